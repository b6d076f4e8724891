"""Plain definitions of the string ratios, for small fixtures."""

from __future__ import annotations


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return (1.0 - (total - 2 * lcs(a, b)) / total) * 100 if total else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    only_l, only_r = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and not (only_l and only_r):
        return 100.0
    head = len(" ".join(shared))
    gap = 1 if head else 0
    n_l, n_r = head + gap + len(only_l), head + gap + len(only_r)
    best = 100.0 - 100 * (len(only_l) + len(only_r) - 2 * lcs(only_l, only_r)) / (n_l + n_r)
    if head:
        best = max(best, 100.0 - 100 * (n_l - head) / (head + n_l), 100.0 - 100 * (n_r - head) / (head + n_r))
    return best


def partial(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0

    def windows(short: str, long: str) -> list[str]:
        m, n = len(short), len(long)
        return [long[max(s, 0) : s + m] for s in range(1 - m, n)]

    best = max(ratio(a, w) for w in windows(a, b))
    if len(a) == len(b):
        best = max(best, max(ratio(b, w) for w in windows(b, a)))
    return best
