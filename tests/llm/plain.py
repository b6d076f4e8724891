"""Plain forms of the operators, for comparison on small tables."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width, lower=False):
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text or "")
    if not words:
        return []
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def simhash(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 4, lower=True)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Least node reachable from each, by depth-first search."""
    out = {}
    for node in sorted(nodes):
        if node in out:
            continue
        todo = [node]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = node
                todo += [y for y in nodes if y not in out and linked(x, y)]
    return out


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
