"""License scans by conditional compression.

Words that notices hold are anchors.  The words around an anchor, as many as a template
has to both sides whatever the line ends, are candidate blocks.  A block is compressed
alone and with each template as a raw dictionary; templates that save enough of their
own size are compared word by word, and the best is reported if the wording differs
little enough.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricing_engine.llm.common import slices
from pricing_engine.llm.license_templates import templates

# looked for in words joined by one space, so that line ends and comment marks don't part them
CUES = re.compile(
    r"licen[sc]|copyright|\bspdx|warrant(?:y|ies)|permission is hereby|permission to use|redistribut|public domain"
    r"|rights reserved|creative commons|copyleft|\bcc0\b|free software|free and unencumbered|opensource org|gnu org"
)
# every cue holds one of these, which is quicker to tell
PLAIN = (
    "licen", "copyright", "spdx", "warrant", "permission", "redistribut", "domain", "reserved", "commons", "copyleft",
    "cc0", "software", "unencumbered", "opensource", "gnu",
)
SHORT = 20  # words; templates of fewer must be whole, and have blocks of their own
LEAST_SAVED = 0.02  # of a template's own compressed size
MOST_MISSING = 0.1  # of a template's words
LEVEL = 13  # quicker levels overlook short matches near the end of a block
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_GONE = "\n"  # stands for words of a notice that has been found; never a word


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Template(NamedTuple):
    rank: int
    name: str
    wording: str
    words: list[str]
    counts: Counter
    missing: int  # words that may be missing
    added: int  # words that may stand in between
    size: int  # bytes, compressed alone
    given: zstandard.ZstdCompressor


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, list[list[Template]]]:
    """A compressor without dictionary, and the templates: long ones, short ones."""
    options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    alone = zstandard.ZstdCompressor(**options)
    long: list[Template] = []
    short: list[Template] = []
    for rank, (name, wording) in enumerate(templates()):
        own = words(wording)
        plain = " ".join(own).encode()
        # compressors take eight bytes at least as a dictionary
        book = zstandard.ZstdCompressionDict(plain.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=LEVEL)
        few = len(own) < SHORT
        most = int(MOST_MISSING * len(own))
        (short if few else long).append(
            Template(
                rank, name, wording, own, Counter(own), 0 if few else most, max(1, most), len(alone.compress(plain)),
                zstandard.ZstdCompressor(dict_data=book, **options),
            )
        )
    return alone, [long, short]


def blocks(anchors: list[int], size: int, reach: int) -> Iterator[tuple[int, int]]:
    """(first, last), last excluded, of runs of words that lie within ``reach`` of an anchor.

    Runs of more than four times ``reach`` come in pieces that overlap by twice
    ``reach``, so that a notice is whole in one of them.
    """
    runs: list[list[int]] = []
    for at in anchors:
        first, last = max(0, at - reach), min(size, at + reach + 1)
        if runs and first <= runs[-1][1]:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    for first, last in runs:
        while last - first > 4 * reach:
            yield first, first + 4 * reach
            first += 2 * reach
        yield first, last


def compared(template: Template, own: list[str]) -> tuple[int, int, int, int] | None:
    """(first word, end, template words missing, words added in between), None if too much differs.

    The longest run in common is where the two are laid on each other; if the words
    there differ too much, the next longest is taken.
    """
    n = len(template.words)
    # a wording that may pass has a run at least this long between its differences
    least = max(1, (n - template.missing) // (template.missing + template.added + 1))
    own = list(own)
    while True:
        run = SequenceMatcher(None, template.words, own, autojunk=False).find_longest_match()
        if run.size < least:
            return None
        start = max(0, run.b - run.a - template.added)
        near = own[start : run.b + n - run.a + template.added]
        if n - sum((template.counts & Counter(near)).values()) <= template.missing:
            pairs = SequenceMatcher(None, template.words, near, autojunk=False).get_matching_blocks()[:-1]
            found = sum(r.size for r in pairs)
            first, last = pairs[0].b, pairs[-1].b + pairs[-1].size
            if n - found <= template.missing and last - first - found <= template.added:
                return start + first, start + last, n - found, last - first - found
        own[run.b : run.b + run.size] = [_GONE] * run.size


def scan(text: str | None) -> Iterator[tuple]:
    """(start, end, license, wording, bytes alone, bytes given, saved, missing, added) of a whole text."""
    if not text:
        return
    lowered = text.lower()
    if not any(map(lowered.__contains__, PLAIN)):
        return
    places = [m.span() for m in _WORD.finditer(text)]
    own = [text[a:b].lower() for a, b in places]
    starts = list(accumulate((len(w) + 1 for w in own), initial=0))
    anchors = [bisect_right(starts, m.start()) - 1 for m in CUES.finditer(" ".join(own))]
    if not anchors:
        return
    alone, kinds = _compressors()
    for known in kinds:
        reach = max(len(t.words) + t.added for t in known)
        for low, high in blocks(anchors, len(own), reach):
            while True:
                block = own[low:high]
                plain = " ".join(w for w in block if w != _GONE).encode()
                size = len(alone.compress(plain))
                held = Counter(block)
                best = None
                for t in known:
                    given = len(t.given.compress(plain))
                    if size - given < LEAST_SAVED * t.size:
                        continue
                    if len(t.words) - sum((t.counts & held).values()) > t.missing:
                        continue
                    place = compared(t, block)
                    if place is not None:
                        *_, missing, added = place
                        differing = missing + added
                        row = (len(t.words) - differing, -differing, size - given, -t.rank, place, t, given)
                        best = row if best is None or row[:4] > best[:4] else best
                if best is None:
                    break
                *_, (first, last, missing, added), t, given = best
                first, last = low + first, low + last
                yield (
                    places[first][0], places[last - 1][1], t.name, t.wording, size, given, (size - given) / size, missing,
                    added,
                )
                own[first:last] = [_GONE] * (last - first)


SCHEMA = (
    "doc_id long, start int, end int, license string, bytes_alone int, bytes_given int, saved double, "
    "missing_words int, added_words int, match string"
)


def found_licenses(docs: DataFrame) -> DataFrame:
    """A row for every license notice in ``docs`` (doc_id, text), in whole texts.

    start, end: characters of the notice; bytes_alone, bytes_given: the size of its
    block compressed alone and given the license's wording; saved: the share that
    this saves; missing_words, added_words: how the wording differs; match: ``exact``
    or ``modified``.  Blocks may hold several notices; line ends and marks before
    lines don't matter.  Null or empty texts have none; repeated rows give rows of
    their own; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for start, end, name, _, plain, given, saved, missing, added in scan(text):
                        match = "modified" if missing or added else "exact"
                        out.append((doc_id, start, end, name, plain, given, saved, missing, added, match))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=_NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCHEMA)


_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_KINDS = [_ARROW[f.split()[1]] for f in SCHEMA.split(", ")]
