import textwrap

import plain
import pytest

from pricing_engine.llm import licenses, queries
from pricing_engine.llm.license_templates import templates

SF_DIR = "/root/testdata/sf0.01"


def test_query_finds_every_notice(spark):
    """Each one-line wording that stands in a document, by plain search."""
    found = {(r.doc_id, r.license) for r in queries.op2_licenses(spark, SF_DIR).collect()}
    short = [(n, w) for n, w in templates() if len(w) < 100]
    docs = plain.read(spark, SF_DIR, "documents")
    want = {(r.doc_id, n) for r in docs for n, w in short if w in r.text}
    assert len(want) > 20 and found == want


def names(text):
    return [(x[2], x[7], x[8]) for x in licenses.scan(text)]


@pytest.mark.parametrize(("name", "wording"), templates())
def test_every_template_is_told_from_the_others(name, wording):
    for text in (wording, "# " + wording.replace("\n", "\n# "), f"Some words before.\n{wording.upper()}\nAnd after that."):
        found = names(text)
        assert [x[0] for x in found] == [name] and found[0][1:] == (0, 0)


def test_differences_are_counted():
    text = dict((n, w) for n, w in reversed(templates()) if len(w) > 200)["Apache-2.0"]
    assert names(text.replace("governing", "that governs")) == [("Apache-2.0", 1, 2)]
    assert names("Licensed under the Apache License, Version 2.0") == [("Apache-2.0", 0, 0)]
    assert names("Licensed under the Apache License, Version 1.1") == []
    assert names("It has no licence and no warranty, all of it is in the public domain somehow") == []
    assert [x[0] for x in names("Released under the MIT License. Licensed under CC BY-SA 4.0.")] == ["CC-BY-SA-4.0", "MIT"]


def test_places_and_savings():
    text = "é" * 50 + "\nReleased under the MIT License.\nmore"
    start, end, name, wording, alone, given, saved, _, _ = next(licenses.scan(text))
    assert text[start:end] == "Released under the MIT License" and given < alone and saved == pytest.approx(1 - given / alone)


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "All rights reserved.", 0), (3, "x\n" * 100_000 + "Released under the MIT License.", 0)]
    rows += [(4, "Licensed under CC BY 4.0.", 0)] * 2
    found = licenses.found_licenses(spark.createDataFrame(rows, "doc_id long, text string, start int"))
    assert sorted(((r.doc_id or 0, r.license) for r in found.collect())) == [(0, "Proprietary"), (3, "MIT"), (4, "CC-BY-4.0"), (4, "CC-BY-4.0")]
    assert licenses.found_licenses(spark.createDataFrame([], "doc_id int, text string")).collect() == []


LONG = [(n, w) for n, w in templates() if len(licenses.words(w)) >= licenses.SHORT]
FILLER = ("some plain words of a page that tell about the weather in the north and what people there do about it " * 40).split()


@pytest.mark.parametrize("width", [60, 72, 78, 80])
@pytest.mark.parametrize(("name", "wording"), LONG)
def test_wrapped_wordings(name, wording, width):
    lines = [x for part in wording.split("\n") for x in textwrap.wrap(part, width)]
    for before in ("", "# ", " * ", "// "):
        text = "int x = 1;\n" + "\n".join(before + x for x in lines) + "\nint y = 2;"
        assert names(text) == [(name, 0, 0)]


@pytest.mark.parametrize(("name", "wording"), templates())
def test_notices_inside_longer_lines(name, wording):
    for around in (0, 1, 10, 20, 40, 80, 160):
        text = " ".join(FILLER[:around]) + " " + wording + " " + " ".join(FILLER[around : 2 * around])
        assert names(text) == [(name, 0, 0)]


@pytest.mark.parametrize(("name", "wording"), LONG)
def test_edits_up_to_the_bound(name, wording):
    """Replaced words count as missing and as added; one in twelve is within a tenth, one in seven is not."""
    for step, found in ((12, True), (7, False)):
        edited = " ".join("zebra" if i % step == 5 else w for i, w in enumerate(wording.split()))
        got = [x for x in names("before it\n" + edited + "\nafter it") if x[0] == name and x[1]]
        assert bool(got) == found


def test_many_notices_in_a_text():
    """Every copy is found, whatever blocks they fall in."""
    mit, short = dict(reversed(LONG))["MIT"], "Released under the MIT License."
    text = " ".join([mit, "and", short, " ".join(FILLER[:100])] * 20)
    assert names(text) == [("MIT", 0, 0)] * 40
    assert names(" ".join(["Licensed under CC BY 4.0."] * 500)) == [("CC-BY-4.0", 0, 0)] * 500
