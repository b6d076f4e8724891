from collections import Counter

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from pricing_engine.llm import line_dedup, queries

PAGE = "host string, text string, n_lines string"


def plainly(rows, ratio, least):
    key = lambda line: line.strip(" \t\r\f\x0b")
    totals, on = Counter(h for h, _ in rows), Counter()
    for host, text in rows:
        on.update({(host, key(x)) for x in (text or "").split("\n")})
    gone = {k for k, n in on.items() if k[1] and n >= least and n > ratio * totals[k[0]]}
    out = []
    for host, text in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if (host, key(x)) not in gone]
        out.append((host, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert difference(queries.op7_line_dedup(spark, sf_dir), connect(sf_dir), queries.ORACLES["op7_line_dedup"]) is None


@pytest.mark.parametrize(("ratio", "least"), [(0.1, 5), (0.5, 2), (0.0, 1)])
def test_equals_plain_form(spark, ratio, least):
    rows = [("a", f"menu\n  menu \nbody {i}\n\n") for i in range(12)] + [("b", "menu\nown"), ("b", None), ("b", "")]
    rows += [(None, f"menu\nx{i % 2}") for i in range(6)] + [("long", "line\n" * 30_000 + "end")] * 3
    frame = spark.createDataFrame([(*r, "clash") for r in rows], PAGE)
    found = line_dedup.drop_frequent_lines(frame, "host", "text", ratio, least).collect()
    assert sorted((tuple(r) for r in found), key=str) == plainly(rows, ratio, least)


def test_no_rows_and_other_columns(spark):
    assert line_dedup.drop_frequent_lines(spark.createDataFrame([], PAGE), "host", "text").collect() == []
    frame = spark.createDataFrame([("h", "x", 1, 2, 3)], "host string, text string, row_key int, gone int, page_key int")
    found = line_dedup.drop_frequent_lines(frame, "host", "text", counted_lines=False)
    assert [tuple(r) for r in found.collect()] == [("h", "x", 1, 2, 3)] and found.columns == frame.columns


def test_hosts_and_text(value):
    host = lambda u: value(line_dedup.host_of(F.lit(u)))
    assert [host(u) for u in ("https://www.A.org:8/x", "http://u@b.net?q", "nothing", None)] == ["a.org", "b.net", "", None]
    html = "<p>One</p><script>x('</p>')</script>two<br/>three <b>bold</b><!-- <p> -->"
    assert value(line_dedup.page_text(F.lit(html))).split() == ["One", "two", "three", "bold"]
    assert value(line_dedup.page_text(F.lit("<a " + "x" * 300_000))) is not None
