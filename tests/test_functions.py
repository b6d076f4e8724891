import datetime
import random

import numpy as np
import pandas as pd
import pytest
from brute_force import lcs, partial, token_set, token_sort
from pair_scores import name_scores
from pyspark.sql import functions as F

from pricing_engine.functions import html, ratios, scoring, text
from pricing_engine.functions import payload_fields as P
from pricing_engine.functions.rounding import exact_round, fixed_text

L = F.lit


def test_normalised_name(value):
    assert value(text.normalised_name(L("Oral-B (Pro), A&B/C  x"))) == "oral b pro a and b c x"


def test_shared_token_name(value):
    a = "Kleenex Complete Clean 3 Ply Facial Tissues 95 Pack"
    b = "Kleenex Complete Clean Facial Tissues 3 Ply 95 Pack"
    assert value(text.shared_token_name(F.array(L(a), L(b)))) == a
    assert value(text.shared_token_name(F.array(L("one Name")))) == "one Name"
    assert value(text.shared_token_name(F.array(L("a b"), L("c d")))) == "a b"
    assert value(text.shared_token_name(F.array().cast("array<string>"))) == ""


def test_title_case_after_every_non_letter(value):
    assert value(text.title_case(L("carman's 100ml l'oreal"))) == "Carman'S 100Ml L'Oreal"


def test_attributes_and_numbers(value):
    name = text.normalised_name(L("Kleenex Tissues 3ply 95 pk 1.5 l"))
    found = [value(f(name)) for f in (text.ply_count, text.pack_count, text.size_value, text.size_unit)]
    assert found == ["3", "95", "1.5", "l"]
    assert value(text.standalone_numbers(text.normalised_name(L("Kleenex 3 Ply 95 Pack")))) == []
    assert value(text.standalone_numbers(text.normalised_name(L("Oral-B Pro 1000 Brush")))) == ["1000"]
    assert value(text.brand(text.normalised_name(L(" (")))) == ""


@pytest.mark.parametrize(
    "given", ["2024-05-20T23:30:00+10:00", "2024-05-20 14:30:00", "2024-05-20T14:30:00Z", "20240520"]
)
def test_iso_date(value, given):
    assert value(text.iso_date(L(given))) == datetime.date(2024, 5, 20)
    assert value(text.iso_date(L("junk"))) is None


def test_safe_number(value):
    assert value(text.safe_number(L("2.5"))) == 2.5
    assert value(text.safe_number(L("n/a"))) is None
    assert value(text.safe_number(L(float("nan")))) is None


def test_price_score(value):
    for price, points in [(10, 100), (9.5, 100), (9, 85), (8.5, 70), (7.5, 45), (7, 20)]:
        assert value(scoring.price_score(L(10.0), L(float(price)))) == points
    assert value(scoring.price_score(L(0.0), L(1.0))) is None
    assert value(scoring.price_reason(L(10.0), L(9.0))) == "max_price 10.00 vs 9.00; difference=10.0%"


def test_final_score(value):
    for name, price, final in [(80.0, 100, 85.0), (80.0, None, 80.0), (60.0, 100, 70.0)]:
        assert value(scoring.final_score(L(name), L(price).cast("int"))) == final


def test_discount_and_status(value):
    assert value(scoring.discount(L(9.0), L(12.0))) == 25.0
    assert value(scoring.discount(L(15.0), L(12.0))) == 0.0
    same = L(4.99)
    assert value(scoring.price_status(same, same, same)) == "cheapest"
    assert value(scoring.price_status(same, same, same, "full_first")) == "full price"
    assert value(scoring.price_status(L(3.0), L(4.0), L(5.0))) == "discounted"
    assert value(scoring.dashboard_discount(L(3.0), L(None).cast("double"))) == 0.0


def test_exact_round_follows_the_binary_value(spark):
    rng = random.Random(5)
    values = [rng.randint(0, 10000) / 100 * 0.75 + 25 for _ in range(5000)] + [2.675, 12.25, 0.125, 98.695]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", exact_round(F.col("v"), 2).alias("two"), exact_round(F.col("v"), 1).alias("one"),
        fixed_text(F.col("v"), 2).alias("text"),
    )
    for row in rows.collect():
        assert (row.two, row.one, row.text) == (round(row.v, 2), round(row.v, 1), f"{row.v:.2f}")


def _scored(pairs):
    frame = pd.DataFrame(
        {
            "l_name": [a for a, _ in pairs],
            "r_name": [b for _, b in pairs],
            "l_sorted": [" ".join(sorted(a.split())) for a, _ in pairs],
            "r_sorted": [" ".join(sorted(b.split())) for _, b in pairs],
            "l_only": [" ".join(sorted(set(a.split()) - set(b.split()))) for a, b in pairs],
            "r_only": [" ".join(sorted(set(b.split()) - set(a.split()))) for a, b in pairs],
            "shared": [len(" ".join(set(a.split()) & set(b.split()))) for a, b in pairs],
            "penalty": 0,
        }
    )
    return ratios.score_names(frame, -1000.0)


def test_ratios_equal_their_definitions():
    rng = random.Random(3)
    words = ["kleenex", "tissue", "tissues", "3", "ply", "é", "granola", "1000", "ab", "abc"]
    names = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 5, 15]))) for _ in range(400)]
    pairs = list(zip(names[::2], names[1::2])) + [(n, n) for n in names[:20]]
    got = _scored(pairs)
    want = [(token_set(a, b), token_sort(a, b), partial(a, b)) for a, b in pairs]
    np.testing.assert_array_equal(got[["token_set", "token_sort", "partial"]].to_numpy(), want)


def test_ratio_fixtures():
    pairs = [
        ("kleenex facial tissues 95 pack", "kleenex facial tissues 70 pack"),
        ("oral b pro 1000 brush", "oral b pro brush"),
        ("abc def", "abc xyz"),
    ]
    want = [[94.7368, 93.3333, 93.3333], [100, 86.4865, 81.4815], [60, 57.1429, 72.7273]]
    np.testing.assert_allclose(_scored(pairs).iloc[:, :3], want, atol=1e-4)
    assert ratios.lcs_lengths(["abcde"], ["ace"])[0] == 3


def test_ratios_of_long_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc ", k=k)) for k in (70, 90, 200, 64, 65)]
    pairs = [(a, b) for a in texts for b in texts]
    assert [token_sort(a, b) for a, b in pairs] == _scored(pairs)["token_sort"].tolist()
    assert [partial(a, b) for a, b in pairs] == _scored(pairs)["partial"].tolist()


def test_ids_urls_and_slugs(value):
    assert value(P.detail_id(L("759496"))) == "759496"
    assert value(P.detail_id(L("https://www.shop.example/x/productdetails/759496"))) == "759496"
    assert value(P.slug_id(L("large-n-thick-tissues-70-pack-2372797"))) == "2372797"
    assert value(P.buy_id(L("/buy/80010/kleenex-facial"))) == "80010"
    assert value(P.slug_name(L("raspberry-hair-vinegar"))) == "Raspberry Hair Vinegar"
    assert value(P.absolute_url(L("/buy/1/x"), "https://s", "/buy/", False)) == "https://s/buy/1/x"
    assert value(P.absolute_url(L("1"), "https://s", "/buy/", False)) is None
    assert value(P.absolute_url(L(" /a-b/ "), "https://s", "/product/", True)) == "https://s/product/a-b/"


def test_prices_in_text(value):
    def pack(given):
        return value(P.pack_price(P.money_values(L(given)), L(given)))

    assert pack("$17.66 A$17.66 $8.83 $30.98 $7.75 per  Item " * 2) == 30.98
    assert pack("$20.00 $15.00") == 20.0
    assert pack("no price") is None
    assert value(P.first_positive_price(L("$0.00 x $12.99 y $3.00"))) == 12.99


def test_pack_label(value):
    labels = [value(P.pack_label(L(t))) for t in ("P (150ml), 1 Pack 2 Packs", "2 Packs\n4 packs", "Pack")]
    assert labels == ["1 Pack", "4 Packs", None]


def test_html_text(value):
    page = (
        "<html><title>T &amp; x</title><script>a<b</script><p> a&eacute;&#8364;&#x41; b<br>c &amp;lt; &foo;"
        " &nbsp;</p><!-- z --><noscript>no</noscript><a title='x>y'>z</a></html>"
    )
    assert value(html.visible_text(L(page), True)).split("\n") == ["T & x", "aé€A b", "c &lt; &foo;", "z"]
    assert "no" in value(html.visible_text(L(page)))
    assert value(html.page_name(L("<title>A | S</title><h1> <b>x</b> y </h1>"), " | S")) == "x y"
    assert value(html.page_name(L("<title>A | S</title><h1> </h1>"), " | S")) == "A"
    assert value(html.page_name(L("<p>x</p>"))) == ""


# worked out by hand from the definitions: (left, right, name score)
NAME_SCORES = [
    ("Kleenex Facial Tissues 95 Pack", "Kleenex Facial Tissues 70 Pack", 74.04),
    ("Oral-B Pro 1000 Brush", "Oral-B Pro Brush", 92.49),
    ("Carman's Granola Fruit & Nut 400g", "Carman's Granola Fruit Free 500g", 60.45),
    ("abc def", "abc xyz", 60.91),
    ("Oral-B Pro 1000 Brush", "Oral-B Pro 2000 Brush", 0.0),
    ("Coles Toilet Paper 3 Ply 12 pack", "Quilton Toilet Paper 3 Ply 12 pack", 0.0),
]


def test_name_scores(spark):
    scores = name_scores(spark, [n for left, right, _ in NAME_SCORES for n in (left, right)])
    assert [scores[left, right] for left, right, _ in NAME_SCORES] == [s for _, _, s in NAME_SCORES]
    for (left, right), score in scores.items():
        assert scores[right, left] == score and 0 <= score <= 100
        assert score == 100 or left != right


def test_rounding_of_small_values(spark):
    values = [0.005, 0.015, 0.025, 0.035, 0.045, 0.055, 0.0049999, 1e-9, 0.0, 0.0625, 2.675, 1.005, 0.05, 0.15, 0.25, 98.695]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", exact_round(F.col("v"), 2).alias("two"), exact_round(F.col("v"), 1).alias("one")
    )
    assert [(r.two, r.one) for r in rows.collect()] == [(round(v, 2), round(v, 1)) for v in values]


def test_ratios_of_long_names():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcd ", k=n)) for n in (0, 1, 63, 64, 65, 80, 128, 129, 200, 300)]
    pairs = [(a, b) for a in texts for b in texts]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert ratios.lcs_lengths(left, right).tolist() == [lcs(a, b) for a, b in pairs]
    short = [(a, b) for a, b in pairs if len(a) <= 130 and len(b) <= 130]
    got = ratios.partial_ratios([a for a, _ in short], [b for _, b in short])
    assert got.tolist() == pytest.approx([partial(a, b) for a, b in short])


def test_pages_that_would_overflow_a_matcher(value):
    huge = "<p>a</p><div " + "x" * 1_000_000 + ">b</div>"
    assert value(html.visible_text(F.lit(huge))) == "a\nb"
    assert value(html.visible_text(F.lit("<p>a</p><i title='open " + "y " * 50_000))).startswith("a")


def test_references(value):
    text = "&dollar;5&period;20 &amp; &#36;&#x24;&#0000000036; &eacute &notin; &unknown; &#1114112; &copy2"
    assert value(html.unescape(F.lit(text))) == "$5.20 & $$$ é ∉ &unknown; &#1114112; &copy2"


def test_token_sort_is_worked_out_only_within_reach_of_the_floor(monkeypatch):
    """A pair whose other scores leave the floor out of reach is not compared char by char."""
    names = [("acme soap 12", "acme soap 13"), ("acme soap 12", "acme elephant trunk deluxe")]
    frame = pd.DataFrame(
        {
            "l_name": [a for a, _ in names], "r_name": [b for _, b in names], "l_sorted": ["12 acme soap"] * 2,
            "r_sorted": ["13 acme soap", "acme deluxe elephant trunk"], "l_only": ["12", "12 soap"],
            "r_only": ["13", "deluxe elephant trunk"], "shared": [9, 4], "penalty": [0, 0],
        }
    )
    whole = ratios.score_names(frame, -1000.0)
    asked, plain = [], ratios.ratios
    monkeypatch.setattr(ratios, "ratios", lambda a, b: asked.extend(a) or plain(a, b))
    found = ratios.score_names(frame, 80.0)
    assert len(asked) == 1 and found.iloc[0].equals(whole.iloc[0])
    assert found.iloc[1].isna().all() and whole.iloc[1]["name_score"] < 80


def test_windows_of_strands_that_no_window_lacks():
    """Chars that lie further apart than the shorter text is long are in no window together."""
    assert ratios.partial_ratios(["aa", "abba"], ["abbaba", "axxbxxbxxa"]).tolist() == pytest.approx([200 / 3, 50.0])
