"""Pages from markup: what a page is, what stands outside, and what two readers make of one document."""

import pytest
from pyspark.sql import functions as F

from veilscan.functions.structured import page_sheets
from veilscan.operators import sheets as S
from veilscan.operators.accounts import CUT, UNREAD, UNVERIFIED


def page(text, more=""):
    return f'<div class="{more} page">{text}</div>'


@pytest.mark.parametrize(
    ("markup", "pages", "outside", "sound"),
    [
        (None, [], "", True), ("", [], "", True), ("a", [], "a", True), (page("a") + page("b"), ["a", "b"], "", True), (page("a") + page("") + "x", ["a", ""], "x", True), ("x" + page("<p>a</p>") + "y", ["\n\na\n\n"], "xy", True),
        (page("a<div>b</div>c", "wide"), ["abc"], "", True), (page("a" + page("b") + "c"), ["a\fbc"], "", False), ('<div class="page">a', [], "a", False), (page("a") + "</div>", ["a"], "", False), ("<div>" + page("a"), ["a"], "", False),
        ("<head><title>t</title></head>" + page("a&amp;b<script>x</script>"), ["a&b"], "", True), ('<div class="pages">a</div>', [], "a", True), ('<div class>a</div>', [], "a", True), (page("a\ud800"), ["a\ud800"], "", True),
    ],
)
def test_pages_of_markup(markup, pages, outside, sound):
    assert page_sheets(markup)[:3] == (pages, outside, sound)


#: doc -> (markup, the file's pages, states, (text, mapped, suppressed, unmatched, outside))
CASES = {
    "same": (page("a  b") + page("é"), ["a b", "é"], ["equal", "equal"], ("", True, 2, 0, False)), "outside": (page("a") + "<p>x</p>", ["a"], ["equal"], ("\n\nx\n\n", True, 1, 0, True)),
    "differs": (page("a") + page("c") + page("d"), ["a", "b", "d"], ["equal", "differs", "equal"], ("c", True, 2, 1, False)), "moved": (page("b") + page("a") + "x", ["a", "b"], ["moved", "moved"], ("b\fa\fx", True, 0, 2, True)),
    "missing": (page("a"), ["a", "b"], ["equal", "missing"], ("a", False, 0, None, False)), "surplus": (page("a") + page("b"), ["a"], ["equal", "surplus"], ("a\fb", False, 0, None, False)), "blank": (page("") + page(" "), ["", "\n"], ["equal", "equal"], ("", True, 2, 0, False)),
    "nested": (page("a" + page("b")), ["a b"], ["equal"], ("a\fb", False, 0, None, False)), "no pages": ("<p>a</p>", ["a"], ["missing"], ("a", False, 0, None, True)), "null": (None, ["a"], ["missing"], ("", False, 0, None, False)), "nothing": ("", [], [], ("", False, 0, None, False)),
    "repeats": (page("a") * 3, ["a", "a", "a"], ["equal"] * 3, ("", True, 3, 0, False)), "null page": (page("a") + page(""), ["a", None], ["equal", "equal"], ("", True, 2, 0, False)),
}


def tables(spark):
    markup = spark.createDataFrame([(d, m) for d, (m, *_) in CASES.items()], "doc string, markup string").repartition(3)
    native = spark.createDataFrame([(d, i, p) for d, (_, ps, *_) in CASES.items() for i, p in enumerate(ps, 1)] + [("elsewhere", 1, "a")], "doc string, unit int, native_text string").repartition(3)
    return markup, native


def test_pairs(spark):
    markup, native = tables(spark)
    got = {}
    for r in sorted(S.sheet_pairs(S.read_sheets(markup, "doc"), native, "doc").collect(), key=lambda r: r["ordinal"]):
        got.setdefault(r["doc"], []).append(r["state"])
    assert got == {d: states for d, (_, _, states, _) in CASES.items() if states} | {"elsewhere": ["missing"]}


def test_supplements(spark):
    markup, native = tables(spark)
    assert {r["doc"]: tuple(r)[1:] for r in S.supplements(markup, native).collect()} == {d: want for d, (*_, want) in CASES.items()}
    assert S.supplements(markup.where("false"), native).collect() == []


def test_merged(spark):
    rows = [
        ("full", "full", None, "a", True, True, None, None, None), ("agreed", "partial", UNVERIFIED, "a", True, True, "", True, 0), ("more", "partial", UNVERIFIED, "a", True, True, "x", True, 0), ("unmapped", "partial", UNVERIFIED, "a", True, True, "", False, None),
        ("unread", "partial", UNREAD, "a", False, False, "x", True, 0), ("failed", "failed", "r", None, None, None, None, None, None), ("one failed", "failed", "r", None, None, None, "x", True, 1), ("long", "partial", UNVERIFIED, "aaaa", True, True, "xx", True, 0),
    ]
    df = spark.createDataFrame(rows, "doc string, status string, reason string, text string, complete boolean, reconciled boolean, more string, mapped boolean, unmatched long")
    got = S.merged_documents(df, df.where("more is not null").select("doc", F.col("more").alias("text"), "mapped", "unmatched"), maximum=6).collect()
    assert {r["doc"]: tuple(r)[1:] for r in got} == {
        "full": ("full", None, "a", True), "agreed": ("partial", UNVERIFIED, "a", True), "more": ("partial", S.BOTH_UNVERIFIED, "a\fx", False), "unmapped": ("partial", S.BOTH_UNVERIFIED, "a", False),
        "unread": ("partial", UNREAD, "a\fx", False), "failed": ("failed", "r", "", False), "one failed": ("partial", "r", "x", False), "long": ("partial", CUT, "aaaa\fx", False),
    }
