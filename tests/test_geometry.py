"""Word rows from recorded markup and tab-separated rows, the faults of each, and the check of a page's mapping."""

import pytest
from pyspark.sql import functions as F

from veilscan.operators.geometry import INVALID, LIMIT, TSV_COLUMNS, UNVERIFIED, Fault, mapping_verified, markup_words, read_boxes, tsv_words, word_text

DOCTYPE = '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">'


def page(body, size='width="200" height="100"', head=DOCTYPE):
    return f'{head}<html xmlns="http://www.w3.org/1999/xhtml"><body><doc><page {size}>{body}</page></doc></body></html>'


def word(text, box=(10, 10, 30, 20)):
    return '<word xMin="{}" yMin="{}" xMax="{}" yMax="{}">'.format(*box) + f"{text}</word>"


def block(*lines):
    return "<flow><block>" + "".join(f"<line>{x}</line>" for x in lines) + "</block></flow>"


GOOD = page(block(word("Ann") + word("R&amp;D", (40, 10, 60, 20)), word("two", (10, 30, 30, 40))) + block(word("far", (100, 50, 200, 100))))


@pytest.mark.parametrize(
    ("markup", "code"),
    [
        (None, INVALID), ("", INVALID), ("<page", INVALID), (page("", 'width="0" height="5"'), INVALID), (page("", 'width="x" height="5"'), INVALID), (page("", 'width="nan" height="5"'), INVALID), (page("", 'height="5"'), INVALID),
        (page("<page width='1' height='1'/>"), INVALID), (page(word("loose")), INVALID), (page(f"<block>{word('x')}</block>"), INVALID), (page(block("<b/>")), INVALID), (page(block(word("a<b/>"))), INVALID),
        (page(block(word("a")), head="<!DOCTYPE html [<!ENTITY x 'y'>]>"), INVALID), (page(block(word("&x;"))), INVALID), (page(block('<word xMin="1" yMin="1" xMax="2">a</word>')), INVALID),
        (page(block(word("a"))) + " " * (4 * 1024 * 1024), LIMIT), (page(block(word("a") * 10_001)), LIMIT),
    ],
)
def test_faults_of_markup(markup, code):
    with pytest.raises(Fault, match=code):
        read_boxes(markup)


def test_words_of_markup(spark):
    odd = {"a b": UNVERIFIED, "": UNVERIFIED, "x" * 513: UNVERIFIED, "a\u0085b": UNVERIFIED}
    boxes = [(30, 10, 30, 20), (-1, 10, 30, 20), (10, 10, 201, 20), (10, 30, 20, 20), (10, 10, 20, 101)]
    rows = [("good", GOOD), ("blank", page("")), ("null", None), ("many", page(block(word("x" * 500) * 501)))]
    rows += [(f"text {t[:3]!r} {len(t)}", page(block(word("fine") + word(t)))) for t in odd] + [(f"box {b}", page(block(word("fine") + word("x", b)))) for b in boxes]
    df = spark.createDataFrame(rows, "page string, markup string").repartition(3)
    got = markup_words(df, ["page"]).collect()
    words = [(r["ordinal"], r["text"], r["left"], r["top"], r["right"], r["bottom"], r["block"], r["line"]) for r in sorted((r for r in got if r["page"] == "good"), key=lambda r: r["ordinal"])]
    assert words == [(0, "Ann", 0.05, 0.1, 0.15, 0.2, 1, 1), (1, "R&D", 0.2, 0.1, 0.3, 0.2, 1, 1), (2, "two", 0.05, 0.3, 0.15, 0.4, 1, 2), (3, "far", 0.5, 0.5, 1.0, 1.0, 2, 1)]
    faults = {r["page"]: r["fault"] for r in got if r["fault"]}
    assert faults == {"null": INVALID, "many": LIMIT} | {f"text {t[:3]!r} {len(t)}": UNVERIFIED for t in odd} | {f"box {b}": INVALID for b in boxes}
    assert all(r["text"] is None and r["left"] is None for r in got if r["fault"]) and len(got) == 4 + len(faults)
    assert word_text(markup_words(df.where("page = 'good'"), ["page"]), ["page"]).first()["text"] == "Ann R&D\ntwo\n\nfar"


def rows_of(*rows, head=TSV_COLUMNS, page_row=(1, 1, 0, 0, 0, 0, 0, 0, 200, 100, -1, "")):
    return "\n".join("\t".join(map(str, r)) for r in [head, *([page_row] if page_row else []), *rows])


def read(text, at=(1, 1, 1, 1), box=(10, 10, 20, 10), level=5, page_num=1):
    return (level, page_num, *at, *box, 95.5, text)


def test_words_of_rows(spark):
    good = rows_of((2, 1, 3, 0, 0, 0, 10, 10, 50, 20, -1, ""), read("b", (3, 1, 2, 1)), read("a", (1, 1, 5, 1), (0, 0, 200, 100)), read("c", (3, 1, 7, 1)), read("", (3, 1, 7, 2)), read("d", (3, 2, 7, 1)), read("e", (3, 1, 2, 2)))
    bad = {
        "header": (rows_of(read("a"), head=TSV_COLUMNS[::-1]), INVALID), "no page": (rows_of(read("a"), page_row=None), INVALID), "two pages": (rows_of((1, 1, 0, 0, 0, 0, 0, 0, 200, 100, -1, "")), INVALID), "null": (None, INVALID),
        "page box": (rows_of(read("a"), page_row=(1, 1, 0, 0, 0, 0, 0, 0, 201, 100, -1, "")), INVALID), "level": (rows_of(read("a", level=6)), INVALID), "page number": (rows_of(read("a", page_num=2)), INVALID), "no number": (rows_of(read("a", ("x", 1, 1, 1))), INVALID),
        "zero": (rows_of(read("a", (0, 1, 1, 1))), INVALID), "twice": (rows_of(read("a"), read("b")), INVALID), "blank": (rows_of(read("a b")), UNVERIFIED), "outside": (rows_of(read("a", box=(190, 10, 20, 10))), INVALID), "nan": (rows_of(read("a", box=("nan", 10, 20, 10))), INVALID),
        "columns": (rows_of((*read("a"), "more")), LIMIT), "large": (rows_of(read("a")) + "\n" * (4 * 1024 * 1024), LIMIT), "first fault decides": (rows_of(read("a b"), read("c", (0, 1, 1, 1))), UNVERIFIED),
    }
    df = spark.createDataFrame([("good", good, 200, 100), ("crlf", good.replace("\n", "\r\n"), 200, 100)] + [(k, t, 200, 100) for k, (t, _) in bad.items()], "page string, tsv string, pixel_width int, pixel_height int").repartition(3)
    got = tsv_words(df, ["page"]).collect()
    for p in ("good", "crlf"):
        words = [(r["text"], r["block"], r["line"]) for r in sorted((r for r in got if r["page"] == p), key=lambda r: r["ordinal"])]
        assert words == [("b", 1, 1), ("a", 2, 1), ("c", 1, 2), ("d", 3, 1), ("e", 1, 1)]
    assert {r["page"]: r["fault"] for r in got if r["fault"]} == {k: code for k, (_, code) in bad.items()}
    assert next(r for r in got if r["text"] == "a")["right"] == 1.0 and len(got) == 10 + len(bad)
    assert tsv_words(df.where("false"), ["page"]).collect() == []


def test_mapping(spark):
    info = "Pages: 2\nPage    2 rot:  0\nPage    2 MediaBox:     0.00     0.00   595.28   841.89\nPage    2 CropBox:      0.00     0.00   595.28   841.89\n"
    rows = [
        (True, info, 2, 595.2756, 841.8898, 1654, 2339), (False, info, 1, 595.2756, 841.8898, 1654, 2339), (False, info.replace("rot:  0", "rot: 90"), 2, 595.2756, 841.8898, 1654, 2339), (False, info.replace("CropBox:      0.00", "CropBox:      1.00"), 2, 595.2756, 841.8898, 1654, 2339),
        (False, info, 2, 595.29, 841.8898, 1654, 2339), (False, info, 2, 595.2756, 841.8898, 1653, 2339), (False, None, 2, 595.2756, 841.8898, 1654, 2339), (False, info, None, 595.2756, 841.8898, 1654, 2339), (False, info, 2, 595.2756, 841.8898, None, 2339), (False, info.replace("595.28", "x"), 2, 595.2756, 841.8898, 1654, 2339),
        (True, info.replace("Page    2 rot", "Page rot").replace("Page    2 ", ""), 2, 595.2756, 841.8898, 1654, 2339),
    ]
    df = spark.createDataFrame(rows, "want boolean, info string, n int, w double, h double, pw int, ph int")
    c = F.col
    assert [r["got"] for r in df.select("want", mapping_verified(c("info"), c("n"), c("w"), c("h"), c("pw"), c("ph")).alias("got")).collect()] == [r[0] for r in rows]
