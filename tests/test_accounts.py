"""Accounts of page readers: every code, every rung of the ladder, both channels, and what is shown of them."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from veilscan.operators import accounts as A
from veilscan.operators import channels as C


def account(kind="image", texts=("MRN: A12345", "Research about diabetes"), **more):
    units = [{"ordinal": i, "render_status": "completed", "ocr_status": "completed", "text": t, "truncated": False} for i, t in enumerate(texts, 1)]
    return {
        "protocol": "parser-accounting/v1", "kind": kind, "original_unit_count": len(texts), "units_omitted": 0, "page_accounting_complete": True, "limited": False, "reason_codes": [],
        "legibility_verified": False, "nonvisual_content_present": False if kind == "image" else None, "text_characters": sum(map(len, texts)), "units": units,
    } | more


def words(text, line=1):
    return [{"text": w, "left": 0.1 * i + 0.05, "top": 0.1, "right": 0.1 * i + 0.14, "bottom": 0.2, "block": 1, "line": line} for i, w in enumerate(text.split())]


def pdf(texts=("a b", "c"), native=None, verified=True, bare=None, texts_drawn=3, **more):
    """Every page read twice; `native` is what the file says where it isn't the same."""
    native = texts if native is None else native
    a = account("pdf", texts)
    for u, n in zip(a["units"], native, strict=True):
        u |= {"native_status": "completed", "native_text": n, "native_text_truncated": False}
        if verified:
            u |= {"geometry_verified": True, "geometry_reason": "verified", "pixel_width": 100, "pixel_height": 50, "ocr_words": words(u["text"]), "native_words": words(n)}
    a["text_characters"] += sum(map(len, native))
    if bare is not None:
        counts = dict.fromkeys(A.FEATURES, 0) | {"native_text_operations": texts_drawn, "image_uses": 4} | ({} if bare else {"forms": 1})
        a["pdf_features"] = {"protocol": "pdf-features/v1", "status": "completed", "inventory_complete": True, "can_extract": True, "ancillary_absent": bare, "original_page_count": len(texts), "encrypted": False, "feature_counts": counts}
    return a | more


def changed(a, *path, to):
    out = copy.deepcopy(a)
    at = out
    for p in path[:-1]:
        at = at[p]
    if to is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = to
    return out


FAILED_FRAME = account() | {"page_accounting_complete": False, "limited": True, "reason_codes": ["pixel_limit", "something of its own", "pixel_limit"], "text_characters": 11}
FAILED_FRAME["units"][1] |= {"render_status": "failed", "ocr_status": "not_attempted", "text": ""}
I, P = account(), pdf()
TWO_LINES = pdf(("a b c",), more=1)
for key in ("ocr_words", "native_words"):
    TWO_LINES["units"][0][key][1]["line"] = 2
FULL, UNSEEN, OVERLAP, PART = "full", A.UNVERIFIED, A.UNRESOLVED, "partial"

#: name -> (kind, account, status, reason, code)
CASES = {
    "frames": ("image", I, FULL, None, None), "blank frames": ("image", account(texts=("", "")), FULL, None, None), "one frame failed": ("image", FAILED_FRAME, PART, A.UNREAD, None),
    "frames left out": ("image", account(texts=("x",)) | {"original_unit_count": 3, "units_omitted": 2, "page_accounting_complete": False, "reason_codes": ["page_limit"]}, PART, A.UNREAD, None),
    "nothing known": ("image", account(texts=()) | {"original_unit_count": None, "units_omitted": None, "page_accounting_complete": False}, PART, A.UNREAD, None), "nonvisual": ("image", changed(I, "nonvisual_content_present", to=True), PART, A.UNINSPECTED, None),
    "pages": ("pdf", P, PART, UNSEEN, None), "pages without places": ("pdf", pdf(verified=False), PART, OVERLAP, None), "pages read once": ("pdf", account("pdf"), PART, OVERLAP, None), "pages differ": ("pdf", pdf(("a b",), ("a x",)), PART, OVERLAP, None),
    "bare pages with text": ("pdf", pdf(bare=True), PART, UNSEEN, None), "bare pictures": ("pdf", pdf(("a b", ""), ("", ""), bare=True, texts_drawn=0), FULL, None, None), "forms": ("pdf", pdf(("a b",), ("",), bare=False, texts_drawn=0), PART, UNSEEN, None),
    "gap of features only": ("pdf", P | {"reason_codes": ["pdf_feature_limit"]}, PART, UNSEEN, None), "one frame not complete": ("pdf", P | {"reason_codes": ["page_limit"], "page_accounting_complete": False}, PART, A.UNREAD, None),
    "null": ("image", None, None, None, A.INVALID), "no json": ("image", "{", None, None, A.INVALID), "list": ("image", [1], None, None, A.INVALID), "key twice": ("image", '{"kind":"image","kind":"image"}', None, None, A.INVALID), "kind": ("pdf", I, None, None, A.INVALID), "no kind": (None, I, None, None, A.INVALID),
    "other kind": ("text", I | {"kind": "text"}, None, None, A.INVALID), "protocol": ("image", I | {"protocol": "other"}, None, None, A.INVALID), "total": ("image", I | {"original_unit_count": 3}, None, None, A.INVALID), "total true": ("image", I | {"original_unit_count": True}, None, None, A.INVALID),
    "total 2.0": ("image", I | {"original_unit_count": 2.0}, None, None, A.INVALID), "omitted": ("image", I | {"units_omitted": 1}, None, None, A.INVALID), "omitted null": ("image", I | {"units_omitted": None}, None, None, A.INVALID), "ordinal": ("image", changed(I, "units", 1, "ordinal", to=1), None, None, A.INVALID),
    "render": ("image", changed(I, "units", 0, "render_status", to="failed"), None, None, A.INVALID), "ocr": ("image", changed(I, "units", 0, "ocr_status", to="failed"), None, None, A.INVALID), "no text": ("image", changed(I, "units", 0, "text", to=None), None, None, A.INVALID),
    "unit": ("image", changed(I, "units", 0, to=7), None, None, A.INVALID), "101 units": ("image", account(texts=("",) * 101), None, None, A.INVALID), "100 units": ("image", account(texts=("",) * 100), FULL, None, None), "characters": ("image", I | {"text_characters": 0}, None, None, A.INVALID),
    "limited": ("image", I | {"limited": True}, None, None, A.CONTRADICTED), "limited 1": ("image", I | {"limited": 1}, None, None, A.INVALID), "legible": ("image", I | {"legibility_verified": True}, None, None, A.LEGIBILITY), "nonvisual null": ("image", I | {"nonvisual_content_present": None}, None, None, A.INVALID),
    "codes": ("image", I | {"reason_codes": [1]}, None, None, A.INVALID), "codes null": ("image", I | {"reason_codes": None}, None, None, A.INVALID), "claims less": ("image", I | {"page_accounting_complete": False}, None, None, A.CONTRADICTED),
    "native in one": ("pdf", changed(P, "units", 0, "native_status", to=KeyError), None, None, A.NATIVE_MIXED), "native status": ("pdf", changed(P, "units", 0, "native_status", to="odd"), None, None, A.NATIVE_INVALID), "native text": ("pdf", changed(P, "units", 1, "native_status", to="failed"), None, None, A.NATIVE_INVALID),
    "long": ("image", account(texts=("x" * 1_000_001,)), None, None, A.INVALID), "cut between": ("image", account(texts=("x" * 600_000, "y" * 400_000)), PART, A.CUT, None), "both long": ("pdf", pdf(("x" * 600_000,), verified=False), None, None, A.NATIVE_INVALID),
    "unasked long": ("pdf", changed(account("pdf", ("x" * 600_000,)), "units", 0, "native_text", to="y" * 600_000), None, None, A.TOO_MUCH_TEXT), "claim": ("pdf", changed(P, "units", 0, "geometry_verified", to=1), None, None, A.BAD_CLAIM), "claim reason": ("pdf", changed(P, "units", 0, "geometry_reason", to="geometry_limit"), None, None, A.BAD_CLAIM),
    "no claim": ("pdf", changed(P, "units", 0, "geometry_verified", to=KeyError), None, None, A.BAD_CLAIM), "width": ("pdf", changed(P, "units", 1, "pixel_width", to=None), None, None, A.BAD_SIZE), "pixels": ("pdf", changed(P, "units", 1, "pixel_width", to=400_001), None, None, A.BAD_SIZE),
    "unread": ("pdf", changed(P, "units", 0, "native_text_truncated", to=True) | {"page_accounting_complete": False}, None, None, A.BAD_CHANNEL), "words": ("pdf", changed(P, "units", 0, "ocr_words", to={}), None, None, A.BAD_LIST), "no words": ("pdf", changed(P, "units", 0, "ocr_words", to=KeyError), None, None, A.BAD_WORDS),
    "other words": ("pdf", changed(P, "units", 0, "ocr_words", 0, "text", to="z"), None, None, A.OTHER_TEXT), "word": ("pdf", changed(P, "units", 0, "ocr_words", 0, "left", to=0.2), None, None, A.BAD_WORDS), "word true": ("pdf", changed(P, "units", 0, "ocr_words", 0, "right", to=True), None, None, A.BAD_WORDS),
    "word 1": ("pdf", changed(pdf(("a",)), "units", 0, "ocr_words", 0, "right", to=1), PART, OVERLAP, None), "line 1.0": ("pdf", changed(P, "units", 0, "ocr_words", 0, "line", to=1.0), None, None, A.BAD_WORDS), "torn": ("pdf", TWO_LINES, None, None, A.TORN_LINE),
    "many words": ("pdf", pdf(("",), bare=None) | {"units": [], "original_unit_count": None, "units_omitted": None, "page_accounting_complete": False}, PART, A.UNREAD, None), "features": ("pdf", P | {"pdf_features": {}}, None, None, A.BAD_FEATURES), "bare": ("pdf", changed(pdf(bare=True), "pdf_features", "ancillary_absent", to=False), None, None, A.FEATURES_CONTRADICTED),
    "a count": ("pdf", changed(pdf(bare=True), "pdf_features", "feature_counts", "xfa", to=KeyError), None, None, A.BAD_FEATURES), "count 0.5": ("pdf", changed(pdf(bare=True), "pdf_features", "feature_counts", "xfa", to=0.5), None, None, A.BAD_FEATURES), "pages differ in number": ("pdf", changed(pdf(bare=True), "pdf_features", "original_page_count", to=3), None, None, A.PAGES_CONTRADICTED),
}


@pytest.fixture(scope="module")
def done(spark):
    rows = [(name, kind, a if a is None or isinstance(a, str) else json.dumps(a)) for name, (kind, a, *_) in CASES.items()]
    return A.accounted(spark.createDataFrame(rows, "doc string, kind string, report string").repartition(3))


def test_ladder_and_codes(done):
    got = {r["doc"]: (r["status"], r["reason"], r["fault"]) for r in done.documents.collect()}
    assert got == {n: (status or "failed", reason if status else A.REFUSED, code) for n, (_, _, status, reason, code) in CASES.items()}


def test_what_documents_hold(done):
    d = {r["doc"]: r for r in done.documents.collect()}
    assert (d["frames"]["text"], d["frames"]["examined"], d["frames"]["unit"], d["frames"]["annotations"]) == ("MRN: A12345\fResearch about diabetes", 2, "frames", "not_applicable")
    assert (d["one frame failed"]["text"], d["one frame failed"]["examined"], d["one frame failed"]["reasons"]) == ("MRN: A12345\f", 1, ["pixel_limit", A.OTHER_REASON])
    assert (d["frames left out"]["omitted"], d["nothing known"]["total"], d["null"]["text"], d["null"]["unit"], d["null"]["examined"]) == (2, None, None, "bytes", 0)
    assert (d["pages"]["text"], d["pages"]["suppressed"], d["pages"]["reconciled"], d["pages"]["nonvisual"], d["pages"]["annotations"]) == ("a b\fc", 2, True, True, "unverified")
    assert (d["pages without places"]["text"], d["pages differ"]["text"], d["pages read once"]["text"]) == ("a b\n\na b\fc\n\nc", "a x\n\na b", "MRN: A12345\fResearch about diabetes")
    assert (d["bare pictures"]["text"], d["bare pictures"]["native_verified"], d["bare pictures"]["nonvisual"], d["bare pictures"]["annotations"]) == ("a b\f", True, False, "none_present")
    assert len(d["cut between"]["text"]) == 1_000_000 and d["cut between"]["truncated"]


def test_units_make_the_document_plan(done):
    units = {(r["doc"], r["unit"]): (r["eligible"], r["reason"]) for r in done.units.collect()}
    assert units["pages", 1] == (True, "verified") and units["one frame not complete", 2] == (False, C.INCOMPLETE) and units["pages read once", 1] == (False, "geometry_unavailable")
    assert units["cut between", 2] == (False, C.TRUNCATED) and not any(d == "null" for d, _ in units)
    documents = done.documents.where("fault is null").select("doc", "text", "truncated")
    rest = {r["doc"]: (r["fallback"], r["reason"]) for r in C.document_channels(documents, done.units, done.words)[2].collect()}
    told = {n: (False, "aligned") for n, (_, _, _, _, code) in CASES.items() if not code} | {"nothing known": (True, C.NO_UNITS), "many words": (True, C.NO_UNITS), "cut between": (True, C.TRUNCATED)}
    assert rest == told


def test_words_of_a_whole_document(spark):
    lines = [" ".join(f"w{i}" for i in range(8))] * 90
    a = pdf(tuple(lines))
    for u in a["units"]:
        for key in ("ocr_words", "native_words"):
            u[key] = [w | {"line": n, "top": n / 100, "bottom": n / 100 + 0.005} for n in range(1, 9) for w in words(lines[0])]
        u |= {"text": "\n".join(lines[:8]), "native_text": "\n".join(lines[:8])}
    a["text_characters"] = sum(len(u["text"]) * 2 for u in a["units"])
    half = a | {"units": a["units"][:70], "original_unit_count": 70, "text_characters": sum(len(u["text"]) * 2 for u in a["units"][:70])}
    rows = [("over", "pdf", json.dumps(a)), ("under", "pdf", json.dumps(half))]
    got = {r["doc"]: (r["fault"], r["suppressed"]) for r in A.accounted(spark.createDataFrame(rows, "doc string, kind string, report string")).documents.collect()}
    assert got == {"over": (A.TOO_MANY_WORDS, None), "under": (None, 560)}


def test_empty_table(spark):
    none = A.accounted(spark.createDataFrame([], "id long, kind string, report string"), "id")
    assert none.documents.collect() == none.units.collect() == none.words.collect() == []


def test_coverage_view(spark):
    kept = I | {"extractor": "isolated_page_ocr"}
    cases = {
        "plain": (I, (True, 2, 2, 0, True, False, False)), "below": ({"page_ocr": kept | {"protocol": 1}}, (True, 2, 2, 0, True, False, False)), "other": ({"a": 1}, None), "null": (None, None), "no json": ("{", None), "empty": ("", None), "long": (I | {"more": "x" * 300_000}, None), "no units": (I | {"units": None}, (False,)),
        "failed": (FAILED_FRAME | {"nonvisual_content_present": None, "embedded_annotation_coverage": "unverified"}, (True, 2, 1, 0, False, True, True)), "unknown": (account(texts=()) | {"original_unit_count": None, "units_omitted": None}, (True, None, 0, None, False, False, False)),
        "total": (I | {"original_unit_count": 0}, (False,)), "omitted": (I | {"units_omitted": 1}, (False,)), "unknown with units": (I | {"original_unit_count": None, "units_omitted": None}, (False,)), "ordinal": (changed(I, "units", 1, "ordinal", to=3), (False,)), "render": (changed(I, "units", 1, "render_status", to="failed"), (False,)),
        "kept": (changed(changed(I, "units", 1, "truncated", to=KeyError), "units", 1, "text_truncated", to=True), (True, 2, 1, 0, False, False, False)), "no flag": (changed(I, "units", 1, "truncated", to=KeyError), (False,)),
    }
    rows = [(n, a if a is None or isinstance(a, str) else json.dumps(a)) for n, (a, _) in cases.items()]
    got = spark.createDataFrame(rows, "n string, report string").select("n", A.coverage_view(F.col("report")).alias("v")).collect()
    for r in got:
        want = cases[r["n"]][1]
        assert (r["v"] and (tuple(r["v"])[:-1] if r["v"]["valid"] else (r["v"]["valid"],))) == want, r["n"]
    assert [tuple(u) for u in next(r["v"]["units"] for r in got if r["n"] == "plain")] == [(1, "completed", "completed", False, None), (2, "completed", "completed", False, None)]
