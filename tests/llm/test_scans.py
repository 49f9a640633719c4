"""Secret scan, quality classifier, token rollups and WARC records."""

import gzip
import re

import numpy as np
import pytest

from veilscan.llm.credential_scan import BASE_KINDS, SCOPE, all_spans, redact_secrets, redacted, scan_secrets
from veilscan.llm.quality_classifier import features, fit, learn, score_documents
from veilscan.llm.token_counts import Rollup, changes, count_tokens, deleted, inserted, pieces, tokenizer, tokenizer_version
from veilscan.llm.warc import Record, derive_pages, derive_records, derived, digest, members, parse_file, parse_records, plain_text, read_warc, response_record, write_warc

KEY = "AKIA" + "ABCDEFGH12345678"
TOKEN = "Zx9kQ2mVb7Lp4Tr8Ys1Wd6"


def brute(text):
    """The base kinds, straight from their definition."""
    out = []
    for kind, pattern, flags, enough in (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII, lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text, flags) if enough(m)]
    return sorted(out, key=lambda x: (x[1], BASE_KINDS.index(x[0])))


@pytest.mark.parametrize("t", ["", "token:token:longvalue123", f"Password = 'abcd1234' {KEY} {'ab' * 20}", "paſſword: abcdefgh toKen: abcdefgh", "secret=short", "a" * 31 + " " + "b" * 32, f"AKIAAKIA{'X' * 10}", 'API_KEY":"x.y-z_=+/12'])
def test_base_spans(t):
    assert [s for s in all_spans(t) if s[0] in BASE_KINDS] == brute(t)


def test_weak_parts_need_each_other():
    assert all_spans(f"see {TOKEN} there") == [] and all_spans("user_id = bob77") == [] and all_spans("at https://host.example/x") == []
    kinds = lambda t: [k for k, _, _ in all_spans(t)]
    assert kinds(f"user_id = bob77 {TOKEN}") == ["identifier", "secret"]
    assert kinds(f"{TOKEN} at https://host.example/x") == ["secret", "endpoint"]
    assert kinds(f"user_id = bob77{' ' * (SCOPE + 1)}{TOKEN}") == [] and kinds(f"user_id = bob77\n \n{TOKEN}") == []
    assert kinds(f"{KEY} pwd: hunter22") == ["access", "secret"]


def test_scan_and_redaction(spark, documents):
    rows = [(1, f"x password: abcd1234 {KEY} y", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (1, f"x password: abcd1234 {KEY} y", "en", "s")]
    df = documents(rows).withColumnRenamed("kept", "spans")
    got = scan_secrets(df).collect()
    assert [len(r["spans"]) for r in got] == [2, 0, 0, 2]
    clean = redact_secrets(df).collect()
    assert clean[0]["text"] == "x [REDACTED] [REDACTED] y" and clean[0]["n_chars"] == len(clean[0]["text"]) and clean[1]["text"] is None and clean[0]["spans"] == "own"
    assert redacted("nothing") == "nothing" and scan_secrets(df.limit(0)).count() == 0
    long = "word " * 200_000 + f"token = {KEY}"
    assert all_spans(long)[0] == ("assign", 1_000_000, len(long))


def test_classifier_learns_and_keeps_to_its_inputs(spark, text, documents):
    rows = [(i, text(120, i) if i % 2 else " ".join(w + "#$%" for w in text(120, i).split()), "en", "s") for i in range(240)]
    docs = documents([*rows, (900, None, None, None), (901, "", "en", "s"), (1, rows[1][1], "xx", "other")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(3, None)], "doc_id long, quality int")
    machine = learn(docs, labels)
    got = score_documents(docs, machine).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] < 240) and len(got) == 243
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert score_documents(docs.limit(0), machine).count() == 0
    assert [r["score"] for r in score_documents(docs, learn(docs, labels.limit(0))).limit(2).collect()] == [0.5, 0.5]


def test_linear_time_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    rows = [features("the cat sat on the mat " * 5, [None]), features("A LOT | OF | PIPES", [3.0])]
    m = fit(rows * 4, np.array([1, 0] * 4, np.float32))
    m.factors = rng.normal(size=m.factors.shape).astype(np.float32)
    at, x = m.row(*rows[0])
    pairs = sum(float(m.factors[at[i]] @ m.factors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
    z = m.bias + float(m.linear[at] @ x) + pairs
    assert abs(m.score("the cat sat on the mat " * 5, [None]) - 1 / (1 + np.exp(-z))) < 1e-4


def counts(spark, *rows):
    return spark.createDataFrame([(i, s, "en", "v", n, 1) for i, s, n in rows], "doc_id int, source string, lang string, tokenizer string, n_tokens long, n_chars long")


def test_rollup_keeps_totals_of_its_batches(spark, tmp_path):
    r = Rollup(spark, str(tmp_path))
    assert r.totals().count() == 0
    first, second = counts(spark, (1, "a", 5), (2, "a", 7), (3, None, 1)), counts(spark, (1, "a", 6), (3, None, 1), (4, "b", 2))
    assert r.apply("b1", inserted(first)) and not r.apply("b1", inserted(first))
    assert r.apply("b2", changes(first, second))
    total = lambda: {x["source"]: (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}
    want = {"a": (1, 6), None: (1, 1), "b": (1, 2)}
    assert total() == want
    assert r.compact() == 1 and total() == want and not r.apply("b2", inserted(second))
    assert r.apply("b3", deleted(counts(spark, (4, "b", 2)))) and total() == {"a": (1, 6), None: (1, 1)}
    assert r.apply("b4", inserted(first.limit(0))) and r.compact() == 2 and total() == {"a": (1, 6), None: (1, 1)}
    with pytest.raises(ValueError):
        r.apply("../x", inserted(first))


def test_failed_batch_is_written_again(spark, tmp_path):
    r = Rollup(spark, str(tmp_path))
    inserted(counts(spark, (1, "a", 99))).write.parquet(str(tmp_path / "deltas/batch=b1"))
    (tmp_path / "deltas/batch=b1/_SUCCESS").unlink()
    assert r.batches() == [] and r.apply("b1", inserted(counts(spark, (1, "a", 5)))) and r.totals().first()["n_tokens"] == 5


@pytest.mark.parametrize("late", [True, False])
def test_compactions_at_once_lose_no_batch(spark, tmp_path, late):
    """One lists before the second batch is committed; both write the same version, in either order."""
    r, other = Rollup(spark, str(tmp_path)), Rollup(spark, str(tmp_path))
    r.apply("b1", inserted(counts(spark, (1, "a", 5))))
    bases, attempts = r._bases(), r._attempts()
    other._bases, other._attempts = lambda: bases, lambda: attempts
    r.apply("b2", inserted(counts(spark, (2, "a", 7))))
    versions = [x.compact() for x in ((r, other) if late else (other, r))]
    total = lambda: [(x["source"], x["n_docs"], x["n_tokens"]) for x in Rollup(spark, str(tmp_path)).totals().collect()]
    assert total() == [("a", 2, 12)] and versions == ([1, 1] if late else [1, 2])
    # A third one that never came to its end doesn't count, and the next base is right again.
    (tmp_path / "base/version=9/attempt=x").mkdir(parents=True)
    r.apply("b3", inserted(counts(spark, (3, None, 1))))
    r.compact()
    assert sorted(total(), key=str) == [("a", 2, 12), (None, 1, 1)] and r.batches() == ["b1", "b2", "b3"]


def test_changes_cancel_what_is_equal(spark):
    a = counts(spark, (1, "a", 5), (1, "a", 5), (2, "a", 1))
    assert changes(a, a).count() == 0
    assert sorted((r["doc_id"], r["sign"]) for r in changes(a, counts(spark, (1, "a", 5), (2, "a", 1))).collect()) == [(1, -1)]


def test_token_counts(spark, documents, text):
    long = text(3000, 1) + "\n\n  x" + text(3000, 2)
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(documents([(1, long, "en", "s"), (2, None, "en", "s"), (3, "", "en", "s")])).collect()}
    encode = tokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary
    assert got == {1: len(encode(long)), 2: 0, 3: 0} and tokenizer_version().startswith("byte_bpe_50k:")
    import veilscan.llm.token_counts as module

    before, module.PIECE_CHARS = module.PIECE_CHARS, 97
    try:
        parts = list(pieces(long))
        assert "".join(parts) == long and len(parts) > 50 and sum(len(encode(p)) for p in parts) == len(encode(long))
    finally:
        module.PIECE_CHARS = before


def test_records_round_trip_and_refer_to_their_source(spark, tmp_path):
    page = '<html lang="en"><head><title>A &amp; B</title></head><body><p>One<br>two</p><script>no</script><a href="/x?a=1&amp;b=2">l</a><!-- no --></body></html>'
    source = response_record("http://e.com/", page.encode(), "2026-01-02T03:04:05Z")
    back = list(parse_records(gzip.compress(bytes(source)) + b""))
    assert back == [source] and derived(back[0]) == derived(source)
    metadata, conversion = derived(source)
    for r in (metadata, conversion):
        assert r.headers["WARC-Refers-To"] == source.headers["WARC-Record-ID"] and r.headers["WARC-Block-Digest"] == digest(r.block) and r.headers["WARC-Date"] == "2026-01-02T03:04:05Z"
    assert conversion.block.decode() == "One\ntwo\nl" and metadata.headers["WARC-Record-ID"] != conversion.headers["WARC-Record-ID"]
    said = metadata.block.decode()
    assert "title: A & B\r\n" in said and "outlink: /x?a=1&b=2 a/@href\r\n" in said and f"source-payload-digest: {digest(page.encode())}\r\n" in said and "http-header-content-type: text/html; charset=utf-8\r\n" in said
    assert derived(conversion) == []
    assert list(parse_records(bytes(source)[:-40])) == [] and list(parse_records(b"")) == []

    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(bytes(source)) + gzip.compress(bytes(conversion)))
    records = read_warc(spark, str(tmp_path / "in.warc.gz"))
    got = derive_records(records, ("file",)).collect()
    assert {r["warc_type"] for r in got} == {"metadata", "conversion"} and {bytes(r["block"]) for r in got} == {metadata.block, conversion.block}
    write_warc(records, str(tmp_path / "out"))
    data = b"".join(bytes(r["record"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert sorted(map(bytes, parse_records(data))) == sorted([bytes(source), bytes(conversion)])


def test_pages_of_all_kinds(spark):
    rows = [(1, "http://a/", "<p>x"), (2, None, None), (None, "u\r\nX: y", ""), (1, "http://a/", "<p>x"), (3, "v", "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = derive_pages(df).collect()
    assert len(got) == 10 and sum(r["page_id"] is None for r in got) == 2
    assert len({r["record_id"] for r in got if r["page_id"] == 1}) == 2 and derive_pages(df.limit(0)).count() == 0
    assert b"\nX: y" not in bytes(Record({"A": "u\r\nX: y"}))
    assert plain_text("x 1 < 2 &lt;p&gt;") == "x 1 < 2 <p>"


def test_pages_that_leave_end_tags_out_keep_their_text():
    own = '<meta charset="utf-8"><title>t <!-- </title>\n<link rel="x"><style>a</style><script>"</head><body>"</script><!-- c -->'
    for page in ("<head>{}<body><p>hello world</p>", "<head>{}<p>hello world</p>", "<head>{}</head><body>hello world", "<head lang=en>{}hello world</html>", "<head>{}<noscript><p>hello world</p>", "<head>{}<template>hello world", "<HEAD>{}<BODY>hello world<script>no end"):
        assert plain_text("<!DOCTYPE html><html>" + page.format(own)) == "hello world", page
    assert plain_text("<p>a<noscript>b</noscript><template>c</template><noscript>d<template>e") == "ade"
    assert plain_text("<p>a<svg><title>drawing</title></svg><!-- b") == "adrawing" and plain_text("<header>a</header><style>b") == "a"
    assert plain_text("<template>" * 50_000 + "x") == "x"
    assert derived(response_record("u", b"<html><head><title>x</title><body><p>hello world</p>"))[1].block == b"hello world"


def test_records_after_a_malformed_one_are_read(spark, tmp_path):
    a, b = (response_record(f"http://{x}/", f"<p>{x}".encode()) for x in "ab")
    for n, bad in enumerate((b"WARC/1.1\r\nWARC-Type: response\r\n\r\nlost WARC/ text\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\nlost\r\n\r\n", b"WARC/1.1\r\nContent-Length: 999999\r\n\r\nlost\r\n\r\n")):
        passed = []
        assert list(parse_records(bytes(a) + bad + bytes(b), passed)) == [a, b] and [x.strip() for x in passed] == [bad.strip()]
        (tmp_path / f"{n}.warc").write_bytes(bytes(a) + bad + bytes(b))
    got = read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 9 and sum(r["headers"] is None and b"lost" in r["block"] for r in got) == 3
    assert derive_records(read_warc(spark, str(tmp_path))).count() == 12
    passed = []
    assert list(parse_records(bytes(a), passed)) == [a] and passed == []


def test_many_gzip_members_take_linear_time():
    import os
    import time

    def took(n):
        data = b"".join(gzip.compress(bytes(Record({"WARC-Type": "resource", "N": str(i)}, os.urandom(3_000)))) for i in range(n))
        start = time.perf_counter()
        assert [int(r.headers["N"]) for r in parse_file(data)] == list(range(n))
        return time.perf_counter() - start

    took(100)
    assert took(8_000) < 12 * took(2_000) + 1


def test_members_of_all_sizes_and_cuts():
    parts = [b"x" * n for n in (0, 1, 65_535, 65_536, 65_537, 200_000)]
    data = b"".join(map(gzip.compress, parts))
    assert list(members(data)) == parts and list(members(b"plain")) == [b"plain"]
    large = bytes(range(256)) * 4_000
    import random

    noise = random.Random(1).randbytes(300_000)
    assert list(members(gzip.compress(noise) + gzip.compress(large))) == [noise, large]
    passed = []
    assert list(members(gzip.compress(b"a") + b"no member", passed)) == [b"a"] and passed == [b"no member"]
    cut = list(members(gzip.compress(noise)[:-100_000], passed := []))
    assert len(cut) == 1 and noise.startswith(cut[0]) and len(cut[0]) > 190_000 and passed == []


def test_names_of_headers_in_any_case():
    a = response_record("http://a/", b"<p>a")
    plain = bytes(a)
    for name in ("WARC-Type", "Content-Length", "WARC-Record-ID", "WARC-Target-URI"):
        plain = plain.replace(name.encode() + b":", name.lower().encode() + b":", 1)
    (got,) = parse_records(plain)
    assert got == a and derived(got) == derived(a)
