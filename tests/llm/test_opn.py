"""Each opN query against a brute-force version, and on tables of odd rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

from veilscan.llm import pieces as P
from veilscan.llm.credential_scan import ADDRESS, BASE_KINDS, EMAIL, ENDPOINT, IDENTIFIER, KINDS, SCOPE, TOKEN, WEAK_SECRET, all_spans, secret_like
from veilscan.llm.decontamination import RADIUS
from veilscan.llm.quality_rules import judge_quality
from veilscan.llm.queries import queries
from veilscan.llm.shards import assign_shards
from veilscan.llm.token_counts import Rollup, changes, earlier, inserted, tokenizer
from veilscan.llm.url_filter import judge_urls
from veilscan.llm.warc import Response, closed_tags, derive_records, digest, links_of, members, parse_file, plain_text, record_id, response_record, title_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def rows_of(spark, name, folder=SF):
    return queries()[name](spark, folder).collect()


def counter(words, k):
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def similarity(a, b):
    total = (a | b).total()
    return (a & b).total() / total if total else 0.0


def test_op1(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    of = {i: re.findall(r"\w+", (t or "").lower()) for i, t in items}
    by = collections.defaultdict(set)
    for i, w in of.items():
        for s in counter(w, min(5, len(w))) if w else ():
            by[s].add(i)
    want = set()
    for d, t, _, _ in docs:
        w = re.findall(r"\w+", (t or "").lower())
        near = {i for k in range(1, 6) for s in counter(w, k) for i in by.get(s, ())}
        for i in near:
            n, k = min(len(w), len(of[i])), min(5, len(of[i]))
            if any(similarity(counter(w[a : a + n], k), counter(of[i], k)) >= 0.8 for a in range(len(w) - n + 1)):
                want.add((d, i))
    got = rows_of(spark, "op1_simhash_decontamination")
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    assert all(r["similarity"] >= 0.8 and r["hamming"] <= RADIUS and r["start"] < r["end"] for r in got)


def brute_spans(text):
    """The definition: every pair of parts is looked at."""
    base = []
    for kind, pattern, flags, enough in (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII, lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ):
        base += [(kind, *m.span()) for m in re.finditer(pattern, text, flags) if enough(m)]
    clear = lambda m, others: all(m.end() <= s or e <= m.start() for _, s, e in others)
    parts = [(k, *m.span()) for k, p in (("secret", WEAK_SECRET), ("identifier", IDENTIFIER), ("endpoint", ENDPOINT)) for m in p.finditer(text) if clear(m, base)]
    parts += [("identifier", *m.span()) for m in EMAIL.finditer(text) if clear(m, base + parts)] + [("endpoint", *m.span()) for m in ADDRESS.finditer(text) if clear(m, base + [p for p in parts])]
    parts += [("secret", *m.span()) for m in TOKEN.finditer(text) if secret_like(m[0]) and clear(m, base + parts)]

    def meets(a, b):
        gap = text[min(a[2], b[2]) : max(a[1], b[1])]
        return len(gap) <= SCOPE and not re.search(r"\n[ \t\r]*\n", text[min(a[2], b[2]) : max(a[1], b[1]) + 1])

    secret = [p for p in parts if p[0] == "secret"] + [b for b in base if b[0] != "access"]
    other = [p for p in parts if p[0] != "secret"] + [b for b in base if b[0] == "access"]
    found = base + [p for p in parts if any(meets(p, q) for q in (other if p[0] == "secret" else secret))]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


PARTS = ["user_id = bob77", "Zx9kQ2mVb7Lp4Tr8Ys1Wd6", "10.2.3.4:80", "me@host.example.com", "https://h.example/x", "pwd: hunter22", "AKIA" + "A" * 16, "token = abcdefgh1", "plain words", "\n\n", "x " * 100, "\n"]


def test_linking_equals_all_pairs():
    import random

    rng = random.Random(3)
    for _ in range(400):
        t = " ".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        assert all_spans(t) == brute_spans(t), t


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_secret_links")}
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    assert len(got) == len(docs)
    for d, t, _, _ in docs:
        spans = brute_spans(t or "")
        base = [s for s in spans if s[0] in BASE_KINDS]
        n = collections.Counter(k for k, _, _ in base)
        assert (got[d]["n_assign"], got[d]["n_access"], got[d]["n_hex"], got[d]["base_sha256"], got[d]["spans"]) == (n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(spans))


def test_op5(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op5_quality_fm")}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet' where quality is not null").fetchall())
    assert got.keys() == {d for d, *_ in docs}
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    asked = [d for d in labels if d in got and got[d]["held_out"]]
    assert sum(got[d]["predicted"] == labels[d] for d in asked) >= 0.8 * len(asked) and len(asked) > 5


def test_op6(spark, docs):
    encode = tokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary
    want = collections.Counter()
    for _, t, lang, source in docs:
        for i, n in enumerate((1, len(encode(t or "")), len(t or ""))):
            want[source, lang, i] += n
    got = rows_of(spark, "op6_token_rollup")
    assert {(r["source"], r["lang"], i): r[c] for r in got for i, c in enumerate(("n_docs", "n_tokens", "n_chars"))} == {k: v for k, v in want.items()} and len(got) * 3 == len(want)


def test_the_earlier_snapshot_differs_in_every_way(spark):
    now = spark.createDataFrame([(i, "s", "en", "v", 10, 50) for i in range(40)] + [(None, "s", "en", "v", 1, 1)], "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")
    signs = collections.Counter((r["doc_id"] % 10 if r["doc_id"] >= 0 else "gone", r["sign"]) for r in changes(earlier(now), now).collect())
    assert signs == {(3, 1): 4, (5, 1): 4, (5, -1): 4, (8, 1): 4, (8, -1): 4, ("gone", -1): 4}


def test_a_batch_between_listing_and_folding_counts_once(spark, tmp_path):
    r = Rollup(spark, str(tmp_path))
    one = lambda n: inserted(spark.createDataFrame([(1, "a", "en", "v", n, 1)], "doc_id int, source string, lang string, tokenizer string, n_tokens long, n_chars long"))
    r.apply("b1", one(5))
    folds = r._sum

    def late(*args):
        r.apply("b2", one(7))
        return folds(*args)

    r._sum = late
    r.compact()
    r._sum = folds
    assert r.totals().first()["n_tokens"] == 12 and r.batches() == ["b1", "b2"]


def test_two_writers_of_a_batch_count_once(spark, tmp_path):
    r = Rollup(spark, str(tmp_path))
    batch = inserted(spark.createDataFrame([(1, "a", "en", "v", 5, 1)], "doc_id int, source string, lang string, tokenizer string, n_tokens long, n_chars long"))
    seen, r._attempts = r._attempts, dict  # neither sees the other
    assert r.apply("b", batch) and r.apply("b", batch)
    r._attempts = seen
    assert r.totals().first()["n_tokens"] == 5 and r.compact() == 1 and r.totals().first()["n_tokens"] == 5


def test_op7(spark):
    pages = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    got = collections.defaultdict(dict)
    for r in rows_of(spark, "op7_warc_derivatives"):
        got[r["page_id"]][r["warc_type"]] = r
    assert got.keys() == {p for p, *_ in pages}
    for p, url, markup in pages:
        source = response_record(url or "", (markup or "").encode())
        for kind, r in got[p].items():
            block = r["block"].encode()
            assert r["refers_to"] == source.headers["WARC-Record-ID"] and r["target_uri"] == (url or "") and r["block_digest"] == digest(block) and r["content_length"] == len(block)
            assert r["record_id"] == record_id(r["refers_to"], kind, digest(block))
        assert got[p].keys() == {"metadata", "conversion"} and got[p]["metadata"]["source_payload_digest"] == digest((markup or "").encode())
        words = re.findall(r"\w+", got[p]["conversion"]["block"])
        assert "<" not in (markup or "") or words


def test_op8(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    got = {r["doc_id"]: r for r in rows_of(spark, "op8_piece_scan")}
    assert got.keys() == {d for d, *_ in docs}
    chunked = P.encode_documents(spark.read.parquet(f"{SF}/documents.parquet"), chunk_chars=1500, fan=3).orderBy("doc_id", "chunk").collect()
    again = collections.defaultdict(list)
    for r in chunked:
        assert r["first"] == len(again[r["doc_id"]]) and r["exact"]
        again[r["doc_id"]] += r["ids"]
    assert sum(r["chunk"] > 3 for r in chunked) > 5 and all(again[d] == library.encode(t or "") for d, t, _, _ in docs)
    for d, t, _, _ in docs:
        ids, points = np.array(library.encode(t or ""), np.int64), np.array([ord(c) for c in (t or "").replace(P.MARK, " ")], np.int64)
        weighted = lambda x: int((np.arange(1, len(x) + 1) % P.DIGEST * x % P.DIGEST).sum() % P.DIGEST)
        r = got[d]
        assert (r["n_tokens"], r["ids_sum"], r["ids_digest"], r["text_digest"], r["exact"]) == (len(ids), int(ids.sum() % P.DIGEST), weighted(ids), weighted(points), P.MARK not in (t or ""))


def test_op9(spark, docs):
    sets = {d: counter(w, min(5, len(w))) if (w := (t or "").lower().split()) else collections.Counter() for d, t, _, _ in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(set)
    for d, c in sets.items():
        for s in c:
            by[s].add(d)
    for a in sets:
        for b in {b for s in sets[a] for b in by[s] if b > a}:
            if similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r["doc_id"]: r["class_id"] for r in rows_of(spark, "op9_weighted_minhash")} == {d: root(d) for d in sets}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls in any column, empty and very long texts, repeated rows and extra columns."""
    at = str(tmp_path_factory.mktemp("odd"))
    words = " ".join(f"w{i % 977}" for i in range(180_000))
    own = "token = 0123456789abcdef0123456789abcdef01234567"
    texts = [(1, words), (1, words), (2, None), (3, ""), (4, " \n\t "), (None, own), (5, own), (5, own + " more"), (6, "\0퟿\U0001f600 x"), (7, "a" * 200_000), (8, "one two three four")]
    rows = [(i, t, "en" if n % 3 else None, "s" if n % 2 else None, None, "mine", "mine", "mine") for n, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _s string, Kept string, row string").write.parquet(f"{at}/documents.parquet")
    pages = [(1, "http://a.com/", "<p>x"), (1, "http://a.com/", "<p>x"), (2, None, None), (None, "", ""), (3, "http://b.net/es/" + "y" * 100_000, "<a " * 300_000)]
    spark.createDataFrame([(*p, "mine") for p in pages], "page_id long, url string, html string, Host string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, "one two three four"), (2, None), (None, ""), (3, words[:400])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = [(1, [0.5] * 64), (1, [0.5] * 64), (None, [1.0] * 64), (2, None), (3, [0.5] * 63), (4, [None] * 64)]
    spark.createDataFrame([(*v, "mine") for v in vectors], "vec_id long, embedding array<float>, Cluster string").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_odd_rows_keep_their_rows(spark, odd, tmp_path):
    for name, n in (("op3_quality_divergence", 11), ("op4_secret_links", 11), ("op5_quality_fm", 11), ("op8_piece_scan", 11), ("op9_weighted_minhash", 11), ("op10_shard_interleave", 11), ("op2_url_markov", 5), ("op7_warc_derivatives", 10), ("op11_ball_clusters", 3), ("op13_line_dedup", 11)):
        assert len(rows_of(spark, name, odd)) == n, name
    assert {(r["doc_id"], r["item_id"]) for r in rows_of(spark, "op1_simhash_decontamination", odd)} == {(1, 3), (8, 1)}
    assert sum(r["n_docs"] for r in rows_of(spark, "op6_token_rollup", odd)) == 11
    assert {(r["item_id"], r["doc_id"]) for r in rows_of(spark, "op12_lexical_max_tree", odd) if r["rank"] == 1} == {(1, 8), (3, 1)}
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_clashing_names_are_kept_or_refused(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "s", *["mine"] * 9)], "doc_id long, text string, lang string, source string, _s string, _h string, _t string, _lang string, class_reference string, b string, r string, f string, s string")
    for f in (lambda: assign_shards(df, "doc_id", "source"), lambda: judge_quality(df), lambda: judge_urls(df, "text")):
        r = f().first().asDict()
        assert all(r[c] == "mine" for c in df.columns[4:])
    again = df.withColumnRenamed("_s", "Shard").withColumnRenamed("_h", "Host").withColumnRenamed("_t", "KEPT")
    assert [c.lower() for c in assign_shards(again, "doc_id", "source").columns].count("shard") == 1 and [c.lower() for c in judge_urls(again, "text").columns].count("host") == 1 and [c.lower() for c in judge_quality(again).columns].count("kept") == 1
    for bad in (df.withColumnRenamed("_s", "__veilscan_x"), df.withColumnRenamed("_s", "R")):
        with pytest.raises(ValueError):
            assign_shards(bad, "doc_id", "source")


def test_hostile_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for unit in ("<a ", "<title>", "<html lang", "<!--", "<p", "href='", "<script ", "<a href=\"", "</td <head "):
        markup = unit * (1_000_000 // len(unit))
        plain_text(markup), title_of(markup, closed_tags(markup)), list(links_of(markup + ">", len(markup) + 1))
    assert time.perf_counter() - began < 20
    began = time.perf_counter()
    all_spans("user_id = bob77 Zx9kQ2mVb7Lp4Tr8Ys1Wd6 http://" + "x" * 5000 + " " + "1.2.3.4 Zx9kQ2mVb7Lp4Tr8Ys1Wd6 me@host.example " * 10_000)
    assert time.perf_counter() - began < 20


def test_cut_and_encoded_responses(spark, tmp_path):
    import gzip

    a, b = (response_record(f"http://{x}/", f"<p>{x * 3000}".encode()) for x in "ab")
    packed = gzip.compress(bytes(a)) + gzip.compress(bytes(b))
    passed = []
    assert list(parse_file(packed, passed)) == [a, b] and passed == []
    cut = packed[:-60]
    assert list(parse_file(cut, passed)) == [a] and passed
    assert list(parse_file(gzip.compress(bytes(a)) + b"\x1f\x8b garbage", passed := [])) == [a] and passed
    assert b"".join(members(gzip.compress(bytes(a) + bytes(b)))) == bytes(a) + bytes(b)
    (tmp_path / "cut.warc.gz").write_bytes(cut)
    from veilscan.llm.warc import read_warc

    assert derive_records(read_warc(spark, str(tmp_path))).count() == 2
    body = gzip.compress(b"<p>hello")
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert Response.parse(head + chunked).content() == b"<p>hello" and Response.parse(head + b"<p>plain").content() == b"<p>plain"
    with pytest.raises(ValueError):
        derive_records(read_warc(spark, str(tmp_path)).withColumnRenamed("file", "Block"), ("Block",))
