"""Near-duplicates, decontamination, pieces and the pipeline."""

import collections
import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
import sentencepiece

from veilscan.llm import pieces as P
from veilscan.llm.common import BYTES_AT_ONCE, ship
from veilscan.llm.components import connected
from veilscan.llm.decontamination import BITS, RADIUS, BlockIndex, find_leaks, packed, signs
from veilscan.llm.near_duplicates import Sampler, Weights, drop_duplicates, duplicate_classes, weighted_jaccard
from veilscan.llm.shingles import counted, keys_of


def edited(t, share, seed):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in t.split())


def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = sum((sets[a] & sets[b]).values())
        total = sum((sets[a] | sets[b]).values())
        if total and both / total >= threshold:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets if any(root(j) == root(i) for j in sets if j != i)}


def test_classes_against_brute_force(spark, text):
    rows = [(i, text(150, i)) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(10)]
    rows += [(200 + i, edited(rows[7][1], 0.015, i)) for i in range(40)]
    rows += [(300 + i, text(60, 999) + " " + text(100, 400 + i)) for i in range(30)]  # a passage that many share
    rows += [(500, None), (501, ""), (502, " "), (503, "one two"), (504, "ONE two"), (505, "x" * 50_000), (506, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in duplicate_classes(df).collect()}
    want = brute_classes(rows)
    assert {k: v for k, v in want.items() if not 200 <= k < 240 and k not in (7, 107)} == {k: v for k, v in got.items() if not 200 <= k < 240 and k not in (7, 107)}
    assert sum(got.get(k) != v for k, v in want.items()) <= 2  # within the group of near copies, at the threshold itself


def test_one_of_each_group_stays(spark, text, documents):
    rows = [(3, text(100, 1), "en", "a"), (2, text(100, 1), "fr", "b"), (2, text(100, 1), "fr", "b"), (9, text(100, 2), "en", "c"), (None, text(100, 1), "en", "a"), (10, None, None, None), (11, None, None, None)]
    kept = drop_duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 2, 9, 10, 11] and kept[0].asDict().keys() == documents(rows).first().asDict().keys()
    assert drop_duplicates(documents(rows).limit(0)).count() == 0


def test_samples_agree_as_often_as_texts_are_similar(text):
    a, b = text(400, 1), edited(text(400, 1), 0.03, 2)
    weights = Weights(np.zeros(1 << 18, np.int64), 10)
    agree, n, s = 0, 0, 0.0
    for seed in range(20):
        sampler = Sampler(seed)
        (ka, na), (kb, nb) = counted(keys_of(a)), counted(keys_of(b))
        x = sampler.samples(np.concatenate([ka, kb]), np.concatenate([na, nb]).astype(np.float32), np.array([0, len(ka)]))
        agree, n = agree + int((x[0] == x[1]).sum()), n + x.shape[1]
        s = weighted_jaccard(ka.tobytes(), na.astype(np.uint32).tobytes(), kb.tobytes(), nb.astype(np.uint32).tobytes(), weights)
    assert abs(agree / n - s) < 4 * (s * (1 - s) / n) ** 0.5 + 0.01


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(6000, 6400)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 3, 300, 20_000])
def test_index_finds_all_within_the_radius(n):
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, (n, 2), np.uint64)
    index = BlockIndex(prints)

    def flipped(p, k):
        bits = np.zeros(BITS, np.int8)
        bits[rng.choice(BITS, k, False)] = 1
        return p ^ packed(bits[None, :])[0]

    asked = np.stack([*prints[:5], *rng.integers(0, 1 << 63, (20, 2), np.uint64), *[flipped(p, k) for k in (RADIUS, RADIUS + 1, 7) for p in prints[:50]]])
    want = [(q, int(i), int(d[i])) for q, f in enumerate(asked) for d in [np.bitwise_count(prints ^ f).sum(1)] for i in np.flatnonzero(d <= RADIUS)]
    assert sorted(zip(*(x.tolist() for x in index.within(asked)), strict=True)) == want and len(want) >= min(n, 5) + 2 * min(n, 50)
    assert (packed(signs(prints[:, 0]))[:, 0] == prints[:, 0]).all()


def brute_leaks(doc, item):
    import re

    w, q = (re.findall(r"\w+", (x or "").lower()) for x in (doc, item))
    n, k = min(len(q), len(w)), min(5, len(q))
    shingles = lambda x: collections.Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    return bool(n) and any(sum((shingles(w[i : i + n]) & shingles(q)).values()) / sum((shingles(w[i : i + n]) | shingles(q)).values()) >= 0.8 for i in range(len(w) - n + 1))


def test_a_large_benchmark_takes_passes(spark, text, documents, monkeypatch):
    from veilscan.llm import decontamination as D

    items = [(i, text(20, 700 + i)) for i in range(12)]
    docs = documents([(i, text(60, i) + " " + items[i][1], "en", "s") for i in range(12)])
    found = lambda: sorted((r["doc_id"], r["text"], r["kept"], tuple(m["item"] for m in r["leaks"])) for r in find_leaks(docs, spark.createDataFrame(items, "item_id int, text string")).collect())
    whole = found()
    monkeypatch.setattr(D, "BLOCK_CHARS", 600)
    assert found() == whole and [r[3] for r in whole] == [(str(i),) for i in range(12)]


def test_leaks_against_brute_force(spark, text, documents):
    items = [(i, text(20 + i % 7, 700 + i)) for i in range(25)] + [(30, None), (31, ""), (32, "just three words"), (33, text(20, 700))]
    rng = random.Random(1)
    rows = []
    for i in range(40):
        words = text(200, i).split()
        if i % 2:
            words[50:50] = edited(items[i % 25][1], rng.choice([0, 0, 0.03, 0.3]), i).split()
        rows.append((i, " ".join(words).replace(" a", ", A") if i % 3 else " ".join(words), "en", "s"))
    rows += [(100, None, None, None), (101, "", "en", "s"), (102, "He said JUST three, words!", "en", "s"), (103, items[0][1], "en", "s")]
    got = find_leaks(documents(rows), spark.createDataFrame(items, "item_id int, text string"), out="kept").collect()
    assert {(r["doc_id"], int(m["item"])) for r in got for m in r["kept"]} == {(i, j) for i, t, _, _ in rows for j, q in items if brute_leaks(t, q)}
    texts = {i: t for i, t, _, _ in rows}
    assert all(texts[r["doc_id"]][m["start"] : m["end"]].lower().split()[:1] for r in got for m in r["kept"])
    none = find_leaks(documents(rows), spark.createDataFrame([], "item_id int, text string")).collect()
    assert all(r["leaks"] == [] for r in none) and find_leaks(documents(rows).limit(0), spark.createDataFrame(items, "item_id int, text string")).count() == 0


def test_documents_shorter_than_an_item_are_compared(spark, text, documents):
    import re

    def similar(doc, item):
        w, q = (re.findall(r"\w+", x.lower()) for x in (doc, item))
        n, k = min(len(q), len(w)), min(5, len(q))
        shingles = lambda x: collections.Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
        return any((t := (shingles(w[i : i + n]) | shingles(q)).total()) and (shingles(w[i : i + n]) & shingles(q)).total() / t >= 0.8 for i in range(len(w) - n + 1))

    items = [(i, text(37 - i % 3, 800 + i)) for i in range(6)] + [(20, "only four words here"), (21, "one two three four five six"), (22, text(400, 900))]
    rows = []
    for _, t in items:
        w = t.split()
        rows += [" ".join(x) for x in (w[:-1], w[1:], w[2:-2], w[: len(w) * 7 // 8], w[: len(w) * 3 // 4], w[: len(w) // 2], w[: len(w) // 2] + w[len(w) // 2 + 1 :]) if x]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(rows)])
    got = {(r["doc_id"], int(m["item"])): (m["start"], m["end"]) for r in find_leaks(docs, spark.createDataFrame(items, "item_id int, text string")).collect() for m in r["leaks"]}
    assert got == {(i, j): (0, len(t)) for i, t in enumerate(rows) for j, q in items if similar(t, q)} and len(got) > 20


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


CASES = ["a", "  ", "a  b ", "x" * 50, " lead", "漢字かな😀 test", "thethethethethe" * 4, "▁a ▁▁b", "trail   ", "a\tb\n\nc é́ß", "\0 \r\n"]


@pytest.mark.parametrize("fan", [2, 5])
def test_two_levels_choose_the_same_states(text, fan):
    v = P.vocabulary()
    chunks = P.chunks_of(P.normalised(text(80, fan)), 6, v.longest)
    matrices = [c.matrix(v) for c in chunks]
    assert P.scanned(matrices, fan) == P.best_states(matrices) and len(matrices) > 4 * fan


@pytest.mark.parametrize("size", [1, 3, 7, 40])
def test_chunks_give_the_librarys_pieces(library, text, size):
    v = P.vocabulary()
    rng = random.Random(size)
    for c in [*CASES, text(60, size), "".join(rng.choice("ab  \nthe") for _ in range(150))]:
        got = np.frombuffer(P.encode_chunked(v, P.normalised(c), size), v.dtype).tolist()
        assert got == library.encode(c) and P.restored(v.decode(np.array(got, v.dtype).tobytes())) == c.replace("▁", " ")


def test_unigram_scan_finds_the_best_path():
    rng = random.Random(4)
    letters = ["a", "b", "c", P.MARK]
    pool = {x for x in letters} | {"".join(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(40)}
    v = P.Vocabulary(sorted(pool), [-rng.random() * len(p) ** 0.5 * 3 for p in sorted(pool)], "unigram")
    for _ in range(20):
        t = "".join(rng.choice(letters) for _ in range(30))
        best = [0.0] + [float("-inf")] * len(t)
        for i in range(len(t)):
            for e in v.at(t, i):
                best[e] = max(best[e], best[i] + v.weight(t, P.START, (i, e)))
        for size in (1, 4, 9):
            ids = np.frombuffer(P.encode_chunked(v, t, size), v.dtype).tolist()
            assert "".join(v.pieces[i] for i in ids) == t and abs(sum(v.scores[i] for i in ids) - best[-1]) < 1e-6


def test_products_are_associative():
    rng = random.Random(5)
    m = [{(s, 0): {(e, 0): rng.random() for e in range(4) if rng.random() < 0.8} for s in range(4)} for _ in range(3)]
    close = lambda x: {k: {e: round(w, 9) for e, w in r.items()} for k, r in x.items()}
    assert close(P.multiply(P.multiply(m[0], m[1]), m[2])) == close(P.multiply(m[0], P.multiply(m[1], m[2])))


def test_encoding_of_documents(spark, documents, library, text):
    long = text(400, 9)
    rows = [(1, "a b", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, long, "en", "s"), (4, long + "x", "en", "s"), (5, "y" * 700, "en", "s")]
    got = P.encode_documents(documents(rows).withColumnRenamed("kept", "row"), chunk_chars=300).orderBy("doc_id", "first").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["ids"] == library.encode("a b") and by[2][0]["ids"] == [] == by[3][0]["ids"] and all(r["exact"] for r in got)
    assert [i for r in by[5] for i in r["ids"]] == library.encode("y" * 700) and len(by[5]) == 3
    assert sorted(i for r in by[4] for i in r["ids"]) == sorted(library.encode(long) + library.encode(long + "x"))
    assert P.encode_documents(documents(rows).limit(0)).count() == 0
    back = collections.defaultdict(list)
    for r in P.decode_documents(P.encode_documents(documents(rows), chunk_chars=300, fan=2)).collect():
        back[r["row"], r["doc_id"]].append((r["chunk"], r["text"]))
    assert sorted((k[1], "".join(t for _, t in sorted(v))) for k, v in back.items()) == sorted((i, t or "") for i, t, _, _ in rows)


def test_chunks_come_in_batches_of_few_bytes(spark, documents):
    P.encode_documents(documents([(1, "a", "en", "s")])).count()
    rows = spark.range(0, 900, 1, 1).selectExpr("id", "repeat('▁abcdefgh', 2000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)], "held": [batch["text"].str.encode("utf-8").str.len().sum()]})

    got = rows.mapInPandas(sizes, "n long, held long").collect()
    assert sum(r["n"] for r in got) == 900 and max(r["held"] for r in got) <= BYTES_AT_ONCE + 22_000


def test_batches_of_an_other_size_stay(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    other = spark.newSession()
    other.conf.set(name, 1 << 20)
    ship(other)
    assert other.conf.get(name) == str(1 << 20)


def test_keys_of_text_and_several_texts_of_a_key(spark, text):
    a, b = text(120, 1), text(120, 2)
    rows = [("x", a), ("y", a.upper()), ("z", b), ("w", edited(b, 0.01, 3)), ("v", text(120, 4)), (None, a)]
    got = {r["doc_id"]: r["class_id"] for r in duplicate_classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"x": "x", "y": "x", "z": "w", "w": "w"}
    rows = [(5, a), (5, b), (7, edited(a, 0.01, 5)), (8, edited(b, 0.01, 6)), (9, b), (9, text(120, 8)), (10, text(120, 8))]
    got = {r["doc_id"]: r["class_id"] for r in duplicate_classes(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == dict.fromkeys((5, 7, 8, 9, 10), 5)


def test_few_samples_are_rare_at_the_threshold():
    import math

    from veilscan.llm.near_duplicates import LEAST_SHARED, SAMPLES

    assert sum(math.comb(SAMPLES, k) * 0.8**k * 0.2 ** (SAMPLES - k) for k in range(LEAST_SHARED)) < 3e-5


def test_frequent_shingles_weigh_less_and_noise_does_not():
    counts = np.full(1 << 18, 40, np.int64) + np.random.default_rng(1).poisson(5, 1 << 18)
    counts[7] += 50_000
    w = Weights(counts, 100_000)
    assert w.table[7] < 0.91 and (w.table == 1).mean() > 0.999


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert 0 < docs.count() <= n
    assert docs.where("not exact").count() == 0


def test_units_are_merged_at_once_as_one_by_one(text):
    v = P.vocabulary()
    rng = random.Random(4)
    units = [P.MARK + "".join(rng.choice("etaoinshrdluäß🙂#▁9") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [P.MARK + w for w in text(2000, 3).split()] + ["x", P.MARK, "🙂"]
    one = [np.array([i for p in v.merge(u) for i in v.to_ids(p)], v.dtype).tobytes() for u in units]
    assert v.merged(units) == one and v.merged([]) == []
    texts = [P.normalised(text(n % 40, n)) for n in range(300)] + ["", P.normalised("y" * 5000)]
    assert list(v.encode_all(texts)) == [v.encode(t) for t in texts]


def test_merging_takes_time_in_proportion_to_characters():
    """A round's work on a unit is the joint pair and its two neighbours, however long the unit is."""
    v = P.vocabulary()
    rng = random.Random(5)

    def a_character(width):
        units = ["".join(rng.choice("etaoinshrdlu") for _ in range(width)) for _ in range(8192)]
        took = []
        for _ in range(5):
            began = time.process_time()
            v.merged(units)
            took.append(time.process_time() - began)
        return min(took) / width

    assert a_character(60) < 1.8 * a_character(6)


def test_merging_handles_ties_and_characters_of_no_piece():
    pieces = ["a", "b", "aa", "ab", "ba", "aab", "ç", "\n", "c", "cd"]  # "d" is part of a piece, but none
    for bytes_too in (False, True):
        byte_pieces = [f"<0x{b:02X}>" for b in range(256)] if bytes_too else []
        at = len(pieces) + 1
        v = P.Vocabulary(["<unk>", *pieces, *byte_pieces], [0.0, 0, 0, -1, -1, -2, -3, 0, 0, 0, -1] + [0.0] * len(byte_pieces), "bpe", 0, list(range(at, at + len(byte_pieces))), frozenset({0, *range(at, at + len(byte_pieces))}))
        rng = random.Random(6)
        units = ["".join(rng.choice("aabbcdç\n\0\x7f\x80é🙂\udc80") for _ in range(rng.randint(0, 64))) for _ in range(3000)] + ["d", "", "aaaa"]
        assert v.merged(units) == [np.array([i for p in v.merge(u) for i in v.to_ids(p)], v.dtype).tobytes() for u in units]
