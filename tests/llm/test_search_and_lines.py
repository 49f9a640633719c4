"""Ball clusters, lexical search and line dedup: against SQL on the tables, against brute force on odd rows."""

import collections
import hashlib
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from veilscan.llm.ball_clusters import ball_clusters, reassigned, squared
from veilscan.llm.lexical_search import MaxTree, search_documents, term_counts
from veilscan.llm.line_dedup import keep_bitmaps, kept_lines, kept_text, mark_lines, packed
from veilscan.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ball_clusters", "op12_lexical_max_tree", "op13_line_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(oracle_sql()[name]).df()
    got = queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    plain = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert sorted(got.columns) == columns and plain(got) == plain(want) and len(got)


def lloyd(vectors, k, rounds):
    """(id, cluster, distance) by comparing everything, in Python's own numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if members[j] else c for j, c in enumerate(centroids)]
    return collections.Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in kept)


def test_clusters_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(c % 5, 0.4) for _ in range(64)]) for i, c in enumerate(range(90))]
    rows += [(7, rows[7][1])] * 3 + [(None, rows[1][1]), (None, rows[2][1]), (200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]), (203, [1.0] * 63 + [float("nan")]), (204, [float("inf")] + [1.0] * 63), (205, [0.0] * 64)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int")
    got = ball_clusters(df, k=6, rounds=4).collect()
    assert collections.Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == lloyd(rows, 6, 4)
    assert len({r["inertia"] for r in got}) == 1 and got[0]["inertia"] == sum(r["distance"] for r in got)
    few = ball_clusters(df.where("vec_id < 3"), k=40, rounds=2).collect()
    assert len(few) == 3 and {r["distance"] for r in few} == {0}
    assert ball_clusters(df.where("false")).collect() == []
    huge = ball_clusters(spark.createDataFrame([(i, [3e38 * (-1) ** i] + [0.0] * 63) for i in range(8)], "vec_id long, embedding array<float>"), k=2, rounds=2).collect()
    assert len(huge) == 8 and all(r["distance"] >= 0 for r in huge)


def test_balls_compare_few(monkeypatch):
    """The annuli give what comparing all gives, with fewer distances."""
    rng = np.random.default_rng(5)
    centroids = rng.integers(-2000, 2000, (20, 64))
    x = centroids[rng.integers(0, 20, 3000)] + rng.integers(-120, 120, (3000, 64))
    every = np.stack([squared(x, c) for c in centroids])
    counted = []
    monkeypatch.setattr("veilscan.llm.ball_clusters.squared", lambda a, c: (counted.append(len(a)), squared(a, c))[1])
    first, _ = reassigned(x, np.zeros(3000, int), centroids)
    counted.clear()
    again, distance = reassigned(x, first, centroids)
    assert (again == every.argmin(axis=0)).all() and (distance == every.min(axis=0)).all() and (first == again).all()
    assert sum(counted) < 2 * 3000


def scores(docs, item):
    """(doc, score) of every document, by the definition."""
    of = [(d, term_counts(t)) for d, t in docs]
    of = [(d, c) for d, c in of if c]
    n_docs, total = len(of), sum(c.total() for _, c in of)
    out = []
    for d, c in of:
        m = 10 + (90 * c.total() * n_docs) // total
        s = 0
        for t in term_counts(item):
            df = sum(t in x for _, x in of)
            if t in c:
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
        if s > 0:
            out.append((d, s))
    return out


def test_search_of_odd_rows(spark, text):
    docs = [(i, text(30, i)) for i in range(60)] + [(100 + i, text(30, 5)) for i in range(15)] + [(None, text(30, 5)), (200, None), (201, ""), (202, " .,;\x00"), (5, text(30, 5)), (203, "Ünï É straße " * 40_000 + "the end")]
    items = [(1, text(30, 5)), (2, text(8, 7)), (3, None), (4, ""), (2, "THE END Ünï"), (5, "zzzz qqqq")]
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(5)
    right = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, rank string")
    for limit in (20_000, 25):  # the second makes several blocks
        got = search_documents(left, right, max_terms=limit).collect()
        by = collections.defaultdict(list)
        for r in sorted(got, key=lambda r: r["rank"]):
            by[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
        want = collections.defaultdict(list)
        for i, t in items:
            best = sorted(scores(docs, t or ""), key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:10]
            want[i] += [(n + 1, d, s) for n, (d, s) in enumerate(best)]
        assert {k: sorted(v, key=str) for k, v in by.items()} == {k: sorted(v, key=str) for k, v in want.items() if v}
    assert search_documents(left.where("false"), right).collect() == [] == search_documents(left, right.where("false")).collect()
    with pytest.raises(ValueError):
        search_documents(left, right, key="doc_id", item_key="DOC_ID")


def test_tree_opens_equal_bounds():
    """Equal scores all over the stretch: the smallest ids win although they lie in the last leaves."""
    n = 3000
    tree = MaxTree(np.zeros(n, int), np.full(n, 500), np.arange(n + 1), list(range(n))[::-1], 1)
    assert len(tree.levels) == 4 and tree.levels[-1].tolist() == [[500]]
    best = tree.search(np.array([0]), np.array([3]), np.array([3]), [], 10)
    assert best == [(-1500, False, i) for i in range(10)]


def test_giant_text_is_cut_between_terms(monkeypatch):
    t = "alpha Beta gämma-delta " * 50
    want = term_counts(t)
    monkeypatch.setattr("veilscan.llm.lexical_search.AT_ONCE", 7)
    assert term_counts(t) == want and want["gämma"] == 50 and want["beta"] == 50


def dedup(rows):
    """(id, lines, dropped, text that stays) by the definition; rows of one id are one document, a null id is the last."""
    order = lambda i: (i is None, i or 0)
    lower = str.maketrans({u: u + 32 for u in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in holders or min(holders[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return collections.Counter(out)


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_lines_of_odd_rows(spark, text, partitions):
    """One line that every document holds runs over many tasks; rows repeat, ids are null or shared."""
    hot = "A Very Common Line\t"
    rows = [(i, f"{hot}\n{text(6, i % 9)}\n\n  a very common line\r\n{text(5, i)}\nshort") for i in range(120)]
    rows += [(500, rows[3][1])] * 40 + [(None, hot), (None, "of null alone line\n" + hot), (501, None), (502, ""), (503, "\n\n"), (3, "a very COMMON line\nanother text of three"), (504, "ÄÖÜäöüßßßß line\nÄÖÜäöüßßßß line"), (505, "ÄÖÜäöüßßßß LINE"), (506, " a very common line"), (507, "x\n" * 70_000 + hot)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, KEEP int").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mark_lines(df).withColumn("kept", kept_text("text", "keep")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == dedup(rows)
    assert any(r["keep"] for r in got) and not all(r["keep"] for r in got)
    text_ids = spark.createDataFrame([(str(i), t) for i, t in rows if i is not None], "doc_id string, text string")
    assert {r["doc"] for r in keep_bitmaps(text_ids).collect()} >= {"500", "507"}
    assert mark_lines(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        mark_lines(df.withColumn("__veilscan_x", df.doc_id))


def test_bitmaps():
    keep = np.array([True, False, True] * 1000)
    assert kept_lines("\n".join(map(str, range(3000))), packed(keep)) == "\n".join(str(i) for i in range(3000) if i % 3 != 1)
    assert kept_lines(None, None) == "" and len(packed(np.ones(80_000, bool))) < 100
