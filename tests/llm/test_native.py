"""URL filter, quality rules and sharding."""

import collections
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilscan.llm.quality_rules import judge_quality
from veilscan.llm.shards import assign_shards, write_shards
from veilscan.llm.url_filter import judge_urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_url_markov", "op3_quality_divergence", "op10_shard_interleave"])
def test_against_sql(spark, name):
    from veilscan.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda df: sorted(tuple("" if x != x or x is None else f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_urls_of_all_kinds(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/?q", "https://com/", "http://x.com", "http://x.net/es/1#/fr/", "http://x.net/fr", "a://b://c/d", "http://É.com/\nx", "http://x.com/?a=http://y.net/es/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(3, urls[3], "mine")], "page_id int, url string, verdict string")
    got = judge_urls(df).collect()
    assert len(got) == 13 and {r["verdict"] for r in got} <= {"allow", "block"}
    by = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert by == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("www.example.com", "/en/x", "www.example.com/en/"), 4: ("a.example.com", "/en/", "example.com/en/"), 5: ("com", "/", "com/"), 6: ("x.com", "", None),
        7: ("x.net", "/es/1", "net/es/"), 8: ("x.net", "/fr", None), 9: ("b:", "//c/d", None), 10: ("É.com", "/\nx", "com/"), 11: ("x.com", "/", "com/"),
    }
    assert judge_urls(df.limit(0)).count() == 0


def test_models_tell_urls_apart(spark):
    good = [(i, f"http://news{i}.com/article/{i}") for i in range(200)]
    bad = [(1000 + i, f"http://pills{i}.net/es/cheap-pills-{i}") for i in range(200)]
    asked = [(2000, "http://news7.org/article/7"), (2001, "http://pills7.org/cheap-pills-7")]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(good + bad + asked, "page_id int, url string")).where("rule is null").collect()}
    assert got == {2000: "allow", 2001: "block"}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b#|é\u2003\U0001f600", max_size=200), max_size=20))
def test_counts_against_brute_force(spark, texts):
    rows = [(i, t, "en") for i, t in enumerate([*texts, None, "", "a b c a b c", "x " * 300])]
    got = judge_quality(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(rows[r["doc_id"]][1])
    assert len(got) == len(rows)


def test_odd_documents_go(spark, text, documents):
    rows = [(i, text(300, i), "en", "s") for i in range(60)]
    rows += [(100, " | ".join(text(300, 100).upper().split()), "en", "s"), (101, None, None, None), (102, text(80, 5), None, "s"), (103, text(300, 6), "xx", "s"), (5, rows[5][1], "en", "s")]
    got = judge_quality(documents(rows)).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(rows) and all(kept[i] for i in range(60)) and not kept[100] and not kept[101] and kept[102] and kept[103]
    assert judge_quality(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000])
def test_shards_are_even_and_mixed(spark, n):
    df = spark.createDataFrame([(i // 2, "hot" if i % 3 else None if i % 2 else f"s{i % 7}", i) for i in range(n)], "doc_id int, source string, shard int")
    got = assign_shards(df, "doc_id", "source").collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == n and (not n or max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1)
    for s, k in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(k))
    for src in {r["source"] for r in got}:
        each = collections.Counter(r["shard"] for r in got if r["source"] == src)
        share = sum(each.values()) / 16
        assert all(abs(each.get(s, 0) - share) <= 2 for s in range(16))


def test_shards_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.range(500).selectExpr("id as doc_id", "'s' || (id % 3) as source")
    a = assign_shards(df.repartition(7), "doc_id", "source")
    assert sorted(a.collect()) == sorted(assign_shards(df.repartition(2), "doc_id", "source").collect())
    write_shards(a, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500
