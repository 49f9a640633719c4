"""Ranked lexical search by branch and bound over a hierarchical max tree of document ranges.

Documents are read once and become postings of the terms that are asked for. A task takes stretches of SEGMENT documents
as they lie in the postings' files: no shuffle is needed, and a range is a run of neighbours. For each term, the tree
holds the greatest impact in ranges of LEAF documents, and in ranges of FAN such ranges, up to the whole stretch. The
weighted sum of a range's maxima bounds the scores in it, so a search opens the range with the highest bound first and
ends when no bound reaches the worst of the best documents so far. Ranges whose bound equals it are opened too: a
document of the same score but a smaller id may lie there. The best of all tasks are merged by a ranking window.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import materialize, ship, table, tidy

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
GAP = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
FOLD = {u: u + 32 for u in range(65, 91)}
BEST = 10
#: Parameters of the score: a document's length counts for B of 100.
B, K = 90, 8
#: Documents of a leaf, ranges of a node, documents of a stretch.
LEAF, FAN, SEGMENT = 32, 8, 16_384
#: Distinct terms that are searched for at once. Items beyond it go to further blocks, each of which reads the documents.
MAX_TERMS = 20_000
#: Characters whose terms are counted at once.
AT_ONCE = 1 << 20


def term_counts(text: str | None) -> Counter:
    """Terms of a whole text, only A-Z lower-cased, with their occurrences. Giant texts are cut between terms."""
    raw: Counter = Counter()
    start, n = 0, len(text or "")
    while start < n:
        gap = GAP.search(text, min(n, start + AT_ONCE))
        end = gap.start() if gap else n
        raw.update(TERM.findall(text, start, end))
        start = end
    out: Counter = Counter()
    for term, k in raw.items():
        out[term.lower() if term.isascii() else term.translate(FOLD)] += k
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, per_doc: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting counts before its term's weight; per_doc: postings of each document."""
    m = np.array([100 - B + (B * int(n) * n_docs) // n_terms for n in lengths], np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + K * np.repeat(m, per_doc))


class MaxTree:
    """Maxima of impacts by term and range. levels[0] has the leaves, the last level a single range."""

    def __init__(self, terms: np.ndarray, impact: np.ndarray, offsets: np.ndarray, keys: list, n_terms: int) -> None:
        self.terms, self.impact, self.offsets, self.keys = terms, impact, offsets, keys
        n = len(keys)
        leaf = np.repeat(np.arange(n) // LEAF, np.diff(offsets))
        low = np.zeros((n_terms, -(-n // LEAF)), np.int32)
        np.maximum.at(low, (terms, leaf), impact.astype(np.int32))
        self.levels = [low]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def search(self, ids: np.ndarray, weights: np.ndarray, by_term: np.ndarray, best: list, k: int) -> list:
        """The k best of `best` and this stretch, as (-score, key is null, key). by_term: the weights, 0 elsewhere."""
        bound = int(weights @ self.levels[-1][ids, 0])
        heap = [(-bound, len(self.levels) - 1, 0)]
        while heap:
            bound, level, node = heapq.heappop(heap)
            least = -best[-1][0] if len(best) == k else 1
            if -bound < least:
                break
            if level:
                below = self.levels[level - 1]
                low = node * FAN
                for i, x in enumerate((weights @ below[ids, low : low + FAN]).tolist()):
                    if x >= least:
                        heapq.heappush(heap, (-x, level - 1, low + i))
            else:
                low, high = node * LEAF, min(len(self.keys), (node + 1) * LEAF)
                cut = slice(self.offsets[low], self.offsets[high])
                scores = np.add.reduceat(by_term[self.terms[cut]] * self.impact[cut], self.offsets[low:high] - self.offsets[low])
                found = [(-int(scores[i]), (key := self.keys[low + i]) is None, 0 if key is None else key) for i in np.flatnonzero(scores >= least).tolist()]
                best = heapq.nsmallest(k, best + found) if found else best
        return best


def stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of `size`, the last one smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= size:
            cut = size - n
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            batch, held, n = batch.slice(cut), [], 0
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _block(docs: DataFrame, key: str, text: str, items: list[tuple[object, list[str]]], item_type: str, best: int) -> DataFrame:
    """(item, doc, score, number) with the best documents of each item, before they are ranked. `number` counts items."""
    place = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    kind = docs.schema[key].dataType.simpleString()

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, t in batch.itertuples(index=False, name=None):
                found = term_counts(t)
                if found:
                    asked = sorted((place[x], k) for x, k in found.items() if x in place)
                    rows.append((doc, found.total(), [i for i, _ in asked], [k for _, k in asked]))
            yield pd.DataFrame(rows, columns=["doc", "n", "terms", "tf"])

    texts = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("t"))
    held = materialize(texts.mapInPandas(tidy(postings), f"doc {kind}, n long, terms array<int>, tf array<long>"), "lexical-postings")
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = dict(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each term asked for
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(place))], np.int64)
    asked = [(n, item, np.array(sorted(place[t] for t in terms), np.int64)) for n, (item, terms) in enumerate(items)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_of: list[list] = [[] for _ in asked]
        by_term = np.zeros(len(weights), np.int64)
        for rows in stretches(batches, SEGMENT):
            rows = rows.combine_chunks()
            lists = rows["terms"].combine_chunks()
            per_doc = lists.value_lengths().to_numpy()
            terms, tf = lists.flatten().to_numpy(), rows["tf"].combine_chunks().flatten().to_numpy()
            impact = impacts(tf, rows["n"].to_numpy(), per_doc, n_docs, n_terms)
            tree = MaxTree(terms, impact, np.concatenate([[0], np.cumsum(per_doc)]), rows["doc"].to_pylist(), len(weights))
            for n, _, ids in asked:
                by_term[ids] = weights[ids]
                best_of[n] = tree.search(ids, weights[ids], by_term, best_of[n], best)
                by_term[ids] = 0
        found = [(n, None if null else doc, -score) for (n, _, _), top in zip(asked, best_of, strict=True) for score, null, doc in top]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], doc_type), pa.array([x[2] for x in found], pa.int64())], ["number", "doc", "score"])

    doc_type = to_arrow_type(docs.schema[key].dataType)
    tops = held.where(F.size("terms") > 0).mapInArrow(tidy(search), f"number int, doc {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    names = docs.sparkSession.createDataFrame([(n, item) for n, (item, _) in enumerate(items)], f"number int, item {item_type}")  # bounded by MAX_TERMS, like the block
    return tops.withColumn("rank", rank).where(F.col("rank") <= best).join(F.broadcast(names), "number").select("item", "rank", F.col("doc"), "score")


def search_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", best: int = BEST, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_key, rank, key, score): the `best` documents of each item with a score above 0, equal scores by key.

    Terms, weights and scores are integers as the constants above define them; N, L and document frequencies count all of
    `docs`. Null and empty texts have no terms: such documents are in no count, such items have no rows. Rows of `docs`
    that repeat are documents of their own with equal scores; a null key comes last among equals. Items that repeat are
    ranked each by itself. Texts may be of any length. Empty tables give no rows. Other columns are left out, whatever
    their names; the two keys must have different names (ValueError).
    """
    if key.lower() == item_key.lower():
        raise ValueError("documents and items need keys of different names")
    spark = docs.sparkSession
    ship(spark)
    item_type = items.schema[item_key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item": batch["item"], "terms": [sorted(term_counts(t)) for t in batch["t"]]})

    parsed = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("t")).mapInPandas(parse, f"item {item_type}, terms array<string>")
    blocks: list[DataFrame] = []
    held: list[tuple[object, list[str]]] = []
    known: set[str] = set()

    def close(last: bool) -> None:
        if held:
            block = _block(docs, key, text, list(held), item_type, best)
            blocks.append(block if last and not blocks else materialize(block, "lexical-best"))
            held.clear()
            known.clear()

    for item, terms in parsed.where(F.size("terms") > 0).toLocalIterator():
        if held and len(known | set(terms)) > max_terms:
            close(False)
        held.append((item, terms))
        known.update(terms)
    close(True)
    out = f"item {item_type}, rank int, doc {docs.schema[key].dataType.simpleString()}, score long"
    found = reduce(DataFrame.unionByName, blocks) if blocks else spark.createDataFrame([], out)
    return found.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")


def op12_lexical_max_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all `documents` for each item of `benchmark`; see `search_documents`."""
    return search_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
