"""Benchmark decontamination: SimHash of item-sized windows, a multi-index, and exact similarity of candidates.

A document's window of as many words as an item, or a shorter document as a whole, is a candidate if the 128-bit SimHashes
of both differ in `RADIUS` bits at most. The index splits a fingerprint into `BLOCKS` blocks of 16 bits: of two
fingerprints within the radius, one block differs in `RADIUS // BLOCKS` bits at most, so looking up, in each block, the
values that are so near finds all of them. Candidates are then compared by the weighted Jaccard similarity of their
shingles, each weighing as often as it occurs.

Only windows that share a shingle with some item of their size are fingerprinted; any other has a similarity of 0. So
what is gathered is the benchmark alone, a block of `BLOCK_CHARS` at a time; documents are read where they are and, but
for a benchmark of several blocks, never shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, materialize, own_name, ship, table, tidy
from .shingles import SIZE, WORD, mixed, windows, word_hashes

THRESHOLD = 0.8
#: Bits in which fingerprints may differ. At a similarity of 0.8 they differ in 19 on average, with a deviation of 4.
RADIUS = 31
BITS = 128
#: Blocks of the multi-index. Within the radius one of eight blocks differs in 3 bits at most; a hundredth of the values of
#: 16 bits are so near to one of them.
BLOCKS = 8
#: Characters of the benchmark that executors hold at once; a larger one takes several passes.
BLOCK_CHARS = 8_000_000
#: Candidates of the index that are compared at once, on average.
PAIRS_AT_ONCE = 200_000
#: Windows that are looked up at once, at most.
WINDOWS_AT_ONCE = 1024
_SHIFTS = np.arange(64, dtype=np.uint64)
#: What keys are moved by before they are mixed once more, for their bits beyond 64.
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def signs(keys: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each key: its bits, and those of the key mixed once more."""
    both = np.stack([keys, mixed(keys ^ _SECOND)], axis=1)
    bits = ((both[:, :, None] >> _SHIFTS) & np.uint64(1)).astype(np.int8).reshape(len(keys), BITS)
    return (bits << 1) - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of summed signs: two numbers of 64 bits each."""
    return ((sums > 0).reshape(len(sums), BITS // 64, 64).astype(np.uint64) << _SHIFTS).sum(2, dtype=np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ, row by row."""
    return np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64) + np.bitwise_count(a[:, 1] ^ b[:, 1])


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are in the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[k]) for k, n in a.items() if k in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class BlockIndex:
    """Fingerprints of the items of one size, in a table for each of BLOCKS blocks of bits.

    A table has a list of items for each value of a block's first `width` bits. The width follows the number of items
    (about 4 lists for each item, 2^16 at most): values that are near stay near in their first bits, so nothing is lost
    by it, and a table takes no more room than its items.
    """

    def __init__(self, prints: np.ndarray) -> None:
        self.prints, self.near = prints, RADIUS // BLOCKS
        self.width = min(BITS // BLOCKS, max(self.near, (4 * len(prints)).bit_length()))
        values = np.arange(1 << self.width, dtype=np.int64)
        #: What a value may differ in: each gives the list of another value that is near.
        self.masks = values[np.bitwise_count(values) <= self.near]
        self.tables = []
        for of in self.values(prints):
            start = np.zeros(len(values) + 1, np.int64)
            np.cumsum(np.bincount(of, minlength=len(values)), out=start[1:])
            items = np.argsort(of, kind="stable")
            self.tables.append((start, np.diff(start) > 0, items, prints[items, 0], prints[items, 1]))

    def values(self, prints: np.ndarray) -> list[np.ndarray]:
        """The first bits of each block."""
        size = BITS // BLOCKS
        mask = np.uint64((1 << self.width) - 1)
        return [((prints[:, at // 64] >> np.uint64(at % 64 + size - self.width)) & mask).astype(np.int64) for at in range(0, BITS, size)]

    def at_once(self) -> int:
        """Windows whose candidates, and lists that are looked up for them, are about PAIRS_AT_ONCE."""
        each = len(self.masks) * max(1.0, len(self.prints) / (1 << self.width))
        return int(max(1, min(WINDOWS_AT_ONCE, PAIRS_AT_ONCE // each)))

    def within(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the fingerprint, item and distance of all pairs within the radius, in order."""
        found = []
        mine = fingerprints[:, 0].copy(), fingerprints[:, 1].copy()
        for values, (start, filled, items, *theirs) in zip(self.values(fingerprints), self.tables, strict=True):
            lists = (values[:, None] ^ self.masks).ravel()
            hits = np.flatnonzero(filled.take(lists))
            lists = lists.take(hits)
            begin, end = start.take(lists), start.take(lists + 1)
            sizes = end - begin
            which = np.repeat(hits // len(self.masks), sizes)
            place = np.repeat(end - np.cumsum(sizes), sizes)
            place += np.arange(len(which))
            bits = sum(np.bitwise_count(a.take(which) ^ b.take(place)) for a, b in zip(mine, theirs, strict=True))
            close = np.flatnonzero(bits <= RADIUS)
            found.append(which[close] * len(self.prints) + items[place[close]])
        which, item = np.divmod(np.unique(np.concatenate(found)), len(self.prints))
        return which, item, distances(fingerprints[which], self.prints[item])


class Benchmark:
    """Items by their number of words. Words are letters, digits and underscores, in lower case.

    An item of fewer than five words is one shingle of all its words; an item without words matches nothing.
    """

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        by_size: dict[int, list[tuple[object, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            words = WORD.findall(text or "")
            if words:
                by_size[len(words)].append((item, windows(word_hashes(words), min(SIZE, len(words)))))
        self.sizes: dict[int, tuple[list, list[Counter], BlockIndex, np.ndarray]] = {}
        for n, of in by_size.items():
            prints = packed(np.stack([signs(k).sum(0, dtype=np.int64) for _, k in of]))
            self.sizes[n] = [i for i, _ in of], [Counter(k.tolist()) for _, k in of], BlockIndex(prints), np.unique(np.concatenate([k for _, k in of]))
        #: For each shingle length: a bitmap to pass over most of a text, all keys, and the sizes that use it.
        self.gates = {}
        for k in {min(SIZE, n) for n in self.sizes}:
            keys = np.unique(np.concatenate([s[3] for n, s in self.sizes.items() if min(SIZE, n) == k]))
            bitmap = np.zeros(1 << 20, bool)
            bitmap[keys >> np.uint64(44)] = True
            self.gates[k] = bitmap, keys, [n for n in self.sizes if min(SIZE, n) == k]

    def matches(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[object, int, int, float, int]]:
        """(item, first word, words, similarity, distance) of the best windows; those of one item don't overlap.

        A window has as many words as the item, or all words of a document that has fewer.
        """
        words = WORD.findall(text) if text else []
        if not words:
            return []
        hashes = word_hashes(words)
        found = []
        for k, (bitmap, keys, sizes) in self.gates.items():
            here = windows(hashes, k)
            hits = np.flatnonzero(bitmap[here >> np.uint64(44)])
            if len(hits):
                hits = hits[among(here[hits], keys)]
            if len(hits):
                for n in sizes:
                    # A document shorter than the item is one window, if so few shingles can be similar enough.
                    if len(here) / (n - k + 1) >= threshold:
                        found += self._of_size(n, min(n, len(words)), k, here, hits, threshold)
        return found

    def _of_size(self, n: int, size: int, k: int, here: np.ndarray, hits: np.ndarray, threshold: float) -> list[tuple[object, int, int, float, int]]:
        names, counters, index, keys = self.sizes[n]
        own = hits[among(here[hits], keys)]
        if not len(own):
            return []
        m = size - k + 1  # shingles of a window
        last = len(here) - m
        edge = np.zeros(len(here) + 2, np.int64)
        np.add.at(edge, np.maximum(0, own - m + 1), 1)
        np.add.at(edge, own + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)
        best: dict[int, list[tuple[float, int, int]]] = defaultdict(list)
        step = index.at_once()
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for at in range(0, len(run), step):
                part = run[at : at + step]
                if not len(part):
                    continue
                sums = np.cumsum(signs(here[part[0] : part[-1] + m]), axis=0, dtype=np.int32)
                sums = np.concatenate([np.zeros((1, BITS), sums.dtype), sums])
                prints = packed(sums[m:] - sums[:-m])
                for start, item, distance in zip(*(x.tolist() for x in index.within(prints)), strict=True):
                    start = int(part[start])
                    s = weighted_similarity(counters[item], Counter(here[start : start + m].tolist()))
                    if s >= threshold:
                        best[item].append((-s, start, distance))
        out = []
        for item, of in best.items():
            taken: list[int] = []
            for s, start, distance in sorted(of):
                if all(abs(start - t) >= size for t in taken):
                    taken.append(start)
                    out.append((names[item], start, size, -s, distance))
        return out


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, n: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in `n` blocks of about BLOCK_CHARS; one block is in the driver at a time."""
    at = F.pmod(F.xxhash64(item, text), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in benchmark.where(at == b).select(item, text).collect()]


MATCH = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "leaks", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with an array of (item, similarity, distance, start, end): the item's key as a string, places in code points.

    Whole texts are searched, row by row. Null and empty texts, an empty benchmark and items without words match
    nothing. Repeated items each match; of one item, the best windows that don't overlap are given. A column `out` is
    replaced; columns whose names differ in case only are refused (ValueError).

    A benchmark of more than BLOCK_CHARS takes a pass for each block of it, so no worker ever holds two blocks. Documents
    are then numbered and written once; a pass writes the numbers of those that it finds something in, with what it
    found, and all passes are joined to the documents once.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [F.col(f"`{c}`") for c in kept_columns(docs, out)]
    n = -(-(benchmark.agg(F.sum(F.char_length(item_text))).first()[0] or 0) // BLOCK_CHARS) or 1

    def found(block: list) -> Column:
        held = spark.sparkContext.broadcast(block)  # BLOCK_CHARS at most, or one item
        return F.pandas_udf(searcher(held, threshold), MATCH)(F.col(f"`{text}`"))

    blocks = benchmark_blocks(benchmark, item, item_text, n)
    leaks, number = own_name("leaks"), own_name("number")
    if n == 1:
        return docs.select(*kept, found(next(blocks)).alias(leaks)).withColumnRenamed(leaks, out)
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    passes = [materialize(numbered.select(number, found(b).alias(leaks)).where(F.size(leaks) > 0), "leaks") for b in blocks]
    each = reduce(DataFrame.unionAll, passes).select(number, F.explode(leaks).alias("m"))
    # Those of one document: as many as its own windows hold, at most.
    by_place = F.array_sort(F.collect_list(F.struct("m.start", "m.end", "m.item", "m.similarity", "m.distance")))
    gathered = each.groupBy(number).agg(by_place.alias(leaks))
    fields = [f.name for f in MATCH.elementType.fields]
    leaky = F.transform(leaks, lambda m: F.struct(*[m[f].alias(f) for f in fields]))
    none = F.array().cast(MATCH)
    return numbered.join(gathered, number, "left").select(*kept, F.coalesce(leaky, none).alias(leaks)).withColumnRenamed(leaks, out)


def searcher(held: Broadcast, threshold: float) -> Callable:
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Benchmark(held.value)
        for batch in batches:
            yield pd.Series([spans_of(items, t, threshold) for t in batch], index=batch.index, dtype=object)

    search = tidy(search)
    search.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return search


def spans_of(items: Benchmark, text: str | None, threshold: float) -> list[dict]:
    found = items.matches(text, threshold)
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    ordered = sorted(found, key=lambda x: (x[1], x[2], str(x[0])))
    return [{"item": str(i), "similarity": s, "distance": d, "start": spans[w][0], "end": spans[w + n - 1][1]} for i, w, n, s, d in ordered]


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, start, end) of every benchmark item found in `documents`, a row for each
    place. Null and empty texts give none, repeated rows give theirs each, an empty table gives none."""
    leaks = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    each = leaks.select("doc_id", F.explode("leaks").alias("m"))
    return each.select("doc_id", F.col("m.item").cast("long").alias("item_id"), F.round("m.similarity", 9).alias("similarity"), F.col("m.distance").alias("hamming"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
