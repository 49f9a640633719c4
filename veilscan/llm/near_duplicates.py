"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Texts of equal words are one class at once, found by a digest; one document represents them from here on. The shingles
   of representatives are written once, and all that follows reads them instead of the texts.
2. Document frequencies of shingles are counted over all representatives in a table of hashed places of fixed size.
3. Each representative gets `BANDS` x `ROWS` improved consistent weighted samples of its shingles, weighted by count and
   IDF. Two texts agree in a sample with the probability of their weighted Jaccard similarity.
4. Texts that agree in all samples of a band share a bucket. Each is compared with the bucket's least member, and with
   the least of those that share the next band, too: links in proportion to the members, not to their pairs.
5. Links whose exact similarity reaches the threshold join classes. Where a bucket still holds several classes, members
   outside its largest class are compared with all others in blocks, by their samples and then exactly, so a link
   between classes isn't lost for want of a common neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, materialize, own, own_name, ship, table, tidy
from .components import connected
from .shingles import counted, keys_of

THRESHOLD = 0.8
#: At a similarity of 0.8, 10 bands of 4 meet in one band at least with a probability of 0.995.
BANDS, ROWS = 10, 4
SAMPLES = BANDS * ROWS
#: Hashed places in which document frequencies are counted; the table of this size goes to every executor.
PLACES_BITS = 18
#: IDF is 1 for a shingle of one text and falls, with the logarithm of its frequency, to 1 - IDF_RANGE for one of all
#: texts. A wide range would take copies apart, as what they share is frequent because it was copied.
IDF_RANGE = 0.1
#: A place tells a shingle's frequency from that of others in it from so many deviations on; below, it counts as 1.
DEVIATIONS = 4
#: Samples are drawn from tables of so many variates.
VARIATES = 1 << 16
#: Members of a bucket's block.
BLOCK = 256
#: Shared samples from which on two texts of one bucket are verified: 4 deviations below those at the threshold. A pair
#: at exactly 0.8 has fewer with a probability of 0.00003.
LEAST_SHARED = math.floor(SAMPLES * THRESHOLD - 4 * math.sqrt(SAMPLES * THRESHOLD * (1 - THRESHOLD)))
#: Shingles that are sampled at once.
AT_ONCE = 200_000
#: Lists of ids up to so many rows are broadcast; longer ones are joined by shuffling.
BROADCAST_ROWS = 500_000


def key_type(docs: DataFrame, key: str) -> str:
    """The type that keys have in here: whole numbers as long, all others as string."""
    return "long" if isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "string"


class Weights:
    """IDF by hashed place. What other shingles add to a place, on average, is taken off."""

    def __init__(self, counts: np.ndarray, documents: int) -> None:
        others = (counts.sum() - counts) / max(1, len(counts) - 1)
        frequency = np.where(counts - others > DEVIATIONS * np.sqrt(others), np.maximum(1.0, counts - others), 1.0)
        span = math.log(max(2, documents))
        self.table = (1 - IDF_RANGE * np.minimum(1.0, np.log(frequency) / span)).astype(np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.table[keys >> np.uint64(64 - PLACES_BITS)]


class Sampler:
    """Improved consistent weighted sampling: r and c are Gamma(2, 1), beta is uniform, for each sample and shingle.

    Variates come from tables, at a place that is hashed from shingle and sample.
    """

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, VARIATES).astype(np.float32) + np.float32(1e-6)
        self.log_c = np.log(rng.gamma(2, 1, VARIATES)).astype(np.float32)
        self.beta = rng.random(VARIATES, np.float32)
        self.factors = rng.integers(1, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row for each stretch of shingles from a start to the next, with its samples as 64-bit values."""
        log_w = np.log(weights, dtype=np.float32)
        lengths = np.diff(np.append(starts, len(keys)))
        out = np.empty((len(starts), SAMPLES), np.uint64)
        for i, factor in enumerate(self.factors):
            at = (keys * factor) >> np.uint64(48)
            r, beta = self.r[at], self.beta[at]
            t = np.floor(log_w / r + beta)
            a = self.log_c[at] - r * (t - beta + 1)
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
            first = least[np.searchsorted(least, starts)]  # of equals, the least key
            out[:, i] = keys[first] ^ (t[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, words) of every text that has words and a key: a digest of its words in lower case."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [" ".join(t.lower().split()) if t else "" for t in batch["t"]]
            yield pd.DataFrame({"id": batch["id"], "words": [xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) if w else None for w in words]})[lambda x: x["words"].notna()]

    kind = key_type(docs, key)
    return docs.select(F.col(key).cast(kind).alias("id"), F.col(text).alias("t")).where("id is not null").mapInPandas(tidy(digest), f"id {kind}, words binary")


def shingle_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, words, keys, times) of every text that has words: digest and sorted shingles; `times` is empty where each
    occurs once."""

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for i, t in batch.itertuples(index=False, name=None):
                k, n = counted(keys_of(t))
                if len(k):
                    rows.append((i, xxhash.xxh3_128_digest(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")), k.tobytes(), b"" if (n == 1).all() else n.astype(np.uint32).tobytes()))
                    held += len(k)
                if held >= AT_ONCE:
                    yield pd.DataFrame(rows, columns=["id", "words", "keys", "times"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["id", "words", "keys", "times"])

    kind = key_type(docs, key)
    return docs.select(F.col(key).cast(kind).alias("id"), F.col(text).alias("t")).where("id is not null").mapInPandas(tidy(shingle), f"id {kind}, words binary, keys binary, times binary")


def frequencies(shingles: DataFrame) -> tuple[np.ndarray, int]:
    """Texts by hashed place of their shingles, and how many there are. 2 ** PLACES_BITS rows come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.zeros((1 << PLACES_BITS) + 1, np.int64)  # the last counts the texts
        for batch in batches:
            for k in batch["keys"]:  # a text's shingles are distinct, but not their places
                at = (np.frombuffer(k, np.uint64) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)
                if len(at) > 4096:
                    places += np.bincount(at, minlength=len(places))
                else:
                    np.add.at(places, at, 1)
            places[-1] += len(batch)
        at = np.flatnonzero(places)
        yield pd.DataFrame({"place": at.astype(np.int32), "n": places[at]})

    sums = shingles.select("keys").mapInPandas(tidy(count), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << PLACES_BITS) + 1, np.int64)
    counts[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return counts[:-1], int(counts[-1])


def sampled(shingles: DataFrame, weights: Weights) -> DataFrame:
    """(id, words, bands, sketch): a key for each band, and 16 bits of each sample."""
    schema = f"id {shingles.schema['id'].dataType.simpleString()}, words binary, bands array<bigint>, sketch binary"

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler()
        for batch in batches:
            sizes = batch["keys"].map(len).cumsum() // (8 * AT_ONCE)
            for _, part in batch.groupby(sizes):
                yield rows(sampler, part)

    def rows(sampler: Sampler, part: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(k, np.uint64) for k in part["keys"]]
        times = np.concatenate([np.frombuffer(n, np.uint32) if n else np.ones(len(k), np.uint32) for k, n in zip(held, part["times"], strict=True)])
        keys = np.concatenate(held)
        starts = np.concatenate([[0], np.cumsum([len(k) for k in held])[:-1]]).astype(np.int64)
        found = sampler.samples(keys, times.astype(np.float32) * weights.of(keys), starts)
        bands = np.empty((len(part), BANDS), np.int64)
        for b in range(BANDS):
            bands[:, b] = [xxhash.xxh64_intdigest(x.tobytes(), b) >> 1 for x in found[:, b * ROWS : (b + 1) * ROWS]]
        low = (found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
        return pd.DataFrame({"id": part["id"].to_numpy(), "words": part["words"].to_numpy(), "bands": list(bands), "sketch": [x.tobytes() for x in low]})

    return shingles.select("id", "words", "keys", "times").mapInPandas(tidy(sample), schema)


def weighted_jaccard(a: bytes, a_times: bytes, b: bytes, b_times: bytes, weights: Weights) -> float:
    ka, kb = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    na = np.frombuffer(a_times, np.uint32) if a_times else np.ones(len(ka), np.uint32)
    nb = np.frombuffer(b_times, np.uint32) if b_times else np.ones(len(kb), np.uint32)
    shared, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = float((np.minimum(na[ia], nb[ib]) * weights.of(shared).astype(np.float64)).sum())
    total = float((na * weights.of(ka).astype(np.float64)).sum() + (nb * weights.of(kb).astype(np.float64)).sum()) - both
    return both / total if total else 0.0


def verified(pairs: DataFrame, shingles: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) that reach the threshold, with their similarity. Both sides are joined by sort and merge,
    where a hot text's partners are split."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = [weighted_jaccard(*x, weights) for x in batch[["a_keys", "a_times", "b_keys", "b_times"]].itertuples(index=False, name=None)]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": np.array(s, np.float64)})[lambda x: x["similarity"] >= threshold]

    kind = shingles.schema["id"].dataType.simpleString()
    of = lambda c: shingles.select(F.col("id").alias(c), F.col("keys").alias(f"{c}_keys"), F.col("times").alias(f"{c}_times"))
    joined = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    return joined.mapInPandas(tidy(verify), f"a {kind}, b {kind}, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def star_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the least one, and with the least that shares the next band as well."""
    center = members.groupBy("bucket").agg(F.min("id").alias("b"))
    closer = members.groupBy("bucket", "next").agg(F.min("id").alias("b"))
    pairs = members.join(center, "bucket").select(F.col("id").alias("a"), "b").unionByName(members.join(closer, ["bucket", "next"]).select(F.col("id").alias("a"), "b"))
    return pairs.where("a <> b").distinct()


def similar_to(keys: np.ndarray, times: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarities of one text and others, all of them in a few vector steps."""
    all_keys, all_times = np.concatenate([k for k, _ in others]), np.concatenate([n for _, n in others])
    starts = np.concatenate([[0], np.cumsum([len(k) for k, _ in others])[:-1]]).astype(np.int64)
    at = np.minimum(np.searchsorted(keys, all_keys), len(keys) - 1)
    idf = weights.of(all_keys).astype(np.float64)
    both = np.add.reduceat(np.where(keys[at] == all_keys, np.minimum(times[at], all_times) * idf, 0.0), starts)
    total = (times * weights.of(keys).astype(np.float64)).sum() + np.add.reduceat(all_times * idf, starts) - both
    return both / total


def cross_links(members: DataFrame, sketches: DataFrame, shingles: DataFrame, classes: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Links (a, b) between documents of one bucket that are of different classes yet, where they reach the threshold.

    Members outside a bucket's largest class meet all of its members, in blocks of BLOCK on each side, so no task holds
    a bucket of any size. A pair is looked at in the first band that both share and nowhere else, if its samples leave
    the threshold possible, and it is verified on the spot: pairs never leave a block, but for links that join classes
    there, fewer than the block has members. Buckets of one class, which most are, give nothing.
    """
    kind = shingles.schema["id"].dataType.simpleString()
    held = materialize(members.select("bucket", "band", "id").join(classes, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("c")).distinct(), "bucket-classes")
    sizes = held.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    mixed = mixed.select("bucket", F.col("top.c").alias("top"), F.expr(f"(n - top.n + {BLOCK - 1}) div {BLOCK}").alias("left_blocks"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("right_blocks"))
    rest = held.join(mixed, "bucket")
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = rest.where("c <> top").select("bucket", "band", "id", "c", F.lit(True).alias("left"), block("l", "left_blocks").alias("i"), each("right_blocks").alias("j"))
    right = rest.select("bucket", "band", "id", "c", F.lit(False).alias("left"), each("left_blocks").alias("i"), block("r", "right_blocks").alias("j"))
    # A key may have several texts: a sketch belongs to the shingles of its own.
    full = sketches.select("id", "words", "sketch", "bands").join(shingles, ["id", "words"])
    blocks = left.unionByName(right).join(full, "id").select("bucket", "i", "j", "band", "left", "id", "c", "words", "sketch", "bands", "keys", "times")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        parsed = rows.drop_duplicates(["left", "id", "words"])
        ids, classes, is_left, band = parsed["id"].tolist(), parsed["c"].tolist(), parsed["left"].to_numpy(), int(parsed["band"].iloc[0])
        sketch, bands = np.stack([np.frombuffer(x, np.uint16) for x in parsed["sketch"]]), np.stack(list(parsed["bands"]))[:, :band]
        texts = [(k := np.frombuffer(x, np.uint64), np.frombuffer(n, np.uint32) if n else np.ones(len(k), np.uint32)) for x, n in zip(parsed["keys"], parsed["times"], strict=True)]
        parent = {c: c for c in classes}

        def root(c: object) -> object:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found, right = [], np.flatnonzero(~is_left)
        for x in np.flatnonzero(is_left).tolist():
            near = right[(sketch[right] == sketch[x]).sum(1) >= LEAST_SHARED]
            near = near[~(bands[near] == bands[x]).any(1)] if band else near
            mine = root(classes[x])
            near = [y for y in near.tolist() if root(classes[y]) != mine]
            if near:
                for y, s in zip(near, similar_to(*texts[x], [texts[y] for y in near], weights), strict=True):
                    if s >= threshold and root(classes[y]) != root(classes[x]):
                        parent[root(classes[y])] = root(classes[x])
                        found.append((ids[x], ids[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64 if kind == "bigint" else object)

    links = blocks.groupBy("bucket", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """`docs` less the keys (id) of `gone`, which is broadcast if it has BROADCAST_ROWS rows at most."""
    listed = gone.select(F.col("id").alias(own_name("gone")))
    listed = F.broadcast(listed) if gone.count() <= BROADCAST_ROWS else listed
    return docs.join(listed, F.col(f"`{key}`").cast(key_type(docs, key)) == own("gone"), "left_anti")


def duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of the documents that share a class with another one; a class is named by its least id.

    Words are what white space separates, in lower case; a text of fewer than five is one shingle. Null and empty texts
    have no words and are in no class, and so are rows with a null key. Rows that repeat a key are one document with
    several texts. Keys of whole numbers are long, all others are compared as strings. An empty table gives no rows.
    """
    kept_columns(docs)
    ship(docs.sparkSession)
    texts = materialize(digests(docs, key, text), "words")

    # Equal words: one representative, found by partial aggregation, so a class may have any share of the rows.
    equal = materialize(texts.groupBy("words").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("words", "rep"), "equal-texts")
    copies = materialize(texts.join(equal, "words").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct(), "copies")
    # A key with other texts besides a copy stays, for their sake.
    several = materialize(texts.groupBy("id").agg(F.min("words").alias("low"), F.max("words").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-keys")
    folded = materialize(copies.select(F.col("a").alias("id")).distinct().join(several.where("low <> high").select("id"), "id", "left_anti"), "folded")
    rows = shingle_rows(without(docs, key, folded), key, text)
    shingles = materialize(rows if several.isEmpty() else rows.dropDuplicates(["id", "words"]), "shingles")
    weights = Weights(*frequencies(shingles))
    sketches = materialize(sampled(shingles, weights), "samples")

    banded = sketches.select("id", F.posexplode("bands").alias("band", "bucket"), "bands").select("id", "band", F.xxhash64("band", "bucket").alias("bucket"), F.get("bands", (F.col("band") + 1) % BANDS).alias("next"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("bucket")
    members = materialize(banded.join(shared, "bucket"), "bucket-members")
    wanted = materialize(members.select("id").distinct(), "candidates")
    few = wanted.count() <= BROADCAST_ROWS
    compared = materialize(shingles.join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), "compared-shingles")

    links = materialize(verified(star_pairs(members), compared, weights, threshold), "links")
    classes = materialize(connected(links.select("a", "b")), "first-classes")
    more = materialize(cross_links(members, sketches, compared, classes, weights, threshold), "more-links")
    stars = classes.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    joined = connected(stars.unionByName(more.select("a", "b")).unionByName(copies))
    return joined.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class stays, with all its columns: the one with the least key.

    Documents without words stay, and so do those without a key. Rows that repeat both key and text are one document:
    one of them stays. Columns may have any names but reserved ones (ValueError). An empty table stays empty.
    """
    classes = materialize(duplicate_classes(docs, key, text, threshold), "classes")
    gone = materialize(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("id")), "dropped")
    left = without(docs, key, gone)
    k = F.col(f"`{key}`")
    repeated = materialize(docs.where(k.isNotNull()).groupBy(k.cast(key_type(docs, key)).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-keys")
    if repeated.isEmpty():
        return left
    again = repeated.select(F.col("id").alias(own_name("gone")))
    again = F.broadcast(again) if repeated.count() <= BROADCAST_ROWS else again
    return without(left, key, repeated).unionByName(left.join(again, k.cast(key_type(docs, key)) == own("gone"), "left_semi").dropDuplicates([key, text]))


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id) of every row of `documents`, null and empty texts and repeated rows included; a document
    without near-duplicates is a class of its own. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = duplicate_classes(docs).select(F.col("doc_id").alias("d"), "class_id")
    ids = docs.select("doc_id")
    return ids.join(classes, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
