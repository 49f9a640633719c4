"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document x is sigmoid(w0 + w.x + sum over pairs of <v_i, v_j> x_i x_j). The pairs are summed in time
linear in the non-zero entries by the identity 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

It is fitted in the driver on a sample of labelled rows that is bounded by `MAX_TRAIN`; every document is scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, released, ship, table, tidy

#: Labelled rows used to fit, at most: those with the lowest md5 of their key.
MAX_TRAIN = 6_000
#: Places that words are hashed to, and bins of each statistic.
HASHED, BINS = 4_096, 8
RANK, EPOCHS, BATCH, RATE, DECAY = 6, 14, 128, 0.02, 1e-4
METADATA = ("n_chars",)
#: Words whose place a worker remembers, at most.
REMEMBERED = 100_000
STATISTICS = ("words", "word_length", "distinct", "upper", "digits", "points", "symbols", "spaces", "lines", "repeated_lines", "repeated_pairs", "longest_word", "non_ascii", "commonest_word")

_places: dict[str, int] = {}
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[list(b".,;:!?'\"()-")] = 3
_CLASS[list(b"#*$%&|<>{}[]\\^~=+_@/`")] = 4
_CLASS[list(b" \t\n\r\x0b\x0c")] = 5
_CLASS[128:] = 6


def place(word: str) -> int:
    at = _places.get(word)
    if at is None:
        if len(_places) >= REMEMBERED:
            _places.clear()
        at = _places[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % HASHED
    return at


def features(text: str | None, metadata: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of the hashed words, and the statistics followed by the metadata (null: as the text's length).

    A null text counts as empty: no words, and statistics of 0.
    """
    text = text or ""
    words = text.lower().split()
    n = len(words)
    counts = Counter(words)
    summed: dict[int, float] = {}
    for w, c in counts.items():
        p = place(w)
        summed[p] = summed.get(p, 0) + c
    at = np.fromiter(summed.keys(), np.int32, len(summed))
    values = np.log1p(np.fromiter(summed.values(), np.float32, len(summed)))
    norm = float(np.sqrt((values * values).sum()))
    if norm:
        values /= norm
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    stats = [
        math.log1p(n), len(raw) / (n + 1), len(counts) / max(1, n), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], len(lines) / (n + 1), 1 - len(set(lines)) / max(1, len(lines)),
        1 - pairs / max(1, n - 1) if n > 1 else 0.0, math.log1p(max(map(len, counts), default=0)), kinds[6], max(counts.values(), default=0) / max(1, n),
    ]
    known = [math.log1p(max(0.0, float(len(text) if m is None or m != m else m))) for m in metadata]
    return at, values.astype(np.float32), np.array([*stats, *known], np.float32)


@dataclass
class Machine:
    """A fitted factorisation machine; its size is fixed by HASHED, BINS and RANK."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    edges: np.ndarray

    def row(self, at: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All non-zero entries: words, standardised statistics, and the bin of each statistic."""
        m = len(stats)
        scaled = np.clip((stats - self.mean) / self.deviation, -4, 4) / 4
        bins = (stats[:, None] > self.edges).sum(1)
        return np.concatenate([at, HASHED + np.arange(m), HASHED + m + np.arange(m) * BINS + bins]), np.concatenate([values, scaled, np.full(m, 0.5, np.float32)])

    def score(self, text: str | None, metadata: Sequence[float | None]) -> float:
        at, x = self.row(*features(text, metadata))
        v = self.factors[at] * x[:, None]
        s = v.sum(0)
        z = self.bias + float(self.linear[at] @ x) + 0.5 * float(s @ s - (v * v).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the logistic loss over shuffled batches. Without rows of both labels, a constant: their share, or 1/2."""
    n_stats = len(rows[0][2]) if rows else len(STATISTICS) + len(METADATA)
    width = HASHED + n_stats * (1 + BINS)
    stats = np.array([r[2] for r in rows], np.float32).reshape(len(rows), n_stats)
    if len(rows):
        mean, deviation = stats.mean(0), stats.std(0) + 1e-6
        edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
    else:
        mean, deviation, edges = np.zeros(n_stats, np.float32), np.ones(n_stats, np.float32), np.zeros((n_stats, BINS - 1), np.float32)
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), mean, deviation, edges)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        machine.bias = 0.0 if not len(labels) else (4.0 if share else -4.0)
        return machine
    # Rows of the rarer label count for more, so that the cut at 1/2 balances both errors.
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    sparse = [machine.row(*r) for r in rows]
    params = [np.zeros(1, np.float32), np.zeros(width, np.float32), rng.normal(0, 0.02, (width, RANK)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            ids = order[b : b + BATCH]
            x = np.zeros((len(ids), width), np.float32)
            for i, r in enumerate(ids):
                np.add.at(x[i], sparse[r][0], sparse[r][1])
            w0, w, v = params
            s = x @ v
            squares = x * x
            z = w0[0] + x @ w + 0.5 * ((s * s).sum(1) - squares @ (v * v).sum(1))
            g = weight[ids] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[ids]) / len(ids)
            grads = [np.array([g.sum()], np.float32), x.T @ g + DECAY * w, x.T @ (g[:, None] * s) - v * (squares.T @ g)[:, None] + DECAY * v]
            step += 1
            for p, d, m1, m2 in zip(params, grads, first, second, strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    machine.bias, machine.linear, machine.factors = float(params[0][0]), params[1], params[2]
    return machine


def is_held_out(key: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def known(docs: DataFrame, metadata: Sequence[str]) -> list[Column]:
    return [F.col(f"`{m}`").cast("double") if m in docs.columns else F.lit(None).cast("double") for m in metadata]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = METADATA, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on `max_train` labelled rows at most whose key is not held out. Null labels and texts without label don't count.

    Metadata that `docs` lacks count as null. Where keys repeat, the rows with the lowest keys are taken, and no more than
    `max_train` come to the driver. Without labelled rows of both kinds the score is a constant.
    """
    ship(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(F.col(key))).select(F.col(key), F.col(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.md5(F.col(key).cast("string")), key, "_label").limit(max_train)
    rows = docs.select(key, F.col(text).alias("_text"), *[c.alias(f"_m{i}") for i, c in enumerate(known(docs, metadata))]).join(F.broadcast(chosen), key)  # max_train rows at most

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [features(t, m) for t, *m in batch[["_text", *[f"_m{i}" for i in range(len(metadata))]]].itertuples(index=False)]
            yield pd.DataFrame({"k": batch[key].astype(str), "y": batch["_label"], "a": [x[0].tobytes() for x in out], "v": [x[1].tobytes() for x in out], "s": [x[2].tobytes() for x in out]})

    found = rows.mapInPandas(tidy(extract), "k string, y int, a binary, v binary, s binary").orderBy("k", "y", "a", "v", "s").limit(max_train).toPandas()
    parsed = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), np.frombuffer(s, np.float32)) for a, v, s in zip(found.a, found.v, found.s, strict=True)]
    return fit(parsed, found.y.to_numpy(np.float32))


def score_documents(docs: DataFrame, machine: Machine, text: str = "text", metadata: tuple[str, ...] = METADATA, out: str = "score") -> DataFrame:
    """`docs` with the score appended. Each row is scored whole and by itself, null and empty texts too.

    Metadata that `docs` lacks count as null. An empty table stays empty. A column `out` is replaced, whatever its case;
    names that differ in case only are refused (ValueError).
    """
    ship(docs.sparkSession)
    kept = kept_columns(docs, out)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        try:
            for texts, *values in batches:
                yield pd.Series([machine.score(t, m) for t, *m in zip(texts, *values, strict=True)], index=texts.index, dtype="float64")
        finally:
            released(_places)

    return docs.select(*[F.col(f"`{c}`") for c in kept], score(F.col(f"`{text}`"), *known(docs, metadata)).alias(out))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `documents`: null and empty texts have the score of a text
    without words, repeated rows the same one each, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
