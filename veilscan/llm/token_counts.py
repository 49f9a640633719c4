"""Token counts, and totals by source, language and tokenizer version that signed changes keep up to date.

A change is a row with a sign: +1 for what a batch adds, -1 for what it takes back; a revised count is one of each. A
batch is summed to one row for each group and written by each attempt into a folder of its own; the writer's success
mark, which comes last, commits it. Of a batch that was written by several attempts, at once or again after a failure,
one committed attempt counts: the one with the least name. Totals are the sum of the committed batches; compaction folds
those into a base. A base holds its totals and the names of its batches in one write with one success mark, in a folder of
its own attempt, so several compactions at once can't mix theirs: whichever base counts, it agrees with itself, and
batches that it doesn't name are added from their own folders.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, materialize, scratch_dir, ship, table, tidy

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUPS, SUMS = ("source", "lang", "tokenizer"), ("n_docs", "n_tokens", "n_chars")
#: Longer texts are cut for the tokenizer where a space follows a letter or digit, which no token crosses.
PIECE_CHARS = 1_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def tokenizer_version(path: str = TOKENIZER) -> str:
    """Name and digest of the vocabulary: another file is another version."""
    return f"{Path(path).stem}:{hashlib.sha256(Path(path).read_bytes()).hexdigest()[:12]}"


def pieces(text: str) -> Iterator[str]:
    """The text in parts that are tokenized alike alone and together; one part if there is no place to cut."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = at + PIECE_CHARS
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """`docs` with the tokens of the whole text; null and empty texts have 0, repeated rows the same each.

    A column `out` is replaced, whatever its case; names that differ in case only are refused (ValueError).
    """
    ship(docs.sparkSession)
    kept = kept_columns(docs, out)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            yield pd.Series([sum(len(encode(p)) for p in pieces(t)) if t else 0 for t in batch], index=batch.index, dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.pandas_udf(tidy(count), T.LongType())(F.col(f"`{text}`")).alias(out))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def changes(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Signed rows from the counts of two snapshots: what is gone or differs with -1, what is new or differs with +1.

    Rows that are equal in both cancel out, however often they occur, so only changes are left to sum.
    """
    cols = [key, *GROUPS, "n_tokens", "n_chars"]
    both = deleted(before.select(*cols)).unionByName(inserted(after.select(*cols)))
    net = both.groupBy(*cols).agg(F.sum("sign").alias("net")).where("net <> 0")
    return net.withColumns({"sign": F.signum("net").cast("int"), "_times": F.abs("net")}).select(*cols, "sign", F.explode(F.sequence(F.lit(1), "_times")).alias("_n")).drop("_n")


def _version(base: str) -> int:
    return int(base.split("/")[1].partition("=")[2])


class Rollup:
    """Totals below one folder, on any file system that Spark writes to."""

    SCHEMA = T.StructType([T.StructField(g, T.StringType()) for g in GROUPS] + [T.StructField(s, T.LongType()) for s in SUMS])

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self, pattern: str) -> list[str]:
        """Folders below the path that have a success mark, in order."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(x.getPath().getParent().toString().split("/")[-depth:]) for x in found)

    def _attempts(self) -> dict[str, str]:
        """The folder that counts, by batch."""
        found: dict[str, str] = {}
        for folder in self._committed("deltas/batch=*/attempt=*"):
            found.setdefault(folder.split("/")[1].partition("=")[2], folder)
        return found

    def _bases(self) -> list[str]:
        """Folders of the committed bases; the last one counts."""
        return sorted(self._committed("base/version=*/attempt=*"), key=lambda x: (_version(x), x))

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return sorted(self._attempts())

    def apply(self, batch: str, signed: DataFrame) -> bool:
        """Sum and commit a batch of signed rows (GROUPS, n_tokens, n_chars, sign); False if it was committed before.

        Null groups are groups of their own; null counts add nothing. An empty batch is committed, too. Rows are summed
        before they are shuffled, so one source may have most of them. Two writers may apply one batch at once.
        """
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError(f"a batch's name has letters, digits and -_. only: {batch!r}")
        if batch in self._attempts():
            return False
        sums = signed.groupBy(*GROUPS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), *[F.sum(F.col("sign") * F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in SUMS[1:]])
        sums.write.parquet(f"{self.path}/deltas/batch={batch}/attempt={uuid4().hex}")
        return True

    def _base(self, base: str) -> DataFrame:
        """GROUPS and SUMS of the totals, where `batch` is null, and a row for each batch in them."""
        return self.spark.read.schema(T.StructType([*self.SCHEMA, T.StructField("batch", T.StringType())])).parquet(f"{self.path}/{base}")

    def _folded(self, bases: list[str]) -> set[str]:
        return {r["batch"] for r in self._base(bases[-1]).where("batch is not null").select("batch").collect()} if bases else set()

    def _sum(self, bases: list[str], attempts: dict[str, str]) -> DataFrame:
        """The last base and the attempts that are not in it."""
        folded = self._folded(bases)
        folders = [f"{self.path}/{f}" for b, f in attempts.items() if b not in folded]
        parts = self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)
        if bases:
            parts = parts.unionByName(self._base(bases[-1]).where("batch is null").drop("batch"))
        summed = parts.groupBy(*GROUPS).agg(*[F.sum(s).alias(s) for s in SUMS])
        return summed.where(" or ".join(f"{s} <> 0" for s in SUMS))

    def totals(self) -> DataFrame:
        """Totals of all committed batches; groups that have come down to nothing are left out."""
        return self._sum(self._bases(), self._attempts())

    def compact(self) -> int:
        """Fold the batches that are committed now into a new base; returns its version.

        Names and totals come from one listing and are committed together, so a batch that is committed meanwhile, or by
        a compaction of the same version, still counts once.
        """
        bases, attempts = self._bases(), self._attempts()
        version = (_version(bases[-1]) if bases else 0) + 1
        names = self.spark.createDataFrame([(b,) for b in sorted({*attempts, *self._folded(bases)})], "batch string")
        self._sum(bases, attempts).unionByName(names, allowMissingColumns=True).write.parquet(f"{self.path}/base/version={version}/attempt={uuid4().hex}")
        return version


def earlier(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """A snapshot of counts before `counts`, by a rule on the keys' remainder by 10, so that there is something to keep
    up with: 3 had not come yet, 5 had three tokens and nine characters more, 7 had a twin that is gone since, and 8
    belonged to another source. Null keys are as they are now."""
    rest = F.coalesce(F.pmod(F.col(key), F.lit(10)), F.lit(0))
    longer = F.when(rest == 5, 1).otherwise(0)
    before = counts.where(rest != 3).withColumns({"n_tokens": F.col("n_tokens") + 3 * longer, "n_chars": F.col("n_chars") + 9 * longer, "source": F.when(rest == 8, F.lit("moved")).otherwise(F.col("source"))})
    return before.unionByName(counts.where(rest == 7).withColumn(key, -1 - F.col(key)))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of `documents` by source, language and tokenizer version, after a first snapshot (`earlier`) was loaded,
    folded, and revised by a batch of signed changes, which is delivered twice.

    Null and empty texts count as documents without tokens, repeated rows count each, null sources and languages are
    groups of their own, and an empty table has no totals.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    counts = count_tokens(docs).select("doc_id", "source", "lang", F.lit(tokenizer_version()).alias("tokenizer"), "n_tokens", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    counts = materialize(counts, "token-counts")
    before = earlier(counts)
    rollup = Rollup(spark, f"{scratch_dir(spark)}/veilscan-scratch/token-rollup-{uuid4().hex}")
    rollup.apply("load", inserted(before))
    rollup.compact()
    revision = materialize(changes(before, counts), "token-changes")
    rollup.apply("revision", revision)
    rollup.apply("revision", revision)  # delivered twice, counted once
    return rollup.totals()
