"""URL filter: host and path rules, and character Markov models for the URLs that no rule covers. Native only.

Two smoothed variable-order Markov models over characters, one for accepted and one for rejected URLs, are counted
from the URLs that a rule decides. A URL's score is the difference of its log-likelihoods, divided by its length. The
threshold is calibrated on a fold of the ruled URLs that the counts leave out. URLs without a rule are judged by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept_columns, materialize, table


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Characters of context at most; longer contexts back off to shorter ones.
ORDER = 4
#: Share of a character that no context has seen: one of so many.
ALPHABET = 257
#: One of so many ruled URLs calibrates the threshold; the rest are counted.
FOLDS = 4
#: Log-likelihoods are kept as whole billionths, so sums don't depend on their order.
UNIT = 1_000_000_000
#: Models up to so many rows are broadcast to the scoring join; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Distinct URLs whose grams one task takes apart.
URLS_OF_A_TASK = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end; A-Z in lower case. Empty if null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does. A fixed, short list, tried in codegen."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.text).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def scored_part(url: Column) -> Column:
    """What the models read: the URL without its scheme, A-Z in lower case; null counts as empty."""
    text = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(text, r"(?s)^.*?://", "")


def with_grams(rows: DataFrame, text: str, order: int = ORDER) -> DataFrame:
    """`rows` with a row for each character: `gram` is it with up to `order` before it; \\x02 pads the start and \\x03 ends
    the text.

    The text is split into characters in a step of its own: within the lambda it would be split again for each of them.
    """
    split = rows.withColumn("chars", F.split(F.concat(F.lit("\x02" * order), text, F.lit("\x03")), ""))
    each = F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.array_join(F.slice("chars", i, order + 1), ""))
    return split.withColumn("gram", F.explode(each)).drop("chars")


def markov_model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, llr) from (gram, na, nr): how often accepted and rejected URLs have it.

    Witten-Bell smoothing: a context that has been followed by t different characters in n places gives them
    count / (n + t) and leaves t / (n + t) to the context that is one character shorter. Every step groups or joins by a
    context or suffix, of which at most one row for each character of the alphabet exists, so no key is hot.
    """
    levels = {order: counts.select(F.col("gram").alias("g"), "na", "nr")}
    for k in range(order - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.substring("g", 2, k + 1).alias("g")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    below = None
    for k in range(order + 1):
        w = Window.partitionBy(F.substring("g", 1, k)) if k else Window.partitionBy(F.lit(0))
        level = levels[k]
        for c in "ar":
            level = level.withColumn(f"total_{c}", F.sum(f"n{c}").over(w)).withColumn(f"kinds_{c}", F.sum(F.when(F.col(f"n{c}") > 0, 1).otherwise(0)).over(w))
        if below is None:
            level = level.withColumns({f"low_{c}": F.lit(1.0 / ALPHABET) for c in "ar"})
        else:
            level = level.withColumn("shorter", F.substring("g", 2, k)).join(below, "shorter")
        p = {f"p_{c}": F.when(F.col(f"total_{c}") > 0, (F.col(f"n{c}") + F.col(f"kinds_{c}") * F.col(f"low_{c}")) / (F.col(f"total_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"low_{c}")) for c in "ar"}
        level = level.select("g", *[v.alias(k) for k, v in p.items()])
        below = level.select(F.col("g").alias("shorter"), F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
    return level.select(F.col("g").alias("gram"), F.round(F.log(F.col("p_a") / F.col("p_r")) * UNIT).cast("long").alias("llr"))


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """`pages` with host, path, rule, verdict, url_score (billionths a character; null if a rule decides) appended.

    Null or empty URLs score as the empty text, whose only character is the end mark. If the ruled URLs lack accepted
    or rejected ones, the threshold is 0. Repeated rows get the same answer, each once. An empty table stays empty.
    Columns of the same names in `pages` are replaced, whatever their case; names that differ in case only are refused
    (ValueError).
    """
    kept = kept_columns(pages, "host", "path", "rule", "verdict", "url_score")
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"), scored_part(F.col(f"`{url}`")).alias("s"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    # Grams carry a digest instead of the text, which may be long.
    ruled = base.withColumns({"rule": name, "ruled": verdict, "id": F.md5(F.encode("s", "UTF-8"))})

    texts = ruled.groupBy("id", "s", "ruled").agg(F.count(F.lit(1)).alias("m"))
    held = F.crc32(F.encode(F.col("s"), "UTF-8")) % FOLDS == 0
    learn = lambda v: F.sum(F.when((F.col("ruled") == v) & ~F.col("held"), F.col("m")).otherwise(0))
    texts = materialize(texts.withColumn("held", held), "url-texts")
    # A URL becomes a hundred grams: its row goes to a task of few before that.
    n = -(-texts.count() // URLS_OF_A_TASK) or 1
    texts = materialize(texts.repartition(n, "id"), "url-parts") if n > 1 else texts
    counts = with_grams(texts, "s", order).groupBy("gram").agg(learn("allow").alias("na"), learn("block").alias("nr"))
    model = materialize(markov_model(materialize(counts, "url-grams"), order), "url-model")
    if model.count() <= BROADCAST_ROWS:
        model = F.broadcast(model)

    each = texts.groupBy("id").agg(F.first("s").alias("s"))
    each = each.repartition(n, "id") if n > 1 else each
    scores = with_grams(each, "s", order).select("id", "gram").join(model, "gram").groupBy("id").agg(F.floor(F.sum("llr") / F.count(F.lit(1))).alias("url_score"))
    scores = materialize(scores, "url-scores")
    threshold = calibrated(texts.where("held and ruled is not null").join(scores, "id"))
    judged = ruled.join(scores, "id", "left")
    by_method = F.when(F.col("url_score") >= F.lit(threshold), "allow").otherwise("block")
    return judged.select("row.*", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("url_score")).alias("url_score"))


def calibrated(scores: DataFrame) -> int:
    """Where two normal curves, fitted to the held-out accepted and rejected scores, cut off equal tails.

    One row for each class comes to the driver. Without either class: 0.
    """
    stats = {r["ruled"]: r for r in scores.groupBy("ruled").agg((F.sum(F.col("m") * F.col("url_score")) / F.sum("m")).alias("mean"), (F.sum(F.col("m").cast("double") * F.col("url_score") * F.col("url_score")) / F.sum("m")).alias("square")).collect()}
    if not {"allow", "block"} <= stats.keys():
        return 0
    mean = {k: r["mean"] for k, r in stats.items()}
    dev = {k: max(0.0, r["square"] - r["mean"] ** 2) ** 0.5 for k, r in stats.items()}
    total = dev["allow"] + dev["block"]
    cut = (mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / total if total > 0 else (mean["allow"] + mean["block"]) / 2
    return int(cut // 1)


def op2_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of `pages`. Null and empty URLs have empty hosts and paths and are judged
    as empty texts, repeated rows each, an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "url_score")
