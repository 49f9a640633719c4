"""Boxes on pages: overlap joins by grid cells, containment, runs and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import MAX_HEIGHTS, MAX_WIDTHS, RUN_GAP, WORD_OVERLAP

#: Cells of the grid on each side of a page, whose coordinates run from 0 to 1.
GRID = 32


def cells(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Numbers of the cells that a box touches."""
    at = lambda x: F.least(F.lit(GRID - 1), F.greatest(F.lit(0), F.floor(x * GRID))).cast("int")
    return F.flatten(F.transform(F.sequence(at(top), at(bottom)), lambda y: F.transform(F.sequence(at(left), at(right)), lambda x: y * GRID + x)))


def overlap_area(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    return side("left", "right") * side("top", "bottom")


def meeting(a: DataFrame, b: DataFrame, page: str, key: str = "id", same: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(page, a, b) of boxes that touch one cell: structs of id, left, top, right, bottom and what `carry` names.

    An equality join on page and cell finds candidates, so no page is compared with another and far boxes never meet.
    A pair that shares several cells is kept in the first of them, so nothing has to be made distinct. With `same`, each
    pair of one table is given once, and no box with itself. Boxes are spread over cells, which Spark doesn't count when it
    guesses sizes, so the join is told not to broadcast them.
    """
    box = lambda df, n: df.select(F.col(page).alias("page"), F.struct(F.col(key).alias("id"), "left", "top", "right", "bottom", *carry).alias(n), F.explode(cells(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"))).alias("cell"))
    at = lambda x: F.least(F.lit(GRID - 1), F.greatest(F.lit(0), F.floor(x * GRID))).cast("int")
    first = at(F.greatest(F.col("a.top"), F.col("b.top"))) * GRID + at(F.greatest(F.col("a.left"), F.col("b.left")))
    met = box(a, "a").join(box(b, "b").hint("merge"), ["page", "cell"]).where(F.col("cell") == first)
    if same:
        met = met.where("a.id < b.id")
    return met.select("page", "a", "b")


def overlapping(a: DataFrame, b: DataFrame, page: str, key: str = "id", same: bool = False) -> DataFrame:
    """(page, a, b, area) of boxes that overlap: `page`, `key`, left, top, right, bottom on either side. See `meeting`."""
    met = meeting(a, b, page, key, same).withColumn("area", overlap_area("a", "b"))
    return met.where("area > 0").select("page", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "area")


def covering(a: str, b: str, part: tuple[float, float]) -> Column:
    """Whether what structs a and b share has these parts of the smaller width and height."""

    def side(low: str, high: str, least: float) -> Column:
        x, y = ((F.col(f"{w}.{high}") - F.col(f"{w}.{low}")) for w in (a, b))
        return F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{high}"), F.col(f"{b}.{high}")) - F.greatest(F.col(f"{a}.{low}"), F.col(f"{b}.{low}"))) >= least * F.least(x, y)

    return side("left", "right", part[0]) & side("top", "bottom", part[1])


def owners(words: DataFrame, rectangles: DataFrame, page: str) -> DataFrame:
    """The rectangle that holds each word's center; null unless it is exactly one.

    Rectangles are spread over cells, words are in one cell each: an equality join with an exact test after it.
    """
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    w = words.select(F.col(page).alias("page"), F.col("id").alias("word"), x.alias("x"), y.alias("y"), cells(x, y, x, y)[0].alias("cell"))
    r = rectangles.select(F.col(page).alias("page"), F.col("id").alias("rectangle"), "left", "top", "right", "bottom", F.explode(cells(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"))).alias("cell"))
    inside = w.join(r.hint("merge"), ["page", "cell"]).where("x >= left and x <= right and y >= top and y <= bottom")
    # Words may share an id: rows are told apart by their places, and equal ones meet the same rectangles.
    one = inside.groupBy("page", "word", "x", "y").agg(F.min("rectangle").alias("rectangle"), F.max("rectangle").alias("other")).where("rectangle = other").drop("other")
    return w.join(one.hint("merge"), ["page", "word", "x", "y"], "left").select("page", "word", "rectangle")


def same_word(a: str, b: str) -> Column:
    """Whether structs a and b (text in normal form C, left, top, right, bottom) are one word seen twice."""
    c = lambda w, f: F.col(f"{w}.{f}")

    def side(low: str, high: str, least: float, ratio: int) -> Column:
        x, y = c(a, high) - c(a, low), c(b, high) - c(b, low)
        shared = F.least(c(a, high), c(b, high)) - F.greatest(c(a, low), c(b, low))
        apart = F.abs(c(a, low) + c(a, high) - c(b, low) - c(b, high))
        return (shared >= least * F.least(x, y)) & (F.greatest(x, y) <= ratio * F.least(x, y)) & (apart <= F.least(x, y))

    return (c(a, "text") == c(b, "text")) & side("left", "right", WORD_OVERLAP[0], MAX_WIDTHS) & side("top", "bottom", WORD_OVERLAP[1], MAX_HEIGHTS)


def islands(rows: DataFrame, by: list[str], order: list[str], starts: Column, out: str = "run") -> DataFrame:
    """Rows with the number of their run, from 1: a run starts with the first row and wherever `starts` holds.

    `starts` may use lag() over `ordered(by, order)`.
    """
    w = ordered(by, order)
    first = F.row_number().over(w) == 1
    flagged = rows.withColumn("_s", F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn(out, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def ordered(by: list[str], order: list[str]):  # noqa: ANN201
    return Window.partitionBy(*by).orderBy(*order)


def horizontal_runs(words: DataFrame, by: list[str], height: str = "height") -> DataFrame:
    """Words of a line in runs; a gap of four heights starts one."""
    w = ordered(by, ["left", "right"])
    return islands(words, by, ["left", "right"], F.col("left") - F.lag("right").over(w) >= RUN_GAP * F.col(height))


def bounds(words: DataFrame, *by: str) -> DataFrame:
    """The box around each group and the median height of its words."""
    return words.groupBy(*by).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.median(F.col("bottom") - F.col("top")).alias("height"))


def containing(points: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """The span (start, end, name) that holds each point (at) of the same `by`; spans of one `by` don't overlap.

    A merge in order: spans and points are sorted together and the last start before a point is carried to it, so no
    point meets more than one span.
    """
    marks = spans.select(F.col(by), F.col("start").alias("at"), F.lit(0).alias("is_point"), F.struct("start", "end", "name").alias("span"), F.lit(None).cast(points.schema["id"].dataType).alias("id"))
    asked = points.select(F.col(by), F.col("at"), F.lit(1).alias("is_point"), F.lit(None).cast(marks.schema["span"].dataType).alias("span"), "id")
    w = Window.partitionBy(by).orderBy("at", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    carried = marks.unionByName(asked).withColumn("span", F.last("span", ignorenulls=True).over(w)).where("is_point = 1")
    return carried.select(by, "id", "at", F.when(F.col("at") < F.col("span.end"), F.col("span.name")).alias("name"))
