"""Ball k-means on whole-number vectors: exact Lloyd rounds that compare a vector with few centroids.

A cluster is a ball: its centroid and the distance of its farthest member. Two facts follow from the triangle
inequality. Only centroids nearer than twice the radius can take a member away: the ball's neighbours. And a member
whose distance is less than half of that to the nearest neighbour is in the stable core and stays without a comparison.
Around the core lie annuli, bounded by half the distance to each next neighbour: a member is compared with the
neighbours whose bound it reaches, and with no other. All distances are squared whole numbers, so every bound is exact
and ties are seen: 4 * d(member, own)^2 >= d(own, other)^2 is the condition for a comparison.

A task judges the balls of its own batch of members, whose radii are at most those of the whole balls, so no pass over
all members is needed to find a radius. Assignments are written with the vectors between two folders that take turns.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, ship, table, tidy

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2:"
#: Greatest absolute component: squared distances of 64 of them fit 63 bits. Larger ones count as this.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that have `dimensions` components, none of them null or not finite."""
    x = F.col(f"`{vector}`")
    fit = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    bounded = lambda c: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(c.cast("double") * scale).cast("double"))).cast("long")
    return vectors.where(x.isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(f"`{key}`").alias("id"), F.transform(x, bounded).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def reassigned(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New clusters and squared distances of vectors whose clusters were `cluster`."""
    best, distance = cluster.copy(), np.empty(len(x), np.int64)
    for own in np.unique(cluster).tolist():
        members = np.flatnonzero(cluster == own)
        to_own = squared(x[members], centroids[own])
        members, to_own = members[order := np.argsort(to_own, kind="stable")], to_own[order]
        between = squared(centroids, centroids[own])
        neighbours = np.flatnonzero(between <= 4 * to_own[-1])
        near, at = to_own.copy(), np.full(len(members), own)
        for j in neighbours[neighbours != own].tolist():
            # The annulus and all beyond it: members are in the order of their distance.
            begin = int(np.searchsorted(4 * to_own, between[j]))
            d = squared(x[members[begin:]], centroids[j])
            closer = (d < near[begin:]) | ((d == near[begin:]) & (j < at[begin:]))
            near[begin:][closer], at[begin:][closer] = d[closer], j
        best[members], distance[members] = at, near
    return best, distance


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, v, cluster) with new clusters and `distance`."""
    n = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["v"].flatten().to_numpy().reshape(-1, n)
            if len(x):
                cluster, distance = reassigned(x, batch["cluster"].to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    return rows.select("id", "v", "cluster").mapInArrow(tidy(assign), f"id {rows.schema['id'].dataType.simpleString()}, v array<bigint>, cluster int, distance long")


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise exact floors of the members' means; a cluster without members keeps its centroid.

    Each task adds up its members; the driver gets a number for each cluster and component.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            cluster, x = batch["cluster"].to_numpy(), batch["v"].flatten().to_numpy().reshape(-1, centroids.shape[1])
            for j in np.unique(cluster).tolist():
                own = x[cluster == j]
                count[j] += len(own)
                total[j] += own.sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = rows.select("cluster", "v").mapInArrow(partial, "cluster int, n long, s array<bigint>")
    sums = parts.select("cluster", "n", F.posexplode("s").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(19,0)")).alias("s"))
    out = centroids.copy()
    for row in sums.collect():
        out[row["cluster"], row["at"]] = int(row["s"]) // row["n"]
    return out


def ball_clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that is kept.

    Vectors of another length, null ones, and those with a null or non-finite component are left out. Components beyond
    LARGEST after scaling count as LARGEST; an inertia that no long can hold is null. Centroids begin as the `k` vectors with the smallest sha256 of seed and key;
    equal keys (a null one counts as empty) are ordered by the vector, and there are fewer clusters if fewer vectors.
    Repeated rows are vectors of their own. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = materialize(whole_vectors(vectors, key, vector, dimensions, scale).withColumn("cluster", F.lit(0)), "ball-vectors")
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = base.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    id_type = base.schema["id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"`{key}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    folder = f"{scratch_dir(spark)}/veilscan-scratch/ball-rounds-{uuid.uuid4().hex}"
    rows = base
    for n in range(rounds + 1):
        assigned(rows, centroids).write.mode("overwrite").parquet(f"{folder}/{n % 2}")
        rows = spark.read.schema(f"id {id_type}, v array<bigint>, cluster int, distance long").parquet(f"{folder}/{n % 2}")
        if n < rounds:
            centroids = means(rows, centroids)
    of = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}  # a row for each cluster
    as_long = lambda x: x if x < 1 << 63 else None
    told = [(j, as_long(of[j]), as_long(sum(of.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist()) if j in of]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return rows.join(F.broadcast(clusters), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector of `embeddings`; see `ball_clusters`."""
    return ball_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
