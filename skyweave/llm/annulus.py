"""Centroid clustering in exact integers, with an annulus search for the nearest centroid.

Centroids are sorted by their norm.  The distance of a vector to the centroid
of nearest norm bounds the distance to its nearest one, so only centroids whose
norm lies in an annulus of that width around the vector's own can win or tie;
both ends are found by binary search, and what lies between is compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.llm.shared import Scratch

#: Components of scaled vectors stay under this size, so that sums of squared differences fit in 64 bits.
LARGEST = 1 << 26


@dataclass
class Settings:
    """``size``: components of a vector that is kept; ``scale``: what they are multiplied by before the floor.

    ``rounds`` of assignment and replacement go before the last assignment;
    ``rows``: vectors that a task compares at once.
    """

    clusters: int = 40
    rounds: int = 5
    size: int = 64
    scale: int = 256
    seed: int = 2
    rows: int = 4096


class Centroids:
    """Centroids by number, and in the order of their norms."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.sorted, self.norms = rows[self.order], norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of every row of integers; of ties the smaller number."""
        own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        right = np.clip(np.searchsorted(self.norms, own), 1, max(len(self.norms) - 1, 1))
        left = right - 1
        right = np.minimum(right, len(self.norms) - 1)
        first = np.where(np.abs(self.norms[left] - own) <= np.abs(self.norms[right] - own), left, right)
        bound = np.sqrt(((x - self.sorted[first]) ** 2).sum(1).astype(np.float64))
        slack = 1e-6 + 1e-9 * (own + bound)  # rounding of the norms; a tie on the boundary stays inside
        low = np.searchsorted(self.norms, own - bound - slack, "left")
        high = np.searchsorted(self.norms, own + bound + slack, "right")
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.rows), np.int64)
        for place in range(int(low.min(initial=len(self.norms))), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= place) & (place < high))
            distance = ((x[rows] - self.sorted[place]) ** 2).sum(1)
            wins = (distance < best[rows]) | ((distance == best[rows]) & (self.order[place] < number[rows]))
            best[rows[wins]], number[rows[wins]] = distance[wins], self.order[place]
        return number, best


def kept_vectors(table: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(vec_id, scaled): vectors of ``size`` components, none null or non-finite, as integers."""
    settings = settings or Settings()
    wide = F.col("embedding").cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("embedding")).where((F.size("embedding") == settings.size) & finite)
    held = F.transform("embedding", lambda x: F.floor(F.when(F.abs(x) < LARGEST / settings.scale, x) * settings.scale))
    return kept.select("vec_id", F.transform(held, lambda x: F.coalesce(x, F.raise_error(F.lit(f"a component of {LARGEST // settings.scale} or more: squared distances would not fit in a long")).cast("long"))).alias("scaled"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _first(kept: DataFrame, settings: Settings) -> np.ndarray:
    """The kept vectors of least hash, a bounded number; equal hashes in the order of their components, null ids last."""
    place = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.orderBy(place.asc_nulls_last(), "scaled").limit(settings.clusters).collect()
    return np.array([r["scaled"] for r in chosen], np.int64).reshape(-1, settings.size)


def _sums(kept: DataFrame, centroids: np.ndarray, settings: Settings) -> list:
    """(cluster, count, sums by component) of every non-empty cluster; a task sends one row a cluster at most."""

    def run(batches):
        search = Centroids(centroids)
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), settings.size)
            for at in range(0, len(x), settings.rows):
                part = x[at : at + settings.rows]
                number, _ = search.nearest(part)
                np.add.at(total, number, part)
                count += np.bincount(number, minlength=len(centroids))
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    told = kept.select("scaled").mapInArrow(run, "cluster int, n long, total array<long>")
    sums = F.array(*(F.sum(F.get("total", k).cast("decimal(38,0)")) for k in range(settings.size)))
    return told.groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("total")).collect()


def _assigned(kept: DataFrame, centroids: np.ndarray, settings: Settings) -> DataFrame:
    def run(batches):
        search = Centroids(centroids)
        for batch in batches:
            x = _matrix(batch.column(1), settings.size)
            parts = [search.nearest(x[at : at + settings.rows]) for at in range(0, len(x), settings.rows)]
            number, distance = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "scaled").mapInArrow(run, "vec_id long, cluster int, distance long")


def _by_number(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def cluster(table: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for each kept vector of ``table`` (vec_id, embedding).

    Kept are vectors of ``size`` components, none null or non-finite, scaled and
    rounded down to integers; others have no row.  The first centroids are the
    kept vectors of least sha-256 of ``seed:vec_id``; rows that repeat an id are
    vectors each, in the order of their components, and rows without an id come
    last.  With fewer kept vectors than ``clusters`` each is a centroid, with
    none the result is empty.  Every round replaces a non-empty centroid by the
    exact rounded-down mean of its vectors; an empty one stays.  ``distance`` is
    squared; of equal distances the smaller cluster wins.  Components of
    262,144 or more stop with an error, as distances would not fit.  Other
    columns are ignored.

    Every round reads the kept vectors once and sends a row a cluster from each
    task, so a cluster of any share of the vectors is no hot key; the driver
    holds the centroids alone, ``clusters`` times ``size`` numbers.
    """
    settings = settings or Settings()
    scratch = Scratch(table.sparkSession, "clusters")
    kept = scratch.keep(kept_vectors(table, settings))
    centroids = _first(kept, settings)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(settings.rounds):
        after = centroids.copy()
        for row in _sums(kept, centroids, settings):
            after[row["cluster"]] = [int(s) // row["n"] for s in row["total"]]
        centroids = after
    last = scratch.keep(_assigned(kept, centroids, settings))
    scratch.drop(kept)
    inertia = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    each = _by_number([inertia.get(k, 0) for k in range(len(centroids))]).cast("array<long>")
    points = F.array(*(_by_number(c) for c in centroids.tolist())).cast("array<array<long>>")
    return last.select(
        "*", F.get(each, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(points, F.col("cluster")).alias("centroid")
    )


def digest(clustered: DataFrame) -> DataFrame:
    """The columns of ``clustered`` with a digest of the centroid in its place."""
    return clustered.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def sql(settings: Settings | None = None) -> str:
    """The same by comparison with every centroid; unique ids."""
    s = settings or Settings()

    def nearest(k: int) -> str:
        return f"""
d{k} AS MATERIALIZED (SELECT x.vec_id, c.cluster, sum((x.v - c.v) * (x.v - c.v)) AS distance FROM x JOIN c{k} c USING (k) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, min(distance)::BIGINT AS distance, arg_min(cluster, (distance, cluster)) AS cluster FROM d{k} GROUP BY vec_id)"""

    def moved(k: int) -> str:
        return f"""
m{k} AS (SELECT cluster, k, sum(v)::BIGINT AS t, count(*) AS n FROM a{k} JOIN x USING (vec_id) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.cluster, c.k, coalesce((t - ((t % n) + n) % n) // n, c.v) AS v FROM c{k} c LEFT JOIN m{k} USING (cluster, k))"""

    steps = [part for k in range(s.rounds) for part in (nearest(k), moved(k))] + [nearest(s.rounds)]
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
w AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda y: floor({s.scale} * y)::BIGINT) AS v FROM e WHERE len(v) = {s.size} AND len(list_filter(v, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, unnest(v) AS v, unnest(range({s.size})) AS k FROM w),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{s.seed}:' || vec_id)) - 1 AS cluster FROM w QUALIFY cluster < {s.clusters}),
c0 AS MATERIALIZED (SELECT f.cluster, x.k, x.v FROM f JOIN x USING (vec_id)),{",".join(steps)},
h AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY k)) AS centroid_sha256 FROM c{s.rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{s.rounds} JOIN h USING (cluster)
"""
