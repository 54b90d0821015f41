"""Spectral neighbours: prediction from the k nearest, cosine matching, inversion by grid search.

Queries meet the library in products of bounded blocks.  A library under a
checked size goes to every task as arrays; a larger one is dealt to blocks, as
are the queries, and every two blocks meet in one cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Spectra of a library that is sent to every task, and of a block of a larger one or of queries.
SHIPPED, BLOCK = 200_000, 8192
#: Bytes of one product of queries and library.
TILE = 32 << 20


def _rows(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - own) ** 2).sum(1))


def _dots(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of products in the order of the components, as a column expression adds them."""
    out = np.zeros(len(own))
    for k in range(own.shape[1]):
        out += x[k] * own[:, k]
    return out


def _nearest(k: int) -> Callable:
    """Finds the ``k`` nearest rows of a library for each query: lists of (cost, place)."""

    def find(x: np.ndarray, library: np.ndarray, left_out: list[list[int]]) -> list[list[tuple[float, int]]]:
        out, square = [], (library**2).sum(1)
        step = max(1, TILE // (8 * max(len(library), 1)))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            rough = (part**2).sum(1)[:, None] + square[None] - 2 * part @ library.T
            slack = 1e-9 * (1 + (part**2).sum(1) + square.max(initial=0))
            for i, row in enumerate(rough):
                row[left_out[at + i]] = np.inf
                want = min(k, len(row)) - 1
                some = np.flatnonzero(row <= min(np.partition(row, want)[want] + slack[i], 1e300)) if want >= 0 else np.zeros(0, int)
                exact = _distances(part[i], library[some])
                order = np.argsort(exact, kind="stable")[:k]  # rows of the library are in the order of their keys
                out.append([(float(exact[j]), int(some[j])) for j in order])
        return out

    return find


def _best_cosine(x: np.ndarray, library: np.ndarray, left_out: list[list[int]]) -> list[list[tuple[float, int]]]:
    """The row of greatest cosine for each query, as a list of one (minus the score, place); zero rows match nothing."""
    out, norm = [], np.sqrt((library**2).sum(1))
    unit = library / np.where(norm > 0, norm, 1)[:, None]
    step = max(1, TILE // (8 * max(len(library), 1)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        rough = np.where(norm > 0, part @ unit.T, -np.inf)
        for i, row in enumerate(rough):
            row[left_out[at + i]] = -np.inf
            top = row.max(initial=-np.inf)
            some = np.flatnonzero(row >= top - 1e-9 * (1 + abs(top))) if top > -np.inf else np.zeros(0, int)
            score = _dots(part[i], library[some]) / np.sqrt([_dots(o, o[None])[0] for o in library[some]]) if len(some) else np.zeros(0)
            out.append([(-float(score[j]), int(some[j])) for j in score.argmax(keepdims=True)] if len(some) else [])
    return out


def _met(ask: DataFrame, rows: DataFrame, key: str, find: Callable, keep: int, shipped: int) -> DataFrame:
    """(key, near): the ``keep`` best rows of the library for each query, as (d, lk, t) in order.

    ``ask``: (key, x, own), ``rows``: (lk, x, t, g), arrays as x and t; rows whose
    g is a query's own are left out for it.  An empty library finds nothing.
    """
    ask = ask.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    rows = rows.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    kinds = [to_arrow_type(rows.schema["lk"].dataType), to_arrow_type(ask.schema[key].dataType)]
    near = pa.list_(pa.struct([("d", pa.float64()), ("lk", kinds[0]), ("t", pa.list_(pa.float64()))]))
    schema = f"{key} {ask.schema[key].dataType.simpleString()}, near array<struct<d:double,lk:{rows.schema['lk'].dataType.simpleString()},t:array<double>>>"

    def search(keys: pa.Array, x: np.ndarray, own: list, library: tuple) -> pa.RecordBatch:
        names, anchors, targets, places = library
        found = find(x, anchors, [places.get(o, []) if o is not None else [] for o in own])
        return pa.RecordBatch.from_arrays([keys, pa.array([[{"d": d, "lk": names[j], "t": targets[j]} for d, j in each] for each in found], near)], [key, "near"])

    def library_of(table: pa.Table) -> tuple:
        table = table.sort_by("lk")
        names, places = table["lk"].to_pylist(), {}
        for i, group in enumerate(table["g"].to_pylist()):
            places.setdefault(group, []).append(i)
        return names, _rows(table["x"]), table["t"].to_pylist(), places

    n = rows.limit(shipped + 1).count()
    if not n:
        return ask.sparkSession.createDataFrame([], schema)
    if n <= shipped:
        shared = ask.sparkSession.sparkContext.broadcast(library_of(rows.toArrow()))

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield search(batch.column(0), _rows(batch.column(1)), batch.column(2).to_pylist(), shared.value)

        return ask.select(key, "x", "own").mapInArrow(run, schema)

    # Every block of queries meets every block of the library in a cell; each cell passes on the best of its own.
    asked = ask.count()
    tall, wide = -(-asked // BLOCK), -(-rows.count() // BLOCK)
    block, other = F.pmod(F.xxhash64(key), F.lit(tall)).cast("int"), F.pmod(F.xxhash64("lk"), F.lit(wide)).cast("int")
    left = ask.select(key, "x", "own", block.alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("c"))
    right = rows.select("lk", "x", "t", "g", other.alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))).alias("r"))

    def cell(queries: pa.Table, library: pa.Table) -> pa.Table:
        if not queries.num_rows or not library.num_rows:
            return pa.table([pa.array([], kinds[1]), pa.array([], near)], [key, "near"])
        return pa.Table.from_batches([search(queries[key].combine_chunks(), _rows(queries["x"]), queries["own"].to_pylist(), library_of(library))])

    parts = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(cell, schema)
    return parts.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, keep).alias("near"))


def knn(queries: DataFrame, library: DataFrame, key: str, library_key: str, anchor: str, target: str, k: int = 10, shipped: int = SHIPPED, own: str | None = None, group: str | None = None) -> DataFrame:
    """(key, prediction, distance): inverse-distance mean of the targets of the k nearest anchors.

    ``anchor`` and ``target`` are array columns; rows whose anchor is null or
    holds nulls are passed over.  Weights are 1 / (d + 1e-6); ties go to the
    least library key; ``distance`` is that of the nearest.  ``own``: a column of
    ``queries`` with the library key that is left out for the row, so that a
    table can be asked against its own other rows; with ``group``, a column of
    the library, all rows of that group are left out, such as those of a fold.
    """
    rows = library.select(F.col(library_key).alias("lk"), F.col(anchor).cast("array<double>").alias("x"), F.col(target).cast("array<double>").alias("t"), F.col(group or library_key).alias("g"))
    left_out = F.lit(None).cast(rows.schema["g"].dataType) if own is None else F.col(own)
    ask = queries.select(key, F.col(anchor).cast("array<double>").alias("x"), left_out.alias("own"))
    found = _met(ask, rows, key, _nearest(k), k, shipped)
    weight = F.transform("near", lambda x: 1 / (x["d"] + 1e-6))
    total = F.aggregate(weight, F.lit(0.0), lambda s, x: s + x)
    n = F.size(F.get("near", F.lit(0))["t"])
    prediction = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.aggregate(F.zip_with("near", weight, lambda x, w: F.get(x["t"], i) * w), F.lit(0.0), lambda s, x: s + x) / total,
    )
    return found.where(F.size("near") > 0).select(key, prediction.alias("prediction"), F.get("near", F.lit(0))["d"].alias("distance"))


def reconstruction_residual(queries: DataFrame, library: DataFrame, key: str, library_key: str, bands: str, k: int = 10, own: str | None = None, group: str | None = None) -> DataFrame:
    """(key, rmse, residual): how far the mean of the ``k`` nearest is from the row itself, in all and by band."""
    rows = library.withColumn("_t", F.col(bands))
    found = knn(queries, rows, key, library_key, bands, "_t", k, own=own, group=group).join(queries.select(key, F.col(bands).alias("_x")), key)
    apart = F.transform(F.arrays_zip(F.col("_x").alias("a"), F.col("prediction").alias("b")), lambda z: F.abs(z["a"] - z["b"]))
    square = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)
    return found.select(key, F.sqrt(square / F.size("_x")).alias("rmse"), apart.alias("residual"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_match(queries: DataFrame, library: DataFrame, key: str, library_key: str, spectrum: str, own: str | None = None, shipped: int = SHIPPED, group: str | None = None) -> DataFrame:
    """(key, match, gain): the library spectrum of greatest cosine, and the brightness that scales it.

    Ties go to the least library key; null spectra, those with nulls and library
    spectra of zeros match nothing.  ``own``: as in ``knn``.
    """
    spectra = F.col(spectrum).cast("array<double>")
    rows = library.select(F.col(library_key).alias("lk"), spectra.alias("x"), spectra.alias("t"), F.col(group or library_key).alias("g"))
    left_out = F.lit(None).cast(rows.schema["g"].dataType) if own is None else F.col(own)
    ask = queries.select(key, spectra.alias("x"), left_out.alias("own"))
    best = _met(ask, rows, key, _best_cosine, 1, shipped).where(F.size("near") > 0).select(key, F.get("near", F.lit(0)).alias("w"))
    both = best.join(ask.select(key, "x"), key)
    return both.select(key, F.col("w.lk").alias("match"), (dot(F.col("x"), F.col("w.t")) / dot(F.col("w.t"), F.col("w.t"))).alias("gain"))


def standardise(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column becomes 0."""
    stats = frame.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.stddev_pop(c).alias(f"{c}_std") for c in columns))
    joined = frame.crossJoin(stats)  # one row
    return joined.select(*[c for c in frame.columns if c not in columns], *(F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(0.0).alias(c) for c in columns))


def grid_search(costs: DataFrame, key: str, candidate: str, cost: str, pool: str | None = None) -> DataFrame:
    """The candidate of least cost of every key, or of least mean cost of every pool; ties to the least."""
    by = pool or key
    mean = costs.groupBy(by, candidate).agg(F.avg(cost).alias("c"))
    return mean.groupBy(by).agg(F.min_by(candidate, F.struct("c", candidate)).alias(candidate), F.min("c").alias("cost"))


def sharpness(curve: DataFrame, keys: list[str], at: str, cost: str, step: int = 5) -> DataFrame:
    """Second difference of a cost curve ``step`` places either side of its minimum, over its cost."""
    order = Window.partitionBy(*keys).orderBy(at)
    bent = curve.withColumn("second", F.lag(cost, step).over(order) + F.lead(cost, step).over(order) - 2 * F.col(cost))
    return bent.groupBy(*keys).agg(F.min_by(F.struct(at, (F.col("second") / F.col(cost)).alias("sharpness")), F.struct(cost, at)).alias("w")).select(*keys, f"w.{at}", "w.sharpness")


def principal_components(frame: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components by row, share of variance): one aggregation gives the covariance, the rest is its size."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = frame.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    return np.array([row[f"m{i}"] for i in range(len(columns))]), vectors[:, order].T, values[order] / values.sum()


def subspace_residual(frame: DataFrame, columns: list[str], mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """``frame`` with ``residual``: root mean square distance from the components' subspace."""
    centred = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]

    def total(xs: list[Column]) -> Column:
        out = xs[0]
        for x in xs[1:]:
            out = out + x
        return out

    scores = [total([c * float(w) for c, w in zip(centred, own, strict=True)]) for own in components]
    rest = [c - total([s * float(own[i]) for s, own in zip(scores, components, strict=True)]) for i, c in enumerate(centred)]
    return frame.withColumn("residual", F.sqrt(total([r * r for r in rest]) / len(columns)))
