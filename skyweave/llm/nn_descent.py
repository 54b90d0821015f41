"""Embedding near-dedup by NN-descent.

A neighbour graph starts from random projection trees and is refined by joining
neighbours of neighbours.  A vector's list holds its nearest few and neighbours
over the threshold; it grows while it is full of those, up to a bound.  A full
list hides links that leave a tight group, so vectors of different components are
compared under fresh trees until no link between components is found.  Trees cut
at medians, and codes that are still large are cut on, so that a corpus whose
vectors all point one way has no large code.  Recall is audited against brute
force on a bounded sample; further rounds follow while it is short, and brute
force in blocks if it stays so.  At last the components are compared
exhaustively in blocks, in double precision, which fixes links and counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.llm.shared import Scratch, connected_components, groups


@dataclass
class Settings:
    """``near``: nearest neighbours a list always holds; ``wide``: over-threshold neighbours it may hold, doubled up to ``widest`` while lists are full.

    ``leaf``: vectors of a tree's leaf; ``cell``: vectors of a group that one
    task compares; a code of over two cells is cut at the median up to ``cuts``
    times.  ``sampled``: vectors from which the medians of the trees come.
    ``audited``: vectors of the recall audit, which together with ``recall``
    decides on up to ``rounds`` rounds; ``passes``: fresh trees of a round at
    most.
    """

    threshold: float = 0.95
    near: int = 8
    wide: int = 48
    widest: int = 96
    trees: int = 8
    leaf: int = 96
    cell: int = 1024
    cuts: int = 24
    sampled: int = 4096
    descents: int = 2
    audited: int = 400
    recall: float = 0.999
    rounds: int = 3
    passes: int = 16
    seed: int = 5
    slack: float = 1e-5


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim.astype(np.float32), pa.float32())], ["u", "v", "sim"])


def _forest(link: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning tree of each part of a symmetric matrix of links: (from, to) by place."""
    u, v, left = [], [], np.ones(len(link), bool)
    for root in range(len(link)):
        if left[root]:
            left[root], todo = False, [root]
            while todo:
                i = todo.pop()
                new = np.flatnonzero(link[i] & left)
                left[new] = False
                u += [i] * len(new)
                v += new.tolist()
                todo += new.tolist()
    return u, v


def _cells() -> Column:
    """A cell for every pair of a ``block`` with one of ``blocks``; that of a block with itself is negative."""
    return F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.when(k == F.col("block"), -1 - k).otherwise(F.least(k, F.col("block")) * F.col("blocks") + F.greatest(k, F.col("block"))),
    )


def unit_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, key, size, exact, short): unit vectors as bytes of doubles and floats.

    Null, empty and zero vectors and those with null or non-finite components
    have null bytes.  ``key`` is equal for equal vectors.
    """

    def run(batches):
        for batch in batches:
            keys, sizes, exact, short = [], [], [], []
            for own in batch.column(1).to_pylist():
                good = own is not None and len(own) > 0 and all(x is not None for x in own)
                x = np.array(own, np.float64) if good else None
                if good and np.isfinite(x).all() and (big := np.abs(x).max()) > 0:
                    keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                    x = x / big
                    x = x / np.sqrt(x @ x)
                    exact.append(x.tobytes())
                    short.append(x.astype(np.float32).tobytes())
                    sizes.append(len(x))
                else:
                    for out in (keys, sizes, exact, short):
                        out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(exact, pa.binary()), pa.array(short, pa.binary())], ["vec_id", "key", "size", "exact", "short"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, key binary, size int, exact binary, short binary")


def _sample(vectors: DataFrame, settings: Settings) -> dict[int, np.ndarray]:
    """By length the vectors of least hash, ``sampled`` in all."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(settings.sampled).select("size", "short").collect()
    sizes = {r["size"] for r in rows}
    return {s: np.stack([np.frombuffer(r["short"], np.float32) for r in rows if r["size"] == s]) for s in sizes}


def _codes(vectors: DataFrame, bits: int, tree: int, sample: dict[int, np.ndarray], settings: Settings) -> DataFrame:
    """(tree, code, id, short) for ``trees`` trees: on which side of the sample's median each random projection lies."""

    def run(batches):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if size not in planes:
                    own = np.random.default_rng([settings.seed, tree, size]).standard_normal((settings.trees, bits, size)).astype(np.float32)
                    held = sample.get(size)
                    middle = np.zeros((settings.trees, bits), np.float32) if held is None else np.stack([np.median(held @ p.T, axis=0) for p in own])
                    planes[size] = own, middle
                part = batch.take(pa.array(rows))
                x = _matrix(part.column(2), np.float32)
                for t in range(settings.trees):
                    code = ((x @ planes[size][0][t].T > planes[size][1][t]) << np.arange(bits)).sum(1) * 4099 + size
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(code.astype(np.int64)), part.column(0), part.column(2)], ["tree", "code", "id", "short"])

    return vectors.select("id", "size", "short").mapInArrow(run, "tree int, code long, id long, short binary")


def _cut(coded: DataFrame, tree: int, scratch: Scratch, settings: Settings) -> DataFrame:
    """``coded``, kept, with every code of over two cells cut in halves at the median of a random projection, until none is left.

    Only the vectors of large codes are written again; a code names its
    vectors' length by its remainder of 4099.
    """
    done, large, used = [], scratch.keep(coded), []
    for level in range(settings.cuts):
        sizes = scratch.keep(large.groupBy("tree", "code").agg(F.count("*").alias("n")).where(F.col("n") > 2 * settings.cell).select("tree", "code"))
        if sizes.isEmpty():
            break
        used += [large, sizes]
        done.append(large.join(sizes, ["tree", "code"], "left_anti"))
        rest = large.join(sizes, ["tree", "code"], "left_semi")

        def run(batches, level=level):
            for batch in batches:
                at = np.zeros(batch.num_rows, np.float32)
                codes = batch.column(1).to_numpy()
                for size in np.unique(codes % 4099).tolist():
                    rows = np.flatnonzero(codes % 4099 == size)
                    plane = np.random.default_rng([settings.seed, tree, size, level]).standard_normal(size).astype(np.float32)
                    at[rows] = _matrix(batch.column(3).take(pa.array(rows)), np.float32) @ plane
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["tree", "code", "id", "short", "at"])

        placed = scratch.keep(rest.select("tree", "code", "id", "short").mapInArrow(run, "tree int, code long, id long, short binary, at float"))
        used.append(placed)
        middle = placed.groupBy("tree", "code").agg(F.percentile_approx("at", 0.5, 1000).alias("middle"))
        side = F.col("at") > F.col("middle")
        code = F.pmod(F.xxhash64("code", side, F.lit(level)), F.lit(1 << 50)) * 4099 + F.col("code") % 4099
        large = scratch.keep(placed.join(middle, ["tree", "code"]).select("tree", code.alias("code"), "id", "short"))
    if not done:
        return large
    out = large
    for part in done:
        out = out.unionByName(part.select("tree", "code", "id", "short"))
    out = scratch.keep(out)
    scratch.drop(large, *used)
    return out


def _leaves(coded: DataFrame, settings: Settings) -> DataFrame:
    """Nearest neighbours within the leaves of every tree: (u, v, sim)."""
    sizes = coded.groupBy("tree", "code").agg(F.count("*").alias("n"))
    cells = F.ceil(F.col("n") / settings.cell).cast("int")
    dealt = coded.join(sizes.where("n > 1"), ["tree", "code"]).withColumn("cell", F.pmod(F.xxhash64("id"), cells).cast("int"))

    def work(table: pa.Table):
        ids, x = table["id"].to_numpy(), _matrix(table["short"], np.float32)
        rng = np.random.default_rng([settings.seed, abs(int(table["code"][0].as_py()))])
        found, open_ = [], [np.arange(len(ids))]
        while open_:
            rows = open_.pop()
            if len(rows) > settings.leaf:  # a tree inside the cell: halves by a random direction
                order = np.argsort(x[rows] @ rng.standard_normal(x.shape[1]).astype(np.float32))
                open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
            elif len(rows) > 1:
                sim = x[rows] @ x[rows].T
                np.fill_diagonal(sim, -2)
                k = min(settings.near, len(rows) - 1)
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(rows)), k), top.ravel()
                found.append((ids[rows[i]], ids[rows[j]], sim[i, j]))
        return _edges(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else None

    parts = dealt.select("tree", "code", "cell", "id", "short").repartition("tree", "code", "cell").sortWithinPartitions("tree", "code", "cell")
    return parts.mapInArrow(lambda b: groups(b, ["tree", "code", "cell"], work), "u long, v long, sim float")


def _lists(edges: DataFrame, wide: int, settings: Settings) -> DataFrame:
    """(u, v, sim, fresh, least): each u's nearest, and all over the threshold up to ``wide``.

    ``least``: what a new neighbour must exceed to enter the list; the threshold
    at most, until the list is full of neighbours over it.
    """
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    near = F.col("sim") >= settings.threshold - settings.slack
    held = one.withColumn("place", F.row_number().over(order)).where((F.col("place") <= settings.near) | near & (F.col("place") <= wide))
    every = Window.partitionBy("u")
    full, last = F.count("*").over(every), F.min("sim").over(every)
    least = F.when(full >= wide, last).when(full >= settings.near, F.least(last, F.lit(settings.threshold - 2 * settings.slack))).otherwise(F.lit(-1.0))
    return held.select("u", "v", "sim", "fresh", least.cast("float").alias("least"))


def _descend(lists: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """(u, v, sim): pairs of a common neighbour, at least one of them new to it, that enter a list."""
    least = lists.groupBy("u").agg(F.max("least").alias("least")).withColumnRenamed("u", "id")
    pivots = lists.select(F.col("u").alias("pivot"), F.col("v").alias("id"), "fresh").unionByName(lists.select(F.col("v").alias("pivot"), F.col("u").alias("id"), "fresh"))
    pivots = pivots.groupBy("pivot", "id").agg(F.max("fresh").alias("fresh"))
    # hubs: a list longer than a cell is dealt to several
    sizes = pivots.groupBy("pivot").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("n > 1 and any")
    cells = F.ceil(F.col("n") / 256).cast("int")
    dealt = pivots.join(sizes, "pivot").withColumn("cell", F.pmod(F.xxhash64("id", "pivot"), cells).cast("int"))
    dealt = dealt.join(least, "id", "left").join(vectors.select("id", "short"), "id")

    def work(table: pa.Table):
        ids, fresh = table["id"].to_numpy(), table["fresh"].to_numpy(zero_copy_only=False)
        least, x = table["least"].to_numpy(zero_copy_only=False), _matrix(table["short"], np.float32)
        sim = x @ x.T
        enters = (sim > np.minimum(least[:, None], least[None])) & (fresh[:, None] | fresh[None])
        i, j = np.nonzero(np.triu(enters, 1))
        return _edges(np.concatenate([ids[i], ids[j]]), np.concatenate([ids[j], ids[i]]), np.concatenate([sim[i, j], sim[i, j]])) if len(i) else None

    parts = dealt.select("pivot", "cell", "id", "fresh", F.coalesce("least", F.lit(-1.0)).cast("float").alias("least"), "short").repartition("pivot", "cell").sortWithinPartitions("pivot", "cell")
    return parts.mapInArrow(lambda b: groups(b, ["pivot", "cell"], work), "u long, v long, sim float")


def _audit(vectors: DataFrame, lists: DataFrame, label: DataFrame, settings: Settings) -> tuple[int, int, DataFrame]:
    """(over-threshold neighbours of ``audited`` vectors, how many of them are found, those neighbours).

    Three in four of the sample are vectors whose best known neighbour is near
    the threshold or over it, as others say little about links; the rest are
    any.  Both are of least hash, a bounded number, and compared with all in
    blocks.
    """
    best = lists.groupBy(F.col("u").alias("id")).agg(F.max("sim").alias("best")).where(F.col("best") >= settings.threshold - 0.05)
    near = vectors.join(best.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(3 * settings.audited // 4)
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(settings.audited - 3 * settings.audited // 4)
    sample = near.unionByName(some).select("id", "size", "short").distinct().collect()
    ids = np.array([r["id"] for r in sample], np.int64)
    by_size = {s: ([i for i, r in enumerate(sample) if r["size"] == s]) for s in {r["size"] for r in sample}}
    matrix = {s: np.stack([np.frombuffer(sample[i]["short"], np.float32) for i in own]) for s, own in by_size.items()}

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size, own in by_size.items():
                rows = np.flatnonzero(sizes == size)
                if len(rows):
                    part = batch.take(pa.array(rows))
                    sim = matrix[size] @ _matrix(part.column(2), np.float32).T
                    i, j = np.nonzero(sim >= settings.threshold + settings.slack)
                    u, v = ids[own][i], part.column(0).to_numpy()[j]
                    yield _edges(u[u != v], v[u != v], sim[i, j][u != v])

    true = vectors.select("id", "size", "short").mapInArrow(run, "u long, v long, sim float")
    # components are compared in full later: a neighbour counts as found if the two are in one
    la, lb = label.select(F.col("node").alias("u"), F.col("component").alias("la")), label.select(F.col("node").alias("v"), F.col("component").alias("lb"))
    got = true.join(la, "u", "left").join(lb, "v", "left").agg(F.count("*").alias("n"), F.sum((F.coalesce("la", F.lit(-1)) == F.coalesce("lb", F.lit(-2))).cast("int")).alias("found")).first()
    return got["n"], got["found"] or 0, true


def _cross(vectors: DataFrame, coded: DataFrame, label: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links between different components under the codes of ``coded``; a forest of each task's.

    All vectors of a code that has several components are compared, in pairs of
    bounded blocks; no list limits them, and what is emitted grows with vectors.
    """
    named = coded.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("tree", "code").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    blocks = F.ceil(F.col("n") / settings.cell).cast("int")
    own = named.join(sizes, ["tree", "code"]).select("tree", "code", "id", "component", "short", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    dealt = own.select("tree", "code", "id", "component", "short", F.explode(_cells()).alias("cell"))

    def work(table: pa.Table):
        ids, part, x = table["id"].to_numpy(), table["component"].to_numpy(), _matrix(table["short"], np.float32)
        u, v = _forest((x @ x.T >= settings.threshold - settings.slack) & (part[:, None] != part[None]))
        return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["a", "b"]) if u else None

    parts = dealt.repartition("tree", "code", "cell").sortWithinPartitions("tree", "code", "cell")
    return parts.mapInArrow(lambda b: groups(b, ["tree", "code", "cell"], work), "a long, b long")


def candidate_components(vectors: DataFrame, scratch: Scratch, settings: Settings) -> tuple[DataFrame, float | None, int]:
    """((node, component), audited recall, audited links) for ``vectors`` (id, size, short).

    Every link is within a component, as far as audited; where the audit stays
    short after all rounds, all vectors of a length are one component.  Recall
    is null where the audit met no link.
    """
    n = vectors.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / (settings.leaf / 2))), 1, 40))
    lists, label, passes = None, None, settings.rounds
    sample = _sample(vectors, settings) if settings.rounds else {}
    old = F.lit(False).alias("fresh")

    def joined(edges: DataFrame, a: str, b: str) -> DataFrame:
        edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        known = edges if label is None else edges.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return scratch.keep(connected_components(known, scratch))

    def descended(lists: DataFrame, wide: int) -> DataFrame:
        new = _descend(lists, vectors, settings).withColumn("fresh", F.lit(True))
        after = scratch.keep(_lists(new.unionByName(lists.select("u", "v", "sim", old)), wide, settings))
        scratch.drop(lists)
        return after

    def saturated(lists: DataFrame, wide: int) -> bool:
        over = lists.where(F.col("sim") >= settings.threshold - settings.slack).groupBy("u").agg(F.count("*").alias("n"))
        return not over.where(F.col("n") >= wide).isEmpty()

    for step in range(settings.rounds):
        coded = _cut(_codes(vectors, bits, step, sample, settings), step, scratch, settings)
        found = _leaves(coded, settings).withColumn("fresh", F.lit(True))
        found = found if lists is None else found.unionByName(lists.select("u", "v", "sim", old))
        lists, wide = scratch.keep(_lists(found, settings.wide, settings)), settings.wide
        for _ in range(settings.descents):
            lists = descended(lists, wide)
        while wide < settings.widest and saturated(lists, wide):  # all of a wider list is new to its vector again
            wide = min(2 * wide, settings.widest)
            full = lists.where(F.col("least") >= settings.threshold - settings.slack)
            open_ = full.withColumn("least", F.lit(settings.threshold - 2 * settings.slack).cast("float")).withColumn("fresh", F.lit(True))
            wider = scratch.keep(lists.join(full.select("u").distinct(), "u", "left_anti").unionByName(open_))
            scratch.drop(lists)
            lists = descended(wider, wide)
        label = joined(lists.where(F.col("sim") >= settings.threshold - settings.slack), "u", "v")
        last = passes + settings.passes
        while passes < last and not (links := scratch.keep(_cross(vectors, coded, label, settings))).isEmpty():  # each time components join
            scratch.drop(coded)
            label = joined(links, "a", "b")
            coded = _cut(_codes(vectors, bits, passes, sample, settings), passes, scratch, settings)
            passes += 1
        scratch.drop(coded)
        audited, met, true = _audit(vectors, lists, label, settings)
        label = joined(true, "u", "v")
        if met >= settings.recall * audited:
            return label, (met / audited if audited else None), audited
    return vectors.select(F.col("id").alias("node"), F.col("size").cast("long").alias("component")), 1.0, 0


def _exact(vectors: DataFrame, label: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Components compared exhaustively, in pairs of bounded blocks: (kind, u, v) rows.

    ``kind`` 0: v vectors are linked to u, all copies counted; 1: a tree of links.
    """
    sizes = label.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / settings.cell).cast("int")
    own = label.join(sizes, "component").select(F.col("node").alias("id"), "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    dealt = own.select("id", "component", "block", F.explode(_cells()).alias("cell")).join(vectors.select("id", "copies", "exact"), "id")

    def work(table: pa.Table):
        ids, block, copies = table["id"].to_numpy(), table["block"].to_numpy(), table["copies"].to_numpy()
        x = _matrix(table["exact"], np.float64)
        link = x @ x.T >= settings.threshold
        np.fill_diagonal(link, False)
        if table["cell"][0].as_py() >= 0:  # pairs inside a block are compared in its own cell
            link &= block[:, None] != block[None]
        count = link @ copies.astype(np.int64)
        u, v = (ids[np.array(side, np.int64)] for side in _forest(link))
        some = np.flatnonzero(count)
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(u)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([ids[some], u])), pa.array(np.concatenate([count[some], v]))], ["kind", "u", "v"])

    parts = dealt.select("component", "cell", "id", "block", "copies", "exact").repartition("component", "cell").sortWithinPartitions("component", "cell")
    return parts.mapInArrow(lambda b: groups(b, ["component", "cell"], work), "kind int, u long, v long")


def near_vectors(table: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall, audited_links) for each row of ``table`` (vec_id, embedding).

    Links: cosine of at least ``threshold`` in double precision.  ``n_links``:
    rows linked directly, copies counted each; ``component_id``: the smallest
    vec_id reachable; ``kept``: it is the row's own; ``recall``: the share of
    ``audited_links`` (found by brute force in the last round) whose ends are in
    one component, null where the audit met no link.  Null and zero vectors and
    those with null or non-finite components link with nothing, vectors of
    different lengths not with each other; equal vectors are one class and
    compared once; rows that share an id but not a vector are separate vectors,
    each with the links of its own; rows with a null id link with nothing, have
    a null component and are kept; other columns are ignored; an empty table
    gives an empty result.
    """
    settings = settings or Settings()
    scratch = Scratch(table.sparkSession, "vectors")
    rows = scratch.keep(unit_vectors(table))
    classes = rows.where("key is not null and vec_id is not null").groupBy("key").agg(F.min(F.struct("vec_id", "size", "exact", "short")).alias("r"), F.count("*").alias("copies"))
    # numbered apart from ids, which may repeat; once written the numbers stay
    vectors = scratch.keep(classes.select(F.monotonically_increasing_id().alias("id"), "key", "copies", "r.*"))
    near, recall, audited = candidate_components(vectors, scratch, settings)
    exact = scratch.keep(_exact(vectors, near, settings))
    counts = exact.where("kind = 0").groupBy(F.col("u").alias("id")).agg(F.sum("v").alias("others"))
    label = scratch.keep(connected_components(exact.where("kind = 1").select(F.col("u").alias("a"), F.col("v").alias("b")), scratch))
    named = vectors.select("key", "id", "copies", "vec_id").join(counts, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = scratch.keep(named.select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component", F.col("vec_id").alias("first")))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    out = rows.select("vec_id", "key").join(named.join(least, "component").select("key", "links", "least"), "key", "left")
    known = F.col("vec_id").isNotNull()
    links, component = F.when(known, F.coalesce("links", F.lit(0))).otherwise(0), F.when(known, F.coalesce("least", "vec_id"))
    out = out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out.withColumn("recall", F.lit(recall).cast("double")).withColumn("audited_links", F.lit(audited).cast("long"))


#: The same by comparing all pairs.
SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS s FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.s * b.s) >= 0.95),
reach AS (SELECT vec_id, vec_id AS least FROM e UNION SELECT link.a, reach.least FROM reach JOIN link ON link.b = reach.vec_id),
part AS (SELECT vec_id, min(least) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM part LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a) USING (vec_id)
"""
