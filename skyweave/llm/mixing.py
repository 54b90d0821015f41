"""Mixing sources to target weights with DataFrame operations alone.

Every source is dealt by hash into blocks of documents, their number by the
source's.  A source's target fixes its quota of blocks: whole passes over all of
them, then blocks in permuted order until the target, the last one by documents.
A splitting tree deals the quotas to output shards: a node gives half of its
blocks to the left, the number of each source by a multivariate hypergeometric
draw, down to the quota of every source in every shard.  Shards then draw
disjoint runs of each source's permuted blocks and shuffle their rows locally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.llm.shared import WORD, Scratch


@dataclass
class Settings:
    """``share``: size of the mix over that of the corpus; ``most``: how often a source may be taken.

    A source has a block for every ``block_rows`` documents, from ``blocks`` to
    ``most_blocks``; the mix has 2 to the power ``levels`` shards, or enough for
    ``shard_rows`` of the corpus in each, to the power ``most_levels`` at most;
    ``part_rows``: rows that are sorted together inside a shard.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2
    blocks: int = 256
    block_rows: int = 20_000
    most_blocks: int = 1 << 16
    levels: int = 4
    shard_rows: int = 1_000_000
    most_levels: int = 14
    part_rows: int = 1_000
    seed: int = 11


def _hash(settings: Settings, *columns) -> Column:
    return F.xxhash64(F.lit(settings.seed), *columns)


def _keys(docs: DataFrame, settings: Settings) -> tuple[Column, Column, Column]:
    """(doc_id, copy, place) of a row: ``copy``, a hash of the text, tells rows of one id apart."""
    doc, copy = F.col("doc_id").cast("long"), F.xxhash64("text")
    return doc, copy, _hash(settings, F.lit("place"), doc, F.col("source"), copy)


def sized(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, source, size, copy, place) of each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    doc, copy, place = _keys(docs, settings)
    return docs.select(doc.alias("doc_id"), "source", size.alias("size"), copy.alias("copy"), place.alias("place"))


def targets(rows: DataFrame, settings: Settings) -> DataFrame:
    """(source, source_size, target) for each source of (source, size).

    Weights repeat along the sources by code point, null last.  Sharing the
    excess of capped sources again by weight until none is above its cap ends
    at one water level: a source has the lesser of its cap and level times
    weight.  The level follows from the sources in order of cap over weight.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))  # a row for each source
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*(F.lit(float(w)) for w in settings.weights))
    ranked = (
        sums.withColumn("weight", F.get(weights, (rank % len(settings.weights)).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(settings.most)))
        .withColumn("total", F.sum("source_size").over(one) * F.lit(settings.share))
    )
    order = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", (F.col("total") - before) / rest)
    open_level = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(one)
    target = F.coalesce(F.least("cap", open_level * F.col("weight")), F.col("cap"))
    return levelled.select("source", "source_size", target.alias("target"))


def _same(left: DataFrame, right: DataFrame, key: str, *also: Column, how: str = "inner") -> DataFrame:
    """A join in which null sources are equal; the right side holds a row for each source or block."""
    right = right.withColumnRenamed(key, f"{key}_r")
    condition = F.col(key).eqNullSafe(F.col(f"{key}_r"))
    for more in also:
        condition = condition & more
    return left.join(right, condition, how).drop(f"{key}_r")


def _block(settings: Settings, place: str, blocks: str) -> Column:
    return F.pmod(_hash(settings, F.lit("block"), place), F.col(blocks)).cast("int")


def _split(quotas: Column, node: Column, settings: Settings) -> Column:
    """How many blocks of each source (source, n) of a node go left: half of all, drawn without replacement.

    Blocks are looked at in turn and each goes with the share of places that
    are still open among blocks still to come, so the counts are a multivariate
    hypergeometric draw.
    """
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q["n"])
    first = F.struct(total.alias("left"), F.floor((total + node % 2) / 2).cast("long").alias("open"), F.array().cast("array<bigint>").alias("drawn"))

    def of_source(state: Column, q: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            chance = F.pmod(_hash(settings, F.lit("node"), node, q["source"], k), F.lit(1 << 52)) / F.lit(float(1 << 52))
            goes = (chance * at["left"] < at["open"]).cast("long")
            return F.struct((at["left"] - 1).alias("left"), (at["open"] - goes).alias("open"))

        blocks = F.when(q["n"] > 0, F.sequence(F.lit(1).cast("long"), q["n"])).otherwise(F.array().cast("array<bigint>"))
        after = F.aggregate(blocks, F.struct(state["left"].alias("left"), state["open"].alias("open")), one)
        drawn = lambda x: F.struct(x["left"].alias("left"), x["open"].alias("open"), F.array_append(state["drawn"], state["open"] - x["open"]).alias("drawn"))
        return F.get(F.transform(F.array(after), drawn), 0)

    return F.aggregate(quotas, first, of_source, lambda s: s["drawn"])


#: Level of the splitting tree from which on its nodes are dealt to all tasks.
SPREAD = 4


def shard_quotas(quotas: DataFrame, levels: int, settings: Settings) -> DataFrame:
    """(source, shard, n): the blocks of every source in every shard, from (source, n), by the splitting tree."""
    own = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("n").cast("long").alias("n"))))
    nodes = quotas.groupBy().agg(F.transform(own, lambda q: F.struct(q["source"].alias("source"), q["n"].alias("n"))).alias("quotas")).select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(levels):
        if level == SPREAD:
            nodes = nodes.repartition(2 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
        drawn = nodes.withColumn("drawn", _split(F.col("quotas"), F.col("node"), settings))
        left = F.zip_with("quotas", "drawn", lambda q, d: F.struct(q["source"].alias("source"), d.alias("n")))
        right = F.zip_with("quotas", "drawn", lambda q, d: F.struct(q["source"].alias("source"), (q["n"] - d).alias("n")))
        sides = F.array(F.struct((2 * F.col("node")).alias("node"), left.alias("quotas")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("quotas")))
        nodes = drawn.select(F.explode(sides).alias("s")).select("s.*")
    return nodes.select((F.col("node") - F.lit(1 << levels)).cast("int").alias("shard"), F.explode("quotas").alias("q")).select("q.source", "shard", "q.n")


def _decide(docs: DataFrame, settings: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(rows, sources, blocks, number of rows, levels): all that decides on draws, a row for each source and block.

    Only the rows of one block of each source, that in which its target ends,
    are sorted; nothing else is shuffled but sums.
    """
    base = scratch.keep(sized(docs, settings))
    counts = base.groupBy("source").agg(F.count("*").alias("rows"))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(settings.most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    n_blocks = F.greatest(F.least(F.ceil(F.col("rows") / settings.block_rows), F.lit(settings.most_blocks)), F.lit(settings.blocks)).cast("int")
    sources = _same(targets(base, settings), counts, "source").withColumn("passes", passes).withColumn("n_blocks", n_blocks)
    sources = scratch.keep(sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    total = sources.agg(F.sum("rows")).first()[0] or 0
    levels = min(settings.most_levels, max(settings.levels, (max(total - 1, 0) // settings.shard_rows).bit_length()))

    # Blocks in permuted order: whole ones, then the one in which the rest of the target ends.
    rows = _same(base, sources.select("source", "n_blocks"), "source").withColumn("block", _block(settings, "place", "n_blocks"))
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    permuted = Window.partitionBy("source").orderBy(_hash(settings, F.lit("order"), "source", "block"), "block")
    placed = sums.withColumn("rank", F.row_number().over(permuted) - 1).withColumn("before", F.sum("block_size").over(permuted) - F.col("block_size"))
    blocks = _same(placed, sources.select("source", "passes", "rest"), "source")
    blocks = blocks.withColumn("room", F.greatest(F.col("rest") - F.col("before"), F.lit(0.0))).withColumn("again", (F.col("room") > 0) & (F.col("block_size") > 0))
    blocks = scratch.keep(blocks.withColumn("ends", F.col("again") & (F.col("room") < F.col("block_size"))))

    ending = blocks.where("ends").select("source", F.col("block").alias("of_block"), "room")
    inside = Window.partitionBy("source").orderBy("place", "doc_id", "copy").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = _same(rows, ending, "source", F.col("block") == F.col("of_block")).withColumn("so_far", F.sum("size").over(inside)).where(F.col("so_far") <= F.col("room"))
    cut = prefix.groupBy("source").agg(F.max(F.struct("place", "doc_id", "copy")).alias("cut"), F.sum("size").alias("got"))
    whole = blocks.where("again and not ends").groupBy("source").agg(F.sum("block_size").alias("whole"))
    sources = _same(_same(sources, cut, "source", how="left"), whole, "source", how="left")
    sources = scratch.keep(sources.withColumn("gap", F.col("rest") - F.coalesce("got", F.lit(0)) - F.coalesce("whole", F.lit(0))))

    # What is left of a target goes to the one undrawn row that comes nearest to it.
    by_block = blocks.select("source", F.col("block").alias("of_block"), "again", "ends")
    undrawn = _same(_same(rows, by_block, "source", F.col("block") == F.col("of_block")), sources.select("source", "gap", "cut"), "source")
    key, miss = F.struct("place", "doc_id", "copy"), F.abs(F.col("gap") - F.col("size"))
    undrawn = undrawn.where((F.col("size") > 0) & ~(F.col("again") & (~F.col("ends") | F.coalesce(key <= F.col("cut"), F.lit(False)))) & (miss < F.col("gap")))
    filler = undrawn.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), key.alias("key"))).alias("f")).select("source", F.col("f.key").alias("filler"))
    sources = scratch.keep(_same(sources, filler, "source", how="left"))

    # Shards: quotas of blocks down the tree, then runs of permuted blocks for every shard.
    none = F.array().cast("array<int>")
    draws = F.concat(F.when(F.col("passes") > 0, F.sequence(F.lit(1), F.col("passes"))).otherwise(none), F.when(F.col("again"), F.array(F.lit(0))).otherwise(none))
    tickets = blocks.select("source", "block", "rank", F.explode(draws).alias("draw"))
    turn = Window.partitionBy("source").orderBy(F.col("draw") == 0, "draw", "rank")
    tickets = scratch.keep(tickets.withColumn("ticket", F.row_number().over(turn).cast("long") - 1))
    quotas = shard_quotas(tickets.groupBy("source").agg(F.count("*").alias("n")), levels, settings)
    by_source = Window.partitionBy("source").orderBy("shard")
    runs = scratch.keep(quotas.where("n > 0").withColumn("to", F.sum("n").over(by_source)))
    dealt = runs.select("source", "shard", F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)).alias("of_ticket"))
    dealt = _same(tickets, dealt, "source", F.col("ticket") == F.col("of_ticket"))
    shards = dealt.groupBy("source", F.col("block").alias("of_block")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("draw") > 0, F.struct("draw", "shard")))), lambda x: x["shard"]).alias("pass_shards"),
        F.max(F.when(F.col("draw") == 0, F.col("shard"))).alias("rest_shard"),
    )
    blocks = _same(blocks, shards, "source", F.col("block") == F.col("of_block"), how="left").select("source", "block", "again", "ends", "pass_shards", "rest_shard")
    return base, sources, scratch.keep(blocks), total, levels


def _draw(rows: DataFrame, doc: str, copy: str, place: str, sources: DataFrame, blocks: DataFrame, levels: int, settings: Settings) -> DataFrame:
    """``rows`` (source and any others) with ``_sw_shards``: the shard of every draw of the row."""
    by_source = sources.select("source", F.col("n_blocks").alias("_sw_n"), F.col("cut").alias("_sw_cut"), F.col("filler").alias("_sw_filler"))
    named = rows.join(by_source.withColumnRenamed("source", "_sw_source"), F.col("source").eqNullSafe(F.col("_sw_source"))).drop("_sw_source")
    named = named.withColumn("_sw_block", _block(settings, place, "_sw_n"))
    by_block = blocks.select(F.col("source").alias("_sw_source"), F.col("block").alias("_sw_b"), F.col("again").alias("_sw_again"), F.col("ends").alias("_sw_ends"), F.col("pass_shards").alias("_sw_pass"), F.col("rest_shard").alias("_sw_rest"))
    named = named.join(by_block, F.col("source").eqNullSafe(F.col("_sw_source")) & (F.col("_sw_block") == F.col("_sw_b"))).drop("_sw_source", "_sw_b")
    key = F.struct(F.col(place).alias("place"), F.col(doc).alias("doc_id"), F.col(copy).alias("copy"))
    again = (F.col("_sw_again") & (~F.col("_sw_ends") | F.coalesce(key <= F.col("_sw_cut"), F.lit(False)))) | F.coalesce(key == F.col("_sw_filler"), F.lit(False))
    other = F.pmod(_hash(settings, F.lit("other"), place), F.lit(1 << levels)).cast("int")  # for a row from a block not drawn
    passes = F.coalesce("_sw_pass", F.array().cast("array<int>"))
    shards = F.when(again, F.array_append(passes, F.coalesce("_sw_rest", other))).otherwise(passes)
    return named.withColumn("_sw_shards", shards).drop("_sw_n", "_sw_cut", "_sw_filler", "_sw_block", "_sw_again", "_sw_ends", "_sw_pass", "_sw_rest")


def plan(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, copy, source, size, source_size, target, taken, shards) for each row of ``docs``.

    ``shards``: the output shard of every draw of the row, empty if it is not
    drawn; ``taken``: size times draws.  Null and empty texts have size 0; a
    null source is a source of its own, the last; rows that repeat an id are
    rows each, told apart by ``copy``; rows that agree in id, source and text
    are drawn alike; an empty table gives an empty result.  Reruns agree,
    whatever the partitioning.
    """
    settings = settings or Settings()
    base, sources, blocks, _, levels = _decide(docs, settings, Scratch(docs.sparkSession, "mix"))
    drawn = _draw(base, "doc_id", "copy", "place", sources, blocks, levels, settings)
    drawn = _same(drawn, sources.select("source", "source_size", "target"), "source")
    return drawn.select("doc_id", "copy", "source", "size", "source_size", "target", (F.col("size") * F.size("_sw_shards")).alias("taken"), F.col("_sw_shards").alias("shards"))


def mix(docs: DataFrame, settings: Settings | None = None, shard: str | None = None) -> DataFrame:
    """The mix itself: a row of ``docs`` for every draw, dealt to its shard and shuffled there.

    Columns are those of ``docs``, and the shard's number under the name
    ``shard`` if one is given; a row drawn twice is there twice.  Texts are
    shuffled once, to their shards: what decides is joined by source and block.
    """
    settings = settings or Settings()
    names = docs.columns
    _, sources, blocks, total, levels = _decide(docs, settings, Scratch(docs.sparkSession, "mix"))
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_keys(docs, settings), ("_sw_doc", "_sw_copy", "_sw_place"), strict=True)))
    drawn = _draw(keyed, "_sw_doc", "_sw_copy", "_sw_place", sources, blocks, levels, settings)
    rows = drawn.select(*names, "_sw_place", F.posexplode("_sw_shards").alias("_sw_draw", "_sw_shard"))
    rows = rows.withColumn("_sw_at", _hash(settings, F.lit("shuffle"), "_sw_place", "_sw_draw"))
    parts = max(1, -(-int(total * settings.share) // (settings.part_rows << levels)))
    dealt = rows.repartition("_sw_shard", F.pmod(F.col("_sw_at"), F.lit(parts))).sortWithinPartitions("_sw_shard", "_sw_at")
    return dealt.select(*names, *([] if shard is None else [F.col("_sw_shard").alias(shard)]))


def digest(planned: DataFrame) -> DataFrame:
    return planned.select("doc_id", "size", "source_size", "target", "taken", F.size("shards").alias("draws"))
