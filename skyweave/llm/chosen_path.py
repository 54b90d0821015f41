"""MinHash near-duplicate detection by a chosen-path set similarity join.

Sets that are equal form one class, and only class representatives go on.  In
each of several independent trees a node of documents chooses minwise tokens
(coordinates of the MinHash sketch) and branches its documents by their values;
large nodes branch on, small ones are compared exhaustively by sketch.  With two
chosen coordinates a node, a pair of similarity s stays together in a tree of
any depth with probability q = 1 - (1 - s q)^2, at least 0.88 for s = 0.75, so
seven trees miss such a pair with probability below 1e-6.

A node passes on only a spanning forest of its similar sketches, strongest
first, so what it emits grows with its documents and not with their pairs.  The
forests join documents to neighbourhoods, outside which no link can lie.  In a
large neighbourhood the forest's links are confirmed first; then documents of
different components are compared on full sets in a grid of bounded blocks: one
cell for a small neighbourhood, few for one that is mostly one component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.shared import Scratch, connected_components, groups, restrict, split_by
from skyweave.llm.text_kernel import shingle_sets, tidy

#: Coordinates of a sketch; each holds 32 bits of a minwise value, the lower halves of all first.
COORDINATES = 64


@dataclass
class Settings:
    """``numerator`` of 100: the least similarity of a link.

    ``leaf``: documents that a node may have to be compared exhaustively;
    ``depth``: levels of branching, after which the documents of a larger node
    are one neighbourhood.  ``passes``: equal coordinates, of 64, of sketches
    that count as similar; a pair of similarity 0.75 has fewer with probability
    below 1e-6.  ``block``: documents of a block of the exact comparison.
    """

    words: int = 5
    numerator: int = 75
    trees: int = 7
    branches: int = 2
    leaf: int = 1000
    depth: int = 3
    passes: int = 30
    block: int = 400
    seed: int = 1


def _sketcher(seed: int):
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)

    def sketch(own: np.ndarray) -> bytes:
        """32 bits of the least value under each of the hash functions."""
        least = np.full(COORDINATES, np.iinfo(np.uint64).max)
        for at in range(0, len(own), 4096):
            value = own[at : at + 4096, None] * factor + shift
            value ^= value >> np.uint64(32)
            np.minimum(least, value.min(0), out=least)
        least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (least >> np.uint64(48)).astype(np.uint16).tobytes() + (least >> np.uint64(32)).astype(np.uint16).tobytes()

    return sketch


def _key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, copy, n_shingles, set_key, sketch) per row; empty sets have null key and sketch; ``copy``: a hash of the text."""

    def run(batches):
        sketch = _sketcher(settings.seed)
        with tidy():
            for batch in batches:
                sizes, keys, made = [], [], []
                for own in shingle_sets(batch.column(2), settings.words):
                    sizes.append(len(own))
                    keys.append(_key(own) if len(own) else None)
                    made.append(sketch(own) if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], ["doc_id", "copy", "n_shingles", "set_key", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").mapInArrow(run, "doc_id long, copy long, n_shingles long, set_key binary, sketch binary")


def _children(rows: DataFrame, path, settings: Settings) -> DataFrame:
    """A row (path, rep) for each chosen coordinate of each row; ``path``: the node's own column."""
    chosen = []
    for branch in range(settings.branches):
        # coordinates of a node: two different ones, from its path
        slot = F.pmod(F.xxhash64(path, F.lit(settings.seed)) + branch * (1 + 2 * F.pmod(F.xxhash64(path, F.lit(-7)), F.lit(31))), F.lit(COORDINATES)).cast("int")
        low, high = (F.col("sketch").substr(slot * 2 + 1 + half, F.lit(2)) for half in (0, 2 * COORDINATES))
        chosen.append(F.xxhash64(path, slot, low, high))
    return rows.select("rep", F.explode(F.array(*chosen)).alias("path"))


def _forests(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Distinct (a, b): spanning forests of the similar sketches of every node (path, rep, sketch)."""

    def work(table: pa.Table) -> pa.RecordBatch | None:
        reps = table["rep"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(len(reps), COORDINATES)
        # Prim's algorithm: the strongest tie of every document to the tree so far
        best, tie = np.full(len(reps), -1, np.int16), np.zeros(len(reps), np.int64)
        left, a, b = np.ones(len(reps), bool), [], []
        at = 0
        for _ in range(len(reps) - 1):
            left[at] = False
            near = (sketch == sketch[at]).sum(1, dtype=np.int16)
            closer = left & (near > best)
            best[closer], tie[closer] = near[closer], at
            at = int(np.where(left, best, -2).argmax())
            if best[at] >= settings.passes:
                a.append(reps[at])
                b.append(reps[tie[at]])
        if not a:
            return None
        a, b = np.array(a), np.array(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    half = F.col("sketch").substr(F.lit(1), F.lit(2 * COORDINATES)).alias("sketch")
    parts = nodes.select("path", "rep", half).repartition("path").sortWithinPartitions("path")
    return parts.mapInArrow(lambda batches: groups(batches, ["path"], work), "a long, b long").distinct()


def _links(cells: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links between documents of different labels of every cell, enough to join their labels.

    ``cells``: (area, cell, rep, label, elements).  Intersections of all pairs
    of a cell are counted exactly, as products of its 0-1 matrix of elements.
    """

    def work(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows != len(first := np.unique(table["rep"].to_numpy(), return_index=True)[1]):
            table = table.take(first)  # a set that came twice
        reps, labels = table["rep"].to_numpy(), table["label"].to_numpy()
        column = table["elements"].combine_chunks()
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(reps)), lengths)
        shared = count[place] > 1
        number = np.cumsum(count > 1) - 1
        owner, place = owner[shared], number[place[shared]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        common = np.zeros((len(reps), len(reps)), np.float32)
        width = 2048
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            x, y = np.searchsorted(place, [at, at + width])
            part = np.zeros((len(reps), width), np.float32)
            part[owner[x:y], place[x:y] - at] = 1
            common += part @ part.T
        both = lengths[:, None] + lengths[None] - common.astype(np.int64)
        linked = (100 * common.astype(np.int64) >= settings.numerator * both) & (labels[:, None] != labels[None])
        i, j = np.nonzero(np.triu(linked, 1))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        a, b = [], []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(int(labels[x])), find(int(labels[y]))
            if p != q:
                root[p] = q
                a.append(reps[x])
                b.append(reps[y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    parts = cells.select("area", "cell", "rep", "label", "elements").repartition("area", "cell").sortWithinPartitions("area", "cell")
    return parts.mapInArrow(lambda batches: groups(batches, ["area", "cell"], work), "a long, b long")


def _cells(members: DataFrame, settings: Settings) -> DataFrame:
    """(area, cell, rep, label) from (area, rep, label): every two documents of different labels meet in a cell.

    Documents of an area's largest label and all others are dealt to blocks
    apart; a block of others meets every block, blocks of the largest label
    never meet each other.  Areas of one label are left out.
    """
    parts = members.groupBy("area", "label").agg(F.count("*").alias("n"))
    areas = parts.groupBy("area").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    small = F.col("all") <= settings.block
    first = F.when(small, 0).otherwise(F.ceil(F.col("m.n") / settings.block)).cast("int")
    rest = F.when(small, 1).otherwise(F.ceil((F.col("all") - F.col("m.n")) / settings.block)).cast("int")
    dealt = members.join(areas.select("area", F.when(small, None).otherwise(F.col("m.label")).alias("major"), first.alias("first"), rest.alias("rest")), "area")
    is_major = F.coalesce(F.col("label") == F.col("major"), F.lit(False))
    own = F.pmod(F.xxhash64("rep"), F.when(is_major, F.col("first")).otherwise(F.col("rest"))).cast("int")
    dealt = dealt.withColumn("is_major", is_major).withColumn("own", own)
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: F.when(F.col("is_major"), F.col("own") * F.col("rest") + k).otherwise(-1 - F.least(k, F.col("own")) * F.col("rest") - F.greatest(k, F.col("own"))))
    with_first = F.when(F.col("is_major") | (F.col("first") == 0), F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.col("first") - 1, F.lit(0))), lambda k: k * F.col("rest") + F.col("own")))
    return dealt.select("area", "rep", "label", F.explode(F.concat(with_rest, with_first)).alias("cell"))


def _sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(rep, elements) of the wanted (rep, set_key, doc_id), from whole texts; a few may come twice."""

    def run(batches):
        seen = set()
        for batch in batches:
            reps, sets = [], []
            for rep, key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), settings.words), strict=True):
                if rep not in seen and _key(own) == key:  # rows that repeat an id may hold other texts
                    seen.add(rep)
                    reps.append(rep)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "elements"])

    texts = restrict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted)
    return texts.join(wanted, "doc_id").select("rep", "set_key", "text").mapInArrow(run, "rep long, elements array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = (
        pairs.select("a", "b")
        .join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("x")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("y")), "b")
        .withColumn("common", F.size(F.array_intersect("x", "y")))
    )
    return both.where(100 * F.col("common") >= settings.numerator * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    As ``marked``, without its hash of the text.
    """
    return marked(docs, settings).drop("copy")


def distinct_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the least id.

    Rows with a null id and rows without words stay.  Of rows that agree in id
    and text one stays, any of them if they differ elsewhere; of rows that share
    an id alone each is decided by its own text.
    """
    rows = Scratch(docs.sparkSession, "distinct").keep(marked(docs, settings).where("doc_id is not null").select(F.col("doc_id").alias("_sw_doc"), F.col("copy").alias("_sw_copy"), "kept"))
    keyed = docs.withColumn("_sw_doc", F.col("doc_id").cast("long")).withColumn("_sw_copy", F.xxhash64("text"))
    left = keyed.join(rows.where("not kept").select("_sw_doc", "_sw_copy").distinct(), ["_sw_doc", "_sw_copy"], "left_anti")
    repeated = rows.groupBy("_sw_doc", "_sw_copy").agg(F.count("*").alias("n")).where("n > 1")
    several, single = split_by(left, "_sw_doc", repeated)
    return single.unionByName(several.dropDuplicates(["_sw_doc", "_sw_copy"])).select(*docs.columns)


def marked(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, copy, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    A set: the distinct shingles of the lower-cased words of the whole text;
    with fewer words the whole sequence.  Texts without words, and null texts,
    have empty sets and link with nothing.  Links: similarity of at least
    ``numerator`` hundredths, confirmed on full sets.  ``component_id``: the
    smallest doc_id reachable; ``kept``: it is the row's own.  Rows that repeat
    an id are one document where their texts agree, else separate ones, each in
    its own text's component; rows with a null id link with nothing, have a
    null component and are kept; other columns are ignored; an empty table gives
    an empty result.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    rows = scratch.keep(sketches(docs, settings))
    full = rows.where("set_key is not null and doc_id is not null")
    least = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "sketch")).alias("least"))
    # classes are numbered as they are written: rows that share an id may be of several
    classes = scratch.keep(least.select(F.monotonically_increasing_id().alias("rep"), "set_key", "least.doc_id", "least.sketch"))

    # Levels: nodes of one document go, small ones are compared, large ones branch on.
    level = None
    for tree in range(settings.trees):
        own = _children(classes, F.lit(tree).cast("long"), settings)
        level = own if level is None else level.unionByName(own)
    sketch = classes.select("rep", "sketch")
    small, ties = None, None
    for depth in range(settings.depth):
        level = scratch.keep(level)
        sizes = level.groupBy("path").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1")
        nodes = scratch.keep(level.join(sizes, "path"))
        scratch.drop(level)
        own = nodes.where(F.col("n") <= settings.leaf).select("path", "rep")
        small = own if small is None else small.unionByName(own)
        large = nodes.where(F.col("n") > settings.leaf)
        if depth == settings.depth - 1:
            ties = large.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
        elif large.isEmpty():
            break
        else:
            level = _children(large.select(F.col("path").alias("parent"), "rep").join(sketch, "rep"), F.col("parent"), settings)
    pairs = _forests(small.join(sketch, "rep"), settings)
    pairs = scratch.keep(pairs if ties is None else pairs.unionByName(ties).distinct())

    # Neighbourhoods, and the components that the forests' links make in large ones.
    area = scratch.keep(connected_components(pairs, scratch).select(F.col("node").alias("rep"), F.col("component").alias("area")))
    sets = scratch.keep(_sets(docs, classes.select("rep", "set_key", "doc_id").join(area.select("rep"), "rep"), settings))
    wide = area.groupBy("area").agg(F.count("*").alias("n")).where(F.col("n") > settings.block).select("area")
    wide_reps = area.join(wide, "area").select(F.col("rep").alias("a"))
    links = scratch.keep(_confirm(pairs.join(wide_reps, "a", "left_semi"), sets, settings))
    label = scratch.keep(connected_components(links, scratch))
    members = area.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("area", "rep", F.coalesce("component", "rep").alias("label"))
    more = _links(_cells(members, settings).join(sets, "rep"), settings)
    links = scratch.keep(links.unionByName(more))
    label = scratch.keep(connected_components(links, scratch))

    linked = classes.select("rep", "set_key", "doc_id").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    first = linked.where("component is not null").groupBy("part").agg(F.min("doc_id").alias("first"))
    named = linked.join(first, "part", "left").select("set_key", F.coalesce("first", "doc_id").alias("component"))
    out = rows.select("doc_id", "copy", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "copy", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The same by counting the shared shingles of all pairs that share any.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS p FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pair AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT doc_id, doc_id AS least FROM documents UNION SELECT link.a, reach.least FROM reach JOIN link ON link.b = reach.doc_id WHERE reach.least < link.a),
part AS (SELECT doc_id, min(least) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM part LEFT JOIN n USING (doc_id)
"""
