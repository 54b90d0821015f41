"""Which tiles a chunk of the grid needs: footprints, intersection and exclusive areas.

Footprints are polygons of several rings, which may overlap.  Inside a chunk the
plane is cut at the heights of all corners and crossings of edges; between two
of them edges do not cross, so what lies between neighbouring edges is a
trapezoid that each tile covers whole or not at all.  Sums of trapezoids are the
exact areas of unions and differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.grid import SINUSOIDAL, project_columns, sinusoidal_columns
from skyweave.operators.ordering import dealt

BOX = ("west", "south", "east", "north")
REQUIRED = "tiles array<string>, required array<string>, unreachable double"


def clip(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of a polygon inside a rectangle, one edge of the rectangle after the other."""
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(ring):
            break
        depth = (ring[:, axis] - limit) * sign
        out = []
        for k in range(len(ring)):
            a, b = depth[k - 1], depth[k]
            if (a >= 0) != (b >= 0):
                out.append(ring[k - 1] + (ring[k] - ring[k - 1]) * (a / (a - b)))
            if b >= 0:
                out.append(ring[k])
        ring = np.array(out).reshape(-1, 2)
    return ring


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """(x, y, x, y, ring) of all edges that are not level, the lower end first."""
    parts = []
    for k, ring in enumerate(rings):
        a, b = ring, np.roll(ring, -1, axis=0)
        up = (a[:, 1] <= b[:, 1])[:, None]
        parts.append(np.column_stack([np.where(up, a, b), np.where(up, b, a), np.full(len(ring), k)]))
    edges = np.concatenate(parts) if parts else np.zeros((0, 5))
    return edges[edges[:, 1] < edges[:, 3]]


def _heights(edges: np.ndarray, block: int = 512) -> np.ndarray:
    """The heights of all ends and crossings of edges, in order; those nearer than rounding are one."""
    x0, y0, x1, y1 = edges[:, :4].T
    slope = (x1 - x0) / (y1 - y0)
    at = x0 - slope * y0
    found = [y0, y1]
    for start in range(0, len(edges), block):
        own = slice(start, start + block)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (at[None] - at[own, None]) / (slope[own, None] - slope[None])
        low, high = np.maximum(y0[own, None], y0[None]), np.minimum(y1[own, None], y1[None])
        found.append(y[(y > low) & (y < high)])
    every = np.unique(np.concatenate(found))
    apart = np.diff(every, prepend=-np.inf) > 1e-12 * max(np.abs(every).max(initial=0.0), 1.0)
    return every[apart]


def overlay(rings: list[np.ndarray], owners: list[int], n: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, float]:
    """(area, exclusive area) of each of ``n`` owners of polygons, and the area of all together.

    An owner covers the union of its rings; a ring that crosses itself covers
    what an odd number of its turns encloses.
    """
    own, alone, whole = np.zeros(n), np.zeros(n), 0.0
    edges = _edges(rings)
    if not len(edges):
        return own, alone, whole
    heights = _heights(edges)
    x0, y0, x1, y1 = edges[:, :4].T
    ring = edges[:, 4].astype(int)
    of = np.array(owners)[ring]
    step = max(block // len(edges), 1)
    for start in range(0, len(heights) - 1, step):
        low, high = heights[:-1][start : start + step], heights[1:][start : start + step]
        mid = (low + high)[:, None] / 2
        x = np.where((y0 < mid) & (y1 > mid), x0 + (x1 - x0) * (mid - y0) / (y1 - y0), np.inf)
        order = np.argsort(x, axis=1)
        x = np.take_along_axis(x, order, axis=1)
        slab = np.arange(len(low))
        turns = np.zeros((len(low), len(rings)), bool)
        held = np.zeros((len(low), n), np.int64)  # rings of each owner that hold the place between two edges
        for k in range(int(np.isfinite(x).sum(1).max()) - 1):
            here, edge = np.isfinite(x[:, k]), order[:, k]
            turns[slab, ring[edge]] ^= here
            held[slab, of[edge]] += np.where(here, np.where(turns[slab, ring[edge]], 1, -1), 0)
            with np.errstate(invalid="ignore"):
                size = np.where(np.isfinite(x[:, k + 1]), x[:, k + 1] - x[:, k], 0.0) * (high - low)
            covers = held > 0
            several = covers.sum(1)
            own += (size[:, None] * covers).sum(0)
            alone += (size[:, None] * (covers & (several == 1)[:, None])).sum(0)
            whole += float((size * (several > 0)).sum())
    return own, alone, whole


def _inside(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """The distinct parts of the rings inside a box that have an area; the box alone if one of them covers it.

    Upright rectangles, which many footprints are, are clipped all at once.
    """
    rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
    corners = [k for k, r in enumerate(rings) if r.shape == (4, 2)]
    upright = np.array([rings[k] for k in corners]).reshape(-1, 4, 2)
    low, high = upright.min(1), upright.max(1)
    # all corners at the ends of both axes, those across from each other apart
    ends = ((upright == low[:, None]) | (upright == high[:, None])).all((1, 2)) & (upright[:, 0] != upright[:, 2]).all(1) & (upright[:, 1] != upright[:, 3]).all(1)
    ends &= ((upright[:, 0] == upright[:, 1]).sum(1) == 1) & ((upright[:, 2] == upright[:, 3]).sum(1) == 1)
    low, high = np.maximum(low[ends], box[:2]), np.minimum(high[ends], box[2:])
    held = np.unique(np.concatenate([low, high], 1)[(high > low).all(1)], axis=0)
    square = np.array([box[:2], (box[2], box[1]), box[2:], (box[0], box[3])])
    if (held == np.array(box)).all(1).any():
        return [square]
    others = set(range(len(rings))) - {corners[k] for k in np.flatnonzero(ends)}
    parts = {part.tobytes(): part for k in sorted(others) if area(part := clip(rings[k], box)) > 0}
    return [np.array([(a, b), (c, b), (c, d), (a, d)]) for a, b, c, d in held] + list(parts.values())


def requirement(box: tuple[float, float, float, float], tiles: dict[str, list[np.ndarray]], least: float) -> tuple[list[str], list[str], float]:
    """(tiles that a box meets, those it requires, share that no tile covers); ``least``: exclusive area of a required tile."""
    full = (box[2] - box[0]) * (box[3] - box[1])
    names, rings, owners = [], [], []
    corner = np.array([box[0], box[1]])
    square = np.array([[0.0, 0.0], [box[2] - box[0], 0.0], [box[2] - box[0], box[3] - box[1]], [0.0, box[3] - box[1]]])
    for tile in sorted(tiles):
        own = _inside([r - corner for r in tiles[tile]], (0.0, 0.0, *square[2]))
        if any(area(x) >= full * (1 - 1e-12) and len(x) == len(np.unique(x, axis=0)) for x in own):
            own = [square]  # many scenes of a tile cover a chunk whole: one of them says all
        if own:
            rings += own
            owners += [len(names)] * len(own)
            names.append(tile)
    size, alone, whole = overlay(rings, owners, len(names))
    met = [k for k in range(len(names)) if size[k] > full * 1e-12]
    # compared to a millionth of a pixel, so that rounding decides no tie
    tell = {k: round(float(alone[k]) / least, 6) if least else float(alone[k]) for k in met}
    required = sorted((k for k in met if tell[k] >= (1.0 if least else 0.0)), key=lambda k: (-tell[k], names[k]))
    if not required and met:
        required = [min(met, key=lambda k: (-round(float(size[k]) / full, 9), names[k]))]
    return [names[k] for k in met], [names[k] for k in required], max(0.0, 1.0 - whole / full) if full > 0 else 0.0


def footprints(scenes: DataFrame, crs: int | str) -> DataFrame:
    """(tile, rings): the distinct rings of all scenes of a tile, projected; ``geometry`` is GeoJSON.

    All parts of multi-polygons count; scenes without a tile or geometry do not.
    """
    ring = "array<array<array<double>>>"
    kind = F.get_json_object("geometry", "$.type")
    inner = F.from_json(F.get_json_object("geometry", "$.coordinates"), ring)
    many = F.from_json(F.get_json_object("geometry", "$.coordinates"), f"array<{ring}>")
    outer = F.when(kind == "Polygon", F.slice(inner, 1, 1)).when(kind == "MultiPolygon", F.transform(many, lambda p: p[0]))
    rings = scenes.where("tile is not null and tile <> ''").select("tile", F.explode(outer).alias("ring")).distinct()

    def there(p: Column) -> Column:
        at = sinusoidal_columns(p[0], p[1]) if crs == SINUSOIDAL else project_columns(p[0], p[1], F.lit(int(crs)))
        return F.array(at["x"], at["y"])

    return rings.select("tile", F.transform("ring", there).alias("ring")).groupBy("tile").agg(F.array_sort(F.collect_set("ring")).alias("rings"))


def _met(chunks: DataFrame, tiles: DataFrame, edge: float) -> DataFrame:
    """(west, south, east, north, tile, rings) of boxes that meet: both are dealt to cells of ``edge``, and meet in the cell of their common corner."""

    def cells(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / edge), F.floor(F.col(high) / edge))

    def in_cells(boxes: DataFrame, west: str, south: str, east: str, north: str) -> DataFrame:
        return boxes.withColumn("cx", F.explode(cells(west, east))).withColumn("cy", F.explode(cells(south, north)))

    both = in_cells(chunks, "west", "south", "east", "north").join(in_cells(tiles, "x0", "y0", "x1", "y1"), ["cx", "cy"])
    both = both.where((F.col("west") < F.col("x1")) & (F.col("east") > F.col("x0")) & (F.col("south") < F.col("y1")) & (F.col("north") > F.col("y0")))
    here = (F.floor(F.greatest("west", "x0") / edge) == F.col("cx")) & (F.floor(F.greatest("south", "y0") / edge) == F.col("cy"))
    return both.where(here).select(*BOX, "tile", "rings")


def classify(chunks: DataFrame, tiles: DataFrame, resolution: float) -> DataFrame:
    """For every chunk (chunk_id, west, south, east, north) the tiles it meets and those it requires.

    A tile is required if an area of at least one pixel of the chunk lies in it
    alone; if none is, the one that covers most is, alphabetically first on
    ties.  Required tiles are ordered by exclusive area.  ``unreachable``: the
    share that no tile covers.  Boxes decide the join, polygons the areas; rings
    of a tile may overlap.
    """
    flat = F.flatten("rings")
    boxed = tiles.select("tile", "rings", *(f(F.transform(flat, lambda p: p[k])).alias(n) for n, f, k in (("x0", F.array_min, 0), ("y0", F.array_min, 1), ("x1", F.array_max, 0), ("y1", F.array_max, 1))))
    # cells about as wide as a tile: a tile is in a few, a chunk mostly in one
    edge = boxed.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    # what a box requires is told once, however many chunks have that box
    placed = chunks.select(F.col("chunk_id").cast("int").alias("chunk_id"), *((F.col(c).cast("double") + 0.0).alias(c) for c in BOX))
    boxes = placed.select(*BOX).distinct()
    met = boxes.join(_met(boxes, boxed, max(float(edge), resolution)), [*BOX], "left")
    schema = pa.schema([*((c, pa.float64()) for c in BOX), ("tiles", pa.list_(pa.string())), ("required", pa.list_(pa.string())), ("unreachable", pa.float64())])

    def work(group: pa.Table) -> pa.Table:
        own: dict[str, list[np.ndarray]] = {}
        for tile, rings in zip(group["tile"].to_pylist(), group["rings"].to_pylist(), strict=True):
            if tile is not None:
                own.setdefault(tile, []).extend(np.array(r, float) for r in rings)
        box = tuple(group[c][0].as_py() for c in BOX)
        return pa.Table.from_pylist([dict(zip(schema.names, (*box, *requirement(box, own, resolution * resolution)), strict=True))], schema)

    def reaches(ring: Column) -> Column:
        x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
        return (F.array_max(x) > F.col("west")) & (F.array_min(x) < F.col("east")) & (F.array_max(y) > F.col("south")) & (F.array_min(y) < F.col("north"))

    picked = met.select(*BOX, "tile", F.filter("rings", reaches).alias("rings"))
    told = dealt(picked, *BOX).groupBy(*BOX).applyInArrow(work, ", ".join(f"{c} double" for c in BOX) + ", " + REQUIRED)
    return placed.join(told, [*BOX]).select("chunk_id", "tiles", "required", "unreachable")


def required_tiles(partition: DataFrame) -> DataFrame:
    """(chunk_id, tile, required_ord) for the ranked selection."""
    return partition.select("chunk_id", F.posexplode("required").alias("required_ord", "tile"))


def summary(partition: DataFrame) -> DataFrame:
    several: Column = F.count_if(F.size("required") > 1)
    return partition.agg(F.count("*").alias("chunks"), several.alias("multi_tile"), F.count_if(F.col("unreachable") > 0).alias("partly_unreachable"))
