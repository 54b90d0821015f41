"""Toxicity: a convolutional text classifier trained in numpy, on all labelled rows in shards.

Words are runs of letters and digits, lower-cased.  A word's vector is the sum
of hashed embeddings of the word and of its beginnings, so inflected forms share
most of it.  Filters of several widths slide over the whole text; each keeps its
maximum, and a logistic layer makes the score.  Thresholds are calibrated by
language on labelled rows that training left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.shared import Scratch, restrict
from skyweave.llm.text_kernel import LOWER, byte_runs, span_hashes, spans, texts_of, tidy

#: Bytes that end a word: ASCII that is neither letter nor digit.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Lengths in bytes of the beginnings that have embeddings beside the whole word's.
PREFIXES = (4, 5, 6)
#: Changes of a model are added in units of 1 / _ONE.
_ONE = float(1 << 36)


@dataclass
class Settings:
    """``rows``, ``bytes``: labelled rows and their text in a shard of training, on average; all rows are in one."""

    rows: int = 2048
    bytes: int = 1 << 24
    bucket_bits: int = 16
    width: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    batch: int = 32
    rate: float = 0.04
    seed: int = 7


@dataclass
class Model:
    """``filters``: a column for each filter, zero in the rows beyond its width."""

    settings: Settings
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word and its beginnings, words per row)."""
    low = LOWER[raw]
    start, end, row = spans(low, offsets, _BREAK)
    shift = np.uint64(64 - bits)
    ids = np.empty((1 + len(PREFIXES), len(start)), np.int32)
    ends = [end, *(np.minimum(end, start + k) for k in PREFIXES)]
    for k, hashed in enumerate(span_hashes(low, start, *ends)):
        ids[k] = (hashed * np.uint64(2 * k + 1)) >> shift
    return ids, np.bincount(row, minlength=len(offsets) - 1)


def _windows(model: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of each window of words, begin of each row, place of each word); rows end in zero words."""
    reach, dim = max(model.settings.widths), model.settings.width
    begin = np.concatenate([[0], np.cumsum(counts + reach)])
    place = np.arange(ids.shape[1]) + np.repeat(np.arange(len(counts)) * reach, counts)
    vectors = model.embedding.take(ids[0], 0)
    for own in ids[1:]:
        vectors += model.embedding.take(own, 0)
    words = np.zeros((int(begin[-1]) + reach, dim), np.float32)
    words[place] = vectors
    flat = words.reshape(-1)
    wide = np.lib.stride_tricks.as_strided(flat, (len(words) - reach, reach * dim), (flat.itemsize * dim, flat.itemsize))
    return wide, begin[:-1], place


def scores(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    wide, begin, _ = _windows(model, ids, counts)
    act = wide @ model.filters
    edges = np.stack([begin, begin + np.maximum(counts, 1)], 1).ravel()
    top = np.maximum.reduceat(act, edges, 0)[::2]
    z = np.maximum(top + model.bias, 0) @ model.out[:-1] + model.out[-1]
    return 1 / (1 + np.exp(-np.clip(model.scale[0] * z.astype(np.float64) + model.scale[1], -30, 30)))


def _start(settings: Settings) -> Model:
    """The model before any row."""
    rng = np.random.default_rng(settings.seed)
    dim, mask, width_of = settings.width, _mask(settings), np.repeat(settings.widths, settings.filters)
    return Model(
        settings,
        (rng.standard_normal((1 << settings.bucket_bits, dim)) * 0.03).astype(np.float32),
        (rng.standard_normal(mask.shape) / np.sqrt(width_of * dim)).astype(np.float32) * mask,
        np.zeros(len(width_of), np.float32),
        np.concatenate([rng.standard_normal(len(width_of)) * 0.3, [0]]).astype(np.float32),
    )


def _mask(settings: Settings) -> np.ndarray:
    width_of = np.repeat(settings.widths, settings.filters)
    return (np.arange(max(settings.widths) * settings.width)[:, None] < width_of[None] * settings.width).astype(np.float32)


def _best(wide: np.ndarray, begin: int, count: int, filters: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the maximum of each filter over the windows of a row, ``step`` of them at once."""
    at = top = None
    for a in range(begin, begin + max(1, count), step):
        act = wide[a : min(a + step, begin + max(1, count))] @ filters
        own = act.argmax(0)
        value = np.take_along_axis(act, own[None], 0)[0]
        at, top = (a + own, value) if at is None else (np.where(value > top, a + own, at), np.maximum(value, top))
    return at, top


def _fetched(rows: pa.Array, settings: Settings) -> list[np.ndarray]:
    """The buckets of every text of a shard."""
    out = []
    raw, offsets = texts_of(rows.field("text"))
    for a, b in byte_runs(offsets):
        ids, counts = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], settings.bucket_bits)
        out += np.split(ids, np.cumsum(counts)[:-1], 1)
    return out


def _parts(shard: int, labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(rows to fit on, a fifth of each label for calibration) of a shard, in every round the same."""
    order = np.random.default_rng([settings.seed, shard]).permutation(len(labels))
    own = [order[labels[order] == label] for label in (0, 1)]
    return np.concatenate([x[len(x) // 5 :] for x in own]), np.concatenate([x[: len(x) // 5] for x in own])


def _epoch(model: Model, sums: tuple, shard: int, epoch: int, got: list, labels: np.ndarray, positive: float) -> tuple[Model, tuple, np.ndarray]:
    """(model, sums of squared gradients, buckets met) after one pass over the rows of a shard.

    ``positive``: the share of label 1 among all labelled rows, which weighs the classes.
    """
    settings = model.settings
    rng = np.random.default_rng([settings.seed, shard, epoch])
    dim, reach, mask = settings.width, max(settings.widths), _mask(settings)
    fit, _ = _parts(shard, labels, settings)
    model = replace(model, embedding=model.embedding.copy(), filters=model.filters.copy(), bias=model.bias.copy(), out=model.out.copy())
    *grads, seen = (x.copy() for x in sums)
    met = np.zeros(len(seen), bool)
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
    rate = settings.rate * (1 - 0.8 * epoch / settings.epochs)
    rng.shuffle(fit)
    for at in range(0, len(fit), settings.batch):
        part = fit[at : at + settings.batch]
        counts = np.array([got[i].shape[1] for i in part])
        ids = np.concatenate([got[i] for i in part], 1)
        wide, begin, place = _windows(model, ids, counts)
        found = [_best(wide, a, c, model.filters) for a, c in zip(begin.tolist(), counts.tolist(), strict=True)]
        best = np.stack([x for x, _ in found])
        pooled = np.maximum(np.stack([x for _, x in found]) + model.bias, 0)
        keep = ((rng.random(pooled.shape) > 0.2) / 0.8).astype(np.float32)  # dropout
        z = (pooled * keep) @ model.out[:-1] + model.out[-1]
        slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / len(part)).astype(np.float32)
        own = slope[:, None] * model.out[:-1] * keep * (pooled > 0)
        windows = wide[best]  # rows, filters, values
        g_filters = np.einsum("rkv,rk->vk", windows, own) * mask + 1e-4 * model.filters
        g_out = np.concatenate([(pooled * keep).T @ slope, [slope.sum()]]) + 1e-4 * model.out
        delta = (own[:, :, None] * model.filters.T[None]).reshape(-1, dim)
        of_word = np.full(len(wide) + reach, -1, np.int64)
        of_word[place] = np.arange(ids.shape[1])
        word = of_word[(best[:, :, None] + np.arange(reach)).ravel()]
        for x, g, total in zip((model.filters, model.bias, model.out), (g_filters, own.sum(0), g_out), grads, strict=True):
            total += g * g
            x -= (rate * g / np.sqrt(total)).astype(np.float32)
        real = (word >= 0) & delta.any(1)
        if real.any():
            bucket = ids[:, word[real]].T.ravel()
            some, inverse = np.unique(bucket, return_inverse=True)
            total = np.zeros((len(some), dim), np.float32)
            np.add.at(total, inverse, np.repeat(delta[real], len(ids), 0))
            seen[some] += (total * total).mean(1)
            model.embedding[some] -= rate * total / np.sqrt(seen[some])[:, None]
            met[some] = True
    return model, (*grads, seen), np.flatnonzero(met)


def _packed(model: Model, sums: tuple) -> np.ndarray:
    """All numbers of filters, bias and layer with their sums, in lines as wide as a bucket's."""
    flat = np.concatenate([np.asarray(x, np.float64).ravel() for x in (model.filters, model.bias, model.out, *sums[:3])])
    return np.pad(flat, (0, -len(flat) % (model.settings.width + 1))).reshape(-1, model.settings.width + 1)


def _round(shards: DataFrame, model: Model, sums: tuple, epoch: int, positive: float) -> tuple[Model, tuple]:
    """One pass over all shards, each from the same model; what they change is averaged.

    A bucket is averaged over the shards that met it.  Changes are added as
    integers, so the sum does not depend on the order; a fixed number of lines
    (one for each bucket and a few for the rest) comes to the driver.
    """
    settings, buckets = model.settings, len(model.embedding)
    shared = shards.sparkSession.sparkContext.broadcast((model, sums))
    names = [f"v{k}" for k in range(settings.width + 1)]

    def run(batches):
        model, sums = shared.value
        with tidy():
            for batch in batches:
                for k, shard in enumerate(batch.column("shard").to_pylist()):
                    rows = batch.column("rows").slice(k, 1).flatten()
                    got, labels = _fetched(rows, settings), rows.field("toxic").to_numpy(zero_copy_only=False)
                    after, now, met = _epoch(model, sums, shard, epoch, got, labels, positive)
                    change = np.concatenate([np.column_stack([after.embedding[met] - model.embedding[met], now[3][met] - sums[3][met]]), _packed(after, now) - _packed(model, sums)])
                    lines = np.concatenate([met, np.arange(buckets, buckets + len(change) - len(met))])
                    whole = np.rint(change * _ONE).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), *(pa.array(np.ascontiguousarray(v)) for v in whole.T)], ["line", *names])

    changed = shards.mapInArrow(run, "line long, " + ", ".join(f"{v} long" for v in names))
    got = changed.groupBy("line").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in names)).toArrow()
    shared.unpersist()
    line = got["line"].to_numpy()
    mean = np.stack([got[v].to_numpy() for v in names], 1) / _ONE / got["n"].to_numpy()[:, None]
    embedding, seen, packed = model.embedding.copy(), sums[3].copy(), _packed(model, sums)
    own = line < buckets
    embedding[line[own]] += mean[own, :-1].astype(np.float32)
    seen[line[own]] += mean[own, -1].astype(np.float32)
    packed[line[~own] - buckets] += mean[~own]
    flat, out, at = packed.ravel(), [], 0
    for x in (model.filters, model.bias, model.out, *sums[:3]):
        out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    return replace(model, embedding=embedding, filters=out[0], bias=out[1], out=out[2]), (*out[3:], seen)


def _margins(shards: DataFrame, model: Model) -> DataFrame:
    """(lang, toxic, z, n): how many rows that training left out have the unscaled score ``z``, to 1/256."""
    shared = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        with tidy():
            for batch in batches:
                for k, shard in enumerate(batch.column("shard").to_pylist()):
                    rows = batch.column("rows").slice(k, 1).flatten()
                    _, rest = _parts(shard, rows.field("toxic").to_numpy(zero_copy_only=False), model.settings)
                    rows = rows.take(pa.array(rest))
                    p = np.array([scores(model, g, np.array([g.shape[1]]))[0] for g in _fetched(rows, model.settings)])
                    z = np.rint((np.log(p) - np.log1p(-p)) * 256) / 256  # the scale is still 1, 0
                    yield pa.RecordBatch.from_arrays([rows.field("lang").cast(pa.string()), rows.field("toxic").cast(pa.int32()), pa.array(z, pa.float64())], ["lang", "toxic", "z"])

    return shards.mapInArrow(run, "lang string, toxic int, z double").groupBy("lang", "toxic", "z").agg(F.count("*").alias("n"))


def _calibrate(model: Model, margins: DataFrame) -> None:
    found = margins.groupBy("toxic", "z").agg(F.sum("n").alias("n")).orderBy("toxic", "z").collect()
    labels, z, weight = (np.array([r[c] for r in found], np.float64) for c in ("toxic", "z", "n"))
    if len(set(labels.tolist())) < 2:
        return
    target = np.where(labels == 1, 0.98, 0.02)
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - target) * z).sum(), (weight * (p - target)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
    model.scale = np.array([max(a, 1e-3), b])
    cuts = np.linspace(0.2, 0.8, 61)

    def threshold(labels: np.ndarray, passed: np.ndarray, n: np.ndarray) -> float:
        """The cut of best F1, the nearest to a half of several; ``passed``: the cuts at or under the score."""
        f1 = [2 * (n * (passed > k) * labels).sum() / max((n * ((passed > k) + labels)).sum(), 1e-9) for k in range(len(cuts))]
        top = cuts[np.array(f1) >= max(f1) - 1e-9]
        return float(min(top, key=lambda c: abs(c - 0.5)))

    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + b, -30, 30)))
    model.default = threshold(labels, (cuts[None] <= p[:, None]).sum(1), weight)
    # by language at most a row for each label and number of cuts; few positive rows: the threshold of all
    often = margins.where("lang is not null and toxic = 1").groupBy("lang").agg(F.sum("n").alias("all")).where("all >= 20").select("lang")
    p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("z") * float(model.scale[0]) + float(b), F.lit(30.0)), F.lit(-30.0))))
    passed = F.size(F.filter(F.lit(cuts.tolist()), lambda c: c <= p)).alias("passed")
    by_lang: dict[str, list] = {}
    for r in margins.join(often, "lang").groupBy("lang", "toxic", passed).agg(F.sum("n").alias("n")).collect():
        by_lang.setdefault(r["lang"], []).append((r["toxic"], r["passed"], r["n"]))
    for lang in sorted(by_lang):
        model.thresholds[lang] = threshold(*(np.array(x) for x in zip(*by_lang[lang], strict=True)))


def shard_rows(docs: DataFrame, labels: DataFrame, settings: Settings, scratch: Scratch | None = None) -> tuple[DataFrame, dict[int, int]]:
    """((shard, rows) of all labelled texts that are not held out, number of rows by label)."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    usable = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = scratch.keep(usable)  # of known size, so that the planner can spare texts a shuffle
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = texts.select("doc_id", F.octet_length("text").alias("size")).join(usable, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    counts = {r["toxic"]: r["n"] for r in found}
    n = max(1, -(-sum(counts.values()) // settings.rows), -(-sum(r["size"] for r in found) // settings.bytes))
    # texts and labels meet under the shard, in the one shuffle of texts
    none = F.lit(None)
    rows = restrict(texts, "doc_id", usable).withColumn("toxic", none.cast("int"))
    rows = rows.unionByName(usable.select("doc_id", none.cast("string").alias("text"), none.cast("string").alias("lang"), "toxic"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(n, "shard").groupBy("shard", "doc_id")
    # a set, sorted: copies of a row count once, and any partitioning gives the same shards
    rows = rows.agg(F.max("toxic").alias("toxic"), F.collect_set(F.when(F.col("text").isNotNull(), F.struct("text", "lang"))).alias("own")).where("toxic is not null").select("shard", "doc_id", "toxic", F.explode("own").alias("own"))
    shards = rows.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("doc_id", "own.text", "own.lang", "toxic"))).alias("rows"))
    return shards, counts


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Train on all labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    The rows are dealt by hashed id to shards, whose number grows with them and
    which stay in the shared folder.  In every epoch each shard is passed from
    the same model and the changes are averaged, so reruns and any partitioning
    agree; a shard keeps a fifth of its rows for calibration.  Only the model,
    of a fixed size, and counts come to the driver.  Null labels, ids or texts
    are left out of training alone; of labels that disagree the greater counts.
    """
    settings = settings or Settings()
    scratch = Scratch(docs.sparkSession, "toxicity")
    shards, counts = shard_rows(docs, labels, settings, scratch)
    model = _start(settings)
    if len(counts) < 2:  # nothing to learn from: a constant score
        model.out[:] = 0
        model.scale = np.array([0.0, -4.0 if 1 not in counts else 4.0])
        return model
    shards = scratch.keep(shards)
    sums = (*(np.full_like(x, 1e-6) for x in (model.filters, model.bias, model.out)), np.full(len(model.embedding), 1e-6, np.float32))
    for epoch in range(settings.epochs):
        model, sums = _round(shards, model, sums, epoch, counts[1] / sum(counts.values()))
    margins = scratch.keep(_margins(shards, model))
    _calibrate(model, margins)
    scratch.drop(shards, margins)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, lang and any others) with score, predicted and toxic appended.

    ``score`` sees the whole text alone; null and empty texts have the score of
    no words.  ``predicted``: score >= 0.5.  ``toxic``: score at or over the
    threshold of the row's language.  Own columns of these names are replaced.
    One pass, no shuffle; the model (about 3 MB, a fixed size) goes with the task.
    """
    docs = docs.drop("score", "predicted", "toxic")
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        with tidy():
            for batch in batches:
                raw, offsets = texts_of(batch.column(at))
                for a, b in byte_runs(offsets):
                    ids, counts = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.settings.bucket_bits)
                    got = scores(model, ids, counts)
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(got, pa.float64())], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    scored = docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", DoubleType()))
    cut = F.lit(model.default)
    if model.thresholds:
        of_lang = F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair))
        cut = F.coalesce(F.try_element_at(of_lang, F.col("lang")), cut)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("toxic", F.col("score") >= cut)
