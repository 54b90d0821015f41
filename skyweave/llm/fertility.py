"""Quality rule from tokeniser fertility.

Public vocabularies measure, for every whole text, the characters per token
(letters, digits and all beyond ASCII), the share of tokens that are lone bytes
of longer characters, and the entropy of its token distribution.  Bands per
language, or per script where the language has none, reject texts that a
vocabulary finds strange.
"""

from __future__ import annotations

import base64
from collections.abc import Collection, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.llm.shared import Scratch
from skyweave.llm.text_kernel import SPACE, byte_runs, texts_of, tidy
from skyweave.llm.word_cache import WordCache

#: (least characters per token, most; most byte-fallback share; least bits of token entropy, most) for
#: each vocabulary (piece_bpe_32k.model, byte_bpe_multi_50k.tiktoken), by script: well below and above
#: what a public sentence in a language of the script has (the first article of the Universal
#: Declaration of Human Rights).  Languages with labelled texts get a band of their own (``part_bands``).
BANDS = {
    "script:latin": ((1.6, 8.0, 0.05, 5.0, 12.0), (1.6, 8.0, 0.1, 5.0, 12.0)),
    "script:cyrillic": ((1.3, 8.0, 0.05, 4.8, 13.0), (1.5, 8.0, 0.1, 4.8, 13.0)),
    "script:greek": ((0.6, 8.0, 0.1, 4.2, 13.0), (1.0, 8.0, 0.15, 4.8, 13.0)),
    "script:arabic": ((0.6, 8.0, 0.1, 4.2, 13.0), (0.9, 8.0, 0.15, 4.5, 13.0)),
    "script:hebrew": ((0.55, 8.0, 0.1, 3.9, 13.0), (0.85, 8.0, 0.25, 4.5, 13.0)),
    "script:devanagari": ((0.5, 8.0, 0.3, 4.2, 13.0), (0.5, 8.0, 0.4, 4.2, 13.0)),
    "script:thai": ((0.6, 8.0, 0.2, 4.2, 13.0), (0.6, 8.0, 0.3, 4.2, 13.0)),
    "script:kana": ((0.5, 8.0, 0.4, 4.5, 13.0), (0.6, 8.0, 0.35, 4.5, 13.0)),
    "script:hangul": ((0.4, 8.0, 0.5, 4.2, 13.0), (0.6, 8.0, 0.35, 4.5, 13.0)),
    "script:han": ((0.5, 8.0, 0.45, 4.5, 13.0), (0.5, 8.0, 0.4, 4.5, 13.0)),
    "script:other": ((0.25, 8.0, 0.9, 4.0, 13.0), (0.25, 8.0, 0.9, 4.0, 13.0)),
}
_FIELDS = "n_words n_chars word_chars text_chars n_symbols n_dup_lines n_repeat_words".split()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
_TEXT = np.array([chr(b).isalnum() for b in range(128)] + [True] * 128)

#: Scripts by ranges of code points; letters outside them are "other".
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0xAC00, 0xD7A3),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
_NAMES = ["none", *SCRIPTS, "other"]


def _script_table() -> np.ndarray:
    """The script of a character by the first two bytes of its UTF-8 form, enough to tell these ranges apart."""
    table = np.full(1 << 16, len(_NAMES) - 1, np.uint8)
    table[: 128 << 8] = 0
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            for point in range(low, high + 1):
                own = chr(point).encode()
                if len(own) == 1:
                    table[own[0] << 8 : (own[0] + 1) << 8] = k
                else:
                    table[own[0] << 8 | own[1]] = k
    for own in range(0xC280, 0xC2C0):  # signs of the Latin supplement are no letters
        table[own] = 0
    table[0xE280 : 0xE2C0] = 0  # nor are general punctuation and symbols
    return table


_SCRIPT = _script_table()


def scripts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of the script that most letters of each row are of, 0 for rows without any; ties to the first."""
    at = np.flatnonzero(_LEAD[raw])
    follow = np.append(raw, 0)[at + 1].astype(np.int64)
    kind = _SCRIPT[raw[at].astype(np.int64) << 8 | follow]
    row = np.searchsorted(offsets, at, "right") - 1
    table = np.bincount(row * len(_NAMES) + kind, minlength=(len(offsets) - 1) * len(_NAMES)).reshape(-1, len(_NAMES))
    table[:, 0] = 0
    return table.argmax(1)


def _encoder(path: str):
    """(function from words to tokens, whether a token is a lone byte of a longer character) for a vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda words: model.encode([w.decode() for w in words], num_threads=1), np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        is_byte = np.zeros(max(ranks.values()) + 1, bool)
        is_byte[[i for piece, i in ranks.items() if len(piece) == 1 and piece[0] > 127]] = True
        return lambda words: [encoding.encode_ordinary(" " + w.decode()) for w in words], is_byte
    raise ValueError(f"no measure for {path}")


@lru_cache(maxsize=2)
def _cache(paths: tuple[str, ...]) -> tuple[WordCache, list[np.ndarray]]:
    encoders, is_byte = zip(*map(_encoder, paths), strict=True)
    return WordCache(*encoders), list(is_byte)


def _windows(ids: np.ndarray) -> np.ndarray:
    """A number for every three words in turn, equal for equal ones alone."""
    if len(ids) < 3:
        return ids[:0]
    if ids.max() < 1 << 21:
        return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1]
    return (pair[:-1] << 32) | ids[2:]


def _repeated(keys: np.ndarray) -> int:
    """Positions that windows of three cover whose key occurs twice or more."""
    if len(keys) < 2:
        return 0
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    often = count[inverse] > 1
    covered = np.zeros(len(keys) + 2, bool)
    for k in range(3):
        covered[k : k + len(keys)] |= often
    return int(covered.sum())


def _measure(raw: np.ndarray, offsets: np.ndarray, cache: WordCache, is_byte: list[np.ndarray]) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    text = raw.tobytes()
    docs = [text[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    words = [d.split() for d in docs]
    count = np.fromiter(map(len, words), np.int64, rows)
    ids = cache.lookup([w for own in words for w in own])
    first = np.concatenate([[0], np.cumsum(count)])

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    windows = _windows(ids)
    dup_lines = []
    for d in docs:
        lines = [x for x in d.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    lead = _LEAD[raw]
    out = {
        "n_words": count,
        "n_chars": per_row(lead),
        "word_chars": per_row(lead & ~SPACE[raw]),
        "text_chars": per_row(lead & _TEXT[raw]),
        "n_symbols": per_row(_SYMBOL[raw]),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": np.array([_repeated(windows[a : max(a, b - 2)]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.int64),
        "script": scripts(raw, offsets).astype(np.int64),
    }
    for k, own in enumerate(is_byte):
        tokens, lengths = cache.expand(ids, k)
        token_row = np.repeat(np.repeat(np.arange(rows), count), lengths)
        n_tokens = np.bincount(token_row, minlength=rows)
        key, times = np.unique((token_row.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64), return_counts=True)
        of_row = (key >> np.uint64(32)).astype(np.int64)
        share = times / n_tokens[of_row]
        out[f"n_tokens{k}"] = n_tokens.astype(np.int64)
        out[f"n_byte_tokens{k}"] = np.bincount(token_row, own[tokens], minlength=rows).astype(np.int64)
        out[f"entropy{k}"] = np.bincount(of_row, -share * np.log2(share), minlength=rows).astype(np.float64)
    return out


def measures(docs: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    """doc_id, lang, script, the base measures, and for vocabulary k, from 0, n_tokens<k>, chars_per_token<k>, byte_share<k>, entropy<k>."""
    each = range(len(vocabularies))
    longs = [*_FIELDS, "script", *(f"{name}{k}" for k in each for name in ("n_tokens", "n_byte_tokens"))]
    doubles = [f"entropy{k}" for k in each]

    def run(batches):
        cache, is_byte = _cache(tuple(vocabularies))
        with tidy():
            for batch in batches:
                raw, offsets = texts_of(batch.column(1))
                for a, b in byte_runs(offsets):
                    got = _measure(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], cache, is_byte)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], *(pa.array(got[k]) for k in (*longs, *doubles))], ["doc_id", "lang", *longs, *doubles])
            cache.clear()

    schema = "doc_id long, lang string, " + ", ".join([f"{k} long" for k in longs] + [f"{k} double" for k in doubles])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, schema)
    out = out.withColumn("script", F.get(F.array(*map(F.lit, _NAMES)), F.col("script").cast("int")))
    for k in each:
        tokens = F.greatest(f"n_tokens{k}", F.lit(1))
        out = out.withColumn(f"chars_per_token{k}", F.col("text_chars") / tokens).withColumn(f"byte_share{k}", F.col(f"n_byte_tokens{k}") / tokens)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_band(measured: DataFrame, named: Collection[str]) -> DataFrame:
    """``measured`` with band: the language if ``named``, else its script if ``named``, else script:other."""
    script = F.concat(F.lit("script:"), F.col("script"))
    return measured.withColumn("band", F.when(F.col("lang").isin(*named), F.col("lang")).when(script.isin(*named), script).otherwise("script:other"))


def fit_bands(measured: DataFrame, labels: DataFrame, vocabularies: int, tail: float = 0.002, least: int = 200) -> dict[str, tuple]:
    """Bands from labelled rows: of every language with ``least`` good texts, the range of their measures but for the tails.

    ``measured``: as ``measures`` gives; ``labels``: (doc_id, quality).  One
    aggregation over all labelled rows; the result has a row for each language.
    """
    good = measured.where("not base_failed and lang is not null").join(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    limits = [F.count("*").alias("n")]
    for k in range(vocabularies):
        limits += [F.percentile_approx(f"{name}{k}", F.lit(at), 10_000).alias(f"{name}{k}_{x}") for name in ("chars_per_token", "byte_share", "entropy") for x, at in enumerate((tail, 1 - tail))]
    rows = good.groupBy("lang").agg(*limits).where(F.col("n") >= least).collect()
    return {r["lang"]: tuple((r[f"chars_per_token{k}_0"], r[f"chars_per_token{k}_1"], r[f"byte_share{k}_1"], r[f"entropy{k}_0"], r[f"entropy{k}_1"]) for k in range(vocabularies)) for r in rows}


def part_bands(measured: DataFrame, labels: DataFrame, vocabularies: int, tail: float = 0.002, bad_tail: float = 0.02, least: int = 20) -> dict[str, tuple]:
    """Bands that part labelled good from bad texts, of every language with ``least`` good ones that pass the base rule.

    The least characters per token lie midway between what all but ``tail`` of
    the good texts exceed and all but ``bad_tail`` of the bad ones stay under;
    without five bad ones, at the former.  Other limits are those of the script
    that most good texts are in, as they part nothing.  ``measured``: as
    ``measures`` gives; ``labels``: (doc_id, quality).  One aggregation over all
    labelled rows; the driver sees a row for each language.
    """
    told = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    both = measured.where("not base_failed and lang is not null").join(told, "doc_id")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    limits = [F.count_if(good).alias("n"), F.count_if(bad).alias("bad"), F.mode(F.when(good, F.col("script"))).alias("script")]
    for k in range(vocabularies):
        limits.append(F.percentile_approx(F.when(good, F.col(f"chars_per_token{k}")), tail, 10_000).alias(f"good{k}"))
        limits.append(F.percentile_approx(F.when(bad, F.col(f"chars_per_token{k}")), 1 - bad_tail, 10_000).alias(f"bad{k}"))
    out = {}
    for r in both.groupBy("lang").agg(*limits).where(F.col("n") >= least).collect():
        rest = BANDS.get(f"script:{r['script']}", BANDS["script:other"])
        low = [(r[f"good{k}"] + r[f"bad{k}"]) / 2 if r["bad"] >= 5 else r[f"good{k}"] for k in range(vocabularies)]
        out[r["lang"]] = tuple((low[k], *rest[min(k, len(rest) - 1)][1:]) for k in range(vocabularies))
    return out


def fertility(docs: DataFrame, vocabularies: str | Sequence[str], bands: dict[str, tuple] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Quality measures and verdict for each row of ``docs`` (doc_id, text, lang).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the rule's own n_tokens, chars_per_token, byte_share,
    token_entropy, band; those of a second vocabulary end in _2, and so on.
    Words are encoded one by one, each with its space: the vocabularies' pieces
    never cross one.  ``base_failed``: fewer than 50 words, or over half of them
    in repeated windows of three.  ``kept``: base passed and all measures of
    every vocabulary inside the band.  Null and empty texts have zeros and fail;
    a null or unknown language takes its script's band; repeated rows are
    measured each; other columns are ignored.  With ``labels`` (doc_id, quality)
    languages that have enough of them get bands from them (``part_bands``); the
    measures are written once, to the shared folder.  Without, one pass and no
    shuffle.  Memory is bounded by a run of texts and the word cache.
    """
    vocabularies = [vocabularies] if isinstance(vocabularies, str) else list(vocabularies)
    table, measured = bands or BANDS, measures(docs, vocabularies)
    if labels is not None:
        measured = Scratch(docs.sparkSession, "fertility").keep(measured)
        table = table | part_bands(measured, labels, len(vocabularies))
    out = with_band(measured, table)
    kept, own = ~F.col("base_failed"), []
    for k in range(len(vocabularies)):

        def limit(x: int, k: int = k) -> Column:
            return F.element_at(F.create_map(*(F.lit(v) for name, each in table.items() for v in (name, float(each[k][x])))), F.col("band"))

        kept &= F.col(f"chars_per_token{k}").between(limit(0), limit(1)) & (F.col(f"byte_share{k}") <= limit(2)) & F.col(f"entropy{k}").between(limit(3), limit(4))
        end = f"_{k + 1}" if k else ""
        own += [F.col(f"{a}{k}").alias(b + end) for a, b in (("n_tokens", "n_tokens"), ("chars_per_token", "chars_per_token"), ("byte_share", "byte_share"), ("entropy", "token_entropy"))]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *own, "band")
