"""Fill-in-the-middle: texts cut in three at line ends and put into another order.

The lines of a text come from the tokenizers library: its Split pre-tokenizer
isolates every match of a pattern and gives the offsets in code points, without
any training.  The number of offsets is the number of lines, two ranks among
them are the cuts.  Everything around that is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.llm.shared import once

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: a line with its end, or what follows the last one.
LINE = r"[^\n]*\n|[^\n]+"


@dataclass
class Settings:
    """Percent of texts that are cut, and of those the percent that put the suffix first."""

    cut: int = 100
    suffix_first: int = 50
    seed: int = 7
    pattern: str = LINE


def offsets(text: str, splitter) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, in code points."""
    return [at for _, at in splitter.pre_tokenize_str(text)] if text else []


def _units(pattern: str):
    """(n, from, to) of a text and two numbers: its units, and where the units of the smaller and of the larger rank begin."""

    @F.arrow_udf("n long, low int, high int")
    def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        splitter = Split(Regex(pattern), "isolated")
        out = []
        for value, a, b in zip(text, one.to_pylist(), two.to_pylist(), strict=True):
            found = offsets(value.as_py(), splitter)
            ends = [0, *(end for _, end in found)]
            low, high = sorted((a % len(ends), b % len(ends)))
            out.append((len(found), ends[low], ends[high]))
        n, low, high = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["n", "low", "high"])

    return cuts


def fill_middle(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text).

    ``n``: units of the whole text.  ``form``: plain, psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle); numbers drawn from the sha-256 of
    ``seed:doc_id`` choose it and the cuts, so reruns agree and rows that share
    an id draw alike; a null id draws as an empty one.  A text that is empty or
    null, or holds one of the three marks, stays plain, its lengths null.  One
    line has cuts at its ends alone.  Other columns are ignored; an empty table
    gives an empty result.  No shuffle: one pass over the scan; a text is held
    whole by its task.
    """
    settings = settings or Settings()
    drawn = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), drawn.alias("drawn"))

    def number(k: int) -> Column:
        return F.conv(F.substring("drawn", 8 * k + 1, 8), 16, 10).cast("long")

    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (number(2) % 100 >= settings.cut)
    form = F.when(plain, "plain").when(number(3) % 100 < settings.suffix_first, "spm").otherwise("psm")
    cut = rows.withColumn("form", form).withColumn("u", _units(settings.pattern)(F.col("text"), number(0), number(1)))
    low, high = F.col("u.low"), F.col("u.high")
    prefix, middle = F.substring("text", F.lit(1), low), F.substring("text", low + 1, high - low)
    suffix = F.substring("text", high + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id", F.col("u.n").alias("n"), "form",
        F.when(moved, low).cast("long").alias("prefix_chars"), F.when(moved, high - low).cast("long").alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: each mark stands in it once, as texts that hold one stay plain."""

    def joined(parts: Column) -> Column:  # the parts between marks; nothing stands before the first
        psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
        return F.when(form == "psm", psm).otherwise(F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))

    return F.when(form == "plain", output).otherwise(once(F.split(output, "<[PSM]>", -1), joined))


def digest(made: DataFrame) -> DataFrame:
    """Digests of the outputs and of what is rebuilt from them."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: The same with SQL's own pattern functions.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS parts, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(parts) AS n, least(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) AS a, greatest(h1 % (len(parts) + 1), h2 % (len(parts) + 1)) AS b FROM u),
f AS (SELECT *, array_to_string(parts[1:a], '') AS p, array_to_string(parts[a + 1:b], '') AS m, array_to_string(parts[b + 1:], '') AS s,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""
