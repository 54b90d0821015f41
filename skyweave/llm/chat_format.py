"""Chat formatting with Spark expressions alone.

Turns are collected as structs and sorted, adjacent turns of one role are merged,
and the pieces are concatenated.  Control strings inside texts and roles are
escaped reversibly, so the turns can be read back from the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.llm.shared import once

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turns of these roles are under the loss mask.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    """Texts without ``<|``: backslashes are doubled, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _runs(turns: Column) -> Column:
    """Adjacent turns of one role, merged: (role, at, parts)."""

    def cut(turns: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(turns) - 1),
            lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
        )
        return once(starts, lambda own: F.transform(
            F.arrays_zip(own.alias("at"), F.concat(F.slice(own, 2, F.size(own)), F.array(F.size(turns))).alias("to")),
            lambda x: F.struct(
                F.get(turns, x["at"])["role"].alias("role"),
                x["at"].alias("at"),
                F.transform(F.sequence(x["at"], x["to"] - 1), lambda i: F.get(turns, i)["text"]).alias("parts"),
            ),
        ))

    return once(turns, cut)


def _head(run: Column) -> Column:
    """What follows the start mark of a run's frame, up to its first text."""
    return F.concat(_escape_role(run["role"]), F.lit("\n"))


def _frame(run: Column) -> Column:
    return F.concat(F.lit(START), _head(run), F.array_join(F.transform(run["parts"], escape), SEPARATOR), F.lit(END + "\n"))


def _mask(run: Column, number: Column) -> Column:
    """The learned texts of a run, by their place in the pieces between marks: each text is one, each end one more."""
    learned = F.when(run["role"].isin(*LEARNED), run["parts"]).otherwise(F.array().cast("array<string>"))
    return F.transform(
        learned,
        lambda text, k: F.struct(
            (run["at"] + k + number + 1).alias("piece"),
            F.when(k == 0, F.length(_head(run))).otherwise(0).alias("start"),
            F.length(escape(text)).alias("length"),
        ),
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) for each conversation of (conv_id, turn, role, text).

    Rows are ordered by turn, ties by role and text, nulls first; null roles and
    texts count as empty; rows that repeat are turns each; a null conv_id is a
    conversation of its own; other columns are ignored; an empty table gives an
    empty result.  Adjacent turns of one role share a frame, a separator
    between their texts.  ``loss_mask``: (piece, start, length) in code points
    of every assistant text, in order; pieces are what ``formatted`` holds
    between its marks (``pieces``), so no mark is ever under the loss.
    One shuffle by conversation; a conversation is one string in the end, so it
    is held whole by the task that makes it, in time linear in its turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    merged = grouped.select("conv_id", _runs(F.col("turns")).alias("runs"))
    return merged.select("conv_id", F.array_join(F.transform("runs", _frame), "").alias("formatted"), F.flatten(F.transform("runs", _mask)).alias("loss_mask"))


def pieces(formatted: Column) -> Column:
    """What a formatted text holds between its marks, in order; texts never hold a mark."""
    return F.split(formatted, r"<\|im_(?:start|sep|end)\|>", -1)


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""

    def block(text: Column) -> Column:
        role = F.substring_index(text, "\n", 1)
        head, tail = F.length(role) + 1, len(END) + 1
        body = F.substring(text, head + 1, F.length(text) - head - tail)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda part: F.struct(_unescape_role(role).alias("role"), unescape(part).alias("text")))

    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), block))


def digest(chats: DataFrame) -> DataFrame:
    """Per conversation the digests of what its formatted text holds, whole and under the loss mask, read back from it."""

    def learned(own: Column) -> Column:
        return F.transform("loss_mask", lambda m: unescape(F.substring(F.get(own, m["piece"]), m["start"] + 1, m["length"])))

    spoken = once(pieces(F.col("formatted")), learned)
    return (
        chats.select("conv_id", read_back(F.col("formatted")).alias("turns"), F.array_join(spoken, "").alias("spoken"), F.length("formatted").cast("long").alias("formatted_chars"))
        .withColumn("told", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2("told", 256).alias("turns_sha256"),
            F.length("spoken").cast("long").alias("loss_chars"),
            F.sha2("spoken", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts hold control strings."""
    probe = conversations.sparkSession.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.unionByName(probe)


SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) AS role_chars
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens THEN length('<|im_start|>') + role_chars + 1 + length('<|im_end|>') + 1 ELSE length('<|im_sep|>') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
