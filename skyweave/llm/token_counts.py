"""Token counts with public vocabularies: lengths only, in batches balanced by bytes."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest piece of a text, in characters, and text bytes in one call of the tokenizer.
PIECE_CHARS = 1 << 16
CALL_BYTES = 1 << 20


def pieces(text: str, limit: int = PIECE_CHARS, drop_space: bool = False) -> list[str]:
    """Cut a text at safe boundaries into pieces of about ``limit`` characters.

    A boundary is safe before one space that stands between two characters
    which are not white space: no token spans it, in byte-level vocabularies
    because their pattern joins a space only to what follows, in word-based
    ones because they split there anyway.  With ``drop_space`` the space goes,
    as SentencePiece puts one in front of every text.  A stretch without such
    a boundary stays whole.
    """
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while cut != -1 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace() or "▁" in text[cut - 1 : cut + 2]):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        out.append(text[at:cut])
        at = cut + drop_space
    return [*out, text[at:]]


@lru_cache(maxsize=4)
def counter(path: str):
    """(function from texts to lengths, whether a cut drops its space) for a vocabulary file."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], False
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(e) for e in processor.encode(texts, num_threads=1)], True
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts], False
    raise ValueError(f"no library for {path}")


def count_tokens(docs: DataFrame, vocabulary: str, max_tokens: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text).

    Counts are those of the vocabulary's own library over the whole text,
    without added begin or end tokens.  ``vocabulary`` is a path every executor
    can open.  Long texts are cut at safe boundaries and calls hold about
    ``CALL_BYTES`` of text, so memory follows the call, not the Arrow batch.
    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted
    each; other columns are ignored; an empty table gives an empty result.
    No shuffle: one pass over the scan.
    """

    def run(batches):
        count, drop = counter(vocabulary)
        for batch in batches:
            sizes, tokens = [], [0] * batch.num_rows
            owners: list[int] = []
            queue: list[str] = []
            held = 0
            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                size = len(text.encode())
                sizes.append(size)
                for piece in pieces(text, drop_space=drop) if text else ():
                    queue.append(piece)
                    owners.append(row)
                    held += len(piece) * size // len(text)
                    if held >= CALL_BYTES:
                        for owner, n in zip(owners, count(queue), strict=True):
                            tokens[owner] += n
                        owners, queue, held = [], [], 0
            if queue:
                for owner, n in zip(owners, count(queue), strict=True):
                    tokens[owner] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(max_tokens))
