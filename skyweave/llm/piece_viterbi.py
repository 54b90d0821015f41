"""SentencePiece encoding and decoding by batched numpy merges, as the library encodes.

The scores of a BPE vocabulary are merge ranks, which do not add up to that of a
segmentation: words are encoded by merging the neighbours of best rank until no
two of them join into a piece.  Distinct words of equal length advance together:
the hashes of all their substrings probe the sorted keys of the pieces, and each
step merges one pair of every word.  Characters that no piece holds fall back to
byte pieces.  The Viterbi search, for vocabularies with additive scores, is kept
beside it as ``encode_words``.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from skyweave.llm.text_kernel import byte_runs, mix, texts_of, tidy
from skyweave.llm.word_cache import WordCache

MARK = "▁"
#: Cells of one batch of words (words x positions x piece lengths).
CELLS = 1 << 20
_BASE = 0xA0761D6478BD642F | 1
_NONE = -1
#: Longest word whose pairs are looked at as a row at every step; longer ones keep a heap.
ROW = 128
_TOP = 20
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTER = re.compile(f"[{_LETTERS}]")


class Pieces:
    """The pieces of a vocabulary: sorted keys, scores, bytes, and the characters they hold."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: dict[int, int]):
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        own = [i for i, is_normal in enumerate(normal) if is_normal]
        self.longest = max(len(pieces[i]) for i in own)
        self.lengths = sorted({len(pieces[i]) for i in own}, reverse=True)
        keys = np.array([self._hash(np.array([[ord(c) for c in pieces[i]]], np.uint64))[0] for i in own], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(own, np.int32)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.scores = np.array(scores, np.float64)[self.ids]
        #: Most substrings are no piece: the top bits of their hashes tell before the search.
        self.known = np.zeros(1 << _TOP, bool)
        self.known[self.keys >> np.uint64(64 - _TOP)] = True
        #: An unknown character costs more than the worst piece.
        self.unknown = float(self.scores.min()) - 10.0
        if any(MARK in pieces[i].lstrip(MARK) for i in own):
            raise ValueError("a piece crosses words")
        held = {c for i in own for c in pieces[i]}
        cut = re.escape("".join(c for c in "\n\t\r\x0b\x0c" if c not in held) + MARK)
        # Marks of punctuation that no piece joins to a letter part from letters as well.
        joined = {c for i in own for pair in zip(pieces[i], pieces[i][1:]) if any(map(_LETTER.match, pair)) for c in pair}
        points = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined))
        other = f"(?![^{_LETTERS}{points}{cut} ])"
        #: A word: spaces and what follows; characters that no piece holds, and a literal mark, stand alone.
        self.word = re.compile(f" *[{_LETTERS}]++{other}| *[{points}]++{other}| *[^ {cut}]+| +|[{cut}]")
        text = [pieces[i].replace(MARK, " ").encode() if normal[i] else b"" for i in range(len(pieces))]
        for value, i in byte_ids.items():
            text[i] = bytes([value])
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.byte_ids] = True
        self.ranks = dict(zip((pieces[i] for i in own), zip((float(scores[i]) for i in own), own)))
        self.cache = WordCache(self.merge_words)

    @staticmethod
    def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = codes.shape[1]
        up, down = (np.cumprod(np.array([1, *[factor] * n], np.uint64), dtype=np.uint64) for factor in (_BASE, pow(_BASE, -1, 1 << 64)))
        total = np.zeros((codes.shape[0], n + 1), np.uint64)
        np.cumsum(mix(codes + np.uint64(1)) * up[:n], axis=1, out=total[:, 1:])
        return total, down

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        total, down = self._prefix(codes)
        return mix(total[:, -1] * down[0] + np.uint64(codes.shape[1]))

    def encode_words(self, words: list[str]) -> list[np.ndarray | list[int]]:
        """Piece ids of each word by greatest sum of scores; a space stands for the mark."""
        return self._by_length(words, lambda codes: self._viterbi(codes))

    def merge_words(self, words: list[str]) -> list[np.ndarray | list[int]]:
        """Piece ids of each word by merges in the order of the scores, those of the library."""
        return self._by_length(words, lambda codes: self._merge(codes) if codes.shape[1] <= ROW else [self._merge_long(row) for row in codes])

    def _by_length(self, words: list[str], encode) -> list[np.ndarray | list[int]]:
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w == MARK:  # a literal mark would read back as a space
                out[i] = self.byte_ids[list(MARK.encode())].tolist()
            else:
                by_length.setdefault(len(w), []).append(i)
        for length, members in by_length.items():
            step = max(1, CELLS // (length * self.longest))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                joined = "".join(words[i] for i in part).replace(" ", MARK)
                codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(part), length)
                for i, ids in zip(part, encode(codes), strict=True):
                    out[i] = ids
        return out

    def _probe(self, codes: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(lengths of pieces, the place of each substring among the pieces by length, word and end)."""
        n, length = codes.shape
        total, down = self._prefix(codes.astype(np.uint64))
        lengths = [k for k in self.lengths if k <= length]
        if 1 not in lengths:
            lengths.append(1)
        found = np.full((len(lengths), n, length + 1), _NONE, np.int32)  # by end position
        for x, k in enumerate(lengths):
            hashed = mix((total[:, k:] - total[:, :-k]) * down[: length - k + 1] + np.uint64(k))
            some = np.nonzero(self.known[hashed >> np.uint64(64 - _TOP)])
            probe = hashed[some]
            place = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            found[x, some[0], some[1] + k] = np.where(self.keys[place] == probe, place, _NONE)
        return lengths, found

    def _merge(self, codes: np.ndarray) -> list[list[int]]:
        n, length = codes.shape
        lengths, found = self._probe(codes)
        # row 0: a substring of a length that no piece has
        at_length = np.zeros(2 * length + 2, np.int32)
        at_length[lengths] = np.arange(1, len(lengths) + 1)
        found = np.concatenate([np.full((1, n, length + 1), _NONE, np.int32), found])
        # ends of the symbols by their start, starts by their end, and the score of each with the next
        end = np.tile(np.arange(1, length + 2), (n, 1))
        start = np.tile(np.arange(-1, length), (n, 1))
        gain = np.full((n, length), -np.inf)

        def score(rows: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
            place = found[at_length[to - at], rows, np.minimum(to, length)]
            return np.where((to <= length) & (place >= 0), self.scores[place], -np.inf)

        for at in range(length - 1):
            gain[:, at] = score(np.arange(n), np.full(n, at), np.full(n, at + 2))
        live = np.arange(n)
        while len(live):
            own = gain[live]
            at = own.argmax(1)  # ties go to the left
            some = own[np.arange(len(live)), at] > -np.inf
            live, at = live[some], at[some]
            middle = end[live, at]
            to = end[live, middle]
            end[live, at] = to
            start[live, to] = at
            gain[live, middle] = -np.inf
            after = np.where(to < length, end[live, np.minimum(to, length)], length + 1)
            gain[live, at] = score(live, at, after)
            rows, here = live[at > 0], at[at > 0]
            before = start[rows, here]
            gain[rows, before] = score(rows, before, end[rows, here])
        out = []
        for i, row in enumerate(codes):
            ids, at = [], 0
            ends = end[i].tolist()
            while at < length:
                place = found[at_length[ends[at] - at], i, ends[at]]
                ids += [int(self.ids[place])] if place >= 0 else self.byte_ids[list(chr(int(row[at])).encode())].tolist()
                at = ends[at]
            out.append(ids)
        return out

    def _merge_long(self, codes: np.ndarray) -> list[int]:
        """The same for one word, with the pairs in a heap."""
        word = codes.astype(np.uint32).tobytes().decode("utf-32-le")
        length = len(word)
        end, start, heap = list(range(1, length + 1)), list(range(-1, length)), []

        def offer(at: int) -> None:
            if at >= 0 and end[at] < length and (known := self.ranks.get(word[at : end[end[at]]])):
                heapq.heappush(heap, (-known[0], at, end[at], end[end[at]]))

        for at in range(length):
            offer(at)
        while heap:
            _, at, middle, to = heapq.heappop(heap)
            if end[at] == middle and end[middle] == to:
                end[at], end[middle], start[to] = to, -1, at
                offer(at)
                offer(start[at])
        ids, at = [], 0
        while at < length:
            known = self.ranks.get(word[at : end[at]])
            ids += [known[1]] if known else self.byte_ids[list(word[at].encode())].tolist()
            at = end[at]
        return ids

    def _viterbi(self, codes: np.ndarray) -> list[list[int]]:
        n, length = codes.shape
        lengths, found = self._probe(codes)
        gain = np.where(found >= 0, self.scores[found], -np.inf)
        single = gain[lengths.index(1)]
        single[np.isneginf(single)] = self.unknown
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, length + 1), np.int16)
        everyone = np.arange(n)
        for end in range(1, length + 1):
            live = [x for x, k in enumerate(lengths) if k <= end]
            option = np.stack([best[:, end - lengths[x]] + gain[x, :, end] for x in live])
            top = option.argmax(0)  # lengths fall, so ties take the longer piece
            best[:, end] = option[top, everyone]
            back[:, end] = np.array(live, np.int16)[top]
        step = np.array(lengths)
        at, tokens = np.full(n, length), []
        while at.max() > 0:
            live = at > 0
            x = back[everyone, at]
            tokens.append(np.where(live, found[x, everyone, at], -2))
            at = np.where(live, at - step[x], 0) if live.any() else at
            codes_at = at
            tokens[-1] = np.where(live & (tokens[-1] == _NONE), -3 - codes_at, tokens[-1])
        out = []
        for row, own in zip(codes, np.array(tokens[::-1]).T, strict=True):
            ids: list[int] = []
            for t in own.tolist():
                if t >= 0:
                    ids.append(int(self.ids[t]))
                elif t <= -3:
                    ids.extend(self.byte_ids[list(chr(int(row[-3 - t])).encode())].tolist())
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of each text's ids); an empty text has none."""
        words = [self.word.findall(" " + t) if t else [] for t in texts]
        rows = self.cache.lookup([w for own in words for w in own])
        ids, lengths = self.cache.expand(rows)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        return ids, np.bincount(owner, lengths, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts in turn, offsets); the space in front of every text goes."""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        first = np.cumsum(counts)[counts > 0] - counts[counts > 0]
        lead = first[(size[first] > 0) & (self.bytes[np.minimum(start[first], len(self.bytes) - 1)] == 32)]
        start[lead] += 1
        size[lead] -= 1
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(start - (ends - size), size) + np.arange(total)]
        ends = np.concatenate([[0], ends])
        return data, ends[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    names = [model.id_to_piece(i) for i in range(n)]
    return Pieces(names, [model.get_score(i) for i in range(n)], normal, {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)})


def encode(docs: DataFrame, vocabulary: str, with_text: bool = True) -> DataFrame:
    """``docs`` (text and any others), without its text if not ``with_text``, with token_ids, n_tokens, n_byte_tokens, round_trip appended.

    ``token_ids``: those of the vocabulary's own library (a SentencePiece BPE
    model with byte fallback and no text normalisation), but for literal marks.  ``round_trip``: the decoded ids equal the text byte for
    byte; a literal mark (U+2581) is kept apart from a space by its bytes.
    Null texts have null ids, empty texts no ids, both 0 tokens; repeated rows
    are encoded each; own columns of these names are replaced.  One pass, no
    shuffle; memory is bounded by a run of texts and the word cache.
    """
    own = ["token_ids", "n_tokens", "n_byte_tokens", "round_trip"]
    docs = docs.drop(*own)
    at = docs.columns.index("text")
    passed = [i for i in range(len(docs.columns)) if with_text or i != at]
    names = [docs.columns[i] for i in passed]

    def run(batches):
        pieces = load(vocabulary)
        with tidy():
            yield from encoded(pieces, batches)
            pieces.cache.clear()

    def encoded(pieces, batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(at))
            null = batch.column(at).is_null()
            for a, b in byte_runs(offsets):
                texts = [x or "" for x in batch.column(at)[a:b].to_pylist()]
                ids, counts = pieces.encode(texts)
                data, ends = pieces.decode(ids, counts)
                source, begins = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if len(data) == len(source) and np.array_equal(ends, begins) and np.array_equal(data, source):
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([np.array_equal(data[p:q], source[r:s]) for p, q, r, s in zip(ends[:-1], ends[1:], begins[:-1], begins[1:], strict=True)])
                token_ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()), mask=null[a:b])
                byte_count = np.bincount(np.repeat(np.arange(b - a), counts), pieces.is_byte[ids], b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in passed), token_ids, pa.array(counts), pa.array(byte_count), pa.array(same)], [*names, *own])

    schema = StructType([docs.schema.fields[i] for i in passed]).add("token_ids", ArrayType(IntegerType())).add("n_tokens", LongType()).add("n_byte_tokens", LongType()).add("round_trip", "boolean")
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``tokens`` (token_ids and any others) with ``text`` appended; null ids give null, no ids the empty text."""
    tokens = tokens.drop("text")
    names, at = tokens.columns, tokens.columns.index("token_ids")

    def run(batches):
        pieces = load(vocabulary)
        for batch in batches:
            column = batch.column(at)
            counts = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            data, ends = pieces.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            raw = data.tobytes()
            texts = [raw[a:b].decode(errors="replace") if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields]).add("text", "string"))


def digest(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_sha256, round_trip): ids joined by spaces under the hash."""
    text = F.array_join(F.coalesce("token_ids", F.array().cast("array<int>")), " ")
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "n_byte_tokens", F.sha2(text, 256).alias("ids_sha256"), "round_trip")
