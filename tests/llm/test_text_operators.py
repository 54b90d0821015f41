"""Operators on single texts: fertility, piece encoding, toxicity, token counts, chats, licences."""

import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skyweave.llm import chat_format, fertility, licenses, piece_viterbi, token_counts, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
TEXTS = [
    None, "", " ", "\n\n", "a", "one two three four five", "the same line\nthe same line\n  \nother", "x " * 3000, "nospace" * 3000,
    "naïve café 中文 \U0001f600 ▁ mark  two  spaces\ttab\r\n", "<|endoftext|> and <|im_end|> </s>", "  non breaking",
    " ".join(RNG.choice(["alpha", "beta", "gamma.", "delta,", "the"]) for _ in range(200)),
    "".join(RNG.choice("ab c\né中") for _ in range(20000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, i, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", 0, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, score string")


def empty(docs):
    return docs.where("doc_id < 0")


def base(text):
    """The base measures, plainly."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 800 else None
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered) if covered is not None else None


def test_fertility(docs):
    got = fertility.fertility(docs, PIECES).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = base(TEXTS[r["doc_id"]])
        have = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert have[:4] == want[:4] and want[4] in (None, have[4])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert fertility.fertility(empty(docs), PIECES).count() == 0


def test_fertility_of_several_vocabularies(docs, spark):
    multi = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    names = [PIECES, multi]
    rows = {(r["doc_id"], i): r for i, r in enumerate(fertility.fertility(docs, names).collect())}
    alone = fertility.fertility(docs, PIECES).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["band"]) for r in rows.values()) == sorted((r["doc_id"], r["n_tokens"], r["band"]) for r in alone)
    encode, is_byte = fertility._encoder(multi)
    for (doc, _), r in rows.items():
        ids = [i for own in encode([w.encode() for w in WORD.findall(TEXTS[doc] or "")]) for i in own]
        assert r["n_tokens_2"] == len(ids) and abs(r["byte_share_2"] - sum(is_byte[i] for i in ids) / max(len(ids), 1)) < 1e-12
        band = [fertility.BANDS[r["band"]][k] for k in range(2)]
        told = [(r[f"chars_per_token{e}"], r[f"byte_share{e}"], r[f"token_entropy{e}"]) for e in ("", "_2")]
        inside = all(b[0] <= c <= b[1] and s <= b[2] and b[3] <= h <= b[4] for b, (c, s, h) in zip(band, told, strict=True))
        assert r["kept"] == (not r["base_failed"] and inside)


def test_bands_are_those_of_good_texts(spark):
    rng = random.Random(3)
    words = ["river", "stone", "morning", "window", "quiet", "garden", "letter", "autumn", "table", "bread"]
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(90)) * (i % 2) for _ in range(80)), "en", 1 - i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    measured = fertility.measures(table, [PIECES])
    bands = fertility.fit_bands(measured, table.select("doc_id", "quality"), 1, tail=0.0, least=100)
    good = measured.where("doc_id % 2 = 0").agg(*(f(c) for c in ("chars_per_token0", "entropy0") for f in (F.min, F.max))).first()
    assert list(bands) == ["en"] and (bands["en"][0][0], bands["en"][0][1], bands["en"][0][3], bands["en"][0][4]) == tuple(good)
    kept = fertility.fertility(table, PIECES, bands | {"script:other": fertility.BANDS["script:other"]})
    assert kept.where("kept and doc_id % 2 = 1").count() == 0 and kept.where("kept").count() == 200


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
u AS (SELECT doc_id, count(*) AS n_dup_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS seen FROM n) WHERE seen > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), range(0, 3) t(j) WHERE n > 1 GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def test_base_measures_equal_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(tuple(r) for r in fertility.fertility(docs, PIECES).select(*columns).collect())
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert got == sorted(con.execute(BASE_SQL).fetchall()) and len(got) == 1000


def test_bands_part_good_from_bad(spark):
    rng = random.Random(5)
    parts = ["river", "stone", "morning", "window", "quiet", "garden", "letter", "autumn", "table", "bread"]
    words = [a + b for a in parts for b in ("", "s", "side", "work", "light", "house")] + parts

    def text(good):
        return " ".join(rng.choice(words) + ("" if good else str(rng.randrange(10**6))) for _ in range(80))

    rows = [(i, text(i % 4), "en" if i % 8 < 5 else "xx", int(i % 4 > 0)) for i in range(320)] + [(1000, text(True), None, None), (1001, text(True), "yy", 1), (1002, None, "en", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    measured = fertility.measures(table, [PIECES])
    bands = fertility.part_bands(measured, table.select("doc_id", "quality"), 1)
    assert set(bands) == {"en", "xx"}  # one good text makes no band
    each = {r["quality"]: r for r in measured.join(table.select("doc_id", "quality"), "doc_id").where("lang = 'en' and not base_failed").groupBy("quality").agg(F.min("chars_per_token0").alias("low"), F.max("chars_per_token0").alias("high")).collect()}
    assert each[0]["high"] < bands["en"][0][0] < each[1]["low"] and bands["en"][0][1:] == fertility.BANDS["script:latin"][0][1:]
    held_out = table.where("doc_id % 5 <> 0").select("doc_id", "quality")
    fitted = fertility.part_bands(measured, held_out, 1)
    wide = {name: ((low[0][0], 9.0, 1.0, 0.0, 99.0),) for name, low in fitted.items()} | {"script:other": fertility.BANDS["script:other"]}
    judged = fertility.fertility(table, PIECES, wide).join(table.select("doc_id", "quality"), "doc_id").where("doc_id % 5 = 0 and doc_id < 1000 and not base_failed")
    assert judged.where("kept <> (quality = 1)").count() == 0 and judged.count() > 50
    assert set(fertility.fertility(table, PIECES, labels=held_out).where("doc_id < 320").select("band").distinct().toPandas()["band"]) == {"en", "xx"}
    assert fertility.fertility(table, PIECES, labels=held_out.limit(0)).where("band = 'script:latin'").count() == 322


def test_scripts():
    import pyarrow as pa

    from skyweave.llm.text_kernel import texts_of

    texts = {"Plain text, élan": "latin", "текст здесь": "cyrillic", "κείμενο": "greek", "نص هنا": "arabic", "טקסט": "hebrew", "पाठ": "devanagari", "ข้อความ": "thai", "ひらがな漢": "kana", "글자": "hangul", "漢字文": "han", "123 ... !": "none", "": "none", "ტექსტი": "other"}
    got = fertility.scripts(*texts_of(pa.array(list(texts), pa.large_string())))
    assert [fertility._NAMES[k] for k in got] == list(texts.values())


def test_windows_of_many_words_stay_apart():
    ids = np.array([1, 2, 3, 1 << 21, 0, 3, 1, 2, 3, (1 << 21) + 1, 5], np.int64)
    keys = fertility._windows(ids)
    triples = [tuple(ids[i : i + 3]) for i in range(len(ids) - 2)]
    assert all((keys[i] == keys[j]) == (triples[i] == triples[j]) for i in range(len(keys)) for j in range(len(keys)))


def test_fertility_measures_match_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in fertility.fertility(docs, PIECES).collect():
        ids = [i for w in WORD.findall(TEXTS[r["doc_id"]] or "") for i in model.encode(w)]
        assert r["n_tokens"] == len(ids)
        share = np.unique(ids, return_counts=True)[1] / max(len(ids), 1)
        assert abs(r["token_entropy"] - float(-(share * np.log2(share)).sum())) < 1e-9
        assert abs(r["byte_share"] - sum(map(model.is_byte, ids)) / max(len(ids), 1)) < 1e-12


def test_token_counts(docs, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    for r in token_counts.count_tokens(docs, BYTES).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False)))
        assert r["over_limit"] == (r["n_tokens"] > 512)
    assert token_counts.count_tokens(empty(docs), BYTES).count() == 0


def test_unbroken_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = ["a" * 200_000, "".join(rng.choice("abcdefgh\u4e2d") for _ in range(150_000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(BYTES)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame, BYTES).collect()} == {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert all(r["round_trip"] for r in piece_viterbi.encode(frame, PIECES).collect())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"])
def test_cutting_changes_no_count(name):
    count, drop = token_counts.counter(public_tokenizers.path(name))
    for text in filter(None, TEXTS):
        for limit in (7, 50, 1000):
            cut = token_counts.pieces(text, limit, drop)
            assert sum(count(cut)) == count([text])[0], (text[:40], limit)


def viterbi(pieces, word):
    """The best segmentation of a word, position by position."""
    table = {k: (i, s) for k, i, s in zip(pieces.keys.tolist(), pieces.ids.tolist(), pieces.scores.tolist(), strict=True)}
    word = word.replace(" ", "▁")
    best = [(0.0, None, None)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - pieces.longest), end):
            key = int(pieces._hash(np.array([[ord(c) for c in word[start:end]]], np.uint64))[0])
            i, s = table.get(key, (None, pieces.unknown if end - start == 1 else -math.inf))
            if best[end] is None or best[start][0] + s > best[end][0]:
                best[end] = (best[start][0] + s, start, i)
    out, end = [], len(word)
    while end:
        _, start, i = best[end]
        out.append([i] if i is not None else pieces.byte_ids[list(word[start:end].encode())].tolist())
        end = start
    return [i for part in out[::-1] for i in part]


def test_viterbi_matches_a_plain_one():
    pieces = piece_viterbi.load(PIECES)
    words = [" the", " theatre", "ing", "   x", " café", "中文", " \U0001f600a", " ", " antidisestablishment", " A1b2"] + ["".join(RNG.choice(" abcdethingeré") for _ in range(RNG.randint(1, 14))) for _ in range(60)]
    words = [w for w in words if "▁" not in w.replace(" ", "▁").lstrip("▁")]
    for word, ids in zip(words, pieces.encode_words(words), strict=True):
        assert list(ids) == viterbi(pieces, word), word


def test_pieces_match_the_library():
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_viterbi.load(PIECES)
    texts = [t for t in TEXTS if t and "▁" not in t] + ["Elle des theatre  antidisestablishment", "a" * 500 + " " * 300 + "b--" * 200, "x= (y+1);\n\tfoo_bar"]
    texts += ["".join(RNG.choice("  abcdethingeré.,-'1\n中") for _ in range(RNG.randint(1, 300))) for _ in range(200)]
    ids, counts = pieces.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == model.encode(text), text[:40]


def test_pieces_round_trip(docs, spark):
    encoded = piece_viterbi.encode(docs.withColumn("token_ids", F.lit("clash")), PIECES)
    rows = encoded.collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == len(TEXTS) + 1
    assert {r["doc_id"]: r["token_ids"] for r in rows if r["doc_id"] < 2} == {0: None, 1: []}
    back = piece_viterbi.decode(encoded.select("doc_id", "token_ids"), PIECES)
    assert all(r["text"] == TEXTS[r["doc_id"]] for r in back.collect())
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in rows:  # the library reads the ids as the same text
        if r["token_ids"]:
            assert model.decode(r["token_ids"]) == TEXTS[r["doc_id"]]
    assert piece_viterbi.encode(empty(docs), PIECES).count() == 0
    assert piece_viterbi.digest(encoded).where("doc_id = 1").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_toxicity_learns(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abdeimnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 3 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["Scum,", "vequ" + rng.choice(words)])
        rows.append((i, " ".join(own), rng.choice(["en", "fr", None]), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"))
    scored = toxicity.score(table.withColumnRenamed("toxic", "label").withColumn("score", F.lit(1)), model).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    right = scored.agg(F.avg((F.col("predicted") == F.col("label")).cast("double")), F.count("*")).first()
    assert right[0] > 0.95 and right[1] > 100
    edge = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "... !!", "en"), (4, "scum " * 50000, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(edge, model).collect()}
    assert got[1] == got[2] == got[3] and all(0 <= s <= 1 for s in got.values()) and got[4] > 0.5
    assert toxicity.score(edge.limit(0), model).count() == 0
    none = toxicity.fit(table.limit(0).drop("toxic"), table.limit(0).select("doc_id", "toxic"))
    assert toxicity.score(edge, none).where("predicted = 1").count() == 0


def test_toxicity_scores_match_a_plain_convolution():
    import pyarrow as pa

    from skyweave.llm.text_kernel import texts_of

    settings = toxicity.Settings(bucket_bits=8, width=3, filters=2)
    rng, width_of = np.random.default_rng(2), np.repeat(settings.widths, settings.filters)
    reach = max(settings.widths)
    mask = np.arange(reach * settings.width)[:, None] < width_of[None] * settings.width
    model = toxicity.Model(settings, rng.standard_normal((256, 3)).astype(np.float32), (rng.standard_normal(mask.shape) * mask).astype(np.float32), rng.standard_normal(6).astype(np.float32), rng.standard_normal(7).astype(np.float32), np.array([0.7, 0.2]))
    texts = ["", "one", "one two", "A longer text, with; some words-and more words.", "x " * 40]
    ids, counts = toxicity.features(*texts_of(pa.array(texts, pa.large_string())), settings.bucket_bits)
    got, at = toxicity.scores(model, ids, counts), 0
    for k, n in enumerate(counts.tolist()):
        assert n == len(re.findall(r"[A-Za-z0-9]+", texts[k]))
        words = [sum(model.embedding[b] for b in ids[:, at + i]) for i in range(n)] + [np.zeros(3, np.float32)] * reach
        at += n
        top = []
        for f, width in enumerate(width_of.tolist()):
            acts = [sum(float(words[i + j] @ model.filters[j * 3 : j * 3 + 3, f]) for j in range(width)) for i in range(max(n, 1))]
            top.append(max(max(acts) + float(model.bias[f]), 0))
        z = float(np.dot(top, model.out[:-1]) + model.out[-1])
        assert abs(got[k] - 1 / (1 + math.exp(-(0.7 * z + 0.2)))) < 1e-5


def test_toxicity_ignores_held_out_labels(spark):
    table = spark.createDataFrame([(i, f"word{i % 7} text", "en", int(i % 7 == 0)) for i in range(300)], "doc_id long, text string, lang string, toxic int")
    flipped = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(t.drop("toxic"), t.select("doc_id", "toxic")) for t in (table, flipped))
    assert np.array_equal(a.embedding, b.embedding) and np.array_equal(a.scale, b.scale)


def test_toxicity_learns_from_every_labelled_row(spark):
    ids = spark.range(6000).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(F.xxhash64("id")).collect()
    rows = []
    for place, (i,) in enumerate(ids):  # one word marks the rows of least hash, others rows beyond any bounded sample of these
        bad = place % 2
        word = ("scum" if place < 4200 else "vermin") if bad else "kind"
        rows.append((i, f"some {word} words of text {i % 50}", "en", bad))
    rows += [(6000 + k, "plain words " * 10000 + f"ogre {k}", "fr", 1) for k in range(60)]  # over 100,000 characters
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    settings = toxicity.Settings(rows=700)
    shards, counts = toxicity.shard_rows(table.drop("toxic"), table.select("doc_id", "toxic"), settings)
    held = {r["doc_id"] for r in table.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()}
    got = [r["doc_id"] for r in shards.select(F.explode("rows").alias("r")).select("r.doc_id").collect()]
    assert sorted(got) == sorted(r[0] for r in rows if r[0] not in held) and sum(counts.values()) == len(got) and shards.count() > 4
    a, b = (toxicity.fit(t.drop("toxic"), table.select("doc_id", "toxic"), settings) for t in (table, table.repartition(7, "text")))
    assert np.array_equal(a.embedding, b.embedding) and np.array_equal(a.out, b.out) and np.array_equal(a.scale, b.scale) and a.thresholds == b.thresholds
    odd = spark.createDataFrame([(1, "some vermin words of text 3", "en"), (2, "some scum words of text 3", "en"), (3, "some kind words of text 3", "en"), (4, "plain words " * 10000 + "ogre 1", "fr")], "doc_id long, text string, lang string")
    assert [r["predicted"] for r in toxicity.score(odd, a).orderBy("doc_id").collect()] == [1, 1, 0, 1]


CHATS = [
    (1, 0, "system", "be\nbrief"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "user", "again \\<| \\\\ <\\|"), (1, 3, "assistant", "<|im_sep|>"), (1, 4, "assistant", None), (1, 5, None, "x"),
    (2, 0, "assistant", ""), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, None, "role\nwith <|im_start|>", "z"), (None, 0, "user", "lost"),
]


def test_chats(spark):
    frame = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn int, role string, text string, formatted string")
    chats = chat_format.format_chats(frame)
    got = {r["conv_id"]: r for r in chats.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    for conv, row in got.items():
        own = sorted((r for r in CHATS if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        pieces = re.split(r"<\|im_(?:start|sep|end)\|>", row["formatted"])
        under = [pieces[m["piece"]][m["start"] :][: m["length"]] for m in row["loss_mask"]]
        assert [t.replace("<\\|", "<|").replace("\\\\", "\\") for t in under] == [r[3] or "" for r in own if r[2] == "assistant"]
    assert got[1]["formatted"].count(chat_format.START) == 4 and got[1]["formatted"].count(chat_format.SEPARATOR) == 2
    digest = {r["conv_id"]: r for r in chat_format.digest(chats).collect()}
    spoken = "<|im_sep|>"
    assert digest[1]["loss_sha256"] == hashlib.sha256(spoken.encode()).hexdigest() and digest[1]["loss_chars"] == len(spoken)
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_time_of_a_chat_is_linear_in_its_turns(spark):
    took = {}
    for n in (4000, 16000):
        turn = F.col("id").cast("int")
        frame = spark.range(0, n, 1, 1).select(F.lit(1).alias("conv_id"), turn.alias("turn"), F.when(turn % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <|"), turn).alias("text"))
        for _ in range(2):
            began = time.perf_counter()
            row = chat_format.digest(chat_format.format_chats(frame)).first()
            took[n] = min(took.get(n, 1e9), time.perf_counter() - began)
        told = "".join(f"{'user' if k % 2 == 0 else 'assistant'}\ntext <|{k}\n" for k in range(n))
        spoken = "".join(f"text <|{k}" for k in range(1, n, 2))
        assert (row["n_turns"], row["turns_sha256"], row["loss_sha256"]) == (n, *(hashlib.sha256(t.encode()).hexdigest() for t in (told, spoken)))
    assert took[16000] < 4.5 * took[4000] + 1, took


def test_licenses_match_every_window(spark):
    settings = licenses.Settings()
    filler = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "Released under the MIT License.")]
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for cut in (0, 1, 3):
            rows.append((10 + 10 * k + cut, " ".join(filler[: 7 * cut] + words[: len(words) - cut] + filler[50 : 50 + 31 * cut])))
    rows.append((999, ("filler text " * 4000) + "licensed UNDER the apache-license version 2 0"))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["template"]): (r["license"], r["n_windows"], r["first_word"], round(r["containment"], 9)) for r in licenses.scan(docs).collect()}
    want = {}
    for doc, text in rows:
        words = licenses.words_of(text or "")
        for t, (name, template) in enumerate(licenses.TEMPLATES):
            own = licenses.words_of(template)
            n, shingles = len(own), {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            hits = []
            for start in range(0, max(len(words), 1), n):
                if start and start - n + 2 * n >= len(words):
                    break
                part = words[start : start + 2 * n]
                share = len({tuple(part[i : i + 5]) for i in range(len(part) - 4)} & shingles) / len(shingles)
                if share >= settings.least:
                    hits.append((start, share))
            if hits:
                want[doc, t] = (name, len(hits), hits[0][0], round(max(s for _, s in hits), 9))
    assert got == want and (2, 2) in got and any(k[0] == 999 for k in got)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_anchors_are_enough():
    settings = licenses.Settings()
    chosen = set(licenses.anchors(licenses.TEMPLATES, settings))
    for _, text in licenses.TEMPLATES:
        own = licenses.words_of(text)
        shingles = [own[i : i + 5] for i in range(len(own) - 4)]
        assert sum(not set(s) & chosen for s in shingles) < settings.least * len(shingles)


def test_sql_of_chats_and_licenses(spark):
    docs = [(1, "Licensed under CC BY-NC 4.0. and more words to follow here"), (2, "nothing")]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    want = con.execute(licenses.sql()).fetchall()
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, want)) == sorted(tuple(r) for r in got) and len(got) == 1
