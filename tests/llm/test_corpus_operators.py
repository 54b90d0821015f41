"""Operators over whole corpora: near-dedup, line dedup, mixing, vectors, and the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import chosen_path, line_dedup, mixing, nn_descent, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3)] + [(1000, 1000 + k) for k in range(1, 400)] + [(2000 + k, 2001 + k) for k in range(60)]
    got = {r["node"]: r["component"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long"), shared.Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert shared.connected_components(spark.createDataFrame([], "a long, b long"), shared.Scratch(spark, "t")).count() == 0


def test_restrict_keeps_all_wanted(spark):
    rows = spark.range(20000).withColumnRenamed("id", "k").withColumn("v", F.col("k"))
    wanted = spark.createDataFrame([(k,) for k in (3, 77, 19999, None)], "k long")
    kept, rest = shared.split_by(rows, "k", wanted)
    assert {3, 77, 19999} <= {r["k"] for r in kept.collect()} and kept.count() < 50 and kept.count() + rest.count() == 20000
    assert shared.restrict(rows, "k", wanted.limit(0)).count() == 0


def corpus():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    docs, n = [], 0
    passage = [rng.choice(words) for _ in range(120)]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((n, " ".join(own) if rng.random() < 0.5 else "\n ".join(own).upper()))
            n += 1
    for _ in range(40):  # a passage that many documents share
        docs.append((n, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(20, 60))])))
        n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "w " * 5000), (0, docs[0][1]), (0, docs[0][1])]
    return docs


@pytest.mark.parametrize("how", [{}, {"leaf": 8, "block": 6, "depth": 2}])
def test_near_duplicates(spark, how):
    docs = corpus()
    got = chosen_path.near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, component_id int, sketch string"), chosen_path.Settings(**how))
    sets = {i: shingle_set(t) for i, t in docs}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(ids, linked)
    rows = got.collect()
    assert len(rows) == len(docs) and len(linked) > 50
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert chosen_path.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_but_not_a_text(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = chosen_path.near_duplicates(spark.createDataFrame([(1, long), (1, "other words entirely here now"), (2, long + " tail")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (1, 1), (2, 1)]


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "A B c d e f"), (None, None)], "doc_id long, text string")
    rows = chosen_path.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"] or 0), r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (0, 0, True), (3, 3, True), (4, 3, False)]
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = nn_descent.near_vectors(vectors).collect()
    assert sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (3, 1, 3), (4, 1, 3)]
    mixed = mixing.mix(docs.withColumn("source", F.lit("s")))
    assert mixed.count() > 0


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = [rng.choice("abé ") for _ in range(rng.randint(20, 40))]
        b = list(a)
        for _ in range(rng.randint(0, threshold + 2)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abé ")] * rng.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where((F.levenshtein("a", "b") <= threshold) != line_dedup.within(F.split("a", ""), F.split("b", ""), threshold)).count() == 0


def lines_by_hand(docs, threshold, least=20):
    def close(a, b):
        if abs(len(a) - len(b)) > threshold:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1] <= threshold

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    first = {}
    for i, t in sorted((i, t) for i, t in docs if t is not None):
        for k, line in enumerate(t.split("\n")):
            if len(line.strip(" ")) >= least:
                first.setdefault(line, (i, k))
    lines = sorted(first)
    part = components(lines, [(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :] if close(a, b)])
    keep = {}
    for line in lines:
        keep[part[line]] = min(keep.get(part[line], (1 << 60, 0)), first[line])
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = None
        else:
            out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if len(x.strip(" ")) < least or keep[part[x]] == (i, k))
    return out


@pytest.mark.parametrize("threshold,crowd", [(1, 12), (2, 12), (1, 2), (2, 2)])
def test_line_dedup(spark, threshold, crowd):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcd efgé") for _ in range(rng.randint(15, 45))) for _ in range(25)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = [rng.choice("xyz")] * rng.randint(0, 1)
            own.append("".join(line))
        docs.append((i, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (104, "short"), (105, "z" * 30000), (106, "z" * 30000 + "y"), (107, base[0] + "\n" + base[0])]
    frame = spark.createDataFrame([(i, t, 7, "k") for i, t in docs], "doc_id long, text string, n_lines int, component string")
    got = line_dedup.dedup_lines(frame, line_dedup.Settings(threshold=threshold, crowd=crowd)).collect()
    want = lines_by_hand([d for d in docs if d[0] not in (105, 106)], threshold)
    want |= {105: "z" * 30000, 106: ""}
    assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(docs)
    assert all(r["n_lines"] == (0 if t is None else t.count("\n") + 1) for r in got for i, t in docs if i == r["doc_id"])
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, base[0]), (1, base[0]), (1, base[0])], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.dedup_lines(odd).collect()] == [base[0]] * 3


def target_by_hand(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target, left = 1.5 * sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left.remove(s)
    return target


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 400])), rng.choice(["b", "a", "é", "a", "a", None, "Z"])) for i in range(900)]
    rows += [(900, None, "a"), (901, "", "empty"), (5, rows[5][1], rows[5][2]), (5, "other text", "a")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, block string")
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = target_by_hand(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(0.01 * want[s], 3)
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["shards"]) for r in own)
    again = mixing.plan(docs.repartition(9)).collect()
    assert sorted((r["doc_id"], r["copy"], r["taken"], tuple(r["shards"])) for r in got) == sorted((r["doc_id"], r["copy"], r["taken"], tuple(r["shards"])) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r["shards"]) for r in got)
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_blocks_are_split_evenly(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    counts = [r["n"] for r in mixing.plan(docs).select(F.explode("shards").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 16 and max(counts) < 1.2 * min(counts)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 24))
    rows = [b for b in base]
    for k in range(8):  # neighbourhoods larger than a list holds
        rows += [base[k] + rng.standard_normal(24) * s for s in rng.uniform(0.05, 0.4, 60 if k == 0 else 6)]
    rows += [base[0]] * 20 + [base[1] * 3, base[2] * 1e-200]
    table = [(i, [float(v) for v in x], 0) for i, x in enumerate(rows)]
    n = len(table)
    table += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 24, 0), (n + 3, [float("nan")] * 24, 0), (n + 4, [None] + [1.0] * 23, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in nn_descent.near_vectors(frame, nn_descent.Settings(cell=64, leaf=32, wide=12)).collect()}
    x = np.array(rows)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    want = components(range(n), [(int(a), int(b)) for a, b in zip(*np.nonzero(link)) if a < b])
    assert len(got) == len(table) and link.sum() > 1000
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"]) == (int(link[i].sum()), want[i])
    assert [got[n + k]["n_links"] for k in range(7)] == [0, 0, 0, 0, 0, 1, 1]
    assert nn_descent.near_vectors(frame.limit(0)).count() == 0


def tight_groups(size):
    """Two groups whose members have a cosine of 0.99, and 0.96 with those of the other."""
    rng = np.random.default_rng(4)
    axes = np.linalg.qr(rng.standard_normal((2 * size + 3, 2 * size + 3)))[0]
    return [list(map(float, np.sqrt(0.96) * axes[0] + np.sqrt(0.03) * axes[1 + k // size] + np.sqrt(0.01) * axes[3 + k])) for k in range(2 * size)]


@pytest.mark.parametrize("how", [{}, {"cell": 64}, {"rounds": 0}])
def test_links_between_tight_groups(spark, how):
    rows = list(enumerate(tight_groups(100)))
    got = nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), nn_descent.Settings(**how)).collect()
    assert len(got) == 200 and all((r["n_links"], r["component_id"]) == (199, 0) for r in got)


def test_vectors_that_share_an_id(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(5, a), (5, b), (3, a + 0.01 * rng.standard_normal(16)), (9, b + 0.01 * rng.standard_normal(16))]
    got = nn_descent.near_vectors(spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(3, 1, 3), (5, 1, 3), (5, 1, 5), (9, 1, 5)]


def test_audit_tells_its_evidence(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(v) for v in rng.standard_normal(32)]) for k in range(3000)]
    own = np.array([x for _, x in rows])
    none = nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).first()
    assert none["recall"] is None and none["audited_links"] == 0
    # forty isolated links among them: the sample is drawn where links are
    rows += [(5000 + k, [float(v) for v in own[k] + 0.2 * rng.standard_normal(32)]) for k in range(40)]
    got = nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    told = got.first()
    assert told["recall"] == 1.0 and told["audited_links"] >= 60 and got.where("n_links > 0").count() == 80


def test_vectors_that_point_one_way_have_no_large_code(spark):
    rng = np.random.default_rng(2)
    n, settings = 20000, nn_descent.Settings(cell=256, leaf=96)
    x = np.sqrt(0.7) * np.eye(32)[0] + np.sqrt(0.3 / 31) * rng.standard_normal((n, 32))  # mean cosine 0.7
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = spark.createDataFrame([(k, 32, x[k].tobytes()) for k in range(n)], "id long, size int, short binary")
    scratch = shared.Scratch(spark, "t")
    sample = nn_descent._sample(vectors, settings)
    # no more than two cells a code, so no vector of a tree has more than two copies; first with few bits, so that codes must be cut
    for bits in (2, 9):
        coded = nn_descent._cut(nn_descent._codes(vectors, bits, 1, sample, settings), 1, scratch, settings)
        sizes = [r["n"] for r in coded.groupBy("tree", "code").agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == n * settings.trees and max(sizes) <= 2 * settings.cell
        assert coded.groupBy("tree", "id").agg(F.count("*").alias("n")).where("n <> 1").count() == 0


def test_lists_grow_while_they_are_full(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(24)
    rows = [(k, [float(v) for v in centre + 0.05 * rng.standard_normal(24)]) for k in range(150)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = []
    plain = nn_descent._lists

    def watched(edges, wide, settings):
        kept.append(wide)
        return plain(edges, wide, settings)

    nn_descent._lists = watched
    try:
        got = nn_descent.near_vectors(table, nn_descent.Settings(wide=12, widest=96)).collect()
    finally:
        nn_descent._lists = plain
    assert kept[:6] == [12, 12, 12, 24, 48, 96]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    assert [r["n_links"] for r in sorted(got)] == (link.sum(1) - 1).tolist()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert out.where("not round_trip").count() == 0 and out.count() > 50


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage by hand on what the one before kept; only the toxicity model and the draws of the mix are the operators' own."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from skyweave.llm import toxicity

    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90").collect()]
    base = [t for _, t, *_ in rows if t and len(t.split()) > 60]
    for k in range(12):  # near copies, and a line that many share but for a letter
        words = base[k % 3].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words), "en", f"s{k % 3}"))
        rows.append((2000 + k, f"own words {k} of this text\na line that many documents share, number {k % 2}\nand the end of {k}", "en", "s9"))
    rows += [(3000, None, "en", "s1"), (3001, "", None, None), (3002, "\n\n", "fr", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("toxic").collect()}
    kept = {i: (t, lang, source) for i, t, lang, source in rows if i not in toxic}

    def close(a, b):
        at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[at + 1 :] == b[at + 1 :] or a[at:] == b[at + 1 :] or a[at + 1 :] == b[at:]

    first = {}
    for i in sorted(kept):
        for k, line in enumerate((kept[i][0] or "").split("\n")):
            if len(line.strip(" ")) >= 20:
                first.setdefault(line, (i, k))
    lines = sorted(first)
    part = components(lines, [(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :] if abs(len(a) - len(b)) <= 1 and close(a, b)])
    stay = {}
    for line in lines:
        stay[part[line]] = min(stay.get(part[line], (1 << 60, 0)), first[line])
    cut = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if len(x.strip(" ")) < 20 or stay[part[x]] == (i, k)) for i, (t, *_) in kept.items()}

    sets = {i: shingle_set(t) for i, t in cut.items()}
    ids = sorted(cut)
    near = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    left = [(i, cut[i], *kept[i][1:], len(cut[i] or "")) for i in ids if near[i] == i]
    assert len(toxic) > 0 and len(left) < len(kept) and any(cut[i] != kept[i][0] for i in ids)

    want = {}
    for r in mixing.plan(spark.createDataFrame(left, docs.schema)).collect():
        want[r["doc_id"]] = len(r["shards"])
    sizes = {}
    for i, t, _, source, _ in left:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(t or ""))
    targets = target_by_hand(sizes)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, taken, texts = {}, {}, {i: t for i, t, *_ in left}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(texts[r["doc_id"]] or ""))
        assert r["round_trip"] and (r["token_ids"] or []) == library.encode(texts[r["doc_id"]] or "")
    assert got == {i: n for i, n in want.items() if n}
    largest = {s: max(len(WORD.findall(t or "")) for _, t, _, x, _ in left if x == s) for s in sizes}
    assert all(abs(taken.get(s, 0) - targets[s]) <= max(largest[s], 3) for s in sizes)


def test_registry(spark):
    from skyweave.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_links_of_texts_that_share_an_id(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])
    docs = [(5, "entirely different words in this text of id five"), (5, " ".join(words)), (3, near), (5, " ".join(words)), (9, near + " tail")]
    rows = chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(3, 3), (5, 3), (5, 3), (5, 5), (9, 3)]


@pytest.mark.parametrize("most", [2, 3])
def test_longer_lines_may_differ_more(spark, most):
    rng = random.Random(11)

    def changed(line, edits):
        own = list(line)
        for at in sorted(rng.sample(range(1, len(own) - 1), edits), reverse=True):
            own[at : at + rng.randint(0, 1)] = [rng.choice("XYZ")]
        return "".join(own)

    docs, want = [], []
    for n in (30, 127, 128, 191, 192, 500):
        allowed = min(max(n // 64, 1), most)
        for edits in (1, 2, 3, 4):
            line = "".join(rng.choice("abcdefgé ") for _ in range(n - 2))
            line, other = f"a{line}b", None
            while other is None or len(other) < n:  # the shorter line decides
                other = changed(line, edits)
            docs += [(len(docs), line), (len(docs) + 1, other)]
            want += [line, "" if edits <= allowed else other]
    crowd = ["".join(rng.choice("abcdefg ") for _ in range(80)) for _ in range(3)]
    for k in range(60):  # lines that share most of their segments, far from each other or near
        docs.append((len(docs), crowd[0] + crowd[1] + "".join(rng.choice("pqrst") for _ in range(20)) + crowd[2]))
        want.append(docs[-1][1])
        docs.append((len(docs), changed(docs[-1][1], most)))
        want.append("")
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), line_dedup.Settings(most=most, crowd=8)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == want


def test_quotas_go_down_the_tree(spark):
    quotas = {"a": 40, "b": 7, None: 1, "c": 0}
    frame = spark.createDataFrame(list(quotas.items()), "source string, n long")
    lefts = []
    for seed in range(12):
        rows = mixing.shard_quotas(frame, 3, mixing.Settings(seed=seed)).collect()
        for s, n in quotas.items():
            assert sum(r["n"] for r in rows if r["source"] == s) == n and all(r["n"] >= 0 for r in rows)
        sizes = [sum(r["n"] for r in rows if r["shard"] == k) for k in range(8)]
        assert sum(sizes) == 48 and set(sizes) == {6}
        lefts.append(sum(r["n"] for r in rows if r["source"] == "a" and r["shard"] < 4))
    assert 18 <= np.mean(lefts) <= 22 and len(set(lefts)) > 1  # a draw, not a rule
    assert mixing.shard_quotas(frame.limit(0), 3, mixing.Settings()).count() == 0


def test_mixing_takes_whole_blocks_in_order(spark):
    """The draw itself, by hand: permuted blocks until the target, the last one by documents, then the best filler."""
    rng = random.Random(21)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice("aaab")) for i in range(1500)]
    docs, settings = spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Settings(blocks=8, block_rows=100, levels=2)
    got = {r["doc_id"]: r for r in mixing.plan(docs, settings).collect()}
    n = {s: max(8, math.ceil(sum(r[2] == s for r in rows) / 100)) for s in "ab"}
    keyed = mixing.sized(docs, settings).withColumn("n", F.when(F.col("source") == "a", n["a"]).otherwise(n["b"])).withColumn("block", mixing._block(settings, "place", "n"))
    keyed = keyed.withColumn("order", F.xxhash64(F.lit(settings.seed), F.lit("order"), "source", "block")).collect()
    for s in "ab":
        own = [r for r in keyed if r["source"] == s]
        size, target = sum(r["size"] for r in own), got[own[0]["doc_id"]]["target"]
        passes = min(2, int(target // size))
        rest, again = target - passes * size, set()
        for _, block in sorted({(r["order"], r["block"]) for r in own}):
            for r in sorted((r for r in own if r["block"] == block), key=lambda r: (r["place"], r["doc_id"])):
                if rest - r["size"] < 0:
                    break
                rest -= r["size"]
                again.add(r["doc_id"])
            else:
                continue
            break
        left = [(abs(rest - r["size"]), r["place"], r["doc_id"]) for r in own if r["doc_id"] not in again and r["size"] > 0 and abs(rest - r["size"]) < rest]
        again |= {min(left)[2]} if left else set()
        zero = {r["doc_id"] for r in own if r["size"] == 0}
        assert {r["doc_id"] for r in own if got[r["doc_id"]]["taken"] > passes * r["size"]} == again - zero
        by_draw = {}
        for r in own:  # a draw of a block is in one shard
            for k, shard in enumerate(got[r["doc_id"]]["shards"][:passes]):
                assert by_draw.setdefault((r["block"], k), shard) == shard



def test_edits_grow_with_the_line_without_a_bound(spark):
    """All pairs by Spark's own distance, over lines up to 40 edits and families of near copies."""
    rng = random.Random(12)

    def changed(line, edits):
        own = list(line)
        for at in sorted(rng.sample(range(len(own)), edits), reverse=True):
            own[at : at + rng.randint(0, 1)] = [rng.choice("XYZ é")] * rng.randint(0, 2)
        return "".join(own)

    every = []
    for n in (20, 63, 64, 127, 128, 129, 190, 256, 300, 420, 600, 1000, 2600):
        line = "".join(rng.choice("abcdefgé ") for _ in range(n))
        every += [line, *(changed(line, max(1, min(n // 2, round(n / 64 * share)))) for share in (0.4, 0.7, 1, 1, 1.2, 2))]
    same = "".join(rng.choice("abcdefg ") for _ in range(140))
    every += [changed(same + "".join(rng.choice("pqrst") for _ in range(rng.randint(30, 200))), 1) for _ in range(40)]  # a passage that many have
    every += [changed(same * 2, rng.randint(1, 4)) for _ in range(40)] + ["ab" * 200 + "c" * k for k in range(9)]  # a family, and a line of one period
    rng.shuffle(every)
    lines = sorted(set(every))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    both = frame.join(frame.toDF("j", "y"), F.expr("i < j")).withColumn("t", F.greatest(F.lit(1), F.floor(F.least(F.length("x"), F.length("y")) / 64)))
    pairs = [(r["i"], r["j"]) for r in both.where(F.levenshtein("x", "y") <= F.col("t")).collect()]
    part = components(range(len(lines)), pairs)
    place = {x: k for k, x in enumerate(lines)}
    seen, want = set(), {}
    for d, x in enumerate(every):
        want[d] = "" if part[place[x]] in seen else x
        seen.add(part[place[x]])
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, line_dedup.Settings(most=None)).collect()}
    far = max(abs(len(lines[i]) - len(lines[j])) for i, j in pairs)
    assert got == want and len(pairs) > 100 and far > 4


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    a, b = (" ".join(f"{w}{k}" for k in range(40)) for w in "ab")
    near = a.replace("a20", "other")
    rows = [
        (7, a, "en", "s", 1), (7, a, "en", "s", 1), (8, b, "en", None, 2), (8, near, None, "t", 3), (9, near + " tail", "fr", "t", 4), (None, a, "en", "s", 5), (None, a, "en", "s", 5),
        (10, None, "en", "s", 6), (11, "", "en", "s", 7), (12, "short", "en", "s", 8), (13, "short", "xx", "s", 9),
    ]
    docs = spark.createDataFrame([(*r, 0.5, "mine") for r in rows], "doc_id long, text string, lang string, source string, n_lines int, Score double, toxic string")
    kept = stages["minhash_near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"] or -1), r["text"] or "") for r in kept.collect())
    assert left == sorted([(7, a), (8, b), (-1, a), (-1, a), (10, ""), (11, ""), (12, "short")])
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and {(r["Score"], r["toxic"]) for r in clean.collect()} == {(0.5, "mine")}
    lined = stages["line_dedup"](spark, docs, SF)
    assert lined.columns == docs.columns and lined.count() == len(rows) and sorted(r["n_lines"] for r in lined.collect()) == sorted(r[4] for r in rows)
    texts = {(r["doc_id"], r["text"]) for r in lined.collect()}
    assert {(7, a), (8, b), (8, near), (9, near + " tail"), (10, None), (11, ""), (12, "short"), (13, "short"), (None, a)} == texts  # a second copy of an id is the same document
    mixed = stages["mix_sources"](spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() > 0
    out = stages["sentencepiece"](spark, docs, SF)
    assert out.count() == len(rows) and out.where("not round_trip").count() == 0
