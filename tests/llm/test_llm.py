"""The training-data operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from placetrail.functions import ordered
from placetrail.llm import components, langid, lineage, mixing, neardup, nearvec, pieces, quality, repeats, sampling, topk, toxicity, unitcodes, wordpiece
from placetrail.llm.lineage import shared_folder
from tests.test_catalog import rows

SQL = ["op1_near_vectors", "op2_token_counts", "op5_near_duplicates", "op7_top_k", "op8_repeats", "op10_mix_sources"]
ODD = [(1, None, "en", "s1", 0), (2, "", "en", None, 0), (3, "Hello there", None, "s1", 5), (4, "Hello there", "en", "s1", 5), (4, "Hello there", "en", "s1", 5), (None, "x y z", "en", "s2", 5), (6, "a" * 30_000, "en", "s2", 5), (7, "é ß 日本 ▁ \t\n", "fr", "s2", 5)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, ties, repeated rows, a long text, and a column with a name of our own."""
    return spark.createDataFrame(ODD, DOCS).withColumns({"score": F.lit("mine"), "size": F.lit(1), "key": F.lit(2), "row": F.lit(3), "found": F.lit(4), "spans": F.lit(5), "out": F.lit(6)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, sf_dir, name):
    own = __spark_entry__.queries()[name](spark, sf_dir).toPandas()
    assert rows(own) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).fetchdf())


# 1 and 7: vectors

VECTORS = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0]), (9, [])]


def test_near_vectors_edges(spark):
    got = {r.vec_id: r for r in nearvec.near_duplicate_vectors(spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 10 and [got[i].n_links for i in (0, 1, 2, 8)] == [3, 3, 3, 3] and {got[i].component_id for i in (0, 1, 2, 8)} == {0}
    assert all(got[i].n_links == 0 and got[i].kept for i in (3, 4, 5, 6, 7, 9))
    assert nearvec.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_in_small_intervals(spark, monkeypatch):
    monkeypatch.setattr(nearvec, "INTERVAL", 16)
    monkeypatch.setattr(nearvec, "LEAF", 4)
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(12, 6)), 10, axis=0) + rng.normal(scale=0.12, size=(120, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(120, dtype=bool)
    label = np.arange(120)
    for _ in range(120):
        label = np.minimum(label, np.where(links, label, 999).min(1))
    got = nearvec.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(links[i].sum()), int(label[i])) for i in range(120)}


def test_near_vectors_of_one_id_are_one_node(spark):
    rows = [(3, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [0.0, 1.0]), (9, [0.0, 1.0]), (4, None), (5, [-1.0, 0.0])]
    got = nearvec.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter((r.vec_id, r.component_id, r.kept) for r in got) == {(3, 3, True): 1, (4, 3, False): 3, (9, 3, False): 1, (5, 5, True): 1}
    hot = nearvec.near_duplicate_vectors(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in hot} == {(199, 0)} and len(hot) == 200


@pytest.mark.parametrize("rounds", [(1, 8, 64, None), (1, 2, None)])
def test_top_k_against_all_products(spark, rounds, monkeypatch):
    monkeypatch.setattr(topk, "ROUNDS", rounds)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 6)), 10, axis=0) + rng.normal(scale=0.2, size=(300, 6))
    grid = np.floor(x * 1024).astype(np.int64)
    ids = [7 if i in (8, 9) else i for i in range(300)]  # a vec_id that repeats
    frame = topk.to_grid(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"))
    got = topk.nearest_neighbours(frame.filter("vec_id % 50 = 0"), frame, 10).collect()
    want = set()
    for q in range(0, 300, 50):
        order = sorted((-int(grid[q] @ grid[j]), ids[j]) for j in range(300) if ids[j] != q)[:10]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(order, 1)}
    assert {tuple(r) for r in got} == want and len(got) == 60


def test_top_k_edges(spark):
    v = spark.createDataFrame([(i, x) for i, x in VECTORS], "vec_id long, embedding array<double>")
    grid = topk.to_grid(v)
    got = topk.nearest_neighbours(grid.filter("vec_id = 0"), grid, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2 * 1024 * 1024), (2, 1024 * 1024), (8, 1024 * 1024)]
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk.nearest_neighbours(empty, empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (100, 100)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert set(got.values()) == {0, 99} and got[40] == 0 and got[100] == 99


# 2 and 6: tokens


def test_longest_match_equals_greedy():
    vocabulary = wordpiece.read_vocabulary()
    auto, have, most = wordpiece.build_automaton(vocabulary), set(vocabulary), max(map(len, vocabulary))

    def greedy(word: bytes, have=have, most=most) -> int:
        text, n = b" " + word, 0
        while text:
            size = next((k for k in range(min(len(text), most), 0, -1) if text[:k] in have), None)
            if size is None:
                return 1
            text, n = text[size:], n + 1
        return n

    words = [b"unbelievably", b"abc\xff" * 40, "größe".encode(), b"", b"a" * 500, b"x1y2"]
    for word in words:
        data = np.frombuffer(word, np.uint8)
        assert wordpiece.count_pieces(auto, data, np.array([0]), np.array([len(word)]))[0] == greedy(word)
    small = [b" ab", b" a", b"b", b"cd", b" abcdx", b"c"]
    auto = wordpiece.build_automaton(small)
    for word in (b"abcd", b"abcdx", b"abc", b"q", b"a", b"abcdxcd", b"abcq", b""):
        data = np.frombuffer(word, np.uint8)
        assert wordpiece.count_pieces(auto, data, np.array([0]), np.array([len(word)]))[0] == greedy(word, set(small), 6)


@pytest.mark.parametrize("together", [64, 3])
def test_longest_match_pops_many_pieces_at_once(together, monkeypatch):
    monkeypatch.setattr(wordpiece, "TOGETHER", together)
    auto = wordpiece.build_automaton([b" ", b"a", b"b", b"a" * 300 + b"c"])
    for word, want in ((b"a" * 299 + b"b", 301), (b"a" * 300 + b"b", 302), (b"a" * 300 + b"c", 2), (b"a" * 600, 601), (b"ab", 3)):
        assert wordpiece.count_pieces(auto, np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0] == want


def test_token_counts_edges(odd, none):
    vocabulary = wordpiece.read_vocabulary()
    got = wordpiece.token_counts(odd, vocabulary)
    assert set(odd.columns) <= set(got.columns)
    assert [(r.n_words, r.n_tokens > 0) for r in got.orderBy("doc_id").collect()][1:3] == [(0, False), (0, False)]
    assert wordpiece.token_counts(none, vocabulary).count() == 0


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_pieces(spark, odd, none, frequent, monkeypatch, sf_dir):
    monkeypatch.setattr(unitcodes, "FREQUENT", frequent)
    model = pieces.read_model()
    texts = odd.select("doc_id", "text", "score").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("x").alias("score")))
    counts, codes = pieces.encode_documents(texts, model)
    want = Counter((r.doc_id, len(pieces.viterbi(model, b" " + r.text.encode())) if r.text else 0) for r in texts.collect())
    assert Counter((r.doc_id, r.n_pieces) for r in counts.collect()) == want
    assert counts.filter("not round_trip").count() == 0
    for r in codes.limit(200).collect():
        assert r.ids == pieces.viterbi(model, r.unit.encode()) and pieces.decode_ids(model, r.ids).decode() == r.unit
    assert pieces.encode_documents(none, model)[0].count() == 0


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_pieces_of_long_units_and_documents(spark, none, frequent, monkeypatch):
    monkeypatch.setattr(unitcodes, "FREQUENT", frequent)
    model = pieces.read_model()
    rng = np.random.default_rng(1)
    junk = ["".join(rng.choice(list("abcdeéß日▁/._-=")) for _ in range(n)) for n in (63, 64, 65, 127, 128, 129, 191, 192, 193, 700)]
    texts = [None, "", " ", "a" * 30_000, "ab" * 501, "日" * 300, "https://example.org/" + "abcdefgh" * 40 + "?q=1", "one two one two", *junk, junk[-1] + " one " + junk[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded, codes = pieces.encode_documents(docs, model)
    got = {r.doc_id: r for r in encoded.collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == (pieces.viterbi(model, b" " + text.encode()) if text else []) and got[i].n_pieces == len(got[i].ids)
        assert got[i].decoded == text and got[i].round_trip
    units = {r.unit: r.ids for r in codes.collect()}
    assert " " + "a" * 30_000 in units or any(len(u) > 20_000 for u in units)
    assert all(ids == pieces.viterbi(model, unit.encode()) for unit, ids in units.items())
    assert {r.doc_id: r.text for r in pieces.decode(encoded.filter("n_pieces between 1 and 1000"), model, ["doc_id"]).collect()} == {i: " " + t for i, t in enumerate(texts) if t and got[i].n_pieces <= 1000}
    assert pieces.encode_documents(none, model)[0].count() == 0


def test_piece_query_against_an_uncut_lattice(spark, sf_dir):
    """Every whole text as one lattice over all pieces: the best score that any chain of pieces has."""
    model, documents = pieces.read_model(), duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in __spark_entry__.queries()["op6_sentence_pieces"](spark, sf_dir).collect()}
    names, most = {p.decode(): model.scores[i] for p, i in model.ids.items()}, max(map(len, model.ids))
    assert len(got) == len(documents)
    for doc_id, text in documents[:60]:
        spaced, best = " " + text, [0.0]
        for end in range(1, len(spaced) + 1):
            ways = [best[start] + names[spaced[start:end]] for start in range(max(0, end - most), end) if spaced[start:end] in names]
            best.append(max([*ways, best[-1] + model.fallback]))
        r = got[doc_id]
        spelled = [model.spelled[i] for i in r.ids]
        bytes_ = len([i for i in r.ids if i in set(model.byte_ids)])
        assert b"".join(spelled) == spaced.encode() and r.decoded == text and r.round_trip and r.n_pieces == len(r.ids)
        assert bytes_ or sum(model.scores[i] for i in r.ids) == pytest.approx(best[-1])
    assert pieces.make_model({b"a": 0, b"b": 1, b"ab": 2}, {0: -1.0, 1: -1.0, 2: -5.0}, [0] * 256).useful.keys() == {"a", "b"}


# 3, 4 and 9: classifiers


def folds(doc_ids, mod):
    return np.array([zlib.crc32(str(i).encode()) % mod for i in doc_ids])


@pytest.fixture(scope="module")
def labelled():
    return duckdb.sql("SELECT doc_id, text, lang, quality, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchdf()


def test_toxicity_held_out(labelled):
    held = folds(labelled.doc_id, 5) == 0
    train = labelled[~held].reset_index(drop=True)
    y, rows = labelled.toxic[held].to_numpy(), toxicity._rows_of(labelled.text[held])
    model = toxicity.fit_cnn(train.text, train.toxic.to_numpy(), train.lang)
    got = toxicity.scores(model, *rows) >= 0.5
    assert got[y == 1].mean() > 0.9 and got[y == 0].mean() < 0.03
    # Nothing but training tells the labels apart: the start ranks them as chance does.
    at_start = toxicity.logits(toxicity.fit_cnn(train.text, train.toxic.to_numpy(), train.lang, steps=0), *rows)
    assert 0.35 < (at_start[y == 1][:, None] > at_start[y == 0]).mean() < 0.65


def test_toxicity_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 50)
    model = toxicity._start(np.random.default_rng(0))
    model.embedding, model.out, model.filters = model.embedding.astype(float), model.out.astype(float), [f.astype(float) for f in model.filters]
    rows, first = toxicity._rows_of(["one two three four", "", "five six", "one"])
    y = np.array([1.0, 0.0, 0.0, 1.0])
    g = toxicity.gradients(model, rows, first, y)
    whole = np.zeros(model.embedding.shape)
    whole[g.rows] = g.embedding
    for values, gradient in ((model.embedding, whole), (model.out, g.out), *zip(model.filters, g.filters, strict=True)):
        for at in list(np.ndindex(values.shape))[::3]:
            kept, losses = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = kept + step
                losses.append(toxicity.gradients(model, rows, first, y).loss)
            values[at] = kept
            assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(gradient[at], abs=1e-6)


def test_toxicity_query_against_plain_convolution(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in __spark_entry__.queries()["op3_toxicity"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        rows, _ = toxicity._rows_of([text or ""])
        vectors = [np.concatenate([model.embedding[a], model.embedding[b]]) for a, b in rows.tolist()]
        z = model.bias
        for k, width in enumerate(toxicity.WIDTHS):
            padded = [*vectors, *[np.zeros(toxicity.DIMS)] * width]
            maps = [np.concatenate(padded[i : i + width]) @ model.filters[k] + model.biases[k] for i in range(len(vectors))]
            z += np.maximum(np.max(maps, axis=0), 0) @ model.out[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS] if maps else 0.0
        language = int(sum(model.language[a] for a, _ in rows.tolist()).argmax()) if len(rows) else 0
        r = got[doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-(z - model.thresholds[language]))), abs=1e-4)
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_quality_held_out(labelled):
    held = folds(labelled.doc_id, 4) == 2
    train = labelled[~held]
    model = quality.fit_ranking(quality._features_of(train.text.tolist()), train.quality.to_numpy(), float((train.quality == 0).mean()))
    got = model.score(quality._features_of(labelled.text[held].tolist())) >= quality.CUT
    assert (got == labelled.quality[held].to_numpy()).mean() > 0.97


def test_near_duplicates_leave_what_is_read_alone(spark):
    """Buckets, sets and links stayed on disk until the end of the session."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[: 200 + (i % 3 == 0)] if i < 30 else [f"d{i}w{j}" for j in range(60)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    found = neardup.near_duplicates(docs)
    assert len(set(os.listdir(folder)) - before) <= 6
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: 0 if i < 30 else i for i in range(60)}


def test_quality_learns_from_every_labelled_row(spark):
    """All bad texts are long, and most good ones too: a sample of short texts held no bad one."""
    text = lambda i, bad: ("@# $ %^ " if bad else "Some good words, in a row. ") * (4000 if bad or i % 5 else 3)
    rows = [(i, text(i, i % 3 == 0), int(i % 3 > 0)) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert got == {r[0]: r[2] for r in rows}
    total = quality.training_rows(docs, labels, 4, 2).groupBy("label").count().collect()
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert {r.label: r["count"] for r in total} == {k: sum(r[2] == k for r in kept) for k in (0, 1)}


def test_quality_cut_is_the_widest_gap_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr(quality, "CELLS", 8)
    values = np.concatenate([np.linspace(0, 1, 300), np.linspace(1.05, 2, 700), [1e6]])
    scored = spark.createDataFrame([(float(v),) for v in values], "value double").repartition(3)
    assert quality._cut_of(scored, 0.3) == pytest.approx(1.025)


def test_quality_query_against_plain_features(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in __spark_entry__.queries()["op4_quality"](spark, sf_dir).collect()}
    for row in docs.collect():
        raw = (row.text or "").encode()
        kinds = [("A", "Z"), ("a", "z"), ("0", "9")]
        counts = [0] * quality.N_CLASSES
        for b in raw:
            k = next((i for i, (x, y) in enumerate(kinds, 1) if ord(x) <= b <= ord(y)), None)
            k = k or (4 if b in b"\t\n\x0b\x0c\r " else 5 if b >= 128 else 6 + quality._MARKS.index(b) if b in quality._MARKS else 0)
            counts[k] += 1
        share = [c / max(1, len(raw)) for c in counts]
        words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), [x for x in raw.split(b"\n") if x]
        sizes, n, m = [len(w) for w in words], max(1, len(words)), max(1, len(lines))
        mean = sum(sizes) / n
        spread = math.sqrt(max(0.0, sum(x * x for x in sizes) / n - mean**2))
        more = [math.log1p(len(words)), mean, spread, len(set(words)) / n, len(set(lines)) / m, math.log1p(len(words) / m), sum(65 <= w[0] <= 90 for w in words) / n]
        z = model.scale * (sum(a * b for a, b in zip([*share, *map(math.sqrt, share), *more], model.weights, strict=True)) - model.cut)
        r = got[row.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(40, max(-40, z + math.log(quality.CUT / (1 - quality.CUT)))))), abs=1e-6)
        assert r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
    assert len(got) == docs.count()


def test_language_gradients_and_posteriors_against_all_paths():
    rng = np.random.default_rng(0)
    emission, labels, moves, start = rng.normal(size=(2, 4, 3)), rng.integers(0, 3, (2, 4)), rng.normal(size=(3, 3)), rng.normal(size=3)
    paths = list(itertools.product(range(3), repeat=4))
    worth = lambda b, p: start[p[0]] + sum(emission[b, t, p[t]] for t in range(4)) + sum(moves[p[t], p[t + 1]] for t in range(3))
    likelihood = lambda: sum(worth(b, labels[b]) - np.log(sum(np.exp(worth(b, p)) for p in paths)) for b in range(2))
    g = langid.gradients(emission, labels, moves, start)
    assert g.likelihood == pytest.approx(likelihood())
    for values, gradient in ((emission, g.emission), (moves, g.transitions), (start, g.start)):
        for at in np.ndindex(values.shape):
            kept, found = values[at], []
            for step in (1e-5, -1e-5):
                values[at] = kept + step
                found.append(likelihood())
            values[at] = kept
            assert (found[0] - found[1]) / 2e-5 == pytest.approx(gradient[at], abs=1e-7)
    # Ragged texts at once: the second one has three words.
    model = langid.Crf(["a", "b", "c"], None, None, moves, start)
    post = langid.posteriors(np.concatenate((emission[0], emission[1][:3])), np.array([0, 4, 7]), model)
    for b, n in ((0, 4), (1, 3)):
        weight = Counter()
        for p in itertools.product(range(3), repeat=n):
            w = np.exp(start[p[0]] + sum(emission[b, t, p[t]] for t in range(n)) + sum(moves[p[t], p[t + 1]] for t in range(n - 1)))
            for t in range(n):
                weight[t, p[t]] += w
        want = np.array([[weight[t, k] for k in range(3)] for t in range(n)])
        assert np.allclose(post[4 * b : 4 * b + n], want / want.sum(1, keepdims=True))


def test_language_query_against_plain_forward_backward(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    got = {r.doc_id: r for r in __spark_entry__.queries()["op9_language_id"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in list(texts.items())[:80]:
        score = []
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
            low, starts, ends, _ = langid.words_of(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
            small = bytes(low[:-1])
            pairs = zip(b"\0" + small, small + b"\0", strict=True)
            score.append(model.weights[langid.word_slots(low, starts, ends, len(model.weights))[0]].sum(0) + sum(model.bigrams[a << 8 | b] for a, b in pairs))
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        if not score:
            assert r.lang_pred == "und"
            continue
        forward, backward = [model.start + score[0]], [np.zeros(len(model.languages))]
        for s in score[1:]:
            forward.append(np.logaddexp.reduce(forward[-1][:, None] + model.transitions, axis=0) + s)
        for s in score[:0:-1]:
            backward.append(np.logaddexp.reduce(model.transitions + backward[-1] + s, axis=1))
        both = np.array(forward) + np.array(backward[::-1])
        mean = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]).mean(0)
        assert r.lang_pred == model.languages[mean.argmax()] and r.score == pytest.approx(mean.max(), abs=1e-3)


def test_samples_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same"), *[(2, f"text {i}") for i in range(40)]] + [(1, "same")] * 39, "doc_id long, text string")
    keys = docs.select("doc_id", F.lit("x").alias("label")).unionByName(docs.select("doc_id", F.lit("y").alias("label")))
    got = sampling.labelled_sample(docs, keys, "label", 1000, 100, 1)
    assert [tuple(r) for r in got[["doc_id", "label", "text"]].itertuples(index=False)] == [(1, "x", "same"), (2, "x", "text 0")]


def test_language_held_out(labelled):
    held = folds(labelled.doc_id, 4) == 2
    model = langid.fit_crf(labelled[~held].head(900))
    words = [langid.label_words(t, model) for t in labelled.text[held].head(200)]
    best = [Counter(x for _, x in w).most_common(1)[0][0] if w else "und" for w in words]
    assert np.mean(np.array(best) == labelled.lang[held].head(200).to_numpy()) > 0.97
    mixed = " ".join(labelled.text[labelled.lang == "en"].iloc[0].split()[:30] + labelled.text[labelled.lang == "de"].iloc[0].split()[:30])
    found = [x for _, x in langid.label_words(mixed, model)]
    assert found[:20].count("en") > 15 and found[-20:].count("de") > 15


def test_classifiers_edges(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for got in (langid.identify(odd, langid.train(odd)), toxicity.score(odd, toxicity.train(odd, labels)), quality.score(odd, quality.train(odd, labels))):
        scores = [r.score for r in got.collect()]
        assert len(scores) == 8 and all(0 <= s <= 1 for s in scores)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.train(odd)).collect()}
    assert got[1] == got[2] == "und"
    assert langid.identify(none, langid.train(none)).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


# 5: near duplicates


def plain_groups(texts: dict[int, str]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if label[b] < label[a] and shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_with_chains_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = rng.choice([f"w{i}" for i in range(500)], 120).tolist()
    texts = {}
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 9))):
            words[at] = f"n{rng.integers(0, 10**6)}"
        texts[i] = " ".join(words)
    texts |= {100: texts[0].upper(), 101: "one two", 102: "ONE two", 103: "", 104: "a b c d e", 105: "a b c d f"}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_groups(texts)


def test_near_duplicates_of_one_id_are_one_node(spark):
    a, b = "one two three four five six", "completely other words are written here"
    rows = [(3, a), (4, a), (4, b), (9, b), (4, ""), (7, ""), *[(i, "") for i in range(100, 300)]]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id < 100) == {(3, 3, True): 1, (4, 3, False): 3, (9, 3, False): 1, (7, 7, True): 1}
    assert sum(r.kept for r in got) == 202 and len(got) == len(rows)


def test_near_duplicates_at_the_threshold(spark):
    """Pairs with 75 and 74 of 100 shingles in common, on both sides of the limit, and signatures in the guaranteed distance."""
    assert neardup.MOST_DIFFERENT <= 2 * neardup.CHUNKS - 1
    texts = {}
    for i in range(200):
        words = [f"w{i}x{k}" for k in range(104 if i % 2 else 101)]
        shared = 79 if i % 4 < 2 else 78
        texts[2 * i] = " ".join(words[:shared] + [f"a{i}y{k}" for k in range(10)])
        texts[2 * i + 1] = " ".join(words[:shared] + [f"b{i}z{k}" for k in range(15)])
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    component = {r.doc_id: r.component_id for r in got}
    for i in range(200):
        linked = {k: plain_groups({k: texts[k] for k in (2 * i, 2 * i + 1)})[k][1] for k in (2 * i, 2 * i + 1)}
        assert {k: component[k] for k in linked} == linked


def test_near_duplicates_edges(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 8 and {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id in (1, 2, 3, 4)} == {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)}
    assert neardup.near_duplicates(none).count() == 0


# 8: repeated strings


def plain_removal(texts: list[str | None], length: int = 200) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        out.append((len(t), int(mask.sum()), len(repeats._runs(mask)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 3])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(1)
    vocabulary = ["the", "of", "é", "ßer", *["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    shared, other = prose(70), prose(200)
    texts = [prose(int(rng.integers(1, 120))) + (shared[int(rng.integers(0, 60)) :] + prose(20) if i % 2 == 0 else "") + (other[: int(rng.integers(150, 900))] if i % 5 == 0 else "") for i in range(40)]
    texts += [texts[3], texts[2] + "x", None, "", "a" * 700, "ab" * 300, prose(5)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))
    got = repeats.remove_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).orderBy("doc_id").collect()
    assert [tuple(r[1:]) for r in got] == plain_removal(texts)


def test_repeats_of_equal_rows_and_of_one_byte(spark):
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(100))
    rows = [(1, text)] * 200 + [(2, "-" * 20_000), (3, "ab" * 3000), (4, text[:150])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame).collect())
    assert got == {(1, len(text), 1): 200, (2, 20_000, 1): 1, (3, 6000, 1): 1, (4, 0, 0): 1}
    data = np.frombuffer(b"-" * 5000 + b"ab" * 2000, np.uint8)
    found = repeats.fragments(data, np.array([0, 5000, 9000]))
    assert len(found["start"]) < 300 and (found["windows"] * found["times"]).sum() == 9000 - 2 * 199


@pytest.mark.parametrize("hot", [2048, 3])
def test_repeats_are_found_before_texts_are_dealt_out(spark, hot, monkeypatch):
    """The search leaves its result alone in the shared folder, and the job that reads it next to the texts does not search again."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(9)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))
    texts = [f"{i} " * (i % 7) + passage[i % 11 :] + f" {i * 7919}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = lineage.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    spans = repeats.repeated_spans(docs.select(repeats.row_key("doc_id", "text").alias("key"), "text"))
    assert set(os.listdir(folder)) - before == {os.path.basename(spans.cut_path)} and spans.count() >= 40
    plan = repeats.remove_repeats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapGroupsInArrow" not in plan and "MapInArrow" not in plan


def test_repeats_edges(odd, none):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == 8 and {r.n_removed for r in got if r.doc_id == 6} == {30_000}
    assert repeats.remove_repeats(none).count() == 0


# 10: mixing


def test_mixing_edges(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 8 and all(r.taken <= 3 * r.size for r in got) and sum(r.size for r in got if r.doc_id == 1) == 0
    assert mixing.mix_sources(none).count() == 0
    repeated = mixing.repeat_documents(odd)
    assert repeated.columns == odd.columns


def test_mixing_takes_equal_rows_alike(spark):
    rows = [(1, "a b c", "s"), *[(2, "a b c d", "s")] * 5, *[(None, "a b", "s")] * 40, *[(i, "x " * (i % 7 + 1), "t") for i in range(10, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    taken = {}
    for r in got:
        assert taken.setdefault((r.doc_id, r.source, r.size), r.copies) == r.copies
    assert mixing.repeat_documents(docs).count() == sum(r.copies for r in got) and len(got) == len(rows)


def test_mixing_with_as_many_sources_as_documents(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", 7)
    monkeypatch.setattr(ordered.running_sums, "__defaults__", (7,))
    docs = spark.createDataFrame([(i, "x " * (i % 5 + 1), None if i == 3 else f"s{i}") for i in range(60)], "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    own = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert rows(own) == rows(con.execute(mixing.ORACLE_SQL).fetchdf())


def test_water_levels(spark):
    sources = spark.createDataFrame([("a", 100, 1), ("b", 10, 2), ("c", 1000, 3)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.water_levels(sources).collect()}
    assert got["b"] == 30 and got["a"] == pytest.approx(270) and got["c"] == pytest.approx(810)


# Pipeline


def test_pipeline(spark, sf_dir, none, odd):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for name, stage in cp.STAGES[:-1]:
        before = docs.count()
        docs = cp.cut(stage(spark, docs, sf_dir))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() <= 3 * before
    last = cp.STAGES[-1][1](spark, docs, sf_dir)
    model = pieces.read_model()
    want = Counter((r.doc_id, len(pieces.viterbi(model, b" " + r.text.encode()))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_pieces) for r in last.collect()) == want and last.filter("not round_trip").count() == 0
    for frame in (none, odd):
        for name, stage in cp.STAGES:
            got = stage(spark, frame, sf_dir)
            assert name == "sentence_pieces" or got.columns == frame.columns
            got.count()


def test_pipeline_run_against_plain_stages(spark, tmp_path):
    """run() on planted copies, near copies, shared passages and rejected documents, each stage against its plain version."""
    import corpus_pipeline as cp

    source = duckdb.sql("SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id LIMIT 40").fetchall()
    texts = [list(r) for r in source]
    passage = " ".join(f"word{i}" for i in range(80))
    for i in (3, 11, 17):
        texts[i][1] += " " + passage
    new = [[1000, texts[5][1], "en", "s9", 1], [1001, texts[6][1] + " ending", "en", "s9", 1], [1002, None, "en", "s9", 0], [1003, "12 34", "en", "s9", 5], [1004, "", "en", None, 0]]
    spark.createDataFrame([tuple(r) for r in texts + new], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.decoded, r.n_pieces) for r in cp.run(spark, str(tmp_path)).collect())

    docs = {r[0]: r[1] for r in texts + new if r[1] and re.search(r"[^\W\d_]", r[1])}  # every text with a letter is clear enough
    groups = plain_groups(docs)
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    assert 1000 not in docs and 1001 not in docs
    kept, raw = {}, [(t or "").encode() for t in docs.values()]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for doc_id, t in zip(docs, raw, strict=True):
        hit = {i + j for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for j in range(200)}
        kept[doc_id] = bytes(b for i, b in enumerate(t) if i not in hit).decode("utf-8", "ignore")
    kept = {i: t for i, t in kept.items() if t}
    assert all(passage not in t for t in kept.values())
    con, sources = duckdb.connect(), {r[0]: r[3] for r in texts + new}
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, sources[i]) for i, t in kept.items()])
    copies = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL}) WHERE size > 0").fetchall()}
    model = pieces.read_model()
    want = Counter({(i, t, len(pieces.viterbi(model, b" " + t.encode()))): copies[i] for i, t in kept.items() if copies.get(i)})
    assert got == want
