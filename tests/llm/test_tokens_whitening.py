"""Byte-level BPE, alignment of tokenizers and whitening against the tokenizers' own libraries and plain linear algebra."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from placetrail.llm import alignment, bytepairs, whitening
from placetrail.llm.textops import text_blocks

P = pytest.importorskip("public_tokenizers")
ODD = [(1, None), (2, ""), (3, "Hello there"), (4, "Hello there"), (4, "Hello there"), (None, "x y z"), (6, "a" * 30_000), (7, "é ß 日本 ▁ \t\n"), (8, "<|endoftext|> it's  'tis\n\n  \t\tdon't 12³ ''s"), (9, " "), (10, "😀é  　x"), (11, "\x00 \x07")]
CLASHING = ("ids", "decoded", "n_bytes", "row", "held", "n_a", "unit", "packed")


def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string")
    return frame.withColumns({c: F.lit(f"mine {c}") for c in CLASHING}).withColumn("map", F.create_map(F.lit("k"), F.lit(1)))


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


# 11


@pytest.fixture(scope="module")
def merges():
    return bytepairs.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def own():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ((_, data, offsets),) = text_blocks(pa.array(texts), 1 << 40)
    return data, offsets


def test_words_are_the_matches_of_the_pattern():
    import regex

    rng = random.Random(1)
    letters = [*"astrelvmdL'' \n\t1²._é日", " ", " ", " ", "　", "\x85", "́", "😀", "\U00011700"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    data, starts, ends, first = bytepairs.words(*flat(texts))
    raw = data.tobytes()
    got = [[raw[starts[i] : ends[i]].decode() for i in range(first[k], first[k + 1])] for k in range(len(texts))]
    assert got == [regex.findall(P.PATTERN, x) for x in texts]


def test_every_character_is_cut_as_the_library_cuts_it(own):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(every), 97):  # a letter, a digit and a mark before every character show its class through the tokens' borders
        c = every[low]
        data, starts, ends, _ = bytepairs.words(*flat([f"a{c}1{c}.{c}"]))
        pieces = [data.tobytes()[s:e] for s, e in zip(starts, ends, strict=True)]
        want = [t for w in pieces for t in own.encode_ordinary(w.decode())]
        assert own.encode_ordinary(f"a{c}1{c}.{c}") == want, hex(ord(c))


def test_replay_equals_the_library(merges, own):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aaabcdehinorst") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["a" * n for n in range(1, 40)] + ["日本語" * 9, "ab" * 5000, "é" * 999, ""]
    ids, bounds = bytepairs.replay(merges, *flat(texts))
    assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)] == [own.encode_ordinary(x) for x in texts]


def test_vocabulary_out_of_order_is_an_error():
    single = {bytes([b]): b for b in range(256)}
    assert len(bytepairs.make_merges(single | {b"ab": 256, b"abc": 257}).pairs) == 2
    with pytest.raises(ValueError, match="higher rank"):
        bytepairs.make_merges(single | {b"abc": 256, b"ab": 257})
    with pytest.raises(ValueError, match="256"):
        bytepairs.make_merges({b"a": 0})
    unreached = bytepairs.make_merges(single | {b"ab": 256, b"cd": 257, b"bc": 258, b"abcd": 259, b"xyz": 260})
    assert 260 not in unreached.merged


@pytest.mark.parametrize("gather,kept", [(1 << 25, 1 << 27), (1, 1)])
def test_byte_pairs_of_odd_documents(spark, merges, own, gather, kept, monkeypatch):
    monkeypatch.setattr(bytepairs, "GATHER", gather)
    monkeypatch.setattr(bytepairs, "KEPT_BYTES", kept)
    got = bytepairs.encode_documents(odd(spark), merges).collect()
    want = Counter((i, t, tuple(own.encode_ordinary(t or ""))) for i, t in ODD)
    assert Counter((r.doc_id, r.decoded_, tuple(r.ids_)) for r in got) == want
    assert all(r.round_trip and r.n_pieces == len(r.ids_) and r.n_bytes_ == len((r.decoded_ or "").encode()) and r.map == {"k": 1} for r in got)
    assert all(r[c] == f"mine {c}" for r in got for c in CLASHING)
    assert all(bytepairs.decode_ids(merges, r.ids_).decode() == (r.decoded_ or "") for r in got)
    assert bytepairs.encode_documents(spark.createDataFrame([], "doc_id long, text string"), merges).count() == 0


def test_byte_pairs_query_against_the_library(spark, sf_dir, own):
    got = Counter(map(tuple, __spark_entry__.queries()["op11_byte_pairs"](spark, sf_dir).collect()))
    want = Counter()
    for i, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert got == want


# 12


def plain_alignment(rows):
    """Per row (doc_id, n_a, n_b, groups, links, n_best, count_sum, digest), by the libraries on whole texts and a walk over both."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = alignment._byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found, held = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if text and (b"".join(map(bytes_a, ids_a)) != (" " + text).encode() or b"".join(map(bytes_b, ids_b)) != (" " + text).encode()):
            ids_a, ids_b = [], []
        spans = []
        for ids, spell in ((ids_a, bytes_a), (ids_b, bytes_b)):
            ends = np.cumsum([len(spell(i)) for i in ids]).astype(int).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)) if ids else [])
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [",".join(str(i) for _, e, i in spans[0] if low < e <= high) + "|" + ",".join(str(i) for _, e, i in spans[1] if low < e <= high) for low, high in zip([0, *common], common)]  # noqa: B905
        links, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j][0] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        held.update(set(links))
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, sha(";".join(groups).encode()) if ids_a else ""))
    most = Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return Counter((d, x, y, g, len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k), s) for d, x, y, g, k, s in found), held


SHORT = [(i, t[:300] if t else t) for i, t in ODD] + [(20 + i, f"the th{'e' * i} anatoly {i} \n\nThen, x'll {'ab' * i}") for i in range(30)]


@pytest.mark.parametrize("frequent", [1 << 18, 2, 0])
@pytest.mark.parametrize("kept", [1 << 26, 0])
def test_alignment_against_the_libraries(spark, frequent, kept, monkeypatch):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "KEPT_BYTES", kept)
    docs = spark.createDataFrame(SHORT, "doc_id long, text string").withColumns({"row": F.lit("mine"), "n_a": F.lit("too"), "map": F.create_map(F.lit("k"), F.lit(1))}).repartition(3)
    aligned, counts = alignment.align_documents(docs, alignment.read_byte_bpe(), alignment.read_pieces(), keep_groups=True)
    got = aligned.collect()
    want, held = plain_alignment(SHORT)
    assert Counter((r.doc_id, r.n_a_, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(held)
    assert all(r.row == "mine" and r.n_a == "too" and r.map == {"k": 1} and (sha(r.groups.encode()) if r.groups else "") == r.groups_sha256 for r in got)


def test_alignment_query_against_the_libraries(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("length(text) < 4000").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aligned = alignment.align_documents(docs, alignment.read_byte_bpe(), alignment.read_pieces())[0]
    assert Counter(map(tuple, aligned.select("doc_id", *alignment.OUTPUTS).collect())) == plain_alignment(rows)[0]
    whole = __spark_entry__.queries()["op12_alignment"](spark, sf_dir)
    assert whole.columns == ["doc_id", *alignment.OUTPUTS] and whole.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(none, alignment.read_byte_bpe(), alignment.read_pieces())[0].count() == 0


def test_identity_map_and_collisions():
    a, b = (alignment.Side(x, None) for x in ([b"a", b"bc", b"", b"x"], [b"", b"bc", b"a", b"a"]))
    assert alignment.identity_map(a, b).tolist() == [3, 1, -1, -1]


# 13


def test_secular_roots_are_the_eigenvalues():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40):
        for spread in (1e-9, 1.0, 1e9):
            d, z = np.sort(rng.normal(size=n)) * spread + np.arange(n) * spread * 1e-3, rng.normal(size=n) + 0.01
            origin, offset = whitening.secular_roots(d, z, 0.7 * spread)
            assert np.allclose(d[origin] + offset, np.linalg.eigvalsh(np.diag(d) + 0.7 * spread * np.outer(z, z)), rtol=1e-12, atol=1e-13 * spread)


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(1)
    values, vectors, whole = np.zeros(6), np.eye(6), np.zeros((6, 6))
    for u in [*np.eye(6)[:3], np.ones(6), np.ones(6), np.zeros(6), *rng.normal(size=(20, 6)), np.eye(6)[5] * 1e-12, np.eye(6)[0] * 1e6]:
        values, vectors = whitening.rank_one(values, vectors, 1.5, u)
        whole += 1.5 * np.outer(u, u)
        assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12) and (np.diff(values) >= 0).all()
        assert np.abs(vectors * values @ vectors.T - whole).max() <= 1e-12 * max(1, np.abs(whole).max())


def plain_whitening(x: np.ndarray, many: int = 8):
    n, total = len(x), x.sum(0)
    centred = (n * x - total) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:many], vectors[:, ::-1][:, :many]
    return centred @ vectors / np.sqrt(values), values / np.trace(cov), ((n * x - total) ** 2).sum(1)


@pytest.mark.parametrize("block,fan", [(1024, 16), (3, 2)])
def test_whitening_against_plain_algebra(spark, block, fan, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(150, 10)) * np.linspace(0.2, 2, 10)
    raw[:60] = raw[0]
    bad = [(900, None), (901, [float("nan")] * 10), (902, [None, *[1.0] * 9]), (903, [float("inf")] * 10)]
    frame = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(raw)), *bad], "vec_id long, embedding array<double>").withColumn("n", F.lit("mine")).repartition(5)
    got = whitening.whiten(frame, shift=100_000).toPandas()
    white, shares, deviation = plain_whitening((np.floor(raw * 1024) + 100_000).astype(np.int64))
    assert len(got) == 150 * 8 and set(got.n) == {150}
    own = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(own * np.sign((own * white).sum(0)) - white).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), shares, rtol=1e-10)
    assert got[got.component == 3].sort_values("vec_id").deviation.tolist() == deviation.tolist() and 0 <= got.identity_error.iloc[0] < 1e-10 and got.identity_error.nunique() == 1


def test_whitening_query_against_plain_algebra(spark, sf_dir):
    got = __spark_entry__.queries()["op13_whitening"](spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = sorted((r.vec_id, r.embedding) for r in table if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding))
    white, shares, deviation = plain_whitening((np.floor(1024 * np.array([v for _, v in rows])) + 100_000).astype(np.int64))
    own = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(own * np.sign((own * white).sum(0)) - white).max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first(), shares, rtol=1e-8)
    assert got[got.component == 1].sort_values("vec_id").deviation.tolist() == deviation.tolist()


def test_whitening_edges(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert run([]) == [] and run([(1, None), (2, [float("nan")])]) == [] and run([(1, [])]) == []
    one = run([(1, [0.5, 0.25])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat_ = {(r.vec_id, r.component): r for r in run([(1, [0.0, 1.0]), (None, [1.0, 1.0]), (3, [0.0]), (3, [0.0])])}
    assert abs(abs(flat_[None, 1].whitened) - abs(flat_[1, 1].whitened)) < 10 and {r.n for r in flat_.values()} == {4}
    constant = run([(i, [i / 4, 1.0]) for i in range(4)])
    assert all((r.whitened is None) == (r.component == 2) for r in constant) and {r.explained for r in constant if r.component == 2} == {0.0}
    with pytest.raises(Exception, match="too large"):
        run([(1, [1e30]), (2, [1.0])])
