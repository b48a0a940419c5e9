"""Rows, columns and values that once broke an operator."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placetrail.llm import langid, neardup, pieces, repeats, sampling, topk

CLASHING = ("n_bytes", "n_removed", "n_spans", "kept", "ids", "decoded", "round_trip", "lang_pred", "score", "n_pieces", "key", "row", "order", "mark", "held", "found", "size", "copies", "rep", "component_id")


def test_repeats_of_rows_that_read_alike(spark):
    text = "".join(random.Random(4).choices("abcdefgh", k=400))
    rows = [(5, text), (None, "5:" + text), (None, text), (None, None), (5, None), (1, "-"), (None, "1:1-")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text, r.n_bytes, r.n_removed) for r in got) == Counter(
        [(5, text, 400, 400), (None, "5:" + text, 402, 400), (None, text, 400, 400), (None, None, 0, 0), (5, None, 0, 0), (1, "-", 1, 0), (None, "1:1-", 4, 0)]
    )
    keys = spark.createDataFrame([("1", "2:xy"), ("12:x", "y"), (None, "-"), ("-", None), ("", None), (None, "")], "a string, b string")
    assert keys.select(repeats.row_key("a", "b").alias("k")).distinct().count() == 6


def test_stages_keep_columns_of_any_name_and_type(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.filter("doc_id < 5")).unionByName(docs.filter("doc_id = 7").withColumn("text", F.concat("text", F.lit(" and more"))))
    mine = {c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING} | {"map": F.create_map(F.lit("k"), F.col("doc_id")), "Kept_": F.lit(1)}
    docs = cp.cut(docs.withColumns(mine))
    names = docs.columns
    for name, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, sf_dir))
        rows = docs.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING) and all(r.map == {"k": r.doc_id} and r.Kept_ == 1 for r in rows), name
        assert docs.columns == names or name == "sentence_pieces"
    assert {"n_bytes_", "n_pieces_", "ids_", "decoded_", "round_trip_"} <= set(docs.columns) and docs.filter("not round_trip_").count() == 0


def test_products_beyond_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(0, [10**9, 1]), (1, [10**9, 2]), (2, [-(10**9), 3])], "vec_id long, v array<long>")
    got = topk.nearest_neighbours(frame.filter("vec_id = 0"), frame, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 10**18 + 2), (2, 3 - 10**18)]
    large = spark.createDataFrame([(0, [10**12]), (1, [10**12])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="too large"):
        topk.nearest_neighbours(large, large, 1).collect()


def invented(language: int, n: int) -> str:
    """Words of an alphabet and a syllable stock that only this language has."""
    rng = random.Random(hashlib.md5(f"{language}:{n}".encode()).hexdigest())
    stock = random.Random(language)
    syllables = ["".join(stock.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(60))


def test_every_language_is_learned(spark):
    rows = [(10 * k + n, invented(k, n), f"l{k:03d}") for k in range(300) for n in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_language=20)
    assert len(model.languages) == 300 and model.weights.shape[0] == langid.slots_for(300) == 1 << 13
    found = langid.identify(docs, model).select((F.col("lang") == F.col("lang_pred")).alias("right"), "lang_pred").collect()
    assert len({r.lang_pred for r in found}) == 300 and sum(r.right for r in found) > 0.95 * len(found)
    assert [langid.slots_for(n) for n in (1, 32, 33, 64, 65)] == [1 << 17, 1 << 17, 1 << 16, 1 << 16, 1 << 15]


def test_a_rare_label_is_in_the_sample_and_too_many_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "often" if i else "once") for i in range(3000)], "doc_id long, text string, label string")
    keys = docs.select("doc_id", "label")
    got = sampling.labelled_sample(docs, keys, "label", 20, 100, seed=1)
    assert (got.label == "once").sum() == 1 and 1 <= (got.label == "often").sum() < 60
    monkeypatch.setattr(sampling, "CLASSES", 1)
    with pytest.raises(ValueError, match="can be learned"):
        sampling.labelled_sample(docs, keys, "label", 20, 100, seed=1)


def test_repeated_strings_take_one_python_worker_for_packing_and_one_for_the_rest(spark):
    """A filter on the outputs must not have every text unpacked and cut a second time, in more workers of the same task."""
    import corpus_pipeline as cp

    passage = "\u00e9" + "x" * 199  # 201 bytes; the first character's second byte is that of the next row's
    rows = [(1, passage, "en", "s", 200), (2, "\u0129" + "x" * 199 + "!", "en", "s", 201), (3, "short", None, "s", 7), (4, None, "en", None, 9), (5, passage, "en", "s", 200), (6, "", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.repeated_strings(spark, docs, "")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2, plan
    assert sorted(map(tuple, got.collect())) == sorted([(2, "!", "en", "s", 1), rows[2], rows[3], rows[5]], key=lambda r: r[0])
    for r in repeats.without_repeats(docs).collect():
        raw = next(k for k in repeats.remove_repeats(docs).collect() if k.doc_id == r.doc_id)
        assert r.n_removed == raw.n_removed and r.text == (raw.kept.decode("utf-8", "ignore") if raw.n_removed else raw.text)


def test_crossed_blocks_hold_few_signatures_at_a_time():
    """64 outsiders and 1024 rows that all are near: 65,536 pairs of 1 kB signatures."""
    n = 64 + 1024
    rep = np.arange(n)[::-1].copy()
    fine = np.zeros((n, neardup.FINE), np.uint8)
    fine[64:][::2, : neardup.FINE_DIFFERENT + 1] = 1  # every other row differs too much
    zeros = np.zeros(n, np.int64)
    lists = pa.ListArray.from_arrays(np.arange(0, n * neardup.CHUNKS + 1, neardup.CHUNKS, dtype=np.int32), pa.array(np.zeros(n * neardup.CHUNKS, np.int64)))
    columns = {"key": zeros, "block": zeros, "pblock": zeros, "probe": np.arange(n) < 64, "rep": rep, "part": rep, "n": zeros + 9, "tag": zeros, "sig": lists, "fine": pa.array([f.tobytes() for f in fine], pa.binary())}
    table = pa.table(columns)
    tracemalloc.start()
    got = neardup._cross(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {(max(u, v), min(u, v)) for u in rep[:64].tolist() for v in rep[64:][1::2].tolist()}
    assert set(zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True)) == want and got.num_rows == len(want)
    assert peak < 60e6


def test_fixed_tables_start_no_python_workers(spark):
    """A table made from a list of rows is read by Python workers of a pool of their own."""
    model = pieces.read_model()
    table = pieces.piece_table(spark, model)
    assert {(r.piece, r.id) for r in table.collect()} == set(model.useful.items())
    back = pieces.decode(spark.createDataFrame(pa.table({"k": [1], "ids": [[5, 300]]})), model, ["k"])
    for frame in (table, back):
        assert "ExistingRDD" not in frame._jdf.queryExecution().executedPlan().toString()
