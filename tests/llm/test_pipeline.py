"""The pipeline's stages, each on what the one before it kept, against brute force."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_dedup import components, shingle_sets, similar_pairs
from vintra.llm import decontamination, mixing, quality, toxicity
from vintra.llm.common import Scratch


@pytest.fixture(scope="module")
def kept(spark, small):
    """The documents after each stage, by its name."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out, scratch = {"": docs}, Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = scratch.save(stage(spark, docs, small), name)
    return {k: v.toPandas().sort_values("doc_id").reset_index(drop=True) for k, v in out.items()}


def test_stages_keep_columns_and_documents(kept):
    before = kept[""]
    for name, _ in corpus_pipeline.STAGES:
        assert list(kept[name].columns)[:5] == list(kept[""].columns)
        assert set(kept[name].doc_id) <= set(before.doc_id) and len(kept[name]) > 0.5 * len(before)
        before = kept[name]


def test_toxicity_stage(kept, small):
    toxic = set(pd.read_parquet(f"{small}/labels.parquet").query("toxic == 1").doc_id)
    gone = set(kept[""].doc_id) - set(kept["toxicity"].doc_id)
    assert len(gone & toxic) >= 0.8 * len(toxic) and len(gone - toxic) <= 0.1 * len(kept[""])


def test_line_stage(kept):
    lines = [" ".join(x.lower().split()) for t in kept["line_dedup"].text for x in t.split("\n")]
    full = [x for x in lines if x]
    assert len(full) == len(set(full))
    assert (kept["line_dedup"].n_chars == kept["line_dedup"].text.str.len()).all()


def test_near_copy_stage(kept):
    rows = list(kept["line_dedup"][["doc_id", "text"]].itertuples(index=False, name=None))
    want = components([d for d, _ in rows], similar_pairs(shingle_sets(rows)))
    assert set(kept["simhash"].doc_id) == {d for d, root in want.items() if d == root}


def test_decontamination_stage(kept, small):
    items = [decontamination.tokens(t) for t in pd.read_parquet(f"{small}/benchmark.parquet").text]
    leaks = set()
    for d, t in kept["simhash"][["doc_id", "text"]].itertuples(index=False):
        number = {}
        words = np.array([number.setdefault(w, len(number)) for w in decontamination.tokens(t)], np.int64)
        for item in items:
            a = np.array([number.get(w, -1) for w in item], np.int64)
            if len(a) and (a >= 0).mean() >= 0.5 and decontamination.smith_waterman(a, words)[0] >= len(a):
                leaks.add(d)
    assert set(kept["decontamination"].doc_id) == set(kept["simhash"].doc_id) - leaks


def test_mixing_stage(kept):
    out, before = kept["mixing"], kept["decontamination"]
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in before[["doc_id", "text"]].itertuples(index=False)}
    assert all(r.size == words[r.doc_id] and 0 < r.copies <= 3 and r.taken == r.size * r.copies for r in out.rename(columns={"size": "n"}).assign(size=out["size"]).itertuples())
    sums = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), longest=("size", "max"))
    assert ((sums.taken - sums.target).abs() <= sums.longest).all()


def test_mixing_by_unequal_odds(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 5), "s", 1.0 + k % 4) for k in range(2000)], "doc_id long, text string, source string, wish double")
    taken = np.zeros(4)
    for seed in range(3):
        out = mixing.mix_sources(docs.select("doc_id", "text", "source", "wish"), share=0.3, seed=seed, weight=F.col("wish"))
        assert abs(out.agg(F.sum("taken")).first()[0] - 0.3 * out.agg(F.sum("size")).first()[0]) <= 5
        taken += [r["n"] for r in out.groupBy((F.col("doc_id") % 4).alias("k")).agg(F.sum("copies").alias("n")).orderBy("k").collect()]
    # documents are included in proportion to their wishes 1, 2, 3, 4
    assert np.allclose(taken / taken.sum(), np.array([1, 2, 3, 4]) / 10, atol=0.03)


def test_models_of_odd_rows(spark):
    rows = [(k, ("bad awful " if k % 2 else "nice good ") * (3 + k % 3) + "the text goes on", "x") for k in range(60)] + [(100, None, "a"), (101, "", "b"), (None, "bad awful", "c"), (100, "nice", "d"), (102, "word " * 100_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("severity", F.lit(1))
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    graded = toxicity.graded(docs, toxicity.learn(docs, labels))
    assert graded.count() == len(rows) and graded.where("toxic is null or isnan(toxic)").count() == 0
    scored = quality.score(docs, quality.learn(docs, labels, "quality"))
    assert scored.count() == len(rows) and scored.where("score between 0 and 1").count() == len(rows)
    assert toxicity.graded(docs.limit(0), toxicity.learn(docs.limit(0), labels.limit(0))).count() == 0
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels.limit(0), "quality")).count() == 0


def test_odd_rows_and_clashing_columns(spark, small, tmp_path):
    """Null ids, sources and texts, long texts, repeated rows and columns named as the stages' own: nothing fails, and clean rows stay."""
    rows = [(k, f"A clean document number {k} says something of its own. " + " ".join(f"word{k}x{i}" for i in range(40)), "en", "s", 100) for k in range(60)]
    rows += [(1000, None, "en", "s", None), (1001, "", None, None, 0), (None, "a text without an id " + "and more " * 30, "en", "t", 1), (1002, "b " * 100_000, "en", "t", 200_000)] + [(1003, "a row that repeats entirely", "en", "t", 27)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(c) for c in ("size", "target", "taken", "copies", "mix_doc_id", "gone_id", "dropped", "n_lines", "severity", "toxic", "keep_id", "row", "id")}
    docs = docs.withColumns(clash)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    scratch, now = Scratch(spark), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, scratch.save(stage(spark, now, str(tmp_path)), name)
        assert set(before.columns) <= set(now.columns), name
        assert set(range(60)) <= {r["doc_id"] for r in now.select("doc_id").collect()} or name == "mixing", name
    got = now.toPandas()
    assert (got["size"] == "size").all() and {"size_", "taken_", "source_size"} <= set(got.columns)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = scratch.save(stage(spark, empty, str(tmp_path)), f"none-{name}")
        assert empty.count() == 0, name
