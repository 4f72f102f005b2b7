"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - t[k]): one weight vector for all ordered thresholds t. Features are words and word beginnings
with their logged counts; an L1 penalty leaves few of them. Labels say only toxic or not, so the grades of the training
rows are made of them: 0 for not toxic, and 1, 2, 3 for toxic rows by thirds of the share that telling features take of
the text. The expected severity is the sum of P(grade > k).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintra.llm.common import Scratch, free
from vintra.llm.quality import bounded_sample

TOKEN = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
GRADES = 4
#: Documents whose P(grade > 0) is as high are rejected.
REJECT = 0.5


def features(text: str | None) -> tuple[dict[str, int], int]:
    """Counts of words and of longer words' beginnings (^...), and the number of words. Null and empty: none."""
    words = Counter(TOKEN.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                out["^" + w[:k]] += n
    return out, sum(words.values())


def value(name: str, count: int, words: int) -> float:
    """A feature's value: a word's logged count; a beginning's logged count in a hundred words, as chance makes some of them in
    any long text."""
    return math.log1p(count) if name[0] != "^" else math.log1p(100 * count / max(words, 20))


@dataclass
class Ordinal:
    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, text: str | None) -> tuple[float, float]:
        """(expected severity, P(grade > 0))."""
        words = Counter(TOKEN.findall((text or "").lower()))
        counts: dict[str, int] = {}
        get = self.weights.get
        for w, n in words.items():
            if w in self.weights:
                counts[w] = n
            for k in BEGINNINGS:
                if len(w) > k and get(b := "^" + w[:k]) is not None:
                    counts[b] = counts.get(b, 0) + n
        total = sum(words.values())
        z = sum(self.weights[f] * value(f, n, total) for f, n in counts.items())
        above = 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - z, -60, 60)))
        return float(above.sum()), float(above[0])


def grades(rows: list[tuple[dict[str, int], int]], toxic: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic, 1..GRADES-1 for the others by quantiles of the share of telling features."""
    share = np.array([sum(counts.values()) / max(1, size) for counts, size in rows])
    out = np.zeros(len(rows), int)
    if toxic.any():
        cuts = np.quantile(share[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
        out[toxic == 1] = 1 + np.searchsorted(cuts, share[toxic == 1], side="right")
    return out


def fit(rows: list[tuple[dict[str, int], int]], toxic: np.ndarray, penalty: float = 2e-4, steps: int = 600) -> Ordinal:
    """Accelerated proximal gradient on the mean negative log-likelihood plus penalty * |w|, for rows of (telling features'
    counts, words). No rows, or none toxic: severity near 0."""
    names = {f: k for k, f in enumerate(sorted({f for counts, _ in rows for f in counts}))}
    at = [(i, names[f], value(f, c, size)) for i, (counts, size) in enumerate(rows) for f, c in sorted(counts.items())]
    row, col, val = (np.array([a[k] for a in at], t) for k, t in enumerate((int, int, float)))
    n, y = len(rows), grades(rows, toxic)
    levels = np.arange(GRADES - 1)
    above = (y[:, None] > levels).astype(float)
    rate = (above.sum(axis=0) + 0.5) / (n + 1)
    t = -np.log(rate / (1 - rate))
    w = np.zeros(len(names))
    u, v, momentum = w.copy(), t.copy(), 1.0
    dot = lambda a: np.bincount(row, val * a[col], n) if len(row) else np.zeros(n)
    # a step's bound: largest squared row, by a few power iterations
    probe = np.ones(len(names)) / max(1, len(names)) ** 0.5
    top = 1.0
    for _ in range(20 if len(row) else 0):
        probe = np.bincount(col, val * dot(probe)[row], len(names))
        top = np.linalg.norm(probe)
        probe /= top
    step = n / (0.25 * top + 1) if n else 0.0
    for _ in range(steps):
        z = dot(u)
        tail = 1 / (1 + np.exp(np.clip(v - z[:, None], -60, 60)))
        # P(y) = tail[y-1] - tail[y]; its gradient by z is 1 - tail[y-1] - tail[y]
        padded = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        hi, lo = padded[i, y], padded[i, y + 1]
        gz = -(1 - hi - lo) / max(n, 1)
        new_w = u - step * (np.bincount(col, val * gz[row], len(names)) if len(row) else 0)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        p = np.maximum(hi - lo, 1e-12)
        gt = np.zeros(GRADES - 1)
        np.add.at(gt, y[y > 0] - 1, (hi * (1 - hi) / p)[y > 0])
        np.subtract.at(gt, y[y < GRADES - 1], (lo * (1 - lo) / p)[y < GRADES - 1])
        new_t = np.maximum.accumulate(v - min(step, 1.0) * gt / max(n, 1))
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        u, v = new_w + (momentum - 1) / nxt * (new_w - w), np.maximum.accumulate(new_t + (momentum - 1) / nxt * (new_t - t))
        w, t, momentum = new_w, new_t, nxt
    return Ordinal({f: float(w[k]) for f, k in names.items() if w[k]}, [float(x) for x in t])


def learn(docs: DataFrame, labels: DataFrame, most: int = 8_000, least_rows: int = 3, least_odds: float = 1.5, **options) -> Ordinal:
    """The model from at most `most` labelled documents; rows with a null label or text take no part.

    Telling features, those that at least least_rows of these documents have and whose share of the toxic ones is
    exp(least_odds) times that of the others or more, are counted in Spark; only they come to the driver.
    """
    scratch = Scratch(docs.sparkSession)
    known = bounded_sample(labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("y")), F.col("doc_id"), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(2).to_pylist()]
            kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64())
            made = ([list(c) for c, _ in rows], [list(c.values()) for c, _ in rows], [n for _, n in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], names=["doc_id", "y", "names", "counts", "size"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")
    rows = scratch.save(texts.mapInArrow(run, "doc_id long, y int, names array<string>, counts array<long>, size long").withColumn("row", F.monotonically_increasing_id()), "features")
    kept = sorted(rows.select("row", "doc_id", "y", "size").collect(), key=lambda r: (r["doc_id"], r["size"], r["row"]))
    toxic = sum(r["y"] for r in kept)
    long = rows.select("row", "y", F.explode(F.arrays_zip("names", "counts")).alias("f")).select("row", "y", F.col("f.names").alias("name"), F.col("f.counts").alias("count"))
    odds = F.log((F.sum("y") + 1) / (toxic + 2)) - F.log((F.count("*") - F.sum("y") + 1) / (len(kept) - toxic + 2))
    telling = long.groupBy("name").agg(odds.alias("odds"), F.count("*").alias("n"), F.sum("y").alias("ones")).where((F.col("n") >= least_rows) & (F.col("odds") >= least_odds) & (F.col("ones") > 0)).select("name")
    counts: dict[int, dict[str, int]] = {}
    for r in long.join(telling, "name", "left_semi").select("row", "name", "count").toLocalIterator():
        counts.setdefault(r["row"], {})[r["name"]] = r["count"]
    return fit([(counts.get(r["row"], {}), r["size"]) for r in kept], np.array([r["y"] for r in kept]), **options)


def graded(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs (text and more) with severity (0 to 3) and toxic (P(grade > 0)) beside them, repeated rows too.

    Null and empty texts have no features and so the severity of none, near 0. Columns of docs called severity or toxic
    give way.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.severity(t) for t in texts], columns=["severity", "toxic"])

    made = F.pandas_udf(run, "severity double, toxic double")(F.col("text"))
    held_ = free("made", docs)
    return docs.drop("severity", "toxic").withColumn(held_, made).withColumn("severity", F.col(held_)["severity"]).withColumn("toxic", F.col(held_)["toxic"]).drop(held_)
