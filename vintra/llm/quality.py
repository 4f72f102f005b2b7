"""Quality scores by histogram gradient-boosted trees over document statistics.

The statistics describe a text's form: lengths, shares of character and word kinds, repetition. Trees are grown on
histograms of binned statistics, from a bounded sample of labelled rows on the driver, and flattened into arrays: a
batch of documents walks all trees at once by numpy indexing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "symbol", "comma", "pipe_words", "symbol_ends", "capital_words", "distinct_words", "top_word", "same_as_previous",
    "log_lines", "line_words", "short_lines", "distinct_lines", "period_ends", "upper_words", "long_words",
)
LETTER, UPPER, DIGIT, SPACE, SYMBOL, MARK = range(6)


@cache
def kinds() -> np.ndarray:
    """The kind of each code point of the basic plane; those beyond count as symbols."""
    kind = lambda c: SPACE if c.isspace() else UPPER if c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK if c in ".,;:?'\"()-" else SYMBOL
    return np.array([kind(chr(k)) for k in range(1 << 16)] + [SYMBOL], np.uint8)


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; zeros for null, empty or blank ones."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[np.minimum(code, 1 << 16)]
    count = np.bincount(kind, minlength=6)
    inside = np.concatenate([[False], kind != SPACE, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2] - 1
    length = last - first + 1
    uppers = np.concatenate([[0], np.cumsum(kind == UPPER)])
    ends, letters = code[last], int(length.sum())
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(code)), np.log1p(n), letters / n, count[UPPER] / letters, count[DIGIT] / letters, 1 - letters / len(code), count[SYMBOL] / letters, np.count_nonzero(code == ord(",")) / n,
        np.count_nonzero((ends == ord("|")) & (length == 1)) / n, np.count_nonzero(kind[last] == SYMBOL) / n, np.count_nonzero(kind[first] == UPPER) / n, len(set(words)) / n,
        max(Counter(words).values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        np.log1p(len(lines)), n / len(lines), sum(len(x) < 40 for x in lines) / len(lines), len(set(lines)) / len(lines), np.count_nonzero(ends == ord(".")) / n,
        np.count_nonzero((uppers[last + 1] - uppers[first] == length) & (length > 1)) / n, np.count_nonzero(length > 14) / n,
    ]


@dataclass
class Trees:
    """Boosted trees as arrays of (trees, nodes); a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), np.int32)
        for _ in range(self.depth):
            down = x[row, self.feature[tree, at]] <= self.cut[tree, at]
            at = np.where(down, self.left[tree, at], self.right[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.08, bins: int = 64, least: float = 3.0, shrink: float = 2.0) -> Trees:
    """Grows trees for logistic loss. Statistics are binned at quantiles; a node's best split comes from sums of gradients and
    curvatures in each bin. least: curvature that a child needs. One class or no rows: a constant score."""
    n = len(y)
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1) if n else np.zeros(x.shape, int)
    nodes = 2 ** (depth + 1) - 1
    out = Trees(*(np.zeros((trees, nodes), t) for t in (np.int32, float, np.int32, np.int32, float)), base, depth)
    out.left[:] = out.right[:] = np.arange(nodes)
    f = np.full(n, base)
    offsets = np.arange(x.shape[1]) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        todo, used = [(0, np.arange(n), 0)], 1
        while todo:
            node, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and len(rows) >= 2:
                flat = (binned[rows] + offsets).ravel()
                gh = [np.bincount(flat, np.repeat(w[rows], x.shape[1]), offsets[-1] + bins).reshape(-1, bins).cumsum(axis=1)[:, :-1] for w in (g, h)]
                gain = gh[0] ** 2 / (gh[1] + shrink) + (gs - gh[0]) ** 2 / (hs - gh[1] + shrink) - gs**2 / (hs + shrink)
                gain[(gh[1] < least) | (hs - gh[1] < least)] = -1
                j, k = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, k] > 1e-6 and k < len(cuts[j]):
                    best = (j, k)
            if best is None:
                out.value[t, node] = rate * gs / (hs + shrink)
                f[rows] += out.value[t, node]
                continue
            j, k = best
            out.feature[t, node], out.cut[t, node] = j, cuts[j][k]
            out.left[t, node], out.right[t, node], used = used, used + 1, used + 2
            low = binned[rows, j] <= k
            todo += [(out.left[t, node], rows[low], level + 1), (out.right[t, node], rows[~low], level + 1)]
    return out


def with_statistics(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns..., x): the statistics of text as an array of doubles."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return docs.select(*columns, F.pandas_udf(run, "array<double>")("text").alias("x"))


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hash of the key: the same rows in every run."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def learn(docs: DataFrame, labels: DataFrame, label: str, most: int = 20_000, **options) -> Trees:
    """Trees from at most `most` labelled documents; a null label or text takes no part, nor does a document without one."""
    known = bounded_sample(labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")), F.col("doc_id"), most)
    rows = with_statistics(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id"), "doc_id", "y").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit(x, rows["y"].to_numpy(float), **options)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text), repeated rows too; null and empty texts have the score of no statistics."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(STATISTICS))
            scores = np.concatenate([held.value.score(x[k : k + 1024]) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
