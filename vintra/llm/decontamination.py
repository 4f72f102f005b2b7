"""Benchmark decontamination: pairs of words as seeds propose where a document may hold a test item, Smith-Waterman decides.

Tokens are lower-cased runs of letters and digits. A seed is a pair of neighbouring words of an item, found in a document next to
each other or with one word between. An alignment that reaches the score has a known least number z of them (see least_pairs());
so it has t of the item's rarest pairs, if all but z - t of its pairs count as rare, and none that reaches it is lost. A
first pass counts in how many documents each pair occurs. Where t seeds of an item lie within its length of one diagonal, the
stretch of the document around them is aligned with the item word by word, unless it shares too few words with the item to
reach the score in any order. The score is the alignment's share of what a perfect copy gets.
Test items go over the corpus in blocks of bounded size; texts are read twice for each block and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintra.llm.common import Scratch

TOKEN = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Of a word number in a pair's code.
BITS = 21


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two arrays of word numbers, and where it ends in b (exclusive). Row by row; gaps in b by a
    running maximum."""
    best, end = 0, 0
    row = np.zeros(len(b) + 1, np.int64)
    slope = np.arange(len(b) + 1) * -GAP
    for x in a:
        up = np.maximum(row + GAP, 0)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
        row = np.maximum.accumulate(up + slope) - slope
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def least_pairs(length: int, least: float) -> int:
    """How many of an item's neighbouring pairs any alignment that scores `least` keeps, at most one word apart in the document; 1 at least.

    Of M matches let z follow each other so, let x do so in the item but farther apart in the document (two gaps or more each), and let y leave
    out words of the item (one penalty and one word or more each). Then M = x + y + z + 1, the item has M + y words or more, and the score is at most
    2 M - 2 x - y = y + 2 z + 2. From score >= 2 least L follows z >= ((2 least - 0.5) L - 1.5) / 1.5. Items of three words can
    reach 0.5 by their first and last word alone: these aren't found.
    """
    return max(1, math.ceil(((2 * least - 0.5) * length - 1.5) / 1.5 - 1e-9))


class Items:
    """A block of test items, with their pairs of neighbouring words as sorted codes over the block's own vocabulary."""

    def __init__(self, rows: list[tuple[int, str]], least: float, shortest: int):
        self.vocabulary = {}
        self.ids, self.words = [], []
        for item_id, text in rows:
            if len(words := tokens(text)) >= shortest:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        self.length = np.array([len(w) for w in self.words], np.int64)
        pairs = np.array([least_pairs(len(w), least) for w in self.words], np.int64)
        #: seeds that a stretch needs, and pairs of each item that are seeds
        self.need = (pairs + 1) // 2
        self.rare = self.length - 1 - pairs + self.need
        self.counts = [np.unique(words, return_counts=True) for words in self.words]
        grams = sorted((code, k, at) for k, words in enumerate(self.words) for at, code in enumerate(((words[:-1] << BITS) + words[1:]).tolist()))
        self.gram, self.item, self.place = (np.array([g[i] for g in grams], np.int64) for i in range(3))

    def seeds(self, documents: np.ndarray) -> None:
        """Leaves each item's rarest pairs; of equally rare ones those whose places are spread over it. documents: of each distinct pair, in order."""
        n = documents[np.cumsum(np.concatenate([[True], self.gram[1:] != self.gram[:-1]])) - 1] if len(self.gram) else self.gram
        spread = (self.place * 0x9E3779B1) & 0xFFFFFFFF
        order = np.lexsort((spread, n, self.item))
        items = self.item[order]
        rank = np.arange(len(order)) - np.searchsorted(items, items)
        keep = np.zeros(len(order), bool)
        keep[order[rank < self.rare[items]]] = True
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]

    def shared(self, k: int, words: np.ndarray) -> int:
        """Words that item k and a stretch have in common, each as often as both have it: no alignment matches more."""
        own, count = self.counts[k]
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == words], minlength=len(own)), count).sum())

    def places(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's word numbers, where two of the block's words stand together or one apart, and their codes."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in tokens(text)), np.int64)
        known = ids >= 0
        at, code = [], []
        for apart in (1, 2):
            first = np.flatnonzero(known[: max(0, len(ids) - apart)] & known[apart:])
            at.append(first)
            code.append((ids[first] << BITS) + ids[first + apart])
        return ids, np.concatenate(at), np.concatenate(code)

    def hits(self, text: str | None, least: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, start in document words, word numbers of the stretch) for each stretch that may hold `least` of an item.

        An alignment that scores half can't drift by more than the item's length, so its seeds start within that of each other.
        """
        ids, at, code = self.places(text)
        lo, hi = np.searchsorted(self.gram, code), np.searchsorted(self.gram, code, "right")
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return
        count = (hi - lo)[found]
        where = np.repeat(at[found], count)
        g = np.repeat(lo[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, start = self.item[g], where - self.place[g]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        # places on one line, items far apart: seeds from each one on within the length of its item
        step = len(ids) + 2 * int(self.length.max()) + 1
        line = item * step + start + int(self.length.max())
        ahead = np.searchsorted(line, line + self.length[item], "right")
        dense = np.flatnonzero(ahead - np.arange(len(line)) >= self.need[item])
        if not len(dense):
            return
        # windows that overlap are one stretch
        new = np.flatnonzero(np.concatenate([[True], dense[1:] >= ahead[dense[:-1]]]))
        for first, last in zip(dense[new], ahead[dense[np.concatenate([new[1:], [len(dense)]]) - 1]] - 1, strict=True):
            k = int(item[first])
            size = len(self.words[k])
            a, b = max(0, int(start[first]) - size), int(start[last]) + 2 * size
            if self.shared(k, ids[a:b]) >= least * size:
                yield k, a, ids[a:b]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, shortest: int = 3, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, score, start, end: test items found in docs (doc_id, text), with the place in the document's tokens.

    score: best alignment score / that of a perfect copy; `least` of it (0.5 or more) at least. A document and an item give one row, the
    best stretch, the first of equals. Every alignment of an item of four tokens or more that reaches the score is found. Null and
    empty texts and items find nothing; items that are equal are each found. Items of fewer than `shortest` tokens find nothing: they can't
    be told from chance. Rows that repeat a doc_id count as one document. block_chars: text of the items that go over the
    corpus at once (the driver and each task hold as much). An empty table on either side: no rows.
    """
    if least < 0.5:
        raise ValueError("least must be 0.5 or more: below it an alignment may drift farther than an item is long")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    items = scratch.save(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").withColumn("row", F.monotonically_increasing_id()), "items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, blocks = None, max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)
        held = Items([(r[0], r[1]) for r in part.select("item_id", "text").collect()], least, shortest)
        grams = np.unique(held.gram)
        documents = np.zeros(len(grams), np.int64)
        for r in document_counts(texts, spark.sparkContext.broadcast((held, grams))).collect():
            documents[r["gram"]] = r["n"]
        held.seeds(documents)
        found = scratch.save(search(texts, spark.sparkContext.broadcast(held), least), f"found-{k}")
        out = found if out is None else out.unionAll(found)
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.score", "x.start", "x.end")


def document_counts(texts: DataFrame, held) -> DataFrame:
    """(gram, n): documents that hold the block's distinct pair of that number; one row for each of these at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, grams = held.value
        n = np.zeros(len(grams) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                code = np.unique(items.places(text)[2])
                at = np.searchsorted(grams, code)
                n[at[grams[np.minimum(at, len(grams) - 1)] == code] if len(grams) else at[:0]] += 1
        seen = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen])], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def search(texts: DataFrame, held, least: float) -> DataFrame:
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *h) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for h in held.value.hits(t, least)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item", "at", "words"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, item, at, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = held.value.words[item]
                score, end = smith_waterman(a, np.array(words, np.int64))
                if score >= least * MATCH * len(a):
                    # the alignment backwards from its end tells where it starts
                    back = smith_waterman(a[::-1], np.array(words[:end][::-1], np.int64))[1]
                    out.append((doc_id, held.value.ids[item], score / (MATCH * len(a)), at + end - back, at + end))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "start", "end"])

    stretches = texts.mapInArrow(propose, "doc_id long, item int, at long, words array<long>")
    return stretches.repartition(F.xxhash64("doc_id", "item", "at")).mapInArrow(align, "doc_id long, item_id long, score double, start long, end long")
