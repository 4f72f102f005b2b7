"""Hierarchical packing of documents into training sequences of several context sizes.

Every document becomes ids and an end id. Documents longer than the largest context give whole windows of it; what is
left of them and all others are routed to the smallest context (tier) that holds them. A tier's window starts with its
longest document; the gap is filled with whole documents of shorter tiers, largest fitting first, and at last with the
head of a document that is cut. So windows are full, and only the last documents of a task leave a rest, which is cut
into windows of powers of two. Windows of one context size then form steps of equal numbers of tokens.

Each task packs its own split of the input in one pass over a pool of bounded size: there's no shuffle of texts or ids, and a
source or document that fills a third of the table is only more splits.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintra.llm.common import Scratch

TIERS = (256, 512, 1024, 2048)
#: Sequences are numbered by task and within it.
TASK_BITS = 40
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_LETTERS, _POINTS = frozenset(b"abcdefghijklmnopqrstuvwxyz"), frozenset(b".,;:!?")


class Encoder:
    """Texts (UTF-8) -> ids as little-endian unsigned 32-bit numbers, the same as encoding each text whole.

    The vocabulary drops white space and lower-cases before it merges, so a text's ids are those of its words in a row.
    Words are encoded once and kept, up to `keep` of them; ASCII letters are lower-cased first where no combining mark
    and no special token can make a difference. A run of points at the end of a word, after a letter, is a token of its own.
    """

    def __init__(self, path: str, keep: int = 500_000, block: int = 1 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.keep, self.block = Tokenizer.from_file(path), keep, block
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters, encoded in one go: each ends with the only token that ends a word."""
        ids = self.ids([b" ".join(words).decode()])[0]
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return [x.tobytes() for x in self.ids([w.decode() for w in words])]
        flat, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def learn(self, words: set[bytes]) -> None:
        known, plain, other, parts = self.known, {}, [], []
        for w in words:
            if w[-1] in _POINTS:
                v = w.rstrip(b".,;:!?")
                if v and (v[-1] in _LETTERS or v.decode()[-1].isalpha()):
                    tail = w[len(v) :]
                    parts.append((w, v, tail))
                    if tail not in known:
                        known[tail] = self.ids([tail.decode()])[0].tobytes()
                    if v in known:
                        continue
                    w = v
            if w.isalpha() or not w.isascii() and w.decode().isalpha():
                plain[w] = None
            else:
                other.append(w)
        if plain:
            known.update(zip(plain, self.letters(list(plain)), strict=True))
        if other:
            known.update(zip(other, (x.tobytes() for x in self.ids([w.decode() for w in other])), strict=True))
        for w, v, tail in parts:
            known[w] = known[v] + known[tail]

    def blocks(self, text: bytes) -> Iterator[list[bytes]]:
        """The words of a text, so many bytes at a time."""
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + self.block) if len(text) - at > self.block else None
            end = cut.start() if cut else len(text)
            yield text[at:end].split()
            at = end

    def __call__(self, text: bytes) -> bytes:
        out = []
        for words in self.blocks(text):
            found = list(map(self.known.get, words))
            at, places = -1, []
            while True:  # what is missing is looked up again alone
                try:
                    at = found.index(None, at + 1)
                except ValueError:
                    break
                places.append(at)
            if places:
                if len(self.known) > self.keep:
                    self.known = {}
                self.learn({words[k] for k in places})
                for k in places:
                    found[k] = self.known[words[k]]
            out.append(b"".join(found))
        return b"".join(out)


class Pool:
    """Pieces that wait for a window, by length; lengths that occur are the bits of one number."""

    def __init__(self):
        self.by_length: dict[int, deque] = {}
        self.bits = self.tokens = 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.by_length.setdefault(n, deque()).append(piece)
        self.bits |= 1 << n
        self.tokens += n

    def take(self, n: int) -> tuple:
        waiting = self.by_length[n]
        piece = waiting.popleft()
        if not waiting:
            self.bits &= ~(1 << n)
        self.tokens -= n
        return piece

    def longest(self, most: int) -> int:
        """The greatest length up to most, 0 if there's none."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self, above: int) -> int:
        """The least length over above; some piece must have one."""
        rest = self.bits >> (above + 1)
        return above + (rest & -rest).bit_length()


def windows(pool: Pool, tiers: tuple[int, ...], leave: int) -> Iterator[tuple[int, list[tuple]]]:
    """(context size, pieces) until no more than `leave` tokens wait; with leave 0 the rest ends as powers of two."""
    while pool.tokens > leave:
        longest = pool.longest(tiers[-1])
        size = next(t for t in tiers if t >= longest)
        if size > pool.tokens:  # the last ones: no whole window of this context is left
            size = 1 << pool.tokens.bit_length() - 1
        pieces, gap = [], size
        while gap:
            if n := pool.longest(gap):
                pieces.append(pool.take(n))
                gap -= n
            else:
                doc, start, ids = pool.take(pool.shortest(gap))
                pieces.append((doc, start, ids[: 4 * gap]))
                pool.put((doc, start + gap, ids[4 * gap :]))
                gap = 0
        yield size, pieces


def packer(path: str, end_id: int, tiers: tuple[int, ...], pool_tokens: int, schema: pa.Schema):
    """The function of mapInArrow: (doc_id, text as bytes) -> pieces."""
    end, most = np.array([end_id], "<u4").tobytes(), tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pool, task = Encoder(path), Pool(), TaskContext.get().partitionId()
        rows, made, counts, held = [], 0, {}, 0

        def placed(size: int, pieces: list[tuple]) -> int:
            nonlocal made
            sequence, offset, nth = (task << TASK_BITS) | made, 0, counts.get(size, 0)
            for (doc_id, total), start, ids in pieces:
                rows.append((doc_id, start, len(ids) // 4, ids, total, sequence, offset, size, task, nth))
                offset += len(ids) // 4
            made, counts[size] = made + 1, nth + 1
            return offset

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for given in batches:
            for doc_id, ids in zip(given.column(0).to_pylist(), (encode(text or b"") for text in given.column(1).to_pylist()), strict=True):
                ids += end
                doc, total = (doc_id, len(ids) // 4), len(ids) // 4
                for start in range(0, total - most + 1, most):
                    held += placed(most, [(doc, start, ids[4 * start : 4 * (start + most)])])
                if total % most:
                    start = total - total % most
                    pool.put((doc, start, ids[4 * start :]))
                if pool.tokens >= pool_tokens:
                    for size, pieces in windows(pool, tiers, pool_tokens // 2):
                        held += placed(size, pieces)
                if held >= 1 << 19:
                    yield batch()
                    held = 0
        for size, pieces in windows(pool, tiers, 0):
            placed(size, pieces)
        if rows:
            yield batch()

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, pool_tokens: int = 1 << 18) -> DataFrame:
    """docs (doc_id, text) -> one row a piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, window, task, nth.

    ids: the piece's ids as little-endian unsigned 32-bit numbers. window: the sequence's context size; every sequence is full.
    nth: the sequence's number among those of its task and window. tiers: powers of two, ascending; only the rest of a task
    lies in smaller windows. pool_tokens: what a task holds back for filling gaps; a document's ids are in memory whole.
    The vocabulary is a path that all executors see; it must be one that drops white space. Null and empty texts are one
    piece with the end id alone. Rows that repeat a doc_id are packed each for itself; null doc_ids stay null. Other columns are
    ignored, whatever their names. No rows: no rows. The same splits of the input give the same sequences.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, task int, nth long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return rows.mapInArrow(packer(vocabulary, end_id, tiers, pool_tokens, to_arrow_schema(StructType.fromDDL(schema))), schema)


def with_steps(pieces: DataFrame, scratch: Scratch, step_tokens: int = 1 << 16) -> DataFrame:
    """Adds step: sequences of one window, in order of their tasks, form steps of step_tokens tokens; a window's last step may be smaller.

    pieces: what pack() gives, written, with or without ids. Sequences are counted by task; one row a task and window is all that is
    ordered and joined. No rows: no rows.
    """
    sums = pieces.groupBy("window", "task").agg((F.max("nth") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("window").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.save(sums.select("window", "task", before.alias("before")), "starts")
    group = F.floor((F.col("before") + F.col("nth")) / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("window"))))
    return pieces.join(starts, ["window", "task"]).withColumn("step", (group * 64 + F.log2(F.col("window").cast("double")).cast("int")).cast("long")).drop("before")
