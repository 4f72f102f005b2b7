"""SimHash near-duplicates with vantage-point trees.

Distinct fingerprints are what is compared: copies share one. A vantage-point tree over a bounded sample of them splits
the Hamming space into shards: each inner node has a vantage point and a radius, a fingerprint lives in the leaf that its
distances lead to and is also sent, as a query, to every leaf that the triangle inequality can't rule out for the linking
distance. Inside a shard the same bound prunes recursively, in numpy blocks. A shard returns a spanning forest of its
links and not the links, so that a dense group costs one edge a member. Components of the forests are found over the
whole table.

Texts that share most of their words but not nearly all are farther apart than such a search can reach at scale. For them
a document also has fingerprints of samples: SimHashes of a few of its shingles, drawn min-wise, so that similar documents
draw the same ones. Documents that meet in a fingerprint of either kind are compared by their whole sets of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintra.llm.common import LOWER_BYTES, Scratch, connected_components, free

#: Shingles hashed at once, so that memory doesn't grow with a text's length beyond its words.
BLOCK = 1 << 16
#: Odd multiplier that mixes hashes (a fixed value).
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pairs compared at once.
PAIRS = 1 << 20


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 with seed 42 of the text's word shingles, repeats included, in blocks. Fewer words make one shingle, none none."""
    words = (text or b"").translate(LOWER_BYTES).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, hash64 = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    for k in range(0, n, BLOCK):
        yield np.fromiter((hash64(joined[a:b], 42) for a, b in zip(first[k : k + BLOCK], last[k : k + BLOCK], strict=True)), np.uint64)


def majority(blocks: list[np.ndarray]) -> int:
    """A bit is 1 if set in over half of the hashes; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text in UTF-8; 0 without words."""
    return majority(list(shingle_hashes(text, shingle)))


def sample_fingerprints(hashes: np.ndarray, samples: int, picks: int) -> list[int]:
    """SimHashes of `samples` samples of so many shingles, drawn min-wise under one order of all hashes for each pick."""
    out = []
    for k in range(samples):
        drawn = []
        for seed in range(k * picks, (k + 1) * picks):
            mixed = (hashes ^ np.uint64(xxhash.xxh64_intdigest(b"%d" % seed))) * MIX
            drawn.append(hashes[np.argmin((mixed ^ (mixed >> np.uint64(32))) * MIX)])
        out.append(majority([np.array(drawn, np.uint64)]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """A vantage-point tree whose leaves are shards. Built on a sample, it sends any fingerprint."""

    def __init__(self, sample: np.ndarray, leaves: int, reach: int):
        self.reach, self.nodes, self.leaves = reach, [], 0
        self._grow(sample, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        cut = self._cut(x) if leaves > 1 and len(x) >= 8 else None
        if cut is None:
            self.nodes[at] = (self.leaves,)
            self.leaves += 1
        else:
            v, radius, d = cut
            inner = d <= radius
            share = min(leaves - 1, max(1, round(leaves * inner.mean())))
            self.nodes[at] = (v, radius, self._grow(x[inner], share), self._grow(x[~inner], leaves - share))
        return at

    def _cut(self, x: np.ndarray) -> tuple | None:
        """The vantage point and radius that leave the fewest within reach of the border, among balanced ones."""
        best = None
        for v in x[np.linspace(0, len(x) - 1, 16).astype(int)]:
            d = hamming(x, v).astype(np.int64)
            seen = np.bincount(d, minlength=66).cumsum() / len(x)
            for radius in np.flatnonzero((seen >= 0.25) & (seen <= 0.75)):
                near = seen[min(65, radius + self.reach)] - (seen[radius - self.reach] if radius >= self.reach else 0)
                # work left by the split: what each side holds times what is asked of it
                work = seen[radius] * seen[min(65, radius + self.reach)] + (1 - seen[radius]) * (1 - (seen[radius - self.reach] if radius >= self.reach else 0)) + 0.1 * near
                if best is None or work < best[0]:
                    best = (work, v, int(radius), d)
        return best and best[1:]

    def send(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for each leaf that may hold something within reach of a row; home: it lives there."""
        rows, leaves, homes = [], [], []
        todo = [(0, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if len(self.nodes[node]) == 1:
                rows.append(at)
                leaves.append(np.full(len(at), self.nodes[node][0]))
                homes.append(home)
                continue
            v, radius, inner, outer = self.nodes[node]
            d = hamming(x[at], v).astype(np.int64)
            a, b = d - self.reach <= radius, d + self.reach > radius
            todo += [(inner, at[a], home[a] & (d[a] <= radius)), (outer, at[b], home[b] & (d[b] > radius))]
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(y) if y else empty for y in (rows, leaves, homes))


class Forest:
    """Union-find over 0..n-1, in blocks of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (nxt := self.up[r]).tobytes() != r.tobytes():
            r = nxt
        self.up[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.up, a, b)


def near_pairs(q: np.ndarray, x: np.ndarray, fp: np.ndarray, reach: int, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of q and x whose fingerprints are within reach. A vantage point of x splits both into shells by distance;
    a shell of q meets the shells of x within reach of it."""
    if len(q) * len(x) <= PAIRS // 4 or level > 12:
        step = max(1, PAIRS // max(1, len(x)))
        for k in range(0, len(q), step):
            i, j = np.nonzero(hamming(fp[q[k : k + step], None], fp[None, x]) <= reach)
            yield q[k : k + step][i], x[j]
        return
    v = fp[x[len(x) * (level * 5 % 13) // 13]]
    dq, dx = hamming(fp[q], v).astype(np.int64), hamming(fp[x], v).astype(np.int64)
    q, x = q[np.argsort(dq, kind="stable")], x[np.argsort(dx, kind="stable")]
    q_end, x_end = np.bincount(dq, minlength=66).cumsum(), np.bincount(dx, minlength=66).cumsum()
    for d in np.unique(dq):
        lo, hi = d - reach, min(65, d + reach)
        part = x[x_end[lo - 1] if lo > 0 else 0 : x_end[hi]]
        if len(part):
            yield from near_pairs(q[q_end[d - 1] if d else 0 : q_end[d]], part, fp, reach, level + 1)


def shard_links(fp: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, root) pairs, of the links between the shard's own rows and all that were sent to it."""
    forest = Forest(len(fp))
    for i, j in near_pairs(np.arange(len(fp)), np.flatnonzero(home), fp, reach):
        forest.join(i, j)
    roots = forest.roots(np.arange(len(fp)))
    linked = roots != np.arange(len(fp))
    return fp[linked], fp[roots[linked]]


def links(known: DataFrame, scratch: Scratch, reach: int, shard_rows: int = 16384, leaf_sample: int = 16, least_sample: int = 50_000) -> DataFrame:
    """(a, b): a spanning forest of the links of `reach` bits or fewer between distinct fingerprints (fp).

    shard_rows: fingerprints that a shard is meant to hold; a shard with more than four times as many is split by hash, and
    what is sent to it goes to every piece. The tree is built on the driver, on leaf_sample fingerprints for each leaf (8 bytes
    for each 1,024 fingerprints) and least_sample at least; it only shapes the shards, and any tree gives the same links.
    """
    n = known.count()
    leaves = max(1, -(-n // shard_rows))
    drawn = [] if leaves == 1 else known.select("fp").orderBy(F.xxhash64("fp")).limit(max(least_sample, leaf_sample * leaves)).toPandas()["fp"]
    tree = VantageTree(np.asarray(drawn, np.int64).view(np.uint64), leaves, reach)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shards, homes = tree.send(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), batch.column(0).take(pa.array(rows.astype(np.int64))), pa.array(homes.astype(bool))], names=["shard", "fp", "home"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)
        a, b = shard_links(fp, pdf["home"].to_numpy().astype(bool), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = known.select("fp").mapInArrow(send, "shard int, fp long, home boolean")
    if leaves == 1:
        return sent.groupBy("shard").applyInPandas(link, "a long, b long")
    sent = scratch.save(sent, "sent")
    pieces = sent.where("home").groupBy("shard").agg(F.ceil(F.count("*") / (4.0 * shard_rows)).cast("int").alias("pieces"))
    split = sent.join(scratch.save(pieces, "pieces"), "shard").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    split = split.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("pieces")) == F.col("piece")))
    return split.select("shard", "piece", "fp", "home").groupBy("shard", "piece").applyInPandas(link, "a long, b long")


def components(fps: DataFrame, scratch: Scratch, reach: int = 2, **options) -> DataFrame:
    """(fp, component_id) of (doc_id, fp): component_id is the smallest doc_id that links of `reach` bits or fewer lead to."""
    known = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "known")
    found = scratch.save(links(known, scratch, reach, **options), "links")
    roots = scratch.save(connected_components(scratch, found).withColumnRenamed("node", "fp"), "roots")
    firsts = scratch.save(roots.join(known, "fp").groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
    linked = scratch.save(roots.join(firsts, "root").select("fp", "component_id"), "linked")
    return scratch.save(known.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2, **options) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text).

    Null and empty texts have fingerprint 0, which links like any other. A null doc_id never names a component unless
    all of it are null. Repeated rows share their component. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.save(fingerprints(docs, shingle), "fps")
    return fps.join(components(fps, scratch, reach, **options), "fp").select("doc_id", "fp", "component_id")


def similar_links(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each of the sets (sorted and without repeats) the first one that links of a Jaccard similarity of least or more lead to."""
    forest, sizes = Forest(len(sets)), np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if both >= least * (sizes.sum() - both):
            forest.join(np.array([1]), np.array([0]))
        return forest.up
    codes, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, who = codes[order], who[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = np.cumsum(sizes)
    for i in range(1, len(sets)):
        # sets before this one that hold a shingle stand before it in the shingle's run
        at = place[ends[i - 1] : ends[i]]
        n = at - start[at]
        at, n = start[at][n > 0], n[n > 0]
        shared = np.bincount(who[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=i)
        near = np.flatnonzero(shared >= least * (sizes[i] + sizes[:i] - shared))
        forest.join(np.full(len(near), i), near)
    return forest.roots(np.arange(len(sets)))


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal values in the first column of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def classes(nodes: DataFrame, scratch: Scratch, most_rows: int, most_words: int, most_parts: int) -> tuple[DataFrame, DataFrame]:
    """(key, id): groups of nodes (id, words, keys) that agree in one of their keys, each of most_rows nodes and most_words words
    at most; and the ids of those whose groups are too large for all of them to meet there.

    A group of up to most_parts times as much is dealt into pieces by hash, and every two pieces make a group, so that all of its
    members still meet. A larger one is only dealt, the smallest to every part; crossed() finds what its members still lack.
    """
    now = scratch.save(nodes.select("id", "words", F.posexplode("keys").alias("t", "fp")).select("id", "words", F.xxhash64("t", "fp").alias("key")), "keys")
    sizes = now.groupBy("key").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("who")).where("n > 1")
    sizes = scratch.save(sizes.withColumn("parts", F.when(F.col("n") > 2, F.ceil(F.greatest(F.col("n") / most_rows, F.col("words") / most_words))).otherwise(1).cast("int")), "sizes")
    # of groups with the same members one is enough
    once = sizes.where("parts = 1").groupBy("n", "who").agg(F.min("key").alias("key")).select("key")
    whole = now.select("key", "id").join(once, "key")
    medium = now.join(sizes.where(F.col("parts").between(2, most_parts)).select("key", (2 * F.col("parts")).alias("pieces")), "key")
    medium = medium.select("key", "id", "pieces", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where("i <> j")
    pieces = medium.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "id")
    large = sizes.where(F.col("parts") > most_parts).select("key", "parts", "first")
    rest = scratch.save(now.join(large, "key").select("key", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long").alias("k")), "rest")
    firsts = large.select("key", F.col("first").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select("key", "id", F.col("k").cast("long").alias("k"))
    dealt = rest.unionAll(firsts).select(F.xxhash64("key", "k").alias("key"), "id").distinct()
    members = [scratch.save(x, name) for x, name in ((whole, "classes"), (pieces, "pieces"), (dealt, "dealt"))]
    return members[0].unionAll(members[1]).unionAll(members[2]), rest.select("id").distinct()


def crossed(sets: DataFrame, roots: DataFrame, scratch: Scratch, least: float, most_rows: int, most_words: int) -> DataFrame:
    """(key, id): groups, of about most_rows rows and most_words shingles, in which every two of the sets (id, set) whose similarity is
    least or more, and whose roots (node, root; without one a set is its own) differ, meet.

    Similar sets share at least ceil(least * size) shingles of either, so in any one order of all shingles they share one among the first
    size - ceil(least * size) + 1. The order is by rarity: shingles of one set only come first, and meet nobody. A shingle's sets of its
    most frequent root needn't meet each other; they are dealt into pieces that each meet every piece of the others, which also meet.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.frombuffer(x.as_buffer(), np.int64)
                for k in range(0, len(codes), BLOCK):
                    part = codes[k : k + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int64)), pa.array(np.full(len(part), len(codes), np.int64)), pa.array(part)], names=["id", "size", "h"])

    held = scratch.save(sets.mapInArrow(shingles, "id long, size long, h long"), "shingles")
    shared = scratch.save(held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    by_id = held.join(shared, "h").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("shared"))
    prefix = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("shared"))
    rare = by_id.select("id", "size", F.explode(F.slice("shared", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))["h"]).alias("h"))
    rare = scratch.save(rare.join(roots, F.col("id") == F.col("node"), "left").select("h", "id", "size", F.coalesce("root", "id").alias("root")), "rare")
    by_root = rare.groupBy("h", "root").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.bit_xor(F.xxhash64("id")).alias("who"))
    groups = by_root.groupBy("h").agg(F.max(F.struct("n", "root", "words")).alias("top"), F.sum("n").alias("n"), F.sum("words").alias("words"), F.bit_xor("who").alias("who"), F.count("*").alias("roots")).where("roots > 1")
    # of groups with the same members one is enough
    groups = groups.groupBy("n", "who").agg(F.min(F.struct("h", "top", "words")).alias("x")).select("n", "x.*")
    parts = lambda n, words: F.ceil(F.greatest(n / (most_rows / 2), words / (most_words / 2))).cast("int")
    groups = scratch.save(groups.select("h", F.col("top.root").alias("top"), parts(F.col("top.n"), F.col("top.words")).alias("a"), parts(F.col("n") - F.col("top.n"), F.col("words") - F.col("top.words")).alias("b")), "groups")
    dealt = rare.join(groups, "h").select("h", "id", (F.col("root") == F.col("top")).alias("inner"), F.pmod(F.xxhash64("id"), "a").cast("int").alias("i"), F.pmod(F.xxhash64("id"), "b").cast("int").alias("j"), "a", "b")
    to_all = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inner = F.transform(to_all("b"), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
    outer = F.concat(F.transform(to_all("a"), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"))), F.transform(F.array_remove(to_all("b"), F.col("j")), lambda k: F.struct((-1 - F.least("j", k)).alias("i"), F.greatest("j", k).alias("j"))))
    return scratch.save(dealt.select("h", "id", F.explode(F.when(F.col("inner"), inner).otherwise(outer)).alias("x")).select(F.xxhash64("h", "x.i", "x.j").alias("key"), "id"), "crossed")


def near_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, samples: int = 8, picks: int = 3, reach: int = 2, class_rows: int = 2048, class_words: int = 2_000_000, class_parts: int = 8) -> DataFrame:
    """(doc_id, keep_id) for each row of docs (doc_id, text) with a doc_id: the smallest doc_id that links lead to, or its own.

    Documents link if the Jaccard similarity of their sets of `shingle`-word shingles is least or more; equal words are equal
    texts, those without words too. They are compared if their SimHashes are within reach (or lead to each other so), or if they
    share the SimHash of a sample, `picks` shingles each: of pairs at a similarity s, 1 - (1 - s**picks)**samples do, 99.7 % at
    0.8 and more beyond. Members of groups too large to compare meet by their rarest shingles, all similar ones of them (see crossed).
    Rows that repeat a doc_id with other texts count with one of them. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, words, fps, drawn = [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                digests.append(hashlib.md5(b" ".join((t or b"").translate(LOWER_BYTES).split())).digest())
                blocks = list(shingle_hashes(t, shingle))
                words.append(sum(map(len, blocks)))
                fps.append(majority(blocks))
                drawn.append(np.array(sample_fingerprints(np.concatenate(blocks), samples, picks) if blocks else [0] * samples, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(words, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(drawn, pa.list_(pa.int64()))], names=["doc_id", "digest", "words", "fp", "samples"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, t, digest in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                # a row that repeats a doc_id may hold another text
                if hashlib.md5(b" ".join((t or b"").translate(LOWER_BYTES).split())).digest() == digest:
                    ids.append(i)
                    found.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t, shingle)])).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["id", "set"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches):
            ids = group.column(1).to_numpy()
            roots = ids[similar_links([np.frombuffer(x, np.uint64) for x in group.column(2).to_pylist()], least)]
            linked = roots != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(roots[linked])], names=["a", "b"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(texts.mapInArrow(run, "doc_id long, digest binary, words long, fp long, samples array<long>"), "rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("words").alias("words"), F.first("fp").alias("fp"), F.first("samples").alias("samples"))
    nodes = scratch.save(firsts.groupBy("id").agg(F.min(F.struct("digest", "words", "fp", "samples")).alias("x")).select("id", "x.*"), "nodes")
    whole = components(nodes.select(F.col("id").alias("doc_id"), "fp"), scratch, reach)
    keyed = scratch.save(nodes.join(whole, "fp").select("id", "words", F.concat(F.array("component_id"), F.col("samples")).alias("keys")), "keyed")
    members, crowd = classes(keyed, scratch, class_rows, class_words, class_parts)
    wanted = members.select("id").distinct().join(nodes.select("id", "digest"), "id")
    made = texts.join(wanted, F.col("doc_id") == F.col("id")).select("id", "text", "digest").mapInArrow(sets, "id long, set binary")
    made = scratch.save(made.dropDuplicates(["id"]), "sets")
    compared = lambda groups: groups.join(made, "id").select("key", "id", "set").repartition("key").sortWithinPartitions("key", "id").mapInArrow(link, "a long, b long")
    similar = scratch.save(compared(members), "similar")
    roots = scratch.save(connected_components(scratch, similar), "roots")
    if crowd.limit(1).count():
        more = scratch.save(compared(crossed(made.join(crowd, "id"), roots, scratch, least, class_rows, class_words)), "similar")
        roots = connected_components(scratch, similar.unionAll(more))
    named = scratch.save(nodes.join(roots, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("keep_id")), "named")
    return rows.join(named, "digest", "left").select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their group (see near_groups), with all their columns; rows with a null doc_id stay.

    Rows that repeat a doc_id stay or go together. No rows: no rows.
    """
    gone = near_groups(docs, **options).groupBy("doc_id").agg(F.min("keep_id").alias("keep_id")).where("keep_id <> doc_id").select(F.col("doc_id").alias(free("gone_id", docs)))
    gone = Scratch(docs.sparkSession).save(gone, "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone[gone.columns[0]], "left_anti")


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
