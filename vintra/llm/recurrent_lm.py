"""Log-likelihood of whole documents under a gated recurrent language model.

Counts of all training tokens are gathered over the corpus. The most frequent words form the model's own vocabulary, in
classes by frequency; all other words are one class. The output is factored: a softmax over classes, and one over the
words of a class; inside the class of other words a word has its add-one share of counts. So every token, a never-seen
one too, has a probability, and before training the model equals the add-one unigram model.

Training is truncated backpropagation in numpy, in rounds: the training documents are dealt to the rounds and each round's to
trainers, all of which start from the same weights; their weights are averaged in Spark for the next round. So every document is learnt from
once, and weights meet often enough to stay close. Scoring deals documents to lanes of about equal length, which run side by side;
a document's state is carried to its end. Texts are read twice, for the counts and to become numbers, which are written.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintra.llm.common import Scratch

#: The end of a document as a token: no word is empty.
END = b""
#: Documents scored side by side, tokens that share an output layer, bytes of texts, or of word numbers, that are worked on
#: together, and partial counts that a task holds.
SIDE, LAYER, PART, HELD = 256, 4096, 1 << 23, 400_000
LOG10 = float(np.log(10.0))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one array of bytes, and how many each text has; A-Z are lower-cased, nulls have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    counts, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().cast(pa.binary())
    # white space at the ends of a text leaves empty words
    real = pc.not_equal(pc.binary_length(words), 0)
    of = np.repeat(np.arange(len(texts)), counts)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real), np.bincount(of, minlength=len(texts))


def parts_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most PART bytes in a column, or one row."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(sizes):
            upto = max(at + 1, int(np.searchsorted(sizes, PART + (sizes[at - 1] if at else 0), side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token binary, n long) over all (text) rows; the end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = lambda held: pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])
        held: list[pa.Table] = []
        for part in parts_of(batches, "text"):
            words, _ = words_of(part.column("text"))
            found = pc.value_counts(words)
            held.append(pa.table({"token": pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())]), "n": pa.concat_arrays([found.field("counts"), pa.array([len(part)], pa.int64())])}))
            if sum(map(len, held)) > HELD:
                held = [merged(held)]
                if len(held[0]) > HELD // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged(held).to_batches()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """index: rows of the frequent words in place (the model's own number, or its size for the class of others) and count; the
    last row stands for all words that index lacks. w: weights by name."""

    index: dict[bytes, int]
    place: np.ndarray
    count: np.ndarray
    starts: np.ndarray
    other_mass: float
    total: float
    w: dict[str, np.ndarray]

    @property
    def known(self) -> dict[bytes, tuple[int, int]]:
        """Number and count of each frequent word."""
        return {t: (int(self.place[k]), int(self.count[k])) for t, k in self.index.items()}

    @property
    def size(self) -> int:
        return len(self.w["word_bias"])

    @property
    def kind(self) -> type:
        """Of word numbers as they are written."""
        return np.uint16 if self.size < 1 << 16 else np.int32


def new_model(top: list[tuple[bytes, int]], tokens: int, distinct: int, own: int, hidden: int, classes: int) -> Model:
    """top: (token, count) by falling count, and the end. Biases make it the add-one unigram model."""
    head = [x for x in top if x[0] != END][: own - 1]
    head = sorted([*head, next((x for x in top if x[0] == END), (END, 0))], key=lambda x: (-x[1], x[0]))
    place = {t: k for k, (t, _) in enumerate(head)}
    known = dict([*top, *(x for x in head if x[0] == END)])
    places = np.array([*(place.get(t, len(head)) for t in known), len(head)], np.int32)
    counts = np.array([*known.values(), 0], float)
    mass = np.array([n + 1.0 for _, n in head])
    # classes of equal sums of square roots: the frequent words' classes are small, so a token costs few exponentials
    roots = np.cumsum(np.sqrt(mass))
    starts = np.unique([0, *(np.searchsorted(roots, roots[-1] * np.arange(1, min(classes, len(head))) / min(classes, len(head))) + 1).tolist(), len(head)])
    # an end that the corpus doesn't have takes the mass of an unseen token
    total = float(tokens + distinct + 1 + (0 if any(t == END for t, _ in top) else 1))
    other = max(1.0, total - mass.sum())
    class_mass = np.array([*np.add.reduceat(mass, starts[:-1]), other])
    rng = np.random.default_rng(11)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    word_bias = np.log(mass) - np.log(np.repeat(class_mass[:-1], np.diff(starts)))
    w = {"input": small(len(head) + 1, 3 * hidden), "state": small(hidden, 3 * hidden), "bias": np.zeros(3 * hidden, np.float32), "class": np.zeros((len(starts), hidden), np.float32), "class_bias": np.log(class_mass / class_mass.sum()).astype(np.float32), "word": np.zeros((len(head), hidden), np.float32), "word_bias": word_bias.astype(np.float32)}
    w["bias"][:hidden] = 1.0
    return Model({t: k for k, t in enumerate(known)}, places, counts, starts, other, total, w)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of x, which is overwritten."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def step(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, and what its gradient needs. Each gate's product lies in one piece, row by row."""
    k = h.shape[1]
    g = np.matmul(h, w["state"].reshape(k, 3, k).transpose(1, 0, 2))
    x = x.reshape(-1, 3, k).transpose(1, 0, 2)
    zr = g[:2]
    zr += x[:2]
    z, r = sigmoid(zr)
    n = r * g[2]
    n += x[2]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, g[2]


def by_word(y: np.ndarray, size: int) -> np.ndarray:
    """The stable order of word numbers up to size; numbers of two bytes are sorted by their digits."""
    return np.argsort(y.astype(np.uint16) if size < 1 << 16 else y, axis=None, kind="stable")


def joined(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Output weights beside their biases, which are weights of a state that is always 1."""
    return {n: np.concatenate([w[n], w[f"{n}_bias"][:, None]], axis=1) for n in ("class", "word")}


def apart(both: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Views of what joined() has put together."""
    return {k: v for n, of in both.items() for k, v in ((n, of[:, :-1]), (f"{n}_bias", of[:, -1]))}


def unsafe(logits: np.ndarray) -> bool:
    """Whether the exponentials of a row could overflow or all vanish."""
    return logits.size > 0 and (logits.max() > 60 or logits.min() < -60)


def output(m: Model, h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None, by: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of tokens y (the size for the class of others) after states h; with grads, adds to them and
    returns the gradient by h. by: joined() weights, if they are at hand. Gradients are divided by a row's total after the products."""
    w, last, k = m.w, len(m.starts) - 1, h.shape[1]
    by = by or joined(w)
    # sorted by word, so that each class is one slice
    order = by_word(y, m.size)
    y, ones = y[order], np.ones((len(h), k + 1), h.dtype)
    ones[:, :k] = h
    h = ones.take(order, 0)
    ends = np.append(np.searchsorted(y, m.starts), len(y))
    of = np.repeat(np.arange(last + 1), np.diff(ends))
    p = h @ by["class"].T
    own_class = np.arange(len(y)) * (last + 1) + of
    out = p.take(own_class)
    if unsafe(p):
        shift = p.max(axis=1)
        p -= shift[:, None]
        out -= shift
    np.exp(p, out=p)
    total = p @ np.ones(last + 1, p.dtype)
    out -= np.log(total)
    dh = None
    if grads is not None:
        p.ravel()[own_class] -= total
        np.reciprocal(total, out=total)
        by_class = p.T @ (h * total[:, None])
        grads["class"] += by_class[:, :-1]
        grads["class_bias"] += by_class[:, -1]
        dh = p @ w["class"]
        dh *= total[:, None]
    own = ends[last]
    if own:
        # the logits of all rows inside their classes, one after the other
        widths = np.diff(m.starts)[of[:own]]
        first = np.cumsum(widths) - widths
        at = first + (y[:own] - m.starts[of[:own]])
        logits = np.empty(first[-1] + widths[-1], p.dtype)
        # of each class that occurs: its rows, its words and its part of the logits
        parts = [(slice(i, j), slice(a, b), logits[first[i] : first[i] + (j - i) * (b - a)].reshape(j - i, b - a)) for i, j, a, b in zip(*(x.tolist() for x in (ends[:-2], ends[1:-1], m.starts[:-1], m.starts[1:])), strict=True) if i < j]
        for rows, words, q in parts:
            np.matmul(h[rows], by["word"][words].T, out=q)
        out[:own] += logits.take(at)
        if unsafe(logits):
            shift = np.maximum.reduceat(logits, first)
            logits -= np.repeat(shift, widths)
            out[:own] -= shift
        np.exp(logits, out=logits)
        total = np.add.reduceat(logits, first)
        out[:own] -= np.log(total)
        if grads is not None:
            logits[at] -= total
            np.reciprocal(total, out=total)
            shares, found, back = h[:own] * total[:, None], np.zeros_like(by["word"]), np.empty((own, k), dh.dtype)
            for rows, words, q in parts:
                np.matmul(q, w["word"][words], out=back[rows])
                np.matmul(q.T, shares[rows], out=found[words])
            back *= total[:, None]
            dh[:own] += back
            grads["word"] += found[:, :-1]
            grads["word_bias"] += found[:, -1]
    back = np.empty_like(order)
    back[order] = np.arange(len(y))
    return out[back], None if dh is None else dh[back]


def summed_runs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at first: long runs as products, of which most rows are; of the others all second
    rows together, all third ones, and so on."""
    counts = np.diff(first, append=len(rows))
    out, long = np.empty((len(first), rows.shape[1]), rows.dtype), counts > 16
    ones = np.ones(counts.max(initial=0), rows.dtype)
    for i in np.flatnonzero(long):
        np.matmul(ones[: counts[i]], rows[first[i] : first[i] + counts[i]], out=out[i])
    few = np.flatnonzero(~long)
    few = few[np.argsort(-counts[few], kind="stable")]
    at, sums = first[few], rows.take(first[few], 0)
    # as many runs have more than k rows
    more = np.searchsorted(-counts[few], -np.arange(1, 17))
    for k, n in enumerate(more.tolist(), 1):
        if not n:
            break
        sums[:n] += rows.take(at[:n] + k, 0)
    out[few] = sums
    return out


def train(m: Model, docs: list[np.ndarray], rate: float, streams: int = 384, window: int = 8, passes: int = 1) -> dict[str, np.ndarray]:
    """The weights after passes over documents (word numbers without the end), by Adagrad over windows; streams of
    documents run side by side, states carry over from window to window and start anew at each document. The rate falls
    to a fifth in the end. Nothing but the rate of a window looks at the amount of text; fewer tokens than streams are that many streams."""
    end = m.place[m.index[END]]
    flow = np.concatenate([np.concatenate([d, [end]]) for d in docs]) if docs else np.zeros(0, np.int32)
    if len(flow) < 2:
        return m.w
    flow = np.tile(flow, passes)
    streams = min(streams, len(flow))
    # what the streams don't share equally is learnt as an end
    width = -(-len(flow) // streams)
    y = np.concatenate([flow, np.full(width * streams - len(flow), end, flow.dtype)]).reshape(streams, width).T.copy()
    x = np.vstack([np.full((1, streams), end, y.dtype), y[:-1]])
    w, by = {k: v.copy() for k, v in m.w.items()}, joined(m.w)
    w |= apart(by)
    m, learnt = replace(m, w=w), {"state": w["state"], "bias": w["bias"], **by}
    seen = {k: np.full_like(v, 1e-3) for k, v in (learnt | {"input": w["input"]}).items()}
    k = w["state"].shape[0]
    h = np.zeros((streams, k), np.float32)
    for t0 in range(0, width, window):
        xs, ys = x[t0 : t0 + window], y[t0 : t0 + window]
        # the window's words, of which alone the inputs have a gradient, and where they stand
        order = by_word(xs, m.size)
        ordered = xs.ravel()[order]
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        words, at = ordered[first], np.empty_like(order)
        at[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        at, of_words = at.reshape(xs.shape), w["input"].take(words, 0)
        grads = {name: np.zeros_like(v) for name, v in learnt.items()}
        inputs, kept, states, befores = of_words + w["bias"], [], np.empty((*xs.shape, k), np.float32), np.empty((*xs.shape, k), np.float32)
        new = xs == end
        for t in range(len(xs)):
            befores[t] = h
            befores[t, new[t]] = 0
            h, *gates = step(w, inputs.take(at[t], 0), befores[t])
            kept.append(gates)
            states[t] = h
        _, dh = output(m, states.reshape(-1, k), ys.ravel(), apart({n: grads[n] for n in by}), by)
        dh = dh.reshape(len(xs), streams, k)
        back, das = np.zeros_like(h), np.empty((*xs.shape, 3, k), inputs.dtype)
        da = np.empty((streams, 3, k), inputs.dtype)
        for t in range(len(xs) - 1, -1, -1):
            z, r, n, gn = kept[t]
            d = dh[t]
            d += back
            rest = 1 - z
            dn = d * rest
            dz = befores[t] - n
            dz *= d
            dz *= z
            np.multiply(dz, rest, out=da[:, 0])
            n *= n
            np.subtract(1, n, out=n)
            dn *= n
            da[:, 2] = dn
            np.multiply(dn, gn, out=gn)
            gn *= r
            np.subtract(1, r, out=rest)
            np.multiply(gn, rest, out=da[:, 1])
            das[t] = da
            np.multiply(dn, r, out=da[:, 2])
            grads["state"] += befores[t].T @ da.reshape(streams, 3 * k)
            back = da.reshape(streams, 3 * k) @ w["state"].T
            d *= z
            back += d
            back[new[t]] = 0
        grads["input"] = summed_runs(das.reshape(-1, 3 * k).take(order, 0), first)
        grads["bias"] = grads["input"].sum(axis=0)
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / ys.size
        scale = np.float32((1.0 / ys.size) * min(1.0, 1.0 / max(norm, 1e-9)))
        now = np.float32(rate * (1 - 0.8 * t0 / width))
        for name, g in grads.items():
            g *= scale
            squares = g * g
            squares += seen["input"].take(words, 0) if name == "input" else seen[name]
            if name == "input":
                seen[name][words] = squares
            else:
                seen[name][...] = squares
            g /= np.sqrt(squares, out=squares)
            g *= now
            if name == "input":
                of_words -= g
                w[name][words] = of_words
            else:
                learnt[name] -= g
    return w


def score_many(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each document (word numbers without the end), to its end; what the class of others holds
    inside is left to the caller. Documents run in lanes of about equal length, one after the other; each begins with a new state."""
    end, k = m.place[m.index[END]], m.w["state"].shape[0]
    lanes: list[list[int]] = [[] for _ in range(min(SIDE, len(docs)))]
    lengths, heap = np.array([len(d) + 1 for d in docs], np.int64), [(0, j) for j in range(len(lanes))]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, j = heap[0]
        lanes[j].append(i)
        heapq.heapreplace(heap, (n + int(lengths[i]), j))
    # by falling length, so that at each step the lanes that aren't over are the first ones
    lanes.sort(key=lambda lane: -int(lengths[lane].sum()))
    sums, dealt = np.array([lengths[lane].sum() for lane in lanes], np.int64), np.array([i for lane in lanes for i in lane], np.int64)
    # an end stands before each lane, and after each document
    flow, logs, begins = (np.full(lengths.sum() + len(lanes), x, kind) for x, kind in ((end, np.int32), (0, float), (False, bool)))
    starts = np.cumsum(lengths[dealt]) - lengths[dealt] + np.repeat(np.arange(1, len(lanes) + 1), [len(lane) for lane in lanes])
    begins[starts - 1] = True
    for i, at in zip(dealt.tolist(), starts.tolist(), strict=True):
        flow[at : at + len(docs[i])] = docs[i]
    first = np.cumsum(sums + 1) - sums - 1
    inputs, by, h = m.w["input"] + m.w["bias"], joined(m.w), np.zeros((len(lanes), k), np.float32)
    t0, longest = 0, int(sums.max(initial=0))
    while t0 < longest:
        live = int(np.searchsorted(-sums, -t0))
        steps = np.arange(t0, min(t0 + -(-LAYER // live), longest))
        lasts = np.searchsorted(-sums, -steps)
        ends = np.cumsum(lasts)
        at = first[np.arange(ends[-1]) - np.repeat(ends - lasts, lasts)] + np.repeat(steps, lasts)
        x, states = flow[at], np.empty((len(at), k), np.float32)
        new = np.flatnonzero(begins[at])
        upto = np.searchsorted(new, ends).tolist()
        a = c = 0
        for b, d in zip(ends.tolist(), upto, strict=True):
            h = h[: b - a]
            if c < d:
                h = h.copy()
                h[new[c:d] - a] = 0
            h = states[a:b] = step(m.w, inputs.take(x[a:b], 0), h)[0]
            a, c = b, d
        logs[at + 1] = output(m, states, flow[at + 1], by=by)[0]
        t0 += len(steps)
    out = np.zeros(len(docs))
    if len(docs):
        out[dealt] = np.add.reduceat(logs, starts)
    return out


def averaged(rows: DataFrame, m: Model, trainers: int, rate: float, options: dict, pieces: int = 64, block: int = 1024) -> dict[str, np.ndarray]:
    """Weights after each trainer's run over its rows (doc_id, ids), averaged in Spark piece by piece, first within blocks of trainers. A document's
    trainer is a hash of its id and words."""
    held = rows.sparkSession.sparkContext.broadcast(m)
    names = list(m.w)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = held.value
        texts = sorted(pdf["ids"])
        rng = np.random.default_rng(5)
        got = train(mine, [np.frombuffer(texts[i], mine.kind) for i in rng.permutation(len(texts))], rate, **options)
        flat = np.concatenate([got[n].ravel() for n in names]).astype(np.float32)
        return pd.DataFrame({"piece": range(pieces), "block": int(pdf["trainer"].iloc[0]) // block, "n": 1, "part": [p.tobytes() for p in np.array_split(flat, pieces)]})

    def summed(kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: pd.DataFrame({"piece": pdf["piece"][:1], "block": pdf["block"][:1], "n": [pdf["n"].sum()], "part": [np.sum([np.frombuffer(p, kind) for p in pdf["part"]], axis=0, dtype=float).tobytes()]})

    schema = "piece int, block long, n long, part binary"
    # a number of partitions that is given isn't lowered for their small size: a trainer works long on few bytes
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(trainers)).alias("trainer"), "ids").repartition(2 * trainers, "trainer")
    parts = dealt.groupBy("trainer").applyInPandas(run, schema)
    sums = parts.groupBy("piece", "block").applyInPandas(summed(np.float32), schema).groupBy("piece").applyInPandas(summed(np.float64), schema)
    rows = {r["piece"]: (np.frombuffer(r["part"]) / r["n"]).astype(np.float32) for r in sums.collect()}
    if not rows:
        return m.w
    flat, at, out = np.concatenate([rows[k] for k in range(pieces)]), 0, {}
    for n in names:
        out[n] = flat[at : at + m.w[n].size].reshape(m.w[n].shape).copy()
        at += m.w[n].size
    return out


def untrained(counts: DataFrame, own: int, hidden: int, classes: int, frequent: int) -> tuple[Model, int, int]:
    """(the model before training, training tokens, distinct ones)."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least count of which no more tokens than `frequent` are: whole levels are taken, so that nothing has to be ordered
    held, least = 0, None
    for n, k in sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True):
        if (held := held + k) > frequent:
            break
        least = n
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    top = sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))
    if all(t != END for t, _ in top):  # a corpus with so many words more frequent than its end
        top += [(bytes(r["token"]), r["n"]) for r in counts.where(F.length("token") == 0).collect()]  # one row at most
    return new_model(top, tokens, distinct, own, hidden, classes), tokens, distinct


def learn(encoded: DataFrame, m: Model, tokens: int, trainer_tokens: int, rates: tuple[float, ...], **options) -> dict[str, np.ndarray]:
    """Weights from training rows (doc_id, ids), which have so many tokens: one round for each rate, over its share of the rows.

    trainer_tokens: about as many for a trainer in a round; the number of trainers grows with the rows.
    """
    trainers = max(1, round(tokens / trainer_tokens / len(rates)))
    for k, rate in enumerate(rates):
        share = encoded.where(F.pmod(F.xxhash64("ids", "doc_id"), F.lit(len(rates))) == k)
        m = replace(m, w=averaged(share, m, trainers, rate, options))
    return m.w


def log_likelihoods(docs: DataFrame, train_docs: Column, own: int = 2048, hidden: int = 24, classes: int = 32, frequent: int = 200_000, trainer_tokens: int = 800_000, rates: tuple[float, ...] = (0.8, 0.5, 0.3), **options) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    train_docs: a condition on docs; rows that meet it are learnt from. Tokens: words with A-Z lower-cased, and one end, so
    that null and empty texts have one token. base_score: log10 probability under add-one counts; score: under the model.
    n_known: tokens that the training rows have. Repeated rows are learnt and scored as often as they occur. Without
    training rows every token has probability 1 under the counts.

    own: words of the model's own. frequent: words whose counts tasks hold, at most. rates: of the rounds, see learn(); options: of train().
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train_docs.alias("learnt"))
    counts = scratch.save(count_tokens(rows.where("learnt")), "counts")
    start, tokens, distinct = untrained(counts, own, hidden, classes, frequent)
    first = spark.sparkContext.broadcast(start)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = first.value
        frequent, logs = pa.array(model.index, pa.binary()), np.log10(model.count + 1)
        end, other, kind = model.index[END], np.log10(model.other_mass), np.dtype(model.kind)
        for batch in parts_of(batches, "text"):
            words, n = words_of(batch.column("text"))
            ends = np.append(0, np.cumsum(n))
            at = pc.index_in(words, value_set=frequent)
            far = at.is_null()
            # the last row stands for words that aren't frequent
            at = at.fill_null(len(frequent)).to_numpy()
            place, log, of = model.place[at], logs[at], np.repeat(np.arange(len(n)), n)
            summed = lambda x, of=of, n=n: np.bincount(of, x, len(n))
            far_ends = np.append(0, np.cumsum(np.bincount(of[far.to_numpy(zero_copy_only=False)], minlength=len(n))))
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(place.astype(kind))])
            known = summed(model.count[at] > 0).astype(np.int64) + int(model.count[end] > 0)
            inside = summed((log - other) * (place == model.size))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "learnt", "row")), ids, pa.array(n + 1, pa.int64()), pa.array(known), pa.array(summed(log) + logs[end]), pa.array(inside), pa.ListArray.from_arrays(pa.array(far_ends, pa.int32()), words.filter(far))],
                names=["doc_id", "learnt", "row", "ids", "n_tokens", "known", "base", "inside", "far"],
            )

    schema = "doc_id long, learnt boolean, row long, ids binary, n_tokens long, known long, base double, inside double, far array<binary>"
    encoded = scratch.save(rows.select("doc_id", "text", "learnt", F.monotonically_increasing_id().alias("row")).mapInArrow(encode, schema), "encoded")
    weights = learn(encoded.where("learnt").select("doc_id", "ids"), start, tokens, trainer_tokens, rates, **options)
    held = spark.sparkContext.broadcast(replace(start, w=weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = held.value.kind
        for batch in parts_of(batches, "ids"):
            states = score_many(held.value, [np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")]) / LOG10
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "learnt", "row", "n_tokens", "known", "base")), pa.array(states + batch.column("inside").to_numpy())], names=["doc_id", "learnt", "row", "n_tokens", "known", "base", "states"])

    scored = encoded.select("doc_id", "learnt", "row", "ids", "n_tokens", "known", "base", "inside").mapInArrow(score, "doc_id long, learnt boolean, row long, n_tokens long, known long, base double, states double")
    far = encoded.select("row", F.explode("far").alias("token")).join(counts, "token").groupBy("row").agg(F.count("*").alias("far_known"), F.sum(F.log10(F.col("n") + 1)).alias("far_log"))
    out = scratch.save(scored, "scored").join(far, "row", "left")
    far_log = F.coalesce("far_log", F.lit(0.0))
    return out.select(
        "doc_id", "learnt", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + far_log - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"), (F.col("states") + far_log).alias("score"),
    )
