"""Exact, near and line duplicates and decontamination against brute force."""

import random
import re
import uuid
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from vintra.llm import decontamination, exact_dedup, line_dedup, queries, simhash
from vintra.llm.common import Scratch, connected_components, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def components(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    fp = {d: plain_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = components(sorted(fp), pairs)
    got = queries.op9_simhash(spark, small).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


@pytest.mark.parametrize(("shard_rows", "leaf_sample"), [(100, 16), (20, 1), (10_000, 16)])
def test_vantage_trees_lose_no_link(spark, shard_rows, leaf_sample):
    reach = 2
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(400)}
    for x in list(fps)[:200]:
        for _ in range(4):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, reach + 2))))
    order = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    a = np.array(order, np.int64).view(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= reach
    want = components(range(len(order)), [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    known = spark.createDataFrame([(x,) for x in order], "fp long")
    got = simhash.links(known, Scratch(spark), reach, shard_rows, leaf_sample, least_sample=8).collect()  # few samples: leaves over the bound
    at = {x: k for k, x in enumerate(order)}
    assert components(range(len(order)), [(at[r["a"]], at[r["b"]]) for r in got]) == want
    assert len(got) <= 60 * len(order)  # forests, not all pairs


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    want = components(sorted({x for p in pairs for x in p if p[0] != p[1]}), [p for p in pairs if p[0] != p[1]])
    got = connected_components(Scratch(spark), spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert connected_components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(rows):
    words = {d: WORD.findall(lower(t)) for d, t in rows}
    return {d: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for d, w in words.items()}


def similar_pairs(sets):
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    near = {(a, b) for group in by.values() for a in group for b in group if a < b}
    return {(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def edited(rng, words, share):
    """words with that share of them replaced, left out or doubled, and some more at the end."""
    out = [y for w in words for y in ([w] if rng.random() >= share else rng.choice(([], [w, w], [f"e{rng.randrange(10**6)}"])))]
    return out + [f"t{rng.randrange(10**6)}" for _ in range(int(len(words) * rng.choice((0, 0, share))))]


@pytest.mark.parametrize("size", ["small", "medium"])
def test_near_groups_against_brute_force(spark, size, request):
    folder = request.getfixturevalue(size)
    docs = pd.read_parquet(f"{folder}/documents.parquet")[["doc_id", "text"]]
    rows = list(docs.itertuples(index=False, name=None))
    want = components(sorted(docs.doc_id), similar_pairs(shingle_sets(rows)))
    got = simhash.near_groups(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == want


def test_near_groups_of_edited_and_longer_copies(spark):
    rng = random.Random(4)
    rows, d = [], 0
    for _ in range(250):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(3):
            rows.append((d, " ".join(edited(rng, base, rng.choice((0.0, 0.01, 0.02, 0.03))))))
            d += 1
    pairs = similar_pairs(shingle_sets(rows))
    want = components(range(d), pairs)
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[k] == want[r] for k, r in got.items())  # nothing unlike is joined
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs) > 100


@pytest.mark.parametrize(("rows", "parts", "share"), [(100, 8, 1.0), (60, 4, 0.95)])
def test_near_groups_too_large_to_compare(spark, rows, parts, share):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = [(k, " ".join(edited(rng, base, 0.02 if k % 3 else 0.08))) for k in range(400)] + [(1000 + k, " ".join([*base, "x"[: k % 2], f"{k}"])) for k in range(200)]
    want = components([k for k, _ in docs], similar_pairs(shingle_sets(docs)))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), class_rows=rows, class_parts=parts).collect()}
    assert all(want[k] == want[r] for k, r in got.items())
    gone = [k for k, r in want.items() if k != r]
    assert sum(got[k] != k for k in gone) >= share * len(gone) > 100


@pytest.mark.parametrize("rows", [8, 30])
def test_no_link_is_lost_in_a_group_too_large_to_compare(spark, rows):
    """Chains of copies in one text's company, and pairs that share little else with it: the groups are those of brute force."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [edited(rng, base, 0.03 if k % 3 else 0.1) for k in range(300)]
    for k in range(40):
        own = [f"o{k}x{rng.randrange(5000)}" for _ in range(60)]
        texts += [[*base[:60], *own], [*base[:60], *own[:-3], f"y{k}"]]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = components([k for k, _ in docs], similar_pairs(shingle_sets(docs)))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), class_rows=rows, class_parts=1).collect()}
    assert got == want and sum(want[k] != k for k in want) > 100


def test_near_groups_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text, "a"), (5, text, "b"), (7, text + " more", "c"), (3, None, "d"), (4, "", "e"), (9, " \n", "f"), (None, text, "g"), (11, "one two", "h"), (12, "ONE  two", "i"), (13, "z" * 300_000, "j"), (5, "another text", "k")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, keep_id string")
    got = simhash.near_groups(docs).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in got) == sorted([*[(5, 5)] * 3, (7, 5), (3, 3), (4, 3), (9, 3), (11, 11), (12, 11), (13, 13)])
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["keep_id"] for r in left.collect()} == {"a", "b", "d", "g", "h", "j", "k"}
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def test_exact_query_and_index(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP10_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in queries.op10_exact_dedup(spark, small).select(columns).orderBy("doc_id").collect()] == want
    path = f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = spark.createDataFrame([(3, "a b"), (2, "ab"), (9, None), (8, " ")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(first).collect()}
    assert got == {3: (3, True), 2: (3, False), 9: (8, False), 8: (8, True)}  # most code points first
    again = exact_dedup.DigestIndex(spark, path, 4)
    again.compact()
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, path, 8)
    odd = spark.createDataFrame([(5, "same", "x"), (5, "same", "y"), (None, "same", "z")], "doc_id long, text string, keep_id string")
    assert again.add(odd.limit(0)).count() == 0
    got = exact_dedup.DigestIndex(spark, f"{path}-odd", 2).add(odd).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(5, 3)} and sum(r["kept"] for r in got) == 1
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.add(spark.createDataFrame([(1, "a  b"), (7, "new")], "doc_id long, text string")).collect()}
    assert got == {1: (3, False), 7: (7, True)}
    assert again.entries().count() == 3


def test_lines_against_brute_force(spark, small):
    rows = [(d, t) for d, t in pd.read_parquet(f"{small}/documents.parquet")[["doc_id", "text"]].itertuples(index=False) if d < 90]
    base = "one two three four five six seven eight nine ten".split()
    rows += [(1000, " ".join(base)), (1001, " ".join([*base[:3], "x", *base[4:]]) + "\nshort line"), (1002, " ".join(base[:-1]) + "\n" + " ".join(base).upper()), (1003, " ".join(["new", *base])), (1004, " ".join(["p", "q", *base])), (1005, None), (1006, "")]
    rows += [(1007, "a a a a a a a a a"), (1008, "a a a a a a a a a a"), (1009, "b " * 300), (1010, "One two three\nc1 c2 c3 c4 c5 c6 c7 c8\nc1 c2 c3 c4 c5 c6 c7\nd1 d2 d3 d4 d5 d6 d7"), (1011, "one  two three\n\nd1 d2 d3 d4 d5 d6 x7\nSHORT line")]
    first, repeats = {}, {}
    for d, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            words = WORD.findall(lower(line))
            if not words:
                continue
            key = tuple(words)
            if key not in first:
                # the earliest line within one edit decides for all lines equal to this one
                near = [at for other, (at, _) in first.items() if max(len(words), len(other)) >= 8 and line_dedup.one_edit(list(other), words)]
                first[key] = ((d, k), min(near, default=None))
            at, near = first[key]
            if near is not None:
                repeats[d, k] = (*near, True)
            elif at != (d, k):
                repeats[d, k] = (*at, False)
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in got.collect()} == repeats
    assert (1001, 0) in repeats and (1002, 1) in repeats and (1003, 0) in repeats and (1004, 0) not in repeats and (1008, 0) in repeats
    assert repeats[1010, 2] == (1010, 1, True) and repeats[1011, 0] == (1010, 0, False) and (1011, 1) not in repeats and (1011, 2) not in repeats and repeats[1011, 3][2] is False


def test_lines_of_odd_rows(spark):
    text = "w1 w2 w3 w4 w5 w6 w7 w8"
    rows = [(2, text, "a"), (None, text + " w9\n\nown line", "b"), (1, None, "c"), (3, "", "d"), (2, text, "e"), (9, "\n".join(f"line {k} {k * k}" for k in range(5000)), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    got = {r["text"] if r["text"] is None else r["text"][:30]: (r["n_lines"], [tuple(x) for x in r["dropped"]]) for r in line_dedup.drop_repeated_lines(docs).collect()}
    # a line repeats an earlier line of its own document too; a null doc_id comes last
    assert got == {text[:30]: (1, []), "\nown line": (3, [(0, 2, True)]), None: (0, []), "": (1, []), "line 0 0\nline 1 1\nline 2 4\nlin": (5000, [])}
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_variant_keys_are_those_of_the_shorter_lines():
    rng = random.Random(7)
    lines = [[b"%d" % rng.randrange(30) for _ in range(n)] for n in (1, 2, 8, 40) for _ in range(50)]
    for w in lines:
        keys = line_dedup.variant_keys(w)
        for k in range(len(w) if len(w) > 1 else 0):
            assert keys[k + 1] == line_dedup.variant_keys(w[:k] + w[k + 1 :])[0]
    # every word counts, the first of a long line too
    assert len({int(line_dedup.variant_keys(w)[0]) for w in lines}) == len({tuple(w) for w in lines})


def test_one_edit():
    e = line_dedup.one_edit
    assert e(list("abc"), list("abc")) and e(list("abc"), list("axc")) and e(list("abc"), list("ab")) and e(list("abc"), list("xabc")) and e([], ["a"])
    assert not e(list("abc"), list("bca")) and not e(list("abcd"), list("ab")) and not e(list("ab"), list("ba"))


def plain_alignment(a, b):
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, h[j] + (2 if x == y else -1), h[j + 1] - 1, row[j] - 1))
        best, h = max(best, *row), row
    return best


def test_smith_waterman():
    rng = random.Random(2)
    for _ in range(40):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert decontamination.smith_waterman(np.array(a), np.array(b))[0] == plain_alignment(a, b)


def test_leaks_against_brute_force(spark, small):
    docs, bench = pd.read_parquet(f"{small}/documents.parquet"), pd.read_parquet(f"{small}/benchmark.parquet")
    item = decontamination.tokens(bench.text[0])
    edited = [w for k, w in enumerate(item) if k % 9 != 4]
    docs = [*docs[["doc_id", "text"]].itertuples(index=False, name=None), (5001, "before " + " ".join(edited) + " after"), (5002, None), (5003, ""), (5004, " ".join(reversed(item)))]
    want = {}
    for d, t in docs:
        words = np.array([hash(w) for w in decontamination.tokens(t)])
        for i, text in bench[["item_id", "text"]].itertuples(index=False):
            a = np.array([hash(w) for w in decontamination.tokens(text)])
            if len(a) and len(words) and (s := decontamination.smith_waterman(a, words)[0] / (2 * len(a))) >= 0.5:
                want[d, i] = round(s, 9)
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{small}/benchmark.parquet"), block_chars=2000).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in got} == want
    assert (5001, bench.item_id[0]) in want and (5004, bench.item_id[0]) not in want


@pytest.mark.parametrize("whole", [False, True])
def test_leaks_of_which_every_fourth_to_sixth_word_is_replaced(spark, whole):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(24 + k))) for k in range(12)]
    # item k has one edited copy: every 4th word of it replaced, or every 5th, or every 6th
    edited = [(100 + k, "before " + " ".join(f"other{i}" if i % (4 + k % 3) == 3 + k % 3 else w for i, w in enumerate(text.split())) + " after") for k, text in items]
    docs = [*edited, *((1000 + k, f"a whole copy: {text}") for k, text in items if whole)]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, d % 100) for d, _ in docs}
    assert all(r["score"] == 1 for r in got if r["doc_id"] >= 1000)


def test_leaks_of_frequent_items(spark):
    common = "of the kind that is in each of them as it was".split()
    item = [w for k in range(5) for w in (*common, f"v{k}")]
    docs = [(k, " ".join(item)) for k in range(60)] + [(100 + k, " ".join(w for i, w in enumerate(item) if i % 8 != k % 8)) for k in range(40)] + [(200 + k, f"a{k} " + " ".join(common[:5])) for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join([*common, *(f"u{k}" for k in range(30))])), (3, None), (4, "two words"), (5, " ".join(item))], "item_id long, text string")
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(d, i) for d, _ in docs if d < 200 for i in (1, 5)}


def edits(rng, words, vocabulary):
    """A copy with words replaced, dropped or put in at a random rate, or one of its parts, or a long insertion in its middle."""
    kind, rate = rng.randrange(6), rng.choice([0.1, 0.2, 0.3, 0.45])
    if kind == 0:
        return [w for k, w in enumerate(words) for w in ((w, rng.choice(vocabulary)) if k % 2 else (w,))]
    if kind == 1:
        return [rng.choice(vocabulary) if k % 3 == 2 else w for k, w in enumerate(words)]
    if kind == 2:
        half = len(words) * 5 // 9 + 1
        return words[:half] if rng.random() < 0.5 else words[-half:]
    if kind == 3:
        at = rng.randrange(len(words))
        return words[:at] + rng.choices(vocabulary, k=int(0.8 * len(words))) + words[at:]
    out = []
    for w in words:
        x = rng.random()
        out += [rng.choice(vocabulary)] if x < rate / 3 else [] if x < 2 * rate / 3 else [w, rng.choice(vocabulary)] if x < rate else [w]
    return out


@pytest.mark.parametrize("vocabulary", [40, 4000])
def test_no_alignment_that_reaches_the_score_is_lost(spark, vocabulary):
    """Items of every length, edited at random, in documents of the same words: the pairs are those of a full alignment."""
    rng = random.Random(vocabulary)
    known = [f"w{k}" for k in range(vocabulary)]
    items = [(k, rng.choices(known, k=rng.choice([4, 5, 6, 8, 10, 15, 25, 40, 60, 90]))) for k in range(60)]
    docs = [(d, rng.choices(known, k=rng.randrange(30)) + edits(rng, rng.choice(items)[1], known) + rng.choices(known, k=rng.randrange(30))) for d in range(250)]
    want = {}
    for d, text in docs:
        words = np.array([int(w[1:]) for w in text])
        for i, item in items:
            a = np.array([int(w[1:]) for w in item])
            if len(words) and (s := decontamination.smith_waterman(a, words)[0] / (2 * len(a))) >= 0.5:
                want[d, i] = round(s, 9)
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontamination.leaks(frame(docs, "doc_id"), frame(items, "item_id"), block_chars=3000).collect()}
    assert got == want and len(want) > 150


def test_least_pairs():
    assert [decontamination.least_pairs(n, 0.5) for n in (3, 4, 6, 9, 24, 200)] == [1, 1, 1, 2, 7, 66] and decontamination.least_pairs(10, 1.0) == 9


def test_leaks_of_odd_rows(spark):
    item = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (1, "other", "z"), (None, item, "n"), (2, None, "m"), (3, "word " * 200_000 + item, "l")], "doc_id int, text string, item_id string")
    bench = spark.createDataFrame([(7, item, 0.5)], "item_id int, text string, score double")
    got = sorted(tuple(r) for r in decontamination.leaks(docs, bench).select("doc_id", "item_id", "score", "start").fillna(-1, ["doc_id"]).collect())
    assert got == [(-1, 7, 1.0, 0), (1, 7, 1.0, 0), (3, 7, 1.0, 200_000)]
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_drop_exact_copies(spark):
    """One row a text, also where a doc_id repeats with other texts, with clashing columns; what the index has goes."""
    rows = [(1, "a b", "x"), (1, "other", "y"), (1, "a  b ", "z"), (2, "ab", "w"), (3, None, "n"), (4, " ", "e"), (None, "no id", "i"), (5, "seen " * 50_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string").withColumn("digest", F.lit("d")).withColumn("id", F.lit(0))
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/drop-{uuid.uuid4().hex}", 4)
    got = exact_dedup.drop_exact_copies(docs, index)
    assert got.columns == docs.columns and sorted(r["own"] for r in got.collect()) == ["e", "i", "l", "y", "z"]
    assert exact_dedup.drop_exact_copies(docs, index).count() == 5  # a batch that runs again gets the same rows
    again = docs.unionAll(docs.limit(1).withColumn("text", F.lit("new"))).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)) + 100)
    assert [r["text"] for r in exact_dedup.drop_exact_copies(again, index).collect()] == ["new"]
    assert exact_dedup.drop_exact_copies(docs.limit(0), index).count() == 0
