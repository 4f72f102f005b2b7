"""The Merkle manifest against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintra.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes, fanout=8):
    """(root, path of each node: (place, siblings) by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for leaf_no, path in enumerate(paths):
            run, k = runs[at[leaf_no] // fanout], at[leaf_no] % fanout
            path.append((k, run[:k] + run[k + 1 :]))
        at = [a // fanout for a in at]
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def fold(digest, path):
    for k, others in path:
        digest = h("".join([*others[:k], digest, *others[k:]]))
    return digest


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf(r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    root, tops = tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for (doc_id, digest, r), path in zip(groups[g], trees[g][1], strict=True):
            whole = path + tops[k]
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            found = fold(leaf((*r[:4], lower(r[4]))), whole) if tampered else root
            assert fold(digest, whole) == root
            out.append((doc_id, digest, trees[g][0], root, h("".join(x for _, o in whole for x in o)), found, found == root))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query(spark, scale):
    docs = pd.read_parquet(f"/root/testdata/{scale}/documents.parquet")[["doc_id", "source", "lang", "n_chars", "text"]]
    want = brute([tuple(None if pd.isna(v) else v for v in r) for r in docs.itertuples(index=False)])
    got = result(queries.op12_merkle(spark, f"/root/testdata/{scale}"))
    assert got == want and any("False)" in r for r in got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_odd_rows(spark, tmp_path, n):
    rows = [(k * 3 % 1000, None if k % 5 == 0 else "s", [None, "", "é", "en", "zz"][k % 5 if n > 2 else 0], None if k % 7 == 0 else k, [None, "", "ABC x Ä", "lower", "Z" * 5000][k % 5]) for k in range(n)]
    rows += [(None, None, None, None, None)] * 2 + [(5, "s", "only", 1, "One")] + [(7, "s", "en", 1, "Same")] * 20 if n > 8 else []
    spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, leaf string").write.parquet(f"{tmp_path}/documents.parquet")
    assert result(queries.op12_merkle(spark, str(tmp_path))) == brute(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert merkle.verified(none, "lang", "doc_id", merkle.digest_of(F.col("text")), F.lit(None).cast("binary")).collect() == []


def test_many_groups_and_paths(spark):
    rows = [(k, f"g{k % 70}", f"t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, text string")
    out = merkle.verified(df, "g", "id", merkle.digest_of(F.col("id"), F.col("text")), F.lit(None).cast("binary"), fanout=3, with_path=True).collect()
    roots = {bytes(r["root"]) for r in out}
    assert len(out) == 300 and len(roots) == 1 and len({bytes(r["subroot"]) for r in out}) == 70
    for r in out:
        assert merkle.folded(bytes(r["leaf"]), [(p["place"], tuple(map(bytes, p["others"]))) for p in r["path"]]) in roots


def test_rows_without_a_claim_are_folded_too(spark, monkeypatch):
    """A sibling that is wrong in the tree shows at every row that has it, whether its leaf is claimed or not."""
    runs = merkle.lowest_runs

    def broken(levels, seeds, count, fanout, scratch):
        wrong = lambda x: ([b"\0" * 32, *x[0][1:]] if x[0] else x[0], x[1])
        out = runs(levels, seeds, count, fanout, scratch)
        return out.mapValues(wrong) if count == 20 else out

    monkeypatch.setattr(merkle, "lowest_runs", broken)
    df = spark.createDataFrame([(k, "g", f"t{k}") for k in range(20)], "id long, g string, text string")
    out = merkle.verified(df, "g", "id", merkle.digest_of(F.col("id")), F.lit(None).cast("binary"), fanout=4).collect()
    # the first child of each run has true siblings
    assert {r["key"] for r in out if r["verified"]} == set(range(0, 20, 4)) and all(r["verified"] == (r["folded_root"] == r["root"]) for r in out)
