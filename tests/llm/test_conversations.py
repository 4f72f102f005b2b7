"""Repair of conversations against exhaustive search and a plain replay."""

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from vintra.llm import conversations, queries

SHAPE = re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """rows: (initial, must go, truncated) -> (cost, audit) over all edits with up to three inserted rows."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        if any(r[1] and x != "D" for r, x in zip(rows, letters, strict=True)):
            continue
        for extra in range(4):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), extra):
                audit = "".join("I" * places.count(k) + x for k, x in enumerate(letters)) + "I" * places.count(len(rows))
                cost = extra * 5 + sum({"D": 2, "K": 0, "R": 1}[x] + 5 * (r[2] and x != "D") for r, x in zip(rows, letters, strict=True))
                if (best is None or (cost, audit) < best) and fits(rows, audit):
                    best = cost, audit
    return best


def fits(rows, audit):
    """Whether the roles that an audit leaves open can be chosen so that they alternate."""
    ends, k = {""}, 0
    for x in audit:
        if x != "D":
            ends = {e + c for e in ends for c in (rows[k][0] if x == "K" else "ua")}
        ends = {e for e in ends if re.fullmatch(r"s?(ua)*u?", e)}
        k += x != "I"
    return any(SHAPE.fullmatch(e) for e in ends)


def test_solve_against_exhaustive_search():
    rng = random.Random(4)
    for n in range(6):
        for _ in range(60 if n > 1 else 9):
            sig = "".join(rng.choice("ssuuuaaaxSUAXd") for _ in range(n))
            rows = [("" if c == "d" else c.lower(), c == "d", c.isupper()) for c in sig]
            assert conversations.solve(sig) == exhaustive(rows), sig


@pytest.mark.parametrize("block", [1, 3, 100])
def test_long_signatures(block):
    assert conversations.solve("ua" * 5000, block) == (0, "K" * 10000)
    assert conversations.solve("s" + "ud" * 400 + "a", block) == conversations.solve("s" + "ud" * 400 + "a", 7)
    assert conversations.solve("x" * 3000, block) == (3000, "R" * 3000)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows):
    given = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in given if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {r[0] for r in own if r[0] is not None}
        seen, faults = set(), []
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        sig = "".join("d" if f in ("b", "d") else (c := r[1][:1] if r[1][:1] in ("s", "u", "a") else "x").upper() if f else r[1][:1] if r[1][:1] in ("s", "u", "a") else "x" for r, f in zip(own, faults, strict=True))
        cost, audit = conversations.solve(sig)
        assert fits([("" if c == "d" else c.lower(), c == "d", c.isupper()) for c in sig], audit)
        final, k, state = [], 0, ""
        for x in audit:
            new = "assistant" if state == "u" else "user"
            if x == "I":
                final.append((new, ""))
            else:
                if x != "D":
                    final.append((own[k][1] if x == "K" else new, own[k][2]))
                k += 1
            state = final[-1][0][:1] if final else ""
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_query(spark, scale):
    rows = pd.read_parquet(f"/root/testdata/{scale}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
    assert result(queries.op13_conversations(spark, f"/root/testdata/{scale}")) == brute(list(rows.itertuples(index=False, name=None)))


def test_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "User", "usher", "ärger"], [None, "", " \t", "Fine.", "cut off", "Fine?\n ", "é…", "x" * 50_000 + ".", "a.b"]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, -3, 0, 1, 2, 3, 9, 2**40]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += rows[:20] + [(99, k, "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(3000)] + [(98, 21, "user", "dropped")] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, fault int")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(queries.op13_conversations(spark, str(tmp_path))) == brute(rows)


def test_repaired_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well."), (2, 0, "assistant", "Yes."), (3, 0, "user", "")], "conv_id int, turn int, role string, text string")
    found = conversations.audits(turns)
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in found.collect()} == {1: ("KDR", 3), 2: ("D", 2), 3: ("D", 2)}
    assert sorted(tuple(r) for r in conversations.repaired(turns, found).collect()) == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Well.", "R")]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversations(spark, str(tmp_path)).collect() == []
