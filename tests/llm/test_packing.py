"""Packing: every id once and in place, full sequences, odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vintra.llm import packing, queries
from vintra.llm.common import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts):
    """rows: pieces as dicts; texts: (doc_id, text) without repeated ids."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == {d for d, _ in texts}
    for d, text in texts:
        ids, at = plain(text), 0
        for r in sorted(docs[d], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part)) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == s[0]["window"] <= 2048 and at & (at - 1) == 0  # no padding
    return docs, sequences


def test_query(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    rows = [r.asDict() for r in queries.op11_packing(spark, small).collect()]
    _, sequences = check(rows, list(zip(docs.doc_id, docs.text, strict=True)))
    assert sum(s[0]["window"] < 256 for s in sequences.values()) <= 8 * 8  # the rest of a task alone
    steps = defaultdict(set)
    for s in sequences.values():
        steps[s[0]["step"]].add((s[0]["sequence_id"], s[0]["window"]))
    by_window = defaultdict(list)
    for step in steps.values():
        assert len({w for _, w in step}) == 1  # one context size a step
        by_window[next(iter(step))[1]].append(len(step))
    for window, sizes in by_window.items():
        assert sum(n != (1 << 16) // window for n in sizes) <= 1 and max(sizes) <= (1 << 16) // window


ODD = [
    None, "", " \t\n ", "x", "Don't STOP... it's 3,5% of 'em!?", "Ein Ärger - über Öl; fünf Straßen\u0085weiter", "é É İ KK ǅ H̱", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>.",
    "漢字かな交じり 文。한국어 \U0001f600\U0001f600!!", "a.b,c;d:e!f?g ..,.. 'S 'll", "\x1ca\x1db\x00c\x0bd\x0ce", "word " * 9000 + "end", "x" * 5000, "ΣΑΣ ΟΔΟΣ.", "don't." * 50, "99 1.5.",
]


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_words_give_the_ids_of_whole_texts(block):
    encode = packing.Encoder(PATH, keep=50, block=block)
    for text in [*ODD, *reversed(ODD), " ".join(t or "" for t in ODD)]:
        got = np.frombuffer(encode((text or "").encode()), "<u4").tolist()
        assert [*got, 1] == plain(text), text


def test_odd_rows(spark):
    texts = [*enumerate(ODD), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, start int, window string").repartition(2)
    rows = [r.asDict() for r in packing.pack(docs, PATH, pool_tokens=4096).collect()]
    for r in rows:
        r["ids_crc32"] = zlib.crc32(r["ids"])
    check(rows, texts)
    again = [r.asDict() for r in packing.pack(docs, PATH, pool_tokens=4096).drop("ids").collect()]
    assert sorted(map(str, again)) == sorted(str({k: v for k, v in r.items() if k not in ("ids", "ids_crc32")}) for r in rows)


def test_repeated_and_no_rows(spark):
    twice = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(twice, PATH).collect()) == 2 * len(plain("same text"))
    none = packing.pack(twice.where("doc_id > 1"), PATH)
    assert none.collect() == []
    assert packing.with_steps(Scratch(spark).save(none, "none"), Scratch(spark)).collect() == []


def test_windows_are_full():
    rng = np.random.default_rng(1)
    pool = packing.Pool()
    lengths = [int(n) for n in np.minimum(2047, rng.geometric(0.004, 3000))]
    for k, n in enumerate(lengths):
        pool.put(((k, n), 0, b"\0\0\0\0" * n))
    cut = whole = 0
    for size, pieces in packing.windows(pool, packing.TIERS, 0):
        assert sum(len(p[2]) // 4 for p in pieces) == size
        whole += sum(len(p[2]) // 4 == p[0][1] for p in pieces)
        cut += sum(p[1] > 0 for p in pieces)
    assert cut < 0.2 * len(lengths) and whole > 0.7 * len(lengths)  # most documents stay whole
