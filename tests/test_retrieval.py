"""The stemmer against published samples, the index against scanning."""

import pytest
from pyspark.sql import functions as F

from vintra.functions.stemming import lexemes, stem
from vintra.operators import metrics, retrieval
from vintra.queries.base import day
from vintra.queries.retrieval import AS_OF, TEXT, WEB, corpus, index_of
from vintra.sources import lexeme_index
from vintra.sources.lexeme_index import LexemeIndex, Terms, known_by
from vintra.sources.scratch import shared_dir

# A sample vocabulary with its published stems.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead
knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit
knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot generate generat generally general communication communic arsenal arsenal
skies sky dying die news news inning inning proceed proceed hopping hop hoped hope hoping hope falling fall sized size agreed agre feed feed tied tie cried cri cries cri ties tie gas gas this this gaps gap kiwis kiwi
happy happi say say by by youth youth boyish boyish relational relat conditional condit rational ration hopefulness hope formality formal sensibility sensibl analogously analog replacement replac adoption adopt adjustment adjust controll control roll roll"""


def test_stems():
    words = SAMPLE.split()
    for word, want in zip(words[::2], words[1::2], strict=True):
        assert stem(word) == want, word


def test_lexemes():
    assert lexemes("The Rates of the_Bank's 2nd ÉTÉ") == [(2, "rate"), (5, "bank"), (7, "2nd"), (8, "été")]
    assert lexemes(None) == lexemes("of the and") == []


def rows(df, *columns):
    return sorted(str([r[c] for c in columns]) for r in df.collect())


def test_index_against_scan(spark, small):
    index, docs = index_of(spark, small), retrieval.indexed(corpus(spark, small)).cache()
    scan = retrieval.match_any(retrieval.published_by(docs, day(AS_OF)), TEXT).withColumn("rank", F.round(retrieval.rank(F.col("title_terms"), F.col("body_terms"), TEXT), 9))
    got = index.match_any(TEXT, known_by(day(AS_OF))).withColumn("rank", F.round("rank", 9))
    assert rows(got, "source_id", "rank") == rows(scan, "source_id", "rank") and got.count() > 3
    for web in (WEB, "licensed", "-rights", 'the "all rights"', "rights or licensed -under", '"of the"', "zzzz", '"rights licensed"', "-the rights"):
        assert rows(index.match_all(web), "source_id") == rows(docs.where(retrieval.websearch(web)), "source_id"), web


def test_only_the_querys_folders_are_read(spark, small):
    plan = index_of(spark, small).match_any("licensed")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert "PushedFilters" in plan and "EqualTo(term,licens)" in plan or "In(term" in plan


@pytest.fixture
def index(spark, request):
    return LexemeIndex(spark, f"{shared_dir(spark)}/test-{request.node.name}-{id(request)}", buckets=8, spread=2)


SHAPE = "document_type string, source_id string, title string, content string, published_at timestamp, rank int"


def test_documents_are_added_once(spark, index):
    day_one = F.to_timestamp(F.lit("2024-01-02 10:00:00"))
    first = spark.createDataFrame([("a", "1", "Rate cuts", "Banks cut rates. Rates fell.", None, 1), ("a", "2", None, "rates", None, 1), ("b", "1", "", "of the", None, 1), ("b", "2", None, None, None, 1)], SHAPE).withColumn("published_at", day_one)
    index.add(first)
    before = rows(index.match_any("rates"), "document_type", "source_id", "rank")
    index.add(first.withColumn("content", F.lit("changed")))
    assert rows(index.match_any("rates"), "document_type", "source_id", "rank") == before and len(before) == 2
    index.add(spark.createDataFrame([("c", "1", "", "cutting rated " * 3, None, 1)], SHAPE).withColumn("published_at", day_one))
    assert rows(index.match_all("cuts rating"), "source_id", "document_type") == ["['1', 'a']", "['1', 'c']"]
    assert index.match_any("of the").count() == 5 and index.match_any("unheard").count() == 0
    assert index.match_all("-rates").count() == 2
    best = index.retrieve("rate", F.lit("2024-01-02").cast("date"), 1).first()
    assert (best["document_type"], best["source_id"]) == ("a", "2") and index.retrieve("rate", F.lit("2024-01-01").cast("date"), 1).count() == 0


def test_rank_of_title_and_length(spark, index):
    """One place in the title counts as much as many in the body, and a long text dilutes."""
    at = F.to_timestamp(F.lit("2024-01-02"))
    data = [("a", "title", "inflation", "word", None, 1), ("a", "body", "word", "inflation " * 9, None, 1), ("a", "long", "inflation", "word " * 500, None, 1)]
    index.add(spark.createDataFrame(data, SHAPE).withColumn("published_at", at))
    got = {r["source_id"]: r["rank"] for r in index.match_any("inflation").collect()}
    assert got["title"] == pytest.approx(1 / 1.64493406685 / 1.584962500721156) and got["title"] > got["body"] > got["long"]


def test_postings_of_documents_in_blocks(spark, small):
    """Numbers for lexemes, in any blocks and with the vocabulary cleared between them, give what lexemes() gives text by text."""
    texts = [None, "", "of the", "The Rates of the_Bank's 2nd ÉTÉ", *(r["text"] for r in corpus(spark, small).select(F.col("content").alias("text")).limit(40).collect())]
    terms = Terms(8, most=50)
    for k in range(0, len(texts), 7):
        rows_, places, numbers = terms.of(texts[k : k + 7])
        got = [[(int(p), terms.terms[n]) for r, p, n in zip(rows_, places, numbers, strict=True) if r == i] for i in range(len(texts[k : k + 7]))]
        assert got == [lexemes(t) for t in texts[k : k + 7]]


def test_tasks_of_the_index_grow_with_the_texts(spark, index, monkeypatch):
    """A task holds the postings of so many characters; before, the number of tasks was fixed."""
    docs = spark.range(400).select(F.lit("a").alias("document_type"), F.col("id").cast("string").alias("source_id"), F.lit("one").alias("title"), F.repeat(F.lit("bank rates "), 20).alias("content"), F.to_timestamp(F.lit("2024-01-02")).alias("published_at"))
    monkeypatch.setattr(lexeme_index, "TASK_CHARS", 5000)
    index.add(docs)
    files = index.postings(["bank"]).select(F.input_file_name().alias("f")).distinct().count()
    assert files > 10 and index.match_any("bank").count() == 400 and index.match_all('"bank rates"').count() == 400


def test_texts_are_taken_apart_once_for_words_and_pairs(spark):
    docs = spark.createDataFrame([("en", "The cat and the dog-house b2 the cat the dog-house"), ("en", None), ("en", "the"), ("de", "x1 x1")], "lang string, text string")
    out = metrics.top_words(docs, ["lang"], "text", 4, ["the", "and"])
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["lang"], r["term"], r["n"], r["kind"]) for r in out.collect()) == [("de", "x1", 2, "word"), ("en", "b2", 1, "word"), ("en", "cat", 2, "word"), ("en", "cat dog-house", 2, "pair"), ("en", "dog-house", 2, "word")]
