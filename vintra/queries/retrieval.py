"""Dated full-text retrieval over the documents."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintra.functions import stemming
from vintra.functions.scalar import quantised
from vintra.operators import metrics, retrieval
from vintra.queries.base import day, q, query, table
from vintra.sources.lexeme_index import LexemeIndex, known_by
from vintra.sources.scratch import shared_dir

TEXT, AS_OF = "all rights reserved under licensed passwords and the others", "2024-03-15"
QUOTAS = {"src0": 5, "src1": 3, "src2": 2}
WEB = '"rights reserved" or licensed -password'


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a title (their first sentence), a type (their source) and a day on which they appeared."""
    return table(spark, d, "documents").select(F.col("source").alias("document_type"), F.col("doc_id").alias("source_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("content"), F.expr("timestamp '2023-01-01 12:00:00' + make_dt_interval(cast(doc_id % 700 as int))").alias("published_at"))


#: The indexes that this process has built, by application and corpus.
_INDEXES: dict[tuple[str, str], LexemeIndex] = {}


def index_of(spark: SparkSession, d: str) -> LexemeIndex:
    """The corpus' index, built at its first use."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        index = LexemeIndex(spark, f"{shared_dir(spark)}/lexemes-{uuid.uuid4().hex}")
        index.add(corpus(spark, d))
        _INDEXES[key] = index
    return _INDEXES[key]


#: Endings that a form of an English word can have besides its stem.
ENDINGS = [x + y for x in ("", "e", "i", "y", "at", "ate", "iz", "ize") for y in ("", "s", "es", "ed", "d", "er", "ers", "ing", "ings", "ly", "ment", "ness", "ion", "ions", "or", "al")]


def forms(lexeme: str) -> list[str]:
    """Words that stem to a lexeme, so that SQL can find it."""
    doubled = [lexeme + lexeme[-1] + e for e in ("ed", "ing", "er")]
    return sorted({w for w in [*(lexeme + e for e in ENDINGS), *doubled] if stemming.stem(w) == lexeme})


ASKED = sorted({t for _, t in stemming.lexemes(TEXT)})


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')"


def squares(n: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, ({n} + 1)::BIGINT), lambda j: 1.0::DOUBLE / (j * j))), 0)"


def found_in(of: str, lexeme: str) -> str:
    return f"len(list_filter({of}, lambda x: list_contains({forms(lexeme)}, x)))"


CORPUS = f"""corpus AS (
  SELECT source AS document_type, doc_id AS source_id, TIMESTAMP '2023-01-01 12:00:00' + to_days((doc_id % 700)::INT) AS published_at, {tokens("split_part(text, '.', 1)")} AS title, {tokens("text")} AS body FROM documents)"""
ANY = f"""{CORPUS}, counted AS (
  SELECT source_id, document_type, published_at, len(list_filter(title || body, lambda x: NOT list_contains({sorted(stemming.STOP_WORDS)}, x))) AS words, {', '.join(f'{found_in("title", t)} AS a{k}, {found_in("body", t)} AS b{k}' for k, t in enumerate(ASKED))} FROM corpus),
ranked AS (
  SELECT *, ({' + '.join(f'{squares(f"a{k}")} + 0.4::DOUBLE * ({squares(f"(a{k} + b{k})")} - {squares(f"a{k}")})' for k in range(len(ASKED)))}) / 1.64493406685::DOUBLE / {len(ASKED)} / log2(words + 1.0::DOUBLE) AS rank
  FROM counted WHERE {' + '.join(f'a{k} + b{k}' for k in range(len(ASKED)))} > 0 AND published_at < DATE '{AS_OF}' + 1)"""


@query(f"WITH {ANY} SELECT source_id, {q('rank')} AS rank FROM ranked")
def x1_x2_x4_match_any(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).match_any(TEXT, known_by(day(AS_OF))).select("source_id", quantised(F.col("rank")).alias("rank"))


@query(f"WITH {ANY} SELECT source_id, {q('rank')} AS rank FROM ranked")
def x1_x2_x4_scanned(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index."""
    found = retrieval.match_any(retrieval.indexed(retrieval.published_by(corpus(spark, d), day(AS_OF))), TEXT)
    return found.select("source_id", quantised(retrieval.rank(F.col("title_terms"), F.col("body_terms"), TEXT)).alias("rank"))


@query(f"WITH {ANY} SELECT source_id, published_at::VARCHAR AS published FROM ranked ORDER BY {q('rank', 9)} DESC, ranked.published_at DESC, source_id DESC LIMIT 8")
def a19_retrieve_as_of(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).retrieve(TEXT, day(AS_OF), 8).select("source_id", F.col("published_at").cast("string").alias("published"))


def follows(of: str, first: str, then: str) -> str:
    return f"len(list_filter(range(1, len({of})), lambda i: list_contains({forms(first)}, {of}[i]) AND list_contains({forms(then)}, {of}[i + 1]))) > 0"


@query(f"WITH {CORPUS} SELECT source_id FROM corpus WHERE {follows('title', 'right', 'reserv')} OR {follows('body', 'right', 'reserv')} OR ({found_in('title || body', 'licens')} > 0 AND {found_in('title || body', 'password')} = 0)")
def x3_websearch(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).match_all(WEB).select("source_id")


@query("SELECT count(*)::BIGINT AS n FROM documents WHERE DATE '2023-01-01' + (doc_id % 700)::INT <= DATE '2024-03-15'")
def x5_stop_words_match_all(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).match_any("of the and", known_by(day(AS_OF))).agg(F.count("*").alias("n"))


@query(f"WITH {ANY} SELECT document_type, nth::BIGINT AS nth, source_id FROM (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY {q('rank', 9)} DESC, published_at DESC, source_id DESC) AS nth FROM ranked WHERE published_at >= DATE '{AS_OF}' - 365) WHERE (document_type = 'src0' AND nth <= 5) OR (document_type = 'src1' AND nth <= 3) OR (document_type = 'src2' AND nth <= 2)")
def x6_quotas_by_type(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).with_quotas(TEXT, day(AS_OF), QUOTAS).select("document_type", F.col("nth").cast("long").alias("nth"), "source_id")


@query(
    """WITH w AS (SELECT lang, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]+'), lambda x: NOT list_contains(['the', 'and'], x)) AS words FROM documents),
    one AS (SELECT lang, unnest(words) AS term FROM w),
    two AS (SELECT lang, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS term FROM w),
    pairs AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS nth FROM (SELECT lang, term, count(*) AS n FROM two GROUP BY ALL HAVING count(*) > 1)),
    words AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS nth FROM (SELECT lang, term, count(*) AS n FROM one GROUP BY ALL)),
    taken AS (SELECT lang, count(*) AS taken FROM pairs WHERE nth <= 5 GROUP BY lang)
    SELECT lang, term, n::BIGINT AS n, 'pair' AS kind FROM pairs WHERE nth <= 5 UNION ALL SELECT lang, term, n::BIGINT, 'word' FROM words LEFT JOIN taken USING (lang) WHERE nth <= 10 - coalesce(taken, 0)"""
)
def g22_top_words(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_words(table(spark, d, "documents"), ["lang"], "text", 10, ["the", "and"]).select("lang", "term", "n", "kind")
