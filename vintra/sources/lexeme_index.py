"""A persisted inverted index of dated documents, and retrieval from it.

A posting is a lexeme in a document: its places in title and body, and what it adds to the document's rank. Postings lie in
folders by a hash of the lexeme and sorted by it, so a query reads the folders of its own lexemes and skips the rest of each file.
Documents that are there already aren't added again. A folder has a file for each task, which holds some of the documents: a lexeme
of a third of all documents is spread over all of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintra.functions.stemming import TOKEN, Stems, lexemes

KEY = ("document_type", "source_id")
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
#: The sum of 1 / k^2, by which a lexeme's places are scaled.
ZETA2 = 1.64493406685
#: Characters whose postings are made at once, those that are worth a task, and those whose postings a task holds at most.
BLOCK_CHARS, LEAST_CHARS, TASK_CHARS = 1 << 20, 1 << 22, 1 << 25


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


class Terms(dict):
    """word -> number of its lexeme, -1 for stop words; terms and their buckets by number. Up to `most` words are kept."""

    def __init__(self, buckets: int = 1, most: int = 500_000):
        super().__init__()
        self.count, self.most, self.stems = buckets, most, Stems(most)
        self.numbers, self.terms, self.buckets = {}, [], []

    def __missing__(self, word: str) -> int:
        term = self.stems[word]
        if term is None:
            out = -1
        elif (out := self.numbers.get(term)) is None:
            out = self.numbers[term] = len(self.terms)
            self.terms.append(term)
            self.buckets.append(bucket_of(term, self.count))
        self[word] = out
        return out

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, number) of the lexemes of the texts, in order; see stemming.lexemes."""
        if len(self) >= self.most:
            self.clear()
            self.numbers, self.terms, self.buckets = {}, [], []
        found = [np.array([self[w] for w in TOKEN.findall((t or "").lower())], np.int32) for t in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        numbers = np.concatenate([np.zeros(0, np.int32), *found])
        rows = np.repeat(np.arange(len(texts)), sizes)
        places = np.arange(len(numbers)) - (np.cumsum(sizes) - sizes)[rows] + 1
        kept = numbers >= 0
        return rows[kept], places[kept].astype(np.int32), numbers[kept]


def postings_of(docs: pa.RecordBatch, terms: Terms, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The postings of documents (document_type, source_id, title, content, published_at)."""
    # both sides by one call: numbers of a call are of one vocabulary
    rows, places, numbers = terms.of([*docs.column(2).to_pylist(), *docs.column(3).to_pylist()])
    if not len(rows):
        return
    n = docs.num_rows
    side, rows = rows >= n, rows % n
    words = np.bincount(rows, minlength=n)
    order = np.argsort(rows * len(terms.terms) + numbers, kind="stable")
    rows, numbers, side, places = rows[order], numbers[order], side[order], places[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (numbers[1:] != numbers[:-1])]))
    a, b = (np.add.reduceat(x.astype(np.int64), new) for x in (~side, side))
    squares = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, words.max() + 1, dtype=float) ** 2)])
    score = TITLE_WEIGHT * squares[a] + BODY_WEIGHT * (squares[a + b] - squares[a])
    lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(x)]).astype(np.int32), places[mine]) for x, mine in ((a, ~side), (b, side))]
    at, number = pa.array(rows[new]), numbers[new]
    kind, key, published = (docs.column(c).take(at) for c in (0, 1, 4))
    columns = [np.array(terms.buckets, np.int32)[number], pa.array(terms.terms).take(pa.array(number)), kind, key, published, words[rows[new]].astype(np.int32), score, *lists]
    yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class LexemeIndex:
    """postings (term, document_type, source_id, published_at, words, score, title, body) and documents (document_type, source_id, published_at)
    under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, spread: int = 4):
        self.spark, self.path, self.buckets, self.spread = spark, path.rstrip("/"), buckets, spread

    def _read(self, name: str) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.path}/{name}")

    def add(self, docs: DataFrame) -> None:
        """Adds documents (document_type, source_id, title, content, published_at) whose key isn't there; one row a key.

        Null titles and contents are empty; a document without lexemes is found by queries of stop words alone. Postings are written before
        the documents: a run that dies between leaves postings that the next one writes again, and queries count a document's posting once.
        """
        old = self._read("documents")
        fresh = docs if old is None else docs.join(old.select(*KEY), list(KEY), "left_anti")
        kind = docs.schema["source_id"].dataType.simpleString()
        shape = f"bucket int, term string, document_type string, source_id {kind}, published_at timestamp, words int, score double, title array<int>, body array<int>"
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema, buckets = to_arrow_schema(StructType.fromDDL(shape)), self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = Terms(buckets)
            for batch in batches:
                first = chars = 0
                for k, n in enumerate(zip(*(pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_pylist() for c in (2, 3)), strict=True)):
                    chars += sum(n)
                    if chars >= BLOCK_CHARS or k == batch.num_rows - 1:
                        yield from postings_of(batch.slice(first, k + 1 - first), terms, schema)
                        first, chars = k + 1, 0

        given = fresh.select("document_type", "source_id", "title", "content", F.col("published_at").cast("timestamp").alias("published_at"))
        # a task's postings grow with its texts and not with the table
        size = given.agg(F.sum(F.coalesce(F.length("content"), F.lit(0)) + F.coalesce(F.length("title"), F.lit(0)))).first()[0] or 0
        tasks = max(self.spread, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_CHARS), -(-size // TASK_CHARS))
        postings = given.repartition(tasks, *KEY).mapInArrow(run, shape).sortWithinPartitions("bucket", "term")
        postings.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        fresh.select(*KEY, F.col("published_at").cast("timestamp").alias("published_at")).write.mode("append").parquet(f"{self.path}/documents")

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some lexemes: their folders alone are read."""
        wanted = sorted({bucket_of(t, self.buckets) for t in terms})
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).drop("bucket")

    def match_any(self, query: str, when: Column | None = None) -> DataFrame:
        """(document_type, source_id, published_at, rank) of the documents with any lexeme of the query, or of all, rank 0, if it has none.

        rank: for each lexeme its places' weights over the squares of their numbers, summed and divided by the number of lexemes and by
        the logarithm of the document's length. when: a condition on published_at and document_type, applied to the postings.
        """
        terms = sorted({t for _, t in lexemes(query)})
        rows = self.documents() if not terms else self.postings(terms)
        rows = rows if when is None else rows.where(when)
        if not terms:
            return rows.select(*KEY, "published_at", F.lit(0.0).alias("rank"))
        once = rows.groupBy(*KEY, "published_at").agg(F.array_sort(F.collect_set(F.struct("term", "score"))).alias("s"), F.max("words").alias("w"))
        total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"])
        return once.select(*KEY, "published_at", (total / ZETA2 / len(terms) / F.log2(F.col("w") + F.lit(1.0))).alias("rank"))

    def match_all(self, query: str, when: Column | None = None) -> DataFrame:
        """(document_type, source_id, published_at) of the documents that a web search finds: words and "phrases" that must all occur, `or`
        between alternatives, -word for what mustn't. A phrase's words stand as far apart as in the query, stop words included; a part of stop words
        only is met by all."""
        alternatives = parsed(query)
        terms = sorted({t for parts in alternatives for _, phrase in parts for _, t in phrase})
        everywhere = not alternatives or any(all(minus or not phrase for minus, phrase in parts) for parts in alternatives)
        if not terms:
            rows = self.documents()
            return rows if when is None else rows.where(when)
        held = self.postings(terms)
        held = held if when is None else held.where(when)
        # title and body are apart: a phrase can't reach from one into the other
        one = [F.first(F.when(F.col("term") == t, F.struct("title", "body")), ignorenulls=True).alias(f"p{k}") for k, t in enumerate(terms)]
        found = held.groupBy(*KEY, "published_at").agg(*one)
        if everywhere:
            docs = self.documents() if when is None else self.documents().where(when)
            found = docs.join(found.drop("published_at"), list(KEY), "left")
        at = {t: F.col(f"p{k}") for k, t in enumerate(terms)}
        return found.where(condition(alternatives, at)).select(*KEY, "published_at")

    def retrieve(self, query: str, as_of: Column, n: int) -> DataFrame:
        """The n best matches known on a day: rank, then newest, then largest source_id."""
        return self.match_any(query, known_by(as_of)).orderBy(F.desc("rank"), F.desc("published_at"), F.desc("source_id")).limit(n)

    def with_quotas(self, query: str, as_of: Column, quotas: dict[str, int], days: int = 365) -> DataFrame:
        """The best matches of each document type up to its quota, within a window of days."""
        found = self.match_any(query, known_by(as_of, days) & F.col("document_type").isin(*quotas))
        quota = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
        w = Window.partitionBy("document_type").orderBy(F.desc("rank"), F.desc("published_at"), F.desc("source_id"))
        return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= quota[F.col("document_type")])


def known_by(as_of: Column, days: int | None = None) -> Column:
    """Published before the end of the day (UTC); within the last `days` if given."""
    out = F.col("published_at") < F.date_add(as_of, 1).cast("timestamp")
    return out if days is None else out & (F.col("published_at") >= F.date_sub(as_of, days).cast("timestamp"))


def parsed(query: str) -> list[list[tuple[bool, list[tuple[int, str]]]]]:
    """Alternatives of parts (unwanted, [(place, lexeme)])."""
    out: list[list] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            out.append([])
        else:
            out[-1].append((bool(minus), lexemes(phrase or word)))
    return [parts for parts in out if parts]


def condition(alternatives: list, at: dict[str, Column]) -> Column:
    """The condition on a document's places of each lexeme (a struct of title and body, null if it has none)."""

    def occurs(phrase: list[tuple[int, str]]) -> Column:
        if len(phrase) == 1:
            return at[phrase[0][1]].isNotNull()
        (first, head), rest = phrase[0], phrase[1:]

        def within(side: str) -> Column:
            follows = lambda p: _all([F.array_contains(at[t][side], (p + (n - first)).cast("int")) for n, t in rest])
            return F.coalesce(F.exists(at[head][side], follows), F.lit(False))

        return within("title") | within("body")

    def part(minus: bool, phrase: list) -> Column:
        if not phrase:
            return F.lit(True)
        return ~occurs(phrase) if minus else occurs(phrase)

    out = F.lit(False) if alternatives else F.lit(True)
    for parts in alternatives:
        out = out | _all([part(*p) for p in parts])
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
