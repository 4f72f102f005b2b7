"""Dated full-text retrieval by scanning: for few documents, or those that no index holds. The rules are those of the lexeme index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintra.functions.stemming import lexemes as lexemes_of
from vintra.sources.lexeme_index import BODY_WEIGHT, TITLE_WEIGHT, ZETA2, Terms, condition, known_by, parsed


def lexemes(text: Column) -> Column:
    """Array of (place, lexeme): stemmed lower-case words without stop words, in order, repeats included."""

    @F.arrow_udf("array<struct<at int, term string>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Terms()
        for texts in parts:
            rows, places, numbers = terms.of(texts.to_pylist())
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))]).astype(np.int32)
            found = pa.array(terms.terms, pa.string()).take(pa.array(numbers))
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(places), found], names=["at", "term"]))

    return run(text)


def indexed(docs: DataFrame) -> DataFrame:
    """docs (title, content) with their lexemes, made once."""
    return docs.withColumn("title_terms", lexemes(F.col("title"))).withColumn("body_terms", lexemes(F.col("content")))


def rank(title: Column, body: Column, query: str) -> Column:
    """The rank that the index gives."""
    terms = sorted({t for _, t in lexemes_of(query)})
    squares = lambda n: F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda a, k: a + F.when(k > 0, 1 / (k * k).cast("double")).otherwise(0.0))
    total = F.lit(0.0)
    for term in terms:
        count = lambda of, term=term: F.size(F.filter(of, lambda x: x["term"] == term))
        a, b = count(title), count(body)
        total = total + TITLE_WEIGHT * squares(a) + BODY_WEIGHT * (squares(a + b) - squares(a))
    return total / ZETA2 / max(1, len(terms)) / F.log2(F.greatest(F.size(title) + F.size(body), F.lit(1)) + F.lit(1.0))


def published_by(docs: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """Published before the end of the day (UTC); within the last `days` if given."""
    return docs.where(known_by(as_of, days))


def match_any(docs: DataFrame, query: str) -> DataFrame:
    """Documents with any lexeme of the query; a query of stop words only matches all."""
    terms = sorted({t for _, t in lexemes_of(query)})
    return docs.where(F.exists("title_terms", lambda x: x["term"].isin(terms)) | F.exists("body_terms", lambda x: x["term"].isin(terms))) if terms else docs


def websearch(query: str) -> Column:
    """A condition on indexed documents: quoted phrases, or, and -word; everything else must occur."""
    alternatives = parsed(query)

    def places(term: str) -> Column:
        title, body = (F.transform(F.filter(of, lambda x: x["term"] == term), lambda x: x["at"]) for of in ("title_terms", "body_terms"))
        return F.when(F.size(title) + F.size(body) > 0, F.struct(title.alias("title"), body.alias("body")))

    return condition(alternatives, {t: places(t) for parts in alternatives for _, phrase in parts for _, t in phrase})


def retrieve(docs: DataFrame, query: str, as_of: Column, n: int) -> DataFrame:
    """The n best matches known on a day: rank, then newest, then largest source_id."""
    found = match_any(published_by(docs, as_of), query).withColumn("rank", rank(F.col("title_terms"), F.col("body_terms"), query))
    return found.orderBy(F.desc("rank"), F.desc("published_at"), F.desc("source_id")).limit(n)


def with_quotas(docs: DataFrame, query: str, as_of: Column, quotas: dict[str, int], days: int = 365) -> DataFrame:
    """The best matches of each document type up to its quota, within a window of days."""
    found = match_any(published_by(docs.where(F.col("document_type").isin(*quotas)), as_of, days), query).withColumn("rank", rank(F.col("title_terms"), F.col("body_terms"), query))
    w = Window.partitionBy("document_type").orderBy(F.desc("rank"), F.desc("published_at"), F.desc("source_id"))
    quota = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= quota[F.col("document_type")])
