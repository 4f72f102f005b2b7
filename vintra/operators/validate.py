"""Checks that return their violations; a sound table has none."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LookaheadError(ValueError):
    """Something was seen before it was published."""


def assert_no_lookahead(df: DataFrame, seen: str = "max_as_of_seen", cutoff: str = "data_as_of") -> DataFrame:
    """df itself; fails if a row saw a vintage after its cutoff. One aggregate over two columns."""
    bad = df.where(F.col(seen) > F.col(cutoff)).limit(1).collect()
    if bad:
        raise LookaheadError(f"{seen} {bad[0][seen]} after {cutoff} {bad[0][cutoff]}")
    return df


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, nulls equal to nulls."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def question_violations(questions: DataFrame) -> DataFrame:
    """Questions whose type, horizon or key don't fit: numeric ones need a horizon in months, probability ones a lead in days and
    binary ones a key; never both a horizon and a lead."""
    one = F.col("horizon_months").isNotNull().cast("int") + F.col("lead_days").isNotNull().cast("int")
    fits = (
        F.when(F.col("question_type") == "numeric_interval", F.col("horizon_months").isNotNull())
        .when(F.col("question_type") == "probability", F.col("lead_days").isNotNull())
        .when(F.col("question_type") == "binary", F.col("question_key").isNotNull())
        .otherwise(False)
    )
    return questions.withColumn("problem", F.when(~fits, "type").when(one != 1, "horizon")).where("problem is not null")


def answer_violations(questions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions that don't fit their question's type: numbers for numeric ones, outcomes for the others, exactly one of them."""
    joined = resolutions.join(questions.select("question_id", "question_type"), "question_id")
    numeric = F.col("question_type") == "numeric_interval"
    return joined.where((numeric & (F.col("actual_value").isNull() | F.col("actual_outcome").isNotNull())) | (~numeric & (F.col("actual_outcome").isNull() | F.col("actual_value").isNotNull())))


def probability_violations(df: DataFrame, p: str | None = None, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Probabilities outside [0, 1] and intervals upside down."""
    bad: Column = F.lit(False)
    if p:
        bad = bad | ~F.col(p).between(0, 1)
    if lower and upper:
        bad = bad | (F.col(lower) > F.col(upper))
    return df.where(bad)
