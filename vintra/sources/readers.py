"""Readers of the payloads that feed the tables: Parquet, dated CSV, market JSON, feed XML, release-date text, survey tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintra.schemas import missing_columns


def parquet(spark: SparkSession, path: str, expected: T.StructType | None = None) -> DataFrame:
    """Checks the stored schema against the declared one before anything is read."""
    df = spark.read.parquet(path)
    if expected is not None and (bad := missing_columns(df.schema, expected)):
        raise ValueError(f"{path} lacks {', '.join(bad)}")
    return df


def dated_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Strict CSV with a header; rows blank in a required column are skipped, anything malformed fails."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    for c in required:
        df = df.where(F.col(c).isNotNull())
    return df


def vintages_json(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """Observation pages {observations: [{date, realtime_start, value}]}; a value of '.' is a reported gap."""
    schema = "observations array<struct<date: string, realtime_start: string, value: string>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("observations").alias("o"))
    return rows.select(F.lit(series_id).alias("series_id"), F.to_date("o.date").alias("observed_at"), F.to_date("o.realtime_start").alias("as_of"), F.when(F.col("o.value") != ".", F.col("o.value")).cast("double").alias("value"), F.lit(False).alias("reconstructed"))


def markets_json(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Markets with list-in-string fields; only yes/no ones; the outcome is the side priced at 1 once closed."""
    m = F.from_json(payload, "id string, question string, category string, outcomes string, outcomePrices string, closed boolean, endDate string")
    names, prices = F.from_json("m.outcomes", "array<string>"), F.transform(F.from_json("m.outcomePrices", "array<string>"), lambda p: p.cast("double"))
    lower = F.transform(names, F.lower)
    yes = F.get(prices, (F.array_position(lower, "yes") - 1).cast("int"))
    out = raw.select(m.alias("m")).select("m.id", "m.question", "m.category", F.coalesce("m.closed", F.lit(False)).alias("closed"), F.to_timestamp("m.endDate").alias("end_at"), lower.alias("names"), yes.alias("p_yes"))
    out = out.where(F.array_sort("names") == F.array(F.lit("no"), F.lit("yes"))).drop("names")
    return out.withColumn("outcome", F.when(F.col("closed") & (F.col("p_yes") >= 0.999), "yes").when(F.col("closed") & (F.col("p_yes") <= 0.001), "no"))


def daily_prices(ticks: DataFrame, before: Column) -> DataFrame:
    """The last price of each complete UTC day."""
    day = F.to_date("at")
    return ticks.where(day < before).groupBy("market_id", day.alias("day")).agg(F.max_by("price", "at").alias("price"))


def atom_entries(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """id, title, summary and published of Atom feed entries, one row an entry, deduplicated by id."""
    feed = F.from_xml(F.col(payload), F.lit("entry array<struct<id: string, title: string, summary: string, published: timestamp>>"))
    return raw.select(F.explode(feed["entry"]).alias("e")).select("e.*").dropDuplicates(["id"])


def monthly_counts(items: DataFrame, at: str, by: list[str]) -> DataFrame:
    """Distinct ids by calendar month."""
    return items.groupBy(*by, F.trunc(F.col(at).cast("date"), "month").cast("date").alias("month")).agg(F.countDistinct("id").alias("n"))


def release_dates(lines: DataFrame) -> DataFrame:
    """(survey_year, survey_quarter, released) from lines such as '1990 Q2  6/8/90' in which the year stands only on its first
    line: the last one seen is carried on. lines: (line_no, line)."""
    year = F.regexp_extract("line", r"^\s*(\d{4})\b", 1)
    quarter = F.regexp_extract("line", r"\bQ([1-4])\b", 1)
    date = F.regexp_extract("line", r"(\d{1,2}/\d{1,2}/\d{2,4})", 1)
    rows = lines.select("line_no", F.when(year != "", year.cast("int")).alias("y"), F.when(quarter != "", quarter.cast("int")).alias("survey_quarter"), date.alias("d"))
    carried = rows.withColumn("survey_year", F.last("y", ignorenulls=True).over(Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    released = F.when(F.length(F.substring_index("d", "/", -1)) == 4, F.to_date("d", "M/d/yyyy")).otherwise(F.to_date("d", "M/d/yy"))
    # two digits are a year of this century to Spark; a survey is released within a year of its own
    near = F.when(F.year(released) > F.col("survey_year") + 1, F.add_months(released, -1200)).otherwise(released)
    return carried.where("survey_quarter is not null and d <> ''").select("survey_year", "survey_quarter", near.alias("released"))


def survey_long(medians: DataFrame, columns: int = 6) -> DataFrame:
    """(YEAR, QUARTER, VAR1..VARn) -> one row for each forecast quarter: column k of a survey is the quarter k - 2 after it."""
    stacked = ", ".join(f"{k}, VAR{k}" for k in range(1, columns + 1))
    rows = medians.selectExpr("YEAR as survey_year", "QUARTER as survey_quarter", f"stack({columns}, {stacked}) as (k, value)")
    index = F.col("survey_year") * 4 + F.col("survey_quarter") - 1 + F.col("k") - 2
    return rows.where("value is not null").select("survey_year", "survey_quarter", F.floor(index / 4).cast("int").alias("year"), (F.pmod(index, F.lit(4)) + 1).cast("int").alias("quarter"), "value")
