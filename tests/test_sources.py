"""Merges, sinks, readers and streaming ingest."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from vintra.operators import writes
from vintra.sources import readers, sinks
from vintra.sources.merge import Merged, MergedTable
from vintra.streaming import ingest

SHAPE = "day string, id int, v string"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def files(tmp_path):
    return {str(p) for p in tmp_path.rglob("*.parquet")}


def test_merge_touches_only_its_partitions(spark, path, tmp_path):
    table = MergedTable(spark, path, ["day", "id"], "day")
    assert table.read() is None
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], SHAPE)
    assert table.insert(first) == Merged(inserted=4, partitions=3)
    before = files(tmp_path)
    assert table.insert(first) == Merged(unchanged=4) and files(tmp_path) == before and table.version() == 1  # a second run writes nothing
    old = table.manifest()["partitions"]
    assert table.upsert(spark.createDataFrame([("a", 2, "w"), ("a", 3, "q"), ("a", 1, "x")], SHAPE), ["v"]) == Merged(1, 1, 1, 1)
    assert held(table) == [("a", 1, "x"), ("a", 2, "w"), ("a", 3, "q"), ("b", 1, "z"), (None, 1, "n")]
    new = table.manifest()["partitions"]
    assert sum(new[p] != old[p] for p in old) == 1 and before <= files(tmp_path)  # others' files as they were
    assert table.upsert(spark.createDataFrame([(None, 1, "m"), ("c", 9, None)], SHAPE), ["v"]) == Merged(1, 1, 0, 2)
    assert table.vacuum() > 0 and len(held(table)) == 6


def test_a_killed_merge_leaves_the_old_version(spark, path, monkeypatch):
    table = MergedTable(spark, path, ["id"])
    table.insert(spark.createDataFrame([("a", 1, "x")], SHAPE))
    rows = spark.createDataFrame([("a", 1, "new"), ("a", 2, "y")], SHAPE)
    with monkeypatch.context() as m:
        m.setattr(MergedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.upsert(rows, ["day", "v"])
    assert held(table) == [("a", 1, "x")]
    assert table.upsert(rows, ["day", "v"]) == Merged(1, 1, 0, 1) and held(table) == [("a", 1, "new"), ("a", 2, "y")]


def test_two_writers_cannot_make_one_version(spark, path):
    table = MergedTable(spark, path, ["id"])
    table.insert(spark.createDataFrame([("a", 1, "x")], SHAPE))
    with pytest.raises(RuntimeError, match="another merge"):
        table._commit(1, table.manifest())
    assert held(table) == [("a", 1, "x")]


def test_the_last_of_equal_keys_counts(spark, path):
    table = MergedTable(spark, path, ["id"])
    rows = spark.createDataFrame([("b", 1, "later"), ("a", 1, "first")], SHAPE)
    assert table.upsert(rows, ["v"], last="day") == Merged(inserted=1, partitions=1) and held(table) == [("b", 1, "later")]
    known = spark.createDataFrame([("a", 1, "first")], SHAPE)
    assert [r["status"] for r in writes.upsert_status(known, rows, ["id"], ["v"], "day").collect()] == ["updated"]


def test_append_and_stream(spark, path, tmp_path):
    rows = spark.createDataFrame([("s", "2020-01-01", "2020-02-01", 1.0), ("s", "2020-01-01", "2020-03-01", 2.0)], "series_id string, observed_at string, as_of string, value double")
    key = ["series_id", "observed_at", "as_of"]
    assert sinks.append_absent(spark, path, rows.limit(1), key) == 1 and sinks.append_absent(spark, path, rows, key) == 1
    rows.unionAll(rows.withColumn("as_of", F.lit("2020-04-01"))).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run replays nothing
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        ingest.ingest(spark, stream, path, f"{tmp_path}/checkpoint-{uuid.uuid4().hex}").awaitTermination()
    assert MergedTable(spark, path, key).read().count() == 3


def test_windowed_means(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 3.0), ("2024-01-01 00:11:00", "a", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/e")
    source = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    ingest.windowed_means(source, "10 minutes", None, "1 hour").writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["n"], r["mean_value"]) for r in spark.table("means").collect()) == [(1, 5.0), (2, 2.0)]


def test_report(spark, tmp_path):
    sinks.report(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), f"{tmp_path}/r")
    assert [json.loads(x) for p in tmp_path.glob("r/part-*") for x in p.read_text().splitlines()] == [{"a": 1, "b": "x"}, {"a": 2}]


def test_vintages_and_csv(spark, tmp_path):
    page = {"observations": [{"date": "2020-01-01", "realtime_start": "2020-02-03", "value": "1.5"}, {"date": "2020-02-01", "realtime_start": "2020-03-03", "value": "."}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    got = [(str(r["observed_at"]), str(r["as_of"]), r["value"]) for r in readers.vintages_json(spark, f"{tmp_path}/p.json", "GDP").collect()]
    assert got == [("2020-01-01", "2020-02-03", 1.5), ("2020-02-01", "2020-03-03", None)]
    (tmp_path / "m.csv").write_text("name,day,flop\nA,2020-01-01,1e20\nB,,2e20\n")
    assert [r["name"] for r in readers.dated_csv(spark, f"{tmp_path}/m.csv", "name string, day date, flop double", ["day"]).collect()] == ["A"]
    with pytest.raises(ValueError, match="lacks"):
        spark.range(1).write.parquet(f"{tmp_path}/q")
        from vintra.schemas import OBSERVATIONS

        readers.parquet(spark, f"{tmp_path}/q", OBSERVATIONS)


def test_markets(spark):
    market = lambda **k: (json.dumps({"id": "1", "question": "q", "category": "c", "outcomes": '["Yes", "No"]', "outcomePrices": '["1", "0"]', "closed": True, "endDate": "2024-05-01T00:00:00Z"} | k),)
    rows = [market(), market(id="2", closed=False, outcomePrices='["0.3", "0.7"]'), market(id="3", outcomes='["A", "B"]'), market(id="4", outcomes='["No", "Yes"]', outcomePrices='["1", "0"]'), market(id="5", closed=None, outcomePrices="[]")]
    got = {r["id"]: (r["p_yes"], r["outcome"], r["closed"]) for r in readers.markets_json(spark.createDataFrame(rows, "payload string")).collect()}
    assert got == {"1": (1.0, "yes", True), "2": (0.3, None, False), "4": (0.0, "no", True), "5": (None, None, False)}
    ticks = spark.createDataFrame([("m", "2024-01-01 10:00:00", 0.2), ("m", "2024-01-01 23:00:00", 0.4), ("m", "2024-01-02 01:00:00", 0.5)], "market_id string, at string, price double").withColumn("at", F.col("at").cast("timestamp"))
    assert [(str(r["day"]), r["price"]) for r in readers.daily_prices(ticks, F.lit("2024-01-02").cast("date")).collect()] == [("2024-01-01", 0.4)]


def test_feed_and_counts(spark):
    feed = "<feed><entry><id>a/1</id><title>One</title><summary>S</summary><published>2024-01-02T10:00:00Z</published></entry><entry><id>a/2</id><title>Two</title><summary>T</summary><published>2024-01-05T10:00:00Z</published></entry></feed>"
    entries = readers.atom_entries(spark.createDataFrame([(feed,), (feed,)], "payload string"))
    assert sorted(r["title"] for r in entries.collect()) == ["One", "Two"]
    assert [(str(r["month"]), r["n"]) for r in readers.monthly_counts(entries, "published", []).collect()] == [("2024-01-01", 2)]


def test_surveys(spark):
    lines = ["Survey  Deadline", "1990 Q2   6/8/90", "     Q3   9/15/1990*", "note", "1991 Q1  3/2/91"]
    got = [(r["survey_year"], r["survey_quarter"], str(r["released"])) for r in readers.release_dates(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).collect()]
    assert got == [(1990, 2, "1990-06-08"), (1990, 3, "1990-09-15"), (1991, 1, "1991-03-02")]
    wide = spark.createDataFrame([(2020, 4, 1.0, 2.0, None, 4.0, 5.0, 6.0)], "YEAR int, QUARTER int, VAR1 double, VAR2 double, VAR3 double, VAR4 double, VAR5 double, VAR6 double")
    assert [(r["year"], r["quarter"], r["value"]) for r in readers.survey_long(wide).collect()] == [(2020, 3, 1.0), (2020, 4, 2.0), (2021, 2, 4.0), (2021, 3, 5.0), (2021, 4, 6.0)]


def test_marks(spark):
    days = lambda *x: spark.createDataFrame([(k, d) for k, d in x], "k string, day string").withColumn("day", F.col("day").cast("date"))
    through = lambda df: {r["k"]: str(r["through"]) for r in df.collect()}
    first = writes.gapless_through(days(("a", "2024-01-01"), ("a", "2024-01-02"), ("a", "2024-01-04"), ("b", "2024-01-01"), ("b", "2024-01-01"), (None, "2024-01-01"), ("c", None)), ["k"], "day")
    assert through(first) == {"a": "2024-01-02", "b": "2024-01-01", None: "2024-01-01"}
    moved = writes.gapless_through(days(("a", "2024-01-03"), ("a", "2024-01-04"), ("b", "2024-01-03"), ("a", "2023-12-01"), (None, "2024-01-02")), ["k"], "day", first)
    assert through(moved) == {"a": "2024-01-04", "b": "2024-01-01", None: "2024-01-02"}
