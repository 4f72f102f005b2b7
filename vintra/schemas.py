"""Declared schemas of the data model, and the values that its enumerations allow."""

from pyspark.sql import types as T

# The allowed members of each enumeration.
QUESTION_TYPES = ("numeric_interval", "probability", "binary")
MISS_CATEGORIES = ("expected_variance", "bad_data", "bad_model", "regime_change")
SERIES_KINDS = ("count", "percent", "log10")


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "map<string,double>": T.MapType(T.StringType(), T.DoubleType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()), "decimal(10,6)": T.DecimalType(10, 6)}


def _struct(text: str) -> T.StructType:
    """Names and types, read without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split(" ") for field in text.split(", "))])


OBSERVATIONS = _struct("series_id string, observed_at date, as_of date, value double, reconstructed boolean")
SERIES = _struct("series_id string, name string, units string, frequency string, domain string")
QUESTIONS = _struct("question_id long, target string, question_type string, domain string, target_date date, horizon_months int, lead_days int, question_key string, platform_question_id long")
FORECASTS = _struct("forecast_id long, question_id long, model_type string, forecast_date date, is_backtest boolean, prediction double, lower double, upper double, probabilities map<string,double>, error double, in_interval boolean, brier double, scored_at timestamp")
RESOLUTIONS = _struct("question_id long, actual_value double, actual_outcome string, actual_as_of date, latest_value double")
POSTMORTEMS = _struct("forecast_id long, category string, classified_by string, notes string, evidence map<string,double>")
PRICES = _struct("platform_question_id long, as_of date, p double")
RETRIEVAL_DOCUMENTS = _struct("document_type string, source_id string, title string, content string, published_at timestamp, metadata map<string,string>")
CALLS = _struct("call_id long, model string, input_tokens long, output_tokens long, cost_usd decimal(10,6), context_hash string, created_at timestamp, error string")
BACKTEST = _struct("series_id string, model string, forecast_date date, data_as_of date, max_as_of_seen date, target_period date, horizon_months int, prediction double, lower double, upper double, actual double, actual_as_of date, error double, abs_error double, squared_error double, in_interval boolean")


def missing_columns(schema: T.StructType, expected: T.StructType) -> list[str]:
    """Fields of expected that schema lacks or has with another type."""
    have = {f.name: f.dataType for f in schema}
    return [f.name for f in expected if have.get(f.name) != f.dataType]
