"""Why a forecast missed, as ordered rules over columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
BAND, REVISION_SHARE, LEAST_MOVES, EXPECTED, PRICED, PRICED_SPREAD, TOLERANCE = 1.5, 0.25, 36, 0.2, 0.2, 0.10, 1e-9


def classify_numeric(prediction: Column, lower: Column, upper: Column, first: Column, latest: Column, last_known: Column, move_99: Column, n_moves: Column) -> Column:
    """Within 1.5 half-widths: expected. Else a revision that takes the error inside the band and a quarter of it away (half of
    it without a band): bad data. Else a move beyond the 99th percentile of at least 36 past moves: a new regime. Else the model."""
    now = F.coalesce(latest, first)
    error, revised = F.abs(prediction - first), F.abs(prediction - now)
    band = F.lit(BAND) * (upper - lower) / 2
    gain = error - revised
    by_data = (now != first) & F.when(band.isNotNull(), (revised <= band) & (gain >= REVISION_SHARE * error)).otherwise(gain >= error / 2)
    moved = F.when(n_moves >= LEAST_MOVES, F.abs(first - last_known) > move_99)
    return F.when(error <= band, "expected_variance").when(by_data, "bad_data").when(moved, "regime_change").otherwise("bad_model")


def classify_decision(p_outcome: Column, outcome: Column, spread: Column) -> Column:
    """A decision among hike, hold and cut that had 20 %: expected. Else whether the bill spread had priced it."""
    priced = F.when(outcome == "hike", spread >= PRICED_SPREAD).when(outcome == "cut", spread <= -PRICED_SPREAD).otherwise(F.abs(spread) < PRICED_SPREAD)
    return F.when(F.coalesce(p_outcome, F.lit(0.0)) >= EXPECTED, "expected_variance").when(spread.isNull() | priced, "bad_model").otherwise("regime_change")


def classify_binary(p_yes: Column, outcome: Column, reference: Column) -> Column:
    """The same with a reference probability (a market, a base rate) in the place of the spread, and a tolerance at 20 %."""
    side = lambda p: F.when(outcome == "yes", p).otherwise(1 - p)
    return F.when(side(p_yes) >= EXPECTED - TOLERANCE, "expected_variance").when(reference.isNull() | (side(reference) >= PRICED - TOLERANCE), "bad_model").otherwise("regime_change")
