"""Column expressions: dirty-number parsing, features, errors, bands and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costweave import fixed_values as fv

# What counts as a number. Spark's cast alone would also take '12d', 'nan' and '0x1p3'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# ---- parsing --------------------------------------------------------------

def parse_number(text: Column) -> Column:
    """Text to DOUBLE; anything that is not plainly a number becomes NULL."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def parse_slash_number(text: Column) -> Column:
    """Mean of the slash-separated numbers in a cell; NULL if one of them is no number."""
    several = F.transform(F.split(text, "/"), parse_number)
    mean = F.aggregate(several, F.lit(0.0), lambda total, x: total + x) / F.size(several)
    return F.when(text.contains("/"), mean).otherwise(parse_number(text))


def parse_dollars(text: Column) -> Column:
    """'$1,234.50' to 1234.5."""
    return parse_number(F.regexp_replace(text, "[$,]", ""))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


# ---- features -------------------------------------------------------------

def share_0_1(value: Column) -> Column:
    """A share given as 0-1 or 0-100, as 0-1 (exactly 1 is read as 100 %)."""
    return F.when(value > 1, value / 100).otherwise(value)


def station_density(stations: Column, length_km: Column) -> Column:
    return F.try_divide(stations, length_km + F.lit(fv.LENGTH_OFFSET))


def safe_log(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def mid_year(start: Column, end: Column) -> Column:
    return (start + end) / 2


def flag_to_double(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


# ---- errors and bands -----------------------------------------------------

def relative_error(true_log: Column, pred_log: Column) -> Column:
    """(prediction - truth) / truth on the original scale, from two logs."""
    true = F.exp(true_log)
    return (F.exp(pred_log) - true) / true


def safe_q10(q10: Column) -> Column:
    """A lower multiplier never below zero; NULL stays NULL."""
    return F.when(q10.isNotNull(), F.greatest(F.lit(0.0), q10))


def safe_q90(q10: Column, q90: Column) -> Column:
    """An upper multiplier at least the minimum width above the safe lower one."""
    return F.when(q90.isNotNull(), F.greatest(safe_q10(q10) + F.lit(fv.MIN_BAND_WIDTH), q90))


def total_budget_billions(cost_per_km: Column, length_km: Column) -> Column:
    return cost_per_km * length_km / 1000


# ---- display --------------------------------------------------------------

def match_percent(score: Column, max_score: float = fv.MAX_SIMILARITY) -> Column:
    """Whole percent of the best possible score, halves to even, within 0-100."""
    percent = F.least(F.greatest(score / max_score * 100, F.lit(0.0)), F.lit(100.0))
    return F.bround(percent, 0).cast("int")


def fixed_text(value: Column, decimals: int) -> Column:
    """A fixed number of decimals, rounded half to even on the exact value, without grouping."""
    return F.regexp_replace(F.format_number(value, decimals), ",", "")


def percent_text(share: Column, decimals: int = 1) -> Column:
    return F.concat(fixed_text(share * 100, decimals), F.lit("%"))


def whole_percent_text(share: Column) -> Column:
    """Share as a whole percent, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def signed_percent_text(percent: Column) -> Column:
    return F.concat(F.when(percent >= 0, "+").otherwise(""), fixed_text(percent, 1), F.lit("%"))


def money_text(amount: Column, decimals: int = 1, suffix: str = "") -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, decimals), F.lit(suffix))


def money_range_text(low: Column, high: Column, decimals: int = 1, suffix: str = "") -> Column:
    """'$lo – $hi', each bound with its own suffix."""
    return F.concat(money_text(low, decimals, suffix), F.lit(" – "), money_text(high, decimals, suffix))
