"""Column-level helpers. Everything here builds JVM expressions (no Python UDFs),
so the plans stay inside whole-stage codegen."""
from __future__ import annotations

import datetime as _dt
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
# Statuses that do not count as revenue.
INVALID_STATUSES = ["Cancelled", "Returned"]
# RFM total score thresholds (r+f+m, each 1..5) and their segment keys.
SEGMENT_THRESHOLDS = [(13, "Champion"), (10, "Loyal"), (7, "Potential"), (4, "At Risk")]
SEGMENT_FALLBACK = "Lost"
# Display labels of the RFM segments as the reports show them.
SEGMENT_DISPLAY = {
    "Champion": "\U0001f3c6 Champion",
    "Loyal": "\U0001f49a Loyal",
    "Potential": "\U0001f331 Potential",
    "At Risk": "⚠️ At Risk",
    "Lost": "❌ Lost",
}
# Churn-risk weight per segment used by the churn dashboard roll-up.
SEGMENT_CHURN_RISK = {"Champion": 5, "Loyal": 12, "Potential": 30, "At Risk": 65, "Lost": 85}
# Recommended action per segment (single-customer scoring).
SEGMENT_ACTION = {
    "Champion": "VIP treatment, early access, loyalty rewards",
    "Loyal": "Upsell & cross-sell, referral program",
    "Potential": "Nurture with personalized offers, free shipping threshold",
    "At Risk": "Win-back campaign, discount voucher, personal outreach",
    "Lost": "Last-chance promotion or deprioritize marketing spend",
}
# Default churn threshold in days.
CHURN_THRESHOLD_DAYS = 90


def lit_date(d) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d).cast("date")


def date_range_filter(col: Column, d_from, d_to) -> Column:
    """Half-open range ``col >= d_from AND col < d_to + 1 day`` (kept unwrapped so
    Parquet min/max statistics can skip row groups)."""
    cond = col < F.date_add(lit_date(d_to), 1)
    if d_from is not None:
        cond = (col >= lit_date(d_from)) & cond
    return cond


def valid_status(col: Column | None = None) -> Column:
    """``status NOT IN ('Cancelled','Returned')``; NULL status is rejected (3VL)."""
    col = F.col("status") if col is None else col
    return ~col.isin(*INVALID_STATUSES)


def idiv(num: Column, den: Column) -> Column:
    """Integral division (truncating) that stays exact on decimals and longs."""
    return F.call_function("div", num, den)


def ratio_round(num: Column, den: Column, digits: int) -> Column:
    """Exact half-up rounding of ``num/den`` to ``digits`` decimals, as DOUBLE.

    ``num`` must be a non-negative exact number (long or decimal); the division is
    carried out in integers, so Spark and any SQL engine agree bit for bit.
    NULL when ``den`` is 0.
    """
    scale = 10 ** digits
    n = num.cast("decimal(38,4)")
    q = idiv(n * F.lit(2 * scale) + den, den * F.lit(2))
    return F.when(den > 0, q.cast("double") / F.lit(float(scale)))


def half_even(col: Column, digits: int) -> Column:
    """Rounding of a double in two stated steps: to 9 decimals (half up), then to
    ``digits`` decimals, ties to the even digit, as DOUBLE. Any engine with decimals
    can follow it. It differs from Python's ``round`` only where the double
    lies within 5e-10 of a tie without being one (0.11374999999999999 gives
    0.1138, Python 0.1137), or is one in decimals but not in binary."""
    return F.bround(col.cast("decimal(38,9)"), digits).cast("double")


def money(col: Column) -> Column:
    """Money leaves the engine as DOUBLE after exact decimal arithmetic."""
    return col.cast("double")


def segment_key(total: Column) -> Column:
    """RFM total score -> segment key (CASE chain of the reports)."""
    expr = None
    for threshold, name in SEGMENT_THRESHOLDS:
        expr = F.when(total >= threshold, F.lit(name)) if expr is None else expr.when(total >= threshold, F.lit(name))
    return expr.otherwise(F.lit(SEGMENT_FALLBACK))


def map_lookup(col: Column, mapping: dict, default=None) -> Column:
    """Literal map lookup (small fixed dictionaries only)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = m[col]
    return out if default is None else F.coalesce(out, F.lit(default))


def segment_display(col: Column) -> Column:
    return map_lookup(col, SEGMENT_DISPLAY)


def monetary_bin(monetary: Column, width: int = 50) -> Column:
    """``(monetary/50)::int * 50`` with numeric->int rounding half away from zero."""
    return (F.round(monetary.cast("decimal(38,2)") / F.lit(width), 0).cast("long") * F.lit(width))


def date_id(col: Column) -> Column:
    """date/timestamp -> yyyymmdd int, NULL-safe."""
    return (F.year(col) * 10000 + F.month(col) * 100 + F.dayofmonth(col)).cast("int")


def title_case(col: Column) -> Column:
    """Python ``str.title()``: upper-case a letter that follows a non-letter,
    lower-case every other letter ("t-shirt & tops" -> "T-Shirt & Tops",
    "café" -> "Café"); letters are Unicode letters."""
    return _title_via_split(F.lower(col))


def _title_via_split(lowered: Column) -> Column:
    # Split into runs of letters and non-letters, upper-case the first char of
    # each letter run, then glue back together. Pure JVM higher-order functions.
    parts = F.regexp_extract_all(lowered, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cap = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.when(lowered.isNull(), None).otherwise(F.array_join(cap, ""))


def risk_band_cut(p: Column) -> Column:
    """Probability -> Low [0,.3], Medium (.3,.6], High (.6,1] (right-closed bins)."""
    return (F.when(p <= 0.3, F.lit("Low"))
            .when(p <= 0.6, F.lit("Medium"))
            .when(p <= 1.0, F.lit("High")))


def risk_threshold_api(p: Column) -> tuple[Column, Column]:
    """Probability -> (risk, prediction): >=.6 High/CHURN, >=.3 Medium/AT RISK, else Low/RETAINED."""
    risk = F.when(p >= 0.6, F.lit("High")).when(p >= 0.3, F.lit("Medium")).otherwise(F.lit("Low"))
    pred = F.when(p >= 0.6, F.lit("CHURN")).when(p >= 0.3, F.lit("AT RISK")).otherwise(F.lit("RETAINED"))
    return risk, pred


def coalesce_label(col: Column, label: str) -> Column:
    return F.coalesce(col, F.lit(label))
