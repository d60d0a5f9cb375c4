"""RFM scoring by NTILE and the segment filter shared by all reports."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_range_filter, lit_date, segment_key, valid_status
from ..operators.ranking import ntiles
from ..sources.published import property_of, publish, read_published, stage


def customer_rfm(fact: DataFrame, d_from, d_to, as_of=None) -> DataFrame:
    """Per customer over valid items in [d_from, d_to]: frequency = distinct
    orders, monetary = exact sum, recency = days from the last order to
    ``as_of`` (default d_to)."""
    as_of = as_of or d_to
    base = fact.filter(date_range_filter(F.col("order_date"), d_from, d_to) & valid_status(F.col("status")))
    return (base.groupBy("customer_id")
            .agg(F.countDistinct("order_id").alias("frequency"),
                 F.sum("sale_price").alias("monetary"),
                 F.max("order_date").alias("last_order"))
            .withColumn("recency", F.datediff(lit_date(as_of), F.col("last_order")))
            .drop("last_order"))


def score_rfm(rfm: DataFrame, recency_tiebreak: bool = True) -> DataFrame:
    """Add r/f/m scores (NTILE 5) and the segment key.

    r: recency DESC; f: frequency ASC[, recency DESC]; m: monetary ASC[,
    recency DESC]; every order ends with customer_id ASC so ties are
    deterministic."""
    late = [-F.col("recency")] if recency_tiebreak else []
    scored = ntiles(rfm, {"r_score": [-F.col("recency")], "f_score": [F.col("frequency")] + late,
                          "m_score": [F.col("monetary")] + late}, "customer_id", 5)
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return scored.withColumn("rfm_total", total).withColumn("segment_key", segment_key(total))


def segment_customers(fact: DataFrame, d_to, as_of=None) -> DataFrame:
    """customer_id, segment_key over ALL valid history up to d_to."""
    return score_rfm(customer_rfm(fact, None, d_to, as_of)).select("customer_id", "segment_key")


def _names(segments) -> list[str]:
    if isinstance(segments, str):
        segments = segments.split(",")
    return [s.strip() for s in segments or [] if s.strip()]


def segment_filter(fact: DataFrame, d_to, segments) -> DataFrame | None:
    """``segments`` (list, comma separated text, or the customers themselves as
    ``SegmentStore.filter`` gives them) -> customers in them, or None."""
    if isinstance(segments, DataFrame):
        return segments.select("customer_id")
    names = _names(segments)
    if not names:
        return None
    return segment_customers(fact, d_to).filter(F.col("segment_key").isin(*names)).select("customer_id")


class SegmentStore:
    """Segments of all customers, ranked once for each as-of day and state of the fact.

    The segments of a day are a published table (``<prefix>segments_<day>``) that carries the
    fact's high-water mark. Reports of the same day read it and rank nothing; once the
    mark has moved the next one ranks again and replaces it. ``forget`` drops a day."""

    def __init__(self, spark, base_path: str, prefix: str = ""):
        self.spark, self.base_path, self.prefix = spark, base_path, prefix

    def _table(self, d_to) -> str:
        return f"{self.prefix}segments_{str(d_to).replace('-', '')}"

    @staticmethod
    def mark(fact: DataFrame) -> str:
        """High-water mark of a fact: its last day and its rows (one aggregate over one column)."""
        row = fact.agg(F.max("order_date").alias("last"), F.count(F.lit(1)).alias("n")).first()
        return f"{row.last}/{row.n}"

    def customers(self, fact: DataFrame, d_to, mark: str | None = None) -> DataFrame:
        """``customer_id``, ``segment_key`` as of ``d_to``, from the store if the mark is that of the stored ones."""
        mark, table = mark or self.mark(fact), self._table(d_to)
        if property_of(self.spark, table, "mark") != mark:
            fresh = segment_customers(fact, d_to)
            publish(self.spark, table, [stage(fresh, self.base_path, table)], fresh.columns, {"mark": mark})
        return read_published(self.spark, table)

    def filter(self, fact: DataFrame, d_to, segments, mark: str | None = None) -> DataFrame | None:
        """Customers in the named segments, for the ``segments`` argument of any report; None without names."""
        names = _names(segments)
        return self.customers(fact, d_to, mark).filter(F.col("segment_key").isin(*names)).select("customer_id") if names else None

    def forget(self, d_to) -> None:
        self.spark.sql(f"DROP VIEW IF EXISTS `{self._table(d_to)}`")
