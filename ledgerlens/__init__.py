"""ledgerlens: customer analytics (star-schema ETL, dashboard reports, RFM feature
store, scoring models and drift monitoring) expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
