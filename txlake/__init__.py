"""Payment-transaction analytics on Spark: lake layers, quality, profiles, risk scoring, alerts, KPIs, masking."""

__version__ = "0.1.0"
