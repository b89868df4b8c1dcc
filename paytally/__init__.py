"""Payment-event ingestion and pre-aggregated analytics on PySpark DataFrames."""

__version__ = "0.1.0"
