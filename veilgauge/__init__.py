"""veilgauge: measure how re-identifiable free text is, on Spark DataFrames."""

__version__ = "0.1.0"
