"""One-class anomaly analytics over gridded, time-ordered data, as PySpark DataFrame operators."""
