"""Spark-first analytics for multivariate time series, with a corpus-building subpackage."""
