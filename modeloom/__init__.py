"""Spark-first analytics for multichannel time series."""
