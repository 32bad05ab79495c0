"""Lunario: monthly-series cleaning, tuning and forecasting as Spark jobs."""
