"""Panel demand forecasting as Spark DataFrame operators and batch jobs."""
