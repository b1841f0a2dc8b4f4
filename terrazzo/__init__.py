"""A Spark-first analytics engine for posed point data and evidence tables."""
