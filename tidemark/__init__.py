"""Spark-first analytics: daily price series, portfolios, and (in ``tidemark.llm``) training-data operators."""
