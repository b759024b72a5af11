"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; ``__spark_entry__`` adds the queries
of ``textlab.llm.queries`` only when the package is present.
"""
