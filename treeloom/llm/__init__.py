"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it. ``registry`` lists the queries and
their DuckDB counterparts; ``corpus_pipeline.py`` at the repository root chains
some of the operators.
"""
