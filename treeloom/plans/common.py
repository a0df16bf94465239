"""What the query modules share: a registry, and the leaves of documents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_LEAVES = r"""split_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source}),
lines AS (SELECT doc_id, unnest(generate_series(1, len(ls)))::INTEGER AS line, unnest(ls) AS words FROM split_lines),
cut AS (SELECT doc_id, line, regexp_extract_all(words, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+') AS ts FROM lines),
raw AS (SELECT doc_id, line, unnest(generate_series(1, len(ts)))::INTEGER AS pos, unnest(ts) AS text FROM cut),
leaves AS (SELECT doc_id, line, pos, CASE WHEN regexp_matches(text, '^\p{L}+$') THEN 'word' WHEN regexp_matches(text, '^\p{N}+$') THEN 'number' WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN 'mixed' ELSE 'punct' END AS type, text FROM raw)"""


def leaves_sql(source: str = "documents") -> str:
    return _LEAVES.replace("{source}", source)


LEAVES_SQL = leaves_sql()
TURNS_SQL = "turns AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, role, text FROM conversations),\n" + leaves_sql("turns")

UNIFIED_SQL = """unified AS (SELECT doc_id, line, pos, CASE type WHEN 'number' THEN 'literal' ELSE 'identifier' END AS type, lower(text) AS text, count(*) OVER (PARTITION BY doc_id, line) AS n_line FROM leaves WHERE type <> 'punct')"""


class Queries:
    """Queries by name, and the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
