"""All queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def blanks_only(sql: str) -> str:
    """SQL whose one-argument trim takes off blanks only, as Spark's does; DuckDB's takes off other spaces too."""
    made, i = [], 0
    while (j := sql.find("trim(", i)) >= 0:
        depth, k, comma = 1, j + 5, False
        while depth:
            depth += (sql[k] in "([") - (sql[k] in ")]")
            comma |= depth == 1 and sql[k] == ","
            if sql[k] == "'":
                k = sql.index("'", k + 1)
            k += 1
        inner = blanks_only(sql[j + 5 : k - 1])
        made += [sql[i:j], "trim(", inner, ")" if comma else ", ' ')"]
        i = k
    return "".join(made) + sql[i:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with SQL that gives the same rows where there is any."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = blanks_only(sql)
        return f

    return add


def _load() -> None:
    from lodestone.plans import q_corpus, q_intervals, q_io, q_more, q_retrieval, q_scores, q_stats, q_surface, q_windows  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
