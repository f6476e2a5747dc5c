"""A small collector of queries and their SQL."""

from __future__ import annotations


class Catalog:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, sql: str | None = None):
        """Registers the decorated query(spark, sf_dir); sql is what DuckDB runs for the same rows."""

        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def rounded(df, *names: str, digits: int = 4):
    """df with doubles rounded; names gives the columns, or none for all doubles."""
    from pyspark.sql import functions as F

    cols = names or [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})
