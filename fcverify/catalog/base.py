"""Registry of queries: a Spark builder and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    sql: str | None
    digits: Mapping[str, int] = field(default_factory=dict)
    text: Sequence[str] = ()

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The result with dates as text and doubles rounded, like the SQL side."""
        df = self.build(spark, sf_dir)
        changes = {c: F.col(c).cast("string") for c in self.text}
        changes.update({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in self.digits.items()})
        return df.withColumns(changes) if changes else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        parts = [f"CAST({c} AS VARCHAR) AS {c}" for c in self.text]
        parts += [f"round({c}, {d}) + 0.0 AS {c}" for c, d in self.digits.items()]
        body = f"SELECT * REPLACE ({', '.join(parts)}) FROM ({self.sql})" if parts else self.sql
        return with_ctes(body)


ENTRIES: dict[str, Entry] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Prefix the common table expressions the text names, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text))
        for name, body in CTES.items():
            if name in words and name not in ordered:
                visit(body)
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    heads = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH {heads}\n{sql}"


def register(name: str, sql: str | None = None, digits: Mapping[str, int] | str | None = None, text: str = ""):
    """``digits`` as 'a b:4 c' gives column names with 6 decimals unless stated."""
    if isinstance(digits, str):
        digits = {d.split(":")[0]: int(d.split(":")[1]) if ":" in d else 6 for d in digits.split()}

    def wrap(build: Builder) -> Builder:
        if name in ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        ENTRIES[name] = Entry(name, build, sql, dict(digits or {}), text.split())
        return build

    return wrap
