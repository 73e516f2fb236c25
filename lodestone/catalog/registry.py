"""Query registry and composition of SQL from named views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()
VIEWS: dict[str, str] = {}
queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
_TABLES: dict[tuple[str, str], "Tables"] = {}


def view(name: str, sql: str) -> None:
    """Name a SQL fragment; fragments may read other named fragments and the given tables. A name stands for one fragment."""
    if VIEWS.setdefault(name, sql) != sql:
        raise ValueError(f"two fragments are named {name}")


def needed(sql: str) -> list[str]:
    """Named fragments `sql` depends on, in an order in which each comes after its own inputs."""
    out: list[str] = []

    def visit(text: str, parents: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in VIEWS and word not in out and word not in parents:
                visit(VIEWS[word], (*parents, word))
                if word not in out:
                    out.append(word)

    visit(sql, ())
    return out


def compose(sql: str) -> str:
    """The statement DuckDB runs: every fragment it needs as a CTE."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed(sql))
    sql = sql.strip()
    if ctes and sql.upper().startswith("WITH "):
        sql = "," + sql[4:]
    head = f"WITH RECURSIVE {ctes}\n" if ctes else ""
    return (head + sql).replace("HASH256(", "sha256(")


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`, with its SQL where SQL can express it."""

    def wrap(fn: Callable[["Tables"], DataFrame]):
        queries[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            _sql[name] = sql
        return fn

    return wrap


def oracles() -> dict[str, str]:
    return {n: compose(s) for n, s in _sql.items()}


class Tables:
    """The given tables of one folder, the graph views bound to them and derived tables built once per session."""

    #: Relations that the edges are restricted to, if they are.
    rels: set[str] | None = None

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._views: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        """A given table or a bound view (lazy)."""
        if name not in self._views:
            if name in BASE:
                self._views[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._views[name] = self.sql(f"SELECT * FROM {name}")
        return self._views[name]

    def sql(self, text: str) -> DataFrame:
        """Bound views are plain SQL over the given tables; both engines read the same text."""
        names = needed(text)
        body = "\n".join([text, *(VIEWS[n] for n in names)])
        used = [b for b in BASE if re.search(rf"\b{b}\b", body)]
        ctes = [f"{b} AS (SELECT * FROM parquet.`{self.folder}/{b}.parquet`)" for b in used]
        ctes += [f"{n} AS ({VIEWS[n]})" for n in names]
        stmt = (f"WITH {', '.join(ctes)} " if ctes else "") + text
        return self.spark.sql(re.sub(r"HASH256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", stmt))

    def built(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table written once per session and folder, like the graph tables at rest."""
        if name not in self._built:
            from lodestone.common import cut

            self._built[name] = cut(make(), name)
        return self._built[name]

    def kept(self, name: str, make: Callable):
        """As `built`, for what consists of several written tables."""
        if name not in self._built:
            self._built[name] = make()
        return self._built[name]


def tables(spark: SparkSession, folder: str) -> Tables:
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, folder)
    return _TABLES[key]
