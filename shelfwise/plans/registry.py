"""Registered queries: (spark, sf_dir) -> DataFrame, plus their DuckDB oracle SQL.

Every query reads whole tables through the testdata adapter. Doubles are
rounded to 6 places in the returned frame (and in the oracle) so the two
engines' last-bit differences do not flip the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.plans import oracle as O
from shelfwise.sources import testdata
from shelfwise.sources.catalog import live_books, load_books, load_interactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Ctx(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


class Ctx:
    """Lazily built inputs shared by the registered queries."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.src = testdata.load(spark, sf_dir)
        self._memo: dict[str, object] = {}

    def memo(self, key, fn):
        if key not in self._memo:
            self._memo[key] = fn()
        return self._memo[key]

    @property
    def books(self) -> DataFrame:
        s = self.src
        return self.memo("books", lambda: load_books(s.books, s.authors, s.book_authors, s.genres, s.book_genres))

    @property
    def live(self) -> DataFrame:
        return self.memo("live", lambda: live_books(self.src.books))

    @property
    def interactions(self) -> DataFrame:
        s = self.src
        return self.memo("inter", lambda: load_interactions(s.ratings, s.reading_history, s.favorites))

    @property
    def content(self):
        """(store, items, profiles, seen) of the content model over the whole log."""
        from shelfwise.operators.content import fit_content
        return self.memo("content", lambda: fit_content(self.interactions, self.src.item_embeddings, self.live))

    def raw(self, table: str) -> DataFrame:
        return self.src.raw(table)


# Importing the query modules fills QUERIES / ORACLE.
from shelfwise.plans import (queries_base, queries_eval, queries_models, queries_reco,  # noqa: E402,F401,I001
                             queries_stream, queries_text)
