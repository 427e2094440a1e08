"""Columns of users' tables under names that no operator makes, so that none can clash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boxed(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ... by their places; `.toDF(*docs.columns)` names them back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def box(docs: DataFrame, column: str) -> str:
    """The name in boxed(docs) of a column, the first of that name."""
    return f"c{docs.columns.index(column)}"


def named(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns of docs, under the names of the arguments."""
    return boxed(docs).select(*[F.col(box(docs, c)).alias(name) for name, c in columns.items()])


def free_name(docs: DataFrame, name: str) -> str:
    """name, or with as many underscores after it as it takes to differ from every column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
