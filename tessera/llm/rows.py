"""Identities of rows, for operators whose parts find back to a row whatever its id: null ids, repeated ids, one id with two texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that no table of a user has; a row's identity is a digest of its id and text in two halves, never null.
TAGS = ("__row_a", "__row_b")


def row_tags(id_col: str, text: str) -> list[Column]:
    """The two halves of the identity; rows that repeat both id and text (null equals null) have the same."""
    known = [F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text).isNull(), F.col(text)]
    return [F.xxhash64(*known).alias(TAGS[0]), F.xxhash64(*reversed(known), F.lit(1)).alias(TAGS[1])]


def with_tags(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select("*", *row_tags(id_col, text))


def rows_of(docs: DataFrame, chosen: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose identity is in ``chosen`` (TAGS); rows that repeat id and text are one document and come once.

    One shuffle deals the rows by their identity, both for the join and for leaving out repeated ones.
    """
    kept = with_tags(docs, id_col, text).join(chosen.select(*TAGS), list(TAGS), "left_semi")
    return kept.dropDuplicates(list(TAGS)).select(*docs.columns)


def rows_not_of(docs: DataFrame, chosen: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose identity is not in ``chosen`` (TAGS)."""
    return with_tags(docs, id_col, text).join(chosen.select(*TAGS), list(TAGS), "left_anti").select(*docs.columns)
