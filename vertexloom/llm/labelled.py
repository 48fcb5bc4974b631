"""A bounded sample of labelled rows, drawn by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Range of ``hash_share``.
SPACE = 1 << 30


def hash_share(*cols) -> Column:
    """A number in [0, 2^30) that depends on the given columns alone."""
    return F.pmod(F.xxhash64(F.lit(7), *cols), F.lit(SPACE))


def share(bound: int, count: int) -> int:
    return SPACE if count <= bound else int(SPACE * bound / count)


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, where: Column, id_col: str = "doc_id") -> DataFrame:
    """About ``bound`` rows (label, columns of ``docs``) with a 0/1 label, one row a document id.

    Ids are drawn from the label table, so only texts of drawn ids are looked
    at.  An id that repeats in either table counts once (its highest label).
    """
    known = labels.where(where & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("__label"))
    drawn = known.where(hash_share(F.col(id_col)) < share(bound, known.count())).limit(2 * bound)
    return docs.where(F.col(id_col).isNotNull()).join(F.broadcast(drawn), id_col)  # at most 2 * bound ids and labels
