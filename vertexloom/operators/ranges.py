"""Where a property is compared by order with a tag: few keys, many rows on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.sources.spec import quoted

#: Comparisons by order; a property is on the left.
OPS = ("<", "<=", ">", ">=")
#: Rows of a block: pairs of blocks are what is sent, a share of 4 / BLOCK of the pairs of rows.
BLOCK = 512


def _holds(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _blocks(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Rows of equal keys in order of a value, ``BLOCK`` at a time; null keys and values are dropped, for they meet nothing."""
    named = [F.col(quoted(k)).alias(f"{side}k{i}") for i, k in enumerate(keys)]
    names = [f"{side}k{i}" for i in range(len(keys))]
    df = df.where(reduce(lambda a, b: a & b, (F.col(quoted(c)).isNotNull() for c in [*keys, value])))
    df = df.select(*named, F.col(quoted(value)).alias(f"{side}v"), F.struct(*[quoted(c) for c in df.columns]).alias(f"{side}row"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(f"{side}v"))
    df = df.withColumn(f"{side}b", F.floor((place - 1) / BLOCK))
    return df.groupBy(*names, f"{side}b").agg(F.collect_list(f"{side}row").alias(f"{side}rows"), F.min(f"{side}v").alias(f"{side}lo"), F.max(f"{side}v").alias(f"{side}hi"))


def pairs(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], tag: str, op: str, value: str) -> DataFrame:
    """An inner join that keeps all pairs with ``value op tag`` and some others: ``tag`` is the left's, ``value`` the right's.

    A plain join sends rows of a key to one task, or lets the tasks that read the left do all work: with few keys and
    small files a handful of tasks make all pairs.  Here whole blocks are joined, those that can't match dropped by
    their bounds, and what is left is dealt over all tasks, which hold two blocks at a time.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = _blocks(left, [x for x, _ in on], tag, "l"), _blocks(right, [x for _, x in on], value, "r")
    meet = _holds(op, F.col("rhi"), F.col("llo")) if op in (">", ">=") else _holds(op, F.col("rlo"), F.col("lhi"))
    same = reduce(lambda x, y: x & y, (F.col(f"lk{i}") == F.col(f"rk{i}") for i in range(len(on))))
    keys = [f"lk{i}" for i in range(len(on))]
    dealt = a.join(b, same & meet).select(*keys, "lb", "rb", "lrows", "rrows").repartition(n, *keys, "lb", "rb")
    return dealt.select("lrows", F.inline("rrows")).select("*", F.inline("lrows")).select(*[quoted(c) for c in [*left.columns, *right.columns]])


def counts(starts: DataFrame, inner: DataFrame, keys: list[str], tag: str, op: str, value: str, count: str, exists: str | None = None) -> DataFrame:
    """For each of the distinct ``starts`` the number of rows of ``inner`` with its keys and ``value op tag``, where there are any.

    Both are sorted together and counted in passing, so no pairs are made.  Where ``exists`` is false all rows count.
    """
    found = inner.where(reduce(lambda a, b: a & b, (F.col(quoted(c)).isNotNull() for c in keys)))
    if exists is None:
        found, starts = found.where(F.col(quoted(value)).isNotNull()), starts.where(F.col(quoted(tag)).isNotNull())
    found = found.groupBy(*[F.col(quoted(k)) for k in keys], F.col(quoted(value)).alias("x__")).agg(F.count(F.lit(1)).alias("n__"))
    strict = op in ("<", ">")
    a = found.select("*", F.lit(int(strict)).alias("side__"), F.lit(False).alias("asks__"))
    b = starts.select("*", F.col(quoted(tag)).alias("x__"), F.lit(0).cast("long").alias("n__"), F.lit(int(not strict)).alias("side__"), F.lit(True).alias("asks__"))
    by = Window.partitionBy(*[F.col(quoted(k)) for k in keys])
    x = F.col("x__").asc_nulls_last() if op in ("<", "<=") else F.col("x__").desc_nulls_last()
    passed = F.sum("n__").over(by.orderBy(x, "side__").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if exists is not None:
        passed = F.when(F.col(quoted(exists)), F.when(F.col("x__").isNotNull(), passed)).otherwise(F.sum("n__").over(by))
    out = b.unionByName(a, allowMissingColumns=True).withColumn(count, passed)
    return out.where(F.col("asks__") & (F.col(quoted(count)) > 0)).select(*[quoted(c) for c in [*starts.columns, count]])
