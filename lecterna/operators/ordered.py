"""Running values over the ordered rows of a key.

A window partitioned by the key sorts all its rows in one task. That is the plan
for keys of bounded length. Where some key is longer than ``MANY`` rows, the rows are
range-sorted by key and order instead, so that a long key lies in many tasks; each
stretch is computed by itself, and what a stretch hands on to the next ones (a row
for each task and key) is carried over. The result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lecterna.plans.lineage import written

#: Rows of a key that one task sorts.
MANY = 5_000_000
#: Inputs below this estimate aren't counted: no key of theirs has MANY rows.
SMALL_BYTES = 256 << 20


def long_keys(df: DataFrame, key: list[str]) -> bool:
    """Whether some key of ``df`` has more than ``MANY`` rows."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return False
    return bool(df.groupBy(*key).count().where(F.col("count") > MANY).limit(1).count())


def running(df: DataFrame, key: str | list[str], order: list[str], **cols: tuple[str, Column | str] | tuple[str, Column | str, bool]) -> DataFrame:
    """``df`` with a column for each of ``cols``: (kind, value) over the rows of the
    key up to this one, or (kind, value, False) up to the one before it. Kinds: sum,
    max, last (the last value that isn't null) and lag (the value of the row before).
    ``order`` must be total; a sum of nothing is 0, the others are null."""
    keys = [key] if isinstance(key, str) else key
    value = {n: F.expr(c[1]) if isinstance(c[1], str) else c[1] for n, c in cols.items()}
    kind = {n: c[0] for n, c in cols.items()}
    whole = {n: len(c) < 3 or c[2] for n, c in cols.items()}

    def over(n: str, by: list[str]) -> Column:
        w = Window.partitionBy(*by).orderBy(*order)
        rows = w.rowsBetween(Window.unboundedPreceding, 0 if whole[n] else -1)
        if kind[n] == "lag":
            return F.lag(F.struct(value[n].alias("v"))).over(w)
        if kind[n] == "last":
            return F.last(value[n], ignorenulls=True).over(rows)
        return (F.sum if kind[n] == "sum" else F.max)(value[n]).over(rows)

    def settled(n: str, x: Column) -> Column:
        return F.coalesce(x, F.lit(0)) if kind[n] == "sum" else x["v"] if kind[n] == "lag" else x

    if not long_keys(df, keys):
        return df.select("*", *[settled(n, over(n, keys)).alias(n) for n in cols])
    # written, as a range sort may place its borders elsewhere when it is done again
    parts = written(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_stretch", F.spark_partition_id()), "stretches")
    at = F.struct(*order)
    total = {"sum": lambda v: F.sum(v), "max": lambda v: F.max(v), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), at)), "lag": lambda v: F.max_by(F.struct(v.alias("v")), at)}
    ends = parts.groupBy("_stretch", *keys).agg(*[total[kind[n]](value[n]).alias(f"_total_{n}") for n in cols])
    w = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    join = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True), "lag": lambda c: F.last(c, ignorenulls=True)}
    before = ends.select("_stretch", *keys, *[join[kind[n]](f"_total_{n}").over(w).alias(f"_total_{n}") for n in cols])
    own = parts.select("*", *[over(n, ["_stretch", *keys]).alias(n) for n in cols])
    same = [F.col("x._stretch") == F.col("y._stretch"), *[F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]]
    both = own.alias("x").join(before.alias("y"), same)

    def joined(n: str) -> Column:
        a, b = F.col(f"x.{n}"), F.col(f"y._total_{n}")
        if kind[n] == "sum":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        if kind[n] == "max":
            return F.greatest(a, b)
        return settled(n, F.coalesce(a, b))

    return both.select(*[F.col(f"x.{c}") for c in df.columns], *[joined(n).alias(n) for n in cols])
