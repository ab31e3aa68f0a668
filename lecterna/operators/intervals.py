"""Interval and sequence algebra over keyed, ordered rows.

Every function takes the key and order columns by name; orders are completed
by the caller to total orders. Running values come from ``ordered.running``, which
spreads a long key over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lecterna.operators.ordered import running


def islands(df: DataFrame, key: str, start: str, end: str, gap: float, *, tie: str | None = None, inclusive: bool = True) -> DataFrame:
    """``df`` with ``island``: a new one begins where the start is ``gap`` or
    more (more, unless ``inclusive``) behind the end before it."""
    order = [start, *([tie] if tie else [])]
    rows = running(df, key, order, _before=("lag", end))
    d = F.col(start) - F.col("_before")
    new = F.when((d >= gap) if inclusive else (d > gap), 1).otherwise(0)
    return running(rows.withColumn("_new", new), key, order, island=("sum", "_new")).drop("_before", "_new")


def spans(df: DataFrame, key: str, start: str, end: str, gap: float, *, tie: str | None = None) -> DataFrame:
    """(key, island, start, end, n): the extent of each island."""
    return islands(df, key, start, end, gap, tie=tie).groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def merge_capped(df: DataFrame, key: str, start: str, end: str, *, cap: int, gap: int) -> DataFrame:
    """(key, start, end, n): greedy merge of ordered segments. A segment starts a
    new group when it is more than ``gap`` behind the one before it, or when the
    group would reach ``cap``. Which segment starts a group depends on the groups
    before it only within an island of small gaps, so islands are the unit of
    work: a long key is spread over as many tasks as it has islands."""
    rows = islands(df, key, start, end, gap, tie=end, inclusive=False).select(key, "island", F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {start} long, {end} long, n long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = head = last = None
        n = 0
        for x in batches:
            out: list[tuple] = []
            for k, i, b, e in zip(*(x.column(c).to_pylist() for c in range(4))):
                if at == (k, i) and e - head < cap:
                    last, n = e, n + 1
                    continue
                if at is not None:
                    out.append((at[0], head, last, n))
                at, head, last, n = (k, i), b, e, 1
            yield _batch(out, x.schema.field(0).type)
        if at is not None:
            yield _batch([(at[0], head, last, n)], x.schema.field(0).type)

    def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[key, start, end, "n"])

    # an island lies in one partition, its rows in order; the loop only carries the open group
    return rows.repartition(key, "island").sortWithinPartitions(key, "island", start, end).mapInArrow(merge, schema)


def complement(df: DataFrame, key: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """(key, start, end): what the intervals of each key leave free in [low, high]."""
    rows = running(df, key, [start, end], _before=("max", end, False))
    inner = rows.select(key, F.coalesce("_before", low).alias("s"), F.col(start).alias("e"))
    tail = df.groupBy(key).agg(F.max(end).alias("s"), high.alias("e"))
    free = inner.unionByName(tail.select(key, "s", "e"))
    return free.where("s < e").select(key, F.col("s").alias(start), F.col("e").alias(end))


def cut_long(df: DataFrame, start: str, end: str, length: int) -> DataFrame:
    """Pieces of at most ``length``; an exact multiple leaves no empty tail."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(end) - F.col(start)) / F.lit(length)).cast("int") - 1))).alias("piece")
    s = F.col(start) + F.col("piece") * length
    rest = [c for c in df.columns if c not in (start, end)]
    return df.where(F.col(start) < F.col(end)).select("*", at).select(*rest, "piece", s.cast("long").alias(start), F.least(F.col(end), s + length).cast("long").alias(end))


def slices(duration: Column, least: float) -> Column:
    """Durations of one-second slices; a tail shorter than ``least`` joins the last."""
    whole = F.floor(duration).cast("int")
    tail = duration - whole
    ones = F.array_repeat(F.lit(1.0), whole)
    return F.when(whole < 1, F.array(duration)).when(tail >= least, F.concat(ones, F.array(tail))).otherwise(F.concat(F.array_repeat(F.lit(1.0), whole - 1), F.array(1.0 + tail)))


def timeline(df: DataFrame, key: str, order: list[str], duration: str) -> DataFrame:
    """``df`` with ``at``: where each slice starts when all are put end to end."""
    return running(df, key, order, _sum=("sum", duration)).withColumn("at", F.col("_sum") - F.col(duration)).drop("_sum")


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value, first, last, n): runs of equal values by position."""
    rows = running(df, key, order, pos=("sum", F.lit(1)), _before=("lag", value))
    rows = rows.withColumn("_new", F.when((F.col("pos") > 1) & F.col("_before").eqNullSafe(F.col(value)), 0).otherwise(1))
    run = running(rows, key, order, run=("sum", "_new"))
    return run.groupBy(key, value, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("run")


def overlap_argmax(tokens: DataFrame, roles: DataFrame, key: str, bucket: int, *, token: str = "token_id", role: str = "role_id") -> DataFrame:
    """(key, token, role, overlap): the segment of ``roles`` (start, end) that
    overlaps each token (start, end) most, ties to the smaller role. Tokens
    without any overlap give no row.

    A range join through buckets of time: a pair meets once, in the bucket where
    its overlap begins, so nothing is compared across a whole key."""
    cells = lambda d, *cols: d.select(*cols, F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("cell"))
    a = cells(tokens, key, token, "start", "end")
    b = cells(roles, key, role, "start", "end").withColumnsRenamed({"start": "rs", "end": "re"})
    met = a.join(b, [key, "cell"]).where((F.col("start") < F.col("re")) & (F.col("rs") < F.col("end")) & (F.col("cell") == F.floor(F.greatest("start", "rs") / bucket)))
    both = met.withColumn("overlap", F.least("end", "re") - F.greatest("start", "rs"))
    best = both.groupBy(key, token).agg(F.max_by(F.struct(role, "overlap"), F.struct("overlap", -F.col(role))).alias("x"))
    return best.select(key, token, F.col(f"x.{role}").alias(role), F.col("x.overlap").alias("overlap"))


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, *, forward: bool = False, tie: str = "id") -> DataFrame:
    """``left`` (key, tie, time) with the value and time of the nearest row of
    ``right`` at or before it (``forward``: at or after). One sort of both sides
    together, no pairs."""
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_t": F.lit(None).cast(right.schema[time].dataType)})
    r = right.select(key, F.col(time), F.col(value).alias("_v"), F.col(time).alias("_t"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    # descending order by the negated time, so that one running value serves both ways
    at = F.col(time).cast("double") if dict(both.dtypes)[time] in ("double", "float") else F.col(time).cast("long")
    both = both.withColumns({"_at": -at if forward else at, "_nth": F.when(F.col("_side") == 1, F.lit(0)).otherwise(-F.col("_v").cast("double")) if dict(right.dtypes)[value] not in ("string",) else F.lit(0)})
    order = ["_at", "_side", "_nth", *(["_v"] if dict(right.dtypes)[value] == "string" else [])]
    rows = running(both, key, order, _x=("last", F.when(F.col("_side") == 0, F.struct("_v", "_t"))))
    return rows.where("_side = 1").select(*left.columns, F.col("_x._v").alias("near_value"), F.col("_x._t").alias("near_time"))


def pauses(df: DataFrame, key: str, order: list[str], start: str, end: str, text: str, skip: list[str], gap: float) -> DataFrame:
    """(key, pos): the positions after which a pause of ``gap`` or more lies;
    tokens to ``skip`` count as positions but neither open nor close a pause."""
    pos = running(df, key, order, pos=("sum", F.lit(1))).withColumn("pos", F.col("pos") - 1).where(~F.col(text).isin(skip))
    rows = running(pos, key, ["pos"], _before=("lag", end))
    return rows.withColumn("gap", F.col(start) - F.col("_before")).where(F.col("gap") >= gap).select(key, (F.col("pos") - 1).alias("pos"))


def moving_average(value: str, key: str, order: list[str], n: int = 3) -> Column:
    """Mean over ``n`` neighbours, zeros beyond the ends (always divided by n)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n // 2), n // 2)
    return F.sum(value).over(w) / F.lit(float(n))


def carried(df: DataFrame, key: str, order: list[str], name: str, value: Column, allowed: Column) -> DataFrame:
    """``df`` with ``name``, the value of the last row that was allowed to set one."""
    return running(df, key, order, **{name: ("last", F.when(allowed, value))})


def frames(x: Column, size: int, hop: int) -> Column:
    """Windows of ``size`` values every ``hop``; only whole ones."""
    n = F.floor((F.size(x) - size) / hop).cast("int")
    return F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(x, i * hop + 1, size))).otherwise(F.array().cast("array<array<float>>"))


def stacked(x: Column, m: int, n: int) -> Column:
    """Low frame rate: ``m`` neighbouring frames in one, every ``n``; the first
    frame is repeated on the left, the last one on the right."""
    left = (m - 1) // 2
    count = F.ceil(F.size(x) / F.lit(n)).cast("int")
    at = lambda k: F.element_at(x, F.greatest(F.lit(1), F.least(F.size(x), k)))
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: at(i * n + k - left + 1))))


def capped_stamps(stamps: Column, cap: Column) -> Column:
    """Token times whose ends are at most ``cap`` behind their begins."""
    return F.transform(stamps, lambda s: F.struct(s["b"].alias("b"), F.least(s["e"], s["b"] + cap).alias("e")))


def ctc_collapse(df: DataFrame, key: str, order: list[str], label: str, blank: object) -> DataFrame:
    """Rows whose label differs from the one before and isn't the blank."""
    rows = running(df, key, order, _prev=("lag", label))
    return rows.where((F.col("_prev").isNull() | (F.col("_prev") != F.col(label))) & (F.col(label) != blank)).drop("_prev")


def collapse(x: Column, blank: int = 0) -> Column:
    """An array of ids without repeats and blanks."""
    kept = F.filter(F.transform(x, lambda v, i: F.struct(v.alias("v"), F.when(i > 0, F.element_at(x, i)).alias("p"))), lambda s: (s["p"].isNull() | (s["p"] != s["v"])) & (s["v"] != blank))
    return F.transform(kept, lambda s: s["v"])


def allocated(span_start: Column, span_end: Column, weights: Column) -> Column:
    """A span dealt to its words by weight, in whole units carried on: each word
    starts where the one before ends, its length is cut to an integer."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, v: s + v)
    first = F.struct(F.array().cast("array<struct<b:int,e:int>>").alias("out"), span_start.cast("int").alias("at"))
    step = lambda a, v: F.struct(
        F.concat(a["out"], F.array(F.struct(a["at"].alias("b"), (a["at"] + ((span_end - span_start) * v / total).cast("int")).alias("e")))).alias("out"),
        (a["at"] + ((span_end - span_start) * v / total).cast("int")).alias("at"),
    )
    return F.aggregate(weights, first, step, lambda a: a["out"])


def peak_stamps(df: DataFrame, key: str, pos: str, value: str, *, least: float, offset: float, unit: float, longest: float) -> DataFrame:
    """(key, nth, start, end): a token from each peak to the next, at most ``longest`` units."""
    w = Window.partitionBy(key).orderBy(pos)
    peaks = df.where(F.col(value) > least).select(key, F.col(pos).alias("pos")).withColumn("next", F.lead("pos").over(w.orderBy("pos"))).withColumn("nth", F.row_number().over(w.orderBy("pos")))
    start = (F.col("pos") + offset) * unit
    end = (F.least("next", F.col("pos") + longest) + offset) * unit
    return peaks.where("next is not null").select(key, "nth", start.alias("start"), end.alias("end"))
