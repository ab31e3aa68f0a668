"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the tokens its source has
sent up to it, divided by the source's target share. Taking the copies of all
sources in the order of their finish times serves them in proportion to their
shares at every moment; the queue is cut where the total reaches the budget.

Scale: before anything is sorted, a source's texts are cut to those that can come
up in time: as many rounds of copies as its goal needs, and of the last round the
texts whose hash lies below a bound taken from a histogram of 1024 counters. The
running sums come from a range sort: each task adds up its own stretch, the
totals of the stretches (a few rows a task) are added up once, and each stretch is
shifted by what lies before it. No window holds a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lecterna.llm.tokens import TOKENIZERS, VOCABULARY, sized
from lecterna.plans.lineage import written


def budget_of(available: dict[str, float], share: dict[str, float]) -> tuple[float, dict[str, float]]:
    """(budget, tokens of each source): the largest total that every source
    which has documents can serve with its share of it; the shares of sources
    without documents are divided among the others in proportion."""
    there = {s: share[s] for s, n in available.items() if n > 0 and share.get(s, 0) > 0}
    if not there:
        return 0.0, {}
    scale = sum(there.values())
    total = min(available[s] / (w / scale) for s, w in there.items())
    return total, {s: total * w / scale for s, w in there.items()}


def running(df: DataFrame, by: str, amount: str, order: list[str]) -> DataFrame:
    """``df`` with ``sum_before``, the total of ``amount`` of the rows of the same
    ``by`` that come before in ``order`` (which must begin with ``by``)."""
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "range")
    totals = parts.groupBy("_part", by).agg(F.sum(amount).alias("_total"))
    # one row for each stretch and source: bounded by tasks plus sources
    w = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(totals.withColumn("_before", F.coalesce(F.sum("_total").over(w), F.lit(0))).drop("_total"))
    inside = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_own", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(before, ["_part", by]).withColumn("sum_before", F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def mixed(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, budget: float | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, copy, tokens, finish): the mix, sorted in queue order by finish.

    Source names are compared without case and outer blanks. Each distinct text
    may be used up to the max_repeat times of its source, and is used a second
    time only after all of its source's texts were used once; a text that lies in
    several sources belongs to one of them, by hash. The budget is the
    largest at which every source still meets its share, unless ``budget`` asks for
    less or more; beyond it, a source that has run out falls short and the
    report says so. Null and empty texts, null sources and sources without a
    positive target give nothing; equal texts count once; empty
    tables give an empty result.
    """
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s 　]+", " ")))
    want = targets.groupBy(name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeat").alias("most")).where("share > 0 and most > 0")
    base = docs.select(F.col(id_col).alias("doc_id"), name(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).where("text <> '' and source is not null")
    base = sized(base.join(want, "source"), "text", tokenizers=tokenizers, vocabulary=vocabulary).where("tokens > 0")
    # a text delivered or copied under several ids is one text
    once = base.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"), F.first("share").alias("share"), F.first("most").alias("most"))
    one = F.min_by(F.struct("source", "doc_id", "tokens", "share", "most"), F.struct(F.xxhash64("digest", "source"), "source"))
    once = written(once.groupBy("digest").agg(one.alias("x")).select("x.*"), "sized")
    # a row for each source of the targets
    have = once.groupBy("source").agg(F.sum("tokens").alias("n"), F.first("share").alias("share"), F.first("most").alias("most")).collect()
    total, of = budget_of({r["source"]: float(r["n"] * r["most"]) for r in have}, {r["source"]: float(r["share"]) for r in have})
    if budget is not None and total > 0:
        of = {s: x / total * budget for s, x in of.items()}
    if not of:
        return once.select("doc_id", "source", F.lit(1).alias("copy"), "tokens", F.lit(0.0).alias("finish")).where("false")
    known = {r["source"]: r for r in have}
    rounds = {s: int(min(known[s]["most"], x // known[s]["n"] + 1)) for s, x in of.items()}
    weight = {s: x / sum(of.values()) for s, x in of.items()}
    goal = docs.sparkSession.createDataFrame([(s, x, weight[s], rounds[s], x - (rounds[s] - 1) * float(known[s]["n"])) for s, x in of.items()], "source string, goal double, weight double, rounds int, rest double")
    # shuffled within each round of copies, the same way in every run
    turn = lambda copy: F.xxhash64(F.lit(seed), "doc_id", copy)
    slot = lambda r: F.shiftright(r, 54)
    texts = once.join(F.broadcast(goal), "source")
    hist = texts.groupBy("source", "rest", slot(turn(F.col("rounds"))).alias("slot")).agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = hist.withColumn("before", before).where("before <= rest").groupBy("source").agg(F.max("slot").alias("last"))
    copies = texts.join(F.broadcast(last), "source").select("doc_id", "source", "tokens", "weight", "rounds", "last", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("copy")).withColumn("r", turn(F.col("copy")))
    copies = copies.where((F.col("copy") < F.col("rounds")) | (slot(F.col("r")) <= F.col("last"))).drop("rounds", "last")
    queue = running(copies, "source", "tokens", ["source", "copy", "r", "doc_id"])
    queue = queue.select("doc_id", "source", "copy", "tokens", ((F.col("sum_before") + F.col("tokens")) / F.col("weight")).alias("finish"), F.lit(0).alias("all"))
    end = sum(min(x, float(known[s]["n"] * known[s]["most"])) for s, x in of.items())
    # the one queue of all sources; its last text is taken if that brings the total nearer to the budget
    queue = running(queue, "all", "tokens", ["all", "finish", "source", "doc_id", "copy"])
    kept = queue.where(F.col("sum_before") + F.col("tokens") / 2 <= end)
    return kept.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "tokens", "finish").repartitionByRange("finish", "source", "doc_id", "copy").sortWithinPartitions("finish", "source", "doc_id", "copy")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, texts, most_copies) of a mix, a row
    for every source of ``targets``."""
    name = F.lower(F.trim(F.col("source")))
    want = targets.groupBy(name.alias("source")).agg(F.sum("target_share").alias("target_share"))
    got = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"), F.max("copy").alias("most_copies"))
    every = want.join(got, "source", "left").fillna(0, ["tokens", "texts", "most_copies"])
    total = Window.partitionBy()
    return every.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(total)), F.lit(0.0))).select("source", "target_share", "actual_share", "tokens", "texts", "most_copies")
