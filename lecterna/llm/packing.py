"""Filling containers of fixed capacity by conflict-constrained best fit.

Items are packed longest first. Open bins are ordered by the room left in
them; each carries bitmaps of the sources and duplicate clusters it holds. The
search starts at the tightest bin that fits and goes on to the next until one is
found that doesn't conflict: a bin never holds two texts of one duplicate cluster
(texts of the same letters and digits), nor more than its share of one source.

Scale: items are dealt to shards by a hash of the item, its text and, for
repeated rows, their number, about ``SHARD`` items each, so that the number of tasks
grows with the items and a task's memory doesn't, and a text with a third of all
rows is spread over all shards; each shard ends with at most a few open bins, the
price of not packing in one place.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecterna.llm.tokens import TOKENIZERS, VOCABULARY, sized
from lecterna.plans.lineage import written

#: Items a shard; a larger shard wastes less, a smaller one needs less memory and time.
SHARD = 20_000
#: The part of a bin that one source may fill.
MOST_SHARE = 0.75


def best_fit(sizes: np.ndarray, groups: np.ndarray, sources: np.ndarray, capacity: int, most_share: float = 1.0) -> np.ndarray:
    """The bin of each item; items are given longest first and fit the capacity.

    ``groups``: a bin takes no two items of one group. ``sources``: a bin takes
    an item only while its source keeps to ``most_share`` of the capacity
    (an item that alone exceeds the share opens a bin of its own).
    """
    out = np.empty(len(sizes), np.int64)
    order: list[tuple[int, int]] = []  # (room, bin), ascending
    # bitmaps of the clusters and sources of a bin, 64 bits each; where a bit is set, the exact ones decide
    clusters: list[int] = []
    held: list[int] = []
    exact: list[set[int]] = []
    used: list[dict[int, int]] = []
    limit = int(capacity * most_share)
    for i, (s, g, src) in enumerate(zip(sizes.tolist(), groups.tolist(), sources.tolist())):
        bit, mark = 1 << (g & 63), 1 << (src & 63)
        at = bisect_left(order, (s, -1))
        while at < len(order):
            _, b = order[at]
            if not (clusters[b] & bit and g in exact[b]) and (used[b].get(src, 0) if held[b] & mark else 0) + s <= limit:
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(held)
            clusters.append(0)
            held.append(0)
            exact.append(set())
            used.append({})
        out[i] = b
        clusters[b] |= bit
        held[b] |= mark
        exact[b].add(g)
        used[b][src] = used[b].get(src, 0) + s
        if room - s > 0:
            insort(order, (room - s, b))
    return out


def packed(docs: DataFrame, containers: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, most_share: float = MOST_SHARE, shard: int = SHARD) -> DataFrame:
    """(container_id, bin, item, piece, tokens, capacity): where every text of
    ``docs`` goes in containers of every kind.

    An item is split only if it alone exceeds the capacity: into pieces of the
    full capacity and one rest, which is packed like an item. Null and empty
    texts (no tokens) aren't packed. A repeated row is an item of its own; texts
    that differ in case, blanks and marks at most never share a bin, and one source
    fills at most ``most_share`` of a bin, unless by a single item. Rows with a null
    id keep it; a null source is a source. Containers without a positive capacity take
    nothing; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("item"), F.lower(F.trim(F.coalesce(source_col, F.lit("")))).alias("source"), F.col(text_col).alias("text")).where("text <> ''")
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", "")
    base = base.withColumn("cluster", F.xxhash64(F.when(letters == "", F.col("text")).otherwise(letters)))
    items = sized(base, "text", tokenizers=tokenizers, vocabulary=vocabulary).where("tokens > 0").groupBy("item", "source", "cluster", "digest", "tokens").agg(F.count("*").alias("times"))
    items = written(items, "items")
    shards = max(1, -(-(items.agg(F.sum("times")).first()[0] or 0) // shard))
    # container kinds are few and fixed; they go into the plan
    kinds = [(r[0], r[1]) for r in containers.where("capacity_tokens > 0").select("container_id", F.col("capacity_tokens").cast("long")).distinct().collect()]
    box = containers.schema["container_id"].dataType.simpleString()
    item_type = base.schema["item"].dataType.simpleString()
    schema = f"container_id {box}, bin string, item {item_type}, piece long, tokens long, capacity long"
    if not kinds:
        return docs.sparkSession.createDataFrame([], schema)
    kind = F.explode(F.array(*[F.struct(F.lit(c).cast(box).alias("container_id"), F.lit(n).cast("long").alias("capacity")) for c, n in kinds])).alias("kind")
    each = items.select("item", "source", "cluster", "digest", F.col("tokens").alias("whole"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    each = each.withColumn("shard", F.pmod(F.xxhash64("item", "digest", "nth"), F.lit(shards)).cast("int")).select("*", kind).select("*", "kind.container_id", "kind.capacity").drop("kind")
    # whole containers of an oversize item are settled here; its rest is packed
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("whole") / F.col("capacity")) - 1)).alias("piece")
    pieces = each.select("*", piece).withColumn("tokens", F.least("capacity", F.col("whole") - F.col("piece") * F.col("capacity")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    full = pieces.where("tokens = capacity").select("container_id", F.concat_ws("-", F.lit("w"), text("item"), text("digest"), text("nth"), text("piece")).alias("bin"), "item", "piece", "tokens", "capacity")

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tokens", "digest", "nth", "piece", "item"], ascending=[False, True, True, True, True], kind="stable")
        src = pd.factorize(g["source"])[0]
        # pieces of one item, and copies of one text, are one cluster
        b = best_fit(g["tokens"].to_numpy(), g["cluster"].to_numpy(), src, int(g["capacity"].iloc[0]), most_share)
        return pd.DataFrame({"container_id": g["container_id"], "bin": [f"{key[1]}-{x}" for x in b], "item": g["item"], "piece": g["piece"], "tokens": g["tokens"], "capacity": g["capacity"]})

    rest = pieces.where("tokens < capacity").drop("whole").groupBy("container_id", "shard").applyInPandas(pack, schema)
    return rest.unionByName(full)


def fill(packing: DataFrame) -> DataFrame:
    """(container_id, bins, tokens, unused_share) of a packing."""
    bins = packing.groupBy("container_id", "bin").agg(F.sum("tokens").alias("t"), F.first("capacity").alias("c"))
    return bins.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"), (1 - F.sum("t") / F.sum("c")).alias("unused_share"))
