"""Similarity, clusters and roles of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lecterna.functions import vector as V


def knn(df: DataFrame, id_col: str, vec_col: str, k: int, *, blocks: int | None = None, block: int = 4000) -> DataFrame:
    """(id, other, sim, rank): the exact k nearest by inner product, ties to the
    smaller id. Blocked: vectors are cut into blocks by hash, each pair of blocks
    is one task with one matrix product and a local top-k; only k rows a vector
    and block leave the task."""
    n = df.count()
    m = blocks or max(1, -(-n // block))
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"))
    a = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(F.col("blk").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "id", "vec")
    b = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(F.col("other").alias("i"), F.col("blk").alias("j"), F.lit(1).alias("side"), "id", "vec")

    def top(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g.side == 0], g[g.side == 1].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        s = np.stack(x.vec.to_numpy()).astype(np.float64) @ np.stack(y.vec.to_numpy()).astype(np.float64).T
        ids, others = x.id.to_numpy(), y.id.to_numpy()
        s[ids[:, None] == others[None, :]] = -np.inf
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        v = np.take_along_axis(s, at, 1)
        out = pd.DataFrame({"id": np.repeat(ids, at.shape[1]), "other": others[at].ravel(), "sim": v.ravel()})
        return out[np.isfinite(out.sim)]

    t = base.schema["id"].dataType.simpleString()
    local = a.unionByName(b).groupBy("i", "j").applyInPandas(lambda g: top(g), f"id {t}, other {t}, sim double")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def affinity_edges(near: DataFrame, least: float) -> DataFrame:
    """(src, dst, weight): the links of a neighbour table that are strong enough."""
    return near.where((F.col("sim") >= least) & (F.col("id") != F.col("other"))).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("sim").alias("weight"))


def isolated(df: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """Ids without any link."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(id_col)).distinct()
    return df.select(id_col).join(ends, id_col, "left_anti")


def centroids(df: DataFrame, label: str, vec_col: str) -> DataFrame:
    """(label, centroid): the mean vector of each label."""
    each = df.select(label, F.posexplode(vec_col).alias("pos", "v"))
    mean = each.groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return mean.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label): communities of a weighted graph; each round a node takes
    the label with the largest total weight around it, itself included with its
    strongest link, ties to the smaller label."""
    from lecterna.plans.lineage import written

    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    own = both.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    both = written(both.unionByName(own), "graph")
    labels = both.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        new = written(votes.groupBy("src").agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("label")).withColumnRenamed("src", "node"), "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            break
    return labels


def spectral(x: np.ndarray, *, neighbours: int = 10, largest: int = 20, seed: int = 42) -> np.ndarray:
    """Labels of one recording's vectors: pruned affinity, graph Laplacian,
    number of clusters by the eigengap, k-means on the eigenvectors. Fewer than
    ten rows are one cluster."""
    n = len(x)
    if n < 10:
        return np.zeros(n, np.int64)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a = 0.5 * (1 + u @ u.T)
    keep = n - (max(n - neighbours, 2) if n < 1000 else int(n * 0.99))
    cut = np.argsort(a, axis=1, kind="stable")[:, : n - keep]
    g = np.ones_like(a)
    np.put_along_axis(g, cut, 0, 1)
    g = 0.5 * (g + g.T)
    np.fill_diagonal(g, 0)
    values, vectors = np.linalg.eigh(np.diag(g.sum(1)) - g)
    gaps = np.diff(values[: min(largest + 1, n)])
    k = max(int(gaps.argmax()) + 1, 2)
    return kmeans(vectors[:, :k], k, seed)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> np.ndarray:
    """Lloyd's algorithm from a spread start, best of ten."""
    g = np.random.default_rng(seed)
    best, out = np.inf, np.zeros(len(x), np.int64)
    for _ in range(10):
        c = x[[int(g.integers(len(x)))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[int(g.choice(len(x), p=d / d.sum()))] if d.sum() > 0 else x[0]])
        for _ in range(rounds):
            label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.vstack([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        d = ((x - c[label]) ** 2).sum()
        if d < best - 1e-12:
            best, out = d, label
    return out


def spectral_by(df: DataFrame, key: str, id_col: str, vec_col: str) -> DataFrame:
    """(key, id, cluster): spectral clusters of each key's vectors."""
    t, kt = df.schema[id_col].dataType.simpleString(), df.schema[key].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id_col)
        return pd.DataFrame({key: g[key], id_col: g[id_col], "cluster": spectral(np.stack(g[vec_col].to_numpy()).astype(float))})

    return df.select(key, id_col, vec_col).groupBy(key).applyInPandas(run, f"{key} {kt}, {id_col} {t}, cluster long")


def merged_by_cosine(labels: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Clusters whose centres are ``least`` or more alike, joined one pair at a time."""
    labels = labels.copy()
    while len(ids := np.unique(labels)) > 1:
        c = np.stack([x[labels == i].mean(0) for i in ids])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        s = c @ c.T
        np.fill_diagonal(s, -1)
        i, j = divmod(int(s.argmax()), len(ids))
        if s[i, j] < least:
            break
        labels[labels == ids[max(i, j)]] = ids[min(i, j)]
    return labels


def recall_ratio(df: DataFrame, id_col: str, vec_col: str, confirmed: DataFrame, near: DataFrame, *, least: float = 0.4, seeds: int = 10_000) -> DataFrame:
    """(id, ratio, matches, recalled): for ids outside ``confirmed`` the share of
    confirmed vectors that are alike, the confirmed ones among the 19 nearest,
    and whether both make it one of them. ``confirmed`` is one speaker's set and is
    sent to all tasks up to ``seeds`` vectors; a larger one is joined in blocks."""
    own = df.join(confirmed.select(id_col), id_col).select(F.col(id_col).alias("seed"), F.col(vec_col).alias("sv"))
    rest = df.join(confirmed.select(id_col), id_col, "left_anti")
    total = own.count()
    if total <= seeds:
        rows = own.orderBy("seed").collect()
        t = np.stack([np.asarray(r["sv"], float) for r in rows]) if rows else np.zeros((0, 1))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.stack(b[vec_col].to_numpy()).astype(float) if len(b) else np.zeros((0, 1))
                hit = (x @ t.T >= least).sum(1) if len(t) and len(b) else np.zeros(len(b))
                yield pd.DataFrame({id_col: b[id_col], "hit": hit.astype(np.int64)})

        ratio = rest.select(id_col, vec_col).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, hit long")
    else:
        pairs = rest.withColumn("cell", F.pmod(F.xxhash64(id_col), F.lit(64))).join(own.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(63)))), "cell")
        ratio = pairs.groupBy(id_col).agg(F.sum((V.dot(F.col(vec_col), F.col("sv")) >= least).cast("long")).alias("hit"))
    m = near.where("rank <= 19").join(confirmed.select(F.col(id_col).alias("other")), "other").groupBy("id").agg(F.count("*").alias("matches")).withColumnRenamed("id", id_col)
    out = ratio.join(m, id_col, "left").fillna(0, ["matches"]).withColumn("ratio", F.col("hit") / F.lit(max(total, 1)))
    ok = ((F.col("ratio") > 0.4) & (F.col("matches") >= 5)) | ((F.col("ratio") > 0.3) & (F.col("matches") >= 8))
    return out.select(id_col, "ratio", "matches", ok.alias("recalled"))


def voted(votes: DataFrame, *, long_weight: float = 1.0, short_weight: float = 0.3) -> DataFrame:
    """(key, label, score, rank) of (key, label, is_long): long gaps weigh 1,
    short ones less and only for labels that have a long vote; without any long
    vote of the key, the commonest label."""
    n = votes.groupBy("key", "label").agg(F.sum(F.when(F.col("is_long"), 1).otherwise(0)).alias("n_long"), F.sum(F.when(F.col("is_long"), 0).otherwise(1)).alias("n_short"))
    any_long = F.max("n_long").over(Window.partitionBy("key")) > 0
    score = F.when(any_long & (F.col("n_long") > 0), F.col("n_long") * long_weight + F.col("n_short") * short_weight).when(~any_long, F.col("n_short").cast("double"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "label")
    return n.withColumn("score", score).where("score is not null").withColumn("rank", F.row_number().over(w)).select("key", "label", "score", "rank")


def teacher_of(votes: DataFrame) -> DataFrame:
    """(key, label): the teacher's label of ``voted`` counts (key, label, n_long,
    n_short, segments). A clear winner of the merged votes is it; where the two best
    are close, the better one of the unmerged votes if those are clear, else the
    one with more segments."""
    w = Window.partitionBy("key")
    some = F.max("n_long").over(w) > 0
    merged = F.when(F.col("n_long") > 0, F.col("n_long") + 0.3 * F.col("n_short"))
    v = votes.withColumn("m", merged).withColumn("some", some)
    rank = lambda c: F.row_number().over(w.orderBy(F.desc_nulls_last(c), "label"))
    v = v.withColumn("rm", rank("m")).withColumn("rl", rank("n_long")).withColumn("rs", rank("segments"))
    at = lambda r, c, k: F.max(F.when(F.col(r) == k, F.col(c)))
    g = v.groupBy("key").agg(
        F.max("some").alias("some"), at("rm", "m", 1).alias("a"), at("rm", "m", 2).alias("b"), at("rl", "n_long", 1).alias("c"), at("rl", "n_long", 2).alias("d"),
        at("rm", "label", 1).alias("best"), at("rl", "label", 1).alias("raw"), at("rs", "label", 1).alias("common"), at("rm", "segments", 1).alias("s1"), at("rm", "segments", 2).alias("s2"), at("rm", "label", 2).alias("second"),
    )
    close = (F.col("b") / F.col("a") > 0.75) | ((F.col("a") - F.col("b") < 10) & (F.col("a") > 50))
    clear = (F.col("d") / F.col("c") > 0.75) & (F.col("c") - F.col("d") > 10)
    longer = F.when(F.col("s2") > F.col("s1"), F.col("second")).otherwise(F.col("best"))
    return g.select("key", F.when(~F.col("some"), F.col("common")).when(F.col("b").isNull() | ~close, F.col("best")).when(clear, F.col("raw")).otherwise(longer).alias("label"))


def speaker_labels(x: np.ndarray, *, alike: float = 0.8, sizes: tuple[int, ...] = (30, 80, 200)) -> np.ndarray:
    """Labels of one recording: spectral clusters, joined where their centres are
    nearly equal; fewer vectors than the smallest size are one cluster if they are
    all alike."""
    if len(x) < sizes[0]:
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if len(x) < 2 or (u @ u.T).min() >= alike:
            return np.zeros(len(x), np.int64)
    return merged_by_cosine(spectral(x), x, alike)


def communities(x: np.ndarray, *, neighbours: int = 20, least: float = 0.4, rounds: int = 20) -> np.ndarray:
    """Labels by propagation over each row's most similar rows; rows without a link stay alone."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    near = np.argsort(-s, 1, kind="stable")[:, : min(neighbours, max(len(x) - 1, 0))]
    w = np.zeros_like(s)
    v = np.take_along_axis(s, near, 1)
    np.put_along_axis(w, near, np.where(v >= least, v, 0), 1)
    w = np.maximum(w, w.T)
    labels = np.arange(len(x))
    for _ in range(rounds):
        votes = np.zeros((len(x), len(x)))
        np.add.at(votes.T, labels, w)
        votes[np.arange(len(x)), labels] += w.max(1, initial=0)
        new = np.where(votes.max(1) > 0, votes.round(9).argmax(1), labels)
        if (new == labels).all():
            break
        labels = new
    return labels


def teacher_roles(x: np.ndarray, start: np.ndarray, end: np.ndarray, *, pause: float = 1.0, least: float = 0.4) -> np.ndarray:
    """0 for the teacher, 1 for others: the community that most long pauses follow,
    so far as a spectral cluster agrees with it, and what is recalled by its
    likeness to those sure segments."""
    n = len(x)
    if n < 2:
        return np.zeros(n, np.int64)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    info, spec = communities(x, least=least), speaker_labels(x)
    gap = np.r_[start[1:] - end[:-1], 0.0]
    score = {}
    for k in np.unique(info):
        long, short = ((info == k) & (gap >= pause)).sum(), ((info == k) & (gap > 0) & (gap < pause)).sum()
        score[int(k)] = (long + 0.3 * short if long else 0.3 * short / (n + 1), int((info == k).sum()), -int(k))
    teacher = max(score, key=score.get)
    own = [np.nonzero((info == teacher) & (spec == k))[0] for k in np.unique(spec)]
    sure = max(own, key=len)
    role = np.ones(n, np.int64)
    role[sure] = 0
    s = u @ u.T
    ratio = (s[:, sure] >= least).mean(1)
    top = np.argsort(-s, 1, kind="stable")[:, 1:20]
    match = np.isin(top, sure).sum(1)
    role[(ratio > 0.4) & (match >= 5) | (ratio > 0.3) & (match >= 8)] = 0
    return role


def roles(segments: DataFrame, key: str, id_col: str, vec_col: str, start: str, end: str, *, span: float = 14_400.0) -> DataFrame:
    """(key, id, role) of the segments of every recording, 0 for the teacher.

    A lesson is the unit: recordings are cut into spans of ``span`` seconds, so that
    one that never ends is many tasks and no task holds more than a span."""
    kind = lambda c: segments.schema[c].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([start, id_col])
        x = np.stack(g[vec_col].to_numpy()).astype(float)
        return pd.DataFrame({key: g[key], id_col: g[id_col], "role": teacher_roles(x, g[start].to_numpy(float), g[end].to_numpy(float))})

    t = segments.select(key, id_col, vec_col, start, end).withColumn("_span", F.floor(F.col(start) / span))
    return t.groupBy(key, "_span").applyInPandas(run, f"{key} {kind(key)}, {id_col} {kind(id_col)}, role long")
