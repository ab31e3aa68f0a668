"""Detections: confidence, geometry, non-maximum suppression, order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confident(df: DataFrame, score: str, least: float, *, strict: bool = False) -> DataFrame:
    return df.where(F.col(score) > least if strict else F.col(score) >= least)


def clipped(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut to their own image; what is left empty is dropped."""
    c = lambda v, m: F.least(F.greatest(F.col(v), F.lit(0.0)), m)
    out = df.withColumns({"x1": c("x1", width), "x2": c("x2", width), "y1": c("y1", height), "y2": c("y2", height)})
    return out.where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))


def of_classes(df: DataFrame, classes: tuple[int, ...] = (2, 3, 11)) -> DataFrame:
    return df.where(F.col("cid").isin(list(classes)))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size as corners."""
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def rescaled(df: DataFrame, scale: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> DataFrame:
    """Boxes of a letterboxed image in the coordinates of the original."""
    return df.withColumns({"x1": (F.col("x1") - dx) / scale, "x2": (F.col("x2") - dx) / scale, "y1": (F.col("y1") - dy) / scale, "y2": (F.col("y2") - dy) / scale})


def letterbox(width: Column, height: Column, to_w: int, to_h: int) -> Column:
    """The scale at which an image fits a frame."""
    return F.least(F.lit(float(to_w)) / width, F.lit(float(to_h)) / height)


def suppressed(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, score: np.ndarray, most: float) -> np.ndarray:
    """Kept rows in score order: a box goes if it overlaps a kept one by more than ``most`` (intersection over union)."""
    order = np.argsort(-score, kind="stable")
    area = (x2 - x1) * (y2 - y1)
    keep = []
    while len(order):
        i, rest = order[0], order[1:]
        keep.append(i)
        w = np.maximum(0, np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]))
        h = np.maximum(0, np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]))
        inter = w * h
        order = rest[inter / (area[i] + area[rest] - inter + 1e-6) <= most]
    return np.array(keep, np.int64)


def nms(df: DataFrame, keys: list[str], most: float, *, id_col: str = "det_id") -> DataFrame:
    """Greedy suppression within each ``keys`` group (add the class for per-class suppression)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        return g.iloc[suppressed(*(g[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2", "score")), most)]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def face_rank(df: DataFrame, image: str, scores: list[str]) -> DataFrame:
    """``df`` with ``rank``: descending by the last score, then those before it."""
    w = Window.partitionBy(image).orderBy(*[F.desc(c) for c in reversed(scores)], *[c for c in df.columns if c.endswith("_id") and c != image][:1])
    return df.withColumn("rank", F.row_number().over(w))


def counts(df: DataFrame, image: str) -> DataFrame:
    return df.groupBy(image).agg(F.count("*").alias("n"))


def similarity_transform(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 2x3 rotation, scale and shift that takes points to points best (least squares)."""
    ms, md = src.mean(0), dst.mean(0)
    a, b = src - ms, dst - md
    u, s, vt = np.linalg.svd(b.T @ a / len(src))
    d = np.array([1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    r = u @ np.diag(d) @ vt
    scale = (s * d).sum() / (a**2).sum() * len(src)
    return np.hstack([scale * r, (md - scale * r @ ms)[:, None]])


def euler(r: np.ndarray) -> tuple[float, float, float]:
    """Pitch, yaw and roll in degrees of a rotation matrix."""
    sy = math.hypot(r[0, 0], r[1, 0])
    if sy > 1e-6:
        a = math.atan2(r[2, 1], r[2, 2]), math.atan2(-r[2, 0], sy), math.atan2(r[1, 0], r[0, 0])
    else:
        a = math.atan2(-r[1, 2], r[1, 1]), math.atan2(-r[2, 0], sy), 0.0
    return tuple(math.degrees(x) for x in a)  # type: ignore[return-value]


def perspective(quad: np.ndarray, width: float, height: float) -> np.ndarray:
    """The 3x3 map of a quadrilateral (clockwise from top left) to a rectangle."""
    to = np.array([[0, 0], [width, 0], [width, height], [0, height]], float)
    rows, rhs = [], []
    for (x, y), (u, v) in zip(np.asarray(quad, float), to):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(rhs)), 1).reshape(3, 3)


def min_area_rect(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(corners, area) of the smallest rectangle around points, over all hull edges."""
    p = np.unique(np.asarray(points, float), axis=0)
    hull = _hull(p)
    best = None
    for i in range(len(hull)):
        e = hull[(i + 1) % len(hull)] - hull[i]
        n = np.hypot(*e)
        if n == 0:
            continue
        c, s = e / n
        rot = np.array([[c, s], [-s, c]])
        q = hull @ rot.T
        lo, hi = q.min(0), q.max(0)
        area = float(np.prod(hi - lo))
        if best is None or area < best[1]:
            best = (np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]]) @ rot, area)
    return best if best is not None else (np.repeat(p[:1], 4, 0), 0.0)


def _hull(p: np.ndarray) -> np.ndarray:
    if len(p) < 3:
        return p
    p = p[np.lexsort((p[:, 1], p[:, 0]))]

    def half(q: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for z in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (z[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (z[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(z)
        return out

    a, b = half(p), half(p[::-1])
    return np.array(a[:-1] + b[:-1])


def labelled_components(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a pixel mask, numbered from 1 in reading order."""
    out = np.zeros(mask.shape, np.int64)
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                    out[c, d] = n
                    todo.append((c, d))
    return out


def sized_components(labels: np.ndarray, least: int) -> np.ndarray:
    """Components of fewer than ``least`` pixels erased."""
    n = np.bincount(labels.ravel())
    return np.where(n[labels] >= least, labels, 0)


def text_boxes(df: DataFrame, *, least_side: float = 3, least_score: float = 0.6, most: int = 1000) -> DataFrame:
    """Text boxes large and sure enough, the ``most`` best of an image."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return df.where((side >= least_side) & (F.col("score") >= least_score)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def inside(poly: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie in a polygon, by crossings."""
    hit = np.zeros(np.shape(x), bool)
    for (x1, y1), (x2, y2) in zip(poly, np.roll(poly, -1, 0)):
        if y1 != y2:
            hit ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return hit


def box_score(prob: np.ndarray, poly: np.ndarray) -> float:
    """Mean probability of the pixels of a polygon; 0 for one without pixels."""
    lo = np.maximum(np.floor(poly.min(0)).astype(int), 0)
    hi = np.minimum(np.ceil(poly.max(0)).astype(int), np.array(prob.shape[::-1]) - 1)
    if (hi < lo).any():
        return 0.0
    y, x = np.mgrid[lo[1] : hi[1] + 1, lo[0] : hi[0] + 1]
    m = inside(poly + 1e-9, x, y)
    part = prob[lo[1] : hi[1] + 1, lo[0] : hi[0] + 1]
    return float(part[m].mean()) if m.any() else 0.0


def unclipped(poly: np.ndarray, ratio: float) -> np.ndarray:
    """A convex polygon with every edge moved outwards by area x ratio / perimeter."""
    p = np.asarray(poly, float)
    nxt = np.roll(p, -1, 0)
    area = ((p[:, 0] * nxt[:, 1]) - (nxt[:, 0] * p[:, 1])).sum() / 2
    edge = nxt - p
    length = np.hypot(*edge.T)
    if not length.all() or not area:
        return p
    normal = np.stack([edge[:, 1], -edge[:, 0]], 1) / length[:, None] * np.sign(area)
    moved = p + normal * abs(area) * ratio / length.sum()
    # each corner is where two moved edges meet
    out = np.empty_like(p)
    for i in range(len(p)):
        a, u, b, v = moved[i - 1], edge[i - 1], moved[i], edge[i]
        cross = u[0] * v[1] - u[1] * v[0]
        out[i] = b if abs(cross) < 1e-12 else a + u * (((b - a)[0] * v[1] - (b - a)[1] * v[0]) / cross)
    return out


def text_regions(prob: np.ndarray, *, threshold: float = 0.3, least_score: float = 0.6, ratio: float = 1.5, least_side: float = 3, least_grown: float = 5, most: int = 1000, scale: tuple[float, float] = (1.0, 1.0)) -> list[tuple[np.ndarray, float]]:
    """(corners, score) of the text of a probability map: its connected regions in
    reading order, at most ``most``, as smallest rectangles that are large and sure enough,
    grown by ``ratio`` and scaled back to the image."""
    labels = labelled_components(prob > threshold)
    out = []
    for k in range(1, min(int(labels.max(initial=0)), most) + 1):
        y, x = np.nonzero(labels == k)
        # pixels are squares
        at = np.concatenate([np.stack([x + dx, y + dy], 1) for dx in (0, 1) for dy in (0, 1)])
        corners, _ = min_area_rect(at)
        if min(np.hypot(*(corners[1] - corners[0])), np.hypot(*(corners[2] - corners[1]))) < least_side:
            continue
        score = box_score(prob, corners - 0.5)
        if score < least_score:
            continue
        grown = unclipped(corners, ratio)
        if min(np.hypot(*(grown[1] - grown[0])), np.hypot(*(grown[2] - grown[1]))) < least_grown:
            continue
        out.append((np.round(grown * np.array(scale)), score))
    return out
