"""Interval algebra against brute force on random input, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lecterna.operators import intervals as I


def greedy(rows, cap, gap):
    out, head, last, n = [], None, None, 0
    for b, e in sorted(rows):
        if head is not None and b - last <= gap and e - head < cap:
            last, n = e, n + 1
        else:
            if head is not None:
                out.append((head, last, n))
            head, last, n = b, e, 1
    return out + ([(head, last, n)] if head is not None else [])


def test_merge_capped_is_the_greedy_merge(spark):
    r = random.Random(1)
    rows = [(k, b, b + r.randrange(50, 400)) for k in range(6) for b in r.sample(range(0, 20_000), 60)]
    got = {}
    for x in I.merge_capped(spark.createDataFrame(rows, "k long, b long, e long"), "k", "b", "e", cap=1500, gap=200).collect():
        got.setdefault(x["k"], []).append((x["b"], x["e"], x["n"]))
    for k in range(6):
        assert sorted(got[k]) == greedy([(b, e) for q, b, e in rows if q == k], 1500, 200)


def test_spans_stay_below_the_cap_and_apart(spark):
    rows = [(1, i * 1000, i * 1000 + 900) for i in range(50)]
    got = I.merge_capped(spark.createDataFrame(rows, "k long, b long, e long"), "k", "b", "e", cap=15_000, gap=1200).orderBy("b").collect()
    assert all(x["e"] - x["b"] < 15_000 for x in got) and sum(x["n"] for x in got) == 50


def test_complement_of_nested_touching_and_equal(spark):
    rows = [(1, 0, 10), (1, 2, 5), (1, 10, 12), (1, 20, 30), (1, 20, 30)]
    got = I.complement(spark.createDataFrame(rows, "k long, s long, e long"), "k", "s", "e", F.lit(0).cast("long"), F.lit(40).cast("long"))
    assert sorted((x["s"], x["e"]) for x in got.collect()) == [(12, 20), (30, 40)]


def test_cut_long_leaves_no_empty_tail(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 0, 11), (3, 5, 5), (4, 0, 3)], "k long, s long, e long")
    got = sorted((x["k"], x["s"], x["e"]) for x in I.cut_long(df, "s", "e", 5).collect())
    assert got == [(1, 0, 5), (1, 5, 10), (2, 0, 5), (2, 5, 10), (2, 10, 11), (4, 0, 3)]


def test_overlap_argmax_brute_force(spark):
    r = random.Random(2)
    tok = [(k, i, s, s + r.randrange(1, 90)) for k in range(3) for i, s in enumerate(r.sample(range(2000), 50))]
    rol = [(k, i, s, s + r.randrange(1, 300)) for k in range(3) for i, s in enumerate(r.sample(range(2000), 15))]
    want = {}
    for k, i, s, e in tok:
        best = max(((min(e, f) - max(s, b), -j) for q, j, b, f in rol if q == k and s < f and b < e), default=None)
        if best:
            want[k, i] = (-best[1], best[0])
    a = spark.createDataFrame(tok, "k long, token_id long, start long, end long")
    b = spark.createDataFrame(rol, "k long, role_id long, start long, end long")
    got = {(x["k"], x["token_id"]): (x["role_id"], x["overlap"]) for x in I.overlap_argmax(a, b, "k", 100).collect()}
    assert got == want


@pytest.mark.parametrize("forward", [False, True])
def test_asof_brute_force(spark, forward):
    r = random.Random(3)
    left = [(k, i, r.randrange(1000)) for k in range(3) for i in range(40)]
    right = [(k, t, t * 7) for k in range(3) for t in r.sample(range(1000), 12)]
    got = I.asof(spark.createDataFrame(left, "k long, id long, t long"), spark.createDataFrame(right, "k long, t long, v long"), "k", "t", "v", forward=forward)
    for x in got.collect():
        c = [t for k, t, _ in right if k == x["k"] and (t >= x["t"] if forward else t <= x["t"])]
        assert x["near_time"] == ((min(c) if forward else max(c)) if c else None)


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],), ([1.0],)], "x array<float>")
    got = df.select(I.frames(F.col("x"), 2, 2).alias("f"), I.stacked(F.col("x"), 3, 2).alias("s")).collect()
    assert [list(map(list, g["f"])) for g in got] == [[[1, 2], [3, 4]], [], []]
    assert list(map(list, got[0]["s"])) == [[1, 1, 2], [2, 3, 4], [4, 5, 5]] and got[1]["s"] is None
    ids = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2],), ([],)], "x array<int>").select(I.collapse(F.col("x")).alias("c")).collect()
    assert [g["c"] for g in ids] == [[1, 1, 2], []]


def test_slices_fold_short_tails(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (2.1,), (2.5,)], "d double").select(I.slices(F.col("d"), 0.2).alias("s"))
    got = [[round(v, 3) for v in x["s"]] for x in df.collect()]
    assert got == [[0.5], [1.0], [1.0, 1.1], [1.0, 1.0, 0.5]]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k long, s long, e long")
    assert I.merge_capped(e, "k", "s", "e", cap=1, gap=1).count() == 0
    assert I.complement(e, "k", "s", "e", F.lit(0), F.lit(1)).count() == 0
    assert I.cut_long(e, "s", "e", 5).count() == 0


def test_allocation_carries_whole_units(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1.0],)], "w array<double>").select(I.allocated(F.lit(0), F.lit(101), F.col("w")).alias("a"))
    assert [(x["b"], x["e"]) for x in df.first()["a"]] == [(0, 25), (25, 75), (75, 100)]


HOT = ["gap_islands", "interval_complement", "slice_timeline", "run_length", "asof_prev_next", "weighted_vote", "pause_index", "particle_carry", "ctc_collapse", "fragment_merge", "token_table", "merge_capped", "transcript_statistics"]


@pytest.mark.parametrize("name", HOT)
def test_long_keys_give_the_same(spark, data, monkeypatch, name):
    from lecterna import catalog
    from lecterna.operators import ordered

    rows = lambda: sorted(map(str, catalog.QUERIES[name](spark, data).collect()))
    want = rows()
    monkeypatch.setattr(ordered, "SMALL_BYTES", 0)
    monkeypatch.setattr(ordered, "MANY", 3)
    assert ordered.long_keys(catalog.events(spark, data), ["user_id"]) and rows() == want


def test_running_values(spark):
    from lecterna.operators import ordered

    rows = [(k, i, v) for k in (1, 2, None) for i, v in enumerate([3, None, 5, 1, None, 2])]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(5)
    how = dict(s=("sum", "v"), m=("max", "v", False), last=("last", "v"), lag=("lag", "v"))
    plain = sorted(map(str, ordered.running(df, "k", ["o"], **how).collect()))
    old = ordered.SMALL_BYTES, ordered.MANY
    ordered.SMALL_BYTES, ordered.MANY = 0, 2
    try:
        assert sorted(map(str, ordered.running(df, "k", ["o"], **how).collect())) == plain
    finally:
        ordered.SMALL_BYTES, ordered.MANY = old
    got = {(r["k"], r["o"]): r for r in ordered.running(df, "k", ["o"], **how).collect()}
    assert [got[1, i]["s"] for i in range(6)] == [3, 3, 8, 9, 9, 11] and [got[1, i]["m"] for i in range(6)] == [None, 3, 3, 5, 5, 5]
    assert [got[2, i]["last"] for i in range(6)] == [3, 3, 5, 1, 1, 2] and [got[2, i]["lag"] for i in range(6)] == [None, 3, None, 5, 1, None]
