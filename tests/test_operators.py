"""Registry, detections, clusters, graph, files and streams."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lecterna.functions.signal import ActivityDetector
from lecterna.operators import cluster as C
from lecterna.operators import detections as D
from lecterna.operators.graph import components
from lecterna.plans import registry as R
from lecterna.sources import files, media
from lecterna.streaming import speech


def registry():
    r = R.Registry()
    add = lambda name, mid, deps: r.add(R.Operator(name, mid, lambda df, n=name: df.withColumn(n, F.lit(n)), deps))
    add("late", 1, (4,)), add("mid", 4, (2,)), add("early", 2, ()), add("other", 8, ())
    return r


def test_plan_holds_only_what_is_asked_for(spark):
    r = registry()
    assert [o.name for o in r.ordered(1)] == ["early", "mid", "late"] and r.supported == 15
    assert r.plan(spark.range(1), 4).columns == ["id", "early", "mid"]
    with pytest.raises(ValueError):
        r.ordered(16)
    rows = spark.createDataFrame([(1, 8), (2, 1)], "id long, todo long")
    got = {x["id"]: (x["other"], x["late"]) for x in r.plan_rows(rows).collect()}
    assert got == {1: ("other", None), 2: (None, "late")}


def test_masks(spark):
    assert R.names(0) == "None" and R.names(3) == "ACT|FACEDET"
    df = spark.createDataFrame([(0,), (3,), (0x1000000001,)], "m long").select(R.mask_names(F.col("m")).alias("n"), R.bits_of(F.col("m")).alias("b")).collect()
    assert [x["n"] for x in df] == ["None", "ACT|FACEDET", "ACT|T5_DECKVS"] and df[2]["b"] == [1, 0x1000000000]
    with pytest.raises(Exception, match="unsupported"):
        R.validated(spark.createDataFrame([(32,)], "todo long"), "todo", 15).collect()


def test_suppression_edges():
    a = np.array([0.0, 0.0, 100.0])
    keep = D.suppressed(a, a, a + 10, a + 10, np.array([0.5, 0.9, 0.1]), 0.45)
    assert keep.tolist() == [1, 2]
    z = np.zeros(1)
    assert D.suppressed(z, z, z, z, z, 0.5).tolist() == [0] and D.suppressed(*[np.zeros(0)] * 5, 0.5).tolist() == []


def test_geometry():
    src = np.array([[0, 0], [1, 0], [0, 1.0]])
    t = np.radians(30)
    r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    m = D.similarity_transform(src, 2 * src @ r.T + [3, 4])
    assert np.allclose(m, np.hstack([2 * r, [[3], [4]]]))
    h = D.perspective(np.array([[0, 0], [2, 0], [2, 1], [0, 1]]), 20, 10)
    p = h @ [1, 0.5, 1]
    assert np.allclose(p[:2] / p[2], [10, 5])
    assert abs(D.min_area_rect(np.array([[0, 0], [2, 0], [2, 1], [0, 1], [1, 0.5]]))[1] - 2) < 1e-9
    assert np.allclose(D.euler(np.eye(3)), 0)
    lab = D.labelled_components(np.array([[1, 1, 0], [0, 0, 1]]))
    assert lab.tolist() == [[1, 1, 0], [0, 0, 2]] and D.sized_components(lab, 2).tolist() == [[1, 1, 0], [0, 0, 0]]


def test_components_brute_force(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(900, 901), (901, 902), (902, 903), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000}


def test_knn_blocks_agree(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    one = {(r["id"], r["rank"]): r["other"] for r in C.knn(df, "id", "vec", 3, blocks=1).collect()}
    four = {(r["id"], r["rank"]): r["other"] for r in C.knn(df, "id", "vec", 3, blocks=4).collect()}
    assert one == four and len(one) == 180


def test_planted_clusters():
    g = np.random.default_rng(0)
    c = g.standard_normal((3, 16)) * 3
    x = np.vstack([c[i] + 0.2 * g.standard_normal((30, 16)) for i in range(3)])
    lab = C.spectral(x)
    assert all(len(set(lab[i * 30 : i * 30 + 30])) == 1 for i in range(3)) and len(set(lab)) == 3
    assert C.spectral(x[:5]).tolist() == [0] * 5
    assert len(set(C.merged_by_cosine(np.array([0] * 15 + [1] * 15 + [2] * 30), x[:60], 0.9))) == 2


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text('{"name": "x", "mid": 4, "model_path": "p", "depend": [2]}')
    (tmp_path / "d/b.json").write_text('{"name": "broken"}')
    d = files.descriptors(spark, str(tmp_path / "d"), 4)
    assert [r["name"] for r in d.collect()] == ["x"] and [r["dep"] for r in R.missing(d).collect()] == [2]
    assert files.default_descriptors(spark, "/m").count() == len(R.BITS)
    (tmp_path / "v.txt").write_text("a\nb\n")
    assert [r["token"] for r in files.vocabulary(spark, str(tmp_path / "v.txt"), blank_last=True).orderBy("id").collect()] == ["a", "b", " "]
    (tmp_path / "c.txt").write_text("<AddShift> 2 2\n<LearnRateCoef> 0 [ 1 2 ]\n<Rescale> 2 2\n<LearnRateCoef> 0 [ 3 4 ]\n")
    shift, scale = files.cmvn(spark, str(tmp_path / "c.txt"))
    assert shift.tolist() == [1, 2] and scale.tolist() == [3, 4]
    np.save(tmp_path / "f.npy", np.ones((2, 3), np.float32))
    assert files.features(spark, str(tmp_path / "f.npy")).count() == 2
    files.write_labels(spark.createDataFrame([(0.0, 1.25, "a\tb")], "start double, end double, text string"), str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "out")).collect()] == [(0.0, 1.25, "a b")]


def test_wav_source(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(np.zeros(20000, np.int16).tobytes())
    spark.dataSource.register(media.WavSource)
    assert [r["rate"] for r in spark.read.format("wav").load(str(tmp_path)).collect()] == [16000]
    a = media.wav(spark, str(tmp_path))
    assert a.first()["rate"] == 16000 and media.chunks(a, 0.5).count() == 3


def frames(n=600):
    s = np.full(n, 0.95)
    s[100:250] = s[400:500] = 0.05
    return pd.DataFrame({"stream_id": 1, "frame": np.arange(n), "silence": s, "db": 0.0})


def test_detector_segments_and_resumes():
    f = frames()
    whole = speech.detected(f, ActivityDetector(), final=True)
    assert len(whole) == 2 and whole[0][0] <= 1000 <= whole[0][1] and whole[0][1] >= 2500 and whole[1][1] >= 5000
    a = ActivityDetector()
    got = speech.detected(f[:333], a)
    b = ActivityDetector().restore(a.state())
    assert got + speech.detected(f[333:], b, final=True) == whole


def test_stream_equals_batch(spark, tmp_path):
    f = pd.concat([frames(), frames().assign(stream_id=2)])
    batch = sorted(tuple(r) for r in speech.detect(spark.createDataFrame(f)).collect())
    end = pd.DataFrame({"stream_id": [1, 2], "frame": [600, 600], "silence": [None, None], "db": [None, None]})
    every = pd.concat([f, end]).sample(frac=1, random_state=1)  # out of order
    for i in range(3):
        every[i::3].astype({"silence": float, "db": float}).to_parquet(tmp_path / f"{i}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema("stream_id long, frame long, silence double, db double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = speech.detect_stream(src).writeStream.format("memory").queryName("vad").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("vad").collect()) == batch


def test_teacher_votes(spark):
    rows = [("a", 1, 10, 0, 5), ("a", 2, 2, 1, 9), ("b", 1, 0, 3, 4), ("b", 2, 0, 9, 7), ("c", 1, 100, 0, 3), ("c", 2, 95, 0, 8), ("d", 1, 4, 0, 1)]
    got = {r["key"]: r["label"] for r in C.teacher_of(spark.createDataFrame(rows, "key string, label long, n_long long, n_short long, segments long")).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 1}


def test_speaker_labels_of_short_recordings():
    g = np.random.default_rng(0)
    same = np.ones((12, 8)) + 0.01 * g.standard_normal((12, 8))
    assert set(C.speaker_labels(same)) == {0} and C.speaker_labels(same[:1]).tolist() == [0]
