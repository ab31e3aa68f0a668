"""Task service, audio streams, roles, text regions, word pieces, repairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lecterna.functions import sequences as S
from lecterna.functions import signal
from lecterna.operators import cluster as C
from lecterna.operators import detections as D
from lecterna.plans import service, speech
from lecterna.plans.registry import BITS, Operator, Registry
from lecterna.streaming import audio

USER = "userdata map<string,string>"


def test_service_runs_urgent_tasks_first(spark):
    with service.TaskService(spark, speech.registry(), USER, service.Settings(queue=3, batch=2)) as s:
        a = s.post({"userdata": {"begin_ms": "0", "end_ms": "1000"}}, BITS["ASR_STAMP"])
        b = s.post({"userdata": {"dex": "7"}}, BITS["VOICEPRINT"])
        c = s.post({"userdata": {"dex": "9"}}, BITS["VOICEPRINT"], urgent=True)
        with pytest.raises(TimeoutError):
            s.post({}, BITS["VOICEPRINT"], timeout=0.01)
        with pytest.raises(ValueError, match="unsupported"):
            s.post({}, BITS["POSE"])
        assert s.sizes() == {"urgent": 1, "waiting": 2, "ready": 0, "done": 0}
        assert s.step() == 2 and c.done() and a.done() and not b.done()
        assert a.result()["frames"] == 98 and a.result()["stacked"] == 17 and a.result()["slots"] == 52 and a.result()["segment"] is None and c.result()["segment"] == 9
        assert len(list(s.drain())) == 3 and s.sizes()["done"] == 3
        d = s.post({"userdata": {}}, BITS["VOICEPRINT"])
    assert d.cancelled()
    with pytest.raises(RuntimeError):
        s.post({}, 0)


def test_settings_and_log(tmp_path):
    x = service.Settings.read("queue: 8\nbatch: 2\nother: 1\npartitions: 4\n")
    assert (x.queue, x.batch, x.conf()["spark.sql.shuffle.partitions"]) == (8, 2, "4")
    log = service.rotating_log(str(tmp_path / "a.log"))
    log.info("here")
    assert "here" in (tmp_path / "a.log").read_text() and service.rotating_log(str(tmp_path / "a.log")) is log
    lines = []
    with service.timed("work", lines.append, 0.01) as seen:
        sum(range(10000))
    assert seen["seconds"] > 0 and "work" in lines[0] and service.once(dict) is service.once(dict)


def test_plan_of_rows_is_linear(spark):
    r = Registry()
    for i in range(20):
        r.add(Operator(f"op{i}", 1 << i, None, (1 << (i - 1),) if i else (), (), None, lambda i=i: {f"c{i}": F.lit(i)}))
    df = spark.createDataFrame([(1 << 19, "a"), (1, "b"), (0, "c")], "todo long, x string")
    got = {x["x"]: x for x in r.plan_rows(df).collect()}
    assert got["a"]["c0"] == 0 and got["a"]["c19"] == 19 and got["b"]["c0"] == 0 and got["b"]["c1"] is None and got["c"]["c0"] is None
    assert len(r.plan_rows(df)._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_whole_table_operators_join_back(spark):
    r = Registry()
    r.add(Operator("a", 1, lambda d: d.withColumn("double", F.col("x") * 2)))
    r.add(Operator("b", 2, lambda d: d.withColumn("more", F.col("double") + 1), (1,)))
    got = {x["x"]: (x["double"], x["more"]) for x in r.plan_rows(spark.createDataFrame([(1, 5), (2, 6), (0, 7)], "todo long, x long")).collect()}
    assert got == {5: (10, None), 6: (12, 13), 7: (None, None)}


def sound(*parts):
    g = np.random.default_rng(0)
    return np.concatenate([g.standard_normal(int(s * 16000)) * v for s, v in parts]).astype(np.float32)


def test_listener_tells_open_segments_and_agrees_with_one_piece():
    x = sound((1, 0), (8, 0.3), (3, 0), (1.5, 0.3), (2, 0))
    whole = audio.Listener().feed(x, last=True)
    some = audio.Listener()
    rows = []
    for at in range(0, len(x), 7000):
        rows += some.feed(x[at : at + 7000], last=at + 7000 >= len(x))
        some = audio.Listener().restore(some.state())
    assert rows == whole and [r for r in rows if r[1] == -1] and len([r for r in rows if r[1] != -1]) == 2
    assert len(some.buffer.samples) < len(x)
    texts = list(audio.transcribed(audio.Listener(), iter([x[:50_000], x[50_000:]]), lambda s: f"{len(s) // 16}"))
    assert [(b, e) for b, e, _ in texts] == [(b, e) for (b, _), (_, e) in zip([r for r in rows if r[0] != -1], [r for r in rows if r[1] != -1])]
    assert all(abs(int(t) - (e - b)) <= 20 for b, e, t in texts)


def test_listening_stream_counts_late_chunks(spark, tmp_path):
    x = sound((1, 0), (3, 0.3), (3, 0))
    chunks = [(1, i, [float(v) for v in x[a : a + 16000]], a + 16000 >= len(x)) for i, a in enumerate(range(0, len(x), 16000))]
    schema = "stream_id long, chunk_id long, samples array<float>, last boolean"
    folder = str(tmp_path / "in")
    for part in (chunks[:3], [chunks[1], *chunks[3:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = audio.listen(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)).writeStream.format("memory").queryName("heard").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("heard").collect()
    ends = [r for r in got if r["end_ms"] not in (None, -1)]
    assert len(ends) == 1 and sum(r["late"] for r in got) >= 1 and sum(r["samples"] for r in got) == len(x)


def test_online_features_equal_those_of_the_whole():
    x = sound((1, 0.2))
    f = signal.OnlineFbank(bins=20)
    parts = [f.accept(x[a : a + 777]) for a in range(0, len(x), 777)]
    assert np.allclose(np.concatenate(parts), signal.fbank(x, bins=20), atol=1e-4)
    assert np.allclose(signal.mel_bank(10, 512, warp=1.0), signal.mel_bank(10, 512)) and not np.allclose(signal.mel_bank(10, 512, warp=1.1), signal.mel_bank(10, 512))


def test_mute_rule_by_its_definition():
    g = np.random.default_rng(1)
    for _ in range(40):
        n = int(g.integers(2, 12))
        x = np.repeat(g.choice([0.0, 0.004, 0.02, 0.3, 0.5], n), 160) * g.uniform(0.8, 1, n * 160)
        vol = [np.convolve(np.abs(x[i * 160 : (i + 1) * 160]), np.ones(3) / 3, "same").max() for i in range(n)]
        up = sorted(v for v in vol if v > 0)
        if not up:
            assert signal.mute_runs(x) == []
            continue
        base = round(float(np.mean(up[-int(len(up) * 0.3) :])), 5)
        mute = [base / (v + 1e-5) >= 8 or v < max(0.00305, 1.3 * min(vol)) for v in vol]
        for i in [i for i, m in enumerate(mute) if m][1:]:
            a, b = vol[i - 1], vol[i]
            if max(a, b) / (min(a, b) + 1e-5) > min(1.1 * base / (6 * b + 1e-5), 3):
                mute[i] = False
        mute[0] = mute[0] and mute[1]
        mute[-1] = mute[-1] and mute[-2]
        on = [i for i, m in enumerate(mute) if not m]
        assert signal.mute_runs(x) == ([(on[0], on[-1])] if on else [])


def test_noise_keeps_quiet_frames_out():
    d = signal.ActivityDetector(ring=2, to_speech=1, to_silence=0, look_back=0, least_snr=10.0)
    for _ in range(5):
        d.push(0.9, -40.0)
    assert d.noise == -40.0 and not d.voiced(0.01, -35.0) and d.voiced(0.01, -20.0)


def test_repairs_name_their_places():
    assert S.repaired("我我们走", "我们走") == ("我们走", [1])
    assert S.repaired("现现的话", "现在的话") == ("现在的话", [])
    assert S.repaired("特别喝喝", "特别好喝") == ("特别好喝", [])
    assert S.repaired("走走", "在走廊") == ("走", [1]) and S.repaired("看看书", "看看书") == ("看看书", [])


def test_roles_of_a_lesson(spark):
    g = np.random.default_rng(3)
    voices = g.standard_normal((3, 64))
    who = [0, 0, 1, 0, 0, 2] * 12
    x = voices[who] + 0.25 * g.standard_normal((len(who), 64))
    start = np.cumsum([3.0 if w == 0 else 1.0 for w in who])
    end = start + np.array([0.5 if w == 0 else 0.9 for w in who])
    role = C.teacher_roles(x, start, end)
    assert (role[np.array(who) == 0] == 0).mean() > 0.9 and (role[np.array(who) != 0] == 1).mean() > 0.9
    rows = [(1, i, [float(v) for v in r], float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, start, end))]
    df = spark.createDataFrame(rows, "k long, id int, v array<float>, a double, b double")
    assert {r["id"]: r["role"] for r in C.roles(df, "k", "id", "v", "a", "b").collect()} == dict(enumerate(role.tolist()))
    assert C.roles(df.where("false"), "k", "id", "v", "a", "b").count() == 0 and C.roles(df, "k", "id", "v", "a", "b", span=10.0).count() == len(who)


def test_text_regions():
    p = np.zeros((40, 60))
    p[5:15, 10:40] = 0.9
    p[25:27, 5:7] = 0.9
    p[30:38, 20:50] = 0.4
    got = D.text_regions(p, ratio=1.5)
    assert len(got) == 1
    box, score = got[0]
    d = 10 * 30 * 1.5 / 80
    assert score == pytest.approx(0.9) and abs(box[:, 0].min() - (10 - d)) <= 1 and abs(box[:, 1].max() - (15 + d)) <= 1
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert np.allclose(D.unclipped(square, 0.4), [[-1, -1], [11, -1], [11, 11], [-1, 11]]) and np.allclose(D.unclipped(square[::-1], 0.4)[0], [-1, 11])
    assert D.box_score(np.ones((5, 5)), square + 100) == 0.0


def test_word_pieces(spark):
    path = "/opt/tokenizers/piece_bpe_32k.model"
    if not os.path.exists(path):
        pytest.skip("no tokenizer here")
    from lecterna.functions import pieces

    df = spark.createDataFrame([("hello lamp",), (None,), ("",)], "t string").select("t", pieces.encoded(F.col("t"), path).alias("i"))
    got = df.select("t", "i", pieces.decoded(F.col("i"), path).alias("b")).collect()
    assert got[0]["b"] == "hello lamp" and got[1]["i"] is None and got[2]["i"] == []


def test_edit_similarity_in_all_languages(spark):
    from lecterna.functions.text import joined_plain, looked_up, similarity, symbols
    from lecterna.operators.transcripts import distance

    g = np.random.default_rng(4)
    pairs = [("".join(g.choice(list("abé好的る"), int(g.integers(1, 9)))), "".join(g.choice(list("abé好的る"), int(g.integers(1, 9))))) for _ in range(60)]
    for r in spark.createDataFrame(pairs, "a string, b string").withColumn("s", similarity(F.col("a"), F.col("b"))).collect():
        assert r["s"] == pytest.approx(1 - distance(r["a"], r["b"]) / max(len(r["a"]), len(r["b"])))
    one = spark.createDataFrame([(["ab", "cd", "好", "x", None, ""], "a...b--")], "w array<string>, t string")
    r = one.select(joined_plain(F.col("w")).alias("j"), symbols(F.col("t"), ["...", "--"]).alias("s"), looked_up(F.lit("k"), {"k": 3}, 0).alias("l"), looked_up(F.lit("z"), {"k": 3}, 0).alias("m")).first()
    assert r["j"] == "ab cd好x" and r["s"] == ["a", "...", "b", "--"] and (r["l"], r["m"]) == (3, 0)


def test_scripts_of_a_locale(spark, tmp_path):
    import json

    from lecterna.sources import files

    (tmp_path / "d.json").write_text(json.dumps({"zh-hant": {"门": "門"}, "zh-hk": {"里": "裏"}}))
    got = files.script_dictionary(spark, str(tmp_path / "d.json"), "zh-hk")
    assert got == {"门": "門", "里": "裏"} and files.script_dictionary(spark, str(tmp_path / "d.json"), "zh-hk") is got and files.script_dictionary(spark, str(tmp_path / "d.json"), "xx") == {}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("门里\n好\n")
    files.convert_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), got)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["好", "門裏"]
    (tmp_path / "p.yaml").write_text("queue: 7\n")
    assert files.pipe_settings(spark, str(tmp_path / "p.yaml")).queue == 7


def test_marks_and_roles_at_edges():
    assert S.reversed_rtl("abc") == "abc" and S.reversed_rtl("אב 12") == " 12בא"
    assert S.smoothed([0, 1, 0, 0], [False, True, False, False])[1] == 0
    assert S.shifted_marks(["a", "b", "c"], [1, 2, 1], [0.0, 0.0, 0.5], [False, True, False]) != [1, 2, 1]


def test_punctuation_and_merging_streams(spark, tmp_path):
    from lecterna.streaming import speech as stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    score = lambda ts: [3 if t == "." else 1 for t in ts]
    tokens = [(1, i, t, i == 8) for i, t in enumerate(["a", "b", ".", "c", "d", "e", ".", "f", "g"])]

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    schema = "stream_id long, pos long, token string, last boolean"
    for part in (tokens[:4], tokens[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got = run(audio.punctuate_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t")), score, chunk=3, trigger=50), "marks", "append")
    assert [(r["token"], r["mark"]) for r in sorted(got, key=lambda r: r["pos"])] == [(t, 3 if t == "." else 1) for _, _, t, _ in tokens[:-1]] + [("g", 3)]
    segs = [(1, 0, 1000), (1, 1500, 4000), (1, 9000, 9500), (1, None, None)]
    spark.createDataFrame(segs, "stream_id long, begin_ms long, end_ms long").coalesce(1).write.parquet(str(tmp_path / "s"))
    got = run(stream.merge_stream(spark.readStream.schema("stream_id long, begin_ms long, end_ms long").parquet(str(tmp_path / "s"))), "merged", "append")
    assert sorted((r["begin_ms"], r["end_ms"]) for r in got) == [(0, 4000), (9000, 9500)]


def test_backends_are_dealt_by_ratio(spark):
    from lecterna.plans.registry import backend

    got = backend(spark.range(3000), ["id"], [1.0, 2.0]).groupBy("backend").count().collect()
    n = {r["backend"]: r["count"] for r in got}
    assert set(n) == {0, 1} and 1.7 < n[0] / n[1] < 2.3


def test_one_second_slices():
    got = signal.slices_4class(np.arange(16000 * 3 + 100, dtype=float))
    assert [b.shape for b in got] == [(4, 32240)] and got[0][1][0] == 16000 and got[0][3][100] == 48000


def test_cluster_rows_and_late_windows(spark, tmp_path):
    from lecterna.sources import files
    from lecterna.streaming import speech as stream

    (tmp_path / "m.txt").write_text("a\nb\na\n\n")
    assert {r["label"]: r["rows"] for r in files.cluster_meta(spark, str(tmp_path / "m.txt"), 10).collect()} == {"a": [10, 12], "b": [11]}
    rows = spark.sql("select 1L as stream_id, timestamp_seconds(s) as at from values (0), (1), (7), (13) as t(s)")
    tumbling = {r["window"]["start"].second: r["count"] for r in stream.windowed(rows, "at").collect()}
    sliding = stream.windowed(rows, "at", size="12 seconds", slide="6 seconds").collect()
    assert tumbling == {0: 2, 6: 1, 12: 1} and sum(r["count"] for r in sliding) == 8
