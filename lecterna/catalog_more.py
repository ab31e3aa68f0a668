"""Queries whose operators need Python steps; registered by ``catalog``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lecterna import catalog as Q
from lecterna.functions import itn, scripts, signal
from lecterna.functions import sequences as S
from lecterna.functions import text as T
from lecterna.operators import cluster as C
from lecterna.operators import decode
from lecterna.operators import transcripts as X
from lecterna.streaming import speech

query, table = Q.query, Q.table


@query()
def itn_texts(spark: SparkSession, d: str) -> DataFrame:
    h = Q.hyp_a(spark, d)
    return h.select("stream_id", "idx", itn.normalised(F.col("preds")).alias("written")).join(h.select("stream_id", "idx", "preds"), ["stream_id", "idx"]).where("written <> preds").drop("preds")


@query()
def script_convert(spark: SparkSession, d: str) -> DataFrame:
    words = {"裡": "里", "門": "门", "讀": "读", "圖": "图", "國": "国", "學": "学", "說": "说", "們": "们"}
    b = table(spark, d, "hyp_b").select("stream_id", "idx", F.col("asr_sensevoice_result.preds").alias("t")).where("t is not null").dropDuplicates(["stream_id", "idx"])
    return b.select("stream_id", "idx", scripts.converted(F.col("t"), words).alias("simplified"), T.is_simplified(F.col("t"), "里门读图国学说们", "裡門讀圖國學說們").alias("is_simplified"))


@query()
def dual_merge(spark: SparkSession, d: str) -> DataFrame:
    return X.merged(table(spark, d, "hyp_a"), table(spark, d, "hyp_b"))


@query()
def text_fusion(spark: SparkSession, d: str) -> DataFrame:
    a = Q.hyp_a(spark, d).select("stream_id", "idx", F.col("preds").alias("a"))
    b = table(spark, d, "hyp_b").select("stream_id", "idx", F.col("asr_sensevoice_result.preds").alias("b")).dropDuplicates(["stream_id", "idx"])

    @F.pandas_udf("string")
    def fuse(x: pd.Series, y: pd.Series) -> pd.Series:
        cuts = [S.best_fusion(p, q) if p and q else None for p, q in zip(x, y)]
        return pd.Series([p[c[0] : c[1]] if c else None for p, c in zip(x, cuts)])

    return a.join(b, ["stream_id", "idx"]).where("a <> b").select("stream_id", "idx", fuse("a", "b").alias("fused"))


@query()
def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    h = Q.hyp_a(spark, d).where("stamps is not null")
    u = h.select(F.col("stream_id").alias("doc"), "idx", "begin_ms", F.posexplode(F.arrays_zip("tokens", "stamps")).alias("k", "x")).where("x.tokens is not null and x.stamps.b >= 0 and x.stamps.e > x.stamps.b")
    t = u.select("doc", (F.col("begin_ms") * 10_000 + F.col("k")).alias("pos"), F.col("x.tokens").alias("token"), ((F.col("begin_ms") + F.col("x.stamps.b")) / 1000).alias("start"), ((F.col("begin_ms") + F.col("x.stamps.e")) / 1000).alias("end"))
    return X.windows(t)


@query()
def transcript_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)[0]


@query()
def transcript_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)[1]


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "segment").select("stream_id", F.col("seg_id").alias("role_id"), (F.col("start_s") * 1000).cast("long").alias("start"), (F.col("end_s") * 1000).cast("long").alias("end"), (F.pmod("group_id", F.lit(2))).alias("role")).where("start < end").dropDuplicates(["stream_id", "role_id"])
    return X.report(table(spark, d, "hyp_a"), table(spark, d, "hyp_b"), s)


@query()
def vad_segments(spark: SparkSession, d: str) -> DataFrame:
    """Activity of each user's events as frames of a recording."""
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    f = Q.events(spark, d).select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).alias("frame"), F.when(F.col("value") > 40, 0.1).otherwise(0.9).alias("silence"), F.lit(0.0).alias("db"))
    return speech.detect(f, ring=5, to_speech=3, to_silence=3, look_back=2, look_ahead=1, end_silence=8, most=200)


@query()
def beam_decode(spark: SparkSession, d: str) -> DataFrame:
    """Beams over each vector read as a table of scores that depends on the last token."""

    @F.pandas_udf("tokens array<int>, score double")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            t = np.asarray(v, float).reshape(8, 8) * 4
            t = t - np.log(np.exp(t).sum(1, keepdims=True))
            out.append(decode.beam(lambda p, t=t: t[p[-1] if p else 0], most=20))
        return pd.DataFrame({"tokens": [x[0] for x in out], "score": [round(x[1], 6) for x in out]})

    return table(spark, d, "embeddings").select("vec_id", run("embedding").alias("x")).select("vec_id", "x.tokens", "x.score")


@query()
def fbank_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean log mel energies of each recording's loudness values as samples."""
    n = table(spark, d, "vad_segment").where("audio_db is not null and idx is not null").select("stream_id", "idx", "audio_db").distinct()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.repeat(g.sort_values("idx")["audio_db"].to_numpy(float), 80)
        f = signal.fbank(x, bins=20)
        return pd.DataFrame({"stream_id": g["stream_id"].iloc[0], "frames": [len(f)], "mean": [round(float(f.mean()), 3) if len(f) else None]})

    return n.groupBy("stream_id").applyInPandas(run, "stream_id long, frames long, mean double")


@query()
def spectral_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the vectors of each label."""
    return C.spectral_by(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    e = C.affinity_edges(C.knn(v, "vec_id", "embedding", 8), 0.2)
    return C.label_propagation(e)


@query()
def lone_segments(spark: SparkSession, d: str) -> DataFrame:
    """Lone segments of each recording joined to a near and similar neighbour."""
    s = table(spark, d, "segment").where(F.size("sv_feat") == 192).select("stream_id", "seg_id", "start_s", "end_s", "group_id", "sv_feat").dropDuplicates(["stream_id", "seg_id"])
    w = Window.partitionBy("stream_id").orderBy("start_s", "seg_id")
    from lecterna.functions import vector as V

    near = s.withColumn("next", F.lead("sv_feat").over(w)).withColumn("dot", F.when(F.forall("sv_feat", lambda v: v.isNotNull()) & F.forall("next", lambda v: v.isNotNull()), V.cosine(F.col("sv_feat"), F.col("next"))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start_s", "seg_id"])
        got = S.lone_merged(list(zip(g["start_s"], g["end_s"], g["group_id"])), g["dot"].fillna(-1).tolist())
        return pd.DataFrame([(g["stream_id"].iloc[0], *x) for x in got], columns=["stream_id", "start_s", "end_s", "group_id"])

    return near.drop("sv_feat", "next").groupBy("stream_id").applyInPandas(run, "stream_id long, start_s double, end_s double, group_id int")


def _voiced(spark: SparkSession, d: str) -> DataFrame:
    fit = F.col("sv_feat").isNotNull() & (F.size("sv_feat") == 192) & F.forall("sv_feat", lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists("sv_feat", lambda v: v != 0)
    return table(spark, d, "segment").where(fit & F.col("start_s").isNotNull()).select("stream_id", "seg_id", "start_s", "end_s", "sv_feat").dropDuplicates(["stream_id", "seg_id"])


@query()
def speaker_roles(spark: SparkSession, d: str) -> DataFrame:
    """The teacher's segments (role 0) of each recording."""
    return C.roles(_voiced(spark, d), "stream_id", "seg_id", "sv_feat", "start_s", "end_s")


@query()
def transcription_report(spark: SparkSession, d: str) -> DataFrame:
    """Whole recordings in one plan: activity by loudness, both recognisers merged,
    roles from the voices, sentences with marks, numbers as digits, statistics."""
    loud = table(spark, d, "vad_segment").where("idx is not null and audio_db >= 0.003").select("stream_id", "idx").distinct()
    a = table(spark, d, "hyp_a").join(loud, ["stream_id", "idx"])
    v = _voiced(spark, d)
    r = C.roles(v, "stream_id", "seg_id", "sv_feat", "start_s", "end_s").join(v.select("stream_id", "seg_id", "start_s", "end_s"), ["stream_id", "seg_id"])
    r = r.select("stream_id", F.col("seg_id").alias("role_id"), (F.col("start_s") * 1000).cast("long").alias("start"), (F.col("end_s") * 1000).cast("long").alias("end"), "role").where("start < end")
    said, counted = X.report(a, table(spark, d, "hyp_b"), r)
    per = said.groupBy("doc").agg(F.count("*").alias("sentences"), F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("teacher"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    return per.join(counted, "doc").select(F.col("doc").alias("stream_id"), "sentences", "teacher", "begin", "end", "words", "speed")
