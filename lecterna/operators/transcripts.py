"""Transcripts end to end: merging hypotheses, segments, roles, sentences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lecterna.functions import sequences as S
from lecterna.functions import text as T
from lecterna.operators.ordered import running
from lecterna.plans import lineage

# Words that mark a teacher's sentence.
TEACHER_SINGLE = ["好", "对", "来", "你", "坐", "停", "看"]
TEACHER_PHRASES = ["请坐", "孩子们", "同学们", "同学们好", "同学好", "谁来", "你来", "你说"]
TEACHER_VERBS = ["按照", "根据", "刚刚", "刚", "讲", "那么", "那", "说", "提示", "提醒", "你们", "你", "大家", "要求", "请", "希望", "强调", "再"]
MANTRAS = ["哇", "嗯", "啊", "哦", "嘿", "哟", "喂", "诶", "哎", "噢", "呃", "呦"]


def chosen(kind: str | None, db: float | None, a: str, b: str, *, compat: bool = False, words: Iterable[str] = (), sim: float | None = None) -> tuple[str, str]:
    """(decision, text) of two hypotheses of one segment.

    ``b`` for English. Otherwise the edit similarity decides: mixed speech keeps ``a``
    above one half. Chinese is suspicious up to .55, or up to .75 if it is quiet;
    what is suspicious survives as ``a`` if it is loud and of nearly equal length
    (``compat``: not even then), as the fusion of both around a common block of
    four characters, or not at all. The rest keeps ``a`` with doubled characters repaired.
    """
    import difflib

    if not a or not b:
        return "drop", ""
    if kind == "en":
        return "b", b
    x = a.replace(" ", "")
    if not x:
        return "drop", ""
    if sim is None:
        sim = 1 - distance(x, b) / max(len(x), len(b))
    if kind != "cn":
        return ("a", x) if sim > 0.5 else ("drop", "")
    loud = db if db is not None else 1.0
    if sim <= 0.55 or (loud < 0.005 and sim <= 0.75):
        if not compat and sim >= 0.35 and abs(len(x) - len(b)) <= 1 and loud >= 0.02 and min(len(x), len(b)) >= 4:
            return "a", x
        block = difflib.SequenceMatcher(None, x, b).find_longest_match(0, len(x), 0, len(b)).size
        if block < 4 or min(len(x), len(b)) / max(len(x), len(b)) < 0.6:
            return "drop", ""
        cut = S.best_fusion(x, b)
        return ("fused", x[cut[0] : cut[1]]) if cut else ("drop", "")
    if not S.doubled(x) or S.doubled(x) == S.doubled(b):
        return "a", x
    return "repaired", S.repaired(x, b, whole_words=words)[0]


def distance(a: str, b: str) -> int:
    """Edit distance by characters."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def merged(hyp_a: DataFrame, hyp_b: DataFrame, *, compat: bool = False) -> DataFrame:
    """(stream_id, idx, begin_ms, decision, text): both hypotheses of each utterance merged."""
    a = hyp_a.select("stream_id", "idx", "begin_ms", "asr_type", "audio_db", F.col("asr_dec_preds").alias("a")).dropDuplicates(["stream_id", "idx"])
    b = hyp_b.select("stream_id", "idx", F.col("asr_sensevoice_result.preds").alias("b")).dropDuplicates(["stream_id", "idx"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            got = [chosen(k if isinstance(k, str) else None, None if pd.isna(d) else d, x or "", y or "", compat=compat, sim=None if pd.isna(s) else s) for k, d, x, y, s in zip(g["asr_type"], g["audio_db"], g["a"], g["b"], g["sim"])]
            out = g[["stream_id", "idx", "begin_ms"]].copy()
            out["decision"], out["text"] = [x[0] for x in got], [x[1] for x in got]
            yield out

    # the edit distance is taken in the JVM, before the rows go to Python
    both = a.join(b, ["stream_id", "idx"], "left").withColumn("sim", T.similarity(F.replace("a", F.lit(" "), F.lit("")), F.col("b")))
    return both.mapInPandas(run, "stream_id long, idx int, begin_ms long, decision string, text string")


def windows(tokens: DataFrame, *, gap: float = 0.3, size: float = 1.5) -> DataFrame:
    """(doc, start, end, group) of (doc, pos, token, start, end): utterance islands
    cut into voiceprint pieces."""
    from lecterna.operators.intervals import islands

    rows = islands(tokens, "doc", "start", "end", gap, tie="pos")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        pieces = S.word_windows(float(g["start"].iloc[0]), float(g["end"].iloc[-1]), list(zip(g["token"], g["start"], g["end"])), size)
        return pd.DataFrame({"doc": g["doc"].iloc[0], "start": [p[0] for p in pieces], "end": [p[1] for p in pieces], "grp": [p[2] for p in pieces]})

    return rows.groupBy("doc", "island").applyInPandas(run, f"doc {tokens.schema['doc'].dataType.simpleString()}, start double, end double, grp long")


def sentences(tokens: DataFrame) -> DataFrame:
    """(doc, sentence, role, begin, end, line, n, seconds) of (doc, pos, token,
    start, end, punc, role): a sentence ends behind a comma, period or question
    mark or where the role changes; its role is the one that lasts longest, the
    teacher (0) on ties; fragments without a final mark join what follows."""
    t = running(tokens, "doc", ["pos"], _punc=("lag", "punc"), _role=("lag", "role"))
    cut = F.col("_punc").between(2, 4) | (F.col("_role") != F.col("role"))
    t = running(t.withColumn("_cut", F.when(cut, 1).otherwise(0)), "doc", ["pos"], part=("sum", "_cut")).drop("_cut", "_punc", "_role")
    parts = t.groupBy("doc", "part").agg(F.min("pos").alias("pos"), F.max_by("punc", "pos").alias("punc"))
    parts = running(parts, "doc", ["part"], _punc=("lag", "punc"))
    ended = F.coalesce(F.col("_punc").isin(3, 4), F.lit(True))
    groups = running(parts.withColumn("_new", F.when(ended, 1).otherwise(0)), "doc", ["part"], sentence=("sum", "_new")).select("doc", "part", "sentence")
    t = t.join(groups, ["doc", "part"])
    role = t.groupBy("doc", "sentence", "role").agg(F.sum(F.col("end") - F.col("start")).alias("d")).groupBy("doc", "sentence").agg(F.max_by("role", F.struct("d", -F.col("role"))).alias("role"))
    mark = F.when(F.col("punc") == 2, "，").when(F.col("punc") == 3, "。").when(F.col("punc") == 4, "？").otherwise("")
    whole = t.groupBy("doc", "sentence").agg(F.min("start").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "token", mark.alias("mark")))).alias("x"))
    words = F.filter(F.flatten(F.transform("x", lambda s: F.array(s["token"], s["mark"]))), lambda s: s != "")
    return whole.join(role, ["doc", "sentence"]).select("doc", "sentence", "role", "begin", "end", T.joined(words)["line"].alias("line"), "n", (F.col("end") - F.col("begin")).alias("seconds"))


def role_overrides(s: DataFrame) -> DataFrame:
    """``s`` (doc, sentence, role, line) with spoken numbers as digits, and with the
    teacher where the words tell: a single command with its mark, a fixed
    phrase, or a mention of the teacher beside the teacher's own sentences."""
    from lecterna.functions.itn import normalised

    w = Window.partitionBy("doc").orderBy("sentence")
    has = lambda words: F.lit(False) if not words else F.exists(F.array(*[F.lit(x) for x in words]), lambda x: F.contains(F.col("line"), x))
    single = (F.char_length("line") == 2) & F.substr("line", F.lit(1), F.lit(1)).isin(TEACHER_SINGLE)
    beside = (F.lag("role").over(w) == 0) | (F.lead("role").over(w) == 0)
    inner = F.lag("role").over(w).isNotNull() & F.lead("role").over(w).isNotNull()
    named = F.contains(F.col("line"), F.lit("老师")) & inner & beside & has(TEACHER_VERBS)
    role = F.when((F.col("role") == 1) & (single | has(TEACHER_PHRASES) | F.coalesce(named, F.lit(False))), 0).otherwise(F.col("role"))
    return s.withColumn("line", normalised(F.col("line"))).withColumn("role", role)


def statistics(s: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc, words, speed, mantras): word count, characters a minute in sentences
    of ten tokens or more, and how often each filler was said."""
    fit = F.col("n") >= 10
    a = s.groupBy("doc").agg(F.sum(T.char_num(F.col("line"))).alias("words"), F.sum(F.when(fit, T.char_num(F.col("line"))).otherwise(0)).alias("k"), F.sum(F.when(fit, F.col("seconds")).otherwise(0.0)).alias("t"))
    m = tokens.where(F.col("token").isin(MANTRAS)).groupBy("doc", "token").count().groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "count")))).alias("mantras"))
    return a.join(m, "doc", "left").select("doc", "words", F.when(F.col("t") > 0, F.floor(F.col("k") / (F.col("t") / 60))).alias("speed"), F.coalesce("mantras", F.create_map().cast("map<string,bigint>")).alias("mantras"))


def report(hyp_a: DataFrame, hyp_b: DataFrame, roles: DataFrame, *, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sentences, statistics) of whole recordings: hypotheses merged, tokens in
    order, roles (stream_id, role_id, start, end, role in ms) by the largest overlap."""
    from lecterna.operators.intervals import overlap_argmax

    kept = merged(hyp_a, hyp_b, compat=compat).where("decision <> 'drop'").select("stream_id", "idx")
    a = hyp_a.select("stream_id", "idx", "begin_ms", "asr_dec_raw_tokens", "asr_dec_stamp", F.substr(F.rtrim("asr_dec_preds"), F.lit(-1)).alias("final")).dropDuplicates(["stream_id", "idx"]).join(kept, ["stream_id", "idx"])
    both = F.arrays_zip(F.col("asr_dec_raw_tokens").alias("token"), F.col("asr_dec_stamp").alias("stamp"))
    # tokens carry no marks: the last one of an utterance gets the mark that ends its text
    u = a.select("stream_id", "idx", "begin_ms", "final", F.size("asr_dec_raw_tokens").alias("m"), F.posexplode(both).alias("k", "x")).where("x.token is not null")
    u = running(u, "stream_id", ["begin_ms", "idx", "k"], pos=("sum", F.lit(1)))
    u = u.select("stream_id", F.col("pos").cast("long").alias("pos"), F.col("x.token").alias("token"), F.when(F.col("k") == F.col("m") - 1, F.col("final")).alias("final"), (F.col("begin_ms") + F.coalesce("x.stamp.b", F.lit(0))).alias("start"), (F.col("begin_ms") + F.coalesce(F.greatest("x.stamp.e", F.col("x.stamp.b") + 1), F.lit(1))).alias("end"))
    u = lineage.written(u, "tokens")  # used twice below
    near = overlap_argmax(u.withColumnRenamed("pos", "token_id"), roles, "stream_id", 10_000).join(roles.select("stream_id", "role_id", "role"), ["stream_id", "role_id"]).select("stream_id", F.col("token_id").alias("pos"), "role")
    sign = F.coalesce("final", F.substr("token", F.lit(-1)))
    mark = F.when(sign.isin(list("。.!！”\"」।")), 3).when(sign.isin(list("?？؟")), 4).when(sign.isin(list(",，")), 2).otherwise(1)
    t = u.join(near, ["stream_id", "pos"], "left").select(F.col("stream_id").alias("doc"), "pos", "token", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), mark.alias("punc"), F.coalesce("role", F.lit(0)).alias("role"))
    t = lineage.written(t, "tokens")  # and this one several times
    s = role_overrides(sentences(t))
    return s, statistics(s, t)
