"""Queries of planning, grouping, ranking, windows of time, lookups and decoding,
with the SQL each is checked against; registered by ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lecterna import catalog as Q
from lecterna.functions import text as T
from lecterna.operators import decode
from lecterna.plans import speech, vision

query, table = Q.query, Q.table

_DUR = "TRY_CAST(userdata['end_ms'] AS BIGINT) - TRY_CAST(userdata['begin_ms'] AS BIGINT)"


@query(f"""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ingest_ts) AS r FROM task) WHERE r = 1),
  a AS (SELECT task_id, todo, userdata, CASE WHEN (todo & CAST(15033499648 AS BIGINT)) <> 0 THEN greatest(0, CAST(floor(({_DUR} - 25) / 10.0) AS BIGINT) + 1) END AS frames FROM t),
  b AS (SELECT *, CASE WHEN (todo & CAST(6443499520 AS BIGINT)) <> 0 THEN CAST(ceil(frames / 6.0) AS BIGINT) END AS stacked FROM a)
  SELECT task_id, coalesce(frames, -1) AS frames, coalesce(stacked, -1) AS stacked, coalesce(CASE WHEN (todo & CAST(4296015872 AS BIGINT)) <> 0 THEN CAST(coalesce((SELECT min(s) FROM (VALUES (16), (32), (64), (128), (256), (512)) v(s) WHERE s >= stacked), 512) AS BIGINT) END, -1) AS width,
    coalesce(CASE WHEN (todo & CAST(4294967296 AS BIGINT)) <> 0 THEN stacked * 3 + 1 END, -1) AS slots, coalesce(CASE WHEN (todo & CAST(8589934592 AS BIGINT)) <> 0 THEN CAST(ceil(frames / 6.0) AS BIGINT) + 4 END, -1) AS second_rows, coalesce(CASE WHEN (todo & 64) <> 0 THEN TRY_CAST(userdata['dex'] AS BIGINT) END, -1) AS segment FROM b""")
def plan_todo(spark: SparkSession, d: str) -> DataFrame:
    """What the operators that each task's bits call for, and those they depend on, make of it."""
    t = table(spark, d, "task").dropDuplicates(["task_id"])
    known = speech.registry()
    got = known.plan_rows(t.withColumn("todo", F.col("todo").bitwiseAND(F.lit(known.supported))))
    return got.select("task_id", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("frames", "stacked", "width", "slots", "second_rows", "segment")])


@query("SELECT name, CAST(m AS BIGINT) AS mid, CAST(n AS INT) AS needs FROM (VALUES ('asr_encode', 65536, 0), ('asr_predictor', 2147483648, 1), ('asr_decode', 1048576, 1), ('asr_stamp', 4294967296, 1), ('sensevoice', 8589934592, 1), ('voiceprint', 64, 0)) v(name, m, n)")
def registered(spark: SparkSession, d: str) -> DataFrame:
    return speech.registry().descriptors(spark).select("name", "mid", F.size("depend").alias("needs"))


@query("""WITH i AS (SELECT p_partkey AS image_id, CAST(1 << CAST(p_partkey % 12 AS INT) AS BIGINT) & 2703 AS todo, 640.0 + p_size * 8 AS w, CAST(length(p_name) * 24 AS DOUBLE) AS h FROM part)
  SELECT image_id, round(CASE WHEN (todo & 2191) <> 0 THEN least(960 / w, 544 / h) ELSE -1 END, 5) AS act_scale, round(CASE WHEN (todo & 2062) <> 0 THEN least(960 / w, 544 / h) ELSE -1 END, 5) AS face_scale,
    CAST(CASE WHEN (todo & 4) <> 0 THEN 112 ELSE -1 END AS INT) AS rec_side, CAST(CASE WHEN (todo & 8) <> 0 THEN 192 ELSE -1 END AS INT) AS ori_side, round(CASE WHEN (todo & 512) <> 0 THEN 224 / least(w, h) ELSE -1 END, 5) AS class_scale FROM i""")
def plan_images(spark: SparkSession, d: str) -> DataFrame:
    """The frames and crops that the operators asked for each image need."""
    p = table(spark, d, "part")
    i = p.select(F.col("p_partkey").alias("image_id"), F.expr("shiftleft(1L, cast(p_partkey % 12 as int)) & 2703L").alias("todo"), (640.0 + F.col("p_size") * 8).alias("width"), (F.length("p_name") * 24).cast("double").alias("height"))
    got = vision.registry().plan_rows(i)
    some = lambda c: F.round(F.coalesce(c, F.lit(-1.0)), 5).alias(c)
    side = lambda c: F.coalesce(c, F.lit(-1)).cast("int").alias(c)
    return got.select("image_id", some("act_scale"), some("face_scale"), side("rec_side"), side("ori_side"), some("class_scale"))


@query("""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return li.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT c_mktsegment, CAST(coalesce(c_nationkey, -1) AS INT) AS c_nationkey, CAST(grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS BIGINT) AS level, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n")).withColumn("c_nationkey", F.coalesce("c_nationkey", F.lit(-1)).cast("int"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY GROUPING SETS ((event_type), ())")
def distinct_sets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupingSets([[F.col("event_type")], []], "event_type").agg(F.countDistinct("user_id").alias("users"))


@query("""SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter, round(percent_rank() OVER w, 5) AS percent, round(cume_dist() OVER w, 5) AS share
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    w, t = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    long = lambda c: c.cast("long")
    return table(spark, d, "orders").select("o_orderkey", long(F.rank().over(w)).alias("rank"), long(F.dense_rank().over(w)).alias("dense"), long(F.ntile(4).over(t)).alias("quarter"), F.round(F.percent_rank().over(w), 5).alias("percent"), F.round(F.cume_dist().over(w), 5).alias("share"))


@query(f"""WITH {Q._EV}, b AS (SELECT user_id, ms // 300000 * 300000 - k * 300000 AS start_ms FROM ev, range(0, 2) r(k)) SELECT user_id, start_ms, count(*) AS n FROM b GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    e = Q.events(spark, d).select("user_id", F.timestamp_millis("ms").alias("at"))
    return e.groupBy("user_id", F.window("at", "10 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_millis("w.start").alias("start_ms"), "n")


@query(f"""WITH {Q._EV}, f AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) >= {Q.HOUR} THEN 1 ELSE 0 END AS nw FROM ev), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM f)
  SELECT user_id, min(ms) AS start_ms, max(ms) + {Q.HOUR} AS end_ms, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = Q.events(spark, d).select("user_id", F.timestamp_millis("ms").alias("at"))
    s = e.groupBy("user_id", F.session_window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


_MARKS = {".": 3, "。": 3, "?": 4, "？": 4, ",": 2, "，": 2, "、": 5}


@query(f"""WITH {Q._HYP}, m(sign, cls) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _MARKS.items())})
  SELECT stream_id, idx, CAST(coalesce(m.cls, 1) AS INT) AS mark FROM a LEFT JOIN m ON m.sign = right(rtrim(preds, ' '), 1) WHERE preds IS NOT NULL""")
def mark_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The class of the mark that ends each text, from a small table in the plan."""
    h = Q.hyp_a(spark, d).where("preds is not null")
    return h.select("stream_id", "idx", T.looked_up(F.substr(F.rtrim("preds"), F.lit(-1)), _MARKS, 1).alias("mark"))


@query("""SELECT 'embedding' AS kind, vec_id AS id, len(embedding) AS n FROM embeddings UNION ALL SELECT 'document', doc_id, coalesce(length(text), 0) FROM documents""")
def batch_concat(spark: SparkSession, d: str) -> DataFrame:
    """Batches of two kinds under one another, beginning with an empty one."""
    seed = spark.createDataFrame([], "kind string, id long, n long")
    a = table(spark, d, "embeddings").select(F.lit("embedding").alias("kind"), F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("n"))
    b = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"))
    return seed.unionByName(a).unionByName(b)


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, CAST(CAST('0x' || substr(md5(text), 1, 6) AS INT) % 16 AS INT) AS part FROM documents WHERE text IS NOT NULL")
def hash_parts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.pmod(F.conv(F.substr(F.md5("text"), F.lit(1), F.lit(6)), 16, 10).cast("int"), F.lit(16)).alias("part"))


@query("""WITH s AS (SELECT vec_id, i, embedding[CAST(i * 8 + 1 AS INT) : CAST(i * 8 + 8 AS INT)] AS x FROM embeddings, range(0, 8) r(i)), m AS (SELECT vec_id, i, list_position(x, list_max(x)) AS k, list_max(x) AS p FROM s),
  l AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY i) AS q FROM m), u AS (SELECT * FROM l WHERE (q IS NULL OR q <> k) AND k <> 1)
  SELECT e.vec_id, coalesce(string_agg(substr('abcdefg', CAST(k - 1 AS INT), 1), '' ORDER BY i), '') AS text, round(coalesce(avg(CAST(p AS DOUBLE)), 0), 5) AS confidence FROM embeddings e LEFT JOIN u USING (vec_id) GROUP BY e.vec_id""")
def ctc_decode(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return table(spark, d, "embeddings").select("vec_id", decode.decoded(x, list("abcdefg")).alias("x")).select("vec_id", "x.text", F.round("x.confidence", 5).alias("confidence"))


@query(f"""WITH {Q._BOX}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM b WHERE least(x2 - x1, y2 - y1) >= 3 AND score >= 950) SELECT det_id FROM k WHERE r <= 20""")
def text_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of each image that are large and sure enough, the best twenty."""
    b = Q.boxes(spark, d).where((F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 3) & (F.col("score") >= 950))
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return b.withColumn("r", F.row_number().over(w)).where("r <= 20").select("det_id")


@query("""WITH v AS (SELECT DISTINCT stream_id, idx, begin_ms AS b, end_ms AS e FROM vad_segment WHERE begin_ms >= 0 AND idx IS NOT NULL AND begin_ms < end_ms), r AS (SELECT stream_id, b // 60000 AS minute, idx % 3 AS role, sum(e - b) AS ms FROM v GROUP BY 1, 2, 3)
  SELECT stream_id, minute, CAST(arg_max(role, struct_pack(a := ms, b := -role)) AS INT) AS role, CAST(max(ms) AS BIGINT) AS ms FROM r GROUP BY 1, 2""")
def role_duration(spark: SparkSession, d: str) -> DataFrame:
    """The role that speaks longest in each minute, ties to the smaller one."""
    v = table(spark, d, "vad_segment").where("begin_ms >= 0 and idx is not null and begin_ms < end_ms").select("stream_id", "idx", "begin_ms", "end_ms").distinct()
    r = v.groupBy("stream_id", F.floor(F.col("begin_ms") / 60000).alias("minute"), (F.col("idx") % 3).alias("role")).agg(F.sum(F.col("end_ms") - F.col("begin_ms")).cast("long").alias("ms"))
    return r.groupBy("stream_id", "minute").agg(F.max_by("role", F.struct("ms", -F.col("role"))).alias("role"), F.max("ms").alias("ms"))


@query(f"""WITH {Q._HYP}, t AS (SELECT stream_id, idx, list_filter(tokens, lambda w: w <> '') AS w FROM a WHERE tokens IS NOT NULL)
  SELECT stream_id, idx, CASE WHEN len(w) = 0 THEN '' ELSE list_aggregate(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(w[i], '^[a-zA-Z]') AND regexp_matches(w[i - 1], '[a-zA-Z]$') THEN ' ' ELSE '' END || w[i]), 'string_agg', '') END AS line FROM t""")
def plain_lines(spark: SparkSession, d: str) -> DataFrame:
    h = Q.hyp_a(spark, d).where("tokens is not null")
    return h.select("stream_id", "idx", T.joined_plain(F.col("tokens")).alias("line"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\.\\.\\.|--|(?s:.)')) AS n FROM documents WHERE text IS NOT NULL""")
def symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(T.symbols(F.col("text"), ["...", "--"])).cast("long").alias("n"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, begin_ms, len(asr_dec_raw_tokens) AS n FROM hyp_a WHERE asr_dec_raw_tokens IS NOT NULL), c AS (SELECT *, sum(n) OVER (PARTITION BY stream_id ORDER BY begin_ms, idx ROWS UNBOUNDED PRECEDING) AS upto FROM a)
  SELECT stream_id, idx, CAST(upto - n AS BIGINT) AS first, CAST(upto AS BIGINT) AS behind FROM c WHERE n > 0""")
def crop_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Where the tokens of each utterance lie among all tokens of its stream."""
    from lecterna.operators.ordered import running

    h = Q.hyp_a(spark, d).where("tokens is not null").select("stream_id", "idx", "begin_ms", F.size("tokens").cast("long").alias("n"))
    rows = running(h, "stream_id", ["begin_ms", "idx"], behind=("sum", "n"))
    return rows.where("n > 0").select("stream_id", "idx", (F.col("behind") - F.col("n")).alias("first"), "behind")


@query("""SELECT stream_id, idx, CAST(to_json(struct_pack(idx := idx, preds := preds, n := n)) AS VARCHAR) AS json FROM (SELECT DISTINCT stream_id, idx, asr_dec_preds AS preds, len(asr_dec_raw_tokens) AS n FROM hyp_a) WHERE preds IS NOT NULL AND n IS NOT NULL""")
def hypothesis_json(spark: SparkSession, d: str) -> DataFrame:
    h = Q.hyp_a(spark, d).where("preds is not null and tokens is not null")
    return h.select("stream_id", "idx", F.to_json(F.struct("idx", "preds", F.size("tokens").alias("n"))).alias("json"))


@query("SELECT vec_id, CAST(len(embedding) * 1 AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def flattened(spark: SparkSession, d: str) -> DataFrame:
    """Nested caches (4 x 16) fed as one flat list."""
    nested = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    flat = F.flatten(nested)
    return table(spark, d, "embeddings").select("vec_id", F.size(flat).alias("n"), F.round(F.aggregate(flat, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


