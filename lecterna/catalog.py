"""The core queries by name and the SQL each is checked against.

Every query runs over its whole tables. Times are milliseconds since 1970 as
integers; sums of doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lecterna.functions import text as T
from lecterna.functions import vector as V
from lecterna.operators import cluster as C
from lecterna.operators import detections as D
from lecterna.operators import intervals as I
from lecterna.operators.ordered import running
from lecterna.plans import registry as R
from lecterna.plans.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(ship(spark), d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time in ms."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


_EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events)"
_ISL = f"""{_EV},
  f AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) >= {HOUR} THEN 1 ELSE 0 END AS nw FROM ev),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
  sp AS (SELECT user_id, island, min(ms) AS s, max(ms) + 1000 AS e, count(*) AS n FROM g GROUP BY user_id, island)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("end", F.col("ms"))
    return I.spans(e, "user_id", "ms", "end", HOUR, tie="event_id").select("user_id", "island", F.col("ms").alias("start"), (F.col("end") + 1000).alias("end"), "n")


@query(f"""WITH {_ISL},
  c AS (SELECT user_id, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fs, s AS fe FROM sp),
  free AS (SELECT user_id, fs, fe FROM c WHERE fs < fe),
  a AS (SELECT user_id, count(*) AS spans, sum(e - s) AS active_ms, sum(n) AS events FROM sp GROUP BY user_id),
  b AS (SELECT user_id, count(*) AS gaps, sum(fe - fs) AS idle_ms, max(fe - fs) AS longest_ms FROM free GROUP BY user_id)
  SELECT a.user_id, CAST(spans AS BIGINT) AS spans, CAST(active_ms AS BIGINT) AS active_ms, CAST(events AS BIGINT) AS events, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(idle_ms, 0) AS BIGINT) AS idle_ms, CAST(coalesce(longest_ms, 0) AS BIGINT) AS longest_ms FROM a LEFT JOIN b USING (user_id)""")
def activity_report(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    free = I.complement(s, "user_id", "start", "end", F.lit(None).cast("long"), F.max("end"))
    a = s.groupBy("user_id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("active_ms"), F.sum("n").alias("events"))
    b = free.groupBy("user_id").agg(F.count("*").alias("gaps"), F.sum(F.col("end") - F.col("start")).alias("idle_ms"), F.max(F.col("end") - F.col("start")).alias("longest_ms"))
    return a.join(b, "user_id", "left").fillna(0, ["gaps", "idle_ms", "longest_ms"])


@query("SELECT asr_type, CAST(bit_or(bits) AS BIGINT) AS supported FROM (SELECT CASE WHEN userdata['dex'] IS NULL THEN 'speech' ELSE 'voice' END AS asr_type, todo AS bits FROM task) GROUP BY asr_type")
def mask_supported(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task").select(F.when(F.col("userdata")["dex"].isNull(), "speech").otherwise("voice").alias("asr_type"), F.col("todo").alias("bits"))
    return R.supported_mask(t, ["asr_type"], "bits")


_BITS = ", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(R.BITS.items()))


@query(f"""WITH ops(pos, name, mid) AS (VALUES {_BITS}), t AS (SELECT DISTINCT task_id, todo FROM task)
  SELECT task_id, coalesce(string_agg(name, '|' ORDER BY pos), 'None') AS names FROM t LEFT JOIN ops ON (todo & CAST(mid AS BIGINT)) = mid GROUP BY task_id""")
def mask_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task").select("task_id", "todo").distinct()
    return t.select("task_id", R.mask_names(F.col("todo")).alias("names"))


@query("""WITH t AS (SELECT DISTINCT task_id, todo FROM task), b AS (SELECT task_id, CAST(1 AS BIGINT) << CAST(i AS BIGINT) AS bit, todo FROM t, range(0, 62) r(i))
  SELECT bit, count(*) AS tasks FROM b WHERE (todo & bit) <> 0 GROUP BY bit""")
def mask_bits(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task").select("task_id", "todo").distinct()
    return t.select(F.explode(R.bits_of(F.col("todo"))).alias("bit")).groupBy("bit").agg(F.count("*").alias("tasks"))


@query("""SELECT l_orderkey, CAST(15 & ~bit_or(CAST(1 << (l_linenumber - 1) AS BIGINT)) AS BIGINT) AS remaining FROM lineitem WHERE l_linenumber < 63 GROUP BY l_orderkey""")
def mask_remaining(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_linenumber < 63").select("l_orderkey", F.lit(15).cast("long").alias("todo"), F.expr("shiftleft(1L, l_linenumber - 1)").alias("done"))
    return R.remaining(li, ["l_orderkey"], "todo", "done")


@query("SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL AND s_acctbal > 8000)")
def dependency_missing(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier").where("s_acctbal > 8000")
    descr = c.select(F.col("c_custkey").alias("mid"), F.array(F.col("c_nationkey").cast("long")).alias("depend"))
    have = s.select(F.col("s_nationkey").cast("long").alias("dep")).distinct()
    need = descr.select("mid", F.explode("depend").alias("dep")).join(have, "dep", "left_anti")
    return need.select(F.col("mid").alias("c_custkey"), F.col("dep").cast("int").alias("c_nationkey")).distinct()


_DEPS = [(0x100000, 0x80000000), (0x80000000, 0x10000), (0x100000000, 0x100000), (0x200000000, 0x100000000), (0x800000000, 0x400000000), (0x1000000000, 0x800000000), (2048, 2), (4, 2), (8, 2), (128, 1)]


@query(f"""WITH RECURSIVE deps(mid, dep) AS (VALUES {', '.join(f'(CAST({a} AS BIGINT), CAST({b} AS BIGINT))' for a, b in _DEPS)}),
  dd(mid, depth) AS (SELECT DISTINCT dep, 0 FROM deps WHERE dep NOT IN (SELECT mid FROM deps) UNION ALL SELECT x.mid, dd.depth + 1 FROM deps x JOIN dd ON x.dep = dd.mid)
  SELECT mid, max(depth) AS depth FROM dd GROUP BY mid""")
def dependency_depth(spark: SparkSession, d: str) -> DataFrame:
    return R.depth(spark, _DEPS)


@query("""SELECT task_id, CASE WHEN (todo & 65536) <> 0 THEN 'ASR_ENCODE' WHEN (todo & 2147483648) <> 0 THEN 'ASR_PREDICTOR' WHEN (todo & 1048576) <> 0 THEN 'ASR_DECODE' WHEN (todo & 4294967296) <> 0 THEN 'ASR_STAMP' WHEN (todo & 64) <> 0 THEN 'VOICEPRINT' END AS operator
  FROM (SELECT DISTINCT task_id, todo FROM task)""")
def dispatch_first(spark: SparkSession, d: str) -> DataFrame:
    name = {v: k for k, v in R.BITS.items()}
    t = table(spark, d, "task").select("task_id", "todo").distinct()
    return R.dispatched(t, "todo", [0x10000, 0x80000000, 0x100000, 0x100000000, 64], name).select("task_id", "operator")


@query("""WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), b(size) AS (VALUES (16), (8), (4), (2), (1))
  SELECT c_nationkey, size, CAST(CASE WHEN size = 16 THEN n // 16 ELSE (n % (size * 2)) // size END AS BIGINT) AS batches FROM n, b WHERE CASE WHEN size = 16 THEN n // 16 ELSE (n % (size * 2)) // size END > 0""")
def batch_powers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.select("c_nationkey", F.explode(R.powers(F.col("n"), 16)).alias("size")).groupBy("c_nationkey", "size").agg(F.count("*").alias("batches"))


@query("SELECT doc_id, coalesce((SELECT min(s) FROM (VALUES (64),(128),(256),(512),(1024),(2048)) v(s) WHERE s >= n_chars), 2048) AS width, n_chars // 1000 AS slot FROM documents WHERE n_chars IS NOT NULL")
def bucket_width(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("n_chars is not null")
    return t.select("doc_id", V.bucket(F.col("n_chars"), [64, 128, 256, 512, 1024, 2048]).alias("width"), F.floor(F.col("n_chars") / 1000).alias("slot"))


@query("SELECT event_type, count(value) AS n, round(sum(value), 3) AS total, round(avg(value), 4) AS mean, max(value) AS largest, min(value) AS smallest FROM events GROUP BY event_type")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("largest"), F.min("value").alias("smallest"))


@query("""SELECT user_id, CASE WHEN event_type LIKE '%view%' THEN 'pre' WHEN event_type LIKE '%cl%' THEN 'infer' ELSE 'post' END AS phase, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def profile_phase(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("event_type").contains("view"), "pre").when(F.col("event_type").contains("cl"), "infer").otherwise("post")
    return table(spark, d, "events").groupBy("user_id", phase.alias("phase")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


_INTER = ["嗯", "啊", "呃", "哦", "吧", "呢"]


@query(f"""WITH dom(word) AS (VALUES {', '.join(f"('{w}')" for w in _INTER)}), a AS (SELECT DISTINCT stream_id, idx, asr_dec_raw_tokens AS t FROM hyp_a),
  tok AS (SELECT stream_id, unnest(t) AS word FROM a), s AS (SELECT DISTINCT stream_id FROM a)
  SELECT s.stream_id, dom.word, count(tok.word) AS n FROM s CROSS JOIN dom LEFT JOIN tok ON tok.stream_id = s.stream_id AND tok.word = dom.word GROUP BY 1, 2""")
def fixed_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "hyp_a").select("stream_id", "idx", F.col("asr_dec_raw_tokens").alias("t")).distinct()
    zero = a.select("stream_id").distinct().select("stream_id", F.explode(F.array(*[F.lit(w) for w in _INTER])).alias("word"))
    n = a.select("stream_id", F.explode("t").alias("word")).where(F.col("word").isin(_INTER)).groupBy("stream_id", "word").agg(F.count("*").alias("n"))
    return zero.join(n, ["stream_id", "word"], "left").fillna(0, ["n"])


@query(f"""WITH {_EV}, c AS (SELECT user_id, event_type, count(*) AS n, min(struct_pack(ms := ms, id := event_id)) AS f FROM ev GROUP BY 1, 2)
  SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def counter_top(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(F.struct("ms", "event_id")).alias("f"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "f")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type", "n")


@query(f"""WITH {_EV}, er AS (SELECT * FROM ev WHERE event_type = 'purchase'), ok AS (SELECT user_id, ms, event_type FROM ev WHERE event_type <> 'purchase'),
  b AS (SELECT e.user_id, e.event_id, e.ms, (SELECT max(struct_pack(ms := o.ms, v := o.event_type)) FROM ok o WHERE o.user_id = e.user_id AND o.ms <= e.ms) AS x FROM er e),
  v AS (SELECT user_id, x.v AS label, (ms - x.ms) >= {HOUR} AS is_long FROM b WHERE x IS NOT NULL),
  n AS (SELECT user_id, label, count(*) FILTER (is_long) AS nl, count(*) FILTER (NOT is_long) AS ns FROM v GROUP BY 1, 2),
  m AS (SELECT *, max(nl) OVER (PARTITION BY user_id) > 0 AS has FROM n),
  s AS (SELECT user_id, label, CASE WHEN has AND nl > 0 THEN nl + 0.3 * ns WHEN NOT has THEN ns END AS score FROM m)
  SELECT user_id, label, CAST(round(score, 3) AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, label) AS rank FROM s WHERE score IS NOT NULL""")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    gaps = e.where("event_type = 'purchase'").select("user_id", "event_id", "ms")
    near = I.asof(gaps, e.where("event_type <> 'purchase'").select("user_id", "ms", "event_type"), "user_id", "ms", "event_type", tie="event_id")
    votes = near.where("near_value is not null").select(F.col("user_id").alias("key"), F.col("near_value").alias("label"), ((F.col("ms") - F.col("near_time")) >= HOUR).alias("is_long"))
    return C.voted(votes).select(F.col("key").alias("user_id"), "label", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice > 0)
  SELECT l_returnflag, round(avg(x), 3) AS top_mean FROM r WHERE n < 10 OR k <= n // 10 GROUP BY 1""")
def top_fraction_mean(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_extendedprice > 0").select("l_returnflag", "l_extendedprice")
    # the threshold by counts of equal values, so that no group is sorted in one task
    per = li.groupBy("l_returnflag", "l_extendedprice").agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_returnflag")
    cum = per.withColumn("above", F.coalesce(F.sum("c").over(w.orderBy(F.desc("l_extendedprice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(w))
    most = F.when(F.col("n") < 10, F.col("n")).otherwise(F.floor(F.col("n") / 10))
    used = cum.withColumn("u", F.greatest(F.lit(0), F.least(F.col("c"), most - F.col("above")))).where("u > 0")
    return used.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("u")) / F.sum("u"), 3).alias("top_mean"))


@query("""SELECT vec_id, i AS frame, round(10 * log10(list_sum(list_transform(embedding[i * 10 + 1 : i * 10 + 25], lambda x: CAST(x AS DOUBLE) * x)) + 1e-6), 5) AS db FROM embeddings, range(0, 4) r(i)""")
def decibel_frames(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "embeddings").select("vec_id", F.posexplode(I.frames(F.col("embedding"), 25, 10)).alias("frame", "x"))
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(V.decibel(F.col("x")), 5).alias("db"))


@query(f"WITH {_EV} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 5) AS smooth FROM ev")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.round(I.moving_average("value", "user_id", ["ms", "event_id"]), 5).alias("smooth"))


@query("SELECT vec_id, i AS frame, round(list_sum(list_transform(embedding[i * 8 + 1 : i * 8 + 16], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings, range(0, 7) r(i)")
def frames_slide(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "embeddings").select("vec_id", F.posexplode(I.frames(F.col("embedding"), 16, 8)).alias("frame", "x"))
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("""SELECT vec_id, i AS frame, round(list_sum(list_transform(range(0, 7), lambda k: CAST(embedding[CAST(greatest(1, least(64, i * 6 + k - 2)) AS INT)] AS DOUBLE))), 5) AS total FROM embeddings, range(0, 11) r(i)""")
def lfr_stack(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "embeddings").select("vec_id", F.posexplode(I.stacked(F.col("embedding"), 7, 6)).alias("frame", "x"))
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query(f"WITH {_ISL} SELECT user_id, CAST(island AS BIGINT) AS island, s AS start_ms, e AS end_ms, n FROM sp")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("user_id", "island", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n")


@query(f"""WITH {_EV}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS pos FROM ev), k AS (SELECT * FROM p WHERE event_type <> 'view')
  SELECT user_id, pos - 1 AS pos FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM k) WHERE gap >= {HOUR}""")
def pause_index(spark: SparkSession, d: str) -> DataFrame:
    return I.pauses(events(spark, d), "user_id", ["ms", "event_id"], "ms", "ms", "event_type", ["view"], HOUR).select("user_id", F.col("pos").cast("long").alias("pos"))


@query("""WITH RECURSIVE v AS (SELECT DISTINCT stream_id, idx, begin_ms AS b, end_ms AS e FROM vad_segment WHERE begin_ms >= 0 AND idx IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY b, e) AS r, b - lag(e) OVER (PARTITION BY stream_id ORDER BY b, e) AS gap FROM v),
  w(stream_id, r, head, e, grp) AS (SELECT stream_id, r, b, e, 1 FROM o WHERE r = 1
    UNION ALL SELECT o.stream_id, o.r, CASE WHEN o.gap > 1200 OR o.e - w.head >= 15000 THEN o.b ELSE w.head END, o.e, CASE WHEN o.gap > 1200 OR o.e - w.head >= 15000 THEN w.grp + 1 ELSE w.grp END FROM w JOIN o ON o.stream_id = w.stream_id AND o.r = w.r + 1)
  SELECT stream_id, head AS begin_ms, max_by(e, r) AS end_ms, count(*) AS n FROM w GROUP BY stream_id, grp, head""")
def merge_capped(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vad_segment").where("begin_ms >= 0 and idx is not null").select("stream_id", "idx", "begin_ms", "end_ms").distinct()
    return I.merge_capped(v, "stream_id", "begin_ms", "end_ms", cap=15_000, gap=1200)


@query(f"""WITH {_EV} SELECT event_id, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)::BIGINT AS speech FROM ev""")
def vad_window_sum(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ms", "event_id").rowsBetween(-19, 0)
    return events(spark, d).select("event_id", F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).over(w).alias("speech"))


@query("""WITH v AS (SELECT DISTINCT stream_id, idx, begin_ms AS b, end_ms AS e FROM vad_segment WHERE begin_ms >= 0 AND idx IS NOT NULL AND begin_ms < end_ms),
  c AS (SELECT stream_id, coalesce(max(e) OVER (PARTITION BY stream_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, b AS t FROM v)
  SELECT stream_id, s AS begin_ms, t AS end_ms FROM c WHERE s < t UNION ALL SELECT stream_id, max(e), max(e) + 1000 FROM v GROUP BY stream_id""")
def interval_complement(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vad_segment").where("begin_ms >= 0 and idx is not null and begin_ms < end_ms").select("stream_id", "idx", "begin_ms", "end_ms").distinct()
    return I.complement(v, "stream_id", "begin_ms", "end_ms", F.lit(0).cast("long"), F.max("end_ms") + 1000)


@query("""WITH v AS (SELECT DISTINCT stream_id, idx, begin_ms AS b, end_ms AS e FROM vad_segment WHERE begin_ms >= 0 AND idx IS NOT NULL AND begin_ms < end_ms)
  SELECT stream_id, idx, CAST(i AS INT) AS piece, b + i * 5000 AS begin_ms, least(e, b + i * 5000 + 5000) AS end_ms FROM v, range(0, 100) r(i) WHERE b + i * 5000 < e""")
def cut_long(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vad_segment").where("begin_ms >= 0 and idx is not null").select("stream_id", "idx", "begin_ms", "end_ms").distinct()
    return I.cut_long(v, "begin_ms", "end_ms", 5000)


_SLICES = """v AS (SELECT DISTINCT stream_id, idx, (end_ms - begin_ms) / 1000.0::DOUBLE AS dur FROM vad_segment WHERE begin_ms >= 0 AND idx IS NOT NULL AND begin_ms < end_ms),
  s AS (SELECT stream_id, idx, dur, floor(dur) AS w, dur - floor(dur) AS t FROM v),
  p AS (SELECT stream_id, idx, CASE WHEN w < 1 THEN 1 WHEN t >= 0.2 THEN w + 1 ELSE w END AS n, dur, w, t FROM s),
  q AS (SELECT stream_id, idx, i AS piece, CASE WHEN w < 1 THEN dur WHEN t >= 0.2 THEN CASE WHEN i < w THEN 1.0 ELSE t END ELSE CASE WHEN i < w - 1 THEN 1.0 ELSE 1.0 + t END END AS d FROM p, range(0, 200) r(i) WHERE i < n)"""


@query(f"WITH {_SLICES} SELECT stream_id, idx, CAST(piece AS INT) AS piece, round(d, 4) AS seconds, round(sum(d) OVER (PARTITION BY stream_id ORDER BY idx, piece) - d, 3) AS at FROM q")
def slice_timeline(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vad_segment").where("begin_ms >= 0 and idx is not null and begin_ms < end_ms").select("stream_id", "idx", ((F.col("end_ms") - F.col("begin_ms")) / 1000.0).alias("dur")).distinct()
    s = v.select("stream_id", "idx", F.posexplode(I.slices(F.col("dur"), 0.2)).alias("piece", "seconds"))
    return I.timeline(s, "stream_id", ["idx", "piece"], "seconds").select("stream_id", "idx", "piece", F.round("seconds", 4).alias("seconds"), F.round("at", 3).alias("at"))


@query(f"""WITH {_EV}, p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS pos FROM ev),
  r AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS run FROM p)
  SELECT user_id, event_type, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r GROUP BY user_id, event_type, run""")
def run_length(spark: SparkSession, d: str) -> DataFrame:
    r = I.runs(events(spark, d), "user_id", ["ms", "event_id"], "event_type")
    return r.select("user_id", "event_type", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query("""WITH v AS (SELECT DISTINCT stream_id, idx, begin_ms AS b, end_ms AS e FROM vad_segment WHERE begin_ms >= 0 AND idx IS NOT NULL AND begin_ms < end_ms),
  g AS (SELECT stream_id, (b // 10000) * 10000 AS c FROM v UNION SELECT stream_id, (e // 10000) * 10000 FROM v),
  w AS (SELECT stream_id, c // 10000 AS role_id, c AS b, c + 10000 AS e FROM g),
  o AS (SELECT v.stream_id, v.idx AS token_id, w.role_id, least(v.e, w.e) - greatest(v.b, w.b) AS ov FROM v JOIN w ON v.stream_id = w.stream_id AND v.b < w.e AND w.b < v.e)
  SELECT stream_id, token_id, arg_max(role_id, struct_pack(a := ov, b := -role_id)) AS role_id, max(ov) AS overlap FROM o GROUP BY 1, 2""")
def overlap_argmax(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vad_segment").where("begin_ms >= 0 and idx is not null and begin_ms < end_ms").select("stream_id", F.col("idx").alias("token_id"), F.col("begin_ms").alias("start"), F.col("end_ms").alias("end")).distinct()
    cell = v.select("stream_id", F.explode(F.array(F.floor(F.col("start") / 10000), F.floor(F.col("end") / 10000))).alias("role_id")).distinct()
    roles = cell.select("stream_id", "role_id", (F.col("role_id") * 10000).alias("start"), (F.col("role_id") * 10000 + 10000).alias("end"))
    return I.overlap_argmax(v, roles, "stream_id", 10_000)


@query(f"""WITH {_EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), p AS (SELECT user_id, ms, max(event_id) AS event_id FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)
  SELECT c.event_id, coalesce(a.event_id, -1) AS prev_purchase, coalesce(b.event_id, -1) AS next_purchase FROM c ASOF LEFT JOIN p a ON c.user_id = a.user_id AND c.ms >= a.ms ASOF LEFT JOIN p b ON c.user_id = b.user_id AND c.ms <= b.ms""")
def asof_prev_next(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    c = e.where("event_type = 'click'").select("user_id", "event_id", "ms")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ms").agg(F.max("event_id").alias("pid"))
    a = I.asof(c, p, "user_id", "ms", "pid", tie="event_id").select("user_id", "event_id", "ms", F.col("near_value").alias("prev_purchase"))
    b = I.asof(a, p, "user_id", "ms", "pid", forward=True, tie="event_id")
    none = F.lit(-1).cast("long")
    return b.select("event_id", F.coalesce("prev_purchase", none).alias("prev_purchase"), F.coalesce("near_value", none).alias("next_purchase"))


@query(f"""WITH {_EV} SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS p FROM ev) WHERE (p IS NULL OR p <> event_type) AND event_type <> 'view'""")
def ctc_collapse(spark: SparkSession, d: str) -> DataFrame:
    return I.ctc_collapse(events(spark, d), "user_id", ["ms", "event_id"], "event_type", "view").select("user_id", "event_id")


@query(f"""WITH {_EV}, n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS pos FROM ev), p AS (SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nx, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS nth FROM n WHERE value > 100)
  SELECT user_id, nth, round((pos - 1.5) * 0.02, 5) AS start, round((least(nx, pos + 30) - 1.5) * 0.02, 5) AS end FROM p WHERE nx IS NOT NULL""")
def peak_stamps(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "event_id")))
    p = I.peak_stamps(e, "user_id", "pos", "value", least=100, offset=-1.5, unit=0.02, longest=30)
    return p.select("user_id", F.col("nth").cast("long").alias("nth"), F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


@query(f"""WITH {_EV} SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS role FROM ev""")
def particle_carry(spark: SparkSession, d: str) -> DataFrame:
    return I.carried(events(spark, d), "user_id", ["ms", "event_id"], "role", F.col("event_type"), F.col("event_type") != "view").select("event_id", "role")


_HYP = "a AS (SELECT DISTINCT stream_id, idx, begin_ms, asr_type, audio_db, asr_dec_preds AS preds, asr_dec_raw_tokens AS tokens FROM hyp_a)"


def hyp_a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hyp_a").select("stream_id", "idx", "begin_ms", "asr_type", "audio_db", F.col("asr_dec_preds").alias("preds"), F.col("asr_dec_raw_tokens").alias("tokens"), F.col("asr_dec_stamp").alias("stamps")).dropDuplicates(["stream_id", "idx"])


@query("""WITH s AS (SELECT DISTINCT stream_id, idx, audio_db FROM vad_segment WHERE idx IS NOT NULL) SELECT stream_id, count(*) AS kept FROM s WHERE audio_db >= 0.003 GROUP BY 1""")
def loud_segments(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "vad_segment").where("idx is not null").select("stream_id", "idx", "audio_db").distinct()
    return s.where("audio_db >= 0.003").groupBy("stream_id").agg(F.count("*").alias("kept"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, begin_ms, asr_dec_preds AS p FROM hyp_a), m AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY begin_ms, idx) AS pos FROM a),
  b AS (SELECT *, CASE WHEN lag(p) OVER (PARTITION BY stream_id ORDER BY pos) IS NULL OR regexp_matches(lag(p) OVER (PARTITION BY stream_id ORDER BY pos), '[.。?？!！]$') THEN 1 ELSE 0 END AS nw FROM m),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY stream_id ORDER BY pos) AS sent FROM b) SELECT stream_id, CAST(sent AS BIGINT) AS sentence, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS parts FROM g GROUP BY 1, 2""")
def fragment_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "hyp_a").select("stream_id", "idx", "begin_ms", F.col("asr_dec_preds").alias("p")).distinct()
    order = ["begin_ms", "idx"]
    rows = running(a, "stream_id", order, before=("lag", "p"))
    new = F.when(F.col("before").isNull() | F.col("before").rlike("[.。?？!！]\\z"), 1).otherwise(0)
    g = running(rows.withColumn("nw", new), "stream_id", order, sentence=("sum", "nw"))
    return g.groupBy("stream_id", "sentence").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("parts"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, len(asr_dec_raw_tokens) AS n, list_max(list_transform(asr_dec_stamp, lambda s: s.e)) AS ms FROM hyp_a)
  SELECT stream_id, CAST(sum(n) AS BIGINT) AS words, CAST(floor(sum(CASE WHEN n >= 10 AND ms > 0 THEN n ELSE 0 END) / (sum(CASE WHEN n >= 10 AND ms > 0 THEN ms ELSE 0 END) / 60000.0)) AS BIGINT) AS speed FROM a GROUP BY 1 HAVING sum(CASE WHEN n >= 10 AND ms > 0 THEN ms ELSE 0 END) > 0""")
def speech_rate(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "hyp_a").select("stream_id", "idx", F.when(F.col("asr_dec_raw_tokens").isNotNull(), F.size("asr_dec_raw_tokens")).alias("n"), F.array_max(F.transform("asr_dec_stamp", lambda s: s["e"])).alias("ms")).distinct()
    fit = (F.col("n") >= 10) & (F.col("ms") > 0)
    g = a.groupBy("stream_id").agg(F.sum("n").alias("words"), F.sum(F.when(fit, F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(fit, F.col("ms")).otherwise(0)).alias("t"))
    return g.where("t > 0").select("stream_id", "words", F.floor(F.col("k") / (F.col("t") / 60000.0)).alias("speed"))


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("k")).where("k <= 3")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, c_acctbal DESC, c_name DESC) AS rank FROM customer")
def lex_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    return D.face_rank(table(spark, d, "customer"), "c_nationkey", ["c_name", "c_acctbal", "c_mktsegment"]).select("c_custkey", F.col("rank").cast("long").alias("rank"))


_BOX = """b AS (SELECT p_partkey AS det_id, p_size AS image_id, CAST(length(p_name) % 4 AS INT) AS cid, CAST(p_partkey % 97 AS DOUBLE) AS x1, CAST(p_partkey % 53 AS DOUBLE) AS y1, CAST(p_partkey % 97 + 20 + p_size AS DOUBLE) AS x2, CAST(p_partkey % 53 + 30 AS DOUBLE) AS y2, p_retailprice AS score FROM part)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    x, y = (F.col("p_partkey") % 97).cast("double"), (F.col("p_partkey") % 53).cast("double")
    return p.select(F.col("p_partkey").alias("det_id"), F.col("p_size").alias("image_id"), (F.length("p_name") % 4).cast("int").alias("cid"), x.alias("x1"), y.alias("y1"), (x + 20 + F.col("p_size")).alias("x2"), (y + 30).alias("y2"), F.col("p_retailprice").alias("score"))


@query(f"""WITH RECURSIVE {_BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, cid ORDER BY score DESC, det_id) AS r FROM b),
  k(image_id, cid, r, kept) AS (SELECT image_id, cid, 1::BIGINT, [struct_pack(id := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] FROM o WHERE r = 1
    UNION ALL SELECT o.image_id, o.cid, o.r, CASE WHEN len(list_filter(k.kept, lambda z: greatest(0, least(z.x2, o.x2) - greatest(z.x1, o.x1)) * greatest(0, least(z.y2, o.y2) - greatest(z.y1, o.y1)) /
      ((z.x2 - z.x1) * (z.y2 - z.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(z.x2, o.x2) - greatest(z.x1, o.x1)) * greatest(0, least(z.y2, o.y2) - greatest(z.y1, o.y1)) + 1e-6) > 0.45)) = 0
      THEN list_append(k.kept, struct_pack(id := o.det_id, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) ELSE k.kept END FROM k JOIN o ON o.image_id = k.image_id AND o.cid = k.cid AND o.r = k.r + 1)
  SELECT image_id, cid, unnest(list_transform(kept, lambda z: z.id)) AS det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cid ORDER BY r DESC) AS nth FROM k) WHERE nth = 1""")
def nms_boxes(spark: SparkSession, d: str) -> DataFrame:
    return D.nms(boxes(spark, d), ["image_id", "cid"], 0.45).select("image_id", "cid", "det_id")


@query(f"WITH {_BOX} SELECT det_id, least(greatest(x1, 0), 80.0) AS x1, least(greatest(y1, 0), 60.0) AS y1, least(greatest(x2, 0), 80.0) AS x2, least(greatest(y2, 0), 60.0) AS y2 FROM b WHERE score >= 500 AND cid IN (2, 3) AND least(greatest(x1, 0), 80.0) < least(x2, 80.0) AND least(greatest(y1, 0), 60.0) < least(y2, 60.0)")
def clip_filter(spark: SparkSession, d: str) -> DataFrame:
    b = D.of_classes(D.confident(boxes(spark, d), "score", 500), (2, 3))
    return D.clipped(b, F.lit(80.0), F.lit(60.0)).select("det_id", "x1", "y1", "x2", "y2")


@query(f"WITH {_BOX} SELECT det_id, round((x1 - 4) / 0.75, 4) AS x1, round(y1 / 0.75, 4) AS y1, round((x2 - 4) / 0.75, 4) AS x2, round(y2 / 0.75, 4) AS y2 FROM b")
def det_rescale(spark: SparkSession, d: str) -> DataFrame:
    b = D.rescaled(boxes(spark, d), D.letterbox(F.lit(1280.0), F.lit(720.0), 960, 544), 4.0)
    return b.select("det_id", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"WITH {_BOX} SELECT image_id, count(*) AS n FROM b GROUP BY 1")
def detection_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.counts(boxes(spark, d), "image_id")


@query("""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
  SELECT id, other, round(sim, 5) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s) WHERE rank <= 5""")
def cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    return C.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("id", "other", F.round("sim", 5).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s) WHERE rank <= 5), e AS (SELECT id, other FROM k WHERE sim >= 0.5)
  SELECT vec_id, (SELECT count(*) FROM e WHERE e.id = vec_id) AS links, vec_id NOT IN (SELECT id FROM e UNION SELECT other FROM e) AS isolated FROM embeddings""")
def affinity_edges(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    e = C.affinity_edges(C.knn(v, "vec_id", "embedding", 5), 0.5)
    n = e.groupBy(F.col("src").alias("vec_id")).agg(F.count("*").alias("links"))
    alone = C.isolated(v, "vec_id", e).withColumn("isolated", F.lit(True))
    return v.select("vec_id").join(n, "vec_id", "left").join(alone, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("isolated", F.lit(False)).alias("isolated"))


@query("""WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM embeddings) SELECT label, pos, round(avg(v::DOUBLE), 5) AS mean FROM u GROUP BY 1, 2""")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    c = C.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("p", "m")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("m", 5).alias("mean"))


@query("""WITH t AS (SELECT * FROM embeddings WHERE label = 0), s AS (SELECT a.vec_id, t.vec_id AS o, list_dot_product(a.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS sim FROM embeddings a, t WHERE a.label <> 0),
  n AS (SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM n) WHERE rank <= 19),
  m AS (SELECT id, count(*) AS c FROM k JOIN t ON t.vec_id = k.other GROUP BY id)
  SELECT s.vec_id, round(count(*) FILTER (sim >= 0.1)::DOUBLE / count(*), 5) AS ratio, coalesce(any_value(m.c), 0) AS matches, (count(*) FILTER (sim >= 0.1)::DOUBLE / count(*) > 0.4 AND coalesce(any_value(m.c), 0) >= 5) OR (count(*) FILTER (sim >= 0.1)::DOUBLE / count(*) > 0.3 AND coalesce(any_value(m.c), 0) >= 8) AS recalled
  FROM s LEFT JOIN m ON m.id = s.vec_id GROUP BY s.vec_id""")
def recall_ratio(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    r = C.recall_ratio(v, "vec_id", "embedding", v.where("label = 0").select("vec_id"), C.knn(v, "vec_id", "embedding", 19), least=0.1)
    return r.select("vec_id", F.round("ratio", 5).alias("ratio"), "matches", "recalled")


_WHOLE = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings"


@query(f"SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INT) AS class, round(exp(list_max(x)) / list_sum(list_transform(x, lambda v: exp(v))), 5) AS confidence FROM ({_WHOLE})")
def argmax_class(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", x.alias("x")).select("vec_id", V.argmax(F.col("x")).alias("class"), F.round(F.array_max(V.softmax(F.col("x"))), 5).alias("confidence"))


@query(f"""WITH s AS ({_WHOLE}), u AS (SELECT vec_id, generate_subscripts(x, 1) - 1 AS place, unnest(x) AS v FROM s)
  SELECT vec_id, CAST(place AS INT) AS place, round(v, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, place) AS r FROM u) WHERE r <= 2""")
def top_two(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.explode(V.top_k(x, 2)).alias("t")).select("vec_id", F.col("t.place").cast("int").alias("place"), F.round("t.score", 5).alias("score"))


@query(f"""WITH {_HYP} SELECT stream_id, idx, CASE WHEN len(tokens) = 0 THEN '' WHEN len(list_filter(tokens, lambda t: NOT regexp_matches(t, '^[a-zA-Z'' ]+$'))) = 0 THEN 'en' WHEN len(list_filter(tokens, lambda t: NOT regexp_matches(t, '^[一-龥0-9]+$'))) = 0 THEN 'cn' ELSE 'mixed' END AS lang FROM a WHERE tokens IS NOT NULL""")
def lang_class(spark: SparkSession, d: str) -> DataFrame:
    return hyp_a(spark, d).where("tokens is not null").select("stream_id", "idx", T.language(F.col("tokens")).alias("lang"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, asr_dec_raw_tokens AS t FROM hyp_a WHERE asr_dec_raw_tokens IS NOT NULL), u AS (SELECT stream_id, unnest(t) AS w FROM a)
  SELECT stream_id, round(avg(CASE WHEN regexp_matches(w, '^[a-zA-Z'']+$') THEN 1.0 ELSE 0.0 END), 5) AS english_share, avg(CASE WHEN regexp_matches(w, '^[a-zA-Z'']+$') THEN 1.0 ELSE 0.0 END) >= 0.1 AS is_english FROM u GROUP BY 1""")
def english_class(spark: SparkSession, d: str) -> DataFrame:
    u = hyp_a(spark, d).select("stream_id", F.explode("tokens").alias("w"))
    return T.english_class(u, "stream_id", "w").select("stream_id", F.round("english_share", 5).alias("english_share"), "is_english")


@query()
def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    """In all languages; SQL's edit distance at hand counts bytes, so a test compares with brute force."""
    a = hyp_a(spark, d).select("stream_id", "idx", F.col("preds").alias("x"))
    b = table(spark, d, "hyp_b").select("stream_id", "idx", F.col("asr_sensevoice_result.preds").alias("y")).dropDuplicates(["stream_id", "idx"])
    both = a.join(b, ["stream_id", "idx"]).where("x is not null and y is not null")
    return both.select("stream_id", "idx", F.round(T.similarity(F.col("x"), F.col("y")), 5).alias("similarity"))


_NCH = "greatest(1, len(regexp_extract_all(c, '[一-龥0-9]')))"


@query(f"SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_filter(string_split(text, ' '), lambda c: c <> ''), lambda c: {_NCH})), 0) AS INT) AS chars FROM documents WHERE text IS NOT NULL")
def char_num(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.char_num(F.col("text")).alias("chars"))


@query("""WITH u AS (SELECT DISTINCT stream_id, idx, generate_subscripts(asr_dec_raw_tokens, 1) AS pos, unnest(asr_dec_raw_tokens) AS w FROM hyp_a)
  SELECT stream_id, idx, CAST(pos - 1 AS INT) AS pos, CAST(CASE WHEN regexp_matches(w, '^[a-zA-Z'']+$') THEN 1 ELSE length(w) END AS INT) AS len, regexp_matches(w, '^[a-zA-Z'']+$') AS english, regexp_matches(w, '^[一-龥0-9]') AS chinese FROM u""")
def token_kinds(spark: SparkSession, d: str) -> DataFrame:
    u = hyp_a(spark, d).select("stream_id", "idx", F.posexplode("tokens").alias("pos", "w"))
    return u.select("stream_id", "idx", "pos", T.text_len(F.col("w")).alias("len"), T.is_english(F.col("w")).alias("english"), T.is_chinese(F.col("w")).alias("chinese"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[!-~]+|[^\\x00-\\x7F\\s]')) AS INT) AS tokens, regexp_extract_all(text, '[!-~]+|[^\\x00-\\x7F\\s]')[1] AS first_token FROM documents WHERE text IS NOT NULL""")
def mix_split(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t).alias("tokens"), F.get(t, F.lit(0)).alias("first_token"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, asr_dec_raw_tokens AS t FROM hyp_a WHERE asr_dec_raw_tokens IS NOT NULL)
  SELECT stream_id, idx, CAST(i AS INT) AS piece, array_to_string(t[i * 20 + 1 : i * 20 + 20], ' ') AS words FROM a, range(0, 2000) r(i) WHERE i * 20 < len(t)""")
def mini_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = hyp_a(spark, d).where("tokens is not null").select("stream_id", "idx", F.posexplode(T.chunks(F.col("tokens"), 20)).alias("piece", "w"))
    return c.select("stream_id", "idx", "piece", F.array_join("w", " ").alias("words"))


_hits = lambda ps: " + ".join(f"CAST(regexp_matches(word, '^(?:{p})') AS INT)" for p in ps)


@query(f"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}'))) AS word FROM documents)
  SELECT word, CAST(greatest(1, len(regexp_extract_all(word, '[aeiouy]+')) - ({_hits(T.SYLLABLE_LESS)}) + ({_hits(T.SYLLABLE_MORE)})) AS INT) AS syllables FROM w""")
def syllables(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return w.select("word", T.syllables(F.col("word")).alias("syllables"))


@query()
def doubled_chars(spark: SparkSession, d: str) -> DataFrame:
    return hyp_a(spark, d).select("stream_id", "idx", T.doubled(F.col("preds")).alias("doubled")).where(F.size("doubled") > 0)


@query()
def joined_tokens(spark: SparkSession, d: str) -> DataFrame:
    return hyp_a(spark, d).where("tokens is not null").select("stream_id", "idx", T.joined(F.col("tokens")).alias("x")).select("stream_id", "idx", "x.line", "x.english")


@query("""WITH u AS (SELECT DISTINCT stream_id, idx, generate_subscripts(asr_dec_stamp, 1) AS pos, unnest(asr_dec_stamp) AS s FROM hyp_a) SELECT stream_id, idx, CAST(pos - 1 AS INT) AS pos, s.b AS b, least(s.e, s.b + 500) AS e FROM u""")
def stamp_cap(spark: SparkSession, d: str) -> DataFrame:
    u = hyp_a(spark, d).select("stream_id", "idx", F.posexplode(I.capped_stamps(F.col("stamps"), F.lit(500))).alias("pos", "s"))
    return u.select("stream_id", "idx", "pos", "s.b", "s.e")


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, asr_dec_raw_tokens AS t FROM hyp_a WHERE asr_dec_raw_tokens IS NOT NULL)
  SELECT stream_id, idx FROM a WHERE len(t) = 0 OR len(list_filter(t, lambda w: NOT list_contains(['哇','呀','呢','嗯','啊','吧','啦','哦','嘿','哟','嘛','哈','呵','喂','了','呗','诶','哎','噢','幺','呃','哼','呦','吗'], w))) = 0
    OR (len(t) = 1 AND length(t[1]) = 1 AND NOT list_contains(['谁','好','对','来','你','坐','停','看','一','二','三','四','五','六','七','八','九','十'], t[1]))""")
def trivial_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return hyp_a(spark, d).where("tokens is not null").where(T.trivial(F.col("tokens"))).select("stream_id", "idx")


@query("""SELECT doc_id, replace(replace(translate(text, '。，：；？！（）《》【】「」『』｛｝‘’“”～－／｜', '.,:;?!()<>[]""''''{}''''""~-/|'), '——', '--'), '……', '...') AS text FROM documents WHERE text IS NOT NULL""")
def ascii_marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.ascii_marks(F.col("text")).alias("text"))


@query("""WITH k AS (SELECT stream_id, idx, begin_ms, min(ingest_ts) AS first FROM hyp_a GROUP BY 1, 2, 3), s AS (SELECT DISTINCT stream_id, seg_id FROM segment)
  SELECT k.stream_id, count(*) AS utterances, count(s.seg_id) AS voiced FROM k LEFT JOIN s ON k.stream_id = s.stream_id AND k.idx = s.seg_id GROUP BY 1""")
def gathered(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "hyp_a").select("stream_id", "idx").distinct()
    s = table(spark, d, "segment").select("stream_id", F.col("seg_id").alias("idx"), F.lit(1).alias("one")).distinct()
    return k.join(s, ["stream_id", "idx"], "left").groupBy("stream_id").agg(F.count("*").alias("utterances"), F.count("one").alias("voiced"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, begin_ms, asr_dec_raw_tokens AS t FROM hyp_a), u AS (SELECT stream_id, idx, begin_ms, generate_subscripts(t, 1) AS p, unnest(t) AS token FROM a)
  SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY begin_ms, idx, p) AS pos, token FROM u""")
def token_table(spark: SparkSession, d: str) -> DataFrame:
    u = hyp_a(spark, d).select("stream_id", "idx", "begin_ms", F.posexplode("tokens").alias("p", "token"))
    return running(u, "stream_id", ["begin_ms", "idx", "p"], pos=("sum", F.lit(1))).select("stream_id", F.col("pos").cast("long").alias("pos"), "token")


@query("SELECT user_id, epoch_us(ts) // 6000000 * 6000 AS at, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.window("t", "6 seconds").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_millis("w.start").alias("at"), "n")


@query("""WITH s AS (SELECT DISTINCT stream_id, idx, audio_db FROM vad_segment WHERE idx IS NOT NULL), a AS (SELECT DISTINCT stream_id, idx FROM hyp_a), v AS (SELECT DISTINCT stream_id, seg_id AS idx FROM segment)
  SELECT stream_id, idx, CASE WHEN a.idx IS NULL THEN -1 ELSE 1 END AS heard, CASE WHEN v.idx IS NULL THEN -1 ELSE 1 END AS voiced FROM s LEFT JOIN a USING (stream_id, idx) LEFT JOIN v USING (stream_id, idx)""")
def parent_child(spark: SparkSession, d: str) -> DataFrame:
    """Sub-results regrouped under every parent, -1 where an operator wasn't run."""
    s = table(spark, d, "vad_segment").where("idx is not null").select("stream_id", "idx").distinct()
    a = table(spark, d, "hyp_a").select("stream_id", "idx", F.lit(1).alias("heard")).distinct()
    v = table(spark, d, "segment").select("stream_id", F.col("seg_id").alias("idx"), F.lit(1).alias("voiced")).distinct()
    return s.join(a, ["stream_id", "idx"], "left").join(v, ["stream_id", "idx"], "left").fillna(-1, ["heard", "voiced"])


@query("""SELECT stream_id, idx FROM (SELECT DISTINCT stream_id, idx FROM hyp_a INTERSECT SELECT DISTINCT stream_id, idx FROM hyp_b WHERE asr_sensevoice_result IS NOT NULL) EXCEPT SELECT stream_id, seg_id FROM segment""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "hyp_a").select("stream_id", "idx")
    b = table(spark, d, "hyp_b").where("asr_sensevoice_result is not null").select("stream_id", "idx")
    s = table(spark, d, "segment").select("stream_id", F.col("seg_id").alias("idx"))
    return a.join(b, ["stream_id", "idx"], "left_semi").distinct().join(s, ["stream_id", "idx"], "left_anti")


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, asr_dec_raw_tokens AS t, asr_dec_stamp AS s FROM hyp_a WHERE asr_dec_raw_tokens IS NOT NULL AND asr_dec_stamp IS NOT NULL),
  u AS (SELECT stream_id, idx, i AS pos, s[i].b AS b, t[i - 1] AS before, s[i - 1].e AS e FROM a, range(2, 3000) r(i) WHERE i <= least(len(t), len(s)))
  SELECT stream_id, idx, CAST(pos - 2 AS INT) AS pos FROM u WHERE b - e >= 300 UNION SELECT stream_id, idx, CAST(pos - 2 AS INT) FROM u WHERE before IN ('，', ',', '、')""")
def break_positions(spark: SparkSession, d: str) -> DataFrame:
    """Places with a pause or a comma behind them, each once."""
    z = hyp_a(spark, d).where("tokens is not null and stamps is not null").select("stream_id", "idx", F.expr("slice(tokens, 1, least(size(tokens), size(stamps)))").alias("t"), F.expr("slice(stamps, 1, least(size(tokens), size(stamps)))").alias("s"))
    at = F.sequence(F.lit(2), F.size("t"))
    u = z.where(F.size("t") > 1).select("stream_id", "idx", "t", "s", F.explode(at).alias("p"))
    u = u.select("stream_id", "idx", (F.col("p") - 2).alias("pos"), (F.element_at("s", F.col("p"))["b"] - F.element_at("s", F.col("p") - 1)["e"]).alias("gap"), F.element_at("t", F.col("p") - 1).alias("before"))
    return u.where("gap >= 300").select("stream_id", "idx", "pos").union(u.where(F.col("before").isin("，", ",", "、")).select("stream_id", "idx", "pos")).distinct()


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents)
  SELECT word, array_to_string(regexp_extract_all(word, '\\d+|[a-zA-Z]+'), ' ') AS parts, array_to_string(list_transform(range(0, (length(word) + 3) // 4), lambda i: substr(word, CAST(i * 4 + 1 AS BIGINT), 4)), ' ') AS pieces FROM w""")
def word_parts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", F.array_join(T.split_digits(F.col("word")), " ").alias("parts"), F.array_join(T.capped_words(F.col("word")), " ").alias("pieces"))


@query("""SELECT doc_id, translate(text, ',.?', '，。？') AS marks, CASE WHEN s > r THEN true WHEN r > s THEN false END AS simplified
  FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[里门读图国学说们]')) AS s, len(regexp_extract_all(text, '[裡門讀圖國學說們]')) AS r FROM documents WHERE text IS NOT NULL) WHERE s <> r""")
def script_class(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", T.full_marks(F.col("text")).alias("marks"), T.is_simplified(F.col("text"), "里门读图国学说们", "裡門讀圖國學說們").alias("simplified")).where("simplified is not null")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE)) AS x, list_transform(embedding[33:64], lambda v: CAST(v AS DOUBLE)) AS y FROM embeddings)
  SELECT vec_id, round(0.5 * (1 + list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))), 5) AS affinity, round(x[1] / sqrt(list_dot_product(x, x)), 5) AS first, round(list_sum(list_transform(range(1, 33), lambda i: (x[i] + 0.5) * y[i])), 5) AS scaled FROM x""")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    part = lambda a: F.transform(F.slice("embedding", a, 32), lambda v: v.cast("double"))
    x = table(spark, d, "embeddings").select("vec_id", part(1).alias("x"), part(33).alias("y"))
    half = F.array_repeat(F.lit(0.5), 32)
    scaled = F.aggregate(V.normalised(F.col("x"), half, F.col("y")), F.lit(0.0), lambda s, v: s + v)
    return x.select("vec_id", F.round(V.affinity(F.col("x"), F.col("y")), 5).alias("affinity"), F.round(V.unit(F.col("x"))[0], 5).alias("first"), F.round(scaled, 5).alias("scaled"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, asr_dec_raw_tokens AS t FROM hyp_a WHERE asr_dec_raw_tokens IS NOT NULL)
  SELECT stream_id, idx, CAST(len(t) AS INT) AS n, CAST(CASE WHEN len(t) <= 1 THEN 1 ELSE pow(2, ceil(log2(len(t)))) END AS BIGINT) AS padded, greatest(0, 64 - len(t))::INT AS pads FROM a""")
def batch_padding(spark: SparkSession, d: str) -> DataFrame:
    h = hyp_a(spark, d).where("tokens is not null")
    n = F.size("tokens")
    return h.select("stream_id", "idx", n.alias("n"), V.next_power(n).cast("long").alias("padded"), (F.size(V.padded(F.col("tokens"), F.lit(64), "")) - n).alias("pads"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, asr_dec_preds AS p FROM hyp_a) SELECT stream_id, idx, regexp_replace(regexp_replace(p, '([a-zA-Z])''([a-zA-Z])', '\\1ʼ\\2', 'g'), '([a-zA-Z])''([a-zA-Z])', '\\1ʼ\\2', 'g') AS protected FROM a WHERE p LIKE '%''%'""")
def apostrophes(spark: SparkSession, d: str) -> DataFrame:
    h = hyp_a(spark, d).where(F.contains("preds", F.lit("'")))
    return h.select("stream_id", "idx", T.protected_apostrophes(F.col("preds")).alias("protected"))


@query("""WITH a AS (SELECT DISTINCT stream_id, idx, begin_ms, asr_dec_preds AS p FROM hyp_a), b AS (SELECT *, lag(p) OVER (PARTITION BY stream_id ORDER BY begin_ms, idx) AS q FROM a)
  SELECT stream_id, idx, CASE WHEN (q IS NULL OR regexp_matches(q, '[.。?？!！][ \t\n]*$')) AND regexp_matches(p, '^[a-z]') THEN upper(substr(p, 1, 1)) || substr(p, 2) ELSE p END AS line FROM b""")
def capitals(spark: SparkSession, d: str) -> DataFrame:
    h = hyp_a(spark, d).select("stream_id", "idx", "begin_ms", F.col("preds").alias("line"))
    return T.capitalised(h, "stream_id", ["begin_ms", "idx"], "line").select("stream_id", "idx", "line")


@query("""SELECT task_id, CAST(userdata['idx'] AS INT) AS idx, CAST(userdata['begin_ms'] AS BIGINT) AS begin_ms, finished_ts IS NULL AS open FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ingest_ts) AS r FROM task) WHERE r = 1 AND userdata['idx'] IS NOT NULL""")
def task_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of each task, read from its map once."""
    t = table(spark, d, "task").dropDuplicates(["task_id"]).where("userdata['idx'] is not null")
    return t.select("task_id", F.col("userdata")["idx"].cast("int").alias("idx"), F.col("userdata")["begin_ms"].cast("long").alias("begin_ms"), F.col("finished_ts").isNull().alias("open"))


from lecterna import catalog_more as _more, catalog_rows as _rows  # noqa: E402, F401 - register more queries
