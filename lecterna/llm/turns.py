"""Speech transcripts into speaker turns by a semi-Markov conditional model.

A turn is one segment of the model: a whole run of utterances with one
speaker, within a stretch without a silence of 30 s. Its score sums what voice and
label say of its utterances, and for every place in it and its end the log
probability of going on or of changing the speaker, given the pause, whether the
text was left open, and whether the segment holds one utterance or more. These
probabilities are learnt from neighbouring utterances whose speakers are known.
Voice and label decide by the definition of a turn, so their weights are above all
others: an utterance that has one can only be of that speaker, and the model decides
those that have neither. The best segmentation of a stretch is decoded exactly.

Scale: utterances are range-partitioned by (stream, time), so that one endless
recording is spread over many tasks. Between two utterances with known speakers
the state of the decoder is known, so a task decodes all between the first and the
last such place of its rows; what lies outside goes to a second step that puts the
end of a partition and the beginning of the next together. The result doesn't depend
on the partitions. At last the outer segments, a few rows a task, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lecterna.llm import speech
from lecterna.llm.voices import voices
from lecterna.plans.lineage import written

#: A pause of so many ms ends every turn.
PAUSE_MS = 30_000
#: Pauses are told apart by steps of this many ms, up to ``BINS`` of them.
STEP_MS, BINS = 500, 12

_MARKED = "stream_id long, idx int, begin_ms long, end_ms long, label string, open boolean, body string"


def marked(hyp: DataFrame, *, text: bool = False) -> DataFrame:
    """The utterances of ``hyp`` that hold something spoken: (stream_id, idx,
    begin_ms, end_ms, label, open, body). ``end_ms`` is begin_ms plus the latest
    stamp, ``label`` the written speaker label in its one spelling, ``open``
    tells that the text doesn't end a statement, ``body`` its spoken words if
    ``text``. Null texts, bare marks and bare hesitations give no row; null or
    broken stamps (null, -1, out of order) count as none."""
    last = F.greatest(F.array_max(F.col("asr_dec_stamp.e")), F.array_max(F.col("asr_dec_stamp.b")), F.lit(0))
    rows = hyp.where("asr_dec_preds <> '' and stream_id is not null and idx is not null").select(
        F.col("stream_id").cast("long").alias("stream_id"), F.col("idx").cast("int").alias("idx"), F.col("begin_ms").cast("long").alias("begin_ms"), (F.col("begin_ms") + F.coalesce(last, F.lit(0))).cast("long").alias("end_ms"), "asr_dec_preds"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(4).to_pylist()
            got = [speech.parsed(t) for t in texts]
            keep = pa.array([g[0] for g in got])
            cols = [b.column(i) for i in range(4)]
            label = pa.array([g[1] for g in got], pa.string())
            ends = pa.array([bool(t) and t.rstrip()[-1:] not in "。.!?！？｡।؟”\"」" for t in texts])
            body = pa.array([speech.cleaned(t) if text and g[0] else None for t, g in zip(texts, got)], pa.string())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*cols, label, ends, body)], names=[x.split()[0] for x in _MARKED.split(", ")])

    return rows.mapInArrow(run, _MARKED)


class SemiMarkov:
    """The decoder. ``change``[d, bin, open] is the log probability that the
    speaker changes after a segment of d + 1 utterances (2: two or more) at a
    pause of that bin after a text that was left open or not; ``stay`` its complement."""

    def __init__(self, counts: dict[tuple[int, int, int, int], int] | None = None) -> None:
        """``counts`` of (d, bin, open, changed) among known neighbours; each cell
        is drawn to the rate of its bin, and that to the rate of all."""
        c = np.zeros((2, BINS + 1, 2, 2))
        for (d, b, o, x), n in (counts or {}).items():
            c[d, b, o, x] += n
        p = (c[..., 1].sum() + 1) / (c.sum() + 2)
        by_bin = (c[..., 1].sum((0, 2)) + p) / (c.sum((0, 2, 3)) + 1)
        p = (c[..., 1] + 2 * by_bin[None, :, None]) / (c.sum(3) + 2)
        self.change, self.stay = np.log(p), np.log1p(-p)

    @staticmethod
    def stretches(hard: np.ndarray) -> list[tuple[int, int]]:
        at = np.nonzero(hard)[0]
        return list(zip(at.tolist(), [*at[1:].tolist(), len(hard)]))

    def segment(self, known: np.ndarray, gap: np.ndarray, opened: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """The speaker of each utterance. ``known``: the speaker that voice or
        label settles, else -1; ``gap`` is the silence before it in ms, ``opened``
        whether the text before it was left open, ``hard`` where a stretch begins.
        Without any known speaker a stretch is of speaker -1."""
        out = known.copy()
        if not (known == -1).any():
            return out
        for a, b in self.stretches(hard):
            k = known[a:b]
            there = np.nonzero(k != -1)[0]
            if len(there) in (0, b - a):
                continue
            # the nearest known speakers on both sides; a third one would only add changes
            nth = np.searchsorted(there, np.arange(b - a), "right")
            left = np.where(nth > 0, k[there[np.maximum(nth - 1, 0)]], -1)
            nth = np.searchsorted(there, np.arange(b - a), "left")
            right = np.where(nth < len(there), k[there[np.minimum(nth, len(there) - 1)]], -1)
            left, right = np.where(left == -1, right, left), np.where(right == -1, left, right)
            out[a:b] = self._best(left, right, gap[a:b], opened[a:b]) if (left != right).any() else left
        return out

    def _best(self, left: np.ndarray, right: np.ndarray, gap: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """The best path; a state is a candidate and whether its segment holds one
        utterance or more. Of equal paths the one that changes later wins."""
        bins = np.clip(gap // STEP_MS, 0, BINS).astype(int)
        states = [{(int(s), 0): (0.0, None) for s in {int(left[0]), int(right[0])}}]
        for u in range(1, len(left)):
            o, b = int(opened[u]), bins[u]
            now: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {}
            for to in dict.fromkeys((int(left[u]), int(right[u]))):
                for (who, d), (score, _) in states[-1].items():
                    state = (to, 1) if who == to else (to, 0)
                    v = score + (self.stay if who == to else self.change)[d, b, o]
                    if state not in now or v > now[state][0]:
                        now[state] = (v, (who, d))
            states.append(now)
        at = max(states[-1], key=lambda z: states[-1][z][0])
        out = np.empty(len(left), np.int64)
        for u in range(len(left) - 1, -1, -1):
            out[u] = at[0]
            at = states[u][at][1]
        return out


def _learnt(said: DataFrame) -> SemiMarkov:
    """The model of ``said`` (stream_id, idx, begin_ms, end_ms, open, who), from
    utterances of neighbouring idx whose speakers are known."""
    known = said.where("who <> -1").select("stream_id", "idx", "begin_ms", "end_ms", "open", "who")
    nxt = known.select("stream_id", (F.col("idx") - 1).alias("idx"), F.col("begin_ms").alias("b"), F.col("who").alias("w"))
    pair = known.join(nxt, ["stream_id", "idx"]).withColumn("gap", F.col("b") - F.col("end_ms")).where(F.col("gap") < PAUSE_MS)
    pair = pair.select("stream_id", "idx", F.least(F.greatest(F.floor(F.col("gap") / STEP_MS), F.lit(0)), F.lit(BINS)).cast("int").alias("bin"), F.col("open").cast("int").alias("o"), (F.col("w") != F.col("who")).cast("int").alias("x"))
    before = pair.select("stream_id", (F.col("idx") + 1).alias("idx"), (1 - F.col("x")).alias("d"))
    counts = pair.join(before, ["stream_id", "idx"]).groupBy("d", "bin", "o", "x").count().collect()
    return SemiMarkov({(r["d"], r["bin"], r["o"], r["x"]): r["count"] for r in counts})


_SEGMENT = "stream_id long, speaker long, first_idx int, last_idx int, begin_ms long, end_ms long, n long, body string, edge boolean, unit string"
_PIECE = "who long, open boolean, context boolean, part int, place int"
_IN = ["stream_id", "idx", "begin_ms", "end_ms", "who", "open", "body"]


def _segments(t: dict[str, np.ndarray], who: np.ndarray, unit: str, text: bool) -> dict[str, list]:
    """Rows in order, with their speakers, as segments."""
    stream, begin, end, idx = t["stream_id"], t["begin_ms"], t["end_ms"], t["idx"]
    n = len(stream)
    new = np.r_[True, (stream[1:] != stream[:-1]) | (begin[1:] - end[:-1] >= PAUSE_MS) | (who[1:] != who[:-1])] if n else np.zeros(0, bool)
    at = np.nonzero(new)[0]
    to = np.r_[at[1:], n]
    body = ["\n".join(x for x in t["body"][a:b] if x) for a, b in zip(at, to)] if text else [None] * len(at)
    edge = np.zeros(len(at), bool)
    edge[:1] = edge[-1:] = True
    return {"stream_id": stream[at], "speaker": who[at], "first_idx": idx[at], "last_idx": idx[to - 1], "begin_ms": begin[at], "end_ms": end[to - 1], "n": to - at, "body": body, "edge": edge, "unit": [unit] * len(at)}


_TYPES = {"stream_id": pa.int64(), "speaker": pa.int64(), "first_idx": pa.int32(), "last_idx": pa.int32(), "begin_ms": pa.int64(), "end_ms": pa.int64(), "n": pa.int64(), "body": pa.string(), "edge": pa.bool_(), "unit": pa.string(), "who": pa.int64(), "open": pa.bool_(), "context": pa.bool_(), "part": pa.int32(), "place": pa.int32()}


def _batch(cols: dict[str, object], n: int, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], _TYPES[c]) if c in cols else pa.nulls(n, _TYPES[c]) for c in names], names=names)


def _columns(t: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    return {c: np.array(t.column(c).to_pylist(), object) if c == "body" else np.asarray(t.column(c)) for c in names}


def _sides(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(silence before each row, whether the text before it was left open, where a stretch begins)."""
    same = np.r_[False, t["stream_id"][1:] == t["stream_id"][:-1]]
    gap = np.where(same, t["begin_ms"] - np.r_[0, t["end_ms"][:-1]], 1 << 60)
    return gap, np.r_[False, t["open"][:-1]] & same, ~same | (gap >= PAUSE_MS)


def _decoded(said: DataFrame, model: SemiMarkov, text: bool) -> DataFrame:
    """Segments of all rows, those at the ends of a unit of work marked."""
    names = [x.split()[0] for x in f"{_SEGMENT}, {_PIECE}".split(", ")]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = _columns(pa.Table.from_batches(got), _IN)
        n = len(t["who"])
        gap, opened, hard = _sides(t)
        fixed = t["who"] != -1
        # after a known row whose neighbour is known or that begins a stretch, the decoder's state is known
        settled = np.r_[False, fixed[1:] & (hard[1:] | fixed[:-1])]
        cut = np.r_[False, hard[1:] | settled[:-1]]
        at = np.nonzero(cut)[0]

        def piece(a: int, b: int, place: int, context: int = 0) -> pa.RecordBatch:
            cols = {c: t[c][a:b] for c in ("stream_id", "begin_ms", "end_ms", "who", "open", "body")} | {"first_idx": t["idx"][a:b], "context": np.arange(a, b) < a + context, "part": np.full(b - a, part), "place": np.full(b - a, place)}
            return _batch(cols, b - a, names)

        if not len(at):
            yield piece(0, n, 1)
            return
        a, b = int(at[0]), int(at[-1])
        back = lambda z: 0 if hard[z] else 1 if hard[z - 1] else 2
        yield piece(0, a, 0)
        yield piece(b - back(b), n, 2, back(b))
        if a < b:
            k = a - back(a)
            h = hard[k:b].copy()
            h[0] = True
            who = model.segment(t["who"][k:b], gap[k:b], opened[k:b], h)[a - k :]
            cols = _segments({c: t[c][a:b] for c in _IN}, who, f"{part}", text)
            yield _batch(cols, len(cols["n"]), names)

    rows = said.repartitionByRange("stream_id", "begin_ms", "idx").sortWithinPartitions("stream_id", "begin_ms", "idx").mapInArrow(first, f"{_SEGMENT}, {_PIECE}")
    rows = written(rows, "turns")
    inner = rows.where("place is null").select(*[x.split()[0] for x in _SEGMENT.split(", ")])
    pieces = rows.where("place is not null").select("stream_id", F.col("first_idx").alias("idx"), "begin_ms", "end_ms", "who", "open", "body", "context", "part", "place")
    # a piece joins the last end of a partition before it; a row for each partition
    ends = pieces.groupBy("part").agg(F.max(F.when(F.col("place") == 2, F.col("part"))).alias("own"))
    ends = ends.withColumn("before", F.coalesce(F.max("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    pieces = pieces.join(ends, "part").withColumn("unit", F.when(F.col("place") == 2, F.col("part")).otherwise(F.col("before")))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        unit = np.asarray(whole.column("unit"))
        cuts = np.r_[0, np.nonzero(np.diff(unit))[0] + 1, len(unit)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            t = _columns(whole.slice(lo, hi - lo), [*_IN, "context"])
            gap, opened, hard = _sides(t)
            who = model.segment(t["who"], gap, opened, hard)
            m = ~t["context"].astype(bool)
            cols = _segments({c: t[c][m] for c in _IN}, who[m], f"end {unit[lo]}", text)
            yield _batch(cols, len(cols["n"]), [x.split()[0] for x in _SEGMENT.split(", ")])

    outer = pieces.select(*_IN, "context", "unit").repartition("unit").sortWithinPartitions("unit", "stream_id", "begin_ms", "idx").mapInArrow(second, _SEGMENT)
    return inner.unionByName(outer)


def turns(hyp: DataFrame, seg: DataFrame, *, text: bool = True, least: float = 0.6, dim: int = 192) -> DataFrame:
    """(stream_id, first_idx, last_idx, speaker, begin_ms, end_ms, n, body): the
    turns of every stream in the order of begin_ms.

    The speaker of an utterance is the voice of its usable vector; without one
    the voice that most often carries its written label in the same stream (ties
    to the smaller voice), the label itself if no voice does; without label that of
    one of its known neighbours, as the model finds; -1 where its stretch has none. Utterances with nothing spoken are left
    out; repeated deliveries count once; rows without stream, idx or begin_ms
    have no place and give nothing; empty tables give an empty result.
    """
    said = marked(hyp, text=text).where("begin_ms is not null").dropDuplicates(["stream_id", "idx"])
    voice = voices(seg, "vec_id", "sv_feat", least=least, dim=dim).select(F.col("id").alias("vec_id"), "voice")
    at = seg.select("vec_id", F.col("stream_id").cast("long").alias("stream_id"), F.col("seg_id").cast("int").alias("idx")).where("vec_id is not null").dropDuplicates(["vec_id"])
    heard = at.join(voice, "vec_id").groupBy("stream_id", "idx").agg(F.min("voice").alias("voice"))
    said = written(said.join(heard, ["stream_id", "idx"], "left"), "said")

    votes = said.where("voice is not null and label is not null").groupBy("stream_id", "label", "voice").count()
    chosen = votes.groupBy("stream_id", "label").agg(F.max_by("voice", F.struct("count", -F.col("voice"))).alias("named"))
    # a label that no voice carries is a speaker of its own, below all ids
    own = -F.abs(F.xxhash64("label")) - 2
    who = F.coalesce("voice", "named", F.when(F.col("label").isNotNull(), own), F.lit(-1).cast("long"))
    said = said.join(chosen, ["stream_id", "label"], "left").withColumn("who", who)
    said = written(said.select("stream_id", "idx", "begin_ms", "end_ms", "who", F.coalesce("open", F.lit(False)).alias("open"), "body"), "speakers")
    model = SemiMarkov() if said.where("who = -1").isEmpty() else _learnt(said)
    parts = written(_decoded(said, model, text), "turns")

    return _joined_ends(parts)


def _joined_ends(parts: DataFrame) -> DataFrame:
    """Turns of the segments of ``_decoded``: of what the border of two units cut,
    a few rows a task, one turn is made."""
    order = Window.orderBy("stream_id", "begin_ms", "first_idx")
    prev = lambda c: F.lag(c).over(order)
    goes_on = (prev("stream_id") == F.col("stream_id")) & (prev("speaker") == F.col("speaker")) & (F.col("begin_ms") - prev("end_ms") < PAUSE_MS) & (prev("unit") != F.col("unit"))
    ends = parts.where("edge").withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(order))
    at = F.struct("begin_ms", "first_idx")
    one = ends.groupBy("run").agg(
        F.first("stream_id").alias("stream_id"), F.first("speaker").alias("speaker"), F.min_by("first_idx", at).alias("first_idx"), F.max_by("last_idx", at).alias("last_idx"),
        F.min("begin_ms").alias("start_ms"), F.max_by("end_ms", at).alias("end_ms"), F.sum("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin_ms", "first_idx", "body"))), lambda x: x["body"]), "\n").alias("body"),
    ).withColumnRenamed("start_ms", "begin_ms")
    cols = ["stream_id", "first_idx", "last_idx", "speaker", "begin_ms", "end_ms", "n", "body"]
    return parts.where("not edge").select(*cols).unionByName(one.select(*cols))
