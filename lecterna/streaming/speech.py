"""Speech streams: late and repeated chunks, activity detection, merging."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lecterna.functions.signal import ActivityDetector

SEGMENTS = "stream_id long, begin_ms long, end_ms long"


def deduplicated(chunks: DataFrame, time: str = "at", *, keys: tuple[str, ...] = ("stream_id", "chunk_id"), delay: str = "1 hour") -> DataFrame:
    """Chunks delivered more than once within ``delay`` count once; later ones are dropped as late."""
    return chunks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def detected(frames: pd.DataFrame, detector: ActivityDetector, *, final: bool = False) -> list[tuple[int, int]]:
    """Segments that frames (silence, db), in order, close."""
    out = [s for p, d in zip(frames["silence"], frames["db"]) if (s := detector.push(float(p), float(d)))]
    if final and (s := detector.finish()):
        out.append(s)
    return out


def detect(frames: DataFrame, **how: object) -> DataFrame:
    """Batch form: (stream_id, begin_ms, end_ms) of (stream_id, frame, silence, db)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        got = detected(g.sort_values("frame"), ActivityDetector(**how), final=True)
        return pd.DataFrame([(g["stream_id"].iloc[0], b, e) for b, e in got], columns=["stream_id", "begin_ms", "end_ms"])

    return frames.groupBy("stream_id").applyInPandas(run, SEGMENTS)


class ActivityProcessor(StatefulProcessor):
    """Streaming form: the same detector, its state and frames that came before
    their turn kept for each stream. A row with a null score ends its stream."""

    def __init__(self, **how: object) -> None:
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detector", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = json.loads(self.state.get()[0]) if self.state.exists() else None
        detector = ActivityDetector(**self.how)
        waiting: dict[int, list] = {}
        if kept:
            detector.restore(kept["d"])
            waiting = {int(k): v for k, v in kept["w"].items()}
        for g in rows:
            for f, s, d in zip(g["frame"], g["silence"], g["db"]):
                if int(f) >= detector.frame:
                    waiting[int(f)] = [None if pd.isna(s) else float(s), None if pd.isna(d) else float(d)]
        out, ended = [], False
        while detector.frame in waiting:
            s, d = waiting.pop(detector.frame)
            if s is None:
                ended = True
                if x := detector.finish():
                    out.append(x)
                break
            if x := detector.push(s, d or 0.0):
                out.append(x)
        if ended:
            self.state.clear()
        else:
            self.state.update((json.dumps({"d": detector.state(), "w": waiting}),))
        yield pd.DataFrame([(key[0], b, e) for b, e in out], columns=["stream_id", "begin_ms", "end_ms"])

    def close(self) -> None:
        pass


def detect_stream(frames: DataFrame, **how: object) -> DataFrame:
    """Streaming form of ``detect``."""
    return frames.groupBy("stream_id").transformWithStateInPandas(ActivityProcessor(**how), SEGMENTS, outputMode="append", timeMode="none")


class MergeProcessor(StatefulProcessor):
    """Segments merged greedily as they come, up to a cap and a gap; a row with a null end flushes."""

    def __init__(self, cap: int = 15_000, gap: int = 1200) -> None:
        self.cap, self.gap = cap, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "begin_ms long, end_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for b, e in sorted((x for g in rows for x in zip(g["begin_ms"], g["end_ms"])), key=lambda x: (pd.isna(x[0]) or pd.isna(x[1]), x)):
            if pd.isna(e):
                if head:
                    out.append(head)
                head = None
            elif head and b - head[1] <= self.gap and e - head[0] < self.cap:
                head = (head[0], int(e))
            else:
                if head:
                    out.append(head)
                head = (int(b), int(e))
        if head:
            self.open.update(head)
        else:
            self.open.clear()
        yield pd.DataFrame([(key[0], b, e) for b, e in out], columns=["stream_id", "begin_ms", "end_ms"])

    def close(self) -> None:
        pass


def merge_stream(segments: DataFrame, cap: int = 15_000, gap: int = 1200) -> DataFrame:
    return segments.groupBy("stream_id").transformWithStateInPandas(MergeProcessor(cap, gap), SEGMENTS, outputMode="append", timeMode="none")


def windowed(events: DataFrame, time: str, *, size: str = "6 seconds", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts of streams by windows of event time, with late data up to ``delay``."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return t.groupBy("stream_id", F.window(time, size, slide) if slide else F.window(time, size)).count()


def frames_of(samples: np.ndarray, score, *, hop: int = 160, size: int = 400) -> pd.DataFrame:  # noqa: ANN001
    """(frame, silence, db) of audio, with a scorer of silence for each frame."""
    from lecterna.functions.signal import decibel, framed

    f = framed(np.asarray(samples, float), size, hop)
    return pd.DataFrame({"frame": np.arange(len(f)), "silence": score(f), "db": decibel(f)})
