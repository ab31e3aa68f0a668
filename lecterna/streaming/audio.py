"""Audio streams: samples buffered by recording, activity found as they come, late
chunks counted, segments told when they open and when they close; marks for token streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lecterna.functions.signal import RATE, ActivityDetector, decibel, framed
from lecterna.operators.decode import punctuated

HEARD = "stream_id long, begin_ms long, end_ms long, late long, samples long"


class PcmBuffer:
    """Samples of one recording in order: ``append`` gives whole pieces of
    ``seconds`` as they fill, ``flush`` the rest filled up with silence, ``evict``
    forgets what lies before a time. Positions are kept in samples since the start."""

    def __init__(self, seconds: float = 6.0, rate: int = RATE) -> None:
        self.piece, self.rate = int(seconds * rate), rate
        self.samples, self.start, self.fed = np.zeros(0, np.float32), 0, 0

    def append(self, x: np.ndarray) -> list[np.ndarray]:
        self.samples = np.concatenate([self.samples, np.asarray(x, np.float32)])
        out = []
        while self.fed + self.piece <= self.start + len(self.samples):
            at = self.fed - self.start
            out.append(self.samples[at : at + self.piece])
            self.fed += self.piece
        return out

    def flush(self) -> np.ndarray | None:
        rest = self.samples[self.fed - self.start :]
        self.fed += len(rest)
        return np.pad(rest, (0, self.piece - len(rest))) if len(rest) else None

    def cut(self, begin_ms: int, end_ms: int) -> np.ndarray:
        """The samples of a span that is still held."""
        a, b = (max(0, int(ms * self.rate / 1000) - self.start) for ms in (begin_ms, end_ms))
        return self.samples[a:b]

    def evict(self, before_ms: int) -> None:
        at = min(int(before_ms * self.rate / 1000), self.fed)
        if at > self.start:
            self.samples, self.start = self.samples[at - self.start :], at


def energy_silence(frames: np.ndarray, quiet: float = 0.01) -> np.ndarray:
    """A scorer of silence by loudness, for use without a model."""
    return np.where(np.abs(frames).max(1) < quiet, 0.95, 0.05)


class Listener:
    """One recording: buffer, detector and what was said about open segments.
    ``feed`` gives (begin_ms, end_ms) rows: -1 as end when a segment opens, -1 as
    begin when it closes after that, both at once if it does both in one step."""

    def __init__(self, score: Callable[[np.ndarray], np.ndarray] = energy_silence, **how: object) -> None:
        self.score, self.buffer, self.detector, self.told = score, PcmBuffer(), ActivityDetector(**how), False
        self.tail = np.zeros(0, np.float32)

    def feed(self, x: np.ndarray, *, last: bool = False) -> list[tuple[int, int]]:
        out = []
        pieces = self.buffer.append(x)
        if last and (rest := self.buffer.flush()) is not None:
            pieces.append(rest)
        for piece in pieces:
            samples = np.concatenate([self.tail, piece])
            f = framed(samples, 400, 160)
            self.tail = samples[len(f) * 160 :]
            for p, db in zip(self.score(f), decibel(f)):
                out += self._told(self.detector.push(float(p), float(db)))
        if last:
            out += self._told(self.detector.finish())
        return out

    def _told(self, closed: tuple[int, int] | None) -> list[tuple[int, int]]:
        if closed:
            row = [(-1, closed[1])] if self.told else [closed]
            self.told = False
            self.buffer.evict(closed[1])
            return row
        if self.detector.open and not self.told:
            self.told = True
            return [(self.detector.start * 10, -1)]
        return []

    def state(self) -> dict:
        b = self.buffer
        return {"d": self.detector.state(), "told": self.told, "tail": self.tail.tolist(), "samples": b.samples.tolist(), "start": b.start, "fed": b.fed}

    def restore(self, s: dict) -> Listener:
        self.detector.restore(s["d"])
        self.told, self.tail = s["told"], np.array(s["tail"], np.float32)
        self.buffer.samples, self.buffer.start, self.buffer.fed = np.array(s["samples"], np.float32), s["start"], s["fed"]
        return self


class ListenProcessor(StatefulProcessor):
    """Chunks (stream_id, chunk_id, samples, last) of many recordings. Chunks wait
    for those before them; one whose turn has passed is dropped and counted as late."""

    def __init__(self, score: Callable[[np.ndarray], np.ndarray] = energy_silence, **how: object) -> None:
        self.score, self.how = score, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("listener", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = json.loads(self.state.get()[0]) if self.state.exists() else {"next": 0, "wait": {}}
        listener = Listener(self.score, **self.how)
        if "l" in kept:
            listener.restore(kept["l"])
        nxt, wait, late, heard = kept["next"], kept["wait"], 0, 0
        for g in rows:
            for c, x, end in zip(g["chunk_id"], g["samples"], g["last"]):
                if int(c) < nxt or str(int(c)) in wait:
                    late += 1
                else:
                    wait[str(int(c))] = [[float(v) for v in x], bool(end)]
        out, ended = [], False
        while not ended and str(nxt) in wait:
            x, ended = wait.pop(str(nxt))
            nxt += 1
            heard += len(x)
            out += listener.feed(np.array(x, np.float32), last=ended)
        if ended:
            self.state.clear()
        else:
            self.state.update((json.dumps({"l": listener.state(), "next": nxt, "wait": wait}),))
        n = max(1, len(out)) if late or heard else len(out)
        rows_out = [(key[0], b, e) for b, e in out] or [(key[0], None, None)] * n
        yield pd.DataFrame([(*r, late if i == 0 else 0, heard if i == 0 else 0) for i, r in enumerate(rows_out)], columns=["stream_id", "begin_ms", "end_ms", "late", "samples"])

    def close(self) -> None:
        pass


def listen(chunks: DataFrame, score: Callable[[np.ndarray], np.ndarray] = energy_silence, **how: object) -> DataFrame:
    """Rows of opened and closed segments of streaming ``chunks``, with the late
    chunks and samples of each step on its first row (progress)."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(ListenProcessor(score, **how), HEARD, outputMode="update", timeMode="none")


class PunctuationProcessor(StatefulProcessor):
    """Marks for token streams (stream_id, pos, token, last), in order of pos; what
    waits for more context is kept with its stream."""

    def __init__(self, score: Callable[[list[str]], list[int]], chunk: int = 20, trigger: int = 200) -> None:
        self.score, self.chunk, self.trigger = score, chunk, trigger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tokens", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = json.loads(self.state.get()[0]) if self.state.exists() else {"carry": [], "at": 0}
        g = pd.concat(list(rows)).sort_values("pos")
        final = bool(g["last"].any())
        tokens = [t for t in g["token"] if isinstance(t, str)]
        marks, carry = punctuated(tokens, self.score, chunk=self.chunk, trigger=self.trigger, carry=kept["carry"], final=final)
        done = (kept["carry"] + tokens)[: len(marks)]
        if final:
            self.state.clear()
        else:
            self.state.update((json.dumps({"carry": carry, "at": kept["at"] + len(marks)}),))
        yield pd.DataFrame({"stream_id": key[0], "pos": np.arange(kept["at"], kept["at"] + len(marks)), "token": done, "mark": marks})

    def close(self) -> None:
        pass


def punctuate_stream(tokens: DataFrame, score: Callable[[list[str]], list[int]], **how: int) -> DataFrame:
    return tokens.groupBy("stream_id").transformWithStateInPandas(PunctuationProcessor(score, **how), "stream_id long, pos long, token string, mark int", outputMode="append", timeMode="none")


def transcribed(listener: Listener, chunks: Iterator[np.ndarray], recognise: Callable[[np.ndarray], str]) -> Iterator[tuple[int, int, str]]:
    """(begin_ms, end_ms, text) of each segment as the chunks of one recording come."""
    held = PcmBuffer()
    begin = None
    last: np.ndarray | None = None

    def step(x: np.ndarray, end: bool) -> Iterator[tuple[int, int, str]]:
        nonlocal begin
        held.samples = np.concatenate([held.samples, x.astype(np.float32)])
        for b, e in listener.feed(x, last=end):
            begin = b if b >= 0 else begin
            if e >= 0:
                yield begin, e, recognise(held.cut(begin, e))
                held.fed = int(e * held.rate / 1000)
                held.evict(e)

    for x in chunks:
        if last is not None:
            yield from step(last, False)
        last = x
    if last is not None:
        yield from step(last, True)
