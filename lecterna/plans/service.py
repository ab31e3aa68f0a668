"""Tasks posted one by one and run in batches, for callers that don't bring a table.

The service holds what a pipe of threads would: a bounded queue with a lane for
urgent tasks, a check of the asked bits, results in the order of completion, a
future for each task, counts of what waits. Spark does the rest: a batch is
one DataFrame through the registry's plan.
"""

from __future__ import annotations

import functools
import logging
import logging.handlers
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import StructType

from lecterna.plans.registry import Registry, names


@dataclass(frozen=True)
class Settings:
    """Sizes of the service and how they map to Spark."""

    queue: int = 4096
    batch: int = 1024
    partitions: int | None = None
    files_per_trigger: int = 1000

    @classmethod
    def read(cls, text: str) -> Settings:
        """From YAML with the keys of this class; others are ignored."""
        import yaml

        given = yaml.safe_load(text) or {}
        return cls(**{k: int(v) for k, v in given.items() if k in cls.__dataclass_fields__})

    def conf(self) -> dict[str, str]:
        out = {"spark.sql.streaming.maxFilesPerTrigger": str(self.files_per_trigger)}
        if self.partitions:
            out |= {"spark.sql.shuffle.partitions": str(self.partitions), "spark.default.parallelism": str(self.partitions)}
        return out


class TaskService:
    """``with TaskService(spark, registry, schema) as s: f = s.post(row, todo)``."""

    def __init__(self, spark: SparkSession, registry: Registry, schema: str, settings: Settings = Settings()) -> None:
        self.spark, self.registry, self.schema, self.settings = spark, registry, schema, settings
        self.columns = StructType.fromDDL(schema).names
        self.urgent: deque = deque()
        self.waiting: deque = deque()
        self.results: deque = deque()
        self.done = 0
        self.room = threading.BoundedSemaphore(settings.queue)
        self.closed = False

    def post(self, row: dict, todo: int, *, urgent: bool = False, timeout: float | None = None) -> Future:
        """Queues a task; blocks while the queue is full. Bits that nobody serves are refused."""
        if self.closed:
            raise RuntimeError("the service is closed")
        if bad := todo & ~self.registry.supported:
            raise ValueError(f"unsupported operators: {names(bad)}")
        if not self.room.acquire(timeout=timeout):
            raise TimeoutError("the queue is full")
        f: Future = Future()
        (self.urgent if urgent else self.waiting).append((row, todo, f))
        return f

    def step(self) -> int:
        """Runs one batch, urgent tasks first; the number of tasks done."""
        batch = []
        while len(batch) < self.settings.batch and (self.urgent or self.waiting):
            batch.append((self.urgent or self.waiting).popleft())
            self.room.release()
        if not batch:
            return 0
        rows = [(i, todo, *[row.get(c) for c in self.columns]) for i, (row, todo, _) in enumerate(batch)]
        try:
            df = self.spark.createDataFrame(rows, f"_n long, todo long, {self.schema}")
            got = self.registry.plan_rows(df).drop("todo").toLocalIterator()
            for r in got:
                out = Row(**{k: v for k, v in r.asDict().items() if k != "_n"})
                batch[r["_n"]][2].set_result(out)
                self.results.append(out)
        except Exception as e:  # noqa: BLE001 - every caller of the batch must hear of it
            for _, _, f in batch:
                if not f.done():
                    f.set_exception(e)
            raise
        self.done += len(batch)
        return len(batch)

    def drain(self) -> Iterator[Row]:
        """Runs what waits and gives all results, first done first."""
        while self.step():
            pass
        while self.results:
            yield self.results.popleft()

    def sizes(self) -> dict[str, int]:
        """What waits, what is ready and what was done."""
        return {"urgent": len(self.urgent), "waiting": len(self.waiting), "ready": len(self.results), "done": self.done}

    def close(self) -> None:
        self.closed = True
        for q in (self.urgent, self.waiting):
            while q:
                q.popleft()[2].cancel()
                self.room.release()

    def __enter__(self) -> TaskService:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


@contextmanager
def timed(name: str, log: Callable[[str], None] = print, every: float = 1.0) -> Iterator[dict]:
    """Wall time, CPU share and largest memory of a block, sampled ``every`` seconds."""
    import resource

    seen: dict = {"name": name, "peak_mb": 0.0}
    stop = threading.Event()

    def sample() -> None:
        while True:
            seen["peak_mb"] = max(seen["peak_mb"], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
            if stop.wait(every):
                return

    t, c = time.perf_counter(), time.process_time()
    th = threading.Thread(target=sample, daemon=True)
    th.start()
    try:
        yield seen
    finally:
        stop.set()
        th.join()
        seen["seconds"] = time.perf_counter() - t
        seen["cpu"] = (time.process_time() - c) / max(seen["seconds"], 1e-9)
        log(f"{name}: {seen['seconds']:.3f} s, CPU {seen['cpu']:.0%}, {seen['peak_mb']:.0f} MB")


def rotating_log(path: str, days: int = 10) -> logging.Logger:
    """A log that begins anew every day and keeps ``days`` of them."""
    log = logging.getLogger(f"lecterna.{path}")
    if not log.handlers:
        h = logging.handlers.TimedRotatingFileHandler(path, when="D", backupCount=days, encoding="utf-8")
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
        log.setLevel(logging.INFO)
    return log


@functools.cache
def once(build: Callable[[], object]) -> object:
    """What ``build`` makes, once a process: tokenizers and sessions that can't be
    pickled are named by their builder and made on each worker."""
    return build()
