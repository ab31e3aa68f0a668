"""Audio and image files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

WAV = "path string, rate int, channels int, samples array<float>"


def parse_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples as float32 in -1..1, rate, channels) of a RIFF file with 16- or
    32-bit integers or 32-bit floats, plain or extensible; unknown chunks are
    skipped. Raises ValueError on anything else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if tag == 0xFFFE:
                if len(body) < 26:
                    raise ValueError("short extensible header")
                tag = struct.unpack("<H", body[24:26])[0]
            form = tag, channels, rate, bits
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            tag, channels, rate, bits = form
            if (tag, bits) == (1, 16):
                x = np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
            elif (tag, bits) == (1, 32):
                x = (np.frombuffer(body[: len(body) // 4 * 4], "<i4") / 2147483648).astype(np.float32)
            elif (tag, bits) == (3, 32):
                x = np.frombuffer(body[: len(body) // 4 * 4], "<f4").astype(np.float32)
            else:
                raise ValueError(f"samples of format {tag} with {bits} bits")
            return x, rate, channels
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, samples) of each WAV file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse_wav(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "rate": [g[1] for g in got], "channels": [g[2] for g in got], "samples": [g[0] for g in got]})

    return files.mapInPandas(run, WAV)


def chunks(audio: DataFrame, seconds: float = 6.0) -> DataFrame:
    """(path, chunk_id, start_ms, samples) in pieces of ``seconds``, the last one shorter."""
    from pyspark.sql import functions as F

    n = (F.col("rate") * seconds).cast("int")
    count = F.ceil(F.size("samples") / n).cast("int")
    each = audio.where(F.size("samples") > 0).select("path", "rate", "samples", n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_id"))
    return each.select("path", "chunk_id", (F.col("chunk_id") * F.lit(int(seconds * 1000))).cast("long").alias("start_ms"), F.slice("samples", F.col("chunk_id") * F.col("n") + 1, F.col("n")).alias("samples"))


def images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, length, content) of the images of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


class WavSource(DataSource):
    """``spark.read.format("wav").load(dir)``: one row a file, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return WAV

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WavReader(self.options["path"])


class _WavReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.path).rglob("*.wav"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            with open(partition.value, "rb") as f:
                x, rate, channels = parse_wav(f.read())
            yield partition.value, rate, channels, x.tolist()
