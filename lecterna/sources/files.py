"""Descriptors, vocabularies, statistics and label files."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecterna.plans.registry import BITS, DESCRIPTOR


def _yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def descriptors(spark: SparkSession, path: str, mask: int = -1) -> DataFrame:
    """Model descriptors of a folder of YAML or JSON files, in the order of their
    names: those with name, mid and model_path whose bit is in ``mask``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = [(r["file"], _yaml(r["value"])) for r in files.orderBy("file").collect()]  # one small file a model
    ok = [json.dumps(x) for _, x in rows if all(k in x for k in ("mid", "model_path", "name"))]
    return spark.createDataFrame([(x,) for x in ok], "j string").select(F.from_json("j", DESCRIPTOR).alias("d")).select("d.*").where(F.col("mid").bitwiseAND(F.lit(mask)) != 0)


def default_descriptors(spark: SparkSession, model_dir: str) -> DataFrame:
    """A template for every operator bit."""
    rows = [json.dumps({"name": k.lower(), "mid": v, "model_path": f"{model_dir}/{k.lower()}", "input": [], "depend": [], "backend": [{"type": "ort", "model_path": f"{model_dir}/{k.lower()}.onnx", "backend_cfg": {"force_cpu": False, "balance_ratio": 1.0}}]}) for k, v in BITS.items()]
    return spark.createDataFrame([(x,) for x in rows], "j string").select(F.from_json("j", DESCRIPTOR).alias("d")).select("d.*")


def vocabulary(spark: SparkSession, path: str, *, blank_last: bool = False) -> DataFrame:
    """(id, token): the lines of a text file, or a JSON list of tokens."""
    text = spark.read.text(path, wholetext=True)
    is_json = F.col("value").rlike(r"^\s*\[")
    items = F.when(is_json, F.from_json("value", "array<string>")).otherwise(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n"))
    if blank_last:
        items = F.concat(items, F.array(F.lit(" ")))
    return text.select(F.posexplode(items).alias("id", "token"))


def cmvn(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(shift, scale) of a statistics file in text form."""
    lines = [r["value"] for r in spark.read.text(path).collect()]  # two short vectors
    out: dict[str, np.ndarray] = {}
    for i, line in enumerate(lines):
        for tag in ("<AddShift>", "<Rescale>"):
            if tag in line:
                body = " ".join(lines[i : i + 3])
                body = body[body.index("[", body.index(tag)) + 1 : body.index("]", body.index(tag))]
                out[tag] = np.array(body.split(), float)
    return out["<AddShift>"], out["<Rescale>"]


def words(spark: SparkSession, path: str) -> list[str]:
    """A word list, one a line: idioms, words that may double."""
    return [r["value"].strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]


# The locales that stand in for one without an own table, nearest first.
FALLBACK = {"zh-cn": ("zh-hans", "zh"), "zh-sg": ("zh-hans", "zh"), "zh-my": ("zh-hans", "zh"), "zh-tw": ("zh-hant", "zh"), "zh-hk": ("zh-hant", "zh"), "zh-mo": ("zh-hk", "zh-hant", "zh"), "zh-hans": ("zh",), "zh-hant": ("zh",)}
_dictionaries: dict[tuple[str, str], dict[str, str]] = {}


def script_dictionary(spark: SparkSession, path: str, locale: str) -> dict[str, str]:
    """One locale's conversions of a JSON dictionary {locale: {from: to}}, those of
    its fallbacks under its own; read once a process."""
    if (path, locale) not in _dictionaries:
        r = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m")).first()
        known = (r and r["m"]) or {}
        out: dict[str, str] = {}
        for name in (*reversed(FALLBACK.get(locale, ())), locale):
            out |= known.get(name) or {}
        _dictionaries[path, locale] = out
    return _dictionaries[path, locale]


def pipe_settings(spark: SparkSession, path: str):  # noqa: ANN201
    """Queue and thread settings of a YAML file, with defaults for what it lacks."""
    from lecterna.plans.service import Settings

    r = spark.read.text(path, wholetext=True).first()
    return Settings.read(r["value"] if r else "")


def convert_files(spark: SparkSession, source: str, target: str, table: dict[str, str]) -> None:
    """Text files converted line by line into another script."""
    from lecterna.functions.scripts import converted

    spark.read.text(source).select(converted(F.col("value"), table).alias("value")).write.mode("overwrite").text(target)


def features(spark: SparkSession, path: str, dim: int = 192) -> DataFrame:
    """(file, row, vec) of .npy files, or of raw float32 files of rows of ``dim``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                x = np.load(io.BytesIO(c)) if c[:6] == b"\x93NUMPY" else np.frombuffer(c, np.float32)
                x = x.reshape(-1, x.shape[-1] if x.ndim == 2 else dim).astype(np.float32)
                yield pd.DataFrame({"file": p, "row": np.arange(len(x)), "vec": list(x)})

    return files.mapInPandas(run, "file string, row long, vec array<float>")


def cluster_meta(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(label, rows): the row numbers of each label of a one-label-a-line file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("row", "label")).where("trim(label) <> ''")
    return lines.groupBy(F.trim("label").alias("label")).agg(F.sort_array(F.collect_list((F.col("row") + start).cast("long"))).alias("rows"))


def write_labels(df: DataFrame, path: str, *, extra: Iterable[str] = ()) -> None:
    """Label files: start, end and text (and ``extra``) by tabs, times with three decimals."""
    cols = [F.format_string("%.3f", F.col("start").cast("double")).alias("start"), F.format_string("%.3f", F.col("end").cast("double")).alias("end"), F.regexp_replace("text", r"[\t\r\n]+", " ").alias("text")]
    df.select(*cols, *extra).write.option("sep", "\t").option("quote", "").mode("overwrite").csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").schema("start double, end double, text string").csv(path)
