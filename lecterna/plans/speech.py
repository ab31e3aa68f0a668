"""The speech operators as a registry over rows of the task table.

Every operator is a set of expressions over ``userdata`` and the results of the
operators it depends on; the neural part of each is a scorer that the caller
adds. What is settled here is the geometry that pre- and post-steps need: frames,
stacked rows, slots of peaks, windows of a voiceprint, batch widths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecterna.functions.vector import bucket
from lecterna.plans.registry import BITS, Operator, Registry

#: ms of a frame and of its hop; frames that one stacked row spans.
FRAME_MS, HOP_MS, STACK = 25, 10, 6


def _number(key: str) -> Column:
    return F.expr(f"try_cast(userdata['{key}'] AS BIGINT)")


def registry(scorers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Registry:
    """The speech chain; ``scorers`` adds operators by name that work on whole tables."""
    r = Registry()
    length = _number("end_ms") - _number("begin_ms")
    add = lambda name, depends, columns: r.add(Operator(name, BITS[name], None, tuple(BITS[d] for d in depends), ("userdata",), None, columns))
    add("ASR_ENCODE", (), lambda: {"frames": F.greatest(F.lit(0).cast("long"), F.floor((length - FRAME_MS) / HOP_MS) + 1)})
    add("ASR_PREDICTOR", ("ASR_ENCODE",), lambda: {"stacked": F.ceil(F.col("frames") / STACK)})
    add("ASR_DECODE", ("ASR_PREDICTOR",), lambda: {"width": bucket(F.col("stacked"), [16, 32, 64, 128, 256, 512]).cast("long")})
    add("ASR_STAMP", ("ASR_DECODE",), lambda: {"slots": F.col("stacked") * 3 + 1})
    add("SENSEVOICE", ("ASR_ENCODE",), lambda: {"second_rows": F.ceil(F.col("frames") / STACK) + 4})
    add("VOICEPRINT", (), lambda: {"segment": _number("dex")})
    for name, transform in (scorers or {}).items():
        r.add(Operator(name, BITS[name], transform))
    return r
