"""Spoken Chinese numbers as digits.

A candidate is a maximal run of number characters and of the words that join
numbers. It is read by a small grammar: digits by name, values with units of ten,
percent, fractions, ratios, arithmetic, times and dates; whatever doesn't read as
a whole stays as it is. Runs inside a known idiom stay, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, powers of ten, and measure words that may follow a number.
DIGITS = {"零": 0, "〇": 0, "幺": 1, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
POWERS = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
UNITS = "个只分万亿秒"
SIGNS = {"加": "+", "减": "-", "乘": "*", "除": "÷", "等于": "="}

_D = "[零〇幺一二两三四五六七八九]"
_V = "[零〇一二两三四五六七八九十百千万亿]"
_RUN = re.compile(rf"(?:百分之|分之|等于|{_V}|幺|点|比|加|减|乘|除|年|月|日|号|分|秒)+")
_NAMED = re.compile(rf"{_D}+(?:点{_D}+)*")
_VALUE = re.compile(rf"{_V}+(?:点{_D}+)?")
_TIME = re.compile(rf"({_V}+)点({_V}+)分(?:({_V}+)秒)?")
_DATE = re.compile(rf"(?:({_D}{{2,4}})年)?(?:({_V}{{1,3}})月)?(?:({_V}{{1,3}})([日号]))?")


def named(s: str) -> str:
    """Digit by digit."""
    return "".join("." if c == "点" else str(DIGITS[c]) for c in s)


def value(s: str) -> str | None:
    """A value with units of ten; None if it isn't one."""
    whole, _, rest = s.partition("点")
    if not whole or not re.search("[十百千万亿]", whole):
        return None
    total = section = number = 0
    last = 1
    seen_digit = False
    for c in whole:
        if c in DIGITS:
            if seen_digit and number:
                return None
            number, seen_digit = DIGITS[c], True
            if c in "零〇":
                last, seen_digit = 1, False
        elif c in "万亿":
            total = (total + section + number) * POWERS[c]
            section = number = 0
            last, seen_digit = POWERS[c] // 10, False
        else:
            section += (number or (1 if not seen_digit else 0)) * POWERS[c]
            last, number, seen_digit = POWERS[c] // 10, 0, False
    # 一千二 is twelve hundred: a digit behind a power stands for the next lower one
    total += section + number * (last if last > 1 else 1)
    return str(total) + ("." + named(rest) if rest else "")


def number(s: str) -> str | None:
    if _NAMED.fullmatch(s):
        return named(s)
    return value(s) if _VALUE.fullmatch(s) else None


def _candidate(s: str) -> str | None:
    """The written form of a whole candidate, or None."""
    if _NAMED.fullmatch(s):
        return None if s == "一" else named(s)
    if _VALUE.fullmatch(s):
        return value(s)
    if s.startswith("百分之"):
        n = number(s[3:])
        return n and n + "%"
    if s.count("分之") == 1:
        low, high = (number(x) for x in s.split("分之"))
        return f"{high}/{low}" if low and high else None
    if s.count("比") == 1:
        a, b = (number(x) for x in s.split("比"))
        return f"{a}:{b}" if a and b else None
    parts = re.split("(加|减|乘|除|等于)", s)
    if len(parts) > 1:
        out = [SIGNS[p] if i % 2 else number(p) for i, p in enumerate(parts)]
        return "".join(out) if all(out) else None  # type: ignore[arg-type]
    if m := _TIME.fullmatch(s):
        got = [number(x) for x in m.groups() if x]
        return ":".join(got) if all(got) else None  # type: ignore[arg-type]
    if (m := _DATE.fullmatch(s)) and s:
        year, month, day, mark = m.groups()
        out = [named(year) + "年" if year else "", (number(month) or "") + "月" if month else "", (number(day) or "") + mark if day else ""]
        return "".join(out)
    return None


def written(text: str | None, idioms: Iterable[str] = ()) -> str | None:
    """``text`` with spoken numbers as digits; null stays null."""
    if not text:
        return text
    guarded = [(m.start(), m.end()) for w in idioms if w and w in text for m in re.finditer(re.escape(w), text)]

    def put(m: re.Match[str]) -> str:
        s = m[0]
        if any(a < m.end() and m.start() < b for a, b in guarded):
            return s
        # marks that merely stand beside a number aren't part of it
        head = re.match("(?:等于|[点比加减乘除年月日号分秒])*", s)[0]  # type: ignore[index]
        body = s[len(head) :]
        for tail in range(len(body), 0, -1):
            if (w := _candidate(body[:tail])) is not None:
                rest = body[tail:]
                return head + w + (_RUN.sub(put, rest) if rest else "")
        return s

    return _RUN.sub(put, text)


def normalised(text: Column, idioms: Iterable[str] = ()) -> Column:
    """Column form of ``written``."""
    words = tuple(idioms)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: written(t, words), na_action="ignore")

    return run(text)
