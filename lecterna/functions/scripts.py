"""Script conversion by longest match over a dictionary the caller supplies,
with the inline markup for exceptions: -{plain}-, -{zh-hans:a;zh-hant:b}-,
-{A|rule}- (rule and text), -{H|rule}- (rule only), -{-|rule}- (drop a rule)."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a locale looks when it has no variant of its own.
FALLBACK = {
    "zh-cn": ("zh-cn", "zh-hans", "zh-sg", "zh"), "zh-hans": ("zh-hans", "zh-cn", "zh-sg", "zh"), "zh-sg": ("zh-sg", "zh-hans", "zh-cn", "zh"),
    "zh-tw": ("zh-tw", "zh-hant", "zh-hk", "zh"), "zh-hant": ("zh-hant", "zh-tw", "zh-hk", "zh"), "zh-hk": ("zh-hk", "zh-hant", "zh-tw", "zh"),
}


class Converter:
    """Longest-match conversion with a dictionary of one locale."""

    def __init__(self, words: Mapping[str, str], locale: str = "zh-hans") -> None:
        self.locale = locale
        self.words = dict(words)
        self.longest = max(map(len, self.words), default=1)

    def tokens(self, text: str) -> list[str]:
        out, i = [], 0
        while i < len(text):
            for n in range(min(self.longest, len(text) - i), 0, -1):
                if n == 1 or text[i : i + n] in self.words:
                    out.append(text[i : i + n])
                    i += n
                    break
        return out

    def convert(self, text: str | None) -> str | None:
        return text and "".join(self.words.get(t, t) for t in self.tokens(text))

    def variants(self, rule: str) -> dict[str, str]:
        """locale -> text of 'zh-hans:a;zh-hant:b'."""
        pairs = (p.split(":", 1) for p in rule.split(";") if ":" in p)
        return {k.strip().split("=>")[-1].strip(): v.strip() for k, v in pairs}

    def pick(self, rule: str) -> str:
        v = self.variants(rule)
        if not v:
            return rule
        return next((v[x] for x in FALLBACK.get(self.locale, (self.locale,)) if x in v), next(iter(v.values())))

    def marked(self, text: str | None) -> str | None:
        """As ``convert``, obeying the markup; rules hold from where they stand."""
        if not text:
            return text
        inner = Converter(self.words, self.locale)
        out, i = [], 0
        while (at := text.find("-{", i)) != -1:
            out.append(inner.convert(text[i:at]) or "")
            depth, j = 1, at + 2
            while j < len(text) and depth:
                if text.startswith("-{", j):
                    depth, j = depth + 1, j + 2
                elif text.startswith("}-", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            if depth:  # never closed: ordinary text
                out.append(inner.convert(text[at:]) or "")
                return "".join(out)
            body = text[at + 2 : j - 2]
            if "-{" in body:
                body = self.marked(body) or ""
            flag, sep, rule = body.partition("|")
            flag = flag.strip()
            if sep and flag in ("A", "H", "-", "R", "T"):
                v = self.variants(rule)
                target = self.pick(rule)
                for source in v.values():
                    if flag == "-":
                        inner.words.pop(source, None)
                    elif flag in ("A", "H"):
                        inner.words[source] = target
                inner.longest = max(map(len, inner.words), default=1)
                if flag in ("A", "R"):
                    out.append(target if flag == "A" else rule)
            elif sep and all(x.strip().startswith("zh") for x in flag.split(";")):
                limits = [x.strip() for x in flag.split(";")]
                out.append((inner.convert(rule) if self.locale in limits else rule) or "")
            else:
                out.append(self.pick(body))
            i = j
        out.append(inner.convert(text[i:]) or "")
        return "".join(out)


def converted(text: Column, words: Mapping[str, str], locale: str = "zh-hans", *, markup: bool = False) -> Column:
    """Column form; the dictionary travels with the function, so it should be a
    dictionary, not a corpus."""
    table = dict(words)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        c = Converter(table, locale)
        return s.map(c.marked if markup else c.convert, na_action="ignore")

    return run(text)
