"""Decoders of model scores: greedy, CTC, attention-style tables, beams."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lecterna.functions.sequences import latex


@dataclass(frozen=True)
class Decoder:
    """How a row of class ids becomes a text.

    ``before`` and ``after`` are special signs around the alphabet; ``ignored`` ids are
    dropped, the first ``stop`` id ends the text, ``repeats`` keeps equal
    neighbours, ``skip`` drops leading places, ``separator`` joins the signs,
    ``empty`` is the confidence of an empty text.
    """

    name: str
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    repeats: bool = True
    skip: int = 0
    separator: str = ""
    empty: float = 0.0
    lower: bool = False

    def alphabet(self, characters: Sequence[str]) -> list[str]:
        return [*self.before, *characters, *self.after]

    def decode(self, ids: Sequence[int], probs: Sequence[float] | None, characters: Sequence[str]) -> tuple[str, float]:
        """(text, mean probability of the kept signs)."""
        table = self.alphabet(characters)
        drop = {table.index(x) for x in self.ignored}
        ends = {table.index(x) for x in self.stop}
        out, conf, prev = [], [], None
        for k, i in enumerate(ids):
            if k < self.skip:
                continue
            if i in ends:
                break
            repeated = not self.repeats and i == prev
            prev = i
            if repeated or i in drop or not 0 <= i < len(table):
                continue
            out.append(table[i])
            conf.append(1.0 if probs is None else float(probs[k]))
        text = self.separator.join(out)
        if self.lower:
            text = re.sub(r"[^0-9a-z一-龥]", "", text.lower())
        return text, float(np.mean(conf)) if conf else self.empty

    def logits(self, scores: np.ndarray, characters: Sequence[str]) -> tuple[str, float]:
        """Decodes (places, classes); the first largest class of a place wins."""
        return self.decode(scores.argmax(1).tolist(), scores.max(1).tolist(), characters)


# The text decoders of the recogniser family, as parameters. Attention's two ends are ignored before they could stop it.
DECODERS = {
    d.name: d
    for d in (
        Decoder("ctc", before=("blank",), ignored=("blank",), repeats=False),
        Decoder("attention", before=("sos",), after=("eos",), ignored=("sos", "eos")),
        Decoder("rfl", before=("sos",), after=("eos",), ignored=("sos", "eos")),
        Decoder("spin", before=("sos", "eos"), ignored=("sos", "eos")),
        Decoder("seed", after=("eos", "padding", "unknown"), ignored=("padding", "unknown"), stop=("eos",)),
        Decoder("srn", after=("sos", "eos"), ignored=("sos", "eos")),
        Decoder("parseq", before=("[E]",), after=("[B]", "[P]"), ignored=("[B]", "[P]"), stop=("[E]",)),
        Decoder("sar", after=("<UKN>", "<BOS/EOS>", "<PAD>"), ignored=("<PAD>",), stop=("<BOS/EOS>",)),
        Decoder("satrn", after=("<UKN>", "<BOS/EOS>", "<PAD>"), ignored=("<PAD>",), stop=("<BOS/EOS>",)),
        Decoder("pren", before=("<PAD>", "<EOS>", "<UNK>"), ignored=("<PAD>",), stop=("<EOS>",), empty=1.0),
        Decoder("nrtr", before=("blank", "<unk>", "<s>", "</s>"), ignored=("blank", "<s>"), stop=("</s>",)),
        Decoder("vitstr", before=("<s>", "</s>"), stop=("</s>",), skip=1),
        Decoder("abinet", before=("</s>",), stop=("</s>",)),
        Decoder("cppd", before=("</s>",), stop=("</s>",)),
        Decoder("can", separator=" "),
    )
}


def distilled(decoder: Decoder, heads: dict[str, np.ndarray], characters: Sequence[str]) -> dict[str, tuple[str, float]]:
    """One decoding for each named head."""
    return {k: decoder.logits(v, characters) for k, v in heads.items()}


def can_ids(ids: Sequence[int]) -> list[int]:
    """Ids up to the first smallest one, where the formula decoder ends."""
    return list(ids[: int(np.argmin(ids))]) if len(ids) else []


def formula(ids: Sequence[int], lookup: Callable[[Sequence[int]], str], *, end: int = 2) -> str:
    """LaTeX of token ids: cut behind the end id, tags stripped, blanks normalised."""
    ids = list(ids)
    if end in ids:
        ids = ids[: ids.index(end)]
    text = lookup(ids).replace("Ġ", " ")
    return latex(re.sub(r"<(?:s|/s|pad|unk|mask)>|\[(?:BOS|EOS|PAD|UNK)\]", "", text).strip())


def decoded(scores: Column, characters: Sequence[str], decoder: str = "ctc") -> Column:
    """Column of (text, confidence) of array<array<float>> scores; null stays null."""
    d, table = DECODERS[decoder], list(characters)

    @F.pandas_udf("text string, confidence double")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [(None, None) if x is None else d.logits(np.stack([np.asarray(r, float) for r in x]), table) if len(x) else ("", d.empty) for x in s]
        return pd.DataFrame(got, columns=["text", "confidence"])

    return run(scores)


def greedy(ids: Column, vocabulary: Column, dropped: tuple[int, ...] = (0, 2)) -> Column:
    """Tokens of ids without the special ones; unknown ids give the last token."""
    kept = F.filter(ids, lambda i: ~i.isin(list(dropped)))
    return F.transform(kept, lambda i: F.coalesce(F.get(vocabulary, i), F.element_at(vocabulary, -1)))


def greedy_words(text: Column) -> Column:
    """Word pieces as text: ▁ is a blank, <...> tags are dropped."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("▁"), F.lit(" ")), r"<[^<>]*>", ""))


def beam(step: Callable[[list[int]], np.ndarray], *, width: int = 2, most: int = 100, end: int = 1, power: float = 0.6, cumulative: bool = True) -> tuple[list[int], float]:
    """(tokens, score) of the best sequence.

    ``step`` gives the log probabilities behind a prefix. Each round adds its best
    ``width`` continuations to every live prefix, divides by length**``power`` (the
    sum so far again each round, unless ``cumulative`` is off) and keeps the best
    ``width``; sequences that end leave the beam. What is still live at the end
    competes with them.
    """
    first = step([])
    order = np.argsort(-first, kind="stable")[:width]
    live = [([int(i)], float(first[i])) for i in order]
    done = [b for b in live if b[0][-1] == end]
    live = [b for b in live if b[0][-1] != end]
    for _ in range(most - 1):
        if not live or len(live) < 2 and done:
            break
        grown = []
        for tokens, score in live:
            lp = step(tokens)
            for i in np.argsort(-lp, kind="stable")[:width]:
                total = score + float(lp[i])
                grown.append(([*tokens, int(i)], total / (len(tokens) + 1) ** power if cumulative else total))
        grown.sort(key=lambda b: -b[1])
        grown = grown[:width]
        done += [b for b in grown if b[0][-1] == end]
        live = [b for b in grown if b[0][-1] != end]
    every = done + live
    return max(every, key=lambda b: b[1]) if every else ([], 0.0)


def punctuated(tokens: Sequence[str], score: Callable[[list[str]], list[int]], *, chunk: int = 20, trigger: int = 200, carry: list[str] | None = None, final: bool = True) -> tuple[list[int], list[str]]:
    """(punctuation ids, tokens carried on): marks for a stream of tokens in
    chunks. Each chunk is scored with what the one before left over; a chunk is
    cut at its last sentence mark (3, 4), or at its last comma (2) once ``trigger``
    tokens have gathered, and the rest waits for more context."""
    out: list[int] = []
    cache = list(carry or [])
    for at in range(0, len(tokens), chunk):
        part = cache + list(tokens[at : at + chunk])
        marks = score(part)
        last = at + chunk >= len(tokens) and final
        if last:
            if marks and marks[-1] in (1, 2, 5):
                marks[-1] = 3
            out += marks
            cache = []
            continue
        cut = max((k for k, m in enumerate(marks) if m in (3, 4)), default=-1)
        if cut < 0 and len(part) >= trigger:
            cut = max((k for k, m in enumerate(marks) if m == 2), default=-1)
            if cut >= 0:
                marks[cut] = 3
        out += marks[: cut + 1]
        cache = part[cut + 1 :]
    return out, cache
