"""One consistent form for text that looks the same.

Compatibility forms are folded and invisible characters deleted; then every
word with letters that other scripts draw alike is read again: the lattice of
all look-alike spellings is searched by Viterbi under character bigram scores
that keep to one script. The lattice depends on the look of the word alone, so
two words that look the same get the same spelling, whatever they held before. A
letter that is drawn like several others (a bar that may be an l or an I) has all of
them in its lattice, and the letters around it decide.

Scale: one pass counts the letter pairs of all texts (three alphabets, so at
most some hundred thousand counters, combined before the shuffle), one pass
reads the texts; only 16-byte hashes of the forms meet in the join.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecterna.llm.speech import AMBIGUOUS, LOOK_ALIKES, fold

_CLASS: dict[str, list[str]] = {}
for _c, _latin in LOOK_ALIKES.items():
    _CLASS.setdefault(_latin, [_latin]).append(_c)


def script(c: str) -> int:
    """The alphabet of a letter, -1 for a combining mark alone."""
    o = ord(c[0])
    if 0x300 <= o <= 0x36F:
        return -1
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return 1
    return 2 if 0x400 <= o <= 0x52F else 3 if 0x530 <= o <= 0x58F else 4 if 0x13A0 <= o <= 0x13FF else 5 if 0xA4D0 <= o <= 0xA4FF else 6 if 0x2C80 <= o <= 0x2CFF else 0


class _Fold(dict):
    def __missing__(self, o: int) -> str:
        self[o] = f = fold(chr(o))
        return f


_FOLD = _Fold()
#: Words of the alphabets that share look-alikes: Latin, Greek, Cyrillic, Armenian, Cherokee, Lisu, Coptic.
_OTHERS = "Ͱ-Ͽἀ-῿Ѐ-ԯ԰-֏Ꭰ-Ᏽꓐ-ꓷⲀ-ⳤ"
WORD = re.compile(f"[A-Za-zÀ-ɏḀ-ỿ\u0300-\u036f{_OTHERS}]+")
_FOREIGN = re.compile(f"[{_OTHERS}]")


def plain(text: str) -> str:
    """Compatibility form, without ignorable characters."""
    if text.isascii() and "\r" not in text and "\t" not in text and text.isprintable():
        return text
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").translate(_FOLD))


@functools.lru_cache(1 << 16)
def drawn(c: str) -> str:
    """A letter as drawn: its base by the Latin letter it looks like, with its accents."""
    base, *marks = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", "".join((LOOK_ALIKES.get(base, base), *marks)))


@functools.lru_cache(1 << 16)
def readings(c: str) -> list[str]:
    """The letters that look like the drawn letter ``c``, with its accents; the Latin ones first."""
    base, *marks = unicodedata.normalize("NFD", c)
    return [unicodedata.normalize("NFC", "".join((x, *marks))) for x in [*AMBIGUOUS.get(base, ""), *_CLASS.get(base, [base])]]


def look(word: str) -> str:
    """The word as drawn."""
    return unicodedata.normalize("NFC", "".join(map(drawn, word)))


def pairs(texts: Iterable[str]) -> Counter:
    """Letter pairs (within a word, with its ends) of the words of one script."""
    words: Counter = Counter()
    for t in texts:
        words.update(WORD.findall(plain(t)))
    out: Counter = Counter()
    for w, n in words.items():
        w = w.lower()
        if len({script(c) for c in w} - {-1}) == 1:
            for a, b in zip(" " + w, w + " "):
                out[a + b] += n
    return out


class Speller:
    """Viterbi over the look-alike lattice of a word."""

    #: Score of changing script within a word: more than all pair scores together,
    #: so that a word with letters of one script alone is read in that script.
    SWITCH = -1e6

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.total = sum(counts.values())
        self.known: dict[str, str] = {}

    def score(self, a: str, b: str) -> float:
        a, b = a.lower(), b.lower()
        s = math.log((self.counts.get(a + b, 0) + 0.1) / (self.total + 100))
        if " " not in (a, b) and script(a) != script(b) and -1 not in (script(a), script(b)):
            s += self.SWITCH
        return s

    def read(self, word: str) -> str:
        """The best spelling of a word's look; the Latin one on ties."""
        key = look(word)
        if (got := self.known.get(key)) is not None:
            return got
        paths = {" ": (0.0, "")}
        for c in key:
            step: dict[str, tuple[float, str]] = {}
            for b in readings(c):
                for a, (s, p) in paths.items():
                    t = s + self.score(a, b)
                    if b not in step or t > step[b][0] + 1e-9:
                        step[b] = (t, p + b)
            paths = step
        best, out = -math.inf, key
        for a, (s, p) in paths.items():
            s += self.score(a, " ")
            if s > best + 1e-9:
                best, out = s, p
        if len(self.known) < 200_000:
            self.known[key] = out
        return out

    def form(self, text: str) -> str:
        t = plain(text)
        if not _FOREIGN.search(t) and not self.foreign:
            return t
        return WORD.sub(lambda m: self.read(m[0]) if self.doubtful(m[0]) else m[0], t)

    @property
    def foreign(self) -> bool:
        """Whether the texts hold words of another script than Latin at all."""
        if "_foreign" not in self.__dict__:
            self.__dict__["_foreign"] = any(script(c) > 0 for ab in self.counts for c in ab)
        return self.__dict__["_foreign"]

    @staticmethod
    def doubtful(word: str) -> bool:
        """Not a word that has a letter which only Latin has, and no others."""
        return bool(_FOREIGN.search(word)) or all(len(readings(c)) > 1 for c in word)


def pair_counts(texts: DataFrame) -> dict[str, int]:
    """Counts of ``pairs`` over all texts of a one-column table; the alphabets
    bound their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            c.update(pairs(t for t in b.column(0).to_pylist() if t))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["pair", "n"])

    return {r["pair"]: r["n"] for r in texts.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def canonical(df: DataFrame, col: str, counts: dict[str, int], *, hashed: bool = False) -> DataFrame:
    """``df`` with the consistent form of ``col`` as last column ``form``, or
    16-byte hashes of the text and of its form as ``raw`` and ``form``. Null stays
    null, an empty text empty; texts of any length are taken whole. Columns of
    these names in ``df`` are replaced."""
    rest = df.drop("form", "raw") if hashed else df.drop("form")
    kept = [f for f in rest.schema.fields if not hashed or f.name != col]
    at = [f.name for f in rest.schema.fields].index(col)
    digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(counts)
        for b in batches:
            texts = b.column(at).to_pylist()
            forms = [None if t is None else speller.form(t) for t in texts]
            cols = [b.column(i) for i in range(b.num_columns) if not hashed or i != at]
            if hashed:
                cols += [pa.array([None if t is None else digest(t) for t in texts], pa.binary()), pa.array([None if t is None else digest(t) for t in forms], pa.binary())]
            else:
                cols.append(pa.array(forms, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + (["raw", "form"] if hashed else ["form"]))

    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    extra = [StructField("raw", BinaryType()), StructField("form", BinaryType())] if hashed else [StructField("form", StringType())]
    return rest.mapInArrow(run, StructType(kept + extra))


def _sides(hyp_a: DataFrame, hyp_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = [F.col("stream_id").cast("long").alias("stream_id"), F.col("idx").cast("int").alias("idx")]
    there = "stream_id is not null and idx is not null and text is not null"
    return hyp_a.select(*key, F.col("asr_dec_preds").alias("text")).where(there), hyp_b.select(*key, F.col("asr_sensevoice_result.preds").alias("text")).where(there)


def forms(hyp_a: DataFrame, hyp_b: DataFrame) -> DataFrame:
    """(stream_id, idx, field, form) of each transcript of both recognisers,
    once for each delivery that differs."""
    a, b = _sides(hyp_a, hyp_b)
    both = a.withColumn("field", F.lit("asr_dec_preds")).unionByName(b.withColumn("field", F.lit("asr_sensevoice_result")))
    return canonical(both, "text", pair_counts(a.select("text").unionByName(b.select("text")))).select("stream_id", "idx", "field", "form").distinct()


def same_look(hyp_a: DataFrame, hyp_b: DataFrame) -> DataFrame:
    """(stream_id, idx) of utterances whose two transcripts are both present,
    differ in characters and have one form. Keys with nulls pair with nothing;
    repeated deliveries count once."""
    a, b = _sides(hyp_a, hyp_b)
    counts = pair_counts(a.select("text").unionByName(b.select("text")))
    ha = canonical(a, "text", counts, hashed=True)
    hb = canonical(b, "text", counts, hashed=True).withColumnsRenamed({"raw": "raw_b", "form": "form_b"})
    return ha.join(hb, ["stream_id", "idx"]).where("form = form_b and raw <> raw_b").select("stream_id", "idx").distinct()
