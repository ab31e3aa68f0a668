"""Sentence boundaries in any script, by unsupervised statistics.

Learning: over all texts, per language, the counts of every word with and
without a period, after a certain boundary, and of pairs around a period give
log-likelihood ratios; significant words become abbreviations, sentence starters
and collocations. Splitting: every period is classified by these statistics;
other marks, quotations, brackets, line breaks and the blanks of scripts
without marks follow fixed rules.

Scale: the counts are combined in the tasks and shuffled once by word; words are
tested where their counts lie, and only abbreviations, sentence starters and
collocations, whose number the languages bound, return to the driver. The bars don't
move with the size of the corpus. Splitting is a narrow map without shuffle.

Words of alphabets with capitals (Latin, Greek, Cyrillic, Armenian) are counted;
periods of other scripts always end a sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecterna.llm import speech
from lecterna.plans.lineage import written

# Frequent function words that tell languages of one script apart.
FUNCTION_WORDS = {
    "de": "der die das und ist wir nicht den ein auf mit wer heute schaut jeder",
    "fr": "le la les et est nous des une qui que dans vous pour aujourd regardez",
    "es": "el los las es esto hoy una por del con que la mirad quién qué",
    "it": "il gli che della per non sono una oggi questo",
    "pt": "os as não uma com para hoje isto você que",
}
_NOT_LATIN = re.compile("[Ͱ-ϿЀ-ԯ԰-֏]")
_LANG = {w: k for k, ws in FUNCTION_WORDS.items() for w in ws.split()}

#: Letters of alphabets with capitals.
CASED = "A-Za-zÀ-ɏͰ-ϿЀ-ԯ԰-֏"
#: A word of such letters with inner periods and apostrophes.
WORD = rf"[{CASED}]+(?:['’\-][{CASED}]+)*(?:\.[{CASED}]+)*"
_CASED = re.compile(f"[{CASED}]")
_TOKEN = re.compile(rf"({WORD})(\.?)|(\d[\d.,:]*\d|\d)(\.?)(?=\s+({WORD}))")
_START = re.compile(rf"(?:^|[!?\n。！？]|[!?]\"?|\A)[ \"“«¿¡]*({WORD})", re.M)
_AFTER = re.compile(rf"({WORD}|\d+)\.[ ]+\"?({WORD})")


def language(v: str) -> str:
    """The language of a text's words of alphabets with capitals: by script, and for
    Latin words by function words, if they are one word in twelve at least."""
    words = re.findall(rf"[{CASED}]+", v.lower())
    if _NOT_LATIN.search(v):
        other = Counter("ru" if "Ѐ" <= w[i] <= "ԯ" else "el" if w[i] < "Ѐ" else "hy" for w in words for i in range(len(w)) if w[i] >= "Ͱ")
        if sum(other.values()) * 3 > sum(map(len, words)):
            return other.most_common(1)[0][0]
    votes = Counter(_LANG[w] for w in words if w in _LANG)
    if not votes:
        return "en"
    lang, n = votes.most_common(1)[0]
    return lang if n * 12 >= len(words) else "en"


def observed(text: str) -> Counter:
    """(language, kind, word, other) counts of one text. Kinds: w a word,
    d a word with a period, s a word after a certain boundary, p a pair around a
    period, u / l a period followed by an upper / lower case word, O / o a word
    in upper / lower case in a text that has both."""
    out: Counter = Counter()
    v = speech.view(text)[0]
    v = v[speech.heads(v)[0] :]
    if not _CASED.search(v):
        return out
    lang = language(v)
    cased = v != v.lower() and v != v.upper()
    for m in _TOKEN.finditer(v):
        w = (m[1] or "#").lower()
        out[lang, "w", w, ""] += 1
        if m[2] or m[4]:
            out[lang, "d", w, ""] += 1
        if cased and m[1]:
            out[lang, "o" if m[1][0].islower() else "O", w.split(".")[0], ""] += 1
    for m in _START.finditer(v):
        out[lang, "s", m[1].lower().split(".")[0], ""] += 1
    if cased:
        for m in _AFTER.finditer(v):
            w = "#" if m[1][0].isdigit() else m[1].lower()
            out[lang, "u" if m[2][0].isupper() else "l", w, ""] += 1
            out[lang, "p", w, m[2].lower()] += 1
    return out


def likelihood(a: float, na: float, b: float, nb: float) -> float:
    """Log-likelihood ratio of ``a`` hits in ``na`` trials against ``b`` in ``nb``."""
    def ll(k: float, n: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    if not na or not nb:
        return 0.0
    p = (a + b) / (na + nb)
    return 2 * (ll(a, na, a / na) + ll(b, nb, b / nb) - ll(a, na, p) - ll(b, nb, p))


@dataclass
class Language:
    """What was learnt of one language."""

    #: abbreviation -> share of its periods that also end a sentence
    short: dict[str, float] = field(default_factory=dict)
    starters: set[str] = field(default_factory=set)
    #: words seen after abbreviations that are otherwise written small
    common: set[str] = field(default_factory=set)
    pairs: set[tuple[str, str]] = field(default_factory=set)


def learnt(texts: DataFrame) -> dict[str, Language]:
    """The statistics of all texts of a one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out() -> pa.RecordBatch:
            ks = list(c)
            cols = [pa.array([k[i] for k in ks], pa.string()) for i in range(4)]
            got = pa.RecordBatch.from_arrays([*cols, pa.array([c[k] for k in ks], pa.int64())], names=["lang", "kind", "w", "x", "n"])
            c.clear()
            return got

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c.update(observed(t))
            if len(c) > 200_000:
                yield out()
        yield out()

    counts = texts.mapInArrow(run, "lang string, kind string, w string, x string, n long").groupBy("lang", "kind", "w", "x").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    # one row a word; every test runs where the counts are
    words = counts.where("kind <> 'p'").groupBy("lang", "w").pivot("kind", ["w", "d", "s", "u", "l", "o", "O"]).agg(F.sum("n")).fillna(0).toDF("lang", "word", "n", "d", "s", "u", "l", "lower", "upper")
    words = written(words, "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("n_all"), F.sum("d").alias("d_all"), F.sum("s").alias("s_all"))
    out = {r["lang"]: Language() for r in total.select("lang").collect()}
    if not out:
        return {}
    c = F.col
    w = words.join(F.broadcast(total), "lang")  # a row for each language
    begins = (c("s") >= LEAST) & (c("s") / F.greatest(c("n"), F.lit(1)) > c("s_all") / c("n_all")) & (_ratio(c("s"), F.greatest("n", "s"), c("s_all") - c("s"), c("n_all") - c("n")) > BAR)
    for r in w.where(begins).select("lang", "word").toLocalIterator():
        out[r["lang"]].starters.add(r["word"])
    # length, inner periods and misses weigh as in the published method; a word followed by lower case proves itself
    inner = F.length("word") - F.length(F.replace(c("word"), F.lit("."), F.lit("")))
    score = F.when(c("d") / c("n") > c("d_all") / c("n_all"), _ratio(c("d"), c("n"), c("d_all") - c("d"), c("n_all") - c("n"))).otherwise(0.0)
    score = score * F.exp(-(F.length("word") - inner)) * (inner + 1) * F.exp(-F.least(F.lit(50), 3 * (c("n") - c("d")) * F.length("word") / c("d")))
    proven = (c("l") >= LEAST) & (c("l") >= 0.2 * c("d")) & (c("d") >= 0.8 * c("n"))
    short = w.where((c("word") != "#") & (c("d") >= LEAST)).where((score > 0.3) | proven | (inner > 0))
    short = written(short.select("lang", "word", (c("u") / F.greatest(F.lit(1), c("u") + c("l"))).alias("share")), "short")
    for r in short.toLocalIterator():
        out[r["lang"]].short[r["word"]] = r["share"]
    after = counts.where("kind = 'p'").select("lang", c("w").alias("word"), F.split_part("x", F.lit("."), F.lit(1)).alias("next"), c("x").alias("whole"), "n")
    behind = after.join(short.select("lang", "word"), ["lang", "word"])
    known = words.select("lang", c("word").alias("next"), "lower", "upper", c("s").alias("s_next"), c("n").alias("n_next"))
    small = behind.select("lang", "next").distinct().join(known, ["lang", "next"]).where((c("lower") >= LEAST) & (c("lower") >= 0.15 * (c("lower") + c("upper"))))
    for r in small.toLocalIterator():
        out[r["lang"]].common.add(r["next"])
    # a word after which statements begin as anywhere, and hardly ever go on, merely ends many of them
    begun = w.where(begins).select("lang", c("word").alias("next"), F.lit(1).alias("begun"))
    rate = behind.join(begun, ["lang", "next"], "left").groupBy("lang", "word").agg((F.sum(c("n") * F.coalesce("begun", F.lit(0))) / F.sum("n")).alias("begun"))
    for r in rate.where("begun > 0.5").toLocalIterator():
        know = out[r["lang"]]
        if know.short.get(r["word"], 0) > 0.85:
            del know.short[r["word"]]
    # collocations over a period: behind a number any word that begins no sentences elsewhere; behind a short word
    # that hardly goes without its period one that follows it far more often than others, and mostly
    pair = after.groupBy("lang", "word", "whole").agg(F.sum("n").alias("n")).where(c("n") >= LEAST)
    number = pair.where("word = '#'")
    for r in number.toLocalIterator():
        if r["whole"] not in out[r["lang"]].starters:
            out[r["lang"]].pairs.add(("#", r["whole"]))
    ends = after.groupBy("lang", "word").agg(F.sum("n").alias("nw"))
    firsts = after.groupBy("lang", "whole").agg(F.sum("n").alias("nx"))
    every = after.groupBy("lang").agg(F.sum("n").alias("na"))
    brief = words.where((F.length("word") <= 4) & (c("d") >= 0.8 * c("n"))).select("lang", "word")
    tied = pair.where("word <> '#'").join(brief, ["lang", "word"]).join(ends, ["lang", "word"]).where("n > 0.5 * nw").join(firsts, ["lang", "whole"]).join(F.broadcast(every), "lang")
    tied = tied.where((c("n") / c("nw") > c("nx") / c("na")) & (_ratio(c("n"), c("nw"), c("nx") - c("n"), c("na") - c("nw")) > BAR))
    for r in tied.join(begun.withColumnRenamed("next", "whole"), ["lang", "whole"], "left_anti").select("lang", "word", "whole").toLocalIterator():
        out[r["lang"]].pairs.add((r["word"], r["whole"]))
    return out


#: A word, a pair or a start counts from so many occurrences.
LEAST = 3
#: The log-likelihood ratio from which a difference is significant.
BAR = 7.88


def _ratio(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """``likelihood`` over columns."""
    ll = lambda k, n, p: k * F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))) + (n - k) * F.log(1 - F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12)))
    p = (a + b) / (na + nb)
    return F.when((na > 0) & (nb > 0), 2 * (ll(a, na, a / na) + ll(b, nb, b / nb) - ll(a, na, p) - ll(b, nb, p))).otherwise(0.0)


_OPEN = {"“": "”", "「": "」", "『": "』", "«": "»", "„": "“", "‘": "’", '"': '"', "《": "》"}
_CLOSE = "”」』»\"’)]）】》"
_BRACKET = {"(": ")", "[": "]", "【": "】", "（": "）"}
_EVENT = re.compile(r"[.。!?।؟｡\n\"“「『«„(\[【（ ]")
_CJ = r"[ぁ-ヿ㐀-鿿ก-๛々〇]"
_FILL = re.compile(rf"(?:(?:{speech._HES}|就是说|那个|you know|그러니까|este|ben|えーと|あのー|うーん)[ ,，、]*|{speech.TIME}\s*|{speech.ANNOTATION}\s*)*", re.I)
_FILE = re.compile(r"[A-Za-z_\-]*\d+$")
_PREV = re.compile(rf"(?:{WORD}|\d[\d.,:]*)$")
_NEXT = re.compile(rf" *[\"“«„¿¡(]*({WORD}|\d+)?")
_EXT = re.compile(r"[a-z]{2,4}\d?(?![A-Za-z])")


class Splitter:
    """Sentence starts of a text, given the learnt statistics."""

    def __init__(self, know: dict[str, Language]) -> None:
        self.know = know

    def period(self, v: str, at: int, begin: int, know: Language) -> bool:
        """Whether the period at ``at`` ends the sentence that began at ``begin``."""
        after = v[at + 1 : at + 2]
        before = v[at - 1 : at] if at > begin else ""
        if after == "." or before == ".":  # an ellipsis ends nothing
            return False
        if not before or before in " (":
            return False
        if after.isdigit() and before.isdigit():
            return False
        if not (before.isascii() and before.isalnum()) and not _CASED.match(before):
            return True
        back = at  # where the token before the period may begin
        while back > begin and (v[back - 1] in "'’-.,:_" or v[back - 1].isalnum()):
            back -= 1
        m = _PREV.search(v, back, at)
        prev = m[0] if m else before
        nxt = _NEXT.match(v, at + 1)
        word = nxt[1] or ""
        if after and after != " " and after not in _CLOSE:
            # no blank: a file name, an inner period, or a sentence set close
            if _CASED.match(after):
                if _FILE.search(v, back, at) and _EXT.match(v, at + 1) and word.lower() not in know.starters:
                    return False
                if len(prev) == 1 and prev.isalpha() and (len(word.split(".")[0]) == 1):
                    return False
                if m and len(m[0].rsplit(".", 1)[-1]) == 1 and m[0][-1].isalpha() and len(word) <= 2:
                    return False
            elif after in ",;:)":
                return False
        low = prev.lower()
        if low.replace(".", "").replace(",", "").isdigit():
            if ("#", word.lower()) in know.pairs and word[:1].isupper():
                return False
            return True
        if len(low.rsplit(".", 1)[-1]) == 1 and "." not in low and low.isalpha():
            return False
        if low not in know.short:
            # a collocation goes on over its period
            return not (word[:1].isupper() and (low, word.lower()) in know.pairs)
        if not word:
            return not _is_wide(v[at + 1 :].lstrip(" ")[:1])
        share = know.short[low]
        if word[0].isdigit():
            return 0.05 < share < 0.98
        starts = word.lower().split(".")[0] in know.starters
        shout = len(word) > 1 and word.isupper() and prev.replace(".", "").isupper()
        small = word[0].islower() or shout
        if small:
            # only in a text without case can a small letter start a sentence here
            caseless = shout or v[begin:at] == v[begin:at].lower()
            return bool(caseless and starts and share >= 0.3)
        return share > 0.02 and (starts or word.lower().split(".")[0] in know.common)

    def starts(self, text: str) -> list[int]:
        """Places in ``text`` of the first character of each sentence."""
        v, pos = speech.view(text)
        lang = language(v) if _CASED.search(v) else "en"
        know = self.know.get(lang) or Language()
        head, _, _ = speech.heads(v)
        n, begin, i = len(v), 0, head
        cuts = [0]
        quiet: list[tuple[int, int]] = [m.span() for m in speech._TIMES.finditer(v, head)] if ":" in v[head:] or "'" in v[head:] or "<" in v[head:] else []
        while m := _EVENT.search(v, i):
            at, c = m.start(), m[0]
            i = at + 1
            if quiet and any(a <= at < b for a, b in quiet):
                continue
            if c == "\n":
                end = True
            elif c in _BRACKET:
                close = v.find(_BRACKET[c], at)
                line = v.find("\n", at)
                if close != -1 and (line == -1 or close < line):
                    i = close + 1
                continue
            elif c in _OPEN:
                close = v.find(_OPEN[c], at + 1)
                line = v.find("\n", at)
                if close == -1 or (line != -1 and close > line):
                    continue
                i = close + 1
                inside = v[close - 1 : close] if v[close - 1 : close] != " " else v[at:close].rstrip(" ")[-1:]
                rest = v[i:].lstrip(" ")[:1]
                opening = v[max(begin, head if begin == 0 else begin) : at].strip(" ")
                opening = opening[_FILL.match(opening).end() :]
                if inside not in "。.!?।؟" or not inside or not opening or rest in ",，、;；." or not rest:
                    if rest == "" or rest == "\n":
                        continue
                    if opening and opening[-1] in ":,：，" and inside not in "。.!?।؟":
                        continue
                    if rest == "." and opening:
                        continue
                    # a quotation that opens the sentence goes on after it
                    continue
                end = opening[-1] in ":：,，"
                if not end:
                    continue
            elif c == " ":
                left, right = v[at - 1 : at], v[at + 1 : at + 2]
                end = self.blank(v, at, begin, left, right)
                if not end:
                    continue
            elif c == ".":
                if not self.period(v, at, begin, know):
                    continue
                end = True
            else:
                if c in "!?" and v[at + 1 : at + 2] in "!?":
                    continue
                end = True
            if end:
                while i < n and v[i] in _CLOSE and not (v[i] == '"' and v.count('"', begin, i) % 2 == 0):
                    i += 1
                nxt = i
                while nxt < n and v[nxt] in " \n":
                    nxt += 1
                if nxt >= n:
                    break
                # marks alone make no sentence; they belong to what follows
                if speech_free(v[begin if begin else 0 : i]):
                    i = max(i, nxt) if c == "\n" else i
                    continue
                h, _, _ = speech.heads(v, nxt)
                if speech_free(v[nxt:]) and not re.search(r"\w", v[h:]):
                    break
                cuts.append(nxt)
                begin = nxt
                i = max(i, h if h > nxt else nxt)
        first = len(v) - len(v.lstrip(" \n"))
        cuts[0] = first
        if not v.strip(" \n"):
            return []
        return [pos[x] for x in cuts] if pos else cuts

    @staticmethod
    def blank(v: str, at: int, begin: int, left: str, right: str) -> bool:
        """Whether a blank parts two statements of a script without blanks."""
        if not left or not right:
            return False
        if re.match(_CJ, right) or right in "“「『（(【":
            if re.match(_CJ, left) or left in "”」』":
                pass
            elif left.isdigit():
                # a number written into the statement, not one set off by blanks
                token = re.search(r"[\d.,:]+$", v[begin:at])
                if not token or not re.match(_CJ, v[begin + token.start() - 1 : begin + token.start()] or " "):
                    return False
            else:
                return False
            opening = v[begin:at].strip(" ")
            opening = opening[_FILL.match(opening).end() :]
            if not opening:
                return False
            if left in "”」』" and not re.match(_CJ, right):
                return True
            if left in "”」』":
                # a quotation that opens the statement goes on behind it
                q = max(opening.rfind("“"), opening.rfind("「"), opening.rfind("『"))
                return q > 0
            return True
        return False


def _is_wide(c: str) -> bool:
    return bool(c) and bool(re.match(_CJ, c))


_LETTER = re.compile(r"[^\W_]")


def speech_free(v: str) -> bool:
    """True if a piece holds marks and signs only."""
    h = speech.heads(v)[0]
    rest = v[h:]
    if not _LETTER.search(rest):
        return True
    if not any(c in rest for c in "[(<*【（"):
        return False
    return not _LETTER.search(speech._NOTES.sub(" ", speech._TIMES.sub(" ", rest)))


def split(df: DataFrame, col: str, know: dict[str, Language]) -> DataFrame:
    """``df`` with ``starts``, the places of the sentences of ``col`` (null for
    null, empty for a text of blanks); ``col`` itself is dropped."""
    rest = df.drop("starts")
    at = rest.columns.index(col)
    kept = [f for f in rest.schema.fields if f.name != col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Splitter(know)
        for b in batches:
            found = [None if t is None else s.starts(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at] + [pa.array(found, pa.list_(pa.int32()))], names=[f.name for f in kept] + ["starts"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return rest.mapInArrow(run, StructType([*kept, StructField("starts", ArrayType(IntegerType()))]))


def sentences(hyp_a: DataFrame, hyp_b: DataFrame) -> DataFrame:
    """(stream_id, idx, field, start_char): every sentence of both transcripts,
    by the place of its first character that isn't blank, without utterances
    whose first transcript holds nothing spoken. Null and blank texts have no
    sentence; repeated deliveries count once; texts are taken whole."""
    key = [F.col("stream_id").cast("long").alias("stream_id"), F.col("idx").cast("int").alias("idx")]
    there = "stream_id is not null and idx is not null"
    a = hyp_a.select(*key, F.col("asr_dec_preds").alias("text")).where(there)
    b = hyp_b.select(*key, F.col("asr_sensevoice_result.preds").alias("text")).where(there)
    know = learnt(a.select("text").unionByName(b.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Splitter(know)
        for x in batches:
            texts = x.column(2).to_pylist()
            said = [bool(t) and speech.parsed(t)[0] for t in texts]
            found = [s.starts(t) if ok else None for t, ok in zip(texts, said)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(said), pa.array(found, pa.list_(pa.int32()))], names=["stream_id", "idx", "said", "starts"])

    # the first transcript is read once: its sentences, or that it says nothing
    mine = a.mapInArrow(run, "stream_id long, idx int, said boolean, starts array<int>")
    out_a = mine.where("said").select("stream_id", "idx", F.lit("asr_dec_preds").alias("field"), "starts")
    silent = mine.where("not said").select("stream_id", "idx").distinct()
    out_b = split(b.where("text is not null"), "text", know).join(silent, ["stream_id", "idx"], "left_anti").select("stream_id", "idx", F.lit("asr_sensevoice_result").alias("field"), "starts")
    one = out_a.unionByName(out_b).dropDuplicates(["stream_id", "idx", "field"])
    return one.select("stream_id", "idx", "field", F.explode("starts").alias("start_char"))
