"""Text quality: statistics of each document and, from them, its kind.

Running prose, list, table or junk is decided by gradient-boosted trees on the
statistics. Two tables learnt from all documents feed them: how usual the
character pairs are, and which words (or character pairs) speak for statements
rather than items. The trees are fitted on a bounded sample of documents with
weak labels by structure (``SAMPLE`` rows, the smallest by hash), with the same
texts broken on purpose as junk, and calibrated on a hand-checked holdout.

Scale: three narrow passes over the documents, of which that for the sample reads
texts below a hash bound only; the tables have ``SLOTS`` hashed counters whatever
the corpus holds, added up in the tasks before the shuffle. Characters are counted
by translation to classes and by NumPy over code points.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecterna.llm import speech
from lecterna.llm.boosting import Boosted
from lecterna.llm.holdout import HOLDOUT
from lecterna.plans.lineage import written

KINDS = ["prose", "list", "table", "junk"]
SLOTS = 1 << 18
#: Weakly labelled documents on which the trees are fitted.
SAMPLE = 6000

_BULLET = re.compile(r"\s*(?:[-–—*•·▪◦●○■□‣+]\s|\(?\d{1,3}[.)、:）]\s*(?!\d)|\d{1,3}\s+(?=\D)|[a-zA-Z][.)]\s|第\d+项|[①-⑳]|[（(]\d+[)）])")
_TERMINAL = ".。!?！？؟।…"
_SEPARATORS = [";", "；", "、", "，", ",", " / ", " | ", "·", "•"]
_GLOSS = re.compile(r"^[^.。!?！？|\t]{1,60}?\s?(?: - | — | – | = |[:：]|→)\s?[^.。!?！？|\t]{1,60}$")
_CELL = re.compile(r"^\s*[\"']?(?:[\d.,:%\-]+|)[\"']?\s*$")
_WORDS = re.compile(r"[\wऀ-ॿ฀-๿]+")
_NOT_LETTERS = re.compile(r"(?:(?![ऀ-ॿ฀-๿؀-ۿ])[\d\W_])+")
_TAG = re.compile(r"</?(?:tr|td|th|table|tbody|li|ul|ol)\b[^>]*>", re.I)
_TERMINALS = re.compile(r"[。!?！？؟।]|\.(?=\s|$)")
#: Letters of spaced scripts, and signs of scripts without blanks.
_SPACED = "A-Za-zÀ-ɏͰ-Ͽ؀-ۿЀ-ӿऀ-ॿ가-힣"
_PIECE = re.compile(rf"[{_SPACED}]+")
_KINDS = np.zeros(0x10000, np.uint8)
for _a, _b in (("A", "Z"), ("a", "z"), ("À", "ɏ"), ("Ͱ", "Ͽ"), ("؀", "ۿ"), ("Ѐ", "ӿ"), ("ऀ", "ॿ"), ("가", "힣")):
    _KINDS[ord(_a) : ord(_b) + 1] = 1
for _a, _b in (("぀", "ヿ"), ("㐀", "鿿"), ("฀", "๿")):
    _KINDS[ord(_a) : ord(_b) + 1] = 2


class _Classes(dict):
    """For str.translate: l and u letters with case, a other letters, e and d
    digits that count as letters or not, s blanks, o signs of broken texts, x others."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        letter = c.isalpha() or "\u0300" <= c <= "\u036f" or "฀" <= c <= "๿" or "ऀ" <= c <= "ॿ"
        if c.isdigit():
            k = "e" if letter else "d"
        elif c.isspace():
            k = "s"
        elif "\x80" <= c <= "¿" and c not in "«»¿¡°±§·" or c == "\ufffd":
            k = "o"
        elif letter:
            k = "l" if c.islower() else "u" if c.isupper() else "a"
        else:
            k = "x"
        self[o] = k
        return k


_CLASSES = _Classes()


def points(v: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A slot for each pair of code points."""
    h = a * np.uint32(0x9E3779B1) ^ (b + np.uint32(1)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 18)).astype(np.int64)


def _slot(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & (SLOTS - 1)


_memo: dict[str, int] = {}


def slots(parts: list[str]) -> np.ndarray:
    out = np.empty(len(parts), np.int64)
    for i, p in enumerate(parts):
        k = _memo.get(p)
        if k is None:
            k = _slot(p if not "가" <= p[0] <= "힣" else "~" + p[-2:])
            if len(_memo) < 500_000:
                _memo[p] = k
        out[i] = k
    return out


def pairs_of(v: str) -> np.ndarray:
    """Slots of the character pairs of letters and blanks, lower case."""
    cp = points(_NOT_LETTERS.sub(" ", v.lower()))
    return _mixed(cp[:-1], cp[1:])


def units(v: str) -> tuple[np.ndarray, np.ndarray]:
    """(slot, line) of the words of spaced scripts (of Korean ones the endings) and
    of the character pairs of the others; the line of a pair across lines is -1."""
    v = v.lower()
    cp = points(v)
    kind = np.where(cp < 0x10000, _KINDS[np.minimum(cp, 0xFFFF)], 0)
    line = np.cumsum(cp == 10)
    word = kind == 1
    begin = np.nonzero(word & ~np.r_[False, word[:-1]])[0]
    own, at = slots(_PIECE.findall(v)), line[begin]
    wide = np.nonzero(kind == 2)[0]
    if len(wide) > 1:
        # signs follow each other if no word lies between them
        after = np.cumsum(word)[wide]
        m = after[1:] == after[:-1]
        first, second = wide[:-1][m], wide[1:][m]
        own = np.r_[own, _mixed(cp[first], cp[second])]
        at = np.r_[at, np.where(line[first] == line[second], line[second], -1)]
    return own, at


def variety(v: str) -> float:
    """Distinct character quadruples by place."""
    if len(v) < 4:
        return 0.0
    cp = points(v).astype(np.uint64)
    h = ((cp[:-3] << np.uint64(42)) | (cp[1:-2] << np.uint64(21)) | cp[2:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ cp[3:] * np.uint64(0xD6E8FEB86659FD93)
    return len(np.unique(h)) / (len(v) - 3)


def lines_of(v: str) -> list[str]:
    return [x for x in v.split("\n") if x.strip()]


#: (sign that must occur, how a row is cut)
_CUTS = [("\t", None), ("|", re.compile(r"\s*\|\s*")), (";", None), (",", None), ("  ", re.compile(r"[ ]{2,}")), ("</t", re.compile(r"</t[dh]>"))]


def table_shape(lines: list[str], also_without_first: bool = False) -> tuple[float, float, float]:
    """(share of the text in rows of the commonest cell count, cells a row, share
    of short or numeric cells); with ``also_without_first``, of the lines without the
    first one if their share is larger."""
    best = (0.0, 0.0, 0.0)
    if len(lines) < 2:
        return best
    size = np.array([len(x) for x in lines])
    for sign, cut in _CUTS:
        if not any(sign in x for x in lines):
            continue
        bare = [x.strip(" ").strip("|").strip(" ") if sign == "\t" else x.strip().strip("|").strip() for x in lines]
        cells = [x.split(sign) if cut is None else cut.split(x) for x in bare]
        count = np.array([len(c) for c in cells])
        for first in (0, 1) if also_without_first and len(lines) > 2 else (0,):
            n = Counter(k for k in count[first:].tolist() if k > 1)
            if not n:
                continue
            k, _ = max(n.items(), key=lambda z: (z[1] * (z[0] > 2) or z[1] * 0.5, z[0]))
            rows = np.nonzero(count[first:] == k)[0] + first
            share = float(size[rows].sum() / size[first:].sum())
            if share <= best[0]:
                continue
            flat = [c for r in rows for c in cells[r]]
            plain = sum(bool(_CELL.match(c)) for c in flat) / len(flat)
            if k > 2 or plain > 0.2:
                best = (share, float(k), plain)
    return best


NAMES = (
    "chars words word_length symbols digits letters blanks lines line_length line_spread bullets ended glossed repeated "
    "table_share table_cells table_plain tags segments segment_length segment_spread numbered_tail labelled terminals common "
    "usual usual_low speaks speaks_body speaks_lines odd_letters variety longest quotes upper_inside item_mass first_ends comma_rate"
).split()


class Measurer:
    """Statistics of a text, given the two learnt tables."""

    def __init__(self, usual: np.ndarray, odds: np.ndarray) -> None:
        self.usual, self.odds = usual, odds

    def __call__(self, text: str) -> list[float]:
        v = speech.view(text)[0]
        n = max(1, len(v))
        every = v.split("\n")
        there = [i for i, x in enumerate(every) if x.strip()]
        lines = [every[i] for i in there]
        words = _WORDS.findall(v)
        body = lines[1:] if len(lines) > 3 else lines
        kinds = v.translate(_CLASSES)
        both = kinds.count("e")
        letters = kinds.count("l") + kinds.count("u") + kinds.count("a") + both
        digits, blanks = kinds.count("d") + both, kinds.count("s")
        size = np.array([len(x) for x in lines] or [0], float)
        total = max(1.0, size.sum())
        bullets = [bool(_BULLET.match(x)) for x in lines]
        ended = [x.rstrip()[-1:] in _TERMINAL or x.rstrip()[-2:-1] in _TERMINAL and x.rstrip()[-1:] in "\"”’」』»)" for x in lines]
        gloss = sum(bool(_GLOSS.match(x)) for x in body)
        share, cells, plain = table_shape(lines, True)
        tags = sum(len(m) for m in _TAG.findall(v)) / n if "<" in v else 0.0
        flat = v.replace("\n", " ")
        seg, seg_len, spread = 1, float(len(flat)), 0.0
        for s in _SEPARATORS:
            if flat.count(s) >= seg:
                ls = np.array([len(p.strip()) for p in flat.split(s)], float)
                seg, seg_len, spread = len(ls), float(ls.mean()), float(ls.std() / max(ls.mean(), 1))
        tail = len(re.findall(r"\(\d{1,3}\)", v)) / max(1, max(len(lines), seg)) if "(" in v else 0.0
        labelled = sum(speech.heads(x)[1] is not None for x in lines) / max(1, len(lines))
        terminals = len(_TERMINALS.findall(v))
        ps = pairs_of(v)
        lp = self.usual[ps] if len(ps) else np.full(1, 4.0)  # nothing to tell
        us, at = units(v)
        od = self.odds[us] if len(us) else np.zeros(1)
        # the mean of each line of the body
        m = at >= 0
        hits = np.bincount(at[m], minlength=len(every)) if len(us) else np.zeros(len(every))
        sums = np.bincount(at[m], od[m], minlength=len(every)) if len(us) else np.zeros(len(every))
        own = np.array(there[len(lines) - len(body) :], int)
        per_a = sums[own] / np.maximum(hits[own], 1) if len(own) else np.zeros(1)
        per_mass = np.array([len(x) for x in body] or [1], float)
        lengths = [len(w) for w in words]
        item = sum(s for s, b, e in zip(size, bullets, ended) if b or not e and s < 40) / total
        return [
            math.log(n), math.log1p(len(words)), sum(lengths) / max(1, len(words)), (n - letters - digits - blanks) / n, digits / n, letters / n, blanks / n,
            math.log(max(1, len(lines))), float(size.mean()), float(size.std() / max(1, size.mean())), sum(bullets) / max(1, len(lines)), sum(ended) / max(1, len(lines)), gloss / max(1, len(body)), 1 - len(set(lines)) / max(1, len(lines)),
            share, cells, plain, tags, math.log(seg), min(seg_len, 500.0), spread, min(tail, 2.0), labelled, terminals / n * 100, float((od > 1).mean()),
            float(lp.mean()), float(np.quantile(lp, 0.2)), float(od.mean()), float((per_a * per_mass).sum() / per_mass.sum()), float(((per_a > 0) * per_mass).sum() / per_mass.sum()), kinds.count("o") / n, variety(v), float(max(lengths, default=0)),
            sum(v.count(q) for q in "\"“”«»「」") / n, kinds.count("lu") / n, item, float(bool(ended[0])) if ended else 0.0, sum(v.count(q) for q in ",，、") / n * 100,
        ]


_BASE64 = re.compile(r"[A-Za-z0-9+/=\n]{40,}")


def weak(text: str) -> str | None:
    """A label by plain structure, where it is beyond doubt; else None."""
    v = speech.view(text)[0]
    lines = lines_of(v)
    if len(v.strip()) < 12 or not lines:
        return None
    kinds = v.translate(_CLASSES)
    letters = (kinds.count("l") + kinds.count("u") + kinds.count("a") + kinds.count("e")) / len(v)
    digits = (kinds.count("d") + kinds.count("e")) / len(v)
    if (letters < 0.3 and digits < 0.15 and "।" not in v) or (len(v) > 40 and len(lines) < 3 and variety(v) < 0.15) or _BASE64.fullmatch(v) and re.search(r"[a-z][A-Z]\w*\d", v):
        return "junk"
    terminals = len(_TERMINALS.findall(v))
    body = lines[1:] if len(lines) > 3 else lines
    share, cells, plain = table_shape(body)
    if len(body) >= 3 and share > 0.95 and cells >= 3 and (plain > 0.2 or _TAG.search(v) or "|---" in v):
        return "table"
    if len(body) >= 3 and all(_BULLET.match(x) for x in body) and max(map(len, body)) < 70 and (terminals <= 1 or sum(map(len, body)) / len(body) < 26):
        return "list"
    if len(lines) == 1 and terminals == 0:
        for s in (";", "；", "、", " / "):
            if v.count(s) >= 4 and max(len(p.strip()) for p in v.split(s)) < 45:
                return "list"
    thai = sum("฀" <= c <= "๿" for c in v) / len(v) if terminals == 0 else 0
    if thai > 0.6 and not any(_BULLET.match(x) for x in lines) and share < 0.5 and not re.search("[;,、，；/|(]", v) and len(v) / len(v.split()) > 14:
        return "prose"
    if terminals >= 3 and not any(_BULLET.match(x) for x in lines) and share < 0.5 and len(v) / terminals < 160 and letters > 0.6 and not re.search("[\x80-\x9f]", v):
        return "prose"
    return None


def _items(text: str) -> list[str]:
    v = speech.view(text)[0]
    lines = lines_of(v)
    if len(lines) > 2:
        return [re.sub(r"\s*\(\d+\)$", "", _BULLET.sub("", x)).strip(" ;.；。") for x in lines]
    return [re.sub(r"\s*\(\d+\)$", "", x).strip() for s in (";", "；", "、", " / ") for x in v.split(s) if v.count(s) >= 4]


def _statements(text: str) -> list[str]:
    v = speech.view(text)[0]
    return [x.strip() for x in re.split(r"(?<=[。!?！？؟।])\s*|(?<=\.)\s+|\n", v) if len(x.strip()) > 3]


def broken(text: str, g: np.random.Generator) -> str:
    """A junk text made of a natural one."""
    k = int(g.integers(0, 12))
    t = text[: int(g.integers(30, 700))]
    wide = sum(not c.isascii() for c in t) > 0.3 * len(t)
    if k in (0, 9, 10):
        cs = list(t)
        g.shuffle(cs)
        return "".join(cs)
    if k == 11:
        return "".join(x[: int(g.integers(1, 3))] + "�" * int(g.integers(0, 4)) for x in re.split(r"(?<=[。.!?！？，, ])", t) for _ in range(2))
    if k == 1:
        return " ".join("".join(chr(97 + int(z)) for z in g.integers(0, 26, int(g.integers(2, 10)))) for _ in range(int(g.integers(6, 60))))
    if k == 2:
        return t.encode("utf-8", "ignore").decode("latin-1") if wide else t[:7] * 20
    if k == 3:
        return t.encode("utf-8", "ignore").decode(["cp1251", "cp1252", "cp437", "koi8-r"][int(g.integers(0, 4))], "ignore") if wide else (t[:2] + "��") * 3 + "".join(w[:2] + "�" * int(g.integers(0, 3)) for w in t.split())
    if k == 4:
        at = int(g.integers(0, max(1, len(t) - 8)))
        p = t[at : at + int(g.integers(1, 8))].replace("\n", " ")
        return (p + (" " if g.random() < 0.4 else "")) * int(g.integers(15, 80))
    if k == 5:
        return "".join(g.choice(list("~#@%^&*_=+|\\/<>§¤°±!?- "), int(g.integers(20, 500))))
    if k == 6:
        return "".join(g.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), int(g.integers(40, 500))))
    if k == 7:
        return "".join(g.choice(list("丨丿一乀乙口日曰田囗凵匚lI1|_-~,.'`rnmu\n "), int(g.integers(30, 200))))
    ws = t.split(" ")
    if len(ws) > 5:
        return " ".join("".join(g.permutation(list(w))) for w in ws)
    cs = list(t)
    g.shuffle(cs)
    return "".join(cs)


def tables_of(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(how usual each character pair is, how each unit speaks for statements)
    as arrays of ``SLOTS`` log scores, from all texts of a one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((3, SLOTS), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if not t or not t.strip():
                    continue
                kind = weak(t)
                if kind in ("prose", "list"):
                    v = speech.view(t)[0]
                    np.add.at(c[0], pairs_of(v), 1)
                    if kind == "list":
                        v = "\n".join(_items(t))
                    np.add.at(c[1 if kind == "prose" else 2], units(v)[0], 1)
        for k in range(3):
            at = np.nonzero(c[k])[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(c[k, at])], names=["k", "slot", "n"])

    c = np.zeros((3, SLOTS))
    for r in docs.mapInArrow(run, "k int, slot long, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        c[r["k"], r["slot"]] = r["n"]
    usual = np.log((c[0] + 0.05) / (c[0].sum() + 0.05 * SLOTS)) + math.log(SLOTS)
    p = (c[1] + 0.3) / (c[1].sum() + 0.3 * 5000)
    q = (c[2] + 0.3) / (c[2].sum() + 0.3 * 5000)
    odds = np.where(c[1] + c[2] > 0, np.clip(np.log(p / q), -5, 5), 0.0)
    return usual, odds


#: Texts of each kind from which learning starts where the documents hold none of it.
SEEDS = {
    "prose": "We met at the gate in the morning. The road was dry, so we took the bicycles. Nobody was late.",
    "list": "- rope\n- two lamps\n- dry socks\n- a map",
    "table": "day,room,hour\nMon,12,9:00\nTue,14,10:30\nWed,12,8:15",
}


def trained(docs: DataFrame, usual: np.ndarray, odds: np.ndarray, sample: int = SAMPLE) -> Boosted:
    """The kind model, fitted on at most ``sample`` weakly labelled texts and texts
    made of them. Labels are sought among the texts of the smallest hashes, about
    eight times ``sample`` of them; of each kind those of the smallest hashes are taken."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            kinds = [weak(t) for t in texts]
            m = pa.array([k is not None for k in kinds])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), pa.array(kinds, pa.string()).filter(m)], names=["text", "kind"])

    n = docs.count()
    part = min(1.0, 8 * sample / max(n, 1))
    some = docs.where("text <> ''")
    if part < 1:
        some = some.where(F.xxhash64("text") < F.lit(int(-(2**63) + part * 2**64)))
    labelled = written(some.mapInArrow(run, "text string, kind string").dropDuplicates(["text"]), "labelled")
    # the smallest hashes of each kind: a fixed sample, whatever the order of the rows
    rows = []
    for kind in KINDS:
        rows += [(r["text"], kind) for r in labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("text"), "text").limit(sample // (1 if kind == "prose" else 3) // 2).collect()]
    # structure alone takes broken texts and items with full stops for prose: their words speak against it
    m = Measurer(usual, odds)
    at = {k: NAMES.index(k) for k in ("usual", "speaks")}
    sure = lambda t: (x := m(t))[at["usual"]] > 1.2 and x[at["speaks"]] > 0 and "�" not in t
    rows = [(t, k) for t, k in rows if k != "prose" or sure(t)]
    g = np.random.default_rng(3)
    prose = [t for t, k in rows if k == "prose"] or [SEEDS["prose"]]
    lists = [t for t, k in rows if k == "list"] or [SEEDS["list"]]
    tables = [t for t, k in rows if k == "table"] or [SEEDS["table"]]
    made: list[tuple[str, str]] = []
    for i in range(len(prose)):
        made.append((broken(prose[i], g), "junk"))
        st = _statements(prose[i])
        if len(st) > 1:
            bare = [re.sub(r"[.。!?！？؟।,，、]+$", "", x) for x in st[: int(g.integers(1, 9))]]
            made.append(("\n".join(bare), "prose"))
            made.append((" ".join(re.sub(r"[,，、]", "", x) for x in bare), "prose"))
            made.append((st[0], "prose"))
            it = [x for x in _items(lists[int(g.integers(0, len(lists)))]) if x]
            if it:
                few = "\n".join("- " + x for x in it[:3])
                made.append(("\n".join([" ".join(st[:4]), few, " ".join(st[4:12] or st[:3])]), "prose"))
                head = re.sub(r"[.。!?！？]$", "", st[0])
                dot = ["", "", ".", "。", ";"][int(g.integers(0, 5))]
                made.append((head + ("：" if "一" <= head[:1] <= "鿿" else ":") + "\n" + "\n".join(x + dot for x in it), "list"))
            made.append((min(st, key=len), "prose"))
            if i % 2 == 1:
                w = int(g.integers(1, 6))
                d = [",", "\t", ";", " | ", "   ", "\t", "   "][int(g.integers(0, 7))]
                grid = [[re.sub(r"[.。!?！？,，;]+$", "", st[z % len(st)])] + [f"{int(g.integers(8, 17))}:{int(g.integers(10, 60))}" if g.random() < 0.5 else str(int(g.integers(1, 999))) if g.random() < 0.6 else it[z % len(it)] if it else "-" for _ in range(w)] for z in range(int(g.integers(2, 12)))]
                if g.random() < 0.5:
                    grid.insert(0, [f"{['col', 'C', '列', 'No '][int(g.integers(0, 4))]}{z + 1}" for z in range(w + 1)])
                if d == "   ":
                    pad = [max(len(r[c]) for r in grid) for c in range(w + 1)]
                    grid = [[x.ljust(p) for x, p in zip(r, pad)] for r in grid]
                made.append((("" if g.random() < 0.6 else st[0] + "\n") + "\n".join(d.join(r) for r in grid), "table"))
            if i % 3 == 0:
                made.append((st[0] + "\n" + tables[int(g.integers(0, len(tables)))], "table"))
    for t in lists:
        it = [x for x in _items(t) if x]
        if len(it) < 3:
            continue
        it = it[: int(g.integers(4, 40))]
        sep = ["、", "，", "; ", ", ", " / ", " · ", "；", "，"][int(g.integers(0, 8))]
        made += [("\n".join(it), "list"), (sep.join(it), "list"), ("\n".join(f"{a}{s}{b}" for a, b, s in zip(it, it[::-1], [[" - ", " = ", "：", " — ", ": "][int(g.integers(0, 5))]] * len(it))), "list"), ("\n".join(x + ";" for x in it), "list"), ("\n".join(x + ("。" if "一" <= x[:1] <= "ヿ" or "一" <= x[-1:] <= "鿿" else ".") for x in it), "list")]
        mark, dot = ["- ", "• ", "▪ ", "· ", "* ", "(#) ", "#. ", "#) ", "# ", "第#项 "][int(g.integers(0, 10))], [".", "。", ";", "；", ""][int(g.integers(0, 5))]
        made.append(("\n".join(mark.replace("#", str(z + 1)) + x + dot for z, x in enumerate(it)), "list"))
        w = int(g.integers(3, 7))
        cell = lambda: it[int(g.integers(0, len(it)))] if g.random() < 0.5 else f"{int(g.integers(8, 17))}:{int(g.integers(10, 60))}" if g.random() < 0.5 else str(int(g.integers(1, 999)))  # noqa: E731, B023
        d = [",", "\t", ";", " | ", "  "][int(g.integers(0, 5))]
        made.append(("\n".join(d.join(cell() for _ in range(w)) for _ in range(int(g.integers(3, 20)))), "table"))
    rows += made
    rows = [(t, KINDS.index(k)) for t, k in rows if t.strip()]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Measurer(usual, odds)
        for b in batches:
            x = [own(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    spark = docs.sparkSession
    bounded = spark.createDataFrame(pa.table({"text": [t for t, _ in rows], "y": pa.array([k for _, k in rows], pa.int32())}), "text string, y int").repartition(spark.sparkContext.defaultParallelism)
    got = bounded.mapInArrow(measured, "x array<double>, y int").orderBy("y", "x").toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(NAMES))
    y = got.column("y").to_numpy()
    weight = 1 / np.bincount(y, minlength=4)[y]
    model = Boosted(4).fit(x, y, weight * len(y) / 4)
    model.rows = len(y)
    return model.calibrate(np.array([m(t) for _, t in HOLDOUT]), np.array([KINDS.index(k) for k, _ in HOLDOUT]))


def quality(df: DataFrame, id_col: str, text_col: str, *, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, kind, p_prose, and a column for each statistic) of every text
    of ``df`` that isn't null or blank. Repeated rows count once; texts of any
    length are measured whole; an empty table gives an empty result."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    cores = df.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)  # the work is in Python: a table of few files is spread over all cores
    usual, odds = tables_of(docs.select("text"))
    model = trained(docs.select("text"), usual, odds, sample)
    kind_of = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measurer(usual, odds)
        for b in batches:
            texts = b.column(1).to_pylist()
            ok = [bool(t.strip()) for t in texts]
            if not any(ok):
                continue
            x = np.array([m(t) for t, k in zip(texts, ok) if k])
            p = model.predict(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(ok)), pa.array([KINDS[i] for i in p.argmax(1)]), pa.array(np.round(p[:, 0], 6)), *[pa.array(x[:, j]) for j in range(x.shape[1])]],
                names=["doc_id", "kind", "p_prose", *NAMES],
            )

    return docs.mapInArrow(run, f"doc_id {kind_of}, kind string, p_prose double, " + ", ".join(f"{x} double" for x in NAMES)).dropDuplicates(["doc_id"])
