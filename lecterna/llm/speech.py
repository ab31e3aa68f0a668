"""Marks in transcripts: time marks, speaker labels, sound annotations and
hesitations, found in any width, with invisible characters or look-alikes
among them."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that are drawn like a Latin letter, and other signs drawn like the usual one.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U",
    "ѵ": "v", "Ѵ": "V", "Ԍ": "G", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓳ": "O", "ꓴ": "U",
    "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T",
}
#: Letters without a serif, drawn like each of several Latin letters; the word tells which.
AMBIGUOUS = {"ӏ": "lI", "Ӏ": "Il", "ꓲ": "Il"}
OTHER_ALIKES = {
    "‐": "-", "‑": "-", "−": "-", "∶": ":", "∣": "|", "ǀ": "|", "⁄": "/", "∕": "/", "‚": ",", "∙": "·", "⋅": "·", "ʼ": "’", "ɑ": "a", "ɡ": "g",
    "⺠": "民", "⻄": "西", "⻅": "见", "⻆": "角", "⻋": "车", "⻓": "长", "⻔": "门", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟", "⺟": "母", "⼾": "户", "⾼": "高",
}
#: Compatibility mappings that change what is seen.
_SEEN = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
_VISIBLE_CF = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


def ignorable(c: str) -> bool:
    """True for a character without any visible shape that isn't a blank."""
    o = ord(c)
    if o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2065) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF:
        return True
    kind = unicodedata.category(c)
    return (kind == "Cf" and o not in _VISIBLE_CF) or (kind == "Cc" and c not in "\n\r\t\x0b\x0c\x85")


def fold(c: str) -> str:
    """One character in its usual width and form; blanks as a space, line
    ends as a line feed, invisible characters as nothing."""
    if c in "\n\x0b\x0c\x85  \r":
        return "\n"
    if ignorable(c):
        return ""
    if c.isspace() or unicodedata.category(c) == "Zs":
        return " "
    if c in OTHER_ALIKES:
        return OTHER_ALIKES[c]
    if unicodedata.decomposition(c).startswith(_SEEN):
        return c
    return unicodedata.normalize("NFKC", c)


class _Same(dict):
    """For str.translate: one character for each, \\0 for an invisible one."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        f = fold(c)
        f = "\0" if f == "" else f if len(f) == 1 else c
        self[o] = f = LOOK_ALIKES.get(f) or AMBIGUOUS.get(f, f)[0]
        return f


_SAME = _Same()


def view(text: str) -> tuple[str, list[int] | None]:
    """``text`` with every character in its usual form and without invisible
    ones, and the place in ``text`` of each (None: the same)."""
    v = text.translate(_SAME)
    if "\0" not in v:
        return v, None
    return v.replace("\0", ""), [i for i, c in enumerate(v) if c != "\0"]


_CLOCK = r"\d+ ?: ?\d\d(?: ?: ?\d\d)?(?:[.,]\d+)?"
TIME = rf"""(?:\[ ?{_CLOCK} ?\]|【 ?{_CLOCK} ?】|\( ?{_CLOCK} ?\)|< ?\d+(?:\.\d+)? ?s ?>|{_CLOCK} ?-->(?: ?{_CLOCK})?|\d+ ?' ?\d\d ?")"""
_NUM = r"(?P<n{0}>\d+|[一二三四五六七八九十]+)"
_TEACHER = r"(?:t|teacher|lecturer|instructor|tutor|professor|老 ?师|教 ?师|讲 ?师|教 ?授|先生|선생님|profesora?|professeure?|lehrer(?:in)?)"
_SPEAKER = rf"(?:speaker|spk|发言人|说话人|話者|화자|sprecher|locuteur|hablante)[ _]?{_NUM.format(1)}"
_STUDENT = rf"(?:student|stu|s|pupil|学生|同学|生徒|학생)[ _]?{_NUM.format(2)}"
LABEL = rf"(?:(?P<teacher>{_TEACHER})|(?P<speaker>{_SPEAKER})|(?P<student>{_STUDENT}))(?: ?[:|>]| -(?= ))"
_SOUNDS = r"(?:applause|clapping|laughter|laugh(?:s|ing)?|chuckles?|music|noise|background noise|cough(?:s|ing)?|sneezes?|sighs?|inaudible|unintelligible|crosstalk|silence|pause|bell(?: rings)?|door ?(?:closes|opens|slams)|chair scrapes|phone rings|pages? turning|writing on (?:the )?board)"
_SOUNDS_HAN = r"(?:[一-鿿]{0,6}声|音乐|噪音|杂音|静音|沉默|咳嗽|鼓掌|大笑|笑|听不清)"
ANNOTATION = rf"(?:[\[(<*【] ?(?:{_SOUNDS}|{_SOUNDS_HAN}) ?[\])>*】]|\[[a-z _一-鿿]{{2,20}}\]|<[a-z_一-鿿]{{2,12}}>|[♪♫]+)"
_HES = r"(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h*m+|a+h+|e+h+|eu+h+|heu+|[äÄ]+h+m*|嗯+|呃+|啊+|额|哦|唉|诶|唔|음+|어+|えー?っ?と?ー*|ええと|あのー+|うー+ん|んー+)"

_HEAD = re.compile(rf"\s*(?:{TIME}|{ANNOTATION}|{LABEL})\s*", re.I)
_TIMES = re.compile(TIME)
_NOTES = re.compile(ANNOTATION, re.I)
_LABELS = re.compile(rf"(?:^|(?<=\n))\s*{LABEL}", re.I)
# possessive: a long run of one sound has one reading, not one for every way to cut it
_BARE = re.compile(rf"(?:[\W_]*+(?>{_HES}(?![a-zäöü])))*+[\W_]*+", re.I)
_MARKS = re.compile(r"[\[(<*【\n]")
_HAN = {c: i for i, c in enumerate("零一二三四五六七八九")}


def _number(s: str) -> int:
    if s.isdigit():
        return int(s)
    if "十" not in s:
        return int("".join(str(_HAN[c]) for c in s))
    tens, _, ones = s.partition("十")
    return (_HAN[tens] if tens else 1) * 10 + (_HAN[ones] if ones else 0)


def heads(v: str, at: int = 0) -> tuple[int, str | None, bool]:
    """The marks that open ``v`` at ``at``: where the text begins, the label
    among them in its one spelling, and whether the last mark is an annotation."""
    label, note = None, False
    while m := _HEAD.match(v, at):
        if m.end() == at:
            break
        if label is not None and (m["teacher"] or m["speaker"] or m["student"]):
            break
        if m["teacher"]:
            label = "teacher"
        elif m["speaker"]:
            label = f"speaker {_number(m['n1'])}"
        elif m["student"]:
            label = f"student {_number(m['n2'])}"
        note = not (m["teacher"] or m["speaker"] or m["student"])
        at = m.end()
    return at, label, note


def spoken(v: str) -> bool:
    """Whether a view holds something spoken beyond bare hesitation sounds."""
    rest = v[heads(v)[0] :]
    at = _BARE.match(rest).end()
    # a word that no mark opens and no label holds settles it
    if rest[at : at + 1].isalpha() and not _MARKS.search(rest, 0, at) and not _LABELS.match(rest):
        return True
    rest = _LABELS.sub(" ", _NOTES.sub(" ", _TIMES.sub(" ", rest)))
    return not _BARE.fullmatch(rest)


def parsed(text: str | None) -> tuple[bool, str | None]:
    """(something is spoken, label) of a transcript; null and empty texts hold nothing."""
    if not text:
        return False, None
    v = view(text)[0]
    return spoken(v), heads(v)[1]


_FILLED = re.compile(rf"(?<![\w])(?:{_HES}|就是说|那个|you know|그러니까|este|ben)(?![a-zäöüáéíóúñ가-힣])[,，、]?\s*", re.I)
_FILLED_HAN = re.compile(r"(?:(?<=[。！？!?\n，,：:“])|^)(?:嗯+|呃+|啊)[,，、]?")


def cleaned(text: str | None) -> str:
    """The spoken words of a transcript: without time marks, labels, sound
    annotations and hesitations, in its own characters otherwise."""
    if not text:
        return ""
    v, pos = view(text)
    cut = [(0, heads(v)[0])]
    for p in (_TIMES, _NOTES, _LABELS, _FILLED_HAN):
        cut += [m.span() for m in p.finditer(v)]
    cut += [m.span() for m in _FILLED.finditer(v)]
    drop = bytearray(len(v))
    for a, b in cut:
        drop[a:b] = b"\1" * (b - a)
    at = pos or range(len(v))
    out = "".join(text[at[i]] for i in range(len(v)) if not drop[i])
    return re.sub(r"[ \t]{2,}", " ", out).strip()
