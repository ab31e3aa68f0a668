"""Sequential algorithms on one transcript: alignment, fusion, repairs, words.

Plain Python on token lists; ``operators.transcripts`` applies them in Arrow batches.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterable, Sequence

Segmenter = Callable[[str], list[str]]


def characters(text: str) -> list[str]:
    """The default segmenter: every character is a word."""
    return list(text)


def max_match(words: Iterable[str]) -> Segmenter:
    """A segmenter that takes the longest word of a dictionary at each place."""
    known = set(words)
    longest = max(map(len, known), default=1)

    def cut(text: str) -> list[str]:
        out, i = [], 0
        while i < len(text):
            n = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in known), 1)
            out.append(text[i : i + n])
            i += n
        return out

    return cut


def mixed_words(text: str, cut: Segmenter = characters) -> list[str]:
    """Words of a mixed text: ASCII runs as they are, the rest by ``cut``."""
    out: list[str] = []
    for part in text.split():
        for m in re.finditer(r"[!-~]+|[^\x00-\x7F]+", part):
            out += [m[0]] if m[0].isascii() else cut(m[0])
    return out


def blocks(a: str, b: str, least: int = 1) -> list[tuple[int, int, int]]:
    """Common blocks (place in a, place in b, length), the longest first; in
    texts of 200 characters and more, very frequent ones don't anchor a block."""
    m = difflib.SequenceMatcher(None, a, b, autojunk=True).get_matching_blocks()
    return sorted(((x.a, x.b, x.size) for x in m if x.size >= max(1, least)), key=lambda x: (-x[2], x[0]))


def fused(a: str, b: str, anchor: str, tolerance: int = 2) -> tuple[int, int] | None:
    """The stretch of ``a`` around a common block on which both texts go
    together: walking out in lock-step, it ends before ``tolerance`` mismatches in
    a row. None if the anchor isn't in both."""
    i, j = a.find(anchor), b.find(anchor)
    if i < 0 or j < 0 or not anchor:
        return None
    lo, miss, k = i, 0, 1
    while i - k >= 0 and j - k >= 0:
        if a[i - k] == b[j - k]:
            lo, miss = i - k, 0
        else:
            miss += 1
            if miss >= tolerance:
                break
        k += 1
    hi, miss, k = i + len(anchor), 0, 0
    p, q = i + len(anchor), j + len(anchor)
    while p + k < len(a) and q + k < len(b):
        if a[p + k] == b[q + k]:
            hi, miss = p + k + 1, 0
        else:
            miss += 1
            if miss >= tolerance:
                break
        k += 1
    return lo, hi


def best_fusion(a: str, b: str, least: int = 4) -> tuple[int, int] | None:
    """The longest fusion over all common blocks, the first on ties."""
    best: tuple[int, int] | None = None
    for i, _, n in blocks(a, b, least):
        f = fused(a, b, a[i : i + n])
        if f and (best is None or f[1] - f[0] > best[1] - best[0]):
            best = f
    return best


def doubled(text: str) -> list[str]:
    """Characters that stand twice in a row."""
    return re.findall(r"(\w)\1", text)


def repaired(a: str, b: str, *, whole_words: Iterable[str] = (), cut: Segmenter = characters) -> tuple[str, list[int]]:
    """``a`` with characters that it doubles and ``b`` doesn't put right from the
    context in ``b``; (text, places of ``a`` deleted), so that the times of its
    characters can follow. Characters of ``whole_words`` may be doubled. A pair that
    no rule explains loses its second character."""
    keep, out, gone = set(whole_words), list(a), set()
    at_or = lambda s, i: s[i] if 0 <= i < len(s) else ""
    for c in dict.fromkeys(doubled(a)):
        if c in doubled(b) or c in keep or c not in b:
            continue
        at = a.find(c + c)
        before, behind = at_or(a, at - 1), at_or(a, at + 2)
        for d in (i for i, x in enumerate(b) if x == c):
            if behind and behind == at_or(b, d + 1):
                gone.add(at + 1)
                break
            second = behind and behind == at_or(b, d + 2)  # the second one stands for another character
            first = before and d > 1 and before == at_or(b, d - 2)
            if second and first:
                words = cut(b[d - 1 : d + 2])
                if len(words) > 1 and len(words[0]) != len(words[1]):
                    second, first = len(words[0]) < len(words[1]), len(words[0]) > len(words[1])
            if second:
                out[at + 1] = b[d + 1]
                break
            if first:
                out[at] = b[d - 1]
                break
        else:
            gone.add(at + 1)
    return "".join(x for i, x in enumerate(out) if i not in gone), sorted(gone)


def deduplicated(tokens: Sequence[str], stamps: Sequence[tuple[int, int]], *, most: int = 2, least_ms: int = 1000, may_double: Iterable[str] = ()) -> list[int]:
    """Places kept: a Chinese token at most ``most`` times in a row (once, unless it may double); an English one not again within ``least_ms``."""
    double, out, n = set(may_double), [], 0
    for i, t in enumerate(tokens):
        same = i > 0 and tokens[i - 1] == t
        n = n + 1 if same else 1
        if re.fullmatch(r"[a-zA-Z']+", t):
            if same and stamps[i][0] - stamps[i - 1][1] < least_ms:
                continue
        elif n > (most if not double or t in double else 1):
            continue
        out.append(i)
    return out


def abbreviations(words: Sequence[str], stamps: Sequence[tuple[int, int]]) -> tuple[list[str], list[tuple[int, int]]]:
    """Runs of two or more single letters as one upper-case word over their span."""
    out: list[str] = []
    at: list[tuple[int, int]] = []
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and re.fullmatch("[a-zA-Z]", words[j]):
            j += 1
        if j - i >= 2:
            out.append("".join(words[i:j]).upper())
            at.append((stamps[i][0], stamps[j - 1][1]))
            i = j
        else:
            out.append(words[i])
            at.append(tuple(stamps[i]))  # type: ignore[arg-type]
            i += 1
    return out, at


def pieces_joined(tokens: Sequence[str], stamps: Sequence[tuple[int, int]]) -> tuple[list[str], list[tuple[int, int]]]:
    """Word pieces that end in @@ joined with what follows; <...> tags dropped."""
    out: list[str] = []
    at: list[tuple[int, int]] = []
    open_ = False
    for t, s in zip(tokens, stamps):
        if re.fullmatch(r"<.*>", t):
            continue
        piece = t[:-2] if t.endswith("@@") else t
        if open_:
            out[-1] += piece
            at[-1] = (at[-1][0], s[1])
        else:
            out.append(piece)
            at.append(tuple(s))  # type: ignore[arg-type]
        open_ = t.endswith("@@")
    return out, at


def character_words(text: str) -> list[tuple[str, str]]:
    """(kind, word): recognised characters as Chinese characters and as runs of letters and digits."""
    return [("cn" if not m[0].isascii() else "en&num", m[0]) for m in re.finditer(r"[A-Za-z0-9]+(?:[.'\-][A-Za-z0-9]+)*|[一-鿿]+", text)]


def reversed_rtl(text: str) -> str:
    """A right-to-left line in reading order: runs of other characters keep theirs."""
    runs = re.findall(r"[a-zA-Z0-9 :*./%+\-]+|.", text, re.S)
    return "".join(r for r in reversed(runs))


def latex(text: str) -> str:
    """LaTeX without the blanks that carry nothing: only an escaped blank and
    the one between two letters stay; named operators lose all of theirs."""
    named = re.compile(r"\\(operatorname|mathrm|text|mathbf)\s*(\*?)\s*\{([^{}]*)\}")
    text = named.sub(lambda m: f"\\{m[1]}{m[2]}{{{''.join(m[3].split())}}}", text.strip())

    def keep(m: re.Match[str]) -> str:
        if m[0].startswith("\\"):
            return m[0]
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        return " " if before.isalpha() and after.isalpha() else ""

    return re.sub(r"\\\s|\s+", keep, text)


def shifted_marks(words: Sequence[str], marks: Sequence[int], gaps: Sequence[float], whole: Sequence[bool], least: float = 0.1) -> list[int]:
    """Punctuation moved off the inside of a word (``whole`` tells that a word
    goes on behind the token) to the neighbour with the clearly longer pause."""
    out = list(marks)
    for i in range(len(out) - 1):
        if out[i] > 1 and whole[i]:
            before = gaps[i - 1] if i else 0.0
            j = i - 1 if i and before - gaps[i + 1] >= least else i + 1
            if out[j] == 1:
                out[j], out[i] = out[i], 1
    return out


def smoothed(roles: Sequence[int], breaks: Sequence[bool]) -> list[int]:
    """Roles of tokens at sentence edges: the token before a break takes the role
    before it; a token right behind a break takes the role of the next."""
    out = list(roles)
    for i in range(1, len(out)):
        if breaks[i]:
            out[i] = out[i - 1]
        elif breaks[i - 1] and i + 1 < len(out) and not breaks[i] and out[i] != out[i + 1] and (i + 2 >= len(out) or out[i + 1] == out[min(i + 2, len(out) - 1)]):
            out[i] = out[i + 1]
    return out


def word_windows(start: float, end: float, words: Sequence[tuple[str, float, float]], size: float = 1.5) -> list[tuple[float, float, int]]:
    """Pieces (start, end, group) of a segment by windows of ``size`` seconds over
    whole words; a lone one-character word under 0.5 s gets group -1."""
    if end - start <= 1.0 or not words:
        lone = len(words) == 1 and len(words[0][0]) == 1 and end - start < 0.5
        return [(start, end, -1 if lone else 0)]
    out: list[tuple[float, float, int]] = []
    at, i = start, 0
    gap = lambda k: words[k + 1][1] - words[k][2] if k + 1 < len(words) else 1e9
    while i < len(words):
        hit = [k for k in range(i, len(words)) if min(words[k][2], at + size) - max(words[k][1], at) > 1e-3]
        if not hit:  # no word in the window: go on at the next word
            at = words[i][1]
            if words[i][2] - words[i][1] <= 1e-3:
                i += 1
            continue
        last = hit[-1]
        if len(hit) > 1 and last < len(words) - 1:
            before = words[last][1] - words[last - 1][2]
            first = hit[0]
            short = words[last - 1][2] - words[first][1] <= 0.7
            single = last - first == 1 and len(words[first][0]) == 1
            if not (before - gap(last) <= 0 or short or single):
                last -= 1
        stop = end if last == len(words) - 1 else words[last][2]
        rest = words[last + 1 :]
        if rest and (end - stop <= 0.5 or (len(rest) == 1 and len(rest[0][0]) == 1)):
            stop, last = end, len(words) - 1
        out.append((at, stop, 0))
        i = last + 1
        at = words[i][1] if i < len(words) else end
    return out


def lone_merged(segments: Sequence[tuple[float, float, int]], dots: Sequence[float], *, near: float = 0.5, alike: float = 0.28) -> list[tuple[float, float, int]]:
    """Segments with lone ones (group < 0) joined to a neighbour that is near
    and alike; ``dots[i]`` is the likeness of segments i and i+1. With both sides
    near, the nearer of two alike ones, the left on ties."""
    seg = [list(s) for s in segments]
    gone = set()
    for i in range(1, len(seg) - 1):
        if seg[i][2] >= 0 or (seg[i - 1][2] < 0 and seg[i + 1][2] < 0):
            continue
        dl = seg[i][0] - seg[i - 1][1] if seg[i - 1][2] >= 0 and i - 1 not in gone else 10.0
        dr = seg[i + 1][0] - seg[i][1] if seg[i + 1][2] >= 0 else 10.0
        sl = dots[i - 1] if dl <= near else -1.0
        sr = dots[i] if dr <= near else -1.0
        if dl <= near and dr <= near:
            if sl >= alike and sr >= alike:
                left = dl <= dr
            else:
                left = sl >= sr
        else:
            left = dl <= near
        if left and sl >= alike:
            seg[i - 1][1] = seg[i][1]
            gone.add(i)
        elif not left and sr >= alike:
            seg[i + 1][0] = seg[i][0]
            gone.add(i)
    return [tuple(s) for k, s in enumerate(seg) if k not in gone]  # type: ignore[misc]
