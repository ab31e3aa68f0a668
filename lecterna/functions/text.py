"""Text and token functions as column expressions, JVM-side.

Java's \\w and \\d know ASCII only; (?U) is set where all scripts are meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Interjections that carry no content.
INTERJECTIONS = ["哇", "呀", "呢", "嗯", "啊", "吧", "啦", "哦", "嘿", "哟", "嘛", "哈", "呵", "喂", "了", "呗", "诶", "哎", "噢", "幺", "呃", "哼", "呦", "吗"]
# Single characters that are a statement by themselves.
SINGLE_WORDS = ["谁", "好", "对", "来", "你", "坐", "停", "看", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十"]
# Chinese punctuation and its ASCII counterpart.
PUNCTUATION = {
    "。": ".", "，": ",", "：": ":", "；": ";", "？": "?", "！": "!", "（": "(", "）": ")", "《": "<", "》": ">", "【": "[", "】": "]",
    "「": '"', "」": '"', "『": "'", "』": "'", "｛": "{", "｝": "}", "‘": "'", "’": "'", "“": '"', "”": '"', "——": "--", "～": "~", "……": "...", "－": "-", "／": "/", "｜": "|",
}
_ASCII_MARKS = "!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~"
_HAN_MARKS = "，。！？、；：“”‘’（）《》【】「」『』｛｝＜＞"


def is_english(t: Column) -> Column:
    return t.rlike("^[a-zA-Z']+$")


def is_numeric(t: Column) -> Column:
    return F.trim(t).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def is_chinese(t: Column) -> Column:
    """CJK or digits, by the first character."""
    return t.rlike("^[一-龥0-9]")


def all_chinese(tokens: Column) -> Column:
    return F.forall(tokens, lambda t: t.rlike("^[一-龥0-9]+$"))


def all_alpha(tokens: Column) -> Column:
    return F.forall(tokens, lambda t: t.rlike("^[a-zA-Z' ]+$"))


def text_len(t: Column) -> Column:
    """1 for an English word, else the number of characters."""
    return F.when(is_english(t), F.lit(1)).otherwise(F.char_length(t))


def char_num(line: Column) -> Column:
    """Words of a line: a chunk between spaces counts its Chinese characters and
    digits, or one if it has none."""
    chunks = F.filter(F.split(line, " "), lambda c: c != "")
    return F.aggregate(chunks, F.lit(0), lambda s, c: s + F.greatest(F.lit(1), F.regexp_count(c, F.lit("[一-龥0-9]"))))


def punct_class(c: Column) -> Column:
    """0 for an ASCII mark, 1 for a Chinese one, -1 otherwise (by the first character)."""
    return F.when(c.rlike(f"^[{_ASCII_MARKS}]"), 0).when(c.rlike(f"^[{_HAN_MARKS}]"), 1).otherwise(-1)


def ascii_marks(t: Column) -> Column:
    """Chinese punctuation as ASCII."""
    for k, v in PUNCTUATION.items():
        if len(k) > 1 or len(v) > 1:
            t = F.replace(t, F.lit(k), F.lit(v))
    one = {k: v for k, v in PUNCTUATION.items() if len(k) == len(v) == 1}
    return F.translate(t, "".join(one), "".join(one.values()))


def full_marks(t: Column) -> Column:
    """,.? of a translation as full-width marks."""
    return F.translate(t, ",.?", "，。？")


def tokens(t: Column) -> Column:
    """Runs of ASCII stay together, other characters stand alone."""
    return F.regexp_extract_all(t, F.lit(r"[!-~]+|[^\x00-\x7F\s]"), F.lit(0))


def chunks(words: Column, limit: int) -> Column:
    """Words in pieces of ``limit``."""
    n = F.ceil(F.size(words) / F.lit(limit)).cast("int")
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(words, i * limit + 1, limit))).otherwise(F.array().cast("array<array<string>>"))


def language(words: Column) -> Column:
    """en: English words only; cn: Chinese only; else mixed."""
    return F.when(F.size(words) == 0, F.lit("")).when(all_alpha(words), "en").when(all_chinese(words), "cn").otherwise("mixed")


def trivial(words: Column) -> Column:
    """Nothing said: no token, interjections only, or one character that is no statement."""
    return (F.size(words) == 0) | F.forall(words, lambda w: w.isin(INTERJECTIONS)) | ((F.size(words) == 1) & (F.char_length(F.get(words, F.lit(0))) == 1) & ~F.get(words, F.lit(0)).isin(SINGLE_WORDS))


def joined(words: Column) -> Column:
    """(line, english): tokens as a line; spaces around English words and
    numbers, ASCII marks after them, a lone i as I."""
    # what a token needs is settled once, so that the fold only joins strings
    kind = punct_class
    items = F.transform(words, lambda t: F.struct(t.alias("t"), kind(t).alias("k"), (is_english(t) | is_numeric(t)).alias("word")))
    items = F.transform(
        items,
        lambda s: F.struct(
            F.when(s["t"] == "i", F.lit("I")).when(s["t"].startswith("i'"), F.concat(F.lit("I"), F.substr(s["t"], F.lit(2)))).otherwise(s["t"]).alias("t"),
            F.when(s["k"] == 1, ascii_marks(s["t"])).otherwise(s["t"]).alias("mark"), s["k"].alias("k"), s["word"].alias("word"),
        ),
    )
    start = F.struct(F.lit("").alias("line"), F.lit(False).alias("en"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        blank = (s["word"] & (a["line"] != "")) | (~s["word"] & a["en"] & (s["k"] < 0))
        token = F.when(a["en"] & (s["k"] == 1), s["mark"]).otherwise(s["t"])
        return F.struct(F.concat(a["line"], F.when(blank, F.lit(" ")).otherwise(F.lit("")), token).alias("line"), s["word"].alias("en"), (a["n"] + s["word"].cast("int")).alias("n"))

    return F.aggregate(items, start, step, lambda a: F.struct(F.trim(a["line"]).alias("line"), a["n"].alias("english")))


def glued_letters(words: Column) -> Column:
    """Runs of single letters as one word."""
    start = F.array().cast("array<string>")
    single = lambda t: t.rlike("^[a-zA-Z]$")

    def step(a: Column, t: Column) -> Column:
        last = F.element_at(a, -1)
        glue = (F.size(a) > 0) & single(t) & F.coalesce(last.rlike("^[a-zA-Z]$|^(?:[A-Z])+$"), F.lit(False))
        return F.when(glue, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.upper(last), F.upper(t))))).otherwise(F.concat(a, F.array(t)))

    return F.aggregate(words, start, step)


# Patterns at the beginning of a word that take a syllable from the count of its vowel groups, or add one.
SYLLABLE_LESS = [
    "cial", "tia", "cius", "cious", "uiet", "gious", "geous", "priest", "giu", "dge", "ion", "iou", "sia$", ".che$", ".ched$", ".abe$", ".ace$",
    ".ade$", ".age$", ".aged$", ".ake$", ".ale$", ".aled$", ".ales$", ".ane$", ".ame$", ".ape$", ".are$", ".ase$", ".ashed$", ".asque$", ".ate$",
    ".ave$", ".azed$", ".awe$", ".aze$", ".aped$", ".athe$", ".athes$", ".ece$", ".ese$", ".esque$", ".esques$", ".eze$", ".gue$", ".ibe$", ".ice$",
    ".ide$", ".ife$", ".ike$", ".ile$", ".ime$", ".ine$", ".ipe$", ".iped$", ".ire$", ".ise$", ".ished$", ".ite$", ".ive$", ".ize$", ".obe$", ".ode$",
    ".oke$", ".ole$", ".ome$", ".one$", ".ope$", ".oque$", ".ore$", ".ose$", ".osque$", ".osques$", ".ote$", ".ove$", ".pped$", ".sse$", ".ssed$",
    ".ste$", ".ube$", ".uce$", ".ude$", ".uge$", ".uke$", ".ule$", ".ules$", ".uled$", ".ume$", ".une$", ".upe$", ".ure$", ".use$", ".ushed$",
    ".ute$", ".ved$", ".we$", ".wes$", ".wed$", ".yse$", ".yze$", ".rse$", ".red$", ".rce$", ".rde$", ".ily$", ".ely$", ".des$", ".gged$", ".kes$",
    ".ced$", ".ked$", ".med$", ".mes$", ".ned$", ".[sz]ed$", ".nce$", ".rles$", ".nes$", ".pes$", ".tes$", ".res$", ".ves$", "ere$",
]
SYLLABLE_MORE = [
    "ia", "riet", "dien", "ien", "iet", "iu", "iest", "io", "ii", "ily", ".oala$", ".iara$", ".ying$", ".earest", ".arer", ".aress", ".eate$",
    ".eation$", "[aeiouym]bl$", "[aeiou]{3}", "^mc", "ism", "^mc", "asm", "([^aeiouy])1l$", "[^l]lien", "^coa[dglx].", "[^gq]ua[^auieo]", "dnt$",
]


def syllables(word: Column) -> Column:
    """Vowel groups of a word, less or more one for each pattern it begins with; at least one."""
    count = lambda ps: sum((word.rlike(f"^(?:{p})").cast("int") for p in ps), F.lit(0))
    n = F.regexp_count(F.lower(word), F.lit("[aeiouy]+")) - count(SYLLABLE_LESS) + count(SYLLABLE_MORE)
    return F.greatest(F.lit(1), n).cast("int")


def joined_plain(words: Column) -> Column:
    """Words in one line: a blank between two that both end and begin with an ASCII letter, else none."""
    first = F.struct(F.lit("").alias("line"), F.lit(False).alias("open"))
    step = lambda a, w: F.struct(F.concat(a["line"], F.when(a["open"] & w.rlike("^[a-zA-Z]"), F.lit(" ")).otherwise(F.lit("")), w).alias("line"), w.rlike("[a-zA-Z]$").alias("open"))
    return F.aggregate(F.filter(words, lambda w: w.isNotNull() & (w != "")), first, step, lambda a: a["line"])


def symbols(text: Column, multi: list[str] = []) -> Column:  # noqa: B006
    """The characters of a text; each of the symbols ``multi`` is one, the longer ones first."""
    import re

    parts = "|".join(re.escape(m) for m in sorted(multi, key=lambda m: (-len(m), m)))
    return F.regexp_extract_all(text, F.lit(f"{parts}|(?s:.)" if parts else "(?s:.)"), F.lit(0))


def looked_up(key: Column, table: dict, default: object = None) -> Column:
    """The value of a small table by key, ``default`` where it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default)) if pairs else F.lit(default)


def protected_apostrophes(t: Column, sign: str = "ʼ") -> Column:
    """Apostrophes between letters by a sign that no tokenizer splits."""
    return F.regexp_replace(t, "(?<=[a-zA-Z])'(?=[a-zA-Z])", sign)


def doubled(t: Column) -> Column:
    """Characters that stand twice in a row."""
    return F.regexp_extract_all(t, F.lit(r"(?U)(\w)\1"), F.lit(1))


def holds_doubled(words: Column, c: Column) -> Column:
    return F.exists(words, lambda w: F.contains(w, F.concat(c, c)))


def capped_words(word: Column, longest: int = 4) -> Column:
    """A word in pieces of at most ``longest`` characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length(word) / F.lit(longest)).cast("int") - 1)), lambda i: F.substr(word, i * longest + 1, F.lit(longest)))


def split_digits(word: Column) -> Column:
    """Runs of digits and of letters."""
    return F.regexp_extract_all(word, F.lit(r"\d+|[a-zA-Z]+"), F.lit(0))


def is_simplified(t: Column, only_simplified: str, only_traditional: str, *, full: bool = False) -> Column:
    """True / False by which script's own characters occur more often (``full``: only
    if the other's don't occur at all), null if neither occurs."""
    s, r = F.regexp_count(t, F.lit(f"[{only_simplified}]")), F.regexp_count(t, F.lit(f"[{only_traditional}]"))
    if full:
        return F.when((s > 0) & (r == 0), True).when((r > 0) & (s == 0), False)
    return F.when(s > r, True).when(r > s, False)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; null if both are empty."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n > 0, 1 - F.levenshtein(a, b) / n)


def rest_after(words: Column, prefix: Column) -> Column:
    """The words behind a consumed prefix; all of them if it doesn't match."""
    n = F.size(prefix)
    return F.when(F.slice(words, F.lit(1), n) == prefix, F.slice(words, n + 1, F.greatest(F.lit(0), F.size(words) - n))).otherwise(words)


def capitalised(df: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """``df`` with the first letter of ``text`` in upper case where the line
    before it in its key ended a sentence."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(*order))
    starts = before.isNull() | before.rlike("[.。?？!！]\\s*$")
    return df.withColumn(text, F.when(starts & F.col(text).rlike("^[a-z]"), F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))).otherwise(F.col(text)))


def english_class(df: DataFrame, key: str, token: str, least: float = 0.1) -> DataFrame:
    """(key, english_share, is_english) of token rows."""
    return df.groupBy(key).agg(F.avg(is_english(F.col(token)).cast("double")).alias("english_share")).withColumn("is_english", F.col("english_share") >= least)
