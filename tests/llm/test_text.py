"""Look-alikes, speech marks, turns, sentences, packing, mixing, quality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lecterna.llm import lookalike, mixing, packing, quality, sentences, speech, turns
from lecterna.llm.boosting import Boosted
from lecterna.llm.tokens import TOKENIZERS, VOCABULARY, count

HYP = "stream_id long, idx int, begin_ms long, asr_dec_preds string, asr_dec_stamp array<struct<b:int,e:int>>"
HYP_B = "stream_id long, idx int, asr_sensevoice_result struct<preds:string>"
SEG = "vec_id long, stream_id long, seg_id int, sv_feat array<float>"

SAME = [
    ("Teacher: note", "Теаcher: note"), ("ABC 12", "ＡＢＣ　１２"), ("café", "café"), ("a b", "a b"), ("ab", "a​b"), ("小一", "⼩⼀"), ("了", "了"), ("각", "각"), ("fin", "ﬁn"), ("T", "Т"), ("a\tb", "a b"), ("x\n", "x\r\n"), ("sè", "sѐ"), ("Übung", "Ü​bung"), ("SOUNDS", "ꓢꓳꓴꓠꓓꓢ"), ("hug", "հսց"), ("DATE", "ꭰᎪᎢᎬ".upper()),
]
DIFFER = [("Teacher", "teacher"), ("cafe", "café"), ("门", "門"), ("a b", "ab"), ("a\nb", "a b"), ("好。", "好."), ("x2", "x²"), ("3", "4"), ("a  b", "a b")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    s = lookalike.Speller(lookalike.pairs(["Teacher note about the classes"] * 5))
    assert s.form(a) == s.form(b)


@pytest.mark.parametrize("a, b", DIFFER)
def test_other_look(a, b):
    s = lookalike.Speller(lookalike.pairs(["Teacher"]))
    assert s.form(a) != s.form(b)


def test_script_by_context():
    s = lookalike.Speller(lookalike.pairs(["это совсем обычный текст про каждое слово и вес воды"] * 20 + ["plain words here"]))
    assert s.form("вeс") == "вес" and s.form("ѡоrd") != ""
    long = "Теаcher " * 50_000
    assert s.form(long) == "Teacher " * 50_000


def test_a_bar_is_read_by_its_word():
    # no table of single letters can read it: l and I look different
    s = lookalike.Speller(lookalike.pairs(["hello will all the little lamps fall in his inn it is in India"] * 20))
    assert s.form("heӏӏo") == "hello" and s.form("ӏt") == "It" and s.form("ꓲn") == "In" and s.form("hello") != s.form("heIIo")
    assert lookalike.look("heӏӏo") != lookalike.look("hello")


def test_same_look_rows(spark):
    a = [(1, i, 0, x, None) for i, (x, _) in enumerate(SAME + DIFFER)] + [(1, 90, 0, None, None), (1, 91, 0, "", None), (None, 5, 0, "x", None), (2, 0, 0, "Теacher", None), (2, 0, 0, "Теacher", None)]
    b = [(1, i, (y,)) for i, (_, y) in enumerate(SAME + DIFFER)] + [(1, 90, ("x",)), (1, 91, ("",)), (2, 0, ("Teacher",)), (3, 1, None)]
    got = {(r["stream_id"], r["idx"]) for r in lookalike.same_look(spark.createDataFrame(a, HYP), spark.createDataFrame(b, HYP_B)).collect()}
    assert got == {(1, i) for i in range(len(SAME))} | {(2, 0)}
    df = spark.createDataFrame([("x", "y", None)], "form string, raw string, t string")
    assert lookalike.canonical(df, "t", {}).collect()[0]["form"] is None
    assert lookalike.same_look(spark.createDataFrame([], HYP), spark.createDataFrame([], HYP_B)).count() == 0


@pytest.mark.parametrize(
    "text, said, label",
    [("[00:01:02.003] spk4> 好。", True, "speaker 4"), ("老 师：um", False, "teacher"), ("*cough*", False, None), ("说话人十二 | 对", True, "speaker 12"), ("Stu1 - (applause)", False, "student 1"), ("12'37\" Ｔ: hi", True, "teacher"), ("", False, None), (None, False, None),
     ("uh uh.", False, None), ("Теаcher：是", True, "teacher"), ("SPEAKER_02: x", True, "speaker 2"), ("00:10:26,944 --> 呃", False, None), ("我说：好", True, None), ("Erde ist rund", True, None)],
)
def test_marks(text, said, label):
    assert speech.parsed(text) == (said, label)


def test_cleaned_text():
    assert speech.cleaned("[00:00:04.663] 学生二：[笑声]嗯嗯，我们开始。") == "我们开始。"
    assert speech.cleaned("Um, the lamp (applause) is on.") == "the lamp is on." and speech.cleaned(None) == ""


def vec(seed, noise=0.0, n=[0]):  # noqa: B006
    n[0] += 1
    return [float(v) for v in np.random.default_rng(seed).standard_normal(192) + noise * np.random.default_rng(1000 + n[0]).standard_normal(192)]


def test_turns(spark):
    stamp = [(0, 500), (-1, 900)]
    a = [
        (1, 0, 0, "老师: 一", stamp), (1, 1, 2_000, "Т：二", [(5, 1)]), (1, 2, 4_000, "um", None), (1, 3, 5_000, "Student 1: 三", None), (1, 4, 36_000, "学生一：四", []), (1, 5, 40_000, "教师 | 五", None),
        (1, 5, 40_000, "教师 | 五", None), (1, 6, None, "x", None), (1, 7, 41_000, None, None), (1, 8, 42_000, "没有标签", None), (2, 0, 0, "spk2> 一", None), (2, 1, 10, "spk3> 二", None),
    ]
    s = [(10, 1, 0, vec(1)), (11, 1, 3, vec(2)), (12, 1, 4, vec(2, 0.1)), (13, 2, 0, vec(1, 0.1)), (14, 2, 1, None)]
    got = turns.turns(spark.createDataFrame(a, HYP), spark.createDataFrame(s, SEG))
    rows = {(r["stream_id"], r["first_idx"], r["last_idx"]): r for r in got.collect()}
    assert set(rows) == {(1, 0, 1), (1, 3, 3), (1, 4, 4), (1, 5, 8), (2, 0, 0), (2, 1, 1)}
    assert rows[1, 0, 1]["body"] == "一\n二" and rows[1, 0, 1]["speaker"] == 10 and rows[1, 3, 3]["speaker"] == 11
    assert turns.turns(spark.createDataFrame([], HYP), spark.createDataFrame([], SEG)).count() == 0


def test_turns_survive_partition_borders(spark):
    a = [(1, i, i * 1000, "T: 好" if (i // 7) % 2 else "S1: 好", [(0, 100)]) for i in range(200)]
    got = turns.turns(spark.createDataFrame(a, HYP).repartition(7), spark.createDataFrame([], SEG), text=False)
    want = {(1, k * 7, min(k * 7 + 6, 199)) for k in range(29)}
    assert {(r["stream_id"], r["first_idx"], r["last_idx"]) for r in got.collect()} == want


def turns_by_definition(rows, model):
    """rows (stream, idx, begin, end, who, open) in order, decoded as a whole."""
    t = {c: np.array(v) for c, v in zip(("stream_id", "idx", "begin_ms", "end_ms", "who", "open"), zip(*rows))}
    gap, opened, hard = turns._sides(t)
    who = model.segment(t["who"], gap, opened, hard)
    seg = turns._segments({**t, "body": np.array([None] * len(rows), object)}, who, "", False)
    return set(zip(*(np.asarray(seg[c]).tolist() for c in ("stream_id", "first_idx", "last_idx", "speaker"))))


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_unknown_speakers_over_any_partitions(spark, parts):
    g = np.random.default_rng(5)
    rows, at = [], 0
    for i in range(400):
        at += int(g.choice([200, 900, 2500, 31_000], p=[0.5, 0.3, 0.19, 0.01]))
        who = -1 if 100 <= i < 160 or g.random() < 0.4 else int(i // 9 % 3) + 1
        rows.append((1 + i // 250, i, at, at + 300, who, bool(g.random() < 0.5)))
        at += 300
    df = spark.createDataFrame([(*r, "x") for r in rows], "stream_id long, idx int, begin_ms long, end_ms long, who long, open boolean, body string")
    model = turns._learnt(df)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = turns._joined_ends(turns._decoded(df, model, True)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r["stream_id"], r["first_idx"], r["last_idx"], r["speaker"]) for r in got} == turns_by_definition(rows, model)
    assert all(len(r["body"].split("\n")) == r["n"] for r in got)


def test_decoding_is_exact_and_learnt():
    g = np.random.default_rng(2)
    model = turns.SemiMarkov({(d, b, o, x): int(g.integers(0, 50)) for d in (0, 1) for b in range(13) for o in (0, 1) for x in (0, 1)})
    for _ in range(30):
        n = int(g.integers(3, 9))
        known = g.choice([1, 2, 3, -1], n, p=[0.2, 0.2, 0.1, 0.5])
        if (known != -1).sum() < 2:
            continue
        gap, opened = g.integers(0, 7000, n), g.random(n) < 0.5
        hard = np.arange(n) == 0
        got = model.segment(known, gap, opened, hard)

        def score(path):
            v, d = 0.0, 0
            for u in range(1, n):
                same = path[u] == path[u - 1]
                v += (model.stay if same else model.change)[d, min(gap[u] // 500, 12), int(opened[u])]
                d = 1 if same else 0
            return v

        import itertools

        near = lambda xs: next((int(x) for x in xs if x != -1), None)
        free = [[int(k)] if k != -1 else sorted({near(known[i:]), near(known[:i][::-1])} - {None}) for i, k in enumerate(known)]
        assert score(got) >= max(map(score, itertools.product(*free))) - 1e-9
    # speakers change at long pauses in the data, and so they do where nobody is known
    model = turns.SemiMarkov({(d, b, o, x): 100 if (b > 4) == x else 1 for d in (0, 1) for b in range(13) for o in (0, 1) for x in (0, 1)})
    gap = np.array([0, 200, 200, 4000, 200])
    assert model.segment(np.array([1, -1, -1, -1, 2]), gap, np.zeros(5, bool), np.arange(5) == 0).tolist() == [1, 1, 1, 2, 2]


LEARN = (
    ["Dr. Quill wrote it. The class reads. It weighs approx. 9.7 kg. See Fig. 3 for it. Bring tape, string, etc. Then we go. The lab starts at 3 p.m. on Monday. We meet at 8 p.m. The class waits.", "She reads a kg of it, wrote it now, waits there, reads on and moves. We wrote and she waits. It reads well now and good men wrote. The good class moves now."] * 30
    + ["Nehmt z. B. das zweite Beispiel. Der Wert liegt bei ca. 6,15. Das ist leicht, d. h. wir üben. Am 5. Mai schreiben wir. Heute lernen wir. Die Klasse ist da.", "Wir üben da und üben hier. Das Beispiel schreiben wir da. Wir lernen da mehr."] * 30
)
CASES = [
    ("T: Dr. Quill reads. See Fig. 4 now. Good.", [0, 20, 36]), ("Stop at 3.5 km. See Fig. 4 now. Good.", [0, 16, 32]), ("He asked, \"Can you? Yes.\" The class reads.", [0, 26]), ("\"It moves. Look!\" said Dr. Quill. The class reads.", [0, 34]),
    ("他说：“好。你们再读！”我们走。", [0, 12]), ("“好了。”小禾一边说，一边写。再见。", [0, 15]), ("一\n二", [0, 2]), ("我们慢一点……再读。", [0]), ("今天我们讲函数 好 听懂了吗", [0, 8, 10]), ("拼音 mā má 里有声调", [0]), ("（见第3页）好。\n[笑声]对。", [0, 9]),
    ("Nehmt z. B. das Beispiel. Am 5. Mai schreiben wir.", [0, 26]), ("第一句.第二句!第三句?", [0, 4, 8]), ("   We wait.  Good now.", [3, 13]), ("", []), ("  \n ", []), ("版本1.2.3好。Open lesson10.txt and read. The class waits.", [0, 9, 37]),
]


RUSSIAN = ["Мы купили хлеб, молоко и т. д. для всех. Это было в г. Москва. Дети ждут нас. Они читают и пишут. На стр. 5 есть рисунок. Мы идём на ул. Ленина и там ждём.", "Дети пишут и читают на доске. Мы ждём для всех и идём туда. Они ждут в школе. Это было давно."] * 40


def test_periods_of_other_alphabets(spark):
    s = sentences.Splitter(sentences.learnt(spark.createDataFrame([(t,) for t in RUSSIAN], "t string")))
    t = "Мы купили хлеб, молоко и т. д. для всех. Дети ждут нас."
    assert s.starts(t) == [0, t.index("Дети")]
    t = "Это было на стр. 5 и там. Они читают."
    assert s.starts(t) == [0, t.index("Они")]
    assert sentences.language("Дети пишут.") == "ru" and sentences.language("der Brief " * 900) == "de" and sentences.language("plain words " * 900 + "der") == "en"


def test_a_rare_abbreviation_of_a_large_corpus(spark):
    # what decides about a word doesn't move with the size of the corpus
    many = spark.range(60_000).selectExpr("concat('The class reads word', id % 50, ' and waits. It weighs more now. We go there and read. ') as t")
    few = spark.createDataFrame([("It is approx. nine of them and approx. ten of it.",)] * 20, "t string")
    assert "approx" in sentences.learnt(many.unionByName(few))["en"].short


@pytest.fixture(scope="module")
def know(spark):
    return sentences.learnt(spark.createDataFrame([(t,) for t in LEARN] + [(None,), ("",)], "t string"))


@pytest.mark.parametrize("text, starts", CASES)
def test_sentences(know, text, starts):
    assert sentences.Splitter(know).starts(text) == starts


def test_sentences_of_long_and_odd_texts(know):
    s = sentences.Splitter(know)
    assert len(s.starts("好。" * 20_000)) == 20_000
    for t in ("\"", "“", "((((", "...", "。。。", "​", "a​. B", "-->", "[", "12'", "T:"):
        got = s.starts(t)
        assert got == sorted(set(got)) and all(0 <= x < len(t) for x in got)


def test_sentences_skip_silent_utterances(spark):
    a = [(1, 0, 0, "um", None), (1, 1, 0, "好。对。", None), (1, 1, 0, "好。对。", None), (1, 2, 0, None, None)]
    b = [(1, 0, ("Hello.",)), (1, 1, ("好。",)), (1, 3, None), (1, 4, ("一。",))]
    got = {tuple(r) for r in sentences.sentences(spark.createDataFrame(a, HYP), spark.createDataFrame(b, HYP_B)).collect()}
    assert got == {(1, 1, "asr_dec_preds", 0), (1, 1, "asr_dec_preds", 2), (1, 1, "asr_sensevoice_result", 0), (1, 4, "asr_sensevoice_result", 0)}
    assert sentences.sentences(spark.createDataFrame([], HYP), spark.createDataFrame([], HYP_B)).count() == 0


def test_best_fit_is_the_tightest_bin():
    g = np.random.default_rng(0)
    sizes = np.sort(g.integers(1, 90, 300))[::-1]
    groups, sources = np.arange(300), np.zeros(300, np.int64)
    bins = packing.best_fit(sizes, groups, sources, 100)
    room: list[int] = []
    for s, b in zip(sizes, bins):
        fit = [r for r in room if r >= s]
        if fit:
            assert room[b] == min(fit)
        else:
            assert b == len(room)
            room.append(100)
        room[b] -= s
    copies = packing.best_fit(np.full(6, 10), np.zeros(6, np.int64), sources[:6], 100)
    assert len(set(copies)) == 6


def test_a_source_fills_its_share_alone():
    sizes, sources = np.array([60, 30, 20, 20, 10]), np.array([0, 0, 0, 1, 1])
    bins = packing.best_fit(sizes, np.arange(5), sources, 100, 0.75)
    for b in set(bins):
        for src in (0, 1):
            m = (bins == b) & (sources == src)
            assert sizes[m].sum() <= 75 or m.sum() == 1
    # the tightest bin conflicts, the next one is taken
    assert bins[1] != bins[0] and bins[3] == bins[0]


DOC = "doc_id long, text string, source string, tokens string"
BOX = "container_id long, name string, capacity_tokens int"
PATH = f"{TOKENIZERS}/{VOCABULARY}"


def test_packing_keeps_everything(spark):
    docs = [(i, f"word{i} " * (i % 50 + 1), "A", "x") for i in range(120)] + [(500, "long " * 1000, "b", "x"), (501, None, "b", "x"), (502, "", None, "x"), (None, "hello", None, "x"), (3, "word3 word3 word3 word3 ", "A", "x"), (3, "word3 word3 word3 word3 ", "A", "x")]
    df = spark.createDataFrame(docs, DOC)
    got = packing.packed(df, spark.createDataFrame([(1, "s", 128), (2, "l", 4096), (3, "none", 0), (4, "null", None)], BOX), shard=50).toPandas()
    assert set(got.container_id) == {1, 2}
    for c, cap in ((1, 128), (2, 4096)):
        g = got[got.container_id == c]
        assert g.groupby("bin").tokens.sum().max() <= cap
        assert g.tokens.sum() == sum(count(t, PATH) for _, t, _, _ in docs)
        pieces = g[g.item == 500]
        n = count("long " * 1000, PATH)
        assert len(pieces) == -(-n // cap) and (g.item == 3).sum() == 3 and g[g.item == 3].bin.nunique() == 3
    near = spark.createDataFrame([(i, x, "A", "") for i, x in enumerate(["One lamp.", "one lamp", "ONE  LAMP!", "two lamps", "...", "?!"])], DOC)
    bins = {r["item"]: r["bin"] for r in packing.packed(near, spark.createDataFrame([(1, "s", 128)], BOX), most_share=1.0).collect()}
    assert len({bins[i] for i in range(3)}) == 3 and len(set(bins.values())) == 3
    assert packing.packed(spark.createDataFrame([], DOC), spark.createDataFrame([(1, "s", 128)], BOX)).count() == 0


MIX = "source string, target_share double, max_repeat int"


def test_mix_meets_its_shares(spark):
    docs = [(i, f"alpha{i} " * 20, " Big ", "x") for i in range(300)] + [(1000 + i, f"beta{i} " * 20, "small", "x") for i in range(20)] + [(2000, "beta1 " * 20, "SMALL", "x"), (2001, None, "big", "x"), (2002, "", "big", "x"), (2003, "x", None, "x"), (2004, "x", "other", "x")]
    t = spark.createDataFrame([("big", 0.75, 1), ("small", 0.25, 3), ("absent", 0.0, 2)], MIX)
    mix = mixing.mixed(spark.createDataFrame(docs, DOC), t)
    rows = {r["source"]: r for r in mixing.shares(mix, t).collect()}
    assert abs(rows["big"]["actual_share"] - 0.75) < 0.02 and abs(rows["small"]["actual_share"] - 0.25) < 0.02 and rows["absent"]["tokens"] == 0
    per = mix.groupBy("doc_id").count().toPandas()
    assert per["count"].max() <= 3 and mix.where("source = 'big'").groupBy("doc_id").count().where("count > 1").count() == 0 and mix.where("doc_id = 2000").count() == 0
    # at any point of the queue the sources stand near their shares
    q = mix.orderBy("finish", "source").toPandas()
    half = q[: len(q) // 2]
    assert abs(half[half.source == "small"].tokens.sum() / half.tokens.sum() - 0.25) < 0.05
    assert mixing.mixed(spark.createDataFrame([], DOC), t).count() == 0
    assert mixing.shares(mixing.mixed(spark.createDataFrame([], DOC), t), t).count() == 3


def test_running_sums_over_partitions(spark):
    g = np.random.default_rng(1)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(g.integers(0, 3, 400), g.integers(1, 9, 400)))]
    got = mixing.running(spark.createDataFrame(rows, "k long, o long, v long").repartition(6), "k", "v", ["k", "o"]).collect()
    for r in got:
        assert r["sum_before"] == sum(v for k, o, v in rows if k == r["k"] and o < r["o"])


def test_boosting_learns_and_calibrates():
    g = np.random.default_rng(0)
    x = g.standard_normal((900, 5))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5) * (x[:, 0] > 0)
    m = Boosted(3, rounds=30).fit(x[:600], y[:600]).calibrate(x[600:750], y[600:750])
    p = m.predict(x[750:])
    assert (p.argmax(1) == y[750:]).mean() > 0.9 and np.allclose(p.sum(1), 1)


def test_kinds(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = [(900_001, "- one\n- two\n- three\n- four"), (900_002, None), (900_003, ""), (900_004, " \n "), (900_005, "a,b,c\n1,2,3\n4,5,6\n7,8,9"), (900_006, "#$%^ &*@ ~~ || \\\\ ##"), (900_007, "The lamp is on. We can see the table now, so let us begin."), (900_007, "The lamp is on. We can see the table now, so let us begin."), (900_008, "好" * 30_000)]
    got = {r["doc_id"]: r for r in quality.quality(docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")), "doc_id", "text").collect()}
    kinds = {k: got[k]["kind"] for k in (900_001, 900_005, 900_006, 900_007, 900_008)}
    assert kinds == {900_001: "list", 900_005: "table", 900_006: "junk", 900_007: "prose", 900_008: "junk"}
    assert not {900_002, 900_003, 900_004} & set(got) and got[900_007]["ended"] == 1.0


def test_quality_of_nothing(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_names_of_statistics():
    m = quality.Measurer(np.zeros(quality.SLOTS), np.zeros(quality.SLOTS))
    assert len(m("x")) == len(quality.NAMES) == len(set(quality.NAMES)) and np.isfinite(m("a" * 100_000)).all() and np.isfinite(m("\n")).all()


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "hello world", 5, 6)], "doc_id long, text string, digest int, tokens int")
    from lecterna.llm.tokens import sized

    assert sized(df, "text").columns == ["doc_id", "tokens", "digest"] and sized(df.withColumn("text", F.lit(None).cast("string")), "text").first()["tokens"] == 0


def test_statistics_see_every_line():
    odds = np.random.default_rng(3).standard_normal(quality.SLOTS)
    m = quality.Measurer(np.zeros(quality.SLOTS), odds)
    plain, spoken = [f"glossary item {i}" for i in range(250)], [f"Teacher: we see that {i} is so." for i in range(250)]
    one, other = (dict(zip(quality.NAMES, m("\n".join(["Notes", *a, *b])))) for a, b in ((plain, spoken), (spoken, plain)))
    for k in ("labelled", "speaks_body", "speaks_lines"):
        assert one[k] == pytest.approx(other[k])
    assert one["labelled"] == pytest.approx(250 / 501)


@pytest.mark.parametrize("text", ["uh, um. " * 30, "(applause) um 【笑声】 " * 20, "嗯" * 5000, "T: 嗯，呃。*cough* " + "hmm " * 40, "um\nT: uh\n" * 20])
def test_long_texts_without_speech(text):
    assert not speech.spoken(text) and speech.spoken(text + "好的") and speech.spoken("well " + text)


def test_long_pieces_of_marks():
    assert sentences.speech_free("(applause) " * 20) and not sentences.speech_free("(applause) " * 20 + "好")
