"""Text, number, script, sequence and signal functions."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lecterna.functions import itn, scripts, signal
from lecterna.functions import sequences as S
from lecterna.functions import text as T
from lecterna.functions import vector as V
from lecterna.operators import decode, transcripts
from lecterna.sources import media


@pytest.mark.parametrize(
    "spoken, written",
    [("幺九二点幺六八点幺点幺", "192.168.1.1"), ("二零二五年十月", "2025年10月"), ("三百五十六", "356"), ("百分之二十", "20%"), ("三分之二", "2/3"), ("三比二", "3:2"), ("一加二等于三", "1+2=3"), ("八除二", "8÷2"),
     ("十二点三十分", "12:30"), ("五月一号", "5月1号"), ("一万两千", "12000"), ("一千二", "1200"), ("他一个人", "他一个人"), ("没有数字", "没有数字"), ("", ""), ("十", "10"), ("一百零五", "105"), ("三点五", "3.5"), ("两万三", "23000")],
)
def test_numbers(spoken, written):
    assert itn.written(spoken) == written


def test_idioms_stay():
    assert itn.written("乱七八糟", ["乱七八糟"]) == "乱七八糟"
    assert itn.written(None) is None


def test_script_conversion_and_markup():
    c = scripts.Converter({"國": "国", "國家": "国家", "門": "门"}, "zh-hans")
    assert c.tokens("國家門") == ["國家", "門"] and c.convert("國家門") == "国家门"
    assert c.marked("-{國}-門") == "國门"
    assert c.marked("-{zh-hans:计算机;zh-hant:電腦}-") == "计算机"
    assert c.marked("-{A|zh-hans:甲;zh-hant:乙}-乙門") == "甲甲门"
    assert c.marked("-{H|zh-hans:甲;zh-hant:乙}-乙") == "甲"
    assert c.marked("門-{國") == "门-{国" and c.convert(None) is None and c.convert("") == ""


def test_fusion_walks_to_two_mismatches():
    a, b = "xxabcdefyyy", "zzabcdefwww"
    cut = S.best_fusion(a, b)
    assert a[cut[0] : cut[1]] == "abcdef"
    assert S.best_fusion("abc", "xyz") is None and S.best_fusion("", "") is None


def test_doubled_repair():
    assert S.repaired("我我们走", "我们走")[0] == "我们走"
    assert S.repaired("看看书", "看看书")[0] == "看看书"


def test_words():
    assert S.abbreviations(["a", "b", "good", "c"], [(0, 1), (1, 2), (2, 3), (3, 4)]) == (["AB", "good", "c"], [(0, 2), (2, 3), (3, 4)])
    assert S.pieces_joined(["he@@", "llo", "<s>", "x"], [(0, 1), (1, 2), (2, 3), (3, 4)]) == (["hello", "x"], [(0, 2), (3, 4)])
    assert S.mixed_words("ab c你好", S.max_match(["你好"])) == ["ab", "c", "你好"]
    assert S.character_words("中a1国") == [("cn", "中"), ("en&num", "a1"), ("cn", "国")]
    assert S.deduplicated(["好", "好", "好"], [(0, 1)] * 3) == [0, 1]
    assert S.latex("a _ { 1 2 } + \\alpha x \\ y") == "a_{12}+\\alpha x\\ y"
    assert S.latex("\\mathrm { m o d } n") == "\\mathrm{mod}n"


def test_word_windows_cover_the_segment():
    words = [("a", i * 0.4, i * 0.4 + 0.3) for i in range(12)]
    got = S.word_windows(0.0, 4.8, words)
    assert got[0][0] == 0.0 and got[-1][1] == 4.8 and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert S.word_windows(0.0, 0.4, [("好", 0.0, 0.3)]) == [(0.0, 0.4, -1)]
    assert S.word_windows(0.0, 9.0, [("a", 6.0, 6.4)])  # a window without words moves on


def test_lone_segments_join_the_alike_neighbour():
    seg = [(0.0, 1.0, 1), (1.1, 1.3, -1), (1.5, 2.0, 2)]
    assert S.lone_merged(seg, [0.5, 0.1]) == [(0.0, 1.3, 1), (1.5, 2.0, 2)]
    assert S.lone_merged(seg, [0.1, 0.5]) == [(0.0, 1.0, 1), (1.1, 2.0, 2)]
    assert S.lone_merged(seg, [0.1, 0.1]) == seg


def test_text_columns(spark):
    df = spark.createDataFrame([(["i", "like", "语", "文", "。"],), (["a", "b"],), ([],), (["嗯", "啊"],), (["好"],)], "w array<string>")
    got = df.select(T.joined(F.col("w"))["line"].alias("l"), T.language(F.col("w")).alias("k"), T.trivial(F.col("w")).alias("t"), T.glued_letters(F.col("w")).alias("g")).collect()
    assert [g["l"] for g in got] == ["I like 语文。", "a b", "", "嗯啊", "好"]
    assert [g["k"] for g in got] == ["mixed", "en", "", "cn", "cn"] and [g["t"] for g in got] == [False, False, True, True, False]
    assert got[1]["g"] == ["AB"]
    one = spark.createDataFrame([("我我们 hello",), ("",), (None,)], "t string").select(T.doubled(F.col("t")).alias("d"), T.char_num(F.col("t")).alias("n"), T.ascii_marks(F.concat("t", F.lit("……。"))).alias("m")).collect()
    assert one[0]["d"] == ["我", "l"] and one[0]["n"] == 4 and one[0]["m"].endswith("....") and one[2]["d"] is None


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "x array<double>, y array<double>")
    a, b = df.select(V.cosine(F.col("x"), F.col("y")).alias("c"), V.unit(F.col("x")).alias("u"), V.argmax(F.col("y")).alias("m"), V.softmax(F.col("y")).alias("s"), V.next_power(F.lit(300)).alias("p")).collect()
    assert abs(a["c"] - 0.96) < 1e-9 and a["u"] == [0.6, 0.8] and a["m"] == 0 and abs(sum(a["s"]) - 1) < 1e-9 and a["p"] == 512
    assert b["c"] is None


def test_filter_bank_against_a_direct_transform():
    x = np.sin(2 * np.pi * 440 * np.arange(800) / 16000)
    f = signal.framed(x)
    assert f.shape == (3, 400)
    got = signal.fbank(x, bins=10)
    y = f - f.mean(1, keepdims=True)
    y = (y - 0.97 * np.concatenate([y[:, :1], y[:, :-1]], 1)) * signal.window("hamming", 400)
    k, n = np.arange(257)[:, None], np.arange(400)[None]
    p = np.abs(y @ np.exp(-2j * np.pi * k * n / 512).T) ** 2
    assert np.allclose(got, np.log(np.maximum(p @ signal.mel_bank(10, 512).T, np.finfo(np.float32).eps)), atol=1e-3)
    assert signal.fbank(np.zeros(10)).shape == (0, 80)


def test_stacking_and_loudness():
    assert signal.stacked(np.arange(5.0)[:, None], 3, 2).tolist() == [[0, 0, 1], [1, 2, 3], [3, 4, 4]]
    assert signal.loudness(np.zeros(50)) == 1e-4 and signal.loudness(np.ones(1000)) == 1.0001


def test_mute_ends_are_cut():
    x = np.concatenate([np.zeros(3200), np.sin(np.arange(16000)), np.zeros(3200)])
    a, b = signal.tightened(x, 10.0, 11.4)
    assert 10.15 <= a <= 10.25 and 11.15 <= b <= 11.25 and signal.mute_runs(np.zeros(3200)) == []


@pytest.mark.parametrize("tag, bits, fmt", [(1, 16, "<i2"), (1, 32, "<i4"), (3, 32, "<f4")])
def test_wav_round_trip(tag, bits, fmt):
    x = np.array([0, 0.5, -0.5, 0.25])
    body = (x * (2 ** (bits - 1) if tag == 1 else 1)).astype(fmt).tobytes()
    fmt_chunk = struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, 1, 16000, 16000 * bits // 8, bits // 8, bits)
    junk = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    data = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt_chunk + junk + b"data" + struct.pack("<I", len(body)) + body
    y, rate, channels = media.parse_wav(data)
    assert np.allclose(x, y) and (rate, channels) == (16000, 1)
    with pytest.raises(ValueError):
        media.parse_wav(b"RIFFxxxx")


def test_decoders():
    chars = list("ab")
    assert decode.DECODERS["ctc"].decode([0, 1, 1, 0, 1, 2, 2], None, chars) == ("aab", 1.0)
    assert decode.DECODERS["nrtr"].decode([2, 4, 5, 3, 4], None, chars)[0] == "ab"
    assert decode.DECODERS["pren"].decode([1], None, chars) == ("", 1.0)
    assert decode.DECODERS["vitstr"].decode([0, 2, 3, 1, 2], None, chars)[0] == "ab"
    assert decode.DECODERS["ctc"].decode([], None, chars) == ("", 0.0)
    assert decode.can_ids([5, 4, 0, 9]) == [5, 4]


def test_beam_finds_the_best_sequence():
    table = np.log(np.array([[0.05, 0.05, 0.6, 0.3], [0.25] * 4, [0.05, 0.8, 0.1, 0.05], [0.1, 0.7, 0.1, 0.1]]))
    tokens, score = decode.beam(lambda p: table[p[-1] if p else 0], most=10)
    assert tokens == [2, 1] and score < 0


def test_punctuation_in_chunks_marks_every_token():
    score = lambda part: [3 if t == "." else 1 for t in part]
    tokens = (["x"] * 7 + ["."]) * 9
    marks, rest = decode.punctuated(tokens, score, chunk=20)
    assert len(marks) == len(tokens) and rest == [] and marks[7] == 3
    half, rest = decode.punctuated(tokens[:30], score, chunk=20, final=False)
    more, _ = decode.punctuated(tokens[30:], score, chunk=20, carry=rest)
    assert half + more == marks


def test_hypotheses():
    assert transcripts.chosen("en", 0.1, "hello", "hallo") == ("b", "hallo")
    assert transcripts.chosen("mixed", 0.1, "我用 python 写", "我用python写")[0] == "a"
    assert transcripts.chosen("mixed", 0.1, "完全不同的话", "another thing") == ("drop", "")
    assert transcripts.chosen("cn", 0.1, "", "好") == ("drop", "")
    loud = transcripts.chosen("cn", 0.1, "今天天气好", "今天田七号")
    assert loud[0] == "a" and transcripts.chosen("cn", 0.1, "今天天气好", "今天田七号", compat=True)[0] == "drop"
    assert transcripts.distance("你好", "你们") == 1
