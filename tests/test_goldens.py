"""Literal expectations: sampling cases, text repair, numbers, alignment, formats."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.functions import numbers, quant
from lyrebird.functions import text as T
from lyrebird.functions import vectors as V
from lyrebird.operators import runs, segments, tokens
from lyrebird.operators import sampling as S


def candidates(spark, p):
    return spark.createDataFrame([(0, i, math.log(x)) for i, x in enumerate(p)], "vec_id long, tok int, x double")


def kept(rows):
    return [round(r.p, 4) for r in S.softmax(rows).orderBy(F.desc("p")).collect()]


CASES = [
    (lambda r: S.top_k(r, 1), [0.1, 0.2, 0.3, 0.4], [1.0]),
    (lambda r: S.top_k(r, 3), [0.1, 0.2, 0.3, 0.4], [0.4444, 0.3333, 0.2222]),
    (lambda r: S.top_k(r, 0), [0.1, 0.2, 0.3, 0.4], [0.4, 0.3, 0.2, 0.1]),
    (lambda r: S.top_p(r, 0), [0.1, 0.2, 0.3, 0.4], [1.0]),
    (lambda r: S.top_p(r, 0.7), [0.1, 0.2, 0.3, 0.4], [0.5714, 0.4286]),
    (lambda r: S.top_p(r, 0.8), [0.1, 0.2, 0.3, 0.4], [0.4444, 0.3333, 0.2222]),
    (lambda r: S.top_p(r, 1), [0.1, 0.2, 0.3, 0.4], [0.4, 0.3, 0.2, 0.1]),
    (lambda r: S.min_p(r, 0.26), [0.1, 0.2, 0.3, 0.4], [0.4444, 0.3333, 0.2222]),
    (lambda r: S.min_p(r, 0.76), [0.1, 0.2, 0.3, 0.4], [1.0]),
    (lambda r: S.xtc(r, 0.19, 0.99, F.lit(0.0)), [0.4, 0.3, 0.2, 0.1], [0.6667, 0.3333]),
    (lambda r: S.typical(r, 0.5), [0.97, 0.01, 0.01, 0.01], [1.0]),
    (lambda r: S.typical(r, 0.5), [0.4, 0.2, 0.2, 0.2], [0.3333, 0.3333, 0.3333]),
    (lambda r: S.top_n_sigma(r, 1.0), [0.1, 0.2, 0.3, 0.4], [0.5714, 0.4286]),
    (lambda r: S.temperature(r, 0), [0.1, 0.2, 0.3, 0.4], [1.0, 0.0, 0.0, 0.0]),
]


@pytest.mark.parametrize("step,p,expected", CASES)
def test_filters(spark, step, p, expected):
    assert kept(candidates(spark, p).transform(step)) == pytest.approx(expected, abs=2e-4)


def test_penalties(spark):
    rows = candidates(spark, [0.2] * 5)
    history = rows.where("tok = 0").select("vec_id", "tok")
    assert kept(S.penalties(rows, history, 50.0, 0.0, 0.0)) == pytest.approx([0.25] * 4 + [0.0], abs=1e-3)


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_languages(spark):
    row = one(spark, "cHINese", T.language_name(F.col("t")).alias("a"), T.is_known_language(F.lit("Klingon")).alias("b"), T.is_known_language(F.lit(None).cast("string")).alias("c"))
    assert (row.a, row.b, row.c) == ("Chinese", False, False)
    with pytest.raises(Exception, match="language is empty"):
        one(spark, "  ", T.language_name(F.col("t")))
    names = spark.createDataFrame([(["Chinese", "English", None, " ", "English"],)], "n array<string>")
    assert names.select(T.merge_languages(F.col("n"))).first()[0] == "Chinese,English"


@pytest.mark.parametrize(
    "raw,forced,expected",
    [
        ("language None<asr_text>", None, ("", "")),
        ("language None<asr_text> yes ", None, ("", "yes")),
        ("language chinese<asr_text>你好", None, ("Chinese", "你好")),
        ("language Chinese\nx\n<asr_text> a ", None, ("Chinese", "a")),
        (" no tag ", None, ("", "no tag")),
        ("language x<asr_text>a", "German", ("German", "language x<asr_text>a")),
        (None, "German", ("", "")),
        ("  ", None, ("", "")),
        ("x<asr_text>a<asr_text>b", None, ("", "a<asr_text>b")),
    ],
)
def test_parse_output(spark, raw, forced, expected):
    row = spark.createDataFrame([(raw, forced)], "r string, f string").select(T.parse_output(F.col("r"), F.col("f")).alias("p")).first().p
    assert (row.language, row.text) == expected


def test_tokens(spark):
    text = "Hello, 世界! it's　o.k. — 3x字y"
    row = one(spark, text, T.general_tokens(F.col("t")).alias("g"), T.mixed_tokens(F.col("t")).alias("m"), T.tokens(F.col("t"), F.lit("JAPANESE")).alias("j"))
    assert row.g == ["Hello", "世", "界", "it's", "ok", "3x", "字", "y"]
    assert row.m == ["Hello", "世", "界", "it's", "o", "k", "3x", "字", "y"]
    assert row.j == list(text)


def shrink(text):
    """The plain loop: runs of more than 20 equal characters, then repeated patterns, leftmost and shortest first."""
    text = re.sub(r"(?s)(.)\1{20,}", r"\1", text)
    out, i = "", 0
    while i < len(text):
        for k in range(1, 21):
            n = 1
            while text[i + n * k : i + (n + 1) * k] == text[i : i + k] and len(text) >= i + (n + 1) * k:
                n += 1
            if n >= 20 and len(text) - i >= 40:
                out, i = out + text[i : i + k], i + n * k
                break
        else:
            out, i = out + text[i], i + 1
    return out


def test_repetitions(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))) + "".join(rng.choices("xyz", k=rng.randint(1, 6))) * rng.choice([1, 19, 20, 21, 25]) + "tail" * rng.choice([0, 3]) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fix_repetitions(F.col("t")).alias("f")).collect()
    assert all(r.f == shrink(r.t) for r in rows)
    assert any(r.f != r.t for r in rows)


@pytest.mark.parametrize(
    "spoken,written",
    [("幺九二点幺六八点幺点幺", "192.168.1.1"), ("三五百人", "300~500人"), ("五六十", "50~60"), ("三四十万", "30~40万"), ("十五六", "15~16"), ("四十五六万", "45~46万"), ("一百六七", "160~170"), ("百分之五十", "50%"), ("三分之二", "2/3"), ("十点二十分", "10:20"), ("乱七八糟", "乱七八糟"), ("几百人", "几百人"), ("二零二五年十月", "2025年10月"), ("没有", "没有"), ("八千克", "8kg"), ("五比三", "5:3"), ("第三", "第三"), ("十", "十"), ("B五", "B5"), ("两个人", "2个人"), ("百分之三点五", "3.5%")],
)
def test_numbers(spoken, written):
    assert numbers.written(spoken) == written


def test_stamps_and_alignment():
    assert segments._repaired([]) == []
    assert segments._repaired([0, 100, 5000, 200, 300]) == [0, 100, 100, 200, 300]
    assert segments._repaired([0, 9000, 9100, 9200, 400, 500, 600, 700]) == [0, 100, 200, 300, 400, 500, 600, 700]
    items = [{"text": "Hello", "start_time": 0.0, "end_time": 0.5}, {"text": "dont", "start_time": 0.6, "end_time": 1.0}]
    assert [(x["text"], x["start_time"], x["end_time"]) for x in segments._reconciled("Hello, do-nt!", items)] == [("Hello", 0.0, 0.5), (", ", 0.5, 0.5), ("do-nt", 0.6, 1.0), ("!", 1.0, 1.0)]
    assert segments._reconciled("x", []) == [{"text": "x", "start_time": 0.0, "end_time": 0.0}] and segments._reconciled("", []) == []


def test_cues(spark):
    words = [("Hi", 0.0, 0.4), (" there,", 0.5, 0.9), (" you.", 1.0, 1.5), (" rest：", 1.6, 2.0)]
    table = spark.createDataFrame([(words,)], f"items {segments.ITEMS}")
    cues = table.select(segments.cues(F.col("items")).alias("c")).first().c
    assert [(c.start, c.end, c.text) for c in cues] == [(0.0, 0.9, "Hi there"), (1.0, 1.5, "you"), (1.6, 2.0, "rest")]
    block = table.select(segments.srt(F.struct(F.lit(3661.5).alias("start"), F.lit(3662.0).alias("end"), F.lit("x").alias("text")), F.lit(1))).first()[0]
    assert block == "1\n01:01:01,500 --> 01:01:02,000\nx\n\n"


def test_quiet_splits():
    rng = np.random.default_rng(0)
    wave = rng.normal(size=5000)
    wave[1900:2000] = 0
    ends = segments.quiet_splits(wave, 100, 20.0)
    assert ends[0] == 1900 and ends[-1] == 5000 and all(b > a for a, b in zip(ends, ends[1:], strict=False))
    assert segments.quiet_splits(wave[:1000], 100, 20.0) == [1000]


def test_split_audio_keeps_every_sample(spark):
    wave = [float(i % 7) for i in range(2030)]
    rows = segments.split_audio(spark.createDataFrame([(1, 100, wave)], "clip_id long, sr int, wav array<float>"), 5.0).orderBy("chunk").collect()
    starts = [round(r.offset_sec * 100) for r in rows] + [2030]
    assert [x for r, a, b in zip(rows, starts, starts[1:], strict=False) for x in r.wav[: b - a]] == wave
    assert all(len(r.wav) >= 50 for r in rows)


@pytest.mark.parametrize("kind", sorted(quant.PACKED))
def test_packed_formats(kind):
    values = (0.1 + 2 * np.cos(np.arange(4096))).astype(np.float32)
    data = quant.packed_bytes(values, kind)
    assert len(data) == 4096 // 32 * quant.PACKED[kind][0]
    limits = {"q8_0": 0.0022, "q4_0": 0.0023, "q4_1": 0.0023, "q5_0": 0.0023, "q5_1": 0.0023, "bf16": 0.0001}
    assert math.sqrt(((quant.unpacked(data, kind) - values) ** 2).sum()) / 4096 < limits[kind]
    assert (quant.unpacked(quant.packed_bytes(np.zeros(64), kind), kind) == 0).all()


def test_small_helpers(spark):
    row = spark.range(1).select(
        T.rounded_count(F.lit(7.6e9), F.lit(2)).alias("b"), T.rounded_count(F.lit(1e6), F.lit(2)).alias("k"), T.title_of(F.lit("Some-model-v1.2-7b")).alias("t"), T.display_name(F.lit("auto_detect")).alias("d"), T.base64_payload(F.lit("data:audio/wav;base64,AA==")).alias("p"),
        runs.ratio(F.lit(1.0), F.lit(0.0)).alias("z"), tokens.common_prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3), F.lit(4))).alias("c"), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("one"), T.dictionary_token(F.lit("abcd"), F.array(F.lit("a"), F.lit("abc"))).alias("w"),
    ).first()
    assert row.b == "7.6B" and row.k == "1000K" and row.t == "Some Model v1.2 7b" and row.d == "Auto Detect" and row.p == "AA==" and row.z == 0 and row.c == 1 and row.one == 1 and row.w == "abc"


def test_resampled_tones_and_features(spark):
    from lyrebird.functions import audio

    tone = [float(v) for v in np.sin(np.arange(8000) * 2 * 2 * np.pi * 110 / 8000)]
    found = spark.createDataFrame([(tone, 8000)], "wave array<double>, sr int").select(audio.resample(F.col("wave"), F.col("sr")).alias("w")).first().w
    expected = np.sin(np.arange(1000, 15001) * 2 * 2 * np.pi * 110 / 16000)
    assert np.abs(np.array(found[1000:15001]) - expected).max() < 0.01
    features = audio.log_mel_of(np.sin(np.arange(16000) * 2 * np.pi * 1000 / 16000))
    assert features.shape == (128, 100) and features.min() >= features.max() - 2
    centre = audio.mel_filters()[25].argmax()  # the bin of 1000 Hz
    assert abs(int(features[:, 50].argmax()) - int(centre)) <= 1


def test_custom_functions(spark):
    from lyrebird.functions.custom import gelu_exact, map_custom

    x = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    row = x.select(map_custom(lambda a: a + 1, F.col("a")), map_custom(lambda a, b: a * b, F.col("a"), F.col("b")), map_custom(lambda a, b, c: a + b + c, F.col("a"), F.col("b"), F.col("c")), gelu_exact(F.col("a"))).first()
    assert tuple(row)[:3] == (2.0, 2.0, 6.0) and row[3] == pytest.approx(0.8413447)
    with pytest.raises(ValueError, match="one to three"):
        map_custom(lambda: 0)


def test_subtitle_file(spark):
    items = [("一共", 0.0, 0.5), ("三百二十个，", 0.5, 1.5), ("百分之五。", 1.6, 2.0)]
    rows = spark.createDataFrame([(1, items)], "id long, items array<struct<text:string,start_time:double,end_time:double>>")
    body = segments.subtitle_file(rows, ["id"], "items").first().body
    assert body == "1\n00:00:00,000 --> 00:00:01,500\n一共320个\n\n2\n00:00:01,600 --> 00:00:02,000\n5%\n\n"


def test_suffix_penalties(spark):
    from lyrebird.operators import sampling

    def penalties(context, breakers=(), least=2):
        rows = spark.createDataFrame([(1, list(context))], "id long, w array<int>")
        return {r.token: round(r.penalty, 6) for r in sampling.suffix_penalties(rows, ["id"], "w", list(breakers), 1.0, 2.0, least).collect()}

    assert penalties([0, 1, 2, 0, 1]) == {2: 1.0}
    assert penalties([0, 1, 2, 3, 4, 1]) == {}
    assert penalties([7, 0, 1, 2, 0, 1, 2]) == {0: 2.0}
    assert penalties([0, 1, 2, 0, 1], breakers=[0]) == {} and penalties([0, 1, 2, 0, 1], breakers=[0], least=1) == {2: 1.0}
    assert penalties([5]) == {} and penalties([]) == {}
    assert penalties([3, None, 3, None], least=1) == {}


def test_repeat_lengths():
    import random

    from lyrebird.operators import sampling

    rng = random.Random(5)
    for _ in range(300):
        codes = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        plain = [next((k for k in range(len(codes) - i) if codes[k] != codes[i + k]), len(codes) - i) for i in range(len(codes))]
        assert sampling.repeat_lengths(codes) == plain
    assert sampling.repeat_lengths([1] * 200_000)[1] == 199_999


def test_best_prefixes(spark):
    from lyrebird.operators import tokens

    words = spark.createDataFrame([(w,) for w in ["학교에서", "학교", "학생", "ab", "abcd", "xyz", "", None, "학교에서"]], "word string")
    entries = spark.createDataFrame([("학교", 0.5), ("학교", 0.9), ("학교에", 0.9), ("학", 2.0), ("ab", 0.1), ("abc", 0.05), (None, 9.0)], "entry string, score double")
    found = {r.word: (r.left, r.right) for r in tokens.best_prefixes(words, entries).collect()}
    assert found == {"학교에서": ("학교에", "서"), "학교": ("학교", ""), "학생": ("학생", ""), "ab": ("ab", ""), "abcd": ("ab", "cd"), "xyz": ("xyz", ""), "": ("", "")}
    assert tokens.best_prefixes(words, entries.limit(0)).where("left = word").count() == 7
    assert tokens.best_prefixes(words.limit(0), entries).count() == 0
