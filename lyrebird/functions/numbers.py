"""Chinese numbers in transcripts, written as digits.

`digits`, `value` and `spelt` are column functions. `normalise` reads whole sentences: a span that may
hold a number is found by a pattern, then the first rule that fits it says how it is written. Idioms
and vague amounts stay. The rules are Python, run on Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Units that may follow a number, and how they are written where that differs.
UNITS = {
    "个": None, "只": None, "分": None, "万": None, "亿": None, "秒": None, "年": None, "月": None, "日": None, "天": None, "时": None,
    "钟": None, "人": None, "层": None, "楼": None, "倍": None, "块": None, "次": None, "克": "g", "千克": "kg", "米": None, "千米": None, "千米每小时": "km/h",
}
# The values of number characters.
DIGIT = {"零": 0, "幺": 1, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
PLACE = {"十": 10, "百": 100, "千": 1000, "万": 10000, "亿": 100000000}
# Idioms that stay as they are.
IDIOMS = """
正经八百 五零二落 五零四散 五十步笑百步 乌七八糟 污七八糟 四百四病 思绪万千 十有八九 十之八九 三十而立 三十六策 三十六计 三十六行
三五成群 三百六十行 三六九等 七老八十 七零八落 七零八碎 七七八八 乱七八遭 乱七八糟 略知一二 零零星星 零七八碎 九九归一 二三其德
二三其意 无银三百两 八九不离十 百分之百 年三十 烂七八糟 一点一滴 路易十六 九三学社 五四运动 入木三分 九九八十一 三七二十一
十二五 十三五 十四五 十五五 十六五 十七五 十八五
""".split()

SOME = "[一二两三四五六七八九]"
NUMBER = "[零一二两三四五六七八九十百千万]"
UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
#: Spans that may hold a number, with a Latin letter before and a unit or letter after.
SPAN = re.compile(
    rf"(?P<head>[a-zA-Z]\s*)?(?P<body>(?:[几零幺一二两三四五六七八九十百千万点比]|[零一二三四五六七八九十] |分之|(?<=[一二两三四五六七八九十])[年月日号分])+"
    rf"(?:(?<=[一二两三四五六七八九十])(?:{UNIT}|[a-zA-Z年月日号])|(?<=[百千万])(?:{UNIT}))?)"
)


def digits(text: Column) -> Column:
    """Number characters one by one as digits, the spoken point as a full stop."""
    return F.translate(text, "零一幺二两三四五六七八九点", "011223456789.")


def spelt(n: Column) -> Column:
    """A whole number from 1 to 9999 in Chinese."""
    figures = F.lpad(n.cast("string"), 4, "0")
    full = F.concat(*[F.concat(F.translate(F.substring(figures, i + 1, 1), "0123456789", "零一二三四五六七八九"), F.lit(place)) for i, place in enumerate(["千", "百", "十", ""])])
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(full, "零[千百十]", "零"), "零+", "零"), "^零|零$", "")


def value(text: Column) -> Column:
    """The value of a number spelt with places; a fold over its characters."""
    known = F.create_map(*[F.lit(x) for pair in {**DIGIT, **PLACE}.items() for x in pair])
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("part"), zero.alias("digit"))

    def step(s: Column, c: Column) -> Column:
        v = known[c].cast("long")
        small = s["part"] + F.when((s["digit"] == 0) & (s["part"] == 0) & (v == 10), F.lit(1)).otherwise(s["digit"]) * v
        large = (s["total"] + s["part"] + s["digit"]) * v
        return F.when(v >= 10000, F.struct(large.alias("total"), zero.alias("part"), zero.alias("digit"))).when(v >= 10, F.struct(s["total"].alias("total"), small.alias("part"), zero.alias("digit"))).otherwise(F.struct(s["total"].alias("total"), s["part"].alias("part"), v.alias("digit")))

    return F.aggregate(F.split(text, ""), start, step, lambda s: s["total"] + s["part"] + s["digit"])


def _value(text: str) -> int:
    total = part = digit = 0
    for c in text:
        if c in DIGIT:
            digit = DIGIT[c]
        elif PLACE[c] >= 10000:
            total, part, digit = (total + part + digit) * PLACE[c], 0, 0
        else:
            part += (digit or (1 if not part else 0)) * PLACE[c]
            digit = 0
    return total + part + digit


def _plain(text: str) -> str:
    return "".join("." if c == "点" else str(DIGIT.get(c, c)) for c in text)


def _number(text: str) -> str:
    """A spelt number; places from ten thousand on stay as characters."""
    whole, point, rest = text.partition("点")
    last = whole[-1:] if len(whole) > 1 and whole[-1:] in "万亿" else ""
    return str(_value(whole[: -1] if last else whole)) + ("." + _plain(rest) if point else "") + last


def _range(text: str) -> str | None:
    """Two neighbouring digits before, after or without a place: an approximate amount."""
    if m := re.fullmatch(rf"([二三四五六七八九])([二三四五六七八九])([十百千万亿])([万千百亿])?({UNIT})?", text):
        a, b, place, more, unit = m.groups(default="")
        keep = place in "万亿" or (place == "千" and more)
        scale = 1 if keep else PLACE[place]
        return f"{DIGIT[a] * scale}~{DIGIT[b] * scale}{place if keep else ''}{more}{unit}"
    if m := re.fullmatch(rf"(十|[一二三四五六七八九]+[十百千万])([一二三四五六七八九])([一二三四五六七八九])([万千亿])?({UNIT})?", text):
        base, a, b, more, unit = m.groups(default="")
        step = PLACE[base[-1]] // 10
        return f"{_value(base) + DIGIT[a] * step}~{_value(base) + DIGIT[b] * step}{more}{unit}"
    if (m := re.fullmatch(r"([一二三四五六七八九])([一二三四五六七八九])", text)) and DIGIT[m[2]] == DIGIT[m[1]] + 1:
        return f"{DIGIT[m[1]]}~{DIGIT[m[2]]}"
    return None


def _written(text: str) -> str:
    if "几" in text or text == "一":
        return text
    if (found := _range(text)) is not None:
        return found
    if m := re.fullmatch(rf"({NUMBER}+)点({NUMBER}+)分(?:({NUMBER}+)秒)?", text):
        return ":".join(f"{_value(x):02d}" for x in m.groups() if x)
    unit = next((u for u in sorted(UNITS, key=len, reverse=True) if text.endswith(u) and len(text) > len(u) and not (u in "万亿" and len(text) == len(u))), "")
    if not unit and (m := re.search(r"[a-zA-Z]+$", text)):
        unit = m[0]
    body, shown = text[: len(text) - len(unit)].strip() if unit else text.strip(), UNITS.get(unit) or unit
    if body == "一" and unit:
        return text
    if re.fullmatch(r"[零幺一二两三四五六七八九]+(点[零幺一二三四五六七八九]+)*", body) and unit not in "万亿年月日号" or re.fullmatch(r"[零幺一二三四五六七八九]{2,}(点[零幺一二三四五六七八九]+)*", body):
        return _plain(body) + shown
    if m := re.fullmatch(rf"(?:十{SOME})+|(?:{SOME}百零?{SOME})+", body):
        parts = re.findall(rf"十{SOME}|{SOME}百零?{SOME}", body)
        if len(parts) > 1:
            return " ".join(str(_value(p)) for p in parts) + shown
    if re.fullmatch(rf"{NUMBER}+(点[零一二三四五六七八九]+)?", body):
        return _number(body) + shown
    if m := re.fullmatch(rf"百分之({NUMBER}+(?:点[零一二三四五六七八九]+)?)", text):
        return _number(m[1]) + "%"
    for mark, sign in (("分之", "/"), ("比", ":")):
        if m := re.fullmatch(rf"({NUMBER}+(?:点[零一二三四五六七八九]+)?){mark}({NUMBER}+(?:点[零一二三四五六七八九]+)?)", text):
            pair = [_number(m[1]), _number(m[2])]
            return sign.join(reversed(pair) if mark == "分之" else pair)
    if m := re.fullmatch(rf"(?:({NUMBER}+)年)?(?:({NUMBER}+)月)?(?:({NUMBER}+)([日号]))?", text):
        year, month, day, mark = m.groups()
        return (f"{_plain(year) if len(year) > 2 and not set(year) & set(PLACE) else _value(year)}年" if year else "") + (f"{_value(month)}月" if month else "") + (f"{_value(day)}{mark}" if day else "")
    return text


def written(text: str) -> str:
    """One sentence with its numbers in digits."""

    def one(span: re.Match) -> str:
        begin = max(span.start("body") - 2, 0)
        if len(span["body"]) == 1 and not span["head"]:  # one character alone is no number
            return span[0]
        if any(begin <= text.find(idiom) < span.end("body") for idiom in IDIOMS):
            return span[0]
        return (span["head"] or "") + _written(span["body"])

    return SPAN.sub(one, text)


def normalise(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(written, na_action="ignore")

    return run(text)
