"""Column functions over maps, JSON objects, paths and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_map(text: Column) -> Column:
    """A JSON object as a map of strings; null for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def merged(a: Column, b: Column) -> Column:
    """Two maps in one; b wins."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(y, x))


def choices(names: Column, shown: Column) -> Column:
    """Displayed names to raw names."""
    return F.map_from_arrays(shown, names)


def is_included(path: Column, excluded: list[str], folder: str, suffix: str) -> Column:
    """Outside excluded folders, and inside one folder only with a suffix."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, excluded))) & (~F.array_contains(parts, folder) | F.endswith(path, F.lit(suffix)))


def expand(ids: Column, placeholder: int, n: Column) -> Column:
    """Each placeholder as often as n says; n of 0 is an error where there is one."""
    checked = F.when((n == 0) & F.array_contains(ids, placeholder), F.raise_error(F.lit("nothing to put for a placeholder"))).otherwise(n).cast("int")
    return F.flatten(F.transform(ids, lambda x: F.when(x == placeholder, F.array_repeat(x, checked)).otherwise(F.array(x))))


def expand_text(text: Column, placeholder: str, counts: Column) -> Column:
    """The i-th placeholder of a text as often as the i-th count says."""
    parts = F.split(text, placeholder)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(parts) - 1, F.repeat(F.lit(placeholder), F.get(counts, i))).otherwise(F.lit("")))), "")


def paired(words: Column, stamps: Column) -> Column:
    """Words with the stamps at twice their place and the one after."""
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), F.get(stamps, i * 2).alias("start_time"), F.get(stamps, i * 2 + 1).alias("end_time")))


def rename_weight(name: Column) -> Column:
    """Attention weights of q, k and v under one stacked name."""
    return F.regexp_replace(name, r"\.(q|k|v)_proj\.", ".qkv_proj.")


def without_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(weight|bias)$", "")


def round_up(n: Column, to: int) -> Column:
    """The least multiple that is not below n."""
    return F.ceil(n / to) * to


def first_or_none(ids: Column) -> Column:
    return F.coalesce(F.get(ids, 0), F.lit(-1))


def data_url(data: Column, kind: str) -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(data))
