"""Dotted names looked up in a table of patterns with wildcards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies of the patterns' shapes, so that names with equally many segments are dealt over so many tasks.
SALTS = 32


def shaped(patterns: DataFrame) -> DataFrame:
    """(pattern, known) plus `open` (begins with **), `body`, `k` (segments of the body) and `at` (places of *)."""
    own = patterns.where("pattern is not null and known is not null").groupBy("pattern").agg(F.min("known").alias("known"))
    is_open = F.col("pattern").startswith("**.")
    body = own.withColumn("open", is_open).withColumn("body", F.when(is_open, F.substring("pattern", 4, 1 << 30)).otherwise(F.col("pattern")))
    segments = F.split("body", r"\.")
    at = F.filter(F.transform(segments, lambda s, i: F.when(s == "*", i)), lambda i: i.isNotNull())
    return body.select("pattern", "known", "open", "body", F.size(segments).alias("k"), at.alias("at"))


def wildcard_lookup(rows: DataFrame, patterns: DataFrame, asked: str, suffixes: tuple[str, ...] = (".weight", ".bias")) -> DataFrame:
    """rows with `name`, null where no pattern of (pattern, known) fits the name in column `asked`.

    A * stands for one segment, a leading ** for any number of them, none included. A name is tried whole, then
    without each of `suffixes`, which the result gets back. Of the patterns that fit, the one that spells out
    the longest end of the name wins, then the one with fewer wildcards, then the smaller text; of a
    pattern given repeatedly, its smallest `known`. {0}, {1}, ... in `known` stand for what the wildcards took.

    Each different name meets the shapes (places of wildcards) for its number of segments, not the patterns;
    those are joined by the name with wildcards put in, so thousands of patterns cost one equal join. Nothing
    is broadcast by force. A column `name` of rows is replaced; null names give null.
    """
    known = shaped(patterns)
    shapes = known.select("open", "k", "at").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.select(F.col(f"`{asked}`").alias("_asked")).where("_asked is not null").distinct()
    forms = [F.struct(F.lit(0).alias("stripped"), F.col("_asked").alias("form"), F.lit("").alias("suffix"))]
    for i, suffix in enumerate(suffixes, 1):
        bare = F.expr(f"left(_asked, char_length(_asked) - {len(suffix)})")
        forms.append(F.when(F.col("_asked").endswith(suffix), F.struct(F.lit(i).alias("stripped"), bare.alias("form"), F.lit(suffix).alias("suffix"))))
    tried = own.select("_asked", F.explode(F.filter(F.array(*forms), lambda f: f.isNotNull())).alias("f")).select("_asked", "f.*").withColumn("parts", F.split("form", r"\."))
    ends = tried.withColumn("n", F.size("parts")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("tail", F.slice("parts", F.col("n") - F.col("k") + 1, F.col("k")))
    met = ends.withColumn("salt", F.pmod(F.xxhash64("_asked"), F.lit(SALTS)).cast("int")).join(shapes, ["k", "salt"]).where("open or k = n")
    body = F.array_join(F.transform("tail", lambda s, i: F.when(F.array_contains("at", i), F.lit("*")).otherwise(s)), ".")
    taken = F.transform("at", lambda i: F.get("tail", i))
    keyed = met.select("_asked", "stripped", "suffix", "k", "open", "at", body.alias("body"), taken.alias("taken"))
    fits = keyed.join(known.drop("k"), ["open", "at", "body"])
    order = F.struct("stripped", -F.col("k"), F.size("at"), "pattern")
    best = fits.groupBy("_asked").agg(F.min_by(F.struct("known", "taken", "suffix"), order).alias("b"))
    pieces = F.split("b.known", r"(?<=\})|(?=\{)")
    filled = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\{\d{1,4}\}$"), F.coalesce(F.get("b.taken", F.regexp_extract(p, r"\d+", 0).try_cast("int")), p)).otherwise(p)), "")
    named = best.select("_asked", F.concat(filled, "b.suffix").alias("_name"))
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "name"]
    return rows.join(named, F.col(f"`{asked}`") == F.col("_asked"), "left").select(*kept, F.col("_name").alias("name"))
