"""Extra columns named like the operators' own working columns pass through and change nothing."""

from pyspark.sql import functions as F

from lyrebird.llm import mixing, outliers, simhash, substrings

WORKING = ["doc", "tag", "places", "grp", "vector", "fit", "centre", "_id", "_fp", "_row", "rest", "whole", "mark", "prefix", "edge", "before", "copy", "own_4"]


def values(df, names):
    return sorted(map(str, df.select(*names).collect()))


def test_clashing_columns_pass_through(docs):
    plain = docs.drop("size")
    wide = plain.select("*", *[F.concat(F.lit(f"{name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in WORKING])
    kept_as_they_were = [F.col(name) == F.concat(F.lit(f"{name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in WORKING]
    for operator in (substrings.remove_repeats, simhash.one_of_each, outliers.keep_good, mixing.mix):
        expected, found = operator(plain), operator(wide)
        assert found.columns[: len(wide.columns)] == wide.columns
        same = F.lit(True)
        for one in kept_as_they_were:
            same = same & one
        assert found.where(~same).count() == 0
        names = [c for c in expected.columns if operator is not simhash.one_of_each or c != "text"]
        assert values(found, names) == values(expected, names)
