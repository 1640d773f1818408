"""Wildcard names, merged candidates, stored sketches and late rows against plain versions."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lyrebird.operators import ranks, sketches
from lyrebird.operators.patterns import wildcard_lookup
from lyrebird.operators.sampling import infill, merged_by_prefix
from lyrebird.streaming import windows


def plain_lookup(name, patterns):
    best = None
    for stripped, suffix in enumerate(("", ".weight", ".bias")):
        if not name.endswith(suffix):
            continue
        form = name[: len(name) - len(suffix)]
        for pattern, known in patterns:
            is_open = pattern.startswith("**.")
            body = pattern[3:] if is_open else pattern
            regex = r"\.".join("([^.]*)" if s == "*" else re.escape(s) for s in body.split("."))
            m = re.fullmatch((r"(?:.*\.)?" if is_open else "") + regex, form)
            if m:
                order = (stripped, -len(body.split(".")), body.split(".").count("*"), pattern, known)
                if best is None or order < best[0]:
                    best = order, re.sub(r"\{(\d+)\}", lambda g: m.group(int(g[1]) + 1) if int(g[1]) < len(m.groups()) else g[0], known) + suffix
    return best[1] if best else None


def test_wildcards_pick_what_the_plain_rule_picks(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "*", "{0}", "weight", "x+"]
    patterns = sorted({(rng.choice(["", "", "**."]) + ".".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice(["n.{0}", "{1}-{0}{7}", "k{}"])) for _ in range(1500)})
    assert len({p for p, _ in patterns}) >= 500
    names = [".".join(rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice(["", ".weight", ".bias"]) for _ in range(300)] + ["", ".weight", "..", None, "a", "a"]
    rows = spark.createDataFrame([(i, n, "old") for i, n in enumerate(names)], "i int, asked string, name string")
    known = spark.createDataFrame([*patterns, (None, "x"), ("a", None)], "pattern string, known string")
    found = {r.i: r.name for r in wildcard_lookup(rows, known, "asked").collect()}
    assert found == {i: None if n is None else plain_lookup(n, patterns) for i, n in enumerate(names)}
    assert sum(v is not None for v in found.values()) > 100
    assert wildcard_lookup(rows, known.limit(0), "asked").where("name is not null").count() == 0
    assert wildcard_lookup(rows.limit(0), known, "asked").count() == 0


def plain_merge(pieces, p):
    p = list(p)
    for i in range(len(p)):
        for j in range(len(p)):
            if p[i] is not None and p[j] is not None and i != j and pieces[i] and pieces[j].startswith(pieces[i]):
                if p[j] > p[i]:
                    p[j], p[i] = p[j] + p[i], None
                else:
                    p[i], p[j] = p[i] + p[j], None
    return p


def test_merging_equals_the_double_loop():
    rng = random.Random(8)
    for _ in range(200):
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 25))]
        p = [rng.choice([None, rng.random(), 0.25]) for _ in pieces]
        assert merged_by_prefix(pieces, p) == plain_merge(pieces, p)


# What the sampler is documented to give for a gap: (piece, p, ends) of a step, then the pieces left with their shares.
GAPS = [
    ([("hel", 0.4, False), ("hello", 0.3, False), ("x", 0.299, False), ("", 0.001, True)], {0: 0.7 / 0.701, 3: 0.001 / 0.701}),  # x falls below a third
    ([("a", 0.5, False), ("b", 0.3, False), ("", 0.2, True)], {2: 1.0}),
    ([(str(i), 0.1, False) for i in range(10)], {99: 1.0}),
    ([("a", 0.9, False), (None, 0.1, False)], {0: 1.0}),
]


@pytest.mark.parametrize("step,left", GAPS)
def test_gaps(spark, step, left):
    rows = spark.createDataFrame([(5, i, math.log(p), piece, e) for i, (piece, p, e) in enumerate(step)], "vec_id long, tok int, x double, piece string, eog boolean")
    found = {r.tok: r.p for r in infill(rows, 99).collect()}
    assert found == pytest.approx(left)
    assert infill(rows.limit(0), 99).count() == 0


def test_sketches_of_parts_make_those_of_all(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("part"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"), (F.col("id") % 5000).alias("user"), F.rand(1).alias("value"))
    rows = rows.union(spark.createDataFrame([(0, "empty", None, None), (1, None, 1, 2.0)], "part long, g string, user long, value double"))
    parts = sketches.sketched(rows, ["g", "part"], "user", "value")
    twice = sketches.merged(sketches.merged(parts, ["g", "part"]), ["g"])
    found = {r.g: r for r in sketches.estimated(twice, ["g"], {"p10": 0.1, "p90": 0.9}).collect()}
    assert found["a"].n == 40_000 and found["b"].n == 20_000 and found["empty"].n == 1
    for g in "ab":
        assert abs(found[g].users - 5000) < 3 * sketches.ERROR * 5000
        assert abs(found[g].p10 - 0.1) < 0.02 and abs(found[g].p90 - 0.9) < 0.02
    assert found["empty"].users == 0 and found["empty"].p10 is None
    assert found[None].users == 1 and found[None].p90 == 2.0
    assert sketches.estimated(sketches.merged(parts.limit(0), ["g"]), ["g"], {"p10": 0.1}).count() == 0


def test_late_rows_are_kept_aside_and_batches_count_once(spark, tmp_path):
    home, start = str(tmp_path), datetime(2024, 1, 1)

    def send(*hours):
        frame = spark.createDataFrame([(None if h is None else start + timedelta(hours=h), i) for i, h in enumerate(hours)], windows.ARRIVALS)
        frame.coalesce(1).write.mode("append").parquet(f"{home}/in")
        windows.run(spark.readStream.schema(windows.ARRIVALS).parquet(f"{home}/in"), home, "ts", "2 hours", "1 hour", "1 HOUR")
        return {(r.began - start) / timedelta(hours=1): (r.n, r.n_late) for r in windows.windows(spark, home).collect()}

    assert send(0.5, None, 5.5) == {-1: (1, 0), 0: (1, 0), 4: (1, 0), 5: (1, 0)}
    # The watermark is 4.5 now: 3.5 is late for the window that began at 2 and in time for the one that began at 3.
    expected = {-1: (1, 1), 0: (1, 1), 2: (0, 1), 3: (1, 0), 4: (1, 0), 5: (1, 0)}
    assert send(3.5, 0.2) == expected
    late = spark.read.parquet(f"{home}/late/*")
    assert sorted((r.ts - start) / timedelta(hours=1) for r in late.collect()) == pytest.approx([0.2, 0.2, 3.5])
    # The last batch again, as after a failure before its progress was written.
    again = spark.createDataFrame([(start + timedelta(hours=3.5), 0), (start + timedelta(hours=0.2), 1)], windows.ARRIVALS)
    windows.counted(home, "ts", "2 hours", "1 hour", "1 HOUR")(again, 1)
    assert {(r.began - start) / timedelta(hours=1): (r.n, r.n_late) for r in windows.windows(spark, home).collect()} == expected


def test_sliding_means_go_over_the_edges_of_blocks(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([None, float(rng.randint(0, 9))])) for g, n in ((0, 500), (1, 1), (None, 40)) for i in sorted(rng.sample(range(3000), n))]
    df = spark.createDataFrame(rows, "g int, i int, v double").withColumn("extra", F.lit("x"))
    expected = {}
    for g in (0, 1, None):
        own = [(i, v) for h, i, v in rows if h == g]
        for at, (i, _) in enumerate(own):
            near = [v for _, v in own[max(0, at - 6) : at + 1] if v is not None]
            expected[g, i] = sum(near) / len(near) if near else None
    for block in (1, 10, 64):
        found = ranks.sliding_mean(df, ["g"], F.floor(F.col("i") / 100), ["i"], "v", 7, block=block).collect()
        assert len(found) == len(rows)
        assert {(r.g, r.i): r["mean"] for r in found} == pytest.approx(expected)
    assert ranks.sliding_mean(df.limit(0), ["g"], F.lit(0), ["i"], "v", 7).count() == 0
