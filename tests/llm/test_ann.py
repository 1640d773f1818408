import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lyrebird.llm import ann


def brute(rows, k=20):
    rows = [(i, np.asarray(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            best = {}
            for i, y in rows:
                if i != q and len(y) == len(x):
                    best[i] = max(best.get(i, -np.inf), float((x * y).sum()))
            out[q] = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(3)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_and_exact_scores(spark, uneven):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if uneven:
        x *= rng.uniform(0.2, 3, (1500, 1)).astype(np.float32)
    x[300:700] = x[5]  # a group of copies: ties go to the smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    ours, exact = found(ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)), brute(rows)
    assert ours.keys() == exact.keys()
    hit = sum(len({i for i, _ in ours[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hit >= 0.93 * sum(map(len, exact.values()))
    lookup = {(q, i): s for q in exact for i, s in [(i, float((x[q].astype(float) * x[i]).sum())) for i, _ in ours[q]]}
    assert all(abs(lookup[q, i] - s) < 1e-12 for q in ours for i, s in ours[q])
    assert uneven or [i for i, _ in ours[320]] == [5, *range(300, 319)]


def test_bad_vectors_few_rows_and_repeats(spark):
    good = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [-1.0, -1.0]), (20, [0.5, 0.5]), (3, [3.0, 3.0]), (3, [1.0, 1.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    assert found(ann.nearest(table(spark, good + bad), F.col("vec_id") % 20 == 0)) == brute(good)
    assert ann.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(table(spark, bad[:2]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0, 1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_small_probes_fall_back_to_all_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    ours = found(ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, tables=1, probes=1, hashes=2))
    assert {q: [i for i, _ in v] for q, v in ours.items()} == {q: [i for i, _ in v] for q, v in brute(rows).items()}


def test_rotation_keeps_lengths_and_buckets_are_probed():
    x = np.random.default_rng(1).normal(size=(50, 64))
    y = ann.rotated(x, 2, 1)
    assert np.allclose((x @ x.T), (y @ y.T))
    for hashes in (1, 2):
        assert (ann.buckets(x, 3, hashes)[:, None] == ann.probed(x, 3, hashes, 8)).any(axis=1).all()


def test_recall_of_a_table_past_the_former_switch_to_two_hashes(spark):
    n, d = 135_000, 16  # one more axis was joined from 131,072 rows of 16 dimensions on
    x = np.random.default_rng(8).normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.range(n).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x[b.column(0).to_numpy()]), pa.list_(pa.float32()))], ["vec_id", "embedding"]) for b in batches), "vec_id long, embedding array<float>")
    ours = found(ann.nearest(rows, F.col("vec_id") % 3000 == 0))
    wide, hit = x.astype(np.float64), 0
    for q in range(0, n, 3000):
        score = wide @ wide[q]
        score[q] = -np.inf
        hit += len({i for i, _ in ours[q]} & set(np.argpartition(-score, 19)[:20].tolist()))
    assert len(ours) == 45 and hit >= 0.98 * 20 * 45, hit / (20 * 45)


def test_repeats_of_one_id_take_one_place(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(0, base.tolist())] + [(1, (base * (1 + 0.001 * i)).tolist()) for i in range(30)]
    rows += [(i, (base * 0.9 + rng.normal(size=8) * 0.05).tolist()) for i in range(2, 50)]
    exact = brute(rows)
    one = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>").coalesce(1)
    ours = found(ann.nearest(one, F.col("vec_id") % 20 == 0))
    assert {q: [i for i, _ in v] for q, v in ours.items()} == {q: [i for i, _ in v] for q, v in exact.items()}


def test_ranks_count_the_nearer_buckets():
    rng = np.random.default_rng(6)
    x, y = ann.unit_vectors(rng.normal(size=(30, 8)), 8, None), ann.unit_vectors(rng.normal(size=(30, 8)), 8, None)
    for hashes in (1, 2, 3):
        rank = ann.ranks(x, y, hashes, 2)
        assert (ann.ranks(np.repeat(x, 2, axis=0), np.repeat(y, 2, axis=0), hashes, 2, np.repeat(np.arange(30), 2)) == np.repeat(rank, 2)).all()
        for i in range(30):
            found = [ann.buckets(y[i : i + 1], t, hashes)[0] in ann.probed(x[i : i + 1], t, hashes, int(rank[i]) + 1)[0] for t in range(2)]
            assert any(found)
            assert rank[i] == 0 or not any(ann.buckets(y[i : i + 1], t, hashes)[0] in ann.probed(x[i : i + 1], t, hashes, int(rank[i]))[0] for t in range(2))


@pytest.mark.parametrize("kind", ["clustered", "random"])
@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_with_measured_probes(spark, monkeypatch, kind, hashes):
    """50,000 vectors of 16 dimensions, each number of axes; prints the share of the rows that the probed buckets hold."""
    n, d = 50_000, 16
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, d))
    if kind == "clustered":
        x = rng.normal(size=(200, d))[rng.integers(0, 200, n)] + 0.4 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    monkeypatch.setattr(ann, "TABLES", {hashes: ann.TABLES[hashes]})
    measured, plan = [], ann.cheapest
    monkeypatch.setattr(ann, "cheapest", lambda *a: measured.append(plan(*a)) or measured[-1])
    rows = spark.range(n).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x[b.column(0).to_numpy()]), pa.list_(pa.float32()))], ["vec_id", "embedding"]) for b in batches), "vec_id long, embedding array<float>")
    ours = found(ann.nearest(rows, F.col("vec_id") % 200 == 0))
    wide, hit = x.astype(np.float64), 0
    for q in range(0, n, 200):
        score = wide @ wide[q]
        score[q] = -np.inf
        hit += len({i for i, _ in ours[q]} & set(np.argpartition(-score, 19)[:20].tolist()))
    _, tables, probes = measured[0]
    share = tables * probes / (2 * d) ** hashes
    print(f"{kind}, {hashes} axes: recall {hit / (20 * len(ours)):.3f}, share {share:.3f}")
    assert len(ours) == 250 and hit >= 0.95 * 20 * 250
    assert hashes == 1 or share < 0.5


def test_huge_components_do_not_overflow_the_norm(spark):
    rows = [(i, [1e200 * (1 + i % 7), 1e200 * (1 + i % 5), 1e199 * i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ours = found(ann.nearest(df, F.col("vec_id") % 20 == 0))
    assert sorted(ours) == [0, 20, 40] and all(len(v) == 20 for v in ours.values())
    assert np.isfinite(ann.unit_vectors(np.array([r[1] for r in rows]), 4, 1e201)).all()
