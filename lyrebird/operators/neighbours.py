"""Exact nearest rows of a stated set of queries, by blocks of rows and of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and queries that a task holds the best rows of.
BLOCK, QUERIES = 2048, 32768
#: Order of a null cosine (last), and of NaN (first).
NULL, NAN = -2.0, 2.0


def _blocks(rows: DataFrame) -> DataFrame:
    """(ids, d, vectors, missing) of rows (id, a): up to BLOCK vectors of equal length in one row, by rising id; vectors that are null or hold nulls are zero and marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(d: int, own: list[tuple]) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in own])
            by = np.argsort(ids, kind="stable")
            vectors, missing = (np.concatenate([x[k] for x in own])[by] for k in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array([ids[by].tobytes()], pa.binary()), pa.array([d], pa.int32()), pa.array([vectors.tobytes()], pa.binary()), pa.array([missing.tobytes()], pa.binary())], ["ids", "d", "vectors", "missing"])

        for batch in batches:
            ids, arrays = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.array(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = arrays.flatten()
            holes = flat.is_null().to_numpy(zero_copy_only=False)
            values = np.where(holes, 0.0, flat.fill_null(0.0).to_numpy(zero_copy_only=False))
            missing = arrays.is_null().to_numpy(zero_copy_only=False).copy()
            ends = np.cumsum(lengths)
            if holes.any():
                missing[np.searchsorted(ends, np.flatnonzero(holes), side="right")] = True
            for d in np.unique(lengths):
                which = np.flatnonzero(lengths == d)
                own = values[((ends - lengths)[which, None] + np.arange(d)).ravel()].reshape(len(which), d)
                own[missing[which]] = 0.0
                for k in range(0, len(which), BLOCK):
                    parts = held.setdefault(int(d), [])
                    parts.append((ids[which[k : k + BLOCK]], own[k : k + BLOCK], missing[which[k : k + BLOCK]]))
                    if sum(len(x[0]) for x in parts) + BLOCK > 2 * BLOCK:
                        yield out(int(d), held.pop(int(d)))
        for d, own in held.items():
            yield out(d, own)

    return rows.mapInArrow(run, "ids binary, d int, vectors binary, missing binary")


def _cosines(q: np.ndarray, r: np.ndarray, q_missing: np.ndarray, r_missing: np.ndarray) -> np.ndarray:
    """As `functions.vectors.cosine`, with NULL for null: 1 for two zero vectors, 0 for one."""
    with np.errstate(all="ignore"):
        n, m = (q * q).sum(axis=1), (r * r).sum(axis=1)
        c = (q @ r.T) / np.sqrt(n[:, None] * m) if q.shape[1] == r.shape[1] else np.full((len(q), len(r)), NULL)
    n_zero, m_zero = (n == 0) & ~q_missing, (m == 0) & ~r_missing
    c[q_missing] = NULL
    c[:, r_missing] = NULL
    c[n_zero] = 0.0
    c[:, m_zero] = 0.0
    c[np.ix_(n_zero, m_zero)] = 1.0
    return c


def cosine_nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, cosine) of the k rows (id, a) of largest cosine for each of the queries (id, a), ties in `digits` decimals to the smaller id.

    Every pair is scored, as products of blocks, but only a task's k best rows of a query leave it. Tasks hold QUERIES
    queries' best rows and one block of each side, so memory doesn't grow; the work is rows times queries. A row
    is no neighbour of queries with its own id, and null ids take no part. Null cosines (null vectors or
    elements, lengths that differ) come last, NaN first.
    """
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    asked = queries.where("id is not null")
    shares = max(1, -(-asked.count() // QUERIES))
    left = _blocks(rows.where("id is not null")).repartition(tasks)
    right = _blocks(asked.repartition(shares)).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "d", "vectors", "missing")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own = [batch.column(c)[i].as_py() for c in range(8)]
                ids, q_ids = np.frombuffer(own[0], dtype=np.int64), np.frombuffer(own[4], dtype=np.int64)
                r, q = np.frombuffer(own[2]).reshape(len(ids), own[1]), np.frombuffer(own[6]).reshape(len(q_ids), own[5])
                c = _cosines(q, r, np.frombuffer(own[7], dtype=bool), np.frombuffer(own[3], dtype=bool))
                low, high = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
                for j in np.flatnonzero(low < high):
                    c[j, low[j] : high[j]] = -np.inf
                if own[4] not in best:
                    best[own[4]] = [np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max), np.full((len(q_ids), k), -np.inf)]
                hot = np.flatnonzero(~(c.max(axis=1) < best[own[4]][0][:, -1] - 10.0**-digits))
                if not len(hot):
                    continue
                c = c[hot]
                rounded = np.where(np.isnan(c), NAN, np.round(c, digits))
                at = []
                for _ in range(min(k, len(ids))):
                    taken = np.arange(len(hot)), rounded.argmax(axis=1)  # ids rise, so the first of equals has the smallest
                    at.append((rounded[taken], ids[taken[1]], c[taken]))
                    rounded[taken] = -np.inf
                order, found, raw = (np.concatenate([old[hot], np.stack(new, axis=1)], axis=1) for old, new in zip(best[own[4]], zip(*at, strict=True), strict=True))
                by = np.lexsort((found, -order), axis=1)[:, :k]
                for old, new in zip(best[own[4]], (order, found, raw), strict=True):
                    old[hot] = np.take_along_axis(new, by, axis=1)
        for key, (order, found, raw) in best.items():
            real = order > -np.inf
            cosine = pa.array(raw[real], pa.float64(), mask=order[real] == NULL)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(key, dtype=np.int64), real.sum(axis=1))), pa.array(found[real]), pa.array(order[real]), cosine], ["query_id", "vec_id", "at", "cosine"])

    met = left.crossJoin(right).mapInArrow(run, "query_id long, vec_id long, at double, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("at"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")
