"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by pseudo-rotations, three rounds of random signs and a fast Hadamard
transform, and falls to the nearest signed axis. One to three such axes make a bucket of a table. A
query looks into the buckets of each table whose axes lie nearest to it, and all candidates found are
scored exactly on the original vectors, in double precision.

How many buckets are probed is measured: the true neighbours of SAMPLE queries, found among all rows,
tell how far down a query's list of buckets they lie, and as many are probed as hold the share TARGET
of them. That is done for one, two and three axes, and the least costly way is taken: more axes for
larger tables, always with the same share found. All rows are hashed, whatever the sample.

The measure is the largest inner product. Where norms differ, data vectors x become
(x, sqrt(M^2 - |x|^2)) / M, M the largest norm, and queries (q, 0) / |q|, which keeps the order.

Buckets differ in size, so each is cut into chunks of rows and of queries, and a task scores chunk
against chunk in numpy: no bucket is gathered, none is capped, and no pair becomes a row. Tasks keep
the best `k` of each query before the shuffle that merges them. Queries that found fewer than
there are to find are scored against all rows in the same chunks.

Null, zero and non-finite vectors, null ids, and vectors of another length than most take no part.
Rows with one id count as one, with its best score, and a query never finds its own id; of equal
scores the smaller id is nearer. Norms are computed without overflow; an inner product beyond the
doubles is infinite. Other columns are ignored; an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.llm.common import cut, read, small_batches, together

K = 20
#: Tables for so many axes a bucket.
TABLES = {1: 8, 2: 16, 3: 32}
#: Queries whose true neighbours are found, and the share of those that the probes must hold.
SAMPLE, TARGET = 100, 0.985
#: What sending a vector to a bucket costs, in rows scored.
SENDING = 300
ROW_CHUNK, QUERY_CHUNK = 4096, 1024
#: Buckets up to which their sizes are broadcast.
BROADCAST_BUCKETS = 50_000
KEEP_ROWS = 200_000
SLACK = 1e-9  # between the fast product that preselects and the exact one that ranks


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, place: int) -> np.ndarray:
    signs = np.random.default_rng([97, table, place]).integers(0, 2, (3, x.shape[1])) * 2.0 - 1.0
    for row in signs:
        x = hadamard(x * row)
    return x


def buckets(x: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """The bucket of each row."""
    code = np.full(len(x), table, dtype=np.int64)
    for place in range(hashes):
        y = rotated(x, table, place)
        axis = np.abs(y).argmax(axis=1)
        code = code * (2 * x.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
    return code


def probed(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """The `probes` buckets nearest to each row, by the sum of its coordinates on their axes."""
    if len(x) > 1 and len(x) * min(probes, 2 * x.shape[1]) ** min(hashes, 2) > 1 << 22:  # sums are as many
        return np.concatenate([probed(part, table, hashes, probes) for part in np.array_split(x, 2)])
    codes, sums = np.full((len(x), 1), table, dtype=np.int64), np.zeros((len(x), 1))
    for place in range(hashes):
        y = rotated(x, table, place)
        signed = np.stack([y, -y], axis=2).reshape(len(y), -1)  # axis 2a is +a, 2a+1 is -a
        most = min(probes, signed.shape[1])
        axes = np.argpartition(-signed, most - 1, axis=1)[:, :most]
        sums = (sums[:, :, None] + np.take_along_axis(signed, axes, 1)[:, None, :]).reshape(len(y), -1)
        codes = (codes[:, :, None] * signed.shape[1] + axes[:, None, :]).reshape(len(y), -1)
        if codes.shape[1] > probes:
            best = np.argpartition(-sums, probes - 1, axis=1)[:, :probes]
            sums, codes = np.take_along_axis(sums, best, 1), np.take_along_axis(codes, best, 1)
    return codes


def ranks(x: np.ndarray, y: np.ndarray, hashes: int, tables: int, query: np.ndarray | None = None) -> np.ndarray:
    """How many buckets lie nearer to x than the bucket of y, row by row, in the table where they are fewest; rows of one `query` have one x."""
    query = np.arange(len(x)) if query is None else query
    order = np.argsort(query, kind="stable")
    least = np.full(len(x), np.iinfo(np.int64).max)
    for table in range(tables):
        sums, own = [], np.zeros(len(x))
        for place in range(hashes):
            turned, other = rotated(x, table, place), rotated(y, table, place)
            signed = np.stack([turned, -turned], axis=2).reshape(len(x), -1)
            axis = np.abs(other).argmax(axis=1)
            own += signed[np.arange(len(x)), 2 * axis + (other[np.arange(len(x)), axis] < 0)]
            sums.append(signed)
        before = None
        for i in order.tolist():
            if query[i] != before:
                before = query[i]
                two = np.sort((sums[0][i][:, None] + (sums[1][i] if hashes > 1 else np.zeros(1))[None, :]).ravel())
                last = sums[2][i] if hashes > 2 else np.zeros(1)
            least[i] = min(least[i], (len(two) - np.searchsorted(two, own[i] - last + SLACK)).sum())
    return least


def cheapest(x: np.ndarray, y: np.ndarray, query: np.ndarray, n: int) -> tuple[int, int, int]:
    """(hashes, tables, probes) that find TARGET of the neighbours y of x, of one x a query, for n rows, at least cost."""
    best = None
    for hashes, tables in TABLES.items():
        buckets_all = (2 * x.shape[1]) ** hashes
        if best is not None and tables * (n / buckets_all + SENDING) >= best[0]:
            continue  # dearer with a single probe
        probes = int(np.quantile(ranks(x, y, hashes, tables, query), TARGET, method="higher")) + 1
        share = probes / buckets_all
        cost = tables * (share * n + probes * SENDING)
        if best is None or cost < best[0]:
            best = cost, hashes, tables, probes
    return best[1:]


def unit_vectors(x: np.ndarray, width: int, largest: float | None) -> np.ndarray:
    """Rows on the unit sphere: queries by their own norms; data, where `largest` is given, by that norm, with one more coordinate if there is room."""
    big = np.abs(x).max(axis=1, keepdims=True)
    norm = big * np.sqrt(((x / big) ** 2).sum(axis=1, keepdims=True))
    unit = np.zeros((len(x), width))
    unit[:, : x.shape[1]] = x / (norm if largest is None else largest)
    if largest is not None and width > x.shape[1]:
        unit[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / largest) ** 2))
    return unit


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1).astype(np.float64)


def _packed(x: np.ndarray, kind: str) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(x, dtype=kind)]


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, nearest first, ties to the smaller id, each row once."""
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    pair = np.lexsort((-score, row, query))
    again = np.zeros(len(query), dtype=bool)
    again[pair[1:]] = (query[pair][1:] == query[pair][:-1]) & (row[pair][1:] == row[pair][:-1])
    query, row, score = query[~again], row[~again], score[~again]
    if not len(query):
        return query, row, score
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], row[rank < k], score[rank < k]


def kth_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row of `scores` over distinct ids, so that one id's repeats take one place."""
    if len(np.unique(ids)) < len(ids):
        order = np.argsort(ids, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
        scores = np.maximum.reduceat(scores[:, order], edges, axis=1)
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -1e308)


def score_blocks(data: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): of each bucket's rows (bucket, id, vec) the k best for its queries, chunk by chunk."""
    n_rows = data.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    n_queries = queries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_queries"))
    sizes = cut(n_rows.join(n_queries, "bucket").select("bucket", F.ceil(F.col("n_rows") / ROW_CHUNK).alias("row_chunks"), F.ceil(F.col("n_queries") / QUERY_CHUNK).alias("query_chunks")))
    if sizes.count() <= BROADCAST_BUCKETS:
        sizes = F.broadcast(sizes)
    one = F.lit(1).cast("long")
    rows = data.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("id"), "row_chunks").alias("rc"), F.explode(F.sequence(one * 0, F.col("query_chunks") - one)).alias("qc"), F.lit(1).alias("is_row"), "id", "vec")
    asked = queries.join(sizes, "bucket").select("bucket", F.explode(F.sequence(one * 0, F.col("row_chunks") - one)).alias("rc"), F.pmod(F.xxhash64("id"), "query_chunks").alias("qc"), F.lit(0).alias("is_row"), "id", "vec")
    units = rows.union(asked).repartition("bucket", "rc", "qc").sortWithinPartitions("bucket", "rc", "qc", "is_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, held, n = None, [], [], 0

        def best() -> pa.RecordBatch:
            out = best_of(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["query_id", "vec_id", "score"])

        for batch in together(batches):
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            ids, is_row = batch.column(4).to_numpy(), batch.column(3).to_numpy() == 1
            vectors = _matrix(batch.column(5), kind)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if now != tuple(key[a]):
                    now, asking = tuple(key[a]), []
                middle = a + int((~is_row[a:b]).sum())  # queries stand before rows
                if middle > a:
                    asking.append((ids[a:middle], vectors[a:middle]))
                if middle == b or not asking:
                    continue
                qi, qv = (np.concatenate(c) for c in zip(*asking, strict=True))
                asking = [(qi, qv)]
                ri, rv = ids[middle:b], vectors[middle:b]
                with np.errstate(over="ignore", invalid="ignore"):  # products beyond the doubles are infinite
                    fast = qv @ rv.T
                    fast[qi[:, None] == ri[None, :]] = -np.inf
                    least = kth_best(fast, ri, k)
                    least = np.where(np.isfinite(least), least - SLACK * (1 + np.abs(least)), least)
                    at_q, at_r = np.nonzero((fast >= least[:, None]) & (fast > -np.inf))
                    held.append((qi[at_q], ri[at_r], (qv[at_q] * rv[at_r]).sum(axis=1)))
                n += len(at_q)
                if n > KEEP_ROWS:
                    out = best()
                    held, n = [tuple(c.to_numpy() for c in out.columns)], out.num_rows
                    if n > KEEP_ROWS // 2:
                        yield out
                        held, n = [], 0
        if held:
            yield best()

    return units.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def true_neighbours(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the queries x, at most SAMPLE: each one's row number and one of its k best rows' vectors, for all of these, from one scan."""
    shipped = rows.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shipped.value
        best = np.zeros((0, 3))
        vectors = np.zeros((0, d))
        for batch in together(batches):
            own, y = batch.column(0).to_numpy(), _flat(batch.column(1), d)
            with np.errstate(over="ignore", invalid="ignore"):
                score = x @ y.T
            score[ids[:, None] == own[None, :]] = -np.inf
            at_q, at_r = np.nonzero((score >= kth_best(score, own, k)[:, None]) & (score > -np.inf))
            best = np.concatenate([best, np.stack([at_q, own[at_r].astype(float), score[at_q, at_r]], axis=1)])
            vectors = np.concatenate([vectors, y[at_r]])
            order = np.lexsort((-best[:, 2], best[:, 0]))
            first = np.searchsorted(best[order, 0], best[order, 0])
            keep = order[np.arange(len(order)) - first < k]
            best, vectors = best[keep], vectors[keep]
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best[:, 0].astype(np.int64)), pa.array(best[:, 2]), pa.array(_packed(vectors, "<f8"), pa.binary())], ["q", "score", "vec"])

    found = rows.select("vec_id", "vec").mapInArrow(run, "q long, score double, vec binary")
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "vec").toArrow()  # SAMPLE * k rows at most
    return best.column(0).to_numpy(), _matrix(best.column(1), "<f8") if best.num_rows else np.zeros((0, d))


def _flat(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), d)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, tables: int | None = None, probes: int | None = None, hashes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows (vec_id, embedding) of each row where is_query holds; tables, probes and hashes where they aren't given are measured."""
    spark = small_batches(vectors).sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    sound = F.col("vec_id").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), is_query.alias("is_query")).where(sound)
    big = F.array_max(F.transform("vec", F.abs))
    norm = big * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.pow(v / big, 2)))
    about = clean.withColumn("norm", norm).groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.max("norm").alias("most"), F.min("norm").alias("least"))
    facts = about.orderBy(F.desc("n"), F.desc("d")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if facts is None:
        return none
    d, largest = facts.d, facts.most
    uneven = facts.most - facts.least > 5e-5 * facts.most
    width = 1 << max(1, int(np.ceil(np.log2(d + uneven))))
    clean = clean.where(F.size("vec") == d)
    asked = clean.where("is_query").select("vec_id", "vec")
    if hashes is None or tables is None or probes is None:
        sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        if not sample.num_rows:
            return none
        x = _flat(sample.column("vec"), d)
        at, y = true_neighbours(clean, sample.column("vec_id").to_numpy(), x, k, d)
        if not len(at):
            return none
        hashes, tables, probes = cheapest(unit_vectors(x[at], width, None), unit_vectors(y, width, largest if uneven else None), at, facts.n)

    def place(of_queries: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in together(batches):
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), _flat(batch.column(1), d)
                unit = unit_vectors(x, width, largest if uneven and not of_queries else None)
                packed = _packed(x, kind)
                for table in range(tables):
                    codes = probed(unit, table, hashes, probes) if of_queries else buckets(unit, table, hashes)[:, None]
                    at = np.repeat(np.arange(len(ids)), codes.shape[1])
                    for some in np.array_split(np.arange(len(at)), max(1, len(at) // 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()[some]), pa.array(ids[at[some]]), pa.array([packed[i] for i in at[some]], pa.binary())], ["bucket", "id", "vec"])

        return run

    kinds = "bucket long, id long, vec binary"
    data = clean.select("vec_id", "vec").mapInArrow(place(False), kinds)
    found = cut(score_blocks(data, asked.mapInArrow(place(True), kinds), k, kind))
    # the rest: whoever found fewer than there are to find looks at all rows
    full = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, facts.ids - 1))
    short = cut(asked.join(full, "vec_id", "left_anti"))
    if not short.isEmpty():

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in together(batches):
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, dtype=np.int64)), batch.column(0).combine_chunks(), pa.array(_packed(_flat(batch.column(1), d), kind), pa.binary())], ["bucket", "id", "vec"])

        rest = score_blocks(clean.select("vec_id", "vec").mapInArrow(pack, kinds), short.mapInArrow(pack, kinds), k, kind)
        found = found.union(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
