"""URL filters by a sort-merge range join.

A host's labels are reversed into a key, `www.example.net` to `net.example.www.`, so a rule's host
and all its subdomains are the interval of keys that begin with the rule's key. Keys are cut into
slices at sampled boundaries over (key, path, page_id), so that a hot host, or even one hot URL,
spreads over slices; a rule goes to each slice that its interval meets. Each slice is sorted, rules
before pages, and swept once: a stack holds the rules whose intervals are open, nested ones above.

A rule fits where the page's path begins with the rule's path. Of the open rules that fit, the
longest text (host and path) wins, then the longer host, then block. A page that no rule fits is
allowed. The sample places boundaries only; no verdict depends on it.

A null URL or one without `://` has empty host and path and no rule; very long ones stay whole. Other columns are ignored. Rules with a null or empty host
or an unknown verdict are refused. Rows are kept one for one. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.common import lower_ascii, read, small_batches

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Sampled keys for each slice, and of all slices at most; they go to the driver, which keeps the boundaries between slices.
SAMPLED, MOST_SAMPLED = 100, 100_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LAST = chr(0x10FFFF)


def reversed_host(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def parse_rules(rules: DataFrame) -> DataFrame:
    """(verdict, host, path) to the rules' keys; host and path as they stand, A-Z of the host lower-cased."""
    host = lower_ascii(F.col("host"))
    sound = F.coalesce((F.length("host") > 0) & F.col("verdict").isin("block", "allow") & F.col("path").isNotNull(), F.lit(False))
    checked = F.when(sound, reversed_host(host)).otherwise(F.raise_error(F.lit("a rule needs a host, a path and block or allow")))
    return rules.select(checked.alias("key"), F.col("path").alias("path"), F.concat(host, F.col("path")).alias("rule"), "verdict")


class _Open:
    """The rules of one key: by path, with the path lengths that occur, longest first."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.rules.get(path, ("", ""))[1] != "block":
            self.rules[path] = rule, verdict
        self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def fitting(self, path: str) -> tuple[str, str] | None:
        return next((self.rules[path[:n]] for n in self.lengths if n <= len(path) and path[:n] in self.rules), None)


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each page, for rules (verdict, host, path)."""
    spark = small_batches(pages).sparkSession
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), lower_ascii(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    keyed = parsed.withColumn("key", reversed_host(F.col("host")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.count()
    sample = keyed.select("key", "path", F.coalesce("page_id", F.lit(-1)).alias("id")).sample(min(1.0, min(SAMPLED * n, MOST_SAMPLED) / max(rows, 1)), 11).collect()
    sample = sorted(map(tuple, sample))
    bounds = [sample[len(sample) * i // n] for i in range(1, n)] if len(sample) >= n else sample
    columns = "slice int, key string, is_page int, path string, page_id long, host string, rule string, verdict string"
    names = [c.split()[0] for c in columns.split(", ")]

    def place_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, paths, keys = (c.to_pylist() for c in batch.columns)
            at = [bisect_right(bounds, (k, p, -1 if i is None else i)) for k, p, i in zip(keys, paths, ids, strict=True)]
            none = pa.nulls(len(ids), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(3), pa.array([1] * len(ids), pa.int32()), batch.column(2), batch.column(0), batch.column(1), none, none], names)

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(s, key, 0, path, None, None, rule, verdict) for key, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in range(bisect_right(bounds, (key,)), bisect_right(bounds, (key + LAST,)) + 1)]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        now = None
        for batch in batches:
            out = []
            for at, key, is_page, path, page, host, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    now, stack = at, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_page:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(key))
                    stack[-1].add(path, rule, verdict)
                    continue
                fits = [f for level in reversed(stack) if (f := level.fitting(path))]
                best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))  # the first of equals has the longer host
                out.append((page, host, path, *best))
            if out:
                kinds = [pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict"])

    events = keyed.select("page_id", "host", "path", "key").mapInArrow(place_pages, columns).union(parse_rules(rules).mapInArrow(place_rules, columns))
    swept = events.repartitionById(n, "slice").sortWithinPartitions("slice", "key", "is_page", "path", "page_id")
    return swept.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict FROM parts p LEFT JOIN rules r
  ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict FROM fits GROUP BY page_id, host, path
"""
