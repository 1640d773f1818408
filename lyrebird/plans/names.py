"""Queries over names, metadata, prompts, subtitles and sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.functions import names as N
from lyrebird.plans.catalog import query
from lyrebird.session import table


@query("file_templates", "SELECT c_custkey, 'out/' || lower(c_mktsegment) || '-' || upper(c_mktsegment) || '-' || c_mktsegment || '.bin' AS name FROM customer")
def file_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind's name in a file name: as it is, lower-case, upper-case."""
    return table(spark, sf_dir, "customer").select("c_custkey", N.filled(F.lit("out/{ftype}-{FTYPE}-{kind}.bin"), F.col("c_mktsegment")).alias("name"))


def model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model ids made from customers: organisation, name, version, size and kind in turn."""
    key = F.col("c_custkey")
    sizes, kinds = F.array(*map(F.lit, ("7B", "0.6b", "8x7B", "350M"))), F.array(*map(F.lit, ("Instruct", "chat", "LoRA", "base")))
    name = F.concat_ws("-", F.lit("Model"), F.format_string("v%d.%d", key % 4, key % 3), sizes[(key % 4).cast("int")], kinds[(F.floor(key / 4) % 4).cast("int")])
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 2 == 0, F.concat(F.lit("org/"), name)).otherwise(name).alias("id"))


IDS = "i AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'org' END AS organisation, 'v' || c_custkey % 4 || '.' || c_custkey % 3 AS version, ['7B', '0.6b', '8x7B', '350M'][c_custkey % 4 + 1] AS size, ['Instruct', 'chat', 'LoRA', 'base'][c_custkey // 4 % 4 + 1] AS kind FROM customer)"


@query("model_id_parts", f"WITH {IDS} SELECT c_custkey, organisation, 'Model' AS basename, version, upper(size) AS size_label, CASE WHEN kind = 'LoRA' THEN NULL ELSE kind END AS finetune, CASE WHEN kind = 'LoRA' THEN 'LoRA' END AS type FROM i")
def model_id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = N.id_parts(F.col("id"))
    return model_ids(spark, sf_dir).select("c_custkey", parts.alias("p")).select("c_custkey", "p.organisation", "p.basename", "p.version", "p.size_label", "p.finetune", "p.type")


@query("model_titles", f"WITH {IDS} SELECT c_custkey, 'Model ' || version || ' ' || size || ' ' || CASE kind WHEN 'chat' THEN 'Chat' WHEN 'base' THEN 'Base' ELSE kind END AS title FROM i")
def model_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lyrebird.functions.text import title_of

    bare = F.regexp_replace("id", "^.*/", "")
    return model_ids(spark, sf_dir).select("c_custkey", title_of(bare).alias("title"))


@query("tensor_names", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE 'blk.' || p_size || '.' || CASE p_size % 3 WHEN 0 THEN 'attn_q' ELSE 'ffn_up' END || CASE WHEN p_partkey % 2 = 0 THEN '.weight' ELSE '.bias' END END AS name FROM part")
def tensor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up in a small table with the layer's number left out; a name that isn't there is tried without its suffix, which the result gets back."""
    layer = F.col("p_size").cast("string")
    kind = F.array(F.lit("self_attn.q_proj"), F.lit("mlp.up_proj"), F.lit("unknown"))[(F.col("p_size") % 3).cast("int")]
    asked = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("model.layers."), layer, F.lit("."), kind, F.when(F.col("p_partkey") % 2 == 0, ".weight").otherwise(".bias")).alias("asked"))
    known = spark.createDataFrame([("model.layers.{n}.self_attn.q_proj", "blk.{n}.attn_q"), ("model.layers.{n}.mlp.up_proj", "blk.{n}.ffn_up")], "pattern string, known string")
    return N.looked_up(asked, known, "asked").select("p_partkey", "name")


@query("metadata_rewrite", "SELECT c_custkey, k, v FROM (SELECT c_custkey, 'name' AS k, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END FROM customer) WHERE NOT (k = 'name' AND c_custkey % 5 = 0)")
def metadata_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with some removed and some set anew."""
    customers = table(spark, sf_dir, "customer")
    fields = customers.select("c_custkey", F.explode(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")).alias("k", "v"))
    removed = customers.where("c_custkey % 5 = 0").select("c_custkey", F.lit("name").alias("k"))
    new = customers.where("c_custkey % 3 = 0").select("c_custkey", F.lit("segment").alias("k"), F.lit("new").alias("v"))
    return N.rewritten(fields, removed, new, ["c_custkey", "k"])


@query("field_contents", "SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def field_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array field by index from either end."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    return turns.select("conv_id", F.size("t").cast("long").alias("n"), F.element_at("t", 1).alias("first_turn"), F.element_at("t", -1).alias("last_turn"))


@query("supported_languages", "SELECT array_to_string(list_sort(list(DISTINCT lower(lang))), ',') AS languages FROM documents")
def supported_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = table(spark, sf_dir, "documents").select(F.lower("lang").alias("lang")).distinct()
    return distinct.agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))


@query("typed_items", "SELECT event_id, coalesce((props->>'$.k')::BIGINT, 0) AS k, coalesce(props->>'$.text', '') AS text, coalesce((props->>'$.start_time')::DOUBLE, 0) AS start_time FROM events")
def typed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of an object with their types, absent ones by default."""
    p = F.from_json("props", "k long, text string, start_time double")
    return table(spark, sf_dir, "events").select("event_id", *[F.coalesce(p[k], F.lit(d)).cast(t).alias(k) for k, d, t in (("k", 0, "long"), ("text", "", "string"), ("start_time", 0.0, "double"))])


@query("broadcast_arguments", "SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE used = 'en') AS same FROM (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'l' || turn END AS used FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id")
def broadcast_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One argument goes to every item, as many go one to one, any other number is refused; even conversations give one."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("items"))
    given = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("en"))).otherwise(F.transform("items", lambda t: F.concat(F.lit("l"), t.cast("string"))))
    used = turns.select("conv_id", F.explode(N.aligned(F.col("items"), given)).alias("u"))
    return used.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("u.argument") == "en").alias("same"))


@query("task_prompts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'transcribe ' || lang ELSE 'translate ' || lang || ' to English' END AS prompt FROM documents")
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.when(F.col("doc_id") % 2 == 0, "transcribe").otherwise("translate")
    return table(spark, sf_dir, "documents").select("doc_id", N.task_prompt(task, F.col("lang"), "English").alias("prompt"))


@query("merged_results", "SELECT conv_id, CASE WHEN count(text) FILTER (WHERE role = 'assistant') > 0 THEN string_agg(text, '|' ORDER BY turn, text) FILTER (WHERE role = 'assistant') END AS texts FROM conversations GROUP BY conv_id")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a file's chunks in one list, null where no chunk has any."""
    own = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    merged = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("t"))
    return merged.select("conv_id", F.when(F.size("t") > 0, F.array_join("t.text", "|")).alias("texts"))


@query("items_by_time", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 0), ts, event_id) AS place FROM events")
def items_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a file by start time; items that start together keep their order."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.round("value", 0), "ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", place.cast("long").alias("place"))


@query("lower_points", "SELECT doc_id, lower(text) AS text FROM documents")
def lower_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))


@query("han_share", r"SELECT doc_id, len(regexp_extract_all(text || '漢字 kana かな', '\p{Han}'))::INT AS han FROM documents")
def han_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.concat("text", F.lit("漢字 kana かな")), F.lit(r"\p{IsHan}")).alias("han"))


@query("pre_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\s\p{L}\p{N}]+'))::INT AS n FROM documents WHERE regexp_matches(text, '^[\x00-\x7F]*$')")
def pre_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters together, digits one by one, other signs together; of ASCII texts, where the engines' white space agrees."""
    plain = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?s)\A[\x00-\x7F]*\z"))
    return plain.select("doc_id", F.size(N.pre_tokens(F.col("text"))).alias("n"))


@query("insert_statements", "SELECT 'INSERT INTO region (r_regionkey, r_name) VALUES (' || r_regionkey || ', ''' || r_name || ''');' AS line FROM region")
def insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(N.insert_statement("region", [("r_regionkey", False), ("r_name", True)]).alias("line"))


@query("quoted_rows", "SELECT n_nationkey, n_name || ', \"' || n_nationkey || '\"' AS sentence, 1 + n_nationkey % 2 AS answer FROM nation")
def quoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file with quoted fields that hold commas and doubled quotes, read back."""
    key = F.col("n_nationkey").cast("string")
    line = F.concat(key, F.lit(',"'), F.col("n_name"), F.lit(', ""'), key, F.lit('""",'), (F.col("n_nationkey") % 2 + 1).cast("string"))
    row = N.quoted_fields(line, "n_nationkey bigint, sentence string, answer bigint")
    return table(spark, sf_dir, "nation").select(row.alias("r")).select("r.n_nationkey", "r.sentence", "r.answer")


@query("sliding_windows", "SELECT w AS began, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows that begin each hour."""
    return N.sliding(table(spark, sf_dir, "events"), "ts", "2 hours", "1 hour")


@query("correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.2 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated subqueries over common table expressions, which the optimiser turns into joins."""
    return spark.sql(
        "WITH o AS (SELECT * FROM {orders}), large AS (SELECT l_orderkey FROM {lines} WHERE l_quantity > 45) SELECT o_orderkey FROM o WHERE o_totalprice > (SELECT 1.2 * avg(i.o_totalprice) FROM o AS i WHERE i.o_custkey = o.o_custkey) AND EXISTS (SELECT 1 FROM large WHERE l_orderkey = o_orderkey)",
        orders=table(spark, sf_dir, "orders"),
        lines=table(spark, sf_dir, "lineitem"),
    )


def decoded_pieces(text: Column) -> Column:
    """Pieces of three bytes of a text, as a token stream would bring them."""
    n = F.ceil(F.octet_length(text) / 3).cast("int")
    # bound to a variable: within the inner function the bytes would be made anew for each piece
    cut = F.transform(F.array(F.encode(text, "UTF-8")), lambda raw: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * 3 + 1, F.lit(3))))
    return F.when(n > 0, cut[0])


@query("incremental_text", "SELECT doc_id, text AS shown, 0 AS held FROM documents WHERE length(text) > 0")
def incremental_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts shown piece by piece: bytes of an unfinished character wait for the next piece, and the end flushes them."""
    pieces = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", decoded_pieces(F.col("text")).alias("pieces"))
    return N.shown_pieces(pieces, "doc_id", "pieces").select("doc_id", F.array_join("pieces", "").alias("shown"), F.lit(0).alias("held"))


NAMED = "lower(p_type) AS t, replace(p_name, ' ', '_') AS m, lower(p_brand) AS b"


@query(
    "wildcard_names",
    f"WITH p AS (SELECT p_partkey AS id, p_size::VARCHAR AS s, {NAMED}, ['.weight', '.bias', ''][(p_partkey % 3 + 1)::INT] AS x FROM part), e AS (SELECT DISTINCT t, m, b FROM p WHERE id % 11 = 0), a AS (SELECT DISTINCT t, m, b FROM p WHERE id % 4 = 0), w AS (SELECT DISTINCT t, b FROM p WHERE id % 9 = 0), c AS (SELECT DISTINCT t, m FROM p WHERE id % 7 = 0), d AS (SELECT DISTINCT m, b FROM p WHERE id % 2 = 0) "
    "SELECT id AS p_partkey, CASE WHEN e.t IS NOT NULL AND x = '.weight' THEN 'whole.' || s WHEN a.t IS NOT NULL THEN 'blk.' || s || '.' || p.t || '_' || p.m || '_' || p.b || x WHEN w.t IS NOT NULL THEN 'kind.' || p.m || '.' || s || x WHEN c.t IS NOT NULL THEN 'end.' || p.b || '.' || p.t || x WHEN d.m IS NOT NULL THEN 'tail.' || p.m || '.' || p.b || x END AS name FROM p "
    "LEFT JOIN e USING (t, m, b) LEFT JOIN a USING (t, m, b) LEFT JOIN w USING (t, b) LEFT JOIN c USING (t, m) LEFT JOIN d USING (m, b)",
)
def wildcard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensor names of every part looked up in the patterns that five rules make of the parts."""
    from lyrebird.operators.patterns import wildcard_lookup

    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), F.lower("p_type").alias("t"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("m"), F.lower("p_brand").alias("b"))
    suffix = F.array(F.lit(".weight"), F.lit(".bias"), F.lit(""))[(F.col("p_partkey") % 3).cast("int")]
    asked = parts.select("p_partkey", F.concat(F.concat_ws(".", F.lit("model.layers"), "s", "t", "m", "b"), suffix).alias("asked"))
    rules = [
        (11, "model.layers.*.{t}.{m}.{b}.weight", "whole.{{0}}"),
        (4, "model.layers.*.{t}.{m}.{b}", "blk.{{0}}.{t}_{m}_{b}"),
        (9, "model.layers.*.{t}.*.{b}", "kind.{{1}}.{{0}}"),
        (7, "**.{t}.{m}.*", "end.{{0}}.{t}"),
        (2, "**.{m}.{b}", "tail.{m}.{b}"),
    ]
    made = [parts.where(F.col("p_partkey") % every == 0).select(*[F.format_string(re.sub(r"\{\{(\d)\}\}", r"{\1}", re.sub(r"(?<!\{)\{[tmb]\}", "%s", form)), *re.findall(r"(?<!\{)\{([tmb])\}", form)).alias(c) for form, c in ((pattern, "pattern"), (known, "known"))]) for every, pattern, known in rules]
    return wildcard_lookup(asked, reduce(DataFrame.union, made), "asked").select("p_partkey", "name")
