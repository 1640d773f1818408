"""Transcript queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.functions import text as T
from lyrebird.operators import ranks
from lyrebird.plans.catalog import query
from lyrebird.session import table

W = r"\s\p{Z}\x{85}\x{1C}-\x{1F}"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}"
K = r"\p{L}\p{N}"  # and the apostrophe


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("lang_normalize", "SELECT doc_id, upper(lang[1]) || lower(lang[2:]) AS lang FROM documents WHERE lang <> ''")
def lang_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where("lang <> ''").select("doc_id", T.language_name(F.col("lang")).alias("lang"))


NAMES = {"en": "English", "de": "German", "fr": "French"}


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return docs(spark, sf_dir).select("doc_id", F.coalesce(names[F.col("lang")], F.col("lang")).alias("language"))


NAMED = "n AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE lang END AS language FROM documents)"


@query("lang_validate_semi", f"WITH {NAMED} SELECT doc_id, language FROM n WHERE language IN ('English', 'German', 'French')")
def lang_validate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(x,) for x in T.LANGUAGES], "language string")  # thirty rows
    return named(spark, sf_dir).join(F.broadcast(known), "language", "left_semi").select("doc_id", "language")


@query("lang_validate_anti", f"WITH {NAMED} SELECT language, count(*) AS n FROM n WHERE language NOT IN ('English', 'German', 'French') OR language IS NULL GROUP BY language")
def lang_validate_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).where(~T.is_known_language(F.col("language"))).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("clean_tokens", f"SELECT doc_id, regexp_replace(text, '[^{K}'']', '', 'g') AS cleaned FROM documents")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.clean_token(F.col("text")).alias("cleaned"))


GENERAL = f"regexp_extract_all(regexp_replace(text, '[^{K}''{W}]', '', 'g'), '[{CJK}]|[^{W}{CJK}]+')"


@query("tokenize_general", f"SELECT doc_id, len({GENERAL}) AS n, array_to_string({GENERAL}, ' ') AS tokens FROM documents")
def tokenize_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("doc_id", T.general_tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("tokenize_cjk_mixed", f"SELECT conv_id, turn, array_to_string(regexp_extract_all(regexp_replace(text || '中文 mixed字', '([{CJK}])', ' \\1 ', 'g'), '[{CJK}]|[{K}'']+'), '|') AS tokens FROM conversations")
def tokenize_cjk_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = T.mixed_tokens(F.concat("text", F.lit("中文 mixed字")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(mixed, "|").alias("tokens"))


@query("align_prompt", f"SELECT doc_id, array_to_string({GENERAL}, '<timestamp><timestamp>') || '<timestamp><timestamp>' AS prompt FROM documents")
def align_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.alignment_prompt(T.tokens(F.col("text"), F.col("lang"))).alias("prompt"))


RUNS = """s AS (SELECT doc_id, string_split(text || repeat(text[1], 30) || 'end', '') AS t FROM documents), d AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS ch FROM s),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS island FROM d), r AS (SELECT doc_id, ch, min(i) AS i, count(*) AS n FROM g GROUP BY doc_id, ch, island)"""


@query("char_run_collapse", f"WITH {RUNS} SELECT doc_id, string_agg(CASE WHEN n > 20 THEN ch ELSE repeat(ch, n::INT) END, '' ORDER BY i) AS text FROM r GROUP BY doc_id")
def char_run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.collapse_characters(F.concat("text", F.repeat(F.substring("text", 1, 1), 30), F.lit("end"))).alias("text"))


@query("pattern_run_collapse")
def pattern_run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-references have no SQL here; the tests compare with a plain loop."""
    return docs(spark, sf_dir).select("doc_id", T.collapse_patterns(F.concat("text", F.repeat(F.lit("ab cd"), 25))).alias("text"))


@query(
    "parse_tagged_output",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'English' WHEN 'assistant' THEN '' ELSE 'French' END AS language, CASE role WHEN 'system' THEN 'language None<asr_text>' ELSE '' END || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations""",
)
def parse_tagged_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns carry a language and a tag, assistants' say none, and the others' language is forced."""
    head = F.when(F.col("role") == "user", "language eNGLISH\nnote\n<asr_text>").otherwise("language None<asr_text>")
    forced = F.when(F.col("role") == "system", "French")
    parsed = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_output(F.concat(head, F.col("text")), forced).alias("p"))
    return parsed.select("conv_id", "turn", "p.language", "p.text")


@query(
    "merge_languages",
    "WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations) SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS merged FROM l WHERE before IS NULL OR before <> role GROUP BY conv_id",
)
def merge_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's roles in order, without consecutive repeats; a conversation is short."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))
    return turns.select("conv_id", T.merge_languages(F.col("t.role")).alias("merged"))


@query("chat_prompt", "SELECT conv_id, turn, '<|im_start|>system\n' || text || '<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n' || CASE WHEN role = 'user' THEN 'language English<asr_text>' ELSE '' END AS prompt FROM conversations")
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = F.when(F.col("role") == "user", "English")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.text_prompt(F.col("text"), forced).alias("prompt"))


@query("chat_template", "SELECT conv_id, string_agg('<|im_start|>' || role || '\n' || text || '<|im_end|>\n', '' ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY conv_id")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("t"))
    return turns.select("conv_id", F.array_join("t.line", "").alias("prompt"))


@query("punct_newlines", "SELECT doc_id, regexp_replace(text, '([，。？！：,.])', '\\1\n', 'g') AS text FROM documents")
def punct_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.break_at_punctuation(F.col("text")).alias("text"))


@query("text_file_lines", "SELECT doc_id, regexp_replace(regexp_replace(text, '([，。？！])', '\\1\n', 'g'), '([a-zA-Z])([,.] )', '\\1\\2\n', 'g') AS text FROM documents")
def text_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.break_lines(F.col("text")).alias("text"))


@query("url_predicates", "SELECT page_id, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS is_url, (starts_with(url, 'data:audio') OR (NOT contains(url, '/') AND NOT contains(url, chr(92)) AND length(url) > 256)) AS is_base64 FROM pages")
def url_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.is_url(F.col("url")).alias("is_url"), T.is_probably_base64(F.col("url")).alias("is_base64"))


@query("base64_predicates", "SELECT page_id, (NOT contains(html, '/') AND NOT contains(html, chr(92)) AND length(html) > 256) OR starts_with(html, 'data:audio') AS is_base64, html AS payload FROM pages")
def base64_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as a data URL comes back whole."""
    html = F.col("html")
    data = F.concat(F.lit("data:text/html;base64,"), F.base64(F.encode(html, "UTF-8")))
    return table(spark, sf_dir, "pages").select("page_id", T.is_probably_base64(html).alias("is_base64"), F.decode(F.unbase64(T.base64_payload(data)), "UTF-8").alias("payload"))


@query("code_points", "SELECT doc_id, length(text) AS n, list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)))::BIGINT AS total FROM documents")
def code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.code_points(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n"), F.aggregate(points, F.lit(0).cast("long"), lambda s, c: s + c).alias("total"))


@query("size_labels", "SELECT p_partkey, CASE WHEN n > 1e9 THEN printf('%.1f', n / 1e9) || 'B' WHEN n > 1e6 THEN printf('%.0f', n / 1e6) || 'M' ELSE printf('%.0f', n / 1e3) || 'K' END AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 25000 WHEN p_partkey % 3 = 1 THEN 75000000 ELSE 7600000000 END::DOUBLE AS n FROM part)")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("p_partkey") % 3 == 0, 25000).when(F.col("p_partkey") % 3 == 1, 75000000).otherwise(7600000000).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", T.rounded_count(n, F.lit(2)).alias("label"))


@query("file_names", "SELECT p_partkey, replace(replace(p_name, ' ', '-'), '/', '-') || '-' || p_brand || '-' || upper(p_type) AS name, printf('part-%05d-of-%05d', p_size::INT, 50) AS shard FROM part")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    name = T.naming(F.col("p_name"), F.col("p_brand"), none, none, F.col("p_type"), none)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), T.shard_name(F.lit("part"), F.col("p_size"), F.lit(50)).alias("shard"))


@query("table_cells", "SELECT doc_id, replace(replace(text, chr(10), chr(92) || 'n'), '|', chr(92) || '|') AS cell FROM documents")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.table_cell(F.col("text")).alias("cell"))


@query("feat_lengths", "SELECT doc_id, (floor((floor((floor((n % 100 - 1) / 2.0) + 1 - 1) / 2.0) + 1 - 1) / 2.0) + 1 + floor(n / 100.0) * 13)::BIGINT AS frames FROM (SELECT doc_id, length(text) AS n FROM documents)")
def feat_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a clip as long as each text."""
    return docs(spark, sf_dir).select("doc_id", T.feature_length(F.char_length("text").cast("long")).cast("long").alias("frames"))


MEL_SQL = """WITH p AS (SELECT range AS j, (range * (15 + ln(8.0) / (ln(6.4) / 27))) / 129 AS m FROM range(130)), f AS (SELECT j, CASE WHEN m >= 15 THEN 1000 * exp(ln(6.4) / 27 * (m - 15)) ELSE m * 200 / 3 END AS hz FROM p),
t AS (SELECT j, hz AS low, lead(hz) OVER (ORDER BY j) AS mid, lead(hz, 2) OVER (ORDER BY j) AS high FROM f), b AS (SELECT range AS bin, range * 40.0 AS hz FROM range(201))
SELECT bin, j AS mel, round(greatest(0, least((hz - low) / (mid - low), (high - hz) / (high - mid))) * 2 / (high - low), 9) AS w FROM b JOIN t ON hz > low AND hz < high"""


@query("mel_filterbank", MEL_SQL)
def mel_filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 128 triangular filters over 201 bins of 40 Hz; bins outside a filter have no row."""
    top = T.hz_to_mel(F.lit(8000.0))
    points = spark.range(130).select(F.col("id").alias("mel"), T.mel_to_hz(F.col("id") * top / 129).alias("low"))
    order = Window.orderBy("mel")  # 130 rows
    filters = points.select("mel", "low", F.lead("low").over(order).alias("mid"), F.lead("low", 2).over(order).alias("high"))
    bins = spark.range(201).select(F.col("id").alias("bin"), (F.col("id") * 40.0).alias("hz"))
    joined = bins.join(F.broadcast(filters), (F.col("hz") > F.col("low")) & (F.col("hz") < F.col("high")))
    slope = F.greatest(F.lit(0.0), F.least((F.col("hz") - F.col("low")) / (F.col("mid") - F.col("low")), (F.col("high") - F.col("hz")) / (F.col("high") - F.col("mid"))))
    return joined.select("bin", "mel", F.round(slope * 2 / (F.col("high") - F.col("low")), 9).alias("w"))


@query("fixed_chunks", "SELECT doc_id, i::INT AS chunk, substring(text, (i * 500 + 1)::INT, 500) AS part FROM (SELECT doc_id, text, unnest(range(0, ((length(text) + 499) // 500)::BIGINT)) AS i FROM documents)")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.ceil(F.length("text") / 500).cast("int")
    chunks = docs(spark, sf_dir).where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return chunks.select("doc_id", "chunk", F.substring("text", F.col("chunk") * 500 + 1, F.lit(500)).alias("part"))


@query("batch_groups", "SELECT source, (rn - 1) // 8 AS batch, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY ALL")
def batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = ranks.numbered(docs(spark, sf_dir).select("source", "doc_id"), ["source"], F.floor(F.col("doc_id") / 1000), ["doc_id"])
    numbered = rn.select("source", "doc_id", F.floor((F.col("rn") - 1) / 8).alias("batch"))
    return numbered.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("separator_chunks")
def separator_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that end in a separator, gathered until they exceed a size; what is left joins the last chunk."""
    from lyrebird.operators.segments import separator_chunks as chunked

    return docs(spark, sf_dir).select("doc_id", F.posexplode(chunked(F.col("text"), "\n", 400)).alias("chunk", "part"))


@query("vocabulary_lookup", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT word) AS words FROM w GROUP BY doc_id")
def vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("words"))


@query("ordered_concat", "SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk texts of a file in order, blank ones left out."""
    full = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    joined = full.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return joined.select("conv_id", F.array_join("t.text", "").alias("text"))


@query("digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("itn_digits", "SELECT s_suppkey, translate(translate(s_suppkey::VARCHAR || '.5', '0123456789.', '零一二三四五六七八九点'), '零一二三四五六七八九点', '0123456789.') AS text FROM supplier")
def itn_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lyrebird.functions.numbers import digits

    spoken = F.translate(F.concat(F.col("s_suppkey").cast("string"), F.lit(".5")), "0123456789.", "零一二三四五六七八九点")
    return table(spark, sf_dir, "supplier").select("s_suppkey", digits(spoken).alias("text"))


@query("itn_value_fold", "SELECT o_orderkey, o_orderkey % 9999 + 1 AS v FROM orders")
def itn_value_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers made from every order's key, spelt in Chinese, come back as values."""
    from lyrebird.functions.numbers import spelt, value

    return table(spark, sf_dir, "orders").select("o_orderkey", value(spelt(F.col("o_orderkey") % 9999 + 1)).alias("v"))


@query(
    "itn_full",
    "WITH p AS (SELECT o_orderkey AS k, o_orderkey % 8999 + 2 AS n, o_orderkey // 7 % 998 + 2 AS m, o_orderkey // 9 % 23 + 1 AS h, o_orderkey // 5 % 59 + 1 AS s, o_orderkey // 11 % 7 + 2 AS d, o_orderdate AS t FROM orders) SELECT k AS o_orderkey, '订单' || CASE k % 10 "
    "WHEN 0 THEN n || '人' WHEN 1 THEN n || '%' WHEN 2 THEN n || '/' || m WHEN 3 THEN n || ':' || m WHEN 4 THEN lpad(h::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') WHEN 5 THEN year(t) || '年' || month(t) || '月' || day(t) || '日' "
    "WHEN 6 THEN n || '.' || lpad(s::VARCHAR, 2, '0') WHEN 7 THEN CASE WHEN (10000000 + k)::VARCHAR LIKE '%7788%' THEN translate((10000000 + k)::VARCHAR, '0123456789', '零一二三四五六七八九') ELSE (10000000 + k)::VARCHAR END WHEN 8 THEN d * 100 || '~' || (d + 1) * 100 || '人' ELSE n || 'kg' END || '。' AS written FROM p",
)
def itn_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for every order with a number of one of ten kinds made from its key or date, spelt and written as digits again; 7788 in figures is an idiom and stays."""
    from lyrebird.functions.numbers import normalise, spelt

    k = F.col("o_orderkey")
    part = lambda every, count, least: F.floor(k / every) % count + least
    spoken = lambda n: F.translate(n.cast("string"), "0123456789", "零一二三四五六七八九")
    n, m, h, s, d = spelt(k % 8999 + 2), spelt(part(7, 998, 2)), spelt(part(9, 23, 1)), part(5, 59, 1), part(11, 7, 2)
    date = F.col("o_orderdate")
    forms = [
        F.concat(n, F.lit("人")),
        F.concat(F.lit("百分之"), n),
        F.concat(m, F.lit("分之"), n),
        F.concat(n, F.lit("比"), m),
        F.concat(h, F.lit("点"), spelt(s), F.lit("分")),
        F.concat(spoken(F.year(date)), F.lit("年"), spelt(F.month(date)), F.lit("月"), spelt(F.day(date)), F.lit("日")),
        F.concat(n, F.lit("点"), spoken(F.lpad(s.cast("string"), 2, "0"))),
        spoken(k + 10_000_000),
        F.concat(spoken(d), spoken(d + 1), F.lit("百人")),
        F.concat(n, F.lit("千克")),
    ]
    chosen = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        chosen = F.when(k % 10 == i, form).otherwise(chosen)
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise(F.concat(F.lit("订单"), chosen, F.lit("。"))).alias("written"))
