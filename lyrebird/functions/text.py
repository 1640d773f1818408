"""Column functions over transcripts: cleaning, tokenizing, repetition repair, parsing, names, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages that are accepted.
LANGUAGES = [
    "Chinese", "English", "Cantonese", "Arabic", "German", "French", "Spanish", "Portuguese", "Indonesian", "Italian",
    "Korean", "Russian", "Thai", "Vietnamese", "Japanese", "Turkish", "Hindi", "Malay", "Dutch", "Swedish",
    "Danish", "Finnish", "Polish", "Czech", "Filipino", "Persian", "Greek", "Romanian", "Hungarian", "Macedonian",
]
# The code points that stand as words of their own.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}"
#: White space as Unicode has it; the engine's own \s is ASCII only.
BLANK = r"\s\p{Z}\x{85}\x{1C}-\x{1F}"
KEPT = r"\p{L}\p{N}'"
TEXT_TAG, STAMP = "<asr_text>", "<timestamp>"
#: Shortest run that counts as a repetition.
REPEATS = 20


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def language_name(name: Column) -> Column:
    """First letter upper, others lower, of the stripped name; null or empty raises."""
    clean = strip(name)
    made = F.concat(F.upper(F.substring(clean, 1, 1)), F.lower(F.substring(clean, 2, 1 << 30)))
    return F.when(F.coalesce(F.length(clean), F.lit(0)) > 0, made).otherwise(F.raise_error(F.lit("language is empty")))


def is_known_language(name: Column) -> Column:
    return F.coalesce(name.isin(LANGUAGES), F.lit(False))


def is_kept(char: Column) -> Column:
    """Letters, numbers and the apostrophe."""
    return char.rlike(f"[{KEPT}]")


def clean_token(token: Column) -> Column:
    return F.regexp_replace(token, f"[^{KEPT}]", "")


def general_tokens(text: Column) -> Column:
    """Words between white space, cleaned, each CJK character alone."""
    return F.regexp_extract_all(F.regexp_replace(text, f"[^{KEPT}{BLANK}]", ""), F.lit(f"[{CJK}]|[^{BLANK}{CJK}]+"), F.lit(0))


def mixed_tokens(text: Column) -> Column:
    """CJK characters and runs of other kept characters; any other character ends a run."""
    return F.regexp_extract_all(text, F.lit(f"[{CJK}]|(?:(?![{CJK}])[{KEPT}])+"), F.lit(0))


def tokens(text: Column, language: Column) -> Column:
    """By language: characters for Japanese and Korean, which have no word model here, else general tokens."""
    return F.when(F.lower(F.coalesce(language, F.lit(""))).isin("japanese", "korean"), F.split(text, "")).otherwise(general_tokens(text))


def dictionary_token(text: Column, words: Column) -> Column:
    """The longest of an array of words that begins the text, else its first character."""
    hits = F.filter(words, lambda w: F.startswith(text, w))
    longest = F.aggregate(hits, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return F.when(F.length(longest) > 0, longest).otherwise(F.substring(text, 1, 1))


def alignment_prompt(words: Column) -> Column:
    """Words with two time slots after each."""
    slots = STAMP * 2
    return F.concat(F.array_join(words, slots), F.lit(slots))


def collapse_characters(text: Column) -> Column:
    """Runs of more than REPEATS equal characters become one."""
    return F.regexp_replace(text, rf"(?s)(.)\1{{{REPEATS},}}", "$1")


def collapse_patterns(text: Column) -> Column:
    """A pattern of at most 20 characters that stands REPEATS times or more becomes one; the shortest pattern first, while 2 * REPEATS characters are left."""
    # two characters or more that stand REPEATS times are 2 * REPEATS long, so only a single one has to look ahead
    return F.regexp_replace(text, rf"(?s)(.)(?=\1)(?=.{{{2 * REPEATS - 1}}})\1{{{REPEATS - 1},}}|(.{{2,20}}?)\2{{{REPEATS - 1},}}", "$1$2")


def fix_repetitions(text: Column) -> Column:
    return collapse_patterns(collapse_characters(text))


def parse_output(raw: Column, forced: Column) -> Column:
    """struct(language, text) of a model's output; see the fields' rules below."""
    fixed = fix_repetitions(strip(F.coalesce(raw, F.lit(""))))
    at = F.instr(fixed, TEXT_TAG)
    meta = F.substring_index(fixed, TEXT_TAG, 1)
    rest = strip(F.regexp_replace(fixed, rf"(?s)^.*?{TEXT_TAG}", ""))
    named = strip(F.regexp_extract(meta, r"(?im)^[^\S\n]*language ([^\n]+)$", 1))
    language = F.when(F.length(named) > 0, F.concat(F.upper(F.substring(named, 1, 1)), F.lower(F.substring(named, 2, 1 << 30)))).otherwise(F.lit(""))
    is_forced = F.coalesce(F.length(forced), F.lit(0)) > 0
    nothing = F.contains(F.lower(meta), F.lit("language none"))
    return F.struct(
        # an empty output has no language; a forced one is believed; without a tag, or where none is said, it is unknown
        F.when(F.length(fixed) == 0, "").when(is_forced, forced).when((at == 0) | nothing, "").otherwise(language).alias("language"),
        F.when(is_forced | (at == 0), fixed).otherwise(rest).alias("text"),
    )


def merge_languages(names: Column) -> Column:
    """Names in order without blanks and consecutive repeats, joined by commas."""
    full = F.filter(F.transform(names, lambda n: strip(F.coalesce(n, F.lit("")))), lambda n: n != "")
    return F.array_join(F.filter(F.transform(full, lambda n, i: F.when((i == 0) | (n != F.get(full, i - 1)), n)), lambda n: n.isNotNull()), ",")


def text_prompt(context: Column, language: Column) -> Column:
    """A chat prompt with a system and a user turn, and the forced language after it."""
    base = F.concat(F.lit("<|im_start|>system\n"), F.coalesce(context, F.lit("")), F.lit("<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n"))
    forced = F.when(F.coalesce(F.length(language), F.lit(0)) > 0, F.concat(F.lit("language "), language, F.lit(TEXT_TAG))).otherwise("")
    return F.concat(base, forced)


def messages(context: Column, audio: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.coalesce(context, F.lit("")).alias("content")), F.struct(F.lit("user").alias("role"), audio.alias("content")))


def break_at_punctuation(text: Column) -> Column:
    """A line feed after each Chinese punctuation mark, full stop or comma of the stream display."""
    return F.regexp_replace(text, "([，。？！：,.])", "$1\n")


def break_lines(text: Column) -> Column:
    """For text files: a line feed after Chinese marks, and after a comma, full stop or blank that follows a Latin letter."""
    return F.regexp_replace(F.regexp_replace(text, "([，。？！])", "$1\n"), r"(?<=[a-zA-Z])([,.] )", "$1\n")


def is_url(text: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(text.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def is_probably_base64(text: Column) -> Column:
    """A data URL of audio, or long and without slashes."""
    return F.coalesce(F.startswith(text, F.lit("data:audio")) | (~F.contains(text, F.lit("/")) & ~F.contains(text, F.lit("\\")) & (F.length(text) > 256)), F.lit(False))


def base64_payload(text: Column) -> Column:
    """What stands after the first comma of a data URL; other text as it is."""
    clean = F.ltrim(text)
    return F.when(F.startswith(clean, F.lit("data:")) & F.contains(clean, F.lit(",")), F.regexp_replace(clean, "(?s)^[^,]*,", "")).otherwise(text)


def code_points(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def rounded_count(n: Column, least_digits: Column) -> Column:
    """A parameter count such as 7.0B: the largest of T, B and M that it exceeds, else K."""
    unit = F.when(n > 1e12, F.lit(1e12)).when(n > 1e9, F.lit(1e9)).when(n > 1e6, F.lit(1e6)).otherwise(1e3)
    name = F.when(n > 1e12, "T").when(n > 1e9, "B").when(n > 1e6, "M").otherwise("K")
    scaled = n / unit
    decimals = F.greatest(least_digits - F.length(F.round(scaled).cast("bigint").cast("string")), F.lit(0))
    return F.concat(F.when(decimals <= 0, F.format_string("%.0f", scaled)).when(decimals == 1, F.format_string("%.1f", scaled)).when(decimals == 2, F.format_string("%.2f", scaled)).otherwise(F.format_string("%.3f", scaled)), name)


def naming(base: Column, size: Column, tune: Column, version: Column, encoding: Column, kind: Column) -> Column:
    """A file name of its parts; null parts are skipped, the base may not be null."""
    clean = F.translate(strip(F.coalesce(base, F.lit("ggml-model"))), " /", "--")
    return F.concat_ws("-", clean, size, F.replace(strip(tune), F.lit(" "), F.lit("-")), strip(version), F.upper(strip(encoding)), kind)


def title_of(identifier: Column) -> Column:
    """Hyphens to blanks; words in lower case that aren't versions or numbers get a capital."""
    plain = F.split(F.replace(identifier, F.lit("-"), F.lit(" ")), " ")
    return F.array_join(F.transform(plain, lambda w: F.when((w == F.lower(w)) & ~w.rlike(r"^(v\d+(\.\d+)*|\d.*)$"), F.initcap(w)).otherwise(w)), " ")


def shard_name(base: Column, i: Column, n: Column) -> Column:
    return F.format_string("%s-%05d-of-%05d", base, i, n)


def display_name(name: Column) -> Column:
    """Underscores to blanks, each word with a capital, the rest as it is."""
    return F.array_join(F.transform(F.split(F.replace(name, F.lit("_"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def table_cell(text: Column) -> Column:
    """Text on one line for a table, with bars escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"\n", r"\\n"), r"\|", r"\\|")


def span_pattern(pattern: Column) -> Column:
    """'+5,-3,+2' to spans: sign says whether to take (true) or skip so many."""
    return F.transform(F.split(pattern, ","), lambda p: F.struct(F.startswith(p, F.lit("+")).alias("take"), F.abs(p.cast("int")).alias("n")))


def hz_to_mel(f: Column) -> Column:
    """Linear to 1000 Hz, logarithmic above."""
    return F.when(f >= 1000, 15 + F.log(f / 1000) / (F.log(F.lit(6.4)) / 27)).otherwise(f * 3 / 200)


def mel_to_hz(m: Column) -> Column:
    return F.when(m >= 15, 1000 * F.exp(F.log(F.lit(6.4)) / 27 * (m - 15))).otherwise(m * 200 / 3)


def halved(n: Column) -> Column:
    return F.floor((n - 1) / 2.0) + 1


def feature_length(n: Column) -> Column:
    """Frames after the encoder's front end: 13 for each 100, the rest halved three times."""
    return halved(halved(halved(n % 100))) + F.floor(n / 100.0) * 13
