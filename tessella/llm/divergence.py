"""Quality rules: distribution divergence.

A document's histograms of character classes and of its language's common words are compared
with the language's reference histograms (means over all documents that pass the base rules and
the length guards) by Jensen-Shannon distance. Only DataFrame functions are used: one pass over
the texts writes a narrow table of counts, from which references and verdicts are computed; the
references are one row per language of ``COMMON_WORDS``, so they may be broadcast.

Base rules: at least 10 words, and at most a fifth of the words in repeated 5-word windows.
Length guards: both histograms are compared from ``MIN_CHARS`` characters and ``MIN_WORDS`` words
on; documents that are shorter by either are judged by the base rules alone.

Defined results: a null text has no words and fails the base rules; a document whose language is
null, or isn't known, is compared with the language whose common words it holds most of (the
first of equals); with a given language that has no references it isn't compared, nor is any
where a language has no document to learn a reference from; repeated rows are each judged
alike. Only id, text and language are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored, table

WHITE_CLASS = "[\\x20\\x09-\\x0D]"
WINDOW = 5
MIN_WORDS_BASE = 10
MAX_REPEATED = 20
MIN_CHARS = 200
MIN_WORDS = 50
TYPICAL_CLASS_DISTANCE = 0.15
TYPICAL_WORD_DISTANCE = 0.25
MAX_CLASS_DISTANCE = 0.28
MAX_TOTAL_DISTANCE = 0.42

# Common words of each language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "das", "den", "zu", "ist", "ein", "nicht", "mit", "auf", "von"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "was"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "un", "con", "no", "por", "las"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "est", "que", "en", "qui", "dans"),
}
CLASSES = ("lower", "upper", "digit", "white", "symbol", "other")


def _held(column: str, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(column, lambda w: w.isin(list(words))))


def _counts(documents: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """One row of counts per document."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    base = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), lang.alias("given"))
    split = base.withColumn("words", F.filter(F.split("t", f"{WHITE_CLASS}+"), lambda w: w != ""))
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    hashed = split.select(
        "id",
        "t",
        "given",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.filter("words", lambda w: w.isin(every)).alias("common"),
    )
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.slice("h", F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))), lambda h, k: F.xxhash64(h, *[F.get("h", k + j) for j in range(1, WINDOW)])),
    )
    windowed = hashed.withColumn("windows", windows).drop("h")
    has_repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = windowed.withColumn("sorted", F.when(has_repeats, F.sort_array(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k")))))).drop("windows")
    marked = ordered.withColumn(
        "places",
        F.array_sort(
            F.transform(
                F.filter(
                    F.transform("sorted", lambda x, k: F.struct(x["k"].alias("k"), (F.coalesce((k > 0) & (F.get("sorted", F.greatest(k - 1, F.lit(0)))["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("sorted", k + 1)["h"] == x["h"], F.lit(False))).alias("again"))),
                    lambda x: x["again"],
                ),
                lambda x: x["k"],
            )
        ),
    ).drop("sorted")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    repeated = F.coalesce(
        F.aggregate("places", start, lambda s, k: F.struct(k.alias("last"), (s["n"] + F.least(F.lit(WINDOW), k - s["last"]).cast("long")).alias("n")), lambda s: s["n"]),
        F.lit(0).cast("long"),
    )
    lines = marked.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    held = {language: _held("common", words) for language, words in COMMON_WORDS.items()}
    most = F.greatest(*held.values())
    guess = F.coalesce(*[F.when(n == most, F.lit(language)) for language, n in held.items()])
    language = F.when(F.col("given").isin(list(COMMON_WORDS)), F.col("given")).otherwise(guess)

    def length_without(pattern: str) -> Column:
        return F.char_length(F.regexp_replace("t", pattern, "")).cast("long")

    counted = lines.select(
        "id",
        "given",
        "n_words",
        "word_chars",
        (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.char_length("t").cast("long").alias("n_chars"),
        length_without("[^\\p{Ll}]+").alias("lower"),
        length_without("[^\\p{Lu}]+").alias("upper"),
        length_without("[^\\p{Nd}]+").alias("digit"),
        "common",
        language.alias("language"),
    )
    of_language = F.coalesce(*[F.when(F.col("language") == k, F.array(*map(F.lit, words))) for k, words in COMMON_WORDS.items()])
    return counted.withColumn("word_counts", F.transform(of_language, lambda w: F.size(F.filter("common", lambda x: x == w)))).drop("common")


def _histograms(counts: DataFrame) -> DataFrame:
    chars = F.greatest(F.col("n_chars"), F.lit(1)).cast("double")
    white = F.col("n_chars") - F.col("word_chars")
    known = [F.col("lower"), F.col("upper"), F.col("digit"), white, F.col("n_symbols")]
    other = F.col("n_chars") - sum(known[1:], known[0])
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    in_list = F.aggregate("word_counts", F.lit(0), lambda a, n: a + n)
    shares = F.transform("word_counts", lambda n: n / words)
    return counts.withColumn("classes", F.array(*[c / chars for c in [*known, other]])).withColumn("words", F.concat(shares, F.array((F.col("n_words") - in_list) / words)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m) / 2).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)))


def _references(profiles: DataFrame) -> DataFrame:
    """Mean histograms of each language; one row per language of COMMON_WORDS at most."""
    sizes = {"classes": len(CLASSES), "words": len(next(iter(COMMON_WORDS.values()))) + 1}
    means = [F.array(*[F.avg(F.get(name, F.lit(k))) for k in range(n)]).alias(f"reference_{name}") for name, n in sizes.items()]
    return profiles.groupBy("language").agg(*means)


def _compared(profiles: DataFrame, references: DataFrame) -> DataFrame:
    joined = profiles.join(F.broadcast(references), "language", "left")
    return joined.withColumn("class_distance", js_distance(F.col("classes"), F.col("reference_classes"))).withColumn("word_distance", js_distance(F.col("words"), F.col("reference_words")))


def judged(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per document: counts, ``base_failed``, both distances (null where the guards or
    a missing reference prevent comparing) and ``kept``."""
    counts = stored(_counts(documents, id_col, text_col, lang_col), "profiles")
    failed = (F.col("n_words") < MIN_WORDS_BASE) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    profiles = _histograms(counts.withColumn("base_failed", failed))
    able = (F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS)
    learned = profiles.filter(~F.col("base_failed") & able).select("language", "classes", "words")
    first = _compared(learned, _references(learned))
    typical = first.filter((F.col("class_distance") <= TYPICAL_CLASS_DISTANCE) & (F.col("word_distance") <= TYPICAL_WORD_DISTANCE)).select("language", "classes", "words")
    comparable = able & (F.col("given").isNull() | F.col("given").isin(list(COMMON_WORDS)))
    found = _compared(profiles, _references(typical))
    for name in ("class_distance", "word_distance"):
        found = found.withColumn(name, F.when(comparable, F.col(name)))
    near = F.coalesce((F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("class_distance") + F.col("word_distance") <= MAX_TOTAL_DISTANCE), F.lit(True))
    return found.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance"
    )


def op1_divergence(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return judged(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_distance(p: str, q: str, n: int) -> str:
    def half(a: str) -> str:
        return f"CASE WHEN {a}[i] > 0 THEN {a}[i] * log2(2 * {a}[i] / ({p}[i] + {q}[i])) / 2 ELSE 0 END"

    return f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: {half(p)} + {half(q)}))))"


def _sql_oracle() -> str:
    languages, size = list(COMMON_WORDS), len(next(iter(COMMON_WORDS.values()))) + 1
    held = {k: f"len(list_filter(words, lambda x: list_contains({_sql_list(v)}, x)))" for k, v in COMMON_WORDS.items()}
    most = f"greatest({', '.join(held.values())})"
    guess = "CASE " + " ".join(f"WHEN {n} = {most} THEN '{k}'" for k, n in held.items()) + " END"
    of_language = "CASE language " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in COMMON_WORDS.items()) + " END"

    def means(name: str, n: int) -> str:
        return "[" + ", ".join(f"avg({name}[{k}])" for k in range(1, n + 1)) + f"] AS r_{name}"

    def references(source: str) -> str:
        return f"SELECT language, {means('classes', len(CLASSES))}, {means('shares', size)} FROM {source} GROUP BY language"

    distances = f"{_sql_distance('classes', 'r_classes', len(CLASSES))} AS dc, {_sql_distance('shares', 'r_shares', size)} AS dw"
    return f"""
WITH b AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{WHITE_CLASS}+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM b
), win AS (
  SELECT rid, i, words[i:i + {WINDOW - 1}] AS five FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)
), again AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, five) > 1
), covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + j AS p FROM again, range({WINDOW}) r(j)) GROUP BY rid
), c AS (
  SELECT rid, doc_id, lang, words, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(t) AS n_chars,
    length(regexp_replace(t, '[^\\p{{Ll}}]+', '', 'g')) AS lower, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper,
    length(regexp_replace(t, '[^\\p{{Nd}}]+', '', 'g')) AS digit,
    CASE WHEN lang IN ({', '.join(f"'{k}'" for k in languages)}) THEN lang ELSE {guess} END AS language
  FROM w LEFT JOIN covered USING (rid)
), h AS (
  SELECT *, n_words < {MIN_WORDS_BASE} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    list_transform([lower, upper, digit, n_chars - word_chars, n_symbols, word_chars - lower - upper - digit - n_symbols], lambda x: x / greatest(n_chars, 1)) AS classes,
    list_transform({of_language}, lambda v: len(list_filter(words, lambda x: x = v)) / greatest(n_words, 1)) AS found
  FROM c
), p AS (
  SELECT *, list_append(found, (n_words - round(list_sum(found) * greatest(n_words, 1))) / greatest(n_words, 1)) AS shares,
    n_words >= {MIN_WORDS} AND n_chars >= {MIN_CHARS} AS able FROM h
), l AS (
  SELECT * FROM p WHERE NOT base_failed AND able
), r1 AS ({references('l')}), d1 AS (
  SELECT language, classes, shares, {distances} FROM l JOIN r1 USING (language)
), r2 AS ({references(f'(SELECT * FROM d1 WHERE dc <= {TYPICAL_CLASS_DISTANCE} AND dw <= {TYPICAL_WORD_DISTANCE})')}), d2 AS (
  SELECT p.*, {distances} FROM p LEFT JOIN r2 USING (language)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN able AND (lang IS NULL OR lang IN ({', '.join(f"'{k}'" for k in languages)}))
    THEN coalesce(dc <= {MAX_CLASS_DISTANCE} AND dc + dw <= {MAX_TOTAL_DISTANCE}, true) ELSE true END AS kept
FROM d2
"""


ORACLE_OP1 = _sql_oracle()
