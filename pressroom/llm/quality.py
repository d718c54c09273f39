"""Quality rules: counts of a text, and how far its histograms diverge from those of its language.

References are learnt from all documents that name a language: shares of character
classes and of the language's most frequent words. A document is compared with the
reference of its own language by Jensen-Shannon distance (base 2, 0 to 1); texts
below the minimum lengths are not judged so. Everything is a built-in expression, and
languages are joined, so there may be any number of them.

Defined results: a null text counts as empty, has no words and fails the base rules. A document that names no
language, or one without a reference, diverges from nothing. An empty table gives no rows. Very long texts are judged whole. Repeated
rows are judged one by one; columns beyond text and lang are passed on unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.common import read, stored

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Character classes, each taken out of what the former ones left; the rest is the last class.
CLASSES = ("[a-z]+", SPACES, "[A-Z]+", "[0-9]+", r"[\x21-\x7E]+", r"\p{L}+")
#: Words in a language's histogram, besides one bin for all others.
COMMON_WORDS = 16
#: A language needs as many words before it serves as a reference.
LEAST_REFERENCE_WORDS = 1000
#: Shorter texts are too small a sample to compare.
LEAST_CHARACTERS = 200
LEAST_COMPARED_WORDS = 50
#: Distances beyond which no language explains the text.
FAR_CLASSES = 0.28
FAR_WORDS = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(words: Column) -> Column:
    """Words within windows that occur twice or more.

    Distinct hashes prove distinct windows; only where some agree are the windows themselves sorted and compared.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(WINDOW))))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i"))))
    bound = lambda array, body: F.element_at(F.transform(F.array(array), body), 1)  # noqa: E731  one evaluation for all uses
    near = lambda s, k: F.get(s, k)["w"]
    twice = lambda s: F.filter(
        s, lambda x, k: F.coalesce(x["w"] == near(s, k + 1), F.lit(False)) | F.coalesce((k > 0) & (x["w"] == near(s, F.greatest(k - 1, F.lit(0)))), F.lit(False))
    )
    places = bound(windows, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
    gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    covered = bound(places, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))
    unique = bound(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < WINDOW, 0).when(unique, 0).otherwise(covered).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """The rows of docs with _words, _classes (characters per class) and the base counts added."""
    out = docs.withColumn("_rest0", F.coalesce(F.col("text"), F.lit("")))
    for k, kind in enumerate(CLASSES):
        out = out.withColumn(f"_rest{k + 1}", F.regexp_replace(f"_rest{k}", kind, ""))
    sizes = [F.length(f"_rest{k}") for k in range(len(CLASSES) + 1)]
    classes = [a - b for a, b in zip(sizes, sizes[1:], strict=False)] + sizes[-1:]
    lines = F.filter(F.split(F.col("_rest0"), "\n"), lambda s: F.length(F.regexp_replace(s, SPACES, "")) > 0)
    out = out.select(
        *docs.columns,
        words_of(F.col("_rest0")).alias("_words"),
        F.array(*classes).alias("_classes"),
        lines.alias("_lines"),
        (sizes[4] - F.length(F.regexp_replace("_rest4", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    out = out.select(
        *docs.columns,
        "_words",
        "_classes",
        F.size("_words").cast("long").alias("n_words"),
        (F.aggregate("_classes", F.lit(0), lambda a, x: a + x) - F.get("_classes", 1)).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def references(docs: DataFrame) -> DataFrame:
    """lang, _words, _word_shares (one more than the words: all others), _class_shares of every language with LEAST_REFERENCE_WORDS words."""
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = named.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total")).where(F.col("total") >= LEAST_REFERENCE_WORDS)
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS).groupBy("lang")
    top = top.agg(F.sort_array(F.collect_list(F.struct("rank", "word", "count"))).alias("top"))
    rest = named.select("lang", F.col("text").alias("_rest0"))
    for k, kind in enumerate(CLASSES):
        rest = rest.withColumn(f"_rest{k + 1}", F.regexp_replace(f"_rest{k}", kind, ""))
    sizes = [F.sum(F.length(f"_rest{k}")) for k in range(len(CLASSES) + 1)]
    rest = rest.groupBy("lang").agg(F.array(*sizes).alias("sizes"))
    shares = F.transform("top", lambda t: t["count"] / F.col("total"))
    others = F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))
    left = lambda x, k: (x - F.coalesce(F.get("sizes", k + 1), F.lit(0))) / F.greatest(F.get("sizes", 0), F.lit(1))
    found = totals.join(top, "lang").join(rest, "lang")
    return found.select(
        "lang", F.transform("top", lambda t: t["word"]).alias("_words_of"), F.concat(shares, F.array(others)).alias("_word_shares"), F.transform("sizes", left).alias("_class_shares")
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two lists of shares, base 2."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def judged(docs: DataFrame) -> DataFrame:
    """_row (the row of docs), its counts, class_distance and word_distance (null: no reference, or too short) and kept."""
    known = stored(references(docs))
    source = docs.select("text", "lang", F.struct(*docs.columns).alias("_row"))
    out = counted(source).join(known, "lang", "left")
    # The common words of a text, found in one pass of a pattern that stands between white space or ends.
    quoted = F.transform("_words_of", lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    apart = SPACES.removesuffix("+").replace("[", "[^", 1)
    pattern = F.concat(F.lit(f"(?<!{apart})(?:"), F.array_join(quoted, "|"), F.lit(f")(?!{apart})"))
    common = F.regexp_extract_all(F.lower("text"), pattern, F.lit(0))
    out = out.withColumn("_hits", F.when(F.col("n_words") >= LEAST_COMPARED_WORDS, common))
    found = F.transform("_words_of", lambda w: F.size("_hits") - F.size(F.array_remove("_hits", w)))
    out = out.withColumn("_counts", F.concat(found, F.array((F.col("n_words") - F.size("_hits")).cast("int"))))
    total = F.aggregate("_classes", F.lit(0), lambda a, x: a + x)
    class_shares = F.transform("_classes", lambda x: x / F.greatest(total, F.lit(1)))
    word_shares = F.transform("_counts", lambda x: x / F.greatest(F.col("n_words"), F.lit(1)))
    out = out.withColumns(
        {
            "class_distance": F.when(total >= LEAST_CHARACTERS, jensen_shannon(class_shares, F.col("_class_shares"))),
            "word_distance": F.when(F.col("n_words") >= LEAST_COMPARED_WORDS, jensen_shannon(word_shares, F.col("_word_shares"))),
        }
    )
    diverges = F.coalesce(F.col("class_distance") > FAR_CLASSES, F.lit(False)) | F.coalesce(F.col("word_distance") > FAR_WORDS, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~diverges)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    # Written first: a filter pushed down would repeat the distances' expressions beyond what the driver can hold.
    return stored(judged(docs).select("_row", "kept")).where("kept").select("_row.*")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's counts and verdicts over the whole documents table."""
    out = judged(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    rounded = [F.round(c, 6).alias(c) if c.endswith("distance") else c for c in names]
    return out.select("_row.doc_id", *rounded)


def _rests(source: str) -> str:
    """The text with one character class after the other taken out of it, as columns r0, r1 ..."""
    out = f"SELECT *, coalesce(text, '') AS r0 FROM {source}"
    for k, kind in enumerate(CLASSES):
        out = f"SELECT *, regexp_replace(r{k}, '{kind}', '', 'g') AS r{k + 1} FROM ({out})"
    return out


_SIZES = ", ".join(f"length(r{k})" for k in range(len(CLASSES) + 1))
_SPLIT = f"list_filter(regexp_split_to_array({{}}, '{SPACES}'), lambda w: w <> '')"
_JS = """sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda x: CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END
    + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END)) / 2))"""
_DIFFERENCES = f"list_transform(range(1, {len(CLASSES) + 2}), lambda i: {{s}}[i] - coalesce({{s}}[i + 1], 0))"

#: The same rules in SQL.
ORACLE_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, text IS NOT NULL AS given FROM documents),
  sized AS (SELECT r, doc_id, lang, given, text, [{_SIZES}] AS sizes, {_SPLIT.format("text")} AS w FROM ({_rests("docs")})),
  named AS (SELECT lang, unnest({_SPLIT.format("lower(text)")}) AS word FROM docs WHERE lang IS NOT NULL AND given),
  counts AS (SELECT lang, word, count(*) AS n FROM named GROUP BY 1, 2),
  totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY 1 HAVING sum(n) >= {LEAST_REFERENCE_WORDS}),
  top AS (SELECT lang, list(word ORDER BY k) AS words, list(n ORDER BY k) AS ns FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM counts) WHERE k <= {COMMON_WORDS} GROUP BY 1),
  classes AS (SELECT lang, [{", ".join(f"sum(sizes[{k + 1}])::DOUBLE" for k in range(len(CLASSES) + 1))}] AS sizes FROM sized WHERE lang IS NOT NULL AND given GROUP BY 1),
  known AS (SELECT lang, words, list_transform(ns, lambda n: n::DOUBLE / total) AS shares, list_transform({_DIFFERENCES.format(s="sizes")}, lambda d: d / greatest(sizes[1], 1)) AS class_shares
    FROM totals JOIN top USING (lang) JOIN classes USING (lang)),
  windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS said FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM sized)),
  twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, said) AS n FROM windows) WHERE n > 1),
  covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS o(k) GROUP BY 1),
  lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
  base AS (SELECT s.*, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM sized s JOIN lines USING (r) LEFT JOIN covered c USING (r)),
  hits AS (SELECT b.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed, words, shares, class_shares,
      list_transform(words, lambda x: len(list_filter(w, lambda y: lower(y) = x))) AS found FROM base b LEFT JOIN known USING (lang)),
  far AS (SELECT *, CASE WHEN sizes[1] >= {LEAST_CHARACTERS} AND words IS NOT NULL THEN {_JS.format(p="list_transform(" + _DIFFERENCES.format(s="sizes") + ", lambda d: d::DOUBLE / greatest(sizes[1], 1))", q="class_shares")} END AS class_distance,
      CASE WHEN n_words >= {LEAST_COMPARED_WORDS} AND words IS NOT NULL THEN {_JS.format(
          p="list_transform(list_append(found, n_words - list_sum(found)), lambda x: x::DOUBLE / greatest(n_words, 1))", q="list_append(shares, greatest(0, 1 - list_sum(shares)))")} END AS word_distance FROM hits)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(class_distance > {FAR_CLASSES}, false) AND NOT coalesce(word_distance > {FAR_WORDS}, false) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM far"""
