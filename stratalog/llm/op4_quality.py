"""Quality rules whose cutoffs are certified on labelled documents.

A document is rejected if the base rules fail it, or if one of ``RULES`` is over its cutoff in the document's stratum, the language. For
each stratum, rule and cutoff of the rule's grid, the labelled good documents of the stratum (quality 1) that pass the base rules are a
holdout: n of them, of which k would be rejected. The cutoff is certified if P(Binomial(n, RISK) <= k) <= ERROR / tests, the exact
one-sided (Clopper-Pearson) bound with Bonferroni's correction over all strata, rules and cutoffs. The lowest certified cutoff is used; a
rule with none rejects nothing in that stratum. So with probability 1 - ERROR every rule rejects at most a share RISK of every
stratum's good documents, and all rules together at most len(RULES) * RISK.

Counts are per code point and per word; windows of three words are told apart by 64-bit hashes. Nulls count as empty texts, which fail
the base rules. A null language is a stratum of its own. Repeated rows are judged each on its own; a doc_id with several labels is good if
all of them say so. Without labelled documents only the base rules reject. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, staged, table

RISK = 0.01
ERROR = 0.05
_RATIOS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75)
#: By rule: its value, of columns that ``measured`` makes, and the grid of cutoffs, ascending; a value over the cutoff is bad.
RULES = {
    "symbols": ("n_symbols / n_words", (0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)),
    "repeats": ("n_repeat_words / n_words", _RATIOS),
    "dup_lines": ("n_dup_lines / n_lines", _RATIOS),
    "capitals": ("n_capitals / word_chars", _RATIOS),
    "long_words": ("word_chars / n_words", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 14.0, 16.0, 20.0, 30.0)),
}
_WHITE = " \t\n\x0b\x0c\r"
_LONG = "long"


def repeat_words(words: Column) -> Column:
    """How many words stand in windows of three that the text has twice or more."""

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(positions, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]

    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.struct(F.xxhash64(w, words[i + 1], words[i + 2]).alias("h"), i.alias("p")))
    same = lambda s, i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
    twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(covered(F.sort_array(F.transform(twice, lambda x: x["p"]))))


def measured(docs: DataFrame) -> DataFrame:
    """The counts of each document, and whether the base rules fail it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    by_word = let(words, lambda w: F.struct(F.size(w).cast(_LONG).alias("n_words"), F.char_length(F.array_join(w, "")).cast(_LONG).alias("word_chars"), repeat_words(w).cast(_LONG).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast(_LONG).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast(_LONG).alias("n_dup_lines")))
    left = lambda of: F.char_length(F.regexp_replace(text, of, "")).cast(_LONG)
    rows = docs.select(F.col("doc_id").cast(_LONG).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("lang").cast("string").alias("lang"), by_word.alias("w"), by_line.alias("l"), left(r"[^#*$%&|<>]+").alias("n_symbols"), left("[^A-Z]+").alias("n_capitals"))
    rows = rows.select("doc_id", "version", "lang", "w.*", "l.*", "n_symbols", "n_capitals")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _certified(k: Column, n: Column, error: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k) <= error, by its terms one after the other; for k over the mean it never is."""
    odds = math.log(risk / (1 - risk))
    first = F.struct((n * math.log1p(-risk)).alias("log"), F.exp(n * math.log1p(-risk)).alias("sum"))

    def more(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + odds
        return let(log, lambda x: F.struct(x.alias("log"), (a["sum"] + F.exp(x)).alias("sum")))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast(_LONG), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k > risk * n, F.lit(False)).otherwise(F.aggregate(terms, first, more)["sum"] <= error)


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """By stratum, the certified cutoff of each rule, null where there is none."""
    good = labels.groupBy(F.col("doc_id").cast(_LONG).alias("doc_id")).agg(F.min("quality").alias("_good")).where("_good = 1")
    held = rows.where("not base_failed").join(good, "doc_id").groupBy("lang")
    value = {name: F.expr(f"double({of})") for name, (of, _) in RULES.items()}
    tests = [(name, cutoff) for name, (_, grid) in RULES.items() for cutoff in grid]
    counts = held.agg(F.count("*").alias("n"), *[F.count(F.when(value[name] > cutoff, 1)).alias(f"k{i}") for i, (name, cutoff) in enumerate(tests)])
    # one row for each stratum, all of which share the error
    counts = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("strata"))))
    share = error / (F.col("strata") * len(tests))
    lowest = {name: F.coalesce(*[F.when(_certified(F.col(f"k{i}"), F.col("n"), share, risk), F.lit(cutoff)) for i, (of, cutoff) in enumerate(tests) if of == name]) for name in RULES}
    return counts.select("lang", *[c.alias(f"most_{name}") for name, c in lowest.items()])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its counts and the verdict ``kept``, and with its language and ``version``, a hash of the text."""
    rows = staged(measured(docs), "quality")
    found = cutoffs(rows, labels).withColumnRenamed("lang", "_lang")
    joined = rows.join(F.broadcast(found), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    over = [F.coalesce(F.expr(f"double({of})") > F.col(f"most_{name}"), F.lit(False)) for name, (of, _) in RULES.items()]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~bad)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lang", "version")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("lang", "version")


def _sql() -> str:
    tests = [(name, i, of, cutoff) for name, (of, grid) in RULES.items() for i, cutoff in enumerate(grid)]
    ratio = {name: "(" + " / nullif(".join(f"{x}::DOUBLE" for x in of.split(" / ")) + ", 0))" for name, (of, _) in RULES.items()}
    rules = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, {r} AS value FROM counted" for n, r in ratio.items())
    grid = ", ".join(f"('{name}', {cutoff}::DOUBLE)" for name, _, _, cutoff in tests)
    white = r"[\x20\x09-\x0D]"
    return f"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM texts WHERE len(w) > 2)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
      len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT AS n_lines,
      n_lines - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM texts LEFT JOIN repeats USING (doc_id))),
ruled AS ({rules}),
grid(rule, cutoff) AS (VALUES {grid}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
tested AS (
  SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
  FROM counted JOIN good USING (doc_id) JOIN ruled USING (doc_id) JOIN grid USING (rule) WHERE NOT base_failed GROUP BY lang, rule, cutoff),
bounded AS (
  SELECT *, k <= {RISK} * n AND (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) <= {ERROR} / count(*) OVER () AS certified FROM tested),
lowest AS (SELECT lang, rule, min(cutoff) AS most FROM bounded WHERE certified GROUP BY lang, rule),
bad AS (SELECT DISTINCT doc_id FROM counted JOIN ruled USING (doc_id) JOIN lowest ON lowest.rule = ruled.rule AND lowest.lang IS NOT DISTINCT FROM counted.lang WHERE value > most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM counted"""


SQL = _sql()
