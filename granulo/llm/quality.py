"""Quality rules as a bitmask ledger, in DataFrame functions only.

ledger() evaluates every rule once and stores a failure bit for each beside the measurements it read. A policy is a
version's mask of bits: applying another one, or asking what a rule alone rejects, needs the stored bits and never the
texts. ablations() works on the counts of distinct masks, which bitwise aggregation makes before anything is shuffled.

Defined results: a null text has no words and fails `few_words`; equal rows are judged each for itself; a text without
line breaks is one line; an empty table gives no rows; ledger() keeps no other columns, so clashing names don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Percent, as whole numbers so that every engine rounds alike.
MAX_SYMBOLS_PER_100_WORDS, MAX_DUP_LINE_PERCENT, MAX_SHOUTS_PER_100_WORDS = 25, 30, 50
WORD_CHARS = (2, 20)

#: Each rule's bit is its place here; places never change, new rules go to the end.
RULES: dict[str, Column | str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_windows": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOLS_PER_100_WORDS} * n_words",
    "repeated_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
    "shouting": f"100 * n_shouts > {MAX_SHOUTS_PER_100_WORDS} * n_words",
    "short_words": f"word_chars < {WORD_CHARS[0]} * n_words",
    "long_words": f"word_chars > {WORD_CHARS[1]} * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versions are never edited; a change is a new one.
POLICIES = {"base": BASE, "v1": sum(BIT.values())}
CURRENT = "v1"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts"]


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: named columns may be pasted into lambdas and run for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; h: the hashes of all windows in order."""

    def positions(s: Column) -> Column:
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["p"]))

    def length(p: Column) -> Column:
        later = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
        end = F.aggregate(later, F.struct(F.lit(WINDOW).cast("long").alias("n"), F.get(p, F.lit(0)).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at")))
        return end["n"]

    sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return let(sorted_, lambda s: let(positions(s), length))


def measure(text: Column) -> Column:
    """A struct of MEASURES for a text."""
    t = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
        repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated.alias("n_repeat_words"))

    words = let(F.array_remove(F.split(t, SPACE), ""), of)
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return let(F.struct(words.alias("w"), lines.alias("l")), lambda s: F.struct(
        s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        s["l"]["dup"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"), s["l"]["n"].alias("n_lines"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_shouts"),
    ))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and fail_bits of each row of docs (doc_id, text)."""
    measured = docs.select("doc_id", measure(F.col("text")).alias("m")).select("doc_id", "m.*")
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a policy."""
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows it fails, rows that only it fails, and rows kept without it."""
    masks = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])).alias("bits")).agg(F.count("*").alias("n"))
    names = [x for x in RULES if POLICIES[version] & BIT[x]]
    sums = masks.agg(
        F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("n"))), F.lit(0)).alias("kept"),
        *[F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(BIT[x])) != 0, F.col("n"))), F.lit(0)).alias(f"fails_{x}") for x in names],
        *[F.coalesce(F.sum(F.when(F.col("bits") == BIT[x], F.col("n"))), F.lit(0)).alias(f"only_{x}") for x in names],
    )
    each = F.array(*[F.struct(F.lit(x).alias("rule"), F.col(f"fails_{x}").alias("failed"), F.col(f"only_{x}").alias("failed_only_here"), (F.col("kept") + F.col(f"only_{x}")).alias("kept_without")) for x in names])
    return sums.select(F.inline(each))


def keep(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of docs (any columns) that a policy keeps."""
    names, m = "|".join(MEASURES), common.spare("m__", docs)
    failed = " OR ".join(re.sub(rf"\b({names})\b", r"m.\1", rule) for name, rule in RULES.items() if POLICIES[version] & BIT[name])
    # the measures' column is named once, in a lambda: named once for each rule, it would be pasted and run as often
    return docs.withColumn(m, measure(docs["text"])).filter(F.expr(f"NOT exists(array({m}), m -> {failed})")).drop(m)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(common.table(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op1_ablations(spark, sf_dir: str) -> DataFrame:
    return ablations(ledger(common.table(spark, sf_dir, "documents")))


_LEDGER_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c
  FROM (SELECT doc_id, i, ws[i:i + 4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t WHERE len(ws) >= 5))
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM win, range(5) AS r(j) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id
), led AS (
  SELECT *, (%s)::BIGINT AS fail_bits FROM m
)
""".replace("%s", " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items()))

SQL = {
    "op1_quality_rules": _LEDGER_SQL + f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {POLICIES[CURRENT]}) = 0 AS kept, fail_bits FROM led",
    "op1_ablations": _LEDGER_SQL + " UNION ALL ".join(f"SELECT '{x}' AS rule, count(*) FILTER (WHERE fail_bits & {BIT[x]} <> 0) AS failed, count(*) FILTER (WHERE fail_bits = {BIT[x]}) AS failed_only_here, count(*) FILTER (WHERE fail_bits = 0 OR fail_bits = {BIT[x]}) AS kept_without FROM led" for x in RULES),
}
