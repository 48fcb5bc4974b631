"""Operator 8, quality rules: a rule bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps the
measurements and one bit a failed rule; a policy is a version number and the set
of bits that reject, so verdicts under any version, and what each rule alone
costs, come from the ledger by bitwise operations, without reading texts again.

Cases: null or wordless text has all measurements 0 and fails ``too_few_words``.
Texts are read whole, however long.
Repeated rows are judged each; an empty table gives an empty ledger.  Input
columns named as a measurement, ``failures`` or ``kept`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.common import table
from vertexloom.llm.text_stats import FIELDS, with_stats

#: Rule by name, in the order of bits; true where a document fails.  Only append.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 60 * (n_lower + n_upper)",
    "exclamations": "100 * n_shouts > 50 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "controls": "100 * n_controls > n_words",
}
BASE = ("too_few_words", "repeated_windows")
#: What rejects, by policy version.
POLICIES = {1: BASE, 2: (*BASE, "symbols", "repeated_lines", "shouting", "exclamations", "long_words", "short_words"), 3: tuple(RULES)}
CURRENT = 2


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules) -> int:
    return sum(bit(r) for r in rules)


def ledger(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the measurements and ``failures`` (long): bit i is set if rule i fails."""
    out = with_stats(df, text_col, keep)
    bits = F.lit(0).cast("long")
    for rule, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failures", bits)


def failed(rules, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def judge(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """Append ``kept`` under one policy to a ledger."""
    return entries.withColumn("kept", ~failed(POLICIES[version]))


def ablation(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """One row a rule of the policy: documents that fail it, and those that only it rejects.

    Masks are counted first, so at most 2^rules rows are shuffled from a task.
    """
    policy = F.lit(mask(POLICIES[version])).cast("long")
    masks = entries.groupBy(F.col("failures").bitwiseAND(policy).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in POLICIES[version]])).alias("r")
    rows = masks.select("m", "n", rules)
    hit = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(hit(F.col("m").bitwiseAND(F.col("r.b")) != 0).alias("n_failed"), hit(F.col("m") == F.col("r.b")).alias("n_only"))


OUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judge(entries).withColumn("base_failed", failed(BASE)).select(*OUT)


_COUNT = "CAST(length(regexp_replace(coalesce(text, ''), '[^{}]', '', 'g')) AS BIGINT)"
_BITS = " + ".join(f"CASE WHEN {fails} THEN {bit(r)} ELSE 0 END" for r, fails in RULES.items())
SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    {_COUNT.format(r"#*$%&|<>")} AS n_symbols, {_COUNT.format("A-Z")} AS n_upper, {_COUNT.format("a-z")} AS n_lower,
    {_COUNT.format("!?")} AS n_shouts, {_COUNT.format(r"\x00-\x08\x0E-\x1F\x7F")} AS n_controls
  FROM documents),
g AS (SELECT row, i, words[i : i + 2] AS g FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
t AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM g) WHERE c > 1),
r AS (SELECT row, count(DISTINCT i + o) AS n FROM t, (SELECT unnest([0, 1, 2]) AS o) GROUP BY row),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, n_upper, n_lower, n_shouts, n_controls
  FROM w LEFT JOIN r USING (row)),
f AS (SELECT *, CAST({_BITS} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failures & {mask(BASE)}) <> 0 AS base_failed, (failures & {mask(POLICIES[CURRENT])}) = 0 AS kept, failures
FROM f
"""
