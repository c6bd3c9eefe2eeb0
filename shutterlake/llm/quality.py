"""Quality rules: in-document statistics and cross-document line frequency.

A line that many documents of one host share is boilerplate. Lines are normalised (trimmed, lower case, one blank
between words) and hashed; for each host and hash the distinct documents are counted, where copies of one text count
once. Lines above the limits are removed, and a document that loses more than half of its words is rejected.

Edge cases: a null text has no words, lines or symbols and fails the word minimum; a null host is a host of its own;
repeated rows each get their own result; ties do not arise, since all counts are exact; an empty table gives an empty
result; columns other than the three named ones are ignored by `assess` and kept by `clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import KEY, SPACE, let, settled, small_side, table, text_key, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SALTS = 16


@dataclass(frozen=True)
class Limits:
    """A line is removed above both line limits; shares are of the host's distinct documents and of a text's words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    line_documents: int = 10
    line_percent: float = 5.0
    min_kept_share: float = 0.5


def _repeat_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text."""
    windows = F.transform(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(0))),
        lambda word, i: F.xxhash64(word, F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        found = let(ordered, lambda rows: F.filter(
            rows, lambda row, k: same(row, F.get(rows, k - 1)) | same(row, F.get(rows, k + 1)),
        ))
        places = F.flatten(F.transform(found, lambda row: F.array(row["i"], row["i"] + 1, row["i"] + 2)))
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0)).otherwise(F.size(F.array_distinct(places)))

    return let(windows, count)


def signals(text: Column) -> Column:
    """In-document statistics as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    tokens = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))
    duplicates = let(lines, lambda rows: F.size(rows) - F.size(F.array_distinct(rows)))
    return let(tokens, lambda t: F.struct(
        t["n_words"].alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicates.cast("long").alias("n_dup_lines"),
        t["n_repeat_words"].alias("n_repeat_words"),
    ))


def normalised(line: Column) -> Column:
    """A line as it is compared: lower case, trimmed, one blank between words."""
    return F.regexp_replace(F.btrim(F.lower(line), F.lit(BLANKS)), SPACE, " ")


def line_hash(line: Column) -> Column:
    """Hash of a normalised line."""
    return F.xxhash64(normalised(line))


def _lines(documents: DataFrame) -> DataFrame:
    """One row per distinct text and host, settled: the hash and number of words of each of its lines."""
    rows = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normalised), lambda line: line != "")
    counted = F.transform(rows, lambda line: F.struct(
        F.xxhash64(line).alias("hash"), (F.length(line) - F.length(F.translate(line, " ", "")) + 1).alias("words"),
    ))
    return settled(
        documents.select(*text_key(), F.col("source").alias("host"), counted.alias("lines"))
        .groupBy(*KEY, "host").agg(F.first("lines").alias("lines"))
    )


def frequent_lines(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(key_a, key_b, host, hash, words): the lines above the limits, for each distinct text and host that has them.

    Counts combine before they shuffle. More than so many documents of a host leave few lines above the limits, so
    these are broadcast if counting shows them small; else a line, which may stand in most documents of a host, is
    spread over a fixed number of salts.
    """
    lines = _lines(documents)
    hosts = lines.groupBy("host").agg(F.count("*").alias("host_documents"))
    counts = (
        lines.select("host", F.explode(F.array_distinct("lines.hash")).alias("hash"))
        .groupBy("host", "hash").agg(F.count("*").alias("documents")).where(F.col("documents") > limits.line_documents)
    )
    above = settled(
        counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
        .where(F.col("documents") * 100 > F.col("host_documents") * limits.line_percent).select("c.host", "hash"))
    rows = lines.select(*KEY, "host", F.explode("lines").alias("line")).select(*KEY, "host", "line.*")
    same = F.col("l.host").eqNullSafe(F.col("a.host")) & (F.col("l.hash") == F.col("a.hash"))
    side = small_side(above)
    if side is above:
        above = above.select("host", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows, side = rows.withColumn("salt", F.pmod("key_a", F.lit(SALTS)).cast("int")), above
        same &= F.col("l.salt") == F.col("a.salt")
    return rows.alias("l").join(side.alias("a"), same).select("key_a", "key_b", "l.host", "l.hash", "words")


def _verdict(limits: Limits) -> tuple[Column, Column]:
    failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent)
    return failed, ~failed & (F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * limits.min_kept_share)


def assess(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row of documents (doc_id, text, source): statistics, words in removed lines, base_failed and kept.

    Only numbers are shuffled here, never texts.
    """
    removed = frequent_lines(documents, limits).groupBy(*KEY, "host").agg(F.sum("words").alias("removed"), F.countDistinct("hash").alias("lines"))
    own = documents.select(
        "doc_id", *text_key(), F.col("source").alias("host"), signals(F.col("text")).alias("s"),
    )
    failed, kept = _verdict(limits)
    return (
        own.alias("d").join(removed.alias("r"), [F.col(f"d.{k}") == F.col(f"r.{k}") for k in KEY] + [F.col("d.host").eqNullSafe(F.col("r.host"))], "left")
        .select("doc_id", "s.*", F.coalesce("removed", F.lit(0)).alias("n_removed_words"), F.coalesce("lines", F.lit(0)).alias("n_removed_lines"))
        .withColumn("base_failed", failed).withColumn("kept", kept)
    )


def clean(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept documents with the frequent lines taken out of their texts; columns as given, n_chars renewed."""
    removed = frequent_lines(documents, limits).groupBy(*KEY, "host").agg(F.sum("words").alias("n_words_out"), F.collect_set("hash").alias("bad"))
    names = documents.columns
    own = documents.select(
        F.struct(*[documents[c] for c in names]).alias("row"), *text_key(),
        F.col("source").alias("host"), signals(F.col("text")).alias("s"),
    )
    _, kept = _verdict(limits)
    joined = (
        own.alias("d").join(removed.alias("r"), [F.col(f"d.{k}") == F.col(f"r.{k}") for k in KEY] + [F.col("d.host").eqNullSafe(F.col("r.host"))], "left")
        .select("row", "s.*", "bad", F.coalesce("n_words_out", F.lit(0)).alias("n_removed_words")).where(kept)
    )
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda line: ~F.array_contains(F.col("bad"), line_hash(line))), "\n")
    text = F.when(F.col("bad").isNull(), F.col("row.text")).otherwise(left)
    out = joined.withColumn("text_left", text)
    renewed = {"text": F.col("text_left"), "n_chars": F.length("text_left").cast("long")}
    return out.select(*[renewed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def op10_quality_rules(spark, folder: str) -> DataFrame:
    """Quality rules over the whole `documents` table."""
    return assess(table(spark, folder, "documents"))


def oracle(limits: Limits = Limits()) -> str:
    """DuckDB SQL of op10_quality_rules."""
    return rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, row_number() OVER () AS r,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls
  FROM documents),
tri AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM tri) WHERE n > 1),
pos AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
ln AS (SELECT r, host, text, lower(regexp_replace(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM (SELECT r, host, text, unnest(ls) AS l FROM d)),
freq AS (SELECT host, l, count(DISTINCT text) AS n FROM ln GROUP BY host, l),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
bad AS (SELECT f.host, f.l FROM freq f JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host WHERE f.n > {limits.line_documents} AND f.n * 100 > h.n * {limits.line_percent}),
gone AS (SELECT ln.r, sum(len(string_split(ln.l, ' '))) AS words, count(DISTINCT ln.l) AS lines
         FROM ln JOIN bad ON ln.host IS NOT DISTINCT FROM bad.host AND ln.l = bad.l GROUP BY ln.r),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(pos.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.words, 0)::BIGINT AS n_removed_words, coalesce(gone.lines, 0)::BIGINT AS n_removed_lines
  FROM d LEFT JOIN pos USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {limits.min_words} OR n_repeat_words * 100 > n_words * {limits.max_repeat_percent} AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - n_removed_words >= n_words * {limits.min_kept_share} AS kept FROM f
"""
