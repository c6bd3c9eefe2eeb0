"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of its own size: `size` consecutive words, or the whole item where it is shorter. A window
occurs in a document only if every one of its words does, so its rarest word alone is a necessary prefix: words are
ordered by the number of documents that hold them, and only the rarest word of each window is joined with the words of
the documents. The position of that word fixes where the window would start; the positional bound drops starts before
the text, the length bound drops ends behind it, and what is left is verified word by word over the whole window.

Benchmark windows are taken in blocks of at most `BLOCK_WINDOWS` distinct windows, each of at most `size` words, so that
what is broadcast has a fixed bound; one block is one pass over the documents, and the documents themselves are never
shuffled. Hits are gathered by content, so copies of one text share one row.

Edge cases: null and wordless texts have no words, no hits and the digest of the empty list; a null or wordless item has
no window; an item id that is null counts as the id "null"; repeated items count once by id; repeated documents each get
the same result; an empty benchmark leaves every document clean; of columns with equal names only doc_id and text of the
documents, and item_id and text of the benchmark, are read by `contamination`, and `clean` keeps every document column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import KEY, settled, table, text_key, words

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
BLOCK_WINDOWS = 100_000


def tokens(text: Column) -> Column:
    """Words of a text: runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII."""
    return words(F.translate(text, UPPER, LOWER), SEPARATOR)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, words, items): the distinct windows of all items, numbered by content, with the ids that hold them."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        rows.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(size)))).alias("words"))
        .groupBy("words").agg(F.collect_set("item").alias("items"))
        .select(F.md5(F.array_join("words", " ")).alias("window"), "words", "items")
    )


def _occurrences(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(key_a, key_b, start, stop, window) for one block of windows; texts holds the key and the words w."""
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    rarity = settled(
        texts.select(F.explode(F.array_distinct("w")).alias("word")).join(F.broadcast(vocabulary), "word")
        .groupBy("word").agg(F.count("*").alias("documents"))
    )
    prefixes = (
        windows.select("window", F.col("words").alias("full"), F.posexplode("words").alias("at", "word"))
        .join(F.broadcast(rarity), "word", "left")
        .groupBy("window").agg(F.min(F.struct(F.coalesce("documents", F.lit(0)).alias("documents"), "word", "at")).alias("rarest"), F.first("full").alias("full"))
        .where("rarest.documents > 0")
        .select("window", "full", F.size("full").alias("length"), "rarest.word", "rarest.at")
    )
    start = F.col("place") - F.col("at")
    return (
        texts.select(*KEY, "w", F.size("w").alias("n"), F.posexplode("w").alias("place", "word"))
        .join(F.broadcast(prefixes), "word")
        .where((start >= 0) & (start + F.col("length") <= F.col("n")))
        .where(F.slice("w", start + 1, F.col("length")) == F.col("full"))
        .select(*KEY, start.alias("start"), (start + F.col("length")).alias("stop"), "window")
    )


def occurrences(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every place (in words, end exclusive) of a distinct text where a benchmark window occurs, with its item ids."""
    windows = settled(item_windows(benchmark, size))
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    texts = documents.select(*text_key(), tokens(F.col("text")).alias("w"))
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [
        _occurrences(texts, windows.where(block == k) if blocks > 1 else windows) for k in range(blocks)
    ])
    return found.join(windows.select("window", "items"), "window").drop("window")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans, zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], s["stop"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def _hits(documents: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """One row per distinct contaminated text; the sets are bounded by the text's own words."""
    found = settled(occurrences(documents, benchmark, size))
    spans = found.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    items = found.select(*KEY, F.explode("items").alias("item")).groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return spans.join(items, KEY).select(*KEY, _covered(F.col("spans")).alias("hit"), "items")


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of documents: its words, the words that benchmark windows cover, the items, and the verdict."""
    hits = _hits(documents, benchmark, size)
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return (
        documents.select("doc_id", *text_key(), F.size(tokens(F.col("text"))).cast("long").alias("n_words")).join(hits, KEY, "left")
        .select(
            "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
            F.col("hit").isNotNull().alias("contaminated"),
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with the columns as given."""
    hits = _hits(documents, benchmark, size).select(*KEY)
    names = documents.columns
    rows = documents.select(F.struct(*[documents[c] for c in names]).alias("row"), *text_key())
    return rows.join(hits, KEY, "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op2_decontamination(spark, folder: str) -> DataFrame:
    """The whole `documents` against the whole `benchmark`."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def oracle(size: int = WINDOW) -> str:
    """DuckDB SQL of op2_decontamination, which compares every window of every text."""
    split = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

    def w(text: str) -> str:
        return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), {split}), lambda x: x <> '')"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {w('text')} AS w FROM documents),
it AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {w('text')} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS i FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + {size} - 1], ' ') AS s, len(w[i:i + {size} - 1]) AS n FROM starts),
lens AS (SELECT DISTINCT n FROM win),
spots AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hit AS (SELECT spots.r, spots.i, spots.n, win.item FROM spots JOIN win ON win.n = spots.n AND win.s = array_to_string(spots.w[spots.i:spots.i + spots.n - 1], ' ')),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS l FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, cover.n IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
