r"""WARC archives: a writer, and a reader that verifies record boundaries as chains.

Writing. Records are laid out by column functions and written with Spark's text writer, whose line end is the blank
lines that close a record, so files go wherever Spark can write. Of records with equal payloads of at least
`revisit_from` bytes, that with the largest page_id is the response and the others are revisits that refer to it. Only
digests and ids are shuffled for that, not payloads.

Reading. The magic `WARC/1.0` may stand inside a payload, so a match of it is only a candidate. Files are cut at the
magic by Spark's splittable text reader. Row lengths, added up within a block and over the blocks of a file, give byte
offsets. Each task emits its candidates' offset and the offset where the record would end, from its Content-Length.
Links from one candidate to the very next are contracted to runs within a block; pointer jumping over the runs,
doubling its reach each round, then keeps those that can be reached from the start of the file. Everything else is payload.
A record made of several pieces, as it has the magic inside, is put together again from those pieces alone.

Edge cases: a null html is an empty payload; a null page_id is written as "null" and read back as null, a null url as an
empty target; rows that tie on the largest page_id of a payload are each a response; repeated rows give repeated
records; an empty table gives no records; other columns are not read; a file that does not start with a record has none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import content_key, scratch_folder, settled, small_side, table

MAGIC = "WARC/1.0\r\n"
CLOSE = "\r\n\r\n"
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PLACE = ["file", "block", "row"]


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def _revisits(pages: DataFrame, revisit_from: int) -> DataFrame:
    """(digest, bytes, latest): the payloads that pages with different ids share."""
    return (
        pages.select("page_id", F.sha1(_payload()).alias("digest"), F.octet_length(_payload()).alias("bytes"))
        .where(F.col("bytes") >= revisit_from).groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("latest"), F.min("page_id").alias("first"), F.max(F.col("page_id").isNull()).alias("unnamed"))
        .where("first < latest or (unnamed and latest is not null)").select("digest", "bytes", "latest")
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(value): one WARC record per row of pages (page_id, url, html), without the blank lines that close it."""
    shared = small_side(settled(_revisits(pages, revisit_from)))
    rows = (
        pages.select("page_id", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("")).alias("url"), _payload().alias("payload"))
        .withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
        .join(shared, ["digest", "bytes"], "left")
    )
    revisit = F.col("latest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("latest")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(CLOSE),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    kind = F.when(revisit, F.concat(
        F.lit(f"WARC-Type: revisit\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("latest")), F.lit("\r\n"),
    )).otherwise(F.lit("WARC-Type: response\r\n"))
    head = F.concat(
        F.lit(MAGIC), kind, F.lit("WARC-Record-ID: "), _urn(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(CLOSE),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM) -> None:
    """Write the pages as WARC files, one per task."""
    records(pages, revisit_from).write.option("lineSep", CLOSE).text(folder)


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The text between one magic and the next, with its place: file, block, order in the block."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _payload_start(body: Column) -> Column:
    """Bytes of the HTTP header at the start of a record's block."""
    return F.octet_length(F.substring_index(body, CLOSE, 1)) + len(CLOSE)


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per candidate: byte offset, the offset its record would end at, header fields, the payload's digest."""
    row = F.col("value").cast("binary")
    size = F.octet_length("value")
    head_bytes = F.octet_length("head") + len(CLOSE)
    # Whole bytes, not characters: a payload may hold anything.
    body = F.expr(f"cast(substring(cast(value as binary), octet_length(head) + {len(CLOSE)} + 1, block_bytes) as string)")
    parsed = (
        _chunks(spark, folder).withColumn("head", F.substring_index("value", CLOSE, 1)).withColumn("bytes", size)
        .withColumn("block_bytes", F.when(F.contains(F.col("value"), F.lit(CLOSE)), F.expr(r"try_cast(regexp_extract(head, '(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*\r?$', 1) as bigint)")).cast("int"))
        .withColumn("needs", head_bytes + F.col("block_bytes") + len(CLOSE))
        .withColumn("body", F.when(F.col("needs") == F.col("bytes"), body))
        .withColumn("http", F.substring_index("body", CLOSE, 1))
    )
    payload = F.expr(f"substring(cast(body as binary), octet_length(http) + {len(CLOSE)} + 1)")
    rows = parsed.select(
        *_PLACE, "bytes", "needs", F.xxhash64("value").alias("hash"),
        _header("WARC-Type").alias("type"), _header("WARC-Record-ID").alias("id"), _header("WARC-Refers-To").alias("refers"),
        _header("WARC-Payload-Digest").alias("named"),
        F.when(F.col("body").isNotNull(), F.sha1(payload)).alias("digest"),
        F.when(F.col("body").isNotNull(), F.octet_length(payload)).alias("payload_bytes"),
        F.regexp_extract("http", r"(?im)^Content-Length:[ \t]*([0-9]+)", 1).alias("declared"),
    )
    rows = settled(rows)
    # Every row but a file's last is followed by the magic; offsets are of the magic before the row.
    within = Window.partitionBy("file", "block").orderBy("row")
    ends = rows.withColumn("end", F.sum(F.col("bytes") + len(MAGIC)).over(within))
    blocks = rows.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("length"))
    bases = blocks.withColumn("base", F.sum("length").over(Window.partitionBy("file").orderBy("block")) - F.col("length"))
    placed = (
        ends.join(bases.select("file", "block", "base"), ["file", "block"])
        .withColumn("from", F.col("base") + F.col("end") - F.col("bytes") - 2 * len(MAGIC))
        .where(F.col("from") >= 0)  # what stands before the first magic is no candidate
    )
    return placed.withColumn("to", F.col("from") + len(MAGIC) + F.col("needs")).drop("base", "end")


def _runs(candidates: DataFrame) -> DataFrame:
    """Each candidate with its run: candidates of a block in which each record ends where the next candidate starts."""
    order = Window.partitionBy("file", "block").orderBy("from")
    broken = F.coalesce(F.lag("to").over(order) != F.col("from"), F.lit(True))
    return candidates.withColumn("run", F.sum(broken.cast("int")).over(order))


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates on the chain from the start of their file."""
    marked = settled(_runs(candidates))
    run = ["file", "block", "run"]
    heads = marked.groupBy(*run).agg(F.min("from").alias("head"), F.max_by("to", "from").alias("next"))
    # A record may end inside a run, at a candidate that no record of the block before it leads to.
    # So each target is looked up among all candidates: it names the run and the place within it.
    places = marked.select("file", F.col("from").alias("next"), *[F.col(c).alias(f"to_{c}") for c in run[1:]])
    links = settled(heads.join(places, ["file", "next"], "left"))
    # Nodes are the places where a chain may enter a run: file starts and targets of links.
    start = heads.where("head = 0").select("file", F.col("head").alias("node"))
    targets = links.where("to_run is not null").select("file", F.col("next").alias("node"))
    nodes = start.union(targets).distinct()
    jump = settled(
        nodes.join(marked.select("file", F.col("from").alias("node"), *run[1:]), ["file", "node"])
        .join(heads.select(*run, "next"), run).join(nodes.select("file", F.col("node").alias("next"), F.lit(True).alias("known")), ["file", "next"], "left")
        .select("file", "node", F.when(F.col("known"), F.col("next")).alias("next"))
    )
    reached = settled(start)
    most = jump.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most + 1))):
        steps = jump.select("file", "node", "next").where("next is not null")
        reached = settled(reached.union(
            reached.join(steps, ["file", "node"]).select("file", F.col("next").alias("node"))).distinct())
        jump = settled(
            steps.alias("a").join(steps.select("file", F.col("node").alias("next"), F.col("next").alias("far")), ["file", "next"])
            .select("file", "node", F.col("far").alias("next")))
    # A run entered at a node is real from there on; later entries of the same run add nothing.
    entries = (
        reached.join(marked.select("file", F.col("from").alias("node"), *run[1:]), ["file", "node"])
        .groupBy(*run).agg(F.min("node").alias("entry"))
    )
    return marked.join(entries, run).where(F.col("from") >= F.col("entry")).drop("run", "entry")


def _rejoined(spark: SparkSession, folder: str, candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """(file, from, digest, payload_bytes, declared) of the records whose payload holds the magic."""
    broken = kept.where("digest is null and needs is not null").select("file", F.col("from").alias("start"), F.col("to").alias("stop"))
    # A piece belongs to the last record that starts at or before it: the marks of records are carried along the file.
    marks = broken.select("file", F.col("start").alias("from"), F.lit(1).alias("is_record"), "stop")
    inside = Window.partitionBy("file").orderBy("from")
    suspects = candidates.join(broken.select("file").distinct(), "file", "left_semi")
    pieces = (
        suspects.join(marks, ["file", "from"], "left")
        .withColumn("start", F.last(F.when(F.col("is_record") == 1, F.col("from")), True).over(inside))
        .withColumn("stop", F.last("stop", True).over(inside)).where(F.col("from") < F.col("stop"))
        .select("file", "block", "bytes", "hash", "from", "start")
    )
    pieces = settled(pieces)
    texts = _chunks(spark, folder).withColumn("bytes", F.octet_length("value")).withColumn("hash", F.xxhash64("value"))
    keys = ["file", "block", "bytes", "hash"]
    needed = small_side(pieces.select(*keys).distinct())
    found = texts.join(needed, keys, "left_semi").select(*keys, "value").dropDuplicates(keys)
    whole = (
        pieces.join(found, keys).groupBy("file", "start")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from", "value"))), lambda p: p["value"]), MAGIC).alias("value"))
        .withColumn("head", F.substring_index("value", CLOSE, 1))
        .withColumn("body", F.expr(f"substring(cast(value as binary), octet_length(head) + {len(CLOSE)} + 1, octet_length(value) - octet_length(head) - {2 * len(CLOSE)})"))
        .withColumn("http", F.substring_index(F.col("body").cast("string"), CLOSE, 1))
    )
    payload = F.expr(f"substring(body, octet_length(http) + {len(CLOSE)} + 1)")
    return whole.select(
        "file", F.col("start").alias("from"), F.sha1(payload).alias("whole_digest"), F.octet_length(payload).alias("whole_bytes"),
        F.regexp_extract("http", r"(?im)^Content-Length:[ \t]*([0-9]+)", 1).alias("whole_declared"),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder: file, offset, page_id, payload size and digest, type, referred page."""
    candidates = settled(_candidates(spark, folder))
    kept = settled(reachable(candidates))
    rejoined = _rejoined(spark, folder, candidates, kept)
    page = lambda column: F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(.*)>$', 1) as bigint)")
    revisit = F.col("type") == "revisit"
    read_digest = F.coalesce("digest", "whole_digest")
    return kept.join(rejoined, ["file", "from"], "left").select(
        page("id").alias("page_id"),
        F.when(revisit, F.coalesce("declared", "whole_declared").cast("long")).otherwise(F.coalesce("payload_bytes", "whole_bytes").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("named", "^sha1:", "")).otherwise(read_digest).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, page("refers")).alias("refers_to"),
        (revisit | (F.concat(F.lit("sha1:"), read_digest) == F.col("named"))).alias("digest_matches"),
        F.element_at(F.split("file", "/"), -1).alias("archive"), F.col("from").alias("offset"),
    )


def op1_warc(spark, folder: str) -> DataFrame:
    """The whole `pages` table written as archives and read back."""
    archive = scratch_folder(spark, "warc")
    write(table(spark, folder, "pages"), archive)
    return read(spark, archive).drop("archive", "offset")


def oracle(revisit_from: int = REVISIT_FROM) -> str:
    """DuckDB SQL of op1_warc."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS m FROM p),
r AS (SELECT *, n >= {revisit_from} AND m IS NOT NULL AND (page_id IS NULL OR page_id < m) AS again FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN m END AS refers_to, true AS digest_matches FROM r
"""
