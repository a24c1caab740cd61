"""WARC archives: writing, boundary-chain verification, reading back.

Writing. Every page becomes one record; of pages with equal payloads that with
the largest id is a response, the others are revisits that name it. Records
are lines of Spark's text writer whose line separator is the two CRLFs that
end a WARC record, so each task streams an uncompressed archive to any file
system. Pages do not move: the revisits (usually few) are sent to the tasks if
they are below a checked size, otherwise joined by id.

Reading. Spark's text reader cuts the archives at the version line, wherever
file splits fall, so the chunks of a file are the candidates for records,
false ones (the version line inside a payload) included. The chunks' lengths,
summed up from the file's start, give their offsets; the header's length and
Content-Length give the offset of the record that must follow. Then pointer
jumping from offset 0 doubles the reach in each round, and only candidates that
the chain reaches are records. A payload that holds the version line is put
together from its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut, fresh_path
from tessera.sources.tables import table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Parts in which pages of one payload meet.
SALTS = 16
#: Revisits up to this number (about 16 bytes each) are sent to every task.
BROADCAST_ROWS = 2_000_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 5 hex digits are 4 digits of base 32."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response).

    Null html is the empty payload. A page is a revisit if its payload has
    ``min_bytes`` bytes or more and another page with an equal payload has a
    larger id; a null id is smaller than any other. Rows that repeat the largest
    id are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    # two passes over the pages, as digests are cheaper than keeping the payloads
    slim = cut(rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest"), "warc-digests")
    tops = slim.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top is not null")
    # equal payloads meet in SALTS parts, however many there are
    tops = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", "digest"), F.lit(SALTS)).cast("int"))
    later = salted.join(tops, ["digest", "salt"]).filter("page_id is null or page_id < top")
    later = cut(later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("top").alias("refers_to")).distinct(), "warc-revisits")
    small = later.count() <= BROADCAST_ROWS
    on = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    joined = rows.join(F.broadcast(later) if small else later, on, "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to")


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A record's text without the CRLFs that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    revisit = refers_to.isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length(payload)), F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(payload),
    )
    no_url = F.lit("urn:none")
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace(url.cast("string"), r"[\r\n]", ""), no_url)),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(http)), F.lit("\r\n"),
    )
    return F.concat(head, http)


def write_archives(records: DataFrame, path: str) -> None:
    """Archives below ``path``: one for each task, uncompressed WARC 1.0."""
    row = record(*[F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to")])
    records.select(row.alias("value")).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """What lies between version lines: file, block, order in the block, value, bytes (with one version line).

    ``files`` picks archives; it has eight bytes for each, and there are as many archives as writing tasks.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("order"), (F.octet_length("value") + len(MAGIC)).cast("long").alias("bytes"),
    )
    return raw if files is None else raw.join(F.broadcast(files), "file", "left_semi")


def _placed(chunks: DataFrame) -> DataFrame:
    """The chunks with the offset ``at`` of the version line before them; what precedes a file's first line goes.

    A task reads a split's lines in order and a split holds as many as fit
    maxPartitionBytes, so sums within a block and over blocks give the offsets.
    """
    blocks = chunks.groupBy("file", "block").agg(F.sum("bytes").alias("sum"))
    blocks = blocks.select("file", "block", (F.sum("sum").over(Window.partitionBy("file").orderBy("block")) - F.col("sum")).alias("start"))
    within = F.sum("bytes").over(Window.partitionBy("file", "block").orderBy("order")) - F.col("bytes")
    placed = chunks.withColumn("within", within).join(blocks, ["file", "block"])
    return placed.withColumn("at", F.col("start") + F.col("within") - len(MAGIC)).filter("at >= 0").drop("within", "start", "order")


def _head(value: Column) -> Column:
    return F.substring_index(value, END, 1)


def _fields(value: Column) -> dict[str, Column]:
    """Fields of a record from its text after the version line, END included."""
    head = _head(value)
    block = F.substring(value, F.length(head) + 5, F.length(value) - F.length(head) - 8)
    http = _head(block)
    payload = F.substring(block, F.length(http) + 5, F.length(block))
    named = lambda text, pattern: F.regexp_extract(text, pattern, 1)
    kind = named(head, r"(?:^|\r\n)WARC-Type: (\w+)")
    stored = named(head, r"\r\nWARC-Payload-Digest: sha1:(\w+)")
    return {
        "page_id": named(head, r"\r\nWARC-Record-ID: <urn:page:(-?\d+)>").try_cast("long"),
        "payload_bytes": named(http, r"\r\nContent-Length: (\d+)").try_cast("long"),
        "payload_digest": F.when(kind == "revisit", stored).otherwise(base32_sha1(payload.cast("binary"))),
        "record_type": kind,
        "refers_to": named(head, r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>").try_cast("long"),
        "digest_holds": (kind == "revisit") | (stored == base32_sha1(payload.cast("binary"))),
    }


def reachable(links: DataFrame) -> DataFrame:
    """(file, run, entry): the runs that the chain from offset 0 reaches, from ``entry`` on.

    ``links`` has file, run, at, next. A run is a stretch of candidates of a
    block of which each names the one behind it; its exit is the last one's
    ``next``. Pointer jumping works on runs: each round doubles the length of
    the jumps and adds what they reach, so a file of r runs takes about
    log2(r) rounds of joins, whatever its length.
    """
    exits = links.groupBy("file", "run").agg(F.max_by("next", "at").alias("exit"))
    entry = links.select("file", F.col("run").alias("to"), F.col("at").alias("exit"))
    jump = exits.join(entry, ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry"))
    jump = cut(jump, "warc-jump")
    reach = cut(links.filter("at = 0").select("file", "run", F.col("at").alias("entry")), "warc-reach")
    had = reach.count()
    while True:
        step = reach.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reach = cut(reach.unionByName(step).groupBy("file", "run").agg(F.min("entry").alias("entry")), "warc-reach")
        has = reach.count()
        if has == had:
            return reach
        had, far = has, jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        jump = cut(jump.join(far, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry")), "warc-jump")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``.

    Columns: page_id, payload_bytes, payload_digest (computed from the payload;
    a revisit's is the stored one), record_type, refers_to, digest_holds. A
    version line inside a payload starts no record, and such a payload is read
    whole. Archives without records give no rows.
    """
    head = _head(F.col("value"))
    length = F.regexp_extract(head, r"(?:^|\r\n)Content-Length: (\d{1,15})(?:\r\n|$)", 1).try_cast("long")
    whole = (len(MAGIC) + F.octet_length(head) + 4 + length + 4).cast("long")
    chunks = _chunks(spark, path).select("file", "block", "order", "bytes", whole.alias("whole"), *[v.alias(k) for k, v in _fields(F.col("value")).items()])
    links = _placed(cut(chunks, "warc-chunks")).withColumn("next", F.col("at") + F.col("whole"))
    order = Window.partitionBy("file", "block").orderBy("at")
    fresh = F.coalesce(F.lag("next").over(order) != F.col("at"), F.lit(True)).cast("int")
    links = links.withColumn("fresh", fresh).withColumn("run", F.struct("block", F.sum("fresh").over(order).alias("k"))).drop("fresh")
    links = cut(links, "warc-links")
    kept = links.join(reachable(links), ["file", "run"]).filter("at >= entry")
    fields = list(_fields(F.lit("")))
    torn = cut(kept.filter("bytes < whole").select("file", "at", "next"), "warc-torn")
    out = kept.filter("bytes = whole").select(*fields)
    if torn.isEmpty():
        return out
    # records whose payload holds version lines: their files are read again and their chunks put together
    parts = _placed(_chunks(spark, path, torn.select("file").distinct())).select("file", "at", "value")
    since = Window.partitionBy("file").orderBy("at")
    parts = parts.join(torn.withColumnRenamed("next", "end").withColumn("owner", F.col("at")), ["file", "at"], "left")
    parts = parts.withColumns({c: F.last(c, ignorenulls=True).over(since) for c in ("owner", "end")}).filter("at < end")
    parts = parts.select("file", F.col("owner").alias("at"), F.col("at").alias("part"), "value")
    listed = F.sort_array(F.collect_list(F.struct("part", "value")))
    text = F.array_join(F.transform(listed, lambda x: x["value"]), MAGIC)
    parts = parts.groupBy("file", "at").agg(text.alias("value"))
    return out.unionByName(parts.select(*[v.alias(k) for k, v in _fields(F.col("value")).items()]))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records, then the archives read back."""
    path = fresh_path(spark, "warc")
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path)


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT body, max(page_id) AS top FROM p GROUP BY body)
SELECT page_id, octet_length(encode(p.body))::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + (('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) % 32, 1), '' ORDER BY i)
        FROM range(32) r(i)) AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to,
       true AS digest_holds
FROM p JOIN t ON p.body = t.body
"""
