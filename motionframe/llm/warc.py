"""A content-addressed WARC archive: payloads once by digest, exact record headers apart, records rebuilt by joins.

The archive is two tables. The store holds every distinct payload once under its SHA-256; the header table holds, for each
record, the exact bytes that stand before the payload (WARC header and HTTP header). A record is a header, its payload (a
revisit has none) and two line ends: ``rebuild_records`` gives these WARC/1.1 bytes back, and ``read_back`` parses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import lookup
from .storage import Scratch, table

#: Equal payloads of at least so many bytes become one response and revisits of it.
REVISIT_FROM = 1000
#: Capture time of every record; the page table has none.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The headers of a payload with more copies than this are spread over one place per so many.
HOT = 1000


def _payload(html: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")


def _sha256(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def facts_of(pages: DataFrame) -> DataFrame:
    """``page_id, record_id, url, payload_sha256, sha1, n, block_sha1``: what headers need to know of each page, without its payload.

    A record id names the page and the row's place in the table, so that repeated pages have records of their own.
    """
    payload = _payload()
    place = (F.col("page_id"), F.sha1(payload), F.monotonically_increasing_id())
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", " ")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("none")), F.lit(":"), F.hex(F.xxhash64(*place)), F.hex(F.hash(*place))).alias("record_id"), url.alias("url"),
        _sha256(payload).alias("payload_sha256"), F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).alias("n"), F.xxhash64(payload).alias("xx"), payload.alias("payload"),
    )
    return rows.withColumn("block_sha1", F.unhex(F.sha1(F.concat(F.encode(http_header(F.col("n")), "UTF-8"), F.col("payload"))))).drop("payload")


def http_header(n: Column) -> Column:
    lines = (F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), n.cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def shared_payloads(facts: DataFrame) -> DataFrame:
    """``payload_sha256, copies, first_page, first_record``: payloads that several pages have, and the record of the largest page_id.

    The digest is verified where it is used as identity: payloads that share a SHA-256 must agree in length, SHA-1 and XXH64
    or the job fails. Copies meet in a partial aggregate before the shuffle.
    """
    check = F.struct("n", "sha1", "xx")
    grouped = facts.groupBy("payload_sha256").agg(
        F.count("*").alias("copies"), F.max(F.struct("page_id", "record_id")).alias("first"), F.min(check).alias("lo"), F.max(check).alias("hi")
    )
    sound = F.when(F.col("lo") == F.col("hi"), F.col("payload_sha256")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest")).cast("binary"))
    return grouped.where(F.col("copies") > 1).select(sound.alias("payload_sha256"), "copies", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record"))


def headers_of(facts: DataFrame, shared: DataFrame, revisit_from: int = REVISIT_FROM, date: str = DATE) -> DataFrame:
    """``page_id, record_id, payload_sha256, copies, header``: the exact bytes (as text) before each record's payload.

    The rows of common payloads stay where they are (``spread.lookup``).
    """
    rows = lookup(facts, shared, "payload_sha256", "copies", facts.count())
    revisit = (F.col("n") >= revisit_from) & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    http = http_header(F.col("n"))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.lower(F.hex("sha1"))),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), F.when(revisit, F.sha1(F.encode(http, "UTF-8"))).otherwise(F.lower(F.hex("block_sha1")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), F.col("first_record"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http)
    return rows.select("page_id", "record_id", "payload_sha256", F.coalesce("copies", F.lit(1)).alias("copies"), header.alias("header"))


def payloads_of(pages: DataFrame) -> DataFrame:
    """``payload_sha256, payload, copies``: every distinct payload once; a common one is met in a partial aggregate and arrives once per task."""
    rows = pages.select(_sha256(_payload()).alias("payload_sha256"), _payload().alias("payload"))
    return rows.groupBy("payload_sha256").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))


class Archive:
    """An archive on disk: ``payloads`` (bucketed by digest, so that no later join moves them) and ``headers``."""

    def __init__(self, pages: DataFrame, scratch: Scratch, revisit_from: int = REVISIT_FROM, date: str = DATE):
        spark, self.scratch = pages.sparkSession, scratch
        facts = scratch.save("facts", facts_of(pages))
        self.headers = scratch.save("headers", headers_of(facts, shared_payloads(facts), revisit_from, date))
        scratch.drop("facts")
        self.name = "payloads_" + scratch.root.rsplit("-", 1)[1]
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # so a task of the grouping writes one bucket, and payloads move once
        payloads_of(pages).write.option("path", f"{scratch.root}/{self.name}").option("compression", "zstd").bucketBy(buckets, "payload_sha256").saveAsTable(self.name)
        self.payloads = spark.table(self.name)

    def drop(self) -> None:
        self.payloads.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop("headers", self.name)


def rebuild_records(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """``page_id, payload, record``: the records' bytes, and the payload that each stands for (a revisit's too, which its record lacks).

    Payloads stay where their bucket is; headers come to them. Those of payloads with over ``HOT`` copies, of which there are few,
    are dealt to one place per ``HOT`` copies with the payload sent to each. An empty archive gives no rows; a header whose payload
    is not stored gives none either (``read_back`` counts nothing twice, as digests are unique in the store).
    """
    response = F.instr("header", "WARC-Type: response" + CRLF) > 0
    record = F.concat(F.encode("header", "UTF-8"), F.when(response, F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n"))
    places = F.ceil(F.col("copies") / F.lit(HOT)).cast("int")
    cold = headers.where(F.col("copies") <= HOT).drop("copies").join(payloads.where(F.col("copies") <= HOT).drop("copies"), "payload_sha256")
    spread = headers.where(F.col("copies") > HOT).withColumn("salt", F.pmod(F.xxhash64("record_id"), places).cast("int")).drop("copies")
    sent = payloads.where(F.col("copies") > HOT).withColumn("salt", F.explode(F.sequence(F.lit(0), places - 1))).drop("copies")
    hot = spread.join(sent, ["payload_sha256", "salt"])
    keep = ("page_id", "header", "payload_sha256", "payload")
    return cold.select(*keep).union(hot.select(*keep)).select("page_id", "payload_sha256", "payload", record.alias("record"))


def _field(head: Column, name: str) -> Column:
    """A field's value in a header block; null where it has none."""
    start = F.instr(F.concat(F.lit(CRLF), head), f"{CRLF}{name}: ")
    return F.when(start > 0, F.substring_index(head.substr(start + len(name) + 2, F.length(head)), CRLF, 1))


def parse_records(records: DataFrame) -> DataFrame:
    """``records`` with ``record_type, said_digest, said_block, block_digest, refers_to, length, found``: fields, and the payload bytes in the block.

    Everything comes from the bytes of ``record``: the header ends at the first empty line, the block has Content-Length bytes, and a response's
    payload follows the HTTP header's empty line in it.
    """
    text = F.col("record").cast("string")
    end = CRLF + CRLF
    rows = records.withColumn("head", F.substring_index(text, end, 1)).withColumn("start", F.octet_length("head") + 4)
    fields = {"record_type": "WARC-Type", "said": "WARC-Payload-Digest", "block_said": "WARC-Block-Digest", "refers": "WARC-Refers-To", "size": "Content-Length"}
    rows = rows.select("*", *[_field(F.col("head"), name).alias(c) for c, name in fields.items()])
    rows = rows.withColumn("block", F.substring(F.col("record"), F.col("start") + 1, F.col("size").cast("int")))
    rows = rows.withColumn("http", F.substring_index(F.col("block").cast("string"), end, 1))
    found = F.substring(F.col("block"), F.octet_length("http") + 5, F.octet_length("block"))
    page = F.substring_index(F.substring_index(F.col("refers"), ":", 3), ":", -1)
    return rows.select(
        *records.columns, "record_type", F.substring_index("said", ":", -1).alias("said_digest"), F.substring_index("block_said", ":", -1).alias("said_block"), F.sha1("block").alias("block_digest"),
        F.when(F.col("record_type") == "revisit", page.try_cast("long")).alias("refers_to"),
        _field(F.col("http"), "Content-Length").cast("long").alias("length"), found.alias("found"),
    )


def read_back(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """What the rebuilt records say of each page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Digests and sizes are computed anew from bytes: a response's from its record's block, a revisit's from the payload it stands for.
    A stored payload that lost its digest, or a record whose digests or length do not hold, fails the job.
    """
    parsed = parse_records(rebuild_records(payloads, headers))
    payload = F.when(F.col("record_type") == "response", F.col("found")).otherwise(F.col("payload"))
    seen = parsed.select("page_id", "record_type", "refers_to", "payload_sha256", "said_digest", "length", (F.col("said_block") == F.col("block_digest")).alias("block_holds"), payload.alias("bytes"))
    seen = seen.select("*", F.octet_length("bytes").cast("long").alias("payload_bytes"), F.sha1("bytes").alias("payload_digest"), _sha256(F.col("bytes")).alias("again"))
    holds = F.col("block_holds") & (F.col("said_digest") == F.col("payload_digest")) & (F.col("length") == F.col("payload_bytes")) & (F.col("again") == F.col("payload_sha256"))
    digest = F.when(holds, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record and its stored payload disagree")).cast("string"))
    return seen.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write ``pages`` as an archive, rebuild and parse its records: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, a row per input row.

    Null html is the empty payload; payloads shorter than ``revisit_from`` bytes are always responses, yet
    stored once. Of equal payloads the largest page_id is the response; rows that repeat that page_id are responses
    too; a null page_id is a revisit of it, or a response where every page_id of the payload is null. Null
    urls are written empty; line ends in a url become blanks in the header. Html of any length is one payload. Extra columns are
    ignored; an empty table gives an empty archive and no rows. The archive's tables are dropped once the rows are written.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    archive = Archive(pages, scratch, revisit_from)
    try:
        return scratch.save("rows", read_back(archive.payloads, archive.headers))
    finally:
        archive.drop()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


ORACLE_SQL = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
    r AS (SELECT *, payload_bytes >= {REVISIT_FROM} AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS revisit FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first_id END AS refers_to FROM r
"""
