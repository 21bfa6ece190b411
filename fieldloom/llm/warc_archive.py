"""Content-addressed WARC archive.

Payload bytes are stored once by SHA-256, in a table bucketed by that digest; a digest under which payloads of
different SHA-1 or length meet is refused. Record headers are stored apart, byte for byte. Records are put together
again by a join of both. Of the records with equal payloads of at least a given size, the one with the largest id is
the response and the others revisit it; smaller payloads, which any number of records may carry, are broadcast to these
where a digest has more than a thousandth of all records.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path
from .common import heavy_keys, join_heavy, written

#: Payload bytes of a bucket that the bucket count aims at.
BUCKET_BYTES = 64 << 20
#: Bytes of a payload that is broadcast; there are common.HEAVY of them at most.
BROADCAST_BYTES = 10_000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Archive:
    """headers: uid, digest, header (exact), http (exact), carries. payloads: digest, payload. heavy: digests of small
    payloads that many records carry."""

    spark: SparkSession
    headers_path: str
    payload_table: str
    heavy: list[bytes]

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.parquet(self.headers_path)

    @property
    def payloads(self) -> DataFrame:
        return self.spark.table(self.payload_table)

    def drop(self) -> None:
        """Takes the payload table out of the catalogue; its files go with the scratch folder."""
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.payload_table}")
        except Exception:  # the session has ended, and its catalogue with it
            return


def _line(name: str, *value: str | Column) -> Column:
    parts = [v if isinstance(v, Column) else F.lit(v) for v in value]
    return F.concat(F.lit(f"{name}: "), *parts, F.lit(CRLF))


def _record_id(uid: Column) -> Column:
    """The urn of a record's name of 32 hexadecimal digits."""
    cut = [F.substring(uid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archive(pages: DataFrame, revisit_from: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Writes one record per row. Null payloads are empty, null urls give an empty target; null ids lose against others.

    A record is named after its id, url, payload and number among rows that agree in these, so that names don't change
    with the partitions. Of repeated rows one is the response. No rows: an archive without records.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    source = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    named = source.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    facts = named.withColumn("fact", F.struct(F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1")))
    rows = facts.groupBy("page_id", "url", "digest").agg(F.min("fact").alias("fact"), F.max("fact").alias("other"), F.count("*").alias("times"))
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.hex("digest"), F.col("time").cast("string"), "url"))
    seen = rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("page_id", "url", "digest", "fact", "other", name.alias("uid"))
    seen = written(seen, "warc-seen")

    same = seen.groupBy("digest").agg(
        F.max(F.struct(F.isnotnull("page_id").alias("has"), "page_id", "uid"))["uid"].alias("top"), F.min("fact").alias("fact"), (F.min("fact") != F.max("other")).alias("clash"), F.count("*").alias("n_records")
    )
    same = written(same.select("digest", "top", "fact.*", "clash", "n_records"), "warc-digests")
    total, clash = same.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_or("clash"), F.lit(False))).first()
    if clash:
        raise ValueError("payloads of different SHA-1 or length share a SHA-256 digest")
    heavy = heavy_keys(same, ["digest"], "n_records")

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    table = f"warc_payloads_{uuid.uuid4().hex}"
    once = named.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    once.repartition(buckets, "digest").write.format("parquet").option("path", fresh_path(spark, "warc-payloads")).option("compression", "zstd").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)

    kind = F.when((F.col("n") >= revisit_from) & (F.col("uid") != F.col("top")), "revisit").otherwise("response")
    http = F.when(F.col("record_type") == "response", F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))).otherwise(f"HTTP/1.1 200 OK{CRLF * 2}")
    block_bytes = F.octet_length("http") + F.when(F.col("record_type") == "response", F.col("n")).otherwise(0)
    refers = F.when(
        F.col("record_type") == "revisit", F.concat(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), _line("WARC-Refers-To", _record_id(F.col("top"))))
    ).otherwise("")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("uid"))), _line("WARC-Date", DATE), _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        F.when(F.col("page_id").isNotNull(), _line("X-Page", F.col("page_id").cast("string"))).otherwise(""),
        _line("WARC-Payload-Digest", "sha1:", F.col("sha1")), _line("X-Payload-Length", F.col("n").cast("string")), refers,
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", block_bytes.cast("string")), F.lit(CRLF),
    )
    headers = (
        join_heavy(seen.select("page_id", "url", "digest", "uid"), same.select("digest", "top", "n", "sha1"), ["digest"], heavy, "inner").withColumn("record_type", kind).withColumn("http", http)
        .select("uid", "digest", F.encode(header, "UTF-8").alias("header"), F.encode("http", "UTF-8").alias("http"), (F.col("record_type") == "response").alias("carries"))
    )
    path = fresh_path(spark, "warc-headers")
    headers.write.parquet(path)
    small = [bytes(r[0]) for r in same.join(F.broadcast(heavy), "digest", "left_semi").where(F.col("n") < min(revisit_from, BROADCAST_BYTES)).select("digest").collect()]
    archive = Archive(spark, path, table, small)
    atexit.register(archive.drop)
    return archive


def records(archive: Archive) -> DataFrame:
    """uid, digest, record: the exact bytes of every record, blank lines after it included."""
    last = F.lit(f"{CRLF}{CRLF}".encode())
    carrying = archive.headers.where("carries")
    full = carrying.join(archive.payloads, "digest")
    if archive.heavy:
        heavy = F.col("digest").isin([F.lit(d) for d in archive.heavy])
        few = F.broadcast(archive.payloads.where(heavy))  # small ones, at most HEAVY
        full = carrying.where(~heavy).join(archive.payloads.where(~heavy), "digest").unionByName(carrying.where(heavy).join(few, "digest"))
    full = full.select("uid", "digest", F.concat("header", "http", "payload", last).alias("record"))
    return full.unionByName(archive.headers.where("not carries").select("uid", "digest", F.concat("header", "http", last).alias("record")))


def read_archive(archive: Archive, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the reconstructed records.

    A response's payload is cut from its record by the header's lengths and hashed anew; a row whose length or digest
    isn't as its header says ends the query with an error. A revisit is answered by its response's payload, which is
    checked where the response is read; one whose WARC-Refers-To names no response of the same digest ends the query.
    """
    def head_bytes(block: str) -> Column:
        """Bytes up to and with the first empty line; payloads come from strings, so that records are UTF-8."""
        text = F.col(block).cast("string")
        return F.octet_length(F.substring(text, F.lit(1), F.position(F.lit(CRLF * 2), text) + 3))

    n = F.octet_length("record")
    parsed = (
        records(archive).withColumn("head_bytes", head_bytes("record"))
        .withColumn("head", F.col("record").substr(F.lit(1), F.col("head_bytes")).cast("string"))
        .withColumn("block", F.col("record").substr(F.col("head_bytes") + 1, n - F.col("head_bytes") - 4))
    )

    def field(name: str) -> Column:
        return F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)

    typed = parsed.select(
        F.when(field("X-Page") != "", field("X-Page")).cast(id_type).alias("page_id"), field("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("of"), field("Content-Length").cast("long").alias("said"), "block",
        head_bytes("block").alias("http_bytes"),
    ).withColumn("payload", F.col("block").substr(F.col("http_bytes") + 1, F.octet_length("block") - F.col("http_bytes")))
    whole = (F.octet_length("block") == F.col("said")) & (
        (F.col("record_type") == "revisit") | ((F.octet_length("payload") == F.col("payload_bytes")) & (F.sha1("payload") == F.col("payload_digest")))
    )
    checked = F.when(whole, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record differs from what its header says")))
    read = written(typed.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "record_id", "of"), "warc-read")
    response = F.col("record_type") == "response"
    revisits = read.where(~response).drop("record_id")
    named = read.where(response).select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("held"))
    wanted = revisits.groupBy("of").agg(F.count("*").alias("n"))
    found = join_heavy(revisits, named, ["of"], heavy_keys(wanted, ["of"]))
    same = F.when(F.col("held").eqNullSafe(F.col("payload_digest")), F.col("refers_to")).otherwise(F.raise_error(F.lit("a revisit names no response of its digest")).cast(id_type))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return read.where(response).select(*columns, F.lit(None).cast(id_type).alias("refers_to")).unionByName(found.select(*columns, same.alias("refers_to")))
