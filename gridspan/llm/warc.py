"""WARC archive with content-addressed payloads.

Payload bytes are stored once under their SHA-256, record headers stand in a
table of their own, and original records come back through a join of the two.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


class Archive(NamedTuple):
    payloads: DataFrame  #: digest, payload
    headers: DataFrame  #: page_id, digest, header (the exact header block in bytes)


def record_id(page_id: Column) -> Column:
    """A URN of the id, in which what a URN may not hold is percent-encoded."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("none:")), F.lit(">"))


def header_block(page_id: Column, uri: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    """The header of one record as WARC/1.1 text in bytes.

    A URI with line breaks can't stand in a header line: it is percent-encoded
    there, per cent signs too, and a field of its own says so.
    """
    uri = F.coalesce(uri, F.lit(""))
    broken = uri.rlike("[\r\n]")
    escaped = F.replace(F.replace(F.replace(uri, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = refers_to.isNotNull()
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page_id)),
        F.when(broken, F.lit("X-Target-URI-Encoding: percent")),
        F.concat(F.lit("WARC-Target-URI: "), F.when(broken, escaped).otherwise(uri)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("WARC-Payload-Length: "), size.cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(refers_to))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=UTF-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(size.cast("string"))),
    )
    return F.encode(F.concat(lines, F.lit("\r\n\r\n")), "UTF-8")


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Archive one record per row in the shared folder.

    Ids may be of any type that orders. A null html is an empty payload;
    payloads may be of any length. Of equal payloads of at least 100 bytes
    the smallest page_id is the response; repeated rows of that page_id are
    responses too. A row without page_id never becomes the response that
    others refer to. Extra columns are ignored, whatever their names. An empty
    table gives an empty archive.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    payloads = stored(rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n_records")), "warc-payloads")
    shared = payloads.where((F.octet_length("payload") >= LEAST_REVISIT) & (F.col("n_records") > 1)).select("digest", "first_page")
    linked = rows.drop("payload").join(shared, "digest", "left")
    refers_to = F.when((F.col("first_page") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first_page"))
    headers = linked.select("page_id", "digest", header_block(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), refers_to).alias("header"))
    return Archive(payloads.select("digest", "payload"), stored(headers, "warc-headers"))


def header_fields(header: Column, id_type: T.DataType | str) -> dict[str, Column]:
    """page_id, digest, payload_length, record_type, target_uri and refers_to as a header block in bytes states them."""
    text = F.decode(header, "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*+)\r\n", 1), F.lit(""))
    page = lambda name: F.url_decode(F.nullif(F.regexp_extract(text, rf"\r\n{name}: <urn:page:(?!none:>)([^>\r\n]*+)>\r\n", 1), F.lit("")))
    # an empty id has an empty URN
    told = lambda name: F.when(text.contains(f"\r\n{name}: <urn:page:>\r\n"), F.lit("")).otherwise(page(name)).try_cast(id_type)
    uri = F.coalesce(field("WARC-Target-URI"), F.lit(""))
    plain = F.replace(F.replace(F.replace(uri, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    return {
        "page_id": told("WARC-Record-ID"),
        "digest": F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]*)", 1),
        "payload_length": field("WARC-Payload-Length").cast("long"),
        "record_type": field("WARC-Type"),
        "target_uri": F.when(text.contains("\r\nX-Target-URI-Encoding: percent\r\nWARC-Target-URI: "), plain).otherwise(uri),
        "refers_to": told("WARC-Refers-To"),
    }


def records(archive: Archive) -> DataFrame:
    """Every original record: header fields, and the payload found by its digest.

    ``verified`` says that the payload read back has the digest and the length
    that the record's header states.
    """
    told = archive.headers.select(*[c.alias(n) for n, c in header_fields(F.col("header"), archive.headers.schema["page_id"].dataType).items()], "header")
    kept = archive.payloads.select("digest", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    return told.join(kept, "digest", "left").withColumn("verified", F.coalesce((F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("payload_length")), F.lit(False)))


def record_bytes(rows: DataFrame) -> DataFrame:
    """``records()`` rows with ``record``: the header block, the body it announces and the closing blank lines."""
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return rows.withColumn("record", F.concat(F.col("header"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")))


def parsed(written: DataFrame, record: str = "record", id_type: str = "bigint") -> DataFrame:
    """Header block, its fields and the body of records in bytes, as ``record_bytes`` gives them.

    ``whole`` says that the body is as long as announced and followed by the
    closing blank lines. The columns of ``written`` are left out.
    """
    # one character a byte, so that places in the text are places in the record
    ends = F.locate("\r\n\r\n", F.decode(record, "ISO-8859-1")) + 3
    split = written.select(F.col(record).alias("_record"), ends.alias("_ends")).select("_record", "_ends", F.expr("substring(_record, 1, _ends)").alias("header"))
    length = F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nContent-Length: ([0-9]+)\r\n", 1).cast("int")
    split = split.withColumns({**header_fields(F.col("header"), id_type), "_length": length})
    whole = F.expr("hex(substring(_record, _ends + _length + 1)) = '0D0A0D0A' AND octet_length(_record) = _ends + _length + 4")
    return split.withColumns({"body": F.expr("substring(_record, _ends + 1, _length)"), "whole": F.coalesce(whole, F.lit(False))}).drop("_record", "_ends", "_length")
