"""WARC archives of pages, with equal payloads stored once.

Headers (page, digest, size) are shuffled by payload digest: of the pages with equal payloads the one of
the largest page_id is the original, the others are revisits of it. Payloads don't take part; they
are written, without those of revisits, by Spark's own text writer, whose line separator is the end of a
WARC record. A table of archives is thus committed like any other, in any store that Spark writes to, and
a lost executor leaves no half file. Archives are read as a stream of bytes, one record in memory.

A record's block is the HTTP response: of a revisit its head alone, which still holds the payload's length.

A null html is an empty payload, a null url gives no target, and line ends and other control characters of
a url are written as %XX. Rows of equal page_id and payload are one page: all are originals or all
revisits. A null page_id is less than any other; pages without one are revisits of a page that has one, else
originals. An empty table gives no archives. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import jobs

LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
RECORD = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload string"


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes): html is never null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumns({"payload_digest": F.sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long")})


def originals(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(payload_digest, original): the largest page_id of each payload of at least ``least`` bytes that several
    pages have. Maxima are taken before the shuffle."""
    rows = headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    return rows.where("n > 1 and original is not null").drop("n")


def resolved(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The headers with record_type, and refers_to of revisits."""
    rows = jobs.hot_join(headers, jobs.stored(originals(headers, least)), "payload_digest")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("original"))}).drop("original")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _page(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _uri(url: Column) -> Column:
    """A url in which nothing can end a header line."""
    return F.when(~url.rlike(r"[\x00-\x20\x7f]"), url).otherwise(F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), ""))


def record(rows: DataFrame, payload: Column, date: str = DATE) -> Column:
    """A whole record without its end: the WARC head, the HTTP head, and the payload of a response."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", rows["payload_bytes"].cast("string")), F.lit("\r\n"))
    block = F.concat(http, payload)
    refers = F.when(rows["record_type"] == "revisit", F.concat(_line("WARC-Refers-To", _page(rows["refers_to"])), _line("WARC-Profile", F.lit(PROFILE)))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", rows["record_type"]), _line("WARC-Record-ID", _page(rows["page_id"])), _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", _uri(rows["url"])), F.lit("")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), rows["payload_digest"])), refers,
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes the pages' archives, deduplicated, as gzipped WARC files under the path.

    Revisit records are made of headers. Responses are the pages that are no revisits, by an anti-join of the payloads
    on page and digest: with few revisits Spark sends these to the payloads, with many it shuffles payloads once."""
    found = payloads(pages)
    headers = jobs.stored(found.drop("html"))
    known = jobs.stored(resolved(headers, least).where("record_type = 'revisit'"))
    keys = known.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d")).distinct()
    responses = found.join(keys, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left_anti").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    full, bare = responses.select(record(responses, responses["html"], date).alias("value")), known.select(record(known, F.lit(""), date).alias("value"))
    full.unionByName(bare).write.option("lineSep", END).option("compression", "gzip").text(path)
    jobs.drop(headers, known)


class Reader:
    """Records out of a stream of bytes that arrives in pieces."""

    def __init__(self) -> None:
        self.pieces, self.size, self.need = [], 0, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """Takes a piece and gives the records that are now whole, each as its header and its block."""
        self.pieces.append(piece)
        self.size += len(piece)
        while self.size and self.size >= self.need:
            data = b"".join(self.pieces)
            head, found, _ = data.partition(END.encode())
            if not found:
                self.pieces, self.need = [data], len(data) + 1
                return
            fields = self.header(head)
            end = len(head) + 4 + int(fields["content-length"])
            if len(data) < end + 4:
                self.pieces, self.need = [data], end + 4
                return
            if data[end : end + 4] != END.encode():
                raise ValueError("a WARC record has no end")
            self.pieces, self.size, self.need = [data[end + 4 :]], len(data) - end - 4, 0
            yield fields, data[len(head) + 4 : end]

    @staticmethod
    def header(head: bytes) -> dict[str, str]:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _number(uri: str | None) -> int | None:
    page = (uri or "").strip("<>").removeprefix(URN)
    return None if page in ("", "none") else int(page)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """What a record says; a response's digest and length are taken from its bytes and must be those that it states."""
    http, _, payload = block.partition(END.encode())
    stated = int(http.decode().lower().rpartition("content-length:")[2].strip())
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload is not what its record states")
    return _number(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri"), stated, digest, _number(fields.get("warc-refers-to")), payload.decode() if fields["warc-type"] == "response" else None


def _parsed(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64() if " long" in c else pa.string() for c in RECORD.split(", ")]
    reader, file = Reader(), None
    for batch in batches:
        rows, held = [], 0
        for path, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            if path != file:
                if reader.size:
                    raise ValueError(f"{file} ends within a record")
                file = path
            for fields, block in reader.feed(value.as_py() + END.encode()):
                row = _row(fields, block)
                rows.append(row if with_payload else (*row[:-1], None))
                held += len(row[-1] or "") if with_payload else 0
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    if reader.size:
        raise ValueError(f"{file} ends within a record")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives under the path; a revisit has no payload of its own. Gzipped files are each read by
    one task, in order; a file that ends within a record, or a payload with another digest, is an error."""
    lines = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.mapInArrow(lambda batches: _parsed(batches, with_payload), RECORD)


def with_payloads(records: DataFrame) -> DataFrame:
    """Revisits with the payloads of the responses that they refer to."""
    responses = records.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload").alias("own")).dropDuplicates(["refers_to", "d"])
    revisits = records.where("record_type = 'revisit'").drop("payload")
    found = revisits.join(responses, (revisits["refers_to"] == responses["refers_to"]) & (F.col("payload_digest") == F.col("d"))).select(*(revisits[c] for c in revisits.columns), F.col("own").alias("payload"))
    return records.where("record_type <> 'revisit'").unionByName(found)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages' archives in the shared folder and reads them back."""
    jobs.prepare(spark)
    path = jobs.new_path(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_archives(spark, path, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """with h as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
    m as (select *, max(page_id) over (partition by payload_digest) as last_id from h)
    select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < last_id then 'revisit' else 'response' end as record_type,
      case when payload_bytes >= 1000 and page_id < last_id then last_id end as refers_to from m"""
