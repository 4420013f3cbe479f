"""WARC archives with revisit records in place of repeated payloads.

Headers (key, payload digest, size) are shuffled by digest: of equal payloads the smallest page_id is
the response and the others revisit it. Records are then written with fresh headers, gzip members one
by one, and can be read back. Payloads that surely occur once, by a bounded key filter, are written
where they are read; only repeated ones are shuffled.

Payloads are equal when SHA-1 and MD5 agree, so a forged pair of one SHA-1 stays apart.

Defined results: a null page is an empty payload; a null page_id ranks after all others, and rows of
one payload without any id are all responses; of rows that share page_id and payload the one of the
smallest url is the response, each with its own url; payloads below ``min_bytes`` are all responses; a
null url is written as an empty target; an empty table writes no archive and gives an empty result;
columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.exact_dedup import with_group
from ledgermill.llm.key_filter import build_filter, may_match
from ledgermill.llm.shard_files import committed, split_uri
from ledgermill.llm.shared import shared_dir, ship, stage

MIN_BYTES = 0
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
_SPACE_OF_IDS = uuid.UUID("3f0c6b0e-6f0e-5c1a-9c3e-0b1d6a3e52aa")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _headers(pages: DataFrame) -> DataFrame:
    """page_id, url, h (digests of the payload), size and record, a digest of the three that name a row."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("html"), _digest(payload).alias("h"))
    return named.withColumn("record", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.hex("h"), "url"))))


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """(record, repeats, first_id, first_url, is_first) of payloads with several rows, and the groups' digests h."""
    headers = _headers(pages).where(F.octet_length("html") >= min_bytes)
    rows = stage(headers.groupBy("record").agg(F.first("page_id").alias("doc_id"), F.first("url").alias("url"), F.first("h").alias("h"), F.count(F.lit(1)).alias("repeats")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "url", "record"))
    groups = stage(rows.groupBy("h").agg(least.alias("least"), F.sum("repeats").alias("group_rows")).where("group_rows > 1"))
    total = rows.agg(F.coalesce(F.sum("repeats"), F.lit(0))).first()[0]
    found = with_group(rows, groups, "h", total).where("group_rows IS NOT NULL")
    is_first = F.col("least.doc_id").isNull() | (F.col("least.record") == F.col("record"))
    resolved = found.select("record", "repeats", F.col("least.doc_id").alias("first_id"), F.col("least.url").alias("first_url"), is_first.alias("is_first"))
    return resolved, groups.select("h")


def _digest(payload) -> F.Column:
    return F.concat(F.unhex(F.sha1(payload)), F.unhex(F.md5(payload)))


def record_id(page_id: int | None, digest: str, url: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_OF_IDS, f'{page_id}/{digest}/{number}/{url}')}>"


def _record(page_id, url: str, payload: bytes, number: int, refers_to: int | None, first_url: str | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    is_revisit = refers_to is not None
    body = http if is_revisit else http + payload
    clean = lambda text: " ".join(text.split())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, url, number)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, first_url, 1)}", f"WARC-Refers-To-Target-URI: {clean(first_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes archives below folder; archive and n_records of each."""
    ship(pages.sparkSession)
    rows = _headers(pages)
    resolved, repeated = resolve_revisits(pages, min_bytes)
    marked = may_match(rows, "h", build_filter(repeated, "h"), "may_repeat")
    alone = marked.where("NOT may_repeat").select("page_id", "url", "html", F.lit(1).cast("long").alias("number"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("first_url"))
    # rows that repeat in full are combined before the shuffle; the row that stands for them is then written as often as they are
    once = marked.where("may_repeat").groupBy("record").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "html")), F.count(F.lit(1)).alias("alike"))
    met = once.join(resolved, "record", "left").withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("repeats", "alike"))))
    responds = F.col("first_id").isNull() | (F.col("is_first") & (F.col("number") == 1))
    shared = met.select("page_id", "url", "html", "number", F.when(~responds, F.col("first_id")).alias("refers_to"), "first_url")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():06d}.warc.gz", 0
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        with committed(f"{folder}/{name}", task.taskAttemptId()) as out:
            while batch is not None:
                for page_id, url, html, number, refers_to, first_url in zip(*(batch.column(c) for c in range(6))):
                    record = _record(page_id.as_py(), url.as_py(), html.as_py().encode(), number.as_py(), refers_to.as_py(), first_url.as_py())
                    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.write(member.compress(record) + member.flush())
                    n += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "n_records"])

    return alone.unionByName(shared).mapInArrow(each, "archive string, n_records bigint")


def _members(source) -> Iterator[bytes]:
    """The decompressed gzip members of a stream."""
    rest = b""
    while True:
        if not rest:
            rest = source.read(1 << 20)
            if not rest:
                return
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            parts.append(member.decompress(rest))
            rest = member.unused_data
            if not member.eof:
                rest = source.read(1 << 20)
                if not rest:
                    raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers by lower-case name, the HTTP header block and the payload."""
    head, _, body = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    http, _, payload = body[: int(headers["content-length"])].partition(b"\r\n\r\n")
    return headers, http, payload


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record.

    Payloads of responses are digested anew and must agree with their header.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = split_uri(f"{folder}/{name}")
                rows = []
                with files.open_input_stream(path, compression=None) as source:
                    for record in _members(source):
                        headers, http, payload = parse_record(record)
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                        if headers["warc-type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size):
                            raise ValueError(f"{headers['warc-record-id']} does not hold the payload of its header")
                        page_id, refers_to = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((page_id and int(page_id), size, digest, headers["warc-type"], refers_to and int(refers_to), headers["warc-target-uri"]))
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    ship(archives.sparkSession)
    # a given number of partitions is not merged: an archive is read by one task, however short the list of names
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(each, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def deduplicate_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives of pages and reads them back (columns of read_archives)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc"
    archives = stage(write_archives(pages, folder, min_bytes))
    return read_archives(archives, folder)
