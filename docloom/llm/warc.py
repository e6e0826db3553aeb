"""WARC archives with an index first, and coalesced byte-range reads.

Writing gives gzip-member-per-record WARC 1.1 files and an index row per record: file, offset, length,
URL and payload digest. Reading takes any selection of index rows, sorts them by file and offset,
merges ranges that lie close together and reads each merged range once.

Of records with equal payloads of at least `min_revisit` bytes, that with the largest id is the
response and the others are revisits that carry headers alone. Which one that is comes from an
aggregate over digests, of which only those that repeat go on; the join back, of ids and digests,
spreads a hot payload over tasks. Pages then join their record types by id, without being moved if there
are few revisits.

Defined results: null html is an empty payload; a null URL is written as about:blank; control
characters and spaces in URLs are percent-encoded; null ids are less than all others; repeated rows
of the winning id are all responses; a payload of any length is one record, written and read whole in
one row's memory. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import spread_join
from .common import scratch, small_batches, table, written
from .files import opened

#: Payloads shorter than this are never revisits.
MIN_REVISIT = 1000
#: A new archive file begins after so many bytes.
FILE_BYTES = 64 << 20
#: Ranges closer than this are read at once; no merged read is longer than READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: So many revisits at most are broadcast, some 10 MB; more are joined by a shuffle of the pages.
FEW_REVISITS = 1 << 17
#: Bytes of archives that a reading task is dealt: the least and, if that makes very many tasks, the most.
TASK_BYTES, MOST_TASK_BYTES, MANY_TASKS = 4 << 20, 256 << 20, 4096

INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary"


def record_id(page_id: int | None) -> str:
    """The record's URN: made from the id, so that a retried task writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def decode(member: bytes) -> dict:
    """What a record holds, from its bytes alone; a full payload is checked against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "html": payload if fields["WARC-Type"] == "response" else None,
    }


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, digest, refers_to of the pages that are revisits: only ids and digests move."""
    rows = pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("_digest"))
    first = rows.groupBy("_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = spread_join(rows.withColumnRenamed("_digest", "_d"), first, "_d", "_digest", ["page_id"])
    found = found.where("refers_to IS NOT NULL AND NOT (page_id <=> refers_to)")
    return found.select("page_id", F.col("_d").alias("digest"), "refers_to").distinct()


def write(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as archives under `path` and return their index, itself written there first.

    A file's name holds the task attempt's own token, and only the index says which files count: what a
    lost or repeated attempt has written is never read.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    known = written(revisits(pages, min_bytes).withColumnRenamed("page_id", "_page"), "revisits")
    few = known.count() <= FEW_REVISITS
    own = F.when(F.octet_length("html") >= min_bytes, F.sha1(F.encode("html", "UTF-8")))
    rows = pages.join(F.broadcast(known) if few else known, F.col("page_id").eqNullSafe(F.col("_page")) & (own == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, name, at = None, "", 0
        for batch in batches:
            out = []
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if sink is None or at >= file_bytes:
                    if sink is not None:
                        sink.close()
                    name, at = f"{path}/archive/{uuid.uuid4().hex}.warc.gz", 0
                    store, where = opened(name)
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(where, compression=None)
                payload = html.encode()
                digest = hashlib.sha1(payload).hexdigest()
                member = encode(page_id, url, payload, digest, refers_to)
                sink.write(member)
                out.append((page_id, url, len(payload), digest, "response" if refers_to is None else "revisit", refers_to, name, at, len(member)))
                at += len(member)
            yield _batch(out, _INDEX)
        if sink is not None:
            sink.close()

    rows.mapInArrow(archive, INDEX).write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([*list(_INDEX)[:6], ("html", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Merge (offset, length) ranges sorted by offset into (offset, length, indexes of the ranges inside)."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, n) in enumerate(ranges):
        if out and at - (out[-1][0] + out[-1][1]) <= gap and max(at + n, out[-1][0] + out[-1][1]) - out[-1][0] <= most:
            begun, span, members = out[-1]
            out[-1] = (begun, max(span, at + n - begun), [*members, i])
        else:
            out.append((at, n, [i]))
    return out


def tasks_for(size: int) -> int:
    """How many tasks read so many bytes of archives."""
    return max(1, min(-(-size // TASK_BYTES), max(MANY_TASKS, -(-size // MOST_TASK_BYTES))))


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that the index rows select, decoded from the archives.

    The number of tasks follows the bytes of the archives that they read, not those of the index, which
    adaptive execution would go by; each range of a file goes to one of them.
    """
    tasks = tasks_for(index.agg(F.sum("length")).first()[0] or 0)
    wanted = index.select("file", "offset", "length", F.floor(F.col("offset") / TASK_BYTES).alias("_part"))
    wanted = wanted.repartition(tasks, "file", "_part").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    schema = _RECORD if payload else pa.schema(list(_RECORD)[:-1])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            begun = 0
            for end in range(1, len(files) + 1):
                if end < len(files) and files[end] == files[begun]:
                    continue
                store, where = opened(files[begun])
                with store.open_input_file(where) as f:
                    for at, n, members in coalesced(list(zip(offsets[begun:end], lengths[begun:end], strict=True))):
                        data = f.read_at(n, at)
                        found = [decode(data[offsets[begun + i] - at : offsets[begun + i] - at + lengths[begun + i]]) for i in members]
                        yield _batch([tuple(r[k] for k in schema.names) for r in found], schema)
                begun = end

    return wanted.mapInArrow(records, RECORD if payload else RECORD.rpartition(",")[0])


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page into archives, and every record back from them."""
    index = write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> last_id THEN last_id END AS refers_to,
       coalesce(nullif(url, ''), 'about:blank') AS url
FROM (SELECT page_id, url, h, max(page_id) OVER (PARTITION BY sha1(h)) AS last_id
      FROM (SELECT page_id, url, coalesce(html, '') AS h FROM pages))
"""
