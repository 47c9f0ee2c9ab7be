"""WARC archives: writing, normalising monolithic gzip, and reading by index.

Archives arrive as one gzip stream for a whole file, which nobody can enter in the
middle. The normaliser inflates such a stream once, in pieces, rewrites every
record as a gzip member of its own, and writes a sidecar index of the members'
offsets, by which single records are then read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, staged

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Uncompressed bytes after which a writer starts a new archive.
ARCHIVE_BYTES = 32 << 20
#: Bytes read at once.
CHUNK = 1 << 18
LEVEL = 3
_GZIP = 31  # zlib's window bits for a gzip header

_RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, is_revisit boolean"
_INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string"
_READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _clean(url: str) -> str:
    """A URL that keeps to one header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def warc_record(row: dict) -> bytes:
    """One record: a response with its payload, or a revisit with headers alone."""
    payload = row["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if row["is_revisit"] else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if row['is_revisit'] else 'response'}", f"WARC-Record-ID: {_record_id(row['page_id'])}", "WARC-Date: 2020-01-01T00:00:00Z"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['url'])}")
    head.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if row["is_revisit"]:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(row['refers_to'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` with digest, size, and whether a record revisits an equal payload.

    Of equal payloads of ``least_bytes`` and more, the smallest page_id is the response. Digests
    are added up before they cross the network; only payloads that occur twice come back.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    shared = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # null ids are larger than any id, so they never are the response while another row could be
    return (
        rows.join(shared, "payload_digest", "left")
        .withColumn("is_revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False)))
        .withColumn("refers_to", F.when(F.col("is_revisit"), F.col("first_id")))
        .select([x.split()[0] for x in _RECORDS.split(", ")])
    )


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives, each one gzip stream, and return their paths (``archive, n_records``).

    A task names its files after its attempt, and only the files of attempts that succeeded
    are listed, so a lost executor leaves at worst files that nobody reads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        done: list[tuple[str, int]] = []
        out = packer = None
        written = n = 0

        def close() -> None:
            nonlocal out, packer
            out.write(packer.flush())
            out.close()
            done[-1] = (done[-1][0], n)
            out = packer = None

        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                    out, packer, written, n = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=_GZIP), 0, 0
                    done.append((name, 0))
                record = warc_record(row)
                out.write(packer.compress(record))
                written += len(record)
                n += 1
                if written >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}" for name, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["archive", "n_records"])

    return records.mapInArrow(write, "archive string, n_records long")


def inflate(source: pa.NativeFile) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members, read once; trailing zero bytes are padding."""
    unpacker = zlib.decompressobj(_GZIP)
    while data := source.read(CHUNK):
        while data:
            yield unpacker.decompress(data, 8 * CHUNK)
            data = unpacker.unconsumed_tail
            if unpacker.eof:
                data = unpacker.unused_data.lstrip(b"\0")
                unpacker = zlib.decompressobj(_GZIP)
    if not unpacker.eof and (rest := unpacker.flush()):
        yield rest


class _Stream:
    """Reads of a given length, or up to a mark, from pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def until(self, mark: bytes) -> bytes | None:
        """Through the mark; None at the end."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if (piece := next(self.pieces, None)) is None:
                if self.held.strip():
                    raise ValueError("an archive ends inside a record's header")
                return None
            self.held += piece
        return self._take(at + len(mark))

    def some(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                if (piece := next(self.pieces, None)) is None:
                    raise ValueError("an archive ends inside a record")
                self.held += piece
                continue
            part = self._take(min(n, len(self.held)))
            n -= len(part)
            yield part

    def _take(self, n: int) -> bytes:
        part = bytes(self.held[:n])
        del self.held[:n]
        return part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise_archive(path: str, folder: str, level: int = LEVEL) -> list[tuple]:
    """Rewrite one archive with a gzip member for each record and a sidecar index; rows of the index."""
    source_fs, source = pafs.FileSystem.from_uri(path)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    name = path.rpartition("/")[2]
    index = []
    with source_fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        stream, offset = _Stream(inflate(raw)), 0
        while (head := stream.until(b"\r\n\r\n")) is not None:
            head = head.lstrip(b"\r\n")
            fields = _fields(head)
            member = zlib.compressobj(level, wbits=_GZIP)
            length = 0

            def put(data: bytes) -> int:
                out.write(data)
                return len(data)

            length += put(member.compress(head))
            for part in stream.some(int(fields["content-length"])):
                length += put(member.compress(part))
            for _ in stream.some(4):  # the two line ends after a block
                pass
            length += put(member.compress(b"\r\n\r\n") + member.flush())
            index.append((f"{folder}/{name}", offset, length, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri")))
            offset += length
    with fs.open_output_stream(f"{base}/{name}.idx.jsonl") as out:
        for _, offset, length, record_id, kind, uri in index:
            out.write(json.dumps({"offset": offset, "length": length, "record_id": record_id, "type": kind, "uri": uri}).encode() + b"\n")
    return index


def _rows_to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive named in ``archives``; the index rows of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{folder}/{TaskContext.get().taskAttemptId()}"
        for b in batches:
            for path in b.column("archive").to_pylist():
                if rows := normalise_archive(path, own):
                    yield _rows_to_batch(rows, _INDEX)

    spread = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("archive").repartition(max(1, spread), "archive").mapInArrow(run, _INDEX)


def read_record(data: bytes) -> tuple:
    """A row of ``_READ`` from one member; size and digest come from the payload where there is one."""
    stream = _Stream(iter([zlib.decompress(data, _GZIP)]))
    fields = _fields(stream.until(b"\r\n\r\n"))
    block = b"".join(stream.some(int(fields["content-length"])))
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "revisit":
        size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
        digest, payload = fields["warc-payload-digest"].removeprefix("sha256:"), None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return _page_id(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, payload, size, digest, _page_id(fields.get("warc-refers-to"))


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, each read alone at its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = None, None
        for b in batches:
            rows, size = [], 0
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if path != held:
                    if source is not None:
                        source.close()
                    fs, at = pafs.FileSystem.from_uri(path)
                    held, source = path, fs.open_input_file(at)
                rows.append(read_record(source.read_at(length, offset)))
                size += len(rows[-1][3] or b"")
                if size > 8 << 20:
                    yield _rows_to_batch(rows, _READ)
                    rows, size = [], 0
            if rows:
                yield _rows_to_batch(rows, _READ)
        if source is not None:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, _READ)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, normalise them, and read every record back.

    One row for each page: ``page_id, url, record_type, payload`` (null for revisits),
    ``payload_bytes, payload_digest, refers_to``. Null html is an empty payload, which is always
    a response; a null page_id or url comes back null; control characters and blanks of a url are
    percent-encoded; rows that repeat the responding id and payload are responses too; an empty
    table gives no archive and no row; other columns are not read. Tasks hold one record at a time.
    """
    folder = new_folder(spark, "warc")
    archives = staged(write_monolithic(plan_records(pages, least_bytes), f"{folder}/raw"), "warc-manifest")
    index = staged(normalise(archives, f"{folder}/members"), "warc-index")
    return read_records(index)
