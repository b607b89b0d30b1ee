"""WARC archives: a writer of one gzip member a record, and a splittable reader.

A reading task gets a byte range of a file. It looks for gzip magic from the
start of the range, accepts a candidate only if the whole member decodes (with
its checksum) to a WARC header and as many bytes of block as that says, and then
owns every record that starts before the range ends, reading past the end
to complete the last one.

Archives go to the shared folder in spark.checkpoint.dir, through pyarrow's file
systems (local paths, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir
from .common import shuffle_partitions, written

LEAST = 100
FILE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 20
CHUNK_BYTES = 16 << 10
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(page_id) -> str:
    """A record's id. What could end a header line is escaped; no id differs from an empty one."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def page_of(header: str | None) -> str | None:
    return unquote(header[10:-1]) if header and header.startswith("<urn:page:") and header.endswith(">") else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One gzip member: a response, or with refers_to a revisit, whose block keeps the HTTP head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a decoded member, or None if it is no whole record."""
    if not data.startswith(b"WARC/1."):
        return None
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        return None
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size) or rest[int(size) :].strip(b"\r\n"):
        return None
    return headers, rest[: int(size)]


class View:
    """A file from some position on, of which a stretch is held."""

    def __init__(self, file, size: int, at: int, step: int):
        self.file, self.size, self.at, self.step, self.data, self.pos = file, size, at, step, b"", 0

    def held(self) -> int:
        return len(self.data) - self.pos

    def more(self) -> bool:
        begin = self.at + self.held()
        got = self.file.read_at(min(self.step, self.size - begin), begin) if begin < self.size else b""
        self.data, self.pos = self.data[self.pos :] + got, 0
        return bool(got)

    def drop(self, n: int) -> None:
        self.pos += n
        self.at += n


def member(view: View) -> tuple[bytes, int] | None:
    """The decoded member at the view's position and its length, or None if there is none."""
    unpack, out, used = zlib.decompressobj(31), bytearray(), 0
    try:
        while not unpack.eof:
            if used >= view.held() and not view.more():
                return None
            part = view.data[view.pos + used : view.pos + used + CHUNK_BYTES]
            used += len(part)
            out += unpack.decompress(part)
            if not bytes(out[:7]).startswith(b"WARC/1."[: len(out)]):
                return None  # most false candidates end here
    except zlib.error:
        return None
    return bytes(out), used - len(unpack.unused_data)


def records(file, size: int, start: int, end: int, step: int = READ_BYTES) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of the records that start in [start, end)."""
    return ((at, head, block) for at, _, head, block in members(file, size, start, end, step))


def members(file, size: int, start: int, end: int, step: int = READ_BYTES) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, compressed length, headers and block of the records that start in [start, end)."""
    view = View(file, size, start, step)
    while view.at < end:
        if view.held() < len(MAGIC) and not view.more() and not view.held():
            return
        if view.data.startswith(MAGIC, view.pos) and (got := member(view)) and (good := parse(got[0])):
            yield view.at, got[1], *good
            view.drop(got[1])
            continue
        k = view.data.find(MAGIC, view.pos + 1) - view.pos
        if k < 0:  # magic may be cut by the end of what is held
            k = max(1, view.held() - len(MAGIC) + 1)
        view.drop(k)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); path and size of the files, a table of its own.

    Of equal payloads of at least `least` bytes, rows with the smallest id are
    responses and others revisit it (rows without an id too, if any has one); what is shorter or
    alone is a response. A null html is an empty payload, a null url gives no target.

    Payloads are shuffled once, by page. What decides the kinds is (id, digest) only.
    Each attempt of a task writes files of its own name, and only those of the attempt
    that counted are in the result.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    ident = F.coalesce(F.concat(F.lit("="), F.col("page_id").cast("string")), F.lit("none"))
    key = F.concat(ident, F.lit(":"), F.sha2(payload, 256))
    shared = written(pages.where(F.octet_length(payload) >= least).select("page_id", F.unhex(F.sha2(payload, 256)).alias("d")), "warc-digests")
    first = shared.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    later = shared.join(first, "d").where("page_id is null or page_id > first")
    later = later.select(F.concat(ident, F.lit(":"), F.lower(F.hex("d"))).alias("page_key"), "first").distinct()
    rows = pages.select("page_id", "url", payload.alias("payload"), key.alias("page_key"))
    rows = rows.join(later, "page_key", "left").select("page_id", "url", "payload", F.col("first").alias("refers_to"))

    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        done, out, name, size = [], None, "", 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                for page, url, data, ref in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns), strict=True):
                    if out is None:
                        name, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(name, compression=None)
                    one = record(page, url, data, hashlib.sha256(data).hexdigest(), ref)
                    out.write(one)
                    size += len(one)
                    if size >= file_bytes:
                        out.close()
                        done.append((name, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    return written(rows.mapInArrow(run, "path string, size long"), "warc-files")


def read(spark, folder: str, files: DataFrame, split_bytes: int = SPLIT_BYTES, id_type: T.DataType | None = None) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit), path, offset, length of every record.

    files: path, as the store of folder has it, and size. The last record of a range may end in the next. length is that
    of the compressed member; gaps() tells which bytes are in none, as those of a damaged record.
    """
    count = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0
    todo = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    todo = todo.withColumn("stop", F.least(F.col("start") + split_bytes, "size"))
    if count:
        todo = todo.repartitionById(min(count, max(shuffle_partitions(spark), -(-count // 16))), F.pmod(F.xxhash64("path", "start"), F.lit(1 << 30)).cast("int"))
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, path string, offset long, length long"
    kinds = [("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]

    def run(batches):
        store, _ = _store(folder)
        for batch in batches:
            for path, size, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for offset, own, head, block in members(file, size, start, stop):
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = next((int(v) for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if n.lower() == b"content-length"), len(body))
                        kind = head.get("warc-type", "")
                        page, ref = (page_of(head.get(h)) for h in ("warc-record-id", "warc-refers-to"))
                        whole = kind == "response"
                        digest = hashlib.sha256(body).hexdigest() if whole else head.get("warc-payload-digest", "").removeprefix("sha256:")
                        rows.append((page, head.get("warc-target-uri"), kind, ref, len(body) if whole else length, digest, body if whole else None, path, offset, own))
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    got = todo.mapInArrow(run, schema)
    kind = id_type or T.LongType()
    return got.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def gaps(found: DataFrame, files: DataFrame) -> DataFrame:
    """path, start, bytes of the stretches of the files that read() found no record in: damaged, cut off or foreign members.

    A file's records are ordered in one task, a few dozen bytes each.
    """
    ends = files.select("path", F.col("size").alias("offset"), F.lit(0).cast("long").alias("length"))
    after = F.lag(F.col("offset") + F.col("length"), 1, 0).over(Window.partitionBy("path").orderBy("offset", "length"))
    each = found.select("path", "offset", "length").unionByName(ends).withColumn("start", after)
    return each.where("offset > start").select("path", "start", (F.col("offset") - F.col("start")).alias("bytes"))


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES, least: int = LEAST) -> DataFrame:
    """Writes pages to new archives in the shared folder and returns what the splittable reader finds in them.

    An empty table gives no files and no rows; columns other than page_id, url and html are not archived.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    few = pages.select("page_id", "url", "html")
    return read(spark, folder, write(few, folder, least), split_bytes, few.schema["page_id"].dataType)
