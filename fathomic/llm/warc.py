"""WARC archives: writer with revisit records and a splittable reader.

Writer: one gzip member per record.  Of records with equal payloads (of at least
``min_revisit_bytes`` bytes) the one with the largest id is a ``response`` and the
others are ``revisit`` records that name it; the revisit keeps the payload's
digest and, in its HTTP header, the payload's length.

Reader: every archive is cut into byte ranges.  The task of a range looks for the
gzip magic, takes a candidate only if the member starts with a decodable WARC
header, and owns the records whose first byte lies in its range; it reads on past
its end to finish the last one.  Ranges need no index and any task can be redone.

Limit: a record whose *compressed* bytes hold a whole uncompressed-stored WARC
member could be taken for a record start; deflate of text never makes such bytes.

Defined results: null html is an empty payload, and empty payloads are equal;
repeated rows whose id is the largest of their group are all responses; a null id
ranks below every other and is written as no id (read back null); null urls become
an empty target; no pages give no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean, remove_tree, scratch, slices, worker_tag

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as bytes, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def headers_of(raw: bytes) -> dict[str, str] | None:
    """Header fields of a decoded record, or None if it is none."""
    if not raw.startswith(b"WARC/"):
        return None
    head, end, _ = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return found if end and "warc-type" in found and "content-length" in found else None


def read_header(pieces: Iterator[bytes]) -> dict[str, str] | None:
    """Header fields of the gzip member that the pieces begin with, or None if it is no WARC record; decodes
    up to the header's end, however long that is."""
    z, raw = zlib.decompressobj(31), bytearray()
    for piece in pieces:
        seen = len(raw)
        try:
            raw += z.decompress(piece)
        except zlib.error:
            return None
        if not raw.startswith(b"WARC/"[: len(raw)]):
            return None
        if z.eof or raw.find(b"\r\n\r\n", max(seen - 3, 0)) >= 0:
            break
    return headers_of(bytes(raw))


def read_range(file, size: int, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records ``(offset, headers, content block)`` that start in bytes [start, end) of an open archive."""
    base, data, pos = start, file.read_at(min(block, size - start), start), 0  # data begins at byte base; pos is where we are

    def more(need: int) -> bool:
        """Make at least ``need`` bytes from ``pos`` available, as far as the file goes."""
        nonlocal base, data, pos
        if len(data) - pos < need and base + len(data) < size:
            base, data, pos = base + pos, data[pos:], 0
            while len(data) < need and base + len(data) < size:
                got = file.read_at(min(max(block, need - len(data)), size - base - len(data)), base + len(data))
                if not got:
                    raise EOFError("archive is shorter than its manifest says")
                data += got
        return len(data) - pos >= need

    def pieces(step: int) -> Iterator[bytes]:
        """The bytes from ``pos`` on, piece by piece."""
        used = 0
        while pos + used < len(data) or more(used + 1):
            piece = data[pos + used : pos + used + step]
            yield piece
            used += len(piece)

    known = False  # whether ``pos`` is a record start that the member before it led to
    while base + pos < end:
        if not known:
            k = data.find(MAGIC, pos)
            if k < 0:
                if base + len(data) >= size:
                    return
                pos = max(pos, len(data) - len(MAGIC) + 1)
                more(len(MAGIC) + block)
                continue
            pos = k
            if base + pos >= end:
                return
            if read_header(pieces(4096)) is None:
                pos += 1
                continue
        z, parts, used = zlib.decompressobj(31), [], 0
        try:
            for piece in pieces(1 << 15):
                parts.append(z.decompress(piece))
                used += len(piece)
                if z.eof:
                    break
        except zlib.error:
            pass
        at = base + pos
        if z.eof:
            used -= len(z.unused_data)
            raw = b"".join(parts)
            if (head := headers_of(raw)) is not None:
                body = raw.index(b"\r\n\r\n") + 4
                yield at, head, raw[body : body + int(head["content-length"])]
        elif not known:
            used = 1  # a broken member: look for the next start behind its magic
        else:
            known = False
            continue
        pos += used
        more(len(MAGIC))
        known = z.eof and data[pos : pos + len(MAGIC)] == MAGIC


def write_archives(pages: DataFrame, out: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 6, small_rows: int = 200_000, salts: int = 16, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write one record per page under the folder ``out``; manifest rows ``(file, bytes, records)``.

    The payloads that occur more than once are broadcast if they are at most ``small_rows`` (a digest and
    an id each); beyond, pages meet them in a salted join, so copies of one payload are not one task's.
    A file that has reached ``roll_bytes`` is followed by a new one."""
    held = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    held = held.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    sizes = held.select("page", "sha", F.octet_length("html").alias("n")).where(F.col("n") >= min_revisit_bytes)
    groups = sizes.groupBy("sha").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null").drop("copies")
    groups = cut(groups)
    if groups.count() <= small_rows:
        joined = held.join(F.broadcast(groups), "sha", "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = held.withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(salts))).join(salted, ["sha", "salt"], "left")
    marked = joined.select("page", "url", "html", F.when((F.octet_length("html") >= min_revisit_bytes) & ~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        stream, size, records, name = None, 0, 0, ""
        told = lambda: pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [records]})
        for part in slices(batches, "html"):
            for page, url, html, refers in zip(*(part.column(k).to_pylist() for k in range(4))):
                if stream is None:
                    fs.create_dir(base, recursive=True)
                    size, records, name = 0, 0, f"pages-{worker_tag()}.warc.gz"
                    stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip_member(record(page, url, html.encode(), refers, refers is not None), level)
                stream.write(member)
                size, records = size + len(member), records + 1
                if size >= roll_bytes:
                    stream.close()
                    stream = None
                    yield told()
        if stream is not None:
            stream.close()
            yield told()

    bound_batches(pages.sparkSession)
    return cut(marked.mapInArrow(lean(run), "file string, bytes long, records long"))


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, split_bytes: int = 8 << 20) -> DataFrame:
    """Rows ``(file, offset, warc_type, target_uri, record_id, refers_to_id, payload_digest,
    http_length, payload)`` of all records in the manifest's archives."""

    def text(x: str | None) -> str | None:
        return None if x is None else x.removeprefix("<urn:page:").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        names = ["file", "offset", "warc_type", "target_uri", "record_id", "refers_to_id", "payload_digest", "http_length", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "start"))):
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(f"{base}/{name}") as file:
                    for at, head, block in read_range(file, size, start, min(size, start + split_bytes)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        rows.append((name, at, head["warc-type"], head.get("warc-target-uri"), text(head.get("warc-record-id")), text(head.get("warc-refers-to")), head.get("warc-payload-digest", "").removeprefix("sha1:"), length, payload))
                        held += len(payload)
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    cuts = manifest.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cuts.count())
    schema = "file string, offset long, warc_type string, target_uri string, record_id string, refers_to_id string, payload_digest string, http_length long, payload binary"
    return cuts.repartition(n, "file", "start").mapInArrow(lean(run), schema)


def check_counts(manifest: DataFrame, read: DataFrame) -> None:
    """Raise unless as many records (column ``file``) were read from every archive as the manifest says."""
    found = read.groupBy("file").agg(F.count(F.lit(1)).alias("found"))
    said = manifest.select("file", "records").join(found, "file", "left").select("file", "records", F.coalesce("found", F.lit(0)).alias("found"))
    if bad := said.where("records <> found").first():
        raise ValueError(f"{bad.file} holds {bad.records} records by its manifest, {bad.found} were read")


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id") -> DataFrame:
    """Write the pages and read them back: ``(page_id, payload_bytes, payload_digest,
    record_type, refers_to)`` per record, from the archives alone.

    Raises if an archive gives another number of records than its manifest says.
    A response's digest and length are taken from its payload bytes as read; a
    revisit, which has none, gives the digest and length of its headers. The archives
    are deleted at the end; ``write_archives`` and ``read_archives`` keep theirs."""
    spark = pages.sparkSession
    out = scratch(spark, "warc")
    manifest = write_archives(pages, out, min_revisit_bytes, id_col)
    back = read_archives(spark, manifest, out)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, said, length, payload = (batch.column(k).to_pylist() for k in range(1, 5))
            found = [d if t == "revisit" else digest(p) for t, d, p in zip(kind, said, payload)]
            sizes = [n if t == "revisit" else len(p) for t, n, p in zip(kind, length, payload)]
            if bad := [k for k, (a, b) in enumerate(zip(found, said)) if a != b]:
                raise ValueError(f"payload digest differs from its header in {len(bad)} records")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found), batch.column(1), batch.column(5), batch.column(6)], ["page", "n", "digest", "kind", "refers", "file"])

    got = back.select("record_id", "warc_type", "payload_digest", "http_length", "payload", "refers_to_id", "file").mapInArrow(lean(check), "page string, n long, digest string, kind string, refers string, file string")
    got = cut(got)
    check_counts(manifest, got)
    remove_tree(spark, out)
    return got.select(F.expr("try_cast(page as long)").alias(id_col), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.expr("try_cast(refers as long)").alias("refers_to"))
