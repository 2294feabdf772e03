"""WARC archives of pages: a writer with revisit records, and a reader that salvages damaged archives.

Each record is one gzip member. A task writes its archives to the shared folder under names with its attempt
and returns a row for each; only archives listed by tasks that succeeded are read, so lost or repeated
attempts leave nothing behind that counts.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import shared_folder

ARCHIVE_BYTES = 8 << 20
#: Compressed bytes given to the decompressor at once.
FEED = 4 << 10
# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION_LINE = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]"), re.compile(rb"WARC/1\.[01]\r\n")
HEADER_LINE, LENGTH = re.compile(rb"([^:\r\n]*):([^\r]*(?:\r(?!\n)[^\r]*)*)\r\n"), re.compile("[0-9]{1,18}")
EPOCH = "1970-01-01T00:00:00Z"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit without payload that names the page it repeats."""
    kind = "response" if refers_to is None else "revisit"
    name = "" if page_id is None else page_id
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", EPOCH),
              ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")), ("WARC-Payload-Digest", "sha1:" + bare_digest(payload)),
              ("WARC-Payload-Length", len(payload))]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    fields.append(("Content-Length", len(payload)))
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


# ---------------------------------------------------------------- writer
def _writer(folder: str):
    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        out, name, size, records, part = None, "", 0, 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])],
                                              names=["file", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name = f"{context.partitionId():06d}-{part:04d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, size, records, part = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0, part + 1
                data = member(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()
    return run


def write_archives(pages: DataFrame, least: int = 0) -> tuple[str, DataFrame]:
    """Write a record for each row of pages (page_id, url, html); returns the folder and its list of archives.

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest page_id is the response
    and the others revisit it; rows repeating that page_id are responses too. Null html is an empty payload;
    a null page_id never is referred to. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    keys = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    first = keys.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    refer = (keys.where(F.col("size") >= least).join(first, "digest")
             .where("page_id IS NULL OR page_id < first").select("page_id", "digest", F.col("first").alias("refers_to")))
    shape = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(
        refer.distinct().withColumnRenamed("page_id", "p").withColumnRenamed("digest", "d"),
        F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    folder = shared_folder(spark)
    spark._jvm.org.apache.hadoop.fs.Path(folder + "/archives").getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(folder + "/archives"))
    listing = shape.select("page_id", "url", "html", "refers_to").mapInArrow(
        _writer(folder + "/archives"), "file string, records long, bytes long")
    listing.write.parquet(folder + "/listing")
    return folder + "/archives", spark.read.schema(listing.schema).parquet(folder + "/listing")


# ---------------------------------------------------------------- reader
class Damage(Exception):
    pass


class _Marks:
    """Places of gzip marks, version lines and zero bytes in an archive; going forward, each byte is searched once."""

    def __init__(self, data: bytes):
        self.data, self.zipped, self.plain, self.zero = data, -1, -1, (0, -1)

    def after(self, at: int) -> int:
        """The first gzip mark with a whole header or version line at or after a place, else the end."""
        if self.zipped < at:
            self.zipped = next((m.start() for m in MAGIC.finditer(self.data, at) if _has_header(self, m.start())), len(self.data))
        if self.plain < at:
            found = VERSION_LINE.search(self.data, at)
            self.plain = found.start() if found else len(self.data)
        return min(self.zipped, self.plain)

    def text_end(self, at: int) -> int:
        """The place after the first zero byte at or after a place, beyond the end if there is none."""
        begin, end = self.zero
        if not begin <= at <= end:
            found = self.data.find(b"\0", at, begin if at < begin <= end else len(self.data))
            # Nothing between ``at`` and the stretch known before: that stretch only starts earlier.
            end = found if found >= 0 else end if at < begin <= end else len(self.data)
            self.zero = at, end
        return end + 1


def _has_header(marks: _Marks, at: int) -> bool:
    """Whether a gzip header that starts at ``at`` ends inside the archive.

    The decompressor itself would read a name without an end up to the end of the archive at each false mark.
    """
    data, flags = marks.data, marks.data[at + 3]
    place = at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place:place + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            place = marks.text_end(place) if place < len(data) else place
    return place + (2 if flags & 2 else 0) < len(data)


def _inflate(marks: _Marks, view: memoryview, at: int) -> tuple[bytes, int | None, str]:
    """Content of a gzip member, the place after it, and "".

    Where its header, data, checksum or length are damaged: the content up to some FEED bytes before, None, the reason.
    """
    if not _has_header(marks, at):
        return b"", None, "gzip: header cut off"
    unpack, parts = zlib.decompressobj(31), []
    try:
        while not unpack.eof and at < len(view):
            parts.append(unpack.decompress(view[at:at + FEED]))
            at += FEED
    except zlib.error as e:
        return b"".join(parts), None, f"gzip: {e}"
    if not unpack.eof:
        return b"".join(parts), None, "gzip: cut off"
    return b"".join(parts), min(at, len(view)) - len(unpack.unused_data), ""


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and the place after the record that starts at ``at``; Damage where a check fails.

    The header is read line by line, so a failed try ends at the next version line at the latest.
    """
    version = VERSION_LINE.match(raw, at)
    if not version:
        raise Damage("no version line")
    end, fields = version.end(), {}
    while raw[end:end + 2] != b"\r\n":
        line = HEADER_LINE.match(raw, end)
        if not line:
            raise Damage("bad header line" if raw.find(b"\r\n", end, end + 8192) >= 0 else "header not ended")
        fields[line[1].decode("utf-8", "replace").strip().lower()] = line[2].decode("utf-8", "replace").strip()
        end = line.end()
    if not LENGTH.fullmatch(fields.get("content-length", "")) or not fields.get("warc-type"):
        raise Damage("no type or length")
    stop = end + 2 + int(fields["content-length"])
    if raw[stop:stop + 4] != b"\r\n\r\n":
        raise Damage("record end not found")
    block = raw[end + 2:stop]
    if fields["warc-type"] == "response" and fields.get("warc-payload-digest", "") != "sha1:" + bare_digest(block):
        raise Damage("payload digest differs")
    return fields, block, stop + 4


def _inside(raw: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """Records and gaps of the content of one member, by places in that content."""
    marks, at, gap, reason = _Marks(raw), 0, None, ""
    while at < len(raw):
        try:
            fields, block, end = parse(raw, at)
        except Damage as e:
            if gap is None:
                gap, reason = at, str(e)
            found = VERSION_LINE.search(raw, at + 1)
            at = found.start() if found else len(raw)
            continue
        if gap is not None:
            yield gap, at, None, b"", reason
            gap = None
        yield at, end, fields, block, ""
        at = end
    if gap is not None:
        yield gap, len(raw), None, b"", reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(start, end, fields, block, reason) of an archive of gzip members and plain records.

    After a failed check the bytes up to the next start that reads as a valid record (the next gzip member or
    version line) are one gap, with fields None and the reason; later records are recovered. Every byte belongs to
    one record or gap. A member may hold any number of records: the first row of a member spans it, further rows
    are empty spans at its end, and a gap among them names its bytes of the content in the reason. Of a member
    that fails its own check, the responses before its last readable one whose payload digest holds are kept, as
    empty spans at its start; a sound member without any record is a gap.
    """
    view, marks, at, gap, reason = memoryview(data), _Marks(data), 0, None, ""
    while at < len(data):
        rows, end, why = [], None, ""
        if MAGIC.match(data, at):
            raw, end, why = _inflate(marks, view, at)
            for a, b, fields, block, damage in _inside(raw):
                if fields is None:
                    rows.append((None, b"", f"{damage} (bytes {a} to {b} of the member)"))
                elif end is not None or (fields["warc-type"] == "response" and b < len(raw)):
                    rows.append((fields, block, ""))
            why = why or ("" if any(r[0] for r in rows) else rows[0][2] if rows else "empty member")
            if end is None:
                rows = [r for r in rows if r[0]]
        else:
            try:
                fields, block, end = parse(data, at)
                rows = [(fields, block, "")]
            except Damage as e:
                why = str(e)
        if gap is not None and any(r[0] for r in rows):
            yield gap, at, None, b"", reason
            gap = None
        if why:  # nothing sound starts here, but for what a damaged member gave
            yield from ((at, at, *r) for r in rows if r[0])
            if gap is None:
                gap, reason = at, why
            at = marks.after(at + 1) if end is None else end
            continue
        for n, row in enumerate(rows):
            yield end if n else at, end, *row
        at = end
    if gap is not None:
        yield gap, len(data), None, b"", reason


RECORD = ("file string, start long, stop long, reason string, record_type string, page_id long, payload_bytes long, "
          "payload_digest string, refers_to long")


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def _reader(batches):
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            path, rows = path.as_py(), []
            for start, end, fields, block, reason in salvage(content.as_py()):
                if fields is None:
                    rows.append((path, start, end, reason, "gap", None, end - start, None, None))
                    continue
                response = fields["warc-type"] == "response"
                size = len(block) if response else int(fields.get("warc-payload-length") or 0)
                rows.append((path, start, end, "", fields["warc-type"], _page(fields.get("warc-record-id", "")), size,
                             bare_digest(block) if response else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                             _page(fields.get("warc-refers-to", ""))))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=[f.split()[0] for f in RECORD.split(", ")])


def read_archives(folder: str, listing: DataFrame | None = None) -> DataFrame:
    """A row for each record of the archives in a folder, and one of record_type 'gap' for each quarantined stretch.

    With a ``listing`` only the archives it names are read; an archive that is not there is not made up.
    """
    spark = None if listing is None else listing.sparkSession
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.active()
    files = spark.read.format("binaryFile").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if listing is not None:
        files = files.join(listing.select(F.col("file").alias("name")), "name", "left_semi")
    return files.select("name", "content").mapInArrow(_reader, RECORD)
