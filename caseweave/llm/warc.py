"""WARC archives: writing with revisits, and a reader that salvages damaged files.

Writer: each task writes an archive of the pages it reads, one gzip member per
record, and a row for the file. Of pages with equal payloads the one with the
smallest id is a response; the others are revisits without payload, whose
stored HTTP head still tells the payload's length. A file counts when its row
is in the written table of files; a task that runs twice leaves a file that
nobody reads.

Reader: a record is taken when its member decompresses (gzip checks crc32 and
length), its head is well formed, and its block and payload match their
digests. When a check fails the reader looks for the next place where a valid
member begins (or, in a plain archive, the next version line at which a whole
record can be read), goes on from there, and logs the bytes between as a
quarantined gap. Files are read in pieces; a record is held whole.

Defined cases: a null or empty html is an empty payload, all of which are equal;
null ids rank last among equal payloads; of rows with the same id and payload
one is the response; a null url becomes an empty target; control characters and
spaces in a url are written as %XX. An empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import files_dir, filesystem, load, materialise, stored

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
MARK = VERSION + b"\r\n"
READ_BYTES = 1 << 20
FEED_BYTES = 1 << 16
#: An archive beyond this size is closed and another begun.
ROLL_BYTES = 64 << 20


def _name(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def _number(name: str | None) -> int | None:
    return None if name in (None, "null") else int(name)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, url: str | None, html: bytes, payload_digest: str,
           payload_bytes: int, refers_to: str | None = None) -> bytes:
    """One uncompressed record; *html* is left out of a revisit."""
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    block %= payload_bytes
    if kind == "response":
        block += html
    head = [
        VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % name.encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + target,
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: sha1:" + payload_digest.encode(),
        b"WARC-Block-Digest: sha1:" + digest(block).encode(),
    ]
    if kind == "revisit":
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%s>" % refers_to.encode()]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Bad(ValueError):
    """A record that fails a check."""


def parse(data: bytes) -> tuple[dict, int]:
    """(fields, length) of the whole record at the beginning of *data*; checks all it can."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION + b"\r\n") or end < 0:
        raise Bad("head")
    head = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b": ")
        if not sep or b"\r" in value or name.lower() in head:
            raise Bad("field")
        head[name.lower()] = value
    size = head.get(b"content-length", b"")
    if not size.isdigit():
        raise Bad("length")
    stop = end + 4 + int(size)
    block = data[end + 4 : stop]
    if len(block) < int(size) or data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("cut short")
    if head.get(b"warc-block-digest") != b"sha1:" + digest(block).encode():
        raise Bad("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get(b"warc-type", b"").decode()
    told = head.get(b"warc-payload-digest", b"")[5:].decode()
    if kind == "response" and digest(payload) != told:
        raise Bad("payload digest")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)

    def page(field: bytes):
        found = re.fullmatch(rb"<urn:page:(.*)>", head.get(field, b""))
        return found[1].decode() if found else None

    return {
        "page": page(b"warc-record-id"), "record_type": kind, "payload_digest": told,
        "payload_bytes": int(length[1]) if length else len(payload),
        "refers_to": page(b"warc-refers-to"), "url": head.get(b"warc-target-uri", b"").decode(),
        "payload": payload,
    }, stop + 4


class _Window:
    """The bytes of a source around a moving place ``pos``; what lies before it is dropped in time."""

    def __init__(self, source):
        self.source, self.base, self.data, self.pos, self.over = source, 0, b"", 0, False

    @property
    def place(self) -> int:
        """Place of ``pos`` in the source."""
        return self.base + self.pos

    def more(self, size: int = READ_BYTES) -> bool:
        piece = b"" if self.over else self.source.read(size)
        self.over = not piece
        if piece:
            self.data += piece
        return bool(piece)

    def go(self, pos: int) -> None:
        self.pos = pos
        if pos >= READ_BYTES:
            self.base, self.data, self.pos = self.base + pos, self.data[pos:], 0

    def left(self) -> bool:
        return self.pos < len(self.data) or self.more()


def _inflated(window: _Window, begin: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at *begin* of the window; reads on as needed."""
    z, out, at = zlib.decompressobj(31), [], begin
    while True:
        piece = memoryview(window.data)[at : at + FEED_BYTES]
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            raise Bad("member") from e
        at += len(piece) - len(z.unused_data)
        if z.eof:
            return b"".join(out), at
        if at == len(window.data) and not window.more():
            raise Bad("member cut short")


def _plain(window: _Window, begin: int) -> tuple[dict, int]:
    """(fields, end) of the uncompressed record at *begin* of the window; reads on as needed."""
    while True:
        try:
            fields, size = parse(window.data[begin:])
            return fields, begin + size
        except Bad as e:
            open_end = str(e) in ("head", "cut short") and (
                window.data[begin : begin + len(MARK)] == MARK[: len(window.data) - begin]
            )
            if not open_end or not window.more(max(READ_BYTES, len(window.data))):
                raise


def _record(window: _Window, begin: int, packed: bool) -> tuple[dict, int]:
    if not packed:
        return _plain(window, begin)
    content, end = _inflated(window, begin)
    fields, size = parse(content)
    if size != len(content):
        raise Bad("more than a record")
    return fields, end


def _next(window: _Window, packed: bool) -> int:
    """Next place behind ``pos`` at which a valid record begins, else the end of the data."""
    mark, at = MEMBER if packed else MARK, window.pos + 1
    while True:
        found = window.data.find(mark, at)
        if found < 0:
            # a mark may straddle the end of what has been read
            at = max(at, len(window.data) - len(mark) + 1)
            if not window.more():
                return len(window.data)
        else:
            try:
                _record(window, found, packed)
                return found
            except Bad:
                at = found + 1


def salvage(source) -> Iterator[dict]:
    """Records, and gaps as {"gap_start", "gap_end", "reason"}, of an archive in order.

    Every byte is in a record or in a gap.
    """
    window = _Window(source)
    if not window.more():
        return
    packed = not window.data.startswith(VERSION) and (
        window.data.startswith(MEMBER) or MARK not in window.data
    )
    while window.left():
        try:
            fields, end = _record(window, window.pos, packed)
            yield fields
        except Bad as e:
            start, end = window.place, _next(window, packed)
            yield {"gap_start": start, "gap_end": window.base + end, "reason": str(e)}
        window.go(end)


def resolved(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html as bytes) with ``refers_to`` and ``is_response``.

    Pages are written once with a row number, so that of equal rows exactly one
    is the response. A payload shared by a third of all pages is one row of
    counts before it moves; the join back is one that adaptive execution splits
    where a payload is frequent.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = stored(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), "url",
            html.alias("html"), F.sha1(html).alias("sha1"),
        ),
        "pages",
    )
    place = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "row")
    firsts = (
        rows.groupBy("sha1").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1").select("sha1", "first")
    )
    is_response = F.col("first").isNull() | (F.col("first.row") == F.col("row"))
    return rows.join(firsts, "sha1", "left").select(
        "page_id", "url", "html", is_response.alias("is_response"),
        F.col("first.page_id").alias("first_id"),
    )


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write *pages* (from ``resolved``) as archives below *folder*; one row per file, written."""

    def run(tables: Iterator):
        import pyarrow as pa

        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        sink = name = None
        names = []
        for table in tables:
            for x in table.to_pylist():
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                kind = "response" if x["is_response"] else "revisit"
                data = record(
                    kind, _name(x["page_id"]), x["url"], x["html"], digest(x["html"]),
                    len(x["html"]), _name(x["first_id"]),
                )
                sink.write(member(data))
                if sink.tell() >= roll_bytes:
                    sink.close()
                    names.append(name)
                    sink = None
        if sink is not None:
            sink.close()
            names.append(name)
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return materialise(pages.mapInArrow(run, "name string"), "warc-files")


def read(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives; one task reads a file.

    Columns: file, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload, gap_start, gap_end, reason.
    """

    def run(tables: Iterator):
        import pyarrow as pa

        store, base = filesystem(folder)
        kinds = pa.schema([
            ("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
            ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("reason", pa.string()),
        ])
        for table in tables:
            for name in table.column("name").to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    rows, size = [], 0
                    for x in salvage(source):
                        x["file"], x["page_id"] = name, _number(x.pop("page", None))
                        x["refers_to"] = _number(x.get("refers_to"))
                        size += len(x.get("payload", b""))
                        if not payload:
                            x.pop("payload", None)
                        rows.append(x)
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kind = (
        "file string, page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary, gap_start long, gap_end long, "
        "reason string"
    )
    return files.repartition(max(1, files.count())).mapInArrow(run, kind)


def op9_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files_dir(spark, "warc")
    files = write(resolved(load(spark, sf_dir, "pages")), folder)
    return read(files, folder, payload=False).where("record_type IS NOT NULL").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
