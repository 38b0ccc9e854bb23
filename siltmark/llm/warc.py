"""WARC archives with one Zstandard frame per record and the dictionary in a leading skippable frame.

Writing. Payload digests are computed by Spark; the smallest id of each digest and length that
occurs twice or more comes from a grouped minimum (combined in each task) and is written. The pages
are joined with that written table, so that the join deals both sides anew and can split a payload
that a third of the pages hold. Each task then fills archives: the first records of an archive (at most ``SAMPLE_BYTES``) train its dictionary, which
is stored in front, and an archive closes near ``ARCHIVE_BYTES``. Archives are rows with the
columns of Spark's ``binaryFile`` source (path, modificationTime, length, content), so a retried
task leaves no half file, and ``read_archives`` reads such a table or a folder of archives alike.

Reading. The leading skippable frame gives the dictionary (itself perhaps compressed); every
following frame must decode to exactly one record, whose version line, headers, lengths and
payload digest are checked. A damaged archive gives one row with ``error`` set, at its place;
what stands before the damage is returned as usual.

Defined cases: NULL and empty payloads are records of 0 bytes; rows with equal id and payload
that have the smallest id are each a response (the other copies are revisits); a NULL id is
larger than any other; an empty table gives no archive and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions.scratch import written
from siltmark.llm.workers import task

# Fixed values of the WARC and Zstandard formats.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 1 << 20, 200, 1 << 14
ARCHIVE_BYTES = 8 << 20
#: Bytes of records per batch handed to Spark, and of a frame fed to the decoder at a time.
BATCH_BYTES, FEED_BYTES = 4 << 20, 1 << 16
#: All records carry the same date: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base32_sha1(payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{page_id}>" if page_id is not None else "<urn:page:none>",
        "WARC-Date": DATE,
        "WARC-Target-URI": _clean(url) if url else "urn:page:unknown",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
    }
    if revisit:
        headers |= {"WARC-Profile": REVISIT_PROFILE}
        headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>" if refers_to is not None else "<urn:page:none>"}
        payload = b""
    headers["Content-Length"] = str(len(payload))
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers.items())])
    return head + b"\r\n\r\n" + payload + b"\r\n\r\n"


def marked(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, revisit and refers_to of every page."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = df.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("_n", F.octet_length("payload")).withColumn("_sha", F.sha1("payload"))
    first = F.min("page_id")  # a minimum passes over NULL: it is larger than any id
    firsts = rows.groupBy(F.col("_sha").alias("_s"), F.col("_n").alias("_l")).agg(first.alias("_first"), F.count("*").alias("_c"))
    firsts = written(firsts.where("_c > 1").drop("_c"), "first-payloads").hint("shuffle_hash")
    joined = rows.join(firsts, (rows["_sha"] == firsts["_s"]) & (rows["_n"] == firsts["_l"]), "left")
    revisit = F.col("_s").isNotNull() & (F.col("_n") >= least) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("_first")).alias("refers_to"))


class _Archive:
    """One archive under construction. Records are held back until the dictionary is trained."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.held = 0
        self.parts: list[bytes] = []
        self.size = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        if self.compressor:
            self._write(data)
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES or len(self.waiting) >= SAMPLE_RECORDS:
            self._start()

    def _start(self) -> None:
        kept = None
        if len(self.waiting) >= 8:
            try:
                kept = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:DICTIONARY_BYTES] for x in self.waiting])
            except zstandard.ZstdError:
                kept = None  # too few or too uniform samples: an archive may go without
        if kept:
            packed = zstandard.ZstdCompressor().compress(kept.as_bytes())
            self.parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=kept, write_checksum=True)
        for x in self.waiting:
            self._write(x)
        self.waiting = []

    def _write(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.parts.append(frame)
        self.size += len(frame)

    def bytes(self) -> bytes:
        if not self.compressor:
            self._start()
        return b"".join(self.parts)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, used = _Archive(), False
    for batch in batches:
        cols = [batch.column(batch.schema.names.index(n)) for n in ("page_id", "url", "payload", "refers_to", "revisit")]
        for values in zip(*cols):
            archive.add(record(*(v.as_py() for v in values)))
            used = True
            if archive.size >= ARCHIVE_BYTES:
                yield _blob(archive)
                archive, used = _Archive(), False
    if used:
        yield _blob(archive)


def _blob(archive: _Archive) -> pa.RecordBatch:
    data = archive.bytes()
    return pa.RecordBatch.from_pydict({
        "path": pa.array([f"{hashlib.sha1(data).hexdigest()}.warc.zst"]),
        "length": pa.array([len(data)], pa.int64()), "content": pa.array([data], pa.binary()),
    })


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the output of :func:`marked` as a table of archives (path, length, content)."""
    pages.mapInArrow(task(_write), "path string, length bigint, content binary").write.parquet(path)


class Damaged(ValueError):
    pass


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames behind the dictionary frame."""
    view, at, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    first = True
    while at < len(view):
        if len(view) - at < 8:
            raise Damaged("cut short")
        magic, n = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE_MAGICS:
            if at + 8 + n > len(view):
                raise Damaged("cut short")
            if first and magic == DICTIONARY_MAGIC:
                raw = bytes(view[at + 8 : at + 8 + n])
                if raw[:4] == ZSTD_MAGIC:
                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + n
        else:
            one, out = decoder.decompressobj(), []
            while not one.eof:
                piece = view[at : at + FEED_BYTES]
                if not piece:
                    raise Damaged("cut short")
                out.append(one.decompress(piece))
                at += len(piece) - len(one.unused_data)
            yield b"".join(out)
        first = False


def parse(data: bytes) -> dict:
    """Headers and payload of the one record in a frame, checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise Damaged("no WARC head")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise Damaged("header without a name")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise Damaged(f"no {name}")
    if not headers["content-length"].isdigit():
        raise Damaged("content-length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("length differs from content-length")
    payload = rest[:n]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if digest and digest != base32_sha1(payload):
            raise Damaged("payload digest differs")
        if headers.get("x-payload-length", str(n)) != str(n):
            raise Damaged("payload length differs")
    elif headers["warc-type"] == "revisit" and (n or not headers.get("warc-refers-to")):
        raise Damaged("revisit with a payload or without a target")
    return headers | {"payload": payload}


def _number(urn: str | None) -> int | None:
    tail = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, "
    "archive string, error string"
)
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("error", pa.string()),
])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, contents = (batch.column(batch.schema.names.index(n)) for n in ("path", "content"))
        for path, content in zip(paths, contents):
            rows, held = [], 0
            for row in _records(path.as_py(), content.as_buffer()):
                rows.append(row)
                held += len(row["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD)


def _records(path: str, data) -> Iterator[dict]:
    try:
        for frame in frames(data):
            r = parse(frame)
            revisit = r["warc-type"] == "revisit"
            yield {
                "page_id": _number(r["warc-record-id"]), "url": r.get("warc-target-uri"), "record_type": r["warc-type"],
                "refers_to": _number(r["warc-refers-to"]) if revisit else None,
                "payload_bytes": int(r.get("x-payload-length", len(r["payload"]))),
                "payload_digest": r.get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(r["payload"]),
                "payload": None if revisit else r["payload"], "archive": path, "error": None,
            }
    except (Damaged, zstandard.ZstdError) as e:
        yield dict.fromkeys(_RECORD.names) | {"archive": path, "error": str(e)}


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of a table of archives: ``binaryFile`` rows, or what :func:`write_archives` wrote."""
    return archives.select("path", "content").mapInArrow(task(_read), RECORD)
