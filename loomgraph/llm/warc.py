"""WARC archives: one gzip member per record, written and read back as streams."""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import join_groups
from .scratch import Scratch

#: Archives are closed once they hold so many compressed bytes; reads take so many at a time.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 16
#: High halves of record ids: of pages with an id, and of those without.
_WITH_ID, _WITHOUT_ID = 0x6C6F6F6D67724A70, 0x6C6F6F6D67724A71
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WRITTEN = "path string, records long, bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page: int | None, digest: str) -> str:
    low = int(digest[:16], 16) if page is None else page % (1 << 64)
    return f"<urn:uuid:{uuid.UUID(int=((_WITHOUT_ID if page is None else _WITH_ID) << 64) | low)}>"


def _page(urn: str | None) -> int | None:
    if not urn:
        return None
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    low = value % (1 << 64)
    return (low - (1 << 64) if low >> 63 else low) if value >> 64 == _WITH_ID else None


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int) -> bytes:
    """One WARC/1.1 record as a gzip member: a response, or, with ``refers_to``, a revisit, which has the HTTP headers only."""
    digest = hashlib.sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page, digest.hexdigest())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join((url or "about:blank").split()),
        f"WARC-Payload-Digest: {_base32(digest.digest())}",
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest.hexdigest())}", f"WARC-Profile: {_REVISIT}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def _archive_writer(root: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base)
        part = TaskContext.get().partitionId()
        own, out, state = uuid.uuid4().hex, [], {"file": None, "n": 0, "bytes": 0, "count": 0}

        def close():
            if state["file"]:
                state["file"].close()
                name = f"part-{part:06d}-{state['count']:04d}-{own}.warc.gz"
                store.move(f"{base}/.{own}", f"{base}/{name}")
                out.append((f"{root}/{name}", state["n"], state["bytes"]))
                state.update(file=None, n=0, bytes=0, count=state["count"] + 1)

        for batch in batches:
            for page, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if not state["file"]:
                    state["file"] = store.open_output_stream(f"{base}/.{own}")
                text = html.as_py()
                member = record(page.as_py(), url.as_py(), (text or "").encode("utf-8", "surrogatepass"), refers_to.as_py(), level)
                state["file"].write(member)
                state.update(n=state["n"] + 1, bytes=state["bytes"] + len(member))
                if state["bytes"] >= ARCHIVE_BYTES:
                    close()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, level: int = 6) -> DataFrame:
    """Write a record per row of ``pages`` into archives under ``root`` (a URI that all executors reach); gives (path, records, bytes).

    Of rows with equal payloads of at least ``least`` bytes, that with the largest id is the
    response and the others are revisits of it; a group without any id is all responses. Null
    html is empty, a null url is about:blank. Rows that repeat id and payload are each written.
    Payloads are equal when their SHA-256 is. An archive gets its name when it is whole. Names have a part that is each
    attempt's own, so a task that runs again meets no file of its first run; the result lists the archives of the attempts that count. The jobs run at once.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    long = rows.where(F.octet_length("html") >= least).select("id", "digest")
    best = long.groupBy("digest").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null")
    best = scratch.table(best.select("digest", "best", "n"), "repeated")
    told = join_groups(rows, best, "digest", "n", "left")
    told = told.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))
    return scratch.table(told.mapInArrow(_archive_writer(root, level), _WRITTEN), "written")


class RecordReader:
    """Records of one archive, in order, from a stream: (headers, block) each, one gzip member at a time.

    Bytes are inflated as they come; a record ends by its Content-Length, and its member must end
    there too. Digests are verified. Broken input raises ValueError.
    """

    def __init__(self, stream, size: int = READ_BYTES):
        self.stream, self.size, self.ahead = stream, size, b""

    def _raw(self) -> bytes:
        got, self.ahead = self.ahead or self.stream.read(self.size), b""
        return bytes(got)

    def _member(self) -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            raw = self._raw()
            if not raw:
                raise ValueError("the archive ends inside a record")
            part = inflate.decompress(raw)
            if part:
                yield part
        self.ahead = inflate.unused_data

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            self.ahead = self._raw()
            if not self.ahead:
                return
            parts = self._member()
            head = bytearray()
            while (end := head.find(b"\r\n\r\n")) < 0:
                part = next(parts, None)
                if part is None:
                    raise ValueError("a record without the end of its headers")
                head += part
            version, *lines = head[:end].decode("utf-8").split("\r\n")
            if not version.startswith("WARC/1."):
                raise ValueError(f"no WARC record: {version[:40]!r}")
            fields = dict(line.split(": ", 1) for line in lines)
            length = int(fields["Content-Length"])
            body = bytearray(head[end + 4 :])
            for part in parts:
                body += part
            if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
                raise ValueError(f"{fields.get('WARC-Record-ID')}: {len(body)} bytes follow, {length + 4} were announced")
            block = bytes(body[:length])
            if fields.get("WARC-Block-Digest", "") not in ("", _base32(hashlib.sha1(block).digest())):
                raise ValueError(f"{fields.get('WARC-Record-ID')}: the block's digest differs")
            yield fields, block


def read_record(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload's SHA-1 in hex, type, refers_to); the full payload's, which for a revisit the headers tell."""
    head, _, payload = block.partition(b"\r\n\r\n")
    announced = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (len(payload) != announced or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest or length")
    return _page(fields["WARC-Record-ID"]), announced, digest.hex(), fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in READ.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list[tuple] = []
    for given in batches:
        for path in given.column(0).to_pylist():
            store, place = pafs.FileSystem.from_uri(path)
            with store.open_input_stream(place, compression=None) as stream:
                for fields, block in RecordReader(stream):
                    if fields["WARC-Type"] in ("response", "revisit"):
                        rows.append(read_record(fields, block))
                    if len(rows) >= 4096:
                        yield batch(rows)
                        rows = []
    if rows:
        yield batch(rows)


def read_archives(paths: DataFrame) -> DataFrame:
    """Responses and revisits of the archives named in ``paths`` (path), an archive a task at most: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null paths are passed over; no paths give no rows. Other record types are passed over.
    """
    paths = paths.select("path").where("path is not null")
    n = max(1, min(paths.count(), 100_000))
    return paths.repartition(n).mapInArrow(_read, READ)
