"""WARC files that are one monolithic gzip stream, rewritten with every record as a gzip member of its own, and a sidecar offset index."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import to_batch
from quillon.sources.workspace import fs_uri, shared_dir

#: Bytes that are read at once; bytes in which a record's header must end.
READ, HEAD = 1 << 18, 1 << 20
_OUT = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("content_length", pa.int64()), ("status", pa.string())])
SCHEMA = "file string, record_no long, offset long, length long, warc_type string, target_uri string, page_id long, content_length long, status string"


def warc_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record; a null html is an empty payload, a null url or id leaves its header out."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode("utf-8", "surrogatepass")
    head = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")).encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url).encode())
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Inflated:
    """The bytes of a gzip stream (of one member, or of several), inflated once, forward only.

    Where it can't be inflated it stops, with `broken` set and all that came before in `buf`; resume() goes on at the
    next gzip header.
    """

    def __init__(self, raw):
        self.raw, self.z, self.buf, self.rest, self.over, self.broken, self.fresh = raw, zlib.decompressobj(31), bytearray(), b"", False, False, True

    def _step(self, data: bytes) -> None:
        self.buf += self.z.decompress(data, 1 << 22)
        self.rest, self.fresh = self.z.unconsumed_tail, False
        if self.z.eof:
            self.rest, self.z, self.fresh = self.z.unused_data, zlib.decompressobj(31), True

    def fill(self) -> bool:
        if self.over or self.broken:
            return False
        data = self.rest or self.raw.read(READ)
        if self.fresh:  # zeros may pad members
            while data and not (data := data.lstrip(b"\0")):
                data = self.raw.read(READ)
        if not data:
            self.over = True
            return False
        before = self.z.copy()
        try:
            self._step(data)
        except zlib.error:
            self.z, at = before, 0
            for step in (4096, 64, 1):  # up to the very byte where it breaks
                while at < len(data):
                    before = self.z.copy()
                    try:
                        self.buf += self.z.decompress(data[at : at + step])
                        at += step
                    except zlib.error:
                        self.z = before
                        break
            self.rest, self.broken = data[at:], True
            return at > 0
        return True

    def resume(self) -> None:
        """Goes to the next gzip header after the break, if there is one."""
        data, mark = self.rest[1:], b"\x1f\x8b\x08"
        while (at := data.find(mark)) < 0:
            more = self.raw.read(READ)
            if not more:
                self.over, self.broken = True, False
                return
            data = data[-2:] + more
        self.rest, self.z, self.broken, self.fresh = data[at:], zlib.decompressobj(31), False, True

    def find(self, mark: bytes, most: int) -> int:
        """Where the mark is in buf; -1 if it isn't among the next `most` bytes."""
        seen = 0
        while (at := self.buf.find(mark, seen)) < 0:
            seen = max(0, len(self.buf) - len(mark) + 1)
            if seen > most or not self.fill():
                return -1
        return at if at <= most else -1

    def skip_to(self, mark: bytes) -> bool:
        """Drops what comes before the mark, holding no more than a piece of it; False if it doesn't come."""
        while (at := self.buf.find(mark)) < 0:
            del self.buf[: max(0, len(self.buf) - len(mark) + 1)]
            if not self.fill():
                self.buf.clear()
                return False
        del self.buf[:at]
        return True

    def ready(self, n: int) -> bool:
        while len(self.buf) < n and self.fill():
            pass
        return len(self.buf) >= n

    def take(self, n: int) -> bytes:
        self.ready(n)
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def normalise(raw, out, level: int = 6):
    """Reads a gzip stream of WARC records from raw, writes each as a member of its own to out, yields one dict a record.

    A record goes over byte for byte, in pieces, so that its size doesn't matter; it is closed by two line ends, should
    it have none. Its status is "ok"; "truncated" if the stream ends or breaks inside it, then its member holds what
    there is; "no length" if it names no Content-Length, then it reaches up to the next record; "bad header" if its
    header doesn't end within HEAD bytes, then it has no member and the search for records goes on behind its first
    bytes. Where the stream can't be inflated, a row "corrupt", of length 0, stands for what is lost, and reading goes on
    at the next gzip header. Bytes between records that belong to none are skipped.
    """
    stream, offset, n = _Inflated(raw), 0, 0
    nothing = {"length": 0, "warc_type": None, "target_uri": None, "page_id": None, "content_length": None}
    while True:
        if not stream.skip_to(b"WARC/"):
            if not stream.broken:
                return
            yield {"record_no": n, "offset": offset, **nothing, "status": "corrupt"}
            n += 1
            while stream.broken:  # places that only look like a gzip header belong to the same loss
                stream.resume()
                stream.fill()
            continue
        end = stream.find(b"\r\n\r\n", HEAD)
        if end < 0 and len(stream.buf) > HEAD:
            yield {"record_no": n, "offset": offset, **nothing, "status": "bad header"}
            n += 1
            stream.take(5)
            continue
        head = stream.take(end + 4 if end >= 0 else len(stream.buf))
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        text = lambda k: v.decode("utf-8", "replace") if (v := fields.get(k)) is not None else None  # noqa: B023, E731
        size = int(v) if (v := fields.get(b"content-length", b"")).isdigit() else None
        z, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> None:
            nonlocal length
            out.write(data)
            length += len(data)

        put(z.compress(head))
        if end < 0:  # the stream ends inside a header
            status = "truncated"
        elif size is None:
            status, mark = "no length", b"\r\n\r\nWARC/"
            while (at := stream.buf.find(mark)) < 0:
                put(z.compress(stream.take(max(0, len(stream.buf) - len(mark) + 1))))
                if not stream.fill():
                    break
            rest = stream.take(at if at >= 0 else len(stream.buf)).removesuffix(b"\r\n\r\n")
            put(z.compress(rest + b"\r\n\r\n"))
        else:
            left = size
            while left and (piece := stream.take(min(left, 1 << 20))):
                left -= len(piece)
                put(z.compress(piece))
            status = "truncated" if left else "ok"
            if not left:
                put(z.compress(b"\r\n\r\n"))
                stream.ready(4)
                for line_end in (b"\r\n", b"\r\n"):
                    if stream.buf.startswith(line_end):
                        stream.take(2)
        put(z.flush())
        page = fields.get(b"x-page-id", b"")
        yield {"record_no": n, "offset": offset, "length": length, "warc_type": text(b"warc-type"), "target_uri": text(b"warc-target-uri"), "page_id": int(page) if page.removeprefix(b"-").isdigit() else None, "content_length": size, "status": status}
        offset += length
        n += 1


def pages_to_warc(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes every partition of pages as one monolithic file of the folder: rows (file, n_records). A task that runs again writes the same file again."""

    def run(batches):
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        temp, out, n = f"{root}/.{uuid.uuid4().hex}", None, 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    out, z = fs.open_output_stream(temp), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(warc_record(*row)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
            fs.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "n_records"])

    pyarrow.fs.FileSystem.from_uri(folder)[0].create_dir(pyarrow.fs.FileSystem.from_uri(folder)[1], recursive=True)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "file string, n_records long")


def target_name(path: str) -> str:
    """The name of a file's normalised form: two inputs never share one, whatever folders they come from."""
    return f"{hashlib.sha256(path.encode()).hexdigest()[:16]}-{path.rpartition('/')[2]}"


def normalise_files(files: DataFrame, folder: str, base: str = "", level: int = 6) -> DataFrame:
    """Normalises the files that column `file` names (one task a file) into `folder`; gives their sidecar indexes' rows.

    One row a record: (file, record_no, offset, length, warc_type, target_uri, page_id, content_length, status), file
    being the normalised one, named by the input's path (without `base`, if it begins so) and its hash; beside it lies
    <file>.idx, the same as JSON lines. status: see normalise(). A record can be read by a seek to offset and inflating
    length bytes. Each input is inflated once, front to back, in bounded memory. Null names are skipped; a name given
    twice is done once; an empty list gives no rows; other columns are ignored. A task that runs again replaces both
    files with equal ones.
    """
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        own, base_path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                source, path = pyarrow.fs.FileSystem.from_uri(name)
                target, temp, rows = target_name(name.removeprefix(base)), f"{base_path}/.{uuid.uuid4().hex}", []
                made = lambda rows, target=target: to_batch(_OUT, file=[f"{folder}/{target}"] * len(rows), **{k: [r[k] for r in rows] for k in _OUT.names[1:]})
                with source.open_input_stream(path, compression=None) as raw, own.open_output_stream(temp, compression=None) as out, own.open_output_stream(temp + ".idx", compression=None) as index:
                    for r in normalise(raw, out, level):
                        index.write((json.dumps(r) + "\n").encode())
                        rows.append(r)
                        if len(rows) == 5000:
                            yield made(rows)
                            rows = []
                own.move(temp, f"{base_path}/{target}")
                own.move(temp + ".idx", f"{base_path}/{target}.idx")
                yield made(rows)

    names = files.where(F.col("file").isNotNull()).select("file").distinct()
    return names.repartition(max(1, min(files.sparkSession.sparkContext.defaultParallelism * 8, 10_000)), "file").mapInArrow(run, SCHEMA)


def warc_normalise_pages(pages: DataFrame) -> DataFrame:
    """Writes pages as monolithic WARC files in the shared folder, normalises them, and gives the index of all records.

    The files' names in the result are relative to a folder of this run. Null urls, texts and ids: see warc_record.
    Empty pages give no rows; repeated rows give a record each; other columns are ignored. The files stay.
    """
    base = fs_uri(f"{shared_dir(pages.sparkSession)}/quillon-warc-{uuid.uuid4().hex}")
    made = pages_to_warc(pages, f"{base}/whole")
    files = [r[0] for r in made.collect()]  # a name a partition
    spark = pages.sparkSession
    rows = normalise_files(spark.createDataFrame([(f,) for f in files], "file string"), f"{base}/records", f"{base}/whole/")
    return rows.withColumn("file", F.regexp_extract("file", "[^/]+$", 0))


def read_record(path: str, offset: int, length: int) -> bytes:
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return zlib.decompress(f.read_at(length, offset), 31)
