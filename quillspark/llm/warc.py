"""WARC files that are one gzip stream, rewritten with a gzip member for each record.

A whole-file stream can only be read from its start. normalise() inflates it
once, in pieces, cuts it into records by their headers' Content-Length, writes
every record as a member of its own, and writes an index of offsets beside it,
so that any record can be read alone.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import cut, shared_dir

LEVEL, CHUNK = 6, 1 << 20
INDEX = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())])


class Broken(ValueError):
    """A stream that ends early or holds something other than records."""


def inflate(source: io.RawIOBase, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of all members of a gzip stream, a piece at a time."""
    engine, fed = zlib.decompressobj(31), False
    while data := source.read(chunk):
        while data:
            fed = True
            try:
                piece = engine.decompress(data, chunk)
            except zlib.error as e:
                raise Broken(str(e)) from e
            if piece:
                yield piece
            if engine.eof:
                data, engine, fed = engine.unused_data, zlib.decompressobj(31), False
            else:
                data = engine.unconsumed_tail
    if fed and not engine.eof:
        raise Broken("the gzip stream ends early")


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers (names in lower case), payload and raw bytes of each record of an inflated stream."""
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        piece = next(stream, b"")
        if at:
            del held[:at]
            at = 0
        held += piece
        return bool(piece)

    while True:
        while True:  # blank lines between records
            while len(held) - at < 2 and more():
                pass
            if held[at : at + 2] != b"\r\n":
                break
            at += 2
        if len(held) == at:
            return
        look = 0
        while (end := held.find(b"\r\n\r\n", at + look)) < 0:
            look = max(0, len(held) - at - 3)
            if not more():
                raise Broken("a record's header ends early")
        head = bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise Broken(f"no record begins with {head[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        try:
            size = int(fields["content-length"])
        except (KeyError, ValueError) as e:
            raise Broken("a record has no length") from e
        if size < 0:
            raise Broken(f"a record has the length {size}")
        begin = end + 4 - at
        while len(held) - at < begin + size:
            if not more():
                raise Broken("a record's payload ends early")
        raw = bytes(held[at : at + begin + size])
        at += begin + size
        yield fields, raw[begin:], raw


def record(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record with its closing blank lines."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(payload)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """raw as a gzip member without a time stamp, so that equal input gives equal bytes."""
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def rewrite(source: io.RawIOBase, sink, level: int = LEVEL) -> pa.Table:
    """normalise() of one open file: writes the members to sink and returns the index."""
    rows, at = [], 0
    for n, (fields, payload, raw) in enumerate(records(inflate(source))):
        packed = member(raw + b"\r\n\r\n", level)
        sink.write(packed)
        own = fields.get("x-page-id", "")
        rows.append((n, int(own) if own.lstrip("-").isdigit() else None, fields.get("warc-target-uri"), fields.get("warc-type"), at, len(packed), len(payload), hashlib.sha1(payload).hexdigest()))
        at += len(packed)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX) if rows else INDEX.empty_table()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a name that Spark takes: local, those that Arrow has itself, any other through Hadoop's client."""
    scheme, mark, rest = uri.partition("://")
    if not mark or scheme == "file":
        return pafs.LocalFileSystem(), rest or uri.removeprefix("file:")
    if scheme in ("s3a", "s3n"):
        return pafs.FileSystem.from_uri(f"s3://{rest}")
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        host, _, path = rest.partition("/")
        return pafs.HadoopFileSystem.from_uri(f"{scheme}://{host}"), f"/{path}"


def _put(fs: pafs.FileSystem, path: str, write) -> None:
    """Writes beside the path and then moves: of two attempts at a task the later wins, none is half there."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as sink:
        write(sink)
    fs.move(own, path)


def normalise_file(uri: str, level: int = LEVEL) -> pa.Table:
    """Rewrites name.warc.gz as name.members.warc.gz with name.index.parquet beside it; returns the index.

    The source stays. The same source gives the same files, so a task that runs
    again replaces them by themselves.
    """
    fs, path = _open(uri)
    stem = path.removesuffix(".warc.gz")
    index = INDEX.empty_table()

    def write(sink) -> None:
        nonlocal index
        with fs.open_input_stream(path, compression=None) as source:
            index = rewrite(source, sink, level)

    _put(fs, f"{stem}.members.warc.gz", write)
    _put(fs, f"{stem}.index.parquet", lambda sink: pq.write_table(index, sink))
    return index


def normalise(files: DataFrame, level: int = LEVEL, uri_col: str = "uri") -> DataFrame:
    """normalise_file() of every file: the index rows with file, the path of the members.

    A null name is passed over, a name that comes twice is done once, a file
    without records has no rows, no file gives no row; a file that breaks off, or
    has a record of negative length, fails the job with its name rather than lose
    what it holds. Other columns are not read. Each file is a task of its own.
    """
    kinds = "file string, record bigint, page_id bigint, url string, type string, offset bigint, length bigint, payload_bytes bigint, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                try:
                    index = normalise_file(uri, level)
                except Broken as e:
                    raise Broken(f"{uri}: {e}") from e
                name = pa.array([uri.removesuffix(".warc.gz") + ".members.warc.gz"] * index.num_rows, pa.string())
                for rows in index.add_column(0, "file", name).to_batches():
                    yield rows

    # a file is hours of work for a few bytes of name: the number of tasks follows the files, not the bytes
    names = cut(files.select(F.col(uri_col).alias("uri")).where("uri is not null").distinct())
    return names.repartition(max(1, names.count())).mapInArrow(run, kinds)


def read_record(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, from its own bytes alone."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        raw = f.read(length)
    fields, payload, _ = next(records(inflate(io.BytesIO(raw))))
    return fields, payload


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 1) -> DataFrame:
    """pages as WARC files that are one gzip stream each, a file for each input partition with rows: uri, records.

    A null page is a record with an empty payload; a null url or id leaves its
    header out.
    """
    inner = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    inner = inner.select(F.spark_partition_id().alias("part"), "id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        sink = path = own = None
        n = 0
        for batch in batches:
            parts, ids, urls, pages_ = (batch.column(i).to_pylist() for i in range(4))
            for part, i, url, page in zip(parts, ids, urls, pages_):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/part-{part:06d}.warc.gz"
                    own = f"{path}.{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(own, compression=None)
                fields = [("WARC-Type", "response")]
                if url is not None:
                    fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
                if i is not None:
                    fields.append(("X-Page-Id", str(i)))
                sink.write(engine.compress(record(fields, (page or "").encode())))
                n += 1
        if sink is not None:
            sink.write(engine.flush())
            sink.close()
            fs.move(own, path)
            scheme = folder.split("://")[0] if "://" in folder else "file"
            yield pa.RecordBatch.from_pydict({"uri": [f"{scheme}://{path}" if scheme == "file" else folder.rstrip("/") + "/" + path.rsplit("/", 1)[1]], "records": [n]})

    return cut(inner.mapInArrow(run, "uri string, records bigint"))


def normalise_pages(pages: DataFrame, level: int = LEVEL) -> DataFrame:
    """pages through monolithic files in the shared folder and back: the index of their members.

    A row for each page, repeated ones too; null ids, urls and pages and empty
    pages are as write_monolithic() says, an empty table gives no row.
    """
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = write_monolithic(pages, folder)
    return normalise(files, level)
