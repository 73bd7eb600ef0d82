"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each a gzip member of its own, so that one record can be read by
its byte range. The index has two levels. Captures sorted by reversed-host URL key are packed into
compressed blocks, one file of blocks per range partition; a sparse directory beside it holds the first
key and the byte range of every block. A lookup searches the first keys of the parts, then the
directory of one part, reads one block's range, searches in it, and then reads one record's range.

Tasks write files under names of their own and report them; only reported files belong to the result,
so a task that is repeated or lost leaves nothing behind that is read. All files are in the given
folder, which every executor must reach. Lookups and fetches are sorted, so each block is read once per
task and neighbouring records come with one read.

Equal payloads of some length are stored once: the record with the largest id is the response, the
others are revisits that name it. Payloads are compared by length and SHA-1.

Defined cases: a null page is an empty payload; a null URL has an empty key and no target header; blanks
and control characters in URLs become ``_``; a null id is written as ``null``, and comes first in its
group's order, so it becomes a revisit where the group has an id; rows that repeat the response's id
are responses too; an empty table makes no archive and gives an empty result. Columns other than id,
URL and content are not stored.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.storage import stored
from tripweave.session import broadcast_if_small, ensure_checkpoint_dir

LEAST_SHARED = 1000  # bytes of a payload from which copies become revisits
ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond this
BLOCK_LINES = 500  # captures per index block
GAP, SPAN = 64 << 10, 4 << 20  # records this close are fetched together, up to a size
READ = 1 << 20
NO_ID = -(2**63)
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[len("file:") :]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def new_folder(spark, name: str) -> str:
    """A folder of its own under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    return folder


def clean_url(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "_")


def url_key(url: Column) -> Column:
    """``http://www.example.org/a?b#c`` becomes ``org,example)/a?b``."""
    shape = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)"
    clean = clean_url(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(clean, shape, 1)), r"^www\.", "")
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(
        clean.rlike(shape), F.concat(turned, F.lit(")"), F.regexp_extract(clean, shape, 2))
    ).otherwise(clean)


def with_revisits(
    pages: DataFrame, page: str, url: str, html: str, least: int = LEAST_SHARED
) -> DataFrame:
    """Columns of a record: id, url, key, html, payload_bytes, digest, refers_to (null: a response)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    records = pages.select(
        F.col(page).alias("id"),
        clean_url(F.col(url)).alias("url"),
        payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    shared = (
        records.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
        .agg(F.max("id").alias("__first"), F.count(F.lit(1)).alias("__copies"))
        .where("__copies > 1 AND __first IS NOT NULL")
        .drop("__copies")
    )
    # Measured: below the limit no page is shuffled for this join.
    shared = broadcast_if_small(shared, 64)
    same = (F.col("digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes"))
    other = ~F.col("id").eqNullSafe(F.col("__first"))
    return records.join(shared, same, "left").select(
        "id", "url", "html", "payload_bytes", "digest",
        F.when(F.col("__first").isNotNull() & other, F.col("__first")).alias("refers_to"),
    )


def record(row: dict) -> bytes:
    """One WARC record: headers, then an HTTP message whose body is the payload."""
    revisit = row["refers_to"] is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    body = http if revisit else http + row["html"].encode("utf-8")
    name = "null" if row["id"] is None else row["id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
    ]
    if row["url"]:
        lines.append(f"WARC-Target-URI: {row['url']}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers by lower-case name, and the record's block of Content-Length bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        # Blanks of HTTP only: a URL may begin or end with other Unicode blanks.
        headers[name.strip(" \t").lower()] = value.strip(" \t")
    return headers, rest[: int(headers["content-length"])]


def page_number(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "null") else int(name)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records (see ``with_revisits``); one row (path, bytes, records) per archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        out, path, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for at in range(batch.num_rows):
                if out is None:
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                data = member(record(row))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out, done = None, [*done, (path, size, count)]
        if out is not None:
            out.close()
            done.append((path, size, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["path", "bytes", "records"],
        )

    return stored(records.mapInArrow(write, "path string, bytes long, records long"))


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream, with bounded reads."""
    begin, data = 0, b""
    while True:
        unpacker, used, parts = zlib.decompressobj(31), 0, []
        while not unpacker.eof:
            if not data:
                data = stream.read(READ)
                if not data:
                    if used:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(unpacker.decompress(data))
            used += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        yield begin, used, b"".join(parts)
        begin += used


def read_captures(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives: url, id, path, byte offset and length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for begin, size, data in members(stream):
                        headers, _ = parse(data)
                        number = page_number(headers.get("warc-record-id"))
                        rows.append((headers.get("warc-target-uri", ""), number, path, begin, size))
                        if len(rows) >= 5000:
                            yield _capture_batch(rows)
                            rows = []
                yield _capture_batch(rows)

    # A task for each archive: an explicit number is not merged again, however small the list is.
    paths = archives.select("path").repartitionByRange(max(archives.count(), 1), "path")
    captures = paths.mapInArrow(scan, "url string, id long, path string, begin long, size long")
    return captures.select(
        url_key(F.col("url")).alias("key"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "path", "begin", "size"
    )


def _capture_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)],
        ["url", "id", "path", "begin", "size"],
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def write_index(captures: DataFrame, folder: str) -> list[tuple]:
    """Write the sorted captures as blocks with a directory per part.

    Returns the top of the index: first key, first id and path of each part, one per range partition.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        path = f"{root}/{uuid.uuid4().hex}.idx"
        first, lines, directory, offset, out = None, [], [], 0, None

        def flush():
            nonlocal offset, lines
            data = zlib.compress("\n".join("\t".join(map(str, line)) for line in lines).encode())
            out.write(data)
            directory.append((lines[0][0], lines[0][1], offset, len(data)))
            offset, lines = offset + len(data), []

        for line in _rows(batches):
            if out is None:
                out, first = system.open_output_stream(path, compression=None), line
            lines.append(line)
            if len(lines) >= BLOCK_LINES:
                flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with system.open_output_stream(f"{path}.dir", compression=None) as side:
                side.write("\n".join("\t".join(map(str, d)) for d in directory).encode())
        part = [(first[0], first[1], path)] if first else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in part], pa.string()),
                pa.array([p[1] for p in part], pa.int64()),
                pa.array([p[2] for p in part], pa.string()),
            ],
            ["key", "id", "path"],
        )

    order = ("key", "id", "path", "begin")
    # Range partitioning looks at its input twice; the archives are read once.
    parts = stored(
        stored(captures).repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("key", "id", "path", "begin", "size")
        .mapInArrow(write, "key string, id long, path string")
    )
    return sorted(tuple(row) for row in parts.collect())


class IndexReader:
    """Looks captures up by binary search; holds one part's directory and one block at a time."""

    def __init__(self, top: list[tuple], firsts: list[tuple], folder: str):
        self.top, self.firsts = top, firsts
        self.system, _ = filesystem(folder)
        self.part = self.block = self.file = None

    def _open_part(self, part: int) -> None:
        if part == self.part:
            return
        path = self.top[part][2]
        with self.system.open_input_stream(f"{path}.dir", compression=None) as side:
            self.directory = [line.split("\t") for line in side.read().decode().split("\n")]
        self.starts = [(line[0], int(line[1])) for line in self.directory]
        self.file, self.part, self.block = self.system.open_input_file(path), part, None

    def _open_block(self, block: int) -> None:
        if block == self.block:
            return
        self.file.seek(int(self.directory[block][2]))
        data = zlib.decompress(self.file.read(int(self.directory[block][3])))
        self.lines = [line.split("\t") for line in data.decode().split("\n")]
        self.keys, self.block = [(line[0], int(line[1])) for line in self.lines], block

    def captures(self, want: tuple[str, int]) -> Iterator[tuple[str, int, int]]:
        """Path, offset and length of every capture of a (key, id)."""
        for part in self._from(self.firsts, want):
            self._open_part(part)
            for block in self._from(self.starts, want):
                self._open_block(block)
                row = bisect.bisect_left(self.keys, want)
                while row < len(self.keys) and self.keys[row] == want:
                    line = self.lines[row]
                    yield line[2], int(line[3]), int(line[4])
                    row += 1

    @staticmethod
    def _from(starts: list[tuple], want: tuple) -> Iterator[int]:
        """The entry before the first that may begin with ``want``, and those that begin with it."""
        at = bisect.bisect_left(starts, want)
        if at > 0:
            yield at - 1
        while at < len(starts) and starts[at] == want:
            yield at
            at += 1


def locate(wanted: DataFrame, top: list[tuple], folder: str, complete: bool = False) -> DataFrame:
    """(path, begin, size) of every capture of the wanted (key, id), each wanted pair once.

    With ``complete`` a wanted pair without a capture is an error.
    """
    firsts = [(key, number) for key, number, _ in top]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = IndexReader(top, firsts, folder), None
        for batch in batches:
            found = []
            for want in _rows([batch]):
                if want != last:
                    own = list(reader.captures(want))
                    if complete and not own:
                        raise ValueError(f"no capture of page {want[1]} with key {want[0]!r}")
                    found += own
                    last = want
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                ],
                ["path", "begin", "size"],
            )

    return (
        wanted.select("key", F.coalesce("id", F.lit(NO_ID)).alias("id"))
        .repartitionByRange("key", "id")
        .sortWithinPartitions("key", "id")
        .mapInArrow(search, "path string, begin long, size long")
    )


def read_record(data: bytes) -> tuple:
    """Id, payload length, SHA-1, type and referred id of a record; lengths are of the full payload."""
    headers, block = parse(zlib.decompress(data, 31))
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    if kind == "revisit":
        size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != headers["warc-payload-digest"].removeprefix("sha1:"):
            raise ValueError(f"payload of {headers['warc-record-id']} does not fit its digest")
    return (
        page_number(headers["warc-record-id"]),
        size,
        digest,
        kind,
        page_number(headers.get("warc-refers-to")),
    )


FETCHED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FETCHED = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())


def fetch(located: DataFrame, folder: str) -> DataFrame:
    """Read the located records by byte range; neighbours in an archive come with one read."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for batch in batches:
            rows, found, file, opened = list(_rows([batch])), [], None, None
            at = 0
            while at < len(rows):
                path, begin, size = rows[at]
                last, end = at + 1, begin + size
                while last < len(rows) and rows[last][0] == path:
                    if rows[last][1] - end > GAP or rows[last][1] + rows[last][2] - begin > SPAN:
                        break
                    end = max(end, rows[last][1] + rows[last][2])
                    last += 1
                if path != opened:
                    file, opened = system.open_input_file(path), path
                file.seek(begin)
                data = file.read(end - begin)
                for _, start, length in rows[at:last]:
                    found.append(read_record(data[start - begin : start - begin + length]))
                at = last
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i, kind in enumerate(_FETCHED)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return (
        located.repartitionByRange("path", "begin")
        .sortWithinPartitions("path", "begin")
        .mapInArrow(load, FETCHED)
    )


def archive_pages(
    pages: DataFrame,
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST_SHARED,
    folder: str | None = None,
) -> tuple[str, DataFrame, list[tuple]]:
    """Write ``pages`` and their index; returns the folder, the archives and the top of the index."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    archives = write_archives(with_revisits(pages, page, url, html, least), folder)
    return folder, archives, write_index(read_captures(archives, folder), folder)


def look_up(
    wanted: DataFrame,
    folder: str,
    top: list[tuple],
    page: str = "page_id",
    url: str = "url",
    complete: bool = False,
) -> DataFrame:
    """The records of the wanted (id, url) rows: id, payload length and digest, type, referred id.

    Rows without a capture give nothing, or an error with ``complete``.
    """
    keyed = wanted.select(url_key(F.col(url)).alias("key"), F.col(page).alias("id"))
    return fetch(locate(keyed, top, folder, complete), folder)
