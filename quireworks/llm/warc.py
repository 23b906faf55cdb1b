"""WARC archives with a two-level capture index: sorted compressed blocks and a sparse directory of their first keys."""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import join_sized, new_path, prepare, stage

BLOCK_LINES = 3000
NAMESPACE = uuid.UUID("8f0d2a2e-9d53-4a4c-8f5e-2f4d9f0f6a11")


_CONTROLS = re.compile("[\x00-\x20\x7f-\xa0\u2028\u2029]")


def escaped_url(url: str | None) -> str:
    """The URL with control characters, line ends of any kind and blanks percent-encoded, as they end a header or a line."""
    return _CONTROLS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def url_key(url: str | None) -> str:
    """The reversed-host sort key of a URL: com,example,www)/path?query, lower-case host, no scheme, port or fragment."""
    url = escaped_url(url)
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return ")" + url
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + path


def _open(path: str, mode: str):  # noqa: ANN202
    """A file of the shared folder, on any store that Arrow reaches."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(at.rpartition("/")[0], recursive=True)
        return store, at, store.open_output_stream(at, compression=None)
    return store, at, store.open_input_file(at)


def _uri(path: str) -> str:
    """The path as a URI; local ones as file:///..."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith(("/", "file:")) else path


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def build_record(page_id: int | None, url: str, digest: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response or revisit record; a revisit has no payload, and says how long it would be."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {escaped_url(url)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}",
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = [h or "" for h in batch.column("html").to_pylist()]
        digests = [_sha1(h.encode()) for h in html]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(digests, pa.string())], ["page_id", "digest"])


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [_sha1((h or "").encode()) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["page_id", "url", "html", "digest"])


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write one archive per task, in the shared folder; the name holds the attempt, so a repeated task never clashes."""
    context = TaskContext.get()
    path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
    sink, at = None, 0
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "keep")]
        for page_id, url, html, digest, keep in zip(*columns, strict=True):
            if sink is None:
                sink = _open(path, "w")[2]
            revisit = keep is not None and page_id != keep
            raw = build_record(page_id, url or "", digest, (html or "").encode(), keep, revisit)
            sink.write(raw)
            rows.append((url_key(url), page_id, path, at, len(raw)))
            at += len(raw)
        if rows:
            columns = list(zip(*rows, strict=True))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["url_key", "page_id", "file", "at", "length"])
    if sink is not None:
        sink.close()


def _blocks(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """Write this range's sorted captures as compressed blocks of one file; a directory row for each block."""
    context = TaskContext.get()
    path = f"{folder}/cdx-{context.partitionId():06d}-{context.taskAttemptId()}.gz"
    rows = itertools.chain.from_iterable(zip(*[b.column(c).to_pylist() for c in ("url_key", "page_id", "file", "at", "length")], strict=True) for b in batches)
    sink, at = None, 0
    while some := list(itertools.islice(rows, lines)):
        if sink is None:
            sink = _open(path, "w")[2]
        text = "".join("\t".join([k, "" if p is None else str(p), f, str(a), str(n)]) + "\n" for k, p, f, a, n in some)
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw = z.compress(text.encode()) + z.flush()
        sink.write(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array([some[0][0]]), pa.array([some[-1][0]]), pa.array([path]), pa.array([at], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([len(some)], pa.int64())],
            ["first_key", "last_key", "file", "at", "length", "captures"],
        )
        at += len(raw)
    if sink is not None:
        sink.close()


def _block_lines(path: str, at: int, length: int) -> list[list[str]]:
    with _open(path, "r")[2] as source:
        source.seek(at)
        return [line.split("\t") for line in zlib.decompress(source.read(length), 31).decode().split("\n")[:-1]]


CAPTURE = "url_key string, page_id long, file string, at long, length long"


def _capture_batch(columns: list) -> pa.RecordBatch:
    numbers = [pa.array([int(x) if x else None for x in columns[k]], pa.int64()) for k in (1, 3, 4)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), numbers[0], pa.array(columns[2], pa.string()), *numbers[1:]], ["url_key", "page_id", "file", "at", "length"])


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at, length in zip(*[batch.column(c).to_pylist() for c in ("file", "at", "length")], strict=True):
            rows = list(zip(*_block_lines(path, at, length), strict=True))
            yield _capture_batch(rows)


def _keyed(batches: Iterator[pa.RecordBatch], first: list[str], last: list[str]) -> Iterator[pa.RecordBatch]:
    """The key of each URL with every index file that may hold it, by binary search in the files' first and last keys."""
    for batch in batches:
        rows = []
        for url in batch.column("url").to_pylist():
            key = url_key(url)
            rows += [(key, part) for part in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["key", "part"])


WANTED = "key string, file string, at long, length long"


def _directory_search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part, its directory rows (in order) before the wanted keys: each key's blocks, by binary search."""
    held, first, last, rows, closed = None, [], [], [], False
    for batch in batches:
        found = []
        for part, key, last_key, file, at, length in zip(*[batch.column(c).to_pylist() for c in ("part", "key", "last_key", "file", "at", "length")], strict=True):
            if part != held:
                held, first, last, rows = part, [], [], []
            if last_key is not None:
                first.append(key)
                last.append(last_key)
                rows.append((file, at, length))
            else:
                found += [(key, *rows[i]) for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key))]
        if found:
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["key", "file", "at", "length"])


def _block_search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted keys sorted by block: each block is range-read once, and its lines are searched by bisection."""
    held, have, lines = None, [], []
    for batch in batches:
        found = []
        for key, *block in zip(*[batch.column(c).to_pylist() for c in ("key", "file", "at", "length")], strict=True):
            if block != held:
                held, lines = block, _block_lines(*block)
                have = [line[0] for line in lines]
            found += lines[bisect.bisect_left(have, key) : bisect.bisect_right(have, key)]
        if found:
            yield _capture_batch(list(zip(*found, strict=True)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Range reads of records; rows come sorted by file and place, and one file is open at a time."""
    held, source = None, None
    for batch in batches:
        rows = []
        for path, at, length in zip(*[batch.column(c).to_pylist() for c in ("file", "at", "length")], strict=True):
            if path != held:
                if source is not None:
                    source.close()
                held, source = path, _open(path, "r")[2]
            source.seek(at)
            headers, payload = parse_record(source.read(length))
            page = headers["X-Page-ID"]
            kind = headers["WARC-Type"]
            if kind == "revisit":
                size, digest, refers = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Refers-To-Page-ID"])
            else:
                size, digest, refers = len(payload), _sha1(payload), None
            rows.append((int(page) if page else None, headers["WARC-Target-URI"], size, digest, kind, refers))
        if rows:
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    if source is not None:
        source.close()


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Archive:
    """WARC files and their index in one folder: `captures` reads the whole index, `lookup` finds single URLs by it."""

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame):
        self.spark, self.folder, self.directory = spark, folder, directory

    @classmethod
    def write(cls, pages: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES, min_revisit_bytes: int = 0) -> Archive:
        """Archive every row of pages (page_id, url, html).

        Of rows with equal payloads of at least min_revisit_bytes, those with the largest page_id are responses and the
        others revisits that refer to it; smaller payloads are responses.  A null html is an empty payload, a null url an
        empty one.  A null page_id is smaller than any number.  Rows that repeat a page_id get a record each.
        Extra columns are ignored; an empty table gives an empty archive.  Control characters of URLs are percent-encoded.
        """
        spark = pages.sparkSession
        prepare(spark)
        folder = _uri(folder or new_path(spark, "warc"))
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
        digests = rows.select("page_id", "html").mapInArrow(_payload_digests, "page_id long, digest string")
        keep, _ = stage(digests.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
        with_digest = rows.mapInArrow(_with_digest, "page_id long, url string, html string, digest string")
        # pages are only shuffled when there are too many repeated payloads to send to every task
        marked = join_sized(with_digest, keep, "digest", "left", bound=2_000_000)
        marked = marked.withColumn("keep", F.when(F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes, F.col("keep")))
        written, _ = stage(marked.select("page_id", "url", "html", "digest", "keep").mapInArrow(lambda it: _write(it, f"{folder}/archive"), CAPTURE), "captures")
        # small archives get files of 8 blocks; beyond 200 files these grow, up to 512 blocks, and then their number
        n_lines = written.count()
        parts = max(1, min(200, -(-n_lines // (block_lines * 8))), -(-n_lines // (block_lines * 512)))
        ordered = written.repartitionByRange(parts, "url_key", "page_id", "at").sortWithinPartitions("url_key", "page_id", "at")
        directory, _ = stage(
            ordered.mapInArrow(lambda it: _blocks(it, f"{folder}/index", block_lines), "first_key string, last_key string, file string, at long, length long, captures long"),
            "directory",
        )
        return cls(spark, folder, directory)

    def captures(self) -> DataFrame:
        """Every capture of the index, block by block."""
        return self.directory.repartition("file", "at").select("file", "at", "length").mapInArrow(_captures, CAPTURE)

    def records(self, captures: DataFrame | None = None) -> DataFrame:
        """Range-read the captures' records: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
        chosen = self.captures() if captures is None else captures
        # a slice of a file per task: neighbouring records are read in order
        dealt = chosen.select("file", "at", "length").repartition("file", F.floor(F.col("at") / (8 << 20)))
        return dealt.sortWithinPartitions("file", "at").mapInArrow(_read, RECORD)

    def lookup(self, urls: DataFrame | list[str]) -> DataFrame:
        """The captures of URLs (a column `url`, or a list), each once: url_key, page_id, file, at, length.

        A binary search in the index files' first and last keys (one short row per file of up to 512 blocks), one in the
        sorted directory rows of that file, then one range read per block that may hold a wanted key and a binary search
        in its lines.  Null URLs are empty ones, repeated ones count once, unknown ones find nothing.
        """
        if isinstance(urls, list):
            urls = self.spark.createDataFrame([(u,) for u in urls], "url string")
        files = self.directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("first", "last", "file").collect()
        first, last = [f["first"] for f in files], [f["last"] for f in files]
        keys = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(lambda it: _keyed(it, first, last), "key string, part int").distinct()
        number = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f["file"], i)]), F.col("file")) if files else F.lit(0)
        rows = self.directory.select("first_key", "last_key", "file", "at", "length", number.cast("int").alias("part"))
        both = rows.withColumnRenamed("first_key", "key").unionByName(keys, allowMissingColumns=True)
        by_part = both.repartition("part").sortWithinPartitions("part", F.col("last_key").isNull(), "key", "last_key", "at")
        wanted = by_part.select("part", "key", "last_key", "file", "at", "length").mapInArrow(_directory_search, WANTED)
        by_block = wanted.repartition("file", "at").sortWithinPartitions("file", "at", "key")
        return by_block.select("key", "file", "at", "length").mapInArrow(_block_search, CAPTURE)
