"""WARC: a Python data source that reads and writes archives, and records made of a table of pages.

An archive holds a gzip member for each record (or plain records), and beside it lies an index of the places of its
records. The reader plans partitions as byte ranges without opening a file; a task looks up the records of its range in
the index. Filters on record_type, target_uri, record_id, refers_to, content_type, payload_digest and payload_bytes are
pushed down and tested on the header, of which no more than its own bytes are inflated; the payload of a record that fails
them, or of any record if `payload` isn't asked for, is passed over by a seek. An archive from elsewhere, without an
index, is one partition, and is read from its start.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from catchwater.llm.common import scratch, small_batches, spread, written

#: Payloads of so many bytes and more are written once; the others repeat.
REVISIT_BYTES = 1000
SPLIT = 64 << 20  # bytes of a partition of an indexed archive
SENT = 8 << 20  # bytes of a list of revisits up to which it is sent to all tasks; beyond, it is joined by a shuffle
STEP = 1 << 10  # bytes that are read and inflated at a time in search of a header's end
INDEX = ".offsets"  # of an index file: places of records and the end, as 64-bit little-endian numbers
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, content_type string, payload binary"
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "content_type": "content-type"}
# Fixed value: the profile of a revisit of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"  # after each record


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """A record for each page, in the columns of SCHEMA; the payload is null in revisits.

    The payload is the html in UTF-8, a null one is empty. Of equal payloads of `least` bytes and more, that of the
    largest id is the response and the others revisit it. A row whose id is null is a response of its own.
    Rows with one id and one payload are one page: the first is the response, and repeated rows of it too.

    Only ids and digests of large payloads are grouped; pages stay where they are unless the revisits are too many to be sent.
    """
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    page = page.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    large = written(page.where((F.col("size") >= least) & F.col("id").isNotNull()).select("digest", "id"), "large")
    first = written(large.groupBy("digest").agg(F.max("id").alias("original"), F.min("id").alias("other")).where("other < original").select("digest", "original"), "first")
    again = written(spread(large, first, "digest").where("id < original").select("id", "digest", "original").distinct(), "again")
    again = F.broadcast(again) if again.count() * 64 <= SENT else again.hint("merge")
    page = page.join(again, ["id", "digest"], "left")
    revisit = F.col("original").isNotNull()
    uri = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    return page.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.coalesce(uri(F.col("id")), F.lit("<urn:page:>")).alias("record_id"), F.col("url").alias("target_uri"),
        uri(F.col("original")).alias("refers_to"), F.col("digest").alias("payload_digest"), F.col("size").alias("payload_bytes"), F.lit("text/html; charset=utf-8").alias("content_type"), F.when(~revisit, F.col("html")).alias("payload"),
    )


def store_of(path: str):
    """(file system, path in it, what stands before that) of a local or shared path, or of a store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: -len(inner)] if path.endswith(inner) else ""


def record_bytes(row: dict) -> bytes:
    """A record as it stands in an archive; header values are put on one line, and only those that are there."""
    lines, payload = ["WARC/1.1"], row["payload"] or b""
    clean = lambda v: " ".join(str(v).splitlines())
    named = (("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", PROFILE if row["record_type"] == "revisit" else None), ("WARC-Payload-Digest", row["payload_digest"] and "sha1:" + row["payload_digest"]), ("X-Payload-Length", row["payload_bytes"]), ("Content-Type", row["content_type"]), ("Content-Length", len(payload)))
    lines += [f"{name}: {clean(value)}" for name, value in named if value is not None]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "replace") + payload + END


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes an archive and its index in a folder for what is not yet committed; the commit moves them, so that lost and repeated tasks leave nothing."""

    def __init__(self, options: dict):
        self.path, self.gzip = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip"

    def write(self, iterator) -> Written:
        store, root, _ = store_of(self.path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        offsets = [0]
        with store.open_output_stream(f"{root}/_temporary/{name}", compression=None) as out:
            for batch in iterator:
                for k in range(0, batch.num_rows, 64):
                    for row in batch.slice(k, 64).to_pylist():
                        data = record_bytes(row)
                        if self.gzip:
                            z = zlib.compressobj(6, zlib.DEFLATED, 31)
                            data = z.compress(data) + z.flush()
                        out.write(data)
                        offsets.append(offsets[-1] + len(data))
        with store.open_output_stream(f"{root}/_temporary/{name}{INDEX}", compression=None) as out:
            out.write(np.array(offsets, "<i8").tobytes())
        return Written([name, name + INDEX])

    def commit(self, messages) -> None:
        store, root, _ = store_of(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        self.clean(store, root)

    def abort(self, messages) -> None:
        store, root, _ = store_of(self.path)
        self.clean(store, root)

    def clean(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")


def write(recs: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives with their indexes in a folder, one of each task. compression: gzip, a member for each record, or none."""
    small_batches(recs.sparkSession)
    recs.sparkSession.dataSource.register(WarcSource)
    recs.write.format("warc").mode("append").option("compression", compression).save(path)


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        return self.stream.seek(offset, whence)

    def tell(self):
        return self.stream.tell()

    def readinto(self, b):
        data = self.stream.read(len(b))
        b[: len(data)] = data
        return len(data)


class _Gunzip(io.RawIOBase):
    """One stream over all gzip members of a file."""

    def __init__(self, stream):
        self.stream, self.z, self.held = stream, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, b):
        while True:
            if self.z.eof:
                self.held = self.z.unused_data or self.held
                self.z = zlib.decompressobj(31)
            if not self.held:
                self.held = self.stream.read(1 << 16)
                if not self.held:
                    return 0
            out = self.z.decompress(self.held, len(b))
            self.held = self.z.unconsumed_tail
            if out:
                b[: len(out)] = out
                return len(out)


def fields(head: bytes) -> dict[str, str]:
    """The fields of a header, names in lower case. head: its lines, from the version on."""
    lines = head.split(b"\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {head[:40]!r}")
    out, last = {}, ""
    for line in lines[1:]:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif text:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def next_header(f) -> bytes | None:
    """The lines of the next record's header, without the empty one after them; None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    lines = []
    while line not in (b"\r\n", b"\n", b""):
        lines.append(line)
        line = f.readline()
    return b"".join(lines)


class Span(InputPartition):
    def __init__(self, path: str, start: int = 0, stop: int | None = None, indexed: bool = False):
        self.path, self.start, self.stop, self.indexed = path, start, stop, indexed


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split", SPLIT))
        self.tests: list = []
        self.inflated = 0  # bytes that came out of decompression

    def pushFilters(self, filters):
        known = (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, IsNotNull)
        for f in filters:
            if isinstance(f, known) and len(f.attribute) == 1 and (f.attribute[0] in HEADER_OF or f.attribute[0] in ("payload_bytes", "payload_digest")):
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, inner, head = store_of(self.path)
        info = store.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
        names = {f.path for f in files} if info.type != fs.FileType.File else {inner, *([inner + INDEX] if store.get_file_info(inner + INDEX).type == fs.FileType.File else [])}
        spans: list[Span] = []
        for f in sorted(files, key=lambda f: f.path):
            hidden = any(part[:1] in ("_", ".") for part in f.path[len(inner) :].split("/"))
            if f.type != fs.FileType.File or hidden or not f.size or f.path.endswith(INDEX):
                continue
            if f.path + INDEX not in names:
                spans.append(Span(head + f.path))
                continue
            cuts = [*range(0, f.size, self.split), f.size]
            spans += [Span(head + f.path, a, b, True) for a, b in zip(cuts, cuts[1:])]
        return spans or [Span("")]

    def _row(self, h: dict[str, str]) -> dict:
        size = h.get("x-payload-length") or h.get("content-length") or "0"
        digest = h.get("warc-payload-digest")
        return {c: h.get(n) for c, n in HEADER_OF.items()} | {"payload_bytes": int(size), "payload_digest": digest.removeprefix("sha1:") if digest else None}

    def _passes(self, row: dict) -> bool:
        for t in self.tests:
            v = row[t.attribute[0]]
            if isinstance(t, EqualNullSafe):
                ok = v == t.value
            elif v is None:
                ok = False
            elif isinstance(t, IsNotNull):
                ok = True
            elif isinstance(t, In):
                ok = v in t.value
            elif isinstance(t, StringStartsWith):
                ok = v.startswith(t.value)
            else:
                ok = v == t.value if isinstance(t, EqualTo) else v > t.value if isinstance(t, GreaterThan) else v >= t.value if isinstance(t, GreaterThanOrEqual) else v < t.value if isinstance(t, LessThan) else v <= t.value
            if not ok:
                return False
        return True

    def _out(self, row: dict, block: bytes | None) -> tuple:
        return row["record_type"], row["record_id"], row["target_uri"], row["refers_to"], row["payload_digest"], row["payload_bytes"], row["content_type"], block

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.path:
            return
        store, inner, _ = store_of(span.path)
        gz = inner.endswith(".gz")
        with store.open_input_file(inner) as stream:
            if not span.indexed:
                yield from self._in_order(io.BufferedReader(_Gunzip(stream) if gz else _Raw(stream), 1 << 18), gz)
                return
            with store.open_input_file(inner + INDEX) as index:
                offsets = np.frombuffer(index.read(), "<i8")
            f = io.BufferedReader(_Raw(stream), 1 << 16)
            lo, hi = np.searchsorted(offsets[:-1], (span.start, span.stop))
            for at, end in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist()):
                f.seek(at)
                got = self._member(f, end - at) if gz else self._plain(f)
                if got:
                    yield got

    def _member(self, f, size: int) -> tuple | None:
        """The record of one gzip member: a step at a time up to its header's end, and the rest only if it is wanted."""
        z, data, taken = zlib.decompressobj(31), b"", 0
        while (stop := data.find(END)) < 0 and taken < size:
            held = f.read(min(STEP, size - taken))
            taken += len(held)
            while held and data.find(END) < 0:
                data += z.decompress(held, STEP)
                held = z.unconsumed_tail
            tail = held
        self.inflated += len(data)
        h = fields(data[:stop])
        row = self._row(h)
        if not self._passes(row):
            return None
        if not self.payload:
            return self._out(row, None)
        length = int(h.get("content-length") or 0)
        rest = z.decompress(tail + f.read(size - taken)) + z.flush()
        self.inflated += len(rest)
        return self._out(row, (data[stop + len(END) :] + rest)[:length])

    def _plain(self, f) -> tuple | None:
        h = fields(next_header(f) or b"")
        row = self._row(h)
        if self._passes(row):
            return self._out(row, f.read(int(h.get("content-length") or 0)) if self.payload else None)
        return None

    def _in_order(self, f, gz: bool) -> Iterator[tuple]:
        """All records of an archive without an index; unwanted payloads are passed over by a seek, or inflated piece by piece and forgotten."""
        while (head := next_header(f)) is not None:
            h = fields(head)
            length, row = int(h.get("content-length") or 0), self._row(h)
            wanted = self._passes(row)
            block = f.read(length) if wanted and self.payload else None
            if block is None and gz:
                while length > 0:
                    length -= len(f.read(min(length, 1 << 16))) or length
            elif block is None:
                f.seek(length, 1)
            if wanted:
                yield self._out(row, block)


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(path), and df.write.format("warc") of the same columns."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives of a folder, or of one file. Filters reach the reader because its session setting is turned on here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "<urn:page:(-?[0-9]*)>", 1).try_cast("bigint")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "gzip") -> DataFrame:
    """Writes a record for each page and reads the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Responses are read with their payloads, whose length and digest are taken; of revisits only headers are read. Repeated
    rows stay repeated, null ids too, an empty table gives no rows, other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(records(pages, id_col, url_col, html_col), path, compression)
    own = [page_of(F.col("record_id")).alias("page_id")]
    stored = read(spark, path).where("record_type = 'response'").select(*own, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    again = read(spark, path, payload=False).where("record_type = 'revisit'").select(*own, "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
    return stored.union(again)


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
