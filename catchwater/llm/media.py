"""Media columns: payloads kept as content-defined chunks.

A medium is a grey-scale image file (binary PGM: a short header, then 8-bit samples). Its bytes are cut where a
rolling gear hash says so, chunks are named by their digests, each digest is stored once, and a medium is an
ordered list of digests. Reading back puts the list together again and holds it against the medium's digest.

Equal payloads are one medium. The bytes of a chunk move only where a medium borrows it from another: a medium
keeps the chunks that it owns beside its list, so most are read back where they are stored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import map_rows, per_row, small_batches, spread, written

WIDTH, FRAME = 24, 576  # samples of a row and of a frame
LEAST, MOST = 2048, 32768  # bytes of a chunk
MASK = np.uint32(0xFFF00000)  # 12 bits: a cut every 4096 bytes or so past the least
GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, 256, dtype=np.uint32)
LEVEL = 12  # of zstandard, for stored chunks
SENT = 8 << 20  # bytes of borrow lists up to which they are sent to all tasks; beyond, they are joined by a shuffle


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * ((-len(data)) % FRAME or (0 if data else FRAME))


def medium_of(payload: bytes) -> bytes:
    return b"P5 %d %d 255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples_of(medium: bytes) -> bytes:
    head, _, rest = medium.partition(b"\n")
    kind, width, height, most = head.split()
    if kind != b"P5" or most != b"255" or len(rest) != int(width) * int(height):
        raise ValueError("not a grey-scale medium")
    return rest


def cuts(data: bytes) -> list[int]:
    """Ends of chunks. The gear hash of the last 32 bytes is built by doubling, for all places at once."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    out, start, n = [], 0, len(data)
    for c in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while c - start > MOST:
            start += MOST
            out.append(start)
        if c - start >= LEAST:
            start = c
            out.append(c)
    while n - start > MOST:
        start += MOST
        out.append(start)
    if start < n or not out:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def name_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature_of(samples: bytes) -> str:
    """Mean sample and a 64-bit gradient hash: the samples, averaged to 8 rows of 9, each held against its right neighbour."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    edges = (np.arange(73) * len(x)) // 72
    sums = np.add.reduceat(x, edges[:-1]) / np.diff(edges)
    bits = np.packbits((sums.reshape(8, 9)[:, 1:] > sums.reshape(8, 9)[:, :-1]).ravel())
    return f"{x.mean():.3f}:{bits.tobytes().hex()}"


def manifests(base: DataFrame) -> DataFrame:
    """(id, key, n_bytes, medium, list) from (id, key, text): a medium's digest and the digests of its chunks."""

    def row(i, key, text):
        data = medium_of(payload_of(text))
        return i, key, len((text or "").encode("utf-8", "surrogatepass")), hashlib.sha256(data).digest(), [name_of(c) for c in chunks(data)]

    return map_rows(base, per_row(lambda: row), "id long, key binary, n_bytes long, medium binary, list array<binary>")


def store(base: DataFrame, odd: DataFrame) -> DataFrame:
    """(medium, list, own array<struct<seq,data>>, borrows): a row for each medium, with the chunks it owns.

    odd: (id, key, keep, lent): rows whose medium another row keeps, and keepers some of whose chunks others own. It is
    sent to all tasks if it has at most SENT bytes, else joined by a shuffle.
    """
    size = odd.select(F.sum(F.lit(128) + 4 * F.size("lent"))).first()[0] or 0
    joined = base.join(F.broadcast(odd) if size <= SENT else odd.hint("merge"), ["id", "key"], "left")
    kept = joined.where(F.coalesce("keep", F.lit(True))).select("text", F.coalesce("lent", F.array().cast("array<int>")).alias("lent"))

    def each():
        press = zstandard.ZstdCompressor(level=LEVEL)

        def row(text, lent):
            data = medium_of(payload_of(text))
            parts, away = chunks(data), {*lent}
            own = [(k, press.compress(c)) for k, c in enumerate(parts) if k not in away]
            return hashlib.sha256(data).digest(), [name_of(c) for c in parts], own, bool(away)

        return row

    return map_rows(kept, per_row(each), "medium binary, list array<binary>, own array<struct<seq:int,data:binary>>, borrows boolean", rows=128)


def read_back(stored: DataFrame) -> DataFrame:
    """(medium, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each stored medium, checked against its digests."""

    def each():
        press = zstandard.ZstdDecompressor()

        def row(medium, names, own, got):
            parts = {c["seq"]: press.decompress(c["data"]) for c in [*own, *(got or ())]}
            data = b"".join(parts[k] for k in range(len(names)))
            if hashlib.sha256(data).digest() != medium:
                raise ValueError(f"medium {medium.hex()} does not match its digest")
            samples = samples_of(data)
            return medium, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), medium.hex(), feature_of(samples)

        return row

    schema = "medium binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    whole = stored.where("NOT borrows").select("medium", "list", "own", F.lit(None).cast("array<struct<seq:int,data:binary>>").alias("got"))
    lent = stored.where("borrows")
    places = lent.select("medium", F.col("own.seq").alias("has"), F.posexplode("list").alias("seq", "name")).where(~F.array_contains("has", F.col("seq"))).select("name", "medium", "seq")
    places = written(places, "asked-places")
    asked = written(places.select("name").distinct(), "asked")
    asked = F.broadcast(asked) if asked.count() * 64 <= SENT else asked.hint("merge")
    lenders = stored.select(F.explode("own").alias("o"), "list").select(F.element_at("list", F.col("o.seq") + 1).alias("name"), F.col("o.data").alias("data")).join(asked, "name", "left_semi").dropDuplicates(["name"])
    fetched = spread(places, lenders, "name").groupBy("medium").agg(F.collect_list(F.struct("seq", "data")).alias("got"))
    return map_rows(whole.unionByName(lent.join(fetched, "medium").select("medium", "list", "own", "got")), per_row(each), schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as a medium and reads it back: id, n_bytes and what read_back gives, a row for each row.

    Null and empty texts are one frame of bytes 255. A medium is kept by the row of the smallest id that has it, a null id
    being the smallest; ids are long. Repeated rows stay repeated. Other columns are not read.
    """
    small_batches(df.sparkSession, 500)
    none = F.lit(-(1 << 63))
    base = df.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"), F.col(text_col).alias("text"))
    listed = written(manifests(base), "manifests")
    keeper = listed.groupBy("medium").agg(F.min("id").alias("keeper"), F.first("key").alias("key"), F.first("list").alias("list"), F.count("*").alias("n"))
    kept = keeper.select(F.col("keeper").alias("id"), "key", "medium")
    placed = written(keeper.select("medium", F.posexplode("list").alias("seq", "name")), "places")
    owner = placed.groupBy("name").agg(F.min(F.struct("medium", "seq")).alias("o"), F.count("*").alias("n")).where("n > 1")
    lent = spread(placed.select("name", "medium", "seq"), owner, "name").where("o.medium != medium OR o.seq != seq").groupBy("medium").agg(F.collect_list("seq").alias("lent")).withColumn("keep", F.lit(True)).join(kept, "medium")
    copies = spread(listed.select("medium", "id", "key"), keeper.where("n > 1").select("medium", "keeper"), "medium").where("id != keeper").select("id", "key").distinct()
    odd = written(lent.select("id", "key", "keep", "lent").union(copies.select("id", "key", F.lit(False), F.array().cast("array<int>"))), "odd")
    stored = written(store(base, odd), "chunks")
    back = read_back(stored).dropDuplicates(["medium"])
    out = spread(listed.select("medium", "id", "n_bytes"), back, "medium")
    return out.select(F.when(F.col("id") != none, F.col("id")).alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
