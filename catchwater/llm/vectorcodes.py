"""Vector code compression: vectors as one byte for each quarter, by codebooks of integers.

Components become integers, so distances are exact and the result is the same however rows are dealt. A round sends the
codebooks to all tasks; a task finds the nearest entries of a batch by |x|^2 - 2 x.c + |c|^2 with integer matrix products
and adds up the parts of each entry; a shuffle grouped by part and entry merges the sums. What meets on the driver is a
row for each entry: PARTS * ENTRIES at most, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import spread, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 512  # vectors whose distances a task holds at a time


@dataclass
class Codebooks:
    books: list[np.ndarray]  # for each part, entries x components, int64

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): floor(1024 * x) of each component. Rows whose vector is null or has null or non-finite components are left out; repeated rows stay, other columns are not read.

    Floors past a long are held at its ends, which `matrix` then refuses.
    """
    out = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    sound = F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return out.where(sound).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * F.lit(float(SCALE)))).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column. Other lengths than `width`, and components whose squared distances could pass a long, raise ValueError."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not (np.diff(column.offsets.to_numpy()) == width).all():
        raise ValueError(f"vectors must all have {width} components")
    most = isqrt((2**63 - 1) // (4 * max(width, 1)))
    if len(flat) and (flat.max() > most or flat.min() < -most):
        raise ValueError(f"components must be within {most // SCALE}")
    return flat.astype(np.int64).reshape(len(column), width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first of its nearest entries, and its squared distance; exact."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    k = d.argmin(1)
    return k, d[np.arange(len(x)), k]


def cut(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, cut(matrix(part.column("v"), width))


def sums(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, s0, s1, ...): how many parts each used entry is nearest to, and their componentwise sums."""
    sent, width = kept.sparkSession.sparkContext.broadcast(books.books), books.width
    each = width // PARTS

    def run(batches):
        own = sent.value
        n, s = [np.zeros(len(b), np.int64) for b in own], [np.zeros(b.shape, np.int64) for b in own]
        for _, parts in blocks(batches, width):
            for p, x in enumerate(parts):
                k, _ = nearest(x, own[p])
                order = k.argsort(kind="stable")
                used, first = np.unique(k[order], return_index=True)
                n[p] += np.bincount(k, minlength=len(own[p]))
                s[p][used] += np.add.reduceat(x[order], first, axis=0)
        for p in range(PARTS):
            (used,) = n[p].nonzero()
            cols = [np.full(len(used), p, np.int32), used.astype(np.int32), n[p][used], *s[p][used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    names = ["part", "entry", "n", *[f"s{i}" for i in range(each)]]
    some = kept.select("v").mapInArrow(run, "part int, entry int, " + ", ".join(f"{c} long" for c in names[2:]))
    return some.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[2:]])


def fit(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of the rows of `integers`, which are read once a round (pass a written table). None without rows.

    They start as the parts of the rows with the smallest ids, repeated rows each for itself, null ids last, equal ids in the order of their
    vectors. An entry that is nearest to nothing stays as it is. Fewer rows than entries give smaller codebooks.
    """
    first = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return None
    if len({len(v) for v in first}) > 1 or len(first[0]) % PARTS:
        raise ValueError(f"vectors must have one length that {PARTS} divides")
    books = Codebooks([b.copy() for b in cut(np.array(first, np.int64).reshape(len(first), -1))])
    for _ in range(rounds):
        for r in sums(kept, books).toLocalIterator():
            part, entry, n, *s = r
            books.books[part][entry] = [int(x) // int(n) for x in s]  # whole numbers, so // is the floor
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) for the rows of `integers`: a byte of `code` in hex for each part, and the squared distance to what it stands for."""
    sent, width = kept.sparkSession.sparkContext.broadcast(books.books), books.width
    kinds = dict(kept.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"

    def run(batches):
        own = sent.value
        for batch, parts in blocks(batches, width):
            found = [nearest(x, own[p]) for p, x in enumerate(parts)]
            text = np.column_stack([k for k, _ in found]).astype(np.uint8).tobytes().hex()
            step = 2 * PARTS
            code = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with `vector`: what each code stands for, in the units of the vectors that were compressed."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in row]) for row in b.tolist()]) for b in books.books])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.element_at(F.element_at(entries, p + 1), at(p) + 1) for p in range(PARTS)]))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row with a sound vector: see `integers` and `fit`.

    label_error: the errors of all rows of the label added up, null labels as one. Repeated rows stay repeated, an empty table gives no rows.
    """
    kept = written(integers(df, id_col, vec_col, label_col), "integers")
    books = fit(kept)
    if books is None:
        kind = dict(kept.dtypes)["vec_id"]
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    codes = written(encode(kept, books).withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    by_label = codes.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return spread(codes, by_label, "_label").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def compress_sql() -> str:
    """SQL for the rows of op11; doubles hold its whole numbers exactly."""
    dist = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    ctes = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM k, (SELECT unnest(range({PARTS})) AS part))",
        f"b0 AS (SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} AS (SELECT vec_id, p.part, min(struct_pack(d := {dist}, e := entry)) AS m, any_value(x) AS x FROM p JOIN b{r} b ON b.part = p.part GROUP BY vec_id, p.part)")
        if r < ROUNDS:
            ctes.append(f"s{r} AS (SELECT part, m.e AS entry, i, floor(sum(x[i]) / count(*)) AS y FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY part, m.e, i)")
            ctes.append(f"b{r + 1} AS (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, entry, list(y ORDER BY i) AS c FROM s{r} GROUP BY part, entry) n ON n.part = b.part AND n.entry = b.entry)")
    ctes.append(f"f AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT f.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN k ON k.vec_id = f.vec_id CROSS JOIN h"
