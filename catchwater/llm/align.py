"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how many documents link each pair of ids.

A byte-level BPE (A) and a sentencepiece model with byte fallback (B) cut one text, " " + text. Where tokens of both end, a group of either
ends. Two tokens are linked if they share a byte. Each stretch between two neighbouring ends, of either kind, lies in one
token of A and one of B, and each linked pair has just one such stretch; so links are read off the merged ends.

Neither cuts across a single blank between two words, so a text is aligned unit by unit and a unit's alignment is remembered. Texts are
tokenized once; their links are written to the shared folder.

Pairs are packed as a * 2^32 + b. A task counts the documents that hold a pair (np.unique over those of its documents), counts are sorted
by ranges over all tasks, runs of one pair are added up, and each range becomes a shard: sorted pairs and their counts in two files
of the shared folder. Lookups map the shards into memory, which the workers of a machine share, and search them. Sent to
all tasks are the list of shards and the highest count of each id of A, bounded by the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from catchwater.llm.common import dropped, packed, parsed, scratch, small_batches, written
from catchwater.llm.warc import store_of

MEMO, REMEMBERED, STRETCH = 60_000, 64, 1 << 18  # units of the newer half of what a worker remembers; characters of the longest; characters of a text that are cut to units at a time
HELD = 1 << 18  # pairs that a task holds before it adds up those it has; distinct ones before it hands them on
#: A blank between two words: neither tokenizer has an entry that crosses it. Python's white space includes that of both.
UNIT = re.compile(r"(?<=\S) (?=\S)")
SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others for the letters from 256 on, in order."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


Unit = tuple[int, int, int, str, bytes]  # tokens of A and of B, groups, the groups as text with a semicolon after each, a packed pair for each link


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        entries = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.names = np.array([[f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b)))] for mark in ",|;"], object)
        self.memo: dict[str, Unit | None] = {}
        self.older: dict[str, Unit | None] = {}

    def aligned(self, units: list[str], together: int = 128) -> list[Unit | None]:
        """Of " " + unit for each unit; None where the bytes of either's tokens aren't those of it.

        Units with no white space at their ends are cut as one text, from which they come apart where they end.
        """
        plain = [k for k, u in enumerate(units) if together > 1 and u == u.strip()]
        held = {*plain}
        parts = [plain[k : k + together] for k in range(0, len(plain), together)] + [[k] for k in range(len(units)) if k not in held]
        texts = [" ".join([units[k] for k in part]) for part in parts]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        out: list[Unit | None] = [None] * len(units)
        good_a, good_b, order = [], [], []
        for part, text, a, b in zip(parts, texts, ids_a, ids_b):
            data = (" " + text).encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data:
                good_a.append(a)
                good_b.append(b)
                order += part
            elif len(part) > 1:
                for k, found in zip(part, self.aligned([units[k] for k in part], 1)):
                    out[k] = found
        for k, found in zip(order, self.merged(good_a, good_b, [1 + len(units[k].encode()) for k in order])):
            out[k] = found
        return out

    def merged(self, ids_a: list[list[int]], ids_b: list[list[int]], sizes: list[int]) -> list[Unit]:
        """The alignments of units of `sizes` bytes that the ids of both spell one after another."""
        if not sizes:
            return []
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        end_a, end_b, last = self.size_a[a].cumsum(), self.size_b[b].cumsum(), np.cumsum(sizes)
        ends = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]]
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        keys = (a[of_a] << SHIFT | b[of_b]).tobytes()
        both = (end_a[of_a] == ends) & (end_b[of_b] == ends)
        closed = np.cumsum(both)  # groups that end up to each stretch
        at_a, at_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        group_a, group_b = (closed - both)[at_a], (closed - both)[at_b]
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = self.names[both[at_a].astype(int), a]
        text[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.names[2 * both[at_b].astype(int), b]
        text = text.tolist()
        stop = np.searchsorted(ends, last) + 1
        out, k, g, i, j = [], 0, 0, 0, 0
        for end, groups, n, m in zip(stop.tolist(), closed[stop - 1].tolist(), np.searchsorted(end_a, last, "right").tolist(), np.searchsorted(end_b, last, "right").tolist()):
            out.append((n - i, m - j, groups - g, "".join(text[i + j : n + m]), keys[8 * k : 8 * end]))
            k, g, i, j = end, groups, n, m
        return out

    def units(self, texts: list[str]) -> list[list[Unit | None]]:
        """The units of each text; a text that has none of its own, null or empty, has no units."""
        cut = [[*pieces(t)] if t else [] for t in texts]
        if len(self.memo) > MEMO:  # what is met again comes back from the older half
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = []
        for u in dict.fromkeys(chain.from_iterable(cut)):
            if u not in memo:
                if u in older:
                    memo[u] = older[u]
                else:
                    new.append(u)
        for k in range(0, len(new), 4096):
            memo.update(zip(new[k : k + 4096], self.aligned(new[k : k + 4096])))
        out = [[*map(memo.__getitem__, c)] for c in cut]
        for u in new:
            if len(u) > REMEMBERED:
                del memo[u]
        return out


def pieces(text: str) -> Iterator[str]:
    """text cut at its UNIT blanks, which are dropped; a stretch of it at a time."""
    at = 0
    while at <= len(text):
        stop = UNIT.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        yield from UNIT.split(text[at : stop.start() if stop else len(text)])
        if not stop:
            return
        at = stop.end()


@lru_cache(2)
def load(path_a: str, path_b: str) -> Aligner:
    """Once a worker."""
    return Aligner(path_a, path_b)


def cut(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, low, high, and with `groups` their text). low and high: the ids of each link of a text, in order, as `halves` has them; `linked` gives them as arrays.

    Null and empty texts, and texts that the tokens of either don't spell, have no tokens: zeros, no links and an empty string.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, low binary, high binary" + ", groups string" * groups

    def run(batches):
        aligner = load(path_a, path_b)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                rows, keys, far = [], [], [0]
                for units in aligner.units(some.column("text").to_pylist()):
                    if not units or None in units:
                        rows.append((0, 0, 0, "", ""))
                    else:
                        n_a, n_b, n, texts, links = zip(*units)
                        text = "".join(texts)[:-1]
                        rows.append((sum(n_a), sum(n_b), sum(n), hashlib.sha256(text.encode()).hexdigest(), text))
                        keys.extend(links)
                    far.append(far[-1] + (rows[-1][0] and sum(map(len, links)) // 8))
                n_a, n_b, n, digest, text = zip(*rows)
                links = halves(np.frombuffer(b"".join(keys), np.int64), far)
                cols = [some.column("id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n)), pa.array(digest, pa.string()), *links, *[pa.array(text, pa.string())] * groups]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def halves(keys: np.ndarray, at: list[int]) -> list[pa.Array]:
    """Packed pairs, those of each row from one place of `at` to the next, as two columns of bytes: the lower 16 bits of a and b by turns, then the upper ones, which are left out of rows that need none.

    A JVM passes bytes on as they are, while arrays cost it several times their size.
    """
    ids = np.stack((keys >> SHIFT, keys & (1 << SHIFT) - 1), 1).astype("<u4").view("<u2")
    low, high = (np.ascontiguousarray(ids[:, k::2]).tobytes() for k in (0, 1))
    cuts = [*zip(at, at[1:])]
    wide = np.r_[0, np.cumsum(ids[:, 1::2].any(1))][at] if len(ids) else np.zeros(len(at), np.int64)
    return [pa.array([low[4 * a : 4 * b] for a, b in cuts], pa.binary()), pa.array([high[4 * a : 4 * b] if n else b"" for (a, b), n in zip(cuts, np.diff(wide).tolist())], pa.binary())]


def packed_links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The packed pairs of all rows, and where each row's begin."""

    def pairs(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(name).cast(pa.large_binary())
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        found = np.frombuffer(data, "<u2", (at[-1] - at[0]) // 2, at[0]) if at[-1] > at[0] else np.empty(0, "<u2")
        return found.reshape(-1, 2), (at - at[0]) // 4

    low, at = pairs("low")
    ids = low.astype(np.int64)
    high, wide = pairs("high")
    for k in np.flatnonzero(np.diff(wide)).tolist():
        ids[at[k] : at[k + 1]] |= high[wide[k] : wide[k + 1]].astype(np.int64) << 16
    return ids[:, 0] << SHIFT | ids[:, 1], at


def linked(links: DataFrame) -> DataFrame:
    """(doc_id, a, b): the ids of each link of a text, in order, as arrays, for the rows of `cut`."""

    def run(batches):
        for batch in batches:
            keys, at = packed_links(batch)
            ids = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(np.int32))) for x in (keys >> SHIFT, keys & (1 << SHIFT) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *ids], names=["doc_id", "a", "b"])

    kind = links.schema["doc_id"].dataType.simpleString()
    return links.select("doc_id", "low", "high").mapInArrow(run, f"doc_id {kind}, a array<int>, b array<int>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n) for the rows of `cut`: how many documents hold each linked pair, a row for each pair and task that has seen it (or several, if it has seen many pairs)."""

    def run(batches):
        load.cache_clear()  # a worker that has aligned texts needs what it remembers no more
        held, size, keys, n = [], 0, np.empty(0, np.int64), np.empty(0, np.int64)

        def merged():
            every = np.concatenate([keys, *held])
            weight = np.concatenate([n, np.ones(len(every) - len(n), np.int64)])
            found, place = np.unique(every, return_inverse=True)
            out = np.zeros(len(found), np.int64)
            np.add.at(out, place, weight)
            return found, out

        for batch in batches:
            key, at = packed_links(batch)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                held.append(np.unique(key[lo:hi]))
                size += len(held[-1])
            if size > HELD:
                (keys, n), held, size = merged(), [], 0
                if len(keys) > HELD:
                    yield from counted(keys, n)
                    keys = n = np.empty(0, np.int64)
        yield from counted(*merged())

    small_batches(links.sparkSession)
    return links.select("low", "high").mapInArrow(run, "key long, n long")


def counted(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], names=["key", "n"])


@dataclass(frozen=True)
class Shards:
    first: list[int]  # the smallest key of each, in order
    paths: list[str]
    best: np.ndarray  # the highest count of each id of A

    def table(self, spark: SparkSession) -> DataFrame:
        """(a_id, b_id, n_docs), a row for each linked pair."""

        def run(batches):
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    keys, n = shard(path)
                    for k in range(0, len(keys), 1 << 16):
                        some = np.asarray(keys[k : k + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array((some >> SHIFT).astype(np.int32)), pa.array((some & (1 << SHIFT) - 1).astype(np.int32)), pa.array(np.asarray(n[k : k + (1 << 16)]))], names=["a_id", "b_id", "n_docs"])

        return spark.createDataFrame([(p,) for p in self.paths], "path string").repartition(max(1, len(self.paths)), "path").mapInArrow(run, "a_id int, b_id int, n_docs long")

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted keys; 0 of those that no document holds."""
        out, cuts = np.zeros(len(keys), np.int64), np.searchsorted(keys, self.first).tolist() + [len(keys)]
        for path, lo, hi in zip(self.paths, cuts, cuts[1:]):
            if lo < hi:
                known, n = shard(path)
                at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
                out[lo:hi] = np.where(known[at] == keys[lo:hi], n[at], 0)
        return out


@lru_cache(4096)
def shard(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts: mapped where the store is a mounted folder; of another store, read."""
    from pyarrow import fs

    store, inner, _ = store_of(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(inner + ".keys", "<i8", "r"), np.memmap(inner + ".counts", "<i8", "r")
    out = []
    for part in (".keys", ".counts"):
        with store.open_input_file(inner + part) as f:
            out.append(np.frombuffer(f.read(), "<i8"))
    return out[0], out[1]


def shards(counts: DataFrame) -> Shards:
    """The sums of the rows (key, n) by key, sorted over all tasks and written a file pair for each range. A task streams its range; of one that is repeated only the files that it reports count."""
    spark = counts.sparkSession
    root = scratch(spark, "pairs")
    kinds = "path string, first long, a array<int>, best array<long>"
    schema = to_arrow_schema(parsed(kinds))

    def run(batches):
        store, inner, _ = store_of(root)
        name, opened, first, size = uuid.uuid4().hex, [], None, 0
        best: dict[int, int] = {}

        def put(keys, n):
            nonlocal first, size
            if not len(keys):
                return
            if first is None:
                store.create_dir(inner, recursive=True)
                opened.extend(store.open_output_stream(f"{inner}/{name}{part}", compression=None) for part in (".keys", ".counts"))
                first = int(keys[0])
            size += len(keys)
            opened[0].write(keys.astype("<i8").tobytes())
            opened[1].write(n.astype("<i8").tobytes())
            ids, at = np.unique(keys >> SHIFT, return_index=True)
            for a, m in zip(ids.tolist(), np.maximum.reduceat(n, at).tolist()):
                best[a] = max(m, best.get(a, 0))

        last_key, last_n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([last_key, batch.column("key").to_numpy()])
            n = np.concatenate([last_n, batch.column("n").to_numpy()])
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, n = keys[at], np.add.reduceat(n, at)
            put(keys[:-1], n[:-1])
            last_key, last_n = keys[-1:], n[-1:]
        put(last_key, last_n)
        for f in opened:
            f.close()
        if first is not None:
            yield packed([(f"{root}/{name}", first, [*best], [*best.values()])], schema)

    found = counts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, kinds).collect()
    found.sort(key=lambda r: r["first"])
    best = np.zeros(1 + max((max(r["a"]) for r in found), default=0), np.int64)
    for r in found:
        np.maximum.at(best, r["a"], r["best"])
    return Shards([r["first"] for r in found], [r["path"] for r in found], best)


def count(links: DataFrame) -> Shards:
    """The counted pairs of the rows of `cut`, which should be a written table."""
    counts = written(pair_counts(links), "counts")
    out = shards(counts)
    dropped(counts)
    return out


def scored(links: DataFrame, known: Shards) -> DataFrame:
    """The rows of `cut` with n_links, n_best and count_sum instead of their links: n_best have the highest count of their id of A, count_sum adds up the counts in `known` of all."""
    sent = links.sparkSession.sparkContext.broadcast(known)
    kept = [c for c in links.columns if c not in ("low", "high")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.select(kept).schema) + ", n_links long, n_best long, count_sum long"

    def run(batches):
        load.cache_clear()
        found = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                every, at = packed_links(some)
                keys, place = np.unique(every, return_inverse=True)
                n = found.counts(keys)[place] if len(keys) else np.empty(0, np.int64)
                best = (n > 0) & (n == found.best[np.minimum(every >> SHIFT, len(found.best) - 1)])
                upto = lambda x: np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][at])
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(np.diff(at)), pa.array(upto(best)), pa.array(upto(n))], names=[*kept, "n_links", "n_best", "count_sum"])

    return links.mapInArrow(run, schema)


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> tuple[DataFrame, Shards]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with `groups` their text) for each row, and the counted pairs.

    Null and empty texts, and texts that the tokens of either don't spell, have no tokens: zeros and an empty string. Repeated rows stay and count
    as documents each, null ids too; an empty table gives no rows; other columns are not read.
    """
    links = written(cut(df, path_a, path_b, id_col, text_col, groups), "links")
    known = count(links)
    out = scored(links, known)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups), known
