"""Packing: documents as token sequences of one length with next to no padding.

A document's ids end with an id of their own. As many whole sequences as it fills are cut from it where it is read; its rest goes to a
group that is drawn at random. In a group the rests are packed first-fit decreasing: a tournament tree of what bins have
left finds the first bin with room in logarithmic time. Gaps that remain are then filled by cuts of what lies in the last
bins, and the last bin is cut to sequences of powers of two tokens, which need no padding either. A group holds GROUP rests
on average, each shorter than a sequence, so it fits a task whatever the documents' lengths are.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import parsed, small_batches, written
from catchwater.llm.tokencount import Counter

LENGTH, GROUP = 4096, 4096  # tokens of a sequence; rests of a group, on average
END = 2  # id after each document
MEMO, REMEMBERED, STRETCH = 300_000, 64, 1 << 22  # pieces that a worker still remembers when it has met twice as many; bytes of the longest; bytes that are cut to pieces at a time
CALL = 1 << 19  # bytes that the library gets at a time
RUN = 1 << 24  # bytes of the texts whose ids are held at once, if more than one
MARKS = b".,;:!?$&*#%)"  # marks that no rule joins to letters or numbers
WORD = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch  # small letters, each one code point and composed
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
BLANK, MARK, ALNUM = 1, 2, 3  # kinds of bytes; others are 0


def kinds_of(marks: set[int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[*b"\t\n\v\f\r "]] = BLANK
    out[[c for c in range(128) if chr(c).isalnum()]] = ALNUM
    out[[*marks]] = MARK
    return out


def spans(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of data that begin at `first`, one after the other."""
    return data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of items that hold `most` in all, but for what their last item has beyond."""
    far = np.cumsum([0, *sizes])
    cuts = [0, *(np.flatnonzero(np.diff(far[:-1] // most)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


class Words:
    """ids of texts by the tokenizers library. Its pre-tokens hold no white space, and none holds a letter or number beside one of MARKS, so what stands between such places is
    encoded apart, once for all texts that hold it. Of pieces without combining marks, capitals A-Z are made small first, as the library would.

    Texts are cut as bytes, many at a time; Arrow finds the different pieces, and only these are looked up. New ones are encoded together: words of small Latin-1 letters with blanks
    between them, for each gives one token that ends a word, and the rules that leave such words as they are stay out; other pieces with a special token between
    them, which the library never joins to anything. What a worker has not met for longest it forgets.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        added = self.lib.get_added_tokens_decoder()
        special = {t.content: i for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.between, self.mark = next(iter(special.items()), (None, -1))
        self.added = re.compile(b"|".join(re.escape(t.content.encode().lower()) for t in added.values()) or b"(?!)")
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        #: Whether the rules are those that pieces and words stand for; else nothing but white space cuts, and the library gets each piece as it is.
        self.usual = kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": Counter.SPLIT} and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self.kinds = kinds_of({*MARKS}.difference(*(t.content.encode() for t in added.values())) if self.usual else set())
        self.bare = Tokenizer(self.lib.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[bytes, int] = {}  # number of a piece
        self.first, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))  # by number: where its ids are, how many, when it was last met
        self.store, self.now = np.zeros(0, np.int32), 0

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text."""
        flat, ends = self.column(pa.array(texts, pa.string()))
        return np.split(flat, ends)[:-1]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each end; a null is empty."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = texts.fill_null("").cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        out, ends, a, n = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), 0, 0
        while a < len(data):
            b = self.stop(data, at, a)
            here = slice(np.searchsorted(at[1:], a, "right"), np.searchsorted(at[1:], b, "right"))
            found, far = self.stretch(data[a:b], at[1:][here] - a)
            ends[here] = n + far
            out.append(found)
            n += len(found)
            a = b
        return np.concatenate(out), ends

    def stop(self, data: np.ndarray, at: np.ndarray, a: int) -> int:
        """The first end of a text or blank from STRETCH bytes after a on."""
        b = a + STRETCH
        if b >= len(data):
            return len(data)
        end = int(at[np.searchsorted(at, b)])
        for k in range(b, end, STRETCH):
            blank = self.kinds[data[k : min(end, k + STRETCH)]] == BLANK
            if blank.any():
                return k + int(blank.argmax())
        return end

    def stretch(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole words that lie side by side, and how many there are up to each of ends, where texts end."""
        if self.usual:
            data = self.lowered(data, ends)
        kind = self.kinds[data]
        blank, mark, letter = kind == BLANK, kind == MARK, kind == ALNUM
        latin = letter.copy()  # also the last bytes of Latin-1 letters
        latin[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begins = ~blank
        begins[1:] &= blank[:-1] | mark[1:] & latin[:-1] | letter[1:] & mark[:-1]
        edge = ends[ends < len(data)]
        begins[edge] = ~blank[edge]
        places, kept = np.flatnonzero(begins), ~blank
        at = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(at), pa.py_buffer(data[kept])]).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in names if p not in self.memo]
        before, filled = len(self.first), len(self.store)
        if new:  # long ones last, which are forgotten at once
            long = [p for p in new if len(p) > REMEMBERED]
            if long:
                new = [p for p in new if len(p) <= REMEMBERED]
            self.learn(new)
            before, filled = len(self.first), len(self.store)
            self.learn(long)
        number = np.fromiter(map(self.memo.__getitem__, names), np.int64, len(names))
        self.now += 1
        self.met[number] = self.now
        each = number[pieces.indices.to_numpy()]
        size = self.size[each]
        far = np.append(0, np.cumsum(size))[np.searchsorted(places, ends)]
        out = spans(self.store, self.first[each], size)
        if before < len(self.first):
            for p in long:
                del self.memo[p]
            self.first, self.size, self.met, self.store = self.first[:before], self.size[:before], self.met[:before], self.store[:filled]
        if before > 2 * MEMO:
            self.forget()
        return out, far

    def lowered(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """With small letters for A-Z, but for texts with combining marks that might join one (a capital has others than its small letter) or with what would become an added token."""
        small = SMALL[data]
        odd = [*np.flatnonzero(data & 0xFE == 0xCC).tolist(), *(m.start() for m in self.added.finditer(small))]
        if odd:
            whole = np.zeros(len(ends) + 1, bool)
            whole[np.searchsorted(ends, odd, "right")] = True
            rows = np.repeat(whole, np.diff(np.concatenate([[0], ends, [len(data)]])))
            small[rows] = data[rows]
        return small

    def learn(self, pieces: list[bytes]) -> None:
        if not pieces:
            return
        texts = [p.decode() for p in pieces]
        if not (self.usual and self.between):
            words, rest, odd = [], [], [*range(len(texts))]
        else:
            words, rest, odd = [], [], []
            for k, t in enumerate(texts):
                (words if WORD(t) else odd if self.between in t else rest).append(k)
        ids, sizes = [], []
        for kind, f in ((words, self.spaced), (rest, self.marked), (odd, self.alone)):
            for a, b in runs([len(pieces[i]) for i in kind], CALL):
                found, size = f([texts[i] for i in kind[a:b]])
                ids.append(found)
                sizes.append(size)
        n, size = len(self.first), np.concatenate(sizes)
        self.memo.update((pieces[i], n + j) for j, i in enumerate(words + rest + odd))
        self.first = np.append(self.first, len(self.store) + np.cumsum(size) - size)
        self.size, self.met = np.append(self.size, size), np.append(self.met, np.zeros(len(size), np.int64))
        self.store = np.concatenate([self.store, *ids])

    def forget(self) -> None:
        """All but the MEMO pieces that were met last."""
        keep = np.sort(np.argpartition(-self.met, MEMO)[:MEMO])
        names = [*self.memo]
        self.memo = {names[k]: j for j, k in enumerate(keep.tolist())}
        size = self.size[keep]
        self.store = spans(self.store, self.first[keep], size)
        self.first, self.size, self.met = np.cumsum(size) - size, size, self.met[keep]

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and how many each has; so do the next two."""
        found = [np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.array([*map(len, found)], np.int64)

    def joined(self, lib, texts: list[str], between: str) -> np.ndarray:
        parts = [between.join(texts[k : k + 512]) for k in range(0, len(texts), 512)]
        found = [np.array(e.ids, np.int32) for e in lib.encode_batch_fast(parts, add_special_tokens=False)]
        end = np.array([self.mark] * (between == self.between), np.int32)
        return np.concatenate([x for f in found for x in (f, end)])

    def marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.joined(self.lib, texts, self.between)
        cuts = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(cuts, prepend=-1) - 1

    def spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.joined(self.bare, texts, " ")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(texts) else self.alone(texts)  # a vocabulary that doesn't mark ends


@lru_cache(2)
def load(path: str) -> Words:
    """Once a worker, which has one core: the library starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Words(path)


def crc(ids: np.ndarray) -> int:
    """Of the ids as unsigned 32-bit little-endian numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class Bins:
    """A tournament tree: each node holds the most that a bin under it has left."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Puts size into the first bin that has room for it, of which there must be one."""
        most, k = self.most, 1
        while k < self.leaves:
            k *= 2
            if most[k] < size:
                k += 1
        most[k] -= size
        found, k = k - self.leaves, k // 2
        while k:
            m = max(most[2 * k], most[2 * k + 1])
            if most[k] == m:
                break
            most[k] = m
            k //= 2
        return found


def first_fit(sizes: np.ndarray, room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length): the items in decreasing order, each in the first bin that has room; none is longer than a bin."""
    tree, bins = Bins(len(sizes), room), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = tree.put(size)
        if k == len(bins):
            bins.append([])
        bins[k].append((i, 0, size))
    return bins


def filled(bins: list[list[tuple[int, int, int]]], room: int) -> list[list[tuple[int, int, int]]]:
    """The same items in bins of which all but one are full: the gaps of the first take from the last, whole pieces if they fit and else cuts."""
    bins = [b[:] for b in bins]
    first = 0
    gap = [room - sum(p[2] for p in b) for b in bins]
    while first < len(bins) - 1:
        if not gap[first]:
            first += 1
            continue
        item, start, length = bins[-1].pop()
        take = min(length, gap[first])
        bins[first].append((item, start, take))
        gap[first] -= take
        if take < length:
            bins[-1].append((item, start + take, length - take))
        if not bins[-1]:
            bins.pop()
            gap.pop()
    return bins


def powers(pieces: list[tuple[int, int, int]], room: int) -> list[list[tuple[int, int, int]]]:
    """A bin that isn't full, cut into bins of powers of two, the largest first."""
    left, out = sum(p[2] for p in pieces), []
    todo = pieces[::-1]
    while left:
        size = room if left >= room else 1 << (left.bit_length() - 1)
        left -= size
        out.append([])
        while size:
            item, start, length = todo.pop()
            take = min(length, size)
            out[-1].append((item, start, take))
            size -= take
            if take < length:
                todo.append((item, start + take, length - take))
    return out


def packed(sizes: np.ndarray, room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) that hold each item once and whole and are full or a power of two long."""
    bins = filled(first_fit(sizes, room), room)
    return bins[:-1] + powers(bins[-1], room) if bins else []


def tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, doc_tokens, start, ids, ids_crc32): the ids of each row and END, cut at multiples of `length`. The last piece of a document, if shorter, has no checksum yet.

    ids: bytes of little-endian numbers, two bytes each if all ids of the vocabulary are below 65,536, else four; `numbers` reads them.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        width = 2 if len(words.ends) <= 1 << 16 else 4
        for batch in batches:
            for a, b in runs(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), RUN):
                flat, ends = words.column(batch.column(1).slice(a, b - a))
                flat = np.insert(flat, ends, END)
                total = np.diff(ends, prepend=0) + 1
                parts = -(-total // length)
                doc = np.repeat(np.arange(b - a), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                size = np.minimum(total[doc] - start, length)
                at = np.append(0, np.cumsum(size))
                sums = [crc(flat[x:y]) if y - x == length else None for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                held = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at * width), pa.py_buffer(flat.astype(f"<u{width}"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(total[doc]), pa.array(start), held, pa.array(sums, pa.int64())], ["doc_id", "doc_tokens", "start", "ids", "ids_crc32"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, parsed(f"`doc_id` {kind}, doc_tokens long, start long, ids binary, ids_crc32 long"))


def numbers(held: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """The n ids in all that a column of `tokens` holds."""
    data = b"".join(held.to_pylist())
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.zeros(0, "<u2")


def listed(df: DataFrame) -> DataFrame:
    """Pieces with ids as arrays instead of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.append(0, np.cumsum(batch.column("length").to_numpy()))
            ids = numbers(batch.column("ids"), int(at[-1])).astype(np.int32)
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)))

    return df.mapInArrow(run, parsed(", ".join(f"`{c}` {'array<int>' if c == 'ids' else kind}" for c, kind in df.dtypes)))


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `ids` the ids), a row for each piece.

    length: of a sequence, a power of two. Sequences are full, but for those of a power of two that the last bin of a group is cut to. Null and empty
    texts are documents of one id, END; repeated rows and null ids are documents of their own, whatever the share of one id;
    an empty table gives no rows; other columns are not read. Texts are tokenized once; their ids are written as bytes to the shared folder, from which
    whole sequences are read as they are and rests are shuffled to their groups. Ids of sequences from groups are not negative, the others are.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    kind = df.schema[id_col].dataType.simpleString()
    cut = written(tokens(df, path, id_col, text_col, length), "tokens").withColumn("_at", F.monotonically_increasing_id())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids]
    whole = cut.where("ids_crc32 IS NOT NULL").withColumns({"length": F.lit(length).cast("long"), "sequence_id": -F.col("_at") - 1, "offset": F.lit(0).cast("long")}).select(names)
    whole = listed(whole) if ids else whole
    rest = cut.where("ids_crc32 IS NULL").drop("ids_crc32")
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at").combine_chunks()
        head = table.column("_group")[0].as_py() << 20
        at = np.append(0, np.cumsum(table.column("doc_tokens").to_numpy() - table.column("start").to_numpy()))
        flat = numbers(table.column("ids"), int(at[-1]))
        item, start, size, sequence, offset, sums = [], [], [], [], [], []
        for s, pieces in enumerate(packed(np.diff(at), length)):
            far = 0
            for i, a, n in pieces:
                item.append(i)
                start.append(a)
                size.append(n)
                sequence.append(head + s)
                offset.append(far)
                sums.append(crc(flat[at[i] + a : at[i] + a + n]))
                far += n
        item = np.array(item, np.int64)
        own = table.select(["doc_id", "doc_tokens", "start"]).take(pa.array(item))
        cols = {"doc_id": own.column("doc_id"), "start": pa.array(own.column("start").to_numpy() + start), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": own.column("doc_tokens"), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
        if ids:
            first = at[item] + start
            cols["ids"] = pa.array([flat[a : a + n].astype(np.int32) for a, n in zip(first.tolist(), size)], pa.list_(pa.int32()))
        return pa.table(cols)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    return whole.union(rest.groupBy("_group").applyInArrow(run, schema).select(names))


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids, documents): the pieces of `pack` put together, padded unless a power of two long. documents: where each piece begins and what it is of."""
    one = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    room = F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, 0).otherwise(length - F.col("n_tokens"))
    ids = F.concat(F.flatten(F.col("p.ids")), F.array_repeat(F.lit(pad), room.cast("int")))
    return one.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("documents"))
