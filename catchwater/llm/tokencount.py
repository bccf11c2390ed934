"""Token counts by a compiled finite-state transducer.

In a merge tokenizer whose last symbol of a word is marked, the tokens of a prefix of a word are known up to
its end, and a longer prefix changes only tokens that its last symbols reach into. So a state needs no more than
the last token at each place from which a vocabulary entry can still be growing. States are interned as
they are first reached; a transition holds the next state and the change of the number of tokens.

A transition picks the one token that ends here and that is compatible with the token before it: two tokens are
compatible if the merges give just them for their joined symbols.

A text is a sequence of chunks, and a chunk is a map from states to (state, count). Chunks of a text are cut inside words, at every SPAN-th of
them: a chunk's head ends the word that its left neighbour has begun, so its map is over the states that can be reached there. Maps are
made for each chunk alone and composed by a parallel prefix scan, whose last map, from the start state, has the text's count; the
others have the counts up to their cuts. What a whole word inside a chunk adds is remembered, since after each word only the
start state can be reached. A word over CHUNK symbols is cut the same way: each of its chunks is run from every state
that can be reached at its cut, whatever comes before it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import map_rows, per_row, small_batches

FINAL = 256  # added to a byte that ends a word
MEMO = 300_000  # words that a worker remembers
TABLE = 1_000_000  # transitions that a worker holds before it compiles anew
CHUNK = 64  # symbols of a chunk of a long word, and the longest word that is remembered
SPAN = 128  # words of a chunk of a text
BLOCK = 1024  # chunks that are composed at once, so that a word of any length takes bounded memory
LONG = 1 << 20  # characters from which the words of a text are not listed but passed one by one


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 for itself, others from 256 on in order."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


class Merges:
    """Tokens are numbers; below 512 they are symbols (bytes, and bytes that end a word)."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        byte = byte_names()
        ids = {c: b for c, b in byte.items()} | {c + suffix: b + FINAL for c, b in byte.items()}
        self.symbols: list[tuple[int, ...]] = [(k,) for k in range(2 * FINAL)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y = ids[a], ids[b]
            if (ab := a + b) not in ids:
                ids[ab] = len(self.symbols)
                self.symbols.append(self.symbols[x] + self.symbols[y])
            self.rank.setdefault((x, y), (r, ids[ab]))

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain merging, lowest rank and leftmost first; for compiling and for tests."""
        at, end = [*symbols], [*range(1, len(symbols) + 1)]
        prev, n = [*range(-1, len(symbols) - 1)], len(symbols)
        heap = [(*p, i, i + 1) for i in range(n - 1) if (p := self.rank.get((at[i], at[i + 1])))]
        heap = [(r, i, j, t, at[i], at[j]) for r, t, i, j in heap]
        heapify(heap)
        while heap:
            _, i, j, t, x, y = heappop(heap)
            if at[i] != x or end[i] != j or at[j] != y:
                continue
            at[i], end[i], at[j] = t, end[j], -1
            if (k := end[i]) < n:
                prev[k] = i
                if p := self.rank.get((t, at[k])):
                    heappush(heap, (p[0], i, k, p[1], t, at[k]))
            if (k := prev[i]) >= 0 and (p := self.rank.get((at[k], t))):
                heappush(heap, (p[0], k, i, p[1], at[k], t))
        out, i = [], 0
        while i < n:
            out.append(at[i])
            i = end[i]
        return out


class Transducer:
    START = 0

    def __init__(self, merges: Merges):
        self.merges, self.pairs = merges, {}
        self.child: list[dict[int, int]] = [{}]  # trie of the vocabulary
        self.token: list[int] = [-1]
        for t, symbols in enumerate(merges.symbols):
            if len(symbols) > 1 and merges.encode(symbols) != [t]:
                continue
            node = 0
            for s in symbols:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][s]
            self.token[node] = t
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, tuple[int, int]] = {}
        self.keys: list[tuple] = [((0, -1, 0),)]  # of a state: (trie node, token before it, tokens since) for each open place
        self.ids = {self.keys[0]: 0}
        self.pairs.clear()

    def state(self, key: tuple) -> int:
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
        return to

    def trimmed(self, state: int) -> int:
        """The state, after a new start where there are too many transitions."""
        if len(self.edges) <= TABLE:
            return state
        key = self.keys[state]
        self.clear()
        return self.state(key)

    def fits(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (ok := self.pairs.get((a, b))) is None:
            ok = self.pairs[a, b] = self.merges.encode(self.merges.symbols[a] + self.merges.symbols[b]) == [a, b]
        return ok

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Adds the transition: (next state, change of the count)."""
        moved = [(c, before, since) for node, before, since in self.keys[state] if (c := self.child[node].get(symbol)) is not None]
        last, delta = next((self.token[c], 1 - since) for c, before, since in moved if self.token[c] >= 0 and self.fits(before, self.token[c]))
        key = (*((c, before, since + delta) for c, before, since in moved if self.child[c]), (0, last, 0))
        to = self.state(key)
        self.edges[state << 9 | symbol] = to, delta
        return to, delta

    def run(self, state: int, symbols) -> tuple[int, int]:
        edges, total = self.edges, 0
        for s in symbols:
            state, d = edges.get(state << 9 | s) or self.compile(state, s)
            total += d
        return state, total

    def word(self, data: bytes) -> int:
        """Tokens of a word that is not empty."""
        if len(data) <= CHUNK:
            return self.run(self.START, [*data[:-1], data[-1] + FINAL])[1]
        state, total = self.START, 0
        for k in range(0, len(data), BLOCK * CHUNK):
            state = self.trimmed(state)
            part = data[k : k + BLOCK * CHUNK]
            chunks = [(part[j : j + CHUNK], k + j + CHUNK >= len(data)) for j in range(0, len(part), CHUNK)]
            state, n = scan(chunk_maps(self, chunks, state))[state]
            total += n
        return total


Map = dict  # entry state: (exit state, tokens)


def chunk_maps(machine: Transducer, chunks: list[tuple[bytes, bool]], entry: int) -> list[Map]:
    """The map of each chunk over the states that can be reached at its cut. A chunk: (bytes, whether it ends the word).

    Each chunk is first run from the start state, without what stands before it. What its left neighbour's map can lead
    to is then added to its own domain, in all chunks at once, until nothing is new; since a state forgets what lies
    further back than the longest token, that takes few rounds. Equal chunks share one map.
    """
    shared: dict[tuple[bytes, bool], Map] = {}
    maps = [shared.setdefault(c, {}) for c in chunks]
    new = [{entry if k == 0 else machine.START} for k in range(len(chunks))]
    while any(new):
        found: list[set[int]] = [set() for _ in chunks]
        for k, (data, last) in enumerate(chunks):
            todo = new[k].difference(maps[k])
            if todo:
                symbols = [*data[:-1], data[-1] + FINAL] if last else data
                for state in todo:
                    maps[k][state] = machine.run(state, symbols)
            if k + 1 < len(chunks):
                found[k + 1] = {to for to, _ in maps[k].values()}.difference(maps[k + 1])
        new = found
    return maps


def composed(first: Map, then: Map) -> Map:
    return {state: (then[mid][0], n + then[mid][1]) for state, (mid, n) in first.items()}


def prefixes(maps: list[Map]) -> list[Map]:
    """The maps of the first chunk, the first two, and so on, by a scan of a logarithmic number of levels: on each, every map is composed with the one `step` before it, all of them independently."""
    step = 1
    while step < len(maps):
        maps = [composed(maps[k - step], m) if k >= step else m for k, m in enumerate(maps)]
        step *= 2
    return maps


def scan(maps: list[Map]) -> Map:
    """The map of all chunks one after the other: neighbours are composed in pairs, on a level all of them independently, until one is left."""
    while len(maps) > 1:
        maps = [composed(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0]


class Counter:
    """Counts as the tokenizers library does for a lower-casing word BPE file."""

    # Fixed value: the file's split pattern.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # Letters and numbers that are younger than the library's tables, so that it takes them for neither,
    # and capitals that it lowers but that are younger than Python's tables: (first, last, step to the small letter).
    YOUNG = (
        "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
        "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
        "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
        "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
        "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
        "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
        "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
        "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
    )
    CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, model = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split != self.SPLIT or model["type"] != "BPE":
            raise ValueError(f"{path}: only NFC, white space, lower case and {self.SPLIT} are compiled")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(Merges(merges, model["end_of_word_suffix"] or ""))
        self.usual = regex.compile(split)
        young = self.YOUNG
        self.young = regex.compile(f"[{young}]").search
        self.rare = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{young}]]+|[\p{{N}}--[{young}]]|[[^\s\p{{L}}\p{{N}}]||[{young}]]+")
        self.lower = {c: c + step for a, b, step in self.CAPITALS for c in range(a, b + 1)}
        self.capital = regex.compile(f"[{''.join(map(chr, self.lower))}]").search
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo: dict[str, int] = {}

    def words(self, text: str):
        split = self.usual
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.capital(text):
                text = text.translate(self.lower)
        text = text.lower()
        if not text.isascii() and self.young(text):
            split = self.rare
        return split.findall(text) if len(text) < LONG else (m[0] for m in split.finditer(text))

    def whole(self, words: list[str]) -> int:
        """Tokens of words, each from the start state to the start state."""
        memo, total = self.memo, 0
        for w in words:
            if (n := memo.get(w)) is None:
                n = self.machine.word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= CHUNK:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = n
            total += n
        return total

    def maps(self, words: Iterator[str]) -> Iterator[Map]:
        """A map for each chunk of a text. States are given by their keys, which stay valid when the machine starts anew."""
        machine, start = self.machine, ((0, -1, 0),)
        entry, head, later = start, b"", [*islice(words, SPAN)]
        while True:
            here, later = later, [*islice(words, SPAN)]
            n = 0
            if head:  # the rest of a word that the chunk before has begun
                n += machine.run(machine.state(entry), [*head[:-1], head[-1] + FINAL])[1]
            cut = here[-1].encode("utf-8", "surrogatepass") if later else b""
            n += self.whole(here[:-1] if later else here)
            tail = cut[: min(len(cut) // 2, CHUNK)]
            if len(cut) > 2 * CHUNK:  # such a word has chunks of its own
                n, tail, cut = n + machine.word(cut), b"", b""
            state, more = machine.run(machine.START, tail)
            exit = machine.keys[state]
            yield {entry: (exit, n + more)}
            if not later:
                return
            entry, head = exit, cut[len(tail) :]

    def plain(self, text: str) -> int:
        """The count of a text without special strings, through the maps of its chunks, BLOCK of them at a time."""
        maps, state, total = self.maps(iter(self.words(text))), ((0, -1, 0),), 0
        while part := [*islice(maps, BLOCK)]:
            self.machine.trimmed(self.machine.START)
            state, n = scan(part)[state]
            total += n
        return total

    def cuts(self, text: str) -> list[int]:
        """The tokens of a text without special strings up to the cut behind each of its chunks; the last is its count. A token that a cut goes through counts where it ends."""
        return [m[((0, -1, 0),)][1] for m in prefixes([*self.maps(iter(self.words(text)))])]

    def __call__(self, text: str | None) -> int:
        """Special strings inside a text are one token each, as the library has it by default."""
        if not text:
            return 0
        if self.special and "<|" in text and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


@lru_cache(2)
def load(path: str) -> Counter:
    return Counter(path)


def count(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of whole texts, a row for each row. Null and empty texts: zeros. Other columns are not read."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def each():
        counter = load(path)

        def row(i, text):
            n = counter(text)
            return i, len((text or "").encode("utf-8", "surrogatepass")), n, n > limit

        return row

    return map_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_row(each), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", rows=4096)
