"""Vector codes, alignment and packing against brute force and the libraries, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib
from math import floor

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catchwater.llm import align, packing, queries, vectorcodes
from catchwater.llm.common import table

SF = "/root/testdata/sf0.001"
BYTE, PIECE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
TEXTS = ["", None, "a", " a", "a ", "a  b", "one two  three\n\n four\tfive", "x▁y", "<0x0A> <s> </s> <unk> <|endoftext|> <|startoftext|>", "naïve Σας ΑΣ ŸÅ İstanbul", "日本語 テキスト", "e ́ ǟ", " nb sp   x", "don't DON'T we'll 1234 a1b2", "\x00\x1c\x85 z", "🙂🙂 👩‍👩‍👧", "word " * 300, "é" * 700, "\n", "tail \n"]
ROWS = [(i, t, "en", i) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "en", 6), (None, "null id", None, None)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, key string, ids long")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, ids long")


def made(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "B", "é", " ", " ", "  ", "\n", "'s", "1", "ß", "x", "y", "́", "<|endoftext|>", "字", "　", "Σ", ".", "-", *["▁"] * (r.random() < 0.05)]) for _ in range(r.randrange(60))) for _ in range(n)]


# 11: vector codes
def brute_codes(rows, rounds=4, entries=256):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and abs(x) < float("inf") for x in r[1])), key=lambda r: r[0])
    m = len(kept[0][1]) // 4
    parts = {r[0]: [[floor(1024 * x) for x in r[1]][p * m : (p + 1) * m] for p in range(4)] for r in kept}
    books = [[parts[r[0]][p] for r in kept[:entries]] for p in range(4)]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e))
    for _ in range(rounds):
        got = collections.defaultdict(list)
        for ps in parts.values():
            for p in range(4):
                got[p, near(p, ps[p])].append(ps[p])
        for (p, e), xs in got.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = {}, collections.Counter()
    for i, _, label in kept:
        ks = [near(p, parts[i][p]) for p in range(4)]
        out[i] = "".join(f"{k:02x}" for k in ks), sum(dist(parts[i][p], books[p][ks[p]]) for p in range(4))
        by[label] += out[i][1]
    return {(i, *out[i], by[label], digest) for i, _, label in kept}


@pytest.mark.parametrize("n", [3, 300, 700])
def test_codes_equal_brute_force(spark, n):
    r = random.Random(n)
    rows = [(i * 7 % 1009, [r.choice([-0.5, 0.25, r.uniform(-3, 3)]) for _ in range(8)], r.choice([None, 1, 2, 2, 2])) for i in range(n)]
    rows += [(2000, None, 1), (2001, [None] + [0.0] * 7, 1), (2002, [float("nan")] + [0.0] * 7, 1), (2003, [float("-inf")] + [0.0] * 7, None), (2004, rows[0][1], 2)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    got = vectorcodes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert {tuple(x) for x in got.collect()} == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vectorcodes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    same = spark.createDataFrame([(1, [0.0] * 4, None), (1, [0.0] * 4, None), (None, [1.0] * 4, "a")], schema)
    assert sorted(map(str, (tuple(r)[:4] for r in vectorcodes.compress(same).collect()))) == sorted(map(str, [(1, "00000000", 0, 0), (1, "00000000", 0, 0), (None, "02020202", 0, 0)]))
    for bad in ([(1, [0.0] * 4, "a"), (2, [0.0] * 8, "a")], [(1, [0.0] * 3, "a")], [(1, [1e12] * 4, "a")]):
        with pytest.raises(Exception, match="component|length"):
            vectorcodes.compress(spark.createDataFrame(bad, schema)).collect()


def test_codes_stand_for_vectors(spark):
    kept = vectorcodes.integers(table(spark, SF, "embeddings"))
    books = vectorcodes.fit(kept, rounds=2)
    rows = vectorcodes.decode(vectorcodes.encode(kept, books), books).join(table(spark, SF, "embeddings").select("vec_id", "embedding"), "vec_id").collect()
    for r in rows:
        x = np.floor(np.array(r["embedding"], float) * 1024)
        assert int(((x - np.array(r["vector"]) * 1024) ** 2).sum()) == r["error"]
    assert len(rows) == 500


# 12: alignment
def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    held = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    letters = {chr(b): b for b in held} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in held)}
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
        pa = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        pb = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p)) and b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if b"".join(pa) != (" " + t).encode() or b"".join(pb) != (" " + t).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in (pa, pb)]
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(ends[0][i] - len(pa[i]), ends[1][j] - len(pb[j])) < min(ends[0][i], ends[1][j])] if len(a) < 1500 else None
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        docs.append((a, b, links, groups))
    held_by = collections.Counter(p for d in docs if d for p in set(d[2]))
    best = collections.Counter()
    for (x, _), n in held_by.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = d
        out.append((len(a), len(b), len(groups), len(links), sum(held_by[p] == best[p[0]] for p in links), sum(held_by[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, held_by


def test_alignment_equals_brute_force(spark, odd, empty):
    texts = [r[1] for r in ROWS] + made(400, 3) + [r["text"] for r in table(spark, SF, "documents").where("length(text) < 2000").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want, held_by = brute_alignment(texts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards of few pairs
    out, known = align.align(df, BYTE, PIECE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["doc_id"]: tuple(r)[1:8] for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) > 5 and len(known.paths) > 1
    assert {((r["a_id"], r["b_id"]), r["n_docs"]) for r in known.table(spark).collect()} == set(held_by.items())
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in out.where("n_a > 0").collect())
    few = align.align(odd, BYTE, PIECE, groups=False)[0]
    assert few.count() == len(ROWS) and few.columns[-1] == "groups_sha256"
    for few in (empty, odd.where("text IS NULL OR text = ''")):
        out, none = align.align(few, BYTE, PIECE)
        assert none.paths == [] and out.where("n_a = 0 AND n_links = 0 AND groups = '' AND groups_sha256 = ''").count() == few.count() == out.count()


def test_alignment_in_stretches(monkeypatch):
    texts = made(300, 5) + ["one two three " * 40]
    whole = align.Aligner(BYTE, PIECE).units(texts)
    monkeypatch.setattr(align, "STRETCH", 20)
    monkeypatch.setattr(align, "MEMO", 50)
    some = align.Aligner(BYTE, PIECE)
    assert [x for k in range(0, len(texts), 10) for x in some.units(texts[k : k + 10])] == whole and len(some.older) > 50


def test_links_as_bytes(spark):
    r = np.random.default_rng(1)
    sizes = [0, 3, 0, 500, 7, 0]
    at = np.r_[0, np.cumsum(sizes)].tolist()
    for top in (60_000, 200_000):  # ids of 16 bits, and of more in some rows
        keys = r.integers(0, top, at[-1]) << 32 | r.integers(0, top, at[-1])
        keys[3:503] &= 0xFFFF_0000_FFFF
        batch = pa.RecordBatch.from_arrays(align.halves(keys, at), names=["low", "high"])
        for lo, hi in ((0, 6), (1, 5), (2, 3), (6, 6)):
            got, places = align.packed_links(batch.slice(lo, hi - lo))
            assert got.tolist() == keys[at[lo] : at[hi]].tolist() and places.tolist() == [x - at[lo] for x in at[lo : hi + 1]]
        assert [len(x) for x in batch.column("high").to_pylist()] == ([0] * 6 if top < 1 << 16 else [0, 12, 0, 0, 28, 0])
    text = "a tokenizer  ≈ two ✓"
    row = align.linked(align.cut(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), BYTE, PIECE)).orderBy("doc_id").collect()
    unit = [np.frombuffer(u[4], np.int64) for u in align.Aligner(BYTE, PIECE).units([text])[0]]
    assert [*zip(row[0]["a"], row[0]["b"])] == [(k >> 32, k & 0xFFFFFFFF) for k in np.concatenate(unit).tolist()] and row[1]["a"] == []


def test_counts_of_many_pairs(spark, monkeypatch):
    r = random.Random(4)
    keys = [r.randrange(50) << 32 | r.randrange(40) for _ in range(5000)]
    found = align.shards(spark.createDataFrame([(k, 2) for k in keys], "key long, n long").repartition(7))
    want = collections.Counter(keys)
    ask = np.unique(np.array(keys + [7, 99 << 32], np.int64))
    assert found.counts(ask).tolist() == [2 * want[k] for k in ask.tolist()]
    assert [int(x) for x in found.best] == [2 * max(n for k, n in want.items() if k >> 32 == a) for a in range(50)]


# 13: packing
def test_words_equal_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORD), packing.Words(WORD)
    texts = [t or "" for t in TEXTS] + made(1500, 6) + [r["text"] for r in table(spark, SF, "documents").collect()]
    for stretch in (1 << 18, 40):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        for k in range(0, len(texts), 50):
            for t, got in zip(texts[k : k + 50], own.ids(texts[k : k + 50])):
                assert got.tolist() == lib.encode(t, add_special_tokens=False).ids, t[:60]


class Asked(dict):
    """Counts look-ups."""

    n = 0

    def __getitem__(self, key):
        Asked.n += 1
        return super().__getitem__(key)


def test_only_different_pieces_are_looked_up():
    own = packing.Words(WORD)
    own.memo, Asked.n = Asked(), 0
    assert {len(x) for x in own.ids(["One two, three. " * 1000] * 10)} == {5000}
    assert Asked.n <= 10


JOINTS = [
    "H\u0331 T\u0308, W\u030a. Y\u030a; J\u030c H\u0331. AB\u0331 İ I\u0307 \u212a \u0344A", "Plain beside.", "<|ENDOFTEXT|> <|EndOfText|>. A<|endoftext|>B. C", "a\vB\fc\u2028D\xa0E\u3000F.\x1cG",
    "foo.bar(Baz)'s x.'s '.s don't. 'RE,a é.É ß!ß ×. ÷. a×.b 5.5% $5,000.00 ½. ²; ,.a,. *a**b*** %a%", "’.a a’. “A,” —B.", "Σ. ΑΣ, слово. Слово,слово 字。字.", "x" * 70 + "." + "Y" * 200, "é" * 40 + ", " + "É" * 40, ".", "\u0301.\u0301a.\u0301",
]


@pytest.mark.parametrize(("stretch", "memo"), [(1 << 22, 300_000), (30, 20), (1, 1)])
def test_words_at_joints(monkeypatch, stretch, memo):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORD), packing.Words(WORD)
    monkeypatch.setattr(packing, "STRETCH", stretch)
    monkeypatch.setattr(packing, "MEMO", memo)
    r = random.Random(9)
    texts = [t or "" for t in TEXTS] + JOINTS + ["".join(r.choice(["a", "B", "é", "É", "'", "s", ".", ",", "*", "5", " ", "\u0331", "h", "H", "<|endoftext|>", "<|EndOfText|>", "’", "×", "\xa0"]) for _ in range(r.randrange(25))) for _ in range(400)]
    for part in (texts, texts[::-1], JOINTS, []):
        assert [x.tolist() for x in own.ids(part)] == [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]
    assert len(own.memo) == len(own.first) <= 2 * memo + len(set(" ".join(texts).split()))
    for kind in (pa.string(), pa.large_string()):
        flat, ends = own.column(pa.array(["cut off", "A b.", None, "", "é", "cut off"], kind).slice(1, 4))
        assert [x.tolist() for x in np.split(flat, ends)] == [*(lib.encode(t, add_special_tokens=False).ids for t in ("A b.", "", "", "é")), []]


def test_words_beside_any_character():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORD), packing.Words(WORD)
    points = [*range(1, 0x500), *range(0x500, 0xD800, 7), *range(0xE000, 0x110000, 61)]
    texts = [f"aB{chr(c)}.C,{chr(c)}5{chr(c)}X" for c in points]
    assert [x.tolist() for x in own.ids(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_words_of_other_rules(tmp_path):
    from tokenizers import Tokenizer, normalizers

    lib = Tokenizer.from_file(WORD)
    lib.normalizer = normalizers.NFC()
    lib.save(str(tmp_path / "own.json"))
    own, texts = packing.Words(str(tmp_path / "own.json")), [t or "" for t in TEXTS] + JOINTS
    texts = [t for t in texts if not re.search(r"[^\S ]", t)]
    assert [x.tolist() for x in own.ids(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_tokens_take_two_bytes(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 100)
    rows = packing.tokens(odd, WORD, length=8).collect()
    assert sum(len(r["ids"]) for r in rows) == 2 * sum(min(8, r["doc_tokens"] - r["start"]) for r in rows)
    assert all(r["ids_crc32"] is None or r["ids_crc32"] == zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_first_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = np.array([r.choice([1, 16, r.randrange(1, 64), r.randrange(1, 17)]) for _ in range(r.choice([0, 1, 2, 300]))], np.int64)
    plain = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, b in enumerate(plain) if sum(sizes[j] for j in b) + sizes[i] <= 64), len(plain))
        plain[k : k + 1] = [[*(plain[k] if k < len(plain) else []), i]]
    assert [[p[0] for p in b] for b in packing.first_fit(sizes, 64)] == plain
    bins = packing.packed(sizes, 64)
    spans = collections.defaultdict(list)
    for b in bins:
        n = sum(p[2] for p in b)
        assert n <= 64 and n & (n - 1) == 0
        for i, a, m in b:
            spans[i].append((a, a + m))
    for i, n in enumerate(sizes.tolist()):
        ends = sorted(spans[i])
        assert ends[0][0] == 0 and ends[-1][1] == n and all(x[1] == y[0] for x, y in zip(ends, ends[1:]))


@pytest.mark.parametrize("group", [4096, 8])
def test_packing(spark, odd, group):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    df = odd.select("doc_id", "text").union(table(spark, SF, "documents").selectExpr("doc_id + 1000", "text")).repartition(4)
    got = packing.pack(df, WORD, length=256, group=group)
    rows = [r.asDict() for r in got.collect()]
    want = collections.Counter((r["doc_id"], tuple([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in df.collect())
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for doc, ids in want:
        if want[doc, ids] == 1:
            got_ids = [x for r in sorted(by_doc[doc], key=lambda r: r["start"]) for x in r["ids"]]
            assert tuple(got_ids) == ids and all(r["doc_tokens"] == len(ids) for r in by_doc[doc])
    assert sum(r["length"] for r in rows) == sum(len(k[1]) * n for k, n in want.items())
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        n = sum(p[1] for p in parts)
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist() and n <= 256 and n & (n - 1) == 0
    whole = packing.sequences(got, 256).collect()
    assert len(whole) == len(by_sequence) and all(len(r["ids"]) == r["n_tokens"] for r in whole)


def test_packing_of_odd_tables(spark, empty):
    assert packing.pack(empty, WORD).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string"), WORD).collect()
    assert sorted((r["length"], r["ids"]) for r in rows) == [(1, [2])] * 3
    with pytest.raises(ValueError, match="power"):
        packing.pack(empty, WORD, length=100)


def test_query_columns(spark):
    assert queries.op13_packing(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert queries.op12_alignment(spark, SF).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
