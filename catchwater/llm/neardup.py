"""Near duplicates by HyperMinHash.

A document's shingle hashes fall into REGISTERS buckets; a register keeps the smallest of its bucket as a
leading-zero count and mantissa bits. An empty bucket is filled by a hash of its own over all shingles, so
small sets have full sketches. Bands of registers give candidates, the collision-corrected estimate drops
hopeless ones, and full sets confirm the rest.

Equal sets are one class from the start; only class representatives are compared. A band bucket of up to
SMALL representatives gives its pairs. Members of larger buckets form regions; a region is dealt into blocks, and each
pair of blocks is compared in a task of its own, which returns a spanning forest of its links, not the links. In buckets
of more than a block, members are first compared with the bucket's hubs, and buckets that this leaves with one component are
settled. Members of one component are not compared again. No bucket is capped.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import dropped, map_rows, per_row, small_batches, spread, written

WORDS, SIMILAR = 5, 75  # words of a shingle; percent of the union from which sets are linked
REGISTERS, ROWS = 384, 6  # 64 bands: a pair of exactly 0.75 meets in none with probability 4e-6, one of 0.8 with 3e-9
MANTISSA = 10
HOPEFUL = 0.62  # estimate from which full sets are compared: 0.75 less 5.9 standard deviations
SMALL = 32  # representatives of a bucket that gives its pairs
BLOCK, BLOCK_CHARS = 1024, 4 << 20  # representatives and characters of a region's block
MEMO, REMEMBERED = 200_000, 64  # words that a worker remembers, and the characters of the longest
SENT = 8 << 20  # bytes of a list of ids or buckets up to which it is sent to all tasks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
_words: dict[str, int] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


ODD = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def fill(v: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least of the hashes of v, for each of these registers by a hash of its own: mixed(v * ODD) but for the last step, which leaves the upper bits."""
    h = v[None, :] * ODD[own][:, None]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h.min(1)


def shingles(text: str | None) -> np.ndarray:
    """The set, as ascending 64-bit hashes. Fewer words than a shingle: the whole sequence as one. No word: empty."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    hashed = []
    for w in words:
        if (h := _words.get(w)) is None:
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            if len(w) <= REMEMBERED:
                _words[w] = h
        hashed.append(h)
    h = np.array(hashed, np.uint64)
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(len(h), WORDS)):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    v = mixed(s + np.uint64(0x632BE59BD9B4E019))
    at = ((s >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(v)[::-1]
    least[at[order]] = v[order]
    full = np.zeros(REGISTERS, bool)
    full[at] = True
    empty = np.flatnonzero(~full)
    step = max(1, (1 << 15) // len(s))
    for k in range(0, len(empty), step):
        own = empty[k : k + step]
        least[own] = fill(v, own)
    bits = np.maximum(least, 1).astype(np.float64).view(np.uint64)
    zeros = np.uint64(1023 + 64) - (bits >> np.uint64(52))
    return ((zeros << np.uint64(MANTISSA)) | ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def chance(n: int, m: int) -> float:
    """Expected share of equal registers of two disjoint sets of these sizes: both minima fall into one cell of zeros and mantissa.

    A cell of the level with z zeros is 2^-(z+1+MANTISSA) wide; the minimum of k uniform values has density k(1-x)^(k-1).
    """
    a, b = max(1.0, n / REGISTERS), max(1.0, m / REGISTERS)
    x = 2.0 ** -np.arange(1, 40)
    return float(np.minimum(1, a * b * (1 - x) ** (a + b - 2) * x * x / 2**MANTISSA).sum())


def estimate(equal: np.ndarray | float, n: int, m: int) -> np.ndarray | float:
    """Jaccard estimate from the share of equal registers, less what chance makes equal."""
    c = chance(n, m)
    return (equal - c) / (1 - c)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < SIMILAR * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * common >= SIMILAR * (len(a) + len(b) - common)


@lru_cache(64)
def _short_set(text: str) -> np.ndarray:
    return shingles(text)


def _set_of(text: str) -> np.ndarray:
    return _short_set(text) if len(text) <= 1 << 16 else shingles(text)


def sets(df: DataFrame) -> DataFrame:
    """(id, text_key, n_shingles, set_key, registers) from (id, text_key, text); set_key: the digest of the set. The last two are null where it is empty."""

    def row(i, key, text):
        s = shingles(text)
        return (i, key, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s).tobytes()) if len(s) else (i, key, 0, None, None)

    return map_rows(df, per_row(lambda: row), "id long, text_key long, n_shingles long, set_key binary, registers binary", rows=1024)


def bands(sk: DataFrame) -> DataFrame:
    """(id, band): a 64-bit hash of each band of registers and its number."""
    one = F.expr(f"transform(sequence(0, {REGISTERS // ROWS - 1}), k -> xxhash64(k, substring(registers, {2 * ROWS} * k + 1, {2 * ROWS})))")
    return sk.select("id", F.explode(one).alias("band"))


def sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked to be sent to all tasks if it has at most SENT bytes; else it is joined by a shuffle. df: a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= SENT else df.hint("merge")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. pairs: written; docs: (id, text, registers). First the estimate, then full sets."""
    side = lambda k: docs.select(F.col("id").alias(k), F.struct("text", "registers").alias(f"d{k}"))

    def each():
        def run(rows):
            for a, b, x, y in rows:
                equal = float((np.frombuffer(x["registers"], np.uint16) == np.frombuffer(y["registers"], np.uint16)).mean())
                if equal < HOPEFUL - 0.05:
                    continue
                s, t = _set_of(x["text"]), _set_of(y["text"])
                if estimate(equal, len(s), len(t)) >= HOPEFUL and linked(s, t):
                    yield a, b

        return run

    one = spread(pairs, side("a"), "a")
    both = spread(one, side("b"), "b", counted=pairs, by="a")
    return map_rows(both.select("a", "b", "da", "db"), each, "a long, b long")


def block_links(ids: list[int], texts: list[str], registers: np.ndarray, roots: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between components of the left and the right block, or within the only one."""
    own: dict[int, np.ndarray] = {}

    def set_of(k: int) -> np.ndarray:
        if k not in own:
            own[k] = shingles(texts[k])
        return own[k]

    at, found = np.unique(roots, return_inverse=True)[1], []
    left, other = np.flatnonzero(~right), np.flatnonzero(~right if same else right)
    for x in left:
        todo = other[other > x] if same else other
        todo = todo[at[todo] != at[x]]
        if not len(todo):
            continue
        equal = (registers[todo] == registers[x]).mean(1)
        hit = equal >= HOPEFUL
        for y in todo[hit][np.argsort(-equal[hit])]:
            if at[x] != at[y] and linked(set_of(x), set_of(y)):
                at[at == at[y]] = at[x]
                found.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
    return found


def region_links(rest: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components of a region. rest: (id, root, region), written; docs: (id, text, registers)."""
    long = rest.join(docs.select("id", F.length("text").alias("chars")), "id")
    sized = written(long.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks")), "regions")
    at = spread(rest.select("region", "id", "root"), sized, "region").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = at.select("region", "id", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("id", "root", "region", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).alias("right"))

    def f(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        same = bool((pdf["lo"] == pdf["hi"]).all())
        right = np.zeros(len(pdf), bool) if same else pdf["right"].to_numpy(bool)
        links = block_links(pdf["id"].tolist(), pdf["text"].tolist(), np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(len(pdf), -1), pdf["root"].to_numpy(), right, same)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.join(docs, "id").groupBy("region", "lo", "hi").applyInPandas(f, "a long, b long")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, root), written: the smallest id that reaches it. Alternates large-star and small-star steps; each round is written to the shared folder, and the one before is dropped."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(spread(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large, low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = written(small, name)
        dropped(e, large)
        e = new
        if new.join(new.select(F.col("u").alias("x")).distinct(), F.col("v") == F.col("x"), "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            break
    out = written(e.select(F.col("u").alias("id"), F.col("v").alias("root")), f"{name}-roots")
    dropped(e)
    return out


def survey(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_shingles, set_key, component) of every row: what `find` and the choice of one row of a class are made of. text_key: a 64-bit hash of the text."""
    spark = df.sparkSession
    small_batches(spark)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    keyed = written(sets(base), "sets")
    named = keyed.where("set_key IS NOT NULL AND id IS NOT NULL")
    classes = written(named.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    copies = written(spread(named.select("set_key", "id"), classes.where("n > 1").select("set_key", "rep"), "set_key").where("id != rep").select("id", "set_key").distinct(), "copies")
    sk = named.select("id", "set_key", "registers").join(sent(copies, 24), ["id", "set_key"], "left_anti")
    member = bands(sk)
    buckets = written(member.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b"), "buckets")
    wide = written(buckets.where("n > 2").select("band", "n", F.col("a").alias("hub")), "wide")
    shared = written(member.join(sent(wide, 24), "band"), "shared")
    few = shared.where(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    of_few = few.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.b", "p.a")
    large = shared.where(F.col("n") > SMALL)
    to_hubs = large.where(F.col("n") > BLOCK).groupBy("id").agg(F.min("hub").alias("x"), F.max("hub").alias("y")).select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("x", "y"))).alias("b")).where("a != b")
    near = written(buckets.where("n = 2").select(F.col("b").alias("a"), F.col("a").alias("b")).union(of_few.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(to_hubs).distinct(), "pairs")
    used = written(near.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct(), "used")
    some = sent(used, 8)
    docs = base.where("text IS NOT NULL").join(some, "id", "left_semi").dropDuplicates(["id", "text_key"])
    drawn = named.select("id", "text_key", "registers").join(some, "id", "left_semi").dropDuplicates(["id", "text_key"])
    docs = written(docs.join(drawn, ["id", "text_key"]).select("id", "text", "registers"), "candidates")
    links = written(confirm(near, docs), "links")
    twice = named.groupBy("id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x != y").select("id")
    same_id = keyed.join(twice, "id", "left_semi").join(classes, "set_key").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.union(same_id))
    if not large.isEmpty():
        at = written(large.select("id", "band").join(roots, "id", "left").select("id", "band", F.coalesce("root", "id").alias("root")), "rooted")
        mixed_bands = at.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("id").alias("first")).where("lo != hi")
        rest = written(spread(at, mixed_bands.select("band", "first"), "band").select("id", "root", "first"), "rest")
        if not rest.isEmpty():
            region = components(rest.select(F.col("id").alias("a"), F.col("first").alias("b")), "region")
            members = written(rest.select("id", "root").distinct().join(region.withColumnRenamed("root", "region"), "id", "left").withColumn("region", F.coalesce("region", "id")), "members")
            more = region_links(members, docs.select("id", "text", "registers"))
            roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more), "cc2")
    final = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    cols = ["id", "text_key", "n_shingles", "set_key"]
    out = spread(keyed.where("set_key IS NOT NULL").select(*cols), final, "set_key", "left")
    out = written(out.select(*cols, "component").union(keyed.where("set_key IS NULL").select(*cols, F.col("id").alias("component"))), "components")
    dropped(keyed, classes, copies, buckets, wide, shared, near, used, docs, links)
    return out


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Null and empty texts, and texts without words, have the empty set and are linked with nothing. A row with a
    null id takes part in its class but can't be its smallest id: it has the component of its class, or null,
    and isn't kept. Rows of one id with different texts are linked through that id, and have the links of each text. Repeated rows stay repeated,
    an empty table gives no rows. Ids are long. Other columns are not read.
    """
    out = survey(df, id_col, text_col).withColumnRenamed("component", "component_id")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of df, with all its columns: of rows with its smallest id (a null one only where there is no other) the one of the least text hash.

    Rows without words are no class, and all stay. Of repeated rows of a class one stays.
    """
    rows = survey(df, id_col, text_col)
    worded = rows.where("set_key IS NOT NULL").withColumn("class", F.coalesce(F.col("component").cast("string"), F.hex("set_key")))
    least = F.min(F.struct(F.when(F.col("id") == F.col("component"), 0).otherwise(1).alias("other"), "id", "text_key"))
    chosen = worded.groupBy("class").agg(least.alias("c")).select("c.id", "c.text_key")
    chosen = written(worded.select("id", "text_key").join(chosen, worded.id.eqNullSafe(chosen.id) & (worded.text_key == chosen.text_key), "left_semi").groupBy("id", "text_key").agg(F.count("*").alias("n")), "chosen")
    gone = written(worded.select("id", "text_key").distinct().exceptAll(chosen.select("id", "text_key")), "gone")
    cols = [F.col(f"d.`{c}`") for c in df.columns]
    docs = df.withColumns({"_id": F.col(id_col).cast("long"), "_key": F.xxhash64(text_col)})
    same = lambda t: F.col("d._id").eqNullSafe(F.col(f"{t}.id")) & (F.col("d._key") == F.col(f"{t}.text_key"))
    left = docs.alias("d").join(sent(gone, 16).alias("g"), same("g"), "left_anti")
    again = written(chosen.where("n > 1").select("id", "text_key"), "again")
    if again.isEmpty():
        return left.select(*cols)
    more = sent(again, 16).alias("r")
    once = left.join(more, same("r"), "left_anti").select(*cols)
    row = F.struct(*[F.col(f"d.`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
    picked = left.join(more, same("r"), "left_semi").groupBy("d._id", "d._key").agg(F.min_by(row, F.xxhash64(*cols)).alias("row"))
    return once.union(picked.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns)]))


FIND_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.c + q.c - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.id)
SELECT id AS doc_id, coalesce(any_value(c), 0) AS n_shingles, min(root) AS component_id, id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY id
"""
