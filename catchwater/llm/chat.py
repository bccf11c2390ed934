"""Chat formatting: logged conversations that a longer one continues are dropped, the rest are rendered.

A log often holds a conversation again and again, each time with some more turns. The hash of a turn prefix is the
running sum of hashes of (place, role, text); sums are taken within blocks of turns and then over blocks, so that a
conversation of any length is spread over tasks. Turns of one number are in the order of a digest, by which even a block
of many such turns is cut. Prefix hashes are written once, without texts. A prefix that more conversations have than end
with it is continued by one; an anti-join removes the conversations that are such prefixes; of equal ones the smallest
conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwater.llm.common import dropped, written

BLOCK = 256  # turn numbers of a block of the running sum
MANY = 1 << 16  # turns of a block from which it is cut by turn and digest
PART = 256  # turns of a row of rendered text
LANE = (1 << 31) - 1  # sums are kept modulo 2^31 in four lanes: those of four billion turns of a block, and of as many blocks, stay within a long

# The marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def tag(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the digest of role and text that orders turns of one number."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return t.withColumn("digest", F.md5(F.concat(tag("role"), F.lit("\x1f"), tag("text"))))


def placed(t: DataFrame) -> DataFrame:
    """t (conv_id, turn, digest and any others) with place, block and cut: place from 1 in the order of turn, then of digest, nulls first; block by turn, cut by turn and digest where a block has MANY turns."""
    names = [c for c in t.columns if c not in ("turn", "digest")]
    t = t.withColumn("block", F.expr(f"floor(turn / {BLOCK})"))
    big = written(t.groupBy("conv_id", "block").count().where(F.col("count") > MANY).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.lit(True).alias("big")), "big")
    fine = F.struct("turn", F.substring("digest", 1, 3).alias("digits"))
    if big.isEmpty():
        t = t.withColumn("cut", F.lit(None).cast("struct<turn:bigint,digits:string>"))
    else:
        t = t.join(big, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left").withColumn("cut", F.when(F.col("big"), fine))
    keys = ["conv_id", "block", "cut"]
    within = Window.partitionBy(*keys).orderBy("turn", "digest")
    sizes = t.groupBy(*keys).agg(F.count("*").alias("n"))
    over = Window.partitionBy("conv_id").orderBy("block", "cut").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    t = t.withColumn("at", F.row_number().over(within))
    return t.alias("t").join(before.alias("b"), same(keys)).select((F.col("before") + F.col("at")).alias("place"), *[f"t.{c}" for c in (*names, "block", "cut")])


def same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def turn_hash(seed: int) -> Column:
    """A 64-bit hash of place and content, the 128 bits that stand for role and text."""
    return F.xxhash64(F.lit(seed), "place", "c1", "c2")


def lane(c: Column) -> Column:
    return c.bitwiseAND(F.lit(LANE))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2): hashes of the turns up to each place, each of two sums modulo 2^31. Role and text are hashed where they are read and go no further."""
    keys = ["conv_id", "block", "cut"]
    content = digested(turns).select("conv_id", "turn", "digest", *[F.xxhash64(F.lit(k), tag("role"), tag("text")).alias(f"c{k}") for k in (1, 2)])
    t = placed(content).withColumns({"y1": turn_hash(1), "y2": turn_hash(2)})
    t = t.select(*keys, "place", *[c.alias(f"x{2 * k + i}") for k in (0, 1) for i, c in enumerate((lane(F.col(f"y{k + 1}")), F.shiftrightunsigned(f"y{k + 1}", 33)))])
    sums = t.groupBy(*keys).agg(*[lane(F.sum(f"x{k}")).alias(f"s{k}") for k in range(4)])
    over = Window.partitionBy("conv_id").orderBy("block", "cut").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, *[lane(F.coalesce(F.sum(f"s{k}").over(over), F.lit(0))).alias(f"b{k}") for k in range(4)])
    within = Window.partitionBy(*keys).orderBy("place")
    t = t.select(*keys, "place", *[lane(F.sum(f"x{k}").over(within)).alias(f"r{k}") for k in range(4)])
    lanes = [lane(F.col(f"r{k}") + F.col(f"b{k}")) for k in range(4)]
    h = [F.shiftleft(lanes[2 * k], 31).bitwiseOR(lanes[2 * k + 1]).alias(f"h{k + 1}") for k in (0, 1)]
    return t.alias("t").join(before.alias("b"), same(keys)).select("t.conv_id", "place", *h)


def whole(pre: DataFrame) -> DataFrame:
    """(place, h1, h2, conv_id, ends): the whole conversations, how many are equal and the smallest conv_id of those."""
    key = ["place", "h1", "h2"]
    return pre.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("e")).select("conv_id", "e.*").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("ends"))


def maximal(pre: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one continues, one of each group of equal ones. pre, ends: written prefixes and the whole of them."""
    key = ["place", "h1", "h2"]
    continued = pre.groupBy(*key).agg(F.count("*").alias("n")).join(ends, key).where("n > ends").select(*key)
    return ends.join(continued, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, part, text): each maximal conversation as marked turns, PART turns to a row, parts from 0.

    Null roles and texts are rendered as empty. Rows of one conversation with one turn number follow each other by a digest of
    role and text. A null conv_id is a conversation of its own. Repeated rows are turns. No rows give none; other
    columns are not read.
    """
    pre = written(prefixes(turns), "prefixes")
    ends = written(whole(pre), "ends")
    keep = written(maximal(pre, ends).select(F.col("conv_id").alias("c"), "n_turns"), "maximal")
    dropped(pre, ends)
    kept = turns.select("conv_id", "turn", "role", "text").join(keep, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    rows = placed(digested(kept)).select("conv_id", F.expr(f"int((place - 1) div {PART})").alias("part"), "place", line.alias("line"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "").alias("text"))
    return parts.join(keep, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n_turns", "part", "text")


RENDER_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, text, md5(coalesce('=' || role, '-') || chr(31) || coalesce('=' || text, '-')) AS x FROM conversations),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS place FROM t),
p AS (SELECT *, md5(string_agg(x, ',') OVER (PARTITION BY conv_id ORDER BY place)) AS hash, count(*) OVER (PARTITION BY conv_id) AS n FROM h),
w AS (SELECT min(conv_id) AS conv_id, place AS n_turns, hash FROM p WHERE place = n GROUP BY place, hash),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place = w.n_turns AND p.hash = w.hash AND p.n > p.place))
SELECT p.conv_id, k.n_turns, CAST((p.place - 1) // {PART} AS INTEGER) AS part,
       string_agg('{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10), '' ORDER BY place) AS text
FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1, 2, 3
"""
