"""Quality rules: text statistics in Spark expressions, and a decision list learned from labelled ones.

Sequential covering: grow a conjunction of thresholds that tells rejected from good documents on two thirds
of the labelled rows, prune it on the last third, keep it if it holds there, take away what it covers, repeat.
The list becomes one CASE expression. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000  # labelled documents of the smallest id hashes from which a list is learned
LONG = 1 << 20  # words from which positions no longer fit beside a 44-bit hash

# White space between words, and symbols.
SPACE = "[ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"

FEATURES = {  # name: expression over the statistics
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "bang_per_word": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "n_words": "double(n_words)",
}


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def covered(starts: Column) -> Column:
    """Positions in windows of three that begin at the given ascending positions."""
    n = F.size(starts)
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(n - 1, F.lit(0))), F.slice(starts, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(n == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda a, g: a + g))


def equal_neighbours(keys: Column, shift: int) -> Column:
    """Of sorted keys (hash bits over position bits), the positions whose hash bits occur more than once, ascending."""
    same = lambda a, b: F.shiftright(a, shift) == F.shiftright(b, shift)
    n = F.size(keys)
    flags = F.zip_with(F.slice(keys, 2, F.greatest(n - 1, F.lit(0))), F.slice(keys, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.when(same(a, b), F.array(a, b)))
    low = (1 << shift) - 1
    return F.sort_array(F.array_distinct(F.transform(F.flatten(F.filter(flags, lambda p: p.isNotNull())), lambda k: k.bitwiseAND(F.lit(low)).cast("int"))))


def window(words: Column, i: Column) -> Column:
    return F.struct(words[i], words[i + 1], words[i + 2])


def repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Window hashes and positions are packed into longs and sorted. Equal hashes are held against the words;
    a document with a collision, or one of LONG words and more, is counted by its whole windows instead.
    """
    last = n - 2
    where = F.sequence(F.lit(0), last - 1)
    hashed = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    keys = F.sort_array(F.transform(where, lambda i: F.shiftleft(hashed(i), 20).bitwiseOR(i.cast("long"))))

    def checked(keys: Column) -> Column:
        true = F.aggregate(
            F.zip_with(F.slice(keys, 2, F.greatest(F.size(keys) - 1, F.lit(0))), F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0))),
                       lambda b, a: (F.shiftright(a, 20) != F.shiftright(b, 20)) | (window(words, a.bitwiseAND(F.lit(LONG - 1)).cast("int")) == window(words, b.bitwiseAND(F.lit(LONG - 1)).cast("int")))),
            F.lit(True), lambda a, x: a & x)
        return F.when(true, covered(equal_neighbours(keys, 20))).otherwise(exact)

    pairs = F.array_sort(F.transform(where, lambda i: F.struct(window(words, i).alias("w"), i.alias("i"))))

    def of_pairs(p: Column) -> Column:
        m = F.greatest(F.size(p) - 1, F.lit(0))
        hits = F.filter(F.zip_with(F.slice(p, 2, m), F.slice(p, 1, m), lambda b, a: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
        return covered(F.sort_array(F.array_distinct(F.flatten(hits))))

    exact = let(pairs, of_pairs)
    return F.when(n < 3, 0).when(n >= LONG, exact).otherwise(let(keys, checked)).cast("long")


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Statistics of whole texts, a row for each row. A null text has no words and no lines: all zeros.

    keep: with the input row as the struct `__row`; else other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), *([F.struct("*").alias("__row")] if keep else []))
    rest = ["__row"] if keep else []
    split = first.select("doc_id", *rest, F.array_remove(F.split("text", SPACE + "+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"), "text")
    n = F.size("words")
    found = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), n).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    # A generator, since filters on statistics would else be pushed below the split and redo it for each word.
    return split.select("doc_id", *rest, F.explode(F.array(found)).alias("s")).select("doc_id", *rest, "s.*")


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.cut!r}D"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.cut if self.above else v <= self.cut


def matches(rule: list[Test], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([t(x) for t in rule]) if rule else np.ones(len(x), bool)


def grow(x: np.ndarray, bad: np.ndarray, longest: int) -> list[Test]:
    """Adds the test with most FOIL gain until no good row is covered."""
    rule: list[Test] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest and (~bad & inside).any() and (bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for j, name in enumerate(FEATURES):
            values = np.unique(x[inside, j])
            for cut in (values[:-1] + np.diff(values) / 2)[:: max(1, len(values) // 64)]:
                for above in (True, False):
                    got = inside & ((x[:, j] > cut) if above else (x[:, j] <= cut))
                    p1, n1 = (bad & got).sum(), (~bad & got).sum()
                    if p1 and (g := p1 * (log2(p1 / (p1 + n1)) - log2(p / (p + n)))) > gain:
                        best, gain = Test(name, above, round(float(cut), 6)), g
        if best is None:
            break
        rule.append(best)
        inside &= best(x)
    return rule


def prune(rule: list[Test], x: np.ndarray, bad: np.ndarray) -> list[Test]:
    """Drops last tests while (p - n) / (p + n) on held-out rows does not fall."""
    worth = lambda r: ((m := matches(r, x)) & bad).sum() / max(1, m.sum()) * 2 - 1 if r else -2.0
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.97, least: int = 3, longest: int = 4, most: int = 12) -> list[list[Test]]:
    """The ordered rules that reject. x: rows in an order of no meaning, columns as in FEATURES. A rule needs `least` held-out rows and that precision on them."""
    rules: list[list[Test]] = []
    held = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most and (bad & left & ~held).sum() >= least:
        g, h = left & ~held, left & held
        rule = prune(grow(x[g], bad[g], longest), x[h], bad[h])
        got = matches(rule, x[h])
        if not rule or got.sum() < least or bad[h][got].mean() < precision:
            break
        rules.append(rule)
        left &= ~matches(rule, x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> list[list[Test]]:
    """Learns from at most `sample` labelled documents; rows that fail the base test teach nothing. Without labelled rows: no rules.

    The labels of the sample are a bounded table and are sent to all tasks.
    """
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    quality = dict(some.collect())
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col("text")).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    rows = statistics(picked).select("doc_id", "n_words", "n_repeat_words", *[F.expr(e).cast("double").alias(f"f_{f}") for f, e in FEATURES.items()]).collect()
    rows = [r for r in rows if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]
    if not rows:
        return []
    rows.sort(key=lambda r: (hash_of(r["doc_id"]), *(r[f"f_{f}"] for f in FEATURES)))
    return learn(np.array([[r[f"f_{f}"] for f in FEATURES] for r in rows]), np.array([quality[r["doc_id"]] == 0 for r in rows]))


def hash_of(i: int) -> int:
    """Orders ids in a way that has nothing to do with their size."""
    return int(i) * 0x9E3779B97F4A7C15 % (1 << 64)


def rule_column(rules: list[list[Test]]) -> Column:
    """The number of the first rule that holds, as one CASE expression; null where none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed([*enumerate(rules, 1)]):
        out = F.when(F.expr(" AND ".join(t.sql() for t in rule)), k).otherwise(out)
    return out


def judge(df: DataFrame, rules: list[list[Test]], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Statistics, base_failed, the number of the rule that rejects (null: none), and kept. Null and empty texts fail the base test."""
    out = statistics(df, id_col, text_col, keep).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", rule_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
