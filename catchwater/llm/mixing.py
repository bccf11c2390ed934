"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed by (source, language, topic); the cells are raked in turn to each target marginal; a
cell's factor, raked over given weight, divided by the largest factor, is the probability with which its documents
stay. So expected tokens have the raked shares, and no probability is over one. The draw is a hash of the id.

Up to SENT cells are raked on the driver: their number is counted first, and each is a row of four values. More are raked by rounds of
joins, with the same result. A raked weight is the given one times a factor of each margin. A round sums by source within the cells, and over sources
only by (language, topic), so that the other two margins are fitted on that small table; no task holds all cells.
"""

from __future__ import annotations

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwater.llm.common import dropped, written

ROUNDS = 12
POWER = 0.9  # target shares without given targets: shares of tokens to this power
SENT = 100_000  # rows of a table of cells up to which it is raked on the driver and sent to all tasks; beyond, it is raked and joined by shuffles
MARGINS = ("source", "lang", "topic")

# The form of a text, by the first test that holds: SQL over n_symbols, n_digits, n_lines and n_all characters.
SYMBOLS, DIGITS = r"[{}();=<>#$%&*|/_@^~\[\]]", "[0-9]"
FORMS = (("code", "20 * n_symbols > n_all"), ("data", "10 * n_digits > n_all"), ("list", "n_lines >= 5 AND n_all < 40 * n_lines"))
CASES = " ".join(f"WHEN {test} THEN '{name}'" for name, test in FORMS) + " ELSE 'prose'"


def topic(text: Column) -> Column:
    """The form of a text, where no topics are given: code, data, list or prose, by its shares of symbols and digits and the length of its lines."""
    of = F.struct(
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"), F.regexp_count(text, F.lit(DIGITS)).alias("n_digits"),
        (F.regexp_count(text, F.lit("\n")) + 1).alias("n_lines"), F.length(text).alias("n_all"),
    )
    return F.transform(F.array(of), _form)[0]


def _form(x: Column) -> Column:
    out = F.lit("prose")
    tests = {"code": 20 * x["n_symbols"] > x["n_all"], "data": 10 * x["n_digits"] > x["n_all"], "list": (x["n_lines"] >= 5) & (x["n_all"] < 40 * x["n_lines"])}
    for name, _ in reversed(FORMS):
        out = F.when(tests[name], name).otherwise(out)
    return out


def draw(id_col: Column) -> Column:
    """A number in [0, 1) from an id, the same in each run: eight hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def weighed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, topic_col: str | None = None, weight_col: str | None = None) -> DataFrame:
    """Source, lang and topic of each row, nulls as 'unknown', and its weight: words of the text, one at least.

    topic_col and weight_col name given columns instead, such as a classifier's topics or exact token counts; null weights count as one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    words = F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""))
    weight = F.greatest(F.coalesce(F.col(weight_col), F.lit(1)) if weight_col else words, F.lit(1)).cast("long")
    own = known(topic_col) if topic_col else topic(text)
    return df.select(F.col(id_col).alias("doc_id"), known("source").alias("source"), known("lang").alias("lang"), own.alias("topic"), weight.alias("weight"), *([F.struct("*").alias("__row")] if keep else []))


def exact(c: Column) -> Column:
    """For sums that do not depend on the order of rows."""
    return F.round(c, 15).cast("decimal(38,15)")


def sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df.hint("merge")


def targets_of(cells: DataFrame, margin: str, given: dict[str, float] | None = None) -> DataFrame:
    """(margin, target): shares that sum to one.

    given: shares by value, in any unit. Values without rows are left out and the rest made to sum to one; values of rows
    without a share get none. Shares that are negative, or all zero, raise ValueError.
    """
    if given is not None:
        there = sorted(r[0] for r in cells.where(F.col(margin).isin([*given])).select(margin).distinct().collect())
        whole = sum(given[v] for v in there) or 1.0
        share = F.coalesce(F.create_map(*[F.lit(x) for v in there for x in (v, float(given[v] / whole))])[F.col(margin)], F.lit(0.0)) if there else F.lit(0.0)
        return cells.select(margin).distinct().select(margin, share.alias(f"target_{margin}"))
    part = written(cells.groupBy(margin).agg(F.sum("tokens").alias("n"), F.first("total").alias("total")).select(margin, F.pow(F.col("n") / F.col("total"), F.lit(POWER)).alias("t")), "shares")
    norm = float(part.agg(F.sum(exact(F.col("t")))).first()[0] or 1)
    return part.select(margin, (F.col("t") / F.lit(norm)).alias(f"target_{margin}"))


def exact_sum(values) -> float:
    """The sum that `exact` gives, which does not depend on the order."""
    return float(sum((Decimal(repr(float(v))).quantize(Decimal("1e-15"), ROUND_HALF_UP) for v in values), Decimal(0)))


def raked(cells: dict[tuple[str, str, str], int], targets: dict[str, dict[str, float]], rounds: int) -> dict[tuple[str, str, str], float]:
    """The factors of cells (source, lang, topic) with tokens: the rounds of `rake` on a table in memory."""
    total = float(sum(cells.values()) or 1)
    share = {k: n / total for k, n in cells.items()}
    aim = []
    for k, m in enumerate(MARGINS):
        tokens: dict[str, int] = defaultdict(int)
        for key, n in cells.items():
            tokens[key[k]] += n
        if m in targets:
            whole = sum(targets[m].get(v, 0.0) for v in sorted(tokens)) or 1.0
            aim.append({v: float(targets[m].get(v, 0.0) / whole) for v in tokens})
        else:
            power = {v: (n / total) ** POWER for v, n in tokens.items()}
            norm = exact_sum(power.values()) or 1.0
            aim.append({v: x / norm for v, x in power.items()})

    def fitted(k: int, weights: dict[tuple, float]) -> dict[str, float]:
        of = defaultdict(list)
        for key, x in weights.items():
            of[key[k]].append(x)
        now = {v: exact_sum(xs) for v, xs in of.items()}
        return {v: aim[k][v] / n if n > 0 else 0.0 for v, n in now.items()}

    b, c, a = dict.fromkeys(aim[1], 1.0), dict.fromkeys(aim[2], 1.0), {}
    for _ in range(rounds):
        a = fitted(0, {key: x * b[key[1]] * c[key[2]] for key, x in share.items()})
        of = defaultdict(list)
        for key, x in share.items():
            of[key[1:]].append(a[key[0]] * x)
        m = {("", *key): exact_sum(xs) for key, xs in of.items()}
        b = fitted(1, {key: x * c[key[2]] for key, x in m.items()})
        c = fitted(2, {key: x * b[key[1]] for key, x in m.items()})
    return {key: a[key[0]] * b[key[1]] * c[key[2]] for key in share} if rounds else dict.fromkeys(share, 1.0)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, factor, probability), from cells with tokens. Margins without given targets: their shares of tokens to the power POWER, made to sum to one.

    If the targets leave no cell a weight, all probabilities are zero. No cells give none. Targets that can't all be met: after `rounds` rounds the topics' are met,
    the sources' and languages' as nearly as the last round left them.
    """
    for m, given in (targets or {}).items():
        if min(given.values(), default=0) < 0 or not sum(given.values()) > 0:
            raise ValueError(f"the targets of {m} need shares of zero and more, with one above zero")
    cells = written(cells, "cells")
    if cells.count() > SENT:
        return rake_by_joins(cells, targets, rounds)
    got = {tuple(r[m] for m in MARGINS): r["tokens"] for r in cells.select(*MARGINS, "tokens").collect()}
    dropped(cells)
    factor = raked(got, targets or {}, rounds)
    most = max(factor.values(), default=0.0)
    rows = [(*key, got[key], float(f), float(f / most) if most else 0.0) for key, f in factor.items()]
    out = cells.sparkSession.createDataFrame(rows, "source string, lang string, topic string, tokens long, factor double, probability double")
    return out.withColumn("probability", F.round("probability", 9))


def rake_by_joins(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """`rake` for any number of cells."""
    targets = targets or {}
    cells = written(cells, "cells")
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 1))
    cells = cells.withColumn("total", total).withColumn("share", F.col("tokens") / total)
    by = {m: targets_of(cells, m, targets.get(m)) for m in MARGINS}
    base = written(cells.join(sent(written(by["source"], "sources")), "source"), "cells")
    lang, form = (written(by[m], m) for m in ("lang", "topic"))
    pairs = written(base.select("lang", "topic").distinct().join(lang, "lang").join(form, "topic").select("*", F.lit(1.0).alias("b"), F.lit(1.0).alias("c")), "pairs")
    each = lambda m: Window.partitionBy(m)
    total_of = lambda value, m: F.sum(exact(value)).over(each(m)).cast("double")
    fitted = lambda target, now: F.when(now > 0, target / now).otherwise(F.lit(0.0))

    def with_source(pairs: DataFrame) -> DataFrame:
        at = base.join(sent(pairs.select("lang", "topic", "b", "c")), ["lang", "topic"])
        return at.withColumn("a", fitted(F.col("target_source"), total_of(F.col("share") * F.col("b") * F.col("c"), "source"))).drop("b", "c")

    before = pairs
    for _ in range(rounds):
        m = with_source(pairs).groupBy("lang", "topic").agg(F.sum(exact(F.col("a") * F.col("share"))).cast("double").alias("m"))
        at = m.join(pairs.drop("b"), ["lang", "topic"])
        at = at.withColumn("b", fitted(F.col("target_lang"), total_of(F.col("m") * F.col("c"), "lang")))
        at = at.withColumn("c", fitted(F.col("target_topic"), total_of(F.col("m") * F.col("b"), "topic")))
        new = written(at.select("lang", "topic", "target_lang", "target_topic", "b", "c"), "pairs")
        if before is not pairs:
            dropped(before)
        before, pairs = pairs, new
    out = with_source(before).join(sent(pairs.select("lang", "topic", "b", "c")), ["lang", "topic"])
    out = written(out.select(*MARGINS, "tokens", (F.col("a") * F.col("b") * F.col("c")).alias("factor")), "factors")
    most = out.agg(F.max("factor")).first()[0] or 0.0
    return out.withColumn("probability", F.coalesce(F.round(F.try_divide(F.col("factor"), F.lit(most)), 9), F.lit(0.0)))


def cells_of(df: DataFrame) -> DataFrame:
    return df.groupBy(*MARGINS).agg(F.sum("weight").alias("tokens"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict[str, float]] | None = None, keep: bool = False, topic_col: str | None = None, weight_col: str | None = None) -> DataFrame:
    """(id, source, lang, topic, weight, probability, kept) of every row; keep: with the input row as `__row`.

    Rows with equal ids are drawn alike; a null id is drawn as an empty one. An empty table gives no rows.
    """
    cells = rake(cells_of(weighed(df, id_col, text_col, False, topic_col, weight_col)), targets).select(*MARGINS, "probability")
    out = weighed(df, id_col, text_col, keep, topic_col, weight_col).join(sent(cells), [*MARGINS])
    return out.withColumn("kept", draw(F.col("doc_id")) < F.col("probability")).withColumnRenamed("doc_id", id_col)


def _sql() -> str:
    ex = lambda x: f"CAST(round({x}, 15) AS DECIMAL(38,15))"
    steps = []
    for m in MARGINS:
        steps += [f"t_{m} AS (SELECT {m}, pow(sum(tokens) / any_value(total), {POWER}) AS t FROM c GROUP BY {m})", f"g_{m} AS MATERIALIZED (SELECT {m}, t / CAST(sum({ex('t')}) OVER () AS DOUBLE) AS target_{m} FROM t_{m})"]
    steps.append("p_0 AS (SELECT DISTINCT lang, topic, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM c)")
    for k in range(ROUNDS):
        steps += [
            f"a_{k} AS MATERIALIZED (SELECT source, any_value(target_source) / CAST(sum({ex('tokens / total * b * p.c')}) AS DOUBLE) AS a FROM c JOIN p_{k} p USING (lang, topic) JOIN g_source USING (source) GROUP BY source)",
            f"m_{k} AS MATERIALIZED (SELECT lang, topic, CAST(sum({ex('a * (tokens / total)')}) AS DOUBLE) AS m FROM c JOIN a_{k} USING (source) GROUP BY lang, topic)",
            f"b_{k} AS (SELECT m.*, target_lang / CAST(sum({ex('m * c')}) OVER (PARTITION BY lang) AS DOUBLE) AS b FROM m_{k} m JOIN p_{k} USING (lang, topic) JOIN g_lang USING (lang))",
            f"p_{k + 1} AS MATERIALIZED (SELECT lang, topic, b, target_topic / CAST(sum({ex('m * b')}) OVER (PARTITION BY topic) AS DOUBLE) AS c FROM b_{k} JOIN g_topic USING (topic))",
        ]
    return rf"""
WITH d0 AS (SELECT *, coalesce(text, '') AS t FROM documents),
d1 AS (SELECT *, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, len(regexp_extract_all(t, '{DIGITS}')) AS n_digits, len(regexp_extract_all(t, '
')) + 1 AS n_lines, length(t) AS n_all FROM d0),
d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, CASE {CASES} END AS topic,
  greatest(len(regexp_extract_all(t, '[^ 	-
]+')), 1)::BIGINT AS weight FROM d1),
c AS MATERIALIZED (SELECT source, lang, topic, sum(weight)::DOUBLE AS tokens, sum(sum(weight)) OVER ()::DOUBLE AS total FROM d GROUP BY source, lang, topic),
{', '.join(steps)},
f AS (SELECT source, lang, topic, a * b * p.c AS factor FROM c JOIN a_{ROUNDS - 1} USING (source) JOIN p_{ROUNDS} p USING (lang, topic)),
p AS (SELECT source, lang, topic, round(factor / max(factor) OVER (), 9) AS probability FROM f)
SELECT doc_id, source, lang, topic, weight, probability, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability AS kept
FROM d JOIN p USING (source, lang, topic)
"""


MIX_SQL = _sql()
