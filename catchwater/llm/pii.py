"""Personal data: base patterns, and a skip-chain conditional random field over the tokens that could be personal data.

Nodes are the base spans of a document and, between them, number groups with the digits of a base span and other
tokens that hold a digit or an at-sign. Neighbours in the text share a chain potential; nodes with equal or similar
content share a skip potential with one auxiliary node of their key, so it reaches them however far apart. Loopy
sum-product passes messages until they settle, so that a token which the patterns miss (no context, broken
form) takes the label of its twin.

All weights are fitted to base labels on a bounded sample of nodes: unary ones by softmax regression, those of chain
and skip by pseudo-likelihood under a prior. Nodes that the patterns miss although a twin is found are of unknown
label, and teach nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import map_rows, per_row, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# The base patterns of the contract. A lookbehind for a digit leaves out starts inside a run that failed at its first digit; they fail the same way.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SAMPLE, TOKENS = 40_000, 20_000  # documents, about, and nodes of them, at most, to which weights are fitted
CHAIN, SKIP = (0.3, 0.3), (12.0, 3.0)  # means and deviations of the priors of the log potentials of equal labels
SURE = 0.9  # belief from which a span is added; at a skip weight of 12, one certain twin outweighs unary odds of e^9
CLOSE = 40  # characters between nodes that are neighbours
SETTLED, PATIENCE = 1e-4, 100  # change of messages at which they have settled; rounds after which their step is halved
BUCKETS = 256  # hashed features


class Model(NamedTuple):
    unary: np.ndarray  # features x labels
    chain: float
    skip: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; linear, since what stands before an at-sign is looked up backwards from it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, start if start == at else done)
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by kind as listed, then start."""
    found = [(s, e, "email") for s, e in emails(text)]
    digits = lambda s: [c for c in s if "0" <= c <= "9"]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := digits(m[0])) <= 19 and luhn("".join(d)):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


DIGIT = re.compile("[0-9@]")
EDGE = ".,;:!?\"'()[]<>{}|*#%&$"


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or an at-sign, without punctuation at their ends."""
    out, pos = [], 0
    while m := DIGIT.search(text, pos):
        s, e = m.start(), m.end()
        while s > pos and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        pos = e
        while s < e and text[s] in EDGE:
            s += 1
        while e > s and text[e - 1] in EDGE:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def features(text: str, s: int, e: int) -> list[int]:
    """Hashed: shape, length, counts of digits and dots, and the words next to the token."""
    t = text[s:e]
    shape = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", t))
    n = sum(c.isdigit() for c in t)
    before, after = text[max(0, s - 24) : s].split()[-1:], text[e : e + 24].split()[:1]
    names = ["bias", "shape " + shape, f"digits {n}", f"dots {t.count('.')}", f"at {'@' in t}", f"plus {t[0] == '+'}", f"length {min(len(t), 40) // 4}", *(f"before {w.lower()}" for w in before), *(f"after {w.lower()}" for w in after)]
    return [hash_of(x) for x in names]


def hash_of(name: str) -> int:
    h = 2166136261
    for b in name.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


class Example(NamedTuple):
    """A node for fitting: its features and label, how many neighbours and how many twins have each label."""

    features: list[int]
    label: int
    near: list[int]
    twins: list[int]


def examples(text: str) -> list[tuple[int, Example]]:
    """(start, example) of the nodes whose label is known."""
    found, out = nodes(text, base_spans(text)), []
    by_key: dict[str, list[int]] = defaultdict(lambda: [0] * len(LABELS))
    for _, _, y, key in found:
        by_key[key][y] += 1
    for i, (s, e, y, key) in enumerate(found):
        twins, near = list(by_key[key]) if key else [0] * len(LABELS), [0] * len(LABELS)
        twins[y] -= bool(key)
        if key and any(by_key[key][1:]):
            if not y:
                continue
            twins[0] = 0
        for j in (i - 1, i + 1):
            if 0 <= j < len(found) and max(found[max(i, j)][0] - found[min(i, j)][1], 0) <= CLOSE:
                near[found[j][2]] += 1
        out.append((s, Example(features(text, s, e), y, near, twins)))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit_examples(rows: list[Example], steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """The model that base labels teach. Without examples: `none` for all that no twin is found of."""
    w = np.zeros((BUCKETS + 1, len(LABELS)))
    if not rows:
        w[hash_of("bias"), 0] = 5
        return Model(w[:-1], CHAIN[0], SKIP[0])
    wide = max(len(r.features) for r in rows)
    at = np.array([[*r.features, *[BUCKETS] * (wide - len(r.features))] for r in rows])
    flat, goal = at.ravel(), np.eye(len(LABELS))[[r.label for r in rows]]
    for _ in range(steps):
        off = np.repeat((goal - softmax(w[at].sum(1))) / len(rows), wide, axis=0)
        w += rate * (np.column_stack([np.bincount(flat, off[:, k], BUCKETS + 1) for k in range(len(LABELS))]) - decay * w)
        w[BUCKETS] = 0
    unary, y = w[at].sum(1), np.array([r.label for r in rows])
    near, twins = np.array([r.near for r in rows], float), np.array([r.twins for r in rows], float)
    share = 1 / (1 + twins.sum(1, keepdims=True))

    def best(grid: np.ndarray, prior: tuple[float, float], some: np.ndarray, scores) -> float:
        """The weight of the grid with the largest pseudo-likelihood and prior."""
        at = np.flatnonzero(some)
        fits = [np.log(softmax(scores(g, at))[np.arange(len(at)), y[at]] + 1e-300).sum() - ((g - prior[0]) / prior[1]) ** 2 / 2 for g in grid]
        return float(grid[int(np.argmax(fits))])

    def hub(g, at):
        levels = g * (np.eye(len(LABELS))[None] + twins[at][:, None, :])  # of the auxiliary node, for each label of the node
        top = levels.max(2, keepdims=True)
        return unary[at] * share[at] + np.log(np.exp(levels - top).sum(2)) + top[:, :, 0]

    chain = best(np.linspace(0, 2, 41), CHAIN, near.any(1), lambda g, at: unary[at] + g * near[at])
    skip = best(np.linspace(0, 20, 41), SKIP, twins.any(1), hub)
    return Model(w[:-1], chain, skip)


def fit(texts: list[str]) -> Model:
    return fit_examples([x for text in texts for _, x in examples(text)])


def key_of(token: str) -> str:
    """Similar tokens have one key: letters in lower case and digits, without separators. Under 6 of them, separators count, as places."""
    parts = re.findall(r"[a-z0-9]+", token.lower())
    return key if len(key := "".join(parts)) >= 6 else ".".join(parts)


def key_of_span(span: str, kind: str) -> str:
    """The same for base spans; the groups of an address tell it from others of the same digits."""
    return alike(".".join(span.split(".")) if kind == "ip" else key_of(span), span)


def alike(key: str, token: str) -> str:
    """One key for similar content: of 10 to 15 digits the last ten (with and without a country's code), of mail the name before a tag and the at-sign."""
    if key.isdigit() and 10 <= len(key) <= 15:
        return key[-10:]
    name, at, _ = token.lower().partition("@")
    name = name.partition("+")[0]
    return name + "@" if at and len(name) >= 6 else key


RUN = re.compile(r"[0-9]+(?:[\x20\xa0().,/_+-]{1,3}[0-9]+)*")


def plain_nodes(text: str, lo: int, hi: int) -> list[tuple[int, int, int, str]]:
    return [(a + lo, b + lo, 0, alike(key_of(t := text[a + lo : b + lo]), t)) for a, b in tokens(text[lo:hi])]


def nodes(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label, key) in text order: base spans; between them, runs of number groups that have the key of one, then other tokens."""
    found = [(s, e, LABELS.index(k), key_of_span(text[s:e], k)) for s, e, k in base]
    known = {key for *_, key in found if re.fullmatch("[0-9.]+", key)}
    most = max((15 if len(k) == 10 else len(k) for k in known), default=0)
    gaps, done = [], 0
    for s, e, *_ in sorted(found):
        gaps.append((done, s))
        done = max(done, e)
    for lo, hi in [*gaps, (done, len(text))]:
        free = lo
        for m in RUN.finditer(text, lo, hi) if known else ():
            run = m[0]
            parts = [(g.start(), g.end()) for g in re.finditer("[0-9]+", run)]
            k = 0
            while k < len(parts):
                hit, plain, groups = None, "", ""
                for j in range(k, len(parts)):
                    part = run[slice(*parts[j])]
                    plain, groups = plain + part, f"{groups}.{part}" if groups else part
                    if len(plain) > most:
                        break
                    if key := next((x for x in (groups, alike(plain, plain)) if x in known), None):
                        hit = j, key
                if not hit:
                    k += 1
                    continue
                s, e = m.start() + parts[k][0], m.start() + parts[hit[0]][1]
                s -= s > free and text[s - 1] in "+("
                found += plain_nodes(text, free, s)
                found.append((s, e, 0, hit[1]))
                free, k = e, hit[0] + 1
        found += plain_nodes(text, free, hi)
    return sorted(found)


def beliefs(unary: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Loopy sum-product with Potts potentials, damped, for all edges at once."""
    n, k = unary.shape
    if edges:
        a, b, w = (np.array(x) for x in zip(*edges))
        src, dst, gain = np.r_[a, b], np.r_[b, a], np.exp(np.r_[w, w])[:, None]
        back = np.r_[np.arange(len(a), 2 * len(a)), np.arange(len(a))]
        m, change, rounds = np.zeros((len(src), k)), np.inf, 0
        while change > SETTLED:
            step = 0.5 ** (1 + rounds // PATIENCE)  # ever smaller, so that messages which swing settle too
            total = unary.copy()
            np.add.at(total, dst, m)
            out = total[src] - m[back]
            p = np.exp(out - out.max(1, keepdims=True))
            new = np.log(p.sum(1, keepdims=True) + (gain - 1) * p)
            new = step * (new - new.max(1, keepdims=True) - m)
            m, change, rounds = m + new, np.abs(new).max(), rounds + 1
        unary = unary.copy()
        np.add.at(unary, dst, m)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def crf_spans(text: str, base: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int, str]]:
    """Spans of tokens outside base spans whose belief in one kind is at least SURE."""
    found = nodes(text, base)
    if not found:
        return []
    unary = np.array([model.unary[features(text, s, e)].sum(0) for s, e, *_ in found])
    unary -= unary.max(1, keepdims=True)
    twins = defaultdict(list)
    for i, (*_, key) in enumerate(found):
        if key:
            twins[key].append(i)
    share = [1 / max(1, len(twins[key])) for *_, key in found]
    edges = [(i - 1, i, model.chain * min(share[i - 1], share[i])) for i in range(1, len(found)) if found[i][0] - found[i - 1][1] <= CLOSE]
    hub = len(found)
    for same in twins.values():
        if len(same) > 1:
            unary[same] /= len(same)  # one content gives its evidence once, and its neighbours, by their share of the chain, theirs
            edges += [(i, hub, model.skip) for i in same]
            hub += 1
    for i, (_, _, y, _) in enumerate(found):
        if y:
            unary[i] = -40
            unary[i, y] = 0
    unary = np.vstack([unary, np.zeros((hub - len(found), len(LABELS)))])
    p = beliefs(unary, edges)
    return [(s, e, LABELS[y]) for i, (s, e, known, _) in enumerate(found) if not known and (y := int(p[i].argmax())) and p[i, y] >= SURE]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = TOKENS) -> Model:
    """Fits on about `sample` documents, drawn by a hash of id and text, and at most `most` nodes of them, drawn by a hash of place.

    Nodes are made in tasks, so no text reaches the driver. Null and empty texts have none, null ids and repeated rows are
    drawn as others, an empty table gives the model without examples.
    """
    small_batches(df.sparkSession)
    part = min(1.0, sample / max(1, df.count()))
    drawn = df.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text")).where(F.pmod("h", F.lit(1_000_000)) < int(part * 1_000_000)).where(F.col("text").rlike("[0-9@]"))

    def each():
        return lambda rows: ((h, s, *x) for h, text in rows for s, x in examples(text))

    got = map_rows(drawn, each, "h long, start long, features array<int>, label int, near array<int>, twins array<int>")
    rows = got.orderBy(F.xxhash64("h", "start"), "h", "start").limit(most).collect()
    return fit_examples([Example(*r[2:]) for r in rows])


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start,end,kind,base>>) of whole texts, by kind as listed, then start; base tells pattern spans from added ones.

    Null and empty texts have no spans; other columns are not read; repeated rows stay repeated.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def row(i, text):
        if not text or not DIGIT.search(text):
            return i, []
        base = base_spans(text)
        spans = [(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, k in crf_spans(text, base, model)]
        return i, sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0]))

    return map_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_row(lambda: row), f"`{id_col}` {kind}, spans array<struct<start:int,end:int,kind:string,base:boolean>>")


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    text = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return spans.select(id_col, *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def brute(text: str) -> list[tuple[int, int, str]]:
    """Base spans by the patterns as they are stated, for tests on short texts."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found: dict[str, list] = defaultdict(list)
    for k, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15:
                found[k].append((m.start(), m.end(), k))
    return [x for k in KINDS for x in found[k]]
