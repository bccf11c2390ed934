"""Secret scans: base patterns, and strings that a primed zstandard dictionary finds novel.

A candidate is a run of 16 or more key characters that mixes letters and digits or small and capital letters, or of 20 or more letters
of one case, with a word such as `key` or `secret` close before or after it, or as a part of it. An equals sign or colon ends it, so
that in name=value the name is its surroundings. It is measured whole, in windows: the novelty of a window is the number of
bytes that it adds to the compressed form of what surrounds it, with a dictionary of common code and identifiers
in place. Prose, paths, repeats and identifiers compress; keys do not. A candidate is reported from its first novel window to its
last, and on through neighbouring windows that are nearly as novel; letters of one case are reported whole.
"""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import map_rows, per_row, small_batches

# The base patterns of the contract. Failing matches are dropped, so {24,} and {16,} equal + with a length test.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
MIXED = re.compile(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]", re.S)
ONE_CASE = re.compile(r"[a-z]{20,}|[A-Z]{20,}")
SENSITIVE = re.compile(r"key|secret|token|passw|credential|auth|bearer|private|signature", re.I | re.A)
PART = re.compile(r"(?:^|[_-])[a-z]*(?:key|secret|token|passw|credential|auth|bearer|private|signature)[a-z]*[_-]", re.I | re.A)  # within a candidate
NEAR = 48  # characters before and after a candidate in which a sensitive word counts
AROUND = 256  # characters before and after a window that count as surroundings
WINDOW = 48  # characters of a window, about: a longer one would bring an entropy code of its own
NOVEL = 0.75  # marginal compressed bytes for each character; random strings measure 0.75 to 1.3, identifiers 0.6 to 0.7
EDGE = 0.68  # the same of windows next to a novel one
PLAIN = 0.64  # the same of letters of one case: random ones measure 0.6 to 0.8, long words 0.5 to 0.6

# Words that primed surroundings hold.
PRIMER = (
    "import from return class def function const let var public private static void int string bool true false null None self this new "
    "if else for while try except catch throw raise assert lambda yield async await package struct enum interface implements extends override "
    "http https www com org net example localhost index html json yaml xml csv txt md py js ts java cpp rs go sh config settings default "
    "user username email password passwd secret token api_key apikey access_key secret_key client_id client_secret auth authorization bearer "
    "get set list map dict array value values item items key keys name names id ids type types size length count index data date time path file "
    "request response header headers body status error message result results query params options args kwargs context session connection "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef the of and to in is that for with was on are this "
).encode()

# Fixed value: plain prose, so that short surroundings too give letters their usual weights.
PROSE = (
    "It was late in the year when the last of the boats came in, and most people had gone home long before that hour. We walked along the "
    "water to see whether anything was left on the quay, talked for a while about the weather, and then went back by the narrow road "
    "between the gardens. Nobody had lit the lamps yet. In one window a woman was reading; she looked up, nodded, and turned the page again. "
)


class Novelty:
    def __init__(self):
        self.by = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.by.compress(text.encode("utf-8", "surrogatepass")))

    def span(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """The novel stretch of a candidate. A window's surroundings are prose, the text around the candidate without other candidates, and the window before."""
        near = PROSE + CANDIDATE.sub(" ", text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND])
        one_case = ONE_CASE.fullmatch(text, start, end)
        n = max(1, round((end - start) / WINDOW))
        cuts = [start + (end - start) * k // n for k in range(n + 1)]
        rate = []
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            before, window = text[cuts[max(0, k - 1)] : s], text[s:e]
            if one_case:  # the dictionary and prose are in small letters
                before, window = before.lower(), window.lower()
            around = near + " " + before
            rate.append((self.size(around + window) - self.size(around)) / (e - s))
        novel = [k for k, x in enumerate(rate) if x >= (PLAIN if one_case else NOVEL)]
        if not novel:
            return None
        if one_case:  # it has no parts
            return start, end
        first, last = novel[0], novel[-1]
        while first and rate[first - 1] >= EDGE:
            first -= 1
        while last < n - 1 and rate[last + 1] >= EDGE:
            last += 1
        return cuts[first], cuts[last + 1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Incompressible strings in a sensitive context, but for those that lie in one base span."""
    found = []
    if not SENSITIVE.search(text):
        return found
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if not (MIXED.search(m[0]) or ONE_CASE.fullmatch(m[0])):
            continue
        if SENSITIVE.search(text, max(0, s - NEAR), s) or SENSITIVE.search(text, e, e + NEAR) or PART.search(text, s, e):
            span = novelty.span(text, s, e)
            if span and not any(x <= span[0] and span[1] <= y for x, y, _ in taken):
                found.append((*span, "novel"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start,end,kind>>) of whole texts, base spans and novel ones, by start, then kind.

    Null and empty texts have no spans; other columns are not read; repeated rows stay repeated.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def each():
        novelty = Novelty()

        def row(i, text):
            base = base_spans(text or "")
            return i, sorted(base + novel_spans(text or "", base, novelty), key=lambda s: (s[0], KINDS.index(s[2])))

        return row

    return map_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_row(each), f"`{id_col}` {kind}, spans array<struct<start:int,end:int,kind:string>>")


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    text = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return spans.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each found span of the text replaced by a mark. All columns stay as they are, n_chars follows the text. A null text stays null."""
    small_batches(df.sparkSession)
    names = df.columns
    at, chars = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def each():
        novelty = Novelty()

        def row(*values):
            text = values[at]
            if not text:
                return values
            base = base_spans(text)
            spans = sorted(base + novel_spans(text, base, novelty))
            if not spans:
                return values
            out, done = [], 0
            for s, e, _ in spans:
                if s >= done:
                    out += [text[done:s], mark]
                done = max(done, e)
            values = list(values)
            values[at] = "".join([*out, text[done:]])
            if chars is not None:
                values[chars] = len(values[at])
            return tuple(values)

        return row

    return map_rows(df, per_row(each), df.schema)


def brute(text: str) -> str:
    """The base digest by the patterns as they are stated, for tests."""
    found = []
    for rank, (k, p, ok) in enumerate((("assign", ASSIGN.pattern, lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))):
        found += [(m.start(), rank, f"{k}:{m.start()}:{m.end()}") for m in re.finditer(p, text, (re.I if k == "assign" else 0) | re.A) if ok(m)]
    return hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
