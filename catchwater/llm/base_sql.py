"""SQL for what SQL can say of operators whose full results it can't: statistics, base spans, payloads, decoded bytes.

Positions of matches come from the pieces between them: a match starts after all pieces up to it and all matches before it.
"""

from __future__ import annotations

SPACE, WORD = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM k WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""

DECODED_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"


def any_case(word: str) -> str:
    """A pattern for a word in either case of its ASCII letters alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


QUOTE = """["'']"""  # as it stands in an SQL string
ASSIGN = "(?:" + "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + f"|{any_case('api')}_?{any_case('key')}){QUOTE}?" + r"\x20*[:=]\x20*" + f"{QUOTE}?([A-Za-z0-9+/_.=-]+)"


def spans(kinds: list[tuple[str, str, str]]) -> str:
    """CTE s(doc_id, rank, kind, a, z) of base spans. kinds: (name, pattern, test of match m)."""
    one = "SELECT doc_id, {rank} AS rank, '{kind}' AS kind, p AS a, p + length(m) AS z FROM (SELECT doc_id, m[i] AS m, g[i] AS g, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS p FROM (SELECT doc_id, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, {group} AS g, string_split_regex(t, '{pattern}') AS s FROM d))) WHERE {test}"
    return "s AS (" + " UNION ALL ".join(one.format(rank=k, kind=kind, pattern=p, test=test, group=f"regexp_extract_all(t, '{p}', 1)" if kind == "assign" else f"regexp_extract_all(t, '{p}')") for k, (kind, p, test) in enumerate(kinds)) + ")"


def span_sql(kinds: list[tuple[str, str, str]], order: str) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in kinds)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {spans(kinds)},
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY {order}) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k, _, _ in kinds)}, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""


SECRET_SQL = span_sql([("assign", ASSIGN, "length(g) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", "[0-9a-f]+", "length(m) >= 24")], "a, rank")
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({DIGITS})[i]::INT ELSE 2 * reverse({DIGITS})[i]::INT - CASE WHEN reverse({DIGITS})[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
PII_SQL = span_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256) > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
    ],
    "rank, a",
)

MEDIA_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
p AS (SELECT doc_id, n_bytes, b || repeat('\xFF', (CASE WHEN n_bytes = 0 THEN 576 ELSE (576 - n_bytes % 576) % 576 END)::BIGINT)::BLOB AS payload FROM d),
m AS (SELECT *, octet_length(payload)::BIGINT AS payload_bytes, encode('P5 24 ' || (octet_length(payload) // 24) || ' 255' || chr(10)) || payload AS medium, list_transform(regexp_extract_all(hex(payload), '..'), lambda x: ('0x' || x)::INT) AS x FROM p),
f AS (SELECT *, list_transform(range(0, 72), lambda k: list_sum(x[k * payload_bytes // 72 + 1:(k + 1) * payload_bytes // 72])::DOUBLE / ((k + 1) * payload_bytes // 72 - k * payload_bytes // 72)) AS s FROM m)
SELECT doc_id, n_bytes, payload_bytes, sha256(payload) AS payload_sha256,
  xor(list_reduce(list_prepend(4294967295::BIGINT, x[-32:]::BIGINT[]), lambda c, v: list_reduce(list_prepend(xor(c, v), range(0, 8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT) AS tail_crc32,
  octet_length(medium)::BIGINT AS media_bytes, sha256(medium) AS media_sha256,
  printf('%.3f', list_sum(x)::DOUBLE / payload_bytes) || ':' || array_to_string(list_transform(range(0, 8), lambda r: printf('%02x', list_sum(list_transform(range(1, 9), lambda c: CASE WHEN s[r * 9 + c + 1] > s[r * 9 + c] THEN 1 << (8 - c)::INT ELSE 0 END))::INT)), '') AS feature
FROM f
"""
