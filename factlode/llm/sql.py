"""The queries of this folder as DuckDB SQL, where SQL can express them. Patterns are the plain ones of the contract, written out here."""

BLANK = r"\x20\x09-\x0D"

#: name, pattern, validity of match m, score, context words, score from which a span counts
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|contact|write", 0),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0",
     0.6, "ip|host|server|address", 0),
    ("card", r"[0-9]([\x20-]?[0-9])+", """length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
        CASE WHEN k % 2 = 1 THEN CAST(digits[-k] AS INT) WHEN CAST(digits[-k] AS INT) > 4 THEN 2 * CAST(digits[-k] AS INT) - 9 ELSE 2 * CAST(digits[-k] AS INT) END)) % 10 = 0""",
     0.7, "card|visa|credit|payment", 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15", 0.6, "phone|tel|call|fax|mobile", 0),
    ("iban", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]+", """length(m) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(concat(m[5:], m[1:4]), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
        lambda acc, v: (acc * CASE WHEN v >= 10 THEN 100 ELSE 10 END + v) % 97) = 1""", 0.9, "iban|account|konto|cuenta|compte", 0.9),
    ("ssn", r"[0-9]+-[0-9]+-[0-9]+", r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)') AND m[5:6] <> '00' AND m[8:11] <> '0000'",
     0.3, "ssn|social|security", 0.6),
)


def _pii() -> str:
    parts = [f"""
  SELECT rid, {number} AS kind_no, '{name}' AS kind, start, start + length(m) AS stop, score FROM (
    SELECT *, least(1.0, {score} + CASE WHEN regexp_matches(lower(concat(right(before, 40), chr(10), left(after, 40))), '{words}') THEN 0.3 ELSE 0.0 END) AS score FROM (
      SELECT rid, m, before, after, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
        sum(length(before) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS start
      FROM (SELECT rid, i, ms[i] AS m, ps[i] AS before, ps[i + 1] AS after
            FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS i
                  FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d) WHERE len(ms) > 0)))
    WHERE {valid}) WHERE score >= {keep}""" for number, (name, pattern, valid, score, words, keep) in enumerate(KINDS)]
    text = "string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, kind_no)"
    counts = lambda names: ", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in names)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(parts)}),
found AS (SELECT rid, {text} AS spans, {text} FILTER (kind_no < 4) AS base, max(score) AS max_score,
  {', '.join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in KINDS)} FROM spans GROUP BY rid)
SELECT doc_id, {counts(('email', 'ip', 'card', 'phone'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, {counts(('iban', 'ssn'))},
  CAST(max_score AS DOUBLE) AS max_score FROM d LEFT JOIN found USING (rid)"""


_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
covered AS (SELECT rid, count(DISTINCT k) AS n FROM (
  SELECT rid, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1) GROUP BY rid),
facts AS (SELECT rid, doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[{BLANK}]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters,
    coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)),
judged AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * word_chars NOT BETWEEN 25 * n_words AND 120 * n_words OR 2 * n_dup_lines > len(lines)
       OR 2 * n_upper > n_words OR 2 * n_letters < word_chars) AS kept
FROM judged"""

_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BLANK}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reached AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, e.v FROM reached r JOIN edges e ON e.u = r.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reached GROUP BY u) c USING (doc_id)"""

_MIXING = f"""
WITH sized AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+')) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, CAST(2 * source_size AS DOUBLE) AS stop FROM sums),
ordered AS (SELECT *, row_number() OVER o AS place, coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighed WINDOW o AS (ORDER BY stop / weight, source NULLS LAST)),
levels AS (SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM sums) - stopped) / open AS level FROM ordered),
chosen AS (SELECT arg_min(level, place) AS level FROM levels WHERE weight * level <= stop),
targets AS (SELECT source, source_size, least(stop, weight * (SELECT level FROM chosen)) AS target FROM weighed),
drawn AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(CAST(2 AS DOUBLE), target / source_size) ELSE CAST(0 AS DOUBLE) END AS rate,
    CAST('0x' || md5(concat('0|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(d.source, ''), '|', md5(coalesce(text, ''))))[1:13] AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS INT) AS copies FROM drawn)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, rate, copies FROM counted"""

#: crc32 of an id written as text, bit by bit.
_CRC = """4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), list_transform(range(0, 8), lambda z: CAST(z AS BIGINT))), lambda c, z: xor(c // 2, (c % 2) * 3988292384)))"""

_TRIE = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base, ({_CRC}) % 4 AS head FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (SELECT h.conv_id, 0 AS part, t.place, mark, words FROM heads h JOIN turns t ON t.conv_id = h.base AND t.place <= h.head
  UNION ALL SELECT h.conv_id, 1, t.place, mark, words FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.place > h.head),
paths AS (SELECT h.conv_id, coalesce(list(mark ORDER BY part, place) FILTER (mark IS NOT NULL), []) AS path,
    coalesce(list(words ORDER BY part, place) FILTER (mark IS NOT NULL), []) AS words FROM heads h LEFT JOIN parts p ON p.conv_id = h.conv_id GROUP BY h.conv_id),
prefixes AS (SELECT conv_id, d AS depth, path[1:d] AS prefix, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w, len(path) = d AS ends
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY depth, prefix),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix),
below AS (SELECT prefix[1:d] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM known) GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens,
  k.ends_sha256
FROM known k JOIN below b ON b.prefix = k.prefix LEFT JOIN nodes p ON k.depth > 0 AND p.depth = k.depth - 1 AND p.prefix = k.prefix[1:k.depth - 1]"""

SQL: dict[str, str] = {
    "op1_pii": _pii(), "op4_jaccard_join": _JACCARD, "op6_quality_rules": _QUALITY, "op11_mixing": _MIXING, "op12_conversation_trie": _TRIE,
}
