"""Tables that stand for filings data: companies, filings, texts, claims."""

from __future__ import annotations

from factlode.registries import STATE_CENTROIDS
from factlode.sources.adapters import COVER, ITEM_7, ITEM_8
from oracle.build import cte
from oracle.chain import text

cte("companies", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS legal_name, concat('T', CAST(s_suppkey AS VARCHAR)) AS ticker,
  CAST(n_regionkey AS VARCHAR) AS sic, CAST(substr(lpad(CAST(s_suppkey AS VARCHAR), 10, '0'), 10, 1) AS INT) AS digit
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
cte("directory", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, concat('C', CAST(c_custkey AS VARCHAR)) AS ticker, c_name AS legal_name FROM customer
""")
cte("filings", """
SELECT CAST(o_orderkey AS VARCHAR) AS accession_number, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
  CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '10-K' WHEN '3-MEDIUM' THEN '10-Q'
    WHEN '4-NOT SPECIFIED' THEN '10-K/A' WHEN '5-LOW' THEN '10-Q/A' END AS form,
  CAST(o_orderdate AS DATE) AS filing_date, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS report_period,
  concat('doc', CAST(o_orderkey AS VARCHAR), '.htm') AS primary_document
FROM orders
""")

_STATES = ", ".join(text(s) for s, _, _ in STATE_CENTROIDS[:20])
_CENTRES = ", ".join(f"({text(s)}, {lat}::DOUBLE, {lon}::DOUBLE)" for s, lat, lon in STATE_CENTROIDS)
cte("addresses", f"""
SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, concat(CAST(c_custkey AS VARCHAR), ' Main St ') AS street1,
  CASE WHEN c_custkey % 3 = 0 THEN 'Floor 2' END AS street2, CASE WHEN c_custkey % 5 <> 0 THEN concat(' ', c_mktsegment) END AS city,
  CASE WHEN c_nationkey < 20 THEN lower([{_STATES}][c_nationkey + 1]) ELSE 'XX' END AS state,
  lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip, concat('https://data.example.org/', CAST(c_custkey AS VARCHAR)) AS source_url,
  sha256(c_name) AS source_sha256
FROM customer
""")
cte("address_lines", """
SELECT *, concat_ws(', ', nullif(trim(street1), ''), nullif(trim(street2), ''), nullif(trim(city), ''), nullif(trim(state), ''),
  nullif(trim(zip), '')) AS address FROM addresses
""")
cte("centroids", f"SELECT * FROM (VALUES {_CENTRES}) AS t(state, latitude, longitude)")

# ------------------------------------------------------------------------------- texts
_CLEAN = ("list_filter(list_transform(regexp_split_to_array({0}, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), "
          "lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'))), lambda l: l <> '')")


def clean_lines(column: str) -> str:
    return _CLEAN.format(column)


def casefold(column: str) -> str:
    return f"replace(lower({column}), 'ß', 'ss')"


def tokens(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({column})), '[\\p{{L}}\\p{{N}}]+')"


cte("documents_clean", f"""
SELECT lpad(CAST(doc_id // 10 AS VARCHAR), 10, '0') AS cik, concat('D-', CAST(doc_id AS VARCHAR)) AS accession_number,
  CASE WHEN lang = 'en' THEN '10-K' ELSE '10-Q' END AS form, concat('doc', CAST(doc_id AS VARCHAR), '.htm') AS primary_document,
  sha256(text) AS content_sha256,
  {clean_lines(f"concat_ws(chr(10), {text(COVER)}, {text(ITEM_7)}, text, {text(ITEM_8)}, concat('Source ', source, ' language ', lang))")} AS lines
FROM documents
""")
_HEAD = r"(?i)^(?:(PART\s+[IVX]+)\s+)?ITEM\s+([0-9]+[A-Z]?)(?:\.|\s|$)\s*(.*)$"
cte("placed_lines", f"""
SELECT accession_number, unnest(lines) AS line, generate_subscripts(lines, 1) AS n,
  unnest(list_transform(lines, lambda l: regexp_matches(l, '{_HEAD}'))) AS is_head FROM documents_clean
""")
cte("sectioned_lines", """
SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY accession_number ORDER BY n) AS piece,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY accession_number ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at
FROM placed_lines
""")
cte("sections", f"""
SELECT d.cik, d.accession_number, d.form, d.primary_document, d.content_sha256, s.piece, s.start_at, s.body,
  concat(CASE WHEN regexp_extract(s.head, '{_HEAD}', 1) <> '' THEN concat(regexp_extract(s.head, '{_HEAD}', 1), ' ') ELSE '' END,
    'Item ', regexp_extract(s.head, '{_HEAD}', 2)) AS section,
  nullif(trim(regexp_extract(s.head, '{_HEAD}', 3), ' .-—'), '') AS subsection
FROM documents_clean d JOIN (
  SELECT accession_number, piece, min(line_at) AS start_at, string_agg(line, chr(10) ORDER BY n) AS body, first(line ORDER BY n) AS head
  FROM sectioned_lines WHERE piece > 0 GROUP BY accession_number, piece) s ON s.accession_number = d.accession_number
""")
cte("chunks", """
SELECT *, 0 AS sequence, CAST(start_at AS BIGINT) AS start_offset, CAST(start_at + length(body) AS BIGINT) AS end_offset,
  concat('https://www.sec.gov/Archives/edgar/data/', CAST(CAST(cik AS BIGINT) AS VARCHAR), '/', replace(accession_number, '-', ''), '/',
    primary_document) AS source_url,
  sha256(concat_ws('|', content_sha256, '1.0.0', accession_number, section, '0', body)) AS chunk_id
FROM sections
""")

# ------------------------------------------------------------------------------ search
cte("queries", """
SELECT CAST(item_id AS VARCHAR) AS query_id, lpad(CAST(item_id AS VARCHAR), 10, '0') AS cik, text AS query FROM benchmark
""")
cte("query_words", f"""
SELECT query_id, cik, w.word, w.first_at, w.place FROM (
  SELECT query_id, cik, word, min(n) AS first_at, row_number() OVER (PARTITION BY query_id ORDER BY min(n)) AS place
  FROM (SELECT query_id, cik, unnest(ws) AS word, generate_subscripts(ws, 1) AS n
        FROM (SELECT *, regexp_extract_all({casefold('query')}, '[A-Za-z0-9][A-Za-z0-9_-]+') AS ws FROM queries))
  GROUP BY query_id, cik, word) w
""")


def _token_rows(chunks: str) -> str:
    return f"""
SELECT chunk_id, cik, form, section, unnest(list_concat(list_transform(a, lambda t: {{'term': t, 'weight': 2.0}}),
    list_concat(list_transform(b, lambda t: {{'term': t, 'weight': 1.0}}), list_transform(c, lambda t: {{'term': t, 'weight': 5.0}})))) AS t,
  len(a) + len(b) + len(c) AS length
FROM (SELECT chunk_id, cik, form, section, {tokens('section')} AS a, {tokens("coalesce(subsection, '')")} AS b, {tokens('body')} AS c FROM {chunks})
"""


cte("chunk_tokens", _token_rows("chunks"))
cte("postings", """
SELECT chunk_id, cik, form, length, t.term AS term, CAST(sum(t.weight) AS DOUBLE) AS frequency FROM chunk_tokens GROUP BY ALL
""")
cte("chunk_lengths", "SELECT cik, chunk_id, max(length) AS length FROM postings GROUP BY cik, chunk_id")
cte("corpus", "SELECT count(*) AS document_count, CAST(sum(length) AS DOUBLE) / count(*) AS average_length FROM chunk_lengths")
cte("frequencies", "SELECT term, count(*) AS document_frequency FROM postings GROUP BY term")


def _scores(words: str, postings: str = "postings", frequencies: str = "frequencies", condition: str = "true") -> str:
    idf = "ln((c.document_count - f.document_frequency + 0.5::DOUBLE) / (f.document_frequency + 0.5::DOUBLE))"
    norm = "1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * p.length / c.average_length)"
    return f"""
SELECT q.query_id, q.cik, p.chunk_id, sum(CAST((CASE WHEN {idf} <= 0 THEN 1e-6::DOUBLE ELSE {idf} END)
    * (p.frequency * 2.2::DOUBLE) / (p.frequency + {norm}) AS DECIMAL(28,12))) AS score
FROM {words} q JOIN {frequencies} f ON f.term = q.word JOIN {postings} p ON p.term = q.word AND p.cik = q.cik CROSS JOIN corpus c
WHERE {condition} GROUP BY q.query_id, q.cik, p.chunk_id
"""


cte("hits", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cik ORDER BY score DESC, chunk_id) AS rank
FROM ({_scores('query_words')})) WHERE rank <= 10
""")

# Porter's steps over the distinct words, one after the other; Y stands for a y that is a consonant.
_BEGIN = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_OVER_0, _OVER_1 = (lambda b: f"regexp_matches({b}, '{_BEGIN}')"), (lambda b: f"regexp_matches({b}, '{_BEGIN}+[aeiouy]+[^aeiouy]')")
_IS_1 = lambda b: f"({_OVER_0(b)} AND NOT {_OVER_1(b)})"
_CLOSED = lambda b: f"regexp_matches({b}, '[^aeiouy][aeiouy][^aeiouywxY]$')"


def _suffix_rules(word: str, rules: dict[str, str], over, more: dict[str, str] | None = None) -> str:
    """The longest suffix decides: its replacement where the rest is long enough, else the word as it is."""
    cases = []
    for suffix in sorted(rules, key=len, reverse=True):
        rest = f"left({word}, -{len(suffix)})"
        condition = over(rest) + (f" AND regexp_matches({rest}, '{more[suffix]}')" if more and suffix in more else "")
        cases.append(f"WHEN suffix({word}, '{suffix}') THEN CASE WHEN {condition} THEN concat({rest}, '{rules[suffix]}') ELSE {word} END")
    return f"CASE {' '.join(cases)} ELSE {word} END"


_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
           "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
           "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")
_STEPS = [
    "regexp_replace(regexp_replace(w, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')",
    "CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN left(w, -2) WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, -1) ELSE w END",
    f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_OVER_0('left(w, -3)')} THEN left(w, -1) ELSE w END "
    "WHEN suffix(w, 'ed') AND regexp_matches(left(w, -2), '[aeiouy]') THEN concat(left(w, -2), '#') "
    "WHEN suffix(w, 'ing') AND regexp_matches(left(w, -3), '[aeiouy]') THEN concat(left(w, -3), '#') ELSE w END",
    "CASE WHEN NOT suffix(w, '#') THEN w WHEN regexp_matches(w, '(at|bl|iz)#$') THEN concat(left(w, -1), 'e') "
    "WHEN lower(w[-2:-2]) = lower(w[-3:-3]) AND NOT regexp_matches(w, '[aeiouylsz]#$') THEN left(w, -2) "
    f"WHEN {_IS_1('left(w, -1)')} AND {_CLOSED('left(w, -1)')} THEN concat(left(w, -1), 'e') ELSE left(w, -1) END",
    "CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches(left(w, -1), '[aeiouy]') THEN concat(left(w, -1), 'i') ELSE w END",
    _suffix_rules("w", _STEP_2, _OVER_0),
    _suffix_rules("w", _STEP_3, _OVER_0),
    _suffix_rules("w", _STEP_4, _OVER_1, {"ion": "[st]$"}),
    f"CASE WHEN suffix(w, 'e') AND ({_OVER_1('left(w, -1)')} OR {_IS_1('left(w, -1)')} AND NOT {_CLOSED('left(w, -1)')}) THEN left(w, -1) ELSE w END",
    f"CASE WHEN suffix(w, 'll') AND {_OVER_1('left(w, -1)')} THEN left(w, -1) ELSE w END",
]


def stems(words: str) -> str:
    """(term, stem) of a relation with one column ``term`` of distinct words."""
    inner = f"SELECT term, term AS w FROM ({words})"
    for step in _STEPS:
        inner = f"SELECT term, {step} AS w FROM ({inner})"
    return f"SELECT term, CASE WHEN regexp_full_match(term, '[a-z]{{3,}}') THEN lower(w) ELSE term END AS stem FROM ({inner})"


cte("word_stems", stems(f"SELECT t.term AS term FROM chunk_tokens UNION SELECT unnest({tokens('word')}) FROM query_words"))
cte("stem_postings", """
SELECT chunk_id, cik, form, section, length, s.stem AS term, CAST(sum(t.weight) AS DOUBLE) AS frequency
FROM chunk_tokens JOIN word_stems s ON s.term = t.term GROUP BY ALL
""")
cte("stem_frequencies", "SELECT term, count(*) AS document_frequency FROM stem_postings GROUP BY term")
# words of one token only: the benchmark texts have no others
cte("stem_query_words", f"""
SELECT q.query_id, q.cik, q.word AS asked, s.stem AS word FROM query_words q JOIN word_stems s ON s.term = strip_accents(q.word)
""")


def stemmed_hits(condition: str = "true") -> str:
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cik ORDER BY score DESC, chunk_id) AS rank
FROM ({_scores('stem_query_words', 'stem_postings', 'stem_frequencies', condition)})) WHERE rank <= 10
"""


# phrases of the documents: two of them in each query, adjacent tokens in one column
cte("phrase_words", """
SELECT concat('d', doc_id) AS query_id, lpad(CAST(doc_id // 10 AS VARCHAR), 10, '0') AS cik,
  unnest([[ws[3], ws[4]], [ws[6], ws[7], ws[8]]]) AS ws FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents) WHERE len(ws) > 8
""")
cte("phrase_terms", f"""
SELECT DISTINCT query_id, cik, asked, word FROM (
  SELECT query_id, cik, CASE WHEN len(ws) = 2 THEN array_to_string(ws, '-') ELSE array_to_string(ws, '_') END AS asked, {tokens("array_to_string(ws, ' ')")} AS ts,
    array_to_string(ts, ' ') AS word FROM phrase_words)
""")
cte("chunk_phrases", f"""
SELECT chunk_id, cik, form, weight, unnest(list_concat(list_transform(range(1, len(ts)), lambda i: concat(ts[i], ' ', ts[i + 1])),
  list_transform(range(1, len(ts) - 1), lambda i: concat(ts[i], ' ', ts[i + 1], ' ', ts[i + 2])))) AS term
FROM (SELECT chunk_id, cik, form, u.ts AS ts, u.weight AS weight FROM (SELECT chunk_id, cik, form, unnest([{{'ts': {tokens('section')}, 'weight': 2.0}}, {{'ts': {tokens("coalesce(subsection, '')")}, 'weight': 1.0}},
    {{'ts': {tokens('body')}, 'weight': 5.0}}]) AS u FROM chunks))
""")
cte("phrase_postings", """
SELECT p.chunk_id, p.cik, p.form, l.length, p.term, CAST(sum(weight) AS DOUBLE) AS frequency
FROM chunk_phrases p JOIN chunk_lengths l ON l.chunk_id = p.chunk_id AND l.cik = p.cik WHERE p.term IN (SELECT word FROM phrase_terms) GROUP BY ALL
""")
cte("phrase_frequencies", "SELECT term, count(*) AS document_frequency FROM phrase_postings GROUP BY term")



def phrase_scores() -> str:
    return _scores("phrase_terms", "phrase_postings", "phrase_frequencies")


def company_scores() -> str:
    """Scores whose frequencies and lengths are those of the query's company, over its chunks of one form."""
    return _scores("query_words", "postings", "(SELECT cik, term, count(*) AS document_frequency FROM postings GROUP BY cik, term)", "p.form = '10-K'") \
        .replace("f.term = q.word JOIN", "f.term = q.word AND f.cik = q.cik JOIN") \
        .replace("CROSS JOIN corpus c", "JOIN (SELECT cik, count(*) AS document_count, avg(CAST(length AS DOUBLE)) AS average_length FROM chunk_lengths GROUP BY cik) c ON c.cik = q.cik")


# the chunks that remain after the refreshes of the stored index
cte("refreshed", """
SELECT chunk_id, cik, form, section, subsection, CASE WHEN number % 5 >= 3 AND section = 'Item 8' THEN concat(body, ' amended filing') ELSE body END AS body
FROM (SELECT *, CAST(accession_number[3:] AS BIGINT) AS number FROM chunks) WHERE number % 7 <> 3 OR number % 10 = 1
""")
cte("refreshed_tokens", _token_rows("refreshed"))
cte("refreshed_postings", """
SELECT chunk_id, length, t.term AS term, CAST(sum(t.weight) AS DOUBLE) AS frequency FROM refreshed_tokens GROUP BY ALL
""")

# ---------------------------------------------------------------------------- evidence
cte("signal_queries", """
SELECT signal_id, cik, signal_rank, test_id, concat_ws(' ', replace(test_id, '_', ' '), replace(evidence, '; ', ' ')) AS query FROM signals
""")
cte("signal_words", f"""
SELECT DISTINCT signal_id AS query_id, cik, unnest(regexp_extract_all({casefold('query')}, '[A-Za-z0-9][A-Za-z0-9_-]+')) AS word FROM signal_queries
""")
cte("signal_hits", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cik ORDER BY score DESC, chunk_id) AS rank
FROM ({_scores('signal_words')})) WHERE rank <= 8
""")

# signals of a company one after the other: each takes its best chunk that no earlier one took
cte("assigned", """
SELECT cik, packet_order, signal_id, signal_rank, chunk_id FROM (
  WITH RECURSIVE queue AS (
    SELECT h.cik, s.signal_id, s.signal_rank, list(h.chunk_id ORDER BY h.rank, h.chunk_id) AS hits,
      row_number() OVER (PARTITION BY h.cik ORDER BY s.signal_rank, s.signal_id) AS pos
    FROM signal_hits h JOIN signal_queries s ON s.signal_id = h.query_id AND s.cik = h.cik GROUP BY h.cik, s.signal_id, s.signal_rank),
  walk AS (
    SELECT DISTINCT cik, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS signal_id, CAST(0 AS BIGINT) AS signal_rank, CAST(NULL AS VARCHAR) AS chunk_id FROM queue
    UNION ALL
    SELECT cik, pos, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, signal_id, signal_rank, pick
    FROM (SELECT q.cik, q.pos, w.used, q.signal_id, q.signal_rank,
            CASE WHEN len(w.used) < 12 THEN list_filter(q.hits, lambda h: NOT list_contains(w.used, h))[1] END AS pick
          FROM walk w JOIN queue q ON q.cik = w.cik AND q.pos = w.pos + 1))
  SELECT *, len(used) - 1 AS packet_order FROM walk WHERE chunk_id IS NOT NULL)
""")


def excerpts(rows: str) -> str:
    """Rows with ``body`` and ``query``, their excerpt and where its first character lies (from 0)."""
    terms = f"list_filter(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda t: length(t) >= 4)"
    places = f"list_filter(list_transform({terms}, lambda t: instr({casefold('body')}, {casefold('t')})), lambda p: p > 0)"
    behind = lambda needle, size: f"CASE WHEN instr(reverse(before), {needle}) > 0 THEN length(before) - instr(reverse(before), {needle}) - {size - 1} ELSE -1 END"
    return f"""
SELECT *, trim(piece, {_SPACES}) AS excerpt,
  opened + CASE WHEN trim(piece, {_SPACES}) = '' THEN 0 ELSE instr(piece, trim(piece, {_SPACES})) - 1 END AS excerpt_start
FROM (SELECT *, substr(body, opened + 1, greatest(closed - opened, 0)) AS piece
  FROM (SELECT *, CASE WHEN sentence > line THEN sentence + 2 ELSE line + 1 END AS opened,
      CASE WHEN instr(substr(body, upto + 1), '. ') > 0 THEN upto + instr(substr(body, upto + 1), '. ') ELSE upto END AS closed
    FROM (SELECT *, {behind("' .'", 2)} AS sentence, {behind('chr(10)', 1)} AS line
      FROM (SELECT *, least(length(body), begun + 700) AS upto, substr(body, 1, begun) AS before
        FROM (SELECT *, greatest(0, coalesce(list_min({places}) - 1, 0) - 233) AS begun FROM ({rows})))))
)"""


_SPACES = "concat(' ', " + ", ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 32), 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + ")"
cte("packets", f"""
SELECT concat('E-', upper(sha256(concat_ws('|', signal_id, chunk_id, CAST(from_at AS VARCHAR), CAST(to_at AS VARCHAR))))) AS evidence_id, *,
  greatest(1, len(regexp_split_to_array(trim(regexp_replace(excerpt, '\\s+', ' ', 'g')), ' '))) AS token_count,
  concat('Lexical match for ', test_id, '; filtered to CIK ', cik, ' and retained section ', section, '.') AS selection_reason
FROM (SELECT *, start_offset + excerpt_start AS from_at, start_offset + excerpt_start + length(excerpt) AS to_at FROM ({excerpts("""
  SELECT a.cik, a.signal_id, a.signal_rank, q.test_id, q.query, c.chunk_id, c.section, c.subsection, c.body, c.start_offset, c.accession_number, c.source_url,
    c.content_sha256, CAST(h.score AS DOUBLE) AS score
  FROM assigned a JOIN signal_queries q ON q.signal_id = a.signal_id AND q.cik = a.cik JOIN chunks c ON c.chunk_id = a.chunk_id AND c.cik = a.cik
  JOIN signal_hits h ON h.query_id = a.signal_id AND h.chunk_id = a.chunk_id AND h.cik = a.cik""")}))
""")

# lines packed up to 2,400 characters: a line opens a chunk or joins the one before it
cte("packed_lines", """
SELECT accession_number, section, base_at, n, k, line_at, line FROM (
  WITH RECURSIVE lines AS (
    SELECT accession_number, section, start_at AS base_at, u.n AS n, trim(u.line) AS line
    FROM (SELECT accession_number, section, start_at, unnest(list_transform(string_split(body, chr(10)), lambda l, i: {'n': i, 'line': l})) AS u FROM sections)),
  walk AS (
    SELECT accession_number, section, base_at, n, 0 AS k, length(line) AS held, CAST(0 AS BIGINT) AS line_at, line FROM lines WHERE n = 1
    UNION ALL
    SELECT l.accession_number, l.section, l.base_at, l.n, CASE WHEN w.held + 1 + length(l.line) > 2400 THEN w.k + 1 ELSE w.k END,
      CASE WHEN w.held + 1 + length(l.line) > 2400 THEN length(l.line) ELSE w.held + 1 + length(l.line) END, w.line_at + length(w.line) + 1, l.line
    FROM walk w JOIN lines l ON l.accession_number = w.accession_number AND l.base_at = w.base_at AND l.n = w.n + 1)
  SELECT * FROM walk)
""")

# ------------------------------------------------------------------------------ claims
cte("turns", """
SELECT lpad(CAST(conv_id AS VARCHAR), 10, '0') AS run_id, CAST(conv_id AS VARCHAR) AS c, turn, role, length(text) AS n FROM conversations
""")
cte("claims", """
SELECT run_id, concat('claim-', c, '-', turn) AS claim_id, ['investigator', 'bull', 'skeptical'][(turn // 2) % 3 + 1] AS role,
  CASE WHEN n % 5 <> 0 THEN [concat('S', c, '-', turn % 4)] ELSE CAST([] AS VARCHAR[]) END AS signal_ids,
  [concat('E', c, '-', turn), concat('E', c, '-', turn + 2)] AS evidence_ids,
  CASE WHEN n % 3 = 0 THEN [concat('F', c, '-', n % 7)] ELSE [concat('M', c, '-', turn % 3), concat('F', c, '-', n % 7)] END AS fact_ids,
  [concat('M', c, '-', turn % 3)] AS metric_ids
FROM turns WHERE role = 'assistant'
""")
cte("verifications_once", """
SELECT run_id, concat('claim-', c, '-', turn - 1) AS claim_id, ['supported', 'partially_supported', 'unsupported', 'contradicted'][n % 4 + 1] AS status,
  CASE WHEN n % 2 = 0 THEN [concat('E', c, '-', turn - 1), concat('E', c, '-', turn + 3)] ELSE [concat('E', c, '-', turn - 1)] END AS checked, turn
FROM turns WHERE role = 'user' AND turn > 0
""")
cte("verifications", "SELECT * FROM verifications_once UNION ALL SELECT * FROM verifications_once WHERE turn = 2")
cte("run_signals", "SELECT DISTINCT run_id, concat('S', c, '-', turn % 4) AS signal_id FROM turns WHERE role = 'user'")
cte("run_evidence", "SELECT run_id, concat('E', c, '-', turn) AS evidence_id FROM turns WHERE n % 4 <> 0")
cte("allowed", """
SELECT run_id, 'signal' AS kind, signal_id AS reference_id FROM run_signals
UNION SELECT run_id, 'evidence', evidence_id FROM run_evidence
UNION SELECT run_id, 'fact', concat('F', c, '-', n % 7) FROM turns WHERE role = 'user'
UNION SELECT run_id, 'metric', concat('M', c, '-', turn % 3) FROM turns WHERE role = 'user'
""")
cte("repaired", """
SELECT c.* EXCLUDE (fact_ids), CASE WHEN len(list_filter(fact_ids, lambda f: NOT list_contains(af.ids, f))) > 0
    AND len(list_filter(fact_ids, lambda f: NOT list_contains(af.ids, f) AND NOT list_contains(am.ids, f))) = 0
  THEN list_filter(fact_ids, lambda f: list_contains(af.ids, f)) ELSE fact_ids END AS fact_ids
FROM claims c
LEFT JOIN (SELECT run_id, list(reference_id) AS ids FROM allowed WHERE kind = 'fact' GROUP BY run_id) af ON af.run_id = c.run_id
LEFT JOIN (SELECT run_id, list(reference_id) AS ids FROM allowed WHERE kind = 'metric' GROUP BY run_id) am ON am.run_id = c.run_id
""")


def _bad_references(claims: str) -> str:
    return f"""
SELECT r.run_id, r.role, r.claim_id, CASE r.kind WHEN 'signal' THEN 'claim_signal_invalid' WHEN 'evidence' THEN 'claim_evidence_invalid'
    WHEN 'fact' THEN 'claim_fact_invalid' ELSE 'claim_metric_invalid' END AS code, r.reference_id
FROM (SELECT run_id, role, claim_id, 'signal' AS kind, unnest(signal_ids) AS reference_id FROM {claims}
  UNION ALL SELECT run_id, role, claim_id, 'evidence', unnest(evidence_ids) FROM {claims}
  UNION ALL SELECT run_id, role, claim_id, 'fact', unnest(fact_ids) FROM {claims}
  UNION ALL SELECT run_id, role, claim_id, 'metric', unnest(metric_ids) FROM {claims}) r
WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.run_id = r.run_id AND a.kind = r.kind AND a.reference_id = r.reference_id)
UNION ALL
SELECT e.run_id, e.role, NULL, 'agent_signal_coverage_failed', NULL
FROM (SELECT run_id, unnest(['investigator', 'bull', 'skeptical']) AS role FROM (SELECT run_id FROM claims UNION SELECT run_id FROM allowed)) e
WHERE NOT EXISTS (SELECT 1 FROM {claims} c WHERE c.run_id = e.run_id AND c.role = e.role AND len(c.signal_ids) > 0)
"""


cte("claim_violations", _bad_references("claims"))
cte("repaired_violations", _bad_references("repaired"))
cte("uncovered", """
SELECT s.run_id, s.signal_id FROM run_signals s
WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.run_id = s.run_id AND list_contains(c.signal_ids, s.signal_id))
""")
cte("checked_evidence", "SELECT DISTINCT run_id, claim_id, unnest(checked) AS reference_id FROM verifications")
cte("verification_violations", """
SELECT coalesce(c.run_id, v.run_id) AS run_id, coalesce(c.claim_id, v.claim_id) AS claim_id, 'verifier_coverage_failed' AS code, CAST(NULL AS VARCHAR) AS reference_id
FROM claims c FULL JOIN (SELECT run_id, claim_id, count(*) AS n FROM verifications GROUP BY run_id, claim_id) v
  ON v.run_id = c.run_id AND v.claim_id = c.claim_id
WHERE c.claim_id IS NULL OR v.n IS NULL OR v.n > 1
UNION ALL
SELECT run_id, claim_id, 'verifier_evidence_invalid', reference_id FROM checked_evidence k
WHERE NOT EXISTS (SELECT 1 FROM run_evidence e WHERE e.run_id = k.run_id AND e.evidence_id = k.reference_id)
UNION ALL
SELECT k.run_id, k.claim_id, 'verifier_claim_scope_invalid', k.reference_id FROM checked_evidence k JOIN claims c ON c.run_id = k.run_id AND c.claim_id = k.claim_id
WHERE EXISTS (SELECT 1 FROM run_evidence e WHERE e.run_id = k.run_id AND e.evidence_id = k.reference_id) AND NOT list_contains(c.evidence_ids, k.reference_id)
""")

# ------------------------------------------------------------------------------- peers
cte("aligned", """
SELECT p.*, a.money AS assets, c.sic FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, metric_id, end_date ORDER BY coalesce(start_date, end_date), metric_result_id) AS choice
    FROM results WHERE computed) WHERE choice = 1) p
JOIN companies c ON c.cik = p.cik
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, end_date ORDER BY coalesce(start_date, end_date), metric_result_id) AS choice
    FROM results WHERE computed AND metric_id = 'assets') WHERE choice = 1) a ON a.cik = p.cik AND a.end_date = p.end_date
""")
cte("peer_stats", """
SELECT t.cik, t.metric_id, t.end_date, count(*) AS peer_count, quantile_cont(p.x, 0.25) AS first_quartile, quantile_cont(p.x, 0.5) AS median,
  quantile_cont(p.x, 0.75) AS third_quartile, CAST(sum(CASE WHEN p.x <= t.x THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS percentile
FROM (SELECT *, CAST(v AS DOUBLE) / 1e15 AS x FROM aligned WHERE assets <> 0) t
JOIN (SELECT *, CAST(v AS DOUBLE) / 1e15 AS x FROM aligned WHERE assets <> 0) p
  ON p.sic = t.sic AND p.metric_id = t.metric_id AND p.end_date = t.end_date AND p.cik <> t.cik
  AND p.assets BETWEEN least(t.assets * 0.5, t.assets * 2) AND greatest(t.assets * 0.5, t.assets * 2)
GROUP BY t.cik, t.metric_id, t.end_date
""")
