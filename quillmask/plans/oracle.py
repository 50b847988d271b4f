"""SQL for DuckDB that gives the rows of the engine's queries, built from the same vocabularies but none of the engine's expressions."""

from __future__ import annotations

from quillmask.functions import vocab
from quillmask.plans.fixture import TEXTS


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(map(_s, xs))


#: Unicode blanks beyond ASCII's, and the vertical tab, which DuckDB's \\s leaves out.
_BLANKS = r"[\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def blanked(text: str) -> str:
    return f"regexp_replace({text}, '{_BLANKS}', ' ', 'g')"


def folded(text: str, word: str) -> str:
    """text in ASCII, character by character, as DuckDB's word boundaries, \\w, \\d and \\s are ASCII's: blanks become spaces, digits 3, other word characters `word`, the rest grave accents."""
    out = blanked(text)
    for regex, to in ((r"[^\x00-\x7F\P{Nd}]", "3"), (r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{M}]|[^\x00-\x7F\P{N}]", word), (r"[^\x00-\x7F]", "`")):
        out = f"regexp_replace({out}, '{regex}', '{to}', 'g')"
    return out


def texts(source: str) -> str:
    """A query over a table or query with doc_id and text: f is the text folded to underscores, g to capitals, for patterns with underscores of their own, and s with plain blanks."""
    t = "coalesce(text, '')"
    return f"SELECT doc_id, text, {folded(t, '_')} AS f, {folded(t, 'X')} AS g, {blanked(t)} AS s FROM {source}"


def spans(source: str, regex: str, kind: str, name: str, rank: int, flags: str = "", where: str = "true", column: str = "f") -> str:
    """Matches with offsets in a table of texts(): lengths of the pieces before and of the matches before; `m` is the match as folded, `own` the text."""
    r = _s(f"(?{flags}){regex}" if flags else regex)
    return f"""
SELECT doc_id, {rank} AS rank, i, start, "end", text, {_s(kind)} AS kind, {_s(name)} AS source, own FROM (SELECT doc_id, i, start::INT AS start, (start + length(m))::INT AS "end", substr(own, start::BIGINT + 1, length(m)) AS text, own FROM (
  SELECT doc_id, own, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, m[i] AS m
  FROM (SELECT doc_id, own, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, coalesce(text, '') AS own, regexp_extract_all({column}, {r}) AS m, string_split_regex({column}, {r}) AS g FROM {source}) WHERE len(m) > 0))) WHERE {where}"""


def pattern(name: str):
    return next(p for p in (*vocab.PATTERNS, *vocab.UNUSED_PATTERNS, *vocab.RULE_PATTERNS, *vocab.SECOND_PASS) if p.name == name)


#: Patterns without what DuckDB lacks, and the conditions on whole matches that say the same: none of these patterns can match differently
#: where a match is refused, as its groups of digits and its ends are fixed by word boundaries.
_PLAIN = {
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", r"NOT regexp_matches(text, '^(000|666|9)|-00-|-0000$')"),
    "alphanumeric_id": (r"\b[A-Z0-9]{10,20}\b", "regexp_matches(rest, '[A-Z]') AND regexp_matches(rest, '[0-9]')"),
}


def one(source: str, name: str, rank: int = 0, where: str = "true") -> str:
    p = pattern(name)
    flags = "i" if "i" in p.flags else ""
    if name in ("username", "rule_username"):
        return _handles(source, name, rank, where)
    if name == "email":
        return _addresses(source, rank, where)
    regex, own = _PLAIN.get(name, (p.regex, "true"))
    own = own.replace("rest", "string_split(substr(own, start + 1), chr(10))[1]")
    return spans(source, regex, p.kind, name, rank, flags, f"({where}) AND ({own})", "g" if name == "username_lax" else "f")


def _handles(source: str, name: str, rank: int, where: str) -> str:
    """Names after @: the character before is matched with them and taken off again."""
    regex = r"(?:^|[^a-zA-Z0-9\-_.])@[A-Za-z]+[A-Za-z0-9\-_]+" if name == "rule_username" else r"(?:^|[^a-zA-Z0-9])@[A-Za-z][A-Za-z0-9_]{2,30}\b"
    # names are ASCII: those that aren't go on beyond the match
    rows = spans(source, regex, "username", name, rank, column="s" if name == "rule_username" else "f")
    bare = f"""SELECT doc_id, rank, i, start + (NOT starts_with(text, '@'))::INT AS start, "end", ltrim(text, substr(text, 1, (NOT starts_with(text, '@'))::INT)) AS text, kind, source, own FROM ({rows})"""
    return f"SELECT * FROM ({bare}) WHERE regexp_full_match(text, '[\\x00-\\x7F]*') AND ({where})"


def _addresses(source: str, rank: int, where: str) -> str:
    """The detector's addresses: local parts are ASCII, but begin at a boundary of any letters; what lies before that is taken off."""
    rows = spans(source, pattern("email").regex, "email", "email", rank)
    bare = f"""SELECT doc_id, rank, i, ("end" - length(t))::INT AS start, "end", t AS text, kind, source, own FROM (SELECT *, regexp_replace(text, '^.*[^\\x00-\\x7F][A-Za-z0-9_]*', '') AS t FROM ({rows})) WHERE regexp_matches(t, '^[^@]+@')"""
    return f"SELECT * FROM ({bare}) WHERE {where}"


LUHN = "len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda j: CASE WHEN (len(d) - j) % 2 = 0 THEN d[j]::INT WHEN d[j]::INT > 4 THEN 2 * d[j]::INT - 9 ELSE 2 * d[j]::INT END)) % 10 = 0"
LUHN_TEXT = "(SELECT " + LUHN + " FROM (SELECT string_split(regexp_replace(text, '[^0-9]', '', 'g'), '') AS d))"
FIXTURE = "fixture AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_s(t)})" for i, t in enumerate(TEXTS)) + ") AS v(doc_id, text))"
DOCS = f"docs AS MATERIALIZED ({texts('documents')})"
#: All documents and, under negative ids, the fixture.
UNITED = f"{FIXTURE}, united AS MATERIALIZED ({texts('(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM fixture)')})"

RAW = f"{DOCS}, raw AS MATERIALIZED (SELECT * EXCLUDE (own), (row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) - 1)::INT AS ord, NULL::DOUBLE AS score FROM (" + " UNION ALL ".join(one("docs", p.name, i) for i, p in enumerate(vocab.SECOND_PASS)) + "))"


def _not_overlapped(rows: str) -> str:
    """rows(doc_id, rank, i, start, end, text, kind) -> doc_id and the structs that overlap none kept before, in order."""
    return f"""SELECT doc_id, unnest(list_reduce(list_transform(list({{'rank': rank, 'i': i, 's': start, 'e': "end", 'text': text, 'kind': kind}} ORDER BY rank, i), lambda x: [x]),
  lambda a, b: CASE WHEN len(list_filter(a, lambda y: y.s < b[1].e AND y.e > b[1].s)) > 0 THEN a ELSE list_concat(a, b) END)) AS x FROM ({rows}) GROUP BY doc_id"""


_COMMON = f"lower(text) NOT IN ({_list(vocab.BLOCKLIST)}) AND length(text) >= 3" + "".join(f" AND NOT contains(lower(text), {_s(b)})" for b in vocab.BLOCKLIST if " " in b)
_COUNT = r"length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))"
_OWN = {
    "credit_card": LUHN_TEXT,
    "alphanumeric_id": f"text NOT IN ({_list(vocab.ID_WORDS)})",
    "swift": f"length(text) IN (8, 11) AND upper(text) NOT IN ({_list(vocab.SWIFT_WORDS)})",
    "license_plate": rf"regexp_matches(text, '\p{{L}}') AND {_COUNT} BETWEEN 1 AND 6 AND length(replace(replace(text, '-', ''), ' ', '')) >= 5",
    "name": f"lower(text) NOT IN ({_list(vocab.NAME_PHRASES)})",
}
_KINDS = {
    "phone": f"{_COUNT} >= 7", "email": "contains(text, '@') AND contains(text, '.')", "ssn": f"{_COUNT} >= 9", "tax_id": f"{_COUNT} >= 9", "credit_card": f"{_COUNT} BETWEEN 13 AND 19",
    "bank_account": f"{_COUNT} BETWEEN 8 AND 17", "routing_number": f"{_COUNT} = 9", "vin": "length(text) = 17",
    "address": rf"{_COUNT} > 0 AND regexp_matches(text, '\p{{L}}') AND length(text) >= 10",
}
_STRIPPED = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"


def detected_regex(source: str) -> str:
    rows = " UNION ALL ".join(one(source, p.name, i, f"{_COMMON} AND ({_OWN.get(p.name, 'true')})") for i, p in enumerate(vocab.PATTERNS))
    return f"""SELECT doc_id, x.rank, x.i, x.s AS start, x.e AS "end", x.text, x.kind, 'enhanced_regex' AS source FROM ({_not_overlapped(rows)})"""


def detected_context(source: str) -> str:
    """The first value in the 100 characters after a keyword, if it is near enough: values are looked for anywhere and then measured."""
    rules = []
    for rank, (kind, keyword, value, any_case, gap) in enumerate(vocab.CONTEXT_RULES):
        val = _s(("(?i)" if any_case else "") + value)
        keys = spans(source, keyword, kind, "context", rank, "i")
        ahead = f"""SELECT *, {blanked('substr(own, "end" + 1, 100)')} AS a FROM ({keys})"""
        hits = f"""SELECT doc_id, rank, i, kind, "end" + length(string_split_regex(a, {val})[1]) AS start, length(string_split_regex(a, {val})[1]) AS gap, regexp_extract(a, {val}) AS v FROM ({ahead}) WHERE regexp_matches(a, {val})"""
        rows = f"""SELECT doc_id, rank, i, kind, start::INT AS start, (start + length(v))::INT AS "end", {_STRIPPED} AS text FROM ({hits}) WHERE gap <= {gap}"""
        rules.append(rf"""SELECT * FROM ({rows}) WHERE length(text) >= 3 AND regexp_matches(text, '[\p{{L}}\p{{N}}]') AND lower(text) NOT IN ({_list(vocab.SKIP_VALUES)}) AND ({_KINDS.get(kind, 'true')})""")
    return f"""SELECT doc_id, x.rank, x.i, x.s AS start, x.e AS "end", x.text, x.kind, 'context' AS source FROM ({_not_overlapped(" UNION ALL ".join(rules))})"""


def detected_rules(source: str) -> str:
    parts = [one(source, p.name, i, "regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Z]')" if p.name == "rule_id" else "true") for i, p in enumerate(vocab.RULE_PATTERNS)]
    return "SELECT doc_id, rank, i, start, \"end\", text, kind, 'rules' AS source FROM (" + " UNION ALL ".join(parts) + ")"


def reconciled(raw: str) -> str:
    """raw, whose steps these are, and the steps from it to reconciled."""
    return f"{raw}, {reconciled_steps()}"


def reconciled_steps() -> str:
    return f"""w1 AS (SELECT * REPLACE (CASE kind {" ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in vocab.TYPE_ALIASES.items())} ELSE kind END AS kind), CASE WHEN contains(source, 'regex') THEN 'regex' ELSE source END AS src, max("end") OVER (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM raw),
w2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR start >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, ord ROWS UNBOUNDED PRECEDING) AS island FROM w1),
w3 AS (SELECT doc_id, min(start) AS start, max("end") AS "end", first(text ORDER BY length(text) DESC, start, ord) AS text, list_sort(list(DISTINCT kind)) AS types, list_sort(list(DISTINCT src)) AS sources, avg(nullif(score, 0)) AS average FROM w2 GROUP BY doc_id, island),
w4 AS (SELECT *, CASE WHEN len(sources) >= 5 THEN 98 WHEN len(sources) = 4 THEN 95 WHEN len(sources) = 3 THEN 85 WHEN len(sources) = 2 THEN 70 ELSE 50 END + CASE WHEN list_has_any(sources, ['presidio', 'spacy']) THEN 5 ELSE 0 END
  + CASE WHEN list_contains(sources, 'context') THEN 5 ELSE 0 END - CASE WHEN len(types) > 1 THEN 10 ELSE 0 END - CASE WHEN len(types) > 2 THEN 5 ELSE 0 END AS points FROM w3),
w5 AS (SELECT * EXCLUDE (points, average), len(sources)::INT AS agreement_count, greatest(0, least(100, CASE WHEN average IS NULL THEN points ELSE trunc(points * 0.7::DOUBLE + average * 100 * 0.3::DOUBLE) END))::INT AS confidence_score,
  coalesce(list_filter([{_list(vocab.TYPE_PRIORITY)}], lambda x: list_contains(types, x))[1], types[1], 'unknown') AS primary_type FROM w4),
reconciled AS MATERIALIZED (SELECT *, CASE WHEN primary_type IN ({_list(vocab.HIGH_CONFIDENCE)}) OR confidence_score >= 80 THEN 'detector' ELSE 'risk_flag' END AS queue FROM w5)"""


def stored(rows: str) -> str:
    """Steps on from reconciled, whose query this is given: stored spans, a made-up history of decisions and what follows from it."""
    return f"""{rows},
spans AS MATERIALIZED (SELECT doc_id, queue AS span_type, (row_number() OVER (PARTITION BY doc_id, queue ORDER BY start, "end"))::INT AS span_id, start, "end", text, primary_type AS category, confidence_score, types, sources, agreement_count FROM reconciled),
events AS (
  SELECT doc_id, span_type, span_id, CASE WHEN span_type = 'detector' THEN 'approve' ELSE 'redact' END AS decision, (2 * start)::BIGINT AS seq FROM spans WHERE (doc_id + start) % 4 <> 3
  UNION ALL SELECT doc_id, span_type, span_id, CASE WHEN span_type = 'detector' THEN 'reject' ELSE 'dismiss' END, (2 * start + 1)::BIGINT FROM spans WHERE (doc_id + start) % 4 = 1
  UNION ALL SELECT doc_id, span_type, span_id, NULL, (2 * start + 1)::BIGINT FROM spans WHERE (doc_id + start) % 4 = 2 AND start % 2 = 0),
latest AS (SELECT doc_id, span_type, span_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, span_type, span_id ORDER BY seq DESC) AS r FROM events) WHERE r = 1 AND decision IS NOT NULL),
items AS (SELECT s.*, l.decision FROM spans s LEFT JOIN latest l USING (doc_id, span_type, span_id)),
truth AS (SELECT doc_id, start, "end", category, text FROM spans WHERE category IN ('email', 'phone')),
approved AS (SELECT doc_id, span_type, span_id, start, "end", text, category FROM items WHERE decision IN ('approve', 'redact'))"""


RECONCILED = reconciled(RAW)
STORED = stored(RECONCILED)

URGENCY = f"""CASE WHEN span_type = 'risk_flag' THEN CASE WHEN category IN ({_list(vocab.CRITICAL_FLAGS)}) THEN 'critical' ELSE 'elevated' END
  WHEN category IN ({_list(vocab.CRITICAL_SPANS)}) THEN 'critical' WHEN category IN ({_list(vocab.ELEVATED_SPANS)}) THEN 'elevated' ELSE 'standard' END"""
TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
INFER = rf"""CASE WHEN regexp_full_match(t, '\d{{3}}-\d{{2}}-\d{{4}}') THEN 'SSN' WHEN regexp_full_match(t, '\d{{3}}-\d{{3}}-\d{{4}}') THEN 'PHONE' WHEN contains(t, '@') THEN 'EMAIL'
  WHEN regexp_full_match(t, '\$[\d,]+(\.\d{{2}})?') THEN 'AMOUNT'
  WHEN regexp_full_match(t, '(?i)(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{{1,2}},\s+\d{{4}}') THEN 'DATE'
  WHEN regexp_full_match(t, '[A-Z][a-z]+(\s+[A-Z][a-z]+)*') THEN 'NAME' WHEN regexp_matches(t, '^[A-Z][a-z]+(\s+(&|and)\s+[A-Z][a-z]+)+') THEN 'ORG'
  WHEN regexp_full_match(t, '([A-Z][a-z]*\s+)+[A-Z][a-z]*') THEN 'ORG' ELSE 'TEXT' END"""
FALSE_POSITIVE = rf"""lower(t) IN ({_list(vocab.FALSE_POSITIVES)}) OR length(t) < 4 OR ends_with(t, ':') OR (kind IN ('organization', 'name') AND length(t) < 5 AND NOT regexp_matches(substr(t, 2), '\p{{Lu}}'))
  OR NOT (regexp_matches(t, '^[\p{{Lu}}\p{{Nd}}(+#@]') OR kind IN ('email', 'url', 'username', 'phone'))"""


def normalised(text: str) -> str:
    for entity, plain in vocab.HTML_ENTITIES:
        text = f"replace({text}, {_s(entity)}, {_s(plain)})"
    steps = (
        (r"[\t\r\f\x0B]+", " "), (r"([^\s\x0B]+@)[\s\x0B]*\n[\s\x0B]*([^\s\x0B]+)", r"\1\2"), (r"(\d+)[-.]?[\s\x0B]*\n[\s\x0B]*[-.]?(\d+)", r"\1-\2"),
        (r"(\d{3})\s*[-]?\s*\n\s*[-]?\s*(\d{2})\s*[-]?\s*\n?\s*[-]?\s*(\d{4})", r"\1-\2-\3"), (r"[\t\r\f\x0B\x{A0} ]+", " "), (r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", ""),
    )
    for regex, to in steps:
        text = f"regexp_replace({text}, {_s(regex)}, {_s(to)}, 'g')"
    return f"translate({text}, '–—', '--')"


def ensemble(source: str, score: str = "NULL::DOUBLE", more: str = "") -> str:
    """Steps from a table or query with doc_id and text to raw, the detections of the whole ensemble; docs are the normalised texts. `more` is a query over docs like detected_rules()."""
    parts = [detected_regex("docs"), more, detected_context("docs"), detected_rules("docs")]
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS detector, rank, i, start, \"end\", text, kind, source, {score if part is more else 'NULL::DOUBLE'} AS score FROM ({part})" for i, part in enumerate(parts) if part)
    docs = texts(f"(SELECT doc_id, {normalised('nfc_normalize(text)')} AS text FROM {source})")
    return f"""docs AS MATERIALIZED ({docs}), raw AS MATERIALIZED (SELECT doc_id, start, "end", text, kind, source, score, (row_number() OVER (PARTITION BY doc_id ORDER BY detector, rank, i) - 1)::INT AS ord FROM ({rows}) WHERE NOT (SELECT {FALSE_POSITIVE} FROM (SELECT {TRIM} AS t)))"""


def spliced(label: str) -> str:
    """Content of every document with approved spans (disjoint) replaced by the SQL expression `label` over a span."""
    return f"""
pieces AS (SELECT doc_id, start, "end", {label} AS r, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS past FROM approved),
joined AS (SELECT p.doc_id, string_agg(substr(d.text, past + 1, start - past) || r, '' ORDER BY start) AS head, max("end") AS past, count(*) AS n FROM pieces p JOIN docs d USING (doc_id) GROUP BY p.doc_id),
content AS (SELECT d.doc_id, coalesce(j.head, '') || substr(d.text, coalesce(j.past, 0) + 1) AS content, coalesce(j.n, 0) AS n FROM docs d LEFT JOIN joined j USING (doc_id))"""


_prefix = "CASE category " + " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in vocab.PSEUDONYM_PREFIXES.items()) + " ELSE 'ENTITY' END"
NORMAL = r"regexp_replace(lower(text), '^\s+|\s+$', '', 'g')"
MAPPINGS = f"""seen AS (SELECT doc_id, category, {NORMAL} AS normalized_text, text, -start AS a, span_type AS b, span_id AS c FROM approved),
firsts AS (SELECT doc_id, category, normalized_text, first(text ORDER BY a, b, c) AS original_text, first(a ORDER BY a, b, c) AS a, first(b ORDER BY a, b, c) AS b, first(c ORDER BY a, b, c) AS c, {_prefix} AS prefix FROM seen GROUP BY doc_id, category, normalized_text),
mappings AS (SELECT doc_id, original_text, normalized_text, category, prefix || '_' || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY a, b, c) AS pseudonym FROM firsts)"""

ENSEMBLE = reconciled(ensemble("documents"))
ENSEMBLE_STORED = stored(ENSEMBLE)
MAPPED = """last AS (SELECT doc_id, original_text, arg_max(pseudonym, struct_pack(c := category, n := normalized_text)) AS pseudonym FROM mappings GROUP BY doc_id, original_text),
mapped AS (SELECT doc_id, string_agg(original_text || '=' || pseudonym, '|' ORDER BY original_text) AS mapping FROM last GROUP BY doc_id)"""


def redactions(label: str) -> str:
    """Each document's redactions from right to left, as one text."""
    return f"""redactions AS (SELECT doc_id, string_agg(start || ':' || "end" || ':' || category || ':' || text || ':' || {label}, '|' ORDER BY start DESC, span_type, span_id) AS listed FROM approved GROUP BY doc_id)"""
