"""Detectors: from a text column to arrays of spans, each an expression that needs no shuffle.

detect() returns the table with one array column per detector; explode_spans() makes rows of them. Entity recognisers plug in as a
function from a text to spans (ner()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions import vocab
from quillmask.functions.spans import AHEAD, EMPTY, all_spans, by_rank, found_of, greedy_ranks, let, literal, pattern_spans, prepared
from quillmask.functions.vocab import Pattern

Recogniser = Callable[[str], Iterable[dict]]
RAW = "array<struct<start: int, end: int, text: string, kind: string, source: string, rank: int, score: double>>"


def _any(words: Iterable[str]) -> str:
    return ", ".join(literal(w) for w in words)


# conditions on x.text by pattern; a candidate that fails doesn't reserve its range
_COMMON = f"lower(x.text) NOT IN ({_any(vocab.BLOCKLIST)}) AND NOT exists(array({_any(w for w in vocab.BLOCKLIST if ' ' in w)}), b -> contains(lower(x.text), b)) AND length(x.text) >= 3"
_COUNT = r"length(regexp_replace(x.text, '(?U)\\D', ''))"
_CARD = r"regexp_replace(x.text, '[^0-9]', '')"
_OWN = {
    "credit_card": f"length({_CARD}) BETWEEN 13 AND 19 AND luhn_check({_CARD})",
    "alphanumeric_id": f"x.text NOT IN ({_any(vocab.ID_WORDS)})",
    "swift": f"length(x.text) IN (8, 11) AND upper(x.text) NOT IN ({_any(vocab.SWIFT_WORDS)})",
    "license_plate": rf"x.text RLIKE '\\p{{L}}' AND x.text RLIKE '(?U)\\d' AND {_COUNT} <= 6 AND length(replace(replace(x.text, '-', ''), ' ', '')) >= 5",
    "name": f"lower(x.text) NOT IN ({_any(vocab.NAME_PHRASES)})",
} | {name: "(" + " OR ".join(f"contains(lower(substring(__t, greatest(x.start - 50, 0) + 1, least(50, x.start))), {literal(w)})" for w in words) + ")" for name, words in vocab.LOOK_BEHIND.items()}


def valid(names: list[str]) -> str:
    """SQL condition on a match x in the text __t of the pattern of rank r."""
    own = " ".join(f"WHEN {i} THEN {_OWN[n]}" for i, n in enumerate(names) if n in _OWN)
    return f"{_COMMON} AND CASE r {own} ELSE true END" if own else _COMMON


def regex_spans(patterns: tuple[Pattern, ...] = vocab.PATTERNS, source: str = "enhanced_regex") -> str:
    """SQL: validated matches of all patterns, each kept unless it overlaps one of an earlier pattern or an earlier match."""
    return greedy_ranks(len(patterns), pattern_spans(patterns, [source] * len(patterns), valid([p.name for p in patterns])))


_MANY = r"length(regexp_replace(x.text, '(?U)\\D', ''))"
_VALUE = {
    "phone": f"{_MANY} >= 7",
    "email": "contains(x.text, '@') AND contains(x.text, '.')",
    "ssn": f"{_MANY} >= 9",
    "tax_id": f"{_MANY} >= 9",
    "credit_card": f"{_MANY} BETWEEN 13 AND 19",
    "bank_account": f"{_MANY} BETWEEN 8 AND 17",
    "routing_number": f"{_MANY} = 9",
    "vin": "length(x.text) = 17",
    "address": r"x.text RLIKE '(?U)\\d' AND x.text RLIKE '\\p{L}' AND length(x.text) >= 10",
}


def context_spans() -> str:
    """SQL: for each rule's keywords, the first value in the next 100 characters if the gap is small enough; ranges in rule order."""
    # the words that a keyword begins with
    begins = [vocab.some(*keyword.removeprefix(r"\b(?:").split(")", 1)[0].split("|")) for _, keyword, *_ in vocab.CONTEXT_RULES]
    keys = found_of([(guard, f"(?Ui){keyword}") for guard, (_, keyword, *_) in zip(begins, vocab.CONTEXT_RULES)], 100)
    # the gap and the value, from a search that is tied to the keyword's end
    value = by_rank([f"(?U{'i' if any_case else ''})\\A((?s:.){{0,{gap}}}?)(?:{value})" for _, _, value, any_case, gap in vocab.CONTEXT_RULES])
    hit = let("w", f"substring_index(k.text, '{AHEAD}', -1)", f"named_struct('end', k.end, 'v', regexp_extract(w, {value}, 0), 'gap', length(regexp_extract(w, {value}, 1)))")
    bare = r"regexp_replace(substring(h.v, h.gap + 1), '(?U)^\\s+|\\s+$', '')"
    kinds = [kind for kind, *_ in vocab.CONTEXT_RULES]
    spans = f"transform(filter(transform({keys}, k -> {hit}), h -> h.v <> ''), h -> named_struct('start', h.end + h.gap, 'end', h.end + length(h.v), 'text', {bare}, 'kind', {by_rank(kinds)}, 'source', 'context', 'rank', r))"
    own = " ".join(f"WHEN {literal(kind)} THEN {condition}" for kind, condition in _VALUE.items())
    ok = rf"length(x.text) >= 3 AND x.text RLIKE '(?U)[\\p{{L}}\\p{{N}}]' AND lower(x.text) NOT IN ({_any(vocab.SKIP_VALUES)}) AND CASE x.kind {own} ELSE true END"
    return greedy_ranks(len(kinds), f"filter({spans}, x -> {ok})", apart=False)


def rule_spans() -> str:
    """SQL: URLs, handles and mixed capital identifiers; they may overlap."""
    mixed = next(i for i, p in enumerate(vocab.RULE_PATTERNS) if p.name == "rule_id")
    return all_spans(vocab.RULE_PATTERNS, ["rules"] * len(vocab.RULE_PATTERNS), f"r <> {mixed} OR x.text RLIKE '[0-9]' AND x.text RLIKE '[A-Z]'")


def legacy_spans() -> str:
    by = {p.name: p for p in vocab.SECOND_PASS}
    return all_spans([by[n] for n in vocab.LEGACY_ORDER], ["legacy_regex"] * len(vocab.LEGACY_ORDER))


def second_pass_spans() -> str:
    """SQL: the second pass before redacted ranges are taken out; findings may overlap each other."""
    return all_spans(vocab.SECOND_PASS, [p.name for p in vocab.SECOND_PASS])


DETECTORS = {"regex": regex_spans, "context": context_spans, "rules": rule_spans, "legacy": legacy_spans, "second_pass": second_pass_spans}


def detect(docs: DataFrame, detectors: Iterable[str] = ("regex", "context", "rules"), text: str = "text") -> DataFrame:
    """docs with an array column of spans for each detector, named after it. Null texts have none. Names that begin with two underscores are reserved."""
    t = prepared(docs, text)
    return t.withColumns({name: F.expr(DETECTORS[name]()) for name in detectors}).drop("__t", "__l", "__n", "__u")


def ner(docs: DataFrame, recogniser: Callable[[], Recogniser], source: str, types: dict[str, str], keep_unknown: bool, text: str = "text") -> DataFrame:
    """docs with an array column of an entity recogniser's spans, named by `source`, for use beside detect().

    recogniser() is called once in each Python worker and returns a function from a text to dicts with start, end, label and, if there
    is one, score. Labels are lower-cased and mapped by `types`; others keep their name or are dropped. A text on which the function fails
    has no spans.
    """

    @F.pandas_udf(RAW)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = recogniser()
        for s in texts:
            out = []
            for t in s:
                try:
                    hits = [(x, types.get(x["label"].lower(), x["label"].lower() if keep_unknown else None)) for x in (find(t) if t else ())]
                except Exception:  # noqa: BLE001  a recogniser's failure on one text isn't the table's
                    hits = []
                out.append([{"start": x["start"], "end": x["end"], "text": t[x["start"] : x["end"]], "kind": k, "source": source, "rank": 0, "score": x.get("score")} for x, k in hits if k])
            yield pd.Series(out)

    return docs.withColumn(source, run(F.col(text)))


def explode_spans(detected: DataFrame, columns: Iterable[str], keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Rows (keys, ord, start, end, text, kind, source, rank, score) of the array columns, in their order; ord numbers a key row's spans."""
    columns = list(columns)
    fields = ("start", "end", "text", "kind", "source", "rank")
    score = {f.name: any(g.name == "score" for g in f.dataType.elementType.fields) for f in detected.schema.fields if f.name in columns}

    def typed(c: str) -> Column:
        own = lambda x: x["score"].cast("double") if score[c] else F.lit(None).cast("double")
        return F.transform(F.coalesce(F.col(c), F.expr(EMPTY if not score[c] else f"CAST(array() AS {RAW})")), lambda x: F.struct(*[x[f].alias(f) for f in fields], own(x).alias("score")))

    spans = F.flatten(F.array(*[typed(c) for c in columns]))
    return detected.select(*keys, F.posexplode(spans).alias("ord", "x")).select(*keys, "ord", *[F.col(f"x.{f}").alias(f) for f in (*fields, "score")])


def false_positive(text: Column, kind: Column) -> Column:
    """Whether a detection is to be dropped: a listed label, a fragment, a heading, a short name, or a word that starts in lower case."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    short = kind.isin("organization", "name") & (F.length(t) < 5) & ~F.substring(t, 2, 1 << 30).rlike(r"\p{Lu}")
    starts = t.rlike(r"(?U)^[\p{Lu}\d(+#@]") | kind.isin("email", "url", "username", "phone")
    return F.lower(t).isin(*vocab.FALSE_POSITIVES) | (F.length(t) < 4) | t.endswith(":") | short | ~starts
