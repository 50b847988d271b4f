"""Spans in texts: find-all with offsets, overlap, greedy suppression and splicing, as Catalyst expressions.

A span is struct<start, end, text, kind, source, rank>; offsets are code points, half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.vocab import Pattern

SPAN = "struct<start: int, end: int, text: string, kind: string, source: string, rank: int>"
EMPTY = f"CAST(array() AS array<{SPAN}>)"
_MATCH = "struct<start: int, end: int, text: string>"
#: Noncharacters that mark matches, and the one that stands for them where a text holds them.
CUT, AHEAD, STAND_IN = "\uffff", "\ufffe", "\ufdd0"
#: Matches that are added up in one go.
CHUNK = 64
_POWERS = f"array({', '.join(str(1 << k) for k in range(24, -1, -1))})"


def safe(text: str) -> str:
    """SQL: text without the marks; a search by bytes each, which copies nothing if there are none."""
    return f"replace(replace({text}, '{CUT}', '{STAND_IN}'), '{AHEAD}', '{STAND_IN}')"


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with what patterns and their guards look at; names that begin with two underscores are reserved.

    __t is the text or '', __l is __t in lower case as case-blind matching sees it, __n its words with a digit and __u those with two
    capital letters in a row, joined by spaces. Both are short, so that most patterns are settled on a few characters a text.
    """
    t = docs.withColumn("__t", F.expr(safe(f"coalesce(`{text}`, '')")))
    words = lambda regex: F.array_join(F.regexp_extract_all("__t", F.lit(regex), F.lit(0)), " ")
    # long s, dotless i and dotted I match s and i when case is ignored
    lower = F.lower(F.expr("replace(replace(replace(__t, 'ſ', 's'), 'ı', 'i'), 'İ', 'I')"))
    return t.withColumns({"__l": lower, "__n": words(r"(?U)(?<!\S)[^\s\d]*+\d\S*+"), "__u": words(r"(?U)(?<!\S)\S*?[A-Z]{2}\S*+")})


def literal(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _placed(parts: str, match: str = "x.m") -> str:
    """SQL: from pieces and matches in turn to matches with their places; `match` is the matched text of an element x.m.

    Places add up the lengths of what comes before, CHUNK matches at a time, so that the cost is in proportion to their number.
    """
    pairs = f"transform(sequence(0, size({parts}) div 2 - 1), k -> named_struct('g', length({parts}[2 * k]), 'm', {parts}[2 * k + 1]))"
    end = f"b.at + x.g + length({match})"
    inner = f"aggregate(c, named_struct('at', a.at, 'out', CAST(array() AS array<{_MATCH}>)), (b, x) -> named_struct('at', {end}, 'out', concat(b.out, array(named_struct('start', b.at + x.g, 'end', {end}, 'text', x.m)))))"
    step = let("r", inner, "named_struct('at', r.at, 'out', concat(a.out, array(r.out)))")
    chunks = f"transform(sequence(0, (size(q) - 1) div {CHUNK}), i -> slice(q, {CHUNK} * i + 1, {CHUNK}))"
    return let("q", pairs, f"aggregate({chunks}, named_struct('at', 0, 'out', CAST(array() AS array<array<{_MATCH}>>)), (a, c) -> {step}, a -> flatten(a.out))")


def _mark(text: str, regex: str, ahead: int = 0) -> str:
    if ahead:
        regex, put = f"{regex}(?=([\\s\\S]{{0,{ahead}}}))", f"{CUT}$0{AHEAD}$1{CUT}"
    else:
        put = f"{CUT}$0{CUT}"
    return f"regexp_replace({text}, {literal(regex)}, '{put}')"


def _cut(marked: str, match: str = "x.m") -> str:
    return let("m", marked, f"IF(contains(m, '{CUT}'), {let('p', f"split(m, '{CUT}', -1)", _placed('p', match))}, CAST(array() AS array<{_MATCH}>))")


def found(text: str, regex: str) -> str:
    """SQL: the non-overlapping matches of a regex in the SQL expression `text`, as array<struct<start, end, text>>.

    One pass of the regex marks its matches, and places follow from the lengths between the marks. The expression must not match the
    empty string, and the text must be safe().
    """
    return _cut(_mark(text, regex))


def found_of(cases: list[tuple[str, str]], ahead: int = 0) -> str:
    """SQL: found() in __t of the regex of cases[r], for an r that is bound around it; a case is a guard, without which nothing is searched, and a regex.

    One expression for all patterns, which are searched one after the other, keeps plans small. With `ahead`, text is the match, AHEAD and
    that many characters of what follows; the regexes must then have no groups.
    """
    marked = "CASE r " + " ".join(f"WHEN {i} THEN IF({guard}, {_mark('__t', regex, ahead)}, '')" for i, (guard, regex) in enumerate(cases)) + " END"
    return _cut(marked, f"substring_index(x.m, '{AHEAD}', 1)" if ahead else "x.m")


def by_rank(names: list[str]) -> str:
    """SQL: the name of rank r."""
    return f"element_at(array({', '.join(map(literal, names))}), r + 1)"


def every_rank(n: int) -> str:
    return f"sequence(0, {n - 1})"


def pattern_spans(patterns: list[Pattern], sources: list[str], valid: str = "true") -> str:
    """SQL: spans in __t of the pattern of rank r that satisfy `valid`, a condition on x.text (and x.start and r)."""
    matches = found_of([(f"__n RLIKE {literal(p.java)}" if p.dense else p.guard, p.java) for p in patterns])
    if valid != "true":
        matches = f"filter({matches}, x -> {valid})"
    return f"transform({matches}, x -> named_struct('start', x.start, 'end', x.end, 'text', x.text, 'kind', {by_rank([p.kind for p in patterns])}, 'source', {by_rank(sources)}, 'rank', r))"


def all_spans(patterns: list[Pattern], sources: list[str], valid: str = "true") -> str:
    """SQL: spans of all patterns, by rank and place."""
    return f"flatten(transform({every_rank(len(patterns))}, r -> {pattern_spans(patterns, sources, valid)}))"


def find_all(name: str, regex: str) -> Column:
    """Column form of found() for a column's name; null text gives null, no match an empty array."""
    return F.expr(f"CASE WHEN `{name}` IS NOT NULL THEN {found(safe(f'`{name}`'), regex)} END")


def overlaps(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Half-open intervals overlap; touching ones don't."""
    return (start1 < end2) & (end1 > start2)


def _taken(kept: str) -> str:
    """SQL: whether a span x overlaps one of the spans `kept`, which are sorted and disjoint: a binary search for the last that begins before x ends."""
    at = f"aggregate({_POWERS}, 0, (n, k) -> IF(get({kept}, n + k - 1).start < x.end, n + k, n))"
    return f"coalesce(get({kept}, {at} - 1).end > x.start, false)"


def greedy_ranks(n: int, spans: str, apart: bool = True) -> str:
    """SQL: the spans of ranks 0 to n - 1 that overlap none kept before, by rank and place; `spans` gives those of rank r by start.

    Unless spans of a rank are `apart`, they may overlap each other and the first stays.
    """
    free = f"filter(g, x -> NOT {_taken('a')})"
    if not apart:
        free = f"aggregate({free}, named_struct('last', 0, 'out', {EMPTY}), (b, x) -> IF(x.start >= b.last, named_struct('last', x.end, 'out', concat(b.out, array(x))), b), b -> b.out)"
    kept = f"aggregate({every_rank(n)}, {EMPTY}, (a, r) -> {let('g', spans, f'IF(size(g) = 0, a, sort_array(concat(a, {free})))')})"
    return f"transform(sort_array(transform({kept}, x -> named_struct('rank', x.rank, 'x', x))), y -> y.x)"


def splice(text: Column, edits: Column) -> Column:
    """text with each of edits(start, end, replacement) applied in the order given, which must be from right to left."""
    put = lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"]), x["replacement"], F.substring(t, x["end"] + 1, F.length(t)))
    return F.aggregate(edits, text, put)


def nth_occurrence(text: Column, sub: str, n: int) -> Column:
    """Start of the n-th occurrence of sub, found again from the character after the last one; an error if there is none."""
    at = F.lit(0)
    for _ in range(n):
        at = F.call_function("locate", F.lit(sub), text, at + 1)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.lit(f"occurrence {n} of {sub!r} not found")))
