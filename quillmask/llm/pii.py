"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. These seeds induce lexical patterns: the one or two
words before a seed, or after it, in lower case and with every digit as 0. A pattern is as good as the share of all its occurrences in
the corpus that stand beside an identifier, and an unseen identifier is as good as the patterns that it stands beside; Spark scores this
bipartite graph of patterns and instances in rounds. Identifiers that end above a confidence are promoted: they induce patterns in turn,
and so on until no new pattern has support. What confident patterns then mark are tokens of a looser shape than the base patterns allow.

One scan finds the seeds; each turn scans once more, counts every occurrence of its new patterns and extracts what stands beside them.
It looks patterns up in a bitmap of a fixed size; what its collisions let through is dropped by an exact join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import LOWER, arrow_map, batch, empty, materialise, mix, pieces, small, utf8, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Distinct identifiers that a pattern needs, the confidence that marks spans, rounds of scoring, and bits of the patterns' bitmap.
SUPPORT, CONFIDENCE, ROUNDS, BITMAP = 3, 0.8, 3, 1 << 22

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may stand beside a pattern, by kind, within a line.
_SHAPES = {
    "email": re.compile(r"[\w.%+'-]+ ?(?:@|\(at\)|\[at\]|\{at\}) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)*", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|,)[0-9]{1,3}){3}(?![0-9])|(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{0,4}(?:::?[0-9a-f]{1,4})*", re.I),
    "card": re.compile(r"[0-9](?:[ .-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?:\+ ?)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9])"),
}
_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@([{:")] = True
_C = np.random.default_rng(77).integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHAPE = LOWER.copy()
_SHAPE[48:58] = 48
#: What may follow an identifier in its word.
_TAIL = re.compile(r"[^\x20\x09-\x0D0-9A-Za-z]*")
_CLOSING = ".,;:!?\"'"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS) of every base match, by start and then kind; the expressions are searched in time linear in the text."""
    found: list[tuple[int, int, int]] = []
    at, past = text.find("@"), 0
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), 0))
            past = m.end()
        else:
            past = max(past, at + 1)  # no local part holds an @
        at = text.find("@", max(at + 1, past))
    for m in _IP.finditer(text):
        if all(int(x) <= 255 for x in m.group().split(".") if len(x.lstrip("0")) <= 3) and all(len(x.lstrip("0")) <= 3 for x in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def described(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def beside(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to two words before a span, if it begins a word, and up to two after it, if letters and digits of its last word end with it."""
    before: list[str] = []
    if start and not _WORD.match(text[start - 1]):
        for reach in (200, start):
            at = max(0, start - reach)
            before = _WORD.findall(text, at, start)
            if len(before) > 2 or at == 0:
                break
    after: list[str] = []
    rest = _TAIL.match(text, end).end()
    if rest == len(text) or not _WORD.match(text[rest]):
        for m in _WORD.finditer(text, rest):
            after.append(m.group())
            if len(after) == 2:
                break
    return before[-2:], after


def _pairs(h: np.ndarray, side: int) -> np.ndarray:
    """The pattern of each word but the last and its next, before (0) or after (1) an identifier."""
    return mix(h[:-1] * _C[3 * side] + h[1:] * _C[3 * side + 1])


def _ones(h: np.ndarray, side: int) -> np.ndarray:
    return mix(h * _C[3 * side + 2])


def patterns_of(places: list[tuple[list[str], list[str]]]) -> list[list[int]]:
    """The patterns that the words beside each span make up, as hashes."""
    flat = [w for sides in places for words in sides for w in words]
    if not flat:
        return [[] for _ in places]
    data, bounds = utf8(pa.array(flat, pa.string()))
    h, _, _ = word_hashes(_SHAPE[data], bounds, lower=False)
    out, at = [], 0
    for before, after in places:
        b, a = h[at : at + len(before)], h[at + len(before) : at + len(before) + len(after)]
        at += len(before) + len(after)
        own = [_ones(b[-1:], 0), _pairs(b, 0) if len(b) > 1 else b[:0], _ones(a[:1], 1), _pairs(a, 1) if len(a) > 1 else a[:0]]
        out.append(np.concatenate(own).view(np.int64).tolist())
    return out


def _seeds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) -> per row its base spans and the seeds (kind, instance, patterns)."""
    seed = pa.struct([("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.int64()))])
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base", pa.string()), ("base_sha256", pa.string()), ("seeds", pa.list_(seed))])
    for b in pieces(it, 2):
        text = b.column(2)
        worth = pc.fill_null(pc.or_(pc.match_substring(text, "@"), pc.match_substring_regex(text, "[0-9]")), False).to_pylist()
        spans: list[list] = [[] for _ in worth]
        who, kinds, places, instances = [], [], [], []
        for i, hit in enumerate(worth):
            if hit:
                t = text[i].as_py()
                spans[i] = base_spans(t)
                for s, e, k in spans[i]:
                    who.append(i)
                    kinds.append(k)
                    places.append(beside(t, s, e))
                    instances.append(t[s:e].lower())
        seeds: list[list] = [[] for _ in worth]
        for i, k, x, p in zip(who, kinds, instances, patterns_of(places)):
            if p:
                seeds[i].append({"kind": k, "instance": x, "patterns": p})
        base = [described(s) for s in spans]
        counts = [[sum(x[2] == k for x in s) for s in spans] for k in range(len(KINDS))]
        yield batch(schema, b.column(0), b.column(1), *counts, base, [hashlib.sha256(x.encode()).hexdigest() for x in base], seeds)


class _Text:
    """A text whose identifiers are looked for from a byte on, or up to one."""

    def __init__(self, raw: np.ndarray):
        self.text = raw.tobytes().decode(errors="replace")
        self.place = np.cumsum((raw & 0xC0) != 0x80) - 1
        self.stop, self.lines = -1, {}

    def onward(self, byte: int) -> Iterator[tuple[int, int, int]]:
        """(kind, start, end) of what begins with the word at a byte."""
        start = int(self.place[byte])
        if start > self.stop:
            self.stop = self.text.find("\n", start)
            self.stop = len(self.text) if self.stop < 0 else self.stop
        for k, kind in enumerate(KINDS):
            if m := _SHAPES[kind].match(self.text, start, self.stop):
                yield k, start, m.end()

    def back(self, byte: int) -> Iterator[tuple[int, int, int]]:
        """(kind, start, end) of what ends with the word before the one at a byte, but for closing marks, on its line. A line is searched once."""
        end = len(self.text[: int(self.place[byte])].rstrip(" \t\n\x0b\f\r")) if byte < len(self.place) else len(self.text)
        while end and self.text[end - 1] in _CLOSING:
            end -= 1
        line = self.text.rfind("\n", 0, end) + 1
        if line not in self.lines:
            stop = self.text.find("\n", line)
            found: dict[int, list] = {}
            for k, kind in enumerate(KINDS):
                for m in _SHAPES[kind].finditer(self.text, line, len(self.text) if stop < 0 else stop):
                    if m.start() == line or not _WORD.match(self.text[m.start() - 1]):
                        found.setdefault(m.end(), []).append((k, m.start(), m.end()))
            self.lines[line] = found
        yield from self.lines[line].get(end, ())


_OCCURRENCE = [("pattern", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.int64()))]


def _occurrences(bitmap: bytes):
    """(doc_id, text_hash, text) -> (pattern, n) for how often each listed pattern occurs, and the identifiers that stand beside it, with the patterns beside them."""
    bits = np.frombuffer(bitmap, np.uint8)
    schema = pa.schema(_OCCURRENCE)

    def listed(p: np.ndarray) -> np.ndarray:
        slot = p & np.uint64(BITMAP - 1)
        return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(it, 2):
            data, bounds = utf8(b.column(2))
            h, first, at = word_hashes(_SHAPE[data], bounds, lower=False)
            if not len(h):
                continue
            marked = np.add.reduceat(_MARK[data], first, dtype=np.int64) > 0
            joint = np.ones(len(h), bool)  # whether a word and the one before are of one text
            joint[at[:-1][at[:-1] < len(h)]] = False
            near = marked.copy()  # or a neighbour in the same text is
            near[:-1] |= marked[1:] & joint[1:]
            near[1:] |= marked[:-1] & joint[1:]
            hits: list[tuple] = []  # pattern, word at which the identifier begins (side 0) or before which it ends (side 1), side
            names, counts = [], []
            for side in (0, 1):
                for wide, p in ((0, _ones(h, side)), (1, _pairs(h, side) if len(h) > 1 else h[:0])):
                    found = listed(p)
                    if wide:
                        found &= joint[1:]
                    where = np.flatnonzero(found)
                    if not len(where):
                        continue
                    n, c = np.unique(p[where], return_counts=True)
                    names.append(n)
                    counts.append(c)
                    word = where + wide + 1 if side == 0 else where
                    inside = (word < len(h)) & (word > 0)
                    where, word = where[inside], word[inside]
                    fits = joint[word] & near[word if side == 0 else word - 1]
                    hits += zip(word[fits].tolist(), [side] * int(fits.sum()), p[where[fits]].view(np.int64).tolist())
            if not names:
                continue
            k = sum(map(len, names))
            blank = [None] * k
            yield batch(schema, np.concatenate(names).view(np.int64), np.concatenate(counts), *[blank] * 7)
            ids, hashes = b.column(0), b.column(1)
            hits.sort()
            docs = (np.searchsorted(at, [w for w, *_ in hits], "right") - 1).tolist()
            rows, places, now, own = [], [], -1, None
            for (word, side, p), d in zip(hits, docs):
                if d != now:
                    now, own = d, _Text(data[bounds[d] : bounds[d + 1]])
                byte = int(first[word] - bounds[d])
                for kind, s, e in own.onward(byte) if side == 0 else own.back(byte):
                    rows.append((p, None, ids[d].as_py(), hashes[d].as_py(), kind, s, e, own.text[s:e].lower()))
                    places.append(beside(own.text, s, e))
            if rows:
                yield batch(schema, *map(list, zip(*rows)), patterns_of(places))

    return fn


def score(seeds: DataFrame, totals: DataFrame, candidates: DataFrame, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confidence of (pattern, kind) and of (instance, kind), from edges seeds/candidates(pattern, kind, instance, n) and totals(pattern, total).

    A pattern's confidence is the scores of its instances by occurrence over all its occurrences; seeds score 1 throughout. An unseen
    instance scores 1 - prod(1 - confidence) over its patterns.
    """
    known = seeds.groupBy("pattern", "kind", "instance").agg(F.sum("n").alias("n"))
    instances = known.select("kind", "instance").distinct()
    unseen = materialise(candidates.join(instances, ["kind", "instance"], "left_anti").groupBy("pattern", "kind", "instance").agg(F.sum("n").alias("n")), "pii-unseen")
    both = known.select("pattern", "kind", "n").unionByName(unseen.select("pattern", "kind", F.lit(0).cast("bigint").alias("n")))
    sure = materialise(both.groupBy("pattern", "kind").agg(F.sum("n").alias("sure")).join(totals, "pattern"), "pii-sure")
    sound = lambda extra: F.least(F.lit(1.0), (F.col("sure") + extra) / (F.col("total") + 1.0))
    patterns = sure.select("pattern", "kind", sound(F.lit(0.0)).alias("confidence"))
    scores = None
    for i in range(rounds):
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
        scores = materialise(unseen.join(patterns, ["pattern", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("score")), f"pii-scores-{i}")
        extra = unseen.join(scores, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("extra"))
        patterns = materialise(sure.join(extra, ["pattern", "kind"], "left").select("pattern", "kind", sound(F.coalesce("extra", F.lit(0.0))).alias("confidence")), f"pii-patterns-{i}")
    return patterns.where(F.col("confidence") >= confidence), scores.where(F.col("score") >= confidence)


def _bitmap(patterns: DataFrame) -> bytes | None:
    """A bit for each pattern's slot; collects BITMAP / 8 rows at most. None if there are none."""
    byte = F.shiftright(F.col("pattern").bitwiseAND(F.lit(BITMAP - 1)), 3)
    bits = patterns.groupBy(byte.alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(pattern & 7 as int))")).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, np.uint8)
    for r in bits:
        out[r["byte"]] = r["bits"]
    return out.tobytes() if bits else None


def discover(keyed: DataFrame, base: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """Spans (doc_id, text_hash, kind, start, end) that confident patterns mark; None if no pattern has support.

    Turns end when no pattern is new; patterns are finite, as each has an occurrence in the corpus.
    """
    seeds = base.select(F.explode("seeds").alias("s")).select("s.kind", "s.instance", F.explode("s.patterns").alias("pattern"))
    own = materialise(seeds.groupBy("pattern", "kind", "instance").agg(F.count("*").alias("n")), "pii-edges")
    edges, seen, totals, found = own.select("pattern", "kind", "instance"), None, None, None
    while True:
        strong = materialise(edges.groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("m")).where(F.col("m") >= support).select("pattern", "kind"), "pii-strong")
        fresh = strong.select("pattern").distinct()
        fresh = materialise(fresh if totals is None else fresh.join(totals.select("pattern"), "pattern", "left_anti"), "pii-fresh")
        bitmap = None if empty(fresh) else _bitmap(fresh)
        if bitmap is None:
            return found
        kinds = "pattern bigint, n bigint, doc_id bigint, text_hash bigint, kind int, start bigint, end bigint, instance string, patterns array<bigint>"
        more = materialise(keyed, "pii-occurrences", _occurrences(bitmap), kinds).join(fresh, "pattern", "left_semi")
        seen = more if seen is None else seen.unionByName(more)
        totals = materialise(seen.where("n IS NOT NULL").groupBy("pattern").agg(F.sum("n").alias("total")), "pii-totals")
        candidates = materialise(seen.where("n IS NULL").join(strong, ["pattern", "kind"], "left_semi").drop("n"), "pii-candidates")
        patterns, scores = score(own.join(strong, ["pattern", "kind"], "left_semi"), totals, candidates.select("pattern", "kind", "instance", F.lit(1).alias("n")), confidence)
        marked = materialise(candidates.join(patterns.select("pattern", "kind"), ["pattern", "kind"], "left_semi").join(scores.select("kind", "instance"), ["kind", "instance"], "left_semi").select("doc_id", "text_hash", "kind", "start", "end", "instance", "patterns").distinct(), "pii-marked")
        found = marked.select("doc_id", "text_hash", "kind", "start", "end")
        edges = own.select("pattern", "kind", "instance").unionByName(marked.select(F.explode("patterns").alias("pattern"), "kind", "instance"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


_SPAN = "array<struct<start: bigint, end: bigint, kind: int>>"


def find_pii(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text_hash, n_email, n_ip, n_card, n_phone, base_sha256, spans, all_spans; one row per row of docs.

    The counts and base_sha256 are those of the base spans. spans is "kind:start:end" by start, then kind (email, ip, card, phone), of
    base and discovered spans, in code points; all_spans the same as structs. A discovered span that overlaps a base span, or an
    earlier discovered one, is left out. Null and empty texts have no spans; equal rows get equal results; doc_ids may be null or
    repeat. Other columns of docs are ignored; an empty table gives an empty result.
    """
    keyed = _keyed(docs)
    seeds = "array<struct<kind: int, instance: string, patterns: array<bigint>>>"
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    base = materialise(keyed, "pii-base", _seeds, f"doc_id bigint, text_hash bigint, {counts}, base string, base_sha256 string, seeds {seeds}")
    found = discover(keyed, base, support, confidence)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    own = F.when(F.col("base") == "", F.array().cast(_SPAN)).otherwise(
        F.transform(F.split("base", ","), lambda x: F.struct(F.split(x, ":")[1].cast("bigint").alias("start"), F.split(x, ":")[2].cast("bigint").alias("end"), (F.array_position(kinds, F.split(x, ":")[0]) - 1).cast("int").alias("kind")))
    )
    rows = base.withColumn("own", own)
    if found is None:
        rows = rows.withColumn("all_spans", F.col("own"))
    else:
        more = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("more"))  # identifiers of one text
        more = materialise(more, "pii-more").toDF("__id", "__hash", "more")
        rows = rows.join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash").eqNullSafe(F.col("__hash"))), "left")
        fits = lambda acc, x: ~F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        merged = F.aggregate("more", F.col("own"), lambda acc, x: F.when(fits(acc, x), F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))).otherwise(acc))
        order: Column = F.transform(F.sort_array(F.transform(merged, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        rows = rows.withColumn("all_spans", F.when(F.col("more").isNull(), F.col("own")).otherwise(order))
    spans = F.array_join(F.transform("all_spans", lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("doc_id", "text_hash", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), "all_spans")


def _mask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, spans, ...) -> row, text with each span replaced by [KIND]; spans that overlap become one, named by the first."""
    for b in it:
        texts = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            parts, past = [], 0
            for item in (spans or "").split(",") if spans else []:
                kind, s, e = item.split(":")
                s, e = int(s), int(e)
                if s >= past:
                    parts += [text[past:s], f"[{kind.upper()}]"]
                past = max(past, e)
            texts.append(text if text is None else "".join(parts) + text[past:])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["__row", "__text"])


def masked(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """docs with personal data in text replaced by [EMAIL], [IP], [CARD] or [PHONE], and n_chars, if there, adjusted; all rows and columns stay.

    Spans are looked up by (doc_id, text). While they are few enough to be broadcast, texts stay where they are; beyond that the join
    sends each text once.
    """
    spans = find_pii(docs, support, confidence).where("spans <> ''").groupBy("doc_id", "text_hash").agg(F.first("spans").alias("__spans"))
    spans = materialise(spans, "pii-spans").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__t"), F.xxhash64(F.col("text")).alias("__h"), F.col("doc_id").alias("__d"))
    rows = rows.join(small(spans, size=F.octet_length("__spans")), F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    kind = docs.select(F.struct(*docs.columns).alias("r")).schema["r"].dataType.simpleString()
    out = arrow_map(rows.select("__row", "__t", "__spans"), _mask, f"__row {kind}, __text string")
    text = lambda c: F.col("__text") if c == "text" else F.when(F.col("__row.n_chars").isNotNull(), F.length("__text")).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"__row.`{c}`")
    return out.select(*[text(c).alias(c) for c in docs.columns])
