"""SentencePiece encoding and decoding with N-best segmentations.

A text is cut into units that no piece crosses: between characters of which no piece holds the last byte of one and the first of the other. Forward Viterbi scores, best and
second best, run over the distinct units of a batch at once, by length; units that the worker has met before are looked up. The N best
segmentations of a text differ from the best one in the N - 1 units whose second best is nearest, so a backward A-star search runs over
the piece lattice of each of these, with forward Viterbi scores as exact heuristics: its first complete paths are the best ones of the
unit, and the N best sums of one path from each unit are the N best of the text.

For a BPE model the ids that its tokenizer gives come from merges in their order, not from sums of scores; these are computed as well,
unit by unit, by the library itself. For a unigram model they are the best segmentation.

A segmentation's score is the sum of its pieces' scores in the model file. A character without a piece of its own is spelled in byte
pieces, together 10 below the lowest score. Spaces are kept as they are, and a space is put before the text; decoding takes it away.
"""

from __future__ import annotations

import heapq
import importlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import arrow_map, batch, give_back, mix, pieces, utf8

SPACE, MARK = 0x20, "▁"
#: Units of more bytes are segmented one by one; texts are handled so many bytes at a time.
LONG, BYTES = 48, 1 << 20
#: Distinct units, and ids of their segmentations, that a worker remembers; beyond, it starts anew with those of the batch.
UNITS, UNIT_IDS = 200_000, 2_000_000
#: Units whose best segmentations a worker remembers.
WAYS = 20_000
FILTER = 1 << 21

_rng = np.random.default_rng(4242)
_LETTERS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(4096, _BASE)]))
ENCODED = "doc_id bigint, ids array<int>, best array<int>, score double, alternatives array<struct<score: double, edits: array<struct<at: int, n: int, ids: array<int>>>>>, round_trip boolean"


def default_model() -> str:
    """Path of a model file with byte fallback: QUILLMASK_PIECE_MODEL, or else that of the package public_tokenizers, where there is one."""
    if path := os.environ.get("QUILLMASK_PIECE_MODEL"):
        return path
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def hash_bytes(data: bytes) -> int:
    h = np.zeros(1, np.uint64)
    for c in data:
        h = h * _BASE + _LETTERS[c : c + 1]
    return int(mix(h)[0])


@dataclass
class Units:
    """What is known of distinct units, by their hashes in order. ids are those of the best segmentations, own the tokenizer's, on end."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gap: np.ndarray = field(default_factory=lambda: np.zeros(0))  # from the best score to the second best
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    own_begin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    own_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def places(self, names: np.ndarray) -> np.ndarray:
        """Where each of these is; -1: unknown."""
        if not len(self.names):
            return np.full(len(names), -1)
        spot = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[spot] == names, spot, -1)

    def plus(self, more: Units) -> Units:
        names = np.concatenate([self.names, more.names])
        order = np.argsort(names)
        both = lambda c, shift=0: np.concatenate([getattr(self, c), getattr(more, c) + shift])[order]
        flat = (np.concatenate([self.ids, more.ids]), np.concatenate([self.own, more.own]))
        return Units(names[order], both("scores"), both("gap"), both("begin", len(self.ids)), both("count"), both("own_begin", len(self.own)), both("own_count"), *flat)


@dataclass
class Model:
    ids: dict[bytes, int]
    scores: np.ndarray  # by id
    surface: list[bytes]  # by id; a piece's bytes, with spaces
    byte_ids: np.ndarray
    unknown: float
    keys: np.ndarray  # sorted hashes of pieces, and their ids
    key_ids: np.ndarray
    filter: np.ndarray
    longest: int
    joins: np.ndarray  # by 256 * a byte + the next: whether both may be of one unit
    merges: object  # the library's processor, for a BPE model
    lead: bytes  # a byte that is a unit of its own, and how many ids it takes with the space before it
    lead_ids: int
    units: Units = field(default_factory=Units)  # met so far
    ways: dict[tuple[bytes, int], list[tuple[float, list[int]]]] = field(default_factory=dict)  # best segmentations of units, searched so far


@lru_cache(4)
def load(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    surface = [b""] * n
    for i in plain:
        surface[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    for b, i in enumerate(byte_ids):
        surface[i] = bytes([b])
    scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
    ids = {surface[i]: i for i in plain}
    if any(b" " in s.lstrip(b" ") for s in ids):
        raise ValueError("a piece goes on after a space")
    keys = np.array([hash_bytes(s) for s in ids], np.uint64)
    order = np.argsort(keys)
    flags = np.zeros(FILTER, bool)
    flags[keys & np.uint64(FILTER - 1)] = True
    # merges may go by way of pieces that are unused in the end
    whole = [sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    joins = np.zeros((256, 256), bool)
    for s in whole:
        for a, b in zip(s, s[1:]):
            joins[a, b] = True
    inside = {b for s in whole if len(s) > 1 for b in s}
    joins[:, 0x80:0xC0] = True  # a character is never cut
    bpe = is_bpe(open(path, "rb").read())
    lone = [b for b in range(1, 128) if b != SPACE and b not in inside]
    lead = bytes(lone[:1])
    lead_ids = len(sp.encode(lead.decode())) if bpe and lead else 0
    return Model(ids, scores, surface, byte_ids, float(scores[plain].min()) - 10, keys[order], np.array(list(ids.values()))[order], flags, max(map(len, ids)), joins.ravel(), sp if bpe else None, lead, lead_ids)


def is_bpe(proto: bytes) -> bool:
    """Whether a model file says that its pieces are merges: model_type, field 3 of trainer_spec, field 2 of the file, is 2."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                out |= (data[at] & 127) << shift
                at, shift = at + 1, shift + 7
                if data[at - 1] < 128:
                    return out

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            elif tag & 7 == 2:
                n = number()
                yield tag >> 3, data[at : at + n]
                at += n
            else:
                at += 8 if tag & 7 == 1 else 4

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return dict(fields(spec)).get(3, 1) == 2


def edges(m: Model, unit: bytes) -> list[list[tuple[int, int, float]]]:
    """For each byte of a unit: (end, id, score) of the pieces that begin there."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in unit]
    at = 0
    while at < len(unit):
        size = 1 + (unit[at] >= 0xC0) + (unit[at] >= 0xE0) + (unit[at] >= 0xF0)
        for end in range(at + 1, min(at + m.longest, len(unit)) + 1):
            if (i := m.ids.get(unit[at:end])) is not None:
                out[at].append((end, i, float(m.scores[i])))
        if unit[at : at + size] not in m.ids:
            for b in range(at, at + size):
                out[b].append((b + 1, int(m.byte_ids[unit[b]]), m.unknown / size))
        at += size
    return out


def forward(lattice: list[list[tuple[int, int, float]]]) -> tuple[list[float], list[tuple[int, int]]]:
    """Viterbi: the best score up to each byte, and the piece (begin, id) that it ends with."""
    n = len(lattice)
    best, back = [0.0] + [-np.inf] * n, [(-1, -1)] * (n + 1)
    for at, out in enumerate(lattice):
        if best[at] > -np.inf:
            for end, i, s in out:
                if best[at] + s > best[end]:
                    best[end], back[end] = best[at] + s, (at, i)
    return best, back


def runner_up(lattice: list[list[tuple[int, int, float]]]) -> float:
    """The second best path's score, -inf if there is one path only."""
    best, second = [0.0] + [-np.inf] * len(lattice), [-np.inf] * (len(lattice) + 1)
    for at, out in enumerate(lattice):
        if best[at] > -np.inf:
            for end, _, s in out:
                a = best[at] + s
                second[end] = max(second[end], second[at] + s, min(a, best[end]))
                best[end] = max(best[end], a)
    return second[-1]


def n_best(lattice: list[list[tuple[int, int, float]]], n: int) -> list[tuple[float, list[int]]]:
    """The n best paths, best first: backward A-star, whose heuristic is the forward Viterbi score; equal scores in the order of ids."""
    best, _ = forward(lattice)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(lattice) + 1)]
    for at, out in enumerate(lattice):
        if best[at] > -np.inf:
            for end, i, s in out:
                into[end].append((at, i, s))
    # sums of the same scores in another order differ in their last bits; of equal ones the path that is nearer to the start goes on,
    # so that the search runs straight to the start however many ties there are
    grain = max(1e-9, abs(best[-1]) * 1e-12)
    queue: list[tuple] = [(round(-best[-1] / grain), len(lattice), 0, 0.0, None)]
    found, number = [], 0
    while queue and len(found) < n:
        _, at, _, tail, path = heapq.heappop(queue)
        if at == 0:
            ids, link = [], path
            while link:
                i, link = link
                ids.append(i)
            found.append((tail, ids))
            continue
        for begin, i, s in into[at]:
            number += 1
            heapq.heappush(queue, (round(-(best[begin] + s + tail) / grain), begin, number, tail + s, (i, path)))
    return found


def merged(m: Model, units: list[bytes]) -> list[list[int]]:
    """The ids that the model's own tokenizer gives for each unit; merges never cross units."""
    # the library puts a space before a text; a unit without one goes behind a byte that merges with nothing
    bare = [u if u[:1] != b" " else u[1:] for u in units]
    texts = [x if u[:1] == b" " else m.lead + x for x, u in zip(bare, units)]
    out = m.merges.encode([t.decode() for t in texts], num_threads=1)
    return [[m.ids[u]] if u == b" " else ids if u[:1] == b" " else ids[m.lead_ids :] for ids, u in zip(out, units)]


def _viterbi(m: Model, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """units: n x length bytes -> best scores, distance to the second best (inf: none), ids in rows padded by -1 on the left, their numbers."""
    n, size = units.shape
    h = np.zeros((size + 1, n), np.uint64)
    for j in range(size):
        h[j + 1] = h[j] * _BASE + _LETTERS[units[:, j]]
    best, second = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
    best[0] = 0
    back, back_id = np.zeros((size + 1, n), np.int16), np.zeros((size + 1, n), np.int32)

    def relax(end: int, at: int, rows: np.ndarray, ids: np.ndarray, s: np.ndarray):
        a, b = best[at, rows] + s, second[at, rows] + s
        top = best[end, rows]
        better = a > top
        second[end, rows] = np.maximum(np.maximum(second[end, rows], b), np.minimum(a, top))
        best[end, rows] = np.maximum(a, top)
        won = rows[better]
        back[end, won], back_id[end, won] = at, ids[better]

    lead = (units & 0xC0) != 0x80
    width = 1 + (units >= 0xC0) + (units >= 0xE0) + (units >= 0xF0)
    spelled = np.zeros(n, np.int64)  # bytes of the current character that are still to be spelled, and how many it has
    wide = np.ones(n, np.int64)
    for at in range(size):
        open_ = np.flatnonzero(lead[:, at])
        has_own = np.zeros(n, bool)
        for end in range(at + 1, min(at + m.longest, size) + 1) if len(open_) else ():
            x = mix(h[end, open_] - h[at, open_] * _POWERS[end - at])
            maybe = m.filter[x & np.uint64(FILTER - 1)]
            if not maybe.any():
                continue
            x, rows = x[maybe], open_[maybe]
            spot = np.minimum(np.searchsorted(m.keys, x), len(m.keys) - 1)
            real = m.keys[spot] == x
            rows, ids = rows[real], m.key_ids[spot[real]]
            if len(rows):
                has_own[rows] |= width[rows, at] == end - at
                relax(end, at, rows, ids, m.scores[ids])
        fresh = open_[~has_own[open_]]
        spelled[fresh] = wide[fresh] = width[fresh, at]
        rows = np.flatnonzero(spelled > 0)
        if len(rows):
            relax(at + 1, at, rows, m.byte_ids[units[rows, at]], m.unknown / wide[rows])
            spelled[rows] -= 1
    ids, count, place = np.full((n, size), -1, np.int32), np.zeros(n, np.int64), np.full(n, size)
    while (rows := np.flatnonzero(place > 0)).size:
        ids[rows, size - 1 - count[rows]] = back_id[place[rows], rows]
        count[rows] += 1
        place[rows] = back[place[rows], rows]
    return best[size], best[size] - second[size], ids, count


def gather(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[begins[i]:begins[i] + counts[i]] for all i, one after the other."""
    ends = np.cumsum(counts)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)]


def _units(m: Model, data: np.ndarray, names: np.ndarray, u_first: np.ndarray, u_size: np.ndarray) -> Units:
    """Segments units, data[u_first[i]:u_first[i] + u_size[i]], whose hashes are names, in order."""
    n = len(names)
    scores, gap, begin, count = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    flat: list[np.ndarray] = []
    total = 0
    for size in np.unique(u_size).tolist():
        members = np.flatnonzero(u_size == size)
        if size <= LONG:
            s, d, ids, c = _viterbi(m, data[u_first[members][:, None] + np.arange(size)])
            rows = ids[ids >= 0]
        else:
            s, d, c, many = np.zeros(len(members)), np.zeros(len(members)), np.zeros(len(members), np.int64), []
            for j, u in enumerate(members.tolist()):
                lattice = edges(m, data[u_first[u] : u_first[u] + size].tobytes())
                best, back = forward(lattice)
                path, at = [], size
                while at:
                    at, i = back[at]
                    path.append(i)
                s[j], d[j], c[j] = best[-1], best[-1] - runner_up(lattice), len(path)
                many += path[::-1]
            rows = np.array(many, np.int32)
        scores[members], gap[members], count[members] = s, d, c
        begin[members] = total + np.cumsum(c) - c
        flat.append(rows)
        total += len(rows)
    flat_ids = np.concatenate(flat)
    if m.merges is None:
        return Units(names, scores, gap, begin, count, begin, count, flat_ids, flat_ids)
    u_bytes = [data[f : f + z].tobytes() for f, z in zip(u_first.tolist(), u_size.tolist())]
    own = merged(m, u_bytes)
    for j, u in enumerate(u_bytes):
        if MARK.encode() in u:  # the library reads a text's own mark as a space
            own[j] = flat_ids[begin[j] : begin[j] + count[j]].tolist()
    sizes_of = np.fromiter(map(len, own), np.int64, n)
    return Units(names, scores, gap, begin, count, np.cumsum(sizes_of) - sizes_of, sizes_of, flat_ids, np.fromiter(chain.from_iterable(own), np.int32, int(sizes_of.sum())))


def segment(m: Model, text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]:
    """The best ids of all texts on end, the places where texts begin and end, scores, for each text its other n - 1 best, and the tokenizer's own ids and their places."""
    raw, ends = utf8(text)
    k = len(ends) - 1
    lengths = np.diff(ends)
    shown = lengths > 0  # an empty text has no pieces
    bounds = np.concatenate([[0], np.cumsum(lengths + shown)])
    data = np.empty(bounds[-1], np.uint8)
    data[bounds[:-1][shown]] = SPACE
    data[np.arange(len(raw)) + np.repeat(np.cumsum(shown), lengths)] = raw
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, np.zeros(k + 1, np.int64), np.zeros(k), [[] for _ in range(k)], none, np.zeros(k + 1, np.int64)
    begins = np.ones(len(data), bool)
    begins[1:] = ~m.joins[data[:-1].astype(np.uint16) << 8 | data[1:]]
    begins[bounds[:-1][shown]] = True
    first = np.flatnonzero(begins)
    sizes = np.diff(np.append(first, len(data)))
    where = np.arange(len(data)) - np.repeat(first, sizes)
    top = int(sizes.max())
    powers = _POWERS if top <= len(_POWERS) else np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(top, _BASE)]))
    names = mix(np.add.reduceat(_LETTERS[data] * powers[where], first)) ^ sizes.astype(np.uint64)
    names, seen, unit = np.unique(names, return_index=True, return_inverse=True)
    known = m.units
    spots = known.places(names)
    if len(known.names) + int((spots < 0).sum()) > UNITS or len(known.ids) > UNIT_IDS:
        known, spots = Units(), np.full(len(names), -1)
    if (spots < 0).any():
        fresh = seen[spots < 0]
        known = known.plus(_units(m, data, names[spots < 0], first[fresh], sizes[fresh]))
        spots = known.places(names)
    m.units = known
    unit = spots[unit]
    scores, gap, counts = known.scores, known.gap, known.count[unit]
    ids = gather(known.ids, known.begin[unit], counts)
    unit_at = np.searchsorted(first, bounds)
    ids_at = np.concatenate([[0], np.cumsum(counts)])
    sums = np.concatenate([[0.0], np.cumsum(scores[unit])])
    others: list[list] = []
    for i in range(k):
        lo, hi = int(unit_at[i]), int(unit_at[i + 1])
        others.append(_others(m, data, first, sizes, ids_at, gap[unit[lo:hi]], lo, n, ids) if n > 1 and hi > lo else [])
    best = np.array([scores[unit[unit_at[i] : unit_at[i + 1]]].sum() for i in range(k)]) if k else sums[:0]
    for i, rest in enumerate(others):
        for o in rest:
            o["score"] += best[i]
    if m.merges is None:
        return ids, ids_at[unit_at], best, others, ids, ids_at[unit_at]
    own_counts = known.own_count[unit]
    own_ids = gather(known.own, known.own_begin[unit], own_counts)
    return ids, ids_at[unit_at], best, others, own_ids, np.concatenate([[0], np.cumsum(own_counts)])[unit_at]


def _others(m: Model, data, first, sizes, ids_at, gap: np.ndarray, lo: int, n: int, ids: np.ndarray) -> list[dict]:
    """The second to nth best of one text, as what they change in the best: ids[at:at + n] become other ids. Scores are differences."""
    near = np.flatnonzero(gap < np.inf)
    if not len(near):
        return []
    if len(near) >= n:
        near = np.sort(near[np.lexsort((near, gap[near]))[: n - 1]])
    start, kept, out = int(ids_at[lo]), [ids[ids_at[lo + u] : ids_at[lo + u + 1]].tolist() for u in near.tolist()], []
    # a few more than n, as the best found here may be a tie of the one that was kept
    found: list[tuple[float, list[list[int]]]] = [(0.0, [])]
    for u in (lo + near).tolist():
        ways = _ways(m, data[first[u] : first[u] + sizes[u]].tobytes(), n + 1)
        found = sorted(((a + s, [*paths, path]) for a, paths in found for s, path in ways), key=lambda x: -x[0])[: n + 1]
    top = found[0][0]
    for score, paths in found:
        edits = [{"at": int(ids_at[lo + u]) - start, "n": len(old), "ids": own} for own, old, u in zip(paths, kept, near.tolist()) if own != old]
        if edits:
            out.append({"score": score - top, "edits": edits})
    return out[: n - 1]


def _ways(m: Model, unit: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a unit; those of short ones are remembered."""
    if (found := m.ways.get((unit, n))) is None:
        found = n_best(edges(m, unit), n)
        if len(unit) <= LONG:
            if len(m.ways) >= WAYS:
                m.ways.clear()
            m.ways[unit, n] = found
    return found


def decode_all(m: Model, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Texts of ids[at[i]:at[i + 1]], without the space put before them."""
    flat = np.frombuffer(b"".join(m.surface), np.uint8)
    sizes = np.array([len(s) for s in m.surface])
    begins = np.cumsum(sizes) - sizes
    data = gather(flat, begins[ids], sizes[ids]).tobytes()
    place = np.concatenate([[0], np.cumsum(sizes[ids])])[at].tolist()
    return [data[lo + 1 : hi] for lo, hi in zip(place, place[1:])]


def _model(path: str) -> Model:
    return load(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _encode(path: str, n: int):
    alternative = pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))])
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("best", pa.list_(pa.int32())), ("score", pa.float64()), ("alternatives", pa.list_(alternative)), ("round_trip", pa.bool_())])

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for b in pieces(it, 1, BYTES):
            wide = pa.schema([*schema, *(b.schema.field(i) for i in range(2, b.num_columns))])
            best, best_at, scores, others, ids, at = segment(m, b.column(1), n)
            raw, ends = utf8(b.column(1))
            raw = raw.tobytes()
            same = [x == y == raw[lo:hi] for x, y, lo, hi in zip(decode_all(m, ids, at), decode_all(m, best, best_at), ends.tolist(), ends[1:].tolist())]
            lists = (pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values, pa.int32())) for places, values in ((at, ids), (best_at, best)))
            yield batch(wide, b.column(0), *lists, scores, others, same, *(b.column(i) for i in range(2, b.num_columns)))
        give_back()

    return fn


def encode(docs: DataFrame, n: int = 4, model: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids, best, score, alternatives, round_trip; one row for each row of docs.

    ids are those of the model's own tokenizer, but for units that hold the mark U+2581, which it would decode as a space: these have
    the ids of best. best is the best segmentation of the piece lattice, score its sum of piece scores,
    alternatives the second to nth best as their scores and what they change in best (at `at`, n ids become others); fewer if there are
    no more. Of equal scores any may come first, always the same one. round_trip says that both decode to the text. Null and empty texts
    have no ids and score 0. doc_ids may be null or repeat; of the other columns only those named by `carry` stay, behind, as
    carried_NAME where the name is taken. The model file's path must be readable on the executors, or be sent there by spark.sparkContext.addFile.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"__{c}") for c in carry])
    kinds = "".join(f", `__{c}` {rows.schema[f'__{c}'].dataType.simpleString()}" for c in carry)
    out = arrow_map(rows, _encode(model or default_model(), n), ENCODED + kinds)
    made = out.columns[: len(out.columns) - len(carry)]
    return out.select(*made, *[F.col(f"__{c}").alias(f"carried_{c}" if c in made else c) for c in carry])


def _decode(path: str):
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for b in it:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            at = np.asarray(lists.offsets).astype(np.int64)
            ids = np.asarray(lists.values)[at[0] : at[-1]] if len(lists) else np.zeros(0, np.int32)
            texts = [t.decode(errors="replace") for t in decode_all(m, ids, at - at[0])] if len(lists) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return fn


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded(doc_id, ids, ...) -> doc_id, text; null or no ids give an empty text."""
    return arrow_map(encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), _decode(model or default_model()), "doc_id bigint, text string")
