"""Quality classifier: a generalised additive model with pairwise interactions.

One scan turns whole texts into a few numbers each. On a bounded sample of labelled rows, cyclic boosting fits shallow trees on one
binned feature at a time, then on the pairs of features whose interaction explains most of what is left; the trees add up to lookup
tables. Scoring adds one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import SPACES, arrow_map, batch, materialise, mix, pieces, small, utf8, word_hashes

FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "digits", "sentence_marks", "commas", "exclamations", "brackets_quotes", "non_ascii",
    "line_breaks", "distinct_words", "same_as_previous", "repeated_windows", "repeated_lines", "top_word", "longest_word", "controls",
)
#: Labelled rows that are used for fitting at most; more are thinned by a hash of doc_id.
TRAIN_ROWS = 20_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, PAIR_BINS = 48, 60, 6, 30, 0.2, 12
_LEAST = 20.0  # rows of a leaf, and its ridge below

# classes of bytes: 0 other, 1 continuation, 2 lead byte, 3 upper, 4 lower, 5 digit, 6 sentence mark, 7 comma, 8 '!', 9 symbol, 10 bracket or quote, 11 line break, 12 other white space, 13 control
_CLASS = np.zeros(256, np.uint8)
_CLASS[:32] = 13
_CLASS[127] = 13
_CLASS[128:192] = 1
_CLASS[192:] = 2
for _members, _c in ((range(65, 91), 3), (range(97, 123), 4), (range(48, 58), 5), (b".?", 6), (b",;:", 7), (b"!", 8), (b"#*$%&|<>", 9), (b"()[]{}\"'", 10), (SPACES, 12), (b"\n", 11)):
    _CLASS[list(_members)] = _c


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64())] + [(f, pa.float32()) for f in FEATURES])
    for b in pieces(it, 1):
        data, bounds = utf8(b.column(1))
        cls = _CLASS[data]
        h, first, at = word_hashes(data, bounds, lower=False)
        lines = np.flatnonzero(cls == 11)
        line_at = np.searchsorted(lines, bounds)
        word_line = np.searchsorted(lines, first)
        out = np.zeros((b.num_rows, len(FEATURES)), np.float32)
        for i in range(b.num_rows):
            lo, hi, w0, w1 = int(bounds[i]), int(bounds[i + 1]), int(at[i]), int(at[i + 1])
            n = w1 - w0
            if not n:
                continue
            c = np.bincount(cls[lo:hi], minlength=14)
            chars = hi - lo - c[1] - c[11] - c[12]
            own = h[w0:w1]
            counts = np.unique(own, return_counts=True)[1]
            windows = mix(own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)) if n > 2 else own[:0]
            starts = np.flatnonzero(np.diff(word_line[w0:w1], prepend=-1))
            text_lines = _line_hashes(own, starts)
            longest = int(np.diff(np.append(first[w0:w1], hi)).max())
            out[i] = (
                np.log1p(n), chars / n, c[9] / n, c[3] / chars, c[5] / chars, c[6] / n, c[7] / n, c[8] / n, c[10] / n, c[2] / chars, c[11] / n,
                len(counts) / n, (own[1:] == own[:-1]).sum() / n, 1 - len(np.unique(windows)) / max(1, len(windows)),
                1 - len(np.unique(text_lines)) / len(text_lines), counts.max() / n, np.log1p(longest), c[13] / chars,
            )
        yield batch(schema, b.column(0), *[out[:, j] for j in range(len(FEATURES))])


def _line_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of words that begins at one of starts, by place within the run."""
    place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
    return np.add.reduceat(mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)


@dataclass
class Gam:
    """base log odds; edges[f]: bin limits; tables[f]: a number a bin; pairs: (f, g, limits of f, limits of g, table)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, x[:, f], "right")]
        for f, g, ef, eg, values in self.pairs:
            out += values[np.searchsorted(ef, x[:, f], "right"), np.searchsorted(eg, x[:, g], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -40, 40)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins by Newton gain: (gain, first bin on the right), or (0, 0)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < _LEAST / 8) | (hr < _LEAST / 8)] = 0
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree over one feature's bins, as a number a bin."""
    gain, at = _split(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree over two features' bins that cuts one and then the other on either side: its gain over a constant and its table."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, a.shape[0]):
            parts, gain = [], -g.sum() ** 2 / (h.sum() + 1)
            for s in (slice(0, at), slice(at, None)):
                row_g, row_h = a[s].sum(axis=0), b[s].sum(axis=0)
                values = _tree(row_g, row_h, 1)
                gain += float((values * row_g).sum())
                parts.append(np.broadcast_to(values, (len(a[s]), a.shape[1])))
            if gain > best[0]:
                values = np.concatenate(parts)
                best = (gain, np.ascontiguousarray(values.T if turn else values))
    return best


def _limits(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic gradient boosting of x (rows x features) against 0/1 labels. Labels of one class, or none: a constant."""
    model = Gam(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_limits(x[:, f], BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    odds = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, (table, bins) in enumerate(zip(model.tables, binned)):
            g, h = slopes()
            step = RATE * np.clip(_tree(np.bincount(bins, g, len(table)), np.bincount(bins, h, len(table)), 2), -4, 4)
            table += step
            odds += step[bins]
    coarse = [_limits(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    spots = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        rows, cols = len(coarse[f]) + 1, len(coarse[k]) + 1
        return np.bincount(spots[f] * cols + spots[k], v, rows * cols).reshape(rows, cols)

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(f, k, g), grid(f, k, h))[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k, coarse[f], coarse[k], np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1))) for gain, f, k in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for f, k, _, _, table in model.pairs:
            g, h = slopes()
            step = RATE * np.clip(_pair_tree(grid(f, k, g), grid(f, k, h))[1], -4, 4)
            table += step
            odds += step[spots[f], spots[k]]
    return model


def _scores(model: Gam):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.column_stack([np.asarray(c) for c in b.columns[1:]]).astype(np.float64)
            yield batch(schema, b.column(0), model.score(x))

    return fn


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(features: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Gam:
    """Fits on the labelled documents that aren't held out, `rows` of them at most, chosen by a hash of doc_id; texts that share a doc_id all count, equal ones once."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "gam-labels")
    sample = features.join(small(known), "doc_id").dropDuplicates(["doc_id", *FEATURES]).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(rows)
    sample = sample.orderBy("doc_id", *FEATURES).select(*FEATURES, (F.col("y") >= 0.5).cast("int").alias("y")).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(np.float64), sample["y"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, held_out, score, predicted; one row for each row of docs.

    score is the probability of quality 1; predicted is 1 from 0.5 on. Null, empty and blank texts have all features 0 and get a score as well. Rows with crc32(doc_id as
    text) mod 3 = 1 are held out of learning; labels with null doc_id or quality are ignored, several labels of a doc_id are averaged.
    Without labels every score is 0.5. A null doc_id is not held out. An empty docs table gives an empty result.
    """
    wide = ", ".join(f"{f} float" for f in FEATURES)
    features = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "gam-features", _features, f"doc_id bigint, {wide}")
    model = train(features, labels, rows)
    scored = arrow_map(features, _scores(model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
