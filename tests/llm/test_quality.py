import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmask.llm import quality_gam as gam
from quillmask.llm import quality_rules as rules
from quillmask.llm.common import table

SF = "/root/testdata/sf0.01"


def signals(text):
    text = text or ""
    words = text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
    words = [w for w in words if w]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_signals_against_python(spark, odd):
    texts = ["a b c a b c d", "x x x x", "one\n\none\n two \none", "a b c\x0ba b c", "#* $%&|<>!", "ends here ", " é è "] + [" ".join(random.Random(i).choices("abc", k=40)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for x in rules.with_signals(df).select("text", *rules.SIGNALS).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == signals(x.text)


def test_em_against_python(spark):
    df = rules.with_signals(table(spark, SF, "documents")).cache()
    patterns = [(x["v"], x["n"]) for x in df.groupBy(rules.votes().alias("v")).agg(F.count("*").alias("n")).collect()]
    m, prior = len(rules.RULES), rules.PRIOR
    good, bad = [list(rules.GOOD_START) for _ in range(m)], [list(rules.BAD_START) for _ in range(m)]
    for _ in range(rules.ITERATIONS):
        w = []
        for v, _n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[j][v[j] + 1] / bad[j][v[j] + 1]) for j in range(m))
            w.append(1 / (1 + math.exp(-odds)))
        share = lambda ws, start: [[(sum(n * x for (v, n), x in zip(patterns, ws) if v[j] == k - 1) + rules.WEIGHT * start[k]) / (sum(n * x for (_, n), x in zip(patterns, ws)) + rules.WEIGHT) for k in range(3)] for j in range(m)]  # noqa: E731, B023
        prior = (sum(n * x for (_, n), x in zip(patterns, w)) + rules.WEIGHT * rules.PRIOR) / (sum(n for _, n in patterns) + rules.WEIGHT)
        good, bad = share(w, rules.GOOD_START), share([1 - x for x in w], rules.BAD_START)
    model = rules.fit(df)
    assert model.prior == pytest.approx(prior, rel=1e-9)
    assert list(model.good) == pytest.approx([x for r in good for x in r], rel=1e-9) and list(model.bad) == pytest.approx([x for r in bad for x in r], rel=1e-9)


def test_verdicts(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = rules.judge(d).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(x.kept for x in rows if x.quality == 1) and not any(x.kept for x in rows if x.quality == 0)
    assert rules.keep_good(d).columns == d.columns
    assert {x.doc_id for x in rules.keep_good(d).collect()} == {x.doc_id for x in rules.judge(d).where("kept").collect()}


def test_rules_on_odd_rows(odd, none):
    got = rules.judge(odd).collect()
    assert len(got) == odd.count() and all(x.base_failed and not x.kept for x in got if x.doc_id in (1, 2, 3, 7))
    assert rules.judge(none).count() == 0 and rules.keep_good(none).count() == 0
    assert rules.keep_good(odd).columns == odd.columns


def test_gam_held_out_accuracy(spark):
    rows = gam.classify(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")).join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in rows) / len(rows) > 0.98 and all(0 <= x.score <= 1 for x in rows)


def test_gam_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert any({f, k} == {0, 1} for f, k, *_ in model.pairs)
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    same = gam.fit(x, np.ones(4000))
    assert np.allclose(same.score(x), 4001 / 4002)


def test_gam_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (8, None, 0), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = gam.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert {x.score for x in gam.classify(odd, labels.where("false")).collect()} == {0.5}
    assert gam.classify(none, labels).count() == 0
    import zlib

    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)


def test_held_out_labels_are_not_learned(spark):
    d, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    wrong = labels.withColumn("quality", F.when(gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda y: {x.doc_id: x.score for x in gam.classify(d, y).collect()}
    assert score(labels) == score(wrong)


def features(text):
    """A text's features, one after the other, from characters and lists of words."""
    text = text or ""
    data = text.encode()
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", data) if w]
    n = len(words)
    if not n:
        return [0.0] * len(gam.FEATURES)
    blank = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    chars = len(text) - blank
    count = lambda cs: sum(text.count(c) for c in cs)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = [tuple(x) for x in ([w for w in re.split(r"[ \t\x0b\x0c\r]+", line) if w] for line in text.split("\n")) if x]
    longest = max(len(m.group()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", data))
    return [
        math.log1p(n), chars / n, count("#*$%&|<>") / n, sum("A" <= c <= "Z" for c in text) / chars, sum("0" <= c <= "9" for c in text) / chars, count(".?") / n, count(",;:") / n, count("!") / n, count("()[]{}\"'") / n,
        sum(ord(c) > 127 for c in text) / chars, text.count("\n") / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(windows)) / max(1, len(windows)),
        1 - len(set(lines)) / len(lines), max(words.count(w) for w in set(words)) / n, math.log1p(longest), sum((ord(c) < 32 and c not in "\t\n\x0b\x0c\r") or ord(c) == 127 for c in text) / chars,
    ]


def test_features_against_python(spark, odd):
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect() + [(100_000 + i, t) for i, t in enumerate(["", "a\x01 b", "one\n\none two\none", "É é! (x) 12"])]
    texts = [r[1] for r in rows if len(r[1]) < 40_000]
    [got] = gam._features(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])]))
    table_ = np.column_stack([np.asarray(c) for c in got.columns[1:]])
    for t, x in zip(texts, table_):
        assert x == pytest.approx(features(t), rel=1e-5, abs=1e-6), t[:80]


def slow_tree(rows, g, h, bins, depth):
    """A tree over one feature, by trying every cut over rows: bin -> value."""
    def total(part):
        return sum(g[i] for i in part), sum(h[i] for i in part)

    def grow(part, lo, hi, depth):
        sg, sh = total(part)
        best = (0.0, 0)
        for at in range(lo + 1, hi) if depth else ():
            (gl, hl), (gr, hr) = total([i for i in part if bins[i] < at]), total([i for i in part if bins[i] >= at])
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - sg**2 / (sh + 1)
            if hl >= 2.5 and hr >= 2.5 and gain > max(best[0], 1e-9) + 1e-12:
                best = (gain, at)
        if not best[1]:
            return {b: sg / (sh + 1) for b in range(lo, hi)}
        left, right = [i for i in part if bins[i] < best[1]], [i for i in part if bins[i] >= best[1]]
        return grow(left, lo, best[1], depth - 1) | grow(right, best[1], hi, depth - 1)

    return grow(list(rows), 0, int(max(bins)) + 1, depth)


def test_fit_against_a_slow_one(monkeypatch):
    """Tables of the first rounds, feature by feature, from cuts tried one by one over rows."""
    monkeypatch.setattr(gam, "ROUNDS", 3)
    monkeypatch.setattr(gam, "PAIRS", 0)
    r = np.random.default_rng(4)
    x = r.integers(0, 9, (160, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6) ^ (r.random(160) < 0.1)).astype(float)
    model = gam.fit(x, y)
    odds = np.full(160, math.log((y.sum() + 1) / (160 - y.sum() + 1)))
    tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(3):
        for f in range(3):
            bins = [int((model.edges[f] <= v).sum()) for v in x[:, f]]
            p = 1 / (1 + np.exp(-odds))
            step = slow_tree(range(160), y - p, p * (1 - p), bins, 2)
            for b, v in step.items():
                tables[f][b] += 0.2 * max(-4, min(4, v))
            odds += np.array([0.2 * max(-4, min(4, step[b])) for b in bins])
    for a, b in zip(model.tables, tables):
        assert np.allclose(a[: len(b)], b)
    assert np.allclose(model.odds(x), odds)
