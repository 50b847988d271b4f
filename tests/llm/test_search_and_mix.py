import itertools
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmask.llm import mixing, topk
from quillmask.llm.common import table


def brute_top(rows, every, k):
    fine = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(fine):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(fine) if b != a and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_search_against_brute_force(spark, monkeypatch):
    """Ties, rows that repeat a vec_id with the same or another vector, vectors that take no part, lengths that don't meet."""
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 40)]) for i in range(300)]
    rows += [(300 + i, [0.5, -0.5, 0.25]) for i in range(8)] + [(400 + i, list(rows[50][1])) for i in range(9)]
    rows += [(None, [1.0] * 40), (500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 40), (504, [float("inf")] * 40), (50, list(rows[50][1])), (100, [9.0] * 40), (550, [1.0])]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "vec_id long, embedding array<float>, label int, score string")
    for sizes in ((8192, 512, 16), (37, 3, 7)):
        for name, n in zip(("ROW_BLOCK", "QUERY_BLOCK", "DIMENSIONS"), sizes):
            monkeypatch.setattr(topk, name, n)
        assert sorted(tuple(x) for x in topk.top_k(df).collect()) == brute_top(rows, 50, 5)
    assert topk.top_k(df.where("false")).count() == 0
    few = spark.createDataFrame([(50, [1.0, 2.0]), (50, [9.0, 0.5]), (50, [9.0, 0.5])], "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in topk.top_k(few).collect()) == brute_top([tuple(x) for x in few.collect()], 50, 5)


def test_pruning_keeps_ties():
    """Bounds that decide: few rows are near, most are far; some scores are equal over several blocks."""
    r = np.random.default_rng(2)
    q = r.normal(0, 20, (4, 64)).round()
    x = np.concatenate([q.T + r.normal(0, 1, (64, 4)).round(), np.repeat(q.T[:, :1], 9, axis=1), r.normal(0, 3, (64, 900)).round()], axis=1)
    ids = r.permutation(x.shape[1])
    s = topk.Search(q, np.array([-1, 5, -1, -1]), 5)
    for at in range(0, x.shape[1], 100):
        s.block(np.ascontiguousarray(x[:, at : at + 100]), ids[at : at + 100], np.arange(at, min(at + 100, x.shape[1])))
    for i in range(4):
        whole = q[i] @ x
        order = [j for j in np.lexsort((ids, -whole)) if not (i == 1 and j == 5)][:5]
        assert s.ids[i].tolist() == ids[order].tolist() and s.scores[i].tolist() == whole[order].tolist()


def test_fit_reaches_the_best_sum():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 6)
        sizes, counts = r.sample(range(1, 30), n), [r.randint(1, 3) for _ in range(n)]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = r.randint(0, total)
        take = mixing.fit(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(s * t for s, t in zip(sizes, take))
        sums = {sum(s * t for s, t in zip(sizes, x)) for x in itertools.product(*[range(c + 1) for c in counts])}
        assert got <= budget
        # the even share is taken first, so the knapsack has what is left of each size
        even = [budget * c // total for c in counts]
        free = {sum(s * t for s, t in zip(sizes, x)) for x in itertools.product(*[range(e, c + 1) for e, c in zip(even, counts)])}
        assert got == max(x for x in free if x <= budget) and got <= max(x for x in sums if x <= budget)


def test_fit_with_large_counts():
    sizes, counts = [7, 11, 5000, 120_000], [10**7, 10**6, 1000, 40]
    take = mixing.fit(sizes, counts, 60_000_001)
    assert sum(s * t for s, t in zip(sizes, take)) == 60_000_001


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    """Capping again and again until none is above."""
    keys = sorted(sizes)
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [k for k in keys if k not in capped]
        left = total - sum(capped.values())
        share = {k: left * w[k] / sum(w[x] for x in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return capped | share
        capped |= {k: most * sizes[k] for k in over}


def test_targets_against_repeated_capping(spark):
    r = random.Random(3)
    for _ in range(12):
        sizes = {f"0s{i:02}": r.choice([0, 1, 5, 100, 10_000]) for i in range(r.randint(1, 9))}
        if not sum(sizes.values()):
            continue
        got = {x.key: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got == pytest.approx({k: want[k] for k in got}), sizes


def test_mix(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix(d).collect()
    by = {}
    for x in rows:
        assert x.taken in (0, x.size, 2 * x.size, 3 * x.size)
        by.setdefault((x.source_size, x.target), [x.source_size, x.target, 0])[2] += x.taken
    assert all(abs(taken - target) <= 2 and target <= 3 * size + 1e-6 for size, target, taken in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(sum(s for s, _, _ in by.values()))
    again = {(x.doc_id, x.taken) for x in mixing.mix(d.repartition(7)).collect()}
    assert again == {(x.doc_id, x.taken) for x in rows}
    out = mixing.mixed(d)
    assert out.columns == d.columns and out.select(F.sum(mixing.size_of(F.col("text")))).head()[0] == sum(x.taken for x in rows)


def brute_draw(doc_id, text, seed=7):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = h if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    return (h if text is None else xxhash.xxh64_intdigest(text.encode(), h)) & ((1 << 63) - 1)


def brute_mix(rows):
    """(doc_id, text, source) -> sorted (doc_id, size, source_size, target, taken): sort each size's documents by draw and take the first."""
    size = lambda t: len([w for w in re.split(r"[ \t\n\x0b\x0c\r]+", t or "") if w])
    key = lambda s: "1" if s is None else "0" + s
    totals = {}
    for _, t, s in rows:
        totals[key(s)] = totals.get(key(s), 0) + size(t)
    aims, out = brute_targets(totals), []
    for k, total in totals.items():
        own = [(size(t), brute_draw(i, t), i) for i, t, s in rows if key(s) == k]
        counts = {}
        for n, *_ in own:
            counts[n] = counts.get(n, 0) + 1
        rounds = min(int(aims[k] // total), 3) if total else 0
        take = dict(zip(sorted(counts), mixing.fit(sorted(counts), [counts[n] for n in sorted(counts)], round(aims[k]) - rounds * total)))
        for n in counts:
            for place, (_, _, i) in enumerate(sorted((x for x in own if x[0] == n), key=lambda x: x[1])):
                out.append((i, n, total, round(aims[k], 6), (rounds + (place < take[n])) * n))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, rows", [(8, 1_000_000), (1, 64)])
def test_whole_mix_against_brute_force(spark, monkeypatch, bits, rows):
    """Row by row on a whole table, and on repeated rows, null ids and null sources."""
    monkeypatch.setattr(mixing, "RANGE_BITS", bits)
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    d = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "source")
    r = random.Random(6)
    odd = [(r.choice([None, 1, 2, 3]), " ".join(r.choices("ab", k=r.randint(0, 3))) or None, r.choice([None, "x", "y", "z"])) for _ in range(400)]
    for df in (d, spark.createDataFrame(odd, d.schema)):
        got = sorted(((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(df).collect()), key=str)
        assert got == brute_mix([tuple(x) for x in df.collect()])
        out = mixing.mixed(df)
        assert out.select(F.sum(mixing.size_of(F.col("text")))).head()[0] == sum(x[4] for x in got)


def test_mix_on_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(x.taken == 0 for x in rows if x.doc_id in (1, 2, 3))
    assert sum(x.taken for x in rows) == mixing.mixed(odd).select(F.sum(mixing.size_of(F.col("text")))).head()[0]
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_texts_without_ids_stay_themselves(spark):
    rows = [(None, f"word{i} again", "s") for i in range(6)] + [(7, "one text", "s"), (7, "other text", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [x.text for x in mixing.mixed(df, weights=(1,)).collect()]
    assert sorted(set(out)) == sorted(t for _, t, _ in rows) and len(out) == len(rows)


def test_one_python_worker_a_task(spark, monkeypatch):
    """A table that a Python step makes is not written by another one, in a second worker of each task."""
    plans = []

    def spied(df, label, fn=None, schema=None, write=mixing.materialise):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, label, fn, schema)

    monkeypatch.setattr(mixing, "materialise", spied)
    assert mixing.mixed(table(spark, "/root/testdata/sf0.001", "documents")).count()
    assert plans and not [x for x in plans if "InPandas" in x or "InArrow" in x]
