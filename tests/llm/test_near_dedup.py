import random

import numpy as np
import pyarrow as pa

from quillmask.llm import near_dedup as nd
from quillmask.llm.components import components


def shingles(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")]
    words = [w for part in words for w in part.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_against_brute_force(spark, prose):
    """Originals, exact copies, near copies around the threshold, and a family whose members are alike only through a hub that isn't the smallest id."""
    r, rows = random.Random(5), []
    for k in range(40):
        base = prose(r.randint(3, 160), k).split(" ")
        rows.append((len(rows) * 3 + 500, " ".join(base)))
        for changes in (0, 1, 2, 3, 6):
            w = list(base)
            for _ in range(changes):
                w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
            rows.append((len(rows) * 3 + 500, (" " if changes else "\n").join(w).upper() if changes == 0 else " ".join(w)))
    hub = prose(120, 999).split(" ")
    for k in range(60):
        w = list(hub)
        if k != 37:
            for at in r.sample(range(120), 1 + (k % 2)):
                w[at] = f"y{k}_{at}"
        rows.append((k, " ".join(w)))
    r.shuffle(rows)
    for percent in (85, 80):
        got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, percent)
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_banding():
    assert nd.banding(0.85) == (32, 6) and nd.banding(0.8) == (38, 5)


def test_estimate_is_unbiased():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 60, 60))
        x, y = (nd.minima(np.unique(np.concatenate([both, s]))) for s in (a, b))
        low = [nd.mix(m.astype(np.uint64) + nd._SEEDS) & np.uint64(3) for m in (x, y)]
        errors.append(((low[0] == low[1]).mean() - 0.25) / 0.75 - 300 / 420)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert nd.cut(0.85) < 0.85 - 4 * np.std(errors) + 0.1


def test_words_do_not_depend_on_their_place():
    texts = ["alpha beta gamma delta eps zeta", "x " * 300_000 + "alpha beta gamma delta eps zeta", "ALPHA\tbeta\x0bgamma\n delta  eps zeta", "a" * 3_000_000]
    first, second, third, fourth = nd.shingle_sets(pa.array(texts))
    assert len(first) == 2 and set(first) <= set(second) and set(first) == set(third) and len(fourth) == 1


def test_odd_rows(odd, none):
    got = {(x.doc_id, x.n_shingles): (x.component_id, x.kept) for x in nd.near_duplicates(odd).collect()}
    assert nd.near_duplicates(odd).count() == odd.count()
    assert got[1, 0] == got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True)
    assert got[5, 76] == (5, True) and got[6, 76] == (5, False) and got[7, 1] == (7, True) and got[8, 1] == (7, False)
    assert got[None, 58] == (None, True)
    assert nd.near_duplicates(none).count() == 0
    kept = nd.keep_one(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9]
    assert nd.keep_one(none).count() == 0


def test_rows_of_one_id_and_of_none(spark, prose):
    a, b, c = prose(60, 71), prose(60, 72), prose(60, 73)
    rows = [(5, a), (5, b), (7, a + " word"), (9, b + " word"), (None, c), (None, c + " word"), (None, prose(60, 74)), (None, b + " more"), (5, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in nd.near_duplicates(df).collect()}
    assert {(5, 56, 5, True), (7, 57, 5, False), (9, 57, 5, False), (None, 57, 5, False)} <= got and sum(k for i, _, c, k in got if i is None) == 2
    kept = sorted((x.doc_id or 0, x.text) for x in nd.keep_one(df).collect())
    assert [t for i, t in kept if i == 5] == sorted([a, b]) and len(kept) == 4 and sum(t.startswith(c) for _, t in kept) == 1
    odd = spark.createDataFrame([(3, a), (3, a + " word"), (4, a)], "doc_id long, text string")
    assert [x.doc_id for x in nd.keep_one(odd).collect()] == [3]


def test_small_blocks(spark, prose, monkeypatch):
    """Many blocks a bucket: texts alike around two hubs in turn, found in the last step only."""
    for name, n in (("BLOCK", 4), ("BLOCK_SHINGLES", 500), ("SALT", 3)):
        monkeypatch.setattr(nd, name, n)
    r, rows = random.Random(8), []
    base = prose(90, 500).split(" ")
    for k in range(60):
        w = list(base)
        for at in r.sample(range(90), r.choice((0, 1, 1, 2))):
            w[at] = f"z{r.randrange(12)}"
        rows.append((k * 7 % 61, " ".join(w)))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {x.id: x.component for x in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
