import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from quillmask.llm import pieces as P
from quillmask.llm.common import table


@pytest.fixture(scope="module")
def model():
    return P.load(P.default_model())


def every(m, data):
    """All segmentations of a unit, by recursion over the lattice."""
    lattice = P.edges(m, data)

    def paths(at):
        if at == len(data):
            yield 0.0, []
            return
        for end, i, s in lattice[at]:
            for score, rest in paths(end):
                yield s + score, [i, *rest]

    return sorted((s for s, _ in paths(0)), reverse=True)


def test_a_star_against_all_segmentations(model):
    for word in (" the", " token", "é", " lichen", " 12a", "😀", " ▁", " aaaa", "\n"):
        want = every(model, word.encode())[:6]
        got = P.n_best(P.edges(model, word.encode()), 6)
        assert np.allclose([s for s, _ in got], want, rtol=1e-12)
        assert all(sum(model.scores[i] for i in ids) == pytest.approx(s) for s, ids in got if len(word) > 1 and word.isascii() and word != "\n" and "▁" not in word)


def test_texts_against_the_whole_lattice(spark, model):
    texts = [x.text[:200] for x in table(spark, "/root/testdata/sf0.001", "documents").limit(30).collect()]
    r = random.Random(4)
    texts += ["".join(r.choices("aeé \n▁日😀t1-", k=40)) for _ in range(40)] + ["", " ", "x" * 400, "ab" * 100 + " end", "\n\n"]
    ids, at, scores, others, _, _ = P.segment(model, pa.array(texts), 4)
    assert [t.encode() for t in texts] == P.decode_all(model, ids, at)
    for i, t in enumerate(texts):
        want = P.n_best(P.edges(model, (" " + t).encode()), 4) if t else []
        assert np.allclose([scores[i]] * bool(t) + [o["score"] for o in others[i]], [s for s, _ in want], rtol=1e-12), t
        best = ids[at[i] : at[i + 1]].tolist()
        seen = {tuple(best)}
        for o in others[i]:
            full = list(best)
            for e in sorted(o["edits"], key=lambda e: -e["at"]):
                full[e["at"] : e["at"] + e["n"]] = e["ids"]
            assert P.decode_all(model, np.array(full), np.array([0, len(full)])) == [t.encode()]
            seen.add(tuple(full))
        assert len(seen) == len(want) or not t


def test_long_units_among_many_words(spark, model):
    """Long units' second best is known as exactly as others', and they don't take the place of nearer words."""
    r = random.Random(9)
    words = [w for x in table(spark, "/root/testdata/sf0.001", "documents").limit(40).collect() for w in x.text[:300].split()]
    junk = ["https://" + "".join(r.choices("abcdefgh/.-_0123456789", k=90)), "".join(r.choices("日本語文字列", k=60)), "x" * 70, "ab" * 60, "".join(r.choices("aeiounrst", k=200))]
    texts = []
    for k in range(60):
        t = r.sample(words, 30) + r.sample(junk, k % 5 + 1)
        r.shuffle(t)
        texts.append(" ".join(t))
    for n in (2, 4):
        _, _, scores, others, _, _ = P.segment(model, pa.array(texts), n)
        for i, t in enumerate(texts):
            want = P.n_best(P.edges(model, (" " + t).encode()), n)
            assert np.allclose([scores[i]] + [o["score"] for o in others[i]], [s for s, _ in want], rtol=1e-12), (n, t)


def test_against_the_library_in_unigram_mode(model):
    """The installed library segments by the same scores once it takes the model for a unigram model."""
    import sentencepiece
    from google.protobuf.internal import decoder, encoder  # noqa: F401

    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb2.ModelProto()
    proto.ParseFromString(open(P.default_model(), "rb").read())
    proto.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for t in ("the token lichen", "alpha beta", "segmentation of words"):
        want = [sum(model.scores[i] for i in ids) for ids in sp.nbest_encode_as_ids(t, 3)]
        _, _, s, o, _, _ = P.segment(model, pa.array([t]), 3)
        assert np.allclose([s[0]] + [x["score"] for x in o[0]], want)


def test_round_trip_on_odd_rows(spark, odd, none):
    rows = P.encode(odd, carry=("key",)).collect()
    assert len(rows) == odd.count() and all(x.round_trip and x.key == "k" for x in rows)
    assert all(x.ids == x.best == [] and x.score == 0 and x.alternatives == [] for x in rows if x.doc_id in (1, 2))
    back = P.decode(P.encode(odd)).collect()
    assert sorted((x.doc_id or 0, x.text) for x in back) == sorted((x.doc_id or 0, x.text or "") for x in odd.collect())
    assert P.encode(none).count() == 0 and P.decode(P.encode(none)).count() == 0
    assert P.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()[0].text == ""


def test_ids_are_those_of_the_library(spark, model):
    """Whole documents and odd texts, id by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    r = random.Random(3)
    texts = [x.text for x in table(spark, "/root/testdata/sf0.001", "documents").collect()] + ["".join(r.choices("aeé \n日😀t1-", k=40)) for _ in range(200)] + ["", " ", "  a", "\n\nb", "x" * 300]
    *_, ids, at = P.segment(model, pa.array(texts), 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == sp.encode(t), t[:60]


def test_long_texts_without_spaces(model):
    """200,000 characters on end, in seconds; ties by the thousand."""
    r = random.Random(5)
    began = time.time()
    for t in ("".join(r.choices("日本語文字列漢字仮名交じり", k=200_000)), "ab" * 100_000, "a" * 200_000):
        ids, at, scores, others, own, own_at = P.segment(model, pa.array([t]), 4)
        assert P.decode_all(model, ids, at) == P.decode_all(model, own, own_at) == [t.encode()] and len(others[0]) == (0 if "日" in t else 3)
        assert all(o["score"] <= scores[0] for o in others[0])
    assert time.time() - began < 120


def test_units_do_not_change_segments(model):
    """Cutting a text into units must give the same as the lattice of the whole text."""
    for a, b in itertools.product(("of", "Üb", "1", "  "), ("the\n", "x y", "\t")):
        t = f"{a} {b}{a}"
        _, _, s, *_ = P.segment(model, pa.array([t]), 1)
        assert s[0] == pytest.approx(P.forward(P.edges(model, (" " + t).encode()))[0][-1], rel=1e-12)


def test_units_are_segmented_once(model, monkeypatch):
    """A worker looks up the units that it has met before; what it remembers, or no longer does, changes no result."""
    texts = pa.array(["the token lichen.", "lichen, the lichen token;", "日本 é 12a. " + "ab" * 60, ""])
    model.units = P.Units()
    want = P.segment(model, texts, 4)
    again = P.segment(model, texts, 4)
    monkeypatch.setattr(P, "UNITS", 1)
    small = [P.segment(model, texts, 4) for _ in range(2)]
    for got in (again, *small):
        assert all(np.array_equal(a, b) if isinstance(a, np.ndarray) else a == b for a, b in zip(want, got))
    monkeypatch.undo()
    P.segment(model, texts, 4)
    monkeypatch.setattr(P, "_viterbi", None)
    monkeypatch.setattr(P, "merged", None)
    P.segment(model, pa.array(["lichen token", "the lichen."]), 4)


def test_units_end_where_no_piece_goes_on(model):
    """A full stop behind a word makes no unit of its own with each word; characters stay whole."""
    model.units = P.Units()
    P.segment(model, pa.array(["lichen. lichen.\nlichen lichen!"]), 1)
    n = len(model.units.names)
    P.segment(model, pa.array([" lichen.\n" * 3]), 1)
    assert n <= 5 and len(model.units.names) <= n + 1
    for t in ("é.é", "日.😀", "a\u0301.", "\u0085x\u0085"):
        ids, at, *_, own, own_at = P.segment(model, pa.array([t]), 1)
        assert P.decode_all(model, ids, at) == P.decode_all(model, own, own_at) == [t.encode()]
