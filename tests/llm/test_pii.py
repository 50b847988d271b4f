import hashlib
import math
import random
import re

from quillmask.llm import pii
from quillmask.llm.common import table

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 12 <= sum(c.isdigit() for c in m.group()) <= 19 and luhn(m.group())]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_against_plain_expressions():
    r = random.Random(2)
    fixed = ["a@b@c.d", "a@b.c@d.e f@g", "@a.b x@y.z.", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.300 01.002.3.4", "é1.2.3.4 4111-1111 1111 1111", "+1 (555) 555-5555 +12345678 ++1 234567890", "4111111111111111 4111111111111112", "", "1 2-3"]
    for t in fixed + ["".join(r.choices("a1.@+- 9()", k=60)) for _ in range(6000)]:
        assert pii.base_spans(t) == plain(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 500_000 + "@", "1" * 500_000, "a@" * 200_000, "1." * 200_000, "+1 " * 100_000):
        pii.base_spans(t)


def test_query_against_base(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {x.doc_id: x.text for x in d.collect()}
    for x in pii.find_pii(d).collect():
        base = plain(texts[x.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base)
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(k == i for *_, k in base) for i in range(4))
        assert set(filter(None, said.split(","))) <= set(x.spans.split(",")) | {""}


def corpus(spark):
    """Seeds after 'write to' and 'hotline is' always are identifiers; 'the house' is followed by anything."""
    rows = [(i, f"Please write to user{i}@mail{i}.example and visit the house 10.0.0.{i} or the house red.") for i in range(12)]
    rows += [(100 + i, f"the house blue and the house green, our hotline is +1 555 010 44{i}0 today") for i in range(8)]
    rows += [(200, "é please write to bob(at)corp.example soon, the hotline is (555) 010-9999; the house 10.0.0.999 stays")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_patterns_discover_unseen_identifiers(spark):
    got = {x.doc_id: x for x in pii.find_pii(corpus(spark)).collect()}
    text = "é please write to bob(at)corp.example soon, the hotline is (555) 010-9999; the house 10.0.0.999 stays"
    found = [tuple(s.split(":")) for s in got[200].spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in found] == [("email", "bob(at)corp.example"), ("phone", "(555) 010-9999")]
    assert got[200].n_email == 0 and got[0].spans.startswith("email:16:") and got[100].spans.count(":") == 2


def test_discovered_identifiers_are_whole(spark):
    """Many words, and long words without digits, up to the line break."""
    mails = ["john (at) example (dot) co (dot) uk", "john (at) mail (dot) example (dot) com", "maximiliane.von.oberhausen@firma(dot)example", "anne-charlotte.montgomery @ example.org", "x" * 400 + " @ example.org"]
    phones = ["+ 33 6 12 34 56 78", "00 33 6 12 34 56 78"]
    rows = [(300 + i, f"é\nplease write to {m}\nsoon 1") for i, m in enumerate(mails)] + [(400 + i, f"the hotline is {m}\n9") for i, m in enumerate(phones)]
    # each is seen after a sure pattern; a doubtful one would mark nothing
    docs = corpus(spark).union(spark.createDataFrame(rows, "doc_id long, text string"))
    more = [(1000 + i, f"Please write to someone{i}@mail{i}.example, our hotline is +1 555 011 {1000 + i} today") for i in range(60)]
    got = {x.doc_id: x.spans for x in pii.find_pii(docs.union(spark.createDataFrame(more, "doc_id long, text string"))).collect()}
    for (i, t), m in zip(rows, mails + phones):
        kind = "email" if i < 400 else "phone"
        assert f"{kind}:{t.index(m)}:{t.index(m) + len(m)}" in got[i].split(","), (m, got[i])


def brute_words(text):
    return [(m.group().lower() if m.group().isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group()), m.start(), m.end()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)]


def brute_shape(w):
    return re.sub("[0-9]", "0", w)


def brute_contexts(text, s, e):
    """Patterns beside a span: ('before' or 'after', words)."""
    words, out = brute_words(text), set()
    before = [brute_shape(w) for w, _, b in words if b <= s]
    if s == 0 or text[s - 1] in " \t\n\x0b\x0c\r":
        out |= {("before", tuple(before[-n:])) for n in (1, 2) if len(before) >= n}
    rest = next((x for x in range(e, len(text)) if text[x] in " \t\n\x0b\x0c\r"), len(text))
    if not re.search("[0-9A-Za-z]", text[e:rest]):
        after = [brute_shape(w) for w, a, _ in words if a >= rest]
        out |= {("after", tuple(after[:n])) for n in (1, 2) if len(after) >= n}
    return out


def brute_candidates(text, side, pattern):
    """(occurrences of a pattern, identifiers beside them)."""
    words, n, count, found = brute_words(text), len(pattern), 0, set()
    for i in range(len(words) - n + 1):
        if tuple(brute_shape(w) for w, _, _ in words[i : i + n]) != pattern:
            continue
        count += 1
        if side == "before" and i + n < len(words):
            start = words[i + n][1]
            line = text.find("\n", start)
            for k, kind in enumerate(pii.KINDS):
                if m := pii._SHAPES[kind].match(text, start, len(text) if line < 0 else line):
                    found.add((k, start, m.end()))
        if side == "after" and i:
            end = words[i - 1][2]
            while end and text[end - 1] in ".,;:!?\"'":
                end -= 1
            lo = text.rfind("\n", 0, end) + 1
            hi = text.find("\n", lo)
            for k, kind in enumerate(pii.KINDS):
                found |= {(k, m.start(), m.end()) for m in pii._SHAPES[kind].finditer(text, lo, len(text) if hi < 0 else hi) if m.end() == end and (m.start() == lo or text[m.start() - 1] in " \t\x0b\x0c\r")}
    return count, found


def brute_discover(texts, support=3, confidence=0.8):
    """The same graph in dictionaries: {(document, kind, start, end)}."""
    own = {}
    for i, t in texts.items():
        for s, e, k in plain(t):
            for c in brute_contexts(t, s, e):
                own[c, k, t[s:e].lower()] = own.get((c, k, t[s:e].lower()), 0) + 1
    edges, totals, seen, marked = set(own), {}, {}, set()
    while True:
        instances = {}
        for c, k, x in edges:
            instances.setdefault((c, k), set()).add(x)
        strong = {ck for ck, xs in instances.items() if len(xs) >= support}
        fresh = {c for c, _ in strong} - set(totals)
        if not fresh:
            return {(i, k, s, e) for i, k, s, e in marked}
        for c in fresh:
            totals[c], seen[c] = 0, set()
            for i, t in texts.items():
                n, found = brute_candidates(t, *c)
                totals[c] += n
                seen[c] |= {(i, *f) for f in found}
        known = {(c, k, x): n for (c, k, x), n in own.items() if (c, k) in strong}
        sure_instances = {(k, x) for _, k, x in known}
        unseen = {}
        for c, k in strong:
            for i, kind, s, e in seen[c]:
                x = texts[i][s:e].lower()
                if kind == k and (k, x) not in sure_instances:
                    unseen[c, k, x] = unseen.get((c, k, x), 0) + 1
        sure = {ck: sum(n for (c, k, _), n in known.items() if (c, k) == ck) for ck in strong}
        trust = {ck: min(1, n / (totals[ck[0]] + 1)) for ck, n in sure.items()}
        scores = {}
        for _ in range(3):
            doubt = {}
            for c, k, x in unseen:
                doubt[k, x] = doubt.get((k, x), 0) + math.log1p(-min(trust[c, k], 0.999999))
            scores = {kx: 1 - math.exp(v) for kx, v in doubt.items()}
            trust = {ck: min(1, (sure[ck] + sum(n * scores[k, x] for (c, k, x), n in unseen.items() if (c, k) == ck)) / (totals[ck[0]] + 1)) for ck in strong}
        marked = {(i, k, s, e) for c, k in strong if trust[c, k] >= confidence for i, kind, s, e in seen[c] if kind == k and scores.get((k, texts[i][s:e].lower()), 0) >= confidence}
        edges = set(own) | {(c, k, texts[i][s:e].lower()) for i, k, s, e in marked for c in brute_contexts(texts[i], s, e)}


def turns(spark):
    """Identifiers after 'write to' stand before 'for details' as well, and some unseen ones before it alone; digits beside identifiers differ."""
    rows = [(i, f"Please write to user{i}@mail{i}.example soon") for i in range(20)]
    rows += [(100 + i, f"please write to clerk{i}(at)desk.example for details") for i in range(5)]
    rows += [(200 + i, f"é or ask boss{i}(at)top.example, for details of it") for i in range(4)]
    rows += [(300 + i, f"case {i}{i} 10.1.{i}.7 gate") for i in range(9)] + [(400, "case 77 2001:db8::7 gate\ncase 5x"), (401, "nothing for nobody, soon")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_discovery_against_a_plain_graph(spark):
    for df in (corpus(spark), turns(spark), table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").where("length(text) < 3000")):
        texts = {x.doc_id: x.text for x in df.collect()}
        keyed = pii._keyed(df)
        base = pii.materialise(keyed, "b", pii._seeds, "doc_id bigint, text_hash bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, base_sha256 string, seeds array<struct<kind: int, instance: string, patterns: array<bigint>>>")
        found = pii.discover(keyed, base)
        assert (set() if found is None else {(x.doc_id, x.kind, x.start, x.end) for x in found.collect()}) == brute_discover(texts)


def test_promoted_identifiers_induce_patterns(spark):
    got = {x.doc_id: x.spans for x in pii.find_pii(turns(spark)).collect()}
    assert all(got[100 + i].startswith("email:16:") for i in range(5)) and all(got[200 + i].startswith("email:9:") for i in range(4))
    assert got[400].startswith("ip:8:") and got[401] == ""


def test_score_of_the_graph(spark):
    seeds = spark.createDataFrame([(1, 0, "a", 4), (1, 0, "b", 5), (2, 0, "a", 1)], "pattern long, kind int, instance string, n long")
    totals = spark.createDataFrame([(1, 10), (2, 99)], "pattern long, total long")
    candidates = spark.createDataFrame([(1, 0, "z", 1), (2, 0, "y", 1), (1, 0, "a", 1)], "pattern long, kind int, instance string, n long")
    patterns, scores = pii.score(seeds, totals, candidates)
    assert [(x.pattern, x.kind) for x in patterns.collect()] == [(1, 0)]
    first = 9 / 11
    second = (9 + first) / 11
    third = (9 + second) / 11
    assert abs(patterns.head().confidence - (9 + third) / 11) < 0.02
    assert [x.instance for x in scores.collect()] == ["z"]


def test_odd_rows_and_masks(spark, odd, none):
    got = pii.find_pii(odd).collect()
    assert len(got) == odd.count() and all(x.spans == "" for x in got)
    assert pii.find_pii(none).count() == 0 and pii.masked(none).count() == 0
    out = pii.masked(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and {x.text for x in out.collect()} == {x.text for x in odd.collect()}
    d = corpus(spark).selectExpr("doc_id", "text", "length(text) AS n_chars", "'s' AS source")
    rows = {x.doc_id: x for x in pii.masked(d).collect()}
    assert rows[3].text == "Please write to [EMAIL] and visit the house [IP] or the house red." and rows[3].n_chars == len(rows[3].text) and rows[3].source == "s"
    assert "[EMAIL] soon" in rows[200].text and "[PHONE];" in rows[200].text
