"""Operators against independent plain-Python versions, the demonstration letter, and properties."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmask.functions import text as X
from quillmask.functions import vocab
from quillmask.functions.spans import find_all, splice
from quillmask.operators import detect, recognisers, reconcile, review, sanitise
from quillmask.operators.ensemble import ensemble, stored
from quillmask.plans.fixture import TEXTS
from quillmask.sources import demo

MORE = (
    "Investment invoice INV-12345 Billing", "Portland position Ordinary order 12345", "15% 15%x 20 percent 3.5%", "ABCDEFGHIJKL and 5 more\nABCDEFGHIJKL and more", "fe80::1 and ::1",
    "@bob hi @al-ice x@y", "Account number is 12345678. Case Reference 847-555-2901", "SSN 123-45-6789 and 😀 234-56-7890 end", "Customer ID: AB-1234, policy no. 998877665, vin 1HGCM82633A004352",
    "card 4111 1111 1111 1111 phone: +1 415 867 5309 address: 12 Main Street, Springfield", "JOHN SMITH lives in Kerala; john-smith_99 born 01/02/1990 DOB: 1/2/90", "routing 021000021 bank account 123456789012 passport: A1234567",
    "00:1A:2b:3C:4d:5E 2001:0db8:85a3:0000:0000:8a2e:0370:7334 SW1A 1AA", "Jan. 5, 2024 THOMPSON REYNOLDS Email address: a.b@c.io e-mail x@y.zz",
)
ALL = [*TEXTS, *MORE, demo.LETTER]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def compiled(p):
    return re.compile(p.regex, re.I if "i" in p.flags else 0)


def ok(name, text, before):
    low = text.lower()
    if low in vocab.BLOCKLIST or any(" " in b and b in low for b in vocab.BLOCKLIST) or len(text) < 3:
        return False
    digits = [int(c) for c in text if c.isdigit()]
    if name == "credit_card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
    if name == "swift":
        return len(text) in (8, 11) and text.upper() not in vocab.SWIFT_WORDS
    if name == "license_plate":
        return any(map(str.isalpha, text)) and 0 < len(digits) <= 6 and len(text.replace("-", "").replace(" ", "")) >= 5
    if name == "name":
        return low not in vocab.NAME_PHRASES
    return name != "alphanumeric_id" or text not in vocab.ID_WORDS


def plain_regex(text):
    kept = []
    for p in vocab.PATTERNS:
        for m in compiled(p).finditer(text):
            s, e = m.span()
            if not any(s < b and e > a for a, b, *_ in kept) and ok(p.name, m.group(), text[:s]):
                kept.append((s, e, m.group(), p.kind))
    return kept


def plain_context(text):
    kept, out = [], []
    for kind, keyword, value, blind, gap in vocab.CONTEXT_RULES:
        for k in re.finditer(keyword, text, re.I):
            m = re.search(value, text[k.end() : k.end() + 100], re.I if blind else 0)
            if not m or m.start() > gap:
                continue
            s, e, v = k.end() + m.start(), k.end() + m.end(), m.group().strip()
            n = sum(map(str.isdigit, v))
            fine = len(v) >= 3 and any(map(str.isalnum, v)) and v.lower() not in vocab.SKIP_VALUES
            fine = fine and {"phone": n >= 7, "email": "@" in v and "." in v, "ssn": n >= 9, "tax_id": n >= 9, "credit_card": 13 <= n <= 19, "bank_account": 8 <= n <= 17, "routing_number": n == 9, "vin": len(v) == 17, "address": n > 0 and any(map(str.isalpha, v)) and len(v) >= 10}.get(kind, True)
            if fine and not any(s < b and e > a for a, b in kept):
                kept.append((s, e))
                out.append((s, e, v, kind))
    return out


def spans_of(spark, texts, detector):
    rows = detect.explode_spans(detect.detect(frame(spark, texts), [detector]), [detector]).orderBy("doc_id", "ord").collect()
    return [[(x.start, x.end, x.text, x.kind) for x in rows if x.doc_id == i] for i in range(len(texts))]


@pytest.mark.parametrize("detector, plain", [("regex", plain_regex), ("context", plain_context)])
def test_detectors_on_fixtures(spark, detector, plain):
    for t, got in zip(ALL, spans_of(spark, ALL, detector)):
        assert got == plain(t), t


@pytest.mark.parametrize("detector, plain", [("regex", plain_regex), ("context", plain_context)])
def test_detectors_on_documents(spark, detector, plain):
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()]
    for t, got in zip(texts, spans_of(spark, texts, detector)):
        assert got == plain(t)


def plain_false_positive(text, kind):
    t = text.strip()
    short = kind in ("organization", "name") and len(t) < 5 and not any(c.isupper() for c in t[1:])
    starts = bool(t) and (t[0].isupper() or t[0].isdigit() or t[0] in "(+#@") or kind in ("email", "url", "username", "phone")
    return t.lower() in vocab.FALSE_POSITIVES or len(t) < 4 or t.endswith(":") or short or not starts


def plain_ensemble(text):
    """The whole detection of a normalised text, from lists of tuples."""
    url, handle, ident = (re.compile(p.regex) for p in vocab.RULE_PATTERNS)
    rules = [(*m.span(), m.group(), "url") for m in url.finditer(text)] + [(*m.span(), m.group(), "username") for m in handle.finditer(text)]
    rules += [(*m.span(), m.group(), "id_number") for m in ident.finditer(text) if re.search("[0-9]", m.group()) and re.search("[A-Z]", m.group())]
    found = [(*x, "regex") for x in plain_regex(text)] + [(*x, "context") for x in plain_context(text)] + [(*x, "rules") for x in rules]
    found = sorted(((s, i, e, t, k, src) for i, (s, e, t, k, src) in enumerate(found) if not plain_false_positive(t, k)))
    out = []
    for s, _, e, t, k, src in found:
        k = vocab.TYPE_ALIASES.get(k, k)
        if out and s < out[-1]["end"]:
            x = out[-1]
            x["end"], x["text"] = max(x["end"], e), t if len(t) > len(x["text"]) else x["text"]
            x["types"].add(k)
            x["sources"].add(src)
        else:
            out.append({"start": s, "end": e, "text": t, "types": {k}, "sources": {src}})
    rows = []
    for x in out:
        n, kinds = len(x["sources"]), x["types"]
        score = (50, 70, 85)[n - 1] + 5 * ("context" in x["sources"]) - 10 * (len(kinds) > 1) - 5 * (len(kinds) > 2)
        first = next((t for t in vocab.TYPE_PRIORITY if t in kinds), min(kinds))
        rows.append((x["start"], x["end"], x["text"], first, sorted(kinds), sorted(x["sources"]), score, "detector" if first in vocab.HIGH_CONFIDENCE or score >= 80 else "risk_flag"))
    return rows


def test_ensemble_on_documents(spark):
    """The flagship against plain Python, on a whole table, the fixtures and a text of more than 33,000 characters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [*ALL, "\n".join(ALL * 16)]
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], docs.schema)).select("doc_id", X.normalise(F.col("text")).alias("text"))
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert max(map(len, texts.values())) > 33_000
    got = {}
    for x in ensemble(docs, normalised=False).collect():
        got.setdefault(x.doc_id, []).append((x.start, x.end, x.text, x.primary_type, x.types, x.sources, x.confidence_score, x.queue))
    for i, t in texts.items():
        assert sorted(got.get(i, [])) == plain_ensemble(t), t[:80]


def test_columns_with_names_of_ours(spark):
    df = spark.createDataFrame([(1, "Write to ann@lee.example.", "x", 2, True, "n", "u")], "doc_id long, text string, t string, l int, d boolean, n string, u string")
    out = detect.detect(df, ["second_pass"])
    assert out.drop("second_pass").collect() == df.collect() and out.columns == [*df.columns, "second_pass"]


def test_texts_with_the_marks_themselves(spark):
    t = "a@b.cd \uffff 10.0.0.1 \ufffe x@y.zz"
    rows = detect.explode_spans(detect.detect(frame(spark, [t]), ["regex"]), ["regex"]).collect()
    assert [(x.start, x.end, x.text) for x in rows] == [(0, 6, "a@b.cd"), (20, 26, "x@y.zz"), (9, 17, "10.0.0.1")]


def test_rules_and_second_pass(spark):
    url, handle, ident = (re.compile(p.regex) for p in vocab.RULE_PATTERNS)
    for t, got in zip(ALL, spans_of(spark, ALL, "rules")):
        want = [(*m.span(), m.group(), "url") for m in url.finditer(t)] + [(*m.span(), m.group(), "username") for m in handle.finditer(t)]
        want += [(*m.span(), m.group(), "id_number") for m in ident.finditer(t) if re.search("[0-9]", m.group()) and re.search("[A-Z]", m.group())]
        assert got == want, t
    for t, got in zip(ALL, spans_of(spark, ALL, "second_pass")):
        assert got == [(*m.span(), m.group(), p.kind) for p in vocab.SECOND_PASS for m in compiled(p).finditer(t)], t


def test_unused_patterns_look_behind(spark):
    texts = ["my ssn is 123456789", "number 123456789", "bank transfer to 12345678", "see 12345678"]
    sql = detect.regex_spans(vocab.UNUSED_PATTERNS)
    from quillmask.functions.spans import prepared

    rows = prepared(frame(spark, texts)).select("doc_id", F.expr(sql).alias("x")).orderBy("doc_id").collect()
    kinds = [[y["kind"] for y in x["x"]] for x in rows]
    assert kinds == [["ssn"], ["passport"], ["bank_account"], []]


def test_find_all_offsets(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("ab😀é1 ", k=30)) for _ in range(200)] + ["", "aaa", "b"]
    rows = frame(spark, texts).select("doc_id", find_all("text", "a+b?").alias("x")).orderBy("doc_id").collect()
    for t, x in zip(texts, rows):
        assert [(y.start, y.end, y.text) for y in x.x] == [(*m.span(), m.group()) for m in re.finditer("a+b?", t)]


def test_false_positives(spark):
    rows = [("ssn", "name", True), ("abc", "id", True), ("Label:", "name", True), ("abcd", "id", True), ("abcd", "email", False), ("(415) 867", "x", False), ("Anna", "name", True), ("AnNa", "name", False), ("  Éric Blanc ", "name", False), ("#tag", "x", False)]
    df = spark.createDataFrame(rows, "text string, kind string, want boolean")
    assert all(x.got == x.want for x in df.withColumn("got", detect.false_positive(F.col("text"), F.col("kind"))).collect())


def detections(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ord int, start int, end int, text string, kind string, source string, score double")


def test_reconcile(spark):
    rows = [(1, 0, 0, 5, "aaaaa", "name", "enhanced_regex", None), (1, 1, 4, 9, "bbbbb", "name_caps", "legacy_regex", None), (1, 2, 9, 12, "ccc", "ssn", "context", None), (1, 3, 10, 11, "d", "zz", "presidio", 0.85)]
    got = [(x.start, x.end, x.text, x.primary_type, x.types, x.sources, x.confidence_score, x.queue) for x in reconcile.reconcile(detections(spark, rows)).orderBy("start").collect()]
    assert got[0] == (0, 9, "aaaaa", "name", ["name"], ["regex"], 50, "risk_flag")
    assert got[1] == (9, 12, "ccc", "ssn", ["ssn", "zz"], ["context", "presidio"], int((70 + 5 + 5 - 10) * 0.7 + 0.85 * 100 * 0.3), "detector")


def test_reconcile_properties(spark):
    r = random.Random(2)
    rows = []
    for d in range(30):
        for i in range(r.randint(0, 12)):
            s = r.randrange(60)
            rows.append((d, i, s, s + r.randint(1, 12), "x" * r.randint(1, 9), r.choice(["name", "ssn", "email", "other"]), r.choice(["context", "rules", "enhanced_regex"]), None))
    df = detections(spark, rows)
    got = reconcile.reconcile(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, reconcile.reconcile(df).collect()))
    for d in range(30):
        own = sorted((x.start, x.end) for x in got if x.doc_id == d)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
        assert all(sum(s <= x[2] and x[3] <= e for s, e in own) == 1 for x in rows if x[0] == d)
    assert all(0 <= x.confidence_score <= 100 for x in got)


def test_letter(spark):
    spans, truth = demo.spans(spark).cache(), demo.ground_truth(spark)
    flags = [(x.start, x.end, x.category) for x in spans.where("span_type = 'risk_flag'").orderBy("span_id").collect()]
    assert flags == [
        (127, 139, "phone"), (423, 435, "phone"), (1328, 1364, "email"), (80, 85, "postal_code"), (734, 739, "postal_code"), (37, 50, "name"), (62, 75, "name"), (112, 126, "name"),
        (141, 148, "name"), (316, 330, "name"), (601, 623, "name"), (698, 714, "name"), (716, 729, "name"), (1252, 1286, "name"), (1287, 1304, "name"), (1307, 1327, "name"),
    ]
    assert [(x.start, x.end) for x in truth.orderBy("start").collect()][:2] == [(150, 166), (423, 435)]
    yes = F.when(F.col("span_type") == "detector", F.when(F.col("span_id") <= 6, "approve").otherwise("reject")).otherwise(F.when(F.col("span_id").isin(2, 3, 14), "redact").otherwise("dismiss"))
    events = spans.select(*review.KEY, yes.alias("decision"), F.col("span_id").cast("long").alias("seq"))
    assert tuple(review.summary(spans, events, truth).head())[1:] == (2, 0, 4, 6, 26)
    assert review.completion(spans, events).head().complete
    states = review.status(demo.documents(spark), events, review.completion(spans, events).where("complete"))
    assert states.head().status == "completed" and review.completed_summary(spans, events, truth, states).count() == 1
    assert [x.span_id for x in review.display_order(review.review_items(spans, events)).limit(3).collect()] == [1, 2, 6]
    approved = sanitise.approved(spans.where("span_type = 'detector'"), spans.where("span_type = 'risk_flag'"), events)
    bars = sanitise.sanitise(demo.documents(spark), approved, "redact").head()
    assert len(bars.content) == len(demo.LETTER) and bars["count"] == 9 and bars.mapping is None and "Whitfield" not in bars.content
    named = sanitise.sanitise(demo.documents(spark), approved, "pseudonymize").head()
    assert named["count"] == 8 and "Dear Mr. PERSON_2," in named.content and named.mapping["415-555-0142"] == "PHONE_1"


def approved_rows(spark, rows):
    return spark.createDataFrame([(1, "detector", i, s, s + len(t), t, c) for i, (s, t, c) in enumerate(rows)], "doc_id long, span_type string, span_id int, start int, end int, text string, category string")


def test_pseudonyms_are_numbered_from_the_end(spark):
    spans = approved_rows(spark, [(0, "Ann Lee", "name"), (20, "Bob Ray", "name"), (40, "ann lee ", "name"), (60, "1-2", "ein"), (70, "9-9", "itin"), (80, "?", "odd")])
    got = {(x.category, x.normalized_text): (x.pseudonym, x.original_text) for x in sanitise.pseudonyms(spans).collect()}
    assert got == {("name", "ann lee"): ("PERSON_1", "ann lee "), ("name", "bob ray"): ("PERSON_2", "Bob Ray"), ("itin", "9-9"): ("TAX_ID_1", "9-9"), ("ein", "1-2"): ("TAX_ID_2", "1-2"), ("odd", "?"): ("ENTITY_1", "?")}
    existing = spark.createDataFrame([(1, "Bob Ray", "bob ray", "name", "PERSON_7"), (1, "x", "x", "name", "PERSON_x")], "doc_id long, original_text string, normalized_text string, category string, pseudonym string")
    more = {x.normalized_text: x.pseudonym for x in sanitise.pseudonyms(spans, existing).collect()}
    assert more["ann lee"] == "PERSON_8" and "bob ray" not in more


def test_decisions_and_undo(spark):
    events = spark.createDataFrame([(1, "detector", 1, "approve", 1), (1, "detector", 1, "reject", 2), (1, "detector", 2, "approve", 3), (1, "detector", 2, None, 4), (1, "risk_flag", 1, "approve", 5), (1, "risk_flag", 2, "redact", 6)], "doc_id long, span_type string, span_id int, decision string, seq long")
    assert sorted((x.span_type, x.span_id, x.decision) for x in review.latest_decisions(events).collect()) == [("detector", 1, "reject"), ("risk_flag", 2, "redact")]
    history = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "a"), (2, 1, None), (2, 2, None)], "doc_id long, seq long, group_id string")
    assert sorted((x.doc_id, x.seq) for x in review.undo(history).collect()) == [(1, 2), (2, 1)]


def test_segments_cover_the_text(spark):
    docs = frame(spark, ["hello world", "plain", ""])
    spans = spark.createDataFrame([(0, 0, 5, "detector", 1), (0, 6, 8, "detector", 2)], "doc_id long, start int, end int, span_type string, span_id int")
    rows = review.segments(docs, spans).orderBy("doc_id", "start").collect()
    assert [(x.doc_id, x.text, x.span_id) for x in rows] == [(0, "hello", 1), (0, " ", None), (0, "wo", 2), (0, "rld", None), (1, "plain", None)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(X.normalise(F.lit("Total 12\n34 Main"))) == "Total 12-34 Main"
    assert one(X.decode_entities(F.lit("&amp;lt;"))) == "<"
    assert one(X.normalise(F.lit("“x” a\t\tb​ é —"))) == "“x” a b é -"
    assert one(X.luhn(F.lit("4111111111111111"))) and not one(X.luhn(F.lit("4532-8891-2234-5567")))
    assert one(splice(F.lit("abcdefghij"), F.expr("array(named_struct('start', 5, 'end', 8, 'replacement', '##'), named_struct('start', 0, 'end', 2, 'replacement', 'XXXX'))"))) == "XXXXcde##ij"
    assert one(X.label(F.lit("date_of_birth"), F.lit(""))) == "DATE OF_BIRTH"
    for text, want in (("$12,450.00", "AMOUNT"), ("January 15, 2024", "DATE"), ("Marcus Whitfield", "NAME"), (" 123-45-6789 ", "SSN"), ("415-867-5309", "PHONE"), ("a@b", "EMAIL"), ("Smith & Sons", "ORG"), ("A Big Co", "ORG"), ("x", "TEXT")):
        assert one(X.infer_category(F.lit(text))) == want
    assert one(X.fix_ocr(F.lit("OolISB"), F.lit("ssn"))) == "001158" and one(X.fix_ocr(F.lit("a @rnail.corn"), F.lit("email"))) == "a@mail.com"
    assert one(X.rejoin(F.lit("john@exam\nple.com 555-123-\n4567"))) == "john@example.com 555-123-4567"


def test_ner_plug_in(spark):
    def load():
        def find(text):
            if "boom" in text:
                raise ValueError
            return [{"start": m.start(), "end": m.end(), "label": "PERSON", "score": 0.85} for m in re.finditer("Ann Lee", text)] + [{"start": 0, "end": 1, "label": "CARDINAL"}]

        return find

    docs = detect.ner(frame(spark, ["Hi Ann Lee", "boom Ann Lee"]), load, "spacy", vocab.SPACY_TYPES, keep_unknown=False)
    rows = ensemble(docs, normalised=False, recognisers=["spacy"]).where("array_contains(sources, 'spacy')").collect()
    assert [(x.doc_id, x.sources, x.primary_type) for x in rows] == [(0, ["regex", "spacy"], "name")]


def test_absent_recognisers_find_nothing(spark):
    docs = recognisers.spacy(recognisers.presidio(frame(spark, ["Ann Lee", None])))
    assert all(not x.presidio and not x.spacy for x in docs.collect())
    assert ensemble(docs, normalised=False, recognisers=["presidio", "spacy"]).count() == ensemble(docs, normalised=False).count()


def test_queues(spark):
    detector, risk = stored(ensemble(demo.documents(spark)))
    assert {x.category for x in detector.collect()} == {"swift", "phone", "email"} and risk.columns[-1] == "pattern_source"
    assert detector.count() + risk.count() == ensemble(demo.documents(spark)).count()


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "a@b.cd"), (2, "")], "doc_id long, text string")
    assert ensemble(docs).count() == 1 and ensemble(docs.where("false")).count() == 0
    assert X is not None and reconcile.reconcile(detections(spark, [])).count() == 0
