"""Queries over texts in any language and script, against Python's re and against their SQL."""

import re

import duckdb
import pytest

from quillmask.functions import vocab
from quillmask.plans import queries as Q

TEXTS = (
    ("de", "Jörg Müller ruft Anna Schmidt an: jörg.müller@straße.example, 555-123-4567."),
    ("fr", "Écrire à é555-123-4567 ou 123-45-6789é, puis 123-45-6789 — Jean Dupont"),
    (None, "Ann Lee: ann@lee.example"),
    ("en", "“Ann Lee” 94103 ٣٤٥٦٧ naïve@x.org\n555 123 4567"),
    ("en", "Ann Lee, 94103"),
    ("fr", "éa@b.cd é.a@b.cd enüerpf.12@mail3.example.com @abcé @bob_x ab-cd-eéf x-y_z Ärzte Haus, Le Mans 20\u00a0percent 12\u00a0345"),
    ("es", ""),
    ("es", None),
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_spans_of_all_documents(spark, folder):
    want = {(i, *m.span(), m.group(), p.kind) for i, (_, t) in enumerate(TEXTS) for p in vocab.SECOND_PASS for m in re.finditer(p.regex, t or "")}
    got = [(x.doc_id, x.start, x.end, x.text, x.kind) for x in Q._raw(spark, folder).collect()]
    assert set(got) == want and len(got) == len(want) and {i for i, *_ in want} == {0, 1, 2, 3, 4, 5}
    names = {(x.doc_id, x.start, x.end) for x in Q.queries()["spans_name"](spark, folder).collect()}
    assert names == {(i, s, e) for i, s, e, _, kind in want if kind == "name"}


def test_redacted_documents_are_all_there(spark, folder):
    approved = Q.queries()["approved_spans"](spark, folder).collect()
    assert {x.doc_id for x in approved} - {4}
    got = {x.doc_id: x.content for x in Q.queries()["redact_bars"](spark, folder).collect()}
    for i, (_, t) in enumerate(TEXTS):
        if t is not None:
            for x in (x for x in approved if x.doc_id == i):
                t = t[: x.start] + "█" * (x.end - x.start) + t[x.end :]
            assert got[i] == t
    assert set(got) == set(range(len(TEXTS)))
    assert {x.doc_id for x in Q.queries()["pseudonymize"](spark, folder).collect()} == set(range(len(TEXTS)))


def test_queries_follow_their_sql_in_any_script(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet' WHERE text IS NOT NULL")
    for name in ("spans_email", "spans_name", "detect_legacy", "fp_filter", "reconcile_spans", "ensemble_spans", "detect_regex", "detect_context", "detect_rules"):
        df = Q.queries()[name](spark, folder)
        quoted = ", ".join(f'"{c}"' for c in df.columns)
        want = con.execute(f"SELECT {quoted} FROM ({Q.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in df.collect()), name


def test_no_query_reads_a_part():
    assert not any(part in sql for sql in Q.oracle_sql().values() for part in ("lang =", "strlen(text)", "LIMIT"))


def test_fixture_queries_read_documents(spark, folder):
    both = {**{i: t for i, (_, t) in enumerate(TEXTS)}, **{-1 - i: t for i, t in enumerate(Q.TEXTS)}}
    got = {(x.doc_id, x.start, x.end, x.kind) for x in Q.queries()["spans_fixture"](spark, folder).collect()}
    rules = [Q.O.pattern(n) for n in Q._FIXED]
    assert got == {(i, *m.span(), p.kind) for i, t in both.items() for p in rules for m in re.finditer(p.regex, t or "", re.I if "i" in p.flags else 0)}
    fixed = {x.doc_id: x for x in Q.queries()["repairs"](spark, folder).collect()}
    assert set(fixed) == set(both) and all(fixed[i].numeric == t.translate(str.maketrans("OolISB", "001158")) for i, t in both.items() if t)
    regions = {x.doc_id for x in Q.queries()["pii_regions"](spark, folder).collect()}
    assert regions == {i for i, t in both.items() if any(re.search(regex, t or "", re.I) for regex, _ in vocab.REGION_HINTS)}
