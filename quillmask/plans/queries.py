"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmask.functions import text as X
from quillmask.functions import vocab
from quillmask.functions.spans import all_spans, find_all, prepared
from quillmask.operators import detect, reconcile, review, sanitise
from quillmask.operators.ensemble import ensemble, stored
from quillmask.plans import oracle as O
from quillmask.plans.fixture import PERSON, TEXTS, recogniser
from quillmask.sources import files, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query and its SQL."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files make fewer; detection costs far more than moving the texts once."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents."""
    return spread(docs(spark, sf_dir).select("doc_id", "text"))


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents and, under negative ids, the fixture, which holds what the documents lack."""
    short = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return every(spark, sf_dir).union(short)


def pattern_rows(df: DataFrame, names: list[str], where: str = "true") -> DataFrame:
    """doc_id, start, end, text, kind of single patterns' matches."""
    arrays = F.expr(all_spans([O.pattern(n) for n in names], names, where))
    return prepared(df).select("doc_id", F.explode(arrays).alias("x")).select("doc_id", "x.start", "x.end", "x.text", "x.kind")


_COLS = 'SELECT doc_id, start, "end", text, kind FROM'


@query("SELECT doc_id, lang, source, doc_id = 1 AS is_demo FROM documents ORDER BY doc_id")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.list_documents(docs(spark, sf_dir)).select("doc_id", "lang", "source", "is_demo")


@query(f"WITH {O.DOCS} {_COLS} ({O.one('docs', 'email_regex')})")
def spans_email(spark, sf_dir):
    return pattern_rows(docs(spark, sf_dir), ["email_regex"])


@query(f"WITH {O.DOCS} {_COLS} ({O.one('docs', 'ipv4')})")
def spans_ipv4(spark, sf_dir):
    return pattern_rows(docs(spark, sf_dir), ["ipv4"])


@query(f"WITH {O.DOCS} {_COLS} ({O.one('docs', 'credit_card')}) WHERE {O.LUHN_TEXT}")
def spans_card_luhn(spark, sf_dir):
    return pattern_rows(docs(spark, sf_dir), ["credit_card"], detect.valid(["credit_card"]))


@query(f"WITH {O.DOCS} {_COLS} ({O.one('docs', 'phone_regex')})")
def spans_phone(spark, sf_dir):
    return pattern_rows(docs(spark, sf_dir), ["phone_regex"])


@query(f"WITH {O.DOCS} {_COLS} ({O.one('docs', 'name_heuristic')})")
def spans_name(spark, sf_dir):
    return pattern_rows(every(spark, sf_dir), ["name_heuristic"])


_FIXED = ["ssn_regex", "postal_regex", "ein", "itin", "email", "uk_postcode", "license_plate", "date", "iban", "mac_address"]


@query(f"WITH {O.UNITED} {_COLS} (" + " UNION ALL ".join(O.one("united", n, i) for i, n in enumerate(_FIXED)) + ")")
def spans_fixture(spark, sf_dir):
    return pattern_rows(united(spark, sf_dir), _FIXED)


@query(f"WITH {O.UNITED} {_COLS} ({O.detected_rules('united')})")
def detect_rules(spark, sf_dir):
    return detect.explode_spans(detect.detect(united(spark, sf_dir), ["rules"]), ["rules"]).select("doc_id", "start", "end", "text", "kind")


@query(f"WITH {O.UNITED} {_COLS} ({O.detected_regex('united')})")
def detect_regex(spark, sf_dir):
    return detect.explode_spans(detect.detect(united(spark, sf_dir), ["regex"]), ["regex"]).select("doc_id", "start", "end", "text", "kind")


@query(f"WITH {O.UNITED} {_COLS} ({O.detected_context('united')})")
def detect_context(spark, sf_dir):
    return detect.explode_spans(detect.detect(united(spark, sf_dir), ["context"]), ["context"]).select("doc_id", "start", "end", "text", "kind")


@query(f"WITH {O.RAW} SELECT doc_id, start, \"end\", text, kind, replace(source, '_', ' ') AS label FROM raw")
def detect_legacy(spark, sf_dir):
    found = detect.explode_spans(detect.detect(every(spark, sf_dir), ["legacy"]), ["legacy"])
    names = F.create_map(*[F.lit(x) for p in vocab.SECOND_PASS for x in (p.kind, p.name.replace("_", " "))])
    return found.select("doc_id", "start", "end", "text", "kind", F.element_at(names, F.col("kind")).alias("label"))


@query(f"SELECT page_id, {O.normalised('nfc_normalize(html)')} AS text FROM pages")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalise(F.col("html")).alias("text"))


@query(f"WITH {O.UNITED} SELECT doc_id, {O.normalised('nfc_normalize(text)')} AS text FROM united")
def normalize_documents(spark, sf_dir):
    return united(spark, sf_dir).select("doc_id", X.normalise(F.col("text")).alias("text"))


def _entities(text: str) -> str:
    for entity, plain in vocab.HTML_ENTITIES:
        text = f"replace({text}, {O._s(entity)}, {O._s(plain)})"
    return text


@query(f"SELECT page_id, {_entities('html')} AS text FROM pages")
def html_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.decode_entities(F.col("html")).alias("text"))


@query(
    f"WITH {O.UNITED} SELECT doc_id, translate(text, 'OolISB', '001158') AS numeric, replace(replace(replace(text, ' ', ''), 'rnail', 'mail'), 'corn', 'com') AS address, "
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]*)\s*\n\s*([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', '\1\2', 'g'), '(\d{3}[-.\s]?\d{3})[-.\s]?\n[-.\s]?(\d{4})', '\1-\2', 'g'), "
    r"'(\d{4}[-.\s]?\d{4})[-.\s]?\n[-.\s]?(\d{4}[-.\s]?\d{4})', '\1-\2', 'g'), '(\d{3})[-.\s]?\n[-.\s]?(\d{2})[-.\s]?\n?[-.\s]?(\d{4})', '\1-\2-\3', 'g') AS rejoined FROM united",
)
def repairs(spark, sf_dir):
    t = F.col("text")
    return united(spark, sf_dir).select("doc_id", X.fix_ocr(t, F.lit("ssn")).alias("numeric"), X.fix_ocr(t, F.lit("email")).alias("address"), X.rejoin(t).alias("rejoined"))


_HINTS = " UNION ALL ".join(O.spans("united", regex, hint, hint, i, "i") for i, (regex, hint) in enumerate(vocab.REGION_HINTS))


@query(
    f"""WITH {O.UNITED}, h AS (SELECT doc_id, start, "end" AS e, kind AS hint, own AS t FROM ({_HINTS})),
r AS (SELECT *, instr(substr(t, e + 1), chr(10)) AS nl FROM h),
q AS (SELECT *, least(e + 100, CASE WHEN nl > 0 AND e + nl - 1 > 0 THEN e + nl - 1 ELSE length(t) END)::INT AS stop FROM r)
SELECT doc_id, start, stop AS "end", substr(t, start + 1, stop - start) AS text, hint FROM q""",
)
def pii_regions(spark, sf_dir):
    return united(spark, sf_dir).select("doc_id", F.explode(X.regions("text")).alias("x")).select("doc_id", "x.*")


def _raw(spark, sf_dir):
    return detect.explode_spans(detect.detect(every(spark, sf_dir), ["second_pass"]), ["second_pass"])


@query(f"WITH {O.RAW} SELECT doc_id, start, \"end\", text, kind FROM (SELECT *, {O.TRIM} AS t FROM raw) WHERE NOT ({O.FALSE_POSITIVE})")
def fp_filter(spark, sf_dir):
    return _raw(spark, sf_dir).where(~detect.false_positive(F.col("text"), F.col("kind"))).select("doc_id", "start", "end", "text", "kind")


@query(f'WITH {O.RECONCILED} SELECT doc_id, start, "end", text, primary_type, types, sources, agreement_count, confidence_score, queue FROM reconciled')
def reconcile_spans(spark, sf_dir):
    return reconcile.reconcile(_raw(spark, sf_dir))


@query(f'WITH {O.ENSEMBLE} SELECT doc_id, start, "end", text, primary_type, types, sources, agreement_count, confidence_score, queue FROM reconciled')
def ensemble_spans(spark, sf_dir):
    return ensemble(every(spark, sf_dir))


@query(f"WITH {O.ENSEMBLE} SELECT primary_type, queue, agreement_count, count(*) AS n_spans, count(DISTINCT doc_id) AS n_documents, avg(confidence_score) AS avg_confidence FROM reconciled GROUP BY ALL")
def ensemble_by_type(spark, sf_dir):
    """The flagship: reconciled spans of all documents, counted by type, queue and agreement."""
    spans = ensemble(every(spark, sf_dir))
    return spans.groupBy("primary_type", "queue", "agreement_count").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_documents"), F.avg("confidence_score").alias("avg_confidence"))


@query(f"""WITH {O.RAW}, redacted AS (SELECT doc_id, start, "end" FROM raw WHERE kind IN ('email', 'phone') AND (doc_id + start) % 2 = 0)
SELECT doc_id, start, "end", text, kind, source AS pattern_source FROM raw WHERE NOT EXISTS (SELECT 1 FROM redacted r WHERE r.doc_id = raw.doc_id AND raw.start < r."end" AND raw."end" > r.start)""")
def risk_second_pass(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    redacted = raw.where("kind IN ('email', 'phone') AND (doc_id + start) % 2 = 0")
    return reconcile.outside(raw, redacted).select("doc_id", "start", "end", "text", "kind", F.col("source").alias("pattern_source"))


def _found(spark, sf_dir):
    """The reconciled spans of the second pass, found once: narrow rows that history, truth and texts are joined to again and again."""
    return reconcile.reconcile(_raw(spark, sf_dir)).persist()


def _spans(spark, sf_dir):
    return review.typed(*stored(_found(spark, sf_dir)))


def _events(spans: DataFrame) -> DataFrame:
    """A made-up history: most spans are approved, some then rejected, some approvals withdrawn."""
    pick = lambda yes, no: F.when(F.col("span_type") == "detector", yes).otherwise(no).alias("decision")
    seq = lambda n: (2 * F.col("start") + n).cast("bigint").alias("seq")
    first = spans.where("(doc_id + start) % 4 <> 3").select(*review.KEY, pick("approve", "redact"), seq(0))
    second = spans.where("(doc_id + start) % 4 = 1").select(*review.KEY, pick("reject", "dismiss"), seq(1))
    third = spans.where("(doc_id + start) % 4 = 2 AND start % 2 = 0").select(*review.KEY, F.lit(None).cast("string").alias("decision"), seq(1))
    return first.union(second).union(third)


@query(f"WITH {O.STORED} SELECT * FROM latest")
def latest_decision(spark, sf_dir):
    return review.latest_decisions(_events(_spans(spark, sf_dir))).drop("seq")


@query(f'WITH {O.STORED} SELECT doc_id, span_type, span_id, start, "end", text, category, confidence_score, decision, {O.URGENCY} AS urgency FROM items')
def review_items(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return review.review_items(spans, _events(spans)).select("doc_id", "span_type", "span_id", "start", "end", "text", "category", "confidence_score", "decision", "urgency")


@query(f"""WITH {O.STORED}, f AS (SELECT doc_id, span_type, text, first(decision ORDER BY span_id) AS d FROM items WHERE decision IS NOT NULL GROUP BY ALL)
SELECT doc_id, span_type, span_id, coalesce(decision, f.d) AS spread FROM items LEFT JOIN f USING (doc_id, span_type, text)""")
def linked_decisions(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return review.linked(review.review_items(spans, _events(spans))).select("doc_id", "span_type", "span_id", "spread")


@query(f"""WITH {O.STORED}, r AS (SELECT l.*, s.start, s."end", t.doc_id IS NOT NULL AS real FROM latest l JOIN spans s USING (doc_id, span_type, span_id) LEFT JOIN truth t ON t.doc_id = l.doc_id AND t.start = s.start AND t."end" = s."end")
SELECT doc_id, count(*) FILTER (decision = 'redact' AND real) AS exposures_caught, count(*) FILTER (decision = 'dismiss' AND real) AS exposures_missed,
  count(*) FILTER (decision = 'reject' AND NOT real) AS unnecessary_redactions_fixed, count(*) FILTER (decision = 'approve' AND real) AS correct_redactions_kept, count(*) AS total_reviewed FROM r GROUP BY doc_id""")
def review_summary(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return review.summary(spans, _events(spans), spans.where("category IN ('email', 'phone')").select("doc_id", "start", "end"))


@query(f"""WITH {O.STORED}, c AS (SELECT doc_id, count(*) FILTER (span_type = 'detector') AS detector_count, count(*) FILTER (span_type = 'risk_flag') AS risk_count, count(decision) AS decision_count FROM items GROUP BY doc_id)
SELECT *, decision_count >= detector_count + risk_count AS complete FROM c""")
def completion_gate(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return review.completion(spans, _events(spans))


@query(f"""WITH {O.STORED} SELECT doc_id, count(decision) AS decided, count(*) AS total, count(*) FILTER (decision IS NULL AND span_type = 'risk_flag') AS pending_flags,
  count(decision) / count(*) * 100 AS percent, count(decision) = count(*) AS all_decided FROM items GROUP BY doc_id""")
def review_progress(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return review.progress(review.review_items(spans, _events(spans)))


@query(f"WITH {O.STORED} SELECT doc_id, CASE WHEN count(*) FILTER (decision IS NULL) = 0 THEN 'completed' WHEN count(decision) > 0 OR max((doc_id + start) % 4 <> 3) THEN 'in_progress' ELSE 'pending_review' END AS status FROM items GROUP BY doc_id")
def document_status(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    events = _events(spans)
    return review.status(spans.select("doc_id").distinct(), events, review.completion(spans, events).where("complete"))


@query(f"""WITH {O.STORED} SELECT doc_id, span_type, span_id, regexp_replace(upper(category), '^([^_]*)_', '\\1 ') AS label, {O.INFER} AS inferred,
  CASE WHEN confidence_score >= 80 THEN 'high' WHEN confidence_score >= 60 THEN 'medium' ELSE 'low' END AS bucket,
  CASE WHEN agreement_count > 1 THEN 'verified by ' || agreement_count ELSE 'caught by ' || sources[1] END AS provenance,
  CASE WHEN decision IN ('approve', 'redact') THEN 'redacted' WHEN decision IN ('reject', 'dismiss') THEN 'released' END AS outcome,
  CASE WHEN length(text) > 12 THEN substr(text, 1, 12) || '...' ELSE text END AS preview FROM (SELECT *, {O.TRIM} AS t FROM items)""")
def span_badges(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    rows = review.review_items(spans, _events(spans))
    return rows.select(
        "doc_id", "span_type", "span_id", X.label(F.col("category"), F.col("text")).alias("label"), X.infer_category(F.col("text")).alias("inferred"), X.confidence_bucket(F.col("confidence_score"), F.col("is_manual")).alias("bucket"),
        X.provenance(F.col("is_manual"), F.col("agreement_count"), F.col("sources")).alias("provenance"), review.outcome(F.col("span_type"), F.col("decision")).alias("outcome"), X.shortened(F.col("text"), 12).alias("preview"),
    )


@query(f"WITH {O.STORED} SELECT doc_id, span_type, text, first(span_id ORDER BY start, span_id) AS span_id, min(start) AS start, count(*) AS copies FROM spans GROUP BY doc_id, span_type, text")
def unique_cards(spark, sf_dir):
    return review.cards(_spans(spark, sf_dir))


@query(f"""WITH {O.STORED}, g AS (SELECT *, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start, span_type, span_id) AS past FROM spans),
p AS (SELECT doc_id, start, "end", span_type, span_id FROM spans UNION ALL SELECT doc_id, past, start, NULL, NULL FROM g WHERE start > past
  UNION ALL SELECT d.doc_id, coalesce(max(s."end"), 0), length(d.text)::INT, NULL, NULL FROM docs d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id, d.text HAVING coalesce(max(s."end"), 0) < length(d.text))
SELECT p.doc_id, start, "end", substr(d.text, start + 1, "end" - start) AS text, span_type, span_id FROM p JOIN docs d USING (doc_id)""")
def viewer_segments(spark, sf_dir):
    return review.segments(every(spark, sf_dir), _spans(spark, sf_dir))


def _approved(spark, sf_dir):
    detector, risk = stored(_found(spark, sf_dir))
    return sanitise.approved(detector, risk, _events(review.typed(detector, risk)))


@query(f"WITH {O.STORED} SELECT * FROM approved")
def approved_spans(spark, sf_dir):
    return _approved(spark, sf_dir)


def _listed(rows: DataFrame) -> DataFrame:
    """Redacted documents with their redactions as one text."""
    one = F.transform("redactions", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["category"], x["original"], x["replacement"]))
    return rows.select("doc_id", "content", "redaction_count", F.array_join(one, "|").alias("listed"))


def _named(rows: DataFrame) -> DataFrame:
    """Pseudonymised documents with their mapping as one text."""
    one = F.transform(F.array_sort(F.map_entries("mapping")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return rows.select("doc_id", "content", F.array_join(one, "|").alias("mapping"), "mapping_count")


@query(f"WITH {O.STORED}, {O.spliced(chr(39) + '█' + chr(39) + '.repeat(length(text)::INT)')}, {O.redactions('repeat(chr(9608), length(text)::INT)')} SELECT doc_id, content, n::INT AS redaction_count, coalesce(listed, '') AS listed FROM content LEFT JOIN redactions USING (doc_id)")
def redact_bars(spark, sf_dir):
    return _listed(sanitise.redact(every(spark, sf_dir), _approved(spark, sf_dir), "bars"))


@query(f"WITH {O.STORED}, {O.spliced(chr(39) + '[REDACTED]' + chr(39))}, {O.redactions("'[REDACTED]'")} SELECT doc_id, content, n::INT AS redaction_count, coalesce(listed, '') AS listed FROM content LEFT JOIN redactions USING (doc_id)")
def redact_brackets(spark, sf_dir):
    return _listed(sanitise.redact(every(spark, sf_dir), _approved(spark, sf_dir), "brackets"))


@query(f"WITH {O.STORED}, {O.MAPPINGS} SELECT * FROM mappings")
def pseudonym_map(spark, sf_dir):
    return sanitise.pseudonyms(_approved(spark, sf_dir))


@query(
    f"WITH {O.STORED}, {O.MAPPINGS}, "
    + O.spliced(f"(SELECT pseudonym FROM mappings m WHERE m.doc_id = approved.doc_id AND m.category = approved.category AND m.normalized_text = {O.NORMAL})")
    + f", {O.MAPPED} SELECT c.doc_id, content, coalesce(d.mapping, '') AS mapping, (SELECT count(*) FROM mappings m WHERE m.doc_id = c.doc_id) AS mapping_count FROM content c LEFT JOIN mapped d USING (doc_id)",
)
def pseudonymize(spark, sf_dir):
    return _named(sanitise.pseudonymise(every(spark, sf_dir), _approved(spark, sf_dir)))


@query(f"""WITH {O.STORED}, {O.MAPPINGS} SELECT doc_id, original_text, normalized_text, category, prefix || '_' || (row_number() OVER (PARTITION BY doc_id, prefix ORDER BY a, b, c)
  + CASE WHEN prefix = 'PERSON' AND doc_id IN (SELECT doc_id FROM approved WHERE category IN ('email', 'phone')) THEN 7 ELSE 0 END) AS pseudonym FROM firsts WHERE category NOT IN ('email', 'phone')""")
def pseudonyms_continued(spark, sf_dir):
    """Numbers go on after those given out; what has a label keeps it, and a label without a number counts for nothing."""
    approved = _approved(spark, sf_dir)
    given = sanitise.pseudonyms(approved.where("category IN ('email', 'phone')")).persist()
    label = lambda normal, pseudonym: given.select("doc_id", F.lit("?").alias("original_text"), F.lit(normal).alias("normalized_text"), F.lit("name").alias("category"), F.lit(pseudonym).alias("pseudonym")).distinct()
    return sanitise.pseudonyms(approved, given.unionByName(label("?", "PERSON_x")).unionByName(label("!", "PERSON_7")))


@query(f"""WITH {O.STORED} SELECT doc_id, span_type, span_id, CASE WHEN len(types) > 1 THEN array_to_string(types, ',') END AS conflicts, len(types) > 1 AS mismatch, CASE WHEN span_type = 'risk_flag' THEN array_to_string(sources, ',') END AS pattern_source FROM spans""")
def stored_spans(spark, sf_dir):
    """What the review tables say of a span's types and sources."""
    detector, risk = stored(_found(spark, sf_dir))
    rows = review.typed(detector, risk)
    return rows.select("doc_id", "span_type", "span_id", F.array_join("conflict_types", ",").alias("conflicts"), F.col("conflict_types").isNotNull().alias("mismatch"), "pattern_source")


@query(f"""WITH {O.STORED}, u AS (SELECT *, {O.URGENCY} AS urgency FROM items) SELECT doc_id, span_type, span_id, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN span_type = 'detector' THEN 2 WHEN urgency = 'critical' THEN 0 ELSE 1 END, start, span_id))::INT AS place FROM u""")
def display_order(spark, sf_dir):
    """The place of each item in its document's list."""
    spans = _spans(spark, sf_dir)
    return review.places(review.review_items(spans, _events(spans))).select("doc_id", "span_type", "span_id", "place")


@query(f"""WITH {O.STORED}, e AS (SELECT * FROM events WHERE decision IS NULL OR (span_id % 3 > 0 AND span_id % 5 > 0)), l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, span_type, span_id ORDER BY seq DESC) AS r FROM e)
SELECT doc_id, span_type, span_id, decision FROM l WHERE r = 1 AND decision IS NOT NULL""")
def valid_decisions(spark, sf_dir):
    """Decisions of the other type's vocabulary, and of none, are ignored."""
    wrong = F.when(F.col("decision").isNull(), F.col("decision")).when(F.col("span_id") % 3 == 0, "maybe").when(F.col("span_id") % 5 == 0, F.when(F.col("span_type") == "detector", "redact").otherwise("approve")).otherwise(F.col("decision"))
    return review.latest_decisions(_events(_spans(spark, sf_dir)).withColumn("decision", wrong)).drop("seq")


@query(f"""WITH {O.STORED}, {O.MAPPINGS} SELECT 'documents' AS "table", count(*) AS "rows" FROM docs UNION ALL SELECT 'spans', count(*) FROM spans UNION ALL SELECT 'mappings', count(*) FROM mappings""")
def table_statistics(spark, sf_dir):
    return tables.statistics(documents=docs(spark, sf_dir), spans=_found(spark, sf_dir), mappings=sanitise.pseudonyms(_approved(spark, sf_dir)))


@query(f"WITH {O.STORED}, {O.MAPPINGS} SELECT doc_id, count(*) AS deleted_count FROM mappings WHERE doc_id % 2 = 0 GROUP BY doc_id")
def cleared_mappings(spark, sf_dir):
    return tables.cleared(sanitise.pseudonyms(_approved(spark, sf_dir)), docs(spark, sf_dir).where("doc_id % 2 = 0"))[1]


@query("SELECT doc_id, lang, length(text)::INT AS char_count FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    return tables.point(docs(spark, sf_dir), "doc_id", 17).select("doc_id", "lang", F.length("text").alias("char_count"))


@query(f"""WITH {O.STORED} SELECT span_type, span_id, start, "end" FROM spans WHERE doc_id = (SELECT min(doc_id) FROM spans) AND start < 100000 AND "end" > 50""")
def overlapping_spans(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    first = spans.agg(F.min("doc_id")).head()[0]
    return tables.overlapping(spans, -1 if first is None else first, 50, 100000).select("span_type", "span_id", "start", "end")


@query(f"""WITH {O.ensemble('documents', '0.85::DOUBLE', O.spans('docs', PERSON, 'name', 'presidio', 0, column='text'))}, {O.reconciled_steps()}
SELECT doc_id, start, "end", text, primary_type, types, sources, agreement_count, confidence_score, queue FROM reconciled""")
def ensemble_recognised(spark, sf_dir):
    """The ensemble beside an entity recogniser, so that what recognisers add to a confidence is compared."""
    found = detect.ner(_normal(spark, sf_dir), recogniser, "presidio", vocab.PRESIDIO_TYPES, keep_unknown=True)
    return ensemble(found, normalised=False, recognisers=["presidio"])


def _normal(spark, sf_dir):
    return every(spark, sf_dir).select("doc_id", X.normalise(F.col("text")).alias("text"))


def _ensemble_approved(spark, sf_dir):
    detector, risk = stored(ensemble(every(spark, sf_dir)).persist())
    return sanitise.approved(detector, risk, _events(review.typed(detector, risk)))


@query(f"WITH {O.ENSEMBLE_STORED}, {O.spliced(chr(39) + '█' + chr(39) + '.repeat(length(text)::INT)')}, {O.redactions('repeat(chr(9608), length(text)::INT)')} SELECT doc_id, content, n::INT AS redaction_count, coalesce(listed, '') AS listed FROM content LEFT JOIN redactions USING (doc_id)")
def ensemble_redact(spark, sf_dir):
    """The whole way: normalised texts, the ensemble's spans, their decisions, bars."""
    return _listed(sanitise.redact(_normal(spark, sf_dir), _ensemble_approved(spark, sf_dir), "bars"))


@query(
    f"WITH {O.ENSEMBLE_STORED}, {O.MAPPINGS}, "
    + O.spliced(f"(SELECT pseudonym FROM mappings m WHERE m.doc_id = approved.doc_id AND m.category = approved.category AND m.normalized_text = {O.NORMAL})")
    + f", {O.MAPPED} SELECT c.doc_id, content, coalesce(d.mapping, '') AS mapping, (SELECT count(*) FROM mappings m WHERE m.doc_id = c.doc_id) AS mapping_count FROM content c LEFT JOIN mapped d USING (doc_id)",
)
def ensemble_pseudonymize(spark, sf_dir):
    return _named(sanitise.pseudonymise(_normal(spark, sf_dir), _ensemble_approved(spark, sf_dir)))


@query(f"""WITH {O.ENSEMBLE_STORED} SELECT doc_id, span_type, span_id, start, "end", text, category, confidence_score, decision, {O.URGENCY} AS urgency FROM items""")
def ensemble_review_items(spark, sf_dir):
    spans = review.typed(*stored(ensemble(every(spark, sf_dir)).persist()))
    return review.review_items(spans, _events(spans)).select("doc_id", "span_type", "span_id", "start", "end", "text", "category", "confidence_score", "decision", "urgency")



@query(f"""WITH {O.STORED}, c AS (SELECT doc_id, x AS start, x + 10 AS "end" FROM docs, (SELECT unnest([0, 40, 200, 5000]) AS x))
SELECT c.doc_id, c.start, c."end", substr(d.text, start + 1, 10) AS text FROM c JOIN docs d USING (doc_id) WHERE c."end" <= length(d.text)
  AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = c.doc_id AND c.start < s."end" AND c."end" > s.start)""")
def manual_spans(spark, sf_dir):
    d = every(spark, sf_dir)
    at = F.explode(F.array(*[F.lit(x) for x in (0, 40, 200, 5000)]))
    asked = d.select("doc_id", at.alias("start")).select("doc_id", "start", (F.col("start") + 10).alias("end"), F.lit("other").alias("category"), F.lit("detector").alias("span_type"))
    return review.manual_spans(asked, d, _spans(spark, sf_dir)).select("doc_id", "start", "end", "text")


@query(f"""WITH {O.STORED}, o AS (SELECT doc_id, span_type, span_id, arg_max(c, q) AS c FROM (SELECT doc_id, span_type, span_id, 'other' AS c, 1 AS q FROM spans WHERE start % 3 = 0 UNION ALL SELECT doc_id, span_type, span_id, 'address', 2 FROM spans WHERE start % 6 = 0) GROUP BY ALL)
SELECT s.doc_id, s.span_type, s.span_id, coalesce(o.c, s.category) AS category FROM spans s LEFT JOIN o USING (doc_id, span_type, span_id) WHERE s.start % 5 <> 0""")
def edited_spans(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    new = lambda where, c, q: spans.where(where).select(*review.KEY, F.lit(c).alias("category"), F.lit(q).alias("seq"))
    changed = review.override_category(spans, new("start % 3 = 0", "other", 1).union(new("start % 6 = 0", "address", 2)))
    return review.without(changed, spans.where("start % 5 = 0")).select(*review.KEY, "category")


@query(f"""WITH {O.STORED}, h AS (SELECT *, CASE WHEN span_id % 2 = 0 THEN 'g' || span_type END AS group_id FROM events), l AS (SELECT doc_id, max(seq) AS s, arg_max(coalesce(group_id, ''), seq) AS g FROM h GROUP BY doc_id)
SELECT doc_id, span_type, span_id, seq FROM h JOIN l USING (doc_id) WHERE NOT (seq = s OR coalesce(group_id = g, false))""")
def undo_last(spark, sf_dir):
    history = _events(_spans(spark, sf_dir)).withColumn("group_id", F.when(F.col("span_id") % 2 == 0, F.concat(F.lit("g"), F.col("span_type"))))
    return review.undo(history).select(*review.KEY, "seq")


@query(f"""WITH {O.STORED}, a AS (SELECT DISTINCT i.doc_id, i.span_type, i.span_id FROM items i JOIN items j ON i.doc_id = j.doc_id AND i.span_type = j.span_type AND i.text = j.text AND j.decision IS NOT NULL)
SELECT e.doc_id, e.span_type, e.span_id, e.seq FROM events e ANTI JOIN a USING (doc_id, span_type, span_id)""")
def reset_linked(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    events = _events(spans)
    return review.reset(events, review.review_items(spans, events)).select(*review.KEY, "seq")


@query(f"WITH {O.STORED} SELECT doc_id, span_type, span_id, seq FROM events QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) <= 3")
def log_tail(spark, sf_dir):
    return review.log_tail(_events(_spans(spark, sf_dir))).select(*review.KEY, "seq")


@query(f"""WITH {O.STORED}, t AS (SELECT doc_id, 'detector' AS span_type, (row_number() OVER (PARTITION BY doc_id ORDER BY start, "end"))::INT AS span_id, start, "end" FROM (SELECT DISTINCT doc_id, start, "end" FROM raw))
SELECT t.doc_id, t.span_id, t.start, t."end", coalesce(first(s.agreement_count ORDER BY s.start, s."end"), 1)::INT AS agreement_count, first(s.confidence_score ORDER BY s.start, s."end") AS confidence_score
FROM t LEFT JOIN reconciled s ON s.doc_id = t.doc_id AND t.start < s."end" AND t."end" > s.start AND s.primary_type <> 'name' GROUP BY t.doc_id, t.span_id, t.start, t."end\"""")
def overlay_metadata(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    found = reconcile.reconcile(raw).where("primary_type <> 'name'")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end"))
    targets = raw.select("doc_id", "start", "end").distinct().select("doc_id", F.lit("detector").alias("span_type"), number.alias("span_id"), "start", "end", F.lit(None).cast("int").alias("confidence_score"))
    return reconcile.overlay(targets, found).select("doc_id", "span_id", "start", "end", "agreement_count", "confidence_score")


@query("SELECT doc_id, 'Uploaded: ' || regexp_replace(source || '.' || lang || '.docx', '\\.[^.]*$', '') AS title, length(text)::INT AS char_count FROM documents")
def upload_titles(spark, sf_dir):
    name = F.concat_ws(".", "source", "lang", F.lit("docx"))
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("Uploaded: "), F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"), F.length("text").alias("char_count"))


@query(f"WITH c AS ({O.texts('(SELECT conv_id AS doc_id, text FROM conversations)')}) SELECT count(*) AS n FROM ({O.one('c', 'email_regex')})")
def conversations_clean(spark, sf_dir):
    """A negative control: conversations hold no addresses."""
    c = table(spark, sf_dir, "conversations").select(F.explode(find_all("text", O.pattern("email_regex").java)).alias("x"))
    return c.agg(F.count("*").alias("n"))


@query(f"""WITH {O.STORED}, n AS (SELECT doc_id, count(*) FILTER (span_type = 'detector') AS d, count(*) FILTER (span_type = 'risk_flag') AS r FROM spans GROUP BY doc_id)
SELECT docs.doc_id, length(text)::INT AS char_count, coalesce(d, 0) AS detector_count, coalesce(r, 0) AS risk_count FROM docs LEFT JOIN n USING (doc_id)""")
def upload_counts(spark, sf_dir):
    return files.with_counts(docs(spark, sf_dir), *stored(_found(spark, sf_dir)))


@query(f"""WITH {O.STORED}, {O.spliced(chr(39) + '[REDACTED]' + chr(39))} SELECT doc_id, 'redact' AS mode, 'brackets' AS redaction_style, content, TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 28) DAY AS created_at FROM content""")
def stored_outputs(spark, sf_dir):
    """Outputs as they are stored, newest first."""
    rows = sanitise.sanitise(every(spark, sf_dir), _approved(spark, sf_dir), "redact", "brackets")
    made = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(doc_id % 28 as int))")
    return tables.outputs_of(sanitise.output_rows(rows, made)).drop("mapping")


@query(f"""WITH {O.STORED} SELECT doc_id, span_type, span_id, start, text, category, array_to_string(sources, ',') AS sources FROM spans""")
def json_rows(spark, sf_dir):
    """Stored spans written as JSON objects and read back."""
    spans = _spans(spark, sf_dir).select("doc_id", "span_type", "span_id", "start", "text", "category", "sources")
    back = files.from_json_rows(files.to_json_rows(spans), spans.schema)
    return back.withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {O.STORED}, c AS (SELECT * FROM items WHERE start % 7 = 0) SELECT doc_id, span_type, span_id, CASE WHEN span_type = 'risk_flag' THEN 'dismiss' ELSE 'reject' END AS decision FROM items i
WHERE start % 7 = 0 OR (decision IS NULL AND EXISTS (SELECT 1 FROM c WHERE c.doc_id = i.doc_id AND c.span_type = i.span_type AND c.text = i.text))""")
def linked_dismissals(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    items = review.review_items(spans, _events(spans))
    return review.dismissals(items, items.where("start % 7 = 0"), True)


@query(f"WITH {O.STORED} SELECT doc_id, span_type, span_id, seq FROM events WHERE doc_id % 3 <> 0")
def reset_everything(spark, sf_dir):
    return review.reset_all(_events(_spans(spark, sf_dir)), docs(spark, sf_dir).where("doc_id % 3 = 0")).select(*review.KEY, "seq")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble_by_type(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
