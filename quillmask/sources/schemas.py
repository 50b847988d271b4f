"""Table schemas of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else False) for f in fields])


DOCUMENTS = _table(("doc_id", _L), ("title", _S), ("text", _S), ("status", _S), ("created_at", T.TimestampType(), True))
GROUND_TRUTH = _table(("doc_id", _L), ("start", _I), ("end", _I), ("category", _S), ("text", _S))
_SPAN = (
    ("doc_id", _L), ("span_id", _I), ("start", _I), ("end", _I), ("text", _S), ("category", _S, True), ("confidence_score", _I, True), ("is_manual", _B),
    ("sources", T.ArrayType(_S), True), ("agreement_count", _I, True), ("conflict_types", T.ArrayType(_S), True),
)
DETECTOR_SPANS = _table(*_SPAN)
RISK_FLAGS = _table(*[(n, t) if n == "category" else (n, t, *r) for n, t, *r in _SPAN], ("pattern_source", _S))
DECISION_EVENTS = _table(("doc_id", _L), ("span_type", _S), ("span_id", _I), ("decision", _S, True), ("seq", _L))
PSEUDONYMS = _table(("doc_id", _L), ("original_text", _S), ("normalized_text", _S), ("category", _S), ("pseudonym", _S))
OUTPUTS = _table(("doc_id", _L), ("mode", _S), ("redaction_style", _S, True), ("content", _S), ("mapping", T.MapType(_S, _S), True), ("created_at", T.TimestampType(), True))
