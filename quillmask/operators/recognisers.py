"""Entity recognisers for detect.ner(): models that are loaded once in each Python worker, where they are installed.

Without its library or model a recogniser finds nothing, as the ensemble then goes on without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmask.functions import vocab
from quillmask.operators.detect import Recogniser, ner


def _nothing(text: str) -> list[dict]:
    return []


def load_presidio() -> Recogniser:
    try:
        from presidio_analyzer import AnalyzerEngine

        engine = AnalyzerEngine()
    except (ImportError, OSError):
        return _nothing
    return lambda text: [{"start": r.start, "end": r.end, "label": r.entity_type, "score": r.score} for r in engine.analyze(text=text, entities=[], language="en")]


def load_spacy(model: str = "en_core_web_sm") -> Recogniser:
    try:
        import spacy

        nlp = spacy.load(model)
    except (ImportError, OSError):
        return _nothing
    return lambda text: [{"start": e.start_char, "end": e.end_char, "label": e.label_} for e in nlp(text).ents]


def presidio(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an array column presidio; labels without a category of ours keep their name."""
    return ner(docs, load_presidio, "presidio", vocab.PRESIDIO_TYPES, keep_unknown=True, text=text)


def spacy(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an array column spacy; labels without a category of ours are dropped."""
    return ner(docs, load_spacy, "spacy", vocab.SPACY_TYPES, keep_unknown=False, text=text)
