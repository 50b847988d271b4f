import corpus_pipeline
from quillmask.llm import near_dedup, pieces, pii, quality_rules
from quillmask.llm.common import materialise, shared_path, table


def test_stages(spark):
    """Every stage on the predecessor's rows, against what its operator says of them."""
    d = table(spark, "/root/testdata/sf0.001", "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "personal data", "source mix", "encoding"]
    out = [d]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(materialise(stage(spark, out[-1], "/root/testdata/sf0.001"), f"test-{i}"))
        if i < 4:
            assert out[-1].columns == d.columns and out[-1].schema.simpleString() == d.schema.simpleString()
    good = {x.doc_id for x in quality_rules.judge(d).where("kept").collect()}
    assert {x.doc_id for x in out[1].collect()} == good
    once = {x.doc_id for x in near_dedup.near_duplicates(out[1], 80).where("kept").collect()}
    assert sorted(x.doc_id for x in out[2].collect()) == sorted(once)
    texts = {x.doc_id: x.text for x in out[2].collect()}
    for x in pii.find_pii(out[2]).collect():
        masked = next(r for r in out[3].where(f"doc_id = {x.doc_id}").collect()) if x.spans else None
        if masked:
            assert masked.text != texts[x.doc_id] and masked.n_chars == len(masked.text) and not pii.base_spans(masked.text)
    sizes = [x for x in out[4].collect()]
    assert {x.doc_id for x in sizes} <= once and len(sizes) > 0
    m = pieces.load(pieces.default_model())
    back = {(x.doc_id, b"".join(m.surface[i] for i in x.ids)[1:].decode()) for x in out[5].collect()}
    assert back == {(x.doc_id, x.text) for x in sizes} and out[5].count() == len(sizes)


def test_run_and_odd_rows(spark, odd, none):
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (odd, none):
        for stage in (f for _, f in corpus_pipeline.STAGES):
            df = materialise(stage(spark, df, ""), "odd")
        assert "ids" in df.columns and "key" not in df.columns
    folder = shared_path(spark, "sf")
    odd.select(base).write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(x.n_pieces == len(x.ids) for x in rows)
