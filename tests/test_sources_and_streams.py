import io
import zipfile

from pyspark.sql import functions as F

from quillmask.sources import files, schemas, tables
from quillmask.streaming import pipeline


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, content in (("My.Letter.DOCX", docx(["Hello", " ", "Ann Lee"])), ("blank.docx", docx([" "])), ("bad.docx", b"xx"), ("x.txt", b"text"), ("y.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(content)
    rows = {x.path.rsplit("/", 1)[-1]: x for x in files.read_files(spark, str(tmp_path)).collect()}
    good = rows["My.Letter.DOCX"]
    assert (good.title, good.text, good.kind, good.status, good.error, good.char_count) == ("Uploaded: My.Letter", "Hello\n\nAnn Lee", "docx", "pending_review", None, 14)
    assert all(rows[n].error and rows[n].text is None and rows[n].status is None for n in rows if n != "My.Letter.DOCX")
    assert "Unsupported" in rows["x.txt"].error
    assert "empty" in files.ingest(spark.createDataFrame([("/a/e.docx", b"")], "path string, content binary")).head().error


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    tables.append(old, path)
    tables.append(spark.createDataFrame([(2, "b", "x")], "doc_id long, text string, title string"), path)
    rows = tables.read(spark, path, schemas.DOCUMENTS).orderBy("doc_id").collect()
    assert [(x.doc_id, x.title, x.status) for x in rows] == [(1, None, None), (2, "x", None)]
    assert tables.point(tables.read(spark, path), "doc_id", 2).head().text == "b" and tables.of_document(tables.read(spark, path), 9).count() == 0
    assert [x.is_demo for x in tables.list_documents(old).collect()] == [True]
    assert tables.new_rows(spark.createDataFrame([(1,), (3,)], "doc_id long"), old, ["doc_id"]).collect()[0].doc_id == 3
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5)], "doc_id long, start int, end int")
    assert [x.end for x in tables.overlapping(spans, 1, 4, 5).collect()] == [5]
    rest, gone = tables.cleared(spans, old)
    assert rest.count() == 1 and gone.head().deleted_count == 2
    assert {tuple(x) for x in tables.statistics(spans=spans, old=old).collect()} == {("spans", 3), ("old", 1)}
    tables.recreate(old, str(tmp_path / "u"))
    assert files.to_json_rows(old).head().json == '{"doc_id":1,"text":"a"}'
    files.write_texts(spark.createDataFrame([(1, "x\ny")], "doc_id long, content string"), str(tmp_path / "out"))
    assert next((tmp_path / "out" / "sanitized_document=1").glob("*.txt")).read_text() == "x\ny\n"


def test_stream_of_documents(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "Write to ann@lee.example."), (2, "nothing")], "doc_id long, text string")
    docs.write.parquet(source)
    for batch in range(2):
        q = pipeline.write(pipeline.detections(pipeline.documents(spark, source, docs.schema)), out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        spark.createDataFrame([(3, "Write to bob@ray.example.")], docs.schema).write.mode("append").parquet(source)
    rows = spark.read.parquet(out).where("kind = 'email' AND source = 'enhanced_regex'").orderBy("doc_id").collect()
    assert [(x.doc_id, x.text) for x in rows] == [(1, "ann@lee.example"), (3, "bob@ray.example")]


def test_stream_of_decisions(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "state")
    kind = "doc_id long, span_type string, span_id int, decision string, seq long, at timestamp"
    first = spark.sql("SELECT 1L doc_id, 'detector' span_type, 1 span_id, 'approve' decision, 1L seq, timestamp'2024-01-01' at")
    first.union(first).write.parquet(source)
    read = lambda: spark.readStream.schema(kind).parquet(source)
    pipeline.keep_latest(pipeline.decisions(read()), out, str(tmp_path / "cp")).awaitTermination(120)
    state = lambda: [(x.span_id, x.decision) for x in pipeline.state(spark, out, max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir() if p.name.startswith("batch="))).collect()]
    assert state() == [(1, "approve")]
    first.select("doc_id", "span_type", "span_id", F.lit("reject").alias("decision"), F.lit(2).cast("long").alias("seq"), F.expr("timestamp'2024-01-01 00:10:00'").alias("at")).write.mode("append").parquet(source)
    pipeline.keep_latest(pipeline.decisions(read()), out, str(tmp_path / "cp")).awaitTermination(120)
    assert state() == [(1, "reject")]
    assert [(x.span_id, x.decision) for x in pipeline.state(spark, out, 0).collect()] == [(1, "approve")]
    pipeline.compact(spark, out, str(tmp_path / "log"))
    assert [(x.span_id, x.decision) for x in pipeline.state(spark, str(tmp_path / "log")).collect()] == [(1, "reject")]


def test_rows_as_json_and_back(spark):
    df = spark.createDataFrame([(1, 'é "x"', ["a", None], {"k": "v"}), (2, None, None, None)], "doc_id long, text string, sources array<string>, mapping map<string, string>")
    assert files.from_json_rows(files.to_json_rows(df), df.schema).orderBy("doc_id").collect() == df.orderBy("doc_id").collect()
