import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmask.llm import common


def test_written_tables(spark, monkeypatch):
    df = spark.range(100).withColumn("t", F.concat(F.lit("é"), F.col("id").cast("string")))
    want = sorted(map(tuple, df.collect()))
    out = common.materialise(df, "t")
    assert sorted(map(tuple, out.collect())) == want and out.known_rows == 100 and not common.empty(out)
    none = common.materialise(df.where("id < 0"), "t")
    assert none.count() == 0 and common.empty(none) and none.dtypes == df.dtypes

    def unknown(folder):
        raise pa.ArrowInvalid("Unrecognized filesystem")

    monkeypatch.setattr(common, "store_of", unknown)
    out = common.materialise(df, "t")
    assert sorted(map(tuple, out.collect())) == want and not common.empty(out)


def test_only_reported_files_are_read(spark):
    out = common.materialise(spark.range(10), "t")
    assert len(out.files) >= 1 and {f.rsplit("/", 1)[-1] for f in out.inputFiles()} == set(out.files)
    store, path = common.store_of(out.folder)
    store.copy_file(f"{path}/{out.files[0]}", f"{path}/part-000000-late.parquet")
    assert out.count() == 10 and common._published(spark, out.folder, out.schema, set(out.files)).count() == 10
    assert "part-000000-late.parquet" not in {f.base_name for f in store.get_file_info(common.fs.FileSelector(path))}
    common.discard(out)
    assert store.get_file_info(path).type == common.fs.FileType.NotFound


def test_places_of_stores():
    assert common.store_of("file:///tmp/x")[1] == "/tmp/x" and common.store_of("/tmp/x")[1] == "/tmp/x"


def test_word_hashes_over_chunks(monkeypatch):
    texts = ["a bb\tccc", "", None, " x ", "ab cd ef " * 50, "a"]
    data, bounds = common.utf8(pa.array(texts, pa.string()))
    whole = common.word_hashes(data, bounds, lower=True)
    monkeypatch.setattr(common, "CHUNK", 7)
    parts = common.word_hashes(data, bounds, lower=True)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert np.diff(whole[2]).tolist() == [3, 0, 0, 1, 150, 1] and whole[0][0] == whole[0][-1]


def test_freed_memory_goes_back():
    """What a worker has freed isn't held by its allocator until the worker ends."""

    def held():
        return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    rows = [np.ones(4096) for _ in range(6000)]
    pin = rows[-1].copy()  # the heap's end stays in use
    del rows
    before = held()
    common.give_back()
    assert held() < before - 100 and len(pin)
