"""What the corpus operators share: tables in the cluster's shared folder, Arrow maps and vectorised word hashing.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D). All hashing works on the UTF-8 bytes of whole texts, a few
megabytes at a time, so that memory doesn't follow the length of a text or of a batch.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SPACES = b" \t\n\x0b\f\r"
#: Java and DuckDB regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that are hashed at once.
CHUNK = 1 << 20
#: Rows of a table of ids (16 bytes each, so 16 MB at most) up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[list(SPACES)] = 0
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(255, _STEP)]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local folder if unset on a local master."""
    conf = spark.sparkContext.getConf()
    if where := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillmask/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system and path of a folder in the shared store."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1) if "://" in folder else f"file://{os.path.abspath(folder)}")


def _writer(folder: str, fn: Callable | None):
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        name, rows, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet", 0, None
        for b in fn(it) if fn else it:
            if b.num_rows:
                out = out or pq.ParquetWriter(f"{path}/{name}", b.schema, filesystem=store)
                out.write_batch(b)
                rows += b.num_rows
        if out:
            out.close()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([name if out else None], pa.string()), pa.array([rows], pa.int64())], names=["file", "n"])

    return write


def _published(spark: SparkSession, folder: str, kind: StructType, files: set[str]) -> DataFrame:
    """The table of just these files of a folder. What lost attempts left there is removed; what they write later was not listed."""
    store, path = store_of(folder)
    for _ in range(5):
        out = spark.read.schema(kind).parquet(folder)
        if {os.path.basename(f) for f in out.inputFiles()} == files:
            return out
        for f in store.get_file_info(fs.FileSelector(path)):
            if f.base_name not in files:
                store.delete_file(f.path)
    raise RuntimeError(f"{folder} does not hold the files that were written")


def materialise(df: DataFrame, label: str, fn: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Writes df, or what mapInArrow(fn, schema) makes of it, to the shared folder and reads it back.

    Later steps neither recompute it nor depend on executors' disks. Each attempt of a task writes a file under a name of its own and
    reports it when it is complete; only the files that successful tasks report are read, so there is nothing to rename, and lost,
    repeated and late attempts do no harm. The report is one row a task.
    """
    spark = df.sparkSession
    at_workers(spark)
    folder = shared_path(spark, label)
    try:
        store, path = store_of(folder)
    except (pa.ArrowException, OSError):  # a store that pyarrow doesn't know: Spark writes, through JVM tasks
        out = df.mapInArrow(fn, schema) if fn else df
        out.write.parquet(folder)
        return spark.read.schema(out.schema).parquet(folder)
    store.create_dir(path, recursive=True)
    _remove_at_exit(folder.rsplit("/", 1)[0])
    done = df.mapInArrow(_writer(folder, fn), "file string, n bigint").collect()
    kind, files = spark.createDataFrame([], schema).schema if schema else df.schema, {r["file"] for r in done if r["file"]}
    out = _published(spark, folder, kind, files) if files else spark.createDataFrame([], kind)
    out.known_rows, out.folder, out.files = sum(r["n"] for r in done), folder, sorted(files)
    return out


@lru_cache(64)
def _remove_at_exit(folder: str) -> None:
    """The application's tables go when its driver ends."""
    atexit.register(_remove, *store_of(folder))


def _remove(store: fs.FileSystem, path: str) -> None:
    try:
        store.delete_dir(path)
    except OSError:  # gone already
        pass


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again."""
    for t in tables:
        if folder := getattr(t, "folder", None):
            _remove(*store_of(folder))


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder by Spark's own writer and read back; no Python worker takes part."""
    folder = shared_path(df.sparkSession, label)
    df.write.parquet(folder)
    try:
        _remove_at_exit(folder.rsplit("/", 1)[0])
    except (pa.ArrowException, OSError):  # a store that pyarrow doesn't know keeps its tables
        pass
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks. Its lineage stays: what a lost executor held is computed again.

    For what is used several times within a query. Where lineage must be cut, or must not run again, materialise() writes a table.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers can import this package from where the driver has it."""
    at_workers(df.sparkSession)
    return df.mapInArrow(fn, schema)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """df, with its columns computed once at this place: what refers to them later isn't merged into the expressions behind them.

    The optimiser doesn't push filters, or merge projections, through a generator. Without this, long expressions that are referred to
    several times multiply from step to step.
    """
    names = columns or df.columns
    return df.select(F.explode(F.array(F.struct(*names))).alias("__row")).select("__row.*")


def at_workers(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env.get('PYTHONPATH', '')}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df, marked for broadcast only if it was counted and found to have few rows and, by `size`, the bytes of a row in columns of any length, few bytes.

    For narrow tables that are kept or written; others go into an ordinary join.
    """
    known = getattr(df, "known_rows", None)
    if (df.limit(rows + 1).count() if known is None else known) > rows:
        return df
    if size is not None and (df.agg(F.sum(size)).head()[0] or 0) > 16 * BROADCAST_ROWS:
        return df
    return F.broadcast(df)


def give_back() -> None:
    """At a task's end: memory that this worker has freed goes back to the system. Idle workers live on, and would hold it beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def empty(df: DataFrame) -> bool:
    known = getattr(df, "known_rows", None)
    return not (df.limit(1).count() if known is None else known)


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row and the n + 1 places where they begin and end; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(arr) + 1 + arr.offset)[arr.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(n: int) -> np.ndarray:
    """Powers of the word hash's base, for words of up to n bytes."""
    global _PLACES
    if n > len(_PLACES):
        _PLACES = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _STEP)]))
    return _PLACES


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts data[bounds[i]:bounds[i + 1]]: a 64-bit hash of each word, each word's first byte, and the n + 1 places in these where texts begin and end."""
    hashes, firsts, size, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], len(data), 0
    inner = bounds[1:-1]
    while at < size:
        end = min(at + CHUNK, size)
        while end < size:  # to the end of a word
            tail = np.flatnonzero(~_IS_WORD[data[end : end + CHUNK]])
            if len(tail):
                end += int(tail[0])
                break
            end = min(end + CHUNK, size)
        part = data[at:end]
        word = _IS_WORD[part]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cut = inner[np.searchsorted(inner, at) : np.searchsorted(inner, end)] - at
        begins[cut] |= word[cut]
        first = np.flatnonzero(begins)
        if len(first):
            lengths = np.diff(np.append(first, len(part)))
            where = np.arange(int(first[0]), len(part)) - np.repeat(first, lengths)
            values = _BYTES[LOWER[part] if lower else part][int(first[0]) :]
            spots = int(where.max()) + 1
            # white space counts 0, so its place doesn't matter; places are bounded by the longest word and its white space
            hashes.append(mix(np.add.reduceat(values * places(spots)[where], first - first[0])))
            firsts.append(first + at)
        at = end
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.searchsorted(first, bounds)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pieces(it: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about `most` bytes of text, or one row."""
    for b in it:
        if not b.num_rows:
            continue
        _, bounds = utf8(b.column(text))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
