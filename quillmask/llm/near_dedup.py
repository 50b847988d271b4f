"""Near-duplicate documents by b-bit MinHash.

Plan: (1) one scan hashes words, shingles and MinHash minima (vectorised, Arrow) and keeps per text the band keys, the low two bits of
each minimum and a digest of its shingle set; (2) equal sets collapse to one representative; (3) band buckets give candidates as stars
round a hub, never all pairs; (4) candidates whose collision-corrected estimate is far below the threshold go; (5) the others are
confirmed on their full shingle sets, recomputed from texts that are sent once for each hub and salt; (6) buckets that still hold more
than one component get a second hub, the member nearest to the bucket's consensus signature; (7) what then still differs within a
bucket is compared exhaustively, in pairs of blocks, on signatures and then on full sets within the task, which returns links only. So each pair that shares a band is either linked
through others or compared: nothing is capped.

Bands are as long as lets a pair at the threshold share none with a probability of at most 1e-6 (32 of 6 minima at 0.85, 38 of 5 at
0.8); its estimate falls under the cut with about as much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import at_workers, batch, empty, materialise, mix, pieces, small, utf8, word_hashes
from quillmask.llm.components import components

SHINGLE, MINIMA = 5, 192
#: Probability that a pair at the threshold may share no band.
MISSED = 1e-6
LANES = MINIMA // 64  # longs of each bit plane
#: Rows of a block in the exhaustive comparison, and members that one task confirms against one hub.
BLOCK, SALT = 1024, 256
#: Shingles that a block holds at most, on average.
BLOCK_SHINGLES = 1_000_000
#: Standard deviations that the estimate may fall short of the threshold.
MARGIN = 5.0

_rng = np.random.default_rng(1908)
_COEFF = _rng.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = (_rng.integers(0, 1 << 31, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]
_SEEDS = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_sets(text: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; a text of 1 to 4 words has one, the whole sequence."""
    data, bounds = utf8(text)
    h, _, at = word_hashes(data, bounds, lower=True)
    n = len(h) - SHINGLE + 1
    every = np.zeros(0, np.uint64)
    if n > 0:
        every = h[:n] * _COEFF[0]
        for k in range(1, SHINGLE):
            every += h[k : n + k] * _COEFF[k]
        every = mix(every)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= SHINGLE:
            yield np.unique(every[lo : hi - SHINGLE + 1])
        elif hi > lo:
            yield mix((h[lo:hi] * _COEFF[: hi - lo]).sum(keepdims=True) + _COEFF[SHINGLE:] * np.uint64(hi - lo))
        else:
            yield every[:0]


def minima(s: np.ndarray) -> np.ndarray:
    """The MinHash minima of a set, 2048 elements at a time."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = (x[None, :2048] * _MUL + _ADD).min(axis=1)
    for at in range(2048, len(x), 2048):
        np.minimum(out, (x[None, at : at + 2048] * _MUL + _ADD).min(axis=1), out=out)
    return out


def banding(threshold: float) -> tuple[int, int]:
    """Bands and minima of each."""
    for rows in range(12, 0, -1):
        if (1 - threshold**rows) ** (MINIMA // rows) <= MISSED:
            return MINIMA // rows, rows
    return MINIMA, 1


def _signatures(bands: int, rows: int):
    return lambda it: _sign(it, bands, rows)


def _sign(it: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    lanes = np.uint64(1) << (np.arange(64, dtype=np.uint64))
    band = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for b in pieces(it, 2):
        sizes, d1, d2, mins = [], [], [], []
        for s in shingle_sets(b.column(2)):
            sizes.append(len(s))
            d1.append(s.sum(dtype=np.uint64))
            d2.append(mix(s + np.uint64(77)).sum(dtype=np.uint64) if len(s) else np.uint64(0))
            mins.append(minima(s) if len(s) else np.zeros(MINIMA, np.uint32))
        low = mix(np.array(mins).astype(np.uint64) + _SEEDS)
        planes = [((low >> np.uint64(p)) & np.uint64(1)).reshape(-1, LANES, 64) @ lanes for p in (0, 1)]
        keys = np.zeros((len(mins), bands), np.uint64) + band
        for r in range(rows):
            keys = mix(keys + np.array(mins)[:, r : bands * rows : rows].astype(np.uint64))
        lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(x.view(np.int64).ravel()))
        yield batch(schema, b.column(0), b.column(1), sizes, np.array(d1, np.uint64).view(np.int64), np.array(d2, np.uint64).view(np.int64), lists(np.hstack(planes), 2 * LANES), lists(keys, bands))


def estimate(a: str, b: str) -> Column:
    """Jaccard similarity from two 2-bit signatures: the share of equal lanes, less the quarter that agree by chance."""
    differ = F.lit(0)
    for i in range(LANES):
        differ = differ + F.bit_count((F.col(a)[i].bitwiseXOR(F.col(b)[i])).bitwiseOR(F.col(a)[i + LANES].bitwiseXOR(F.col(b)[i + LANES])))
    return (1 - differ / F.lit(float(MINIMA)) - 0.25) / 0.75


def cut(threshold: float) -> float:
    agree = 0.25 + 0.75 * threshold
    return threshold - MARGIN * (agree * (1 - agree) / MINIMA) ** 0.5 / 0.75


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x & y| >= percent * |x | y|, for sorted sets."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    if len(x) * 100 < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    """Batches of (hub, salt, role, id, text), sorted, the hub's own text first -> confirmed links."""

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        hub, own = None, None
        for b in pieces(it, 4):
            a, role, ids = (b.column(i).to_pylist() for i in (0, 2, 3))
            links = []
            for h, r, i, s in zip(a, role, ids, shingle_sets(b.column(4))):
                if r == 0:
                    hub, own = h, s
                elif hub == h and own is not None:
                    if similar(own, s, percent):
                        links.append((h, i))
            if links:
                yield batch(schema, *map(list, zip(*links)))

    return fn


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, label: str) -> DataFrame:
    """Those pairs(a, b) whose full shingle sets are similar enough. docs(key, text); rows of one key are equal."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), f"{label}-ids")
    texts = materialise(docs.join(small(ids), "key").dropDuplicates(["key"]).select("key", "text"), f"{label}-texts")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("key"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("key"))
    rows = members.unionByName(hubs).join(texts, "key").select("a", "salt", "role", "key", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role", "key"), f"{label}-links", _verify(percent), "a bigint, b bigint")


def _consensus(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, bits), sorted -> key, members, and how many of them have each signature bit, as int64 bytes; one row a key and part at least."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("ones", pa.binary())])
    for b in it:
        key, part = np.asarray(b.column(0)), np.asarray(b.column(1))
        bits = np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1)
        ones = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        sums = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
        yield batch(schema, key[first], np.diff(np.append(first, len(key))), [x.tobytes() for x in sums])


def _majority(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, ones), sorted by key -> key and the bits that more than half of its members have."""
    schema = pa.schema([("key", pa.int64()), ("middle", pa.list_(pa.int64()))])
    held, n, ones = None, 0, None

    def row():
        bits = np.packbits(2 * ones > n, bitorder="little").view(np.int64)
        return batch(schema, [held], [bits.tolist()])

    for b in it:
        for key, m, x in zip(*(c.to_pylist() for c in b.columns)):
            if key != held:
                if held is not None:
                    yield row()
                held, n, ones = key, 0, 0
            n, ones = n + m, ones + np.frombuffer(x, np.int64)
    if held is not None:
        yield row()


def _near_pairs(rows: list[dict], floor: float, percent: int) -> list[tuple[int, int]]:
    """Places of the pairs of two blocks of a bucket (or within one) that are of different components and whose estimate is high enough.

    A pair that shares several buckets is left to the one with the smallest key.
    """
    first = rows[0]
    get = lambda c, t=np.int64: np.array([r[c] for r in rows], dtype=t)
    ids, comp, size, bits, mine = get("id"), get("component"), get("n_shingles"), get("bits").view(np.uint64), get("block")
    left, right = np.flatnonzero(mine == first["i"]), np.flatnonzero(mine == first["j"])
    keys = [frozenset(r["keys"]) for r in rows]
    pairs: list[tuple[int, int]] = []
    for x in left.tolist():
        y = right[ids[right] > ids[x]] if first["i"] == first["j"] else right
        y = y[(comp[y] != comp[x]) & (size[y] * 100 >= percent * size[x]) & (size[x] * 100 >= percent * size[y])]
        if len(y):
            d = bits[y] ^ bits[x]
            differ = np.bitwise_count(d[:, :LANES] | d[:, LANES:]).sum(axis=1, dtype=np.int64)
            pairs += [(x, z) for z in y[(1 - differ / MINIMA - 0.25) / 0.75 >= floor].tolist() if min(keys[x] & keys[z]) == first["key"]]
    return pairs


def _involved(rows: list[dict], floor: float, percent: int) -> Iterator[tuple[int, int]]:
    """(key, id) of the rows that have a near pair: two blocks at most, however many pairs."""
    return ((rows[0]["key"], rows[z]["id"]) for z in sorted({z for pair in _near_pairs(rows, floor, percent) for z in pair}))


def _compare(rows: list[dict], floor: float, percent: int) -> Iterator[tuple[int, int]]:
    """The near pairs that are links on full shingle sets, but for those whose components are joined by then."""
    pairs = _near_pairs(rows, floor, percent)
    needed = sorted({z for pair in pairs for z in pair})
    sets = dict(zip(needed, shingle_sets(pa.array([rows[z]["text"] for z in needed], pa.large_string())))) if needed else {}
    root = {r["component"]: r["component"] for r in rows}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for x, y in pairs:
        cx, cy = top(rows[x]["component"]), top(rows[y]["component"])
        if cx != cy and similar(sets[x], sets[y], percent):
            root[cx] = cy
            yield rows[x]["id"], rows[y]["id"]


def _blocks(find, floor: float, percent: int, names: tuple[str, str]):
    """Rows sorted by (key, i, j) -> what find() says of each two blocks of a bucket, which are held at a time."""

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in names])
        held: list[dict] = []
        name = lambda r: (r["key"], r["i"], r["j"])
        for b in it:
            out = []
            for r in b.to_pylist():
                if held and name(held[0]) != name(r):
                    out += find(held, floor, percent)
                    held = []
                held.append(r)
            if out:
                yield batch(schema, *map(list, zip(*out)))
        if held and (out := list(find(held, floor, percent))):
            yield batch(schema, *map(list, zip(*out)))

    return fn


def _met(rows: DataFrame, counts: DataFrame, *more: str) -> DataFrame:
    """rows(key, id, ...) dealt into the blocks of their key, every two blocks of a key together; counts(key, blocks)."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.join(counts, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n_shingles", "bits", "keys", *more)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")


def _exhaustive(open_: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between the members(key, id, component, n_shingles, bits) of each bucket that aren't of one component yet; docs(key, text).

    Signatures meet first, in pairs of blocks; only members that have a near pair then meet with their texts.
    """
    floor = cut(percent / 100)
    # buckets of the same members are compared once
    mark = F.xxhash64("id")
    same = open_.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
    counts = same.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = materialise(open_.join(counts.select("key"), "key", "left_semi").drop("part"), "dealt")
    keys = dealt.groupBy("id").agg(F.collect_list("key").alias("keys"))  # one a band at most
    dealt = materialise(dealt.join(keys, "id"), "dealt-keys")
    near = materialise(_met(dealt, counts), "block-near", _blocks(_involved, floor, percent, ("key", "id")), "key bigint, id bigint")
    if empty(near):
        return near.selectExpr("key AS a", "id AS b")
    rows = materialise(dealt.join(near.distinct(), ["key", "id"], "left_semi"), "block-rows")
    weight = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    counts = rows.groupBy("key").agg(F.ceil(weight).cast("int").alias("blocks"))
    ids = materialise(rows.select(F.col("id").alias("key")).distinct(), "block-ids")
    texts = docs.join(small(ids), "key").dropDuplicates(["key"]).select(F.col("key").alias("id"), "text")
    return materialise(_met(rows.join(texts, "id"), counts, "text"), "block-links", _blocks(_compare, floor, percent, ("a", "b")), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, one row for each row of docs.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| on their sets of distinct shingles of five lower-cased words (A-Z);
    a text of one to four words is one shingle, a null, empty or blank text has none and no links. component_id is the smallest doc_id
    reached; kept marks the rows with that doc_id. Rows go by doc_id and text: those that share a doc_id and have different texts are
    documents of their own, and so are rows without doc_id, whose component_id is null unless they are linked to a row that has one.
    Of a component without any doc_id one text is kept. An empty table gives an empty result; other columns of docs are ignored.
    """
    return _labelled(docs, percent).drop("key", "head")


def _key() -> Column:
    """What tells rows apart: rows of one key are equal in doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """near_duplicates() with each row's key, and `head`, the least key of its component."""
    at_workers(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key().alias("key"), F.col("text").cast("string").alias("text"))
    sig = materialise(docs, "signatures", _signatures(*banding(percent / 100)), "doc_id bigint, key bigint, n_shingles bigint, d1 bigint, d2 bigint, bits array<bigint>, bands array<bigint>")
    docs = docs.drop("doc_id")
    same = ["d1", "d2", "n_shingles"]
    sets = materialise(sig.where("n_shingles > 0").groupBy(*same).agg(F.min("key").alias("id"), F.min("doc_id").alias("least")), "sets")
    reps = sig.join(sets.select(F.col("id").alias("key"), *same), ["key", *same], "left_semi").dropDuplicates(["key"])
    reps = materialise(reps.select(F.col("key").alias("id"), "n_shingles", "bits", "bands"), "representatives")
    bits = reps.select("id", "n_shingles", "bits")
    rows = reps.select("id", F.explode("bands").alias("key"))
    buckets = materialise(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub"), F.max("id").alias("last")).where("n > 1"), "buckets")
    large = buckets.where("n > 2").select("key", "hub")
    crowd = materialise(rows.join(large, "key"), "crowd")
    floor = cut(percent / 100)

    def promising(pairs: DataFrame) -> DataFrame:
        a, b = bits.toDF("a", "size_a", "bits_a"), bits.toDF("b", "size_b", "bits_b")
        both = pairs.distinct().join(a, "a").join(b, "b").where(f"size_a * 100 >= size_b * {percent} AND size_b * 100 >= size_a * {percent}")
        return both.where(estimate("bits_a", "bits_b") >= floor).select("a", "b")

    stars = buckets.where("n = 2").select(F.col("hub").alias("a"), F.col("last").alias("b")).union(crowd.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    tried = materialise(promising(stars), "pairs-1")
    links = confirm(tried, docs, percent, "star-1")
    found = components(links)

    def unsettled() -> DataFrame:
        """The buckets' members where a bucket still has more than one component, each in a part of its bucket of about BLOCK members."""
        own = crowd.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        own = materialise(own, "labelled")
        keys = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("lo <> hi").select("key", "parts")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        return materialise(own.join(keys, "key").withColumn("part", part).drop("parts").join(bits, "id"), "unsettled")

    open_ = unsettled()
    if not empty(open_):
        # members come sorted by key and part, so a task adds up one part of a bucket after the other
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = open_.select("key", "part", "bits").repartition(n, "key", "part").sortWithinPartitions("key", "part")
        parts = materialise(parts, "consensus-parts", _consensus, "key bigint, n bigint, ones binary")
        middle = parts.repartition(n, "key").sortWithinPartitions("key")
        middle = materialise(middle, "consensus", _majority, "key bigint, middle array<bigint>")
        # what a bucket's members are held against goes to each of its parts
        spots = materialise(open_.select("key", "part").distinct(), "parts")
        nearest = open_.join(middle.join(spots, "key"), ["key", "part"]).groupBy("key", "part").agg(F.max_by(F.struct("id", "component"), F.struct(estimate("bits", "middle").alias("e"), -F.col("id"))).alias("hub"), F.max(F.struct(estimate("bits", "middle").alias("e"), -F.col("id"))).alias("e"))
        nearest = materialise(nearest, "nearest").groupBy("key").agg(F.max_by("hub", "e").alias("hub"))
        # the component of the hub needs no second look at its own members
        second = open_.join(nearest.join(spots, "key"), ["key", "part"]).where("component <> hub.component").select(F.col("hub.id").alias("x"), F.col("id").alias("y"))
        second = second.select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("g"), "x", "y").dropDuplicates(["l", "g"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
        seen = tried.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("g"))
        fresh = second.withColumns({"l": F.least("a", "b"), "g": F.greatest("a", "b")}).join(seen, ["l", "g"], "left_anti").select("a", "b")
        more = materialise(promising(fresh), "pairs-2")
        links = links.union(confirm(more, docs, percent, "star-2"))
        found = components(links)
        last = _exhaustive(unsettled(), docs, percent)
        if not empty(last):
            found = components(links.union(last))

    linked = materialise(found.join(sets.select("id", "least"), "id"), "linked")
    tops = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(tops, "component").select("id", F.col("component").alias("head"), "component_id")
    named = sets.join(linked, "id", "left").select(*same, F.coalesce("head", "id").alias("head"), F.when(F.col("head").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = sig.select("doc_id", "key", *same).join(named, same, "left")
    alone = F.col("n_shingles") == 0
    out = out.withColumns({"component_id": F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")), "head": F.when(alone, F.col("key")).otherwise(F.col("head"))})
    kept = F.when(F.col("component_id").isNull(), F.col("key") == F.col("head")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "key", "head")


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs without near-duplicates: one row of each component stays, with all columns of docs.

    It is one with the component's smallest doc_id; of rows that are equal in doc_id and text any one. Names that begin with two
    underscores are reserved.
    """
    chosen = materialise(_labelled(docs, percent).where("kept").groupBy("head").agg(F.min("key").alias("__key"), F.count("*").alias("copies")), "kept")
    rows = docs.withColumn("__own", _key()).join(small(chosen.select("__key")), F.col("__own") == F.col("__key"), "left_semi")
    if chosen.where("copies > 1").limit(1).count():
        # a copy of a kept row can only be where a component has more than one
        many = small(chosen.where("copies > 1").select("__key"))
        once = rows.join(many, F.col("__own") == F.col("__key"), "left_semi").dropDuplicates(["__own"])
        rows = rows.join(many, F.col("__own") == F.col("__key"), "left_anti").unionByName(once)
    return rows.select(docs.columns)
