"""Near duplicates among embeddings by random-hyperplane sign hashing.

Equal vectors are one class. Classes are hashed into several tables of sign patterns; within a
bucket all pairs are verified by exact cosine in double precision, a block against a block at a time. A pair that shares
several buckets counts in the first one only. Each block sends on link counts and a spanning
forest, never its pairs; components of the forests are found in Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestq.llm.common import components, cut, ready

MIN_COSINE = 0.95
#: Share of pairs at exactly the least cosine that may be missed.
MISS = 0.002
#: Aimed number of classes in a bucket when directions are even, and the largest block of a bucket.
BUCKET, BLOCK = 48, 1024
SEED = 20_24


def tables_for(n: int, min_cosine: float = MIN_COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits grow with the logarithm of ``n``, tables follow from the share that may be missed."""
    bits = min(30, max(4, math.ceil(math.log2(max(2, n / BUCKET)))))
    hit = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-hit)))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def _signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) of bit patterns."""
    signs = (x @ planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _width(vectors: DataFrame, vector_column: str) -> int:
    """Bytes of a stored component: what the column's type needs."""
    return 4 if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else 8


def classes_of(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, key, vec): key is a 128-bit hash of the components, null when the vector can't be compared."""
    dtype = f"<f{_width(vectors, vector_column)}"

    def run(batches):
        for b in batches:
            keys, raws = [], []
            for v in b.column(1).to_pylist():
                key = raw = None
                if v and None not in v:
                    x = np.array(v, np.float64) + 0.0  # -0.0 is 0.0
                    if np.isfinite(x).all() and x.any():
                        raw = x.astype(dtype).tobytes()
                        key = xxhash.xxh3_128_digest(raw)
                keys.append(key)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "key", "vec"])

    return vectors.select(id_column, vector_column).mapInArrow(run, "vec_id long, key binary, vec binary")


def _unit(vecs: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), f"<f{width}").astype(np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow, no underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _linked(keys, reps, sizes, vecs, sigs, width: int, table: int, block, lo: int, hi: int, min_cosine: float):
    """Rows (key, rep, n, root) of one block pair: n other vectors linked for the first time here, root of the local tree."""
    x = _unit(vecs, width)
    block = np.array(block)
    a, b = (np.flatnonzero(block == lo), np.flatnonzero(block == hi)) if lo != hi else (np.arange(len(x)),) * 2
    if not len(a) or not len(b):
        return
    i, j = np.nonzero(x[a] @ x[b].T >= min_cosine)
    i, j = a[i], b[j]
    if lo == hi:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return
    s = np.frombuffer(b"".join(sigs), np.int64).reshape(len(x), -1)
    first = ~(s[i, :table] == s[j, :table]).any(1)
    size, n = np.array(sizes, np.int64), np.zeros(len(x), np.int64)
    np.add.at(n, i[first], size[j[first]])
    np.add.at(n, j[first], size[i[first]])
    rep = np.array(reps, np.int64)
    order = np.argsort(rep, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    root = rank.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[order[root]]  # the root's own root
        if (root == before).all():
            break
    for k in np.unique(np.concatenate([i, j])):
        yield keys[k], int(rep[k]), int(n[k]), int(rep[order[root[k]]])


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, miss: float = MISS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    n_links: other vectors found with a cosine of at least ``min_cosine``. component_id: the
    smallest id that links reach. kept: whether that is the vector's own. Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing; vectors of different length are not
    compared. Rows that repeat an id are one node, and count as vectors of their own in
    n_links. A row with a null id has no component, is in nobody's links and is kept. Further columns are ignored; an empty table gives
    an empty result. The hashing finds all but a share ``miss`` of the pairs at exactly
    ``min_cosine``, and more of those above.
    """
    spark = ready(vectors.sparkSession)
    width = _width(vectors, vector_column)
    rows = cut(classes_of(vectors, id_column, vector_column), "vectors")
    real = rows.where("vec_id is not null and key is not null")
    grouped = real.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vec").alias("vec"))
    total = real.agg(F.approx_count_distinct("key")).first()[0]
    bits, tables = tables_for(total, min_cosine, miss)

    def hashed(batches):
        for b in batches:
            raws, out = b.column("vec").to_pylist(), [b""] * b.num_rows
            by_dim: dict[int, list[int]] = {}
            for i, r in enumerate(raws):
                by_dim.setdefault(len(r), []).append(i)
            for own in by_dim.values():
                for i, s in zip(own, _signatures(_unit([raws[i] for i in own], width), bits, tables), strict=True):
                    out[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "sigs"])

    known = cut(grouped.mapInArrow(hashed, "key binary, rep long, size long, vec binary, sigs binary"), "signatures")

    def spread(batches):
        for b in batches:
            s = np.frombuffer(b"".join(b.column("sigs").to_pylist()), np.int64).reshape(b.num_rows, -1)
            dims = np.fromiter(map(len, b.column("vec").to_pylist()), np.int64, b.num_rows) // width
            keys = b.column("key").to_pylist()
            for t in range(s.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(dims), pa.array(np.full(len(s), t)), pa.array(s[:, t])], ["key", "dim", "tab", "sig"])

    at = ["dim", "tab", "sig"]
    placed = cut(known.select("key", "vec", "sigs").mapInArrow(spread, "key binary, dim long, tab long, sig long"), "buckets")
    full = cut(placed.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket_sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = placed.join(full, at).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", *at, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    met = dealt.join(known, "key")
    unit = [*at, "lo", "hi"]
    met = met.repartition(*unit).sortWithinPartitions(*unit)

    def verify(batches):
        now, held, out = None, [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["key", "rep", "n", "root"])

        def settle():
            if now is not None and len(held) > 1:
                keys, reps, sizes, vecs, sigs, block = zip(*held, strict=True)
                out.extend(_linked(keys, reps, sizes, vecs, sigs, width, now[1], block, now[3], now[4], min_cosine))

        for b in batches:
            cols = [b.column(c).to_pylist() for c in (*unit, "key", "rep", "size", "vec", "sigs", "block")]
            for row in zip(*cols, strict=True):
                if row[:5] != now:
                    settle()
                    now, held = row[:5], []
                    if len(out) >= 20_000:
                        yield batch()
                        out.clear()
                held.append(row[5:])
        settle()
        yield batch()

    found = cut(met.mapInArrow(verify, "key binary, rep long, n long, root long"), "links")
    group = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    sized = cut(known.select("key", "rep", "size").join(links, "key", "left").join(group.df.toDF("rep", "component"), "rep", "left"), "classes")
    # a copy of an invalid or unnumbered vector has no class; its key would send all of them to one task
    known_rows = real.select("vec_id", "key").join(sized, "key")
    self_id = F.col("vec_id")
    result = known_rows.select(self_id, (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    other = rows.where("vec_id is null or key is null").select(self_id, F.lit(0).cast("long").alias("n_links"), self_id.alias("component_id"))
    return result.unionByName(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
