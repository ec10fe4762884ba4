"""What the corpus operators share: shared-folder tables, links to components, word hashes."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a worker holds of its input at a time: rows, and bytes where Spark can tell.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
#: Environment of Python workers: what a task has freed goes back to the machine, as workers are used again for other tasks.
FRUGAL = {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}
REPO_ROOT = str(Path(__file__).resolve().parents[2])


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings; the caller's own come back at the end."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the place the driver has it, be frugal with memory, and get texts in small batches.

    A cluster that ships the package with ``--py-files`` is not affected: the path is only appended.
    """
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, REPO_ROOT])
    for name, value in FRUGAL.items():
        env.setdefault(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; on a single machine else one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "nestq-shared")
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/nestq-{label}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table or folder written with ``cut``/``scratch``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back(spark: SparkSession) -> None:
    """Collect the driver's garbage and return what its JVM and this process have freed to the machine.

    Broadcasts and plans of ended queries stay with the driver until its garbage is collected. Memory that its compiler, codecs and network
    have freed stays in the many arenas of the C library, and adds up from query to query, until these are trimmed; a JVM that has no such command is left as it is.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    try:
        named = jvm.java.lang.Class.forName
        kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class is closed to reflection, its interface is not
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Exception:  # noqa: BLE001  by Java's kind and version
        pass


#: Whether Spark deletes the shuffle files of a query as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Kept:
    """A DataFrame read back from a table in the shared folder, and that table's path.

    Once it is written, the shuffle files that led to it are of no more use, so they are deleted.
    """

    def __init__(self, spark: SparkSession, df: DataFrame, label: str):
        self.spark, self.path = spark, scratch(spark, label)
        with settings(spark, {CLEAN_UP: "true"}):
            df.write.parquet(self.path)
        give_back(spark)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def forget(self) -> None:
        forget(self.spark, self.path)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, so a lost executor costs no recomputation."""
    return Kept(df.sparkSession, df, label).df


def components(nodes_edges: DataFrame, a: str = "a", b: str = "b") -> Kept:
    """Connected components of the undirected edges (``a``, ``b``: long).

    Returns ``(node, component)`` for every node that has an edge to another node; ``component`` is
    the smallest node id that can be reached. Null ends and self loops are ignored.

    Each round every node points at the least of itself and its neighbours in a pseudo-random
    order, and the graph is contracted along these pointers; the random order makes the number of
    rounds logarithmic even on long chains. Pointers are minima, so hubs are combined before the
    shuffle; tables are cut each round, so the joins are between plain exchanges and AQE can
    split the hub's partition.
    """
    spark = nodes_edges.sparkSession
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("id"))
    edges = Kept(
        spark,
        nodes_edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct(),
        "edges",
    )
    labels: Kept | None = None
    while True:
        both = edges.df.union(edges.df.select("y", "x").toDF("x", "y"))
        best = both.groupBy("x").agg(F.min(key(F.col("y"))).alias("m"))
        hop = Kept(spark, best.select(F.col("x").alias("node"), F.least(key(F.col("x")), F.col("m"))["id"].alias("to")), "hop")
        if labels is None:
            fresh = Kept(spark, hop.df.select("node", F.col("to").alias("root")), "roots")
        else:
            moved = labels.df.join(hop.df.toDF("root", "to"), "root", "left")
            fresh = Kept(spark, moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
            labels.forget()
        labels = fresh
        left = edges.df.join(hop.df.toDF("x", "to_x"), "x").select("to_x", "y")
        onto = left.join(hop.df.toDF("y", "to_y"), "y").where("to_x <> to_y")
        less = Kept(spark, onto.select(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y")).distinct(), "edges")
        edges.forget()
        edges = less
        done = edges.df.isEmpty()
        hop.forget()
        if done:
            break
    edges.forget()
    least = cut(labels.df.groupBy("root").agg(F.min("node").alias("component")), "least")
    out = Kept(spark, labels.df.join(least, "root").select("node", "component"), "components")
    labels.forget()
    return out


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.array([xxhash.xxh3_64_intdigest(b"multiplier", seed * 1000 + i) | 1 for i in range(n)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out, factor = np.ones(1, np.uint64), base
    while len(out) < n:
        out, factor = np.concatenate([out, out * np.uint64(factor)]), factor * factor % (1 << 64)
    return out[:n]


#: ASCII white space, as a pattern and as flags of bytes.
BLANK = re.compile(rb"[\x20\x09-\x0D]")
IS_BLANK = bytes(bool(BLANK.match(bytes([i]))) for i in range(256))
#: Bytes of a text that are looked at together, and from what length on a word is hashed by itself.
HASHED, LONG_WORD = 1 << 16, 256
#: A value for each byte, A-Z as a-z; powers of an odd number and of its inverse.
BYTE_VALUES = np.array([xxhash.xxh3_64_intdigest(bytes([i]).lower(), 78) for i in range(256)], np.uint64)
POWERS, INVERSE_POWERS = (_powers(x, HASHED + LONG_WORD + 1) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, in order: runs of anything but ASCII white space, A-Z lower-cased.

    A word's hash is a polynomial in its bytes' values, a difference of prefix sums that is moved back to the word's beginning, so all words are hashed at once.
    """
    out = [np.empty(0, np.uint64)]
    for at in range(0, len(text), HASHED):  # each time the words that begin in these bytes
        before, piece = text[at - 1 : at] or b" ", text[at : at + HASHED + LONG_WORD + 1]
        blank = np.frombuffer((before + piece + b" ").translate(IS_BLANK), bool)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        if not blank[0]:  # the end of a word that began earlier
            edges = edges[1:]
        begin, end = edges[::2], edges[1::2]
        own = np.searchsorted(begin, HASHED)
        begin, end = begin[:own], end[:own]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE_VALUES.take(np.frombuffer(piece, np.uint8)) * POWERS[: len(piece)], out=sums[1:])
        h = mixed((sums[end] - sums[begin]) * INVERSE_POWERS[begin])
        for k in np.flatnonzero(end - begin > LONG_WORD).tolist():
            first = at + int(begin[k])
            last = BLANK.search(text, first)
            h[k] = xxhash.xxh3_64_intdigest(text[first : last.start() if last else len(text)].lower(), 79)
        out.append(h)
    return np.concatenate(out)
