"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles. All sets are sorted by one global order, the
least frequent shingles first as far as a count sketch over all documents can tell. Two sets that are similar enough
share l tokens among the prefixes that are l - 1 tokens longer than the classical one. Each document
picks its l by what the sketch says its prefix would cost: where the prefix holds frequent
tokens, a longer prefix that must match several times verifies less.

Candidates are verified on whole sets. As the join serves classes and components, equal sets are
one class from the start, and no pair is looked at whose ends are known to be connected: rounds in which every class
is compared with one pivot first connect what is plainly alike, in time linear in the index;
then all remaining pairs between different components are enumerated and verified.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestq.llm.common import Kept, components, mixed, odd_constants, ready, word_hashes

SHINGLE = 5
#: Similarity as a fraction: |A n B| * DEN >= |A u B| * NUM.
NUM, DEN = 75, 100
#: Cells of the count sketch (32 bits each, saturating), and the rows they are sent in.
CELLS, SLICES = 1 << 22, 64
#: Longest multi-match, and what one more prefix token costs as against one candidate.
MOST_MATCHES, TOKEN_COST = 4, 4.0
#: Tokens that the sketch puts above this count are dealt to so many more tasks.
HOT = 4096
#: Bits of the filter through which sets are fetched.
FILTER_BITS = 1 << 25
#: Where a posting's position and its set's size begin among the bits of ``at``.
POS_AT, SIZE_AT = 3, 33
#: Bits of a set's parities (a multiple of 64).
PARITIES = 256
#: Pivots of a token in a round; rounds go on while more than this share of the pairs they try are links.
PIVOTS, PROGRESS = 96, 0.25


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than n are one shingle, no words none."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    h = word_hashes(raw)
    if not len(h):
        return h
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(raw.lower().split()), 77)], np.uint64)
    c = odd_constants(n, 1)
    total = h[: len(h) - n + 1] * c[0]
    for k in range(1, n):
        total += h[k : len(h) - n + 1 + k] * c[k]
    found = np.sort(mixed(total))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def _fingerprint(tokens: np.ndarray) -> bytes | None:
    """A 128-bit hash of a set; none of an empty one."""
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _parities(tokens: np.ndarray) -> list[int]:
    """PARITIES bits, each the parity of the number of tokens that are dealt to it: bits in which two sets differ tell at least as many tokens."""
    odd = np.bincount((tokens >> np.uint64(40) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def least_overlap(n: int, num: int = NUM, den: int = DEN) -> int:
    """Tokens that a set of n shares with any set that is similar enough."""
    return -(-n * num // den)


def _batches(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


def _described(docs: DataFrame, n_cells: int = CELLS) -> Kept:
    """One pass over all texts. Rows of kind 0: (doc_id, n, fingerprint and parities of the set); of kind 1: a slice of the task's share of the sketch."""
    names = ["kind", "doc_id", "n", "fp", "parity", "slice", "cells"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(batches):
        cells = np.zeros(n_cells, np.uint32)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text)
                rows.append((0, doc_id, len(s), _fingerprint(s), _parities(s) if len(s) else None, None, None))
                cells[(s & np.uint64(n_cells - 1)).astype(np.int64)] += 1  # documents by cell: one whose tokens share a cell counts once there
            yield _batches(rows, kinds, names)
        step = n_cells // SLICES
        rows = []
        for k in range(SLICES):
            part = cells[k * step : (k + 1) * step]
            if part.any():
                rows.append((1, None, None, None, None, k, zlib.compress(part.astype("<u4").tobytes(), 1)))
        yield _batches(rows, kinds, names)

    schema = "kind int, doc_id long, n long, fp binary, parity array<long>, slice int, cells binary"
    return Kept(docs.sparkSession, docs.select("doc_id", "text").mapInArrow(run, schema), "described")


def _sketch(described: DataFrame, n_cells: int = CELLS) -> np.ndarray:
    """The sum of all shares: a table of fixed size. Shares are summed slice by slice in two levels."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(cells), "<u4").astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        rows = [(k, zlib.compress(np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes(), 1)) for k, v in sums.items()]
        yield _batches(rows, [pa.int32(), pa.binary()], ["slice", "cells"])

    parts = described.where("kind = 1").select("slice", "cells", F.pmod(F.xxhash64("cells"), F.lit(64)).alias("share"))
    once = parts.repartition("slice", "share").select("slice", "cells").mapInArrow(add, "slice int, cells binary")
    step, out = n_cells // SLICES, np.zeros(n_cells, np.uint32)
    for r in once.repartition("slice").mapInArrow(add, "slice int, cells binary").toArrow().to_pylist():  # one job, where an iterator would run one for each partition
        # a slice comes once: its partition is summed in one task
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zlib.decompress(r["cells"]), "<u4")
    return out


def prefix(tokens: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(the prefix in global order, l, counts): the prefix of ascending tokens for l matches, l picked by estimated cost.

    The cost of l is TOKEN_COST for each token of its prefix, and for candidates the documents that the tokens
    beyond the l - 1 least frequent ones lead to, a 1/l share of which is taken to match l times.
    """
    n = len(tokens)
    count = sketch[(tokens & np.uint64(len(sketch) - 1)).astype(np.int64)]
    base = n - least_overlap(n) + 1
    most = min(MOST_MATCHES, least_overlap(n))
    reach = min(n, base + most - 1)
    order = np.argsort(count, kind="stable")[:reach]
    ordered = count[order].astype(np.float64)
    reached = np.cumsum(ordered)
    best, pick = None, 1
    for l in range(1, most + 1):
        size = base + l - 1
        if size > n:
            break
        cost = TOKEN_COST * size + (reached[size - 1] - (reached[l - 2] if l > 1 else 0.0)) / l**2
        if best is None or cost < best:
            best, pick = cost, l
    order = order[: base + pick - 1]
    return tokens[order], pick, count[order]


def _index(docs: DataFrame, sketch, bitmap, hot: int) -> DataFrame:
    """Postings (key, hot, rep, at) of the prefixes of ``docs`` (rep, text, h) that the bitmap does not know.

    The key is the token, or for a hot token, which then stands in ``hot``, one of its salts; ``at`` holds the set's size, the token's
    position and l. All postings are shuffled, so they are as narrow as can be.
    """
    names = ["key", "hot", "rep", "at"]

    def run(batches):
        cells = sketch.value
        rows: list[tuple] = []
        held = 0

        def out():
            key, token, plain, rep, at = (np.concatenate([r[i] for r in rows]) for i in range(5))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(token.view(np.int64), mask=plain), pa.array(rep), pa.array(at.view(np.int64))], names)

        for b in batches:
            b = b.filter(pa.array(~_known_to(bitmap.value, b.column(2).to_numpy())))
            for rep, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if not len(s):
                    continue
                own, l, count = prefix(s, cells)
                k = len(own)
                salts = count.astype(np.int64) // hot + 1
                mine = xxhash.xxh3_64_intdigest(str(rep).encode()) >> 1
                salted = mixed(own ^ mixed((mine % salts + 1).astype(np.uint64)))
                at = np.uint64(len(s) << SIZE_AT | l) | np.arange(k, dtype=np.uint64) << np.uint64(POS_AT)
                rows.append((np.where(salts > 1, salted, own), own, salts == 1, np.full(k, rep, np.int64), at))
                held += k
                if held >= 50_000:
                    yield out()
                    rows.clear()
                    held = 0
        if rows:
            yield out()

    return docs.mapInArrow(run, "key long, hot long, rep long, at long")


def _unpacked(at) -> list:
    """n, pos and l of what ``at`` holds."""
    pos = F.shiftrightunsigned(at, POS_AT).bitwiseAND(F.lit((1 << SIZE_AT - POS_AT) - 1))
    return [F.shiftrightunsigned(at, SIZE_AT).cast("int").alias("n"), pos.cast("int").alias("pos"), at.bitwiseAND(F.lit((1 << POS_AT) - 1)).cast("int").alias("l")]


def _could(x: str, y: str):
    """Whether two postings of one token can be of similar sets, and count as a match of them.

    Sizes must fit; the token must lie in both prefixes that the overlap needed by just these two sizes calls for (much
    shorter than a prefix that serves any partner: about a seventh of sets of one size); and
    the tokens before and behind it must leave that overlap possible.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    small, large = F.least(n, m), F.greatest(n, m)
    need = F.floor(((n + m).cast("long") * NUM + (NUM + DEN - 1)) / (NUM + DEN))
    l = F.least(f"{x}.l", f"{y}.l")
    left = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    in_prefixes = (F.col(f"{x}.pos") < n - need + l) & (F.col(f"{y}.pos") < m - need + l)
    return (small.cast("long") * DEN >= large.cast("long") * NUM) & in_prefixes & (F.least(F.col(f"{x}.pos"), F.col(f"{y}.pos")) + left >= need)


def _filter_of(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of fixed size that holds the hashes of all ids."""
    at = F.pmod(F.xxhash64("rep"), F.lit(bits))
    wide = 1 << 12
    rows = ids.select((at / wide).cast("int").alias("line"), F.shiftright((at % wide).cast("int"), 6).alias("word"), (at % 64).cast("int").alias("bit"))
    masks = rows.groupBy("line", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    found = masks.toArrow()  # a row for each word of the bitmap at most
    out[found["line"].to_numpy().astype(np.int64) * (wide // 64) + found["word"].to_numpy()] = found["mask"].to_numpy()
    return out


def _sets(docs: DataFrame, wanted: DataFrame) -> Kept:
    """(rep, set) of the wanted documents. The bitmap lets hardly any other text into the shuffle."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_filter_of(wanted))
    hashed = docs.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)))

    def run(batches):
        for b in batches:
            part = b.filter(pa.array(_known_to(bitmap.value, b.column(2).to_numpy())))
            for at in range(0, part.num_rows, 256):
                few = part.slice(at, 256)
                raws = [shingles(t).tobytes() for t in few.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(raws, pa.binary())], ["rep", "set"])

    sets = hashed.select("rep", "text", "h").mapInArrow(run, "rep long, set binary")
    return Kept(spark, sets.join(wanted, "rep", "left_semi"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""

    def run(batches):
        for b in batches:
            ok = []
            last, left = None, None
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                if x is not last:
                    last, left = x, np.frombuffer(x, np.uint64)
                right = np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(both * DEN >= (len(left) + len(right) - both) * NUM)
            kept = b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            yield kept

    met = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", n_cells: int = CELLS, hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of at
    least 0.75; the join is exact up to collisions of 64-bit hashes. Null, empty and blank texts have no shingles and link with
    nothing. Rows that repeat an id are one node. A null id links with nothing and has a null component. Further columns
    are ignored; an empty table gives an empty result. Texts are read whole, however long.
    """
    spark = ready(documents.sparkSession)
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    described = _described(docs, n_cells)
    sketch = spark.sparkContext.broadcast(_sketch(described.df, n_cells))
    rows = Kept(spark, described.df.where("kind = 0").select("doc_id", F.col("n").cast("int").alias("n"), "fp", "parity"), "rows").df
    described.forget()
    whole = rows.where("doc_id is not null and fp is not null")
    classes = Kept(spark, whole.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1"), "classes")
    copies = Kept(spark, whole.join(classes.df, "fp").where("doc_id <> rep").select("doc_id", "rep", "fp").distinct(), "copies")

    texts = docs.where("doc_id is not null").toDF("rep", "text")
    postings = _postings(texts, copies.df.select(F.col("doc_id").alias("rep"), "fp"), sketch, hot)
    nodes = whole.select(F.col("doc_id").alias("rep"), "n", *[F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITIES // 64)]).distinct()
    links = _links(texts, postings, nodes)
    postings.forget()

    group = components(links.union(copies.df.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    out = rows.join(group.df.toDF("doc_id", "component_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _postings(texts: DataFrame, copies: DataFrame, sketch, hot: int) -> Kept:
    """Index of all texts but copies: what can meet another posting, with the pivot of its token.

    Texts whose id the bitmap does not know are no copies; the others, copies and a few more, are
    compared with the copies exactly, by id and fingerprint.
    """
    spark = texts.sparkSession
    bitmap = spark.sparkContext.broadcast(_filter_of(copies))
    hashed = texts.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)))
    maybe = hashed.mapInArrow(_bitmap_hits(bitmap), "rep long, text string, h long, fp binary")
    unsure = maybe.join(copies, ["rep", "fp"], "left_anti").select("rep", "text", F.lit(-1).cast("long").alias("h"))
    index = _index(hashed.unionByName(unsure), sketch, bitmap, hot)
    # columns alone: an expression over the window would be made before the shuffle and go through it
    same = Window.partitionBy("key").orderBy("rep").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = index.select("*", F.count(F.lit(1)).over(same).alias("size"), F.first("rep").over(same).alias("p_rep"), F.first("at").over(same).alias("p_at"))
    pivot = F.struct(F.col("p_rep").alias("rep"), *_unpacked(F.col("p_at"))).alias("p")
    return Kept(spark, met.where("size > 1 or hot is not null").select(F.coalesce("hot", "key").alias("token"), "rep", *_unpacked(F.col("at")), pivot), "postings")


def _bitmap_hits(bitmap):
    def run(batches):
        for b in batches:
            hit = b.filter(pa.array(_known_to(bitmap.value, b.column(2).to_numpy())))
            fps = [_fingerprint(shingles(t)) for t in hit.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*hit.columns, pa.array(fps, pa.binary())], [*hit.schema.names, "fp"])

    return run


def _known_to(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the bit of each hash; a negative hash counts as absent."""
    at = np.maximum(h, 0)
    return ((bits[at >> 6] >> (at & 63)) & 1).astype(bool) & (h >= 0)


def _pairs(matches: DataFrame) -> DataFrame:
    """(a, b) of postings' matches (a, b, l) that match at least l times, the smaller l of the two documents."""
    return matches.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.min("l").alias("l")).where("m >= l").select("a", "b")


def _best(matches: DataFrame, of: str) -> DataFrame:
    """One pair (a, b) for each ``of``: that with most matches."""
    counted = matches.groupBy(*dict.fromkeys(["a", "b", of])).agg(F.count(F.lit(1)).alias("m"))
    return counted.groupBy(of).agg(F.max(F.struct("m", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("s")).select("s.a", "s.b")


def _apart(x: str, y: str):
    """In how many bits the parities of two sets differ: in no more tokens than that do the sets."""
    return sum((F.bit_count(F.col(f"{x}.p{k}").bitwiseXOR(F.col(f"{y}.p{k}"))) for k in range(PARITIES // 64)), F.lit(0))


def _near(x: str, y: str):
    """Whether the parities of two sets differ in no more bits than similar sets of these sizes do in tokens."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return _apart(x, y) <= n + m - 2 * F.floor(((n + m).cast("long") * NUM + (NUM + DEN - 1)) / (NUM + DEN))


def _links(texts: DataFrame, postings: Kept, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of verified pairs that connect all documents that links connect.

    At first every document is compared with one other, the pivot with which it shares most tokens. Then, round by round, every
    component is compared with the nearest by parities of the pivots drawn for its tokens, if they leave a link possible. That connects
    large groups in work linear in the index. When few of these pairs are links any more, all pairs between
    components that match often enough, and whose parities leave a link possible, are verified.
    """
    spark = texts.sparkSession
    tried = Kept(spark, _best(_with_pivots(postings.df), "b"), "tried")
    every, rounds, open_ = _check(texts, tried.df).df, 0, None
    while True:
        rounds += 1
        group = components(every)
        own = group.df.toDF("rep", "comp")
        if open_ is None:
            placed = postings.df.drop("p").join(nodes.join(own, "rep", "left"), ["rep", "n"])
        else:
            placed = open_.df.drop("comp").join(own, "rep", "left")
        located = Kept(spark, placed.withColumn("comp", F.coalesce("comp", "rep")), "located")
        if open_ is not None:
            open_.forget()
        mixed_tokens = located.df.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
        open_ = Kept(spark, located.df.join(mixed_tokens, "token", "left_semi"), "open")
        located.forget()
        group.forget()
        turn = F.xxhash64("rep", F.lit(rounds))
        drawn = F.min(F.struct(turn.alias("h"), *[c for c in open_.df.columns if c != "token"]))
        pivots = open_.df.groupBy("token", F.pmod(turn, F.lit(PIVOTS)).alias("slot")).agg(drawn.alias("s")).select("token", "s.*")
        x, y = open_.df.alias("x"), pivots.alias("y")
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & _could("x", "y") & _near("x", "y"))
        ends = [F.col("y.rep").alias("a"), F.col("x.rep").alias("b")]
        apart = (_apart("x", "y") / (F.col("x.n") + F.col("y.n"))).alias("apart")
        fresh = met.select(*ends, apart, F.col("x.comp").alias("comp")).join(tried.df.union(tried.df.select("b", "a")).distinct(), ["a", "b"], "left_anti")
        nearest = fresh.groupBy("comp").agg(F.min(F.struct("apart", "a", "b")).alias("s")).select("s.a", "s.b")
        now = Kept(spark, nearest.distinct(), "tried")
        more, n_tried = _check(texts, now.df), now.df.count()
        every = every.union(more.df)
        before, tried = tried, Kept(spark, tried.df.union(now.df), "tried")
        before.forget()
        now.forget()
        if more.df.count() <= n_tried * PROGRESS:
            break
    tried.forget()
    x, y = open_.df.alias("x"), open_.df.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.rep") < F.col("y.rep"))
    met = x.join(y, on & _could("x", "y") & _near("x", "y")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.least("x.l", "y.l").alias("l"))
    rest = _check(texts, _pairs(met))
    open_.forget()
    return every.union(rest.df)


def _with_pivots(postings: DataFrame) -> DataFrame:
    """Matches (a, b) of postings with the pivot ``p`` of their token."""
    both = postings.select(F.struct("rep", "n", "pos", "l").alias("x"), F.col("p").alias("y"))
    both = both.where((F.col("x.rep") != F.col("y.rep")) & _could("x", "y"))
    return both.select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b"))


def _check(texts: DataFrame, pairs: DataFrame) -> Kept:
    """The pairs that are similar enough."""
    spark = texts.sparkSession
    kept = Kept(spark, pairs, "pairs")
    wanted = Kept(spark, kept.df.select(F.col("a").alias("rep")).union(kept.df.select("b")).distinct(), "wanted")
    sets = _sets(texts, wanted.df)
    out = Kept(spark, _verified(kept.df, sets.df), "links")
    for k in (kept, wanted, sets):
        k.forget()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
