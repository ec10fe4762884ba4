"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Equal lines are grouped by a 128-bit hash. Each distinct line is split into one segment more than the edits it
may differ by (MAX_EDITS, fewer for short lines), so a line within these edits holds one of them unchanged; longer lines probe the segment index
with the substrings that length and position leave possible. What meets is compared by letter
counts and then verified by a banded bit-parallel edit distance: for each number of edits a bit
mask over the diagonals of the band says where that many edits suffice, and one
pass over the characters moves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestq.llm.common import Kept, components, ready

MAX_EDITS = 2
#: Lines under this many characters, and blank ones, stay as they are: they are single words and marks.
MIN_CHARS = 8
#: From these lengths of the shorter line on, two lines may differ by one edit and by MAX_EDITS; shorter ones meet only when equal. A segment has 6 characters at least.
ONE_EDIT, ALL_EDITS = 12, 20
#: Characters that are counted to turn down pairs before verification, in groups of eight at most.
COUNTED = (" etaonir", "hdslubgw", "01234567", "89.,:-/_")
PAIRS_A_TASK = 2_000
#: Bits of the filter through which the texts of candidates are fetched.
FILTER_BITS = 1 << 22


def _hash(*cols: Column) -> list[Column]:
    return [F.xxhash64(F.lit(11), *cols), F.xxhash64(F.lit(12), *cols)]


def _lines(docs: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, at, line, h1, h2) for every line that takes part; d1, d2 name a document: its id and text."""
    keyed = docs.where("doc_id is not null").select("doc_id", "d1", "d2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keyed = keyed.where((F.length("line") >= MIN_CHARS) & F.col("line").rlike(r"\S"))
    h1, h2 = _hash(F.col("line"))
    return keyed.select("*", h1.alias("h1"), h2.alias("h2"))


def allowed_edits(n: Column) -> Column:
    """By how many edits two lines may differ whose shorter one has ``n`` characters."""
    return F.when(n >= ALL_EDITS, MAX_EDITS).when(n >= ONE_EDIT, 1).otherwise(0)


def measured(lines: DataFrame) -> DataFrame:
    """``lines`` (line, ...) with n, its length, and for lines of n - less characters where each segment begins (b_less_i) and its length (l_less_i).

    Segments are m / parts long, the last m % parts of them a character longer; the length is null where lines of m characters have no such segment. These columns are made once, below the keys: as
    expressions within them they would make a method too large to be compiled.
    """
    parts = MAX_EDITS + 1
    out = lines.withColumn("n", F.length("line"))
    n = F.col("n")
    out = out.withColumns({f"m_{less}": n - less for less in range(parts)} | {f"p_{less}": allowed_edits(n - less) + 1 for less in range(parts)})
    m, p, s, over = (lambda less, x=x: F.col(f"{x}_{less}") for x in "mpso")
    out = out.withColumns({f"s_{less}": F.floor(m(less) / p(less)).cast("int") for less in range(parts)} | {f"o_{less}": F.pmod(m(less), p(less)) for less in range(parts)})
    begins = {f"b_{less}_{i}": s(less) * i + F.greatest(F.lit(0), over(less) + i - p(less)) for less in range(parts) for i in range(parts)}
    lengths = {f"l_{less}_{i}": F.when((p(less) > max(i, less, 1)), s(less) + F.when(over(less) + i >= p(less), 1).otherwise(0)) for less in range(parts) for i in range(parts)}
    return out.withColumns(begins | lengths)


def _key(less: int, i: int, move: int) -> Column:
    begin, size = F.col(f"b_{less}_{i}") + move, F.col(f"l_{less}_{i}")
    key = F.xxhash64(F.col(f"m_{less}"), F.lit(i), F.substring(F.col("line"), begin + 1, size))
    return F.when(size.isNotNull() if not less and not move else (begin >= 0) & (begin + size <= F.col("n")), key)


def segment_keys() -> Column:
    """Keys (null where there is none) of a measured line's own segments: the line's length, the segment's number and text."""
    return F.array(*[_key(0, i, 0) for i in range(MAX_EDITS + 1)])


def probe_keys() -> Column:
    """Keys (null where there is none) that a measured line looks up among lines as long or up to MAX_EDITS characters shorter, besides its own.

    If i edits at most lie before segment i and MAX_EDITS - i at most behind it, the
    segment has moved by at most i as seen from the left, and by at most MAX_EDITS - i from the difference in length as seen from the right.
    Between lines of one length a move to the left is one to the right for the other line, so only the latter are looked up.
    """
    out = []
    for less in range(MAX_EDITS + 1):
        for i in range(MAX_EDITS + 1):
            moves = range(max(-i, less - (MAX_EDITS - i)), min(i, less + MAX_EDITS - i) + 1)
            out += [_key(less, i, move) for move in moves if less or move > 0]
    return F.array(*out)


def _common_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings begin with in common, by binary search; more steps where the shorter has 4096 characters or more."""
    most = F.least(F.length(a), F.length(b))
    few, all_of_them = (F.array(*[F.lit(1 << k) for k in reversed(range(bits))]) for bits in (12, 31))
    steps = F.when(most >= 1 << 12, all_of_them).otherwise(few)

    def longer(p: Column, step: Column) -> Column:
        same = F.substring(a, p + 1, step) == F.substring(b, p + 1, step)
        return F.when((step <= most - p) & same, p + step).otherwise(p)

    return F.aggregate(steps, F.lit(0), longer)


def _unlike(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with two of its string columns cut to what lies between their common beginning and, in what is left, their common end; their edit distance stays the same."""
    x, y, same = F.col(a), F.col(b), F.col("__same")
    rest = pairs.withColumn("__same", _common_prefix(x, y)).withColumns({c: F.substring(F.col(c), same + 1, F.length(c)) for c in (a, b)})
    ends = rest.withColumn("__same", _common_prefix(F.reverse(x), F.reverse(y)))
    return ends.withColumns({c: F.substring(F.col(c), F.lit(1), F.length(c) - same) for c in (a, b)}).drop("__same")


def _band(a: Column, b: Column, most: int) -> Column:
    """The masks r0 .. r<most> after all characters of ``a``: bit ``d + most`` of rk says that ``a`` becomes the first ``len(a) + d`` characters of ``b`` with k edits or fewer.

    A step moves all diagonals at once: along equal characters, by a substitution on the diagonal, by a character left out to the diagonal below, and, within
    a step, by one put in to the diagonal above. Once all masks are empty the remaining characters are passed over.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    names = [f"r{k}" for k in range(most + 1)]

    def closed(masks: list[Column]) -> list[Column]:
        out = [masks[0]]
        for m in masks[1:]:
            out.append(m.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full)))
        return out

    def state(chars_a: Column, chars_b: Column, masks: list[Column]) -> Column:
        return F.struct(chars_a.alias("a"), chars_b.alias("b"), *[m.alias(n) for m, n in zip(masks, names, strict=True)])

    def move(s: Column, i: Column) -> Column:
        c = F.get(s["a"], i)
        equal = F.lit(0)
        for d in range(-most, most + 1):
            same = F.coalesce(F.get(s["b"], i + d) == c, F.lit(False))
            equal = equal.bitwiseOR(F.when(same, 1 << (d + most)).otherwise(0))
        # the equality mask is bound once
        bound = F.transform(F.array(equal), lambda e: F.struct(*[m.alias(n) for m, n in zip(_stepped([s[n] for n in names], e), names, strict=True)]))
        new = F.get(bound, F.lit(0))
        return F.when(s[names[-1]] == 0, s).otherwise(state(s["a"], s["b"], [new[n] for n in names]))

    def _stepped(old: list[Column], equal: Column) -> list[Column]:
        new = [old[0].bitwiseAND(equal)]
        for k in range(1, most + 1):
            new.append(old[k].bitwiseAND(equal).bitwiseOR(old[k - 1]).bitwiseOR(F.shiftright(old[k - 1], 1)))
        return closed(new)

    first = state(F.split(a, ""), F.split(b, ""), closed([F.lit(1 << most)] + [F.lit(0)] * most))
    return F.aggregate(F.sequence(F.lit(0), F.length(a) - 1), first, move)


#: Characters after the common beginning over which a first look goes.
LOOK = 16


def still_possible(a: Column, b: Column, begin: Column, most: int = MAX_EDITS) -> Column:
    """Whether any diagonal of the band is left after LOOK characters behind ``begin``; true where ``a`` ends before."""
    left = F.length(a) - begin
    look = _band(F.substring(a, begin + 1, F.lit(LOOK)), F.substring(b, begin + 1, F.lit(LOOK + most)), most)
    return F.when(left <= LOOK, True).otherwise(look[f"r{most}"] != 0)


def within_edits(a: Column, b: Column, most: int = MAX_EDITS, begin: Column | None = None, allowed: Column | None = None) -> Column:
    """Whether the edit distance of two strings is at most ``most`` (or ``allowed``, from 1 to ``most``): banded and bit-parallel, from where the strings begin to differ (or ``begin``)."""
    allowed = F.lit(most) if allowed is None else allowed
    begin = F.lit(0) if begin is None else begin
    x, y = F.substring(a, begin + 1, F.length(a)), F.substring(b, begin + 1, F.length(b))
    d = F.length(b) - F.length(a)
    masks = _band(x, y, most)
    last = F.coalesce(*[F.when(allowed == k, masks[f"r{k}"]) for k in range(1, most)], masks[f"r{most}"])
    hit = F.call_function("shiftright", last, (d + most).cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.when(F.least(F.length(x), F.length(y)) == 0, F.abs(d) <= allowed).when(F.abs(d) > allowed, False).otherwise(hit)


def _letter_counts(line: Column, group: int) -> Column:
    """How often each character of a group occurs, up to 127, a byte each."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(COUNTED[group]):
        found = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))  # these characters have one byte each
        out = out.bitwiseOR(F.shiftleft(F.least(found, F.lit(127)).cast("long"), 8 * k))
    return out


def _counts_fit(x: str, y: str) -> Column:
    """Whether the letter counts leave MAX_EDITS edits possible: an edit changes them by two at most."""
    total = F.lit(0)
    of = lambda side, g, k: F.shiftright(F.col(f"{side}.counts{g}"), 8 * k).bitwiseAND(F.lit(127))
    for g, letters in enumerate(COUNTED):
        for k in range(len(letters)):
            total = total + F.abs(of(x, g, k) - of(y, g, k))
    return total <= 2 * MAX_EDITS


def _bitmap(keys: DataFrame, column: str) -> bytes:
    """A bitmap of fixed size with the bits of all keys."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    rows = keys.select((at / 32).cast("int").alias("word"), (at % 32).cast("int").alias("bit"))
    words = [0] * (FILTER_BITS // 32)
    for r in rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toLocalIterator():
        words[r["word"]] = r["mask"]
    return b"".join(w.to_bytes(4, "little") for w in words)


def _bit_of(bitmap: bytes, column: Column) -> Column:
    at = F.pmod(column, F.lit(FILTER_BITS))
    byte = F.conv(F.hex(F.substring(F.lit(bytearray(bitmap)), (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1


def near_lines(docs: DataFrame) -> tuple[Kept, Kept]:
    """(distinct lines: h1, h2, key, n, first occurrence and count; verified pairs of their keys)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # a longer method would run uncompiled
    lines = _lines(docs)
    line = F.col("line")
    keys = F.struct(segment_keys().alias("own"), probe_keys().alias("probes"))
    made = measured(lines).select("h1", "h2", F.struct("doc_id", "at", "d1", "d2").alias("place"), keys.alias("x"))
    grouped = made.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"), F.first("x").alias("x"))
    distinct = Kept(spark, grouped.select("h1", "h2", F.col("h1").alias("key"), "first", "size", "x.*"), "lines")

    # most lines meet no other: only for those that do are texts fetched and characters counted
    sides = [distinct.df.select("key", F.explode(c).alias("k"), F.lit(c == "own").alias("own")) for c in ("own", "probes")]
    postings = sides[0].union(sides[1]).where("k is not null")
    shared = postings.groupBy("k").agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("n")).where("own and n > 1").select("k")
    # a task's part of the shared keys is small beside its part of all keys, which need not be sorted
    meeting = Kept(spark, postings.join(shared.hint("shuffle_hash"), "k", "left_semi"), "meeting_lines")
    wanted = Kept(spark, meeting.df.select("key").distinct().join(distinct.df.select("key", "first.*"), "key"), "wanted_lines")
    bitmap = _bitmap(wanted.df, "d1")
    of = docs.where(_bit_of(bitmap, F.col("d1")))
    texts = _lines(of).select(F.col("h1").alias("key"), "d1", "d2", "at", "line").join(wanted.df.select("key", "d1", "d2", "at"), ["key", "d1", "d2", "at"])
    counts = [f"counts{g}" for g in range(len(COUNTED))]
    counted = [_letter_counts(line, g).alias(c) for g, c in enumerate(counts)]
    texts = Kept(spark, texts.groupBy("key").agg(F.first("line").alias("line")).select("key", "line", *counted), "line_texts")

    known = Kept(spark, meeting.df.join(texts.df.select("key", *counts), "key"), "counted_lines")
    own, probes = known.df.where("own").alias("y"), known.df.where("not own").alias("x")
    apart = (F.col("x.k") == F.col("y.k")) & _counts_fit("x", "y")
    ends = [F.col("x.key").alias("a"), F.col("y.key").alias("b")]
    moved = probes.join(own, apart & (F.col("x.key") != F.col("y.key"))).select(*ends)
    still = known.df.where("own").alias("x").join(own, apart & (F.col("x.key") > F.col("y.key"))).select(*ends)
    met = moved.union(still).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = Kept(spark, met.distinct(), "line_pairs")
    plain = texts.df.select("key", "line")
    both = pairs.df.join(plain.toDF("a", "la"), "a").join(plain.toDF("b", "lb"), "b")
    # A pair costs far more than its bytes tell, so pairs are dealt by number. The table between keeps the optimizer from moving verification before that, into the join.
    both = both.repartition(max(1, min(100_000, pairs.df.count() // PAIRS_A_TASK)), "a", "b")
    both = both.withColumn("allowed", allowed_edits(F.least(F.length("la"), F.length("lb"))))
    dealt = Kept(spark, _unlike(both, "la", "lb"), "line_pair_texts")
    la, lb = F.col("la"), F.col("lb")
    near = dealt.df.where(still_possible(la, lb, F.lit(0)) & within_edits(la, lb, MAX_EDITS, allowed=F.col("allowed")))
    links = Kept(spark, near.select("a", "b"), "line_links")
    for k in (meeting, known, pairs, dealt, wanted, texts):
        k.forget()
    return distinct, links


def repeated_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, d1, d2, dropped): for each document with lines to drop, their numbers (from 0) in order."""
    spark = ready(documents.sparkSession)
    docs = _named(documents, id_column, text_column)
    distinct, links = near_lines(docs)
    group = components(links.df)
    placed = distinct.df.select("h1", "h2", "key", "size", "first")
    classed = placed.join(group.df.toDF("key", "class"), "key", "left").where("size > 1 or class is not null")
    classed = Kept(spark, classed.withColumn("class", F.coalesce("class", "key")), "line_classes")
    firsts = Kept(spark, classed.df.groupBy("class").agg(F.min("first").alias("keep")), "line_firsts")
    members = Kept(spark, classed.df.join(firsts.df, "class").select("h1", "h2", F.col("keep.d1").alias("k1"), F.col("keep.d2").alias("k2"), F.col("keep.at").alias("k_at")), "line_members")
    occurring = _lines(docs).select("doc_id", "d1", "d2", "at", "h1", "h2").join(members.df, ["h1", "h2"])
    gone = occurring.where(~((F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")) & (F.col("at") == F.col("k_at"))))
    return gone.groupBy("doc_id", "d1", "d2").agg(F.array_sort(F.collect_set("at")).alias("dropped"))


def _named(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    d1, d2 = _hash(F.col(id_column), F.col(text_column))
    return documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), d1.alias("d1"), d2.alias("d2"))


def dedup_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with repeated lines taken out of the text.

    Lines of at least MIN_CHARS characters, blank ones aside, are linked when they are equal or within MAX_EDITS edits of one
    another (one edit where the shorter has under ALL_EDITS characters, none under ONE_EDIT); of each connected
    class the occurrence with the smallest (id, line number) stays and all others go. All other lines
    and columns stay as they are; a text whose lines all go becomes empty. Documents with a null id or null text are
    left alone; rows that repeat both id and text are one document and come out alike. An empty table gives an empty result.
    """
    d1, d2 = _hash(F.col(id_column), F.col(text_column))
    gone = repeated_lines(documents, id_column, text_column).select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "dropped").withColumnRenamed("dropped", "__dropped")
    joined = documents.withColumn("__d1", d1).withColumn("__d2", d2).join(gone, ["__d1", "__d2"], "left")
    lines = F.split(F.col(text_column), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    text = F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i)))
    cleaned = joined.withColumn(text_column, F.when(F.col("__dropped").isNull(), F.col(text_column)).otherwise(text))
    return cleaned.select(*[F.col(c) for c in documents.columns])


def line_report(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, dropped (line numbers, comma-joined)."""
    d1, d2 = _hash(F.col(id_column), F.col(text_column))
    own = documents.select(F.col(id_column).alias("doc_id"), d1.alias("d1"), d2.alias("d2"), F.coalesce(F.size(F.split(F.col(text_column), "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    gone = repeated_lines(documents, id_column, text_column).drop("doc_id")
    return own.join(gone, ["d1", "d2"], "left").select("doc_id", F.when(F.col("n_lines") > 0, F.col("n_lines")).otherwise(0).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.concat_ws(",", "dropped").alias("dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
