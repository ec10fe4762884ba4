"""Secret scans with multipart credential linking, in DataFrame functions alone.

Plain patterns give the base spans. Weaker candidates (user and client identifiers, secret-like
tokens, endpoints) are not reported for themselves: an interval join over the spans of a document
reports them only where complementary parts stand within one scope. Positions come from
splitting a text at its matches and adding up lengths, so texts that match nothing never leave the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestq.llm.common import cut, ready

#: Complementary parts lie at most this many code points apart.
SCOPE = 200


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    part: str  # identifier, secret or endpoint
    base: bool
    least: int = 0  # characters of group ``group``
    group: int = 0
    hint: str = ""  # only texts in which this occurs are searched


# The kinds of span and their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    Kind("assign", ASSIGN, "secret", True, 6, 2, r"(?i)password|passwd|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]+", "identifier", True, 20, 0, r"AKIA[A-Z0-9]{16}"),
    Kind("hex", r"[0-9a-f]{24,}", "secret", True, 24, 0, r"[0-9a-f]{24}"),
    Kind("identifier", r"""(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", "identifier", False, 0, 0, r"(?i)(?:user(?:name)?|login|account|client_?id|key_?id)[\"']?\x20*[:=]"),
    Kind("phrase", r"""(?i:pass(?:phrase|code)?|pwd|auth|credential|private_?key|signature)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", "secret", False, 0, 0, r"(?i)(?:pass(?:phrase|code)?|pwd|auth|credential|private_?key|signature)[\"']?\x20*[:=]"),
    Kind("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}={0,2}", "secret", False, 0, 0, r"[A-Za-z0-9+/_-]{20}"),
    Kind("endpoint", r"""(?i:https?|ftps?|ssh|sftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>|]+""", "endpoint", False, 0, 0, r"://"),
    Kind("address", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])", "endpoint", False, 0, 0, r"[0-9]\.[0-9]{1,3}\.[0-9]"),
)


def _matches(kind: Kind, rank: int) -> Column:
    """Every match of a kind in ``text``, as an array of (rank, nth, before, size, ok), with the length of the text between a match and the one before."""
    found = F.regexp_extract_all("text", F.lit(f"({kind.pattern})" if kind.group == 0 else kind.pattern), F.lit(0))
    between = F.split("text", kind.pattern, -1)
    one = lambda m, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), F.length(F.get(between, i)).alias("before"), F.length(m).alias("size"), _long_enough(m, kind).alias("ok"))
    return F.when(F.col("text").rlike(kind.hint), F.transform(found, one)).otherwise(F.array().cast("array<struct<rank:int,nth:int,before:int,size:int,ok:boolean>>"))


def _long_enough(match: Column, kind: Kind) -> Column:
    if not kind.least:
        return F.lit(True)
    return F.length(F.regexp_extract(match, kind.pattern, kind.group) if kind.group else match) >= kind.least


def find_spans(texts: DataFrame) -> DataFrame:
    """(k1, k2, rank, start, end) of all spans of all kinds, weak candidates included."""
    every = F.concat(*[_matches(kind, rank) for rank, kind in enumerate(KINDS)])
    rows = texts.select("k1", "k2", F.explode(every).alias("m")).select("k1", "k2", "m.*")
    rows = rows.groupBy("k1", "k2", "rank", "nth").agg(*[F.first(c).alias(c) for c in ("before", "size", "ok")])  # repeated rows are one text
    upto = Window.partitionBy("k1", "k2", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("size")).over(upto)
    placed = rows.withColumn("end", end)
    return placed.where("ok").select("k1", "k2", "rank", (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans that have a complementary part within ``scope``: a secret an identifier or endpoint, these a secret.

    Spans are dealt into bins of the scope's length; a bin holds few of them however long the text, so no
    key is hot. A weak span that overlaps its complement is the same thing found twice and does not count.
    """
    part = F.element_at(F.array(*[F.lit(k.part) for k in KINDS]), F.col("rank") + 1)
    weak = F.element_at(F.array(*[F.lit(not k.base) for k in KINDS]), F.col("rank") + 1)
    known = spans.withColumn("part", part)
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    left = known.where(weak).withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope)).alias("x")
    right = known.withColumn("bin", F.floor(F.col("start") / scope)).alias("y")
    other = known.withColumn("bin", F.floor((F.col("end") - 1) / scope)).alias("y")
    both = right.union(other).distinct().alias("y")
    near = (F.col("y.start") <= F.col("x.end") + scope) & (F.col("y.end") >= F.col("x.start") - scope)
    apart = (F.col("y.start") >= F.col("x.end")) | (F.col("y.end") <= F.col("x.start"))
    complement = (F.col("x.part") == "secret") != (F.col("y.part") == "secret")
    same = (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2")) & (F.col("x.bin") == F.col("y.bin"))
    return left.join(both, same & near & apart & complement).select(*[F.col(f"x.{c}").alias(c) for c in ("k1", "k2", "rank", "start", "end")]).distinct()


def _has_rank(rank: int):
    return lambda span: span["rank"] == rank


def scan_secrets(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are written kind:start:end in code points, end exclusive, by start, then kind in the order
    of KINDS. base_sha256 digests the base spans (of the empty string when there are none); spans lists
    them and the weak candidates that the interval join links. Null and empty texts have
    no spans. Rows that repeat id and text get equal results; a null id is carried along; further
    columns are ignored; an empty table gives an empty result.
    """
    ready(documents.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    doc = F.col(id_column)
    named = documents.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(21), doc, text).alias("k1"), F.xxhash64(F.lit(22), doc, text).alias("k2"))
    spans = cut(find_spans(named), "spans")
    base = F.element_at(F.array(*[F.lit(k.base) for k in KINDS]), F.col("rank") + 1)
    told = spans.where(base).unionByName(link_parts(spans)).distinct()
    one = F.struct("start", "rank", "end")
    lists = told.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.when(base, one))).alias("base"), F.array_sort(F.collect_list(one)).alias("all"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    counted = [F.size(F.filter("base", _has_rank(r))).cast("long").alias(f"n_{KINDS[r].name}") for r in range(3)]
    found = lists.select("k1", "k2", *counted, written(F.col("base")).alias("base"), written(F.col("all")).alias("spans"))
    out = named.select("doc_id", "k1", "k2").join(found, ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{KINDS[r].name}", F.lit(0).cast("long")).alias(f"n_{KINDS[r].name}") for r in range(3)],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
