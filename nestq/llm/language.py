"""Language identification by prediction by partial matching (PPM).

For every language the bytes that follow each context of up to ORDER bytes are counted on a bounded
sample of labelled texts. A context is kept when it was seen often enough; a byte that is new in a context costs
an escape to the next shorter one (escape method C). Statistics are frozen after training, so a
byte's code length depends on the longest kept context before it and nothing else: the contexts of a
language become the states of an automaton with a table of exact code lengths, and
texts are scored by walking each language's, many pieces of text side by side. So the model grows with the languages and no faster.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import ready

ORDER = 4
#: Bound of the training sample: bytes per language, from pieces of this many characters at most.
SAMPLE_BYTES, SAMPLE_PIECE = 400_000, 2000
#: Contexts of two bytes and more are kept from this many occurrences on.
MIN_SEEN = 6
UNDETERMINED = "und"
#: Text is walked in pieces of this many bytes; each begins ORDER bytes early, which makes the pieces exact.
PIECE, BATCH_BYTES = 512, 2 << 20
TEMPERATURE = 0.05


class Ppm:
    """Frozen model. For each language ``move[state, symbol]`` and ``cost[state, symbol]`` (bits)."""

    def __init__(self, languages: list[str], symbol: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], order: int):
        self.languages, self.symbol, self.tables, self.order = languages, symbol, tables, order

    def code_lengths(self, data: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(data), len(self.languages)))
        begins, texts = [], []
        for i, d in enumerate(data):
            n = max(1, -(-len(d) // PIECE))
            begins.append(np.arange(n, dtype=np.int64) * PIECE)
            texts.append(np.full(n, i))
        if not data:
            return total
        owner, begin = np.concatenate(texts), np.concatenate(begins)
        size = np.fromiter(map(len, data), np.int64, len(data))
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        joined = self.symbol[np.frombuffer(b"".join(data) + b"\0", np.uint8)].astype(np.int32)
        length = np.minimum(PIECE, size[owner] - begin)
        early = np.minimum(self.order, begin)
        by_length = np.argsort(-length, kind="stable")
        owner, begin, length, early = owner[by_length], begin[by_length], length[by_length], early[by_length]
        at = base[owner] + begin
        live = np.searchsorted(-length, -np.arange(PIECE) - 0.5)  # pieces longer than each step
        for li, (move, cost) in enumerate(self.tables):
            width = move.shape[1]
            onward, price = move.ravel() * width, cost.ravel()  # a state is where its row begins
            state = np.zeros(len(owner), np.int32)
            for k in range(self.order, 0, -1):
                use = early >= k
                s = joined[np.where(use, at - k, 0)]
                state = np.where(use, onward[state + s], state)
            bits = np.zeros(len(owner), np.float32)
            for step in range(int(length[0])):
                n = live[step]
                cell = state[:n] + joined[at[:n] + step]
                bits[:n] += price[cell]
                state[:n] = onward[cell]
            np.add.at(total[:, li], owner, bits.astype(np.float64))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of whole texts; UNDETERMINED with score 0 without a letter."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        group: list[int] = []
        data: list[bytes] = []
        held = 0

        def settle():
            nonlocal held
            bits = self.code_lengths(data)
            for row, i, d in zip(bits, group, data, strict=True):
                best = int(row.argmin())
                odds = np.exp2(-(row - row[best]) / max(1.0, len(d) * TEMPERATURE))
                names[i], scores[i] = self.languages[best], float(1 / odds.sum())
            group.clear()
            data.clear()
            held = 0

        for i, text in enumerate(texts):
            if self.languages and text and any(map(str.isalpha, text)):
                data.append(text.encode("utf-8", "surrogatepass"))
                group.append(i)
                held += len(data[-1])
                if held >= BATCH_BYTES:
                    settle()
        if data:
            settle()
        return names, scores


def train(samples: dict[str, list[str]], order: int = ORDER, min_seen: int = MIN_SEEN) -> Ppm:
    """The frozen model of the sample texts of each language."""
    languages = sorted(samples)
    data = {lang: [t.encode("utf-8", "surrogatepass") for t in samples[lang]] for lang in languages}
    seen = sorted({b for texts in data.values() for d in texts for b in set(d)})
    symbol = np.full(256, len(seen), np.uint8 if len(seen) < 256 else np.uint16)
    symbol[seen] = np.arange(len(seen))
    return Ppm(languages, symbol, [_automaton(_contexts(data[lang], order, min_seen), seen, order) for lang in languages], order)


def _contexts(data: list[bytes], order: int, min_seen: int) -> list[dict[bytes, Counter]]:
    """By length, the kept contexts of a language and how often each byte follows them."""
    levels: list[dict[bytes, Counter]] = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        grams: Counter = Counter()
        for d in data:
            grams.update(d[i : i + k + 1] for i in range(len(d) - k))
        level = levels[k]
        for g, n in grams.items():
            level.setdefault(g[:-1], Counter())[g[-1]] += n
    for k in range(order, 1, -1):  # rare contexts go; a context stays when one that extends it does
        longer = {c[1:] for c in levels[k + 1]} if k < order else set()
        levels[k] = {c: f for c, f in levels[k].items() if sum(f.values()) >= min_seen or c in longer}
    return levels


def _automaton(levels: list[dict[bytes, Counter]], seen: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one language: the state that follows each state and symbol, and the symbol's cost there."""
    width, place = len(seen) + 1, {b: i for i, b in enumerate(seen)}
    states = {b""} | {c for level in levels for c in level}
    states |= {c[:k] for c in states for k in range(len(c))}  # an automaton needs all beginnings
    states |= {c[k:] for c in states for k in range(len(c))}
    named = sorted(states, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(named)}
    move = np.zeros((len(named), width), np.int32)
    cost = np.full((len(named), width), math.log2(256), np.float32)
    for i, c in enumerate(named):  # shorter contexts come first
        if c:
            cost[i] = cost[number[c[1:]]]
        if followers := levels[len(c)].get(c):
            total, kinds = sum(followers.values()), len(followers)
            cost[i] -= math.log2(kinds / (total + kinds))
            for b, n in followers.items():
                cost[i, place[b]] = -math.log2(n / (total + kinds))
        if c:
            move[i] = move[number[c[1:]]]
        for k, b in enumerate(seen if len(c) < order else ()):
            if (to := number.get(c + bytes([b]))) is not None:
                move[i, k] = to
    return move, cost


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, seed: int = 7) -> Ppm:
    """Train on ``labelled`` (text, lang), a sample of about ``sample_bytes`` per language.

    All labelled texts are counted first. Each is cut into pieces of SAMPLE_PIECE characters, however long it is, and every language
    keeps the share of its pieces that makes up the bound, picked by a hash; a language with less is taken whole, and none is left out.
    """
    real = labelled.where((F.octet_length("text") > 0) & F.col("lang").isNotNull())
    sizes = real.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("lang").collect()
    if not sizes:
        return train({})
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(SAMPLE_PIECE))
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_bytes / r["n"]))]), F.col("lang"))
    kept = F.filter(starts, lambda at: F.pmod(F.xxhash64("text", at, F.lit(seed)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    picked = real.withColumn("share", share).withColumn("starts", kept).where(F.size("starts") > 0)
    pieces = picked.select("lang", F.explode(F.transform("starts", lambda at: F.substring("text", at, F.lit(SAMPLE_PIECE)))).alias("text"))
    samples: dict[str, list[str]] = {r["lang"]: [] for r in sizes}
    for r in pieces.collect():
        samples[r["lang"]].append(r["text"])
    return train({k: sorted(set(v)) for k, v in samples.items() if v})


def identify(documents: DataFrame, labelled: DataFrame | None = None, model: Ppm | None = None) -> DataFrame:
    """All columns of ``documents`` with ``lang_pred`` (string) and ``score`` (double) appended.

    Trains on ``labelled`` (text, lang; by default the rows of ``documents`` that are not held out), or takes
    ``model``. Only ``text`` is looked at in a prediction. Null text, and text without a letter, is
    UNDETERMINED with score 0, as is all text when there is nothing to learn from. Existing columns
    lang_pred and score are replaced; repeated rows come out alike; texts are read whole, however long; an empty table gives an empty result. The model
    that workers get holds at most some ten thousand contexts per language.
    """
    spark = ready(documents.sparkSession)
    if model is None:
        source = labelled if labelled is not None else documents.where(~held_out(F.col("doc_id")))
        model = fit(source.select("text", "lang"))
    shared = spark.sparkContext.broadcast(model)
    plain = documents.drop("lang_pred", "score")
    at = plain.columns.index("text")

    def run(batches):
        ppm = shared.value
        for b in batches:
            names, scores = ppm.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labelled = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    found = identify(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
