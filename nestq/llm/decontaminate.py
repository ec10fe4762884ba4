"""Benchmark decontamination by spaced-seed hashing.

A fixed mask reads some positions of a window of words and ignores the others, so one hash still meets when
words at ignored positions were replaced. Hashes of all windows of the documents are looked up among those of
the benchmark; around each hit the texts are compared word by word along their diagonal, and
the best stretch with few enough substitutions is the overlap, or any stretch with few enough if the best has too many.

The benchmark is dealt into blocks of a bounded number of words, each broadcast by itself; a
document is read once a block and never shuffled.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestq.llm.common import WordHashes, mixed, odd_constants, ready

#: Fixed masks: 1 reads a word, 0 ignores it. Their zeros lie 3, 4, 5 and 6 apart, or side by side.
MASKS = ("11011011", "1110111011", "111101111", "1111101111", "1100110011", "1111001111")
#: An overlap counts from this many equal words on, or from this share of a shorter item.
MIN_WORDS, MIN_SHARE = 13, 0.75
#: A substituted word costs as much as this many equal words bring; each price finds a stretch, the lower one a longer.
SUBSTITUTION = (1, 2)
#: Share of equal words in a stretch.
MIN_EQUAL = 0.75
#: Items of fewer words than this never match; items shorter than a mask match as a whole.
LEAST_WORDS = 5
BLOCK_WORDS = 400_000
#: Words of documents that are hashed at a time.
CHUNK_WORDS = 1 << 18


class PlainWords(WordHashes):
    """Hashes of words without case and without what is neither letter nor digit at their ends; 0 when nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        text = word.decode("utf-8", "replace").casefold()
        begin, end = 0, len(text)
        while begin < end and not text[begin].isalnum():
            begin += 1
        while end > begin and not text[end - 1].isalnum():
            end -= 1
        h = self[word] = xxhash.xxh3_64_intdigest(text[begin:end].encode()) | 1 if begin < end else 0
        return h

    def text(self, text: str | None) -> np.ndarray:
        h = self.of(text.encode("utf-8", "surrogatepass").split()) if text else np.empty(0, np.uint64)
        return h[h != 0]


def mask_hashes(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """One hash for each window of the mask's length."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = odd_constants(len(mask), 100 + number)
    total = np.full(n, np.uint64(number))
    for k, bit in enumerate(mask):
        if bit == "1":
            total += h[k : k + n] * c[k]
    return mixed(total)


class Block:
    """Hashes of some benchmark items, sorted, with the item and position of each."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        shortest = min(map(len, MASKS))
        lengths = sorted({len(h) for _, h in items if LEAST_WORDS <= len(h) < max(map(len, MASKS))})
        self.masks = [(m, i) for i, m in enumerate(MASKS)] + [("1" * n, 50 + n) for n in lengths]
        keys, item, pos = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, (_, h) in enumerate(items):
            for m, i in self.masks:
                if i < 50 or len(h) == len(m) or (len(h) >= shortest and len(m) == len(h)):
                    found = mask_hashes(h, m, i)
                    keys.append(found)
                    item.append(np.full(len(found), k))
                    pos.append(np.arange(len(found)))
        keys, item, pos = map(np.concatenate, (keys, item, pos))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.pos = keys[order], item[order], pos[order]
        bits = max(16, min(26, int(len(keys) * 16).bit_length()))
        self.low = np.uint64((1 << bits) - 1)
        self.there = np.zeros(1 << bits, bool)
        self.there[(self.keys & self.low).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in h, item, position in the item) of every window that meets one of the benchmark."""
        at, item, pos = [], [], []
        for m, i in self.masks:
            g = mask_hashes(h, m, i)
            where = np.flatnonzero(self.there[(g & self.low).astype(np.int64)])
            if not len(where):
                continue
            lo, hi = np.searchsorted(self.keys, g[where], "left"), np.searchsorted(self.keys, g[where], "right")
            n = hi - lo
            if not n.any():
                continue
            index = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at.append(np.repeat(where, n))
            item.append(self.item[index])
            pos.append(self.pos[index])
        if not at:
            return (np.empty(0, np.int64),) * 3
        return tuple(map(np.concatenate, (at, item, pos)))


def best_stretch(equal: np.ndarray, substitution: int) -> tuple[int, int, int]:
    """(begin, end, equal words) of the stretch with the highest score: 1 for an equal word, less ``substitution`` for another."""
    score = np.where(equal, 1, -substitution)
    total = np.concatenate([[0], np.cumsum(score)])
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    begin = int(np.flatnonzero(total[: end + 1] == least[end])[-1])
    return begin, end, int(equal[begin:end].sum())


def qualifying_stretch(equal: np.ndarray, wanted: int) -> tuple[int, int, int] | None:
    """(begin, end, equal words) of a stretch with the most equal words among those with a share of MIN_EQUAL; None when that is fewer than ``wanted``.

    With 1 - MIN_EQUAL for an equal word and -MIN_EQUAL for another, a stretch has the share when its score is not negative. For each end
    the earliest such begin is where the running minimum of the prefix sums first falls to the sum at the end.
    """
    share = Fraction(MIN_EQUAL).limit_denominator(1000)
    up, down = share.denominator - share.numerator, share.numerator
    total = np.concatenate([[0], np.cumsum(np.where(equal, up, -down))])
    least = np.minimum.accumulate(total)
    begin = np.searchsorted(-least, -total, "left")  # whole numbers, so ties are exact
    count = np.concatenate([[0], np.cumsum(equal)])
    same = count - count[begin]
    end = int(np.argmax(same))
    if same[end] < max(1, wanted):
        return None
    return int(begin[end]), end, int(same[end])


def overlaps(block: Block, h: np.ndarray, at: np.ndarray, item: np.ndarray, pos: np.ndarray) -> list[tuple]:
    """The best overlap (item, equal words, words, begin in h, begin in the item) with each item that was hit and overlaps enough."""
    best: dict[int, tuple] = {}
    for k, d in sorted(set(zip(item.tolist(), (at - pos).tolist(), strict=True))):
        other = block.items[k][1]
        lo, hi = max(0, -d), min(len(other), len(h) - d)
        equal = h[lo + d : hi + d] == other[lo:hi]
        wanted = min(MIN_WORDS, int(np.ceil(MIN_SHARE * len(other))))
        if np.count_nonzero(equal) < wanted:
            continue
        stretches = [s for price in SUBSTITUTION if (s := best_stretch(equal, price))[2] >= wanted and s[2] >= MIN_EQUAL * (s[1] - s[0])]
        if not stretches and (found := qualifying_stretch(equal, wanted)):
            stretches = [found]
        for begin, end, same in stretches:
            if same > best.get(k, (0, 0))[1]:
                best[k] = (k, same, end - begin, lo + d + begin, lo + begin)
    return list(best.values())


def blocks_of(benchmark: DataFrame, id_column: str, text_column: str, most: int = BLOCK_WORDS):
    """Benchmark items in blocks of at most ``most`` words (a longer item is a block of its own), one at a time."""
    known, items, held = PlainWords(), [], 0
    for r in benchmark.select(id_column, text_column).toLocalIterator():
        h = known.text(r[1])
        if len(h) < LEAST_WORDS:
            continue
        if items and held + len(h) > most:
            yield Block(items)
            items, held = [], 0
        items.append((r[0], h))
        held += len(h)
    if items:
        yield Block(items)


def _search(block: Block, texts: list[str | None], known: PlainWords):
    """(row, overlaps) of the texts that overlap."""
    hashes: list[np.ndarray] = []
    first = held = 0

    def settle(first: int):
        size = np.fromiter(map(len, hashes), np.int64, len(hashes))
        ends = np.cumsum(size)
        joined = np.concatenate([np.empty(0, np.uint64), *hashes])
        at, item, pos = block.hits(joined)
        row = np.searchsorted(ends, at, "right")
        order = np.argsort(row, kind="stable")
        at, item, pos, row = at[order], item[order], pos[order], row[order]
        for i in np.unique(row).tolist():
            lo, hi = np.searchsorted(row, [i, i + 1])
            found = overlaps(block, hashes[i], at[lo:hi] - (ends[i] - size[i]), item[lo:hi], pos[lo:hi])
            if found:
                yield first + i, found

    for i, text in enumerate(texts):
        hashes.append(known.text(text))
        held += len(hashes[-1])
        if held >= CHUNK_WORDS:
            yield from settle(first)
            first, held = i + 1, 0
            hashes.clear()
    if hashes:
        yield from settle(first)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (doc_id, item_id, equal_words, words, doc_word, item_word) per document and benchmark item that overlap.

    Texts are compared word by word, without case and punctuation. An overlap has at least
    MIN_WORDS equal words, or MIN_SHARE of an item's words, and a share of MIN_EQUAL equal words; doc_word and item_word say at which word it begins. Null or empty texts on either side and items of
    fewer than LEAST_WORDS words have none. Repeated rows give their overlaps each; null ids are
    carried along; further columns are ignored; empty tables give an empty result.
    """
    spark = ready(documents.sparkSession)
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id long, item_id long, equal_words long, words long, doc_word long, item_word long"
    names = [c.split()[0] for c in schema.split(", ")]
    out = None
    for block in blocks_of(benchmark, item_column, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            known = PlainWords()
            for b in batches:
                ids, rows = b.column(0).to_pylist(), []
                for i, found in _search(shared.value, b.column(1).to_pylist(), known):
                    rows += [(ids[i], shared.value.items[k][0], *rest) for k, *rest in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(len(names))], names)

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_benchmark(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents``, all columns, without the rows that overlap with an item as ``find_overlaps`` says. No shuffle."""
    spark = ready(documents.sparkSession)
    out, at = documents, documents.columns.index(text_column)
    for block in blocks_of(benchmark, item_column, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            known = PlainWords()
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[i for i, _ in _search(shared.value, b.column(at).to_pylist(), known)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, documents.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return find_overlaps(read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"))
