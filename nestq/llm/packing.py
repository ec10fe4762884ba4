"""Order-preserving packing of tokenised documents into training sequences.

Documents stay in the order in which their partition holds them. A dynamic programme chooses the
window cuts: a cut after a document is free, after a sentence it costs a little, anywhere else a
lot, and every sequence that is neither full nor a power of two long pays its padding. The
cheapest predecessor of each cut comes from a monotone queue, so the work is linear in the number
of possible cuts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from nestq.llm.common import ready

WINDOW = 1024
END_ID = 0
#: Cost of a cut, in tokens of padding.
SENTENCE_CUT, WORD_CUT = 8.0, 40.0
#: The programme runs over about this many tokens at a time; what its last, open window holds goes on to the next run.
BLOCK_TOKENS = 1 << 18
#: Bytes without a change between white space and anything else from which a text goes to the plain tokenizer, whose time does not grow with the square of a word's length.
LONG_RUN = 2000
#: Shortest sequence that is left unpadded on purpose (a power of two).
LEAST_UNPADDED = 128
TOKENIZER = "byte_bpe_50k.json"
#: The pattern by which a byte-level vocabulary splits texts into pre-tokens.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: In UTF-8: a closing mark and whatever quotes and brackets close behind it. White space must follow, but after marks of Chinese and Japanese.
CLOSING = re.compile("(?:[.]|!|[?]|…|。|！|？)(?:'|\"|[)]|]|»|”|’)*".encode())

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where an executor finds the vocabulary file; a name without a folder is one of the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def merge_ranks(tokenizer: dict) -> dict[bytes, int] | None:
    """The tokens (bytes) of a byte-level vocabulary file and their ids, if merging the neighbours whose union has the least id does what its merges do; else None.

    It does if each merge makes a token of its own, later ones greater ids, all greater than
    those of the parts, and if each token is what its own bytes are encoded as: as long as no merge crosses the ends of a stretch, the stretch
    is merged as it is alone, so where two neighbours make up a token they are that token's merge.
    """
    model, pre, added = tokenizer["model"], tokenizer["pre_tokenizer"] or {}, tokenizer["added_tokens"]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(name) for name in odd) or any(tokenizer[name] for name in ("normalizer", "truncation", "padding")):
        return None
    if pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
        return None
    if len(added) > 1 or any(t[name] for t in added for name in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in {t["content"] for t in added}}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    last = max(vocabulary.get(c, len(vocabulary)) for c in byte_of)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if len(vocabulary) != len(byte_of) + len(pairs):
        return None
    for left, right in pairs:
        made = vocabulary.get(left + right, -1)
        if made <= max(last, vocabulary.get(left, made), vocabulary.get(right, made)):
            return None
        last = made
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    alone = Tokenizer.from_str(json.dumps(tokenizer | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
    encoded = alone.encode_batch_fast(list(vocabulary), add_special_tokens=False)
    if any(e.ids != [i] for e, i in zip(encoded, vocabulary.values(), strict=True)):
        return None
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items()}


class TextEncoder:
    """Ids of whole texts as the tokenizer of a vocabulary file has them, special tokens found, none added.

    Where ``merge_ranks`` allows it, they come from the same vocabulary by the faster merging of ranks.
    """

    def __init__(self, path: str):
        self.path, self.plain, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        ranks = merge_ranks(told)
        if ranks is None:
            self._tokenizer()
        else:
            special = {t["content"]: t["id"] for t in told["added_tokens"]}
            self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)
            size = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
            for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
                size[i] = len(token)
            self.size = size

    def _tokenizer(self):
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return self.plain

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the numbers of ids after which a sentence ends."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        white = raw <= 32
        runs = np.flatnonzero(white[1:] != white[:-1])
        if self.fast is not None and np.diff(runs, prepend=-1, append=len(raw) - 1).max() < LONG_RUN:
            ids = self.fast.encode_to_numpy(text, allowed_special="all")
            ends = np.cumsum(self.size[ids])
        else:
            found = self._tokenizer().encode(text, add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            chars = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
            ends = np.searchsorted(chars, np.array([b for _, b in found.offsets]), "right")
            ends[:-1][ends[:-1] == ends[1:]] = 0  # only the last id of a character ends with it
        spans = np.array([m.span() for m in CLOSING.finditer(raw.tobytes())], np.int64).reshape(-1, 2)
        stop = np.append(raw == 10, False)  # a line break also ends what is before it
        stop[spans[:, 1][np.append(white, False)[spans[:, 1]] | (raw[spans[:, 0]] > 0xE2)]] = True
        return ids.astype("<u4", copy=False), np.flatnonzero(stop[ends]) + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """The encoder of a worker; what it holds does not grow with the texts."""
    return TextEncoder(path)


def unpadded_sources(at: np.ndarray, window: int) -> dict[int, list[int]]:
    """Per cut, the earlier cuts that lie a power of two before it."""
    out: dict[int, list[int]] = {}
    power = window
    while power >= min(LEAST_UNPADDED, window):
        k = np.searchsorted(at, at - power)
        hit = np.flatnonzero(at[np.minimum(k, len(at) - 1)] == at - power)
        for j, i in zip(hit.tolist(), k[hit].tolist(), strict=True):
            out.setdefault(j, []).append(i)
        power //= 2
    return out


def best_cuts(ends: list[int], costs: list[float], window: int = WINDOW, open_end: bool = False) -> list[int]:
    """The cheapest chain of cuts from 0 to the last of ``ends`` (ascending), as positions.

    Two neighbouring cuts lie at most ``window`` apart; ``costs[i]`` is what the cut at ``ends[i]``
    costs, and a sequence of n tokens pays ``window - n`` unless n is a power of two (of LEAST_UNPADDED or more). With ``open_end``
    the last sequence is not padded. ``ends`` may lie no further apart than ``window``.
    """
    best, back, at = [0.0], [0], [0, *ends]
    exact = unpadded_sources(np.array(at), window)
    reach = [0.0]  # best + position: what a cut has to offer to all later ones alike
    queue, head, last = [0], 0, len(ends)
    for j in range(1, last + 1):
        pos = at[j]
        lowest = pos - window
        while at[queue[head]] < lowest:
            head += 1
        source = queue[head]
        pay = reach[source] - lowest
        if open_end and j == last:
            pay, source = _least(best, at, j, lowest)
        elif j in exact:
            for k in exact[j]:
                if best[k] < pay:
                    pay, source = best[k], k
        pay += costs[j - 1]
        best.append(pay)
        back.append(source)
        value = pay + pos
        reach.append(value)
        while len(queue) > head and reach[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts = []
    while last:
        cuts.append(at[last])
        last = back[last]
    return cuts[::-1]


def _least(best: list[float], at: list[int], j: int, lowest: int) -> tuple[float, int]:
    found = (best[j - 1], j - 1)
    for k in range(j - 2, -1, -1):
        if at[k] < lowest:
            break
        found = min(found, (best[k], k))
    return found


class Packer:
    """Packs a stream of documents; yields rows of pieces as sequences are closed."""

    def __init__(self, first_sequence: int, window: int = WINDOW, sentence_cut: float = SENTENCE_CUT, word_cut: float = WORD_CUT):
        self.sequence, self.window, self.sentence_cut, self.word_cut = first_sequence, window, sentence_cut, word_cut
        self.docs: list[tuple[int | None, np.ndarray, np.ndarray, int, int]] = []  # id, ids left, sentence ends, ids before, all ids
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray, sentence_ends: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, sentence_ends, 0, len(ids)))
        self.held += len(ids)
        if self.held >= BLOCK_TOKENS:
            yield from self.flush(False)

    def _possible(self) -> tuple[list[int], list[float]]:
        """Where the stream can be cut. Where sentences give none within half a window, every eighth position can be."""
        parts, price, base = [], [], 0
        for _, ids, ends, before, _ in self.docs:
            n = len(ids)
            inner = ends[(ends > before) & (ends < before + n)] - before
            stops = np.concatenate([[0], inner, [n]])
            gaps = np.flatnonzero(np.diff(stops) > self.window // 8)
            extra = [np.arange(stops[g] + 8, stops[g + 1], 8) for g in gaps]
            pos = np.concatenate([inner, [n], *extra]).astype(np.int64)
            cost = np.concatenate([np.full(len(inner), self.sentence_cut), [0.0], np.full(len(pos) - len(inner) - 1, self.word_cut)])
            order = np.argsort(pos, kind="stable")
            parts.append(pos[order] + base)
            price.append(cost[order])
            base += n
        return np.concatenate(parts).tolist(), np.concatenate(price).tolist()

    def flush(self, final: bool = True) -> Iterator[tuple]:
        if not self.docs:
            return
        ends, costs = self._possible()
        cuts = best_cuts(ends, costs, self.window, open_end=not final)
        if not final:  # the last window goes on
            cuts = cuts[:-1]
        begin, d, inside = 0, 0, 0
        for end in cuts:
            offset, length = 0, end - begin
            padded = length if length & (length - 1) == 0 else self.window
            while begin < end:
                doc_id, ids, _, before, total = self.docs[d]
                n = min(end - begin, len(ids) - inside)
                yield (doc_id, before + inside, n, zlib.crc32(ids[inside : inside + n].tobytes()), total, self.sequence, offset, padded)
                begin, inside, offset = begin + n, inside + n, offset + n
                if inside == len(ids):
                    d, inside = d + 1, 0
            self.sequence += 1
        self.docs = self.docs[d:]
        if inside:
            doc_id, ids, ends_, before, total = self.docs[0]
            self.docs[0] = (doc_id, ids[inside:], ends_, before + inside, total)
        self.held = sum(len(x[1]) for x in self.docs)


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` tokens (a power of two).

    A document is the ids of its whole text, special tokens in it included, and a closing END_ID; null or empty text is that id alone. Each id lies in one piece:
    ids ``start`` to ``start + length`` of its document lie at ``offset`` of ``sequence_id``.
    Repeated rows are packed each by itself, a null id stays null, further columns are
    ignored, an empty table gives no pieces; a very long text is read whole and cut like any other. Partitions are packed independently, with memory for a
    block of documents only; the order is that of the partition.
    """
    ready(documents.sparkSession)

    def run(batches):
        encode = encoder(tokenizer_path(tokenizer))
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, ends = encode(text.as_py() or "")
                rows += packer.add(doc_id, np.append(ids, np.uint32(END_ID)).astype("<u4"), ends)
                if len(rows) >= 10_000:
                    yield out()
                    rows.clear()
        rows += packer.flush()
        if rows:
            yield out()

    return documents.select(id_column, text_column).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
