"""Packing a token stream into windows, keeping its order, by dynamic programming.

The stream of a range of documents is cut into windows of at most ``size``
tokens.  A window costs its padding, and the place of its end costs nothing
after a document, ``sentence`` inside a document after a sentence, ``broken``
inside a sentence (offered only where sentences are longer than a window).  Padding is ``size -
length``, but nothing where the length is a power of two.  The cheapest start of
a padded window is a minimum over a sliding range of earlier cuts, kept in a
monotone queue, so a cut takes amortised constant time; windows of a power of
two are a dozen more transitions.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkTokenizer, batches, texts_of

SIZE = 2048
#: Tokens of a stream that one programme covers; a longer document has one of its own.
SPAN = 1 << 19
#: Cost of a cut, in tokens of padding.
SENTENCE, BROKEN = 4.0, 64.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut string"


def cut_windows(cuts: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Ends of the cheapest windows.

    cuts: ascending places where a window may end, the last the end of the
    stream; cost: of ending there.  Places farther apart than ``size`` must not
    occur.  Of equally cheap ways that with the longest last window wins."""
    places = np.concatenate(([0], cuts)).astype(np.int64)
    m = len(places)
    exact: dict[int, list[int]] = {}
    k = 1
    while k <= size:
        at = np.searchsorted(places, places - k)
        for j in np.flatnonzero(places[np.minimum(at, m - 1)] == places - k).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        k *= 2
    p, price = places.tolist(), [0.0, *cost.tolist()]
    best, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (best + place, place, number), ascending in both
    for j in range(1, m):
        pj = p[j]
        while queue[0][1] < pj - size:
            queue.popleft()
        value, _, i = queue[0]
        value += size - pj
        for e in exact.get(j, ()):
            if best[e] < value:
                value, i = best[e], e
        value += price[j]
        best[j], back[j] = value, i
        key = value + pj
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, pj, j))
    ends, j = [], m - 1
    while j:
        ends.append(p[j])
        j = back[j]
    return ends[::-1]


def candidate_cuts(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, size: int, sentence: float, broken: float) -> tuple[np.ndarray, np.ndarray]:
    """Places after documents (``ends``) and after sentence ends, and, in longer gaps, every ``size`` tokens."""
    inner = np.flatnonzero(closes[ids]) + 1
    places = np.union1d(inner, ends)
    cost = np.full(len(places), sentence)
    cost[np.searchsorted(places, ends)] = 0.0
    gaps = np.diff(np.concatenate(([0], places)))
    if wide := np.flatnonzero(gaps > size).tolist():
        more = np.concatenate([np.arange(places[g] - gaps[g] + size, places[g], size) for g in wide])
        order = np.argsort(np.concatenate((places, more)), kind="stable")
        places, cost = np.concatenate((places, more))[order], np.concatenate((cost, np.full(len(more), broken)))[order]
    return places, cost


def closing_ids(tokenizer) -> np.ndarray:
    """Which ids end a sentence: pieces whose last character (without a word-end mark) is . ! or ?"""
    out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = piece.removesuffix("</w>")[-1:] in (".", "!", "?")
    return out


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, size: int = SIZE, sentence: float = SENTENCE, broken: float = BROKEN, span: int = SPAN, stored: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and what cut its end (document, sentence, inside).

    Documents keep their doc_id order, in sequences and inside them; with
    ``stored`` the order in which the files of ``docs`` hold them (a shuffled shard
    keeps its order), and no row is moved.  Null and
    empty texts have the end id alone.  Rows that share a doc_id are documents
    of their own, ordered by a hash of the text; a null doc_id comes first.  Other
    columns aren't read.  An empty table gives no row.  Each task streams its rows
    and holds ``span`` tokens or one document."""

    def run(parts):
        import pyarrow as pa

        tok = ChunkTokenizer.shared(tokenizer, "bare", "<u2")
        if tok.vocab_size > 1 << 16 or end_id >= 1 << 16:
            tok = ChunkTokenizer.shared(tokenizer, "bare", "<u4")
        closes = closing_ids(tok.tokenizer)
        if end_id < len(closes):
            closes[end_id] = False
        end = np.array([end_id], tok.dtype).tobytes()
        sequence = TaskContext.get().partitionId() << 40

        def packed(doc_ids, ids):
            nonlocal sequence
            lengths = np.array([len(x) for x in ids], np.int64) // tok.dtype.itemsize
            ends = np.cumsum(lengths)
            stream = np.frombuffer(b"".join(ids), tok.dtype)
            places, cost = candidate_cuts(stream, ends, closes, size, sentence, broken)
            windows = np.array(cut_windows(places, cost, size), np.int64)
            stops = np.union1d(windows, ends)
            starts = np.concatenate(([0], stops[:-1]))
            doc = np.searchsorted(ends, stops)
            window = np.searchsorted(windows, stops)
            raw = stream.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            window_start = np.concatenate(([0], windows[:-1]))[window]
            inside = cost[np.searchsorted(places, stops)]
            cut = np.where(stops == ends[doc], "document", np.where(inside == broken, "inside", "sentence"))
            yield pa.record_batch(
                [pa.array(doc_ids, pa.int64()).take(pa.array(doc)), pa.array(starts - (ends - lengths)[doc]), pa.array(stops - starts), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(window + sequence), pa.array(starts - window_start), pa.array(cut.tolist(), pa.string())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"],
            )
            sequence += len(windows)

        doc_ids, ids, have = [], [], 0
        for batch in parts:
            texts, names = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in batches(texts):
                for name, x in zip(names[a:b], tok.encode(texts.slice(a, b - a)), strict=True):
                    doc_ids.append(name)
                    ids.append(x + end)
                    have += len(ids[-1]) // tok.dtype.itemsize
                    if have >= span:
                        yield from packed(doc_ids, ids)
                        doc_ids, ids, have = [], [], 0
        tok.forget()
        if ids:
            yield from packed(doc_ids, ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not stored:
        tie = F.xxhash64("text")  # rows that share a doc_id don't have to share a task
        rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return rows.mapInArrow(run, SCHEMA)
