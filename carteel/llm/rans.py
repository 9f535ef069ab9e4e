"""Token ids as binary files, coded by a static range asymmetric numeral system.

File: ``CTRANS01``, blocks, index, its length (8 bytes), ``CTRANS01``.  All
blocks of a data set share one frequency table (file ``table.bin``).  A block
holds up to ``lanes * steps`` ids; id number ``t * lanes + n`` belongs to lane
``n``.  Each lane is a coder of its own, and the lanes' 16-bit words are
interleaved in the order in which a decoder asks for them; behind them come the ids
that have no frequency in the table, four bytes each.  Every ``every``
steps a checkpoint keeps all lanes' states and the word position, so a block
decodes from each checkpoint independently; the decoder here runs all lanes of
all checkpoints of many blocks as one vector.  A checksum over the ids guards
each block.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import RangeReader, workspace, write_file, written
from .tokens import ChunkTokenizer, batches, texts_of

MAGIC = b"CTRANS01"
#: A lane's state lies in [2**16, 2**32) between two ids; frequencies add up to 2**16.
BITS = 16
LOW = 1 << BITS
HEAD = struct.Struct("<IIII")
NO_ID = -(2**63)  # a null doc_id


@dataclass(frozen=True)
class Layout:
    """lanes: coders a block; steps: ids of a lane in a block; every: steps from checkpoint to checkpoint."""

    lanes: int = 32
    steps: int = 2048
    every: int = 512
    together: int = 32  # blocks that are coded as one vector


class Table:
    """Frequencies with sum 2**16, at least 1 for each id that occurs.

    Vocabularies of more than 2**16 ids have one more symbol, ``escape``.  Where
    more than 2**16 ids occur, the 2**15 most frequent have frequencies and the
    others are coded as the escape symbol and written out beside."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        present = np.flatnonzero(counts)
        if len(counts) > LOW:
            rare = present[np.lexsort((present, -counts[present]))][LOW // 2 :] if len(present) > LOW else present[:0]
            counts = np.append(counts, counts[rare].sum())
            counts[rare] = 0
            present = np.flatnonzero(counts)
        freq = np.zeros(len(counts), np.int64)
        if len(present):
            total = int(counts.sum())
            freq[present] = np.maximum(1, (counts[present].astype(object) * LOW // total).astype(np.int64))
            order = present[np.lexsort((present, -counts[present]))]
            left, k = LOW - int(freq.sum()), 0
            if left > 0:
                freq[order[0]] += left
            while left < 0:  # rounding up the rare ones took too much: the frequent ones give
                s = order[k % len(order)]
                give = min(-left, int(freq[s]) - 1, max(1, int(freq[s]) // 8))
                freq[s] -= give
                left, k = left + give, k + 1
        self._set(freq)

    def _set(self, freq: np.ndarray) -> None:
        self.freq = freq
        before = np.concatenate(([0], np.cumsum(freq)[:-1])) if len(freq) else freq
        self.pad = int(np.argmax(freq)) if len(freq) else 0
        # of so many symbols the last is the escape
        self.escape = len(freq) - 1 if len(freq) > LOW else None
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= LOW else np.uint32), freq)
        # by id, for coding; whole numbers below 2**53 are exact in float64, which divides faster than integers do
        self.f, self.c = freq.astype(np.float64), before.astype(np.float64)
        # by slot, for decoding
        self.slot_freq = freq[self.symbol].astype(np.uint32)
        self.slot_rank = (np.arange(len(self.symbol)) - before[self.symbol]).astype(np.uint32)

    def coded(self, ids: np.ndarray) -> np.ndarray:
        """The symbols of ``ids``."""
        if self.escape is None:
            return ids
        return np.where(self.freq[ids] > 0, ids, self.escape).astype(self.symbol.dtype)

    def dump(self) -> bytes:
        return MAGIC + struct.pack("<I", len(self.freq)) + zlib.compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def load(cls, data: bytes) -> Table:
        if data[:8] != MAGIC:
            raise ValueError("no frequency table")
        table = cls.__new__(cls)
        table._set(np.frombuffer(zlib.decompress(data[12:]), "<u4").astype(np.int64))
        return table


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_blocks(ids: np.ndarray, table: Table, layout: Layout) -> list[bytes]:
    """Blocks for all of ``ids``; the last may be shorter."""
    room, out = layout.lanes * layout.steps, []
    full = len(ids) // room
    for b in range(0, full, layout.together):
        out += _encode(ids[b * room : min(full, b + layout.together) * room], table, layout, layout.steps, room)
    if rest := ids[full * room :].size:
        steps = -(-rest // layout.lanes)
        padded = np.full(steps * layout.lanes, table.pad, ids.dtype)
        padded[:rest] = ids[full * room :]
        out += _encode(padded, table, layout, steps, rest)
    return out


def _encode(ids: np.ndarray, table: Table, layout: Layout, steps: int, count: int) -> list[bytes]:
    lanes, raw = layout.lanes, ids.reshape(-1, steps * layout.lanes)
    cells = np.ascontiguousarray(table.coded(ids).reshape(-1, steps, lanes).swapaxes(0, 1)).reshape(steps, -1)
    width = cells.shape[1]
    n = width // lanes
    state = np.full(width, float(LOW))
    words = np.empty((steps, width), np.uint16)
    sent = np.empty((steps, width), bool)
    marks = -(-steps // layout.every)
    states = np.empty((marks, width), np.uint32)
    for t in range(steps - 1, -1, -1):
        s = cells[t]
        f = table.f.take(s)
        high = np.floor(state * (1.0 / LOW))
        np.subtract(state, high * LOW, out=words[t], casting="unsafe")
        m = np.greater_equal(high, f, out=sent[t])
        np.copyto(state, high, where=m)
        q = np.floor(state / f)
        state += q * (LOW - f)
        state += table.c.take(s)
        if t % layout.every == 0:
            states[t // layout.every] = state
    per_step = sent.reshape(steps, n, lanes).sum(axis=2, dtype=np.int64)
    words, sent, states = words.reshape(steps, n, lanes), sent.reshape(steps, n, lanes), states.reshape(marks, n, lanes)
    out = []
    for b in range(n):
        w = words[:, b, :][sent[:, b, :]]
        at = np.concatenate(([0], np.cumsum(per_step[:, b])))[: steps : layout.every]
        mine = raw[b, :count]
        beside = mine[table.freq[mine] == 0] if table.escape is not None else mine[:0]
        out.append(HEAD.pack(len(mine), len(w), steps, _crc(mine)) + states[:, b, :].astype("<u4").tobytes() + at.astype("<u4").tobytes() + w.astype("<u2").tobytes() + beside.astype("<u4").tobytes())
    return out


def decode_blocks(blocks: list[bytes], table: Table, layout: Layout) -> list[np.ndarray]:
    """The ids of each block; a damaged block raises ValueError."""
    out: list[np.ndarray | None] = [None] * len(blocks)
    by_steps: dict[int, list[int]] = {}
    heads = [HEAD.unpack_from(b) for b in blocks]
    for i, h in enumerate(heads):
        by_steps.setdefault(h[2], []).append(i)
    for steps, group in by_steps.items():
        for g in range(0, len(group), layout.together):
            _decode([(i, blocks[i], heads[i]) for i in group[g : g + layout.together]], steps, table, layout, out)
    return out  # type: ignore[return-value]


def _decode(group, steps: int, table: Table, layout: Layout, out: list) -> None:
    lanes, every = layout.lanes, layout.every
    marks, n = -(-steps // every), len(group)
    state = np.empty((n, marks, lanes), np.uint32)
    at = np.empty((n, marks), np.int32)
    words, beside, base = [], [], 0
    for k, (_, block, (_, n_words, _, _)) in enumerate(group):
        pos = HEAD.size
        state[k] = np.frombuffer(block, "<u4", marks * lanes, pos).reshape(marks, lanes)
        pos += 4 * marks * lanes
        at[k] = np.frombuffer(block, "<u4", marks, pos).astype(np.int64) + base
        pos += 4 * marks
        words.append(np.frombuffer(block, "<u2", n_words, pos))
        beside.append(np.frombuffer(block, "<u4", -1, pos + 2 * n_words))
        base += n_words
    # the last checkpoint of a block may have fewer steps; what is decoded past its end is dropped
    stream = np.concatenate([*words, np.zeros(lanes * every + 1, np.uint16)]).astype(np.uint32)
    state, at = state.reshape(-1, lanes), at.reshape(-1, 1)
    todo = min(every, steps)
    cells = np.empty((todo, n * marks, lanes), table.symbol.dtype)
    mask, shift = np.uint32(LOW - 1), np.uint32(BITS)
    rank = np.empty(state.shape, np.int32)
    for t in range(todo):
        slot = state & mask
        table.symbol.take(slot, out=cells[t])
        state >>= shift
        state *= table.slot_freq.take(slot)
        state += table.slot_rank.take(slot)
        m = state < LOW
        np.cumsum(m, axis=1, dtype=np.int32, out=rank)
        rank += at
        at = rank[:, -1:].copy()
        rank -= 1
        np.copyto(state, (state << shift) | stream.take(rank, mode="clip"), where=m)
    cells = np.ascontiguousarray(cells.swapaxes(0, 1)).reshape(n, marks * todo * lanes)
    for k, (i, _, (count, _, _, crc)) in enumerate(group):
        ids = cells[k, :count]
        if table.escape is not None:
            ids[ids == table.escape] = beside[k]
        if _crc(ids) != crc:
            raise ValueError(f"checksum of block {i} differs")
        out[i] = ids


class IdFile:
    """Reads one file; any range of ids is decoded from the blocks it lies in."""

    def __init__(self, uri: str, table: Table):
        self._in, self.table = RangeReader(uri), table
        tail = self._in.read(self._in.size - 16, 16)
        if tail[8:] != MAGIC or self._in.read(0, 8) != MAGIC:
            raise ValueError(f"{uri} is no id file")
        size = struct.unpack("<Q", tail[:8])[0]
        raw = self._in.read(self._in.size - 16 - size, size)
        head_size = struct.unpack_from("<I", raw)[0]
        head = json.loads(raw[4 : 4 + head_size])
        self.layout = Layout(**head["layout"])
        index = np.frombuffer(zlib.decompress(raw[4 + head_size :]), "<i8")
        b, d = head["blocks"], head["docs"]
        self.offsets, self.sizes, self.counts = index[:b], index[b : 2 * b], index[2 * b : 3 * b]
        self.doc_ids, self.doc_tokens = index[3 * b : 3 * b + d], index[3 * b + d :]

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self._in.__exit__(*a)

    def chunks(self, first: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
        stop = len(self.offsets) if stop is None else stop
        for b in range(first, stop, self.layout.together):
            e = min(stop, b + self.layout.together)
            raw = self._in.read(int(self.offsets[b]), int(self.sizes[b:e].sum()))
            at = np.concatenate(([0], np.cumsum(self.sizes[b:e])))
            yield np.concatenate(decode_blocks([raw[at[i] : at[i + 1]] for i in range(e - b)], self.table, self.layout))

    def ids(self, start: int, length: int) -> np.ndarray:
        ends = np.cumsum(self.counts)
        first, stop = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + length, "left")) + 1
        if length <= 0:
            return np.empty(0, np.uint32)
        got = np.concatenate(list(self.chunks(first, stop)))
        skip = start - (int(ends[first - 1]) if first else 0)
        return got[skip : skip + length].astype(np.uint32)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in file order; a few blocks are in memory at a time, and the document at hand."""
        doc, have, parts = 0, 0, []
        for ids in self.chunks():
            at = 0
            while doc < len(self.doc_ids):
                take = min(int(self.doc_tokens[doc]) - have, len(ids) - at)
                parts.append(ids[at : at + take])
                at, have = at + take, have + take
                if have < self.doc_tokens[doc]:
                    break
                yield int(self.doc_ids[doc]), np.concatenate(parts)
                doc, have, parts = doc + 1, 0, []
                if at == len(ids) and doc < len(self.doc_ids) and self.doc_tokens[doc]:
                    break


def file_chunks(docs: Iterator[tuple[int, np.ndarray]], table: Table, layout: Layout, told: dict) -> Iterator[bytes]:
    """The bytes of one file; ``told`` gets the counts."""
    room = layout.lanes * layout.steps * layout.together
    sizes, counts, doc_ids, doc_tokens, parts, have = [], [], [], [], [], 0
    yield MAGIC

    def coded(ids):
        for block in encode_blocks(ids, table, layout):
            sizes.append(len(block))
            counts.append(HEAD.unpack_from(block)[0])
            yield block

    for doc_id, ids in docs:
        doc_ids.append(doc_id)
        doc_tokens.append(len(ids))
        parts.append(ids)
        have += len(ids)
        if have >= room:
            ids = np.concatenate(parts)
            cut = have // room * room
            yield from coded(ids[:cut])
            parts, have = [ids[cut:]], have - cut
    if have:
        yield from coded(np.concatenate(parts))
    offsets = 8 + np.concatenate(([0], np.cumsum(sizes)))[: len(sizes)]
    head = json.dumps({"layout": layout.__dict__, "blocks": len(sizes), "docs": len(doc_ids)}).encode()
    index = np.concatenate([np.asarray(x, "<i8") for x in (offsets, sizes, counts, doc_ids, doc_tokens)])
    raw = struct.pack("<I", len(head)) + head + zlib.compress(index.astype("<i8").tobytes())
    told.update(n_docs=len(doc_ids), n_tokens=int(sum(doc_tokens)))
    yield raw + struct.pack("<Q", len(raw)) + MAGIC


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(counts, doc_id, n_tokens, width, ids): ids of each whole text and the end id, as little-endian integers of ``width``
    bytes: 2, or 4 throughout for vocabularies of more than 65,536 ids.  Each task's last row, with counts = 1, holds how
    often each id came, as 64-bit integers."""

    def run(parts):
        import pyarrow as pa

        tok = ChunkTokenizer.shared(tokenizer, "spaced", "<u2")
        if tok.vocab_size > 1 << 16 or end_id >= 1 << 16:
            tok = ChunkTokenizer.shared(tokenizer, "spaced", "<u4")
        end = np.array([end_id], tok.dtype).tobytes()
        wide, counts = tok.dtype.itemsize, np.zeros(max(tok.vocab_size, end_id + 1), np.int64)
        names = ["counts", "doc_id", "n_tokens", "width", "ids"]
        for batch in parts:
            texts = texts_of(batch.column(1))
            for a, b in batches(texts):
                ids = [x + end for x in tok.encode(texts.slice(a, b - a))]
                counts += np.bincount(_array(b"".join(ids), wide), minlength=len(counts))
                n = len(ids)
                yield pa.record_batch([pa.array([0] * n, pa.int32()), batch.column(0).slice(a, n), pa.array([len(x) // wide for x in ids], pa.int64()), pa.array([wide] * n, pa.int32()), pa.array(ids, pa.binary())], names=names)
        tok.forget()
        if counts.any():
            yield pa.record_batch([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([int(counts.sum())]), pa.array([8], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "counts int, doc_id long, n_tokens long, width int, ids binary")


def _array(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4")


def token_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs, from the rows with counts = 1, added up in Spark; the driver gets a number for each id of the vocabulary."""

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            for data in batch.column(0):
                counts = np.frombuffer(data.as_buffer(), "<i8")
                used = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])

    found = rows.filter("counts = 1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in found), default=-1) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    return counts


def write_ids(rows: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Write the ids of all rows as files ``ids-NNNNN.rans`` in ascending doc_id order and the shared table beside them.

    Returns the manifest: file_no, path, n_docs, n_tokens, first (ids in all files before)."""
    table = Table(token_counts(rows))
    write_file(f"{folder}/table.bin", [table.dump()])
    packed = table.dump()

    def run(parts):
        import pyarrow as pa

        def docs():
            for batch in parts:
                for doc_id, ids, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    yield NO_ID if doc_id is None else doc_id, _array(ids, width)

        stream = docs()
        head = next(stream, None)
        if head is None:
            return
        no, told = TaskContext.get().partitionId(), {}

        def all_docs():
            yield head
            yield from stream

        path = f"{folder}/ids-{no:06d}.rans"
        size = write_file(path, file_chunks(all_docs(), Table.load(packed), layout, told))
        yield pa.record_batch([[no], [path], [told["n_docs"]], [told["n_tokens"]], [size]], names=["file_no", "path", "n_docs", "n_tokens", "n_bytes"])

    tie = F.xxhash64("ids")  # rows that share a doc_id don't have to share a task
    ordered = rows.filter("counts = 0").select("doc_id", "ids", "width").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "ids")
    manifest = written(ordered.mapInArrow(run, "file_no long, path string, n_docs long, n_tokens long, n_bytes long"), folder, "manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files, each by a task of its own."""

    def run(parts):
        import pyarrow as pa

        table = None
        for batch in parts:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if table is None:
                    with RangeReader(f"{folder}/table.bin") as f:
                        table = Table.load(f.read(0, f.size))
                rows: list[tuple] = []
                with IdFile(path, table) as f:
                    for doc_id, ids in f.documents():
                        rows.append((None if doc_id == NO_ID else doc_id, first, len(ids), _crc(ids)))
                        first += len(ids)
                        if len(rows) == 20_000:
                            yield _batch(pa, rows)
                            rows = []
                if rows:
                    yield _batch(pa, rows)

    files = (manifest.agg(F.max("file_no")).first()[0] or 0) + 1
    spread = manifest.select(F.col("file_no").cast("int").alias("file_no"), "path", "first").repartitionById(files, "file_no").select("path", "first")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(pa, rows):
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_corpus(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, layout: Layout = Layout()) -> DataFrame:
    """Tokenise whole texts, write them as coded id files, read the files back.

    Nulls and empty texts have the end id alone.  Rows that share a doc_id all
    stay, ordered by a hash of their ids; rows with a null doc_id come first.  Other
    columns aren't read.  An empty table gives no row and no file."""
    spark = docs.sparkSession
    folder = workspace(spark, "rans")
    rows = written(token_rows(docs, tokenizer, end_id), folder, "tokens", by=("counts",))
    return read_ids(write_ids(rows, folder, layout), folder)
