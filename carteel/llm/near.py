"""Near duplicates by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with its
occurrence (the second time a shingle comes it is another symbol).  A sketch
takes, for each of ``HASHES`` orders, the ``TUPLE`` least symbols and keeps them
in text order; texts that agree in one such tuple are candidates, which depends
on which shingles they share and on their order.  Candidates are verified by
alignment: ``a`` symbols that both have in the same order, of ``n`` and ``m``,
give the similarity ``a / (n + m - a)``, which must reach 0.8.  Symbols come once
in a text, so the alignment is a longest increasing chain of matches; those
outside the band that the similarity leaves are skipped.

Unaligned symbols ``n + m - 2a`` are a distance, so the triangle inequality
rules out pairs exactly.  Texts of a bucket are first compared with one of them;
only where a bucket still holds several components are the others compared,
in blocks, and large buckets (of texts that share a passage, mostly) are first
divided by the rarest symbols of their texts, without loss.  Components then come from label propagation over
written tables.  Keys, classes and hubs with a large share of the rows are joined
by broadcasting their few rows of the other side.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import combinations, count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .store import hot_keys, joined, whole_row, workspace, written
from .tokens import batches, texts_of

WORDS, LEAST = 5, 0.8
#: Long texts with similarity 0.8 share all of a tuple with probability 0.8**4: missed by all 24 with 3e-6.  Short ones share it less
#: often, as symbols are drawn without replacement: 8 of 10 shingles are missed with 6e-5, which is the worst; 4 of 5 and 5 of 6 never are.
HASHES, TUPLE = 24, 4
#: A task compares at most about so many texts of a bucket, of so many shingles in all, with as many others.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Buckets of more texts than this are divided by shared symbols, which loses no link: dividing copies a text up to once for every
#: fifth of its shingles, comparing it in blocks once for each block, so that pays only from many blocks on.
LARGE = 64 * BLOCK
#: Copies of the symbols of a text that very many others are compared with.
SALTS = 64
#: Hashes of words that a task keeps.
WORDS_KEPT = 200_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class Shingles:
    """Labelled shingles of texts; keeps the hashes of the words it has met."""

    def __init__(self, words: int = WORDS):
        self.words, self._known = words, {}

    def symbols(self, parts: list[bytes]) -> np.ndarray:
        """One 64-bit symbol for each shingle, in order; a text with fewer words is one shingle; one without words has none."""
        if not parts:
            return np.empty(0, np.uint64)
        known = self._known
        ids = list(map(known.get, parts))
        if None in ids:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in set(parts).difference(known):
                known[w] = _hash(w)
            ids = list(map(known.__getitem__, parts))
        h = np.array(ids, np.uint64)
        size = min(self.words, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = _mix(out * _M1 + h[k : k + n])
        order = np.argsort(out, kind="stable")
        ranked = out[order]
        again = np.flatnonzero(ranked[1:] == ranked[:-1])
        if len(again):  # number the occurrences of each
            first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            label = np.empty(n, np.uint64)
            label[order] = (np.arange(n) - begin).astype(np.uint64)
            out = np.where(label > 0, _mix(out + label * _M1), out)
        return out


def _keys_of(tuples: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A key for each row of symbols."""
    key = np.full(len(tuples), seed)
    for k in range(tuples.shape[1]):
        key = _mix(key * _M1 + tuples[:, k])
    return key


def sketch(symbols: np.ndarray, hashes: int = HASHES, size: int = TUPLE, seed: int = 1) -> np.ndarray:
    """The distinct keys of a text: for each order, of its ``size`` least symbols in text order.

    A text of ``size`` symbols or fewer has the one key of all of them, and one
    with one or two more has those of all its ``size``-tuples: any two such texts
    that may be similar share one."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    seeds = _mix(np.arange(seed, seed + hashes, dtype=np.uint64) * _M1)
    if n <= size:
        return _keys_of(symbols[None, :], seeds[0]).astype(np.int64)
    every = _keys_of(symbols[np.array(list(combinations(range(n), size)))], seeds[0]) if n <= size + 2 else np.empty(0, np.uint64)
    if n == size + 1:
        return np.unique(every).astype(np.int64)
    rows = max(1, (1 << 20) // n)
    keys = np.empty(hashes, np.uint64)
    for a in range(0, hashes, rows):
        s = seeds[a : a + rows, None]
        ranks = (symbols[None, :] ^ s) * _M2
        ranks ^= ranks >> _S31
        ranks *= _M3
        at = np.sort(np.argpartition(ranks, size - 1, axis=1)[:, :size], axis=1)
        key = s[:, 0].copy()
        for k in range(size):
            key = _mix(key * _M1 + symbols[at[:, k]])
        keys[a : a + rows] = key
    return np.unique(np.concatenate((keys, every))).astype(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> int:
    """How many symbols align in order inside the band: all of them if the similarity reaches ``least``.  With 0 there is no band."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0
    same = min(n, m)
    if n == m and (a == b).all():
        return n
    # equal ends first: all matches there are in some best chain
    short = a[:same] == b[:same]
    head = int(np.argmin(short)) if not short.all() else same
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    tail = 0
    if same:
        short = a[::-1][:same] == b[::-1][:same]
        tail = int(np.argmin(short)) if not short.all() else same
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    # similarity >= least leaves at most (1 - least) / (1 + least) * (n + m) symbols unaligned: the band
    band = int((1 - least) / (1 + least) * (n + m) + 1e-9)
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    at = np.searchsorted(ranked, a)
    at[at == len(ranked)] = 0
    hit = ranked[at] == a
    i = np.flatnonzero(hit)
    j = order[at[i]]
    j = j[np.abs(j - i) <= band]
    best: list[int] = []
    for x in j.tolist():
        k = bisect_left(best, x)
        if k == len(best):
            best.append(x)
        else:
            best[k] = x
    return head + tail + len(best)


def similar(a: int, n: int, m: int, least: float = LEAST) -> bool:
    """Whether a / (n + m - a) >= least, up to rounding."""
    return a + 1e-9 >= least * (n + m - a)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): t1 and t2 tell the texts of a doc_id's rows apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def sketch_rows(docs: DataFrame, hashes: int, size: int) -> DataFrame:
    """(doc_id, t1, t2, content, n, keys): content is the same for texts with the same words."""

    def run(parts):
        import pyarrow as pa

        shingles = Shingles()
        for batch in parts:
            texts = texts_of(batch.column(3))
            for first, stop in batches(texts, 1 << 22):
                content, n, keys = [], [], []
                for text in texts.slice(first, stop - first).to_pylist():
                    words = _words(text)
                    symbols = shingles.symbols(words)
                    content.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    n.append(len(symbols))
                    keys.append(sketch(symbols, hashes, size))
                rows = batch.slice(first, stop - first)
                yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), pa.array(content, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t1", "t2", "content", "n", "keys"])

    return _rows(docs).mapInArrow(run, "doc_id long, t1 long, t2 long, content binary, n long, keys array<long>")


def _sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, symbols) for the texts in ``wanted`` (rep, doc_id, t1, t2): one row of each."""

    def run(parts):
        import pyarrow as pa

        shingles = Shingles()
        for batch in parts:
            texts = texts_of(batch.column(1))
            for first, stop in batches(texts, 1 << 22):
                out = [shingles.symbols(_words(text)).tobytes() for text in texts.slice(first, stop - first).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(first, stop - first), pa.array(out, pa.binary())], names=["rep", "symbols"])

    rows, keys = _rows(docs), wanted.select("rep", *[F.col(c).alias(f"_{c}") for c in ("doc_id", "t1", "t2")])
    found = keys.join(rows, keys["_doc_id"].eqNullSafe(rows["doc_id"]) & (keys["_t1"] == rows["t1"]) & (keys["_t2"] == rows["t2"])).select("rep", "text")
    return found.mapInArrow(run, "rep long, symbols binary").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, sequences: DataFrame, least: float, folder: str) -> DataFrame:
    """(a, b, distance, linked) for (a, b): unaligned symbols (where the band doesn't hold, without one), and whether they are similar.

    Texts ``b`` in very many pairs have their symbols in SALTS tasks."""

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            linked, far = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                n = aligned(x, y, least)
                linked.append(similar(n, len(x), len(y), least))
                far.append(len(x) + len(y) - 2 * (n if linked[-1] else aligned(x, y, 0.0)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(far, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "distance", "linked"])

    hot = F.broadcast(hot_keys(pairs, "b", folder, "hubs").withColumn("_hot", F.lit(True)))
    salted = pairs.join(hot, "b", "left").select("a", "b", F.when(F.col("_hot"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    one = sequences.select(F.col("rep").alias("a"), F.col("symbols").alias("x"))
    two = sequences.select(F.col("rep").alias("b"), F.col("symbols").alias("y")).join(hot, "b", "left").select("b", "y", F.explode(copies).alias("salt"))
    return salted.join(one, "a").join(two, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long, distance long, linked boolean")


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(rep, label) for every end of a link (a, b): the least rep of its component.

    Each round a node takes the least label of its neighbours and then the label
    of that label's node, so long chains shrink by more than half each time.
    Each round is written down: nothing is lost with an executor."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, folder, f"{name}-links")
    hubs = hot_keys(both, "b", folder, f"{name}-hubs")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "rep"), folder, f"{name}-0")
    for k in count(1):
        offered = joined(both, labels.withColumnRenamed("rep", "b"), "b", hubs).groupBy("a").agg(F.min("label").alias("offer"))
        mine = labels.join(offered, labels["rep"] == offered["a"]).select("rep", F.least("label", "offer").alias("near"), F.col("label").alias("was"))
        mine = written(mine, folder, f"{name}-{k}-near")
        up = labels.select(F.col("rep").alias("near"), F.col("label").alias("far"))
        up = joined(mine, up, "near", hot_keys(mine, "near", folder, f"{name}-{k}-hot"))
        labels = written(up.select("rep", F.least("near", "far").alias("label"), "was"), folder, f"{name}-{k}")
        if labels.filter("label <> was").isEmpty():
            return labels.select("rep", "label")
        labels = labels.select("rep", "label")


def _by_key(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with a ``table`` of a row for each key; both have ``hot``, and rows of hot keys stay where they are."""
    warm = rows.filter("hot").join(F.broadcast(table.filter("hot").drop("hot")), "key")  # HOT_SHARE rows at most
    return rows.filter("NOT hot").join(table.filter("NOT hot").drop("hot"), "key").unionByName(warm)


def _divided(held: DataFrame, sequences: DataFrame, least: float, folder: str) -> DataFrame:
    """``held`` with the texts of each large bucket dealt out to buckets of a symbol each; similar texts of a bucket still meet.

    Similar texts share at least ``least * n`` symbols of either's ``n``.  So in any order of all symbols, the first one that
    both have has at least so many of either text's symbols from it on, and only a text's first ones need be looked at.  Those
    of one component alone come first in the order and join nothing; then comes what few texts have, and a passage last."""
    sizes = written(held.groupBy("key", "hot").agg((F.count(F.lit(1)) > LARGE).alias("_large")), folder, "large")
    if sizes.filter("_large").isEmpty():
        return held

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            lengths = np.array([len(v.as_buffer()) // 8 for v in batch.column(2)], np.int64)
            for first, stop in batches(batch.column(2), 1 << 22):
                reps, labels = (np.repeat(batch.column(c).to_numpy()[first:stop], lengths[first:stop]) for c in (0, 1))
                symbols = np.frombuffer(b"".join(batch.column(2).slice(first, stop - first).to_pylist()), np.int64)
                yield pa.record_batch([pa.array(reps), pa.array(labels), pa.array(symbols)], names=["rep", "label", "symbol"])

    marked = written(_by_key(held, sizes), folder, "marked")
    mine = marked.filter("_large").drop("_large")
    texts = written(mine.groupBy("rep").agg(F.first("label").alias("label"), F.first("n").alias("n")), folder, "large-texts")
    symbols = texts.join(sequences, "rep").select("rep", "label", "symbols").mapInArrow(run, "rep long, label long, symbol long")
    spread = symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("texts"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    spread = written(spread.filter("_low < _high").select("symbol", "texts"), folder, "symbols")
    total = texts.agg(F.sum("n")).first()[0]
    often = spread.filter(F.col("texts") >= max(store.LEAST_HOT, -(-total // store.HOT_SHARE))).select("symbol")
    shared = joined(symbols.drop("label"), spread, "symbol", often)
    ranked = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("texts", "symbol"))).alias("_ranked"))
    first = F.slice("_ranked", F.lit(1), F.greatest(F.size("_ranked") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-6)).cast("int") + 1, F.lit(0)))
    finer = mine.join(ranked, "rep").withColumn("_first", F.explode(first)).withColumn("key", F.xxhash64("key", "_first.symbol"))
    finer = written(finer.select("key", "rep", "label", "n", "low", "high"), folder, "finer")
    hot = F.broadcast(hot_keys(finer, "key", folder, "hot-finer").withColumn("_hot", F.lit(True)))
    finer = finer.join(hot, "key", "left").withColumn("hot", F.coalesce("_hot", F.lit(False)))
    held = marked.filter("NOT _large").select(*held.columns).unionByName(finer.select(*held.columns))
    return _mixed(written(held, folder, "divided"), folder, "divided")


def _mixed(held: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of the buckets that hold several components."""
    several = held.groupBy("key", "hot").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("key", "hot")
    return written(_by_key(held, several), folder, f"{name}-rows")


def _within(held: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between texts of different components of a bucket, a spanning set for each block.

    ``held``: (key, hot, rep, label, n, low, high), bounds of the distance to the bucket's leader.  A
    bucket's texts go into blocks; every two blocks meet in one task."""
    size = held.groupBy("key", "hot").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = _by_key(held, size)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    rows = rows.withColumn("at", F.explode(met)).select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "rep", "label", "n", "low", "high", "mine")
    rows = rows.join(sequences, "rep")

    def run(table):
        import pyarrow as pa

        reps, labels, ns, low, high = (table.column(c).to_pylist() for c in ("rep", "label", "n", "low", "high"))
        mine, i, j = table.column("mine").to_pylist(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        seqs = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("symbols").combine_chunks()] if len(reps) else []
        sets = [np.sort(s) for s in seqs]
        top: dict[int, int] = {}

        def root(x):
            while top.get(x, x) != x:
                x = top[x]
            return x

        links: list[tuple[int, int]] = []
        for p in range(len(reps)):
            for q in range(p):
                if i != j and mine[p] == mine[q] or root(labels[p]) == root(labels[q]):
                    continue
                room = (1 - least) / (1 + least) * (ns[p] + ns[q]) + 1e-9
                if abs(ns[p] - ns[q]) > room or low[p] - high[q] > room or low[q] - high[p] > room:
                    continue
                x, y = sets[p], sets[q]
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                if not similar(int((x[at] == y).sum()), ns[p], ns[q], least):
                    continue
                if similar(aligned(seqs[p], seqs[q], least), ns[p], ns[q], least):
                    links.append((reps[p], reps[q]))
                    top[root(labels[p])] = root(labels[q])
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _classified(docs: DataFrame, least: float, hashes: int, size: int) -> DataFrame:
    """(doc_id, t1, t2, class_id, class_size, kept) for every row."""
    folder = workspace(docs.sparkSession, "near")
    rows = written(sketch_rows(docs, hashes, size), folder, "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t1", "t2"))
    texts = rows.filter("n > 0").groupBy("content").agg(first.alias("_first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    texts = texts.select("content", F.col("_first.doc_id").alias("doc_id"), F.col("_first.t1").alias("t1"), F.col("_first.t2").alias("t2"), "n", "keys", "copies")
    texts = written(texts.withColumn("rep", F.monotonically_increasing_id()), folder, "texts")  # written: the numbers stay

    keyed = texts.select("rep", "n", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), folder, "shared")
    total = texts.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    hot = F.col("size") >= max(store.LEAST_HOT, -(-total // store.HOT_SHARE))  # HOT_SHARE keys at most
    held = written(keyed.join(shared.withColumn("hot", hot), "key"), folder, "buckets")
    degree = held.groupBy("rep").agg(F.sum("size").alias("degree"))
    leader = held.join(degree, "rep").groupBy("key", "hot").agg(F.max_by(F.struct("rep", "n"), F.struct("degree", -F.col("rep"))).alias("_leader"))
    leader = written(leader.select("key", "hot", F.col("_leader.rep").alias("leader"), F.col("_leader.n").alias("leader_n")), folder, "leaders")
    led = written(_by_key(held, leader).select("key", "hot", "rep", "n", "leader", "leader_n"), folder, "led")
    near_enough = F.least("n", "leader_n") >= F.lit(least) * F.greatest("n", "leader_n") - 1e-9
    pairs = written(led.filter(F.col("rep") != F.col("leader")).filter(near_enough).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), folder, "pairs")

    wanted = held.select("rep").distinct().join(texts.select("rep", "doc_id", "t1", "t2"), "rep")
    sequences = written(_sequences(docs, wanted), folder, "sequences")
    checked = written(_verified(pairs, sequences, least, folder), folder, "checked")
    links = checked.filter("linked").select("a", "b")
    labels = components(links, folder, "first")

    # buckets that still hold several components; what is too near the leader to reach one of another component stays out
    known = checked.select(F.col("a").alias("rep"), F.col("b").alias("leader"), "distance")
    now = written(led.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), folder, "now")
    split = now.groupBy("key", "hot").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.max(F.when(F.col("rep") == F.col("leader"), F.col("label"))).alias("_main")).filter("_low < _high").select("key", "hot", "_main")
    open_ = _by_key(now, written(split, folder, "split")).filter("rep <> leader").join(known, ["rep", "leader"], "left")
    low = F.coalesce("distance", F.abs(F.col("n") - F.col("leader_n")))
    high = F.coalesce("distance", F.col("n") + F.col("leader_n"))
    open_ = written(open_.select("key", "hot", "rep", "label", "n", low.alias("low"), high.alias("high"), (F.col("label") != F.col("_main")).alias("_apart")), folder, "open")
    share = (1 - least) / (1 + least)
    reach = written(open_.filter("_apart").groupBy("key", "hot").agg(F.min(F.col("low") - F.col("n") * share).alias("_reach")), folder, "reach")
    open_ = _by_key(open_, reach).filter(F.col("_apart") | (F.col("high") + F.col("n") * share + 1e-6 >= F.col("_reach")))
    open_ = written(open_.select("key", "hot", "rep", "label", "n", "low", "high"), folder, "within")
    open_ = _divided(_mixed(open_, folder, "mixed"), sequences, least, folder)
    more = written(_within(open_, sequences, least), folder, "more")
    if not more.isEmpty():
        labels = components(links.unionByName(more), folder, "second")

    members = texts.select("rep", "content", "copies", "doc_id", "t1", "t2").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    members = written(members.drop("rep"), folder, "members")
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t1", "t2")).alias("_w")
    found = written(members.groupBy("label").agg(winner, F.sum("copies").alias("class_size")), folder, "classes")
    classes = joined(members.select("content", "label"), found, "label", hot_keys(members, "label", folder, "hot-classes")).drop("label")
    worded = rows.filter("n > 0").select("doc_id", "t1", "t2", "content")
    named = joined(worded, written(classes, folder, "contents"), "content", hot_keys(worded, "content", folder, "hot-contents"))
    kept = F.col("doc_id").eqNullSafe(F.col("_w.doc_id")) & (F.col("t1") == F.col("_w.t1")) & (F.col("t2") == F.col("_w.t2"))
    named = named.select("doc_id", "t1", "t2", F.col("_w.doc_id").alias("class_id"), "class_size", kept.alias("kept"))
    alone = rows.filter("n = 0").select("doc_id", "t1", "t2", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return written(named.unionByName(alone), folder, "named")


def near_duplicates(docs: DataFrame, least: float = LEAST, hashes: int = HASHES, size: int = TUPLE) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for every row of ``docs``.

    Texts with the same words in the same order, and texts with links to each
    other, directly or through others, are one class; class_id is its least
    doc_id (null only if all are).  One row of a class is kept, that with the
    least doc_id, and of rows that share it that with the least hash of its text;
    rows with the same doc_id and text are alike and all marked.  Null and empty
    texts, and texts of white space alone, have no shingles: each is a class of
    its own.  Other columns aren't read."""
    return _classified(docs, least, hashes, size).select("doc_id", "class_id", "class_size", "kept")


def one_of_each(docs: DataFrame, least: float = LEAST, hashes: int = HASHES, size: int = TUPLE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns: one of each class, whether or not its doc_id is null or
    shared with rows of other classes; of rows alike in doc_id and text any.  Rows without words all stay."""
    folder = workspace(docs.sparkSession, "one")
    named = _classified(docs, least, hashes, size).filter("class_size > 1")
    gone = named.filter("NOT kept").select("doc_id", "t1", "t2").distinct()
    twins = named.filter("kept").groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    status = written(gone.withColumn("gone", F.lit(True)).unionByName(twins.withColumn("gone", F.lit(False))), folder, "status")
    text = F.col("text").cast("string")
    keyed = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"))

    def on(table):
        return keyed["_i"].eqNullSafe(table["doc_id"]) & (keyed["_a"] == table["t1"]) & (keyed["_b"] == table["t2"])

    out = keyed.join(status, on(status), "left_anti")
    some = status.filter("NOT gone")
    if not some.isEmpty():
        out = out.unionByName(keyed.join(some, on(some), "left_semi").dropDuplicates(["_i", "_a", "_b"]))
    return out.select("_row.*")
