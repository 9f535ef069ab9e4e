import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from carteel.llm import packing, rans, tokens


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "bare")])
def test_chunks_equal_whole_texts(name, kind):
    tok = tokens.ChunkTokenizer.shared(name, kind, "<u2")

    @given(st.lists(st.text(alphabet=st.sampled_from(list("ab Zé'.!0 \n\t<|>ÀΣς中́ sİﬁ²½\x1c _-")) | st.characters(), max_size=40), max_size=6))
    @settings(max_examples=200, deadline=None)
    def same(texts):
        texts = [t.encode("utf-8", "ignore").decode() for t in texts]
        assert tok.encode(texts) == [tok.whole(t) for t in texts]

    same()
    assert tok.encode(["<|endoftext|> it's  we'LL\n\n x ", "", " ", "don't 12 3a"]) == [tok.whole(t) for t in ["<|endoftext|> it's  we'LL\n\n x ", "", " ", "don't 12 3a"]]


@given(st.integers(0, 400), st.integers(1, 5), st.integers(1, 16), st.integers(1, 9), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(n, lanes, steps, every, seed):
    layout = rans.Layout(lanes, steps, every, 3)
    ids = (np.random.default_rng(seed).zipf(1.5, n) % 300).astype(np.uint16)
    table = rans.Table.load(rans.Table(np.bincount(ids, minlength=300)).dump())
    assert table.freq.sum() in (0, 1 << 16)
    got = rans.decode_blocks(rans.encode_blocks(ids, table, layout), table, layout)
    assert (np.concatenate(got) if got else ids).tolist() == ids.tolist()


def test_many_rare_symbols_fit():
    counts = np.ones(50_000, np.int64)
    counts[7] = 10**9
    table = rans.Table(counts)
    assert table.freq.min() == 1 and table.freq.sum() == 1 << 16
    ids = np.arange(50_000, dtype=np.uint16)
    got = rans.decode_blocks(rans.encode_blocks(ids, table, rans.Layout()), table, rans.Layout())
    assert (np.concatenate(got) == ids).all()


def test_more_ids_than_slots():
    """A vocabulary of 200,000 ids that all occur: the rare ones are written beside."""
    draw = np.random.default_rng(1)
    ids = np.concatenate((np.arange(200_000), draw.integers(0, 100, 300_000))).astype(np.uint32)
    draw.shuffle(ids)
    table = rans.Table.load(rans.Table(np.bincount(ids)).dump())
    blocks = rans.encode_blocks(ids, table, rans.Layout())
    assert (np.concatenate(rans.decode_blocks(blocks, table, rans.Layout())) == ids).all()
    assert sum(map(len, blocks)) < 4 * len(ids)
    few = np.array([199_999, 5, 5, 70_000], np.uint32)
    table = rans.Table(np.bincount(few))
    assert (rans.decode_blocks(rans.encode_blocks(few, table, rans.Layout()), table, rans.Layout())[0] == few).all()


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint16) % 97
    table = rans.Table(np.bincount(ids))
    (block,) = rans.encode_blocks(ids, table, rans.Layout())
    bad = bytearray(block)
    bad[len(bad) // 2] ^= 255
    with pytest.raises(ValueError):
        rans.decode_blocks([bytes(bad)], table, rans.Layout())


def test_ranges_of_a_file(tmp_path):
    draw = np.random.default_rng(5)
    docs = [(i, draw.integers(0, 50, draw.integers(1, 400)).astype(np.uint16)) for i in range(60)]
    everything = np.concatenate([d for _, d in docs])
    table, layout = rans.Table(np.bincount(everything)), rans.Layout(4, 16, 4, 2)
    path, told = tmp_path / "x.rans", {}
    path.write_bytes(b"".join(rans.file_chunks(iter(docs), table, layout, told)))
    assert told == {"n_docs": 60, "n_tokens": len(everything)}
    with rans.IdFile(str(path), table) as f:
        assert [(i, d.tolist()) for i, d in f.documents()] == [(i, d.tolist()) for i, d in docs]
        for start, length in [(0, 1), (63, 2), (100, 1000), (len(everything) - 5, 5), (10, 0)]:
            assert f.ids(start, length).tolist() == everything[start : start + length].tolist()


def encoded(name, text, end):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_corpus_comes_back(spark, docs, clashing):
    for table in (docs, clashing):
        got = sorted(map(tuple, rans.encode_corpus(table).collect()), key=lambda r: r[1])
        rows = [(r.doc_id, encoded("byte_bpe_50k.json", r.text, 2)) for r in docs.collect()]
        assert sorted((r[0] is not None, r[0] or 0, r[3]) for r in got) == sorted((i is not None, i or 0, crc(d)) for i, d in rows)
        assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
        assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])))[:-1].tolist()
    assert rans.encode_corpus(docs.limit(0)).count() == 0


def padded(n, size):
    return 0 if n & (n - 1) == 0 else size - n


def brute(cuts, cost, size):
    places, best = [0, *cuts], {0: 0.0}
    for j in range(1, len(places)):
        best[j] = min(best[i] + padded(places[j] - places[i], size) for i in range(j) if places[j] - places[i] <= size) + cost[j - 1]
    return best[len(places) - 1]


@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 4.0, 64.0])), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_windows_are_the_cheapest(steps):
    cuts, cost, size = np.cumsum([s for s, _ in steps]), np.array([c for _, c in steps]), 16
    ends = packing.cut_windows(cuts, cost, size)
    price = dict(zip(cuts.tolist(), cost.tolist()))
    begin = [0, *ends[:-1]]
    assert ends[-1] == cuts[-1] and all(0 < b - a <= size for a, b in zip(begin, ends))
    assert sum(padded(b - a, size) + price[b] for a, b in zip(begin, ends)) == pytest.approx(brute(cuts.tolist(), cost.tolist(), size))


def test_pieces_cover_every_id(spark, docs, clashing):
    want = sorted(((r.doc_id is not None, r.doc_id or 0), encoded("word_bpe_49k.json", r.text, 1)) for r in docs.collect())
    for table, span in ((docs, packing.SPAN), (clashing, 50)):
        rows = packing.pack(table, span=span).collect()
        whole = {}
        for r in rows:
            whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert sum(r.length for r in rows) == sum(len(d) for _, d in want)
        for _, d in want:
            key = next(k for k in whole if k[1] == len(d))
            pieces = sorted((p.start, p.length, p.ids_crc32) for p in whole[key])
            assert {(s, n, crc(d[s : s + n])) for s, n, _ in pieces if key[0] is not None} >= set() and sum(n for _, n, _ in pieces) % len(d) == 0
        sequences = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == np.concatenate(([0], np.cumsum([n for _, n in parts])))[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert sum(r.length for r in packing.pack(docs, stored=True).collect()) == sum(len(d) for _, d in want)
    long = [r for r in packing.pack(docs).collect() if r.doc_id == 6]
    d = encoded("word_bpe_49k.json", "word " * 30_000, 1)
    assert all(r.ids_crc32 == crc(d[r.start : r.start + r.length]) for r in long) and len(long) > 10
    assert packing.pack(docs.limit(0)).count() == 0


def test_stored_order_is_kept(spark, tmp_path):
    """Pieces follow each other as the files' rows do, copies and all."""
    rows = [(i * 7 % 40, f"text {i % 40} " * (1 + i % 9)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = packing.pack(table.coalesce(1), stored=True).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in got if r.start == 0] == [i for i, _ in rows]
