import bisect
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carteel.llm import exact, near, store


SF = "/root/testdata/sf0.01"


def expected(docs):
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    return sorted(((i is not None, i or 0), max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)


@pytest.mark.parametrize("least_hot", [1, 3, 1000])
def test_exact_groups(docs, clashing, least_hot):
    for table in (docs, clashing):
        for digest in (exact.sha256, lambda t: F.length(t) % 2):
            got = exact.duplicate_groups(table, digest=digest, least_hot=least_hot).collect()
            assert sorted(((r.doc_id is not None, r.doc_id or 0), r.keep_id, r.group_size) for r in got) == expected(docs)
            assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact.duplicate_groups(docs.limit(0)).count() == 0


def test_distinct(docs, clashing, unharmed):
    for table in (docs, clashing):
        for least_hot in (1, 1000):
            kept = exact.distinct_documents(table, least_hot=least_hot)
            assert kept.columns == table.columns
            rows = kept.collect()
            texts = [r.text or "" for r in rows]
            assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
            assert {r.doc_id for r in rows if r.text and r.text.startswith("the quick")} == {8}
    unharmed(exact.distinct_documents(clashing))
    assert exact.distinct_documents(docs.limit(0)).count() == 0 and exact.distinct_documents(docs.select("text", "doc_id")).columns == ["text", "doc_id"]


def test_exact_runs_no_python(docs):
    plan = exact.duplicate_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def chain(a, b):
    at, best = {x: i for i, x in enumerate(b)}, []
    for j in [at[x] for x in a if x in at]:
        k = bisect.bisect_left(best, j)
        best[k : k + 1] = [j]
    return len(best)


@pytest.mark.parametrize("seed", range(40))
def test_alignment(seed):
    draw = random.Random(seed)
    a = list(range(draw.randint(1, 60)))
    b = a[:]
    for _ in range(draw.randint(0, 12)):
        k = draw.randrange(len(b) + 1)
        draw.choice([lambda: b.insert(k, draw.randint(1000, 10**6)), lambda: b.pop(k - 1) if b else 0, lambda: b.sort(key=lambda x: (x + k) % 7)])()
    b = list(dict.fromkeys(b))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    full = chain(a, b)
    assert near.aligned(x, y, 0.0) == full
    assert near.similar(near.aligned(x, y), len(a), len(b)) == near.similar(full, len(a), len(b))


def test_labels_of_repeated_shingles():
    s = near.Shingles()
    got = s.symbols(b"a a a a a a a".split())
    assert len(set(got.tolist())) == 3 and (s.symbols(b"a a a a a a".split()) == got[:2]).all()
    assert len(s.symbols([])) == 0 and len(s.symbols([b"x", b"y"])) == 1
    assert s.symbols([b"x", b"y"])[0] != s.symbols([b"y", b"x"])[0]


def corpus(spark, seed, families=12, size=9):
    draw, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(4000)]
    for _ in range(families):
        root = draw.choices(words, k=draw.randint(6, 160))
        for _ in range(size):
            text = root[:]
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4, 8])):
                text[draw.randrange(len(text))] = draw.choice(words)
            if draw.random() < 0.3:
                del text[: draw.randint(0, 3)]
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def classes(rows):
    s = near.Shingles()
    symbols = {i: s.symbols(t.encode().split()) for i, t in rows}
    top = {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, _), (j, _) in itertools.combinations(rows, 2):
        a, b = symbols[i], symbols[j]
        if near.similar(chain(a.tolist(), b.tolist()), len(a), len(b)):
            top[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("seed,block,large,hot", [(1, 512, 4096, 1000), (2, 3, 4096, 1000), (3, 4, 6, 3)])
def test_classes_equal_all_pairs(spark, monkeypatch, seed, block, large, hot):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "LARGE", large)
    monkeypatch.setattr(store, "LEAST_HOT", hot)
    rows, df = corpus(spark, seed)
    got = near.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Whether a bucket is divided makes no difference: pairs that meet only in the bucket of a passage, by a single key."""
    draw, rows = random.Random(7), []
    shared = [f"p{i}" for i in range(90)]
    for i in range(40):
        own = [f"w{i}-{k}" for k in range(60)]
        other = own[:]
        other[15], other[30] = f"x{i}", f"y{i}"
        other[-draw.randint(1, 6) :] = [f"z{i}"]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(store, "LEAST_HOT", 3)
    got = []
    for large in (1 << 30, 4):
        monkeypatch.setattr(near, "LARGE", large)
        got.append({r.doc_id: r.class_id for r in near.near_duplicates(df, hashes=1, size=1).collect()})
    assert got[0] == got[1] and len(set(got[0].values())) < 70


def test_awkward_rows(spark, docs, clashing, unharmed):
    for table in (docs, clashing):
        got = sorted(((r.doc_id is not None, r.doc_id or 0), r.class_id, r.class_size) for r in near.near_duplicates(table).collect())
        assert len(got) == docs.count()
        of = {}
        for k, c, n in got:
            of.setdefault(k[1], []).append((c, n))
        assert of[1] == of[2] == [(1, 4)] and of[8] == [(1, 4), (1, 4)] and of[3] == [(3, 1)] and of[4] == [(4, 1)] and of[5] == [(5, 1)]
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, None, 9}
    assert near.near_duplicates(docs.limit(0)).count() == 0 and near.near_duplicates(docs.filter("doc_id = 3")).count() == 1
    assert near.one_of_each(clashing).columns == clashing.columns
    unharmed(near.one_of_each(clashing))


def test_short_texts_share_a_key():
    for n in (4, 5):
        a = np.arange(100, 100 + n, dtype=np.uint64)
        for k in range(n + 1):
            assert set(near.sketch(a)) & set(near.sketch(np.insert(a, k, 7)))
    assert len(near.sketch(np.arange(4, dtype=np.uint64))) == 1


def test_rows_that_share_an_id(spark):
    """One row of each class stays, and no other text is lost with it."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base, "a"), (5, "something else that nobody repeats here at all", "b"), (5, base + " more", "c"), (6, "x", "d"), (None, base + " none", "e"), (3, base, "f"), (None, "a text without any id but with words", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_row` string")
    kept = near.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r[1], r[2]) for r in kept.collect())
    assert [t for t, _ in got] == sorted({base, "something else that nobody repeats here at all", "x", "a text without any id but with words"})
    assert dict(got)[base] in "af" and all((t, c) in {(r[1], r[2]) for r in rows} for t, c in got)
    marks = near.near_duplicates(df).collect()
    assert sorted(r.class_size for r in marks) == [1, 1, 1, 4, 4, 4, 4] and sum(r.kept for r in marks) == 5


def test_links_of_a_stated_query_set(spark):
    """Recall against brute force: ids divisible by 50 against all rows of ``documents``."""
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    of = {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()}
    s = near.Shingles()
    symbols = {r.doc_id: s.symbols((r.text or "").encode().split()) for r in docs.collect()}
    sets = {i: set(x.tolist()) for i, x in symbols.items()}
    links = found = 0
    for i in (i for i in symbols if i % 50 == 0):
        for j, y in symbols.items():
            n, m = len(symbols[i]), len(y)
            if i != j and n and m and near.similar(len(sets[i] & sets[j]), n, m) and near.similar(chain(symbols[i].tolist(), y.tolist()), n, m):
                links += 1
                found += of[i] == of[j]
    assert found == links
