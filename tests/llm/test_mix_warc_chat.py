import base64
import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from carteel.llm import chat, mixing, warc
from carteel.llm.store import workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    fixed = {}
    while True:
        left, w = sum(sizes.values()) - sum(fixed.values()), sum(weight[n] for n in names if n not in fixed)
        over = [n for n in names if n not in fixed and left * weight[n] / w > cap * sizes[n]]
        if not over:
            return {n: fixed.get(n, left * weight[n] / w if n not in fixed else 0) for n in names}
        fixed |= {n: cap * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 100, "c": 1000}, {"a": 0, "b": 5, "c": 0, "d": 7}, {"a": 3, "b": 3, "c": 3, "d": 3, "e": 900}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "_key string, source_size long")).collect()
    assert {r._key: r.target for r in got} == pytest.approx(filled(sizes))


def quantile(u, good, bad, drawn):
    low, high = max(0, drawn - bad), min(good, drawn)
    w = [math.comb(good, x) * math.comb(bad, drawn - x) for x in range(low, high + 1)]
    run = 0
    for x, v in zip(range(low, high + 1), w):
        run += v
        if run > Fraction(u) * sum(w):
            return x
    return high


def test_hypergeometric(spark):
    cases = [(u, g, b, n) for u in (1e-9, 0.03, 0.31, 0.503, 0.77, 0.999) for g, b, n in ((5, 5, 5), (0, 10, 4), (10, 0, 4), (3, 7, 10), (30, 70, 40), (400, 900, 650))]
    df = spark.createDataFrame([(float(u), g, b, n) for u, g, b, n in cases], "u double, g long, b long, n long")
    got = [r[0] for r in df.coalesce(1).select(mixing.hypergeometric(F.col("u"), F.col("g"), F.col("b"), F.col("n"))).collect()]
    assert got == [quantile(*c) for c in cases]


def test_tree_keeps_quotas(spark):
    quotas = {"a": 40, "b": 7, "c": 1, "d": 0}
    got = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "_key string, quota long"), 8, 3).collect()
    assert {k: sum(r.quota for r in got if r._key == k) for k in quotas} == quotas
    shards = [sum(r.quota for r in got if r.shard == s) for s in range(8)]
    assert sum(shards) == 48 and max(shards) - min(shards) <= 1


def test_mix_of_a_corpus(spark):
    rows = [(i, "w " * (1 + i * 7919 % 90), "xyz"[i % 3] if i % 10 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.doc_id: r for r in mixing.plan_mix(df).collect()}
    again = {r.doc_id: r for r in mixing.plan_mix(df.repartition(7)).collect()}
    assert {i: (r.taken, r.copies) for i, r in plan.items()} == {i: (r.taken, r.copies) for i, r in again.items()}
    sizes = {}
    for _, t, s in rows:
        sizes[s or "~"] = sizes.get(s or "~", 0) + len(WORD.findall(t))
    want = filled(sizes)
    for s in sizes:
        mine = [plan[i] for i, _, x in rows if (x or "~") == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size and r.taken == r.size * len(r.copies) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 3
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(len(r.copies) for r in plan.values())
    # each shard is one partition, in order of place
    got = {}
    for r in mixed.select(F.spark_partition_id().alias("p"), "doc_id").collect():
        got.setdefault(r.p, []).append(r.doc_id)
    want = {}
    for i, r in plan.items():
        for c in r.copies:
            want.setdefault(c.shard, []).append((c.place, i))
    assert got == {s: [i for _, i in sorted(rows)] for s, rows in want.items()}
    plan_text = mixing.plan_mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan_text and "Arrow" not in plan_text


def test_shards_grow_with_the_mix(spark):
    assert [mixing.shards_for(n, 16, 100) for n in (0, 1600, 1601, 100_000)] == [16, 16, 32, 1024]


def test_mix_of_awkward_rows(docs, clashing, unharmed):
    for table in (docs, clashing):
        plan = mixing.plan_mix(table).collect()
        assert len(plan) == docs.count()
        assert all(r.taken == 0 for r in plan if r.size == 0) and all(r.taken <= 3 * r.size for r in plan)
        rows = mixing.mixed_documents(table)
        assert sum(len(WORD.findall(r.text)) for r in rows.collect()) == sum(r.taken for r in plan)
    unharmed(mixing.mixed_documents(clashing))
    assert mixing.plan_mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.filter("doc_id = 4")).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix_fills_around_a_long_document(spark, seed):
    rows = [(i, "w " * (5 + i % 11), "a") for i in range(1500)] + [(1500 + i, "w " * (9_000 + 1000 * i), "a") for i in range(3)] + [(2000 + i, "w " * 50, "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    plan = mixing.plan_mix(df, weights=(1.0, 3.0), seed=seed).collect()
    for s in ("a", "b"):
        mine = [r for r in plan if (r.doc_id < 2000) == (s == "a")]
        # documents are whole: what is left is less than the smallest (5 or 50 words), and half of that is the nearest one can always come
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= (2.5 if s == "a" else 25)


def test_partial_pass_is_a_greedy_fill(spark):
    draw = random.Random(5)
    sizes = {k: [draw.choice([1, 7, 40, 300, 2000, 9000]) + draw.randrange(20) for _ in range(600)] for k in "abcd"}
    rows, want, extra = [], {}, {}
    for k, ns in sizes.items():
        rest, end, left, got, out = sum(ns) * "abcd".index(k) // 5 + 11, 0, None, set(), []
        left = rest
        for i, n in enumerate(ns):
            end += n
            rows.append((k, i // 50, n, end, rest))
            if n <= left:
                left -= n
                got.add(end)
            else:
                out.append((n, end))
        want[k] = got
        extra[k] = min(out)[1] if min(out)[0] - left < left else None
    df = spark.createDataFrame(rows, "_key string, _block int, size long, _end long, _rest long")
    spans, over = mixing._partial(df, workspace(spark, "test"))
    spans = {r._key: r._spans for r in spans.collect()}
    assert {k: {e for x, _, n, e, _ in rows if x == k and any(s["from"] < e <= s["to"] and n <= s["left"] for s in spans[k])} for k in want} == want
    found = {r._key: r._over for r in over.collect()}
    assert {k: found.get(k) for k in want} == extra


PAGES = "page_id long, url string, html string"


def test_archives(spark):
    rows = [(5, "http://a/x y\r\nz", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (9, None, None), (7, "", ""), (3, "http://c", "z" * 300_000), (4, "http://d", "q"), (4, "http://d", "q")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("offset", F.lit("clash"))
    folder = workspace(spark, "test")
    index = warc.write_archives(pages, folder)
    got = {(r.page_id): r for r in warc.read_archives(index, with_payload=True).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert bytes(got[i].payload) == (data if got[i].record_type == "response" else b"")
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {2: ("response", None), 5: ("revisit", 2), 7: ("response", None), 9: ("revisit", 7), 3: ("response", None), 4: ("response", None)}
    assert got[5].url == "http://a/x%20y%0D%0Az" and warc.read_archives(index).count() == 7
    some = warc.read_archives(index, F.col("url") == "http://c").collect()
    assert [r.page_id for r in some] == [3]
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, folder + "b", least=9)).collect() if r.payload_bytes < 9} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_ranges():
    wanted = [(0, 10), (10, 5), (30, 5), (100, 50)]
    assert list(warc.ranges(wanted, gap=15, most=1000)) == [(0, 35, wanted[:3]), (100, 50, wanted[3:])]
    assert [r[:2] for r in warc.ranges(wanted, gap=1000, most=20)] == [(0, 15), (30, 5), (100, 50)]
    assert list(warc.ranges([])) == []


def test_damaged_record():
    data, _, _ = warc.record(1, "http://a", b"payload", 1)
    assert warc.parse(data)["payload"] == b"payload"
    for bad in (data[:-6], data.replace(b"payload", b"pAyload"), b"junk"):
        with pytest.raises(ValueError):
            warc.parse(bad)


TURNS = "conv_id long, turn long, role string, text string"


def rendered(turns, me):
    out, spans = "", []
    for turn, role, text in sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1] or "unknown", t[2] or "")):
        role = role or "unknown"
        out += "<|assistant|>\n" if role == me else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
        begin = len(out)
        out += (text or "").replace("<|", "< |") + "<|end|>\n"
        if role == me:
            spans.append((begin, len(out)))
    return out, spans


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|assistant|>"), (1, 2, "bob", None), (1, 3, "ann", "é🙂 ok"), (1, 700, "eve", "late"), (2, 0, "system", "alone"), (3, None, None, "?"), (3, 1, "ann", ""), (None, 1, "ann", "x")]
    df = spark.createDataFrame([*turns, (4, 0, "x", "same"), (4, 0, "x", "same")], TURNS).withColumn("part", F.lit("clash"))
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(df).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "eve"), (3, "ann"), (3, "unknown"), (4, "x")}
    for (conv, me, part), r in got.items():
        rows = [*turns, (4, 0, "x", "same"), (4, 0, "x", "same")]
        mine = [t[1:] for t in rows if t[0] == conv and (t[1] // 256 if t[1] is not None else None) == part]
        text, spans = rendered(mine, me)
        assert (r.text, [tuple(s) for s in r.spans]) == (text, spans) and r.n_turns == len(mine) and r.n_own == len(spans)
    assert chat.rotate(df.limit(0)).count() == 0
