import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from carteel.llm import language, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    often, covered = Counter(windows), set()
    for i, g in enumerate(windows):
        if often[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts(spark, docs):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["a", "b", "é#", "c|"]) + draw.choice(["", "\n", "\t"]) for _ in range(draw.randint(0, 60))) for _ in range(60)]
    texts += ["", " ", "a", "a b", "a b c", "a b c a b c", "x\nx\nx", "\n\n", "a b \x1c", *[r.text for r in docs.collect() if r.text]]
    rows = quality.with_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [counted(t) for t in texts]


def prose(draw, n=120):
    return " ".join(draw.choice(["the", "of", "and", "to", "wood", "river", "stone", "house", "runs", "sleeps", "green", "old"]) + draw.choice(["", "", ".", ","]) + draw.choice(["", str(draw.randint(0, 99))]) for _ in range(n))


def test_verdict(spark):
    draw = random.Random(1)
    rows = []
    for i in range(80):
        text = prose(draw, 400)
        if i % 4 == 0:
            text = " ".join(w + draw.choice(["###", "$$$", "&&&"]) for w in text.split())
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 80, 1) if i % 3], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(df, marks).collect()}
    assert all(got[i].kept == (i % 4 > 0) for i in range(80) if not got[i].base_failed) and sum(r.kept for r in got.values()) > 40
    again = {r.doc_id: r.score for r in quality.judge(df.repartition(5), marks).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})
    none = quality.judge(df, marks.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_every_trusted_document_counts(spark):
    """More than 5,000 of them: all are in the ratio or in the threshold."""
    draw = random.Random(5)
    df = spark.createDataFrame([(i, " ".join(draw.choice("abcdefgh") + str(draw.randint(0, 9)) for _ in range(60))) for i in range(5600)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 20 > 0)) for i in range(5600)], "doc_id long, quality int")
    fit = {r[0]: r[1] for r in quality.trusted_ids(marks).collect()}
    assert sorted(fit) == [i for i in range(5600) if i % 20] and 2500 < sum(fit.values()) < 2800
    got = quality.judge(df, marks).collect()
    mid, low = np.percentile([r.score for r in got if not fit.get(r.doc_id, True) and not r.base_failed], [50, 100 * quality.LOW])
    assert len({r.threshold for r in got}) == 1 and got[0].threshold == pytest.approx(mid - quality.SPREAD * (mid - low))
    good, raw = Counter(), Counter()
    for r in df.select("doc_id", quality.ngram_buckets(df["text"]).alias("b")).collect():
        raw.update(r.b)
        good.update(r.b if fit.get(r.doc_id) else ())
    n, m = raw.total(), good.total()
    ratio = {b: math.log((good[b] + quality.SMOOTHING * raw[b] / n) / (m + quality.SMOOTHING) / (raw[b] / n)) for b in raw}
    for r in df.filter("doc_id < 40").select("doc_id", quality.ngram_buckets(df["text"]).alias("b")).collect():
        assert next(x.score for x in got if x.doc_id == r.doc_id) == pytest.approx(np.mean([ratio[b] for b in r.b]))


@pytest.mark.parametrize("values", [[], [2.5], [1.0, -4.0], [3.0] * 40, [k % 7 / 3 for k in range(333)]])
def test_percentiles(spark, tmp_path, values):
    rows = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = quality.percentiles(rows, "x", [0.0, 0.01, 0.5, 0.77, 1.0], f"file://{tmp_path}")
    assert got == (pytest.approx(list(np.percentile(values, [0, 1, 50, 77, 100]))) if values else None)


def test_ngrams_ignore_case(spark):
    row = spark.createDataFrame([("Een ÉTÉ, two THREE!", "een été, two three!")], "x string, y string")
    assert row.select(quality.ngram_buckets(row["x"]) == quality.ngram_buckets(row["y"])).first()[0]


def test_quality_of_awkward_rows(docs, clashing, spark):
    marks = spark.createDataFrame([(1, 1), (None, 1), (2, None), (1, 1)], "doc_id long, quality int")
    for table in (docs, clashing):
        got = quality.judge(table, marks).collect()
        assert len(got) == docs.count() and all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert quality.judge(docs.limit(0), marks).count() == 0
    plan = quality.judge(docs, marks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


BAD = ["vile", "rotten"]


def spoken(draw, toxic):
    lines = [" ".join(draw.choice(["we", "see", "a", "bird", "in", "the", "tree", "today", "again"]) for _ in range(7)) for _ in range(draw.randint(3, 15))]
    if toxic:
        k = draw.randrange(len(lines))
        lines[k] += " " + draw.choice(BAD)
    return ". ".join(lines) + "."


def test_toxicity_learns_and_locates():
    draw = random.Random(2)
    rows = [(spoken(draw, i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    model, again = (toxicity.learn(rows) for _ in range(2))
    assert model.weights == again.weights
    test = [(spoken(draw, i % 2), i % 2) for i in range(100)]
    assert np.mean([(model.score(t) >= 0.5) == bool(y) for t, y in test]) > 0.95
    text = "We see a bird. You are vile today.\nThe tree again!"
    (found,) = model.locate(text)
    assert text[found[0] : found[1]].strip() == "You are vile today."
    parts = [text[a:b] for a, b in toxicity.sentences(text)]
    odds = [model.base + sum(model.weights.get(f, 0) for w in set(toxicity.WORD.findall(p.lower())) for f in toxicity.features(w)) for p in parts]
    brute = 1 - (1 - model.leak) * math.prod(1 - 1 / (1 + math.exp(-z)) for z in odds if z >= toxicity.NOTHING)
    assert model.score(text) == pytest.approx(brute)
    assert model.score(None) == model.score("") == pytest.approx(model.leak) and model.locate(None) == []


def test_toxicity_without_labels():
    assert toxicity.learn([]).score("x") == 0.0 and toxicity.learn([("a", 1), ("b", 1)]).score("x") == 1.0


def test_length_alone_is_not_toxic(spark):
    draw = random.Random(2)
    model = toxicity.learn([(spoken(draw, i % 5 == 0), int(i % 5 == 0)) for i in range(400)])
    assert toxicity.Model({}, 0.01).score("a bird. " * 100_000) == pytest.approx(0.01)
    book = " ".join(spoken(draw, False) for _ in range(11_000))
    assert len(toxicity.bags(book)) > 90_000 and model.score(book) == pytest.approx(model.leak)
    assert model.score(book + " you are vile.") >= 0.5
    rows = spark.createDataFrame([(1, book), (2, "you are vile")], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.clean_documents(rows, model).select("doc_id").collect()] == [1]


def test_toxicity_over_rows(spark, docs, clashing):
    draw = random.Random(2)
    model = toxicity.learn([(spoken(draw, i % 5 == 0), int(i % 5 == 0)) for i in range(300)])
    for table in (docs, clashing):
        assert toxicity.score_documents(table, model).count() == docs.count()
        clean = toxicity.clean_documents(table, model)
        assert clean.schema == table.schema and clean.count() == docs.count()
    bad = spark.createDataFrame([(1, "you are vile"), (2, "a bird"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.clean_documents(bad, model).orderBy("doc_id").collect()] == [2, 3]
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, 1, None), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert {y for _, y in toxicity.sample(docs, marks)} <= {0, 1}


def segmentations(text, table, k):
    """The sum over all ways to cut ``text``, one by one."""
    if not text:
        return 1.0
    total = 0.0
    for i in range(1, len(text) + 1):
        p = table[text[:i]][k] if text[:i] in table else language.UNKNOWN if i == 1 else 0.0
        total += p * segmentations(text[i:], table, k) if p else 0.0
    return total


def test_forward_sums_all_segmentations():
    draw = random.Random(3)
    vocabulary = list(dict.fromkeys([*"abc", language.MARK, "ab", "bc", "abc", "ca", language.MARK + "a", "cab"]))
    model = language.learn([("x", "abc cab abcabc bca"), ("y", "cacaca ccc a b")], vocabulary)
    words = ["".join(draw.choice("abcz") for _ in range(draw.randint(1, 9))) for _ in range(40)]
    scorer = language.Scorer(model)
    got = scorer.scores(words)
    for w, row in zip(words, got):
        want = [math.log(segmentations(language.MARK + w, model.table, k)) for k in range(2)]
        assert model.log_probability(w) == pytest.approx(want) and row.tolist() == pytest.approx(want)
    assert (scorer.scores(words + words)[40:] == got).all()
    long = "abc" * 200
    assert scorer.scores([long])[0].tolist() == pytest.approx(model.log_probability(long))
    for k in range(2):
        assert sum(p[k] for p in model.table.values()) == pytest.approx(1.0)


def test_language_of_texts():
    rows = [("en", "the house and the river are green " * 3), ("de", "das haus und der fluss sind grün " * 3)]
    model = language.learn(rows, language.pieces())
    lang, score = language.Scorer(model).predict(pa.array(["the green river", "Der Fluss und das Haus!", "", "123 ... ½", "中"]))
    assert lang[:4] == ["en", "de", "und", "und"] and score[2:4] == [0.0, 0.0] and all(0 <= s <= 1 for s in score) and lang[4] in ("en", "de")
    assert language.Scorer(language.learn([], language.pieces())).predict(pa.array(["a"])) == (["und"], [0.0])


def test_long_words_teach():
    """Clauses without spaces: both forms of the expected counts agree, and a language of such clauses is learned."""
    vocabulary = [*"abcd", language.MARK, "ab", "bc", "abc", "dd"]
    number = {p: i for i, p in enumerate(vocabulary)}
    prob = (np.arange(1, len(vocabulary) + 1) / 45).tolist()
    spans = language._spans(language.MARK + "abcddabz", number, 12)
    one, two = [0.0] * len(vocabulary), [0.0] * len(vocabulary)
    language._expect(9, spans, prob, 3, one)
    language._expect_long(9, spans, prob, 3, two)
    assert one == pytest.approx(two)
    model = language.learn([("x", "abc" * 500), ("y", "dda" * 500)], vocabulary)
    assert language.Scorer(model).predict(pa.array(["abcabc", "ddadda"]))[0] == ["x", "y"]


def test_sample_of_languages(spark):
    rows = [(i, f"text number {i} " + "z" * (50_000 if i == 7 else 0), "big" if i % 50 else f"small{i % 4}") for i in range(3000)] + [(9000, "same", "copies")] * 2500 + [(9001, None, "big"), (9002, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(df, 20, 1000).collect()
    count = Counter(r.lang for r in got)
    assert count["big"] == 20 and count["copies"] == 1 and count["small0"] + count["small2"] == 40 and max(len(r.text) for r in got) <= 1000
    assert sorted(got) == sorted(language.sample(df.repartition(5), 20, 1000).collect())
    whole = language.sample(df.filter("doc_id = 7"), 20, 1000).collect()
    assert len(whole) == 1 and len(whole[0].text) == 1000


def test_language_without_labels(spark, docs):
    from pyspark.sql import functions as F

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify_languages(bare).collect()} == {("und", 0.0)}


def test_language_over_rows(docs, clashing):
    for table in (docs, clashing):
        got = language.identify_languages(table).collect()
        assert len(got) == docs.count() and {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
        assert all(not r.held_out for r in got if r.doc_id is None)
    assert language.identify_languages(docs.limit(0)).count() == 0
    one = sorted(map(tuple, language.identify_languages(docs.filter("doc_id is not null")).collect()), key=str)
    assert one == sorted(map(tuple, language.identify_languages(docs.filter("doc_id is not null").repartition(3)).collect()), key=str)
