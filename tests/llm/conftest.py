import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of every awkward kind: null, empty, white space, very long, repeated, equal ids, a null id."""
    base = "the quick brown fox jumps over the lazy dog and runs into the wood again. "
    rows = [
        (1, base * 3, "en", "a"),
        (2, base * 3, "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", None),
        (6, "word " * 30_000, "en", "a"),
        (7, "été à Noël ½ 中文 <|endoftext|> İ", "fr", "c"),
        (7, "another text under the same id.", "en", "c"),
        (8, base * 3, "en", "a"),
        (8, base * 3, "en", "a"),
        (None, "no id here. But two sentences!", "en", "b"),
        (9, "x", "en", "b"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named as operators name theirs; each holds its own name and the row's text."""
    from pyspark.sql import functions as F

    names = "size start rep key label _text score kept shard place content target _id _key _null _row _digest _plan_id _rest _best _order _salt _hot rest empty taken copies t1 t2 _i _a _b words lang_pred"
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("none"))).alias(c) for c in names.split()])


@pytest.fixture(scope="session")
def unharmed():
    """Whether the columns of ``clashing`` still hold what they held."""

    def check(table):
        own = [c for c in table.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert len(own) > 20
        for r in table.collect():
            for c in own:
                assert r[c] in (f"{c}:{r.text}", f"{c}:none") and (r.text is not None or r[c] == f"{c}:none"), c

    return check
