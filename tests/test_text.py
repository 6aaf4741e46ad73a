import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from memloom.functions.stem import stem
from memloom.functions.text import fixed_chunks, labels, plain_chunks, plain_identity, plain_words, trim_space, words


def test_stems_that_fall_together():
    for a, b in (("antibody", "antibodies"), ("penguin", "penguins"), ("tool", "tools"), ("hope", "hoping"), ("relate", "relational")):
        assert stem(a) == stem(b)
    assert stem("preferred") == "prefer"
    assert stem("skies") == "sky" and stem("news") == "news" and stem("at") == "at"


def test_published_stems():
    pairs = "consign consign consigned consign consistency consist knaves knave knackeries knackeri happily happili generate generat communism communism"
    flat = pairs.split()
    for word, expected in zip(flat[::2], flat[1::2], strict=True):
        assert stem(word) == expected


@given(st.text(max_size=200))
@settings(max_examples=100, deadline=None)
def test_chunks_lose_nothing(text):
    parts = list(plain_chunks(text, 7, 11))
    assert "".join(parts) == text
    assert all(0 < len(p) <= 7 and len(p.encode()) <= 11 for p in parts)


def test_words_on_driver_and_in_spark_agree(spark):
    texts = ["The Cat, and the HAT! été 42nd", "", "a of it", "x" * 65 + " ok", "Straße—Über_maß"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("w")).collect()
    for r in rows:
        assert list(r["w"]) == plain_words(r["t"])


def test_labels(spark):
    df = spark.createDataFrame([(["Local", "local", " B\t"],), (["x" * 65],), (["a"] * 9,), ([],)], "t array<string>")
    got = [r[0] for r in df.select(labels(F.col("t"))).collect()]
    assert got == [["b", "local"], None, None, []]


def test_trim_covers_unicode_space(spark):
    df = spark.createDataFrame([(" \t a b \n",)], "t string")
    assert df.select(trim_space(F.col("t"))).first()[0] == "a b"


def test_fixed_chunks(spark):
    df = spark.createDataFrame([("abcdefg",), ("",)], "t string").select(fixed_chunks(F.col("t"), 3).alias("c"))
    got = [[(c["part"], c["content"]) for c in r["c"]] for r in df.collect()]
    assert got == [[(0, "abc"), (1, "def"), (2, "g")], [(0, "")]]


def test_identity_ignores_case_and_composition():
    assert plain_identity("Straße  Café") == plain_identity("STRASSE café")
