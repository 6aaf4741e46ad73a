import math

import pytest
from pyspark.sql import functions as F

from memloom.plans import cursor
from memloom.plans.search import Filters, SearchQuery, byte_page, recall, search, search_counters

SCHEMA = "namespace string, key string, content string, topic string, tags array<string>, occurred_at_ms long, written_at_ms long, expires_at_ms long, revision long"


def frame(spark, rows):
    return spark.createDataFrame([("k", key, text, topic, ["local"], at, at, expires, 1) for key, text, topic, at, expires in rows], SCHEMA)


def keys(df):
    return [r["key"] for r in df.collect()]


def test_rank_stem_and_filters(spark):
    m = frame(
        spark,
        [("old-relevant", "Antibodies bind immune cells", "science", 1, None), ("food", "Cells need food", "science", 9, None), ("other", "Antibodies bind immune cells", "other", 10, None)],
    )
    hits = search(m, SearchQuery("How does an antibody bind the immune system?", Filters("SCIENCE", "LOCAL", 1, 9)), 100).collect()
    assert [h["key"] for h in hits] == ["old-relevant"] and hits[0]["score"] > 0


def test_scores_follow_the_formula(spark):
    rows = [(f"d{i:03d}", " ".join(["river"] + ["copper"] * (i + 1)) if i < 4 else "river stone stone", "t", i, None) for i in range(160)]
    hits = search(frame(spark, rows), SearchQuery("river copper", limit=100), 1000).collect()
    tokens = sum(len(r[1].split()) for r in rows)

    def part(tf, df, length):
        return math.log(1 + (160 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (tokens / 160)))

    for h in hits[:4]:
        i = int(h["key"][1:])
        assert h["score"] == pytest.approx(part(1, 160, i + 2) + part(i + 1, 4, i + 2), abs=1e-9)
    page = search(frame(spark, rows), SearchQuery("river copper", limit=100, after=(hits[-1]["score"], hits[-1]["key"])), 1000)
    assert page.count() == 60


def test_ties_go_by_key_and_expired_rows_count_in_the_corpus(spark):
    rows = [("b", "same words", "t", 1, None), ("a", "same words", "t", 1, None), ("\U0001f600", "same words", "t", 1, None), ("gone", "same words", "t", 1, 50)]
    m = frame(spark, rows)
    assert keys(search(m, SearchQuery("same"), 50)) == ["a", "b", "\U0001f600"]
    live = search(m, SearchQuery("same"), 50).first()["score"]
    assert live == search(m, SearchQuery("same"), 49).first()["score"]


def test_long_queries_keep_64_terms(spark):
    text = " ".join(["unindexed"] * 200 + [f"term{i}" for i in range(90)])
    m = frame(spark, [(f"d{i}", f"term{i}", "t", i, None) for i in range(90)])
    got = search_counters(m, SearchQuery(text, stemmed=False)).first()
    assert (got["query_terms"], got["selected_terms"], got["scored_candidates"]) == (91, 64, 64)


def test_expansion(spark):
    m = frame(spark, [("x", "they ban it", "t", 1, None), ("y", "they prohibit it", "t", 1, None)])
    assert keys(search(m, SearchQuery("ban"), 9)) == ["x"]
    assert keys(search(m, SearchQuery("ban", expand=True), 9)) == ["x", "y"]


def test_empty_corpus_and_unknown_terms(spark):
    assert search(frame(spark, []), SearchQuery("word"), 1).count() == 0
    assert search(frame(spark, [("a", "b", "t", 1, None)]), SearchQuery("word"), 1).count() == 0


def test_validation():
    for bad in (SearchQuery(" "), SearchQuery("x" * 16_385), SearchQuery("x", limit=0), SearchQuery("x", expansion_terms=("a b",)), SearchQuery("x", Filters(from_ms=2, to_ms=1))):
        with pytest.raises(ValueError):
            bad.validate()


def test_recall_order_range_and_literals(spark):
    m = frame(spark, [("a", "Alpha beta", "t", 1, None), ("z", "beta", "t", 2, None), ("\U0001f600", "BETA alpha", "t", 2, None), ("other", "beta", "t", 3, None)])
    assert keys(recall(m, 100, Filters(from_ms=2, to_ms=2))) == ["\U0001f600", "z"]
    assert keys(recall(m, 100, query="alpha BET")) == ["\U0001f600", "a"]
    assert keys(recall(m, 100, after=(2, "z"))) == ["a"]
    with pytest.raises(ValueError):
        recall(m, 100, query="a b c d e f g h i")


def test_pages_by_bytes(spark):
    m = frame(spark, [("a", "12345", "t", 3, None), ("b", "12345", "t", 2, None), ("c", "1", "t", 1, None)])
    page = byte_page(recall(m, 9), [F.desc("occurred_at_ms"), F.desc("key")], F.octet_length("content"), 10)
    assert keys(page) == ["a", "b"]


def test_cursors():
    bound = cursor.binding("q", 1)
    text = cursor.encode([cursor.score_bits(0.1 + 0.2), "kéy"], bound)
    bits, key = cursor.decode(text, bound)
    assert cursor.bits_score(bits) == 0.1 + 0.2 and key == "kéy"
    for bad, to in ((text, "else"), ("nonsense", bound), ("x" * 5000, bound)):
        with pytest.raises(cursor.CursorError):
            cursor.decode(bad, to)
