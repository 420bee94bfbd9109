"""Benchmark items of a few characters."""

from fieldstrata.llm import decontaminate


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "Is it so?"), (2, "東京はどこ"), (3, ""), (4, None), (5, "abc")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "he asked: is  it so? yes"), (2, "this it so? no"), (3, "問い東京はどこですか"), (4, None), (5, "xabc abcd"), (6, "an abc.")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, items).collect()) == [(1, 1, 0), (3, 2, 0), (6, 5, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()) == [2, 4, 5]
