from gridweave.llm import decontaminate


def test_items_without_id_hit_words(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(None, passage), (7, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before it {passage} after it alpha beta gamma")], "doc_id long, text string")
    for max_words in (5, 1000):  # two automata and one
        got = decontaminate.matches(docs, items, window=10, max_words=max_words).first()["leak"]
        assert (got["n_words"], got["n_hit"], got["items"]) == (19, 15, [7])
