from quillmark.operators.similarity import containment


def test_short_items_are_found_whole(spark):
    long = " ".join(f"w{i}" for i in range(14))
    docs = [(1, "Before: the red, fox ran home. After"), (2, "The red fox ran home!"), (3, "the red fox ran"), (4, f"x {long}"), (5, ""), (6, None), (7, "fox fox"), (8, " ".join(long.split()[:12]))]
    items = [(1, "the red fox ran home"), (2, "Fox"), (3, long), (4, ""), (5, None), (6, "red ran")]
    df = containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in df.collect())
    assert got == [(1, 1, "containment"), (1, 2, "containment"), (2, 1, "exact"), (2, 2, "containment"), (3, 2, "containment"), (4, 3, "containment"), (7, 2, "containment"), (8, 3, "shingle")]
    assert all(r["evidence"] == "the red fox ran home" for r in df.where("item_id = 1").collect())
