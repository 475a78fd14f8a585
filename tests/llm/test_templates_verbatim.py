from loomspark.llm import templates

WORDS = "the farmer brings some apples to an old market every morning before sunrise and sells them there to people from other villages nearby".split()


def test_a_conflicting_slot_leaves_the_verbatim_windows(spark):
    item = " ".join(["2", *WORDS, "2", "baskets", "remain"])
    docs = [(1, item), (2, item.replace("2 baskets", "3 baskets")), (3, item.upper().replace("2 BASKETS", "3 BASKETS").lower()), (4, " ".join(["2", *WORDS[:6], "3"]))]
    found = templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1, 2, 3} and all(r.n_changed_slots == (r.doc_id > 1) for r in found)
