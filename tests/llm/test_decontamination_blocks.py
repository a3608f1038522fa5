"""Result rows of decontamination do not depend on the number of items."""

from collections import Counter

from alleleflow.llm import decontaminate
from alleleflow.llm.shared import table


def test_repeated_items_give_rows_in_blocks(spark):
    text = " ".join(f"w{k}" for k in range(12))
    docs = table(spark.createDataFrame([(1, f"a b {text} c"), (2, "other words only")], "doc_id long, text string"), "docs")
    items = spark.createDataFrame([(5, text), (5, text), (6, text), (7, "q r s t u v"), (8, None)], "item_id long, text string")
    whole, blocked = (Counter(map(tuple, decontaminate.contained_items(docs, items, block=n).collect())) for n in (1000, 2))
    assert whole == blocked == {(1, 5, 8, 8, 1.0): 2, (1, 6, 8, 8, 1.0): 1}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items, block=2).collect()] == [2]
