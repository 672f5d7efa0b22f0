"""A benchmark's plain words count whatever their number."""

import pytest

from conftest import SF

from tideglass.llm import decontamination, queries

ITEMS = [(1, "Walk along the old road then walk home"), (2, "Tom has 5 apples. Tom eats 2 of the apples. How many apples are left now?")]
DOCS = {
    1: "Walk along the old road then walk home",
    2: "Drive along the old road then walk home",
    3: "Ann has 9 apples. Ann eats 4 of the apples. How many apples are left now?",
    4: "Apples has 9 apples. Apples eats 4 of the apples.",
    5: None,
    6: "",
}


@pytest.mark.parametrize("most", [10**6, 3, 0])
def test_results_do_not_depend_on_the_vocabulary(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", most)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([*DOCS.items(), (1, DOCS[1])], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontamination.leaks(docs, bench).collect()} == {(1, 1, False), (3, 2, True)}
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()) == [2, 4, 5, 6]
    assert {r["item_id"]: r["class_id"] for r in decontamination.item_classes(bench).collect()} == {1: 1, 2: 2}


def test_query_does_not_depend_on_the_vocabulary(spark, monkeypatch):
    want = sorted(map(tuple, queries.op5_decontamination(spark, SF).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", 10)
    assert want and sorted(map(tuple, queries.op5_decontamination(spark, SF).collect())) == want
