"""Recall of planted items, whatever the benchmark's size and the items' length."""

import random

import pytest
from test_operators import docs, prose

from tracewright.llm import decontaminate


@pytest.mark.parametrize("items, length", [(800, 38), (200, 6)])
def test_verbatim_copies_are_found(spark, items, length):
    rng = random.Random(5)
    bench = [prose(1000 + i, length) for i in range(items)]
    texts = []
    for i, t in enumerate(bench):
        around = prose(5000 + i, 120).split()
        at = rng.randrange(len(around))
        texts.append(" ".join([*around[:at], t, *around[at:]]))
    table = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, texts), table).collect()}
    assert [i for i in range(items) if (i, i) not in found] == []


@pytest.mark.parametrize("replaced", [0.1, 0.2, 0.3])
def test_recall_of_reworded_items_at_a_cut_rank(spark, monkeypatch, replaced):
    """Against plain comparison of every item with its region: blocks hold more passages than the model has dimensions."""
    monkeypatch.setattr(decontaminate, "AT_ONCE", 1)
    rng, items, texts = random.Random(int(100 * replaced)), [], []
    for i in range(400):
        items.append(prose(3000 + i, 44) + ". " + prose(9000 + i, 6))
        w = items[-1].replace(".", "").split()
        for at in rng.sample(range(44), int(44 * replaced)):
            w[at] = f"other{rng.randrange(10**6)}"
        around = prose(20_000 + i, 150).split()
        at = rng.randrange(len(around))
        texts.append(" ".join([*around[:at], *w, *around[at:]]))
    table = spark.createDataFrame([(f"item {i}", t) for i, t in enumerate(items)], "item_id string, text string")
    wanted = set()
    for i, t in enumerate(texts):
        item, text = decontaminate.words(items[i]), decontaminate.words(t)
        share = decontaminate.common_subsequence(item, text) / len(item)
        answer = decontaminate.answer_of(items[i])
        if share >= decontaminate.COPY or share >= decontaminate.PARAPHRASE and decontaminate.common_subsequence(answer, text) >= decontaminate.ANSWER * len(answer):
            wanted.add((i, f"item {i}"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, texts), table).collect()}
    print(f"{replaced} of the words replaced: {len(found & wanted)} of {len(wanted)} found, {len(found - wanted)} others")
    assert len(wanted) > 300 and len(found & wanted) >= 0.9 * len(wanted) and not found - wanted
