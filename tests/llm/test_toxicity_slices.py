"""Whole texts are scored in small slices, whatever the size of the batch they come in (operator 8)."""

import pyarrow as pa

from tracewright.llm import toxicity


def test_texts_come_in_slices():
    texts = [None if i % 7 == 0 else f"text {i}" for i in range(3 * toxicity.BATCH + 5)]
    got = list(toxicity.texts_of(pa.array(texts, pa.string()).slice(2)))
    assert [len(g) for g in got] == [toxicity.BATCH] * 3 + [3] and sum(got, []) == texts[2:]
    assert list(toxicity.texts_of(pa.array([], pa.string()))) == []
