"""Windows that equal their neighbours: words that repeat with a short period between other words."""

import numpy as np
import pytest

from lexiloom.llm import suffixes

from . import brute_force


@pytest.mark.parametrize("period", [1, 2, 7, 49, 50])
def test_periods(spark, period):
    rng = np.random.default_rng(period)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = {}
    for i in range(30):
        unit = word(period)
        texts[i] = " ".join([*word(rng.integers(0, 90)), *(unit * 120)[: 50 + period + i % 12], *word(rng.integers(0, 90))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {}
    for r in suffixes.later_copies(df).collect():
        assert r["source_doc_ids"] == [r["doc_id"]]
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert got == brute_force.later_words(texts, 50) and len(got) == 30
