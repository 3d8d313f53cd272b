"""op5: the pieces of words of any length count for the scores."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import tokencounts
from gridspark.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def _plainly(word: str) -> collections.Counter:
    table = tokencounts.pieces(PATH)
    unknown, longest = min(table.values()) - tokencounts.PENALTY, max(map(len, table))
    s = "▁" + word
    best, back = [0.0] + [-np.inf] * len(s), [0] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for k in range(min(longest, end), 0, -1):
            score = table.get(s[end - k : end])
            if score is not None and best[end - k] + score > best[end]:
                best[end], back[end] = best[end - k] + score, k
        if s[end - 1] not in table and best[end - 1] + unknown > best[end]:
            best[end], back[end] = best[end - 1] + unknown, 0
    out, at = collections.Counter(), len(s)
    while at:
        if back[at]:
            out[s[at - back[at] : at]] += 1
        at -= max(back[at], 1)
    return out


@pytest.mark.parametrize("block", [tokencounts.BLOCK, 97])
def test_long_words_count_for_the_scores(spark, monkeypatch, block):
    rng, table = random.Random(3), tokencounts.pieces(PATH)
    words = ["".join(rng.choice(["the", "ory", "日本", "q́", "\U0001f9ea", "xy"]) for _ in range(n)) for n in (200, 400, 900)]
    texts = ["the theory", f"{words[0]} ory {words[1]}", words[2], words[2], None, "x" * 256, "x" * 257]
    want = sum((_plainly(w) for t in texts for w in (t or "").split()), collections.Counter())
    monkeypatch.setattr(tokencounts, "BLOCK", block)
    counter = tokencounts.Counter(PATH)
    counter.expect(pa.array(texts, pa.string()), True)
    assert {p: n for p, n in zip(table, counter.used.tolist(), strict=True) if n} == dict(want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    total = sum(want.values()) + 0.5 * (len(table) - len(want))
    assert np.allclose(tokencounts.estimate(docs, PATH, whole=True), [np.log((want[p] or 0.5) / total) for p in table])


def test_counts_use_the_scores_of_all_words(spark):
    docs = spark.createDataFrame([(0, "y" * 4000), (1, "the")], "doc_id long, text string")
    whole = tokencounts.estimate(docs, PATH, whole=True)
    plain = tokencounts.count_tokens(docs, PATH, whole).collect()
    seen = tokencounts.count_documents(docs, PATH).collect()
    assert sorted(seen) == sorted(plain) and not np.allclose(whole, tokencounts.estimate(docs, PATH))
