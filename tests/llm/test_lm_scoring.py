"""Scores against counts held in dictionaries."""

import math
import random
from collections import Counter

import pytest

from weirgauge.llm import lm_scoring

SCHEMA = "doc_id bigint, text string, word string, n int"


def brute(rows):
    docs = {}
    for i, text in rows:
        docs.setdefault(i, []).append([w for w in (text or "").lower().split(" ") if w])
    pairs = {i: Counter((a, b) for w in ws for a, b in zip([None, *w], w)) for i, ws in docs.items()}
    words = {i: Counter(x for w in ws for x in w) for i, ws in docs.items()}
    heads = {i: Counter(x for w in ws for x in [None, *w[:-1]] if w) for i, ws in docs.items()}
    add = lambda parts: sum(parts.values(), Counter())
    all_pairs, all_words, all_heads = add(pairs), add(words), add(heads)
    total, out = sum(all_words.values()), {}
    for i in docs:
        size, value, backed = sum(words[i].values()), 0.0, 0
        for (a, b), n in pairs[i].items():
            others = all_pairs[a, b] - n
            if others:
                value += n * math.log(others / (all_heads[a] - heads[i][a]))
            else:
                backed += n
                value += n * math.log(0.4 * max(all_words[b] - words[i][b], 0.5) / max(total - size, 1))
        out[i] = (size, backed, pytest.approx(value, rel=1e-9, abs=1e-9))
    return out


@pytest.mark.parametrize("heavy", [1000, 15])
def test_scores_equal_those_of_counts(spark, monkeypatch, heavy):
    monkeypatch.setattr(lm_scoring, "HEAVY", heavy)
    monkeypatch.setattr(lm_scoring, "TOKENS", 300)
    pick = random.Random(heavy)
    vocabulary = [f"w{k}" for k in range(80)]
    texts = [" ".join(pick.choices(vocabulary, weights=[1 / (k + 1) for k in range(80)], k=pick.randint(0, 60))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "Once only"), (None, "w0 w1 w2"), (103, "w0")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r["node"]: (r["n_words"], r["n_backed"], r["log_score"]) for r in lm_scoring.score(docs).collect()}
    want = {lm_scoring.NO_ID if i is None else i: v for i, v in brute(rows).items()}
    assert got == want


def test_empty_table(spark):
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA)).collect() == []
