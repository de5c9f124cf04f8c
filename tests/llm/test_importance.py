"""Importance resampling: buckets, weights, scores and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirgauge.llm import importance as im

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def runs(text, order):
    w = words_of(text)
    return [" ".join(w[i : i + n]).encode() for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, order=1, buckets=im.BUCKETS, least=20, percent=10):
    """Rows of (doc_id, n_features, weight, score, rank) by the definition."""
    of = lambda texts: [[zlib.crc32(f) % buckets for f in runs(t, order)] for t in texts]
    found, wanted = of([t for _, t in docs]), of(target)
    s, t = Counter(b for f in found for b in f), Counter(b for f in wanted for b in f)
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for (i, text), f in zip(docs, found, strict=True):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least])
    can = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(can[: len(can) * percent // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_composed_crc_is_that_of_the_joined_parts(a, b):
    one = lambda x: np.array([zlib.crc32(x)], dtype=np.uint32)
    assert im.composed(one(a), one(b), np.array([len(b)]))[0] == zlib.crc32(a + b)


@pytest.mark.parametrize(("order", "bound"), [(1, 5), (2, 40), (3, 10_000), (1, 0)])
def test_features_with_any_dictionary(order, bound):
    draw = random.Random(order)
    dictionary = im.Dictionary(bound)
    some = ["".join(draw.choice("abÄé1Z你") for _ in range(draw.randrange(1, 4))) for _ in range(60)]
    for _ in range(20):
        texts = ["".join(draw.choice([*some, " ", "\n", "--", "_"]) + draw.choice(["", " ", ","]) for _ in range(draw.randrange(40))) for _ in range(8)]
        got = im.features([t.encode() for t in texts], order, dictionary)
        want = [[zlib.crc32(r) for r in runs(t, order)] for t in texts]
        assert [np.concatenate(g).tolist() for g in got] == want
    assert len(dictionary.crc) <= bound


def test_long_words_and_texts():
    long = "x" * 100_000 + " y " + "zz" * 70_000 + " " + "a b c " * 50_000
    got = im.features([long.encode(), b"", b"..."], 2, im.Dictionary())
    assert np.concatenate(got[0]).tolist() == [zlib.crc32(r) for r in runs(long, 2)]
    assert [len(x) for g in got[1:] for x in g] == [0] * 4


@pytest.mark.parametrize("order", [1, 2])
def test_rows_against_the_definition(spark, order):
    draw = random.Random(7)
    text = lambda: " ".join(draw.choice(["the", "of", "Ära", "x1", "tion", "rare%d" % draw.randrange(50)]) for _ in range(draw.randrange(5, 60)))
    docs = [(i, text()) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " ,. "), (None, docs[0][1]), (3, docs[3][1]), (3, docs[3][1]), (300, "word " * 30_000)]
    target = [text() for _ in range(9)] + [None, ""]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, weight int, bucket int").repartition(3)
    wanted = spark.createDataFrame(list(enumerate(target)), "item_id bigint, text string")
    got = im.resampled(table, wanted, order=order)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = sorted(map(tuple, got.collect()), key=str)
    want = expected(docs, target, order)
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    assert sorted((r[4], r[3]) for r in rows if r[4]) == sorted((r[4], r[3]) for r in want if r[4])
    assert {r for r in rows if r[0] not in (None, 0, 3)} == {r for r in want if r[0] not in (None, 0, 3)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    target = spark.createDataFrame([(1, "a c")], "item_id bigint, text string")
    assert im.resampled(docs.limit(0), target).count() == 0
    assert [tuple(r) for r in im.resampled(docs, target.limit(0), percent=100).collect()] == expected([(1, "a b " * 20)], [], percent=100)
