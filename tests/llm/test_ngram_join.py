"""The Jaccard join against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from weirgauge.llm import ngram_join

SCHEMA = "doc_id bigint, text string, node string, sh int"


def brute(rows):
    """Component of each id, from all pairs of sets."""
    sets = {}
    for i, text in rows:
        w = []
        for part in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).translate(
            {c: " " for c in (9, 10, 11, 12, 13)}
        ).split(" "):
            if part:
                w.append(part)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    out = []
    for size in (3, 9, 12, 14, 20, 21, 24, 30, 60, 150, 400):
        for _ in range(3):
            base = [pick.choice(vocabulary) for _ in range(size)]
            out.append(base)
            for _ in range(6):
                copy = list(base if pick.random() < 0.7 else out[-1])
                for _ in range(pick.randint(0, max(1, size // 40))):
                    copy[pick.randrange(len(copy))] = pick.choice(vocabulary) + "x"
                out.append(copy + ["end"] * (pick.random() < 0.2))
    passage = ["shared", "line", "of", "some", "words"] * 4
    out += [passage + [pick.choice(vocabulary) for _ in range(pick.randint(1, 80))] for _ in range(40)]
    texts = [" ".join(w) for w in out] + [None, "", " \n ", "one", "One", "two words", "TWO\twords", "two  Words"]
    pick.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "boundary"), [(1, 1), (1, 19), (2, None)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, seed, boundary):
    if boundary:
        monkeypatch.setattr(ngram_join, "choose_boundary", lambda sizes: boundary)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r["node"]: (r["n_shingles"], r["component"]) for r in ngram_join.near_classes(docs).collect()}
    assert got == brute(rows)


def pages_and_passage(page, small):
    """Pages A and B of ``page`` shingles that are linked, and smaller texts that share all their rare shingles.

    A and B end in a passage and differ in two of its words.  Everything else in them, and in the smaller
    texts that hold the passage, stands in more texts, so that the passage comes first in the order.
    """
    passage = [f"p{k}" for k in range(52)]
    fill = lambda name, n: [f"{name}{k}" for k in range(n)]
    article, other = fill("a", page + 2 - 52), fill("b", small + 2 - 52)
    out = [other + passage]
    for version in "xy":
        changed = list(passage)
        changed[20], changed[30] = version, version + version
        out.append(article + changed)
    out.append([*out[0], "end"])
    for k in range(3):
        for start in (article, other):
            out.append([*start, *passage[:2], *fill(f"t{start[0]}{k}", 100)])
        out.append([*fill(f"f{k}", 60), *passage[18:23], *fill(f"g{k}", 60), *passage[28:33], *fill(f"h{k}", 60)])
    out += [[*text, "end"] for text in out[4:]]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("page", "small"), [(200, 150), (212, 176)])
def test_smaller_members_of_a_list_do_not_hide_larger_ones(spark, page, small):
    rows = pages_and_passage(page, small)
    want = brute(rows)
    assert want[2] == (page, 1) and want[0] == (small, 0)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r["node"]: (r["n_shingles"], r["component"]) for r in ngram_join.near_classes(docs).collect()}
    assert got == want


def pairwise(rows, width, num, den):
    """Component of each id from all pairs, for texts of plain words."""
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    at = dict.fromkeys(sets)
    for i in at:
        at[i] = i
    for i, j in [(i, j) for i in sorted(sets) for j in sorted(sets) if i < j]:
        if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and at[i] != at[j]:
            a, b = sorted((at[i], at[j]))
            at = {k: a if c == b else c for k, c in at.items()}
    return {i: (len(sets[i]), at[i]) for i in at}


@pytest.mark.parametrize("boundary", [1, 11, None])
def test_other_widths_and_thresholds(spark, monkeypatch, boundary):
    if boundary:
        monkeypatch.setattr(ngram_join, "choose_boundary", lambda sizes, rule: boundary)
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = ngram_join.near_classes(docs, rule=ngram_join.Rule(5, 4, 5)).collect()
    assert {r["node"]: (r["n_shingles"], r["component"]) for r in got} == pairwise(rows, 5, 4, 5)


def test_boundary_follows_the_costs():
    assert ngram_join.choose_boundary({}) == 1
    assert 10 <= ngram_join.choose_boundary({12: 100, 16: 100, 500: 100}) <= 20


def test_empty_table_null_and_repeated_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_classes(none).collect() == []
    rows = [(None, "a b c d"), (None, "e f g h"), (4, "a b c d"), (4, "a b c d"), (5, None)]
    got = ngram_join.near_classes(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted(
        [(ngram_join.NO_ID, 4)] * 2 + [(4, 4)] * 2 + [(5, 5)]
    )


def test_representatives_keep_the_input_columns(spark):
    rows = [(i, t, "x", 1) for i, t in [(1, "a b c d"), (2, "a B c d"), (3, "other words here"), (4, None)]]
    kept = ngram_join.representatives(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "node", "sh"]
    assert {r["doc_id"] for r in kept.select(F.col("doc_id")).collect()} == {1, 3, 4}


def test_representatives_keep_one_row_of_each_class(spark):
    rows = [
        (1, "a b c d"), (1, "A b c  d"), (None, "n o p q"), (None, "n o p q"), (None, "r s t u"),
        (2, "e f g h"), (3, "e f g h"), (3, "only here i stand"), (7, None), (7, "k l m n"), (8, "k l m n"), (9, " "), (9, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in ngram_join.representatives(docs).collect()), key=str)
    assert kept == sorted(
        [(1, ["a", "b", "c", "d"]), (None, ["n", "o", "p", "q"]), (None, ["r", "s", "t", "u"]), (2, ["e", "f", "g", "h"]),
         (3, ["only", "here", "i", "stand"]), (7, []), (7, ["k", "l", "m", "n"]), (9, []), (9, [])], key=str
    )
