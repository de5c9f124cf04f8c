"""Packing: ids, pieces, places and how full sequences are."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from weirgauge.llm import packing

SCHEMA = "doc_id bigint, text string, length string, own int"


def check(rows, texts, capacity):
    """Every piece of every text once, gapless sequences, right ids."""
    model = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in texts:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], dtype="<u4")
            want.append((i, k, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(w[3] for w in want)


def test_pack_whole_texts(spark):
    pick = random.Random(5)
    words = ["the", "Straße,", "don't", "naïve", "été", "x9-y", "<|endoftext|>", "日本語", "a b", "…", "12345", "##"]
    texts = [(i, " ".join(pick.choice(words) for _ in range(int(pick.expovariate(1 / 40))))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, " \n\t "), (203, "word " * 900), (204, "same"), (204, "same"), (None, "no id"), (205, "\x0bv\x0cf \x1cfs ls")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], SCHEMA)
    sequences, tokens = check(packing.pack(docs, capacity=128).collect(), texts, 128)
    assert sequences <= tokens / 128 * 1.03 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_is_near_the_bound_and_small():
    pick = np.random.default_rng(3)
    for draw in (pick.lognormal(6, 1, 200_000), pick.uniform(1, 2048, 200_000), pick.uniform(700, 1100, 50_000), np.full(30_000, 683)):
        lengths = np.clip(draw.astype(int), 1, 2048)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing.Plan(counts, 2048)
        assert not any(plan.left.values()) and plan.next == counts
        used = np.zeros(plan.sequences, dtype=int)
        for length, lo, hi, first, each, _ in plan.rows:
            np.add.at(used, first + np.arange(hi - lo) // each, length)
        assert used.max() <= 2048
        bound = max(-(-lengths.sum() // 2048), (lengths > 1024).sum(), -(-(lengths > 682).sum() // 2))
        assert plan.sequences <= bound * 1.01 + 2
        assert len(plan.rows) < 40 * 2048
