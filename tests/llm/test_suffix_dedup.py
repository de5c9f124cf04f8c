"""Removed bytes against a table of all windows."""

import hashlib
import random
from collections import Counter

from weirgauge.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, hull int, body string"


def brute(rows):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + 400] for _, b in bodies for s in range(len(b) - 399))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    pick = random.Random(seed)
    letters = "abcdefgh éß日"
    make = lambda n: "".join(pick.choice(letters) for _ in range(n))
    passages = [make(n) for n in (250, 330, 390, 400, 500, 900, 2000)]
    out = [None, "", "short", make(399), "a" * 1500, "ab" * 500, "x" * 399, "x" * 400]
    for _ in range(45):
        parts = [make(pick.randint(0, 700))]
        for _ in range(pick.randint(0, 3)):
            p = pick.choice(passages)
            if pick.random() < 0.5:
                k = pick.randrange(len(p))
                p = p[:k] + pick.choice(letters) + p[k + 1 :]
            lo = pick.randint(0, 60)
            parts += [p[lo : len(p) - pick.randint(0, 60)], make(pick.randint(0, 300))]
        out.append("".join(parts))
    out += [out[-1], out[-2][:-1], "z" + out[-3]]
    return list(enumerate(out))


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = suffix_dedup.cut(docs).collect()
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)


def test_bytes_equal_those_of_all_windows(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 2000)
    monkeypatch.setattr(suffix_dedup, "_powers", [])
    pick = random.Random(4)
    long = "".join(pick.choice("abcd ") for _ in range(9000))
    rows = [(1, long), (2, long[3100:4300]), (3, "y" + long[1500:2100] + "y"), (3, "y" + long[1500:2100] + "y"), (None, long[100:550])]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
