"""Token counts: equal to the library's on any text, however the stream is cut."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weirgauge.llm import token_counts as tc

PATH = tc.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
MIXED = [*"aabcdersttlvm''''  !!  <>|1 2\n\tÉéΣσςİıﬁ´́‍你好αβ٣½ǅ\x1c\x85　 ", "<|startoftext|>", "<|endoftext|>", "'re", "'ll", "'LL", " don't"]
SMALL = tc.Compiled(PATH, block=40, chunks=5)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="ab'retsl <|!1é"), st.lists(st.sampled_from(MIXED)).map("".join)), max_size=6))
def test_equal_to_the_library(texts):
    assert SMALL.count(texts).tolist() == library(texts)
    assert tc.compiled(PATH).count(texts).tolist() == library(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="ab'retsl <|!1é"), st.lists(st.sampled_from(MIXED)).map("".join)), max_size=6))
def test_ids_equal_to_the_library(texts):
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert SMALL.ids(texts) == want == tc.compiled(PATH).ids(texts)


@pytest.mark.parametrize("chunks", [1, 3, 64, 4096])
def test_any_number_of_chunks(chunks):
    draw = random.Random(chunks)
    texts = ["".join(draw.choice(MIXED) for _ in range(draw.randrange(200))) for _ in range(60)]
    assert tc.Compiled(PATH, chunks=chunks).count(texts).tolist() == library(texts)


def test_composed_maps_are_the_run_of_both_parts():
    words = SMALL.words
    draw = random.Random(1)
    for _ in range(200):
        first, second = ([draw.randrange(words.next.shape[1]) for _ in range(draw.randrange(6))] for _ in range(2))
        maps = []
        for part in (first, second, first + second):
            one = 0
            for kind in part:
                one = int(words.grown[one, kind])
            maps.append(one)
        assert words.composed[maps[0], maps[1]] == maps[2]
        for state in range(len(words.next)):
            now = state
            for kind in first + second:
                now = int(words.next[now, kind])
            assert words.maps[maps[2], state] == now


def test_long_runs_without_a_blank_and_forgetting(monkeypatch):
    texts = ["ab" * 40_000, "x" * 30_001, "=" * 5_000 + "'s" * 3_000, "7" * 2_000, "word " * 20_000]
    model = tc.Compiled(PATH, block=1_000)
    assert model.count(texts).tolist() == library(texts)
    monkeypatch.setattr(tc, "KEPT", 10)
    assert model.count(texts[2:]).tolist() == library(texts[2:])


def test_rows_of_any_kind(spark):
    texts = [(1, None), (1, ""), (None, "the end"), (3, "<|endoftext|>a"), (3, "<|endoftext|>a"), (4, "a word " * 3000), (5, "É́ \n\t")]
    rows = [(i, t, 7, True) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes int, over_limit boolean")
    got = tc.token_counts(docs, limit=5000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    found = sorted(map(tuple, got.collect()), key=str)
    counts = library([t or "" for _, t in texts])
    want = [(i, len((t or "").encode()), n, n > 5000) for (i, t), n in zip(texts, counts, strict=True)]
    assert found == sorted(want, key=str)
    assert tc.token_counts(docs.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    got = {r["doc_id"]: r["n_tokens"] for r in tc.op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r[0] for r in rows], library([r[1] or "" for r in rows]), strict=True))


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tc.Compiled(public_tokenizers.path("byte_bpe_50k.json"))
