"""The pipeline on the smallest tables, and edge cases of its first stages."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from weirgauge.llm import line_dedup, mixing, quality_rules, sharding  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, kept string, size int"
ROWS = [
    (1, None, "en", "a", "x", 1), (2, "", None, None, "x", 1), (3, "a\nb\nc\nd", "en", "a", "x", 1), (3, "a\nb\nc\nd", "en", "a", "x", 1),
    (None, "x\na\nb\nc", "en", "b", "x", 1), (5, "word " * 60, "en", "b", "x", 1), (6, "one two three\n" * 40_000, "en", "b", "x", 1),
]


def test_stages_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        now = [r[0] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(now) <= ids, name
        assert name.startswith("mixing") or len(now) == len(set(now))
        ids = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == ids


def test_near_stage_takes_five_words_and_four_fifths(spark):
    texts = []
    for name, size, places in (("a", 50, (20,)), ("b", 100, (30, 60)), ("c", 100, (20, 50, 80))):
        words = [f"{name}{k}" for k in range(size)]
        texts += [words, [f"{name}new" if k in places else w for k, w in enumerate(words)]]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", "x", 1) for i, w in enumerate(texts)], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5]  # 41 of 51, 86 of 106, and 81 of 111 shingles


def test_line_dedup_edges(spark):
    got = line_dedup.cut_lines(spark.createDataFrame(ROWS, SCHEMA)).collect()
    kept = {(r["row"]["doc_id"], r["row"]["text"] and r["row"]["text"][:3]): (r["n_removed"], r["kept"]) for r in got}
    assert len(got) == len(ROWS)
    assert kept[1, None] == (0, None) and kept[2, ""] == (0, "")
    assert kept[None, "x\na"] == (0, "x\na\nb\nc")  # a null id comes first
    assert kept[3, "a\nb"] == (3, "d")
    assert kept[6, "one"][0] == 39_999


def test_quality_and_mix_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    judged = {r["row"]["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert judged[1]["n_words"] == judged[2]["n_words"] == 0 and judged[1]["base_failed"] and not judged[1]["kept"]
    assert judged[5]["n_repeat_words"] == 60 and judged[5]["base_failed"]
    assert judged[6]["n_dup_lines"] == 39_999
    mixed = mixing.mix_counts(docs).collect()
    assert len(mixed) == len(ROWS) and all(r["copies"] * r["size"] <= 3 * r["size"] for r in mixed)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(empty).collect() == mixing.mixed(empty).collect() == line_dedup.cut_lines(empty).collect() == []


def test_shards_fit(spark):
    pick = [(i, "x" * (i % 50), "en", "a", "x", 1) for i in range(400)] + [(7, "same text here", "en", "a", "x", 1)] * 60 + ROWS
    got = sharding.shard_names(spark.createDataFrame(pick, SCHEMA), limit=200).collect()
    total = {}
    for r in got:
        total.setdefault(r["shard"], []).append(r["n_bytes"])
    assert len(got) == len(pick)
    assert all(sum(sizes) <= 200 or len([s for s in sizes if s]) == 1 for sizes in total.values())
    assert sharding.shard_names(spark.createDataFrame([], SCHEMA)).collect() == []
