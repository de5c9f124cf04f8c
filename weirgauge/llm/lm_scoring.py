"""Stupid-backoff scores of documents from the n-gram counts of all others.

A word scores c(context word) / c(context), or ``ALPHA`` c(word) / N where no other
document has the bigram; counts leave the document's own occurrences out, and a word that
no other document has counts one half.  The score of a document is the sum of logarithms.

Word counts are an aggregate with map-side combine.  Bigrams are exploded within a batch
of documents, counted by document, and sent once, packed, to the partition of their
context's hash, where the count tables of the partition's bigrams are formed and joined
to the same entries; sums by document leave it, and words to back off to go on to a join
with the word counts.  Words above 1 / ``HEAVY`` of the corpus (so fewer than that in
number) have their counts handed out instead, and their bigrams are dealt by both words,
so that no partition holds a frequent word.  Partitions grow in number with the corpus.

Defined results: null and empty texts have no words and the score 0; rows sharing an id
(null is an id) are one document whose sums are added; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm.common import documents, lower_ascii, query, text_of, words
from weirgauge.session import staged

ALPHA = 0.4
HEAVY = 1000
ENTRIES = 1_500_000  # bigrams of a partition, about
TOKENS = 1_000_000  # words of the documents that are packed together
START = 1  # context of a first word
NO_ID = -(2**63)
FIELDS = (("docs", "<i8"), ("xs", "<i8"), ("ys", "<i8"), ("doc", "<u4"), ("x", "<u4"), ("y", "<u4"), ("n", "<u4"), ("own_x", "<u4"), ("own_y", "<u4"))

RISING = ("docs", "xs", "ys", "y")


def _deal(x: np.ndarray, y: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    """Partition of bigrams: by context, by both words where the context is heavy."""
    mixed = x.view(np.uint64) + np.where(np.isin(x, heavy), y.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1), np.uint64(0))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, firsts of the groups in it, group of each entry in the order)."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), dtype=bool)
    for key in keys:
        sorted_key = key[order]
        change[1:] |= sorted_key[1:] != sorted_key[:-1]
    change[:1] = True
    return order, np.flatnonzero(change), np.cumsum(change) - 1


def bigram_entries(nodes: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct bigrams of each document: doc (index), x, y, n and the document's counts of x as context and of y."""
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    x = np.concatenate([[START], y[:-1]]).astype(np.int64) if len(y) else y
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    x[starts] = START
    order, first, _ = _grouped(doc, x, y)
    n = np.diff(np.append(first, len(order))).astype(np.int32)
    out = {"doc": doc[order][first], "x": x[order][first], "y": y[order][first], "n": n}
    for name, key in (("own_x", "x"), ("own_y", "y")):
        order, first, group = _grouped(out["doc"], out[key])
        own = np.empty(len(n), dtype=np.int32)
        own[order] = np.add.reduceat(n[order], first)[group] if len(n) else n
        out[name] = own
    return out


def _packed(nodes: np.ndarray, e: dict[str, np.ndarray], rows: np.ndarray, press) -> bytes:
    rows = rows[np.lexsort((e["doc"][rows], e["y"][rows]))]
    docs, doc = np.unique(e["doc"][rows], return_inverse=True)
    xs, x = np.unique(e["x"][rows], return_inverse=True)
    ys, y = np.unique(e["y"][rows], return_inverse=True)
    values = (nodes[docs], xs, ys, doc, x, y, e["n"][rows], e["own_x"][rows], e["own_y"][rows])
    head = np.array([len(docs), len(xs), len(ys), len(rows)], dtype="<i8").tobytes()
    return press.compress(head + b"".join(_planes(v.astype(kind), name in RISING) for v, (name, kind) in zip(values, FIELDS, strict=True)))


def _planes(values: np.ndarray, rising: bool) -> bytes:
    """Bytes of a column, first those of lowest rank; a rising column as differences.  Both make it compress better."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, dtype="<i8", count=4).tolist()
    out, at = {}, 32
    for k, (name, kind) in enumerate(FIELDS):
        many, wide = sizes[min(k, 3)], np.dtype(kind).itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=many * wide, offset=at).reshape(wide, many)
        values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out[name] = np.cumsum(values, dtype=kind) if name in RISING else values
        at += many * wide
    return out


def packed_bigrams(hashed: DataFrame, heavy: list[int], parts: int) -> DataFrame:
    """(p, blob): bigrams of batches of documents by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, often = zstandard.ZstdCompressor(level=3), np.array(sorted(heavy), dtype=np.int64)
        for batch in batches:
            column = batch.column("h")
            offsets = np.asarray(column.offsets, dtype=np.int64)
            values, nodes = np.asarray(column.values), np.asarray(batch.column("node"))
            low = 0
            while low < len(nodes):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + TOKENS, side="right")) - 1)
                e = bigram_entries(nodes[low:high], np.diff(offsets[low : high + 1]), values[offsets[low] : offsets[high]])
                p = _deal(e["x"], e["y"], often, parts)
                order = np.argsort(p, kind="stable")
                cuts = np.flatnonzero(np.diff(p[order])) + 1
                blocks = [b for b in np.split(order, cuts) if len(b)]
                blobs = [_packed(nodes[low:high], e, b, press) for b in blocks]
                out = pa.RecordBatch.from_arrays([pa.array([int(p[b[0]]) for b in blocks], pa.int64()), pa.array(blobs, pa.binary())], ["p", "blob"])
                del e, p, order, blocks, blobs  # not held while the next documents are packed
                yield out
                low = high

    return hashed.mapInArrow(run, "p bigint, blob binary")


def scored_entries(blobs: DataFrame, contexts: dict[int, int], common: dict[int, int]) -> DataFrame:
    """(node, key, n, own, score, backed): sums of each document (n is 0), and the words (key) it backs off to."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(b) for b in group["blob"]]
        shift = lambda name, of: np.concatenate([p[name].astype(np.int64) + s for p, s in zip(parts, of, strict=True)])
        ends = lambda name: np.cumsum([0] + [len(p[name]) for p in parts[:-1]])
        whole = lambda name: np.concatenate([p[name] for p in parts])
        nodes, node = np.unique(whole("docs"), return_inverse=True)
        xs, x = np.unique(whole("xs"), return_inverse=True)
        ys, y = np.unique(whole("ys"), return_inverse=True)
        doc, x, y = node[shift("doc", ends("docs"))], x[shift("x", ends("xs"))], y[shift("y", ends("ys"))]
        n, own_x, own_y = (whole(k).astype(np.int64) for k in ("n", "own_x", "own_y"))
        order = np.argsort(x * len(ys) + y, kind="stable")
        key = (x * len(ys) + y)[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.empty(len(n), dtype=np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(order))))
        context = np.bincount(x, weights=n, minlength=len(xs)).astype(np.int64)
        for k in np.flatnonzero(np.isin(xs, list(contexts))):
            context[k] = contexts[int(xs[k])]
        others = total - n
        seen = others > 0
        gain = np.zeros(len(n))
        gain[seen] = n[seen] * (np.log(others[seen]) - np.log(context[x[seen]] - own_x[seen]))
        known = np.array([common.get(int(v), 0) for v in ys], dtype=np.int64)[y]
        light = ~seen & (known > 0)
        gain[light] = n[light] * np.log(np.maximum(known[light] - own_y[light], 0.5))
        sums = np.bincount(doc, weights=gain, minlength=len(nodes))
        backed = np.bincount(doc[~seen], weights=n[~seen], minlength=len(nodes)).astype(np.int64)
        ask = np.flatnonzero(~seen & (known == 0))
        # entries of a document for one word, from all its contexts here, go on as one
        order, first, _ = _grouped(y[ask], doc[ask])  # equal words side by side, which the shuffle compresses better
        at = ask[order][first] if len(ask) else ask
        times = np.add.reduceat(n[ask][order], first) if len(ask) else n[ask]
        asked = pd.DataFrame({"node": nodes[doc[at]], "key": ys[y[at]], "n": times, "own": own_y[at], "score": 0.0, "backed": 0})
        told = pd.DataFrame({"node": nodes, "key": nodes, "n": 0, "own": 0, "score": sums, "backed": backed})
        return pd.concat([told, asked]) if len(asked) else told

    return blobs.groupBy("p").applyInPandas(run, "node bigint, key bigint, n bigint, own bigint, score double, backed bigint")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, n_words, n_backed, log_score) for each document."""
    word = words(lower_ascii(text_of(F.col(f"`{text}`"))))
    hashed = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID)).alias("node"), F.transform(word, lambda w: F.xxhash64(w)).alias("h")
    )
    # a word that occurs once is in no other document: the scores treat it as a word without a count
    counts = staged(hashed.select(F.explode("h").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    sizes = staged(hashed.select("node", F.size("h").alias("n"), F.try_element_at("h", F.lit(-1)).alias("last")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    often = {r["w"]: r["c"] for r in counts.where(F.col("c") * HEAVY > total).collect()}  # fewer than HEAVY rows
    last = sizes.where("n > 0")
    ends = {r["w"]: r["c"] for r in last.where(F.col("last").isin(list(often))).groupBy(F.col("last").alias("w")).agg(F.count(F.lit(1)).alias("c")).collect()}
    contexts = {w: c - ends.get(w, 0) for w, c in often.items()} | {START: last.count()}
    parts = max(8, math.ceil(total / ENTRIES))
    found = scored_entries(packed_bigrams(hashed, list(contexts), parts), contexts, often)
    # sums have n = 0 and their document as the key: they meet no word and are spread
    joined = found.join(counts, (F.col("key") == F.col("w")) & (F.col("n") > 0), "left")
    back = F.when(F.col("n") > 0, F.col("n") * F.log(F.greatest(F.coalesce("c", F.lit(0)) - F.col("own"), F.lit(0.5)))).otherwise(0.0)
    sums = joined.groupBy("node").agg(F.sum(F.col("score") + back).alias("gain"), F.sum("backed").alias("n_backed"))
    lengths = sizes.groupBy("node").agg(F.sum("n").cast("bigint").alias("n_words"))
    rest = F.log(F.lit(ALPHA)) - F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)))
    return lengths.join(sums, "node", "left").select(
        "node",
        "n_words",
        F.coalesce("n_backed", F.lit(0)).cast("bigint").alias("n_backed"),
        F.coalesce(F.col("gain") + F.col("n_backed") * rest, F.lit(0.0)).alias("log_score"),
    )


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select(
        F.when(F.col("node") != NO_ID, F.col("node")).alias("doc_id"),
        "n_words",
        "n_backed",
        "log_score",
        (F.col("log_score") / F.greatest("n_words", F.lit(1))).alias("score"),
    )
