"""Suffix dedup by bucket-pointer refinement over sampled suffixes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else.

Sorting every suffix would shuffle many times the text, so suffixes are sampled by
content: a position is an anchor if its q-gram has the smallest hash of some window of
``LENGTH`` bytes that holds it.  Equal windows have equal anchors at equal places, so each
window of the corpus is judged at its anchors, and about one position in 140 is one.

Anchors start in buckets by their q-gram.  A bucket of one has no repeat and leaves.  The
members of the others carry a pointer to their bucket and are refined on the identifiers
of pieces at further offsets: pairs (bucket pointer, identifier) are grouped into
narrower buckets, whose pointers are what the next turn refines.  A turn deals with the
windows of an anchor in blocks.  All windows of a block hold its core and lie in its hull:
a core that is alone ends the block, a hull that is not alone settles it at once, and
only blocks between the two are split for the next turn, down to single windows.  Copies
are thus settled whole, and only the surroundings of their ends are refined.

Counts are aggregates with map-side combine, buckets come back to their members by joins
(which the runtime splits for a hot bucket), and identifiers are 128 bits with the
pointer.  Texts travel twice, compressed.

Defined results: a null text is empty; texts under ``LENGTH`` bytes are kept; repeated
rows repeat each other's text, so both lose it; null ids are ids; an empty table gives no
rows; very long texts are read in overlapping segments, so memory does not follow them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm.common import documents, query, text_of
from weirgauge.session import staged

LENGTH = 400
GRAM = 128
REACH = LENGTH - GRAM  # a window starts at most this far before its anchor
BLOCK = 12
SEGMENT = 1 << 21
MULTIPLIER = 0x9E3779B97F4A7C15  # odd
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for positions of a segment."""
    if not _powers:
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 2**64)):
            row = np.full(SEGMENT + 1, base, dtype=np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers[0], _powers[1]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return out if have == width else pick(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])


def anchors_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, near, far) of the anchors in ``data`` (texts one after another, ``ends`` their ends)."""
    if len(data) < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 3
    up, down = powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
    grams = len(data) - GRAM + 1
    h = (sums[GRAM:] - sums[:-GRAM]) * down[:grams]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) | np.uint64(1)
    least = _sliding(h, REACH + 1, np.minimum)  # of each window
    starts = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(len(least) + 1, dtype=np.int64)  # windows inside one text
    fits = ends - starts >= LENGTH
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, (ends - LENGTH + 1)[fits], -1)
    least = np.where(np.cumsum(whole[:-1]) > 0, least, np.uint64(0))
    edge = np.zeros(REACH, dtype=np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
    found = np.flatnonzero(most == h)
    near, far = owned(found, h[found])
    some = near <= far
    return found[some], near[some], far[some]


def owned(found: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows each anchor owns: those that start ``near`` to ``far`` before it and have it as their first smallest."""
    near, far = np.zeros(len(found), dtype=np.int64), np.full(len(found), REACH, dtype=np.int64)
    for sign, bound in ((-1, far), (1, near)):
        left, step = np.arange(len(found)), 0
        while len(left):
            step += 1
            other = left + sign * step
            left, other = left[(other >= 0) & (other < len(found))], other[(other >= 0) & (other < len(found))]
            gap = np.abs(found[other] - found[left])
            close = gap <= REACH
            left, other, gap = left[close], other[close], gap[close]
            stops = value[other] <= value[left] if sign < 0 else value[other] < value[left]
            bound[left[stops]] = gap[stops] - 1 if sign < 0 else REACH + 1 - gap[stops]
            left = left[~stops]
    return near, far


def segments(bodies: Iterator[bytes]) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Texts put together up to a segment: (row, offset of its first byte) for each text, and the bytes.

    Long texts come in several segments that overlap by a byte less than a window, so that
    every window is in one segment.
    """
    rows, offsets, held, size = [], [], [], 0
    for row, body in enumerate(bodies):
        step = SEGMENT - LENGTH + 1
        for start in range(0, max(1, len(body) - LENGTH + 1), step):
            part = body[start : start + SEGMENT]
            if size + len(part) > SEGMENT:
                yield rows, offsets, held
                rows, offsets, held, size = [], [], [], 0
            rows.append(row)
            offsets.append(start)
            held.append(part)
            size += len(part)
    if rows:
        yield rows, offsets, held


def hull_id(body: bytes, a: int, near: int, far: int) -> int:
    """Identifier of the windows that start ``near`` to ``far`` before the anchor at ``a``: their bytes and where they lie."""
    return _signed(xxhash.xxh3_64_intdigest(body[a - far : a - near + LENGTH], seed=near << 32 | far))


def _signed(x: int) -> int:
    return x - 2**63


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(id, content, a, near, far, bucket, hull) for every anchor of ``texts`` (id, content, body); near and far bound its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("body")
            ids, contents = batch.column("id"), batch.column("content")
            for rows, offsets, parts in segments(b.as_py() for b in column):
                data = b"".join(parts)
                ends = np.cumsum([len(p) for p in parts])
                found, near, far = anchors_of(np.frombuffer(data, dtype=np.uint8), ends)
                of = np.searchsorted(ends, found, side="right")
                starts = np.concatenate([[0], ends[:-1]])
                far = np.minimum(far, found - starts[of])  # windows lie inside the text
                near = np.maximum(near, found + LENGTH - ends[of])
                some = near <= far
                found, near, far, of = found[some], near[some], far[some], of[some]
                places = list(zip(found.tolist(), near.tolist(), far.tolist(), strict=True))
                bucket = [_signed(xxhash.xxh3_64_intdigest(data[p : p + GRAM])) for p, _, _ in places]
                whole = [hull_id(data, p, n, f) for p, n, f in places]
                own = pa.array(np.asarray(rows, dtype=np.int32)[of], pa.int32())
                at = np.asarray(offsets, dtype=np.int64)[of] + found - starts[of]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(own), contents.take(own), pa.array(at, pa.int64()), pa.array(near, pa.int32()), pa.array(far, pa.int32()),
                        pa.array(bucket, pa.int64()), pa.array(whole, pa.int64()),
                    ],
                    ["id", "content", "a", "near", "far", "bucket", "hull"],
                )

    return texts.mapInArrow(run, "id bigint, content int, a bigint, near int, far int, bucket bigint, hull bigint")


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur in more than one row."""
    busy = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    return rows.join(busy, keys, "left_semi")


def refined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Members of shared buckets with ``settled`` (their hull is shared too) and ``open`` (the next turn needs them).

    Open are the members that are not settled and, as their partners, one member of each
    settled hull in a bucket that has an open member.
    """
    members = staged(shared(rows, keys))
    place = F.struct(*[c for c in ("id", "content", "a", "near")])
    hulls = members.groupBy(*keys, "hull").agg(F.count(F.lit(1)).alias("same"), F.min(place).alias("head")).where("same > 1")
    hulls = hulls.select(*[F.col(k).alias(f"h_{k}") for k in [*keys, "hull"]], "head")
    on = [F.col(k) == F.col(f"h_{k}") for k in [*keys, "hull"]]
    judged = staged(
        members.join(hulls, on, "left").select(
            *members.columns, F.col("head").isNotNull().alias("settled"), F.coalesce(place == F.col("head"), F.lit(False)).alias("first")
        )
    )
    unsettled = judged.where("not settled").select(*[F.col(k).alias(f"o_{k}") for k in keys]).distinct().withColumn("needed", F.lit(True))
    joined = judged.join(unsettled, [F.col(k) == F.col(f"o_{k}") for k in keys], "left")
    is_open = ~F.col("settled") | (F.col("first") & F.col("needed").isNotNull())
    return staged(joined.select(*members.columns, "settled", is_open.alias("open")))


def packed_texts(texts: DataFrame) -> DataFrame:
    """``texts`` with compressed bodies, for the way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = pa.array([press.compress(b.as_py()) for b in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("content"), small], ["id", "content", "body"])

    return texts.mapInArrow(run, "id bigint, content int, body binary")


def _open(column: pa.Array) -> Iterator[bytes]:
    press = zstandard.ZstdDecompressor()
    for small in column:
        yield press.decompress(small.as_py())


def _same_text(names: tuple[str, str]) -> Column:
    return F.col("id").eqNullSafe(F.col(names[0])) & (F.col("content") == F.col(names[1]))


def surroundings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, content, a, near, far, bucket, around) for the ``wanted`` anchors: the bytes that their windows cover."""
    lists = wanted.groupBy(F.col("id").alias("w_id"), F.col("content").alias("w_content")).agg(
        F.collect_set(F.struct("a", "near", "far", "bucket")).alias("anchors")
    )
    joined = packed_texts(texts).join(lists, _same_text(("w_id", "w_content"))).select("id", "content", "body", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents = batch.column("id"), batch.column("content")
            for row, (body, found) in enumerate(zip(_open(batch.column("body")), batch.column("anchors"), strict=True)):
                found = found.as_py()
                own = pa.array([row] * len(found), pa.int32())
                column = lambda name, kind: pa.array([x[name] for x in found], kind)  # noqa: B023, E731
                around = [body[x["a"] - x["far"] : x["a"] - x["near"] + LENGTH] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(own), contents.take(own), column("a", pa.int64()), column("near", pa.int32()), column("far", pa.int32()),
                        column("bucket", pa.int64()), pa.array(around, pa.binary()),
                    ],
                    ["id", "content", "a", "near", "far", "bucket", "around"],
                )

    return joined.mapInArrow(run, "id bigint, content int, a bigint, near int, far int, bucket bigint, around binary")


def block_rows(around: DataFrame, width: int) -> DataFrame:
    """Blocks of windows of each anchor: (id, content, a, near, far, bucket, core, hull).

    Blocks start at multiples of ``width``, so that those of equal windows are equal; an
    anchor has the parts that it owns.  A block's core is that of the whole block, as far
    as the bytes at hand reach.  ``split`` names the blocks to divide, where it is there.
    """
    chosen = "split" in around.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, a, bucket = (batch.column(c) for c in ("id", "content", "a", "bucket"))
            rows, nears, fars, cores, hulls = [], [], [], [], []
            near_of, far_of, bodies = batch.column("near").to_pylist(), batch.column("far").to_pylist(), batch.column("around")
            splits = batch.column("split").to_pylist() if chosen else None
            for row in range(batch.num_rows):
                body, low, high = bodies[row].as_py(), near_of[row], far_of[row]
                at = high  # the anchor's place in ``body``
                first, last = (splits[row], min(high, splits[row] // BLOCK * BLOCK + BLOCK - 1)) if chosen else (low, high)
                near = first
                while near <= last:
                    far = min(near // width * width + width - 1, last)
                    start = near // width * width
                    core = _core(body, at, start, width)
                    rows.append(row)
                    nears.append(near)
                    fars.append(far)
                    cores.append(_signed(xxhash.xxh3_64_intdigest(core, seed=start)))
                    hulls.append(hull_id(body, at, near, far) if width > 1 else 0)
                    near = far + 1
            own = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(own), contents.take(own), a.take(own), pa.array(nears, pa.int32()), pa.array(fars, pa.int32()),
                    bucket.take(own), pa.array(cores, pa.int64()), pa.array(hulls, pa.int64()),
                ],
                ["id", "content", "a", "near", "far", "bucket", "core", "hull"],
            )

    return around.mapInArrow(run, "id bigint, content int, a bigint, near int, far int, bucket bigint, core bigint, hull bigint")


def _core(body: bytes, at: int, start: int, width: int) -> bytes:
    """Bytes that all windows of a whole block share: from ``start`` before the anchor to the end of the furthest window."""
    return body[at - start : at - (start + width - 1) + LENGTH]


def repeats(texts: DataFrame) -> DataFrame:
    """(id, content, low, high): strings of ``texts`` that hold only repeated windows; they may overlap."""
    span = ["id", "content", (F.col("a") - F.col("far")).alias("low"), (F.col("a") - F.col("near") + LENGTH).alias("high")]
    turn0 = refined(anchor_rows(texts), ["bucket"])
    around = staged(surroundings(texts, turn0.where("open")))
    turn1 = refined(block_rows(around, BLOCK), ["bucket", "core"])
    split = turn1.where("open").select(
        F.col("id").alias("b_id"), F.col("content").alias("b_content"), F.col("a").alias("b_a"), F.col("near").alias("split"), F.col("far").alias("b_far")
    ).distinct()
    inside = F.col("split").between(F.col("near"), F.col("far"))  # long texts can have an anchor twice, with other windows
    pieces = around.join(split, _same_text(("b_id", "b_content")) & (F.col("a") == F.col("b_a")) & inside).select(*around.columns, "split")
    turn2 = shared(block_rows(pieces, 1), ["bucket", "core"])
    settled = [t.where("settled").select(*span) for t in (turn0, turn1)]
    return settled[0].unionByName(settled[1]).unionByName(turn2.select(*span))


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``docs``."""
    body = text_of(F.col(f"`{text}`"))
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.hash(body).alias("content"), body.cast("binary").alias("body"))
    found = repeats(texts).groupBy(F.col("id").alias("r_id"), F.col("content").alias("r_content")).agg(
        F.collect_set(F.struct("low", "high")).alias("spans")
    )
    joined = packed_texts(texts).join(found, _same_text(("r_id", "r_content")), "left").select("id", "body", F.sort_array("spans").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(_open(batch.column("body")), batch.column("spans"), strict=True):
                merged: list[list[int]] = []
                for s in spans.as_py() or ():
                    if merged and s["low"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["high"])
                    else:
                        merged.append([s["low"], s["high"]])
                kept, at = [], 0
                for low, high in merged:
                    kept.append(body[at:low])
                    at = high
                left = b"".join([*kept, body[at:]])
                out.append((len(body), len(body) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cut(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
