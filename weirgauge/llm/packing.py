"""Best-fit packing of token sequences by linear grouping.

Documents are tokenised where they lie and only lengths travel.  The number of pieces of
each length (at most ``capacity`` numbers, however many documents there are) decides the
plan: large lengths are rounded up within groups of equal cardinality, the fewest
sequences for the rounded lengths are found over all configurations (column generation
with a small simplex), actual lengths take the places of the rounded ones, and what is
left is put in by best fit, longest first.  Equal sequences are planned together, so the
plan has a few rows for each length.  Pieces are numbered within their length, in as
many tasks as there are partitions, and each looks its place up in the plan.

Defined results: a null text has no tokens, so its piece is the end id alone; repeated
rows are packed each; a piece never spans two sequences and only documents above the
capacity are cut; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirgauge.llm.common import documents, query
from weirgauge.llm.token_counts import compiled
from weirgauge.session import staged

CAPACITY = 2048
GROUPS = 300  # groups of equal cardinality
LARGE = 3  # lengths above capacity / LARGE are grouped; a configuration has fewer than LARGE of them


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_bytes(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers, by the compiled tokenizer."""
    return compiled(path).ids(texts)


def at_once(texts: Iterator[str], characters: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts with about so many characters together."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= characters:
            yield run
            run, held = [], 0
    if run:
        yield run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece."""
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = (t.as_py() or "" for t in batch.column("text"))
            found = (ids for some in at_once(texts) for ids in id_bytes(some, tokenizer))
            for one, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids += end
                total = len(ids) // 4
                for number, start in enumerate(range(0, total, capacity)):
                    part = ids[start * 4 : (start + capacity) * 4]
                    rows.append((one, number, start, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    named = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """Every multiset of sizes that fits, as rows of their places; the place after the last stands for no size."""
    none = len(sizes)
    out = [
        chosen + (none,) * (LARGE - 1 - many)
        for many in range(1, LARGE)
        for chosen in itertools.combinations_with_replacement(range(none), many)
        if sum(sizes[i] for i in chosen) <= capacity
    ]
    return np.array(out, dtype=np.int64).reshape(-1, LARGE - 1)


def few_configurations(sizes: list[int], needed: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(counts by size, sequences) that hold the needed items, up to a remainder below one sequence for each configuration.

    Simplex over all configurations: starts from one configuration for each size and
    brings in the one of most worth at the present prices until none is worth more than
    a sequence.  A basic solution has no more configurations than sizes.
    """
    if not sizes:
        return []
    options, many = configurations(sizes, capacity), len(sizes)
    counts = lambda places: np.bincount(places, minlength=many + 1)[:many]
    basis = [counts(np.repeat(i, capacity // s)) for i, s in enumerate(sizes)]
    inverse, want = np.diag([1.0 / (capacity // s) for s in sizes]), np.array(needed, dtype=float)
    least, since = np.inf, 0
    while since < many:  # turns without gain are few unless the simplex goes round in circles
        prices = np.append(inverse.sum(axis=0), 0.0)
        worth = prices[options].sum(axis=1)
        best = int(np.argmax(worth))
        now = float((prices[:-1] * want).sum())
        least, since = (now, 0) if now < least * (1 - 1e-7) else (least, since + 1)
        if worth[best] <= 1 + 1e-9:
            break
        config = counts(options[best])
        direction, amount = (inverse * config).sum(axis=1), np.maximum((inverse * want).sum(axis=1), 0)
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[out] = config
        pivot = inverse[out] / direction[out]
        inverse -= direction[:, None] * pivot
        inverse[out] = pivot
    amount = (inverse * want).sum(axis=1)
    return [(tuple(int(x) for x in basis[j]), int(amount[j] + 1e-9)) for j in range(many) if amount[j] >= 1]


class Plan:
    """Places for pieces known by their length and number within it."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c}  # pieces still without a place
        self.next = dict.fromkeys(self.left, 0)  # their lowest number
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, sequences)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, from, to, first sequence, in each, offset
        self._configured()
        self._best_fit()

    def _take(self, length: int, items: int, sequence: int, each: int, offset: int) -> None:
        start = self.next[length]
        self.rows.append((length, start, start + items, sequence, each, offset))
        self.next[length] += items
        self.left[length] -= items

    def _groups(self) -> list[list[int]]:
        """Large lengths, longest first, cut into groups of about equally many pieces."""
        lengths = sorted((n for n in self.left if n * LARGE > self.capacity), reverse=True)
        share = sum(self.left[n] for n in lengths) / GROUPS
        groups, held = [], share
        for n in lengths:
            if held >= share:
                groups.append([])
                held = 0
            groups[-1].append(n)
            held += self.left[n]
        return groups

    def _configured(self) -> None:
        groups = self._groups()
        needed = [sum(self.left[n] for n in g) for g in groups]
        for config, times in few_configurations([g[0] for g in groups], needed, self.capacity):
            while times:
                heads = []  # (length, in each sequence) for the next sequences
                for group, many in zip(groups, config, strict=True):
                    for n in group:
                        if many and self.left[n]:
                            heads.append((n, min(many, self.left[n])))
                            many -= heads[-1][1]
                    if many:
                        heads = []
                        break
                if not heads:
                    break  # the remainder goes to best fit
                run = min(times, *(self.left[n] // k for n, k in heads))
                offset = 0
                for n, k in heads:
                    self._take(n, run * k, self.sequences, k, offset)
                    offset += n * k
                if offset < self.capacity:
                    self.open[self.capacity - offset].append((self.sequences, run))
                self.sequences += run
                times -= run

    def _best_fit(self) -> None:
        rooms = sorted(self.open)
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                room = next((r for r in rooms if r >= length and self.open[r]), None)
                if room is None:
                    room, each = self.capacity, self.capacity // length
                    first, many = self.sequences, -(-self.left[length] // each)
                    self.sequences += many
                else:
                    first, many = self.open[room].pop()
                    each = room // length
                full = min(many, self.left[length] // each)
                if full:
                    self._take(length, full * each, first, each, self.capacity - room)
                    self._leave(rooms, room - each * length, first, full)
                if full < many:
                    part = min(self.left[length], each - 1)
                    if part:
                        self._take(length, part, first + full, part, self.capacity - room)
                        self._leave(rooms, room - part * length, first + full, 1)
                        full += 1
                    if full < many:
                        self._leave(rooms, room, first + full, many - full)

    def _leave(self, rooms: list[int], room: int, first: int, many: int) -> None:
        if room:
            if room not in self.open:
                rooms.append(room)
                rooms.sort()
            self.open[room].append((first, many))


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (stored pieces with ``__part``) with sequence_id and offset."""
    spark = cut.sparkSession
    by_part = staged(cut.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = Plan(counts, capacity)
    columns = "p_length long, lo long, hi long, first long, each long, at long"
    places = spark.createDataFrame(plan.rows, columns).groupBy("p_length").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "first", "each", "at"))).alias("places")
    )
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(
        F.col("length").alias("s_length"), F.col("__part").alias("s_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_at")
    )
    here = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("here", F.row_number().over(here) - 1)
        .join(starts, (F.col("length") == F.col("s_length")) & (F.col("__part") == F.col("s_part")))
        .withColumn("rank", F.col("here") + F.col("start_at"))
        .join(places, F.col("length") == F.col("p_length"))
    )
    own: Column = F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0]
    ranked = ranked.withColumn("own", own).withColumn("step", F.col("rank") - F.col("own.lo"))
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("own.first") + F.call_function("div", F.col("step"), F.col("own.each"))).alias("sequence_id"),
        (F.col("own.at") + F.col("step") % F.col("own.each") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    cut = staged(pieces(docs, doc_id, text, capacity, tokenizer).withColumn("__part", F.spark_partition_id()))
    return placed(cut, capacity)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))
