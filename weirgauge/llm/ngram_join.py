"""Jaccard join on word shingles: a size-aware heavy-light join with exact links.

A pair whose smaller set has fewer shingles than a boundary is light: all subsets of a
fixed size are enumerated, that size being the least overlap a linked pair can have, and
linked sets meet in a common subset.  Other pairs are heavy: inverted lists of shingles,
rarest first, are scanned.  The boundary is the one of least cost for the sizes at hand.

Heavy sets without any partner are dropped before lists are built: the shingles of a set
are dealt by hash to one segment more than a linked pair can differ in, so that linked
sets agree in a whole segment, and a set that shares no segment has no link.  Keys of segments
are counted first; a fixed number of bits then tells most keys of a single set, which are
not shuffled a second time.  Empty segments
count only for sets that have so many that a pair could agree in nothing else.  What stays
has its shingles counted exactly; a set enters the lists of its rarest shingles only
(prefix of 0.1 n + 1 at 0.9), and a place in that order bounds the overlap that is still possible.

Shingle width and threshold are a ``Rule``; three words and 0.9 are those of op7's contract.

Lists are split by size, so that a list holds sets of two neighbouring steps of sizes and
every pair that can be linked is together in one.  They are never turned into all their
pairs.  Each set is compared with one centre (the member of its lists with the fewest rare
shingles); what is then still in another component than a fellow of a list, and can still
reach the overlap, is compared with it.
Equal sets are one set throughout.  Every comparison is an exact intersection.

Defined results: null and empty texts have no set, link with nothing and are their own
component; rows sharing an id (null counts as an id) are one document with the links of
any of them; a class is named by its smallest id that is not null, if it has one; fewer words
than a shingle has make one shingle; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm.common import documents, lower_ascii, packed, query, text_of, unpacked, words
from weirgauge.llm.components import components
from weirgauge.session import staged


class Rule(NamedTuple):
    """Words of a shingle, and the least Jaccard of a link as a fraction."""

    width: int = 3
    num: int = 9
    den: int = 10


CONTRACT = Rule()
LARGEST_BOUNDARY = 40
CLASS_RATIO = 1.5  # sizes of a class of heavy sets differ by this factor at most
NO_ID = 2**63 - 1  # a null id is the last one, so that a class is named by an id where it has one
MARKS = 1 << 26  # bits that tell keys of several sets from others before they are shuffled again
#: A-Z in lower case; bytes.split() parts words at the same characters as the contract.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles_of(texts: list[bytes], rule: Rule = CONTRACT) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values): the distinct 64-bit shingle hashes of each text, ascending, one text after another.

    A text with fewer words than a shingle has is one shingle of its own kind.
    """
    spoken = [t.translate(FOLDED).split() for t in texts]
    counts = [len(w) for w in spoken]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(spoken)), dtype=np.uint64, count=sum(counts))
    padded = np.concatenate([h, np.zeros(rule.width, dtype=np.uint64)])
    total = np.zeros(len(h), dtype=np.uint64)
    for k in range(rule.width):
        total += padded[k : k + len(h)] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
    whole = _mix(total, rule.width).view(np.int64)
    values, at = [whole[:0]], 0
    for n in counts:
        if n >= rule.width:
            values.append(np.unique(whole[at : at + n - rule.width + 1]))
        elif n:
            values.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + n].tobytes(), seed=n) - 2**63], dtype=np.int64))
        else:
            values.append(whole[:0])
        at += n
    return np.array([len(v) for v in values[1:]], dtype=np.int64), np.concatenate(values)


def in_runs(batch: pa.RecordBatch, size: int = 2_000_000) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(nodes, texts) of a batch in runs of about so many bytes of text."""
    node, texts = batch.column("node"), batch.column("text")
    start, held = 0, 0
    for at, length in enumerate(pc.binary_length(texts).to_pylist(), 1):
        held += length
        if held >= size or at == len(texts):
            yield node.slice(start, at - start), texts.slice(start, at - start).to_pylist()
            start, held = at, 0


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text): the id, null as ``NO_ID``, and the text as bytes."""
    node = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID))
    return docs.select(node.alias("node"), text_of(F.col(f"`{text}`")).cast("binary").alias("text"))


def set_names(sizes: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """128 bits for each set, as two signed numbers."""
    out, at = [], 0
    for n in sizes.tolist():
        whole = xxhash.xxh3_128_intdigest(values[at : at + n].tobytes())
        out.append(((whole >> 64) - 2**63, (whole & 2**64 - 1) - 2**63))
        at += n
    return out


def shingle_sets(docs: DataFrame, doc_id: str, text: str, rule: Rule = CONTRACT) -> DataFrame:
    """(node, sh) for each row; sh holds distinct 64-bit shingle hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, texts in (run for batch in batches for run in in_runs(batch)):
            sizes, values = shingles_of(texts, rule)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "sh"])

    return _texts(docs, doc_id, text).mapInArrow(run, "node bigint, sh array<bigint>")


def named_sets(docs: DataFrame, doc_id: str, text: str, rule: Rule = CONTRACT) -> DataFrame:
    """(node, n, a, b) for each row: size and name of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, texts in (run for batch in batches for run in in_runs(batch)):
            sizes, values = shingles_of(texts, rule)
            names = set_names(sizes, values)
            columns = [node, pa.array(sizes.astype(np.int32)), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "a", "b"])

    return _texts(docs, doc_id, text).mapInArrow(run, "node bigint, n int, a bigint, b bigint")


def least_overlap(n: int, m: int, rule: Rule = CONTRACT) -> int:
    """Smallest overlap of a linked pair of these sizes."""
    return -(-rule.num * (n + m) // (rule.num + rule.den))


def most_apart(total: int, rule: Rule = CONTRACT) -> int:
    """Largest number of shingles that only one of a linked pair has, for the sum of their sizes."""
    return (rule.den - rule.num) * total // (rule.num + rule.den)


def light_tags(size: int, boundary: int, rule: Rule = CONTRACT) -> range:
    """Sizes of the smaller set of the light pairs that a set of ``size`` can be in."""
    return range(-(-rule.num * size // rule.den), min(size, boundary - 1) + 1)


def prefix_beyond_one(size: int | Column, rule: Rule) -> int | Column:
    """A linked partner has one of the rarest shingles of a set, this many and one."""
    most = size * (rule.den - rule.num)
    return most // rule.den if isinstance(size, int) else F.call_function("div", most, F.lit(rule.den))


def light_cost(size: int, boundary: int, rule: Rule = CONTRACT) -> int:
    return sum(math.comb(size, least_overlap(n, n, rule)) for n in light_tags(size, boundary, rule))


def choose_boundary(sizes: dict[int, int], rule: Rule = CONTRACT) -> int:
    """Boundary of least cost; ``sizes`` counts sets by size (those above the largest boundary are heavy anyway)."""

    def cost(boundary: int) -> int:
        total = 0
        for size, count in sizes.items():
            total += count * light_cost(size, boundary, rule)
            if size >= boundary:  # keys of segments, counted and joined; shingles, the same; places in lists
                total += count * (2 * (most_apart(2 * size, rule) + 1) + 2 * size + prefix_beyond_one(size, rule) + 1)
        return total

    return min(range(1, LARGEST_BOUNDARY + 1), key=cost)


def subset_keys(sh: Iterable[int], boundary: int, rule: Rule = CONTRACT) -> Iterator[int]:
    """Hashes of the fixed-size subsets of one set; ``sh`` ascending."""
    values = np.asarray(sh, dtype=np.int64)
    for n in light_tags(len(values), boundary, rule):
        size = least_overlap(n, n, rule)
        for chosen in itertools.combinations(range(len(values)), size):
            key = values[list(chosen)].tobytes()
            yield xxhash.xxh64_intdigest(key, seed=n) - 2**63


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Multiply-xorshift mixing of 64-bit numbers."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def size_classes(boundary: int, largest: int) -> list[tuple[int, int]]:
    out, low = [], boundary
    while low <= largest:
        high = max(low, int(low * CLASS_RATIO))
        out.append((low, high))
        low = high + 1
    return out


def segment_keys(
    lengths: np.ndarray, values: np.ndarray, boundary: int, rule: Rule = CONTRACT
) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) for the segments of the heavy sets.

    ``values`` holds the sets one after another.  Pairs of one size class meet under the
    class's tag, pairs across two classes under the tag of their border.  An empty segment
    has a key only where a linked pair could agree in empty segments alone.
    """
    sets, keys = [], []
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    classes = size_classes(boundary, int(lengths.max(initial=0)))
    groups = []
    for number, (low, high) in enumerate(classes):
        groups.append((2 * number, low, high, most_apart(2 * high, rule) + 1))
        over = high * rule.den // rule.num  # largest partner of a set of the class
        if over > high:
            groups.append((2 * number + 1, -(-rule.num * (high + 1) // rule.den), over, most_apart(high + over, rule) + 1))
    for tag, low, high, least in groups:
        own = np.flatnonzero((lengths >= low) & (lengths <= high))
        if not len(own):
            continue
        n = lengths[own]
        segments = least + least // 16 + 1 if high < 6 * least else least  # small segments: some more, to need no empty ones
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(starts[own] - (ends - n), n)
        x = values[at].view(np.uint64)
        part = _mix(x, 2 * tag + 1) % np.uint64(segments)
        slot = np.repeat(np.arange(len(own)) * segments, n) + part.astype(np.int64)
        total = np.zeros(len(own) * segments, dtype=np.uint64)
        np.add.at(total, slot, _mix(x, 2 * tag + 2))
        full = np.zeros(len(own) * segments, dtype=bool)
        full[slot] = True
        most = np.minimum(least - 1, (rule.den - rule.num) * (n + np.minimum(high, n * rule.den // rule.num)) // (rule.num + rule.den))
        none_needed = segments - full.reshape(len(own), segments).sum(axis=1) < segments - most
        told = np.flatnonzero(full | ~np.repeat(none_needed, segments))
        number = (told % segments).astype(np.uint64) + np.uint64((tag + 1) << 32)
        sets.append(own[told // segments])
        keys.append(_mix(total[told] + _mix(number, 3), 5).view(np.int64))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(sets), np.concatenate(keys)) if sets else (none, none)


def _all_keys(sizes: np.ndarray, values: np.ndarray, boundary: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key): segments of heavy sets and subsets of small ones."""
    sets, keys = segment_keys(sizes, values, boundary, rule)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    more = [(sets, keys)]
    for one in np.flatnonzero((sizes > 0) & (rule.num * sizes < rule.den * boundary)):
        own = np.fromiter(subset_keys(values[starts[one] : starts[one] + sizes[one]], boundary, rule), dtype=np.int64)
        more.append((np.full(len(own), one), own))
    return np.concatenate([m[0] for m in more]), np.concatenate([m[1] for m in more])


def meeting_keys(docs: DataFrame, doc_id: str, text: str, boundary: int, rule: Rule = CONTRACT, among: np.ndarray | None = None) -> DataFrame:
    """(key, a): linked sets that differ share at least one key; a names the set, so copies of a text are one.

    ``among`` are bits of keys (``marked_keys``): keys whose bit is not set are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in (run for batch in batches for run in in_runs(batch)):
            sizes, values = shingles_of(texts, rule)
            sets, keys = _all_keys(sizes, values, boundary, rule)
            if shared is not None:
                bit = keys & (MARKS - 1)
                kept = (shared.value[bit >> 5] >> (bit & 31)) & 1 == 1
                sets, keys = sets[kept], keys[kept]
            names = np.array([a for a, _ in set_names(sizes, values)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names[sets] if len(names) else keys)], ["key", "a"])

    return _texts(docs, doc_id, text).mapInArrow(run, "key bigint, a bigint")


def marked_keys(keys: DataFrame) -> np.ndarray:
    """Bits of ``keys`` by their last 26 bits: at most two million numbers, however many keys there are."""
    bit = F.col("key").bitwiseAND(MARKS - 1)
    marks = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(32)).cast("int")))
    found = keys.groupBy(F.shiftright(bit, 5).cast("int").alias("word")).agg(marks.alias("bits")).toArrow()
    out = np.zeros(MARKS // 32, dtype=np.int64)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return out


def _close(n: Column, m: Column, overlap: Column, rule: Rule) -> Column:
    """Whether sets of these sizes with this overlap are linked."""
    return overlap * rule.den >= (n + m - overlap) * rule.num


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """The linked ones of ``pairs`` (u, v), by exact intersection."""
    left = sets.select(F.col("node").alias("u"), F.col("sh").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("sh").alias("sv"))
    both = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(_close(F.size("su"), F.size("sv"), common, rule)).select("u", "v").distinct()


def list_entries(sets: DataFrame, boundary: int, rule: Rule = CONTRACT) -> DataFrame:
    """Entries of the inverted lists: (light, key, node, n, pos); pos shingles of the set come before the key's."""
    heavy = sets.where(F.size("sh") >= boundary)
    each = heavy.select("node", F.explode("sh").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = (
        each.join(shared, "key")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("common"))
        .join(heavy.select("node", F.size("sh").alias("n")), "node")
    )
    prefix = prefix_beyond_one(F.col("n"), rule) + 1
    alone = F.col("n") - F.size("common")  # shingles that no other set has are the rarest
    chosen = F.slice("common", 1, F.greatest((prefix - alone).cast("int"), F.lit(0)))
    lists = ordered.select("node", "n", alone.alias("alone"), F.posexplode(chosen).alias("j", "c")).select(
        F.lit(False).alias("light"), F.col("c.key").alias("key"), "node", "n", (F.col("alone") + F.col("j")).alias("pos")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, sh in zip(batch.column("node").to_pylist(), batch.column("sh").to_pylist(), strict=True):
                keys = list(subset_keys(sh, boundary, rule))
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array([node] * len(keys), pa.int64()),
                        "key": pa.array(keys, pa.int64()),
                        "n": pa.array([len(sh)] * len(keys), pa.int32()),
                    }
                )

    small = sets.where((F.size("sh") > 0) & (F.size("sh") * rule.num < rule.den * boundary))
    light = small.mapInArrow(run, "node bigint, key bigint, n int").select(
        F.lit(True).alias("light"), "key", "node", "n", F.lit(0).alias("pos")
    )
    return lists.unionByName(light)


def by_size(entries: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """Each entry under two numbers: its step of sizes and the one below.

    The sizes of a pair that can be linked are in the same step or in neighbouring ones.
    """
    width = math.log(rule.den / rule.num) * (1 + 1e-9)  # a little wider, so that rounding cannot part a pair
    step = F.floor(F.log(F.col("n")) / width).cast("int")
    return entries.withColumn("step", F.explode(F.array(step - 1, step)))


def links(sets: DataFrame, boundary: int, rule: Rule = CONTRACT) -> DataFrame:
    """Links (u, v) that join the same sets as all links do; ``sets`` holds distinct sets."""
    entries = by_size(staged(list_entries(sets, boundary, rule)), rule)
    lists = entries.groupBy("light", "key", "step").agg(
        F.min(F.struct("pos", "node", "n")).alias("c"), F.min("n").alias("least"), F.count(F.lit(1)).alias("members")
    ).where("members > 1")
    met = entries.join(lists, ["light", "key", "step"])
    reach = F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos"))
    stars = (
        met.where((F.col("node") != F.col("c.node")) & _close(F.col("n"), F.col("c.n"), reach, rule))
        .groupBy("node", F.col("c.node").alias("centre"))
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("node")
        .agg(F.max_by("centre", F.struct("times", -F.col("centre"))).alias("centre"))
    )
    first = staged(verified(stars.select(F.col("node").alias("u"), F.col("centre").alias("v")), sets, rule))
    known = components(first)
    # a set can still need a fellow of its list: the best one has just the shingles from this place on, or is the smallest
    left = F.col("n") - F.col("pos")
    placed = (
        met.where(_close(F.col("n"), F.greatest(F.col("least"), left), left, rule))
        .join(known, "node", "left")
        .select("light", "key", "step", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    )
    open_lists = placed.groupBy("light", "key", "step").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo < hi")
    rest = staged(placed.join(open_lists.select("light", "key", "step"), ["light", "key", "step"]))
    other = rest.select(*[F.col(c).alias(f"{c}_2") for c in rest.columns])
    same = [F.col(c) == F.col(f"{c}_2") for c in ("light", "key", "step")]
    both = rest.join(other, [*same, F.col("node") < F.col("node_2")])
    reach = F.least(F.col("n") - F.col("pos"), F.col("n_2") - F.col("pos_2"))
    pairs = both.where((F.col("component") != F.col("component_2")) & _close(F.col("n"), F.col("n_2"), reach, rule))
    left_over = pairs.select(F.col("node").alias("u"), F.col("node_2").alias("v")).distinct()
    return first.unionByName(verified(left_over, sets, rule))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """(node, n_shingles, component) for each row of ``docs``; component is the smallest id reachable by links."""
    about = staged(named_sets(docs, doc_id, text, rule))
    small = f"n between 1 and {LARGEST_BOUNDARY * rule.den // rule.num + 1}"
    sizes = {r["n"]: r["count"] for r in about.where(small).groupBy("n").count().collect()}  # one row for each small size
    boundary = choose_boundary(sizes) if rule == CONTRACT else choose_boundary(sizes, rule)
    heads = staged(about.where("n > 0").groupBy("n", "a", "b").agg(F.min("node").alias("head")))
    every = meeting_keys(docs, doc_id, text, boundary, rule)
    busy = staged(every.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo < hi").select("key"))
    again = meeting_keys(docs, doc_id, text, boundary, rule, marked_keys(busy))
    partnered = staged(again.join(busy, "key", "left_semi").select("a").distinct())
    chosen = staged(heads.join(partnered, "a", "left_semi").select(F.col("head").alias("node")).distinct())
    id_column = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NO_ID))
    texts = docs.select(id_column.alias("__id"), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).join(
        chosen, F.col("__id") == F.col("node"), "left_semi"
    )
    candidates = staged(shingle_sets(texts, doc_id, text, rule))
    joined = links(candidates, boundary, rule)
    # rows that share an id, and rows with equal sets, are linked through their head
    equal = about.where("n > 0").join(heads, ["n", "a", "b"]).select(F.col("node").alias("u"), F.col("head").alias("v"))
    found = components(joined.unionByName(equal))
    return about.join(found, "node", "left").select(
        "node", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "node").alias("component")
    )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """Exactly one row of each class, one with its smallest id (null last); rows without a word all stay.

    A row is known by its id, and by id and words where several rows share the id.
    """
    own = F.coalesce(F.col(f"row.`{doc_id}`").cast("bigint"), F.lit(NO_ID)).alias("id")
    said = words(lower_ascii(text_of(F.col(f"row.`{text}`"))))
    shared = staged(packed(docs).select(own).groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again")))
    rows = packed(docs).select("row", own).join(shared, "id", "left").select(
        "row",
        "id",
        F.coalesce("again", F.lit(False)).alias("again"),
        F.when(F.col("again"), F.xxhash64("id", said)).otherwise(F.col("id")).alias("node"),
    )
    found = near_classes(rows.select(F.col("node").alias("doc_id"), F.col(f"row.`{text}`").alias("text")), rule=rule)
    ids = rows.where("again").select("node", "id").distinct()
    known = staged(
        found.where("n_shingles > 0").select("node", "component").distinct().join(ids, "node", "left").select(
            "node", "component", F.coalesce("id", "node").alias("id")
        )
    )
    first = known.groupBy("component").agg(F.min(F.struct("id", "node")).alias("first"))
    gone = staged(known.join(first, "component").where(F.col("node") != F.col("first.node")).select("node"))
    wordless = F.size(said) == 0
    single = rows.where(~F.col("again") | wordless).join(gone, "node", "left_anti")
    several = rows.where(F.col("again") & ~wordless).join(gone, "node", "left_anti").dropDuplicates(["node"])
    return unpacked(single.select("row").unionByName(several.select("row")), docs.columns)


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(documents(spark, sf_dir).select("doc_id", "text"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(named("node").alias("doc_id"), "n_shingles", named("component").alias("component_id"))
