"""Resampling documents by importance for a target distribution.

Features are runs of words, hashed to buckets by CRC.  Buckets are counted in the corpus and
in the target; the logarithm of the two smoothed shares is a bucket's gain, and a document's
weight is the sum over its features.  Adding seeded Gumbel noise and taking the highest
scores draws without replacement in proportion to the weights.

Words are found by an Aho-Corasick automaton.  Its entries are distinct words between two
delimiters, so that only whole words match, and each carries its payload (CRC, length).  A
scan emits payloads, and those of adjacent words are composed: the CRC of a run follows from
the CRCs of its parts and the length of the second, without reading the text again.  The
dictionary is the words that a worker has met, at most ``WORDS`` of them; words outside get
their payload from the text itself, so the bound changes nothing but speed.

Texts are scanned once.  Their buckets are written to the shared folder, and counting and
scoring read them from there.  Counts are added up in each task first; the driver gets one
gain for each bucket, a number that the caller sets.

Defined results: a null or empty text has no features and weight 0; every row gives one row,
repeated rows and null ids included (a null id draws as the empty id and is last among
ties); other columns, whatever their names, are not read; very long texts are scanned
whole; an empty corpus gives no rows and an empty target counts nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm.common import documents, query, ranked, text_of
from weirgauge.session import staged

BUCKETS = 10_000
ORDER = 1  # words in the longest feature
SEED = 2024
LEAST_WORDS = 20  # of a document that can be drawn
PERCENT = 10  # of those are drawn
WORDS = 200_000  # entries of a worker's dictionary
SCANNED = 4_000_000  # bytes scanned together
#: Bytes that may be in a word are kept, A-Z in lower case; all others are delimiters.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@cache
def zeros_operator(length: int) -> np.ndarray:
    """Tables (4, 256) of what ``length`` zero bytes do to a CRC, for each of its bytes."""

    def applied(columns: list[int], value: int) -> int:
        out = 0
        while value:
            low = value & -value
            out ^= columns[low.bit_length() - 1]
            value ^= low
        return out

    one_byte = [(zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0)) & 0xFFFFFFFF for i in range(32)]
    power, now = [1 << i for i in range(32)], one_byte
    while length:
        if length & 1:
            power = [applied(now, c) for c in power]
        now = [applied(now, c) for c in now]
        length >>= 1
    return np.array([[applied(power, byte << 8 * place) for byte in range(256)] for place in range(4)], dtype=np.uint32)


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of joined parts from those of the parts and the length of the second."""
    out = second.copy()
    for one in np.unique(length):
        own = length == one
        table = zeros_operator(int(one)) if one < 64 else zeros_operator.__wrapped__(int(one))
        crc = first[own]
        for place in range(4):
            out[own] ^= table[place][crc >> np.uint32(8 * place) & np.uint32(255)]
    return out


class Dictionary:
    """Words with their payloads, and the automaton that finds them between delimiters."""

    def __init__(self, most: int = WORDS):
        self.most = most
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.crc = np.zeros(0, dtype=np.uint32)
        self.fresh: dict[str, int] = {}  # words that the automaton does not have yet

    def settle(self) -> None:
        """Make the automaton anew once it would grow by a quarter or to its bound."""
        size = len(self.crc)
        if self.fresh and (len(self.fresh) * 4 > size or size + len(self.fresh) >= self.most):
            for place, word in enumerate(self.fresh, size):
                self.automaton.add_word(f" {word} ", place)
            self.crc = np.concatenate([self.crc, np.array(list(self.fresh.values()), dtype=np.uint32)])
            self.automaton.make_automaton()
            self.fresh = {}

    def payloads(self, folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, crc, length) of every word of a text that begins and ends with a delimiter."""
        blank = np.frombuffer(folded, dtype=np.uint8) == 32
        turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = turn[::2], turn[1::2]
        crc, known = np.zeros(len(starts), dtype=np.uint32), np.zeros(len(starts), dtype=bool)
        text = folded.decode("latin-1")  # one character for each byte
        if len(self.crc):
            found = np.fromiter(self.automaton.iter(text), dtype=np.dtype("i8,i8"))
            place = np.searchsorted(ends, found["f0"])
            crc[place], known[place] = self.crc[found["f1"]], True
        for i in np.flatnonzero(~known).tolist():
            crc[i] = zlib.crc32(folded[starts[i] : ends[i]])
            if len(self.crc) + len(self.fresh) < self.most:
                self.fresh[text[starts[i] : ends[i]]] = int(crc[i])
        self.settle()
        return starts, crc, ends - starts


_dictionaries: dict[int, Dictionary] = {}  # of this Python worker, by bound


def features(texts: list[bytes], order: int, dictionary: Dictionary) -> list[list[np.ndarray]]:
    """For each text, the CRCs of its runs of 1, 2, ... ``order`` words."""
    folded = b" " + b" ".join(t.translate(FOLDED) for t in texts) + b" "
    starts, crc, length = dictionary.payloads(folded)
    borders = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    cuts = np.searchsorted(starts, borders + 1)
    blank = np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32)
    runs, out = crc, [[] for _ in texts]
    for words in range(1, order + 1):
        if words > 1:  # a run, a blank, the next word; runs over the end of a text are left out below
            one = np.ones(len(runs) - 1, dtype=np.int64)
            runs = composed(composed(runs[:-1], blank[: len(one)], one), crc[words - 1 :], length[words - 1 :]) if len(one) else runs[:0]
        for i, own in enumerate(out):
            own.append(runs[cuts[i] : max(cuts[i], cuts[i + 1] - words + 1)])
    return out


def _runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= SCANNED:
            yield run
            run, held = [], 0
    if run:
        yield run


def _packed_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(docs: DataFrame, doc_id: str, text: str, order: int = ORDER, buckets: int = BUCKETS, words: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the bucket of every feature, packed."""
    kind = _packed_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = _dictionaries.setdefault(words, Dictionary(words))
        for batch in batches:
            sizes, counts, packed = [], [], []
            for some in _runs(batch.column("text").to_pylist()):
                for own in features(some, order, dictionary):
                    sizes.append(len(own[0]))
                    crcs = np.concatenate(own)
                    counts.append(len(crcs))
                    packed.append((crcs % np.uint32(buckets)).astype(kind).tobytes())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])

    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_of(F.col(f"`{text}`")).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of ``bucketed`` rows, added up in each task first."""
    kind = _packed_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for own in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(own, dtype=kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the corpus, by bucket."""
    counted = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))
    )
    each = staged(counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    s_all, t_all = (int(x or 0) for x in each.agg(F.sum("s"), F.sum("t")).first())

    def gain(s: Column, t: Column) -> Column:
        share = (t + 1.0) * F.lit(float(s_all + buckets)) / ((s + 1.0) * F.lit(float(t_all + buckets)))
        return F.floor(F.lit(1000.0) * F.log(share)).cast("bigint")

    whole = each.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(each, "bucket", "left")
    found = whole.select("bucket", gain(F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")).alias("gain"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, value in found.collect():  # one row for each bucket
        out[bucket] = value
    return out


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``bucketed`` rows with the sum of their gains in place of the buckets."""
    kind = _packed_type(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(own, dtype=kind)].sum()) for own in batch.column("buckets").to_pylist()]
            columns = [*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of the hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")


def resampled(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_id: str = "item_id", target_text: str = "text",
    order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, words: int = WORDS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; the rank of rows not drawn is null."""
    found = staged(bucketed(docs, doc_id, text, order, buckets, words))
    wanted = bucketed(target, target_id, target_text, order, buckets, words)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets)
    scored = weighted(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("__can", F.col("n_words") >= least_words)
    placed = staged(ranked(scored, [F.col("__can").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place"))
    drawn = placed.agg(F.count_if("__can")).first()[0] * percent // 100
    rank = F.when(F.col("__can") & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


RESAMPLED_SQL = rf"""
WITH steps AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM steps),
found AS (
    SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
numbered AS (SELECT *, row_number() OVER () AS k FROM found),
words AS (SELECT kind, k, unnest(w) AS word FROM numbered),
counted AS (SELECT word, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM words GROUP BY word),
hexed AS (SELECT word, s, t, hex(encode(word)) AS h FROM counted),
hashed AS (SELECT word, s, t, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, crcs[(1 + (xor(a, x) & 255))::INT])), 4294967295) % {BUCKETS} AS bucket FROM hexed, crc_table),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM buckets, totals),
weights AS (SELECT k, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY k),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
    FROM numbered LEFT JOIN weights USING (k) WHERE kind = 'd'),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features >= {LEAST_WORDS} DESC, score DESC, doc_id NULLS LAST) AS place,
    {PERCENT} * count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () // 100 AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= many THEN place END AS rank FROM placed
"""


@query("op12_importance", RESAMPLED_SQL)
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
