"""Secret scans: base patterns, and an assignment-aware reading of source and configuration.

The reader finds name-literal pairs (``name = "literal"``, ``"name": 'literal'``,
``name: word``, ``name := a + "b"``), keeps what each name was last given, replaces names
on the right by their literals (so a secret is found through the constants it is passed
by), and scores each literal by how sensitive its target's name is and how random the
literal looks.  A literal of enough score is a secret; its span is where the literal
stands, be it several assignments before.

Positions are code points, ends exclusive.  Texts are scanned whole, in one pass for each
kind; no pattern can backtrack beyond one token.

Defined results: a null text is empty and has no span; repeated rows give the same spans
each; only columns asked for are read, so others cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm.common import documents, query

# The base kinds in their order, with the least length of a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

# One name with what it is given: quoted or plain parts joined by +.
PART = r"""(?:"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|[A-Za-z0-9_./+=$@:-]++)"""
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.$-])(?P<q>["']?)(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+)(?P=q)[ \t]*+(?::=|=>|=(?!=)|:(?!:))[ \t]*+(?P<value>{PART}(?:[ \t]*+\+[ \t]*+{PART})*+)"""
)
ONE_PART = re.compile(PART)
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*\Z")
# Parts of names that promise a secret, with their weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "private": 2, "auth": 2, "bearer": 2, "signing": 2, "encryption": 2, "access": 1, "api": 1, "key": 1, "client": 1,
}
HARMLESS = {"changeme", "example", "password", "secret", "none", "null", "true", "false", "placeholder", "undefined", "redacted"}
ENOUGH = 5
LEAST_LITERAL = 8


def name_score(name: str) -> int:
    """Weight of a target's name: its parts between _ . - and capitals."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    parts = re.split(r"[^A-Za-z0-9]+", spaced.lower())
    return min(4, sum(SENSITIVE.get(p, 0) for p in parts))


def literal_score(value: str) -> int:
    """How much a literal looks like key material: 0 to 4."""
    if len(value) < LEAST_LITERAL or value.lower() in HARMLESS or len(set(value)) < 5 or re.search(r"\s|^[<$%{]", value):
        return 0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (entropy >= 2.8) + (entropy >= 3.4) + (classes >= 2) + (len(value) >= 16)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach sensitive names."""
    if ":" not in text and "=" not in text:
        return []
    given: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}
    found = set()
    for pair in PAIR.finditer(text):
        value, where = [], []
        at = pair.start("value")
        for part in ONE_PART.finditer(text, at, pair.end("value")):
            word = part[0]
            if word[0] in "\"'":
                value.append(word[1:-1])
                where.append((part.start() + 1, part.end() - 1))
            elif word in given:
                value.append(given[word][0])
                where += given[word][1]
            elif word != "+":
                value.append(word)
                where.append((part.start(), part.end()))
        whole, spans = "".join(value), tuple(where)
        given[pair["name"]] = (whole, spans)
        plain = not spans or (len(spans) == 1 and text[spans[0][0] - 1 : spans[0][0]] not in ("'", '"') and NAME.match(whole) and not re.search("[0-9]", whole))
        if not plain and name_score(pair["name"]) and name_score(pair["name"]) + literal_score(whole) >= ENOUGH and literal_score(whole) >= 2:
            found.update(s for s in spans if s[0] < s[1])
    return sorted(found)


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text by start, then kind; a literal inside a base span is not told again."""
    base = base_spans(text)
    out = list(base)
    for start, end in literal_spans(text):
        if not any(a <= start and end <= b for a, _, b in base):
            out.append((start, 3, end))
    return sorted(out)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found) for each row; found is an array of (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t.as_py() or "")] for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    named = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "doc_id bigint, found array<struct<kind string, start bigint, end bigint>>")


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of(kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
