"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers are built from the tokenizer file.  The first reads characters
and says where words end: its states are the open word kinds and the begun contractions, and
a delayed decision names an end up to a few characters back.  The second reads the bytes of a
word and annotates each transition with the tokens that the byte adds (fewer than none where
a longer token takes the place of several).  A state of it is what later bytes can still ask
for: the vocabulary's prefixes that end here and, for each, the token before it and the
tokens counted since.  A token may follow another where no merge across their border comes
before the merges that close over it, so the next state follows from the present one alone.
Its transitions are made when they are first met and kept.

Texts of a batch become one stream.  It is cut into chunks that are read side by side.  For
the first transducer each chunk is reduced to its state map, an element of the finite set of
maps that characters generate; the maps are composed in a parallel prefix scan, which gives
each chunk its entry state.  For the second, chunks are cut where a word ends: there the
map is constant, as every state goes back to the start.  The annotated counts are then
added up between the borders of the texts.  No row leaves its task, so nothing is shuffled.

Defined results: a null or empty text has no bytes and no tokens; every row gives one row,
repeated and null ids included, and ties do not arise; other columns, whatever their names,
are not read; an empty table gives no rows.  Whole texts count: a long one is read in blocks
cut after a blank, so memory follows the longest run without one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import product
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm.common import documents, query, text_of

LIMIT = 2048  # a text with more tokens is over the limit
BLOCK = 1_000_000  # characters read at a time
CHUNKS = 2048  # chunks read side by side
ALONE = 12  # with fewer open chunks the rest is read one after another
KEPT = 2_000_000  # transitions kept by a worker
START = 0
CLASSES = [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]  # after the contractions, in this order
BLANK, LETTER, DIGIT, SYMBOL = range(4)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Where words end: a transducer over kinds of characters, and the maps its chunks have.

    ``ends[state, kind]`` has bit k set where a word ends k characters before the one read.
    """

    def __init__(self, pattern: str, splitter):
        parts = pattern.split("|")
        fixed = parts[: -len(CLASSES)]
        if parts[-len(CLASSES) :] != CLASSES or not all(re.fullmatch(r"\W[a-z]+", p, re.ASCII) for p in fixed):
            raise ValueError(f"no transducer for the pattern {pattern!r}")
        if any(a != b and b.startswith(a) for a, b in product(fixed, fixed)):
            raise ValueError(f"a contraction begins another one in {pattern!r}")
        self.splitter = splitter
        begun = sorted({p[:k] for p in fixed for k in range(1, len(p))})
        special = sorted({c for p in fixed for c in p})
        self.own_kind = {c: 4 + i for i, c in enumerate(special)}
        group = [BLANK, LETTER, DIGIT, SYMBOL] + [LETTER if c.isalpha() else SYMBOL for c in special]
        state = {name: i for i, name in enumerate([None, LETTER, SYMBOL, *begun])}
        states, kinds = len(state), len(group)
        self.next = np.zeros((states, kinds), dtype=np.int8)
        self.ends = np.zeros((states, kinds), dtype=np.uint8)
        for name, kind in product(state, range(kinds)):
            after, marks = self._read(name, group[kind], special[kind - 4] if kind > 3 else "", fixed, begun)
            self.next[state[name], kind] = state[after]
            self.ends[state[name], kind] = sum(1 << k for k in marks)
        self._maps()
        self.kind_of = np.full(0x110000, 255, dtype=np.uint8)

    def _read(self, name, kind: int, char: str, fixed: list[str], begun: list[str]) -> tuple:
        """(state, how far back words end) after a character."""
        if isinstance(name, str):  # a begun contraction
            if name + char in fixed:
                return None, [0]
            if char and name + char in begun:
                return name + char, []
            if len(name) == 1:
                return self._read(SYMBOL, kind, char, fixed, begun)
            after, marks = self._read(LETTER, kind, char, fixed, begun)
            return after, [len(name), *marks]
        if name == kind and kind in (LETTER, SYMBOL):
            return name, []
        before = [] if name is None else [1]
        if kind == BLANK:
            return None, before
        if kind == DIGIT:
            return None, [*before, 0]
        return (char if char in begun else kind), before

    def _maps(self) -> None:
        """The maps of states that runs of characters have: ``grown[map, kind]`` and ``composed[first, second]``."""
        same = tuple(range(len(self.next)))
        known, order, grown = {same: 0}, [same], []
        for one in order:  # grows while it is read
            row = []
            for kind in range(self.next.shape[1]):
                more = tuple(int(self.next[s, kind]) for s in one)
                if more not in known:
                    known[more] = len(order)
                    order.append(more)
                row.append(known[more])
            grown.append(row)
        self.grown = np.array(grown, dtype=np.int32)
        self.maps = np.array(order, dtype=np.int8)
        self.composed = np.array([[known[tuple(b[s] for s in a)] for b in order] for a in order], dtype=np.int32)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        found = self.kind_of[points]
        if (found == 255).any():
            for point in np.unique(points[found == 255]):
                self.kind_of[point] = self._kind(chr(point))
            found = self.kind_of[points]
        return found

    def _kind(self, char: str) -> int:
        """The kind of a character, asked of the tokenizer's own splitter."""
        if char in self.own_kind:
            return self.own_kind[char]
        if not self.splitter(char):
            return BLANK
        if len(self.splitter(char + char)) == 2:
            return DIGIT
        return LETTER if len(self.splitter("a" + char)) == 1 else SYMBOL

    def entries(self, kinds: np.ndarray) -> np.ndarray:
        """Entry states of chunks (steps, chunks), from the prefix scan of their maps."""
        maps = np.zeros(kinds.shape[1], dtype=np.int32)
        for row in kinds:
            maps = self.grown[maps, row]
        step = 1
        while step < len(maps):  # each turn composes runs of twice the length
            maps = np.concatenate([maps[:step], self.composed[maps[:-step], maps[step:]]])
            step *= 2
        return np.concatenate([[START], self.maps[maps[:-1], START]]).astype(np.int8)

    def word_ends(self, points: np.ndarray, chunks: int) -> np.ndarray:
        """Whether a word ends at each character; the last one must be blank."""
        kinds = self.kinds(points)
        steps = -(-len(kinds) // chunks)
        laid = np.zeros(steps * chunks, dtype=np.uint8)  # blank behind the end
        laid[: len(kinds)] = kinds
        laid = np.ascontiguousarray(laid.reshape(chunks, steps).T)
        now, marks = self.entries(laid), np.empty_like(laid)
        for t, row in enumerate(laid):
            marks[t] = self.ends[now, row]
            now = self.next[now, row]
        marks = marks.T.reshape(-1)[: len(kinds)]
        ends = (marks & 1).astype(bool)
        for back in range(1, int(marks.max(initial=0)).bit_length()):
            ends[:-back] |= (marks[back:] >> back & 1).astype(bool)
        return ends


class Merges:
    """Tokens counted byte by byte; a word's last byte is a symbol of its own (byte + 256)."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        letters = byte_letters()
        self.rank, self.parts = {}, {}
        for rank, pair in enumerate(merges):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if whole in self.parts or any(self.parts.get(p, (0, 0, -1))[2] >= rank for p in (left, right)):
                raise ValueError(f"merge {rank} makes a known token or comes before its parts")
            self.rank[left, right] = rank
            self.parts[whole] = left, right, rank
        self.trie, self.token, self.size = [{}], [-1], np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for text, number in vocabulary.items():
            body = text.removesuffix(end)
            symbols = [letters[c] for c in body]
            if body != text:
                symbols[-1] += 256
            node = 0
            for symbol in symbols:
                if symbol not in self.trie[node]:
                    self.trie[node][symbol] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = self.trie[node][symbol]
            self.token[node] = number
            self.size[number] = len(symbols)
        self.borders: tuple[dict, dict] = {}, {}
        self.follows: dict = {}
        self.forget()

    def forget(self) -> None:
        """Drop all transitions; they are made again when met."""
        self.numbers, self.states, self.edges = {}, [], {}
        self.follows.clear()
        self._number(((0, -1, 0),))
        self._table(1 << 16)

    def _table(self, slots: int) -> None:
        self.bits = np.uint64(64 - (slots.bit_length() - 1))
        self.keys = np.full(slots, -1, dtype=np.int64)
        self.after = np.zeros(slots, dtype=np.int32)
        self.adds = np.zeros(slots, dtype=np.int8)
        self.last = np.zeros(slots, dtype=np.int32)
        for key, edge in self.edges.items():
            self._put(key, *edge)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def _put(self, key: int, state: int, adds: int, token: int) -> None:
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.bits)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.after[slot], self.adds[slot], self.last[slot] = key, state, adds, token

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def _border(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one border of ``token`` over time, each with the rank of the merge that takes it in."""
        if token not in self.borders[side]:
            out, until, one = [], float("inf"), token
            while True:
                out.append((one, until))
                if one not in self.parts:
                    break
                *halves, until = self.parts[one]
                one = halves[1 - side]
            self.borders[side][token] = out
        return self.borders[side][token]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether no merge joins the two: one at equal rank wins against the second's, which lies to the right."""
        if (first, second) not in self.follows:
            self.follows[first, second] = not any(
                (rank := self.rank.get((a, b))) is not None and rank < a_until and rank <= b_until
                for a, a_until in self._border(first, 0)
                for b, b_until in self._border(second, 1)
            )
        return self.follows[first, second]

    def edge(self, state: int, symbol: int) -> tuple[int, int, int]:
        """(next state, tokens added, the token that now is the last)."""
        key = state << 9 | symbol
        if key not in self.edges:
            token, adds, kept = -1, 0, []
            for node, before, counted in self.states[state]:
                child = self.trie[node].get(symbol)
                if child is None:
                    continue
                if token < 0 <= self.token[child] and (before < 0 or self.may_follow(before, self.token[child])):
                    token, adds = self.token[child], counted + 1
                if self.trie[child]:
                    kept.append((child, before, counted))
            if symbol > 255:
                after = START
            else:
                after = self._number((*((c, b, n - adds) for c, b, n in kept), (0, token, 0)))
            self.edges[key] = after, adds, token
            if len(self.edges) * 3 > len(self.keys):
                self._table(len(self.keys) * 2)
            else:
                self._put(key, after, adds, token)
        return self.edges[key]

    def read(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One transition for each chunk."""
        keys = states << 9 | symbols
        slots = self._slots(keys)
        while True:
            found = self.keys[slots]
            other = np.flatnonzero(found != keys)
            if not len(other):
                return self.after[slots].astype(np.int64), self.adds[slots], self.last[slots]
            unknown = other[found[other] < 0]
            if len(unknown):
                for key in np.unique(keys[unknown]).tolist():
                    self.edge(key >> 9, key & 511)
                slots = self._slots(keys)
            else:
                slots[other] = (slots[other] + 1) & (len(self.keys) - 1)

    def counts(self, symbols: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens added, last token) at each symbol; the last symbol must end a word."""
        if len(self.edges) > KEPT:
            self.forget()
        adds, last = np.zeros(len(symbols), dtype=np.int64), np.zeros(len(symbols), dtype=np.int32)
        ends = np.flatnonzero(symbols > 255)
        near = np.searchsorted(ends, np.linspace(0, len(symbols), chunks, endpoint=False)[1:])
        cuts = np.unique(np.concatenate([[0], ends[near[near < len(ends)]] + 1, [len(symbols)]]))
        sizes = np.diff(cuts)
        order = np.argsort(-sizes, kind="stable")
        at, sizes = cuts[:-1][order], sizes[order]
        states, t, active = np.zeros(len(at), dtype=np.int64), 0, len(at)
        while active > ALONE:
            where = at[:active] + t
            states, adds[where], last[where] = self.read(states[:active], symbols[where])
            t += 1
            active = int(np.searchsorted(-sizes, -t))
        for chunk in range(active):
            state = int(states[chunk])
            for i, symbol in enumerate(symbols[at[chunk] + t : at[chunk] + sizes[chunk]].tolist(), int(at[chunk]) + t):
                state, adds[i], last[i] = self.edge(state, symbol)
        return adds, last

    def token_ends(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the tokens of the words end: from the end of each word back over its last token, again and again."""
        found = np.zeros(len(symbols), dtype=bool)
        ends = np.flatnonzero(symbols > 255)
        first = np.concatenate([[0], ends[:-1] + 1])
        while len(ends):
            found[ends] = True
            ends = ends - self.size[last[ends]]
            more = ends >= first
            ends, first = ends[more], first[more]
        return found


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabularies over bytes: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Compiled:
    """A tokenizer file as transducers; ``count`` gives the tokens of texts."""

    def __init__(self, path: str, block: int = BLOCK, chunks: int = CHUNKS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        if model["type"] != "BPE" or model.get("dropout") or len(steps) != 2 or steps[1]["type"] != "ByteLevel" or not steps[0].get("invert"):
            raise ValueError("only BPE over the bytes of words kept by a pattern is compiled")
        whole = Tokenizer.from_file(path)
        self.normalized = whole.normalizer.normalize_str
        self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.words = Words(steps[0]["pattern"]["Regex"], whole.pre_tokenizer.pre_tokenize_str)
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.block, self.chunks = block, chunks

    def _blocks(self, text: str) -> Iterator[str]:
        """The text in parts cut after a blank, which no word, mark or added token spans."""
        at = 0
        while len(text) - at > self.block:
            cut = max(text.rfind(c, at, at + self.block) for c in " \n") + 1
            if cut <= 0:
                later = [i for c in " \n" if (i := text.find(c, at + self.block)) >= 0]
                cut = min(later) + 1 if later else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _parts(self, block: str) -> tuple[int, list[str]]:
        """(added tokens, normalised texts between them)."""
        plain = self.added.split(block) if self.added else [block]
        return len(plain) - 1, [self._plain(p) for p in plain]

    def _plain(self, text: str) -> str:
        """The normalised text; blanks need not be joined, and lower case is that of each letter alone but for a final sigma."""
        if text.isascii() or (is_normalized("NFC", text) and "\u03a3" not in text):
            return text.lower()
        return self.normalized(text)

    def _symbols(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, borders of the parts in them); all are one stream with blanks between them."""
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = self.words.word_ends(points, min(self.chunks, len(points)))
        raw = np.frombuffer(joined.encode(), dtype=np.uint8)
        blank = self.words.kinds(points) == BLANK
        if len(raw) != len(points):
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            last = np.cumsum(width) - 1
            marks = np.zeros(len(raw), dtype=bool)
            marks[last[ends]] = True
            ends, blank = marks, np.repeat(blank, width)
        kept = ~blank
        symbols = (raw.astype(np.int64) + (ends.astype(np.int64) << 8))[kept]
        sizes = np.array([len(p) if p.isascii() else len(p.encode()) for p in parts], dtype=np.int64)
        borders = np.concatenate([[0], np.cumsum(sizes + 1)])
        return symbols, np.concatenate([[0], np.cumsum(kept)])[borders]

    def _stream(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part."""
        symbols, before = self._symbols(parts)
        if not len(symbols):
            return np.zeros(len(parts), dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(self.merges.counts(symbols, self.chunks)[0])])
        return np.diff(total[before])

    def _ids(self, parts: list[str]) -> list[np.ndarray]:
        """Token ids of each part."""
        symbols, before = self._symbols(parts)
        if not len(symbols):
            return [np.zeros(0, dtype="<u4")] * len(parts)
        last = self.merges.counts(symbols, self.chunks)[1]
        found = self.merges.token_ends(symbols, last)
        every, cuts = last[found].astype("<u4"), np.concatenate([[0], np.cumsum(found)])[before]
        return [every[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit numbers; texts with added tokens are left to the library."""
        out: list[list[bytes]] = [[] for _ in texts]
        owner, parts, held = [], [], 0

        def read() -> None:
            for i, own in zip(owner, self._ids(parts), strict=True):
                out[i].append(own.tobytes())
            owner.clear()
            parts.clear()

        for i, text in enumerate(texts):
            if self.added and self.added.search(text):
                out[i].append(np.array(self.encode(text), dtype="<u4").tobytes())
                continue
            for block in self._blocks(text):
                if parts and held + len(block) > self.block:
                    read()
                    held = 0
                owner.append(i)
                parts.append(self._plain(block))
                held += len(block)
        if parts:
            read()
        return [b"".join(found) for found in out]

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        owner, parts, held = [], [], 0

        def read() -> None:
            np.add.at(out, owner, self._stream(parts))
            owner.clear()
            parts.clear()

        for i, text in enumerate(texts):
            for block in self._blocks(text):
                if parts and held + len(block) > self.block:
                    read()
                    held = 0
                added, plain = self._parts(block)
                out[i] += added
                owner += [i] * len(plain)
                parts += plain
                held += len(block)
        if parts:
            read()
        return out


_compiled: dict[str, Compiled] = {}  # of this Python worker


def compiled(path: str) -> Compiled:
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    return _compiled[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = compiled(path).count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found)], ["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    sized = own.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    counted = sized.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text"))
