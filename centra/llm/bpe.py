"""Byte-level BPE through a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop for every byte. Each merge (u, v) -> w
is compiled in order by a gadget: the state that u leads to is cloned without its arc for v, u is
redirected to the clone, and every state with an arc for u gets one for w that leads where v leads.
What remains after the last merge accepts exactly the token sequences that the merges produce, and
each byte string has one path through it. A clone is kept as its difference from the state that it
was cloned from (the arc it lost, and when), so the automaton has one row a token.

Words are encoded by transitions over bytes. A prefix of a word has one path too, so what the rest of it depends on
is which states the path passed while the bytes since then still spell the beginning of a label: a state of the
transition table is the list of those (state, place in the trie of labels). A byte leads from one such state
to the next and emits the label of the arc that ends there, the last token of the prefix. The table is filled as texts use it;
reading the emitted labels backwards from the end gives the tokens. Nothing is tried twice.

Cases: a null text counts as an empty one and has no tokens. Texts and words of any length are encoded whole;
time grows with the length. Repeated rows give repeated results. An empty table gives an empty one. A doc_id that is no number
is null in the digests.
Other columns are neither read nor returned by the digests; `encode` keeps them and replaces a
column that has the name of its output. A tokenizer file that asks for anything else than byte-level merging under the one split
pattern is an error.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value of byte-level vocabularies: how a text is split before merging.
SPLIT = r""" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, LOW = -1, 0xFFFFFFFF
NEVER = float("inf")
#: Entries of the caches of a Python worker; a full cache is emptied.
WORDS, ARCS, TRANSITIONS = 200_000, 200_000, 150_000


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The deterministic automaton of a merge list, with its arc labels."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        alphabet = byte_alphabet()
        self.label = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items()}
        self.made = {}  # token -> (its left part, rank of its merge)
        self.clone_of = {}  # token -> (token whose state its own began as, rank)
        self.lost = {}  # token -> {token whose arc its state lost: rank}
        for rank, (left, right) in enumerate(merges):
            self._gadget(vocabulary[left], vocabulary[right], vocabulary[left + right], rank)
        self.size = {i: len(x) for i, x in self.label.items()}
        # The trie of labels: a node and a byte to a node, and the tokens that end at nodes.
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        for i, label in self.label.items():
            node = 0
            for c in label:
                following = self.trie.get(node << 8 | c)
                if following is None:
                    following = self.trie[node << 8 | c] = len(self.ends)
                    self.ends.append(-1)
                node = following
            self.ends[node] = i
        self.inner = {k >> 8 for k in self.trie}
        self.arcs: dict[int, bool] = {}
        self._empty()

    def _empty(self) -> None:
        """A table with the state of the empty prefix only."""
        # Pairs of numbers are kept as one, the second in the low 32 bits.
        self.states: list[tuple[int, ...]] = [(START + 1 << 32,)]
        self.number = {self.states[0]: 0}
        self.table: dict[int, int] = {}

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        if w not in self.made:
            self.clone_of[w] = (v, rank)
            self.made[w] = (u, rank)
        self.lost.setdefault(u, {}).setdefault(v, rank)

    def _lost_at(self, state: int, token: int) -> float:
        """When the state lost its arc for the token, itself or a state that it was cloned from."""
        until, first, lost, clone_of = NEVER, NEVER, self.lost, self.clone_of
        while state is not None:
            row = lost.get(state)
            if row is not None:
                rank = row.get(token, NEVER)
                if rank < until and rank < first:
                    first = rank
            state, until = clone_of.get(state, (None, 0))
        return first

    def _expand(self, state: int, token: int) -> bool:
        if state == START:
            return True
        # The arc for a token made of (u, v) was added where u had one then, and is gone if lost later.
        until = NEVER
        while True:
            lost = self._lost_at(state, token)
            if lost <= until and lost < NEVER:
                return False
            if token not in self.made:
                return True
            token, until = self.made[token]

    def arc(self, state: int, token: int) -> bool:
        key = state + 1 << 32 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._expand(state, token)
        return known

    def transition(self, state: int, byte: int) -> int:
        """The next state of the table, and in the low 32 bits the token that ends at this byte."""
        open_, token = [], -1
        for pair in self.states[state]:
            before, node = (pair >> 32) - 1, self.trie.get((pair & LOW) << 8 | byte, 0)
            if not node:
                continue
            end = self.ends[node]
            if token < 0 <= end and self.arc(before, end):
                token = end
            if node in self.inner:
                open_.append(before + 1 << 32 | node)
        if token < 0:
            raise ValueError("the vocabulary lacks a byte of the word")
        key = (*open_, token + 1 << 32)
        following = self.number.get(key)
        if following is None:
            following = self.number[key] = len(self.states)
            self.states.append(key)
        got = self.table[state << 8 | byte] = following << 32 | token
        return got

    def encode(self, word: bytes) -> list[int]:
        """The tokens on the one path whose labels spell the word."""
        if len(self.table) >= TRANSITIONS:
            self._empty()
        known, state, last = self.table.get, 0, []
        for byte in word:
            got = known(state << 8 | byte)
            if got is None:
                got = self.transition(state, byte)
            state = got >> 32
            last.append(got & LOW)
        at, ids, size = len(last), [], self.size
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return ids


def _checked(j: dict) -> dict:
    """The definition, if it asks for nothing but what is done here."""
    split, model = j.get("pre_tokenizer") or {}, j["model"]
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    merged = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = not any(t.get(k) for t in j.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    if not (plain and merged and added and j.get("normalizer") is None and (j.get("decoder") or {}).get("type") == "ByteLevel"):
        raise ValueError("not a byte-level BPE definition with the plain split pattern")
    return j


class Codec:
    """Texts to ids (packed as little-endian unsigned 32-bit integers) and back."""

    def __init__(self, definition: str) -> None:
        j = _checked(json.loads(definition))
        vocabulary = j["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        self.automaton = MergeAutomaton(vocabulary, merges)
        self.added = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.labels = dict(self.automaton.label) | {i: s.encode() for s, i in self.added.items()}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = regex.compile(SPLIT).findall
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(self.words) >= WORDS:
            self.words.clear()
        ids = self.automaton.encode(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self.words[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        get, other = self.words.get, self._word
        return b"".join([get(w) or other(w) for w in self.split(text)])

    def encode(self, text: str) -> bytes:
        if self.split_added is None or not any(s in text for s in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self._plain(text[at : m.start()]), struct.pack("<I", self.added[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        """Emits the label of every arc; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(definition: str) -> Codec:
    """The compiled automaton, once in a Python worker."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(definition)
    return _CODECS[key]


def definition(path: str) -> str:
    """The tokenizer's file, read on the driver: executors need not have it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _map(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    # A vocabulary is a fixed file of a few MB, however many documents there are.
    shared = docs.sparkSession.sparkContext.broadcast(definition(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            yield make(c, batch)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns, and the ids of the text as an array of int."""
    kept = docs.drop(out)
    at = kept.columns.index(text)

    def make(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(c.encode(t or ""), "<u4").astype("int32") for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return _map(kept, path, f"{kinds}, `{out}` array<int>", make)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and the text that the ids spell; a null array spells the empty text."""
    kept = encoded.drop(out)
    at = kept.columns.index(ids)

    def make(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [c.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return _map(kept, path, f"{kinds}, `{out}` string", make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, so that ids need not cross to the JVM."""

    def make(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, texts = [], [], []
        for t in batch.column(1).to_pylist():
            packed = c.encode(t or "")
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(c.decode(packed).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("text"))
    return _map(chosen, path, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
