"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased: ASCII letters and digits,
and everything outside ASCII. In UTF-8 that is decided byte by byte, so a text is normalised by one byte
table, and a byte of the normalised text can be mapped back to the text. A window is 10 consecutive words
of an item; an item of fewer words, but not none, is one window. All windows go into one automaton, which
reads each document once and reports every window that ends at a place, shorter ones inside longer ones too.

Sizes are bounded: items are dealt over several automata of at most WINDOW_WORDS words in windows each, which a task
uses in turn. What is broadcast at once is checked: a benchmark of over BYTES is dealt, by a hash of the item, over
several passes that each broadcast a part, and what a pass finds is written out before the next.

Cases: a null text has no words, as an item or as a document; such a document is returned with zeros.
Equal items each count. Items
without an id count for n_hit, contaminated, removal and spans, but not for n_items and items_sha256: they have no id to list. An empty benchmark gives zeros, an empty table of documents an empty result.
A doc_id or item_id that is no number counts as none. Other columns are ignored by `hits`; `spans` and `remove` keep those of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.llm.shared import cut

WINDOW = 10
#: Words in the windows of one automaton; about 100 bytes of memory each.
WINDOW_WORDS = 1_500_000
#: Bytes of items that are collected and broadcast at once.
BYTES = 32 << 20
NORMAL = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(item: list[bytes]) -> list[list[bytes]]:
    return [item[i : i + WINDOW] for i in range(max(1, len(item) - WINDOW + 1))] if item else []


class Matcher:
    """One automaton; a window is spelled with a space before and after each word."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        found: dict[str, tuple[int, set[int]]] = {}
        for item_id, text in items:
            for w in windows(words(text)):
                found.setdefault(" " + b" ".join(w).decode("latin-1") + " ", (len(w), set()))[1].add(item_id)
        self.automaton = ahocorasick.Automaton()
        for key, (n, ids) in found.items():
            self.automaton.add_word(key, (len(key), n, tuple(ids)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, spelled: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(place of the window's first character in the spelled text, its words, its items), for a text spelled like the windows."""
        if self.empty:
            return []
        return [(end - length + 1, n, ids) for end, (length, n, ids) in self.automaton.iter(spelled)]


class Matchers:
    def __init__(self, items: list[tuple[int, str]]) -> None:
        shards, weight = [[]], 0
        for item_id, text in items:
            n = len(words(text))
            size = max(1, n - WINDOW + 1) * min(n, WINDOW)
            if shards[-1] and weight + size > WINDOW_WORDS:
                shards.append([])
                weight = 0
            shards[-1].append((item_id, text))
            weight += size
        self.shards = [Matcher(s) for s in shards]

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
        """Words of the text, and (first word, words, items) of each occurrence of a window."""
        split = words(text)
        if not split:
            return 0, []
        spelled = " " + b" ".join(split).decode("latin-1") + " "
        found = [m for shard in self.shards for m in shard.matches(spelled)]
        if not found:
            return len(split), []
        starts = np.cumsum([0, *[len(w) + 1 for w in split]])
        return len(split), [(int(np.searchsorted(starts, at)), n, ids) for at, n, ids in found]


_MATCHERS: dict[str, Matchers] = {}


def _matchers(shared) -> Matchers:
    """Compiled once in a Python worker."""
    key = shared.value[0]
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matchers(shared.value[1])
    return _MATCHERS[key]


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The items, in parts of about BYTES at most."""
    items = benchmark.select(F.expr("try_cast(item_id AS bigint)").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items for i in range(n)]


def _items(part: DataFrame):
    """A part's items, broadcast."""
    rows = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return part.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(rows).encode()).hexdigest(), rows))


def _digest(n: list[int], found: list[list[tuple[int, int, tuple[int, ...]]]]) -> list[pa.Array]:
    hit, items, digests = [], [], []
    for own in found:
        covered, ids = set(), set()
        for first, count, which in own:
            covered.update(range(first, first + count))
            ids.update(i for i in which if i is not None)
        hit.append(len(covered))
        items.append(len(ids))
        digests.append(hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]


DIGEST = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
DIGEST_KINDS = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
FOUND = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("items", pa.list_(pa.int64()))]))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    parts = _parts(benchmark)
    chosen = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("text"))
    if len(parts) == 1:
        shared = _items(parts[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _matchers(shared)
            for batch in batches:
                got = [m.find(text) for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *_digest([n for n, _ in got], [f for _, f in got])], DIGEST)

        return chosen.mapInArrow(run, DIGEST_KINDS)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(x["first"], x["words"], tuple(x["items"])) for x in own] for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_digest([len(words(t)) for t in batch.column(1).to_pylist()], found)], DIGEST)

    return _all_parts(chosen, parts, "text", "found").mapInArrow(last, DIGEST_KINDS)


def _all_parts(docs: DataFrame, parts: list[DataFrame], text: str, out: str) -> DataFrame:
    """The documents, and in `out` the occurrences of the windows of all parts, one pass a part."""
    frame = docs.withColumn(out, F.array().cast("array<struct<first:bigint,words:bigint,items:array<bigint>>>"))
    for part in parts:
        frame = cut(_one_part(frame, _items(part), text, out))
    return frame


def _one_part(frame: DataFrame, shared, text: str, out: str) -> DataFrame:
    at, own = frame.columns.index(text), frame.columns.index(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matchers(shared)
        for batch in batches:
            found = [[*before, *({"first": a, "words": n, "items": list(ids)} for a, n, ids in m.find(t)[1])] for t, before in zip(batch.column(at).to_pylist(), batch.column(own).to_pylist(), strict=True)]
            columns = [pa.array(found, FOUND) if i == own else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return frame.mapInArrow(run, frame.schema)


def _word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word in the text itself, in characters."""
    raw = text.encode()
    normal = np.frombuffer(raw.translate(NORMAL), "u1") != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], normal.view("i1"), [0]])))
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, "u1") & 0xC0) != 0x80)])
    return list(zip(chars[edges[::2]].tolist(), chars[edges[1::2]].tolist(), strict=True))


def _keep(docs: DataFrame, drop: str = "") -> tuple[DataFrame, str]:
    kept = docs.drop(drop) if drop else docs
    return kept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)


def spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """The documents, and in `out` an array of (item_id, start, end): each occurrence of a window, in characters of the original text."""
    kept, kinds = _keep(docs, out)
    found_ = _all_parts(kept, _parts(benchmark), text, out)
    at, own = found_.columns.index(text), found_.columns.index(out)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = []
            for t, found in zip(batch.column(at).to_pylist(), batch.column(own).to_pylist(), strict=True):
                places = _word_places(t) if found else []
                listed = sorted(((x["first"], x["words"], i) for x in found for i in x["items"]), key=lambda m: (*m[:2], m[2] is not None, m[2] or 0))
                column.append([{"item_id": i, "start": places[a][0], "end": places[a + n - 1][1]} for a, n, i in listed])
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) if i == own else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return found_.mapInArrow(run, f"{kinds}, `{out}` array<struct<item_id:bigint,start:bigint,end:bigint>>")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without those that hold a window of the benchmark."""
    kept, kinds = _keep(docs)
    at = kept.columns.index(text)
    parts = _parts(benchmark)

    def without(frame: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _matchers(shared)
            for batch in batches:
                clean = [not m.find(t)[1] for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return frame.mapInArrow(run, kinds)

    for i, part in enumerate(parts):
        kept = without(kept, _items(part))
        if i < len(parts) - 1:
            kept = cut(kept)
    return kept
