"""Exact substring dedup with suffix automata of reference shards.

Words are runs of other than space and U+0009 to U+000D, unchanged; a window is WINDOW consecutive words of a
document. Every word covered by a window that also starts anywhere else, in any document, is removed (`dedup`).
`dedup_against` removes what occurs in a reference of its own: the automata of its shards are broadcast, the documents
streamed through them for matching statistics, and maximal spans of at least WINDOW words removed.

For `dedup` all documents are the reference, and comparing every document with every shard of it would take
time in the square of the corpus. Its shards are cut by content instead: of the GRAM-word sequences in a window,
the one with the smallest hash decides the group, and equal windows agree on it. A maximal run of windows with
one such hash is a segment.

1. Equal texts become one, with the number of their copies. Texts are only shuffled for this, but by every job that uses them.
2. The deciding hashes of every text are counted. One that occurs once cannot belong to a repeated window.
3. Texts are cut into segments whose hash occurs more often, and each goes to the shard of its group only. Where a hash
   occurs at over HOT places (a passage of a great many texts, with another text around it in each), its windows go by
   themselves, grouped by their first and last word too, and are summed up before they are grouped.
4. A shard's segments, weighted by their copies, make one suffix automaton. Its segments are streamed through
   it for matching statistics: at each word, how many of the last words occur and how often the last WINDOW of
   them do. Ranges of windows that occur twice or more go back to the texts that hold the segment.

Hashes only choose candidates and groups; what repeats is decided by the words in the automaton. Texts are
named by 96 bits of hashes, windows of hot groups by 128.

Cases: a null text has no words; the digest of no words is that of the empty string. Texts under WINDOW
words lose nothing. Repeated rows of a document are copies of it and lose what they share. What a row loses is
decided by its text alone, so rows that repeat an id, have none, or have one that is no number (null in the
result) are like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.llm.shared import cut
from centra.llm.words import Words, chunks, mix

WINDOW, GRAM = 35, 16
#: Places of a deciding hash from which its windows go one by one; words in the segments of one automaton; bytes of windows that are held to be summed.
HOT, SHARD_WORDS, HELD = 256, 100_000, 16 << 20
#: Rows that are broadcast at most, and bytes of a reference's texts whose automata are broadcast at once.
BROADCAST, BYTES = 1_000_000, 8 << 20


def deciding(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash that decides each window's group, by the window's first word; whether the window lies in one text; and the hashes of GRAM words."""
    n = len(w.first) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, "u8"), np.zeros(0, bool), np.zeros(0, "u8")
    grams = Words.rolled(w.hashes(), GRAM)
    return slide(grams, WINDOW - GRAM + 1, np.minimum), w.owner[:n] == w.owner[WINDOW - 1 :], grams


def slide(x: np.ndarray, size: int, of) -> np.ndarray:
    """The least or greatest of every `size` values in a row."""
    reach = 1
    while 2 * reach <= size:
        x = of(x[:-reach], x[reach:])
        reach *= 2
    rest = size - reach
    return of(x[:-rest], x[rest:]) if rest else x


def _words(texts: list[str | None]) -> Words:
    return Words([(t or "").encode() for t in texts])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view("i8"), pa.int64())


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, check, text, copies to (h, key, check, n, weight): the places in the text whose hash decides a window there, and those of its copies too."""
    for batch in batches:
        texts, copies = batch.column(2).to_pylist(), batch.column(3).to_numpy()
        for begin, end in chunks(texts):
            w = _words(texts[begin:end])
            least, whole, grams = deciding(w)
            if not whole.any():
                continue
            # A place decides a window if no window around it has a smaller least: its hash is the greatest of those.
            size = WINDOW - GRAM + 1
            padded = np.concatenate([np.zeros(size - 1, "u8"), np.where(whole, least, np.uint64(0)), np.zeros(size - 1, "u8")])
            chosen = np.flatnonzero(slide(padded, size, np.maximum) == grams)
            owner, h = w.owner[chosen], grams[chosen]
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]))
            n = np.diff(np.append(new, len(h)))
            of = owner[new] + begin
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([_signed(h[new]), batch.column(0).take(at), batch.column(1).take(at), pa.array(n, pa.int64()), pa.array(n * copies[of], pa.int64())], ["h", "key", "check", "n", "weight"])


def _segments(texts: list[str | None], lists: list[list[int] | None]) -> Iterator[tuple[int, int, int, int, list[bytes]]]:
    """(text, first word, windows, hash, words) of each segment whose hash is listed for its text."""
    for begin, end in chunks(texts):
        own_lists = [(i, x) for i, x in enumerate(lists[begin:end]) if x]
        if not own_lists:
            continue
        w = _words(texts[begin:end])
        least, whole, _ = deciding(w)
        if not whole.any():
            continue
        cuts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (w.owner[1 : len(least)] != w.owner[: len(least) - 1]) | (whole[1:] != whole[:-1])]))
        ends = np.append(cuts[1:], len(least))
        cuts, ends = cuts[whole[cuts]], ends[whole[cuts]]
        owner = w.owner[cuts]
        listed = np.sort(np.concatenate([np.array(x, "i8").view("u8") ^ mix(np.array([i + 1], "u8")) for i, x in own_lists]))
        own = least[cuts] ^ mix((owner + 1).astype("u8"))
        found = np.flatnonzero(listed[np.minimum(np.searchsorted(listed, own), len(listed) - 1)] == own)
        first, last, buffer, base = w.first, w.last, w.buffer, w.base
        for k in found.tolist():
            i, a, b = int(owner[k]), int(cuts[k]), int(ends[k])
            yield begin + i, a - int(base[i]), b - a, int(least[a].view("i8")), buffer[first[a] : last[b + WINDOW - 2]].split()


def _cool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, check, text, copies, hashes to (g, words, key, check, start, n): segments where they stand."""
    for batch in batches:
        copies = batch.column(3).to_pylist()
        owners: list[int] = []
        rows: list[tuple[int, bytes, int, int]] = []
        size = 0

        def flush(own: list[int], got: list, b: pa.RecordBatch = batch) -> pa.RecordBatch:
            at = pa.array(own, pa.int64())
            g, words, start, n = (list(c) for c in zip(*got, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(words, pa.binary()), b.column(0).take(at), b.column(1).take(at), pa.array(start, pa.int32()), pa.array(n, pa.int64())], ["g", "words", "key", "check", "start", "n"])

        for i, start, _, h, words in _segments(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            owners.append(i)
            rows.append((h, b" ".join(words), start, copies[i]))
            size += len(rows[-1][1])
            if size >= HELD:
                yield flush(owners, rows)
                owners, rows, size = [], [], 0
        if rows:
            yield flush(owners, rows)


def _windows(texts: list[str | None], lists: list[list[int] | None]) -> Iterator[tuple[int, int, int, bytes]]:
    """(text, first word, group, words) of each window whose hash is listed for its text."""
    for i, start, n, h, words in _segments(texts, lists):
        for j in range(n):
            group = xxhash.xxh64_intdigest(words[j] + b" " + words[j + WINDOW - 1], h & 0xFFFFFFFFFFFFFFFF)
            yield i, start + j, group - (1 << 64) if group >> 63 else group, b" ".join(words[j : j + WINDOW])


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, check, text, copies, hashes to (g, words, n): windows with their counts, summed as far as HELD bytes of them hold."""
    counts: dict[tuple[int, bytes], int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([g for g, _ in counts], pa.int64()), pa.array([w for _, w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["g", "words", "n"])
        counts.clear()
        return got

    for batch in batches:
        copies = batch.column(3).to_pylist()
        for i, _, g, words in _windows(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            if (g, words) not in counts:
                size += len(words) + 100
            counts[g, words] = counts.get((g, words), 0) + copies[i]
            if size >= HELD:
                yield flush()
                size = 0
    if counts:
        yield flush()


def _name(words: bytes) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(words)
    high, low = n >> 64, n & 0xFFFFFFFFFFFFFFFF
    return high - (1 << 64) if high >> 63 else high, low - (1 << 64) if low >> 63 else low


def _named(rows: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())]


def _hot_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, check, text, copies, hashes to (p1, p2, key, check, start): where each window of a hot group stands."""
    for batch in batches:
        owners, starts, names = [], [], []
        for i, start, _, words in _windows(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            owners.append(i)
            starts.append(start)
            names.append(_name(words))
        at = pa.array(owners, pa.int64())
        yield pa.RecordBatch.from_arrays([*_named(names), batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32())], ["p1", "p2", "key", "check", "start"])


class SuffixAutomaton:
    """Of several sequences, with the weight of what occurs in each state."""

    def __init__(self) -> None:
        self.arcs: list[dict] = [{}]
        self.length, self.link, self.count = [0], [-1], [0]

    def add(self, sequence: list, weight: int) -> None:
        arcs, length, link, count = self.arcs, self.length, self.link, self.count
        last = 0
        for c in sequence:
            q = arcs[last].get(c)
            if q is not None:
                # The sequence goes where one before it went.
                if length[q] != length[last] + 1:
                    q = self._clone(last, c, q)
                last = q
            else:
                new = len(length)
                length.append(length[last] + 1)
                arcs.append({})
                link.append(0)
                count.append(0)
                p = last
                while p != -1 and c not in arcs[p]:
                    arcs[p][c] = new
                    p = link[p]
                if p != -1:
                    q = arcs[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = new
            count[last] += weight

    def _clone(self, p: int, c, q: int) -> int:
        arcs, length, link = self.arcs, self.length, self.link
        new = len(length)
        length.append(length[p] + 1)
        arcs.append(arcs[q].copy())
        link.append(link[q])
        self.count.append(0)
        link[q] = new
        while p != -1 and arcs[p].get(c) == q:
            arcs[p][c] = new
            p = link[p]
        return new

    def close(self) -> None:
        """Adds up the occurrences of a state to its suffixes."""
        count, link = self.count, self.link
        for v in np.argsort(-np.array(self.length), kind="stable").tolist():
            if v:
                count[link[v]] += count[v]

    def statistics(self, sequence: list, window: int) -> Iterator[tuple[int, int]]:
        """At each element of any sequence: how many of the last elements occur as they stand (`window` if more do), and how often those occur."""
        arcs, length, link, count = self.arcs, self.length, self.link, self.count
        v = matched = 0
        for c in sequence:
            following = arcs[v].get(c)
            while following is None and v:
                # The longest suffix that occurs with another continuation.
                v = link[v]
                matched = length[v]
                following = arcs[v].get(c)
            if following is not None:
                v, matched = following, matched + 1
            while v and length[link[v]] >= window:
                v = link[v]
            matched = min(matched, window)
            yield matched, count[v]

    def repeated(self, sequence: list, window: int, least: int = 2) -> list[int]:
        """Ranges (start, end, start, end, ...) of the sequence's windows that occur at least so often."""
        out: list[int] = []
        for i, (matched, count) in enumerate(self.statistics(sequence, window)):
            if matched >= window and count >= least:
                at = i - window + 1
                if out and out[-1] == at:
                    out[-1] = at + 1
                else:
                    out += [at, at + 1]
        return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, tuple[list[bytes], int, list[tuple]]]]:
    """Rows of (g, words, ..., n) in the order of g to shards of whole groups: the different segments with their words, weight, and the other columns of their rows."""
    held: dict[bytes, tuple[list[bytes], int, list[tuple]]] = {}
    size, group = 0, None
    for batch in batches:
        for g, words, *rest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group:
                group = g
                if size >= SHARD_WORDS:
                    yield held
                    held, size = {}, 0
            # Equal segments have equal groups, so a shard has all of them.
            known = held.get(words)
            if known is None:
                split = words.split()
                size += len(split)
                held[words] = split, n, [tuple(rest)]
            else:
                known[2].append(tuple(rest))
                held[words] = known[0], known[1] + n, known[2]
    if held:
        yield held


def _ranges(shard: dict[bytes, tuple[list[bytes], int, list[tuple]]]) -> Iterator[tuple[bytes, list[int], list[tuple]]]:
    automaton = SuffixAutomaton()
    for split, weight, _ in shard.values():
        automaton.add(split, weight)
    automaton.close()
    for words, (split, _, rows) in shard.items():
        if found := automaton.repeated(split, WINDOW):
            yield words, found, rows


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, words, key, check, start, n) in the order of g to (key, check, start, ranges) of segments that hold a repeated window."""
    for shard in _shards(batches):
        rows = [(*row, ranges) for _, ranges, own in _ranges(shard) for row in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)], ["key", "check", "start", "ranges"])


def _repeated_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, words, n) in the order of g to the names (s1, s2) of windows that repeat."""
    for shard in _shards(batches):
        yield pa.RecordBatch.from_arrays(_named([_name(words) for words, _, _ in _ranges(shard)]), ["s1", "s2"])


def _joined_spans(segments: list[dict] | None) -> list[tuple[int, int]]:
    """The ranges of words to remove, in order and apart."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((s["start"] + r[i], s["start"] + r[i + 1] - 1 + WINDOW) for s in segments or [] for r in [s["ranges"]] for i in range(0, len(r), 2)):
        if spans and a <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(b, spans[-1][1])
        else:
            spans.append((a, b))
    return spans


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the name of the text: key and check, null for a null text."""
    chosen = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("key"), F.when(F.col("text").isNotNull(), F.hash("text")).alias("check"))


def _found(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different texts (key, check, text, copies), and for those with repeated windows their ranges (segments)."""
    texts = marked.where(F.col("text").isNotNull()).groupBy("key", "check").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    occurrences = texts.select("key", "check", "text", "copies").mapInArrow(_occurrences, "h bigint, key bigint, check int, n bigint, weight bigint")
    often = cut(occurrences.groupBy(F.col("h").alias("of")).agg(F.sum("n").alias("n_"), F.sum("weight").alias("weight_")).where("weight_ > 1").select("of", (F.col("n_") > HOT).alias("hot")))
    # Two lists of plain numbers are half the size of one of pairs.
    own = occurrences.join(often, F.col("h") == F.col("of")).groupBy(F.col("key").alias("key_"), F.col("check").alias("check_"))
    listed = cut(own.agg(F.collect_list(F.when(~F.col("hot"), F.col("h"))).alias("hashes"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot")))
    candidates = texts.join(listed, (F.col("key") == F.col("key_")) & (F.col("check") == F.col("check_")))
    cool = candidates.select("key", "check", "text", "copies", "hashes")
    segments = cool.mapInArrow(_cool, "g bigint, words binary, key bigint, check int, start int, n bigint")
    kinds = "key bigint, check int, start int, ranges array<int>"
    found = segments.repartition("g").sortWithinPartitions("g").mapInArrow(_repeats, kinds)
    if not listed.where(F.size("hot") > 0).isEmpty():
        warm = candidates.where(F.size("hot") > 0).select("key", "check", "text", "copies", F.col("hot").alias("hashes"))
        windows = warm.mapInArrow(_hot, "g bigint, words binary, n bigint").groupBy("g", "words").agg(F.sum("n").alias("n"))
        names = cut(windows.repartition("g").sortWithinPartitions("g").mapInArrow(_repeated_names, "s1 bigint, s2 bigint"))
        places = warm.mapInArrow(_hot_places, "p1 bigint, p2 bigint, key bigint, check int, start int")
        few = F.broadcast(names) if names.count() <= BROADCAST else names
        at = places.join(few, (F.col("p1") == F.col("s1")) & (F.col("p2") == F.col("s2")), "left_semi")
        found = found.unionAll(at.select("key", "check", "start", F.array(F.lit(0), F.lit(1)).alias("ranges")))
    return texts, found.groupBy(F.col("key").alias("key_"), F.col("check").alias("check_")).agg(F.collect_list(F.struct("start", "ranges")).alias("segments"))


def _each(docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], make: Callable[[list[bytes], list[tuple[int, int]]], tuple], empty: list) -> DataFrame:
    """doc_id and what `make` gives for the words of each text and the ranges to remove. It is made once a text and joined to the rows by its name."""
    marked = _marked(docs)
    texts, found = _found(marked)
    joined = texts.join(found, (F.col("key") == F.col("key_")) & (F.col("check") == F.col("check_")), "left").select("key", "check", "text", "segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [make((t or "").encode().split(), _joined_spans(s)) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            columns = [pa.array([g[i] for g in got], kind) for i, (_, _, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["k_", "c_", *(name for name, _, _ in fields)])

    made = joined.mapInArrow(run, "k_ bigint, c_ int, " + ", ".join(f"{name} {kind}" for name, kind, _ in fields))
    rows = marked.select("doc_id", "key", "check").join(made, (F.col("key") == F.col("k_")) & (F.col("check") == F.col("c_")), "left")
    return rows.select("doc_id", *[F.coalesce(F.col(name), e).alias(name) for (name, _, _), e in zip(fields, empty, strict=True)])


def _kept(split: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    own = list(split)
    for x, y in reversed(spans):
        del own[x:y]
    return b" ".join(own)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and an array of (start, end): the ranges of words that repeat."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [("n_words", "bigint", pa.int64()), ("spans", "array<struct<start:bigint,end:bigint>>", kind)]
    make = lambda split, s: (len(split), [{"start": x, "end": y} for x, y in s])
    return _each(docs, fields, make, [F.lit(0).cast("bigint"), F.array().cast(fields[1][1])])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, and text: the words that are kept, joined by one space."""
    fields = [("n_words", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("text", "string", pa.string())]
    make = lambda split, s: (len(split), sum(y - x for x, y in s), _kept(split, s).decode())
    return _each(docs, fields, make, [F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit("")])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    fields = [("n_words", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("kept_sha256", "string", pa.string())]
    make = lambda split, s: (len(split), sum(y - x for x, y in s), hashlib.sha256(_kept(split, s)).hexdigest())
    return _each(docs, fields, make, [F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(hashlib.sha256(b"").hexdigest())])


_AUTOMATA: dict[str, list[SuffixAutomaton]] = {}


def _automata(shared, window: int) -> list[SuffixAutomaton]:
    """A reference's automata, of about SHARD_WORDS words each, built once in a Python worker."""
    key = f"{shared.value[0]} {window}"
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        built, size = [], SHARD_WORDS
        for text in shared.value[1]:
            split = text.encode().split()
            if size >= SHARD_WORDS:
                built.append(SuffixAutomaton())
                size = 0
            built[-1].add(split, 1)
            size += len(split)
        for a in built:
            a.close()
        _AUTOMATA[key] = built
    return _AUTOMATA[key]


def dedup_against(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text: without the maximal spans of at least `window` words that occur in a text of the reference (column text).

    A reference of over BYTES is dealt by hash over several passes, whose ranges are joined by text.
    """
    texts = reference.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    n = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES))
    marked = _marked(docs)
    frame = marked.select("doc_id", "text", F.array().cast("array<int>").alias("found"))
    for i in range(n):
        part = sorted(r[0] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect())
        shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(part).encode()).hexdigest(), part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automata = _automata(shared, window)
            for b in batches:
                out = []
                for t, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    split = (t or "").encode().split()
                    out.append([*before, *(x for a in automata for x in a.repeated(split, window, 1))] if len(split) >= window else before)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "text", "found"])

        frame = frame.mapInArrow(run, "doc_id bigint, text string, found array<int>")
        frame = cut(frame) if i < n - 1 else frame

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                split = (t or "").encode().split()
                gone = np.zeros(len(split) + 1, "i8")
                np.add.at(gone, found[::2], 1)
                np.add.at(gone, [x + window - 1 for x in found[1::2]], -1)
                own = [w for w, g in zip(split, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
                total.append(len(split))
                removed.append(len(split) - len(own))
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return frame.mapInArrow(last, "doc_id bigint, n_words bigint, n_removed bigint, text string")
