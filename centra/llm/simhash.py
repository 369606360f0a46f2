"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Equal fingerprints are
one node. Distinct fingerprints, in order, are a binary trie, and the join descends pairs of its nodes: from the
root with itself, each pair goes on to the pairs of its children, the differing bits add up, and a pair is dropped when
they exceed the budget. All pairs of a level are one array operation. Pairs of very small nodes (DIRECT) are compared row by row.

The top of the trie is dealt over tasks: it is cut at the level where no node has over NODE_ROWS
fingerprints, the node pairs of that level that are within the budget are the tasks' roots, and each
fingerprint goes to the pairs of its own node: 1 + P + P (P - 1) / 2 of them at level P, for a budget of two. A task's memory does
not grow with the corpus, and what is shuffled grows with the square of its logarithm. A task hands on the
edges of a spanning forest, not its pairs; components are then formed over all tasks.

Cases: a null or empty text has the fingerprint zero and is linked like any other. A text of fewer words
than a shingle is one shingle. Copies share a node, however many. Rows that repeat an id are each returned, with
the fingerprint of their own text; a row without an id (or with one that is no number) has a null id in the
result, and a component of such rows only a null component_id. An empty table gives an empty result. Other columns are
ignored by `components_of`.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.llm import graph
from centra.llm.shared import cut
from centra.llm.words import Words, chunks

SHINGLE, BUDGET, SEED = 3, 2, 42
#: Fingerprints of a trie node that is a task's root, and the deepest level of such nodes.
NODE_ROWS, TOP = 65_536, 16
#: Rows of tasks, by columns of 64 bits, that are searched at once, pairs of trie nodes that are descended at once, products of sizes that are compared outright, and comparisons at once.
ROWS, FRONTIER, DIRECT, COMPARED = 250_000, 500_000, 16, 2_000_000

#: Of the dedup by similarity: columns of 64 bits in a fingerprint, and the bands of least hashes that texts meet in.
SIMILARITY, COLUMNS, BANDS, BAND_ROWS = 0.8, 4, 24, 3
#: Texts of a band, and texts and bytes of a group to be verified, that one task holds twice at most; rows that are broadcast at most.
CHUNK, VERIFIED, SETS, BROADCAST = 4096, 4096, 4 << 20, 1_000_000
#: Sets of a group that a hash is in, up to which sets are looked up by it.
RARE = 32


def words(text: str | None) -> list[bytes]:
    """Runs of other than space and U+0009 to U+000D, after A-Z are lower-cased; both are decided byte by byte."""
    return (text or "").encode().lower().split()


def shingle_hashes(split: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of all shingles, repeats included; fewer words than a shingle has are one."""
    if not split:
        return np.zeros(0, "u8")
    n = max(1, len(split) - shingle + 1)
    text, digest = b" ".join(split), xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(text, SEED)], "u8")
    ends = np.cumsum(np.fromiter(map(len, split), "i8", len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), "u8", n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero for none."""
    ones = np.zeros(64, "i8")
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i4")
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(split: list[bytes], shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(split, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(words(t), shingle) for t in b.column(1).to_pylist()), "u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view("i8"), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.expr(f"try_cast(`{key}` AS bigint)").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, fp bigint")


def _near(x: np.ndarray, i: np.ndarray, j: np.ndarray, budget: int) -> np.ndarray:
    return np.bitwise_count(x[i] ^ x[j]).sum(1, dtype="i4") <= budget


def _direct(x: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compares all of each pair of ranges, so many pairs at a time that the arrays stay small."""
    size = (ah - al) * (bh - bl)
    total = np.cumsum(size)
    begin = 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + COMPARED, side="right")))
        own, m = size[begin:end], (bh - bl)[begin:end]
        of = np.repeat(np.arange(end - begin), own)
        k = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)
        i, j = al[begin:end][of] + k // m[of], bl[begin:end][of] + k % m[of]
        i, j = i[i < j], j[i < j]
        near = _near(x, i, j, budget)
        if near.any():
            yield i[near], j[near]
        begin = end


def _pairs(x: np.ndarray, ranges: tuple[np.ndarray, ...], budget: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most `budget` bits apart, for pairs of ranges (a's start and end, b's start and end, b the same or after a) of x, whose rows (columns of 64 bits) are in order within a range.

    With labels, pairs of rows of one label are spared. Of rows that do not differ at all a chain is enough, without labels.
    """
    stack = [(64 * x.shape[1] - 1, *ranges, np.zeros(len(ranges[0]), "i2"))]
    ones: dict[int, np.ndarray] = {}
    changes = None if label is None else np.concatenate([[0], np.cumsum(label[1:] != label[:-1], dtype="i4")])
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(bit, *(v[:half] for v in (al, ah, bl, bh, err))), (bit, *(v[half:] for v in (al, ah, bl, bh, err)))]
            continue
        if label is not None:
            go = (label[al] != label[bl]) | (changes[ah - 1] != changes[al]) | (changes[bh - 1] != changes[bl])
            al, ah, bl, bh, err = al[go], ah[go], bl[go], bh[go], err[go]
        if bit < 0 and label is None:
            # What is left has no more differing bits than the budget: one link a pair of nodes, a chain in a node.
            inner = np.repeat(al[al == bl], (ah - al - 1)[al == bl])
            step = np.arange(len(inner)) - np.repeat(np.cumsum((ah - al - 1)[al == bl]) - (ah - al - 1)[al == bl], (ah - al - 1)[al == bl])
            yield np.concatenate([al[al != bl], inner + step]), np.concatenate([bl[al != bl], inner + step + 1])
            continue
        small = ((ah - al) * (bh - bl) <= DIRECT) | (bit < 0)
        if small.any():
            yield from _direct(x, al[small], ah[small], bl[small], bh[small], budget)
            rest = ~small
            al, ah, bl, bh, err = al[rest], ah[rest], bl[rest], bh[rest], err[rest]
        if not len(al):
            continue
        if bit not in ones:
            # Ones below each place: within a node, rows with a one at this bit follow those without.
            column = x[:, x.shape[1] - 1 - bit // 64]
            ones[bit] = np.concatenate([np.zeros(1, "i4"), np.cumsum((column >> np.uint64(bit % 64)) & np.uint64(1), dtype="i4")])
        c = ones[bit]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl
        # Children that go the same way keep the count of differing bits, others add one; a node with itself is crossed once.
        children = [
            (al, am, bl, bm, err, am > al),
            (am, ah, bm, bh, err, ah > am),
            (al, am, bm, bh, err + 1, err < budget),
            (am, ah, bl, bm, err + 1, (err < budget) & ~same),
        ]
        next_pairs = []
        for a0, a1, b0, b1, e, go in children:
            go = go & (a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1))
            next_pairs.append((a0[go], a1[go], b0[go], b1[go], e[go]))
        merged = tuple(np.concatenate(v) for v in zip(*next_pairs, strict=True))
        if len(merged[0]):
            stack.append((bit - 1, *merged))


def _spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that make a spanning forest of n rows."""
    root = np.arange(n)
    one, two = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            # A pair for each root that is not the least of its pair: it hangs that root below the other.
            high, at = np.unique(np.maximum(a, b), return_index=True)
            one.append(i[at])
            two.append(j[at])
            root[high] = np.minimum(a, b)[at]
            while not np.array_equal(jumped := root[root], root):
                root = jumped
    return np.concatenate(one), np.concatenate(two)


def _search(keys: np.ndarray, side: np.ndarray, node: np.ndarray, x: np.ndarray, budget: int, label: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes: a spanning forest, or with labels all pairs whose labels differ; `keys` has equal rows next to each other, x the fingerprints, the highest 64 bits first."""
    edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
    number = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((*x.T[::-1], side, number))
    x, number, side, node = x[order], number[order], side[order], node[order]
    label = None if label is None else label[order]
    starts = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (side[1:] != side[:-1])]))
    ends = np.append(starts[1:], len(x))
    alone = (keys[edges[:-1], -1] == keys[edges[:-1], -2])[number[starts]]
    # A task's root is a node with itself, or two nodes of the trie: their rows follow each other.
    own = np.flatnonzero(alone & (ends - starts > 1))
    first = np.flatnonzero(~alone[:-1] & (number[starts][1:] == number[starts][:-1]))
    a, b = np.concatenate([own, first]), np.concatenate([own, first + 1])
    pairs = _pairs(x, (starts[a], ends[a], starts[b], ends[b]), budget, label)
    if label is None:
        i, j = _spanning(len(x), pairs)
    else:
        found = [(i[label[i] != label[j]], j[label[i] != label[j]]) for i, j in pairs]
        i, j = (np.concatenate([np.zeros(0, "i8"), *c]) for c in (zip(*found, strict=True) if found else ([], [])))
    return node[i], node[j]


def _joined(dealt: DataFrame, keys: int, width: int, budget: int) -> DataFrame:
    """Rows to edges (u, v), a spanning forest of each task's pairs within the budget. A row is a task's key, whose last two columns are the task's two trie nodes, the side that the row is on, the row's node, and `width` columns of its fingerprint; a task's rows are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def search(rows: np.ndarray) -> pa.RecordBatch:
            x = np.ascontiguousarray(rows[:, keys + 2 : keys + 2 + width]).view("u8")
            u, v = _search(rows[:, :keys], rows[:, keys], rows[:, keys + 1], x, budget, None)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.column_stack([c.to_numpy() for c in b.columns]))
            size += b.num_rows
            if size >= ROWS // width:
                rows = np.concatenate(held)
                last = (rows[:, :keys] == rows[-1, :keys]).all(1)
                held, size = [rows[last]], int(last.sum())
                if size < len(rows):
                    yield search(rows[~last])
        if size:
            yield search(np.concatenate(held))

    return dealt.mapInArrow(run, "u bigint, v bigint")


def level(nodes: DataFrame) -> int:
    """The first level of the trie where no node has over NODE_ROWS fingerprints, TOP at most; 2 ** TOP counts reach the driver."""
    sizes = np.zeros(1 << TOP, "i8")
    for prefix, n in nodes.groupBy(F.shiftrightunsigned("fp", 64 - TOP).alias("p")).count().collect():
        sizes[prefix] = n
    return next((p for p in range(TOP) if sizes.reshape(1 << p, -1).sum(1).max() <= NODE_ROWS), TOP)


def links(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect what lies within the budget."""
    p = level(nodes)
    prefix = F.shiftrightunsigned("fp", 64 - p) if p else F.lit(0).cast("bigint")
    apart = F.array(*[F.lit(m).cast("bigint") for m in range(1 << p) if m.bit_count() <= budget])
    pairs = F.transform(apart, lambda m: F.struct(F.least("own", F.col("own").bitwiseXOR(m)).alias("a"), F.greatest("own", F.col("own").bitwiseXOR(m)).alias("b")))
    dealt = nodes.select("fp", prefix.alias("own")).select("fp", "own", F.inline(pairs)).repartition("a", "b").sortWithinPartitions("a", "b")
    return _joined(dealt.select("a", "b", (F.col("own") == F.col("b")).cast("bigint").alias("side"), F.col("fp").alias("node"), "fp"), 2, 1, budget)


def components_of(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id of the documents whose fingerprints can be reached by links."""
    prints = cut(fingerprints(docs, shingle, key, text))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_")))
    joined = graph.components(links(nodes, budget))
    rooted = nodes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first_", F.coalesce("root", "fp").alias("root_"))
    # A component's smallest document, over its nodes; then over each node's documents.
    least = cut(rooted.groupBy(F.col("root_").alias("of_")).agg(F.min("first_").alias("component_id")))
    named = cut(rooted.join(least, F.col("root_") == F.col("of_")).select(F.col("fp").alias("node_"), "component_id"))
    return prints.join(named, F.col("fp") == F.col("node_")).select("doc_id", "fp", "component_id")


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype="u8") * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """A 64-bit name of each text's words, and the hashes of its different shingles, in order; A-Z are lower-cased."""
    for begin, end in chunks(texts):
        w = Words([(t or "").encode().lower() for t in texts[begin:end]])
        hashes = w.hashes()
        for i in range(end - begin):
            own = hashes[w.base[i] : w.base[i + 1]]
            yield Words.name(own), np.unique(Words.rolled(own, min(shingle, len(own)))) if len(own) else own


def _sketch(hashes: np.ndarray, columns: np.ndarray, salts: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint's columns, and one key a band: a hash of BAND_ROWS least values under as many permutations of the shingles' hashes."""
    if not len(hashes):
        return np.zeros(COLUMNS, "u8"), np.zeros(0, "u8")
    prints = []
    for salt in columns:
        h = hashes * salt
        prints.append(majority(h ^ (h >> np.uint64(32))))
    least = np.full(len(salts), np.iinfo("u8").max, "u8")
    for i in range(0, len(hashes), 1024):
        mixed = salts[:, None] * hashes[None, i : i + 1024]
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, mixed.min(1))
    keys = (least.reshape(BANDS, BAND_ROWS) * band).sum(1, dtype="u8")
    return np.array(prints, "u8"), (keys ^ (keys >> np.uint64(31))) * _BAND_SALTS


_BAND_SALTS = _odd(BANDS, 4)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, mark, text to doc_id, mark, node (a name of the words), the fingerprint's columns and the bands' keys."""
    prints = [f"f{i}" for i in range(COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, salts, band = _odd(COLUMNS, 1), _odd(BANDS * BAND_ROWS, 2), _odd(BAND_ROWS, 3)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                nodes, got, keys = [], [], []
                for name, hashes in shingle_sets(b.column(2).to_pylist(), shingle):
                    own, bands = _sketch(hashes, columns, salts, band)
                    nodes.append(name)
                    got.append(own)
                    keys.append(bands.view("i8"))
                numbers = [np.array(nodes, "u8"), *np.array(got, "u8").reshape(-1, COLUMNS).T]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(c).view("i8"), pa.int64()) for c in numbers), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "node", *prints, "keys"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, f"doc_id bigint, mark bigint, node bigint, {', '.join(f'{f} bigint' for f in prints)}, keys array<bigint>")


def _shared(rows: DataFrame) -> DataFrame:
    """key, node, a key's rows together, without the rows whose key no other row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, seen = np.zeros(0, "i8"), np.zeros(0, "i8"), False

        def kept(n: int) -> pa.RecordBatch:
            """The first n rows, the row after them being known or the end; `seen` tells whether the first one's key came before."""
            same = np.concatenate([[seen], key[1:] == key[:-1], [False]])
            at = np.flatnonzero((same[:-1] | same[1:])[:n])
            return pa.RecordBatch.from_arrays([pa.array(key[at], pa.int64()), pa.array(node[at], pa.int64())], ["key", "node"])

        for b in batches:
            key, node = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate((key, node)))
            if len(key) > 1:
                yield kept(len(key) - 1)
                seen = bool(key[-2] == key[-1])
                key, node = key[-1:], node[-1:]
        if len(key):
            yield kept(1)

    return rows.mapInArrow(run, "key bigint, node bigint")


def _dealt(nodes: DataFrame) -> DataFrame:
    """key, a, b, side, node and fingerprint: the texts that share a band, where a band of over CHUNK texts is cut into parts and each pair (a, b) of its parts is a task by itself."""
    pairs = nodes.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key")
    shared = cut(_shared(pairs))
    large = cut(shared.groupBy("key").agg(F.count("*").alias("n_")).where(F.col("n_") > CHUNK).select(F.col("key").alias("key_"), F.ceil(F.col("n_") / CHUNK).cast("bigint").alias("parts_")))
    parts = shared.join(F.broadcast(large) if large.count() <= BROADCAST else large, F.col("key") == F.col("key_"), "left").select("key", "node", F.coalesce("parts_", F.lit(1).cast("bigint")).alias("parts_"))
    own = parts.select("key", "node", "parts_", F.pmod(F.xxhash64("node"), "parts_").alias("own"))
    both = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts_") - 1), lambda o: F.struct(F.least("own", o).alias("a"), F.greatest("own", o).alias("b")))
    rows = own.select("key", "node", "own", F.inline(both)).select("key", "a", "b", (F.col("own") == F.col("b")).cast("bigint").alias("side"), "node")
    prints = [f"f{i}" for i in range(COLUMNS)]
    return cut(rows.join(nodes.select(F.col("node").alias("node_"), *prints), F.col("node") == F.col("node_")).select("key", "a", "b", "side", "node", *prints))


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def _verified(edges: DataFrame, texts: DataFrame, shingle: int, share: Fraction) -> DataFrame:
    """Edges (u, v) that connect what is linked by a cosine of at least `share` of the sets of shingles, among the texts that `edges` connect; texts are (node, text).

    A component of the edges is a task, to which each text's set goes once, whatever the number of its pairs. One of over VERIFIED
    texts or SETS bytes of sets is cut into parts, and each pair of parts is a task by itself.
    """
    rooted = graph.components(edges)
    members = cut(rooted.select("node", "root").unionAll(rooted.select(F.col("root").alias("node"), "root")).distinct())
    wanted = members.select(F.col("node").alias("node_"))
    few = F.broadcast(wanted) if members.count() <= BROADCAST else wanted
    once = texts.join(few, F.col("node") == F.col("node_"), "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                raw = [h.tobytes() for _, h in shingle_sets(b.column(1).to_pylist(), shingle)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(raw, pa.binary())], ["of", "size", "hashes"])

    hashed = cut(once.select("node", "text").mapInArrow(sets, "of bigint, size bigint, hashes binary"))
    sizes = members.join(hashed.select("of", "size"), F.col("node") == F.col("of")).groupBy(F.col("root").alias("root_"))
    large = cut(sizes.agg(F.ceil(F.greatest(F.count("*") / VERIFIED, F.sum("size") / SETS)).cast("bigint").alias("parts_")).where("parts_ > 1"))
    placed = members.join(F.broadcast(large) if large.count() <= BROADCAST else large, F.col("root") == F.col("root_"), "left")
    own = placed.select("node", F.col("root").alias("key"), "parts_", F.pmod(F.xxhash64("node"), "parts_").alias("own"))
    other = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("parts_") - 1), lambda o: o != F.col("own"))
    both = F.transform(F.when(F.col("parts_") > 1, other).otherwise(F.array(F.lit(0).cast("bigint"))), lambda o: F.struct(F.least("own", o).alias("a"), F.greatest("own", o).alias("b")))
    rows = own.join(hashed.select("of", "hashes"), F.col("node") == F.col("of")).select("key", "node", "hashes", F.inline(both))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, held = None, [], []

        def found() -> pa.RecordBatch:
            i, j = _forest(held, share)
            at = np.array(nodes, "i8")
            return pa.RecordBatch.from_arrays([pa.array(at[i], pa.int64()), pa.array(at[j], pa.int64())], ["u", "v"])

        for b in batches:
            for *own, node, raw in zip(*(b.column(c).to_pylist() for c in ("key", "a", "b", "node", "hashes")), strict=True):
                if own != task:
                    if task:
                        yield found()
                    task, nodes, held = own, [], []
                nodes.append(node)
                held.append(np.frombuffer(raw, "u8"))
        if task:
            yield found()

    return _together(rows).mapInArrow(run, "u bigint, v bigint")


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of n from start."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _forest(sets: list[np.ndarray], share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that make a spanning forest of the links: the pairs of sets (hashes, in order) with a cosine of at least `share`.

    Sets are looked up one after another, the most typical first; those of the largest component so far are passed over, since
    a link out of it is found from its other end. A lookup counts the common hashes, exactly, with the sets that have a rare hash (in up to RARE sets) in common, and with those
    to which the frequent hashes alone could be enough, by both sets' numbers of them.
    """
    if len(sets) == 2:
        linked = np.arange(1 if _similar(*sets, share) else 0)
        return linked, linked + 1
    given = np.argsort([len(h) for h in sets], kind="stable")
    size = np.array([len(sets[i]) for i in given])
    at, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    ids = np.unique(np.concatenate([sets[i] for i in given]), return_inverse=True)[1].astype("i4")
    common = np.bincount(ids)
    rare = (common > 1) & (common <= RARE)
    where = np.flatnonzero(rare[ids])
    posted = owner[where[np.argsort(ids[where], kind="stable")]]
    length = np.where(rare, common, 0)
    post = np.cumsum(length) - length
    frequent = np.bincount(owner, weights=common[ids] > RARE, minlength=len(size)).astype("i8")
    typical = np.bincount(owner, weights=common[ids], minlength=len(size)) / size
    p, q = share.numerator**2, share.denominator**2
    label, count, largest = np.arange(len(size)), np.ones(len(size), "i8"), -1
    own, done, one, two = np.zeros(len(common), bool), np.zeros(len(size), bool), [], []
    while len(left := np.flatnonzero(~done & (label != largest))):
        for u in left[np.argsort(-typical[left], kind="stable")].tolist():
            if label[u] == largest:
                continue
            done[u] = True
            hashes = ids[at[u] : at[u] + size[u]]
            low, high = np.searchsorted(size, [-(-p * size[u] // q), size[u] * q // p + 1])
            enough = low + np.flatnonzero(np.minimum(frequent[low:high], frequent[u]) ** 2 * q >= p * size[u] * size[low:high])
            few = hashes[rare[hashes]]
            near = np.unique(np.concatenate([enough, posted[_spread(post[few], length[few])]]))
            near = near[(near >= low) & (near < high) & (label[near] != label[u])]
            if not len(near):
                continue
            own[hashes] = True
            met = np.concatenate([_met(own, ids, at[some], size[some]) for some in _blocks(near, size)])
            own[hashes] = False
            near = near[met**2 * q >= p * size[u] * size[near]]
            if len(near):
                labels, first = np.unique(label[near], return_index=True)
                one.append(np.full(len(first), u))
                two.append(near[first])
                into, total = label[u], count[labels].sum()
                label[np.isin(label, labels)] = into
                count[into] += total
                if largest < 0 or largest in labels or count[into] > count[largest]:
                    largest = into
    i, j = (np.concatenate([np.zeros(0, "i8"), *c]) for c in (one, two))
    return given[i], given[j]


def _blocks(near: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Cut where the sets together go on over COMPARED hashes."""
    total = np.cumsum(size[near]) // COMPARED
    return np.split(near, np.flatnonzero(total[1:] != total[:-1]) + 1)


def _met(own: np.ndarray, ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many hashes of each set are own ones."""
    return np.add.reduceat(own[ids[_spread(at, size)]], np.cumsum(size) - size, dtype="i8")


def _similar(a: np.ndarray, b: np.ndarray, share: Fraction) -> bool:
    """Whether two sets of hashes, in order, have a cosine of at least `share`; in whole numbers, so exactly."""
    low, high = sorted((len(a), len(b)))
    if not low or low * share.denominator**2 < high * share.numerator**2:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common**2 * share.denominator**2 >= share.numerator**2 * low * high


def budget(similarity: float, bits: int = 64 * COLUMNS) -> int:
    """Bits that two fingerprints at that cosine differ in at most: four standard deviations beyond the mean."""
    angle = acos(similarity) / pi
    return ceil(bits * angle + 4 * sqrt(bits * angle * (1 - angle)))


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with one of each group of near duplicates: that with the smallest id.

    Two texts are linked if the cosine of their sets of shingles, which is the similarity that the bits of fingerprints
    stand for, is at least `similarity`; it is decided by the sets themselves. Their Jaccard similarity is never
    above that cosine, so whatever has `similarity` by Jaccard is linked too. Fingerprints have 64 * COLUMNS bits over the different shingles.
    A budget of a fifth of the bits hardly prunes the top of a trie, so the tries that are joined are
    those of the texts that share one of BANDS bands of BAND_ROWS least hashes. Of two texts of equal size at the threshold, no band
    is shared with a probability of 2.2e-4, at a Jaccard similarity of 0.8 of 3e-8; fewer than 1e-4 at the threshold differ in more bits than the budget.

    No step writes pairs. A task of the join hands on a spanning forest of those within the budget, so it has fewer edges than texts; the texts that
    edges connect meet once, with their sets, and are linked there by an index of the shingles. Linked or not, a group's texts
    are one row each until it is cut into parts (see `_verified`). Comparisons of fingerprints grow with the square of a band's texts that are within the budget.

    Equal texts (by a 64-bit hash of their words) are one node. Rows with one id and one text are one row, and one of them stays. Null and
    empty texts are copies of each other. A row without an id stays only if no other of its group has one; ids that are no
    numbers count as none. Of several with the same id the one whose text has the smaller hash stays.
    """
    share = Fraction(str(similarity))
    marked = docs.select("*", F.expr("try_cast(doc_id AS bigint)").alias("id__"), F.xxhash64("text").alias("mark__"))
    got = cut(sketches(marked.select(F.col("id__").alias("doc_id"), F.col("mark__").alias("mark"), "text"), shingle))
    prints = [f"f{i}" for i in range(COLUMNS)]
    nodes = cut(got.select("node", *prints, "keys").dropDuplicates(["node"]))
    dealt = _dealt(nodes)
    # The texts of nodes are found by the hash of the text itself, without computing their words again.
    named = cut(got.groupBy("mark").agg(F.min("node").alias("node")).join(dealt.select(F.col("node").alias("in_")).distinct(), F.col("node") == F.col("in_"), "left_semi"))
    names = F.broadcast(named) if named.count() <= BROADCAST else named
    texts = marked.select("text", "mark__").join(names, F.col("mark__") == F.col("mark")).select("node", "text")
    proposed = _joined(_together(dealt), 3, COLUMNS, budget(similarity)).distinct()
    joined = graph.components(_verified(proposed, texts, shingle, share))

    # Copies are summed up by node before they are joined.
    first_of = lambda c: F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias(c)
    least = got.groupBy("node").agg(first_of("first")).join(joined.withColumnRenamed("node", "of_"), F.col("node") == F.col("of_"), "left")
    kept = cut(least.groupBy(F.coalesce("root", "node").alias("of")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark")))
    rows = cut(got.groupBy("doc_id", "mark").agg(F.count("*").alias("n")))
    match = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    dropped = cut(rows.join(kept, match, "left_anti").select(F.col("doc_id").alias("dropped_id"), F.col("mark").alias("dropped_mark")))
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST else dropped
    left = marked.join(gone, F.col("id__").eqNullSafe(F.col("dropped_id")) & (F.col("mark__") == F.col("dropped_mark")), "left_anti")
    if not rows.where("n > 1").join(kept, match, "left_semi").isEmpty():
        left = left.dropDuplicates(["id__", "mark__"])
    return left.drop("id__", "mark__")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return components_of(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
