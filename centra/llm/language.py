"""Language identification of spans.

A word is a run of letters. Its script, read from a table of ranges, narrows the languages that it can be
in to those that were seen with that script in training. A candidate's score is the mean log-probability
of the word's character n-grams (one to three characters, word ends included). Viterbi over the words of a
text, with a penalty for each switch, then labels spans; a text's language is the one that covers most of
its letters, and the score is the share of its letters.

The model is fitted to at most MAX_DOCS documents (those with the smallest hash of their id), whole texts;
n-grams are counted in a table of fixed size, so the model does not grow with the corpus and is broadcast: 1 MB a language
(and 2 MB on the driver while it is fitted), for up to 32,767 languages.
Prediction is one pass without a shuffle. Viterbi steps through all texts of a batch at once.

Cases: a null text, and one without a letter, is `und` with score 0. If no row can be learned from, all are
`und`. Texts in a script that no training text had get the most frequent language. Ties go to the language
that sorts first. Repeated rows are labelled alike; an empty table gives an empty result. A doc_id that is no number is null in
the result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.llm import codepoints as cp
from centra.llm.shared import sample_of

MAX_DOCS = 6_000
BITS = 18
SMOOTH, SWITCH, LEAST_SHARE = 0.5, 5.0, 0.01
UNKNOWN = "und"
BARRED = -1e4


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # (2 ** BITS, languages): log-probabilities
    allowed: np.ndarray  # (scripts + 1, languages): 0, or BARRED


def _hashes(small: np.ndarray) -> list[np.ndarray]:
    """For each place, the table rows of the n-grams that end there; `small` has 0 for what is no letter."""
    a = small.astype("u8")
    b, c = np.zeros_like(a), np.zeros_like(a)
    b[1:] = a[:-1]
    c[2:] = np.where(b[2:] > 0, a[:-2], 0)
    shift = np.uint64(64 - BITS)
    one = (a * np.uint64(0x9E3779B97F4A7C15)) >> shift
    two = ((a + (b << np.uint64(21)) + np.uint64(1 << 61)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift
    three = ((a + (b << np.uint64(21)) + (c << np.uint64(42)) + np.uint64(1 << 63)) * np.uint64(0x165667B19E3779F9)) >> shift
    return [one.astype("i4"), two.astype("i4"), three.astype("i4")]


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    grams, scripts = np.zeros(1 << BITS, "i8"), np.zeros(len(cp.SCRIPTS) + 1, "i8")
    for begin, end in cp.chunks(texts):
        points, _, _ = cp.joined(texts[begin:end])
        small = cp.lower()[points]
        letter = small > 0
        one, two, three = _hashes(small)
        # The place after a word holds the n-grams of its end.
        after = np.zeros_like(letter)
        after[1:] = letter[:-1]
        grams += np.bincount(one[letter], minlength=1 << BITS)
        grams += np.bincount(two[letter | after], minlength=1 << BITS)
        grams += np.bincount(three[letter | after], minlength=1 << BITS)
        scripts += np.bincount(cp.scripts()[points[letter]], minlength=len(scripts))
    return grams, scripts


def fit(docs: DataFrame, learn_from: Column, max_docs: int = MAX_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows where `learn_from` holds and neither text nor lang is null."""
    rows = docs.where(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sample = sample_of(rows, "key", max_docs).select("lang", "text").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                grams, scripts = _counts([t for t, x in zip(texts, langs, strict=True) if x == name])
                both = np.concatenate([grams, scripts])
                at = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(both[at], pa.int64())], ["lang", "row", "n"])

    total = sample.mapInArrow(count, "lang string, row int, n bigint").groupBy("lang", "row").agg(F.sum("n").alias("n"))
    got = total.toArrow()  # at most (2 ** BITS + scripts) rows a language
    languages = sorted(set(got["lang"].to_pylist()))
    table = np.zeros(((1 << BITS) + len(cp.SCRIPTS) + 1, len(languages)))
    if languages:
        order = {x: i for i, x in enumerate(languages)}
        table[got["row"].to_numpy(), np.array([order[x] for x in got["lang"].to_pylist()])] = got["n"].to_numpy()
    grams, scripts = table[: 1 << BITS], table[1 << BITS :]
    logs = np.log(grams + SMOOTH) - np.log((grams + SMOOTH).sum(0, keepdims=True))
    share = scripts / np.maximum(1, scripts.sum(0, keepdims=True))
    allowed = np.where(share >= LEAST_SHARE, 0.0, BARRED)
    allowed[~(share >= LEAST_SHARE).any(1)] = 0.0  # a script without a language bars none
    return Model(languages, logs.astype("f4"), allowed.astype("f4"))


def word_scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the words of all texts, one row a word; each word's text, start and length."""
    scores, owner, start, length = [], [], [], []
    for begin, end in cp.chunks(texts):
        points, starts, _ = cp.joined(texts[begin:end])
        small = cp.lower()[points]
        first, last = cp.runs(small > 0)
        if not len(first):
            continue
        one, two, three = _hashes(small)
        # Rows are gathered once for places in words and the place after each, where only word ends count.
        sums = model.grams[two]
        sums += model.grams[three]
        sums[small > 0] += model.grams[one[small > 0]]
        edges = np.column_stack([first, last + 1]).ravel()
        total = np.add.reduceat(sums, edges[:-1] if edges[-1] >= len(sums) else edges, axis=0)[::2]
        n = last - first
        word = total / (3.0 * n + 2.0)[:, None] * np.minimum(n, 8)[:, None].astype("f4")
        word += model.allowed[cp.scripts()[points[first]]]
        text = np.searchsorted(starts, first, side="right") - 1
        scores.append(word.astype("f4"))
        owner.append(text + begin)
        start.append(first - starts[text])
        length.append(n)
    if not scores:
        return np.zeros((0, len(model.languages)), "f4"), *(np.zeros(0, "i8") for _ in range(3))
    return np.concatenate(scores), np.concatenate(owner), np.concatenate(start), np.concatenate(length)


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; `sizes` are the words of each text, whose rows follow each other."""
    n, k = scores.shape
    if k <= 1 or not n:
        return np.zeros(n, "i2")
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    sizes, offsets = sizes[order], offsets[order]
    # Texts still running at each step: they come first, longest first.
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    back = np.zeros((n, k), "i2")
    own = np.arange(k, dtype="i2")
    best = scores[offsets[: active[0]]].copy()
    ended = np.zeros(len(sizes), "i2")
    for t in range(1, len(active)):
        a = active[t]
        if a < len(best):
            ended[a : len(best)] = best[a:].argmax(1)
            best = best[:a]
        top = best.argmax(1)
        other = best[np.arange(a), top][:, None] - switch
        moved = other > best
        rows = offsets[:a] + t
        back[rows] = np.where(moved, top[:, None].astype("i2"), own)
        best = np.where(moved, other, best) + scores[rows]
    ended[: len(best)] = best.argmax(1)
    labels = np.zeros(n, "i2")
    now = ended.astype("i8")
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        rows = offsets[:a] + t
        labels[rows] = now[:a]
        if t:
            now[:a] = back[rows, now[:a]]
    return labels


def _labelled(model: Model, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, owner, start, length, label) for ranges of texts with a few million words together."""
    for begin, end in cp.chunks(texts, 16_000_000):
        scores, owner, start, length = word_scores(model, texts[begin:end])
        sizes = np.bincount(owner, minlength=end - begin)
        yield begin, end, owner, start, length, viterbi(scores, sizes[sizes > 0])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, shares = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for begin, end, owner, _, length, label in _labelled(m, texts) if k else ():
                letters = np.bincount(owner * k + label, weights=length, minlength=(end - begin) * k).reshape(-1, k)
                total, top = letters.sum(1), letters.argmax(1)
                for i in np.flatnonzero(total).tolist():
                    names[begin + i] = m.languages[top[i]]
                    shares[begin + i] = letters[i, top[i]] / total[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.expr(f"try_cast(`{key}` AS bigint)").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and an array of (start, end, lang): maximal runs of words with one label, in characters of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            column: list[list[dict]] = [[] for _ in texts]
            for begin, _, owner, start, length, label in _labelled(m, texts) if m.languages else ():
                for o, s, n, x in zip(owner.tolist(), start.tolist(), length.tolist(), label.tolist(), strict=True):
                    own, name = column[begin + o], m.languages[x]
                    if own and own[-1]["lang"] == name:
                        own[-1]["end"] = s + n
                    else:
                        own.append({"start": s, "end": s + n, "lang": name})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(column, kind)], ["doc_id", "spans"])

    return docs.select(F.expr(f"try_cast(`{key}` AS bigint)").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, spans array<struct<start:bigint,end:bigint,lang:string>>")
