"""The pipeline's rows against each stage's decision made again by brute force on the stage's own input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from centra.llm import quality, queries
from centra.llm.shared import bucket_of
from test_operators import brute_hits, components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def similar(a, b):
    p, q = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return p == q or 25 * len(p & q) ** 2 >= 16 * len(p) * len(q) > 0


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    question = prose(24)
    rows, labels, kind = [], [], {}

    def add(text, what, label=None):
        i = len(rows)
        rows.append((i, text, "en", f"s{i % 3}", len(text or "")))
        kind[i] = what
        if label is not None:
            labels.append((i, label, 0))

    for i in range(150):
        add(prose(100) + "\nAll rights reserved here\n" + prose(60), "clean", 1 if i % 2 else None)
    for _ in range(40):
        add(prose(100).upper().replace(" ", "!! "), "junk", 0)
    copied = prose(200)
    for _ in range(4):
        words = copied.split()
        words[rng.randrange(len(words))] = "other"
        add(" ".join(words), "copies")
    for _ in range(3):
        add(prose(80) + " " + question + " " + prose(40), "leak")
    add(None, "empty")
    add("", "empty")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, question)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, kind


def test_stages_and_run(spark, folder):
    path, rows, kind = folder
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"), bucket_of("doc_id", 5) != 0)
    left = {i: t for i, t, *_ in rows}
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
            seen.append({r.doc_id: r.text for r in docs.collect()})
    scores = model.score(list(left.values()))
    assert set(seen[0]) == {i for i, s in zip(left, scores, strict=True) if s >= quality.THRESHOLD}
    assert not any(kind[i] == "junk" for i in seen[0]) and all(i in seen[0] for i in kind if kind[i] == "clean")
    assert all("All rights" not in (t or "") for t in seen[1].values()) and set(seen[1]) == set(seen[0])
    assert sum(kind[i] == "copies" for i in seen[2]) == 1 and all(i in seen[2] for i in kind if kind[i] in ("clean", "leak"))
    source = {i: x for i, _, _, x, _ in rows}
    pages, total = Counter((source[i], x.strip()) for i, t in seen[0].items() for x in set((t or "").split("\n"))), Counter(source[i] for i in seen[0])
    cleaned = lambda i, t: "\n".join(x for x in t.split("\n") if not x.strip() or pages[source[i], x.strip()] < 3 or pages[source[i], x.strip()] <= 0.08 * total[source[i]])
    assert seen[1] == {i: None if t is None else cleaned(i, t) for i, t in seen[0].items()}
    ids = sorted(seen[1])
    near = [(a, b) for a in ids for b in ids if a < b and similar(seen[1][a], seen[1][b])]
    assert set(seen[2]) == set(components(ids, near).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    hits = brute_hits(list(seen[2].values()), items)
    assert set(seen[3]) == {i for n, i in enumerate(seen[2]) if not hits[n][-1]} and not any(kind[i] == "leak" for i in seen[3])
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.TOKENIZER)
    want = {i: hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in seen[3].items()}
    assert {r.doc_id: r.ids_sha256 for r in docs.collect()} == want
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, path).collect()} == want
    assert np.all([len(h) == 64 for h in want.values()])


def test_odd_tables(spark, folder, tmp_path):
    """Rows without an id, repeated rows, clashing names, very long texts; an empty table, an empty benchmark and no labels."""
    path, rows, _ = folder
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = [(None, "alone " + rows[0][1]), (None, None), (5, rows[5][1]), (5, rows[5][1]), (900, long), (901, long + " end"), (902, ""), (903, "\n\n")]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "x", 3) for i, t in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint, mark string, node int")
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{empty}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, empty)
            assert frame.columns == COLUMNS
        got = sorted((str(r.doc_id), (r.text or "")[:20]) for r in frame.collect())
        last = corpus_pipeline.STAGES[-1][1](spark, frame, empty)
        assert last.count() == len(got)
        if got:
            assert [g[0] for g in got] == ["5", "900", "902", "None"]
