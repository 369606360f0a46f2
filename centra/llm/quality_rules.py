"""Quality rules with host verdicts, in DataFrame operations only.

Each document is measured by itself and fails the base rules if it has under MIN_WORDS words or if over
MAX_REPEATED per cent of its words lie in 3-word windows that it holds twice or more. Then hosts are
judged: a host's failure rate is shrunk towards the mean of all hosts with a beta prior whose two
parameters are fitted to the hosts' rates by moments, and a host whose shrunk rate exceeds MAX_RATE
takes its documents with it. A host with few documents thus needs much stronger evidence than a large one.

Repeated windows are found inside the row: windows are hashed to 64 bits and sorted, and neighbours that
are equal repeat. Places of repeats are looked up in the list of repeated hashes, or, where that list
times the text would be long, read off the sorted (hash, place) pairs; both give the same places. Only
the measures, some 60 bytes a document, are kept for the second pass; hosts are summed by partial sums.

Cases: a null text has no words, measures 0 and fails; so do empty texts. Documents without a host (null)
form one group. Repeated rows are judged alike and each returned. An empty table gives an empty result.
A doc_id that is no number is null in the result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.llm.shared import SPACE, cut

MIN_WORDS, MAX_REPEATED, MAX_RATE = 50, 50, 0.5
SYMBOLS = "#*$%&|<>"
#: Fixed bounds of the prior's weight, in documents: hosts that differ no more than by chance are pooled.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6
#: Look-ups (repeated hashes times words) up to which a list is searched, and hosts up to which their table is broadcast.
LOOKUPS, HOSTS = 2_000_000, 100_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and the measures of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    frame = docs.select(
        *[F.col(c) for c in keep],
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \x09-\x0D]+", -1)).alias("w_"),
        F.length(_without(t, SPACE)).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("bigint").alias("n_symbols"),
        lines.alias("lines_"),
    )
    w, h, s, d, p = (F.col(c) for c in ("w_", "h_", "s_", "d_", "p_"))
    base = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    frame = frame.select(
        *keep, F.size(w).cast("bigint").alias("n_words"), "word_chars", "n_symbols", (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("bigint").alias("n_dup_lines"), F.when(F.size(w) >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("h_")
    )
    frame = frame.select(*base, "h_", F.sort_array(h).alias("s_"))
    frame = frame.select(*base, "h_", F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))).alias("d_"))
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    by_list = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
    frame = frame.select(
        *base, F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d).cast("bigint") * F.size(h) <= LOOKUPS, by_list).alias("p_"), F.when(F.size(d).cast("bigint") * F.size(h) > LOOKUPS, pairs).alias("pairs_")
    )
    q = F.col("pairs_")
    same = lambda e, k: (e["x"] == F.get(q, k - 1)["x"]) | (e["x"] == F.get(q, k + 1)["x"])
    by_sort = F.sort_array(F.transform(F.filter(q, same), lambda e: e["i"]))
    frame = frame.select(*base, F.coalesce(p, by_sort).alias("p_"))
    covered = F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return frame.select(*base, covered.cast("bigint").alias("n_repeat_words"))


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_kept."""
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed().cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    n, mean, spread, chance = hosts.agg(
        F.count("*"),
        F.sum("n_failed") / F.sum("n_docs"),
        F.var_pop(rate),
        F.avg(1 / F.col("n_docs")),
    ).first()
    mean = float(mean or 0.0)
    # Rates of hosts vary by chance as m(1-m)/n; what they vary beyond that is the prior's own variance.
    beyond = float(spread or 0.0) - mean * (1 - mean) * float(chance or 0.0)
    weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, mean * (1 - mean) / beyond - 1)) if beyond > 0 else MOST_WEIGHT
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    verdicts = hosts.select("host", "n_docs", "n_failed", F.round(shrunk, 9).alias("host_rate"), (shrunk <= MAX_RATE).alias("host_kept"))
    return F.broadcast(verdicts) if n <= HOSTS else verdicts


def judge(docs: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the measures, base_failed, kept, host_rate."""
    chosen = docs.select(F.expr(f"try_cast(`{key}` AS bigint)").alias("doc_id"), F.col(host).cast("string").alias("host_"), F.col(text).alias("text_"))
    measured = cut(measures(chosen, "text_", ("doc_id", "host_")))
    verdicts = host_verdicts(measured, "host_")
    joined = measured.join(verdicts, measured["host_"].eqNullSafe(verdicts["host"]), "left")
    return joined.select("doc_id", *MEASURES, failed().alias("base_failed"), (~failed() & F.coalesce("host_kept", F.lit(True))).alias("kept"), "host_rate")
