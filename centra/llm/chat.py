"""Chat formatting: records of any known layout to canonical turns, and turns to a training text with a loss mask.

A record's layout is told by its schema fingerprint: a hash of the nested paths of its fields, but for fields
that carry no text (METADATA). The fingerprint selects one of the declared mappings (LAYOUTS), which says where
roles and texts stand. A table with a schema has one fingerprint (`canonical`); a column of JSON records has one
a record, from the fields that the record has (`canonical_json`). An unknown fingerprint is an error in a
table. A JSON record gets null turns if its fingerprint is unknown, if it is no JSON or nested beyond Python's recursion, if a message is no
object, if a text is a list or an object, or if one of several messages that have places has none, or no whole number; half a surrogate
pair in it becomes U+FFFD.

The template marks turns with control strings. Where a text holds one, a backslash is put after its first
character; where it already holds one with backslashes there, one more. Reading back takes one away, so
every text comes back as it was, and none can end its turn early. The loss mask is a list of spans of the
formatted text: each assistant's text, without its marks.

A conversation is one row, like a document: its turns are gathered by its id, in the order of the turn.

Cases: a null text or role counts as an empty one. Turns with the same number are ordered by role, then text;
repeated rows are repeated turns. Rows without a conv_id, or with one that is no number, form one conversation. Empty texts have empty spans. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's control strings, and the role names of other layouts.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
METADATA = {"id", "conv_id", "conversation_id", "source", "lang", "language", "created", "model", "category"}
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}


@dataclass(frozen=True)
class Layout:
    """Either a list of messages (its path, and in it the role's, text's and, if any, order's field), or single fields with their roles."""

    messages: tuple[str, str, str, str | None] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> list[frozenset[str]]:
        """The path sets that this layout covers."""
        if self.messages:
            at, *parts = self.messages
            return [frozenset({at, *(f"{at}[].{p}" for p in parts if p)})]
        needed = [f for f, _ in self.fields if f not in self.optional]
        return [frozenset([*needed, *extra]) for n in range(len(self.optional) + 1) for extra in combinations(self.optional, n)]


LAYOUTS = [
    Layout(messages=("turns", "role", "text", "turn")),
    Layout(messages=("messages", "role", "content", None)),
    Layout(messages=("conversations", "from", "value", None)),
    Layout(messages=("conversation", "role", "content", None)),
    Layout(fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout(fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Layout(fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Layout(fields=(("instruction", "user"), ("context", "user"), ("response", "assistant")), optional=("context",)),
    Layout(fields=(("question", "user"), ("answer", "assistant"))),
]


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(p): layout for layout in LAYOUTS for p in layout.paths()}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of all named fields; [] stands for a list's elements."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return set()
    named = {f"{at}.{f.name}" if at else f.name: f.dataType for f in kind.fields if at or f.name not in METADATA}
    return set(named).union(*(schema_paths(inner, name) for name, inner in named.items()))


def record_paths(value: object, at: str = "") -> set[str]:
    """The same for a JSON value; fields that are null are taken as missing."""
    if isinstance(value, list):
        return {p for x in value for p in record_paths(x, f"{at}[]")}
    if not isinstance(value, dict):
        return set()
    named = {f"{at}.{k}" if at else k: x for k, x in value.items() if x is not None and (at or k not in METADATA)}
    return set(named).union(*(record_paths(x, name) for name, x in named.items()))


TURNS = "array<struct<role:string,text:string>>"


def _role(c: Column, own: bool) -> Column:
    """The canonical name of a role; a layout with the canonical field names has its own."""
    if own:
        return F.coalesce(c, F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(c)), c, F.lit(""))


def canonical(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: the layout is chosen by the table's schema."""
    found = fingerprint(schema_paths(records.drop(key).schema))
    if found not in MAPPINGS:
        raise ValueError(f"no mapping for the schema {found}: {sorted(schema_paths(records.drop(key).schema))}")
    layout = MAPPINGS[found]
    if layout.messages:
        at, role, text, order = layout.messages
        one = lambda m: F.struct(_role(m[role], role == "role").alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))
        listed = F.col(at)
        if order:
            listed = F.array_sort(F.transform(listed, lambda m: F.struct(m[order].alias("o"), F.coalesce(m[role], F.lit("")).alias(role), F.coalesce(m[text], F.lit("")).alias(text))))
        return records.select(key, F.coalesce(F.transform(listed, one), F.array().cast(TURNS)).alias("turns"))
    turns = F.array(*[F.struct(F.lit(role).alias("role"), F.col(f).cast("string").alias("text")) for f, role in layout.fields if f in records.columns])
    filled = F.filter(turns, lambda t: t["text"].isNotNull())
    return records.select(key, merged(filled).alias("turns"))


def merged(turns: Column) -> Column:
    """Neighbouring turns of one role, as an instruction and its input are, become one, a blank line between them."""
    return F.aggregate(
        turns,
        F.array().cast(TURNS),
        lambda done, t: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == t["role"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(t["role"].alias("role"), F.concat(F.try_element_at(done, F.lit(-1))["text"], F.lit("\n\n"), t["text"]).alias("text")))),
        ).otherwise(F.concat(done, F.array(t))),
    )


def _text(value: object) -> str:
    """A field as text: nothing for null, JSON's spelling for numbers and truth values; half a surrogate pair becomes U+FFFD. Lists and objects are no text."""
    if value is None:
        return ""
    if isinstance(value, list | dict):
        raise ValueError("no text")
    text = value if isinstance(value, str) else json.dumps(value)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _read(record: str | None) -> tuple[str, list[tuple[str, str]]]:
    """The fingerprint and turns of one JSON record; an error if its layout is unknown or it does not keep to it."""
    value = json.loads(record or "")
    found = fingerprint(record_paths(value))
    layout = MAPPINGS.get(found)
    if layout is None or not isinstance(value, dict):
        raise ValueError("unknown layout")
    if layout.messages:
        at, role, text, order = layout.messages
        listed = value[at]
        if not isinstance(listed, list) or not all(isinstance(m, dict) for m in listed):
            raise ValueError("messages must be objects in a list")
        if order:
            places = [m.get(order) for m in listed]
            if not all(isinstance(p, int) and not isinstance(p, bool) for p in places):
                raise ValueError("every message needs a whole number for its place")
            listed = sorted(listed, key=lambda m: (m[order], _text(m.get(role)), _text(m.get(text))))
        known = {} if role == "role" else ROLES
        return found, [(known.get(_text(m.get(role)).lower(), _text(m.get(role))), _text(m.get(text))) for m in listed]
    turns: list[tuple[str, str]] = []
    for field, role in layout.fields:
        if value.get(field) is not None:
            if turns and turns[-1][0] == role:
                turns[-1] = role, f"{turns[-1][1]}\n\n{_text(value[field])}"
            else:
                turns.append((role, _text(value[field])))
    return found, turns


def record_layout(record: str | None) -> tuple[str, list[tuple[str, str]]] | None:
    """Fingerprint and canonical turns of one JSON record; None if it is no JSON, too deeply nested, of an unknown layout, or does not keep to its layout."""
    try:
        return _read(record)
    except (ValueError, RecursionError):
        return None


def record_turns(record: str | None) -> list[tuple[str, str]] | None:
    got = record_layout(record)
    return None if got is None else got[1]


def canonical_json(records: DataFrame, column: str, key: str = "conv_id") -> DataFrame:
    """key, layout (fingerprint), turns: the layout is chosen for each record."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, turns = [], []
            for r in b.column(1).to_pylist():
                got = record_layout(r)
                turns.append(None if got is None else [{"role": x, "text": t} for x, t in got[1]])
                marks.append(None if got is None else got[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.string()), pa.array(turns, kind)], [key, "layout", "turns"])

    return records.select(F.col(key), F.col(column).cast("string")).mapInArrow(run, f"`{key}` {records.schema[key].dataType.simpleString()}, layout string, turns {TURNS}")


_NAMES = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_CONTROL = re.compile(rf"([<\[])(\\*)(?={_NAMES})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_NAMES})")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans that the loss is taken on."""
    out, at, spans = [], 0, []
    for role, text in turns:
        before, after = MARKS.get(role) or (f"[ROLE]{escape(role)}[/ROLE]\n", "\n[/ROLE]")
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith("[ROLE]", at):
            end = formatted.index("[/ROLE]\n", at)
            role, before, after = unescape(formatted[at + 6 : end]), end - at + 8, "\n[/ROLE]"
        else:
            role = next(r for r in ("user", "system", "assistant") if formatted.startswith(MARKS[r][0], at))
            before, after = len(MARKS[role][0]), MARKS[role][1]
        end = formatted.index(after, at + before)
        turns.append((role, unescape(formatted[at + before : end])))
        at = end + len(after)
    return turns


def _formatted(b: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    for turns in b.column(1).to_pylist():
        yield render([(t["role"] or "", t["text"] or "") for t in turns or []])


def format_turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns to key, formatted, loss_spans (start and end, in characters)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(_formatted(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in got], pa.string()), pa.array([[{"start": x, "end": y} for x, y in s] for _, s in got], kind)], [key, "formatted", "loss_spans"])

    return conversations.select(key, "turns").mapInArrow(run, f"`{key}` {conversations.schema[key].dataType.simpleString()}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def gather(rows: DataFrame) -> DataFrame:
    """Rows of one turn each (conv_id, turn, role, text) to records with their turns in a list."""
    return rows.groupBy(F.expr("try_cast(conv_id AS bigint)").alias("conv_id")).agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))


def report(rows: DataFrame) -> DataFrame:
    """Formats, reads the output back, and digests what was read."""
    formatted = format_turns(canonical(gather(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{t}\n" for role, t in turns)
                for c, v in zip(cols, (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
