"""Chat formatting: schema fingerprinting.

A record (JSON text) is reduced to the sorted set of its nested field paths; the hash of that
set selects a declarative mapping, which turns the record's layout into canonical turns. A
template then marks each turn and escapes control strings inside the texts reversibly.

A record whose fingerprint no mapping has keeps its text too: it takes the mapping with the most
paths among those whose paths it has all (``nearest``; its other paths are named in ``unmapped``),
or else gives a turn for each of its leaves, with the leaf's path as the role (``leaves``); what is
no JSON becomes one turn ``text`` (``raw``).

Defined results: a null record gives no turns and a null fingerprint; null or missing texts and
roles are empty; equal rows are all kept; turns with the same position are ordered by role, then
text, and turns without a position come last; a null conversation id is one conversation. Extra
columns are ignored, whatever their names; very long texts are formatted whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, reducers, table

# Control strings of common chat templates, which texts must not contain raw.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

START, END = "<|im_start|>", "<|im_end|>"
_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_RAW = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])(\\*)\\({_TAILS})")


def escape(text: str) -> str:
    """Put one backslash more after the first character of each control string."""
    return _RAW.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves; list positions are written ``[]``."""
    if isinstance(value, dict):
        inner = [field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [field_paths(v, f"{at}[]") for v in value]
    else:
        return {at}
    return set().union(*inner) if inner else {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    Either ``each`` names a list and ``role``/``text`` are fields of its items, or ``turns``
    lists pairs of a literal role (``=user``) or a role field, and the fields joined to its text.
    """

    paths: tuple[str, ...]
    each: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def apply(self, record: dict) -> list[tuple[str, str]]:
        rename = dict(self.roles)
        if self.each is not None:
            rows = [(_at(x, self.role), _at(x, self.text)) for x in record.get(self.each) or []]
        else:
            rows = []
            for role, fields in self.turns:
                parts = [p for f in fields if (p := _at(record, f))]
                if parts or not role.startswith("=system"):
                    rows.append((role[1:] if role.startswith("=") else _at(record, role), "\n\n".join(parts)))
        return [(rename.get(r, r), t) for r, t in rows]


def _at(record: object, path: str) -> str:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return "" if record is None else record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)


_SHARE = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping(("role", "text"), turns=(("role", ("text",)),)),
    Mapping(("role", "content"), turns=(("role", ("content",)),)),
    Mapping(("messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Mapping(("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=_SHARE),
    Mapping(("system", "conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=_SHARE),
    Mapping(("prompt", "completion"), turns=(("=user", ("prompt",)), ("=assistant", ("completion",)))),
    Mapping(("prompt", "response"), turns=(("=user", ("prompt",)), ("=assistant", ("response",)))),
    Mapping(("system", "prompt", "response"), turns=(("=system", ("system",)), ("=user", ("prompt",)), ("=assistant", ("response",)))),
    Mapping(("instruction", "output"), turns=(("=user", ("instruction",)), ("=assistant", ("output",)))),
    Mapping(("instruction", "input", "output"), turns=(("=user", ("instruction", "input")), ("=assistant", ("output",)))),
    Mapping(("question.text", "answer.text"), turns=(("=user", ("question.text",)), ("=assistant", ("answer.text",)))),
)


def by_fingerprint(mappings: Iterable[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(m.paths): m for m in mappings}


def leaves(value: object, at: str = "") -> Iterator[tuple[str, str]]:
    """Path and text of each leaf that isn't null, in the record's order."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from leaves(v, f"{at}[]")
    elif value is not None:
        yield at or "text", value if isinstance(value, str) else json.dumps(value)


@dataclass(frozen=True)
class Canonical:
    """A record's fingerprint, how its layout was found, its turns, and the paths they leave out."""

    mark: str | None
    layout: str | None
    turns: list[tuple[str, str]]
    unmapped: tuple[str, ...] = ()


def canonical(record: str | None, known: dict[str, Mapping]) -> Canonical:
    if record is None:
        return Canonical(None, None, [])
    try:
        value = json.loads(record)
    except (ValueError, RecursionError):
        return Canonical(fingerprint(["(no JSON)"]), "raw", [("text", record)])
    paths = field_paths(value)
    mark = fingerprint(paths)
    mapping, layout = known.get(mark), "declared"
    if mapping is None:
        fitting = [m for m in known.values() if isinstance(value, dict) and paths.issuperset(m.paths)]
        if not fitting:
            return Canonical(mark, "leaves", list(leaves(value)))
        mapping, layout = max(fitting, key=lambda m: len(m.paths)), "nearest"
    turns = mapping.apply(value)
    if mapping.each and "system" in mapping.paths and (system := _at(value, "system")):
        turns.insert(0, ("system", system))
    return Canonical(mark, layout, turns, tuple(sorted(paths.difference(mapping.paths))))


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def parse_formatted(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the start and end of the text under the loss mask (equal unless the
    turn is the assistant's) of each turn of a formatted string."""
    found = []
    for m in _TURN.finditer(formatted):
        role = unescape_role(m[1])
        start, end = m.span(2)
        found.append((role, unescape(m[2]), start, end if role == "assistant" else start))
    return found


def _canonical_batches(keys: int, mappings: tuple[Mapping, ...], batches) -> Iterator[tuple[pa.RecordBatch, list[Canonical]]]:
    known = by_fingerprint(mappings)
    for batch in batches:
        yield batch, [canonical(value, known) for value in batch.column(keys).to_pylist()]


def format_records(records: DataFrame, record: str, keys: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The ``keys`` columns of each row, its ``fingerprint``, ``layout`` (declared, nearest, leaves
    or raw), the paths left ``unmapped``, ``n_turns`` and the ``formatted`` turns.

    ``record`` holds JSON text of any layout.
    """
    bounded_batches(records.sparkSession)
    source = records.select(*[F.col(k) for k in keys], F.col(record).alias("__record"))
    schema = T.StructType(list(source.schema.fields[:-1])).add("fingerprint", "string").add("layout", "string")
    schema = schema.add("unmapped", T.ArrayType(T.StringType())).add("n_turns", "integer").add("formatted", "string")

    def run(batches):
        for batch, found in _canonical_batches(len(keys), mappings, batches):
            marks, layouts = ([getattr(c, name) for c in found] for name in ("mark", "layout"))
            texts = ["".join(format_turn(r, t) for r, t in c.turns) for c in found]
            columns = [pa.array(marks, pa.string()), pa.array(layouts, pa.string()), pa.array([list(c.unmapped) for c in found], pa.list_(pa.string()))]
            columns += [pa.array([len(c.turns) for c in found], pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def canonical_turns(records: DataFrame, record: str, keys: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """A row for each turn of each record: the ``keys`` columns, ``fingerprint``, ``position`` in
    the record, ``role`` and ``text``."""
    bounded_batches(records.sparkSession)
    source = records.select(*[F.col(k) for k in keys], F.col(record).alias("__record"))
    schema = T.StructType(list(source.schema.fields[:-1])).add("fingerprint", "string").add("position", "integer").add("role", "string").add("text", "string")

    def run(batches):
        for batch, found in _canonical_batches(len(keys), mappings, batches):
            rows = [(k, c.mark, at, role, text) for k, c in enumerate(found) for at, (role, text) in enumerate(c.turns)]
            if rows:
                of, *columns = zip(*rows, strict=True)
                kept = [c.take(pa.array(of, pa.int64())) for c in batch.columns[: len(keys)]]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=schema.names)

    return source.mapInArrow(run, schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Conversation:
    """Running digests of a conversation that is read back turn by turn; memory doesn't grow."""

    def __init__(self, key):
        self.key, self.turns, self.loss, self.chars = key, 0, 0, 0
        self.all_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, start, end in parse_formatted(formatted):
            self.turns += 1
            self.all_hash.update(f"{role}\n{text}\n".encode())
            if end > start:
                masked = unescape(formatted[start:end])
                self.loss += len(masked)
                self.loss_hash.update(masked.encode())

    def row(self) -> tuple:
        return self.key, self.turns, self.all_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Format the turns (conv_id, role, text; conversations together and in order within
    partitions) and read them back."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def flush(rows):
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in DIGEST.split(", ")])

        for batch in batches:
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(key)
                now.add(format_turn(role, text))
            if len(done) >= 4096:
                yield flush(done)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield flush(done)

    return turns.select("conv_id", "role", "text").mapInArrow(run, DIGEST)


def in_layouts(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as JSON records of four layouts, by a hash of the turn's place."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    speaker = F.when(role == "user", F.lit("human")).when(role == "assistant", F.lit("gpt"))
    plain = F.struct(role.alias("role"), text.alias("text"))
    content = F.struct(role.alias("role"), text.alias("content"))
    messages = F.struct(F.array(content).alias("messages"))
    shared = F.struct(F.array(F.struct(speaker.alias("from"), text.alias("value"))).alias("conversations"))
    layout = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    record = F.when(layout == 0, F.to_json(plain)).when(layout == 1, F.to_json(content)).when((layout == 2) | speaker.isNull(), F.to_json(messages)).otherwise(F.to_json(shared))
    return rows.select("conv_id", "turn", record.alias("record"))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back (one row each).

    The rows come as records of four layouts, which their fingerprints turn into canonical turns
    where they lie; only then are turns brought together by conversation and sorted (spilling), so
    no task holds a conversation in memory.
    """
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    turns = canonical_turns(in_layouts(rows.unionByName(extra)), "record", ["conv_id", "turn"])
    ordered = turns.repartition(reducers(spark), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
    return digest_conversations(ordered)


ORACLE_OP10 = """
WITH x AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *,
    regexp_replace(text, '([<\\[])(\\\\*)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)', '\\1\\2\\\\\\3', 'g') AS escaped
  FROM x
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(escaped) + 10 + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
