"""PII: anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs, digits and
identifier cues. From each anchor a deterministic local parser expands to the left and right and
validates what it found. Kinds of the base rules are email, ip, card and phone; the parsers of
schemes and cues add url, iban, account and secret (keys and tokens that are assigned to a name).
Cues count in lower case, upper case and with one capital.

Defined results: a null or empty text has no spans; spans of one kind don't overlap, those of
different kinds may; offsets are code points, ends exclusive; repeated rows are treated alike;
texts of any length are parsed in one pass. Only the id and text columns are read, and redacting
touches the text (and its length column) alone.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")
#: Kinds that redacting replaces: an address of a public page isn't personal.
REDACTED = ("email", "ip", "card", "phone", "iban", "account", "secret")

# The characters and shapes of the base rules.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_IBAN = re.compile(r"[:\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?:\x20[A-Z0-9])?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|nummer|num))?\.?[:#\x20]{1,3}([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])")

#: What is assigned to a secret's name: from 16 characters on, with a letter and a digit.
_SECRET = re.compile(r"[\"']?\x20{0,2}[:=]{1,2}\x20{0,2}[\"']?((?=[A-Za-z0-9_./+=-]*[A-Za-z])(?=[A-Za-z0-9_./+=-]*[0-9])[A-Za-z0-9_./+=-]{16,})")

IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key")
_CUED = {"iban": (IBAN_CUES, _IBAN), "account": (ACCOUNT_CUES, _ACCOUNT), "secret": (SECRET_CUES, _SECRET)}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Anchors; each gives its parser's name and its own length."""
    found = ahocorasick.Automaton()
    anchors = {"@": "at", "://": "scheme", "+": "plus"} | dict.fromkeys("0123456789", "digit")
    anchors |= {form: kind for kind, (cues, _) in _CUED.items() for cue in cues for form in (cue, cue.capitalize(), cue.upper())}
    for anchor, parser in anchors.items():
        found.add_word(anchor, (parser, len(anchor)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    doubled = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def valid_iban(value: str) -> bool:
    compact = value.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _addresses(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Four digit runs with single dots between; a failing match is dropped whole."""
    found, k = [], 0
    while k + 3 < len(runs):
        four = runs[k : k + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(_small(text[s:e]) for s, e in four):
                found.append((four[0][0], four[3][1]))
            k += 4
        else:
            k += 1
    return found


def _cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chains of digit runs with single spaces or hyphens between, of 16 to 19 digits."""
    found, k = [], 0
    while k < len(runs):
        first, n = k, runs[k][1] - runs[k][0]
        while k + 1 < len(runs) and runs[k + 1][0] == runs[k][1] + 1 and text[runs[k][1]] in " -":
            k += 1
            n += runs[k][1] - runs[k][0]
        if 16 <= n <= 19 and luhn("".join(text[s:e] for s, e in runs[first : k + 1])):
            found.append((runs[first][0], runs[k][1]))
        k += 1
    return found


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order of their start."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    runs: list[tuple[int, int]] = []
    run_end = email_end = url_end = cue_end = 0
    for last, (parser, size) in automaton().iter(text):
        at = last - size + 1
        if parser == "digit":
            if at >= run_end:
                run_end = _DIGITS.match(text, at).end()
                runs.append((at, run_end))
        elif parser == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                spans["email"].append((start, m.end()))
                email_end = m.end()
        elif parser == "plus":
            if m := _PHONE.match(text, at):
                if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    spans["phone"].append(m.span())
        elif parser == "scheme":
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            m = _URL_REST.match(text, last + 1) if start < at else None  # within a URL, nothing is matched again
            if m and (rest := m.group().rstrip(".,;:!?)*")):
                url_end = m.start() + len(rest)
                spans["url"].append((start, url_end))
        elif at >= cue_end and (at == 0 or not text[at - 1].isalnum()):
            m = _CUED[parser][1].match(text, last + 1)
            value = m[1] if m else ""
            while parser == "iban" and value and not valid_iban(value):
                value = value.rpartition(" ")[0]  # what follows the number may look like its groups
            if value:
                cue_end = m.start(1) + len(value)
                spans[parser].append((m.start(1), cue_end))
    spans["ip"], spans["card"] = _addresses(text, runs), _cards(text, runs)
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in kinds for s, e in spans[kind])


def redact(text: str, kinds: tuple[str, ...] = REDACTED) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    found = find_spans(text)
    spans = sorted((s, -e, kind) for kind in kinds for s, e in found[kind])
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, ``base_sha256`` of the base spans and ``spans``, all spans."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType)])
    for kind in BASE_KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches):
        for batch in batches:
            found = [find_spans(t.as_py() or "") for t in batch.column(1)]
            counts = [pa.array([len(f[kind]) for f in found], pa.int64()) for kind in BASE_KINDS]
            digests = [hashlib.sha256(joined(f, BASE_KINDS).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(f, KINDS) for f in found], pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redacted(documents: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All columns and rows, with the text redacted (null stays null) and its length column brought up to date."""
    bounded_batches(documents.sparkSession)
    schema = documents.schema
    at = schema.names.index(text_col)
    length_at = schema.names.index(length_col) if length_col in schema.names else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = [None if (t := x.as_py()) is None else redact(t) for x in columns[at]]
            columns[at] = pa.array(texts, columns[at].type)
            if length_at is not None:
                columns[length_at] = pa.array([None if t is None else len(t) for t in texts], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(run, schema)


def op4_pii_anchors(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(table(spark, sf_dir, "documents"))
