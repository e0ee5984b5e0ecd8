"""Language identification: hierarchical discrimination.

Texts become frequencies of hashed byte n-grams (two to four letters, case-folded, everything
else as blanks). One-versus-rest linear support vector machines choose the language family;
within it, one machine for each pair of its languages discriminates the closely related ones.
Sigmoids turn margins into probabilities; the score is the family's times the language's.

Models are fitted on at most ``MAX_TRAIN`` texts, the same number of each language, chosen by a
hash of id and text among those with a language and with crc32 of the id modulo 4 other than 2.
Rows that repeat both count once, in the bounds of the draw too, so what reaches the driver stays
bounded and no language loses texts to its repeated rows.

Defined results: ``und`` with score 0 for a null text, one without letters, or when nothing can
be learned; with one language to learn from, that one; repeated rows are treated alike. Texts of
any length are learned from and predicted whole: that long ones are worked on in parts changes no
feature and no score. Only the id, text and language columns are read, and a prediction uses the
text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, in_training, table
from tessella.llm.linear import fit_hinge, fit_sigmoid, sigmoid
from tessella.llm.tokens import LONG, folded, text_pieces

MAX_TRAIN = 2000
BITS = 13
SCALE = 24.0
UNKNOWN = "und"

# Families of languages (ISO 639-1); any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"),
    "semitic": ("ar", "he", "am", "mt"),
}
_FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def family_of(language: str) -> str:
    return _FAMILY.get(language, language)


def grams(raw: np.ndarray, offsets: np.ndarray, starts: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashed n-gram at each byte, and whether it lies within its text (and begins
    among the first ``starts`` bytes)."""
    low = folded(raw)
    low = np.where(_LETTER[low], low, 32).astype(np.uint32)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    found = []
    code = low.copy()
    for n in (2, 3, 4):
        whole = max(0, len(low) - n + 1)
        code[:whole] = (code[:whole] << 8) | low[n - 1 :]
        hashed = ((code ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        inside = np.arange(n, len(low) + n) <= ends
        if starts is not None:
            inside[starts:] = False
        found.append((hashed, inside))
    return found


def parts(raw: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, bytes where n-grams begin) to work on at once: all of them, or parts of one
    long text. A part begins with a character and reaches over its end as far as its n-grams do, so
    each n-gram counts once."""
    if len(offsets) != 2 or len(raw) <= LONG:
        yield raw, offsets, None
        return
    first = 0
    while first < len(raw):
        last = min(first + LONG, len(raw))
        while last < len(raw) and raw[last] & 0xC0 == 0x80:
            last += 1
        part = raw[first : last + 3]
        yield part, np.array([0, len(part)]), last - first
        first = last


def sparse_rows(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers and values of each text's features."""
    n, found = len(offsets) - 1, []
    for part, own, starts in parts(raw, offsets):
        doc = np.repeat(np.arange(n), np.diff(own))
        found.append(np.unique(np.concatenate([doc[inside] << BITS | g[inside] for g, inside in grams(part, own, starts)]), return_counts=True))
    unique, at = np.unique(np.concatenate([u for u, _ in found]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([c for _, c in found]), minlength=len(unique))
    values = SCALE * counts / np.maximum(1, np.diff(offsets))[unique >> BITS]
    cuts = np.searchsorted(unique >> BITS, np.arange(1, n))
    return list(zip(np.split(unique & ((1 << BITS) - 1), cuts), np.split(values, cuts), strict=True))


#: Weights are served as whole multiples of 1 / UNIT, so sums don't depend on their order.
UNIT = 1 << 24


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def sums(self, hashed, offsets: np.ndarray) -> np.ndarray:
        """Sum of each text's n-gram weights, in units."""
        total = np.zeros(len(offsets) - 1, np.int64)
        for g, inside in hashed:
            running = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.weights[g] * inside)])
            total += running[offsets[1:]] - running[offsets[:-1]]
        return total

    def probability(self, total: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margins = SCALE * (total / UNIT) / np.maximum(1, np.diff(offsets)) + self.bias
        return sigmoid(self.slope * margins + self.offset)


def fit_machine(rows: list, positive: np.ndarray) -> Machine:
    n1, n = int(positive.sum()), len(positive)
    cost = np.where(positive, n / (2 * n1), n / (2 * (n - n1)))
    fitted = fit_hinge([r[0] for r in rows], [r[1] for r in rows], np.where(positive, 1.0, -1.0), 1 << BITS, cost, epochs=20)
    margins = np.array([fitted[:-1][r] @ v for r, v in rows]) + fitted[-1]
    slope, offset = fit_sigmoid(margins, positive.astype(np.int64))
    return Machine(np.rint(fitted[:-1] * UNIT).astype(np.int64), float(fitted[-1]), slope, offset)


@dataclass
class Model:
    languages: list[str]
    families: list[str] = field(default_factory=list)
    of_family: dict[str, Machine] = field(default_factory=dict)
    of_pair: dict[tuple[str, str], Machine] = field(default_factory=dict)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text, and score."""
        n, machines = len(offsets) - 1, {**self.of_family, **self.of_pair}
        total = {key: np.zeros(n, np.int64) for key in machines}
        for part, own, starts in parts(raw, offsets):
            hashed = grams(part, own, starts)
            for key, machine in machines.items():
                total[key] += machine.sums(hashed, own)
        families = np.ones((n, len(self.families)))
        for k, name in enumerate(self.families):
            if name in self.of_family:
                families[:, k] = self.of_family[name].probability(total[name], offsets)
        if len(self.families) == 2 and self.of_family:
            families[:, 1] = 1 - families[:, 0]
        families /= np.maximum(families.sum(axis=1, keepdims=True), 1e-12)
        chosen, best = families.argmax(axis=1), families.max(axis=1)
        votes = np.zeros((n, len(self.languages)))
        index = {language: k for k, language in enumerate(self.languages)}
        for k, name in enumerate(self.families):
            members = [x for x in self.languages if family_of(x) == name]
            mine = chosen == k
            if len(members) == 1:
                votes[mine, index[members[0]]] = 1.0
            for a, b in combinations(members, 2):
                p = self.of_pair[a, b].probability(total[a, b], offsets)
                votes[mine, index[a]] += p[mine] / (len(members) - 1)
                votes[mine, index[b]] += (1 - p[mine]) / (len(members) - 1)
        return votes.argmax(axis=1), np.clip(best * votes.max(axis=1), 0.0, 1.0)


def fit(rows: list, languages: list[str]) -> Model:
    known = sorted(set(languages))
    model = Model(known, sorted({family_of(x) for x in known}))
    of = np.array([family_of(x) for x in languages])
    if len(model.families) > 1:
        for name in model.families[: 1 if len(model.families) == 2 else None]:
            model.of_family[name] = fit_machine(rows, of == name)
    for name in model.families:
        for a, b in combinations([x for x in known if family_of(x) == name], 2):
            pair = [k for k, x in enumerate(languages) if x in (a, b)]
            model.of_pair[a, b] = fit_machine([rows[k] for k in pair], np.array([languages[k] == a for k in pair]))
    return model


def train(documents: DataFrame, most: int = MAX_TRAIN) -> Model | None:
    """A model from a bounded, balanced sample of the documents outside the held-out fold."""
    bounded_batches(documents.sparkSession)
    usable = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training()).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.col("text").cast("string")).bitwiseAND(F.lit(2**63 - 1)).alias("order"), F.col("text").cast("string").alias("text")
    )
    known = usable.groupBy("lang", "order").agg(F.count(F.lit(1)).alias("rows"))  # the bounds are on distinct texts, as is what's drawn
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return None
    each = max(1, most // len(counts))
    wanted = F.lit(False)
    for lang, n in sorted(counts.items()):
        bound = min(2**63 - 1, int(2**63 * min(1.0, 1.2 * each / n + 8 / n)))
        wanted = wanted | ((F.col("lang") == lang) & (F.col("order") <= F.lit(bound)))

    def run(batches):
        for batch in batches:
            numbers, values = [], []
            for _, _, raw, offsets in text_pieces(batch.column(2)):
                for number, value in sparse_rows(raw, offsets):
                    numbers.append(number.astype("<u2").tobytes())
                    values.append(value.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.binary()), pa.array(values, pa.binary())], names=["lang", "order", "numbers", "values"])

    each_row = usable.filter(wanted).mapInArrow(run, "lang string, order long, numbers binary, values binary")
    distinct = each_row.groupBy("lang", "order").agg(F.min(F.struct("numbers", "values")).alias("least"))  # however often id and text are repeated
    found = sorted(distinct.select("lang", "order", "least.*").collect(), key=lambda r: (r.lang, r.order))
    used: dict[str, int] = {}
    rows, languages = [], []
    for r in found:
        used[r.lang] = used.get(r.lang, 0) + 1
        if used[r.lang] <= each and r.numbers:
            rows.append((np.frombuffer(r.numbers, "<u2").astype(np.int64), np.frombuffer(r.values, "<f4").astype(np.float64)))
            languages.append(r.lang)
    return fit(rows, languages) if rows else None


def identified(documents: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, ``lang_pred`` and ``score``."""
    bounded_batches(documents.sparkSession)
    source = documents.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType(list(source.schema.fields[:-1])).add("lang_pred", "string").add("score", "double")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for first, last, raw, offsets in text_pieces(batch.column(len(keep))):
                low = folded(raw)
                plain = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
                letters = plain[offsets[1:]] > plain[offsets[:-1]]
                for k in np.flatnonzero(~letters).tolist():
                    letters[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode())
                if model is None:
                    letters[:] = False
                else:
                    index, score = model.predict(raw, offsets)
                names += [model.languages[i] if ok else UNKNOWN for i, ok in zip(index.tolist(), letters.tolist(), strict=True)] if model else [UNKNOWN] * (last - first)
                scores.append(np.where(letters, score, 0.0) if model else np.zeros(last - first))
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(found)], names=schema.names)

    return source.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    documents = table(spark, sf_dir, "documents")
    found = identified(documents, train(documents), ["doc_id"])
    return found.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score")
