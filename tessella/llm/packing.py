"""Best-fit packing: large-item matching.

Documents are tokenised where they lie and cut into pieces of at most ``capacity`` tokens. The
plan depends only on how many pieces there are of each length, so it is made from a histogram
of at most ``capacity`` numbers, whatever the corpus size: pieces above a third of the capacity
are matched greedily (the longest with the longest that fits it, at most two a bin), then
smaller lengths, in falling order, go best-fit into the remaining gaps. The plan treats runs of
equal bins at once; its size depends on the capacity alone, so it may be broadcast. A piece's
rank among those of its length picks its bin; ranks come from one array of counts a partition,
summed up within groups of ``GROUP`` partitions in parallel and over the groups on the driver
(``capacity`` numbers a group), so no length, however frequent, meets in one task. Pieces meet
their partition's sums in a shuffled join of narrow rows; nothing that grows is broadcast but the
groups' sums, 8 * ``capacity`` bytes for each ``GROUP`` partitions.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows
and null ids are packed like any others; an empty table gives no pieces. Only the id and text
columns are read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, stored, table

CAPACITY = 2048
END_ID = 0

# Fixed value: how the vocabulary's byte-level tokenizer splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Finds a character outside those whose classes all Unicode versions agree on; such texts go to the tokenizers library.
UNSETTLED = re.compile(r"[^\t-\r\x20-ɏͰ-ϿЀ-ӿ‐-‧‰-›€]")
_SPLIT_AT = 1 << 20
#: Partitions whose counts are summed up together.
GROUP = 512


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevelEncoder:
    """Ids of a byte-level BPE vocabulary file (as the tokenizers library gives them).

    The file's vocabulary is loaded as ranks into tiktoken, which is several times faster; texts
    with characters outside settled ranges are encoded by tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def ids(self, text: str) -> np.ndarray:
        if UNSETTLED.search(text) is None and len(text) <= _SPLIT_AT:
            return np.asarray(self.fast.encode(text, allowed_special=self.special), np.uint32)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(path: str | None) -> ByteLevelEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return ByteLevelEncoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str | None, with_ids: bool) -> DataFrame:
    """Pieces with the partition they came from and their rank there among pieces of their length;
    and one further row a partition, with ``counts`` of its pieces by length (null in the others)."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("pid", T.IntegerType()),
            T.StructField("local", T.LongType()),
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            *([T.StructField("ids", T.BinaryType())] if with_ids else []),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        encode, pid = encoder(tokenizer).ids, TaskContext.get().partitionId()
        counts, kind = np.zeros(capacity + 1, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            owner, rows = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + length].tobytes()
                    owner.append(k)
                    rows.append((pid, int(counts[length]), number, start, length, zlib.crc32(raw), raw if with_ids else None))
                    counts[length] += 1
            if not rows:
                continue
            pid_, local, number, start, length, crc, raw = zip(*rows, strict=True)
            columns = [pa.array(pid_, pa.int32()), pa.array(local, pa.int64()), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []) + [pa.nulls(len(rows), pa.list_(pa.int64()))], names=schema.names)
        if counts.any():
            empty = [pa.nulls(1, t) for t in (pa.int64(), kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else []))]
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), *empty, pa.array([counts.tolist()], pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def prefix_sums(counts: DataFrame, capacity: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(pid, before) with the pieces of each length in partitions before it in its group; what
    stands before each group; and the whole histogram."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid")
        each = np.array(rows.counts.tolist(), np.int64).reshape(-1, capacity + 1)
        upto = each.cumsum(axis=0)
        found = pd.DataFrame({"pid": rows.pid.to_numpy(), "before": list(upto - each)})
        return pd.concat([found, pd.DataFrame({"pid": [-1 - int(rows.pid.iloc[0]) // GROUP], "before": [upto[-1]]})])

    grouped = counts.withColumn("group", F.floor(F.col("pid") / GROUP)).groupBy("group").applyInPandas(run, "pid int, before array<long>")
    sums = stored(grouped, "sums")
    totals = {-1 - r.pid: r.before for r in sums.filter("pid < 0").collect()}  # a row for each GROUP partitions
    groups = np.zeros((max(totals, default=-1) + 2, capacity + 1), np.int64)
    for group, total in totals.items():
        groups[group + 1] = total
    upto = groups.cumsum(axis=0)
    return sums.filter("pid >= 0"), upto[:-1], upto[-1]


@dataclass
class Plan:
    """For runs of pieces of one length, from rank ``first`` on: the bin of the first, and the offset there."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) | rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    left = {s: n for s, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    found: list[tuple[int, int, int, int]] = []
    bins = 0

    def put(size: int, count: int, sequence: int, offset: int) -> None:
        found.append((size, used[size], sequence, offset))
        used[size] += count
        left[size] -= count

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        for partner in (p for p in large if p <= min(size, capacity - size)):
            count = left[size] // 2 if partner == size else min(left[size], left[partner])
            if count:
                put(size, count, bins, 0)
                put(partner, count, bins, size)
                gaps[capacity - size - partner].append((bins, count))
                bins += count
        if count := left[size]:
            put(size, count, bins, 0)
            gaps[capacity - size].append((bins, count))
            bins += count
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        gap = size
        while left[size]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // size
                gaps[capacity].append((bins, -(-left[size] // each)))
                bins += -(-left[size] // each)
                gap = capacity
            start, count = gaps[gap].pop()
            each = gap // size
            full = min(count, left[size] // each)
            for k in range(each if full else 0):
                put(size, full, start, capacity - gap + k * size)
            if full:
                gaps[gap - each * size].append((start, full))
            if full < count:
                if rest := left[size]:
                    for k in range(rest):
                        put(size, 1, start + full, capacity - gap + k * size)
                    gaps[gap - rest * size].append((start + full, 1))
                    full += 1
                if full < count:
                    gaps[gap].append((start + full, count - full))
    found.sort()
    size, first, sequence, offset = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
    return Plan((size << 44) | first, first, sequence, offset, bins)


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``,
    little-endian 32-bit, if asked for). ``tokenizer`` is a vocabulary file on the executors."""
    bounded_batches(documents.sparkSession)
    cuts = stored(pieces(documents, id_col, text_col, capacity, tokenizer, with_ids), "pieces")
    sums, groups, whole = prefix_sums(cuts.filter("counts IS NOT NULL").select("pid", "counts"), capacity)
    histogram = {length: int(n) for length, n in enumerate(whole) if n}
    context = documents.sparkSession.sparkContext
    plan, before = context.broadcast(make_plan(histogram, capacity)), context.broadcast(groups)
    ranked = cuts.filter("piece IS NOT NULL").drop("counts").join(sums.hint("merge"), "pid").select(
        "id", "piece", "start", "length", "ids_crc32", "pid", (F.get("before", F.col("length").cast("int")) + F.col("local")).alias("rank"), *(["ids"] if with_ids else [])
    )
    schema = T.StructType([f for f in ranked.schema if f.name not in {"rank", "pid", "ids"}]).add("sequence_id", "long").add("offset", "long")
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        for batch in batches:
            length, rank, pid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank", "pid"))
            sequence, offset = plan.value.place(length, before.value[pid // GROUP, length] + rank)
            columns = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset), *([batch.column("ids")] if with_ids else [])], names=schema.names)

    return ranked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
