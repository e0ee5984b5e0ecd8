"""Exact dedup: Golomb-coded fingerprint exchange.

1. Every partition fingerprints its texts (48 bits of SHA-256 of the normalised UTF-8 bytes),
   sorts the distinct fingerprints, cuts them by owner (a range of fingerprints) and sends each
   owner the Golomb-coded (Rice form) gaps.
2. An owner decodes the lists and answers each partition with a bitmap: which of its
   fingerprints another partition has too.
3. Each partition marks its suspects (bitmap, or repeated within the partition).
4. Only suspects' texts are shuffled, grouped by their normalised bytes themselves, with
   partial aggregation on the map side: a text of many copies costs each task one row.

Fingerprints are collected nowhere; an owner holds its range only, and there are as many owners as
keep their parts to about ``OWNED`` rows. Step 1 is written as a table
in the shared folder, so partitions and their fingerprints stay as they were when executors go.

Defined results: a null text counts as empty; empty texts are equal to each other; ties on
length go to the smallest id, null ids last; rows that repeat an id and a text form one group,
and each row with the kept id is kept (as in ``ORACLE_OP2``); of a group without any id, one row
is kept, the first of the longest. An empty table gives no rows. Only the id and text
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, broadcast_if_small, byte_slices, reducers, stored, table

#: Fixed value: the characters that normalising deletes.
WHITE = b" \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]+"
BITS = 48
#: Fingerprints that an owner is meant to hold.
OWNED = 2_000_000
_CONTINUATION = bytes(range(0x80, 0xC0))


def golomb_encode(values: np.ndarray, base: int) -> bytes:
    """Sorted distinct values from ``base`` on as gaps: quotients in unary, then remainders of k bits."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(base))
    k = max(0, int(np.log2(max(1.0, 0.69 * float(gaps.mean())))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, ::-1]) & np.uint64(1)).astype(np.uint8)
    first = np.packbits(unary).tobytes()
    return struct.pack("<IBI", len(values), k, len(first)) + first + np.packbits(rest.ravel()).tobytes()


def golomb_decode(blob: bytes, base: int) -> np.ndarray:
    n, k, size = struct.unpack_from("<IBI", blob)
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, size, 9))
    ends = np.flatnonzero(unary == 0)[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    rest = np.unpackbits(np.frombuffer(blob, np.uint8, offset=9 + size))[: n * k].reshape(n, k)
    remainders = np.zeros(n, np.uint64)
    for column in range(k):
        remainders = (remainders << np.uint64(1)) | rest[:, column].astype(np.uint64)
    return np.cumsum((quotients << np.uint64(k)) | remainders) + np.uint64(base)


def owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    """Which of ``owners`` equal ranges each fingerprint falls into."""
    return (prints // np.uint64(owner_width(owners))).astype(np.int64)


def owner_width(owners: int) -> int:
    return -(-(1 << BITS) // owners)


def fingerprints(digests: bytes) -> np.ndarray:
    wide = np.zeros((len(digests) // 32, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(digests, np.uint8).reshape(-1, 32)[:, :6]
    return wide.view(">u8").ravel().astype(np.uint64)


def _segments(distinct: np.ndarray, owners: int):
    """(owner, start, end) of the runs of sorted distinct fingerprints."""
    of = owner_of(distinct, owners)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(of[s]), int(s), int(e)) for s, e in zip(starts, [*starts[1:], len(distinct)], strict=True)]


def _send(docs: DataFrame, owners: int) -> DataFrame:
    """Rows of kind 0 (a document's number, id, digest and length) and kind 1 (a list for an owner)."""
    schema = T.StructType(
        [
            T.StructField("kind", T.IntegerType()),
            T.StructField("pid", T.IntegerType()),
            T.StructField("uid", T.LongType()),
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("sha", T.StringType()),
            T.StructField("n_points", T.LongType()),
            T.StructField("owner", T.IntegerType()),
            T.StructField("blob", T.BinaryType()),
        ]
    )

    def run(batches):
        pid, seen = TaskContext.get().partitionId(), []
        uid = pid << 40
        for batch in batches:
            texts, n = batch.column(1), batch.num_rows
            digests, points, hexes = [], [], []
            for raw in byte_slices(texts):
                found = hashlib.sha256(raw.translate(None, WHITE))
                digests.append(found.digest())
                hexes.append(found.hexdigest())
                points.append(len(raw.translate(None, _CONTINUATION)))
            seen.append(fingerprints(b"".join(digests)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.array(np.arange(uid, uid + n)), batch.column(0), pa.array(hexes, pa.string()), pa.array(points, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=schema.names,
            )
            uid += n
        if seen:
            distinct = np.unique(np.concatenate(seen))
            lists = [(o, golomb_encode(distinct[s:e], o * owner_width(owners))) for o, s, e in _segments(distinct, owners)]
            n = len(lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, batch.schema.field(0).type), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array([o for o, _ in lists], pa.int32()), pa.array([b for _, b in lists], pa.binary())],
                names=schema.names,
            )

    return docs.select("id", "text").mapInArrow(run, schema)


def _answer(owners: int):
    def run(lists: pd.DataFrame) -> pd.DataFrame:
        base = int(lists.owner.iloc[0]) * owner_width(owners)
        found = [golomb_decode(b, base) for b in lists.blob]
        every = np.sort(np.concatenate(found))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        bitmaps = [np.packbits(np.isin(f, shared, assume_unique=True)).tobytes() for f in found]
        return pd.DataFrame({"pid": lists.pid, "owner": lists.owner, "bitmap": bitmaps})

    return run


def _receive(owners: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        prints = fingerprints(bytes.fromhex("".join(docs.sha)))
        distinct, at, counts = np.unique(prints, return_inverse=True, return_counts=True)
        marked, bitmaps = counts > 1, dict(zip(answers.owner, answers.bitmap, strict=True))
        for owner, start, end in _segments(distinct, owners):
            marked[start:end] |= np.unpackbits(np.frombuffer(bitmaps[owner], np.uint8))[: end - start].astype(bool)
        return docs.loc[marked[at], ["id"]]

    return run


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    owners = max(reducers(documents.sparkSession), -(-docs.count() // OWNED))
    sent = stored(_send(docs, owners), "fingerprints")
    narrow = sent.filter("kind = 0").select("pid", "uid", "id", "sha", "n_points")
    lists = sent.filter("kind = 1").select("pid", "owner", "blob")
    answers = lists.groupBy("owner").applyInPandas(_answer(owners), "pid int, owner int, bitmap binary")
    kind = T.StructType([T.StructField("id", docs.schema["id"].dataType)])
    suspects = stored(narrow.drop("uid").groupBy("pid").cogroup(answers.groupBy("pid")).applyInPandas(_receive(owners), kind).distinct(), "suspects")
    wanted = broadcast_if_small(suspects.withColumnRenamed("id", "wanted"))
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    order = F.struct((-F.char_length(F.coalesce("text", F.lit("")))).alias("longest"), F.col("id").isNull().alias("absent"), F.col("id").alias("id"))
    verified = (
        texts.select(F.regexp_replace(F.coalesce("text", F.lit("")), WHITE_CLASS, "").alias("bytes"), order.alias("rank"))
        .groupBy("bytes")
        .agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2(F.col("bytes").cast("binary"), 256).alias("sha"), F.col("first.id").alias("first_id"), F.col("group_size"))
    )
    absent = narrow.filter("id IS NULL").groupBy("sha").agg(F.min(F.struct((-F.col("n_points")).alias("longest"), "uid")).alias("absent")).select("sha", F.col("absent.uid").alias("first_uid"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("first_id"))
    other = F.col("group_size").isNotNull() & F.col("id").isNull() & (F.col("uid") != F.col("first_uid"))
    return (
        narrow.join(verified.join(absent, "sha", "left"), "sha", "left")
        .select(F.col("id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("id").eqNullSafe(keep) & ~F.coalesce(other, F.lit(False))).alias("kept"), F.col("sha").alias("text_sha256"))
        .withColumnRenamed("id", id_col)
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, each with the one of its equals that stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_OP2 = """
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS bytes FROM documents
)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY bytes) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, sha256(bytes) AS text_sha256
FROM n
WINDOW g AS (PARTITION BY bytes ORDER BY length(text) DESC, doc_id NULLS LAST)
"""
