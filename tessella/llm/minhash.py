"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles (five words, folded as in :mod:`tessella.llm.tokens`) are
   counted over the whole corpus in two hashed tables of fixed size; the lesser counter, less its
   table's background (the median), stands. Copies and near copies shouldn't make their own
   shingles look common, so texts count by families: texts with the same least shingle, in one of
   a few orders, share one count (family sizes come from tables of the same kind). A shingle's weight is its frequency in
   the text times ln(1 + families / document frequency).
2. Texts with the same words (128 bits of BLAKE2 over them) are one node. Every node gets
   ``BANDS * ROWS`` samples by improved consistent weighted sampling; equal samples of a whole
   band make two nodes candidates.
3. Candidates are first linked to the least node of their bucket only, and the components of
   those links, found without any pair list, are cut in sorted order into blocks of at most
   ``BLOCK_NODES`` nodes. A task compares the candidates within a block by exact weighted Jaccard
   similarity and joins linked nodes.
4. Components of several blocks hold a tournament: the blocks' class roots meet in new blocks
   until they hardly shrink. Buckets that then still hold several classes are worked through
   block against block: signatures first, then the texts of those that may be linked, so no link
   between candidates is lost.

Nothing that grows with the corpus is collected or broadcast unmeasured: the tables have a fixed
size. Frequencies below a table's noise (which grows with the root of the corpus) weigh alike.

Defined results: a text without words is a class of its own; texts under five words have one
shingle, of all their words; null ids never name a class unless all of its ids are null;
repeated rows are in one class. One row of each class is kept, the first of those with its id.
An empty table gives no rows. Only the id and text are read. Texts of any length are compared
whole; characters of scripts without spaces are words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, broadcast_if_small, reducers, stored, table
from tessella.llm.components import connected_components
from tessella.llm.tokens import mix, text_digests, text_pieces, windows, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: Samples (compared by one byte) that candidates must share before their texts are compared;
#: at the threshold a pair falls below with a probability of about 1 in 20,000.
AGREE = 33

#: Counters of a table: 2 ** DF_BITS; they travel in DF_BLOCKS parts.
DF_TABLES, DF_BITS, DF_BLOCKS, DF_SHARDS = 2, 20, 16, 16

#: Orders in which texts' least shingles make families.
FAMILIES = 3

#: Bounds of a block: nodes, and words (but for a longer text).
BLOCK_NODES, BLOCK_WORDS = 500, 1_000_000
#: Nodes of a block of which signatures alone are compared.
SIGNED_NODES = 2000
#: A tournament goes on while each round leaves at most this share of the roots.
SHRINK = 0.8

_random = np.random.default_rng(20100)
_U = _random.random((5, 1 << 16)) * (1 - 2e-7) + 1e-7
_R = (-np.log(_U[0] * _U[1])).astype(np.float32)
_LNC = np.log(-np.log(_U[2] * _U[3])).astype(np.float32)
_BETA = _U[4].astype(np.float32)
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FIRST, _SECOND = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xDA942042E4DD58B5)


def shingles(raw: np.ndarray, offsets: np.ndarray):
    """The words, and document, hash and count of each document's distinct shingles (sorted)."""
    found = words(raw, offsets, punctuation=False)
    doc, value = windows(found, SHINGLE)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if not len(doc):
        return found, doc, value, np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return found, doc[at], value[at], np.diff(np.append(at, len(doc)))


def samples(doc: np.ndarray, value: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples, one row for each document that has shingles."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.empty((len(starts), SAMPLES), np.uint64)
    place = np.arange(len(doc), dtype=np.int64)
    for j in range(SAMPLES):
        x = value * _FACTORS[j]
        r = _R[x >> np.uint64(48)]
        beta = _BETA[(x >> np.uint64(32)) & np.uint64(0xFFFF)]
        t = np.floor(log_weight / r + beta)
        a = _LNC[(x >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta + np.float32(1))
        bits = a.view(np.int32)
        ordered = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)
        least = np.minimum.reduceat((ordered << 32) | place, starts) & 0xFFFFFFFF
        out[:, j] = mix(value[least] + (t[least].astype(np.int64).astype(np.uint64) + np.uint64(j << 20)) * _SECOND)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(found), BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(len(found), band + 1, np.uint64)
        for row in range(ROWS):
            total = mix(total * _FIRST + found[:, band * ROWS + row])
        keys[:, band] = total
    return keys.view(np.int64)


def _slots(value: np.ndarray) -> list[np.ndarray]:
    """The counter of each hash in each table."""
    shift = np.uint64(64 - DF_BITS)
    return [((value * _FACTORS[k]) >> shift).astype(np.int64) for k in range(DF_TABLES)]


class Counts:
    """How often hashed keys occur, from tables of fixed size; never less than ``least``, the noise."""

    def __init__(self, tables: np.ndarray, total: float):
        background = np.array([np.median(t) for t in tables])
        self.total = total
        self.least = max(1.0, 4.0 * float(np.sqrt(background.max())))
        self.found = np.empty(tables.shape, np.float32)
        for found, table, ground in zip(self.found, tables, background, strict=True):
            np.maximum(table - ground, self.least, out=found, casting="same_kind")

    def of(self, value: np.ndarray) -> np.ndarray:
        slots = _slots(value)
        found = self.found[0][slots[0]]
        for k in range(1, DF_TABLES):
            found = np.minimum(found, self.found[k][slots[k]])
        return found


class Weights:
    """Inverse document frequencies of hashed shingles, as shares of the rarest ones' weight."""

    def __init__(self, counts: Counts):
        n = max(1.0, counts.total)
        self.log = np.log(np.log1p(n / counts.found) / np.log1p(n / counts.least)).astype(np.float32)

    def log_weights(self, value: np.ndarray, count: np.ndarray) -> np.ndarray:
        slots = _slots(value)
        idf = self.log[0][slots[0]]
        for k in range(1, DF_TABLES):
            idf = np.maximum(idf, self.log[k][slots[k]])
        return idf + np.log(count).astype(np.float32)


def count_hashed(docs: DataFrame, keys: Callable) -> Counts:
    """Counters of the hashes and weights that ``keys(bytes, offsets)`` gives for all texts."""
    size = (1 << DF_BITS) // DF_BLOCKS

    def count(batches):
        counters = np.zeros((DF_TABLES, 1 << DF_BITS))
        total = 0.0
        for batch in batches:
            for _, _, raw, offsets in text_pieces(batch.column(0)):
                value, weight, n = keys(raw, offsets)
                total += n
                for table, slot in zip(counters, _slots(value), strict=True):
                    table += np.bincount(slot, weights=weight, minlength=1 << DF_BITS)
        shard = TaskContext.get().partitionId() % DF_SHARDS
        parts = [(t * DF_BLOCKS + k, p) for t in range(DF_TABLES) for k in range(DF_BLOCKS) if (p := counters[t, k * size : (k + 1) * size]).any()]
        numbers, blobs = [k for k, _ in parts] + [-1], [_packed(p) for _, p in parts] + [_packed(np.append(total, np.zeros(size - 1)))]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([shard] * len(numbers), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "shard", "counts"])

    def add(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for number, shard, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _add_packed(totals.setdefault((number, shard), np.zeros(size)), blob)
        for (number, shard), total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([shard], pa.int32()), pa.array([_packed(total)], pa.binary())], names=["block", "shard", "counts"])

    kind, n = "block int, shard int, counts binary", reducers(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, kind).repartition(n, "block", "shard").mapInArrow(add, kind)
    whole = parts.withColumn("shard", F.lit(0)).repartition(min(n, DF_TABLES * DF_BLOCKS), "block").mapInArrow(add, kind)
    tables, total = np.zeros((DF_TABLES, 1 << DF_BITS)), 0.0
    for row in whole.collect():  # DF_TABLES * DF_BLOCKS + 1 rows of fixed size
        if row.block < 0:
            _add_packed(last := np.zeros(size), row.counts)
            total = float(last[0])
        else:
            table, k = divmod(row.block, DF_BLOCKS)
            _add_packed(tables[table, k * size : (k + 1) * size], row.counts)
    return Counts(tables, total)


def _packed(values: np.ndarray) -> bytes:
    """Counters as places and values, or as values alone where that is shorter."""
    at = np.flatnonzero(values)
    if 10 * len(at) < 8 * len(values):
        return b"\1" + at.astype("<u2").tobytes() + values[at].astype("<f8").tobytes()
    return b"\0" + values.astype("<f8").tobytes()


def _add_packed(total: np.ndarray, blob: bytes) -> None:
    if blob[0]:
        n = (len(blob) - 1) // 10
        total[np.frombuffer(blob, "<u2", n, 1)] += np.frombuffer(blob, "<f8", n, 1 + 2 * n)
    else:
        total += np.frombuffer(blob, "<f8", -1, 1)


def family_keys(n: int, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of n texts have shingles, and a row for each with its least shingle in each of FAMILIES orders."""
    texts = np.unique(doc)
    found = np.empty((len(texts), FAMILIES), np.uint64)
    for k in range(FAMILIES):
        least = np.full(n, np.iinfo(np.uint64).max)
        np.minimum.at(least, doc, value * _FACTORS[-1 - k])
        found[:, k] = mix(least[texts] + np.uint64(k))
    return texts, found


def families(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The families of the texts that have words, each counting one."""
    texts, found = family_keys(len(offsets) - 1, *windows(words(raw, offsets, punctuation=False), SHINGLE))
    return found.ravel(), np.ones(found.size), len(texts)


def document_frequencies(docs: DataFrame) -> Weights:
    """In how many families of texts each shingle stands, over all documents."""
    sizes = docs.sparkSession.sparkContext.broadcast(count_hashed(docs, families))

    def keys(raw, offsets):
        _, doc, value, _ = shingles(raw, offsets)
        texts, found = family_keys(len(offsets) - 1, doc, value)
        size = np.max([sizes.value.of(found[:, k]) for k in range(FAMILIES)], axis=0)
        share = np.minimum(1.0, sizes.value.least / size.astype(np.float64))  # sizes within the noise count as one
        return value, np.repeat(share, np.bincount(doc, minlength=len(offsets) - 1)[texts]), share.sum()

    found = Weights(count_hashed(docs, keys))
    sizes.destroy()  # the counts are here; no task needs the sizes again
    return found


def _signatures(docs: DataFrame, weights) -> DataFrame:
    """One row per document: uid, id, hashes of its words, number of words, band keys and one
    byte of each sample (null without words)."""
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("id", docs.schema["id"].dataType)])
    schema = schema.add("t1", "long").add("t2", "long").add("n_words", "long").add("bands", "binary").add("bytes", "binary")

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for first, last, raw, offsets in text_pieces(batch.column(1)):
                found, doc, value, count = shingles(raw, offsets)
                t1, t2 = text_digests(found).T
                n_words = np.bincount(found.doc, minlength=last - first)
                bands: list = [None] * (last - first)
                short: list = [None] * (last - first)
                if len(doc):
                    drawn = samples(doc, value, weights.value.log_weights(value, count))
                    keys, low = band_keys(drawn), (drawn & np.uint64(0xFF)).astype(np.uint8)
                    for k, d in enumerate(np.unique(doc).tolist()):
                        bands[d], short[d] = keys[k].tobytes(), low[k].tobytes()
                for column, values in zip(rows, (t1.tolist(), t2.tolist(), n_words.tolist(), bands, short), strict=True):
                    column += values
            n = batch.num_rows
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), batch.column(0), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names=schema.names)
            uid += n

    return docs.mapInArrow(run, schema)


def _bucket_links(nodes: DataFrame) -> DataFrame:
    """(u, v): each node of a bucket of several, and the bucket's least node."""

    def run(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys)], names=["node", "bucket"])

    members = nodes.select("node", "bands").mapInArrow(run, "node long, bucket long")
    least = members.groupBy("bucket").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(least, "bucket").select(F.col("node").alias("u"), "v")


def _runs(batches, n_keys: int):
    """(key, table) for each run of rows with equal first ``n_keys`` columns."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_keys)], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(keys[start].tolist())
            if key != last and held:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


class _Texts:
    """Weighted shingles and signatures of the texts of a block (a table with node, bands, bytes, text)."""

    def __init__(self, rows: pa.Table, weights: Weights):
        self.node = rows.column("node").to_numpy()
        n = len(self.node)
        self.value: list = [np.zeros(0, np.uint64)] * n
        self.weight: list = [np.zeros(0)] * n
        for first, _, raw, offsets in text_pieces(rows.column("text")):
            _, doc, value, count = shingles(raw, offsets)
            weight = np.exp(weights.log_weights(value, count).astype(np.float64))
            cuts = np.searchsorted(doc, np.arange(1, len(offsets) - 1))
            for k, (v, w) in enumerate(zip(np.split(value, cuts), np.split(weight, cuts), strict=True)):
                self.value[first + k], self.weight[first + k] = v, w
        self.total = np.array([w.sum() for w in self.weight])
        self.bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.int64).reshape(n, BANDS)
        self.bytes = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(n, SAMPLES)

    def candidates(self, k: int, other: _Texts, upto: int | None = None) -> np.ndarray:
        """Which texts of ``other`` (the first ``upto``) may be linked to text k."""
        shared = (other.bands[:upto] == self.bands[k]).any(axis=1)
        agree = (other.bytes[:upto] == self.bytes[k]).sum(axis=1) >= AGREE
        return np.flatnonzero(shared & agree)

    def linked(self, k: int, other: _Texts, m: int, threshold: float) -> bool:
        """Weighted Jaccard similarity of at least ``threshold``."""
        small, large = sorted((self.total[k], other.total[m]))
        if small < threshold * large:
            return False
        a, b = self.value[k], other.value[m]
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        same = b[at] == a
        both = np.minimum(self.weight[k][same], other.weight[m][at[same]]).sum()
        return both >= threshold * (small + large - both) - 1e-9


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _link_blocks(rows: DataFrame, weights, threshold: float) -> DataFrame:
    """(comp, node, root) of rows (comp, block, node, bands, bytes, text): links within blocks."""

    def run(batches):
        for _, block in _runs(batches, 1):
            texts = _Texts(block, weights.value)
            parent = list(range(len(texts.node)))
            for k in range(1, len(parent)):
                for m in texts.candidates(k, texts, k).tolist():
                    a, b = _find(parent, k), _find(parent, m)
                    if a != b and texts.linked(k, texts, m, threshold):
                        parent[max(a, b)] = min(a, b)
            least: dict[int, int] = {}
            roots = [_find(parent, k) for k in range(len(parent))]
            for k, root in enumerate(roots):
                least[root] = min(least.get(root, texts.node[k]), texts.node[k])
            found = pa.array([least[r] for r in roots], pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("comp").combine_chunks(), pa.array(texts.node), found], names=["comp", "node", "root"])

    dealt = _dealt(rows, ["block"], ["block", "comp", "node", "bands", "bytes", "text"])
    return dealt.mapInArrow(run, "comp long, node long, root long")


def _dealt(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.select(*columns).repartition(reducers(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members (comp, node, n_words, ...) with their ``block``: a run of the sorted rows of one
    component, in one range partition, that keeps the bounds."""
    names = members.columns
    schema = T.StructType(list(members.schema.fields)).add("block", "long")

    def run(batches):
        block = (TaskContext.get().partitionId() << 40) - 1
        last, nodes, held = None, 0, 0
        for batch in batches:
            found = []
            for comp, n in zip(batch.column(names.index("comp")).to_pylist(), batch.column(names.index("n_words")).to_pylist(), strict=True):
                if comp != last or nodes == BLOCK_NODES or held + n > BLOCK_WORDS:
                    block, last, nodes, held = block + 1, comp, 0, 0
                nodes, held = nodes + 1, held + n
                found.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, "block"])

    placed = members.repartitionByRange(reducers(members.sparkSession), "comp", "node").sortWithinPartitions("comp", "node")
    return placed.mapInArrow(run, schema)


def _classes(nodes: DataFrame, docs: DataFrame, weights, threshold: float) -> DataFrame:
    """(node, root) of all nodes that stand in a bucket with others."""
    labels = connected_components(_bucket_links(nodes))
    columns = [F.col("label").alias("comp"), "node", "n_words", "first_id", "t1", "t2", "bands", "bytes"]
    placed = stored(_in_blocks(labels.join(nodes, "node").select(*columns)), "members")
    wanted = stored(placed.select(F.col("first_id").alias("wanted")).distinct(), "wanted")
    texts = docs.join(broadcast_if_small(wanted), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    keyed = _keyed(texts).dropDuplicates(["t1", "t2"])
    full = stored(placed.drop("first_id").join(keyed, ["t1", "t2"]).drop("t1", "t2"), "texts")
    roots = stored(_link_blocks(full, weights, threshold), "roots")
    several = placed.groupBy("comp").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a <> b").select("comp")
    several = stored(several, "several")
    if several.isEmpty():
        return roots.select("node", "root")
    several = broadcast_if_small(several)
    heads, before, links = roots.filter("node = root").join(several, "comp", "left_semi"), None, None
    while True:
        counted = heads.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        total = counted.agg(F.sum("n")).first()[0] or 0
        if not total or (before and total > SHRINK * before):
            break
        before = total
        open_heads = heads.join(counted.select("comp"), "comp", "left_semi").select("comp", "node")
        again = stored(_in_blocks(open_heads.join(full.select("node", "n_words"), "node").select("comp", "node", "n_words")), "heads")
        met = stored(_link_blocks(again.join(full.select("node", "bands", "bytes", "text"), "node"), weights, threshold), "met")
        pairs = met.select(F.col("node").alias("u"), F.col("root").alias("v")).filter("u <> v")
        links = pairs if links is None else links.union(pairs)
        open_comps = again.groupBy("comp").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a <> b").select("comp")
        heads = met.filter("node = root").join(open_comps, "comp", "left_semi")
    roots = stored(_joined(roots, links), "roots")
    across = _across(full.join(several, "comp", "left_semi"), roots, weights, threshold)
    return (_joined(roots, across) if across is not None else roots).select("node", "root")


def _joined(roots: DataFrame, links: DataFrame | None) -> DataFrame:
    """Roots after classes with links between their roots have become one."""
    if links is None:
        return roots
    merged = connected_components(links)
    return roots.join(merged.withColumnRenamed("node", "root"), "root", "left").select("comp", "node", F.coalesce("label", "root").alias("root"))


_PAIR = ["bucket", "left_block", "block"]


def _across(full: DataFrame, roots: DataFrame, weights, threshold: float) -> DataFrame | None:
    """Links between classes, from the buckets that hold several: in each, what is outside its
    largest class is compared, block against block, with every node of another class."""
    rooted = stored(full.select("node", "n_words", "bands", "bytes").join(roots.select("node", "root"), "node"), "rooted")
    members = stored(_band_members(rooted), "buckets")
    counted = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    split = counted.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    blocks = F.ceil((F.col("all") - F.col("most.n")) / SIGNED_NODES).alias("left_blocks"), F.ceil(F.col("all") / SIGNED_NODES).alias("blocks")
    split = stored(split.select("bucket", F.col("most.root").alias("main"), *blocks), "split")
    if split.isEmpty():
        return None
    rows = members.join(broadcast_if_small(split), "bucket").withColumn("outside", F.col("root") != F.col("main"))
    left = rows.filter("outside").withColumn("left_block", F.pmod(F.xxhash64("node", F.lit(-1)), "left_blocks"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    right = rows.withColumn("left_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_blocks") - 1)))
    right = right.withColumn("block", F.pmod(F.xxhash64("node", F.lit(-2)), "blocks")).withColumn("side", F.lit(1))
    columns = [*_PAIR, "side", "node"]
    narrow = left.select(*columns, "band", "root", "outside").union(right.select(*columns, "band", "root", "outside"))
    signed = narrow.join(rooted.drop("root"), "node")
    survivors = stored(_survivors(signed), "survivors")
    with_texts = survivors.join(full.select("node", "bands", "bytes", "text"), "node")
    return stored(_link_across(with_texts, weights, threshold), "across")


def _band_members(rooted: DataFrame) -> DataFrame:
    """(bucket, band, node, root): a row for each band of each node."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            node, root = (np.repeat(batch.column(k).to_numpy(), BANDS) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(node), pa.array(root)], names=["bucket", "band", "node", "root"])

    return rooted.select("node", "bands", "root").mapInArrow(run, "bucket long, band int, node long, root long")


class _Side:
    """Signatures of one side of a pair of blocks."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.node, self.root = (rows.column(c).to_numpy() for c in ("node", "root"))
        self.outside = rows.column("outside").to_numpy(zero_copy_only=False)
        self.bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
        self.bytes = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, SAMPLES)


def _open_pairs(left: _Side, right: _Side, band: int):
    """(k, places of the right side): pairs of different classes that may be linked, each in the
    first band they share and, if both are outside the largest class, from the lesser node."""
    for k in range(len(left.node)):
        agree = (right.bytes == left.bytes[k]).sum(axis=1) >= AGREE
        fresh = ~(right.bands[:, :band] == left.bands[k, :band]).any(axis=1)
        once = ~right.outside | (left.node[k] < right.node)
        found = np.flatnonzero(agree & fresh & once & (right.root != left.root[k]))
        if len(found):
            yield k, found


def _sides(batches):
    for key, block in _runs(batches, 3):
        side = block.column("side").to_numpy()
        left, right = (block.filter(pa.array(side == k)) for k in (0, 1))
        if left.num_rows and right.num_rows:
            yield key, block.column("band")[0].as_py(), _Side(left), _Side(right)


def _text_blocks(n_words: np.ndarray) -> np.ndarray:
    """A block for each of some texts, in order, by the bounds of BLOCK_NODES and BLOCK_WORDS."""
    found, nodes, held = [0] * len(n_words), 0, 0
    for k, n in enumerate(n_words.tolist()):
        new = nodes == BLOCK_NODES or nodes and held + n > BLOCK_WORDS
        nodes, held = (1, n) if new else (nodes + 1, held + n)
        found[k] = (found[k - 1] if k else 0) + bool(new)
    return np.array(found, np.int64)


def _survivors(rows: DataFrame) -> DataFrame:
    """For each pair of blocks of texts whose signatures leave a possible link, the nodes with one."""
    kept = ["side", "node", "band", "root", "outside"]

    def run(batches):
        for (bucket, left_block, right_block), band, left, right in _sides(batches):
            pairs = list(_open_pairs(left, right, band))
            if not pairs:
                continue
            k, m = np.repeat([k for k, _ in pairs], [len(f) for _, f in pairs]), np.concatenate([f for _, f in pairs])
            (some, k_at), (others, m_at) = (np.unique(x, return_inverse=True) for x in (k, m))
            of_k = _text_blocks(left.rows.column("n_words").to_numpy()[some])[k_at]
            of_m = _text_blocks(right.rows.column("n_words").to_numpy()[others])[m_at]
            for x, y in np.unique(np.stack([of_k, of_m]), axis=1).T.tolist():
                own = (of_k == x) & (of_m == y)
                for side, nodes in ((left, k[own]), (right, m[own])):
                    taken = side.rows.select(kept).take(pa.array(np.unique(nodes))).combine_chunks()
                    key = [pa.array(np.full(taken.num_rows, v, np.int64)) for v in (bucket, left_block << 20 | x, right_block << 20 | y)]
                    yield pa.RecordBatch.from_arrays([*key, *[taken.column(c).combine_chunks() for c in kept]], names=[*_PAIR, *kept])

    kind = "bucket long, left_block long, block long, side int, node long, band int, root long, outside boolean"
    return _dealt(rows, _PAIR, [*_PAIR, *kept, "n_words", "bands", "bytes"]).mapInArrow(run, kind)


def _link_across(rows: DataFrame, weights, threshold: float) -> DataFrame:
    """(u, v): roots of classes with a link between a text of the left and one of the right side."""

    def run(batches):
        for _, band, left, right in _sides(batches):
            a, b = _Texts(left.rows, weights.value), _Texts(right.rows, weights.value)
            of_a, of_b = left.root.tolist(), right.root.tolist()
            names = {root: k for k, root in enumerate(sorted({*of_a, *of_b}))}
            parent = list(range(len(names)))
            links = []
            for k, found in _open_pairs(left, right, band):
                for m in found.tolist():
                    x, y = _find(parent, names[of_a[k]]), _find(parent, names[of_b[m]])
                    if x != y and a.linked(k, b, m, threshold):
                        parent[max(x, y)] = min(x, y)
                        links.append((of_a[k], of_b[m]))
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    columns = [*_PAIR, "side", "node", "band", "root", "outside", "bands", "bytes", "text"]
    return _dealt(rows, _PAIR, columns).mapInArrow(run, "u long, v long")


def _keyed(docs: DataFrame) -> DataFrame:
    """(t1, t2, text) of texts that have words."""

    def run(batches):
        for batch in batches:
            keys = [text_digests(words(raw, offsets, punctuation=False)) for _, _, raw, offsets in text_pieces(batch.column(0))]
            t1, t2 = np.concatenate(keys).T if keys else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t1)), pa.array(np.ascontiguousarray(t2)), batch.column(0)], names=["t1", "t2", "text"])

    return docs.select("text").mapInArrow(run, "t1 long, t2 long, text string")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``class_id`` (the class's least id), ``class_size`` and ``kept``
    (true for one row of each class)."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    weights = documents.sparkSession.sparkContext.broadcast(document_frequencies(docs))
    signed = stored(_signatures(docs, weights), "signatures")
    order = F.struct(F.col("id").isNull().alias("absent"), F.col("id").alias("id"))
    groups = signed.filter("bands IS NOT NULL").groupBy("t1", "t2")
    nodes = stored(groups.agg(F.min("uid").alias("node"), F.min(order).alias("o"), F.max("n_words").alias("n_words"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")).withColumn("first_id", F.col("o.id")).drop("o"), "nodes")
    classes = stored(_classes(nodes, docs, weights, threshold), "classes")
    of_text = nodes.select("t1", "t2", "node").join(classes, "node", "left").select("t1", "t2", F.coalesce("root", "node").alias("root"))
    placed = signed.select("uid", "id", "t1", "t2", F.col("bands").isNotNull().alias("full")).join(of_text.withColumn("full", F.lit(True)), ["t1", "t2", "full"], "left")
    placed = placed.select("uid", "id", F.coalesce("root", "uid").alias("root"))
    summed = placed.groupBy("root").agg(F.min(F.struct(order.alias("o"), "uid")).alias("least"), F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    several = stored(summed.select("root", F.col("least.o.id").alias("first_id"), F.col("least.uid").alias("first_uid"), "class_size"), "sizes")
    joined = placed.join(several, "root", "left")  # a plain shuffled join, whose hot classes adaptive execution splits
    class_id = F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("first_id"))
    return joined.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (F.col("uid") == F.coalesce("first_uid", "uid")).alias("kept"))


def op8_minhash_icws(spark, sf_dir: str) -> DataFrame:
    """All documents with their class of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
