"""BPE encoding and decoding: contiguous rank array.

A short word is held as contiguous parts with the ranks of adjacent pairs beside them: scan for
the minimum, delete that boundary, refresh the two neighbouring ranks, repeat. Many words of
like length are worked on at once, as rows of a matrix, so each step is a few array operations.
Long words, where repeated scans would cost the square of the length, keep their pairs in a
heap instead, with the same result. Encoded words are remembered in a table of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text; texts of any
length are worked through in segments cut at white space, so memory is bounded; repeated rows
are encoded alike. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, table
from tessella.llm.packing import UNSETTLED, byte_symbols

# Fixed value: how the vocabulary's tokenizer finds words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SUFFIX = "</w>"
#: Bytes of a word that is still worked on in matrices.
SHORT = 64
SEGMENT = 1 << 20
#: Characters of text whose words are encoded together.
GROUP = 4 << 20
#: Words remembered in each Python worker.
MEMORY = 400_000
NONE = np.int32(2**31 - 1)


class WordEncoder:
    """A BPE vocabulary file with word ends: lower case, white space dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.size = max(chain(vocab.values(), special.values())) + 1
        self.tokens = [""] * self.size
        for token, k in chain(vocab.items(), special.items()):
            self.tokens[k] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.byte_of = byte_symbols()
        symbols = {b: c for c, b in self.byte_of.items()}
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[symbols[b] + SUFFIX] for b in range(256)], np.int32)
        self.ints = list(range(self.size))
        self.decimal = [str(k) for k in self.ints]
        #: Encoded words: those met lately, and those met before these.
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those that no merge joins, or with a missing side (-1), have NONE."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def encode_matrix(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words of at most SHORT bytes."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        columns = np.arange(width)
        parts = np.where(columns < sizes[:, None] - 1, self.inner[raw], np.where(columns == sizes[:, None] - 1, self.last[raw], np.int32(-1)))
        parts = np.pad(parts, ((0, 0), (0, 1)), constant_values=-1)
        ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        done: list[tuple[int, ...] | None] = [None] * len(words)
        rows = np.arange(len(words))
        ints = self.ints
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == NONE
            if ended.any():
                for row, ids in zip(rows[ended].tolist(), parts[ended].tolist(), strict=True):
                    done[row] = tuple([ints[i] for i in ids if i >= 0])
                live = ~ended
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            parts[each, at] = self.merged[best]
            moved = np.arange(parts.shape[1] - 1)
            parts[:, :-1] = np.where(moved > at[:, None], parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            kept = np.arange(ranks.shape[1] - 1)
            ranks[:, :-1] = np.where(kept >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            ranks[each, at] = self.pair_ranks(parts[each, at], parts[each, at + 1])
            before = at > 0
            ranks[each[before], at[before] - 1] = self.pair_ranks(parts[each[before], at[before] - 1], parts[each[before], at[before]])
        return done

    def encode_long(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word of any length, in n log n steps."""
        raw = np.frombuffer(word, np.uint8)
        parts = np.append(self.inner[raw[:-1]], self.last[raw[-1]])
        ranks = self.pair_ranks(parts[:-1], parts[1:]).tolist()
        parts, n = parts.tolist(), len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k, parts[k], parts[k + 1]) for k, r in enumerate(ranks) if r != NONE]
        heapq.heapify(queue)
        while queue:
            rank, k, left, right = heapq.heappop(queue)
            nxt = after[k]
            if parts[k] != left or nxt >= n or parts[nxt] != right:
                continue
            parts[k], parts[nxt] = int(self.merged[rank]), -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := self._rank(parts[a], parts[b])) != NONE:
                    heapq.heappush(queue, (r, a, parts[a], parts[b]))
        return tuple(p for p in parts if p >= 0)

    def _rank(self, left: int, right: int) -> int:
        key = left * self.size + right
        at = int(np.searchsorted(self.keys, key))
        return int(self.ranks[at]) if at < len(self.keys) and self.keys[at] == key else int(NONE)

    def learn(self, words: set[str]) -> None:
        """Encode words and remember them; those of like length are worked on together."""
        shelves: dict[int, list[str]] = {}
        for word in words:
            n = len(word.encode())
            if n > SHORT:
                self.known[word] = self.encode_long(word.encode())
            else:
                shelves.setdefault(-(-n // 4), []).append(word)
        for shelf in shelves.values():
            for k in range(0, len(shelf), 16384):
                some = shelf[k : k + 16384]
                self.known.update(zip(some, self.encode_matrix([w.encode() for w in some]), strict=True))

    def segments(self, text: str) -> Iterator[list[str] | int]:
        """The words of a text, segment by segment, or the id of a special token."""
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                yield self.special[part]
                continue
            at = 0
            while at < len(part):
                end = at + SEGMENT
                if end < len(part):
                    found = regex.search(r"\s", part, pos=end)
                    end = found.end() if found else len(part)
                yield self.words(part[at:end])
                at = end

    def words(self, segment: str) -> list[str]:
        """Normalised words of a segment. Where Unicode versions differ, the tokenizers library
        finds them, so that boundaries are the vocabulary's own."""
        if UNSETTLED.search(segment) is None:
            return WORDS.findall(lower(unicodedata.normalize("NFC", segment)))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))
        return [bytes(self.byte_of[c] for c in word).decode() for word, _ in found]

    def encode(self, texts: list[str]) -> Iterator[list[list[int]]]:
        """For each text its ids, in one or more lists."""
        held: list[list] = []
        size = 0
        for text in texts:
            if len(text) > GROUP:
                yield from self._encode(held)
                held, size = [], 0
                yield self._stream(text)
                continue
            held.append(list(self.segments(text)))
            size += len(text)
            if size > GROUP:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _stream(self, text: str) -> Iterator[list[int]]:
        for segment in self.segments(text):
            yield from next(self._encode([[segment]]))

    def _encode(self, held: list[list]) -> Iterator[list[list[int]]]:
        words = set(chain.from_iterable(s for text in held for s in text if not isinstance(s, int)))
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > MEMORY // 2:  # words that are met again move on, others are forgotten
            self.before, self.known, missing = self.known, {}, words
        again = {word: self.before[word] for word in missing.intersection(self.before)}
        self.known.update(again)
        self.learn(missing.difference(again))
        get = self.known.__getitem__
        for text in held:
            yield [[s] if isinstance(s, int) else list(chain.from_iterable(map(get, s))) for s in text]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def lower(text: str) -> str:
    """Lower case character by character (a final sigma isn't told from others)."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


@functools.cache
def encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordEncoder(path)


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (and ``ids``, an array, if asked for)."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType)]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        bpe = encoder(tokenizer)
        for batch in batches:
            counts, id_hashes, text_hashes, kept = [], [], [], []
            for segments in bpe.encode([t.as_py() or "" for t in batch.column(1)]):
                n, of_ids, of_text, every = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in segments:
                    if not ids:
                        continue
                    gap = " " if n else ""
                    of_ids.update((gap + " ".join(map(bpe.decimal.__getitem__, ids))).encode())
                    of_text.update((gap + bpe.decode(ids)).encode())
                    n += len(ids)
                    if with_ids:
                        every += ids
                counts.append(n)
                id_hashes.append(of_ids.hexdigest())
                text_hashes.append(of_text.hexdigest())
                kept.append(every)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=schema.names)

    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_word_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return encode_documents(table(spark, sf_dir, "documents"))
