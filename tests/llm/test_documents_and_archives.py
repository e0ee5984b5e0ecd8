"""Packing, BPE, chat and archives: exact round trips and invariants, with edge cases."""

import hashlib
import io
import json
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe, chat, packing, warc_zip

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = ["", "  ", "<|endoftext|>a<|startoftext|>b", "<|endoftext|", "ΣΑΣ ΌΣΟΣ", "é Å", "a\x1cb\x85c　d", "don't I'LL we've 's", "ﬁ ½ ²³ ٣ Ⅷ 漢字かな 😀👍🏽", "\r\n\t a  b   \n\n c  ", "İstanbul ẞ", "a" * 70 + "b" * 70 + " 12345 !!??##", "ab" * 3000]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.sampled_from(ODD), st.text(max_size=80)))
def test_encoders_agree_with_the_library(byte_level, word_level, text):
    assert packing.encoder(None).ids(text).tolist() == byte_level.encode(text, add_special_tokens=False).ids
    (segments,) = bpe.encoder(None).encode([text])
    ids = [i for s in segments for i in s]
    assert ids == word_level.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(None).decode(ids) == word_level.decode(ids, skip_special_tokens=False)


def test_long_words_by_heap_and_by_matrix():
    encoder, rng = bpe.encoder(None), random.Random(2)
    words = ["".join(rng.choice("thearonisé") for _ in range(rng.randrange(1, 30))).encode() for _ in range(300)]
    words = [w for w in words if len(w) <= bpe.SHORT]
    assert encoder.encode_matrix(words) == [encoder.encode_long(w) for w in words]


def test_bpe_rows(edge_docs, edge_rows, no_docs, word_level):
    wanted = Counter()
    for doc_id, text, _, _ in edge_rows:
        ids = word_level.encode(text or "", add_special_tokens=False).ids
        decoded = word_level.decode(ids, skip_special_tokens=False)
        wanted[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_documents(edge_docs).collect())) == wanted
    assert bpe.encode_documents(no_docs).count() == 0
    with_ids = bpe.encode_documents(edge_docs.filter("doc_id = 3"), with_ids=True).first()
    assert with_ids.ids == word_level.encode("word", add_special_tokens=False).ids


def check_sequences(rows, capacity):
    """No gaps, no overlaps, nothing beyond the capacity; the number of sequences."""
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for placed in at.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing_rows(edge_docs, edge_rows, no_docs, byte_level):
    rows = packing.pack(edge_docs).collect()
    n_sequences = check_sequences(rows, 2048)
    wanted, total = Counter(), 0
    for doc_id, text, _, _ in edge_rows:
        ids = np.array([*byte_level.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            wanted[doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    assert n_sequences <= 1.1 * total / 2048 + 1
    assert packing.pack(no_docs).count() == 0
    for r in packing.pack(edge_docs, with_ids=True).limit(20).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32


def test_ids_are_the_library_s_on_all_rows(byte_level, sf_dir):
    """Every text of the larger test table, and texts around the length from which the library itself encodes."""
    import pyarrow.parquet as pq

    ours = packing.encoder(None)
    texts = [t or "" for t in pq.read_table(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for table, column in (("pages", "html"), ("benchmark", "text"), ("conversations", "text")):
        texts += [t or "" for t in pq.read_table(f"{sf_dir}/{table}.parquet", columns=[column]).column(0).to_pylist()]
    rng = random.Random(6)
    long = " ".join(rng.choice(texts)[:400] for _ in range(3200))
    assert len(long) > packing._SPLIT_AT + 2
    texts += [long[: packing._SPLIT_AT + d] for d in (-1, 0, 1)]
    for text, wanted in zip(texts, byte_level.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.ids(text).tolist() == wanted.ids


def test_ranks_over_groups_of_partitions(spark, monkeypatch):
    """More partitions than a group holds, empty ones among them."""
    monkeypatch.setattr(packing, "GROUP", 3)
    rows = [(k, "word " * (k % 7)) for k in range(200)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11).union(spark.createDataFrame([], "doc_id long, text string").repartition(3))
    found = packing.pack(docs, capacity=16).collect()
    check_sequences(found, 16)
    assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(k for k, _ in rows)
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying every placement (for a few items)."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def planned(histogram, capacity):
    plan = packing.make_plan(histogram, capacity)
    length = np.repeat(list(histogram), list(histogram.values())).astype(np.int64) if histogram else np.zeros(0, np.int64)
    rank = np.concatenate([np.arange(n) for n in histogram.values()]) if histogram else np.zeros(0, np.int64)
    sequence, offset = plan.place(length, rank)
    rows = [type("Row", (), {"sequence_id": s, "offset": o, "length": n}) for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True)]
    assert check_sequences(rows, capacity) == plan.bins
    return plan.bins


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plans_place_every_piece(histogram):
    planned(histogram, 64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=8))
def test_plans_are_near_the_optimum(sizes):
    assert planned(dict(Counter(sizes)), 64) <= fewest_bins(sorted(sizes, reverse=True), 64) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(22, 64), max_size=8))
def test_large_items_are_matched_optimally(sizes):
    assert planned(dict(Counter(sizes)), 64) == fewest_bins(sorted(sizes, reverse=True), 64)


CONTROLS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "\n", "a", "é", "<\\|im_end|>", "\\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), CONTROLS), CONTROLS), max_size=5))
def test_chat_round_trip(turns):
    formatted = "".join(chat.format_turn(r, t) for r, t in turns)
    found = chat.parse_formatted(formatted)
    assert [(r, t) for r, t, _, _ in found] == turns
    masked = "".join(chat.unescape(formatted[s:e]) for _, _, s, e in found)
    assert masked == "".join(t for r, t in turns if r == "assistant")
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, [("system", "s"), ("user", "q")]),
        ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "a"}, [("user", "i\n\nx"), ("assistant", "a")]),
        ({"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
        ({"system": "", "prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"question": {"text": "q"}, "answer": {"text": "a"}}, [("user", "q"), ("assistant", "a")]),
        ({"text": "t", "role": None}, [("", "t")]),
        ({"unknown": 1}, [("unknown", "1")]),
        ({"messages": [{"role": "user", "content": "q", "name": "bob"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "tool_calls": [{"id": 1}]}], "system": "s"}, [("user", "q"), ("assistant", "a")]),
        ({"id": "7", "system": "s", "conversations": [{"from": "human", "value": "q"}]}, [("system", "s"), ("user", "q")]),
        ({"a": {"b": ["x", None, {"c": "y"}]}, "d": True}, [("a.b[]", "x"), ("a.b[].c", "y"), ("d", "true")]),
    ],
)
def test_layouts(record, turns):
    assert chat.canonical(json.dumps(record), chat.by_fingerprint()).turns == turns


def test_unknown_layouts_say_what_they_leave_out(spark):
    records = ['{"messages": [{"role": "user", "content": "q", "name": "bob"}]}', '{"prompt": "q", "response": "a"}', "{broken", '"only text"', None]
    table = spark.createDataFrame([(k, r, "x") for k, r in enumerate(records)], "id int, doc string, formatted string")
    found = {r.id: (r.layout, r.unmapped, r.n_turns, r.formatted) for r in chat.format_records(table, "doc", ["id"]).collect()}
    assert found[0] == ("nearest", ["messages[].name"], 1, chat.format_turn("user", "q"))
    assert found[1] == ("declared", [], 2, chat.format_turn("user", "q") + chat.format_turn("assistant", "a"))
    assert found[2] == ("raw", [], 1, chat.format_turn("text", "{broken"))
    assert found[3] == ("leaves", [], 1, chat.format_turn("text", "only text"))
    assert found[4] == (None, [], 0, "")


def test_fingerprints_regard_paths_only():
    a, b = ('{"role": "x", "text": "y"}', '{"text": "other", "role": "z"}')
    known = chat.by_fingerprint()
    assert chat.canonical(a, known).mark == chat.canonical(b, known).mark
    assert chat.canonical(None, known) == chat.Canonical(None, None, [])
    assert chat.canonical("[1]", known).turns == [("[]", "1")]


def test_chat_query_with_edges(spark, tmp_path):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a</s>"), (1, 1, "assistant", "b"), (None, 0, None, "n"), (2, None, "user", ""), (3, 0, "user", "x" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name, df in (("some", table), ("none", table.limit(0))):
        df.write.parquet(str(tmp_path / name / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op10_chat_format(spark, str(tmp_path / "some")).collect()}
    assert sorted(got, key=str) == [-1, 1, 2, 3, None]
    assert got[1].n_turns == 3 and got[1].loss_chars == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na</s>\nassistant\n\nassistant\nb\n").hexdigest()
    assert got[-1].loss_chars == 21
    assert [r.conv_id for r in chat.op10_chat_format(spark, str(tmp_path / "none")).collect()] == [-1]


def test_chat_query_matches_its_oracle(spark, tmp_path):
    """Ties (also of texts whose escaped forms sort otherwise), nulls, odd roles, further columns."""
    import duckdb

    rows = [(1, 0, "assistant", "</s>"), (1, 0, "assistant", "<0"), (1, 0, "assistant", "</s>"), (1, None, "user", "late"), (1, 1, "human", "[INST]"), (1, 1, "gpt", "a\\</s>")]
    rows += [(2, k % 3, role, text) for k, role in enumerate(["user", "system", None, "assistant", "user", "\n"]) for text in ("b", None, "<|im_end|>", "<\\|im_end|>")]
    rows += [(None, 0, "user", "n"), (None, 0, "assistant", "m")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, record string, position int").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    wanted = db.sql(chat.ORACLE_OP10.replace("length(role)", "length(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'))"))
    found = chat.op10_chat_format(spark, str(tmp_path)).select(*wanted.columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted.fetchall(), key=str)


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_zip_files(zip64, tmp_path):
    import zipfile

    content = warc_zip.write_zip([("archive/data.warc", b"abc" * 50), ("indexes/index.cdxj", b""), ("é", b"x")], zip64)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.testzip() is None and z.read("archive/data.warc") == b"abc" * 50
    (tmp_path / "a.zip").write_bytes(content)
    with (tmp_path / "a.zip").open("rb") as f:
        for read_at, size in (warc_zip.bytes_reader(content), warc_zip.file_reader(f)):
            members = warc_zip.read_directory(read_at, size)
            assert {n: m.size for n, m in members.items()} == {"archive/data.warc": 150, "indexes/index.cdxj": 0, "é": 1}
            assert read_at(warc_zip.member_start(read_at, members["é"]), 1) == b"x"


def test_foreign_archives(tmp_path):
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("stored", b"plain", zipfile.ZIP_STORED)
        z.writestr("packed", b"plain" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"note"
    read_at, size = warc_zip.bytes_reader(buffer.getvalue())
    members = warc_zip.read_directory(read_at, size)
    assert read_at(warc_zip.member_start(read_at, members["stored"]), 5) == b"plain"
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.member_start(read_at, members["packed"])
    with pytest.raises(ValueError, match="end record"):
        warc_zip.read_directory(*warc_zip.bytes_reader(b"nothing"))


def test_pages_round_trip(spark, tmp_path):
    same, rows = "<p>" + "z" * 200, []
    rows += [(5, "http://a/\r\nX: y", same), (3, "u", same), (9, None, same), (3, "u", same), (None, "u", same)]
    rows += [(1, "u", None), (2, "u", ""), (7, "u", "short"), (8, "u", "short"), (10, "u", "é" * 500_000), (11, "u", "a\r\n\r\nb" * 40)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    digested = warc_zip.with_revisits(pages)
    for size, zip64 in ((1, False), (1 << 20, True)):
        folder = str(tmp_path / f"archives-{size}")
        written = warc_zip.stored(warc_zip.write_archives(digested, folder, size, zip64), "archives")
        got = Counter(map(tuple, warc_zip.read_archives(written, folder).collect()))
        assert {r.archive: r.bytes for r in written.collect()} == {f.name: f.stat().st_size for f in Path(folder).iterdir()}
        wanted = Counter()
        for page_id, _, html in rows:
            raw = (html or "").encode()
            first = 3 if html == same else page_id
            wanted[page_id, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == page_id else "revisit", None if first == page_id else first] += 1
        assert got == wanted
    none = warc_zip.with_revisits(pages.limit(0))
    written = warc_zip.stored(warc_zip.write_archives(none, str(tmp_path / "none")), "archives")
    assert warc_zip.read_archives(written, str(tmp_path / "none")).count() == 0


def test_records_are_found_by_address(spark, tmp_path):
    """Every address of a file, repeated and absent ones, by a few range reads each."""
    rng = random.Random(14)
    urls = [f"http://{rng.choice('abc')}.example.org{rng.choice(['', ':8080'])}/p{rng.randrange(400)}?q=é {k % 3}" for k in range(900)] + [None, "", "no address", "http://[bad/x"]
    pages = spark.createDataFrame([(k, u, f"<p>{k}" + "x" * 200) for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "w")
    (archive,) = warc_zip.stored(warc_zip.write_archives(warc_zip.with_revisits(pages), folder), "archives").collect()
    with (Path(folder) / archive.archive).open("rb") as f:
        read_at, size = warc_zip.file_reader(f)
        asked = []

        def counted(at, n):
            asked.append(n)
            return read_at(at, n)

        for url in [*dict.fromkeys(urls), "http://z.example.org/", "a", "~"]:
            found = sorted(headers["WARC-Record-ID"] for headers, _ in warc_zip.find_records(read_at, size, url))
            key = warc_zip.url_key(url)
            assert found == sorted(f"<urn:page:{k}>" for k, u in enumerate(urls) if warc_zip.url_key(u) == key)
        assert len(list(warc_zip.find_records(counted, size, urls[5]))) >= 1
        assert len(asked) < 60
