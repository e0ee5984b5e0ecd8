"""Near duplicates against brute force, hot groups, components, and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import exact_dedup, minhash, packing, pii, quality, registry
from tessella.llm.components import connected_components


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        base = [f"t{rng.randrange(3000)}" for _ in range(rng.randrange(200, 400))]
        texts += [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 60]))) for _ in range(rng.randrange(1, 6))]
    texts += [None, "", " . ", "one two", "One, two!", "one two three", "x" * 100_000]
    return list(enumerate(texts))


#: Characters that are words of their own, and runs of letters and digits.
TOKEN = re.compile("[\u3040-\u30ff\u4e00-\u9fff]|[0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")


def shingle_counts(text):
    found = TOKEN.findall((text or "").lower())
    return Counter(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else Counter()


def jaccard(a, b, weight):
    both = sum(min(n, b[s]) * weight[s] for s, n in a.items() if s in b)
    every = sum(n * weight[s] for x in (a, b) for s, n in x.items()) - both
    return both / every if every else 0.0


def _root(parent, k):
    while parent[k] != k:
        k = parent[k]
    return k


def joined(n, links):
    parent = list(range(n))
    for a, b in links:
        x, y = sorted((_root(parent, a), _root(parent, b)))
        parent[y] = x
    return [_root(parent, k) for k in range(n)]


def brute_classes(rows):
    """Classes by exact TF-IDF Jaccard similarity of all pairs; none of the operator's functions. A
    family is a set of texts of plain similarity from 0.6 on, and counts once for each shingle."""
    counts = [shingle_counts(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if counts[a] and counts[b] and not counts[a].keys().isdisjoint(counts[b])]
    one = Counter(dict.fromkeys((s for c in counts for s in c), 1))
    family = joined(len(rows), [p for p in near if jaccard(counts[p[0]], counts[p[1]], one) >= 0.6])
    n = len({f for f, c in zip(family, counts, strict=True) if c})
    frequency = Counter(s for _, s in {(f, s) for f, c in zip(family, counts, strict=True) for s in c})
    weight = {s: math.log1p(n / f) for s, f in frequency.items()}
    found = {p: jaccard(counts[p[0]], counts[p[1]], weight) for p in near}
    wide, tight = (joined(len(rows), [p for p, v in found.items() if v >= minhash.THRESHOLD + d]) for d in (-0.03, 0.03))
    return {rows[k][0]: rows[wide[k]][0] for k in range(len(rows)) if all(tight[m] == tight[k] for m in range(len(rows)) if wide[m] == wide[k])}


def check(spark, rows):
    """Equal classes, but for those that a threshold 0.03 lower or higher would change (families differ a little)."""
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    wanted = brute_classes(rows)
    assert len(found) == len(rows) and len(wanted) >= 0.8 * len(rows)
    assert {r.doc_id: r.class_id for r in found if r.doc_id in wanted} == wanted
    sizes = Counter(r.class_id for r in found)
    for r in found:
        assert r.kept == (r.doc_id == r.class_id)
        assert r.class_size == sizes[r.class_id]


def test_classes_match_brute_force(spark, near_rows):
    check(spark, near_rows)


def test_blocks_and_tournaments_lose_no_link(spark, near_rows, monkeypatch):
    """Blocks of a few nodes, so that each group needs a tournament and the block-wise rest."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", 2)
    monkeypatch.setattr(minhash, "SIGNED_NODES", 7)
    rng = random.Random(5)
    base = [f"h{k}" for k in range(400)]
    hot = [(1000 + k, " ".join(edited(rng, base, 2 + k % 3))) for k in range(40)]
    check(spark, near_rows[:80] + hot)


def test_frequent_passages_weigh_less(spark):
    """Texts that share a long passage with all others: near by plain similarity, not by TF-IDF."""
    rng = random.Random(31)
    passage = [f"p{k}" for k in range(400)]
    rows = [(k, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(50)])) for k in range(200)]
    counts = [shingle_counts(t) for _, t in rows[:2]]
    assert jaccard(*counts, Counter(dict.fromkeys(counts[0] | counts[1], 1))) >= 0.78
    rows += [(1000 + k, " ".join(f"r{rng.randrange(10**6)}" for _ in range(60))) for k in range(100)]
    rows += [(2000, rows[-1][1] + " more"), (2001, rows[0][1])]
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(found.values())) < len(rows) and found[2000] == 1099 and found[2001] == found[0]


def test_scripts_without_spaces(spark):
    """One changed character in a long text, full-width punctuation, and another text."""
    rng = random.Random(32)
    base = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600))
    rows = [(1, base), (2, base[:300] + "\u9fa0" + base[301:]), (3, base[:100] + "\u3002" + base[100:]), (4, base[::-1])]
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def test_long_words_that_differ_by_a_swap(spark):
    """Two bytes, 65,536 apart, exchanged."""
    word = "a" + "b" * 65_545 + "c"
    other = word[65_536] + word[1:65_536] + word[0] + word[65_537:]
    found = minhash.near_duplicates(spark.createDataFrame([(1, word), (2, other), (3, word + "!")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {1: 1, 2: 2, 3: 1}


def test_planted_pairs_of_the_table(spark, sf_dir):
    """All pairs of plain similarity from 0.8 on, over all documents of the larger test table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect()]
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    counts = {k: shingle_counts(t) for k, t in rows}
    holding = {}
    for k, c in counts.items():
        for s in c:
            holding.setdefault(s, []).append(k)
    near = {(a, b) for ids in holding.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in near if 2 * len(counts[a].keys() & counts[b].keys()) > len(counts[a]) and jaccard(counts[a], counts[b], Counter(dict.fromkeys(counts[a] | counts[b], 1))) >= 0.8]
    assert len(links) >= 80
    assert sum(found[a] == found[b] for a, b in links) >= 0.97 * len(links)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    found = minhash.near_duplicates(edge_docs).collect()
    assert len(found) == len(edge_rows)
    assert {r.class_size for r in found if r.doc_id in (0, 1, 2)} == {1}
    assert minhash.near_duplicates(no_docs).count() == 0


def test_samples_meet_at_the_similarity():
    rng = np.random.default_rng(3)
    value = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    weight = np.log(rng.choice([0.75, 0.9, 1.0, 2.0], 400)).astype(np.float32)
    a, b = slice(0, 340), slice(60, 400)
    drawn = [minhash.samples(np.zeros(340, np.int64), value[s], weight[s])[0] for s in (a, b)]
    w = np.exp(weight)
    true = w[60:340].sum() / w.sum()
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.2


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    got = {r.node: r.label for r in found.collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs = before = spark.read.parquet(f"{big}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, docs, big), name)
        assert now.columns == before.columns and now.dtypes == before.dtypes
        if name == "pii":
            assert now.count() == docs.count()
        else:
            assert now.exceptAll(docs).isEmpty()
        docs = now
    labels = spark.read.parquet(f"{big}/labels.parquet")
    texts = docs.filter(F.length("text") > 0)
    assert texts.select(F.regexp_replace("text", "\\s", "")).distinct().count() == texts.count()
    kept_ids = docs.select("doc_id")
    bad = labels.filter("quality = 0")
    assert bad.join(kept_ids, "doc_id").count() <= 0.15 * bad.count()
    packed = corpus_pipeline.run(spark, big)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_tell_rows_without_ids_apart(spark):
    """Null and shared ids, clashing names, null and empty texts."""
    rng = random.Random(12)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(120)) for _ in range(8)]
    close = texts[3] + " more"
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, None), (2, ""), (3, texts[2]), (3, texts[3]), (None, close), (4, None), (5, texts[4] + " "), (5, texts[4]), (6, texts[5]), (6, texts[5])]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 0.5, 1, b"z") for r in rows], "doc_id long, text string, gone string, id int, kept string, score double, predicted int, bands binary").repartition(3)
    exact = corpus_pipeline.stored(corpus_pipeline.exact_stage(spark, docs, ""), "exact")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    got = sorted(((r.doc_id, r.text) for r in exact.collect()), key=key)
    assert exact.columns == docs.columns
    assert got == sorted([(1, texts[0]), (None, texts[1]), (2, ""), (3, texts[2]), (3, texts[3]), (None, close), (5, texts[4] + " "), (6, texts[5]), (6, texts[5])], key=key)
    near = corpus_pipeline.stored(corpus_pipeline.near_stage(spark, exact, ""), "near")
    got.remove((None, close))
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=key) == got and near.columns == docs.columns


def test_one_row_stays_of_copies_without_ids(spark):
    """Byte-identical rows without an id: as a hot group, and beside others that have ids."""
    rng = random.Random(21)
    texts = [" ".join(f"c{rng.randrange(10**6)}" for _ in range(100)) for _ in range(5)]
    rows = [(None, texts[0])] * 60 + [(None, texts[1])] * 2 + [(None, texts[1] + "  ")] * 2 + [(7, texts[2])] + [(None, texts[2])] * 3 + [(8, texts[3]), (None, texts[4])] + [(None, None)] * 2
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int").repartition(4)
    left = Counter([(None, texts[0]), (None, texts[1] + "  "), (7, texts[2]), (8, texts[3]), (None, texts[4]), (None, None)])
    exact = corpus_pipeline.stored(corpus_pipeline.exact_stage(spark, docs, ""), "exact")
    assert exact.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == left
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, exact, "").collect()) == left
    near = Counter((r.doc_id, (r.text or "").strip()) for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert near == Counter([(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[3]), (None, texts[4]), (None, ""), (None, "")])
    kept = [r for r in exact_dedup.exact_groups(docs).collect() if r.kept]
    assert Counter((r.doc_id, r.group_size) for r in kept) == Counter([(None, 60), (None, 4), (7, 4), (8, 1), (None, 1), (None, 2)])


def test_one_row_is_kept_of_each_class(spark):
    """Shared and missing ids: classes by text, one row kept in each."""
    rng = random.Random(22)
    texts = [" ".join(f"d{rng.randrange(10**6)}" for _ in range(100)) for _ in range(3)]
    rows = [(None, texts[0])] * 9 + [(4, texts[1]), (4, texts[1] + " more"), (None, texts[1])] + [(5, texts[2])] * 2 + [(6, texts[2])]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found if r.kept) == Counter([(None, None, 9), (4, 4, 3), (5, 5, 3)])
    assert len(found) == len(rows)


def test_stages_with_edges(spark, edge_docs, edge_rows, no_docs, tmp_path):
    """All edge rows through each stage on its own: equal to brute force, and nothing from nothing."""
    spark.createDataFrame([(100 + k, 1 - (k % 5 == 0)) for k in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def texts(name):
        found = stages[name](spark, edge_docs, str(tmp_path))
        assert found.columns == edge_docs.columns
        return Counter((r.doc_id, r.text, r.n_chars) for r in found.collect())

    every = Counter((doc_id, text, None if text is None else len(text)) for doc_id, text, _, _ in edge_rows)
    groups = {}
    for doc_id, text, n in every.elements():
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, (doc_id, text, n)))
    stay = [min(g, key=lambda x: x[:3])[3] for g in groups.values()]
    assert texts("exact") == Counter({row: 1 if row[0] is None else every[row] for row in stay})
    assert texts("pii") == Counter((d, None if t is None else pii.redact(t), None if t is None else len(pii.redact(t))) for d, t, _ in every.elements())
    near = texts("near")
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(edge_docs).collect()}
    assert {d for d, *_ in near if d is not None} == {c for c in classes.values() if c is not None} and near <= every
    model = quality.train(edge_docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    score = {text: float(model.scores(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]) for _, text, _ in every}
    assert texts("quality") == Counter(r for r in every.elements() if score[r[1]] >= quality.THRESHOLD)
    packed = packing.pack(edge_docs).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, *_ in every.elements())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
