"""The corpus operators against plain Python, on whole small tables and on awkward rows."""

import hashlib
import random
import tracemalloc
from types import SimpleNamespace

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ashlar.llm import (
    bpe,
    compression_quality,
    decontaminate,
    personal_data,
    quality_rules,
    queries,
    shards,
    simhash,
    site_style,
    substring_dedup,
    toxicity,
)

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, key string, fp long, base string, n_words long"


@pytest.fixture(scope="module")
def plain():
    return duckdb.connect().sql(f"select * from '{FOLDER}/documents.parquet' order by doc_id").df()


def result(spark, name, folder=FOLDER):
    found = next(q for n, q in queries.QUERIES.items() if n.startswith(name + "_"))
    return found(spark, folder).toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs, empty, blank and long texts, ties, repeated rows, ids that repeat, clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    prose = [" ".join(word() for _ in range(120)) for _ in range(6)]
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "x", "Ünïcödé 中文 🎉 İΣ", prose[0], prose[0], prose[0] + " tail", prose[1],
        "\n".join(["same line here"] * 30), "a " * 5000, "b" * 30000, prose[2] + " " + prose[1] + " " + prose[3],
        "mail me@host.example.org, call +44 (20) 7946 0958, pay 4111 1111 1111 1111, ping 10.0.0.256 10.0.0.255",
        "1" * 5000 + " " + "@" * 500 + "+" * 300, "<|endoftext|>it's <|startoftext|>", "NUL\x00byte \xa0 nbsp \x1c sep",
    ]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", None, "r", "k", "y", 1, "b", 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (3, prose[4], "en", "s", 1, "r", "k", "y", 1, "b", 2), (None, prose[5], "en", "s", 1, *rows[0][5:]), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def expected_tokens(known, text):
    ids = known.encode(text or "", add_special_tokens=False).ids
    return ids, known.decode(ids, skip_special_tokens=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_equals_the_library(spark, plain):
    known, found = library(), result(spark, "op1")
    for text, row in zip(plain.text, found.itertuples(), strict=True):
        ids, decoded = expected_tokens(known, text)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_bpe_awkward_and_back(spark, awkward):
    known = library()
    found = bpe.encode(awkward, queries.tokenizer_path(), ["doc_id", "text"], ["ids"])
    for row in bpe.decode(found, queries.tokenizer_path(), ["text", "ids"]).collect():
        assert (list(row.ids), row.decoded) == expected_tokens(known, row.text)


def test_bpe_words_with_failing_pairs_are_merged_exactly():
    v = bpe.Vocabulary.read(queries.tokenizer_path())
    rng = random.Random(1)
    words = {"".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 14))) for _ in range(3000)}
    words = sorted(words) + ["a" * 3000, "thethe" * 200]
    exact = [v.merged(v.symbols(w)) for w in words]
    assert v.words(words) == exact
    assert any(v.proposed(w) != e for w, e in zip(words, exact, strict=True))


def test_bpe_memory_is_bounded():
    m = bpe.Memory(bpe.Vocabulary.read(queries.tokenizer_path()), most=20)
    for i in range(50):
        known = m.learn([[b"w%d" % j for j in range(i, i + 7)]])
        assert len(known) == 7 and len(m.new) + len(m.old) <= 20


def test_bpe_holds_few_separate_words_of_a_batch():
    """Words of 4 MB of text are looked up in runs, so that they never are separate all at once."""
    batch = pa.RecordBatch.from_arrays([pa.array([b"some words of a text " * 3000] * 64)], names=["body"])
    memory = bpe.Memory(bpe.Vocabulary.read(queries.tokenizer_path()))
    tracemalloc.start()
    total = sum(len(f) for _, found in bpe._in_runs(batch, memory) for f in found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 64 * 15000 and peak < 5 * batch.nbytes


def test_bpe_remembers_runs_in_few_bytes():
    """Remembered runs and pieces are no Python objects of 100 bytes and more each."""
    memory = bpe.Memory(bpe.Vocabulary.read(queries.tokenizer_path()))
    runs = [b"run%dx" % i for i in range(50_000)]
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    assert len(memory.learn([runs])) == len(memory.new) == len(runs)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 100 * len(runs)


def test_bpe_reads_a_worker_s_tables_once(monkeypatch):
    """A worker that has the tables of a file does not read a second query's copy of them."""
    monkeypatch.setattr(bpe, "_memories", {})
    first, second = (SimpleNamespace(value=bpe.Vocabulary.read(queries.tokenizer_path())), SimpleNamespace())
    memory = bpe._memory(("app", "path"), first)
    assert bpe._memory(("app", "path"), second) is memory and memory.vocabulary is first.value


def test_bpe_parts_of_any_size_give_the_same(monkeypatch):
    """Borders of runs, of strings and of shown tokens may lie anywhere."""
    known, v = library(), bpe.Vocabulary.read(queries.tokenizer_path())
    special = next(iter(v.special))
    texts = ["", None, " \n\x0b ", "Don't, don't! ", f"a{special}b {special}{special} \x1c\x7f", "x" * 500 + " é\u2003ÀΣΣ 12٣ e\u0301"]
    texts = texts * 2 + [" ".join(f"word{i}, {special if i % 9 == 0 else 'İ'}" for i in range(40))]
    batch = pa.RecordBatch.from_arrays([pa.array([None if t is None else t.encode() for t in texts], pa.binary())], names=["body"])
    for name, few in (("RUN_BYTES", 60), ("STRINGS", 3), ("STRING_BYTES", 40), ("SHOWN", 7)):
        monkeypatch.setattr(bpe, name, few)
    memory, made = bpe.Memory(v, most=12), []
    for first, found in bpe._in_runs(batch, memory):
        assert first == len(made)
        hashes = [bpe._hashes(found, s).to_pylist() for s in (memory.decimals, memory.texts)]
        made += zip([f.tolist() for f in found], *hashes, strict=True)
    for text, row in zip(texts, made, strict=True):
        ids, decoded = expected_tokens(known, text)
        assert row == (ids, sha(" ".join(map(str, ids))), sha(decoded))
    assert memory.learn([]).to_pylist() == [] and memory.learn([[]]).to_pylist() == []


def test_quality_counts(spark, plain):
    found = result(spark, "op2")
    for text, row in zip(plain.text, found.itertuples(), strict=True):
        m = brute.measures(text)
        assert m == (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert row.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (row.base_failed and row.kept)


def test_quality_awkward(spark, awkward):
    found = quality_rules.judged(awkward, awkward.columns).select("row.text", *quality_rules.MEASURES, "kept").collect()
    assert len(found) == awkward.count()
    for row in found:
        assert brute.measures(row.text) == tuple(row)[1:6]


def test_quality_limits_follow_the_group(spark):
    """A source full of symbols sets its own limits; the same text fails in a source without."""
    rng = random.Random(2)
    prose = lambda mark: " ".join("".join(rng.choice("abcdef") for _ in range(5)) + mark for _ in range(60))
    rows = [(i, prose("##"), "en", "code") for i in range(150)] + [(1000 + i, prose(""), "en", "news") for i in range(300)]
    rows += [(5000, prose("##"), "en", "news"), (5001, prose("##"), "en", "tiny"), (5002, prose(""), "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs, ["doc_id"]).select("row.doc_id", "kept").collect()}
    assert all(kept[i] for i in range(150)) and all(kept[1000 + i] for i in range(300))
    assert not kept[5000] and kept[5002]


def test_quality_is_the_same_for_rows_given_twice(spark):
    docs = queries.documents(spark, FOLDER)
    once = {r.doc_id: r.kept for r in quality_rules.judged(docs, ["doc_id"]).select("row.doc_id", "kept").collect()}
    for times in (2, 7):
        again = docs.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(times))))
        found = quality_rules.judged(again, ["doc_id"]).select("row.doc_id", "kept").collect()
        assert len(found) == times * len(once) and all(once[r.doc_id] == r.kept for r in found)


def test_quality_salted_join_gives_the_same(spark, monkeypatch):
    docs = queries.documents(spark, FOLDER)
    plain_join = quality_rules.judged(docs, ["doc_id"]).select("row.doc_id", "kept").collect()
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert sorted(quality_rules.judged(docs, ["doc_id"]).select("row.doc_id", "kept").collect()) == sorted(plain_join)


def test_shards(spark, plain):
    found = result(spark, "op4")
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert ((found.grown_shard == found.shard) | (found.grown_shard == 16)).all()
    assert [brute.crc(t) for t in plain.text] == found.text_crc32.tolist()
    assert [len((t or "").encode()) + 1 for t in plain.text] == found["size"].tolist()


def test_shards_by_plain_hashing(spark):
    import math

    import xxhash

    weights = [1.0, 2.0, 0.0, 1.0]
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = shards.shard(docs, weights, [*weights, 1.0]).collect()

    def expected(key, weights):
        best = None
        for i, w in enumerate(weights):
            if w:
                first = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
                h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), first)
                score = -w / math.log(((h >> 11) + 0.5) / 2**53)
                best = max(best or (score, i), (score, i), key=lambda p: p[0])
        return best[1]

    assert all(r.shard == expected(r.doc_id, weights) for r in found)
    assert all(r.grown_shard in (r.shard, 4) for r in found)
    share = np.bincount([r.shard for r in found], minlength=4) / 2000
    assert np.allclose(share, [0.25, 0.5, 0, 0.25], atol=0.04)


def test_shards_awkward_and_hot_key(spark, awkward):
    found = shards.shard(awkward, [1.0] * 4, [1.0] * 5).toPandas()
    assert len(found) == awkward.count()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    hot = spark.range(250_000).select(F.lit(7).alias("doc_id"), F.lit("x").alias("text"))
    slots = shards.shard(hot, [1.0] * 4, [1.0] * 5).agg(F.min("slot"), F.max("slot"), F.countDistinct("slot")).first()
    assert tuple(slots) == (0, 249_999, 250_000)


def test_toxicity_and_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = duckdb.connect().sql(f"select * from '{folder}/labels.parquet'").df()
    for name, label, least in (("op3", "toxic", 0.97), ("op5", "quality", 0.96)):
        found = result(spark, name, folder)
        assert found.score.between(0, 1).all()
        held = found[found.held_out].merge(labels, on="doc_id")
        good, bad = held.score[held[label] == 1].values, held.score[held[label] == 0].values
        assert np.mean(good[:, None] > bad[None]) + np.mean(good[:, None] == bad[None]) / 2 > least


def test_models_awkward(spark, awkward):
    labelled = awkward.select("doc_id", "text", (F.length("text") % 2).alias("label"))
    tox = toxicity.fit(labelled, "doc_id", "text", "label")
    assert toxicity.scored(awkward, tox, ["doc_id"]).filter("score BETWEEN 0 AND 1").count() == awkward.count()
    model = compression_quality.fit(labelled, "doc_id", "text", "label")
    assert compression_quality.scored(awkward, model, ["doc_id"]).filter("score BETWEEN 0 AND 1").count() == awkward.count()
    none = labelled.limit(0)
    assert toxicity.scored(awkward, toxicity.fit(none, "doc_id", "text", "label"), ["doc_id"]).first().score == 0.5
    one = compression_quality.fit(none, "doc_id", "text", "label")
    assert compression_quality.scored(awkward, one, ["doc_id"]).first().score == 0.5


def test_repeats(spark, plain):
    found = result(spark, "op6")
    assert brute.removed(plain.text) == list(zip(found.n_words, found.n_removed, found.kept_sha256, strict=True))


@pytest.mark.parametrize("held", [1 << 18, 16])
def test_repeats_awkward(spark, awkward, held, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    found = substring_dedup.without_repeats(awkward, ["text"], outputs=("kept", "kept_sha256")).collect()
    plain = brute.removed([r.text for r in found])
    assert plain == [(r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert all(sha(r.kept) == r.kept_sha256 for r in found)


def test_repeats_with_a_saturated_sketch(spark, plain, monkeypatch):
    """With 64 cells all windows pass the sketch; all go the exact way, and nothing changes."""
    monkeypatch.setattr(substring_dedup, "LEAST_BITS", 6)
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 6)
    passed, real = [], substring_dedup.decided
    monkeypatch.setattr(substring_dedup, "decided", lambda rows: passed.append(rows.selectExpr("sum(length(hashes) div 12 + run)").first()[0]) or real(rows))
    found = result(spark, "op6")
    assert brute.removed(plain.text) == list(zip(found.n_words, found.n_removed, found.kept_sha256, strict=True))
    windows = sum(max(0, len(brute.words(t)) - substring_dedup.WINDOW + 1) for t in plain.text)
    assert passed[0] >= 0.99 * windows


def test_sketch_never_underestimates(spark):
    """A sketch with far too few cells only sends more windows on."""
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(4000)]
    texts = [" ".join(base[i : i + 90]).encode() for i in range(0, 3900, 60)]
    docs = spark.createDataFrame([(t,) for t in texts], "body binary").repartition(3)
    for bits in (4, 20):
        twice = substring_dedup.sketch(docs, bits)
        count = {}
        for t in texts:
            _, _, grams, anchors = substring_dedup.anchored([t])
            for a in substring_dedup.marked(grams, anchors):
                count[a] = count.get(a, 0) + 1
        often = np.array([a for a, n in count.items() if n > 1], np.uint64)
        for row, cells in zip(twice, substring_dedup._cells(often, bits), strict=True):
            assert substring_dedup._repeated(cells, row).all()


def check_spans(rows):
    for row in rows:
        base = [f"{k}:{s}:{e}" for k, s, e in brute.spans(row.text)]
        assert ([] if not row.base else row.base.split(",")) == base
        assert set(base) <= set(row.spans.split(",")) or not base


def test_personal_data(spark, awkward):
    for docs in (queries.documents(spark, FOLDER), awkward):
        found = personal_data.found(docs, ["text"])
        made = [personal_data.written_out(F.col(c)).alias(c) for c in ("base", "spans")]
        check_spans(found.select("row.text", *made).collect())


def test_personal_data_digest_and_redaction(spark, awkward):
    found = result(spark, "op7", "/root/testdata/sf0.01")
    assert (found.base_sha256[found.spans == ""] == sha("")).all() and (found.spans != "").sum() > 10
    one = personal_data.found(awkward, ["doc_id"], whole=True)
    text = {r.doc_id: r.t for r in one.select("row.doc_id", personal_data.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert text[13] == "mail [EMAIL], call [PHONE], pay [CARD], ping 10.0.0.256 [IP]"


def test_trees_accept_what_looks_like_the_base(spark):
    """Card numbers with a wrong last digit in the place of many right ones are chosen too."""
    rng = random.Random(4)

    def card(wrong):
        d = [4] + [rng.randint(0, 9) for _ in range(14)]
        total = sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d))
        return "".join(map(str, d)) + str((-total % 10 + wrong) % 10)

    rows = [(i, f"paid with card {card(i % 100 == 0)} today") for i in range(1000)]
    found = personal_data.found(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    sizes = found.select("row.doc_id", F.size("base").alias("b"), F.size("spans").alias("s")).collect()
    assert all(r.s >= 1 for r in sizes) and sum(r.b == 0 for r in sizes) == 10


def spans_by_row(spark, rows, times=1):
    docs = spark.createDataFrame(rows * times, "doc_id long, text string").repartition(4)
    found = personal_data.found(docs, ["doc_id"], whole=True)
    hits = F.transform("spans", lambda s: s["hit"])
    return [(r.doc_id, tuple(r.hits)) for r in found.select("row.doc_id", hits.alias("hits")).collect()]


def test_spans_written_otherwise_are_found(spark):
    """Written-out addresses and telephone groups behind the words that announce plain ones are added, all
    and nothing else, whatever share of the corpus they are; rows given twice are judged as once."""
    rng = random.Random(12)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    rows, expected = [], {}
    for i in range(1000):
        mail = f"ann{i} (at) host{i % 9} (dot) example (dot) org" if i % 2 else f"ann{i}@host{i % 9}.example.org"
        phone = f"030 {digits(4)} {digits(4)}" if i % 4 < 2 else f"+49 30 {digits(7)}"
        rows.append((i, f"order 12-34-567 of 2021-10-{i % 28 + 1:02d}, mail {mail} or call {phone} today, page 10.20.30 line 77"))
        expected[i] = (mail, phone)
    found = spans_by_row(spark, rows)
    assert dict(found) == expected
    assert sorted(set(spans_by_row(spark, rows, 2))) == sorted(found)
    few = spans_by_row(spark, rows[:40])
    assert dict(few) == {i: expected[i] for i in range(40)}
    assert sorted(set(spans_by_row(spark, rows[:40], 5))) == sorted(few)


def test_fingerprints_and_components(spark, plain):
    found = result(spark, "op8")
    prints = [brute.fingerprint(t) for t in plain.text]
    assert [f"{p:016x}" for p in prints] == found.fingerprint.tolist()
    least = plain.doc_id.groupby(brute.components(prints)).transform("min")
    assert least.tolist() == found.component_id.tolist()


def test_vantage_point_trees_lose_no_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:600].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    dense = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    values = np.unique(np.concatenate([base, near, dense]))
    edges = []
    for first, mask in simhash._bands(simhash.BANDS):
        band = (values >> np.uint64(first)) & np.uint64(mask)
        tree = simhash.grown(band, 16)
        rows, leaves, homes = simhash.dealt(tree, band, 1)
        assert np.bincount(rows[homes], minlength=len(values)).tolist() == [1] * len(values)
        for leaf in np.unique(leaves):
            mine = leaves == leaf
            edges.append(simhash.linked(values[rows[mine & homes]], values[rows[mine]], first, mask))
    edges = np.concatenate(edges)
    assert len(edges) < 20 * len(values)
    label = np.arange(len(values))
    a, b = np.searchsorted(values, edges[:, 0]), np.searchsorted(values, edges[:, 1])
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    assert label.tolist() == brute.components(values).tolist()


def test_large_shards_in_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 42, 150, dtype=np.uint64) << np.uint64(21)  # one value in the first band
    near = base ^ (np.uint64(5) << rng.integers(21, 60, 150).astype(np.uint64))
    values = np.unique(np.concatenate([base, near, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    found = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    monkeypatch.setattr(simhash, "HELD", 16)
    roots = {r.node: r.root for r in simhash.components(simhash.edges_of(found)).collect()}
    mine = np.unique([roots.get(int(v), int(v)) for v in values.view(np.int64)], return_inverse=True)[1]
    plain = brute.components(values)
    assert len(set(mine)) == len(set(plain)) == len(set(zip(mine.tolist(), plain.tolist())))


def test_chain_of_links(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(2000, 1999)], "u long, v long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, n + 1)} | {2000: 1999}


def test_near_duplicates_awkward(spark, awkward):
    rows = simhash.near_duplicates(awkward, ["text"]).select("key", "row.text", "fp", "component").collect()
    assert len(rows) == awkward.count()
    prints = [brute.fingerprint(r.text) for r in rows]
    assert prints == [r.fp & (2**64 - 1) for r in rows]
    label = brute.components(prints)
    for k in set(label):
        keys = [r.key for r, j in zip(rows, label, strict=True) if j == k]
        least = min((x for x in keys if x is not None), default=None)
        assert {r.component for r, j in zip(rows, label, strict=True) if j == k} == {least}
    left = simhash.representatives(awkward).collect()
    assert len(left) == len(set(label))


def site(path, nav, blocks):
    inner = "".join(f"<div class='x'>{b}</div>" for b in blocks)
    return (path, f"http://a.example/{path}", f"<html><body><ul class=top><li>{nav}</ul><section>{inner}</section></body></html>")


def test_site_trees_remove_what_every_page_says(spark):
    rows = [site(i, "Home &amp; more", [f"text {i} one", f"text  {i}\n two"]) for i in range(40)]
    rows += [(100, None, None), (101, "http://b.example/", ""), (102, "http://a.example/x", "<nav>menu</nav>")]
    found = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert found[3] == "text 3 one\n\ntext 3 two"
    assert found[100] == found[101] == found[102] == ""


def test_page_blocks():
    page = """<header>top</header><main role="main"><article><h1>T &lt; &#233;</h1><p>one <b>two<br>three</b><p>four
    <script>var t="</p><p>no</p>";</script><style>p{}</style><div class="share-bar">share</div><aside>side</aside>
    <ul><li>a<li>b</ul><section id="comments"><p>first!</p></section><form><p>mail</p></form><!-- <p>gone</p> -->
    five &amp;amp; 3 < 4</article></main><footer>end</footer>"""
    kept = [t for _, sort, t in site_style.parsed(page)[0] if sort == 2]
    assert kept == ["T < é", "one two three", "four", "a", "b", "five &amp; 3 < 4"]
    assert site_style.parsed("<p" * 2000)[0] is not None and site_style.parsed("<div>" * 3000)[0] == []


def test_pages_keep_the_article(spark):
    docs = duckdb.connect().sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    known = {" ".join((t or "").split()) for (t,) in docs}
    found = queries.QUERIES["op9_site_style_tree"](spark, "/root/testdata/sf0.01").toPandas()
    assert all(" ".join(" ".join(t.split("\n\n")[1:]).split()) in known for t in found.text)
    assert (found.text.str.len() == found.n_chars).all()


def test_benchmark_passages(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    docs = con.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    items = con.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()
    flat = lambda t: " " + " ".join(decontaminate.tokens_of(t or "")) + " "
    whole = {(d, i) for d, t in docs for x in [flat(t)] for i, s in items if flat(s) in x}
    found = queries.QUERIES["op10_decontaminate"](spark, folder).collect()
    assert whole and whole <= {(r.doc_id, r.item_id) for r in found}
    assert all(r.coverage >= 0.8 and r.covered <= r.n_tokens for r in found)


def test_reordered_and_partial_passages(spark, awkward, empty):
    rng = random.Random(8)
    item = ["w%d" % i for i in range(40)]
    noise = lambda n: " ".join("n%d" % rng.randint(0, 99) for _ in range(n))
    rows = [
        (1, noise(50) + " " + " ".join(item[20:]).upper() + ", " + noise(5) + " " + " ".join(item[:20])),
        (2, " ".join(item[:31])), (3, " ".join(item[:33])), (4, " ".join(x for i in range(0, 40, 4) for x in [*item[i : i + 4], "z"])),
        (5, noise(500)), (6, None), (7, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, "n1 n2")], "item_id long, text string")
    found = {(r.doc_id, r.covered, r.tiles) for r in decontaminate.contaminated(docs, bench, ["doc_id"]).collect()}
    assert found == {(1, 40, 2), (3, 33, 1)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 4, 5, 6, 7]
    assert decontaminate.clean(awkward, bench).count() == awkward.count()
    assert decontaminate.contaminated(docs, bench.limit(0), ["doc_id"]).count() == 0
    assert decontaminate.contaminated(empty, bench, ["doc_id"]).count() == 0


def test_tiles_never_overlap():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = rng.integers(0, 4, 60), rng.integers(-1, 4, 150)
        made = decontaminate.tiles(a, b)
        for which in (1, 2):
            at = sorted((t[which], t[0]) for t in made)
            assert all(x + n <= y for (x, n), (y, _) in zip(at, at[1:]))
        assert all((a[i : i + k] == b[j : j + k]).all() and k >= 5 for k, i, j in made)


def test_empty_tables(spark, empty):
    path = queries.tokenizer_path()
    assert bpe.encode(empty, path, ["doc_id"]).count() == 0
    assert quality_rules.judged(empty, ["doc_id"]).count() == 0
    assert shards.shard(empty, [1.0], [1.0, 1.0]).count() == 0
    assert substring_dedup.without_repeats(empty, ["doc_id"]).count() == 0
    assert personal_data.found(empty, ["doc_id"]).count() == 0
    assert simhash.near_duplicates(empty, []).count() == 0
    assert simhash.representatives(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert site_style.main_text(pages, ["page_id"]).count() == 0


def test_pipeline(spark, plain, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, texts = docs.columns, dict(zip(plain.doc_id, plain.text, strict=True))
    left = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in left.select("doc_id", "text").collect()}
        left = stage(spark, left, FOLDER)
        left.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert left.columns == names
            after = {r.doc_id: r.text for r in left.select("doc_id", "text").collect()}
        if i == 1:
            keys = sorted(before)
            label = brute.shingle_groups([before[k] for k in keys])
            assert sorted(after) == sorted({k: None for k in (keys[j] for j in sorted(set(label)))})
        if i == 3:
            assert all(not brute.spans(t) for t in after.values())
            assert all(after[k] == texts[k] for k in after if not brute.spans(texts[k]))
    known = library()
    for r in left.collect():
        assert list(r.ids) == expected_tokens(known, after[r.doc_id])[0]


def test_pipeline_awkward(spark, awkward, tmp_path):
    left = awkward
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, left, FOLDER).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
    assert left.count() > 0
