"""Bounded samples, the two classifiers and the tiling against plain loops."""

import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from ashlar.llm import common, compression_quality, decontaminate, toxicity


def test_a_sample_is_bounded_whatever_id_repeats(spark):
    rows = spark.range(0, 30_000, 1, 6).selectExpr("IF(id % 3 = 0, 7L, id) AS doc_id", "id % 11 AS other")
    chosen = common.bounded_sample(rows, 1000).collect()
    assert 800 < len(chosen) < 1200 and sum(r.doc_id == 7 for r in chosen) <= common.PER_KEY
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, common.bounded_sample(rows.repartition(3), 1000).collect()))
    few = common.bounded_sample(rows.limit(50).union(rows.limit(50)), 1000)
    assert few.count() == rows.limit(50).distinct().filter("doc_id <> 7").count() + min(common.PER_KEY, rows.limit(50).filter("doc_id = 7").distinct().count())


def test_labelled_texts_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    docs = spark.range(0, 6000, 1, 4).selectExpr("IF(id % 3 = 0, 8L, id) AS doc_id", "concat(repeat('word ', 40), id) AS text")
    labels = spark.range(6000).selectExpr("IF(id % 2 = 0, 8L, id) AS doc_id", "int(id % 2) AS toxic")
    sample, _ = common.labelled(docs, labels, "toxic", 500)
    rows = sample.collect()
    assert 100 < len(rows) < 700 and sum(r.doc_id == 8 for r in rows) <= common.PER_KEY
    monkeypatch.setattr(common, "SAMPLE_BYTES", 20_000)
    less = common.labelled(docs, labels, "toxic", 500)[0].collect()
    assert 0 < sum(len(r.text) for r in less) < 40_000 and {r.text for r in less} < {r.text for r in rows}


def labelled_texts():
    rng = random.Random(2)
    rows = []
    for i in range(160):
        bad = i % 3 == 0
        words = [rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(1, 25))]
        if bad:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["nasty", "vile thing"]))
        rows.append((i, " ".join(words).title(), int(bad)))
    return [*rows, (900, None, 0), (901, "", 1)]


def plain_features(text):
    words = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
    mask, found = (1 << 64) - 1, set(words)
    for gap, salt in ((1, 1), (2, 2)):
        found |= {((a * int(toxicity._A)) + b + salt) & mask for a, b in zip(words, words[gap:], strict=False)}
    return sorted({(((h ^ (h >> 33)) * int(toxicity._B)) & mask) >> (64 - toxicity.BITS) for h in found})


def test_ftrl_equals_plain_loops(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    bias, at, w = toxicity.fit(docs, "doc_id", "text", "label")
    turns = {r.doc_id: r.turn for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("turn")).collect()}
    z, n, bias_z, bias_n = {}, {}, 0.0, 0.0
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= toxicity.L1 else -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)
    base = lambda: -bias_z / ((toxicity.BETA + math.sqrt(bias_n)) / toxicity.ALPHA)
    for _ in range(toxicity.EPOCHS):
        for doc_id, text, label in sorted(rows, key=lambda r: (turns[r[0]], r[2])):
            mine = plain_features(text)
            weights, b = {f: weight(f) for f in mine}, base()
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.values()) + b)))) - label
            for f in mine:
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA
                z[f] = z.get(f, 0.0) + g - sigma * weights[f]
                n[f] = n.get(f, 0.0) + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / toxicity.ALPHA * b
            bias_n += g * g
    expected = {f: weight(f) for f in z if weight(f)}
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(expected, rel=1e-9) and bias == pytest.approx(base(), rel=1e-9)
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, (bias, at, w), ["doc_id"]).collect()}
    for doc_id, text, _ in rows:
        total = base() + sum(expected.get(f, 0.0) for f in plain_features(text))
        assert scores[doc_id] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6)


def test_compression_scores_equal_plain_loops(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        good = i % 2
        vocabulary = ["sound", "careful", "reason", "therefore"] if good else ["$$$", "click", "win", "now!!!"]
        rows.append((i, " ".join(rng.choice(vocabulary) + str(rng.randint(0, 3)) for _ in range(rng.randint(5, 700))), good))
    docs = spark.createDataFrame([*rows, (900, "", 1), (901, None, 0)], "doc_id long, text string, label int").repartition(3)
    model = compression_quality.fit(docs, "doc_id", "text", "label")

    def plain_difference(text):
        body, saved = text.encode(), 0
        for i in range(0, len(body), compression_quality.PIECE):
            sizes = []
            for data in (model.bad, model.good):
                made = zstandard.ZstdCompressor(
                    level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(data),
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                sizes.append(len(made.compress(body[i : i + compression_quality.PIECE])))
            saved += sizes[0] - sizes[1]
        return saved / len(body)

    scores = {r.doc_id: r.score for r in compression_quality.scored(docs, model, ["doc_id"]).collect()}
    for doc_id, text, good in rows:
        expected = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * plain_difference(text) + model.bias))))
        assert scores[doc_id] == pytest.approx(expected, rel=1e-9)
        assert (scores[doc_id] > 0.5) == bool(good)
    assert scores[900] == scores[901] == model.empty


def plain_tiles(item, doc, least):
    """The longest match of unmarked tokens by looking at all pairs of places, again and again."""
    used_i, used_d, made = set(), {j for j, t in enumerate(doc) if t < 0}, []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and i + k not in used_i and j + k not in used_d:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return made
        k, i, j = best
        made.append(best)
        used_i |= set(range(i, i + k))
        used_d |= set(range(j, j + k))


def test_tiling_equals_plain_greedy_tiling():
    rng = random.Random(9)
    for _ in range(250):
        item = np.array([rng.randrange(rng.choice([2, 4, 20])) for _ in range(rng.randint(1, 40))])
        parts = [item[a : a + rng.randint(2, 15)].tolist() for a in (rng.randrange(len(item)) for _ in range(rng.randint(0, 5)))]
        doc = np.array([t for p in parts for t in (*p, *([rng.choice([-1, 0, 1, 99])] * rng.randint(0, 2)))], np.int64)
        least = rng.choice([2, 3, 5])
        assert sorted(decontaminate.tiles(item, doc, least)) == sorted(plain_tiles(item.tolist(), doc.tolist(), least))


def test_contaminated_equals_plain_tiling(spark):
    """All pairs of document and item of the smallest tables, and items that are shorter than a seed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = spark.createDataFrame([(9001, "Zq wq"), (9002, "xq"), (9003, "..."), (9004, "a b c d")], "item_id long, text string")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").union(short)
    docs = docs.union(spark.createDataFrame([(9000, "Here zq, WQ stands; a b c, no d"), (9001, "only zq and wq; xq"), (9002, "z a b, c. D")], docs.schema))
    found = {(r.doc_id, r.item_id): (r.n_tokens, r.covered) for r in decontaminate.contaminated(docs, benchmark, ["doc_id"]).collect()}
    items = {r.item_id: decontaminate.tokens_of(r.text) for r in benchmark.collect()}
    expected = {}
    for row in docs.collect():
        tokens = decontaminate.tokens_of(row.text or "")
        for key, item in items.items():
            least = min(decontaminate.LEAST, len(item))
            seeds = {tuple(item[i : i + least]) for i in range(len(item) - least + 1)}
            if not item or not any(tuple(tokens[i : i + least]) in seeds for i in range(len(tokens) - least + 1)):
                continue
            numbers = {t: n for n, t in enumerate(dict.fromkeys(item))}
            # Long stretches of text that share nothing with the item shrink to one gap.
            doc = [numbers.get(t, -1) for t in tokens]
            doc = [t for n, t in enumerate(doc) if t >= 0 or n == 0 or doc[n - 1] >= 0]
            total = sum(t[0] for t in plain_tiles([numbers[t] for t in item], doc, least))
            if total >= 0.8 * len(item):
                expected[row.doc_id, key] = (len(item), total)
    assert found == expected and {(9000, 9001), (9001, 9002), (9002, 9004)} <= found.keys() and (9001, 9001) not in found


def test_equal_words_are_tiled_in_linear_time():
    began = time.perf_counter()
    assert sum(t[0] for t in decontaminate.tiles(np.zeros(40, np.int64), np.zeros(20_000, np.int64))) == 40
    assert time.perf_counter() - began < 0.5
    items = decontaminate.Items([(1, "no " * 40)])
    assert items.matches("no " * 20_000) == [(0, 40, 1)]


def test_tiling_of_very_long_texts_and_clashing_columns(spark):
    rows = [(1, "x " * 30_000 + "one two three four five six", "a", 2, 3), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, covered int, n_tokens int")
    benchmark = spark.createDataFrame([(5, "one two three four five six", 1)], "item_id long, text string, covered int")
    assert decontaminate.contaminated(docs, benchmark, ["doc_id"]).count() == 1
    assert decontaminate.clean(docs, benchmark).columns == docs.columns and decontaminate.clean(docs, benchmark).count() == 1
