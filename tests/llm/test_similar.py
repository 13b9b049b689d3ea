"""The near-dedup stage of the pipeline against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from ashlar.llm import similar, simhash


def test_stage_removes_similar_texts_of_distant_prints(spark):
    """Pairs of Jaccard similarity 0.8 to 0.9 go, though their op8 prints differ in more than 4 bits; pairs of 0.6 stay."""
    rng = random.Random(11)
    rows, near, far, distant = [], [], [], 0
    for n in range(40):
        words = ["w%d" % rng.randint(0, 5000) for _ in range(300)]
        for edits, into in ((5, near), (16, far)):
            other = list(words)
            for i in range(edits):
                other[10 + i * (280 // edits)] = "x%d" % rng.randint(0, 5000)
            a, b = " ".join(words), " ".join(other).upper()
            if into is far:
                a = a.replace("w", "v")
                b = b.replace("W", "V")
            j = similar.similarity(similar.shingles(a.encode()), similar.shingles(b.encode()))
            assert 0.8 <= j < 0.9 if into is near else j < 0.7
            if into is near:
                prints = [simhash.fingerprint(simhash._lowered(t.encode())) for t in (a, b)]
                distant += (prints[0] ^ prints[1]).bit_count() > simhash.RADIUS
            into.append(len(rows) + 1)
            rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert distant > 20
    assert left == set(range(len(rows))) - set(near)


@pytest.mark.parametrize("edits", [3, 4, 5])
def test_dense_groups_are_linked_as_by_brute_force(spark, edits):
    """400 variants of one text, from mostly loose to mostly near: components as all pairs give them."""
    rng = random.Random(edits)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    texts = []
    for _ in range(400):
        other = list(words)
        for i in rng.sample(range(300), edits):
            other[i] = f"x{rng.randint(0, 9000)}"
        texts.append(" ".join(other))
    sets = [similar.shingles(t.encode()) for t in texts]
    every = np.unique(np.concatenate(sets))
    member = np.zeros((400, len(every)), np.float32)
    for row, s in zip(member, sets, strict=True):
        row[np.searchsorted(every, s)] = 1
    both = member @ member.T
    sizes = member.sum(axis=1)
    a, b = np.nonzero(np.triu(both / (sizes[:, None] + sizes - both) >= similar.SIMILARITY, 1))
    label = np.arange(400)
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.key: r.root for r in similar.similar(docs, ["doc_id"]).collect()}
    joined = sum(found[x] == found[y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert len(a) > 10 and joined >= 0.98 * len(a)
    # Nothing else is joined, and as many documents stay as brute force leaves, but for the missed links.
    assert len(set(found.values())) <= len(set(label.tolist())) + 0.02 * 400
    groups = {}
    for k, root in found.items():
        groups.setdefault(root, set()).add(int(label[k]))
    assert all(len(g) == 1 for g in groups.values())


def test_spanning_trees_join_all_that_pairs_join():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, (2, 500))
    away = np.sort(rng.integers(0, 9, 500)).astype(np.uint16)
    tree = similar.spanning(np.maximum(a, b), np.minimum(a, b), away)
    u, v = np.maximum(a, b)[tree], np.minimum(a, b)[tree]

    def groups(x, y):
        label = np.arange(400)
        while (label[x] != label[y]).any():
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
        return label

    assert groups(u, v).tolist() == groups(a, b).tolist()
    assert len(u) == 400 - len(set(groups(a, b).tolist()))
    x, y, _, of_trees = similar.thinned(np.maximum(a, b), np.minimum(a, b), away)
    assert groups(x[of_trees], y[of_trees]).tolist() == groups(a, b).tolist()


def test_loose_dense_group_loses_no_link(spark):
    """600 variants, few of them near: every link that brute force finds, beyond each text's nearest ones."""
    rng = random.Random(7)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    texts = []
    for _ in range(600):
        other = list(words)
        for i in rng.sample(range(300), 5):
            other[i] = f"x{rng.randint(0, 9000)}"
        texts.append(" ".join(other))
    sets = [similar.shingles(t.encode()) for t in texts]
    pairs = [(i, j) for i in range(600) for j in range(i) if similar.similarity(sets[i], sets[j]) >= similar.SIMILARITY]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.key: r.root for r in similar.similar(docs, ["doc_id"]).collect()}
    assert len(pairs) > 40 and all(found[i] == found[j] for i, j in pairs)
    names = list(range(600))
    for i, j in pairs:
        names = [names[i] if n == names[j] else n for n in names]
    assert len(set(found.values())) == len(set(names))


@pytest.mark.parametrize("counted", [similar.COUNTED, 64])
def test_linked_compares_all_of_a_cluster(monkeypatch, counted):
    """Sets of 0 to 40 shingles, chains and copies among them, against all pairs within clusters."""
    monkeypatch.setattr(similar, "COUNTED", counted)
    rng = np.random.default_rng(2)
    sets, clusters = [np.zeros(0, np.uint64)], [0]
    for cluster in (5, -3, 9):
        base = rng.choice(1 << 40, 40, replace=False).astype(np.uint64)
        for _ in range(70):
            part = base[rng.random(40) < rng.choice([0.55, 0.9])]
            sets.append(np.unique(part if len(part) else base))
            clusters.append(cluster)
    n = len(sets)
    expected, links = np.arange(n), 0
    for i in range(n):
        for j in range(i):
            if clusters[i] == clusters[j] and similar.similarity(sets[i], sets[j]) >= similar.SIMILARITY:
                expected[expected == expected[i]] = expected[j]
                links += 1
    found = similar.linked(sets, np.array(clusters))
    assert links > 50 and 10 < len(set(expected.tolist())) < n - 10
    assert len(set(zip(found.tolist(), expected.tolist()))) == len(set(found.tolist())) == len(set(expected.tolist()))
