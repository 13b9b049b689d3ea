"""Periodic runs, the class language model and source divergence against plain Python and SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest

from ashlar.llm import class_lm, periodic_runs, queries, source_divergence
from ashlar.llm.sql import ORACLES
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, row string, n_runs long, score double, rank int, term string, n long"


@pytest.fixture(scope="module")
def plain():
    return duckdb.connect().sql(f"select * from '{FOLDER}/documents.parquet' order by doc_id").df()


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs, empty and very long texts, ties, repeated rows and ids, columns named as results are."""
    texts = [None, "", " \n\t", "one", "a b a b a b a b", "a " * 900, "x y z " * 400 + "end", "Ünïcödé ÉA éa 中文 中文 A a", "same words here again"]
    extra = ("r", 1, 0.5, 2, "t", 3)
    rows = [(i, t, "en" if i % 4 else None, None if i % 3 else "s", *extra) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, "b a b a", "en", "t", *extra), (None, "same words here", "en", "", *extra), (None,) * 10]
    rows += [(100 + i, "same words here again and more of the same", "en", f"u{i % 5}", *extra) for i in range(30)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_runs(w, least=6, times=4):
    found = []
    names = {}
    v = np.array([names.setdefault(x, len(names)) for x in w])
    for q in range(1, len(w) // times + 1):
        if not (v[q:] == v[:-q]).any():
            continue
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            start, length = i, j + q - i
            shorter = any(w[start : start + length - d] == w[start + d : start + length] for d in range(1, q))
            if length >= max(least, times * q, 2 * q) and not shorter:
                found.append((start, length, q))
            i = j
    return sorted(found)


def test_runs_of_small_words():
    rng = random.Random(3)
    for _ in range(600):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 5 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, n // 4 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, times in ((6, 4), (2, 2), (5, 3)):
            assert periodic_runs.runs(w, least, times) == plain_runs(w, least, times)
        # Cutting at rare words changes nothing, and texts do not run into each other.
        text = " ".join(map(str, w)).encode()
        assert periodic_runs._text_runs([text, None, b"q r " + text, text], 6, 4)[1] == [
            plain_runs(w), [], [(s + 2, k, q) for s, k, q in plain_runs(w)], plain_runs(w)
        ]


def expected_runs(w):
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_of_runs_plants_and_finds(spark, plain):
    found = {r.doc_id: tuple(r)[1:] for r in queries.op11(spark, FOLDER).collect()}
    planted = 0
    for doc_id, text in zip(plain.doc_id, plain.text, strict=True):
        w = brute.words(text)
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += bool(plain_runs(w))
        assert found[doc_id] == expected_runs(w)
    assert planted > 3


def test_runs_of_awkward_rows(spark, awkward, empty):
    rows = periodic_runs.periodic(awkward, awkward.columns).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        w = brute.words(r.row.text)
        count, start, length, period, milli, _, kept = expected_runs(w)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (count, start, length, period, milli)
        assert sha(r.collapsed) == kept and len(r.runs) == count
    assert periodic_runs.periodic(empty, ["doc_id"]).count() == 0


def likelihood(n):
    n = np.asarray(n, float)
    total = lambda v: float(sum(x * math.log(x) for x in np.ravel(v) if x > 0))
    return total(n) - total(n.sum(axis=1)) - total(n.sum(axis=0))


def class_bigrams(lines, of, c):
    n = np.zeros((c, c), np.int64)
    for line in lines:
        for a, b in zip(line, line[1:], strict=False):
            n[of[a], of[b]] += 1
    return n


def test_gains_are_differences_of_the_likelihood():
    rng = random.Random(4)
    classes, words = 3, 9
    lines = [["end", *[rng.randrange(words) for _ in range(rng.randint(1, 20))], "end"] for _ in range(12)]
    of = {w: rng.randrange(classes + 1) for w in range(words)} | {"end": classes + 1}
    n = class_bigrams(lines, of, classes + 2)
    pairs = Counter((a, b) for x in lines for a, b in zip(x, x[1:], strict=False))
    behind, before = np.zeros((2, words, classes + 2))
    for (a, b), k in pairs.items():
        if a != "end":
            behind[a, of[b]] += k
        if b != "end":
            before[b, of[a]] += k
    own = np.array([of[w] for w in range(words)])
    itself = np.array([pairs[w, w] for w in range(words)], float)
    made = class_lm.gains(n, own, behind, before, itself, classes)
    for w in range(words):
        each = [likelihood(class_bigrams(lines, of | {w: b}, classes + 2)) for b in range(classes)]
        assert np.allclose(np.diff(made[w]), np.diff(each))


def plain_scores(texts, learn, classes, head_size, rounds):
    """The whole model with plain loops; each gain by counting all bigrams of classes anew."""
    rare, end, c = classes, classes + 1, classes + 2
    tokens = [brute.words("".join(x.lower() if x.isascii() else x for x in t or "")) for t in texts]
    training = [t for t, y in zip(tokens, learn, strict=True) if y]
    counts = Counter(w for t in training for w in t)
    of_counts = Counter(counts.values())
    room, head = head_size, []
    for k in sorted(of_counts, reverse=True):
        if k < 2 or of_counts[k] > room:
            break
        room -= of_counts[k]
        head += sorted((w for w in counts if counts[w] == k), key=lambda w: w.encode())
    of = {w: min(i, rare) if i < classes else rare for i, w in enumerate(head)}
    lines = [["", *t, ""] for t in training]
    place = lambda w: end if w == "" else of.get(w, rare)

    def head_bigrams(moved=None, to=None):
        n = np.zeros((c, c))
        for line in lines:
            for a, b in zip(line, line[1:], strict=False):
                if a in numbers or b in numbers:
                    n[to if a == moved else place(a), to if b == moved else place(b)] += 1
        return n

    numbers = {w: i for i, w in enumerate(head)}
    steps, reach = [], min(classes, len(head))
    while reach < len(head):
        steps.append((reach, min(len(head), 4 * reach), None))
        reach = steps[-1][1]
    for start, stop, parity in steps + [(0, len(head), k % 2) for k in range(rounds)]:
        moves = {}
        for w in head[start:stop]:
            if parity is not None and ((numbers[w] * 0x9E3779B1) >> 16) % 2 != parity:
                continue
            each = [likelihood(head_bigrams(w, b)) + 1e-6 * (b == of[w]) for b in range(classes)]
            moves[w] = int(np.argmax(np.round(each, 9)))
        of |= moves
    base = head_bigrams()
    for w in counts.keys() - numbers.keys():
        if counts[w] > 1:
            near = Counter((place(a), place(b)) for x in lines for a, v, b in zip(x, x[1:], x[2:], strict=False) if v == w)
            sides = np.zeros((2, 1, c))
            for (a, b), k in near.items():
                sides[0, 0, b] += k
                sides[1, 0, a] += k
            of = of | {(w, "placed"): int(class_lm.gains(base, np.array([rare]), sides[0], sides[1], np.zeros(1), classes).argmax())}
    final = {w: of.get((w, "placed"), of.get(w, rare)) for w in counts}
    n = np.zeros((c, c))
    for line in lines:
        codes = [end if w == "" else final[w] for w in line]
        for a, b in zip(codes, codes[1:], strict=False):
            n[a, b] += 1
    has = np.array([float(k >= rare or n[:, k].sum() > 0) for k in range(c)])
    share = (n.sum(axis=0) + 0.5 * has) / (n.sum() + 0.5 * has.sum())
    once, twice = of_counts[1], of_counts[2]
    unknown = (once + 0.5) / (once + 2 * twice + 1)
    total, distinct = sum(counts.values()) + len(training), len(counts) + bool(training)

    def within(w):
        if w == "":
            return 1.0
        if w not in counts:
            return unknown
        return (1 - unknown) / once if counts[w] == 1 else counts[w] / n[:, final[w]].sum()

    found = []
    for t in tokens:
        score, base, last = 0.0, 0.0, end
        for w in [*t, ""]:
            code = end if w == "" else final.get(w, rare)
            score += math.log10((n[last, code] + c * share[code]) / (n[last].sum() + c)) + math.log10(within(w))
            k = len(training) if w == "" else counts[w]
            base += math.log10((k + 0.5) / (total + 0.5 * (distinct + 1)))
            last = code
        known = sum(w in counts for w in t) + bool(training)
        found.append((len(t) + 1, known, total, base, score))
    probabilities = sum(within(w) * (n[end, final[w]] + c * share[final[w]]) for w in counts)
    probabilities += within("") * (n[end, end] + c * share[end]) + unknown * (n[end, rare] + c * share[rare])
    return found, probabilities / (n[end].sum() + c), final


def little_corpus():
    rng = random.Random(8)
    nouns, verbs, marks = [f"n{i}" for i in range(9)], [f"v{i}" for i in range(7)], ["The", "a", "one"]
    texts = []
    for _ in range(24):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += [rng.choice(marks), nouns[int(rng.random() ** 2 * 9)], verbs[int(rng.random() ** 2 * 7)]]
            if rng.random() < 0.3:
                words.append(f"x{rng.randrange(60)}")
        texts.append(" ".join(words))
    return [*texts, None, "", "the n1 Éa éa"]


@pytest.mark.parametrize("head_size", [1 << 18, 12, 0])
def test_class_model_equals_plain_loops(spark, head_size):
    texts = little_corpus()
    docs = spark.createDataFrame([(i, t, i % 4 != 1) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    rows = {r.row.doc_id: r for r in class_lm.scored(docs, ["doc_id"], docs.learn, classes=4, head_size=head_size, rounds=2).collect()}
    expected, total, final = plain_scores(texts, [i % 4 != 1 for i in range(len(texts))], 4, head_size, 2)
    assert abs(total - 1) < 1e-9
    for i, (tokens, known, trained, base, score) in enumerate(expected):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, trained)
        assert r.base_score == pytest.approx(base, rel=1e-12) and r.score == pytest.approx(score, rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-score / tokens))
    if head_size == 1 << 18:
        # Words of a kind come together.
        kinds = [{final[w] for w in final if w[0] == k and w not in ("the", "a", "one") and final[w] < 4} for k in "nv"]
        assert not kinds[0] & kinds[1]


def test_class_model_beats_single_words_on_held_out_texts(spark):
    rows = queries.op12(spark, "/root/testdata/sf0.01").toPandas()
    held = rows[rows.held_out]
    assert len(rows) == 1000 and held.score.sum() > 0.9 * held.base_score.sum() and (rows.score < 0).all()
    assert rows.train_tokens.nunique() == 1


def test_class_model_on_awkward_rows(spark, awkward, empty):
    rows = class_lm.scored(awkward, awkward.columns, awkward.doc_id % 5 != 1, classes=4).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r.n_tokens == len(brute.words(r.row.text)) + 1 and r.score < 0 and math.isfinite(r.score)
    assert len({(r.base_score, r.score) for r in rows if not brute.words(r.row.text)}) == 1
    assert class_lm.scored(empty, ["doc_id"], empty.doc_id > 0).count() == 0
    none = class_lm.scored(awkward, ["doc_id"], awkward.doc_id < 0).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    with pytest.raises(ValueError):
        class_lm.scored(awkward, ["doc_id"], awkward.doc_id < 0, classes=200)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_divergence_equals_sql(spark, folder):
    found = queries.op13(spark, folder).toPandas()
    assert difference(found, connect(folder).execute(ORACLES["op13_source_divergence"]).df()) is None
    assert set(found.part) == {"pair", "term"}


def plain_divergence(rows, top=200):
    terms = {}
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        kept = "".join((x.lower() if x.isascii() else x) if x.isalpha() or not x.isascii() else " " for x in text or "")
        terms.setdefault(lang or "", []).append((source or "", Counter(t for t in kept.split(" ") if t)))
    found = []
    for lang in {g[0] for g in groups}:
        seen = Counter(t for _, c in terms[lang] for t in c)
        kept = sorted(t for t in seen if seen[t] >= 3)
        counts = {s: Counter() for l, s in groups if l == lang}
        for s, c in terms[lang]:
            counts[s].update({t: k for t, k in c.items() if seen[t] >= 3})
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        gap = lambda p, q: (p - q) ** 2 // q
        for s in counts:
            parts = {"pair": [(o, sum(gap(share(counts[s], t), share(counts[o], t)) for t in kept)) for o in counts if o != s]}
            more = [(t, share(counts[s], t), share(whole, t)) for t in counts[s]]
            parts["term"] = [(t, gap(p, q)) for t, p, q in more if p > q]
            for part, items in parts.items():
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, t, v, k) for k, (t, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(found)


def test_divergence_of_awkward_rows(spark, awkward, empty):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    assert sorted(tuple(r) for r in source_divergence.divergence(awkward).collect()) == plain_divergence(rows)
    assert source_divergence.divergence(empty).count() == 0
    assert sorted(tuple(r) for r in source_divergence.divergence(awkward, top=1).collect()) == plain_divergence(rows, 1)


def test_shares_are_exact_for_large_counts():
    for n, total in ((0, 1), (10**15, 10**15 + 7), (9 * 10**14, 3 * 10**15), (6, 7)):
        assert source_divergence.shares(np.array([n]), np.array([total])).tolist() == [1 + 10**9 * (n + 1) // total]
