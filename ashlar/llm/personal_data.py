"""Personal data: generators propose spans, boosted trees score them, calibrated limits choose.

Everything that touches texts is built of Spark's own functions. Training needs no rows either:
features are small whole numbers, so all candidates together are a table of counts per feature
vector, bounded by the features' ranges. The trees are grown on that table and become one SQL
expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import let, written

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns of the base kinds. Where a pattern cannot match from inside a run unless it
#: matches from its start, it is tried at the start only, or where the last match ended; long
#: runs then cost linear time. Possessive loops do not use the stack.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match; looked for first.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "+"}
#: Generators beside the base patterns, wide on purpose: written-out addresses, dotted numbers of
#: any length, long digit groups, and telephone-like groups without a plus.
WIDE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[.,][0-9]{1,3}){3,7}(?![0-9.])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ ./-]?){3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9])",
}
#: Fixed list: words before a span that speak for it.
CUES = "(?i)(?:mail|tel|phone|fon|call|mobile|cell|fax|card|visa|ip|host|server|contact|address)[^A-Za-z0-9]{0,3}$"
#: Feature -> number of values; their product bounds the table that training reads.
FEATURES = {"kind": 4, "digits": 24, "marks": 8, "length": 12, "before": 5, "after": 5, "cue": 2, "plus": 2}
ROUNDS, DEPTH, RATE, SHRINK = 40, 3, 0.3, 1.0
#: Those of them the trees learn from: what tells how a base pattern writes its spans is left out,
#: so that places and digits carry over to spans written otherwise.
LEARNED = ["kind", "digits", "length", "before", "after", "cue"]
#: All candidates together weigh so much, however many there are.
WEIGHT = 10_000.0
#: A score's candidates must be right this often to be chosen.
PRECISION = 0.98


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Matches, leftmost first and not overlapping, as (start, kind, end, hit) in code points.

    Splitting by the same pattern gives the gaps, lengths of gaps and matches the places.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(F.coalesce(pair["hit"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("found"))
    return F.aggregate(pairs, start, step, lambda s: F.filter(s["found"], lambda x: x["hit"].isNotNull()))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit holds; called with at most 19 digits."""
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: let(
            F.substring(digits, i, F.lit(1)).cast("int") * (1 + (F.length(digits) - i) % 2),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: int, hit: Column) -> Column:
    digits = _digits(hit)
    if KINDS[kind] == "ip":
        bare = F.transform(F.split(hit, "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if KINDS[kind] == "card":
        return F.when(F.length(digits).between(14, 19), let(digits, _luhn)).otherwise(False)
    if KINDS[kind] == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _checks(kind: int) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["hit"])


_EMPTY = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _has(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(NEEDS[kind])) if kind in ("email", "phone") else text.rlike(NEEDS[kind])


def _features(text: Column, span: Column) -> Column:
    """The features of a candidate as small whole numbers, from its format and its neighbours."""

    def sort(c: Column) -> Column:
        return (
            F.when(c == "", 0).when(c.rlike("[ \\x09-\\x0D]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("\\p{L}"), 3).otherwise(4)
        )

    hit = span["hit"]
    before = F.substring(text, F.greatest(F.lit(1), span["start"] - 15), F.least(span["start"], F.lit(16)))
    return F.struct(
        span["kind"].alias("kind"),
        F.least(F.length(_digits(hit)), F.lit(23)).alias("digits"),
        F.least(F.length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), F.lit(7)).alias("marks"),
        F.least(F.floor(F.length(hit) / 4).cast("int"), F.lit(11)).alias("length"),
        F.when(span["start"] == 0, 0).otherwise(sort(F.substring(text, span["start"], F.lit(1)))).alias("before"),
        sort(F.substring(text, span["end"] + 1, F.lit(1))).alias("after"),
        before.rlike(CUES).cast("int").alias("cue"),
        F.startswith(hit, F.lit("+")).cast("int").alias("plus"),
    )


def proposed(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``row`` (the columns ``keep``), ``base`` (valid spans of the base patterns) and ``others``
    (further candidates with features ``f`` and the weak label ``y``). One pass, no shuffle.

    A candidate that equals a valid base span is right (y = 1), a failing base match is not (y = 0),
    nor is what only a wide generator proposes; but where a word right before that speaks for it,
    it may be right and teaches nothing (y NULL).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), body.alias("text"))
    found = rows.select(
        "row",
        "text",
        *[
            F.when(_has(F.col("text"), k), _spans(F.col("text"), p, i)).otherwise(F.array().cast(_EMPTY)).alias(f"b{i}")
            for i, (k, p) in enumerate(BASE.items())
        ],
        *[
            F.when(
                F.col("text").rlike("[(\\[{]at[)\\]}]" if k == "email" else "[0-9]{2}[^A-Za-z]?[0-9]|[0-9][.,][0-9]"),
                _spans(F.col("text"), p, i),
            ).otherwise(F.array().cast(_EMPTY)).alias(f"w{i}")
            for i, (k, p) in enumerate(WIDE.items())
        ],
    )
    fine = [F.filter(f"b{i}", _checks(i)) for i in range(len(KINDS))]
    checked = found.select(
        "row", "text", F.array_sort(F.concat(*fine)).alias("base"),
        F.concat(*[F.col(f"b{i}") for i in range(len(KINDS))]).alias("tried"),
        F.array_distinct(F.concat(*[F.col(f"{c}{i}") for c in "bw" for i in range(len(KINDS))])).alias("all"),
    )
    featured = checked.select(
        "row", "text", "base", "tried", F.transform("all", lambda s: F.struct(s.alias("span"), _features(F.col("text"), s).alias("f"))).alias("all")
    )

    def labelled(c: Column) -> Column:
        y = F.when(F.array_contains("base", c["span"]), 1).when((c["f"]["cue"] == 0) | F.array_contains("tried", c["span"]), 0)
        return F.struct(c["span"].alias("span"), c["f"].alias("f"), y.alias("y"))

    return featured.select("row", "text", "base", F.transform("all", labelled).alias("all"))


def _grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: nested (feature, limit, low side, high side) or a value."""
    value = -RATE * g.sum() / (h.sum() + SHRINK)
    if depth == 0 or len(x) < 2:
        return float(value)
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + SHRINK)
    for f in range(x.shape[1]):
        top = int(x[:, f].max()) + 1
        gs, hs = (np.cumsum(np.bincount(x[:, f], v, top))[:-1] for v in (g, h))
        if not len(gs):
            continue
        won = gs**2 / (hs + SHRINK) + (g.sum() - gs) ** 2 / (h.sum() - hs + SHRINK) - whole
        at = int(np.argmax(won))
        if won[at] > gain:
            best, gain = (f, at), float(won[at])
    if best is None:
        return float(value)
    f, at = best
    low = x[:, f] <= at
    return f, at, _grown(x[low], g[low], h[low], depth - 1), _grown(x[~low], g[~low], h[~low], depth - 1)


def _applied(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, at, low, high = tree
    return np.where(x[:, f] <= at, _applied(low, x), _applied(high, x))


def _as_column(tree, features: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, at, low, high = tree
    name = LEARNED[f]
    return F.when(features[name] <= at, _as_column(low, features)).otherwise(_as_column(high, features))


def fitted(candidates: DataFrame) -> tuple[list, list[float]]:
    """Trees and, per kind, the limit of their score, from ``f`` and ``y`` of all labelled candidates.

    Only counts per feature vector come to the driver, fewer than the product of the features'
    ranges however many rows there are, and only their shares count: the same rows given twice
    teach the same. A limit is the lowest score from which on all higher scores of the kind together
    are right often enough; without any such score nothing of the kind is chosen.
    """
    vector = F.struct(*[F.col("f").getField(name).alias(name) for name in LEARNED]).alias("f")
    counts = candidates.filter("y IS NOT NULL").groupBy(vector).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("right")).orderBy("f").collect()
    if not counts:
        return [], [math.inf] * len(KINDS)
    x = np.array([[r.f[name] for name in LEARNED] for r in counts], np.int64)
    n, right = (np.array([r[c] for r in counts], float) for c in ("n", "right"))
    n, right = n * (WEIGHT / n.sum()), right * (WEIGHT / n.sum())
    margin, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grown(x, n * p - right, n * p * (1 - p), DEPTH))
        margin += _applied(trees[-1], x)
    limits = [math.inf] * len(KINDS)
    for kind in range(len(KINDS)):
        mine = x[:, 0] == kind
        score, seen, good = np.round(margin[mine], 6), 0.0, 0.0
        for s in np.unique(score)[::-1]:
            seen, good = seen + n[mine][score == s].sum(), good + right[mine][score == s].sum()
            if good >= PRECISION * seen * (1 - 1e-9):
                limits[kind] = float(s)
    return trees, limits


def found(docs: DataFrame, keep: Sequence[str], text: str = "text", whole: bool = False) -> DataFrame:
    """``row`` (the columns ``keep``), ``base`` and ``spans``: arrays of (start, kind, end, hit) in
    code points, ends exclusive, ordered by start, then kind. ``whole`` keeps ``text`` as well.

    ``spans`` are the base spans and those other candidates that the trees score at the limit of
    their kind or above and that overlap no base span. NULL and empty texts have none; rows are judged alone,
    so repeated rows get equal spans; an empty table gives no rows.

    Texts are searched once; candidates are written to the shared folder, the trees fitted on
    the counts of all of them and applied as an expression.
    """
    columns = ["row", *(["text"] if whole else []), "base", "all"]
    rows = written(proposed(docs, keep, text).select(*columns), "candidates")
    trees, limits = fitted(rows.select(F.explode("all").alias("c")).select("c.f", "c.y"))
    if all(map(math.isinf, limits)):
        return rows.withColumn("spans", F.col("base")).drop("all")

    def chosen(c: Column) -> Column:
        score = F.lit(0.0)
        for tree in trees:
            score = score + _as_column(tree, c["f"])
        apart = F.forall("base", lambda b: (b["start"] >= c["span"]["end"]) | (b["end"] <= c["span"]["start"]))
        limit = F.element_at(F.array(*map(F.lit, limits)), c["span"]["kind"] + 1)
        return ~F.coalesce(c["y"] == 1, F.lit(False)) & apart & (F.round(score, 6) >= limit)

    more = F.transform(F.filter("all", chosen), lambda c: c["span"])
    return rows.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", more)))).drop("all")


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind)))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    # A span that begins within what is covered so far only widens it.
    start = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        one = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        inside = F.coalesce(s["start"] < last["end"], F.lit(False))
        return F.when(inside, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(
            F.concat(done, F.array(one))
        )

    def rebuilt(merged: Column) -> Column:
        name = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1)
        end = lambda i: F.coalesce(F.get(merged, i)["end"], F.lit(0))
        parts = F.transform(
            merged, lambda s, i: F.concat(F.substring(text, end(i - 1) + 1, s["start"] - end(i - 1)), name(s))
        )
        tail = F.substring(text, end(F.size(merged) - 1) + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(spans, start, merge), rebuilt))
