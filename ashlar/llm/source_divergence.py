"""How far the word use of sources departs from each other and from their language.

A document's bytes are tokenized by one translate table, which lowers A-Z and blanks all that
separates terms, and by ``bytes.split``; a Counter per document gives its counts. Tasks add these
up before anything moves, so that rows are (language, source, term) with counts, never tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.llm.common import written

#: A term counts in a language if so many of its documents have it.
LEAST_DOCS = 3
#: Ranks of the report on terms.
TOP = 200
#: Shares are whole numbers of this unit, so that all arithmetic is exact.
UNIT = 1_000_000_000
#: Distinct terms that a task gathers before it hands them on.
HELD = 400_000
#: Cells of one dense block of counts, terms by sources.
CELLS = 1 << 18
#: A-Z to a-z; letters and all bytes beyond ASCII stay; all else becomes a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of UTF-8 text, A-Z lowered."""
    return text.translate(TABLE).split() if text else []


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term`` with ``n`` occurrences in ``docs`` documents, summed per task only."""
    blank = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), blank).alias("lang"),
        F.coalesce(F.col(source).cast("string"), blank).alias("source"),
        F.col(text).cast("binary").alias("body"),
    )
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (tongue, origin), (times, seen) in held.items():
                k = len(times)
                columns = [pa.repeat(tongue, k), pa.repeat(origin, k), pa.array(times, pa.binary())]
                columns += [pa.array(times.values(), pa.int64()), pa.array([seen[t] for t in times], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            held.clear()

        count = 0
        for batch in batches:
            tongues, origins = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for group, body in zip(zip(tongues, origins, strict=True), batch.column("body"), strict=True):
                if not (found := Counter(terms_of(body.as_py()))):
                    continue
                times, seen = held.setdefault(group, (Counter(), Counter()))
                count -= len(times)
                times.update(found)
                seen.update(found.keys())
                count += len(times)
                if count > HELD:
                    yield from flush()
                    count = 0
        yield from flush()

    return rows.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")


def kept_terms(counts: DataFrame) -> DataFrame:
    """Per language and term that enough of its documents have: ``total`` and ``entries`` (source, n).

    One exchange, by language and term; both sums run within it. A term has at most a row per
    task and source, and an entry per source.
    """
    dealt = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = dealt.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries")
    )
    return each.filter(F.col("docs") >= LEAST_DOCS).drop("docs")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (n + 1) / total)``; in steps of a thousand, so that nothing overflows."""
    rest, share = n + 1, np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // total
        rest = rest % total
    return share + 1


def _share(n: Column, total: Column) -> Column:
    """The same as an expression, by decimals."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(20,0)")) + 1


def _gap(p, q):
    return (p - q) * (p - q) // q


def pair_sums(terms: DataFrame, groups: dict[str, tuple[list[str], list[int], int]]) -> DataFrame:
    """``lang, source, item, value``: summed over all kept terms of the language.

    ``groups`` names per language its sources, their counts and its number of kept terms. Most
    terms are missing in most sources: such a pair of shares is the same for all of them, so tasks
    add up only what terms that occur add to it. A task's rows are at most the result's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            tongues = np.array(batch.column("lang").to_pylist(), object)
            entries = batch.column("entries")
            flat = entries.flatten()
            names, n = flat.field("source").to_pylist(), flat.field("n").to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(entries.offsets.to_numpy()))
            owner = np.repeat(np.arange(len(entries)), np.diff(ends, prepend=0))
            for tongue in dict.fromkeys(tongues):
                sources, counts, kept = groups[tongue]
                place = {s: i for i, s in enumerate(sources)}
                total = np.array(counts, np.int64) + kept
                none = shares(np.zeros(len(sources), np.int64), total)
                usual = _gap(none[:, None], none[None, :])
                acc = sums.setdefault(tongue, np.zeros((len(sources), len(sources)), np.int64))
                rows = np.flatnonzero(tongues == tongue)
                step = max(1, CELLS // len(sources))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    new = np.full(len(tongues), -1)
                    new[part] = np.arange(len(part))
                    mine = np.flatnonzero(new[owner] >= 0)
                    dense = np.zeros((len(part), len(sources)), np.int64)
                    dense[new[owner[mine]], [place[names[i]] for i in mine]] = n[mine]
                    p = shares(dense, total)
                    for a in range(len(sources)):
                        t = np.flatnonzero(dense[:, a])
                        own, others, missing = p[t, a, None], p[t], dense[t] == 0
                        acc[a] += (_gap(own, others) - usual[a]).sum(axis=0)
                        acc[:, a] += ((_gap(others, own) - usual[:, a]) * missing).sum(axis=0)
        for tongue, acc in sums.items():
            sources = groups[tongue][0]
            k = len(sources)
            columns = [pa.repeat(tongue, k * k), pa.array(np.repeat(sources, k).tolist(), pa.string()), pa.array(sources * k, pa.string()), pa.array(acc.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])

    return terms.select("lang", "entries").mapInArrow(run, "lang string, source string, item string, value bigint")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language, in part ``pair`` every
    other source of it and in part ``term`` the ``top`` terms that it uses more than its language.

    A share is ``p = 1 + floor(10^9 * (n + 1) / (N + V))`` of a kept term's n occurrences, N of all V
    kept terms; a value is ``floor((p - q)^2 / q)``, of a pair their sum. NULL text, language and
    source count as empty. Sources without terms take part in pairs; repeated rows count again. A
    language without kept terms has pairs of value 0; an empty table gives no rows.

    The (language, source) groups are held whole, on the driver and in tasks: part ``pair`` has the
    square of a language's sources as rows, so they are few.
    """
    terms = written(kept_terms(counted(docs, text, lang, source)), "terms")
    blank = F.lit("")
    every = docs.select(F.coalesce(F.col(lang).cast("string"), blank).alias("lang"), F.coalesce(F.col(source).cast("string"), blank).alias("source"))
    inside = terms.select("lang", F.inline("entries")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    whole = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    tallied = every.distinct().join(inside, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["n", "kept", "lang_n"])
    groups: dict[str, tuple[list[str], list[int], int]] = {}
    rows = sorted(tuple(r) for r in tallied.select("lang", "source", "n", "kept", "lang_n").collect())
    for tongue, origin, n, kept, _ in rows:
        sources, counts, _ = groups.setdefault(tongue, ([], [], kept))
        sources.append(origin)
        counts.append(n)

    spark = docs.sparkSession
    known = spark.createDataFrame(rows, "lang string, source string, n bigint, kept bigint, lang_n bigint")
    one, other = known.select("lang", "source", "n", "kept"), known.select("lang", F.col("source").alias("item"), F.col("n").alias("item_n"))
    added = pair_sums(terms, groups).groupBy("lang", "source", "item").agg(F.sum("value").alias("added"))
    share = [F.when(F.col("kept") > 0, _share(F.lit(0), F.greatest(F.col(c) + F.col("kept"), F.lit(1)))).otherwise(1) for c in ("n", "item_n")]
    usual = F.call_function("div", (share[0] - share[1]) * (share[0] - share[1]), share[1]) * F.col("kept")
    pairs = (
        one.join(other, "lang")
        .filter(F.col("source") != F.col("item"))
        .join(added, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", (usual + F.coalesce("added", F.lit(0))).alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    p, q = (_share(F.col(c), F.col(t) + F.col("kept")) for c, t in (("times", "n"), ("total", "lang_n")))
    uses = terms.select("lang", "term", "total", F.inline("entries")).withColumnRenamed("n", "times")
    more = (
        uses.join(F.broadcast(known), ["lang", "source"])
        .select("lang", "source", F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q"))
        .filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    )
    # Tasks keep their own leading ranks of a group before any row of it moves.
    best = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
