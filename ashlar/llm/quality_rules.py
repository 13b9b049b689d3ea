"""Quality rules whose limits follow the corpus: quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import let, same, written

#: Words of a window that is looked up for repeats.
WINDOW = 8
#: Measured rate -> least width of the band above the third quartile (and, for lengths, below
#: the first). Rates are in thousandths, word lengths in hundredths of a character.
RATES = {"symbols": 60, "length": 400, "lines": 250, "repeats": 200}
TWO_SIDED = ("length",)
#: Width of the band in distances between the quartiles.
REACH = 4
#: Groups whose limits are broadcast; beyond, the join shuffles.
BROADCAST_GROUPS = 200_000
SALTS = 32
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from all windows' hashes.

    Hash and start are sorted together; starts with an equal neighbour are repeats. Each covers
    the words up to the next repeat's start, its own length at most. Linear but for the sort.
    """

    def covered(ordered: Column) -> Column:
        twin = lambda p, k, d: F.coalesce(F.get(ordered, k + d)["h"] == p["h"], F.lit(False))
        repeats = F.filter(ordered, lambda p, k: ((k > 0) & twin(p, k, -1)) | twin(p, k, 1))
        return let(
            F.array_sort(F.transform(repeats, lambda p: p["i"])),
            lambda starts: F.aggregate(
                F.transform(
                    starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))
                ),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.array_sort(pairs), covered)
    ).otherwise(F.lit(0))


def measured(docs: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``row`` (the columns ``keep``), ``lang``, ``source`` and the counts of every whole text
    (NULL: none), with built-in functions only.

    ``word_chars`` code points in words, ``n_symbols`` characters of ``[#*$%&|<>]``,
    ``n_dup_lines`` lines with a word that equal an earlier one, ``n_repeat_words`` words in
    repeated windows of eight, ``n_lines`` lines with a word. Nothing is shuffled.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    kept = ["row", "lang", "source"]
    split = docs.select(
        F.struct(*keep).alias("row"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        value.alias("_text"),
        F.array_remove(F.split(value, "[ \\x09-\\x0D]+"), "").alias("_words"),
        F.filter(F.split(value, "\n"), lambda line: line.rlike("[^ \\x09-\\x0D]")).alias("_lines"),
    )
    hashed = split.select(
        *kept,
        "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.when(
            F.size("_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_hashes"),
    )
    return hashed.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_hashes")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    ).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )


def _rates() -> dict[str, Column]:
    share = lambda a, b, unit: F.expr(f"CASE WHEN {b} > 0 THEN {unit} * {a} div {b} END")
    return {
        "symbols": share("n_symbols", "word_chars", 1000),
        "length": share("word_chars", "n_words", 100),
        "lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
    }


def sketched(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Quantile sketches of every rate: counts per log-linear bucket, the bucket named by its
    highest value, at most 1/32 above any value in it.

    Sketches merge by adding counts, in any order and with the same outcome, so partial ones
    are built before the shuffle and languages are merged from their sources.
    """
    rates = F.array(*[F.struct(F.lit(name).alias("rate"), value.alias("v")) for name, value in _rates().items()])
    return (
        rows.filter(~F.col("base_failed"))
        .select(*groups, F.inline(rates))
        .withColumn("top", F.expr("v | (shiftleft(1L, greatest(0, length(bin(v)) - 6)) - 1)"))
        .groupBy(*groups, "rate", "top")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def blended(sketches: DataFrame) -> DataFrame:
    """Per language ``l``, source ``s`` and rate the blended sketch: a weight ``w`` for every bucket ``top``.

    A group's own counts are joined by its language's, which weigh a quarter of the language's
    average source, and a language's likewise by the corpus'. So a group far below the average
    mostly follows its language, a large one itself, with no size at which that changes; and the
    same rows given twice weigh twice on all sides. Weights are whole numbers: all shares are
    brought to one denominator.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    known = F.col("l").eqNullSafe(F.col("l2"))
    # The corpus has a few thousand buckets at most: 32 per doubling of the value, for each rate.
    corpus = F.broadcast(sketches.groupBy(F.col("rate").alias("r"), F.col("top").alias("t")).agg(F.sum("n").alias("n_all")))
    langs = sketches.groupBy("l", "rate", "top").agg(F.sum("n").alias("n_l"))
    groups = sketches.groupBy("l", "s", "rate").agg(F.sum("n").alias("n_g"))
    sizes = groups.groupBy("l", "rate").agg(F.sum("n_g").alias("size_l"), F.count(F.lit(1)).alias("sources"))
    whole = F.broadcast(sizes.groupBy(F.col("rate").alias("r3")).agg(F.sum("size_l").alias("size_all"), F.count(F.lit(1)).alias("langs")))
    own = langs.select(F.col("l").alias("l2"), F.col("rate").alias("r2"), F.col("top").alias("t2"), "n_l")
    by_lang = (
        sizes.join(whole, F.col("rate") == F.col("r3"))
        .join(corpus, F.col("rate") == F.col("r"))
        .join(own, known & (F.col("rate") == F.col("r2")) & (F.col("t") == F.col("t2")), "left")
        .select(
            F.col("l").alias("l2"), F.col("rate").alias("r2"), F.col("t").alias("top"), "size_l", "sources",
            (4 * wide("langs") * F.coalesce(wide("n_l"), F.lit(0)) + wide("n_all")).alias("m"),
            (4 * wide("langs") * wide("size_l") + wide("size_all")).alias("size_m"),
        )
    )
    mine = sketches.select(F.col("l").alias("l4"), F.col("s").alias("s4"), F.col("rate").alias("r4"), F.col("top").alias("t4"), "n")
    met = F.col("l").eqNullSafe(F.col("l4")) & F.col("s").eqNullSafe(F.col("s4")) & (F.col("rate") == F.col("r4")) & (F.col("top") == F.col("t4"))
    weight = 4 * wide("sources") * wide("size_m") * F.coalesce(wide("n"), F.lit(0)) + wide("size_l") * wide("m")
    return groups.join(by_lang, known & (F.col("rate") == F.col("r2"))).join(mine, met, "left").select("l", "s", "rate", "top", weight.alias("w"))


def thresholds(rows: DataFrame) -> DataFrame:
    """Low and high limit of every rate per (language, source), from the quartiles of its blended sketch."""
    fine = written(sketched(rows.withColumnsRenamed({"lang": "l", "source": "s"}), ["l", "s"]), "sketches")
    ranked = blended(fine).selectExpr(
        "*",
        "sum(w) OVER (PARTITION BY l, s, rate ORDER BY top ROWS UNBOUNDED PRECEDING) AS upto",
        "sum(w) OVER (PARTITION BY l, s, rate) AS whole",
    )
    quartiles = ranked.groupBy("l", "s", "rate").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("whole"), F.col("top"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("whole"), F.col("top"))).alias("q3"),
    )
    least = F.create_map(*[F.lit(x) for item in RATES.items() for x in item])
    band = F.greatest(REACH * (F.col("q3") - F.col("q1")), F.element_at(least, F.col("rate")))
    found = []
    for name in RATES:
        mine = F.col("rate") == name
        low = F.col("q1") - band if name in TWO_SIDED else F.lit(None).cast("bigint")
        found += [
            F.max(F.when(mine, low)).alias(f"low_{name}"),
            F.max(F.when(mine, F.col("q3") + band)).alias(f"high_{name}"),
        ]
    return quartiles.groupBy("l", "s").agg(*found)


def judged(docs: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``row`` (the columns ``keep``) with the counts, ``base_failed`` and ``kept``.

    A row is kept unless the base rule fails or a rate lies outside its group's limits, the
    quartiles of its sketch, blended with its language's and the corpus', widened by four distances between them or the least width, whichever is more.
    Counts and quartiles cover all rows that pass the base rule. NULL language or source is a
    group like any other; an empty text fails the base rule; an empty table gives no rows;
    repeated rows are judged alike.

    Texts are read once: counts are written to the shared folder, then sketched and joined.
    Limits are broadcast while their number is bounded; else both sides are salted, so that a
    source with a third of all rows is spread over tasks.
    """
    rows = written(measured(docs, keep, text, lang, source), "measured")
    limits = written(thresholds(rows), "limits")
    group, limit = [F.col("lang"), F.col("source")], [F.col("l"), F.col("s")]
    if limits.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(limits), same(group, limit), "left")
    else:
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = rows.withColumn("turn", F.pmod(F.xxhash64("row", *MEASURES), F.lit(SALTS)).cast("int"))
        joined = mine.join(salted, same([*group, F.col("turn")], [*limit, F.col("salt")]), "left")
    within = ~F.col("base_failed")
    for name, value in _rates().items():
        within = within & F.coalesce(value <= F.col(f"high_{name}"), F.lit(True))
        within = within & F.coalesce(value >= F.col(f"low_{name}"), F.lit(True))
    return joined.select("row", *MEASURES, "base_failed", within.alias("kept"))
