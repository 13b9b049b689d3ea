"""The registered queries: every operator over whole tables of the given folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.text import field_count, look_alike, unquote
from ashlar.operators import anonymize as anon
from ashlar.operators import clean, distribution, normalize, outliers, ranks, relate, synth
from ashlar.operators.profile import fit, infer_types, profile, raw_moments
from ashlar.plans.anonymizer import make_substitute
from ashlar.plans.datamaker import make_data
from ashlar.plans.features import find_features
from ashlar.session import shared_path
from ashlar.sources import lines as src
from ashlar.sources import sinks
from ashlar.sources.tables import read_table, staged

Query = Callable[[SparkSession, str], DataFrame]

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
PART = ["p_partkey", "p_size", "p_retailprice"]
EVENTS = ["event_id", "user_id", "value"]
MEANS = [1.2, 3.4, 5.6]
VARIANCES = [7.8, 9.10, 11.12]
SEED = 42


def digits(value: Column, n: int = 9) -> Column:
    """A float to ``n`` significant digits, so that summation order does not show."""
    place = n - 1 - F.floor(F.log10(F.abs(value)))
    up = F.pow(F.lit(10.0), F.greatest(place, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(-place, F.lit(0)))
    return F.when(value == 0, 0.0).otherwise(F.round(value * up / down) / up * down)


def shown(df: DataFrame, n: int = 9, places: dict[str, int] | None = None) -> DataFrame:
    """Every double to ``n`` significant digits, or to fixed decimals where asked."""
    places = places or {}
    return df.select(
        *[
            (F.round(c, places[c]) if c in places else digits(F.col(c), n)).alias(c)
            if t == "double"
            else F.col(c)
            for c, t in df.dtypes
        ]
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def _profile(name: str, cols: list[str], moments: bool = False) -> Query:
    def run(spark, folder):
        return shown(profile(table(spark, folder, name), cols, moments))

    return run


def _moments(spark, folder):
    found = profile(table(spark, folder, "lineitem"), LINEITEM, moments=True)
    return shown(
        found.select("column", "skewness", "kurtosis"), places={"skewness": 8, "kurtosis": 8}
    )


def _raw_moments(spark, folder):
    return shown(raw_moments(table(spark, folder, "lineitem"), LINEITEM))


def _types(name: str, cols: list[str], rule: str) -> Query:
    def run(spark, folder):
        return infer_types(table(spark, folder, name), cols, rule)

    return run


def _documents(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("value")
    )


def _customer_lines(spark, folder):
    return src.as_lines(table(spark, folder, "customer"), "c_custkey", CUSTOMER)


def _order_lines(spark, folder):
    return src.as_lines(table(spark, folder, "orders"), "o_orderkey", ORDERS)


def _unquote(spark, folder):
    return _documents(spark, folder).select("row_id", unquote(F.col("value")).alias("value"))


def _field_counts(spark, folder):
    return _documents(spark, folder).select(
        "row_id", field_count(unquote(F.col("value"))).alias("n_fields")
    )


def _field_shape(spark, folder):
    return clean.field_shape(_documents(spark, folder))


def _widest(spark, folder) -> int:
    return clean.field_shape(_documents(spark, folder)).first()["max_fields"]


def _short_rows(spark, folder):
    return clean.short_rows(_documents(spark, folder), _widest(spark, folder))


def _rectangular_rows(spark, folder):
    return clean.rectangular_rows(_documents(spark, folder), _widest(spark, folder))


def _header_removed(spark, folder):
    return clean.rectangularize(_order_lines(spark, folder), header=True).rows.toDF(
        "row_id", "orderkey", "custkey", "status", "totalprice", "priority"
    )


def _detect_header(spark, folder):
    found = None
    for name, key, cols in (
        ("customer", "c_custkey", ["c_name", "c_mktsegment"]),
        ("orders", "o_orderkey", ORDERS),
        ("part", "p_partkey", ["p_partkey", "p_name", "p_brand"]),
    ):
        lines = src.as_lines(table(spark, folder, name), key, cols)
        judged = clean.detect_header(lines).select(F.lit(name).alias("source"), "*")
        found = judged if found is None else found.unionByName(judged)
    return found


def _rectangular_table(spark, folder):
    return clean.rectangularize(_customer_lines(spark, folder), header=False).rows


def _typed_table(spark, folder):
    cleaned = clean.rectangularize(_order_lines(spark, folder), header=False)
    types = {s.column: s.inferred_type for s in fit(cleaned.rows, cleaned.names).values()}
    return clean.typed_columns(cleaned.rows, cleaned.names, types)


def _numbers_only(spark, folder):
    orders = table(spark, folder, "orders")
    types = {s.column: s.inferred_type for s in fit(orders, ORDERS).values()}
    return clean.numbers_only(orders, ORDERS, types)


def _lenient(spark, folder):
    return clean.parse_check(
        clean.split_fields(_customer_lines(spark, folder)), ["row_id", "col_idx"], "field"
    )


def _sentinel(spark, folder):
    return clean.append_sentinel(_customer_lines(spark, folder)).withColumn(
        "n_fields", field_count(F.col("value"))
    )


def _sentinel_dropped(spark, folder):
    marked = clean.append_sentinel(_customer_lines(spark, folder))
    return clean.drop_sentinel(clean.to_columns(marked, [*CUSTOMER, "No Data"]))


def _counts(spark, folder):
    return clean.stage_counts(_documents(spark, folder))


def _corr_matrix(spark, folder):
    return shown(relate.correlation(table(spark, folder, "lineitem"), LINEITEM), places={"r": 8})


def _corr_pairs(spark, folder):
    return shown(relate.correlated_pairs(table(spark, folder, "lineitem"), LINEITEM, 0.001), places={"r": 8})


def _corr_pairs_half(spark, folder):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lineitem = table(spark, folder, "lineitem").select(*LINEITEM, revenue.alias("revenue"))
    return shown(relate.correlated_pairs(lineitem, lineitem.columns), places={"r": 8})


def _corr_vectors(spark, folder):
    numbers = [
        *["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        *LINEITEM,
    ]
    wide = table(spark, folder, "lineitem")
    wide = wide.select(*numbers, *[(F.col(c) * F.col("l_quantity")).alias(f"{c}_x_quantity") for c in numbers], F.sqrt("l_extendedprice").alias("root_price"))
    return shown(relate.correlation(wide, wide.columns), places={"r": 7})


def _vectorized(spark, folder):
    part = relate.vectorize(table(spark, folder, "part"), PART)
    from pyspark.ml.functions import vector_to_array

    return part.select("p_partkey", F.posexplode(vector_to_array("features")).alias("pos", "value"))


def _independence(spark, folder, p_value: bool = False):
    part = table(spark, folder, "part")
    found = relate.chi2_independence(part, ["p_size", "p_retailprice"], p_value=p_value)
    return shown(found, places={"p_value": 4})


def _independence_of_counts(spark, folder):
    """Customers by nation and segment, which have nothing to do with each other: a p-value between."""
    cells = [F.count_if(F.col("c_mktsegment") == s).alias(f"n{i}") for i, s in enumerate(SEGMENTS)]
    counts = table(spark, folder, "customer").groupBy("c_nationkey").agg(*cells)
    return shown(relate.chi2_independence(counts, [f"n{i}" for i in range(len(SEGMENTS))]), places={"p_value": 2})


def _gof(spark, folder, p_value: bool = False):
    customer = table(spark, folder, "customer")
    found = relate.chi2_gof(customer, ["c_nationkey", "c_acctbal"], p_value=p_value)
    return shown(found, places={"p_value": 4})


def _ks(spark, folder, p_value: bool = False):
    return shown(
        distribution.ks_normal(table(spark, folder, "events"), ["user_id", "value"], p_value=p_value),
        places={"statistic": 9, "p_value": 2},
    )


def _ks_lineitem(spark, folder):
    return shown(
        distribution.ks_normal(table(spark, folder, "lineitem"), LINEITEM, p_value=False), places={"statistic": 9}
    )


def _kde_points(spark, folder):
    return shown(
        distribution.kde(table(spark, folder, "events"), ["value", "user_id"], points=[0.0, 25.0, 50.0, 75.5]),
        places={"density": 10},
    )


def _kde_grid(spark, folder):
    return shown(
        distribution.kde(table(spark, folder, "events"), ["value", "user_id"]), places={"density": 10}
    )


def _kde_threshold(spark, folder):
    part = table(spark, folder, "part")
    stats = fit(part, ["p_size", "p_retailprice"])
    unit = distribution.unit_grid(stats["p_size"].count)
    return shown(
        distribution.kde(part, list(stats), grid=unit, least=0.01, stats=stats), places={"density": 9}
    )


def _median(name: str, cols: list[str], side: str, limit: int = ranks.EXACT_LIMIT) -> Query:
    def run(spark, folder):
        return ranks.median(table(spark, folder, name), cols, side, limit=limit)

    return run


def _ranks(op, name: str, cols: list[str]) -> Query:
    def run(spark, folder):
        return shown(op(table(spark, folder, name), cols))

    return run


def _bin_edges(op, name: str, cols: list[str]) -> Query:
    def run(spark, folder):
        return shown(op(table(spark, folder, name), cols), places={"left_edge": 6})

    return run


def _zscore(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", *LINEITEM, "l_returnflag")
    scaled = normalize.zscore(lineitem, LINEITEM)
    return shown(scaled, places={c: 5 for c in LINEITEM})


def _norms(spark, folder):
    return normalize.row_norms(table(spark, folder, "customer"), ["c_custkey"], CUSTOMER[1:])


NORM_PLACES = {"row_max": 6, "row_min": 6, "l1_norm": 6, "l2_norm": 6}


def _row_norms(spark, folder):
    return shown(_norms(spark, folder), places=NORM_PLACES)


def _labeled_norms(spark, folder):
    norms = normalize.labeled_norms(table(spark, folder, "events"), ["event_id", "event_type"], EVENTS[1:])
    return shown(norms, places=NORM_PLACES)


def _extreme(ascending: bool) -> Query:
    def run(spark, folder):
        lists = normalize.extreme_rows(_norms(spark, folder), "c_custkey", ascending=ascending)
        return shown(lists, places={"value": 6})

    return run


def _sorted_norms(spark, folder):
    ordered = normalize.sort_rows(_norms(spark, folder), "c_custkey", "l1_norm", ascending=False)
    return shown(ordered.select("c_custkey", "l1_norm"), places=NORM_PLACES)


def _scan(interval: str, feature: str, low: float, high: float, order: str | None = "row") -> Query:
    def run(spark, folder):
        hits = outliers.scan(
            table(spark, folder, "events"), "event_id", EVENTS, interval, feature, low, high, order
        )
        return shown(hits, places={"low": 6, "high": 6, "deviation": 6})

    return run


def _md5(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5("text").alias("digest"))


def _look_alike(spark, folder):
    return table(spark, folder, "documents").select("doc_id", look_alike(F.col("text")).alias("text"))


def _look_alike_names(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", *[look_alike(F.col(c)).alias(c) for c in ("c_name", "c_mktsegment")]
    )


def _redraw(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stats = fit(orders, ["o_custkey", "o_totalprice"])
    return shown(anon.redraw(orders, ["o_orderkey"], stats, SEED), n=8)


def _anonymized(spark, folder):
    return anon.anonymize(table(spark, folder, "customer"), ["c_custkey"], CUSTOMER, SEED)


def _anonymize(spark, folder):
    return shown(_anonymized(spark, folder), n=8)


def _fidelity(spark, folder):
    compared = anon.fidelity(table(spark, folder, "customer"), _anonymized(spark, folder), CUSTOMER)
    return shown(compared, n=7)


def _synth(spark, folder):
    return synth.fill_rows(
        table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", MEANS, VARIANCES, SEED, keep_key=True
    )


def _synth_rows(spark, folder):
    return shown(_synth(spark, folder), places={f"num_{j}": 7 for j in range(3)})


def _synth_verify(spark, folder):
    return shown(synth.verify(_synth(spark, folder), MEANS, VARIANCES), n=7)


def _words_among_numbers(spark, folder):
    wordy = table(spark, folder, "customer").selectExpr(
        "if(c_custkey % 2 = 0, 'Nan', 'inf') AS words",
        "if(c_custkey % 10 = 0, string(c_nationkey), c_name) AS mostly_words",
        "if(c_custkey % 10 = 0, 'n/a', string(c_nationkey)) AS mostly_numbers",
        "if(c_custkey % 3 = 0, 'NaN', c_custkey % 4 || '.25') AS shares",
    )
    return infer_types(wordy, least_parse_rate=0.5)


def _not_finite(spark, folder):
    rows = table(spark, folder, "customer").selectExpr(
        "CASE c_custkey % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE c_acctbal END AS balance"
    )
    return shown(profile(rows).select("column", "count", "parsed", "mean", "variance", "min", "max"))


def _look_alike_salted(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", look_alike(F.col("c_name"), "grain").alias("c_name"))


def _ranked(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Each row's place in an ordered result: partitions in order, rows in order within them."""
    # The id holds the partition above 33 bits and the row's place in it below.
    placed = staged(ordered.select(*keys, F.monotonically_increasing_id().alias("at")), "ranked")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.selectExpr("part", "sum(n) OVER (ORDER BY part ROWS UNBOUNDED PRECEDING) - n AS before")
    found = placed.join(before, F.shiftright("at", 33) == F.col("part"))
    return found.selectExpr(*[f"`{k}`" for k in keys], f"(at & {2**33 - 1}) + before + 1 AS rank")


def _sorted_rank(spark, folder):
    return _ranked(normalize.sort_rows(_norms(spark, folder), "c_custkey", "l1_norm", ascending=False), ["c_custkey"])


def _scan_rank(order: str) -> Query:
    """The place of every hit in the row-major or column-major scan."""

    def run(spark, folder):
        hits = outliers.scan(table(spark, folder, "events"), "event_id", EVENTS, "OUTLIER", "MEAN", -1.0, 1.0, order)
        return _ranked(hits, ["event_id", "column"])

    return run


def _ks_draws(spark, folder):
    found = distribution.ks_normal(_synth(spark, folder), [f"num_{j}" for j in range(3)])
    return shown(found, places={"statistic": 9, "p_value": 2})


def _preview(spark, folder):
    return src.preview(table(spark, folder, "customer"), "c_custkey", 5)


def _first_row(spark, folder):
    return src.first_row(_order_lines(spark, folder), "row_id")


def _normalized_read_back(spark, folder):
    path = shared_path(spark, "normalized")
    customer = table(spark, folder, "customer").select(*CUSTOMER)
    sinks.write_normalized(customer, path, CUSTOMER)
    again = sinks.read_back(spark, path)
    found = profile(again.rows, again.names).select("column", "col_idx", "count", "mean", "variance", "inferred_type")
    return shown(found, places={"mean": 6, "variance": 6})


def _norms_read_back(spark, folder):
    path = shared_path(spark, "norms")
    sinks.write_norms(table(spark, folder, "events"), path, ["event_id", "event_type"], EVENTS[1:])
    rows = sinks.read_back(spark, path).rows.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        "event_type",
        F.col("`L1-Norm`").cast("double").alias("l1_norm"),
        F.col("`L2-Norm`").cast("double").alias("l2_norm"),
    )
    return shown(rows, places=NORM_PLACES)


def _substitute_read_back(spark, folder):
    path = shared_path(spark, "substitute")
    sinks.write_csv(_anonymized(spark, folder), path)
    again = sinks.read_back(spark, path)
    found = profile(again.rows, again.names)
    return shown(found.select("column", "col_idx", "count", "mean", "variance", "min", "max", "inferred_type"), n=7)


def _documents_read_back(spark, folder):
    path = shared_path(spark, "documents")
    documents = table(spark, folder, "documents")
    sinks.write_csv(documents, path, exact=True)
    return sinks.read_table_back(spark, path, documents.schema)


def _text_sink(spark, folder):
    path = shared_path(spark, "lines")
    sinks.write_text(_order_lines(spark, folder), path)
    return src.read_lines(spark, path).select("value")



def _order_file(spark, folder) -> str:
    path = shared_path(spark, "orders")
    sinks.write_csv(table(spark, folder, "orders").select(*ORDERS), path)
    return path


def _long(df: DataFrame, part: str, name: str, value: str) -> DataFrame:
    return df.selectExpr(f"'{part}' AS part", f"{name} AS name", f"double({value}) AS value")


def _feature_finder(spark, folder):
    """The whole program over a text file with a header that it has to detect."""
    found = find_features(spark, _order_file(spark, folder), header=None, ids=ORDERS[:1], low=-1.0, high=1.0)
    numeric = found["profile"].filter("inferred_type <> 'String'")
    parts = [
        _long(numeric, "mean", "column", "mean"),
        _long(numeric, "stddev", "column", "stddev"),
        _long(found["median"], "median", "column", "median"),
        _long(found["hits"].filter("column = 'o_totalprice'").agg(F.count(F.lit(1)).alias("n")), "hits", "'o_totalprice'", "n"),
        _long(found["row_norms"].agg(F.count(F.lit(1)).alias("n")), "norms", "'rows'", "n"),
    ]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionAll(part)
    return shown(long)


def _anonymizer_program(spark, folder):
    """The whole program: moments of the original, and how often each substituted text stands."""
    made = make_substitute(spark, _order_file(spark, folder), shared_path(spark, "substitute"), header=None, seed=SEED)
    texts = made["substituted"].groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    before = made["fidelity"].filter("variance_before > 0")
    long = _long(before, "mean", "column", "mean_before").unionAll(_long(before, "variance", "column", "variance_before"))
    return shown(long.unionAll(_long(texts, "texts", "concat_ws('|', o_orderstatus, o_orderpriority)", "n")), 7)


def _data_maker_program(spark, folder):
    """As many lines as there are orders, from a specification in one list; the file's own moments."""
    means, variances = synth.split_spec(len(MEANS), [*MEANS, *VARIANCES])
    rows = table(spark, folder, "orders").count()
    made = make_data(spark, shared_path(spark, "made"), rows, len(MEANS), means, variances, SEED)
    return made["check"].select(
        "column", "count", "spec_mean", "spec_variance",
        (F.abs("mean_error") < 6).alias("mean_is_near"),
        (F.abs(F.col("variance") / F.col("spec_variance") - 1) < 6 * F.sqrt(2 / F.col("count"))).alias("variance_is_near"),
        F.lit(made["preview"].count()).cast("bigint").alias("n_preview"),
    )


QUERIES: dict[str, Query] = {
    # Whole programs
    "feature_finder": _feature_finder,
    "anonymizer_program": _anonymizer_program,
    "data_maker_program": _data_maker_program,
    # Sources and sinks
    "preview": _preview,
    "first_row": _first_row,
    "row_counts": _counts,
    "text_sink_scan": _text_sink,
    "normalized_read_back": _normalized_read_back,
    "norms_read_back": _norms_read_back,
    "substitute_read_back": _substitute_read_back,
    "documents_read_back": _documents_read_back,
    # Cleaning
    "unquote": _unquote,
    "field_counts": _field_counts,
    "field_shape": _field_shape,
    "short_rows": _short_rows,
    "rectangular_rows": _rectangular_rows,
    "header_removed": _header_removed,
    "detect_header": _detect_header,
    "rectangular_table": _rectangular_table,
    "typed_table": _typed_table,
    "numbers_only": _numbers_only,
    "split_fields": lambda s, d: clean.split_fields(_documents(s, d)),
    "lenient_parse": _lenient,
    "vectorize": _vectorized,
    "sentinel_append": _sentinel,
    "sentinel_drop": _sentinel_dropped,
    # Summaries and types
    "profile_lineitem": _profile("lineitem", LINEITEM),
    "profile_orders": _profile("orders", ORDERS),
    "profile_part": _profile("part", PART),
    "profile_events": _profile("events", EVENTS),
    "profile_customer": _profile("customer", CUSTOMER),
    "infer_types_exact": _types("customer", CUSTOMER, "exact"),
    "infer_types_coarse": _types("lineitem", LINEITEM, "coarse"),
    "infer_types_words": _words_among_numbers,
    "profile_not_finite": _not_finite,
    "infer_types_label": _types("orders", ORDERS, "label"),
    "skewness_kurtosis": _moments,
    "raw_moments": _raw_moments,
    # Association and distribution
    "correlation_matrix": _corr_matrix,
    "correlation_matrix_wide": _corr_vectors,
    "correlated_pairs": _corr_pairs,
    "correlated_pairs_half": _corr_pairs_half,
    "chi2_independence": _independence,
    "chi2_independence_p_value": lambda s, d: _independence(s, d, True),
    "chi2_independence_of_counts": _independence_of_counts,
    "chi2_goodness_of_fit": _gof,
    "chi2_goodness_of_fit_p_value": lambda s, d: _gof(s, d, True),
    "ks_normal_events": _ks,
    "ks_normal_lineitem": _ks_lineitem,
    "ks_normal_p_value_draws": _ks_draws,
    "ks_normal_p_value": lambda s, d: _ks(s, d, True),
    "kernel_density_points": _kde_points,
    "kernel_density_grid": _kde_grid,
    "kernel_density_threshold": _kde_threshold,
    # Order statistics and histograms
    "median_upper": _median("lineitem", LINEITEM, "upper"),
    "median_lower": _median("events", ["user_id", "value"], "lower"),
    "median_by_rounds": _median("lineitem", LINEITEM, "upper", limit=500),
    "histogram": _ranks(ranks.histogram, "events", ["user_id", "value"]),
    "histogram_orders": _ranks(ranks.histogram, "orders", ["o_custkey", "o_totalprice"]),
    "histogram_edges": _bin_edges(ranks.histogram_edges, "events", ["user_id", "value"]),
    "mode": _ranks(ranks.mode, "events", ["user_id", "value"]),
    "ranked_modes": _bin_edges(ranks.ranked_modes, "orders", ["o_custkey", "o_totalprice"]),
    # Normalization
    "zscore": _zscore,
    "row_norms": _row_norms,
    "labeled_norms": _labeled_norms,
    "extreme_rows_smallest": _extreme(True),
    "extreme_rows_largest": _extreme(False),
    "norms_sorted": _sorted_norms,
    "norms_sorted_rank": _sorted_rank,
    # Interval scan
    "scan_inlier": _scan("INLIER", "NONE", 0.2, 0.8),
    "scan_outlier_zero": _scan("OUTLIER", "ZERO", -1.0, 2.0),
    "scan_outlier_mean": _scan("OUTLIER", "MEAN", -1.5, 1.5),
    "scan_outlier_median": _scan("OUTLIER", "MEDIAN", -3.0, 3.0),
    "scan_outlier_mode": _scan("OUTLIER", "MODE", -1.0, 3.0, "column"),
    "scan_rows_ranked": _scan_rank("row"),
    "scan_columns_ranked": _scan_rank("column"),
    "scan_outlier_none": _scan("OUTLIER", "NONE", -3.0, 3.0),
    "scan_fallback_options": _scan("sideways", "NONE", 0.8, 0.2),
    # Anonymization
    "md5_digest": _md5,
    "look_alike_names": _look_alike_names,
    "look_alike_salted": _look_alike_salted,
    "look_alike_documents": _look_alike,
    "gaussian_substitution": _redraw,
    "anonymized_rows": _anonymize,
    "fidelity": _fidelity,
    # Data generation
    "synthetic_rows": _synth_rows,
    "synthetic_check": _synth_verify,
}
