"""The feature finder: clean, profile, test, normalize and rank a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ashlar.functions.names import named
from ashlar.operators import distribution, normalize, outliers, ranks, relate
from ashlar.operators.clean import rectangularize
from ashlar.operators.profile import SCALED_TYPES, ColumnStats, fit, of_type, profile
from ashlar.sources.lines import read_lines
from ashlar.sources.sinks import label_path, write_csv, write_norm_table, write_norms
from ashlar.sources.tables import Staged


class Features(dict):
    """Results by name. ``close`` removes what was staged for them; nothing can be read from them then."""

    staged: Staged | None = None

    def close(self) -> None:
        if self.staged is not None:
            self.staged.close()

    def __enter__(self) -> Features:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def find_features(
    spark: SparkSession,
    path: str,
    output: str | None = None,
    norms_folder: str | None = None,
    header: bool | None = True,
    ids: Sequence[str] | None = None,
    interval: str = "OUTLIER",
    feature: str = "MEDIAN",
    low: float = -3.0,
    high: float = 3.0,
    mode: str = "errorifexists",
    stage: bool = True,
) -> Features:
    """Every result of the feature finder for a delimited text file.

    The fit, the medians and the test of normality are computed at once; all else is lazy.
    ``header=None`` lets the first line decide whether it is a header.

    Writes the normalized table to ``output`` and the labeled norms to ``norms_folder``
    where these are given. Some twenty passes read the cleaned rows, so these are written
    once (``stage``), numbers as numbers, instead of cleaning and parsing the text for each.
    The result owns them: close it when all results are read.
    """
    table = rectangularize(read_lines(spark, path), header)
    leading = list(ids if ids is not None else table.names[:6])
    results = Features()
    if not stage:
        rows = typed = scaled = labeled = table.rows
        shown = {c: c for c in leading}
        stats = fit(rows, table.names, moments=True)
    else:
        # All columns are tried for numbers, in the one pass over the text; the fit reads these.
        results.staged = Staged(table.rows, "rows", table.names)
        stats = fit(results.staged.typed(), table.names, moments=True)
        # Identifying columns and numeric labels are shown as they stood in the text.
        shown = {f"__text{i}": c for i, c in enumerate(leading)}
        rows, typed = results.staged.rows, results.staged.typed(of_type(stats))
        scaled = results.staged.typed(of_type(stats, SCALED_TYPES))
        labeled = results.staged.typed(text={c: t for t, c in shown.items()})
    results |= features_of(typed, "row_id", table.names, None, interval, feature, low, high, stats)
    results["normalized"] = normalize.zscore(scaled.select(*[named(c) for c in table.names]), stats=stats)
    if of_type(stats):
        norms = normalize.labeled_norms(labeled, list(shown), stats=stats)
        results["labeled_norms"] = norms.withColumnsRenamed(shown)
        if norms_folder is not None:
            write_norm_table(results["labeled_norms"], label_path(path, norms_folder), mode)
    elif norms_folder is not None:
        write_norms(rows, label_path(path, norms_folder), leading, stats=stats, mode=mode)
    if output is not None:
        write_csv(results["normalized"], output, mode=mode)
    results |= {"rejected": table.rejected, "rows": rows}
    return results


def features_of(
    df: DataFrame,
    key: str,
    cols: Sequence[str] | None = None,
    ids: Sequence[str] | None = None,
    interval: str = "OUTLIER",
    feature: str = "MEDIAN",
    low: float = -3.0,
    high: float = 3.0,
    stats: dict[str, ColumnStats] | None = None,
) -> dict[str, DataFrame]:
    """The same results for any table with a unique sortable ``key``; ``stats`` if they are known."""
    cols = list(cols if cols is not None else [c for c in df.columns if c != key])
    stats = stats or fit(df, cols, moments=True)
    numeric = of_type(stats)
    results = {
        "profile": profile(df, cols, moments=True),
        "normalized": normalize.zscore(df.select(*[named(c) for c in cols]), stats=stats),
    }
    if not numeric:
        return results
    norms = normalize.row_norms(df, [key], stats=stats)
    median, centres = ranks.median(df, numeric, stats=stats), None
    if (interval.upper(), feature.upper()) == ("OUTLIER", "MEDIAN"):
        centres = {r["column"]: r["median"] for r in median.collect()}
    results |= {
        "correlation": relate.correlation(df, numeric),
        "correlated_pairs": relate.correlated_pairs(df, numeric),
        "independence": relate.chi2_independence(df, numeric, stats),
        "goodness_of_fit": relate.chi2_gof(df, numeric, stats),
        "density": distribution.kde(df, numeric, stats=stats),
        "median": median,
        "histogram": ranks.histogram(df, numeric, stats),
        "mode": ranks.mode(df, numeric, stats),
        "ranked_modes": ranks.ranked_modes(df, numeric, stats),
        "row_norms": norms,
        "labeled_norms": normalize.labeled_norms(df, ids or [key], stats=stats),
        "extreme_rows": normalize.extreme_rows(norms, key),
    }
    if normalize.scaled_columns(stats):
        results["hits"] = outliers.scan(df, key, None, interval, feature, low, high, stats=stats, centres=centres)
    if any(stats[c].variance > 0 for c in numeric):
        results["normality"] = distribution.ks_normal(df, numeric, stats)
    return results

