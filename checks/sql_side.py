"""The same results in DuckDB SQL, written from the definitions alone."""

from __future__ import annotations

from ashlar.functions.numbers import (
    NORMAL_DENOMINATOR,
    NORMAL_NUMERATOR,
    NORMAL_SCALE,
    NORMAL_SWITCH,
)
from checks.spark_side import CUSTOMER, EVENTS, LINEITEM, MEANS, ORDERS, PART, SEED, SEGMENTS, VARIANCES

TEXT = {"c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority"}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def num(col: str) -> str:
    return f"coalesce(try_cast({q(col)} AS DOUBLE), 0.0)"


def digits(x: str, n: int = 9) -> str:
    place = f"({n - 1} - floor(log10(abs({x}))))"
    up, down = f"pow(10.0, greatest({place}, 0))", f"pow(10.0, greatest(-{place}, 0))"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN 0.0 "
        f"ELSE round({x} * {up} / {down}) / {up} * {down} END"
    )


def show(inner: str, plain: list[str], n: int = 9, sig=(), places: dict[str, int] | None = None) -> str:
    """Columns as they are, to significant digits, or to decimals (without a negative zero)."""
    parts = [q(c) for c in plain]
    parts += [f"{digits(q(c), n)} AS {q(c)}" for c in sig]
    parts += [f"round({q(c)}, {p}) + 0.0 AS {q(c)}" for c, p in (places or {}).items()]
    return f"SELECT {', '.join(parts)} FROM ({inner}) shown"


def union(parts) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


# ---------------------------------------------------------------- summaries and types

MOMENT_FIELDS = {
    "skewness": "avg(pow((x - mu) / sd, 3))",
    "kurtosis": "avg(pow((x - mu) / sd, 4)) - 3",
    "raw_moment3": "avg(x * x * x)",
    "raw_moment4_minus3": "avg(x * x * x * x) - 3",
}


def summary(source: str, col: str, i: int, moments: bool = False) -> str:
    """One profile row; ``source`` is a table or a parenthesized query."""
    extra = "".join(f", {f} AS {name}" for name, f in MOMENT_FIELDS.items()) if moments else ""
    return f"""
      WITH v AS (SELECT {num(col)} AS x, try_cast({q(col)} AS DOUBLE) AS found FROM {source} t),
      m AS (SELECT avg(x) AS mu, nullif(stddev_samp(x), 0) AS sd FROM v)
      SELECT '{col}' AS "column", {i} AS col_idx, count(*) AS "count", count(found) AS parsed,
             avg(x) AS mean, var_samp(x) AS variance, min(x) AS "min", max(x) AS "max",
             sum(abs(x)) AS l1, sqrt(sum(x * x)) AS l2, count(*) FILTER (x <> 0) AS nonzeros,
             bool_and(x = floor(x)) AS all_whole, stddev_samp(x) AS stddev{extra}
      FROM v, m"""


EXACT = "CASE WHEN l1 = 0 THEN 'String' WHEN all_whole THEN 'Int' ELSE 'Double' END"
COARSE = (
    "CASE WHEN l1 = 0 THEN 'String' WHEN l1 = floor(l1) AND \"max\" = floor(\"max\") "
    "AND \"min\" = floor(\"min\") THEN 'Int' ELSE 'Double' END"
)
LABEL = (
    "CASE WHEN l1 = 0 THEN 'String' WHEN NOT all_whole THEN 'Double' "
    "WHEN \"min\" >= 0 AND (\"max\" > 10000 OR kurtosis < -1.2 OR kurtosis > 3.0) THEN 'NumLabel' ELSE 'Int' END"
)


def summaries(source: str, cols: list[str], moments: bool = False, rule: str = EXACT) -> str:
    rows = union(summary(source, c, i, moments) for i, c in enumerate(cols))
    return f"SELECT *, {rule} AS inferred_type FROM ({rows}) s"


def profile(source: str, cols: list[str]) -> str:
    return show(
        summaries(source, cols),
        ["column", "col_idx", "count", "parsed", "nonzeros", "all_whole", "inferred_type"],
        sig=["mean", "variance", "min", "max", "l1", "l2", "stddev"],
    )


def types(source: str, cols: list[str], rule: str) -> str:
    inner = summaries(source, cols, rule == LABEL, rule)
    return f'SELECT "column", col_idx, inferred_type, parsed / "count" AS parse_rate FROM ({inner}) t'


# ---------------------------------------------------------------- lines

def unquoted(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_split_to_array({text}, '[''\"]'), "
        f"lambda piece, i: CASE WHEN i % 2 = 0 THEN replace(piece, ',', '_') ELSE piece END), ' ')"
    )


def line(cols: list[str]) -> str:
    return " || ',' || ".join(f"coalesce(CAST({q(c)} AS VARCHAR), '')" for c in cols)


MEASURED = f"""
  SELECT row_id, value, len(string_split(value, ',')) AS n_fields
  FROM (SELECT doc_id AS row_id, {unquoted('text')} AS value FROM documents) u"""
CUSTOMER_LINES = f"SELECT c_custkey AS row_id, {line(CUSTOMER)} AS value FROM customer"
ORDER_LINES = f"SELECT o_orderkey AS row_id, {line(ORDERS)} AS value FROM orders"
WIDEST = f"(SELECT max(n_fields) FROM ({MEASURED}) w)"


def header_like(value: str) -> str:
    return (
        f"len(list_filter(string_split({value}, ','), "
        f"lambda f: coalesce(try_cast(f AS DOUBLE), 0) <> 0)) = 0"
    )


def detect(source: str, name: str, key: str, cols: list[str]) -> str:
    return f"""
      WITH two AS (
        SELECT row_number() OVER (ORDER BY {key}) AS line, value FROM (
          SELECT {key}, {line(cols)} AS value FROM {source} ORDER BY {key} LIMIT 2) l)
      SELECT '{name}' AS source, CAST(line AS INTEGER) AS line, value,
             bool_and({header_like('value')}) OVER (ORDER BY line) AS looks_like_header
      FROM two"""


# ---------------------------------------------------------------- z-scores and scans

def scaled(source: str, cols: list[str], keep: list[str], labels: bool = True) -> str:
    """CTEs ``v`` (numbers), ``m`` (moments), ``k`` (kurtosis) and ``zs`` (z-scores, NULL if unscaled)."""
    values = ", ".join([q(c) for c in keep] + [f"{num(c)} AS {q('v_' + c)}" for c in cols])
    moments = ", ".join(
        f"avg(v_{c}) AS mu_{c}, nullif(stddev_samp(v_{c}), 0) AS sd_{c}, min(v_{c}) AS lo_{c}, "
        f"max(v_{c}) AS hi_{c}, bool_and(v_{c} = floor(v_{c})) AS whole_{c}"
        for c in cols
    )
    kurt = ", ".join(f"avg(pow((v_{c} - mu_{c}) / sd_{c}, 4)) - 3 AS ku_{c}" for c in cols)
    used = ", ".join(
        f"NOT (lo_{c} = 0 AND hi_{c} = 0) AND NOT (whole_{c} AND lo_{c} >= 0 AND "
        f"(hi_{c} > 10000 OR ku_{c} < -1.2 OR ku_{c} > 3.0)) AS used_{c}"
        for c in cols
    )
    zs = ", ".join(f"CASE WHEN used_{c} THEN (v_{c} - mu_{c}) / sd_{c} END AS z_{c}" for c in cols)
    return f"""
      v AS (SELECT {values} FROM {source} t),
      m AS (SELECT count(*) AS n, {moments} FROM v),
      k AS (SELECT {kurt} FROM v, m),
      u AS (SELECT {used} FROM m, k),
      zs AS (SELECT v.*, {zs} FROM v, m, u)"""


def zscored(source: str, cols: list[str], keep: list[str]) -> str:
    outs = ", ".join([q(c) for c in keep] + [f"CASE WHEN used_{c} THEN z_{c} ELSE v_{c} END AS {q(c)}" for c in cols])
    return f"WITH {scaled(source, cols, keep)} SELECT {outs} FROM zs, u"


def norms(source: str, cols: list[str], keep: list[str]) -> str:
    zs = [f"z_{c}" for c in cols]
    guarded = [f"CASE WHEN abs({z}) < 100 THEN abs({z}) ELSE 0.0 END" for z in zs]
    zeros = " + ".join(f"CASE WHEN {z} = 0 THEN 1 ELSE 0 END" for z in zs)
    return f"""
      WITH {scaled(source, cols, keep)}
      SELECT {', '.join(q(c) for c in keep)},
             greatest(-999999.0::DOUBLE, {', '.join(zs)}) AS row_max,
             least(999999.0::DOUBLE, {', '.join(zs)}) AS row_min,
             {zeros} AS zeros, {' + '.join(guarded)} AS l1_norm,
             sqrt({' + '.join(f'({g}) * ({g})' for g in guarded)}) AS l2_norm
      FROM zs"""


NORM_PLACES = {"row_max": 6, "row_min": 6, "l1_norm": 6, "l2_norm": 6}
CUSTOMER_NORMS = norms("customer", CUSTOMER[1:], ["c_custkey"])


def extreme(direction: str) -> str:
    way = "ASC" if direction == "smallest" else "DESC"
    parts = [
        f"""SELECT '{metric}' AS metric, '{direction}' AS direction,
                   CAST(row_number() OVER (ORDER BY {metric} {way}, c_custkey {way}) AS INTEGER) AS rank,
                   c_custkey, CAST({metric} AS DOUBLE) AS value
            FROM n ORDER BY {metric} {way}, c_custkey {way} LIMIT 5"""
        for metric in ("row_max", "row_min", "zeros", "l1_norm", "l2_norm")
    ]
    inner = f"WITH n AS ({CUSTOMER_NORMS}) {union(parts)}"
    return show(inner, ["metric", "direction", "rank", "c_custkey"], places={"value": 6})


def scan(interval: str, feature: str, low: float, high: float) -> str:
    def one(i: int, c: str) -> str:
        v, mu, sd, lo, hi = (f"{p}_{c}" for p in ("v", "mu", "sd", "lo", "hi"))
        if interval == "INLIER":
            origin, unit = lo, f"({hi} - {lo})"
            bounds = f"{lo} + {low} * ({hi} - {lo})", f"{lo} + {high} * ({hi} - {lo})"
        elif feature == "NONE":
            origin, unit, bounds = "0.0", "0.0", (lo, hi)
        else:
            centre = {
                "ZERO": "0.0",
                "MEAN": mu,
                "MEDIAN": f"(SELECT {v} FROM v ORDER BY {v} LIMIT 1 OFFSET (SELECT n // 2 FROM m))",
                "MODE": f"(SELECT mode FROM ({mode_of('events', c)}) mo)",
            }[feature]
            origin, unit = centre, sd
            bounds = f"{centre} + {low} * {sd}", f"{centre} + {high} * {sd}"
        hit = (
            f"{v} > \"low\" AND {v} < \"high\"" if interval == "INLIER" else f"{v} < \"low\" OR {v} > \"high\""
        )
        return f"""SELECT event_id, '{c}' AS "column", {i} AS col_idx, {v} AS value, "low", "high",
                     CASE WHEN unit = 0 THEN 0.0 ELSE ({v} - origin) / unit END AS deviation
                   FROM (SELECT v.event_id, {v}, {bounds[0]} AS "low", {bounds[1]} AS "high",
                                {origin} AS origin, {unit} AS unit FROM v, m, u WHERE used_{c}) b
                   WHERE {hit}"""

    inner = f"WITH {scaled('events', EVENTS[1:] + EVENTS[:1], ['event_id'])} " + union(
        one(i, c) for i, c in enumerate(EVENTS)
    )
    return show(
        inner,
        ["event_id", "column", "col_idx"],
        sig=["value"],
        places={"low": 6, "high": 6, "deviation": 6},
    )


# ---------------------------------------------------------------- association, distribution

def covariance_r(a: str, b: str) -> str:
    return f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


def correlation(source: str, cols: list[str], lower_only: bool = False) -> str:
    return union(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, {covariance_r(q(a), q(b))} AS r FROM {source} t"
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
        if not lower_only or j < i
    )


def independence(source: str, cols: list[str]) -> str:
    sums = ", ".join(f"sum(abs({c})) AS s_{c}" for c in cols)
    row = " + ".join(f"abs({c})" for c in cols)
    grand = " + ".join(f"s_{c}" for c in cols)
    terms = " + ".join(
        f"pow(abs({c}) - r * s_{c} / ({grand}), 2) / (r * s_{c} / ({grand}))" for c in cols
    )
    return f"""
      WITH s AS (SELECT {sums} FROM {source}), t AS (SELECT *, {row} AS r FROM {source})
      SELECT sum({terms}) FILTER (r > 0) AS statistic,
             (count(*) FILTER (r > 0) - 1) * {len(cols) - 1} AS df, count(*) FILTER (r = 0) AS zero_rows
      FROM t, s"""


def goodness(source: str, col: str) -> str:
    return f"""
      WITH o AS (SELECT {col} - least(0.0, (SELECT min({col}) FROM {source})) AS o FROM {source}),
      s AS (SELECT sum(o) / sum(o + 1) AS scale FROM o)
      SELECT '{col}' AS "column",
             sum(CASE WHEN o + 1 > 0 THEN pow(o - (o + 1) * scale, 2) / ((o + 1) * scale) END) AS statistic,
             count(*) - 1 AS df
      FROM o, s"""


def polynomial(x: str, coefficients) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return f"{text}::DOUBLE"


def normal_cdf(z: str) -> str:
    x = f"abs({z})"
    bell = f"exp(-{x} * {x} / 2)"
    near = f"{bell} * {polynomial(x, tuple(float(c) for c in NORMAL_NUMERATOR))} / {polynomial(x, NORMAL_DENOMINATOR)}"
    fraction = f"({x} + 0.65)"
    for step in (4, 3, 2, 1):
        fraction = f"({x} + {step} / {fraction})"
    tail = f"(CASE WHEN {x} > 37 THEN 0.0 WHEN {x} < {NORMAL_SWITCH} THEN {near} ELSE {bell} / {fraction} / {NORMAL_SCALE} END)"
    return f"CASE WHEN {z} > 0 THEN 1.0 - {tail} ELSE {tail} END"


def ks(source: str, col: str) -> str:
    return f"""
      WITH m AS (SELECT count(*) AS n, avg({col}) AS mu, stddev_samp({col}) AS sd FROM {source}),
      s AS (SELECT ({col}::DOUBLE - mu) / sd AS z, row_number() OVER (ORDER BY {col}) AS i, n FROM {source}, m),
      f AS (SELECT {normal_cdf('z')} AS p, i, n FROM s)
      SELECT '{col}' AS "column", max(greatest(i / n - p, p - (i - 1) / n)) AS statistic, max(n) AS n FROM f"""


def kernel(col: str, source: str, points: str, h: float = 3.0) -> str:
    return f"""
      SELECT '{col}' AS "column", point,
             sum(exp(-0.5 * pow((point - {col}) / {h}, 2))) / (count(*) * {h} * sqrt(2 * pi())) AS density
      FROM {source}, ({points}) g GROUP BY point"""


def ranked(source: str, col: str, place: str) -> str:
    return f"""
      SELECT '{col}' AS "column", max(x) FILTER (i = {place}) AS median
      FROM (SELECT {col}::DOUBLE AS x, row_number() OVER (ORDER BY {col}) AS i, count(*) OVER () AS n FROM {source}) r"""


def bins(source: str, col: str) -> str:
    return f"""
      WITH m AS (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi, floor(sqrt(count(*)))::BIGINT AS nb FROM {source}),
      w AS (SELECT *, (hi - lo) / nb AS width FROM m)
      SELECT '{col}' AS "column", floor(({col} - lo) / width)::BIGINT AS bin, count(*) AS "count",
             any_value(lo) AS lo, any_value(hi) AS hi, any_value(nb) AS nb, any_value(width) AS width
      FROM {source}, w GROUP BY bin"""


def histogram(source: str, cols: list[str]) -> str:
    return union(
        f"""WITH b AS ({bins(source, c)})
            SELECT '{c}' AS "column", e.bin, coalesce(b."count", 0) AS "count"
            FROM (SELECT unnest(range(0, (SELECT max(nb) FROM b) + 1)) AS bin) e LEFT JOIN b ON e.bin = b.bin"""
        for c in cols
    )


def leading_bins(source: str, cols: list[str], order: str) -> str:
    inner = union(
        f"""SELECT "column", CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank,
                   lo + bin * width AS left_edge, "count", nb FROM ({bins(source, c)}) b"""
        for c in cols
    )
    kept = f"SELECT * FROM ({inner}) r WHERE rank <= nb"
    return show(kept, ["column", "rank", "count"], places={"left_edge": 6})


def mode_of(source: str, col: str) -> str:
    return f"""SELECT "column", lo + (hi - lo) * bin / nb AS mode
               FROM ({bins(source, col)}) b ORDER BY "count" DESC, bin LIMIT 1"""


# ---------------------------------------------------------------- anonymizer, generator

def look_alike(text: str, salt: str = "") -> str:
    byte = f"((('0x' || substr(md5('{salt}' || substr({text}, ((i - 1) // 16) * 16 + 1, 16)), ((i - 1) % 16) * 2 + 1, 2))::INTEGER + 128) % 256)"
    return f"""array_to_string(list_transform(string_split({text}, ''), lambda c, i: CASE
        WHEN regexp_full_match(c, '[A-Z]') THEN chr(65 + {byte} % 26)
        WHEN regexp_full_match(c, '[a-z]') THEN chr(97 + {byte} % 26)
        WHEN regexp_full_match(c, '[0-9]') THEN chr(48 + {byte} % 10) ELSE c END), '')"""


def look_alike_long(source: str, key: str, col: str) -> str:
    """The same by sixteen-character pieces, one digest each, for long texts."""
    byte = "((('0x' || substr(digest, i * 2 - 1, 2))::INTEGER + 128) % 256)"
    return f"""
      WITH pieces AS (
        SELECT {key}, pos, substr({col}, pos * 16 + 1, 16) AS piece
        FROM (SELECT {key}, {col}, unnest(range(0, (length({col}) + 15) // 16)) AS pos FROM {source}) p),
      digested AS (SELECT *, md5(piece) AS digest FROM pieces),
      swapped AS (
        SELECT {key}, pos, array_to_string(list_transform(string_split(piece, ''), lambda c, i: CASE
          WHEN regexp_full_match(c, '[A-Z]') THEN chr(65 + {byte} % 26)
          WHEN regexp_full_match(c, '[a-z]') THEN chr(97 + {byte} % 26)
          WHEN regexp_full_match(c, '[0-9]') THEN chr(48 + {byte} % 10) ELSE c END), '') AS piece
        FROM digested)
      SELECT {key}, string_agg(piece, '' ORDER BY pos) AS {col} FROM swapped GROUP BY {key}"""


def draw(key: str, j: int) -> str:
    digest = f"md5('{SEED}|' || {key} || '|{j // 4}')"
    start = 1 if j % 4 < 2 else 17
    first, second = (
        f"((('0x' || substr({digest}, {s}, 8))::BIGINT)::DOUBLE + 1) / 4294967297" for s in (start, start + 8)
    )
    turn = "cos" if j % 2 == 0 else "sin"
    return f"(sqrt(-2 * ln({first})) * {turn}(2 * pi() * {second}))"


def redrawn(source: str, key: str, cols: list[str], whole: set[str]) -> list[str]:
    outs = []
    for j, c in enumerate(cols):
        value = f"{draw(f'{key}::VARCHAR', j)} * (SELECT stddev_samp({c}) FROM {source}) + (SELECT avg({c}) FROM {source})"
        outs.append(f"trunc({value})::BIGINT AS {c}" if c in whole else f"{value} AS {c}")
    return outs


ANONYMIZED = f"""
  SELECT {', '.join(redrawn('customer', 'c_custkey', ['c_custkey', 'c_nationkey', 'c_acctbal'], {'c_custkey', 'c_nationkey'}))},
         {look_alike('c_name')} AS c_name, {look_alike('c_mktsegment')} AS c_mktsegment
  FROM customer"""


def alphabet_pick(digest: str, at: int) -> str:
    index = f"(('0x' || substr({digest}, {at * 2 + 1}, 2))::INTEGER % 32)"
    if at == 0:
        index = f"(CASE WHEN {index} > 23 THEN {index} - 24 ELSE {index} END)"
    return f"substr('ABCDEFGHJKLMNPQRSTUVWXYZ23456789', {index} + 1, 1)"


def synthetic_label(key: str, j: int) -> str:
    digest = f"md5('{SEED}|' || {key} || '|label{j}')"
    whole = " || ".join(alphabet_pick(digest, at) for at in range(13))
    if j == 0:
        return whole
    return f"left({whole}, ('0x' || substr({digest}, 31, 2))::INTEGER % 10 + 4)"


def synthetic() -> str:
    outs = ["o_orderkey"]
    for j, (mean, variance) in enumerate(zip(MEANS, VARIANCES)):
        outs.append(f"{synthetic_label('o_orderkey::VARCHAR', j)} AS label_{j}")
        outs.append(f"{draw('o_orderkey::VARCHAR', j)} * sqrt({variance}::DOUBLE) + {mean} AS num_{j}")
    return f"SELECT {', '.join(outs)} FROM orders"


def _fidelity() -> str:
    sides = f"""
      WITH anonymized AS ({ANONYMIZED}),
      b AS ({summaries('customer', CUSTOMER)}), a AS ({summaries('anonymized', CUSTOMER)})
      SELECT b."column", b.col_idx, b.mean AS mean_before, b.variance AS variance_before,
             a.mean AS mean_after, a.variance AS variance_after,
             a.mean - b.mean AS mean_delta, a.variance - b.variance AS variance_delta
      FROM b JOIN a ON a."column" = b."column\""""
    return show(
        sides,
        ["column", "col_idx"],
        7,
        ["mean_before", "variance_before", "mean_after", "variance_after", "mean_delta", "variance_delta"],
    )


def _synthetic_check() -> str:
    rows = union(
        f"""SELECT 'num_{j}' AS "column", count(*) AS "count", {m}::DOUBLE AS spec_mean, avg(num_{j}) AS mean,
                   {v}::DOUBLE AS spec_variance, var_samp(num_{j}) AS variance,
                   (avg(num_{j}) - {m}) / sqrt({v}::DOUBLE / count(*)) AS mean_error FROM s"""
        for j, (m, v) in enumerate(zip(MEANS, VARIANCES))
    )
    return show(
        f"WITH s AS ({synthetic()}) {rows}",
        ["column", "count"],
        7,
        ["spec_mean", "mean", "spec_variance", "variance", "mean_error"],
    )


REVENUE = "(SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"
WIDE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINEITEM]
WIDE = "(SELECT {}, {}, sqrt(l_extendedprice) AS root_price FROM lineitem)".format(
    ", ".join(WIDE_NUMBERS), ", ".join(f"{c} * l_quantity AS {c}_x_quantity" for c in WIDE_NUMBERS)
)
WIDE_COLUMNS = [*WIDE_NUMBERS, *[f"{c}_x_quantity" for c in WIDE_NUMBERS], "root_price"]
PROFILE_OF_Z = f"""SELECT "column", col_idx, "count", mean, variance, inferred_type
  FROM ({summaries('(' + zscored('customer', [c for c in CUSTOMER if c not in TEXT], ['c_name', 'c_mktsegment']) + ')', CUSTOMER)}) p"""
LABELED = norms("events", EVENTS[1:], ["event_id", "event_type"])



def chi2_tail(inner: str, keep: list[str], places: int = 4) -> str:
    """The cube-root normal approximation of the tail; middle values are good to two decimals."""
    z = "((pow(statistic / df, 1.0 / 3) - 1 + 2.0 / (9 * df)) / sqrt(2.0 / (9 * df)))"
    tail = f"SELECT *, {normal_cdf('-(' + z + ')')} AS p_value FROM ({inner}) s"
    return show(tail, keep, sig=["statistic"], places={"p_value": places})


def ks_tail(inner: str) -> str:
    """The limiting distribution of the statistic, to the two decimals asked for."""
    terms = " + ".join(
        f"{2 * (-1) ** (k - 1)} * exp(-{2 * k * k} * n * statistic * statistic)" for k in range(1, 8)
    )
    tail = f"SELECT *, least(1.0::DOUBLE, {terms}) AS p_value FROM ({inner}) s"
    return show(tail, ["column", "n"], places={"statistic": 9, "p_value": 2})


WORDY = ["words", "mostly_words", "mostly_numbers", "shares"]
WORDY_CUSTOMERS = """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Nan' ELSE 'inf' END AS words,
    CASE WHEN c_custkey % 10 = 0 THEN c_nationkey::VARCHAR ELSE c_name END AS mostly_words,
    CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE c_nationkey::VARCHAR END AS mostly_numbers,
    CASE WHEN c_custkey % 3 = 0 THEN 'NaN' ELSE (c_custkey % 4) || '.25' END AS shares
  FROM customer"""

def ks_finite_tail(inner: str) -> str:
    """The limiting distribution at the root of n times the statistic, corrected for finite n to
    the order of 1 / n; middle values need that with few rows."""
    root = "statistic * sqrt(n)"
    x = f"({root} + 1 / (6 * sqrt(n)) + ({root} - 1) / (4 * n))"
    terms = " + ".join(f"{2 * (-1) ** (k - 1)} * exp(-{2 * k * k} * {x} * {x})" for k in range(1, 8))
    tail = f"SELECT *, least(1.0::DOUBLE, {terms}) AS p_value FROM ({inner}) s"
    return show(tail, ["column", "n"], places={"statistic": 9, "p_value": 2})


ORACLES: dict[str, str] = {
    "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 5",
    "first_row": f"SELECT * FROM ({ORDER_LINES}) l ORDER BY row_id LIMIT 1",
    "row_counts": union(
        [
            "SELECT 'read' AS stage, count(*) AS rows FROM documents",
            f"SELECT 'short' AS stage, count(*) AS rows FROM ({MEASURED}) m WHERE n_fields < {WIDEST}",
            f"SELECT 'rectangular' AS stage, count(*) AS rows FROM ({MEASURED}) m WHERE n_fields = {WIDEST}",
        ]
    ),
    "text_sink_scan": f"SELECT value FROM ({ORDER_LINES}) l",
    "normalized_read_back": show(
        PROFILE_OF_Z, ["column", "col_idx", "count", "inferred_type"], places={"mean": 6, "variance": 6}
    ),
    "norms_read_back": show(LABELED, ["event_id", "event_type"], places={"l1_norm": 6, "l2_norm": 6}),
    "substitute_read_back": show(
        f"WITH anonymized AS ({ANONYMIZED}) {summaries('anonymized', CUSTOMER)}",
        ["column", "col_idx", "count", "inferred_type"],
        7,
        ["mean", "variance", "min", "max"],
    ),
    "documents_read_back": "SELECT * FROM documents",
    "unquote": f"SELECT row_id, value FROM ({MEASURED}) m",
    "field_counts": f"SELECT row_id, CAST(n_fields AS INTEGER) AS n_fields FROM ({MEASURED}) m",
    "field_shape": f"""
      WITH m AS ({MEASURED}), first AS (SELECT * FROM m ORDER BY n_fields DESC, row_id LIMIT 1)
      SELECT count(*) AS n_rows, CAST(min(m.n_fields) AS INTEGER) AS min_fields,
             CAST(max(m.n_fields) AS INTEGER) AS max_fields, min(m.n_fields) <> max(m.n_fields) AS jagged,
             any_value(first.row_id) AS widest_row, any_value(first.value) AS header FROM m, first""",
    "short_rows": f"SELECT row_id, value, CAST(n_fields AS INTEGER) AS n_fields FROM ({MEASURED}) m WHERE n_fields < {WIDEST}",
    "rectangular_rows": f"SELECT row_id, value, CAST(n_fields AS INTEGER) AS n_fields FROM ({MEASURED}) m WHERE n_fields = {WIDEST}",
    "header_removed": f"""
      WITH l AS ({ORDER_LINES}), h AS (SELECT value AS header FROM l ORDER BY row_id LIMIT 1)
      SELECT row_id, split_part(value, ',', 1) AS orderkey, split_part(value, ',', 2) AS custkey,
             split_part(value, ',', 3) AS status, split_part(value, ',', 4) AS totalprice,
             split_part(value, ',', 5) AS priority FROM l, h WHERE value <> header""",
    "detect_header": union(
        [
            detect("customer", "customer", "c_custkey", ["c_name", "c_mktsegment"]),
            detect("orders", "orders", "o_orderkey", ORDERS),
            detect("part", "part", "p_partkey", ["p_partkey", "p_name", "p_brand"]),
        ]
    ),
    "rectangular_table": "SELECT c_custkey AS row_id, {} FROM customer".format(
        ", ".join(f"CAST({c} AS VARCHAR) AS c{i}" for i, c in enumerate(CUSTOMER))
    ),
    "typed_table": "SELECT o_orderkey AS row_id_dropped, * FROM orders",
    "numbers_only": "SELECT o_orderkey, o_custkey::BIGINT AS o_custkey, o_totalprice FROM orders",
    "split_fields": """
      SELECT doc_id AS row_id, CAST(pos - 1 AS INTEGER) AS col_idx, field FROM (
        SELECT doc_id, unnest(string_split(text, ',')) AS field,
               unnest(range(1, len(string_split(text, ',')) + 1)) AS pos FROM documents) f""",
    "lenient_parse": f"""
      SELECT row_id, CAST(pos - 1 AS INTEGER) AS col_idx, coalesce(try_cast(field AS DOUBLE), 0.0) AS value,
             try_cast(field AS DOUBLE) IS NOT NULL AS parsed FROM (
        SELECT row_id, unnest(string_split(value, ',')) AS field,
               unnest(range(1, len(string_split(value, ',')) + 1)) AS pos FROM ({CUSTOMER_LINES}) l) f""",
    "vectorize": union(
        f"SELECT p_partkey, {i} AS pos, {c}::DOUBLE AS value FROM part" for i, c in enumerate(PART)
    ),
    "sentinel_append": f"SELECT row_id, value || ',No Data' AS value, {len(CUSTOMER) + 1} AS n_fields FROM ({CUSTOMER_LINES}) l",
    "sentinel_drop": "SELECT c_custkey AS row_id, {} FROM customer".format(
        ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CUSTOMER)
    ),
    "profile_lineitem": profile("lineitem", LINEITEM),
    "profile_orders": profile("orders", ORDERS),
    "profile_part": profile("part", PART),
    "profile_events": profile("events", EVENTS),
    "profile_customer": profile("customer", CUSTOMER),
    "infer_types_exact": types("customer", CUSTOMER, EXACT),
    "infer_types_coarse": types("lineitem", LINEITEM, COARSE),
    "infer_types_label": types("orders", ORDERS, LABEL),
    "skewness_kurtosis": show(
        summaries("lineitem", LINEITEM, True), ["column"], places={"skewness": 8, "kurtosis": 8}
    ),
    "raw_moments": show(
        summaries("lineitem", LINEITEM, True), ["column"], sig=["raw_moment3", "raw_moment4_minus3"]
    ),
    "correlation_matrix": show(correlation("lineitem", LINEITEM), ["col_i", "col_j"], places={"r": 8}),
    "correlation_matrix_wide": show(correlation(WIDE, WIDE_COLUMNS), ["col_i", "col_j"], places={"r": 7}),
    "correlated_pairs": show(
        f"SELECT * FROM ({correlation('lineitem', LINEITEM, True)}) c WHERE abs(r) >= 0.001",
        ["col_i", "col_j"],
        places={"r": 8},
    ),
    "correlated_pairs_half": show(
        f"SELECT * FROM ({correlation(REVENUE, [*LINEITEM, 'revenue'], True)}) c WHERE abs(r) >= 0.5",
        ["col_i", "col_j"],
        places={"r": 8},
    ),
    "chi2_independence": show(
        independence("part", ["p_size", "p_retailprice"]), ["df", "zero_rows"], sig=["statistic"]
    ),
    "chi2_goodness_of_fit": show(
        union(goodness("customer", c) for c in ("c_nationkey", "c_acctbal")), ["column", "df"], sig=["statistic"]
    ),
    "ks_normal_events": show(
        union(ks("events", c) for c in ("user_id", "value")), ["column", "n"], places={"statistic": 9}
    ),
    "chi2_independence_p_value": chi2_tail(
        independence("part", ["p_size", "p_retailprice"]), ["df", "zero_rows"]
    ),
    "chi2_goodness_of_fit_p_value": chi2_tail(
        union(goodness("customer", c) for c in ("c_nationkey", "c_acctbal")), ["column", "df"]
    ),
    "ks_normal_p_value": ks_tail(union(ks("events", c) for c in ("user_id", "value"))),
    "ks_normal_lineitem": show(
        union(ks("lineitem", c) for c in LINEITEM), ["column", "n"], places={"statistic": 9}
    ),
    "kernel_density_points": show(
        union(
            kernel(c, "events", "SELECT unnest([0.0, 25.0, 50.0, 75.5])::DOUBLE AS point")
            for c in ("value", "user_id")
        ),
        ["column", "point"],
        places={"density": 10},
    ).replace('"point"', "point"),
    "kernel_density_grid": show(
        union(
            kernel(
                c,
                "events",
                "SELECT i * root AS point FROM (SELECT unnest(range(0, floor(sqrt(count(*)))::BIGINT)) AS i, "
                "floor(sqrt(count(*)))::DOUBLE AS root FROM events) r",
            )
            for c in ("value", "user_id")
        ),
        ["column"],
        sig=["point"],
        places={"density": 10},
    ),
    "kernel_density_threshold": show(
        "SELECT * FROM ({}) d WHERE density >= 0.01".format(
            union(
                kernel(c, "part", "SELECT unnest(range(0, count(*)))::DOUBLE AS point FROM part")
                for c in ("p_size", "p_retailprice")
            )
        ),
        ["column"],
        sig=["point"],
        places={"density": 9},
    ),
    "median_upper": union(ranked("lineitem", c, "n // 2 + 1") for c in LINEITEM),
    "median_by_rounds": union(ranked("lineitem", c, "n // 2 + 1") for c in LINEITEM),
    "median_lower": union(ranked("events", c, "n // 2") for c in ("user_id", "value")),
    "histogram": histogram("events", ["user_id", "value"]),
    "histogram_orders": histogram("orders", ["o_custkey", "o_totalprice"]),
    "histogram_edges": leading_bins("events", ["user_id", "value"], "bin"),
    "mode": show(union(mode_of("events", c) for c in ("user_id", "value")), ["column"], sig=["mode"]),
    "ranked_modes": leading_bins("orders", ["o_custkey", "o_totalprice"], '"count" DESC, bin'),
    "zscore": show(
        zscored("lineitem", LINEITEM, ["l_orderkey", "l_returnflag"]),
        ["l_orderkey", "l_returnflag"],
        places={c: 5 for c in LINEITEM},
    ),
    "row_norms": show(CUSTOMER_NORMS, ["c_custkey", "zeros"], places=NORM_PLACES),
    "labeled_norms": show(LABELED, ["event_id", "event_type"], places={"l1_norm": 6, "l2_norm": 6}),
    "extreme_rows_smallest": extreme("smallest"),
    "extreme_rows_largest": extreme("largest"),
    "norms_sorted": show(CUSTOMER_NORMS, ["c_custkey"], places={"l1_norm": 6}),
    "scan_inlier": scan("INLIER", "NONE", 0.2, 0.8),
    "scan_outlier_zero": scan("OUTLIER", "ZERO", -1.0, 2.0),
    "scan_outlier_mean": scan("OUTLIER", "MEAN", -1.5, 1.5),
    "scan_outlier_median": scan("OUTLIER", "MEDIAN", -3.0, 3.0),
    "scan_outlier_mode": scan("OUTLIER", "MODE", -1.0, 3.0),
    "scan_outlier_none": scan("OUTLIER", "NONE", -3.0, 3.0),
    "scan_fallback_options": scan("INLIER", "NONE", 0.2, 0.8),
    "md5_digest": "SELECT doc_id, md5(text) AS digest FROM documents",
    "look_alike_names": f"SELECT c_custkey, {look_alike('c_name')} AS c_name, {look_alike('c_mktsegment')} AS c_mktsegment FROM customer",
    "look_alike_documents": look_alike_long("documents", "doc_id", "text"),
    "gaussian_substitution": show(
        f"SELECT o_orderkey, {', '.join(redrawn('orders', 'o_orderkey', ['o_custkey', 'o_totalprice'], {'o_custkey'}))} FROM orders",
        ["o_orderkey", "o_custkey"],
        8,
        ["o_totalprice"],
    ),
    "anonymized_rows": show(
        ANONYMIZED, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], 8, ["c_acctbal"]
    ),
    "fidelity": _fidelity(),
    "synthetic_rows": show(
        synthetic(), ["o_orderkey", "label_0", "label_1", "label_2"], places={f"num_{j}": 7 for j in range(3)}
    ),
    "synthetic_check": _synthetic_check(),
}


def feature_finder() -> str:
    parts = []
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        middle = f"""(SELECT x FROM (SELECT {c}::DOUBLE AS x, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n
                      FROM orders) v WHERE r = n // 2 + 1)"""
        parts += [
            f"SELECT 'mean' AS part, '{c}' AS name, avg({c})::DOUBLE AS value FROM orders",
            f"SELECT 'stddev', '{c}', stddev_samp({c}) FROM orders",
            f"SELECT 'median', '{c}', {middle}",
        ]
        if c == "o_totalprice":
            bound = f"abs({c} - {middle}) > (SELECT stddev_samp({c}) FROM orders)"
            parts.append(f"SELECT 'hits', '{c}', count(*)::DOUBLE FROM orders WHERE {bound}")
    parts.append("SELECT 'norms', 'rows', count(*)::DOUBLE FROM orders")
    return show(union(parts), ["part", "name"], sig=["value"])


def anonymizer_program() -> str:
    parts = []
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        parts.append(f"SELECT 'mean' AS part, '{c}' AS name, avg({c})::DOUBLE AS value FROM orders")
        parts.append(f"SELECT 'variance', '{c}', var_samp({c}) FROM orders")
    name = f"{look_alike('o_orderstatus')} || '|' || {look_alike('o_orderpriority')}"
    parts.append(f"SELECT 'texts', {name}, count(*)::DOUBLE FROM orders GROUP BY ALL")
    return show(union(parts), ["part", "name"], 7, ["value"])


def words_among_numbers() -> str:
    """At least half of a column must be numbers; words among numbers count as zero."""
    parts = []
    for i, col in enumerate(WORDY):
        value = f"CASE WHEN regexp_full_match({col}, '-?[0-9.]+') THEN {col}::DOUBLE END"
        parts.append(f"""SELECT '{col}' AS "column", {i} AS col_idx,
            CASE WHEN 2 * count(v) < count(*) OR bool_and(coalesce(v, 0) = 0) THEN 'String'
                 WHEN bool_and(coalesce(v, 0) = trunc(coalesce(v, 0))) THEN 'Int' ELSE 'Double' END AS inferred_type,
            count(v) / count(*) AS parse_rate
          FROM (SELECT {value} AS v FROM ({WORDY_CUSTOMERS}) c) x""")
    return union(parts)


def not_finite_left_out() -> str:
    value = "CASE WHEN c_custkey % 7 > 2 THEN c_acctbal ELSE 0.0 END"
    inner = f"""SELECT 'balance' AS "column", count(*) AS "count", count(*) FILTER (c_custkey % 7 > 2) AS parsed,
        avg({value}) AS mean, var_samp({value}) AS variance, min({value}) AS min, max({value}) AS max FROM customer"""
    return show(inner, ["column", "count", "parsed"], sig=["mean", "variance", "min", "max"])


ORACLES["infer_types_words"] = words_among_numbers()
ORACLES["profile_not_finite"] = not_finite_left_out()
ORACLES["look_alike_salted"] = f"SELECT c_custkey, {look_alike('c_name', 'grain')} AS c_name FROM customer"
ORACLES["norms_sorted_rank"] = f"""SELECT c_custkey, row_number() OVER (ORDER BY l1_norm DESC, c_custkey DESC) AS rank
  FROM ({CUSTOMER_NORMS}) n"""
ORACLES["ks_normal_p_value_draws"] = ks_finite_tail(
    f"WITH draws AS ({synthetic()}) " + union(f"SELECT * FROM ({ks('draws', f'num_{j}')}) k" for j in range(3))
)
ORACLES["chi2_independence_of_counts"] = chi2_tail(
    independence(
        "(SELECT {} FROM customer GROUP BY c_nationkey)".format(
            ", ".join(f"count(*) FILTER (c_mktsegment = '{s}')::DOUBLE AS n{i}" for i, s in enumerate(SEGMENTS))
        ),
        [f"n{i}" for i in range(len(SEGMENTS))],
    ),
    ["df", "zero_rows"],
    places=2,
)
HITS = scan("OUTLIER", "MEAN", -1.0, 1.0)
ORACLES["scan_rows_ranked"] = f"""SELECT event_id, "column", row_number() OVER (ORDER BY event_id, col_idx) AS rank FROM ({HITS}) h"""
ORACLES["scan_columns_ranked"] = f"""SELECT event_id, "column", row_number() OVER (ORDER BY col_idx, event_id) AS rank FROM ({HITS}) h"""
ORACLES["feature_finder"] = feature_finder()
ORACLES["anonymizer_program"] = anonymizer_program()
ORACLES["data_maker_program"] = union(
    f"""SELECT 'num_{j}' AS "column", count(*) AS "count", {m}::DOUBLE AS spec_mean, {v}::DOUBLE AS spec_variance,
               true AS mean_is_near, true AS variance_is_near, 5::BIGINT AS n_preview FROM orders"""
    for j, (m, v) in enumerate(zip(MEANS, VARIANCES))
)
# The typed table keeps the line's names, not the source's.
ORACLES["typed_table"] = (
    "SELECT o_orderkey AS c0, o_custkey::BIGINT AS c1, o_orderstatus AS c2, o_totalprice AS c3, "
    "o_orderpriority AS c4 FROM orders"
)
