"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

#: Words and their windows of every document; ``r`` numbers rows, for ids may repeat.
_WORDS = r"""
    docs AS (
        SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS ws
        FROM documents
    ),
    words AS (SELECT r, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM docs),
    windows AS (
        SELECT r, p, md5(array_to_string(ws[p:p + {size} - 1], ' ')) AS k
        FROM (SELECT r, ws, unnest(range(1, len(ws) - {size} + 2)) AS p FROM docs)
    ),
"""

QUALITY = (
    "WITH "
    + _WORDS.format(size=8)
    + r"""
    twice AS (SELECT r, k FROM windows GROUP BY r, k HAVING count(*) > 1),
    starts AS (SELECT r, p FROM windows SEMI JOIN twice USING (r, k)),
    repeats AS (
        SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM starts) GROUP BY r
    ),
    counted AS (
        SELECT r, doc_id, lang, source, len(ws) AS n_words,
               length(array_to_string(ws, '')) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls
        FROM docs
    ),
    measured AS (
        SELECT r, doc_id, lang, source, n_words, word_chars, n_symbols, len(ls) AS n_lines,
               len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
               n_words < 20 OR 100 * coalesce(n, 0) > 30 * n_words AS base_failed
        FROM counted LEFT JOIN repeats USING (r)
    ),
    -- Each rate with the least width of its band; lengths have a lower limit too.
    rates AS (
        SELECT r, lang, source, base_failed, 'symbols' AS rate, 60 AS least, false AS low,
               CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars END AS v FROM measured
        UNION ALL SELECT r, lang, source, base_failed, 'length', 400, true,
               CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END FROM measured
        UNION ALL SELECT r, lang, source, base_failed, 'lines', 250, false,
               CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END FROM measured
        UNION ALL SELECT r, lang, source, base_failed, 'repeats', 200, false,
               CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END FROM measured
    ),
    -- A bucket is named by its highest value: six leading binary digits are kept.
    tops AS (
        SELECT lang, source, rate, least, v | ((1::BIGINT << greatest(0, length(bin(v)) - 6)) - 1) AS top
        FROM rates WHERE NOT base_failed
    ),
    counts AS (SELECT lang, source, rate, top, count(*)::HUGEINT AS n FROM tops GROUP BY ALL),
    groups AS (SELECT lang, source, rate, any_value(least) AS least FROM tops GROUP BY lang, source, rate),
    sizes AS (SELECT lang, rate, sum(n)::HUGEINT AS size_l, count(DISTINCT coalesce('=' || source, ''))::HUGEINT AS sources FROM counts GROUP BY lang, rate),
    whole AS (SELECT rate, sum(size_l)::HUGEINT AS size_all, count(*)::HUGEINT AS langs FROM sizes GROUP BY rate),
    corpus AS (SELECT rate, top, sum(n)::HUGEINT AS n_all FROM counts GROUP BY rate, top),
    -- A language's sketch and a quarter of an average language of the corpus; of a group and its language alike.
    by_lang AS (
        SELECT s.lang, s.rate, c.top, size_l, sources, 4 * langs * coalesce(n_l, 0) + n_all AS m, 4 * langs * size_l + size_all AS size_m
        FROM sizes AS s JOIN whole USING (rate) JOIN corpus AS c USING (rate)
             LEFT JOIN (SELECT lang, rate, top, sum(n)::HUGEINT AS n_l FROM counts GROUP BY lang, rate, top) AS x
               ON x.lang IS NOT DISTINCT FROM s.lang AND x.rate = s.rate AND x.top = c.top
    ),
    weighed AS (
        SELECT g.lang, g.source, g.rate, g.least, b.top, 4 * sources * size_m * coalesce(n, 0) + size_l * m AS w
        FROM groups AS g JOIN by_lang AS b ON b.lang IS NOT DISTINCT FROM g.lang AND b.rate = g.rate
             LEFT JOIN counts AS x
               ON x.lang IS NOT DISTINCT FROM g.lang AND x.source IS NOT DISTINCT FROM g.source AND x.rate = g.rate AND x.top = b.top
    ),
    ranked AS (
        SELECT *, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY top) AS upto, sum(w) OVER (PARTITION BY lang, source, rate) AS total
        FROM weighed
    ),
    limits AS (
        SELECT lang, source, rate, q1 - greatest(4 * (q3 - q1), least) AS below, q3 + greatest(4 * (q3 - q1), least) AS above
        FROM (
            SELECT lang, source, rate, any_value(least) AS least,
                   min(top) FILTER (4 * upto >= total) AS q1, min(top) FILTER (4 * upto >= 3 * total) AS q3
            FROM ranked GROUP BY lang, source, rate
        )
    ),
    decided AS (
        SELECT r, bool_and(coalesce(v <= above, true) AND (NOT low OR coalesce(v >= below, true))) AS within
        FROM rates AS x LEFT JOIN limits AS y
          ON x.rate = y.rate AND x.lang IS NOT DISTINCT FROM y.lang AND x.source IS NOT DISTINCT FROM y.source
        GROUP BY r
    )
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND within AS kept
    FROM measured JOIN decided USING (r)
"""
)

REPEATS = (
    "WITH "
    + _WORDS.format(size=35)
    + r"""
    twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
    starts AS (SELECT r, p, 1 AS hit FROM windows SEMI JOIN twice USING (k)),
    covered AS (
        SELECT r, p, word, max(hit) OVER (PARTITION BY r ORDER BY p ROWS 34 PRECEDING) IS NOT NULL AS gone
        FROM words LEFT JOIN starts USING (r, p)
    ),
    kept AS (
        SELECT r, count(*) AS n, count(*) FILTER (gone) AS n_removed,
               coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS rest
        FROM covered GROUP BY r
    )
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
           sha256(coalesce(rest, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (r)
"""
)


# The five constants of XXH64.
_P1, _P2, _P3 = 11400714785074694791, 14029467366897019727, 1609587929392839161
_P4, _P5 = 9650029242287828579, 2870177450012600261
# CRC-32 remainders of the sixteen half bytes.
_CRC = (
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
)


def _wrapped(value: str) -> str:
    return f"(({value}) % 18446744073709551616::UHUGEINT)"


def _times(a: str, b: int) -> str:
    return _wrapped(f"({a}) * {b}::UHUGEINT")


def _plus(a: str, b: int) -> str:
    return _wrapped(f"({a}) + {b}::UHUGEINT")


def _turned(a: str, bits: int) -> str:
    """Rotated to the left."""
    return f"({_wrapped(f'{a} * {1 << bits}::UHUGEINT')} + {a} // {1 << (64 - bits)}::UHUGEINT)"


def _steps(source: str, *steps: str) -> str:
    """``h`` put through every step, each in a select of its own."""
    for step in steps:
        source = f"(SELECT * REPLACE ({step} AS h) FROM {source})"
    return source


def _finished(source: str) -> str:
    return _steps(
        source,
        _times(f"xor(h, h // {1 << 33}::UHUGEINT)", _P2),
        _times(f"xor(h, h // {1 << 29}::UHUGEINT)", _P3),
        f"xor(h, h // {1 << 32}::UHUGEINT)",
    )


def _four_bytes(source: str, value: str, length: int) -> str:
    """The step of XXH64 for the four bytes of ``value``, at the start of ``length`` bytes."""
    return _steps(
        source,
        f"xor({_plus('h', _P5 + length & (1 << 64) - 1)}, {_times(value, _P1)})",
        _plus(_times(_turned("h", 23), _P2), _P3),
    )


def _shards() -> str:
    """Shards 0 to 15, and 0 to 16, by the highest draw, the lower number among equals; with equal
    weights the highest draw has the highest score. Slots follow blocks of keys by hash."""
    keys = _steps(
        "(SELECT DISTINCT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id END)::UHUGEINT AS h FROM documents)",
        _times("h", _P2),
        _times(_turned("h", 31), _P1),
        f"xor({42 + _P5 + 8}::UHUGEINT, h)",
        _plus(_times(_turned("h", 27), _P1), _P4),
    )
    draws = _finished(_four_bytes("(SELECT doc_id, h, unnest(range(17)) AS i FROM keys)", "i::UHUGEINT", 4))
    word, rest = int.from_bytes(b"bloc", "little"), ord("k")
    blocks = _finished(
        _steps(
            _four_bytes("keys", f"{word}::UHUGEINT", 5),
            f"xor(h, {_times(f'{rest}::UHUGEINT', _P5)})",
            _times(_turned("h", 11), _P1),
        )
    )
    table = "[" + ", ".join(f"{c}::BIGINT" for c in _CRC) + "]"
    half = lambda x: f"xor({table}[({x} & 15) + 1], {x} >> 4)"
    crc = f"""list_reduce(regexp_extract_all(hex(encode(t)), '..'),
        lambda c, b: {half(half("xor(c, ('0x' || b)::BIGINT)"))}, 4294967295::BIGINT)"""
    return f"""
    WITH keys AS MATERIALIZED (SELECT * FROM {_finished(keys)}),
    draws AS MATERIALIZED (SELECT doc_id, i, h // 2048::UHUGEINT AS draw FROM {draws}),
    picked AS (
        SELECT doc_id, max_by(i, (draw, -i)) FILTER (i < 16) AS shard, max_by(i, (draw, -i)) AS grown FROM draws GROUP BY doc_id
    ),
    blocks AS (
        SELECT doc_id, (h::HUGEINT - CASE WHEN h >= {1 << 63} THEN 18446744073709551616::HUGEINT ELSE 0 END) AS h,
               greatest(64, (SELECT count(*) FROM documents) // 1600000) AS n
        FROM {blocks}
    ),
    sized AS (SELECT doc_id, octet_length(encode(t)) + 1 AS size, xor({crc}, 4294967295) AS crc
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
    SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY ((h % n) + n) % n, doc_id, size, crc) - 1 AS slot,
           grown::INTEGER AS grown_shard
    FROM sized JOIN picked USING (doc_id) JOIN blocks USING (doc_id)
    """


#: Shares and their gaps in whole numbers of 128 bits.
DIVERGENCE = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
        FROM documents
    ),
    tokens AS (
        SELECT r, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
        FROM docs
    ),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
    sums AS (SELECT lang, source, sum(n)::HUGEINT AS group_n FROM counts GROUP BY lang, source),
    shares AS (
        SELECT lang, source, term, coalesce(n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(group_n, 0) + v) AS p,
               1 + (1000000000::HUGEINT * (total + 1)) // (lang_n + v) AS q
        FROM groups JOIN kept USING (lang) JOIN sizes USING (lang)
             LEFT JOIN sums USING (lang, source) LEFT JOIN counts USING (lang, source, term)
    ),
    pairs AS (
        SELECT lang, a.source, b.source AS item, coalesce(gap, 0) AS value
        FROM groups AS a JOIN groups AS b USING (lang)
             LEFT JOIN (
                 SELECT x.lang AS l, x.source AS s, y.source AS t, sum((x.p - y.p) * (x.p - y.p) // y.p) AS gap
                 FROM shares AS x JOIN shares AS y ON x.lang = y.lang AND x.term = y.term
                 GROUP BY x.lang, x.source, y.source
             ) ON lang = l AND a.source = s AND b.source = t
        WHERE a.source <> b.source
    ),
    terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', item, value FROM terms
        )
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
    FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {
    "op2_quality_rules": QUALITY,
    "op4_rendezvous_shards": _shards(),
    "op6_substring_dedup": REPEATS,
    "op13_source_divergence": DIVERGENCE,
}
