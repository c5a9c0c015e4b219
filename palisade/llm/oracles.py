"""SQL that gives the same rows as the registered queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: words of a text; \x20 and the control characters from tab to return separate them
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]'))"


def _quality_rules() -> str:
    from .quality_rules import BITS, GAP, LADDER, MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, NO_FENCE, REACH, RULES, WINDOW

    values = ", ".join(f"('{m}', {m})" for m in RULES)
    kinds = " ".join(f"WHEN '{m}' THEN '{kind}'" for m, kind in RULES.items())
    both = ", ".join(f"'{m}'" for m, kind in RULES.items() if kind == "both")
    shares = [250, *LADDER]
    spread = lambda t: f"least({t}.q500 - {t}.q250, {t}.q750 - {t}.q500)"
    either = lambda t: f"CASE WHEN {spread(t)} = 0 THEN greatest({t}.q500 - {t}.q250, {t}.q750 - {t}.q500) ELSE {spread(t)} END"

    def level(name: str, keys: list[str], bins: str) -> str:
        k = "".join(f"{x}, " for x in keys)
        at = ", ".join(f"min(bin) FILTER (1000 * below >= {x} * total) AS q{x}" for x in shares)
        return f"""{name} AS (SELECT {k}measure, max(total) AS total, {at}
            FROM (SELECT *, sum(n) OVER (PARTITION BY {k}measure) AS total, sum(n) OVER (PARTITION BY {k}measure ORDER BY bin) AS below
                  FROM (SELECT {k}measure, bin, sum(n) AS n FROM {bins} GROUP BY ALL)) GROUP BY {k}measure)"""

    def chosen(name: str, mark: str, flat: bool) -> str:
        usable = lambda t: f"{t}.total >= {MIN_GROUP}" + (f" AND NOT (f.measure IN ({both}) AND {either(t)} = 0)" if flat else "")
        picks = ", ".join(f"CASE WHEN {usable('g')} THEN g.q{x} WHEN {usable('l')} THEN l.q{x} ELSE a.q{x} END AS q{x}" for x in shares)
        return f"""{name} AS (SELECT f.lang, f.source, f.measure, {picks} FROM (SELECT DISTINCT lang, source, measure FROM bins) f
            LEFT JOIN {mark}g g ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source AND f.measure = g.measure
            LEFT JOIN {mark}l l ON f.lang IS NOT DISTINCT FROM l.lang AND f.measure = l.measure LEFT JOIN {mark}a a ON f.measure = a.measure)"""

    tables = [level(f"{mark}{name}", keys, bins) for mark, bins in (("w", "bins"), ("s", "some_bins")) for name, keys in (("g", ["lang", "source"]), ("l", ["lang"]), ("a", []))]
    steps = ", ".join(f"{{'ratio': (q{y} + 1) // (q{x} + 1), 'fence': floor(sqrt((q{x} + 1) * (q{y} + 1)))}}" for x, y in zip(LADDER, LADDER[1:], strict=False))
    width = lambda c: f"{c} // {1 << (BITS - 1)} + 1"
    return f"""
    WITH words AS (SELECT row_number() OVER () AS r, doc_id, text, lang, source, {_WORDS} AS w, {_LINES} AS ln FROM documents),
    spots AS (SELECT r, len(w) AS n, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) > {WINDOW}),
    wins AS (SELECT r, i, count(*) OVER (PARTITION BY r, hash(list_slice(w, i, i + {WINDOW - 1}))) AS c FROM spots),
    cover AS (SELECT r, sum(least({WINDOW}, coalesce(following - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM wins WHERE c > 1) GROUP BY r),
    base AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
        FROM words w LEFT JOIN cover c ON w.r = c.r),
    m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbol_rate,
        CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_rate FROM base),
    vals AS (SELECT r, lang, source, measure, v FROM m CROSS JOIN LATERAL (VALUES {values}) AS x(measure, v) WHERE NOT base_failed),
    bins AS (SELECT lang, source, measure, (v >> greatest(0, length(bin(v)) - {BITS})) << greatest(0, length(bin(v)) - {BITS}) AS bin, count(*) AS n FROM vals GROUP BY ALL),
    some_bins AS (SELECT * FROM bins WHERE bin > 0),
    {', '.join(tables)}, {chosen('whole', 'w', True)}, {chosen('few', 's', False)},
    marks AS (SELECT w.*, CASE w.measure {kinds} END AS kind, {spread('w')} AS spread, list_max([{steps}]) AS step FROM whole w),
    fences AS (SELECT m.lang, m.source, m.measure, CASE WHEN kind = 'both' THEN m.q500 - greatest({REACH} * ({either('m')}), {width('m.q500')}) ELSE -1 END AS low,
        CASE WHEN kind = 'both' THEN m.q500 + greatest({REACH} * ({either('m')}), {width('m.q500')}) WHEN spread > 0 THEN m.q500 + {REACH} * spread
            WHEN kind = 'apart' THEN CASE WHEN step.ratio >= {GAP} THEN step.fence ELSE {NO_FENCE} END
            ELSE coalesce(s.q500 + greatest({REACH} * ({either('s')}), {width('s.q500')}), {NO_FENCE}) END AS high
        FROM marks m LEFT JOIN few s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source AND m.measure = s.measure),
    bad AS (SELECT DISTINCT r FROM vals v JOIN fences f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.measure = f.measure
        WHERE v.v > high OR v.v < low)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept, n_lines, word_length, symbol_rate, dup_line_rate, repeat_rate FROM m
    """


ORACLES["op3_quality_rules"] = _quality_rules()


def _sharding(shards: int = 8) -> str:
    draw = lambda k: f"CAST('0x' || substr(md5('{k}:' || key), 1, 13) AS BIGINT)"
    best = lambda n: f"list_position([{', '.join(draw(k) for k in range(n))}], greatest({', '.join(draw(k) for k in range(n))})) - 1"
    return f"""
    WITH steps AS (SELECT CAST(i AS BIGINT) AS i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
    crc AS (SELECT list(v ORDER BY i) AS t FROM steps),
    docs AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, encode(coalesce(text, '')) AS b FROM documents),
    sums AS (SELECT doc_id, key, octet_length(b) + 1 AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM docs, crc),
    placed AS (SELECT *, {best(shards)} AS shard, {best(shards + 1)} AS grown_shard FROM sums)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
        row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key), 14, 3), md5(key), text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard, shard <> grown_shard AS moved FROM placed
    """


ORACLES["op8_rendezvous_sharding"] = _sharding()


def _filter_audit() -> str:
    from .filter_audit import CAPITAL_PERCENT, DISTINCT_PERCENT, FILTERS, MIN_WORDS, SYMBOLS

    letters = ", ".join(f"('{x}')" for x in FILTERS)
    orders = " ".join(f"JOIN letters l{k} ON l{k}.x NOT IN ({', '.join(f'l{j}.x' for j in range(k))})" for k in range(1, 5))
    order = " || ".join(f"l{k}.x" for k in range(5))
    gone = " ".join(f"WHEN contains(fails, substr(filter_order, {k}, 1)) THEN {k}" for k in range(1, 6))
    return f"""
    WITH letters(x) AS (VALUES {letters}),
    orders AS (SELECT {order} AS filter_order FROM letters l0 {orders}),
    marks AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
    docs AS (SELECT d.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
        CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END
        || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
        FROM words d LEFT JOIN marks m ON d.doc_id = m.doc_id),
    kinds AS (SELECT part, good, toxic, fails, count(*) AS n FROM docs GROUP BY ALL),
    steps AS (SELECT CAST(i AS INTEGER) AS step FROM range(1, 6) t(i)),
    lost AS (SELECT *, CASE {gone} ELSE 6 END AS gone FROM kinds CROSS JOIN orders),
    counts AS (SELECT part, filter_order, step, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
        sum(n) FILTER (gone < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, sum(n) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
        sum(n) FILTER (gone = step AND good) AS good_lost, sum(n) FILTER (gone = step AND toxic) AS toxic_lost FROM lost CROSS JOIN steps GROUP BY ALL)
    SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
        CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
        CAST(coalesce(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)), 0) AS BIGINT) AS shapley FROM counts
    """


ORACLES["op11_filter_audit"] = _filter_audit()
