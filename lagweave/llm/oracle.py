"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op6_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (SELECT c.*, r.verdict, r.h || r.p AS rule FROM cut c LEFT JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule) DESC NULLS LAST) AS k FROM hit)
SELECT page_id, url, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""

SQL["op11_ranked_search"] = r"""
WITH found AS (
  SELECT d.k, d.doc_id, translate(u.t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents) d, unnest(regexp_extract_all(d.text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) u(t)),
post AS (SELECT k, doc_id, t, count(*) AS tf FROM found GROUP BY ALL),
size AS (SELECT k, sum(tf)::BIGINT AS n FROM post GROUP BY k),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM size),
freq AS (SELECT t, count(*) AS df FROM post GROUP BY t),
asked AS (
  SELECT i.j, i.item_id, translate(u.t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT row_number() OVER () AS j, item_id, text FROM benchmark) i, unnest(regexp_extract_all(i.text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) u(t)),
term AS (SELECT j, item_id, t, count(*) AS q FROM asked GROUP BY ALL),
hit AS (
  SELECT j, item_id, k, doc_id, q * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // len))) AS s
  FROM term JOIN freq USING (t) JOIN post USING (t) JOIN size USING (k), whole),
total AS (SELECT j, item_id, k, doc_id, sum(s)::BIGINT AS score FROM hit GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS rank FROM total WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

SQL["op10_quality_rules"] = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, ws[i:i + 7] AS g FROM w, unnest(range(1, len(ws) - 6)) u(i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
gap AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM rep WHERE c > 1),
r AS (SELECT doc_id, sum(n) AS n FROM gap GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
m AS (SELECT *, least(coalesce(1000 * word_chars // nullif(n_words, 0), 0), 100000) AS v1, least(coalesce(1000 * n_symbols // nullif(word_chars, 0), 0), 1000000) AS v2,
        least(coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0), 1000000) AS v3, least(coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0), 1000000) AS v4 FROM b),
q AS (SELECT *, {windows} FROM m),
lim AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, v1, v2, v3, v4, {limits} FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND v1 >= low1 AND v1 <= high1 AND v2 <= high2 AND v3 <= high3 AND v4 <= high4 AS kept FROM lim
"""


def _quality_sql() -> str:
    levels = {"a": "PARTITION BY lang, source", "b": "PARTITION BY lang", "c": ""}
    windows = [f"count(*) OVER ({by}) AS n_{k}" for k, by in levels.items()]
    windows += [f"quantile_disc(v{m}, {q}) OVER ({by}) AS q{q[2:]}_{m}_{k}" for k, by in levels.items() for m in (1, 2, 3, 4) for q in ("0.25", "0.5", "0.75")]
    slack, limits = {1: 2500, 2: 50, 3: 500, 4: 300}, []

    def pick(make) -> str:
        return f"CASE WHEN n_a >= 200 THEN {make('a')} WHEN n_b >= 200 THEN {make('b')} ELSE {make('c')} END"

    for m, s in slack.items():
        limits.append(pick(lambda k: f"q5_{m}_{k} + greatest(6 * (q75_{m}_{k} - q5_{m}_{k}), {s})") + f" AS high{m}")  # noqa: B023
    limits.append(pick(lambda k: f"q5_1_{k} - greatest(6 * (q5_1_{k} - q25_1_{k}), {slack[1]})") + " AS low1")
    return SQL["op10_quality_rules"].format(windows=",\n  ".join(windows), limits=",\n  ".join(limits))


SQL["op10_quality_rules"] = _quality_sql()


def _tails_sql() -> str:
    """The counts of op10_quality_rules, judged by tails: quantiles of the rows that pass the base rules, and votes of the sources."""
    counts = SQL["op10_quality_rules"].partition("\nq AS (")[0]
    levels, metrics, failed = {"la": "lang, source", "lb": "lang", "lc": ""}, (1, 2, 3, 4), "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    columns = "count(*) AS n, " + ", ".join(
        f"quantile_disc(v{m}, 0.5) AS mid{m}, quantile_disc(v{m}, 0.99) - mid{m} AS up{m}, mid{m} - quantile_disc(v{m}, 0.01) AS down{m}" for m in metrics)
    sides = [(m, d) for m in metrics for d in ("up", "down")]
    made = [f"{k} AS (SELECT {by + ', ' if by else ''}{columns} FROM ok{' GROUP BY ' + by if by else ''})" for k, by in levels.items()]
    middle = ", ".join(f"quantile_disc({d}{m}, 0.5) AS {d}{m}" for m, d in sides)
    made += [f"vb AS (SELECT lang, {middle} FROM la WHERE n >= 200 GROUP BY lang HAVING count(*) >= 3)", f"vc AS (SELECT {middle} FROM la WHERE n >= 200 HAVING count(*) >= 3)"]
    pick = lambda x: f"CASE WHEN la.n >= 200 THEN la.{x} WHEN lb.n >= 200 THEN lb.{x} ELSE lc.{x} END"
    picked = ", ".join([f"{pick(f'mid{m}')} AS mid{m}" for m in metrics] + [f"{pick(f'{d}{m}')} AS p_{d}{m}, coalesce(vc.{d}{m}, p_{d}{m}) AS c_{d}{m}, coalesce(vb.{d}{m}, c_{d}{m}) AS b_{d}{m}" for m, d in sides])
    made.append(f"lim AS (SELECT la.lang, la.source, {picked} FROM la JOIN lb ON la.lang IS NOT DISTINCT FROM lb.lang CROSS JOIN lc LEFT JOIN vb ON la.lang IS NOT DISTINCT FROM vb.lang LEFT JOIN vc ON true)")
    gap = lambda m, d: f"greatest(list_sort([p_{d}{m}, b_{d}{m}, c_{d}{m}])[2], 5)"
    inside = " AND ".join(["v1 >= mid1 - " + gap(1, "down"), *[f"v{m} <= mid{m} + {gap(m, 'up')}" for m in metrics]])
    return f"""{counts}
ok AS (SELECT * FROM m WHERE NOT ({failed})),
{", ".join(made)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT ({failed}) AND coalesce({inside}, true) AS kept
FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source
"""


SQL["op10_quality_rules_tails"] = _tails_sql()
SQL["op10_quality_rules_slack"], SQL["op10_quality_rules"] = SQL["op10_quality_rules"], SQL["op10_quality_rules_tails"]
