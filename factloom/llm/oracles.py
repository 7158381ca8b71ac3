"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from factloom.llm import urlfilter

# The values that the operators are registered with, typed here.
CUTOFFS = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01], "dup_line_share": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeat_share": [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05], "long_words": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0], "short_words": [-1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0],
}
RISK, DELTA, LEAST_COUNT, BACKOFF = 0.01, 0.05, 2, 0.4


def quality_rules() -> str:
    grid = " UNION ALL ".join(f"SELECT '{m}' AS measure, {step} AS step, CAST({c} AS DOUBLE) AS cutoff" for m, cuts in CUTOFFS.items() for step, c in enumerate(cuts))
    part, measures = RISK / len(CUTOFFS), len(CUTOFFS)
    values = " UNION ALL ".join(f"SELECT stratum, '{m}' AS measure, {m} AS x FROM good" for m in CUTOFFS)
    above = " OR ".join(f"COALESCE(m.{name} > c.cut_{name}, FALSE)" for name in CUTOFFS)
    cuts = ", ".join(f"min(cutoff) FILTER (WHERE measure = '{m}') AS cut_{m}" for m in CUTOFFS)
    return rf"""
WITH t AS (SELECT doc_id, COALESCE(lang, '') AS stratum, COALESCE(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, sum(c) AS n FROM (SELECT doc_id, least(5, COALESCE(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS c FROM d) GROUP BY doc_id),
b AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             CAST(COALESCE(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_share,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
             CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share,
             CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS long_words,
             CASE WHEN n_words > 0 THEN -(word_chars::DOUBLE / n_words) ELSE 0 END AS short_words FROM b),
good AS (SELECT m.* FROM m JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)),
v AS ({values}),
grid AS ({grid}),
k AS (SELECT stratum, measure, step, cutoff, count(*) AS n, count(*) FILTER (WHERE x > cutoff) AS k FROM v JOIN grid USING (measure) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k > n * {part} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
        lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({part}) + (n - j) * ln(1 - {part})))) END AS tail FROM k),
s AS (SELECT *, bool_and(tail <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM good) * {measures})) OVER (PARTITION BY stratum, measure ORDER BY step) AS passes FROM p),
c AS (SELECT stratum, {cuts} FROM s WHERE passes GROUP BY stratum)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({above}) AS kept
FROM m LEFT JOIN c USING (stratum)
"""


def url_filter(rules: list[tuple[str, str]]) -> str:
    u = urlfilter
    fits = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{rule}|{action}'"
        for rule, host, path, action in sorted((u.parse_rule(a, r) for a, r in rules), key=lambda r: (-len(r[0]), -len(r[1]), r[3]))
    )
    return f"""
WITH RECURSIVE tags AS (SELECT url AS u, unnest(regexp_extract_all(html, '{u.TAGS}', 0)) AS tag FROM pages WHERE contains(url, '://')),
named AS (SELECT u, {u.target_sql("tag", "regexp_matches")} AS t FROM tags),
full_ AS (SELECT u, {u.resolve_sql("t", "u")} AS t FROM named WHERE t IS NOT NULL),
edges AS (SELECT {u.node_sql("u", ", 'g'")} AS a, {u.node_sql("t", ", 'g'")} AS b FROM full_),
both_ AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT DISTINCT a, a AS b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
node AS (SELECT a, regexp_extract(b, '^([^/?#]*)', 1) AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
group_ AS (SELECT a, bool_or(f LIKE '%|allow') AS allowed, bool_or(f LIKE '%|block') AS blocked FROM (SELECT a, CASE {fits} END AS f FROM node) GROUP BY a),
page AS (SELECT page_id, {u.host_sql("url")} AS host, {u.path_sql("url")} AS path, CASE WHEN contains(url, '://') THEN {u.node_sql("url", ", 'g'")} END AS a FROM pages),
ruled AS (SELECT *, CASE {fits} END AS f FROM page)
SELECT page_id, host, path, nullif(split_part(f, '|', 1), '') AS rule,
       COALESCE(nullif(split_part(f, '|', 2), ''), CASE WHEN blocked AND NOT COALESCE(allowed, FALSE) THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN group_ USING (a)
"""


def stupid_backoff() -> str:
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS u FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
c1 AS (SELECT w, count(*) AS n FROM e GROUP BY w),
c2 AS (SELECT u, w, count(*) AS n FROM e WHERE u IS NOT NULL GROUP BY u, w),
s AS (SELECT e.r, CASE WHEN e.u IS NULL THEN ln(cw.n / (SELECT count(*) FROM e))
                       WHEN c2.n >= {LEAST_COUNT} THEN ln(c2.n) - ln(cu.n)
                       ELSE ln({BACKOFF}) + ln(cw.n / (SELECT count(*) FROM e)) END AS x
      FROM e JOIN c1 AS cw ON cw.w = e.w LEFT JOIN c2 ON c2.u = e.u AND c2.w = e.w LEFT JOIN c1 AS cu ON cu.w = e.u),
d AS (SELECT r, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(COALESCE(x, 0), 3) AS log_score, round(x / len(ws), 6) AS score
FROM t LEFT JOIN d USING (r)
"""


def revisits() -> str:
    return f"""
WITH c AS (SELECT page_id, (page_id * 7919) % 10 AS kind, (page_id // 7) % 3 AS v, (page_id * 104729) % 1000003 AS date,
                  CASE WHEN contains(url, '://') THEN CASE WHEN page_id % 3 = 0 THEN 'hot.example/' ELSE regexp_replace({urlfilter.node_sql("url", ", 'g'")}, '[0-9]+', '', 'g') END END AS url_key FROM pages),
t AS (SELECT *, CASE WHEN kind IN (1, 2, 5, 9) THEN 'v' || v END AS tag, CASE WHEN kind IN (0, 2, 6) THEN 'day ' || v END AS modified,
             CASE WHEN kind IN (7, 9) OR (kind = 3 AND page_id % 2 = 0) THEN md5(CAST(v AS VARCHAR)) END AS digest FROM c),
full_ AS (SELECT url_key, date, max(page_id) AS id FROM t WHERE kind < 4 AND url_key IS NOT NULL GROUP BY 1, 2),
answer AS (SELECT f.url_key, f.date, t.page_id AS id, t.tag, t.modified, t.digest FROM full_ f JOIN t ON t.page_id = f.id),
r AS (SELECT v.*, a.id, a.tag AS a_tag, a.modified AS a_modified, a.digest AS a_digest FROM (SELECT * FROM t WHERE kind > 4) v ASOF LEFT JOIN answer a ON v.url_key = a.url_key AND v.date > a.date),
o AS (SELECT *, CASE WHEN id IS NULL THEN 'no_response'
                     WHEN COALESCE(digest <> a_digest, FALSE) OR COALESCE(tag <> a_tag, FALSE) OR ((tag IS NULL OR a_tag IS NULL) AND COALESCE(modified <> a_modified, FALSE)) THEN 'mismatch'
                     WHEN (digest IS NOT NULL AND a_digest IS NOT NULL) OR (tag IS NOT NULL AND a_tag IS NOT NULL) OR (modified IS NOT NULL AND a_modified IS NOT NULL) THEN 'resolved' ELSE 'unvalidated' END AS outcome FROM r),
h AS (SELECT *, outcome = 'resolved' AS ok, CASE WHEN tag IS NOT NULL THEN 'W/' || tag END AS own FROM o)
SELECT page_id AS record_id, url_key, date, CASE WHEN ok THEN id END AS resolved_id, outcome,
       array_to_string(list_filter(['cache-control=max-age=' || page_id % 100, 'content-type=' || CASE WHEN ok THEN 'text/html' ELSE 'text/plain' END, 'date=' || date,
                                    'etag=' || COALESCE(own, CASE WHEN ok THEN a_tag END), 'last-modified=' || COALESCE(modified, CASE WHEN ok THEN a_modified END)], lambda x: x IS NOT NULL), ';') AS headers
FROM h
"""


def filter_audit() -> str:
    return r"""
WITH t AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
f AS (SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, COALESCE(doc_id > first, FALSE) AS e FROM w),
l AS (SELECT doc_id, bool_or(COALESCE(quality = 1, FALSE)) AS good, bool_or(COALESCE(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS mask,
             count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM x v, x w, x, x y, x z WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS here, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
k AS (SELECT *, contains(mask, here) AS fails, step > 1 AND regexp_matches(mask, '[' || CASE WHEN step > 1 THEN before ELSE '-' END || ']') AS gone FROM m, s),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, here, sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed,
             sum(n) FILTER (WHERE fails AND gone) AS redundant, sum(n) FILTER (WHERE mask = here) AS unique_fails,
             sum(good) FILTER (WHERE fails AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE fails AND NOT gone) AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, step, CAST(COALESCE(kept, 0) AS BIGINT) AS kept, CAST(COALESCE(removed, 0) AS BIGINT) AS removed, CAST(COALESCE(redundant, 0) AS BIGINT) AS redundant,
       CAST(COALESCE(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(COALESCE(good_lost, 0) AS BIGINT) AS good_lost, CAST(COALESCE(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(COALESCE(sum(removed) OVER (PARTITION BY part, here), 0) AS BIGINT) AS shapley
FROM g
"""


def collocations() -> str:
    return r"""
WITH t AS (SELECT row_number() OVER () AS r, COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS x(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1),
half AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
both_ AS (SELECT *, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest FROM half),
cut AS (SELECT b.lang, b.phrase, a, cut, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
        FROM both_ b JOIN f x ON x.lang = b.lang AND x.phrase = b.first JOIN f y ON y.lang = b.lang AND y.phrase = b.rest),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, unnest(list_transform([[1, 2], [2, 2], [3, 2], [1, 3], [2, 3]], lambda p: CASE WHEN p[2] < k AND p[1] + p[2] - 1 <= k THEN array_to_string(ws[p[1]:p[1] + p[2] - 1], ' ') END)) AS phrase FROM c WHERE k > 2),
longer AS (SELECT lang, phrase, max(a) AS longest FROM inner_ WHERE phrase IS NOT NULL GROUP BY ALL),
d AS (SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100::HUGEINT * longest < 80 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM d JOIN n USING (lang) WHERE rank <= 2000
"""
