"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from roomrank.llm import license_scan, mixing, url_filter

MIXING = f"""
WITH RECURSIVE
c AS (SELECT source, count(*) AS rows, sqrt(count(*)) AS weight FROM documents GROUP BY source),
w AS (SELECT source, weight / sum(weight) OVER () AS w, ceil(rows / {mixing.BLOCK_ROWS}) AS blocks,
             row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM c),
p AS (SELECT greatest({mixing.PERIOD}, CAST(ceil(1 / min(w)) AS BIGINT)) AS q, CAST(max(ceil(blocks / w)) AS BIGINT) + count(*) + 2 AS slots FROM w),
-- the blocks that each source has had when a stretch of q slots ends
f AS (SELECT k, w.i, (k + 1) * q AS t, w * ((k + 1) * q) AS x FROM w, p, (SELECT unnest(range(0, (SELECT slots // q + 1 FROM p))) AS k)),
g AS (SELECT k, i, floor(x) + CASE WHEN row_number() OVER (PARTITION BY k ORDER BY floor(x) - x, i) <= t - sum(floor(x)) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS had FROM f),
e AS (SELECT k, list(CAST(had AS BIGINT) ORDER BY i) AS had FROM g GROUP BY k),
n AS (SELECT list(w ORDER BY i) AS w, list(source ORDER BY i) AS names FROM w),
step(t, had, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(n.w, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM n
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(had) + 1), lambda i: had[i] + CASE WHEN i = b THEN 1 ELSE 0 END), b
  FROM (SELECT step.t, step.had, list_min(list_filter(list_transform(range(1, len(step.had) + 1), lambda i:
          CASE WHEN step.had[i] < e.had[i] THEN {{'early': floor(step.had[i] / n.w[i]) > step.t + 1, 'deadline': ceil((step.had[i] + 1) / n.w[i]), 'i': i}} END),
          lambda x: x IS NOT NULL)).i AS b
        FROM step, n, p, e WHERE e.k = (step.t + 1) // p.q AND step.t + 1 < p.slots)),
plan AS (SELECT n.names[step.pick] AS source, step.had[step.pick] - 1 AS block, step.t AS slot FROM step, n WHERE step.t >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS n FROM documents)
SELECT d.doc_id, d.source, d.n // {mixing.BLOCK_ROWS} AS block, plan.slot, CAST(d.n % {mixing.BLOCK_ROWS} AS INTEGER) AS place
FROM d JOIN plan ON plan.source IS NOT DISTINCT FROM d.source AND plan.block = d.n // {mixing.BLOCK_ROWS}"""


def _rule_sql(column: int) -> str:
    cases = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{(rule, verdict)[column]}'")
    return "CASE " + " ".join(cases) + " END"


def _strength_sql(table: str, mean: str) -> str:
    low, high = url_filter.STRENGTH
    return f"""(SELECT least(greatest(coalesce(1 / nullif(greatest((spread - within) / nullif(pairs, 0), 0), 0) - 1, {high}), {low}), {high}) FROM (
    SELECT sum({mean} * (1 - {mean})) AS within, sum(pow(bad - n * {mean}, 2) / n) AS spread, sum({mean} * (1 - {mean}) * (n - 1)) AS pairs
    FROM {table} WHERE n > 0))"""


def _level(name: str, source: str, mean: str, out: str) -> str:
    return f"""
{name}_k AS (SELECT {_strength_sql(source, mean)} AS k),
{name}_p AS (SELECT s.*, 1 / (1 / k + 1 / {mean}_n) AS prior FROM {source} s, {name}_k),
{name} AS (SELECT * EXCLUDE (prior), n + prior AS {out}_n, (bad + prior * {mean}) / (n + prior) AS {out} FROM {name}_p)"""


URL_FILTER = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1) AS raw FROM a),
p AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(split_part(split_part(substr(rest, length(raw) + 1), '?', 1), '#', 1), '') AS path FROM b),
o AS (SELECT doc_id AS page_id, CAST(quality = 0 AS INTEGER) AS bad FROM labels WHERE quality IS NOT NULL),
h0 AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, string_split(host, '.') AS l FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT host, n, bad, l, CASE WHEN length(l[-1]) = 2 AND len(l) > 1 AND l[-2] IN ({', '.join(f"'{x}'" for x in url_filter.SECOND_LEVEL)})
                                   THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix FROM h0),
h2 AS (SELECT host, n, bad, suffix, array_to_string(l[greatest(1, len(l) - CASE WHEN contains(suffix, '.') THEN 2 ELSE 1 END):], '.') AS domain FROM h1),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h2 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY ALL),
s1 AS (SELECT s0.*, (t.bad + 0.5) / (t.n + 1) AS overall, t.n + 1.0 AS overall_n
       FROM s0, (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM s0) t),{_level('s', 's1', 'overall', 'suffix_rate')},
d1 AS (SELECT d0.*, suffix_rate, suffix_rate_n FROM d0 JOIN s USING (suffix)),{_level('d', 'd1', 'suffix_rate', 'domain_rate')},
h3 AS (SELECT h2.*, domain_rate, domain_rate_n FROM h2 JOIN d USING (suffix, domain)),{_level('h', 'h3', 'domain_rate', 'rate')},
r AS (SELECT host, rate, greatest(rate - {url_filter.Z} * sqrt(rate * (1 - rate) / (rate_n + 1)), 0) AS bound FROM h)
SELECT page_id, host, path, {_rule_sql(0)} AS rule,
       coalesce({_rule_sql(1)}, CASE WHEN bound > {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS host_rate, round(bound, 6) AS host_bound
FROM p LEFT JOIN r USING (host)"""


def _h_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _h_row(text: str) -> str:
    return "sha256(" + " || ".join(_h_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# crc32 bit by bit over the decimal digits
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda u, i: xor(u >> 1, 3988292384 * (u & 1)))))"""


def _tree(name: str, base: str) -> str:
    """{name}(grp, lvl, n, digest, total): all levels; {name}_s: the digests before and after each node in its run of 16."""
    return f"""
{name}(grp, lvl, n, digest, total) AS (
  {base}
  UNION ALL
  SELECT grp, lvl + 1, n // 16, sha256(string_agg(digest, '' ORDER BY n)), (total + 15) // 16 FROM {name} WHERE total > 1 GROUP BY grp, lvl, n // 16, total),
{name}_s AS (SELECT grp, lvl, n,
    coalesce(string_agg(digest, '') OVER (PARTITION BY grp, lvl, n // 16 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY grp, lvl, n // 16 ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE total > 1)"""


def _walk(name: str, tree: str, base: str) -> str:
    return f"""
{name}(doc, grp, lvl, n, digest, proof) AS (
  {base}
  UNION ALL
  SELECT w.doc, w.grp, w.lvl + 1, w.n // 16, sha256(s.l || w.digest || s.r), w.proof || s.l || s.r
  FROM {name} w JOIN {tree}_s s ON s.grp = w.grp AND s.lvl = w.lvl AND s.n = w.n)"""


MERKLE = f"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce('+' || source, '') AS grp, {_h_row('text')} AS leaf,
             CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL AND {_CRC} % 5 = 0
                  THEN {_h_row("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n, count(*) OVER (PARTITION BY grp) AS total,
             row_number() OVER () AS doc FROM d),{_tree('t', 'SELECT grp, 0, n, leaf, total FROM e')},
sub AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS n, count(*) OVER () AS total FROM t WHERE total = 1),{
_tree('u', "SELECT '', 0, n, subroot, total FROM sub")},{
_walk('w', 't', "SELECT doc, grp, 0, n, coalesce(now, leaf), '' FROM e")},
x AS (SELECT doc, max_by(digest, lvl) AS digest, max_by(proof, lvl) AS proof FROM w GROUP BY doc),{
_walk('v', 'u', "SELECT e.doc, '', 0, sub.n, x.digest, x.proof FROM e JOIN x USING (doc) JOIN sub USING (grp)")},
y AS (SELECT doc, max_by(digest, lvl) AS folded_root, max_by(proof, lvl) AS proof FROM v GROUP BY doc)
SELECT e.doc_id, e.leaf, sub.subroot, r.digest AS root, sha256(y.proof) AS proof_sha256, y.folded_root, y.folded_root = r.digest AS verified
FROM e JOIN sub USING (grp) JOIN y USING (doc), (SELECT digest FROM u WHERE total = 1) r"""


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _license_sql() -> str:
    """Every block against every template, without filters."""
    step = license_scan.BLOCK // 2
    places = [f"""list_transform(list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))}),
                lambda i: {{'at': i, 'label': '{label}'}})""" for p, label in license_scan.PHRASES.items()]
    templates = ", ".join(f"('{label}', {_sql_list(sorted(set(license_scan.template_words(t))))})" for label, t in license_scan.TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
         lambda x: x <> '') AS w FROM documents),
b AS (SELECT row, doc_id, w, list_concat({', '.join(places)}) AS f FROM d),
t(label, words) AS (VALUES {templates}),
k AS (SELECT row, list_distinct(list_slice(w, s + 1, s + {license_scan.BLOCK})) AS words
      FROM (SELECT row, w, unnest(range(0, greatest(len(w) - {step}, 1), {step})) AS s FROM d)),
m AS (SELECT row, label, len(list_intersect(k.words, t.words)) AS shared, len(t.words) AS size FROM k, t),
g AS (SELECT row, list(DISTINCT label) AS more, max(shared / size) AS most FROM m WHERE 100 * shared >= {license_scan.PERCENT} * size GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(f) AS BIGINT) AS n_base,
       list_min(list_transform(f, lambda x: x.at)) AS first_word, list_max(list_transform(f, lambda x: x.at)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(f, lambda x: x.label), coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(f) > 0 THEN 1.0 ELSE coalesce(most, 0.0) END AS score
FROM b LEFT JOIN g USING (row)"""


COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
      FROM s, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k AS size, f AS a FROM f WHERE k > 1 AND f >= 100),
u AS (SELECT lang, phrase, w, a, unnest(range(1, size)) AS k FROM c),
v AS (SELECT u.lang, u.phrase, u.k, u.a, x.f AS l, y.f AS r, t.n,
             CAST((1000::HUGEINT * u.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM u JOIN t USING (lang) JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.k], ' ')
      JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.k + 1:], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT DISTINCT g.lang, array_to_string(g.w[i:i + k - 1], ' ') AS phrase, g.a FROM c g, range(1, 6) x(i), range(2, 5) y(k)
      WHERE k < g.size AND i + k - 1 <= g.size),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = b.lang AND h.phrase = b.phrase AND 100 * h.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING, "op3_url_filter": URL_FILTER, "op11_merkle": MERKLE, "op12_license_scan": _license_sql(), "op13_collocations": COLLOCATIONS}
