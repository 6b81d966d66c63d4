"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Every string starts with the same CTE block that rebuilds the users / reviews / matches
views from the driver tables. Splits are always taken from ``user_id % 10`` and the
accommodation id is computed in a subquery over ``orders`` before any join (two DuckDB
"""

from __future__ import annotations

BATCH = 64
TRUNCATE_DIM = 32
HASH_DIM = 64
SAMPLE_FRAC = 0.2
SAMPLE_N = 100
DRAWS = 20
DRAW_SEED = 11
SHUFFLE_SEED = 7
EPOCHS = 3
GROUP_BLOCK = 64
DRIFT_FEATURES = ["guest_id", "guest_country", "guest_type", "accommodation_country", "accommodation_type",
                  "accommodation_id"]


def h32(k: str) -> str:
    """SQL text of the 32-bit multiplicative hash used by ``clean.mult_hash32``."""
    kk = f"(({k}) % 4294967296)"
    return (f"((((({kk} // 65536) * 2654435761) % 65536) * 65536 + ({kk} % 65536) * 2654435761) % 4294967296)")


def split_sql(uid: str) -> str:
    return f"CASE WHEN {uid} % 10 < 8 THEN 'train' WHEN {uid} % 10 = 8 THEN 'val' ELSE 'test' END"


FIXTURE = f"""
WITH
n_sup AS (SELECT count(*) AS n FROM supplier),
n_vec AS (SELECT count(*) AS n FROM embeddings),
ord AS (
  SELECT o_orderkey, o_custkey, o_orderdate, (o_orderkey * 7 + o_custkey) % (SELECT n FROM n_sup) AS acc_id
  FROM orders),
users AS (
  SELECT o.o_orderkey AS user_id, o.o_custkey AS guest_id,
         CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE g.n_name END AS guest_country,
         c.c_mktsegment AS guest_type, CAST(o.acc_id AS BIGINT) AS accommodation_id,
         a.n_name AS accommodation_country, p.p_type AS accommodation_type,
         CASE WHEN p.p_size % 11 = 0 THEN NULL ELSE CAST(p.p_size % 5 + 1 AS DOUBLE) END AS accommodation_star_rating,
         s.s_acctbal AS accommodation_score,
         CAST(1 + o.o_orderkey % 14 AS INTEGER) AS room_nights,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         {split_sql('o.o_orderkey')} AS split
  FROM ord o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation g ON g.n_nationkey = c.c_nationkey
  JOIN supplier s ON s.s_suppkey = o.acc_id
  JOIN nation a ON a.n_nationkey = s.s_nationkey
  JOIN part p ON p.p_partkey = o.acc_id),
reviews AS (
  SELECT doc_id AS review_id,
         CAST((doc_id * (doc_id % 7 + 1)) % (SELECT n FROM n_sup) AS BIGINT) AS accommodation_id,
         title AS review_title,
         CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN rest
              ELSE substr(rest, 1, CAST(length(rest) // 2 AS BIGINT)) END AS review_positive,
         CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 6 = 0 THEN rest
              ELSE substr(rest, CAST(length(rest) // 2 AS BIGINT) + 1) END AS review_negative,
         CAST(n_chars % 10 + 1 AS DOUBLE) AS review_score,
         CAST(doc_id % 37 AS INTEGER) AS review_helpful_votes
  FROM (SELECT *, substr(text, length(title) + 2) AS rest
        FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM documents))),
reviews_filled AS (
  SELECT review_id, accommodation_id,
         coalesce(review_title, 'None Given') AS review_title,
         coalesce(review_positive, 'None Given') AS review_positive,
         coalesce(review_negative, 'None Given') AS review_negative,
         review_score, review_helpful_votes
  FROM reviews),
rev_num AS (
  SELECT accommodation_id, review_id,
         row_number() OVER (PARTITION BY accommodation_id ORDER BY review_id) - 1 AS rn,
         count(*) OVER (PARTITION BY accommodation_id) AS n_rev
  FROM reviews),
matches AS MATERIALIZED (
  SELECT u.user_id, r.review_id, u.accommodation_id, {split_sql('u.user_id')} AS split
  FROM (SELECT user_id, accommodation_id FROM users) u
  JOIN rev_num r ON r.accommodation_id = u.accommodation_id AND u.user_id % r.n_rev = r.rn),
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
uvec AS MATERIALIZED (
  SELECT u.user_id, u.accommodation_id, v.vec
  FROM (SELECT user_id, accommodation_id FROM users) u
  JOIN vec v ON v.vec_id = (u.user_id * 7 + 3) % (SELECT n FROM n_vec)),
rvec AS MATERIALIZED (
  SELECT r.review_id, r.accommodation_id, v.vec
  FROM (SELECT review_id, accommodation_id FROM reviews) r
  JOIN vec v ON v.vec_id = r.review_id % (SELECT n FROM n_vec)),
pairs AS MATERIALIZED (
  SELECT m.user_id, m.review_id, m.accommodation_id, m.user_id % 10 AS split_no, uv.vec AS uvec, rv.vec AS rvec
  FROM matches m JOIN uvec uv ON uv.user_id = m.user_id JOIN rvec rv ON rv.review_id = m.review_id)
"""

PROMPT_SHORT_SQL = ("'clustering: The following is a review on a website for some accommodation.' || chr(10) || "
                    "'    The review title is: ' || review_title || '.' || chr(10) || "
                    "'    The positive review portion: ' || review_positive || '.' || chr(10) || "
                    "'    The negative review portion: ' || review_negative || '.' || chr(10)")
PROMPT_FULL_SQL = ("chr(10) || '    The following data is a review by a user of an anonymous hotel/accomodation.' || chr(10) || "
                   "'    The review title is: ' || review_title || '.' || chr(10) || "
                   "'    The user wrote this positive review portion: ' || review_positive || '.' || chr(10) || "
                   "'    The user wrote this negative review portion: ' || review_negative || '.' || chr(10) || "
                   "'    The overall Score the user gave is: ' || CAST(review_score AS VARCHAR) || '.' || chr(10) || "
                   "'    When published, this review garnered ' || CAST(review_helpful_votes AS VARCHAR) || "
                   "' ''helpful'' notes.' || chr(10) || '    ' || chr(10) || '    '")

COS = ("list_inner_product({a}, {b}) / greatest(sqrt(list_inner_product({a}, {a})) * "
       "sqrt(list_inner_product({b}, {b})), 1e-8)")


def _q(body: str) -> str:
    return FIXTURE + body


# ---------------------------------------------------------------------- feature pieces
FEATURE_CTES = """,
fe_means AS (
  SELECT split, accommodation_id,
         avg(accommodation_star_rating) AS average_accommodation_star_rating,
         avg(accommodation_score) AS average_accommodation_score,
         avg(room_nights) AS average_room_nights
  FROM users GROUP BY split, accommodation_id),
fe_u AS (
  SELECT u.*, m.average_accommodation_star_rating, m.average_accommodation_score, m.average_room_nights
  FROM users u JOIN fe_means m ON m.split = u.split AND m.accommodation_id = u.accommodation_id),
fq_guest_country AS (
  SELECT split, guest_country, count(*) / sum(count(*)) OVER (PARTITION BY split) AS f
  FROM users WHERE guest_country IS NOT NULL GROUP BY split, guest_country),
fq_guest_type AS (
  SELECT split, guest_type, count(*) / sum(count(*)) OVER (PARTITION BY split) AS f
  FROM users WHERE guest_type IS NOT NULL GROUP BY split, guest_type),
fq_accommodation_country AS (
  SELECT split, accommodation_country, count(*) / sum(count(*)) OVER (PARTITION BY split) AS f
  FROM users WHERE accommodation_country IS NOT NULL GROUP BY split, accommodation_country),
fq_raw AS (
  SELECT u.user_id, u.split, a.f AS count_guest_country, b.f AS count_guest_type, c.f AS count_accommodation_country
  FROM users u
  LEFT JOIN fq_guest_country a ON a.split = u.split AND a.guest_country = u.guest_country
  LEFT JOIN fq_guest_type b ON b.split = u.split AND b.guest_type = u.guest_type
  LEFT JOIN fq_accommodation_country c ON c.split = u.split AND c.accommodation_country = u.accommodation_country),
fq_mode AS (
  SELECT split, v AS mode_v FROM (
    SELECT split, count_guest_country AS v,
           row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, count_guest_country) AS rk
    FROM fq_raw WHERE count_guest_country IS NOT NULL GROUP BY split, count_guest_country) WHERE rk = 1),
fq AS (
  SELECT r.user_id, coalesce(r.count_guest_country, m.mode_v) AS count_guest_country,
         r.count_guest_type, r.count_accommodation_country
  FROM fq_raw r LEFT JOIN fq_mode m ON m.split = r.split),
mm_stats AS (
  SELECT split,
    min(accommodation_score) AS lo1, max(accommodation_score) AS hi1,
    min(month) AS lo2, max(month) AS hi2,
    min(room_nights) AS lo3, max(room_nights) AS hi3,
    min(accommodation_star_rating) AS lo4, max(accommodation_star_rating) AS hi4,
    min(average_accommodation_star_rating) AS lo5, max(average_accommodation_star_rating) AS hi5,
    min(average_accommodation_score) AS lo6, max(average_accommodation_score) AS hi6,
    min(average_room_nights) AS lo7, max(average_room_nights) AS hi7
  FROM fe_u GROUP BY split),
mm AS (
  SELECT u.user_id, u.split,
    CASE WHEN hi1 > lo1 THEN (accommodation_score - lo1) / (hi1 - lo1) ELSE accommodation_score - lo1 END AS accommodation_score,
    CASE WHEN hi2 > lo2 THEN (month - lo2) / (hi2 - lo2) ELSE month - lo2 END AS month,
    CASE WHEN hi3 > lo3 THEN (room_nights - lo3) / (hi3 - lo3) ELSE room_nights - lo3 END AS room_nights,
    CASE WHEN hi4 > lo4 THEN (accommodation_star_rating - lo4) / (hi4 - lo4) ELSE accommodation_star_rating - lo4 END AS accommodation_star_rating,
    CASE WHEN hi5 > lo5 THEN (average_accommodation_star_rating - lo5) / (hi5 - lo5) ELSE average_accommodation_star_rating - lo5 END AS average_accommodation_star_rating,
    CASE WHEN hi6 > lo6 THEN (average_accommodation_score - lo6) / (hi6 - lo6) ELSE average_accommodation_score - lo6 END AS average_accommodation_score,
    CASE WHEN hi7 > lo7 THEN (average_room_nights - lo7) / (hi7 - lo7) ELSE average_room_nights - lo7 END AS average_room_nights
  FROM fe_u u JOIN mm_stats s ON s.split = u.split),
mm_month AS (SELECT split, avg(month) AS average_month FROM mm GROUP BY split),
bin_dom AS (
  SELECT 'guest_country' AS col, v, row_number() OVER (ORDER BY v) AS code, count(*) OVER () AS n
  FROM (SELECT DISTINCT guest_country AS v FROM users WHERE guest_country IS NOT NULL)
  UNION ALL
  SELECT 'accommodation_country', v, row_number() OVER (ORDER BY v), count(*) OVER ()
  FROM (SELECT DISTINCT accommodation_country AS v FROM users WHERE accommodation_country IS NOT NULL)
  UNION ALL
  SELECT 'accommodation_type', v, row_number() OVER (ORDER BY v), count(*) OVER ()
  FROM (SELECT DISTINCT accommodation_type AS v FROM users WHERE accommodation_type IS NOT NULL)),
bin_bits AS (
  SELECT col, CAST(greatest(1, ceil(log2(max(n) + 1))) AS BIGINT) AS bits FROM bin_dom GROUP BY col),
bin_long AS (
  SELECT u.user_id, x.col, x.val, coalesce(d.code, 0) AS code, b.bits
  FROM users u
  CROSS JOIN LATERAL (VALUES ('guest_country', u.guest_country), ('accommodation_country', u.accommodation_country),
                             ('accommodation_type', u.accommodation_type)) x(col, val)
  LEFT JOIN bin_dom d ON d.col = x.col AND d.v = x.val
  JOIN bin_bits b ON b.col = x.col),
bin_codes AS (
  SELECT l.user_id, l.col, i.i AS bit_index,
         CAST((l.code >> (l.bits - 1 - i.i)) & 1 AS BIGINT) AS value
  FROM bin_long l JOIN (SELECT range AS i FROM range(0, 64)) i ON i.i < l.bits),
oh_dom AS (
  SELECT v, row_number() OVER (ORDER BY v) AS k FROM (SELECT DISTINCT guest_type AS v FROM users WHERE guest_type IS NOT NULL)),
oh AS (
  SELECT u.user_id, d.v, d.k, CAST(CASE WHEN u.guest_type = d.v THEN 1 ELSE 0 END AS BIGINT) AS value
  FROM users u CROSS JOIN oh_dom d)
"""


def _feature_long(users_filter: str = "") -> str:
    """Long-form user features in the Spark column order."""
    return f"""{FEATURE_CTES},
offs AS (
  SELECT (SELECT bits FROM bin_bits WHERE col = 'guest_country') AS b1,
         (SELECT bits FROM bin_bits WHERE col = 'accommodation_country') AS b2,
         (SELECT bits FROM bin_bits WHERE col = 'accommodation_type') AS b3,
         (SELECT count(*) FROM oh_dom) AS k),
feat AS (
  SELECT user_id, 1 AS position, count_guest_country AS value FROM fq
  UNION ALL SELECT user_id, 2, count_guest_type FROM fq
  UNION ALL SELECT user_id, 3, count_accommodation_country FROM fq
  UNION ALL SELECT b.user_id, 3 + CASE b.col WHEN 'guest_country' THEN 0 WHEN 'accommodation_country' THEN o.b1
                                      ELSE o.b1 + o.b2 END + b.bit_index + 1, b.value
            FROM bin_codes b, offs o
  UNION ALL SELECT h.user_id, 3 + o.b1 + o.b2 + o.b3 + h.k, h.value FROM oh h, offs o
  UNION ALL SELECT m.user_id, 3 + o.b1 + o.b2 + o.b3 + o.k + x.j, x.v
            FROM mm m, offs o,
            LATERAL (VALUES (1, m.accommodation_score), (2, m.month), (3, m.room_nights),
                            (4, m.accommodation_star_rating), (5, m.average_accommodation_star_rating),
                            (6, m.average_accommodation_score), (7, m.average_room_nights)) x(j, v)
  UNION ALL SELECT m.user_id, 3 + o.b1 + o.b2 + o.b3 + o.k + 8, a.average_month
            FROM mm m JOIN mm_month a ON a.split = m.split, offs o)
"""


FEATURE_SUMS = """SELECT user_id, count(*) AS n, round(sum(coalesce(CAST(value AS DOUBLE), 0)), 6) AS total,
       round(sum(coalesce(CAST(value AS DOUBLE), 0) * position), 6) AS weighted FROM feat GROUP BY user_id"""


def mlp_sql(name: str, source: str, key: str, sizes: list[int], model: int, act_last: bool = False) -> str:
    """CTEs that take ``source(key, x)`` through the formula layers; the last is ``name(key, y)``, activated if asked."""
    out, src = "", f"(SELECT {key}, x FROM {source})"
    for n, size in enumerate(sizes):
        last = n == len(sizes) - 1
        act = "v" if last and not act_last else "CASE WHEN v > 0 THEN v ELSE 0.01 * v END"
        out += f""",
{name}_w{n} AS (SELECT i, list_transform(range(CAST((SELECT max(len(x)) FROM {src}) AS BIGINT)),
    lambda j: ((7 * i + 13 * j + {5 * n + 3 * model}) % 17 - 8) / 32.0::DOUBLE) AS w FROM (SELECT unnest(range({size})) AS i)),
{name if last else f'{name}_{n}'} AS MATERIALIZED (
  SELECT {key}, list({act} ORDER BY i) AS {'y' if last else 'x'}
  FROM (SELECT s.{key}, w.i, list_inner_product(s.x, w.w::DOUBLE[]) AS v FROM {src} s CROSS JOIN {name}_w{n} w) GROUP BY {key})"""
        src = f"{name}_{n}"
    return out


def review_vector_unrounded(rows: str) -> str:
    return rows.replace("round(z.z, 6)", "z.z").replace("round(s1, 6)", "s1").replace("round(s2, 6)", "s2")


def _drift_summary() -> str:
    parts = []
    for f in DRIFT_FEATURES:
        parts.append(f"""
  SELECT '{f}' AS feature,
    (SELECT count(*) FROM (SELECT DISTINCT {f} FROM users WHERE user_id % 10 <= 8)) AS union_size,
    (SELECT count(*) FROM users t WHERE t.user_id % 10 < 8 AND NOT EXISTS (
        SELECT 1 FROM users v WHERE v.user_id % 10 = 8 AND v.{f} IS NOT DISTINCT FROM t.{f})) AS unseen_rows""")
    return "\nSELECT * FROM (" + "\n  UNION ALL".join(parts) + ")"


def _drift_counts() -> str:
    parts = []
    for f in DRIFT_FEATURES:
        parts.append(f"""
  SELECT '{f}' AS feature, CAST(t.{f} AS VARCHAR) AS value, count(*) AS n
  FROM users t
  WHERE t.user_id % 10 < 8 AND t.{f} IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM users v WHERE v.user_id % 10 = 8 AND v.{f} IS NOT DISTINCT FROM t.{f})
  GROUP BY 1, 2""")
    return "\nSELECT * FROM (" + "\n  UNION ALL".join(parts) + ")"


def _batches_sql(order_expr: str, epoch: int | None = None) -> str:
    return f"""
  SELECT p.*, CAST(floor((row_number() OVER (PARTITION BY accommodation_id ORDER BY {order_expr}) - 1) / {BATCH}) AS BIGINT) AS batch_id
  FROM pairs p WHERE p.split_no < 8"""


def _batch_losses(order_expr: str) -> str:
    return f""",
b AS MATERIALIZED ({_batches_sql(order_expr)}),
s AS (
  SELECT x.accommodation_id, x.batch_id, x.user_id AS ui, y.user_id AS uj,
         list_inner_product(x.uvec, y.rvec) AS s,
         sqrt(list_sum(list_transform(range(1, len(x.uvec) + 1),
              lambda i: (x.uvec[i] - y.rvec[i] + 1e-6) * (x.uvec[i] - y.rvec[i] + 1e-6)))) AS d
  FROM b x JOIN b y ON x.accommodation_id = y.accommodation_id AND x.batch_id = y.batch_id),
per_user AS (
  SELECT accommodation_id, batch_id, ui,
         ln(sum(exp(s - mx))) + max(mx) - max(CASE WHEN ui = uj THEN s END) AS ce,
         avg(greatest(s, 0) - s * CASE WHEN ui = uj THEN 1.0 ELSE 0.0 END + ln(1 + exp(-abs(s)))) AS bce,
         sum(CASE WHEN ui = uj THEN d * d ELSE power(greatest(2.0 - d, 0.0), 2) END) AS con_sum,
         count(*) AS cnt
  FROM (SELECT *, max(s) OVER (PARTITION BY accommodation_id, batch_id, ui) AS mx FROM s)
  GROUP BY accommodation_id, batch_id, ui),
per_batch AS (
  SELECT accommodation_id, batch_id, avg(ce) AS loss_softmax, avg(bce) AS loss_bce,
         sum(con_sum) / sum(cnt) AS loss_contrastive
  FROM per_user GROUP BY accommodation_id, batch_id)
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["split_counts"] = _q("SELECT split, count(*) AS n FROM users GROUP BY split")
    q["text_filled"] = _q("SELECT review_id, review_title, review_positive, review_negative FROM reviews_filled")
    q["review_prompt"] = _q(f"SELECT review_id, md5({PROMPT_SHORT_SQL}) AS prompt_md5, "
                            f"CAST(length({PROMPT_SHORT_SQL}) AS BIGINT) AS prompt_len FROM reviews_filled")
    q["review_prompt_full"] = _q(f"SELECT review_id, md5({PROMPT_FULL_SQL}) AS prompt_md5, "
                                 f"CAST(length({PROMPT_FULL_SQL}) AS BIGINT) AS prompt_len FROM reviews_filled")
    q["hash_sample_cascade"] = _q(f""",
rs AS (SELECT review_id FROM reviews WHERE {h32('review_id')} < {int(SAMPLE_FRAC * 4294967296)}),
ms AS (SELECT m.* FROM matches m WHERE m.review_id IN (SELECT review_id FROM rs)),
sp AS (SELECT * FROM (VALUES ('train', 0, 7), ('val', 8, 8), ('test', 9, 9)) t(split, lo, hi))
SELECT sp.split, 'reviews' AS table_name, (SELECT count(*) FROM rs) AS n FROM sp
UNION ALL
SELECT sp.split, 'matches', (SELECT count(*) FROM ms WHERE ms.user_id % 10 BETWEEN sp.lo AND sp.hi) FROM sp WHERE sp.split <> 'test'
UNION ALL
SELECT sp.split, 'users', (SELECT count(*) FROM users u WHERE u.user_id % 10 BETWEEN sp.lo AND sp.hi
   AND (sp.split = 'test' OR u.user_id IN (SELECT user_id FROM ms))) FROM sp
""")
    q["sample_n_users"] = _q(f"SELECT user_id FROM users ORDER BY {h32('user_id')}, user_id LIMIT {SAMPLE_N}")
    q["sample_groups_replace"] = _q(f""",
g AS (SELECT accommodation_id, count(*) AS n, row_number() OVER (ORDER BY accommodation_id) AS ordinal
      FROM matches WHERE user_id % 10 < 8 GROUP BY accommodation_id),
d AS (SELECT range AS draw FROM range(0, {DRAWS}))
SELECT d.draw, g.accommodation_id, g.n FROM d
JOIN g ON g.ordinal = {h32(f'd.draw + {DRAW_SEED}')} % (SELECT count(*) FROM g) + 1""")
    merge = """
SELECT m.user_id, m.review_id, m.accommodation_id, u.split
FROM matches m JOIN reviews r ON r.review_id = m.review_id{extra_r}
JOIN users u ON u.user_id = m.user_id{extra_u}
WHERE m.user_id % 10 <= 8"""
    q["merge_single_key"] = _q(merge.format(extra_r="", extra_u=""))
    q["merge_composite_key"] = _q(merge.format(extra_r=" AND r.accommodation_id = m.accommodation_id",
                                               extra_u=" AND u.accommodation_id = m.accommodation_id"))
    q["user_match_lookup"] = _q("""
SELECT u.user_id, min(m.review_id) AS review_id
FROM users u JOIN matches m ON m.user_id = u.user_id AND m.accommodation_id = u.accommodation_id
WHERE u.user_id % 10 <= 8 GROUP BY u.user_id""")
    q["drift_summary"] = _q(_drift_summary())
    q["drift_unseen_counts"] = _q(_drift_counts())
    q["accommodation_means"] = _q(FEATURE_CTES + """
SELECT user_id, round(average_accommodation_star_rating, 6) AS average_accommodation_star_rating,
       round(average_accommodation_score, 6) AS average_accommodation_score,
       round(average_room_nights, 6) AS average_room_nights FROM fe_u""")
    q["value_frequencies"] = _q(FEATURE_CTES + """
SELECT user_id, round(count_guest_country, 6) AS count_guest_country, round(count_guest_type, 6) AS count_guest_type,
       round(count_accommodation_country, 6) AS count_accommodation_country FROM fq""")
    q["minmax_users"] = _q(FEATURE_CTES + """
SELECT user_id, round(accommodation_score, 6) AS accommodation_score, round(month, 6) AS month,
       round(room_nights, 6) AS room_nights, round(accommodation_star_rating, 6) AS accommodation_star_rating,
       round(average_accommodation_star_rating, 6) AS average_accommodation_star_rating,
       round(average_accommodation_score, 6) AS average_accommodation_score,
       round(average_room_nights, 6) AS average_room_nights FROM mm""")
    q["minmax_reviews"] = _q("""
, rs AS (SELECT DISTINCT u.split, r.* FROM users u JOIN reviews r ON r.accommodation_id = u.accommodation_id)
SELECT split, review_id,
  round(CASE WHEN hi1 > lo1 THEN (review_score - lo1) / (hi1 - lo1) ELSE review_score - lo1 END, 6) AS review_score,
  round(CASE WHEN hi2 > lo2 THEN (review_helpful_votes - lo2) / (hi2 - lo2) ELSE review_helpful_votes - lo2 END, 6) AS review_helpful_votes
FROM (SELECT rs.*, min(review_score) OVER w AS lo1, max(review_score) OVER w AS hi1, CAST(min(review_helpful_votes) OVER w AS DOUBLE) AS lo2,
             CAST(max(review_helpful_votes) OVER w AS DOUBLE) AS hi2 FROM rs WINDOW w AS (PARTITION BY split))""")
    q["dropped_users"] = _q("""
SELECT u.split, count(*) AS n_users, count(*) FILTER (WHERE r.a IS NULL) AS n_dropped
FROM users u LEFT JOIN (SELECT DISTINCT accommodation_id AS a FROM reviews) r ON r.a = u.accommodation_id GROUP BY u.split""")
    q["month_mean"] = _q(FEATURE_CTES + "SELECT split, round(average_month, 6) AS average_month FROM mm_month")
    q["binary_codes"] = _q(FEATURE_CTES + """
SELECT user_id, col || '_' || CAST(bit_index AS VARCHAR) AS "column", value FROM bin_codes""")
    q["onehot_guest_type"] = _q(FEATURE_CTES + """
SELECT user_id, 'guest_type_' || v AS "column", CAST(k AS BIGINT) AS position, value FROM oh WHERE value = 1""")
    q["user_features"] = _q(_feature_long() + """
SELECT user_id, CAST(position AS BIGINT) AS position, round(CAST(value AS DOUBLE), 6) AS value FROM feat""")
    q["candidates"] = _q("""
SELECT u.accommodation_id, count(*) AS n_users, CAST(count(*) * max(r.n) AS BIGINT) AS n_pairs
FROM users u JOIN (SELECT accommodation_id, count(*) AS n FROM reviews GROUP BY 1) r
  ON r.accommodation_id = u.accommodation_id
GROUP BY u.accommodation_id""")
    q["group_review_ids"] = _q(f"""
SELECT accommodation_id, CAST(rn // {GROUP_BLOCK} AS BIGINT) AS block_id, count(*) AS n,
       string_agg(CAST(review_id AS VARCHAR), ',' ORDER BY review_id) AS review_ids
FROM rev_num GROUP BY accommodation_id, rn // {GROUP_BLOCK}""")
    q["pairs_in_group"] = _q("""
SELECT accommodation_id, count(*) * count(*) AS pairs, count(*) AS positives
FROM matches WHERE user_id % 10 < 8 GROUP BY accommodation_id""")
    q["dot_scores"] = _q("SELECT user_id, review_id, round(list_inner_product(uvec, rvec), 6) AS score FROM pairs")
    q["cosine_scores"] = _q(f"SELECT user_id, review_id, round({COS.format(a='uvec', b='rvec')}, 6) AS score FROM pairs")
    q["euclid_scores"] = _q("""
SELECT user_id, review_id,
  round(sqrt(list_sum(list_transform(range(1, len(uvec) + 1),
        lambda i: (uvec[i] - rvec[i] + 1e-6) * (uvec[i] - rvec[i] + 1e-6)))), 6) AS score FROM pairs""")
    rank_body = """,
q AS MATERIALIZED (SELECT user_id, accommodation_id, vec FROM uvec WHERE user_id % 10 = 8),
cand AS (
  SELECT q.user_id, r.review_id AS cand_id, round({score}, 6) AS s
  FROM q JOIN rvec r ON r.accommodation_id = q.accommodation_id),
ranked AS (
  SELECT user_id, cand_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, cand_id) AS rk FROM cand),
tr AS (
  SELECT m.user_id, r.rk AS rank FROM matches m JOIN ranked r ON r.user_id = m.user_id AND r.cand_id = m.review_id
  WHERE m.user_id % 10 = 8)
"""
    dot_rank = rank_body.format(score="list_inner_product(q.vec, r.vec)")
    cos_rank = rank_body.format(score=COS.format(a="q.vec", b="r.vec"))
    rr = "CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END"
    q["target_rank"] = _q(dot_rank + f"SELECT user_id, CAST(rank AS BIGINT) AS rank, round({rr}, 6) AS rr FROM tr")
    q["mrr_all"] = _q(dot_rank + f"SELECT count(*) AS n_users, round(avg({rr}), 6) AS mrr FROM tr")
    q["mrr_cosine"] = _q(cos_rank + f"SELECT count(*) AS n_users, round(avg({rr}), 6) AS mrr FROM tr")
    q["mrr_matched"] = _q(f""",
v AS MATERIALIZED (SELECT * FROM pairs WHERE split_no = 8),
cand AS (
  SELECT a.user_id, b.review_id AS cand_id, b.user_id AS cand_user, a.review_id AS t_id,
         round(list_inner_product(a.uvec, b.rvec), 6) AS s
  FROM v a JOIN v b ON a.accommodation_id = b.accommodation_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, cand_id, cand_user) AS rk FROM cand),
tr AS (SELECT user_id, rk AS rank FROM ranked WHERE cand_id = t_id AND cand_user = user_id)
SELECT count(*) AS n_users, round(avg({rr}), 6) AS mrr FROM tr""")
    topk = """,
q AS MATERIALIZED (SELECT user_id, accommodation_id, vec FROM uvec WHERE user_id % 10 = 9),
cand AS (
  SELECT q.user_id, q.accommodation_id, r.review_id, round(list_inner_product(q.vec, r.vec), 6) AS s
  FROM q JOIN rvec r ON r.accommodation_id = q.accommodation_id),
ranked AS (
  SELECT user_id, accommodation_id, review_id,
         row_number() OVER (PARTITION BY user_id ORDER BY s DESC, review_id) AS rk FROM cand),
top AS (SELECT * FROM ranked WHERE rk <= 10)
"""
    q["topk10"] = _q(topk + "SELECT user_id, CAST(rk AS BIGINT) AS rank, review_id FROM top")
    q["topk10_bounded"] = q["topk10"]  # the same lists
    cols = ",\n       ".join(f"coalesce(max(CASE WHEN rk = {i} THEN review_id END), min(first_id)) AS review_{i}"
                              for i in range(1, 11))
    q["top10_wide"] = _q(topk + f""",
firsts AS (SELECT accommodation_id, min(review_id) AS first_id FROM rvec GROUP BY accommodation_id),
w AS (
  SELECT t.accommodation_id, t.user_id,
       {cols}
  FROM top t JOIN firsts f ON f.accommodation_id = t.accommodation_id
  GROUP BY t.accommodation_id, t.user_id)
SELECT row_number() OVER (ORDER BY accommodation_id, user_id) AS "ID", * FROM w""")
    q["top10_stream"] = q["top10_wide"]  # same lists, computed by the stream
    ln_body = f""",
lv AS (SELECT vec_id AS id, x, pos FROM (SELECT vec_id, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS pos FROM vec)),
st AS (SELECT id, avg(x) AS mu FROM lv GROUP BY id),
var AS (SELECT l.id, avg((l.x - s.mu) * (l.x - s.mu)) AS v FROM lv l JOIN st s USING (id) GROUP BY l.id),
y AS (SELECT l.id, l.pos, (l.x - s.mu) / sqrt(v.v + 1e-5) AS y
      FROM lv l JOIN st s USING (id) JOIN var v USING (id) WHERE l.pos <= {TRUNCATE_DIM}),
nrm AS (SELECT id, greatest(sqrt(sum(y * y)), 1e-12) AS nn FROM y GROUP BY id),
z AS (SELECT y.id, y.pos, y.y / n.nn AS z FROM y JOIN nrm n USING (id))
"""
    q["layernorm_truncate_l2"] = _q(ln_body + """
SELECT id AS vec_id, CAST(pos AS BIGINT) AS position, round(z, 6) AS value FROM z""")
    q["review_vector"] = _q(ln_body + f""",
sc AS (
  SELECT review_id,
    CASE WHEN hi1 > lo1 THEN (review_score - lo1) / (hi1 - lo1) ELSE review_score - lo1 END AS s1,
    CASE WHEN hi2 > lo2 THEN (review_helpful_votes - lo2) / (hi2 - lo2) ELSE review_helpful_votes - lo2 END AS s2
  FROM reviews, (SELECT min(review_score) lo1, max(review_score) hi1, CAST(min(review_helpful_votes) AS DOUBLE) lo2,
                        CAST(max(review_helpful_votes) AS DOUBLE) hi2 FROM reviews))
SELECT r.review_id, CAST(z.pos AS BIGINT) AS position, round(z.z, 6) AS value
FROM reviews r JOIN z ON z.id = r.review_id % (SELECT n FROM n_vec)
UNION ALL SELECT review_id, {TRUNCATE_DIM + 1}, round(s1, 6) FROM sc
UNION ALL SELECT review_id, {TRUNCATE_DIM + 2}, round(s2, 6) FROM sc""")
    q["hashed_text_vector"] = _q(f""",
tok AS (SELECT review_id, unnest(string_split(lower({PROMPT_SHORT_SQL}), ' ')) AS t FROM reviews_filled),
cnt AS (SELECT review_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {HASH_DIM} AS bucket, CAST(count(*) AS DOUBLE) AS c
        FROM tok WHERE t <> '' GROUP BY 1, 2),
nrm AS (SELECT review_id, sqrt(sum(c * c)) AS nn FROM cnt GROUP BY 1)
SELECT c.review_id, CAST(c.bucket + 1 AS BIGINT) AS position, round(c.c / n.nn, 6) AS value
FROM cnt c JOIN nrm n USING (review_id)""")
    q["batches"] = _q(f""",
b AS ({_batches_sql('user_id')})
SELECT accommodation_id, batch_id, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS id_sum, min(user_id) AS id_min,
       md5(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id)) AS ids_md5 FROM b GROUP BY 1, 2""")
    q["shuffled_batches"] = _q(f""",
b AS ({_batches_sql(h32(f'user_id + {SHUFFLE_SEED}') + ', user_id')})
SELECT accommodation_id, batch_id, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS id_sum, min(user_id) AS id_min,
       md5(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id)) AS ids_md5 FROM b GROUP BY 1, 2""")
    losses = _batch_losses("user_id")
    q["loss_softmax"] = _q(losses + "SELECT accommodation_id, batch_id, round(loss_softmax, 6) AS loss FROM per_batch")
    q["loss_bce"] = _q(losses + "SELECT accommodation_id, batch_id, round(loss_bce, 6) AS loss FROM per_batch")
    q["loss_contrastive"] = _q(losses + "SELECT accommodation_id, batch_id, round(loss_contrastive, 6) AS loss FROM per_batch")
    q["loss_cosine"] = _q(f"""
SELECT {split_sql('user_id')} AS split, round(avg(1.0 - {COS.format(a='uvec', b='rvec')}), 6) AS loss
FROM pairs GROUP BY 1""")
    epochs = []
    for e in range(EPOCHS):
        body = _batch_losses(h32(f"user_id + {e}") + ", user_id").replace("b AS MATERIALIZED", f"b{e} AS MATERIALIZED")
        body = body.replace("FROM b x JOIN b y", f"FROM b{e} x JOIN b{e} y")
        for name in ("s AS", "per_user AS", "per_batch AS"):
            body = body.replace(name, name.replace(" AS", f"{e} AS"))
        body = body.replace("FROM s)", f"FROM s{e})").replace("FROM per_user GROUP", f"FROM per_user{e} GROUP")
        epochs.append(body)
    q["loss_epoch_mean"] = _q("".join(epochs) + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT CAST({e} AS BIGINT) AS epoch, round(avg(loss_softmax), 6) AS loss FROM per_batch{e}"
        for e in range(EPOCHS)) + ")")
    q["nonfinite_counts"] = _q(losses + """
SELECT 'embedding_values' AS key,
       CAST((SELECT count(*) FROM (SELECT unnest(vec) AS x FROM vec) WHERE isnan(x) OR isinf(x)) AS BIGINT) AS value
UNION ALL
SELECT 'loss_softmax', CAST((SELECT count(*) FROM per_batch WHERE isnan(loss_softmax) OR isinf(loss_softmax)) AS BIGINT)""")
    no_test = _feature_long().replace("FROM users", "FROM users_nt")
    q["training_examples"] = _q(f""",
users_nt AS (SELECT * FROM users WHERE user_id % 10 <= 8){no_test},
fs AS ({FEATURE_SUMS})
SELECT m.user_id, m.review_id, md5({PROMPT_FULL_SQL}) AS text_md5, f.n AS n_features, f.total, f.weighted
FROM matches m JOIN reviews_filled r ON r.review_id = m.review_id JOIN fs f ON f.user_id = m.user_id
WHERE m.user_id % 10 < 8""")
    q["pair_vector"] = _q("""
SELECT user_id, review_id, CAST(len(uvec) + len(rvec) AS INTEGER) AS n, round(list_sum(uvec) + list_sum(rvec), 6) AS total,
       round(list_inner_product(uvec, range(1, len(uvec) + 1)::DOUBLE[])
             + list_inner_product(rvec, range(len(uvec) + 1, len(uvec) + len(rvec) + 1)::DOUBLE[]), 6) AS weighted
FROM pairs""")
    q["csv_splits"] = _q(""",
sp AS (SELECT * FROM (VALUES ('train', 0, 7), ('val', 8, 8), ('test', 9, 9)) t(split, lo, hi)),
su AS MATERIALIZED (
  SELECT sp.split, u.user_id, u.accommodation_id,
         coalesce(length(u.guest_country), 0) + coalesce(length(u.guest_type), 0) AS chars,
         concat_ws('|', u.user_id, coalesce(u.guest_country, '~'), coalesce(u.guest_type, '~')) AS line
  FROM users u JOIN sp ON u.user_id % 10 BETWEEN sp.lo AND sp.hi),
sa AS (SELECT DISTINCT split, accommodation_id FROM su),
sr AS (
  SELECT sa.split, r.review_id,
         coalesce(length(r.review_title), 0) + coalesce(length(r.review_positive), 0)
           + coalesce(length(r.review_negative), 0) AS chars,
         concat_ws('|', r.review_id, coalesce(r.review_title, '~'), coalesce(r.review_positive, '~'), coalesce(r.review_negative, '~')) AS line
  FROM reviews r JOIN sa ON sa.accommodation_id = r.accommodation_id)
SELECT split, 'users' AS table_name, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS id_sum,
       CAST(sum(chars) AS BIGINT) AS text_chars,
       CAST(sum(('0x' || substr(md5(line), 1, 8))::BIGINT) AS BIGINT) AS digest_sum FROM su GROUP BY split
UNION ALL
SELECT split, 'reviews', count(*), CAST(sum(review_id) AS BIGINT), CAST(sum(chars) AS BIGINT), CAST(sum(('0x' || substr(md5(line), 1, 8))::BIGINT) AS BIGINT) FROM sr GROUP BY split
UNION ALL
SELECT sp.split, 'matches', count(*), CAST(sum(m.user_id) AS BIGINT), CAST(0 AS BIGINT),
       CAST(sum(('0x' || substr(md5(CAST(m.user_id AS VARCHAR)), 1, 8))::BIGINT) AS BIGINT)
FROM matches m JOIN sp ON m.user_id % 10 BETWEEN sp.lo AND sp.hi WHERE sp.split <> 'test' GROUP BY sp.split""")
    # jobs whose output is a query's result read back from a file: the same SQL checks them
    q["csv_roundtrip"] = q["top10_wide"]
    q["cache_roundtrip"] = q["review_vector"]
    review_vector_ctes, review_vector_rows = q["review_vector"][len(FIXTURE):].rsplit("\nSELECT r.review_id", 1)
    q["prepare_all"] = _q(_feature_long() + f""",
fs AS ({FEATURE_SUMS}){review_vector_ctes},
rv AS (SELECT review_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total
       FROM (SELECT r.review_id{review_vector_unrounded(review_vector_rows)}) GROUP BY review_id)
SELECT m.user_id, m.review_id, m.accommodation_id, {split_sql('m.user_id')} AS split, f.n AS n_user_features,
       f.total AS user_total, f.weighted AS user_weighted, rv.n AS n_review_features, rv.total AS review_total
FROM matches m JOIN fs f ON f.user_id = m.user_id JOIN rv ON rv.review_id = m.review_id
WHERE m.user_id % 10 <= 8""")
    users_x = _feature_long() + """,
ux AS MATERIALIZED (SELECT user_id, list(coalesce(CAST(value AS DOUBLE), 0) ORDER BY position) AS x FROM feat GROUP BY user_id)"""
    reviews_x = review_vector_ctes + f""",
rx AS MATERIALIZED (SELECT review_id, list(value ORDER BY position) AS x
       FROM (SELECT r.review_id{review_vector_unrounded(review_vector_rows)}) GROUP BY review_id)"""
    enc_u, enc_r = mlp_sql("eu", "ux", "user_id", [64, 32, 16], 0), mlp_sql("er", "rx", "review_id", [64, 32, 16], 1)
    long = """
SELECT {key}, CAST(pos AS BIGINT) AS position, round(v, 6) AS value FROM (SELECT {key}, unnest(y) AS v, unnest(range(1, 17)) AS pos FROM {t})"""
    q["encode_users"] = _q(users_x + enc_u + long.format(key="user_id", t="eu"))
    q["encode_reviews"] = _q(reviews_x + enc_r + long.format(key="review_id", t="er"))
    q["pair_score"] = _q(users_x + enc_u + reviews_x + enc_r + """,
px AS MATERIALIZED (SELECT m.user_id, list_concat(a.y, b.y) AS x FROM matches m JOIN eu a ON a.user_id = m.user_id
       JOIN er b ON b.review_id = m.review_id WHERE m.user_id % 10 <= 8)""" + mlp_sql("bs", "px", "user_id", [32, 16, 1], 2) + """
SELECT m.user_id, m.review_id, round(s.y[1], 6) AS score FROM bs s JOIN matches m ON m.user_id = s.user_id""")
    towers = (""",
tux AS (SELECT user_id, y AS x FROM eu), trx AS (SELECT review_id, y AS x FROM er)""" + mlp_sql("tu", "tux", "user_id", [32, 16], 3, True)
              + mlp_sql("tr", "trx", "review_id", [32, 16], 4, True))

    def bridged(pairs: str) -> str:
        """``bz(key, y)``: the bridge on ``pairs(key, x)``."""
        return pairs + mlp_sql("bz", "zx", "key", [32, 16, 1], 2)

    q["pair_batch_loss"] = _q(users_x + enc_u + reviews_x + enc_r + towers + """,
bt AS MATERIALIZED (SELECT m.accommodation_id, m.user_id, m.review_id,
         CAST(floor((row_number() OVER (PARTITION BY m.accommodation_id ORDER BY m.user_id) - 1) / 32) AS BIGINT) AS batch_id
       FROM matches m WHERE m.user_id % 10 < 8),
bp AS MATERIALIZED (SELECT row_number() OVER () AS key, a.accommodation_id, a.batch_id, a.user_id AS ui, b.user_id AS uj, b.review_id
       FROM bt a JOIN bt b ON a.accommodation_id = b.accommodation_id AND a.batch_id = b.batch_id)""" + bridged(""",
zx AS MATERIALIZED (SELECT key, list_concat(u.y, r.y) AS x FROM bp JOIN tu u ON u.user_id = bp.ui JOIN tr r ON r.review_id = bp.review_id)""") + """,
bl AS (SELECT accommodation_id, batch_id, ui, avg(greatest(bz.y[1], 0) - bz.y[1] * CASE WHEN ui = uj THEN 1.0 ELSE 0.0 END + ln(1 + exp(-abs(bz.y[1])))) AS loss
       FROM bp JOIN bz USING (key) GROUP BY 1, 2, 3)
SELECT accommodation_id, batch_id, round(avg(loss), 6) AS loss FROM bl GROUP BY 1, 2""")
    q["pair_mrr"] = _q(users_x + enc_u + reviews_x + enc_r + towers + """,
pv AS MATERIALIZED (SELECT user_id, review_id, accommodation_id FROM matches WHERE user_id % 10 = 8),
pp AS MATERIALIZED (SELECT row_number() OVER () AS key, a.user_id, a.review_id AS t_id, b.review_id AS cand_id, b.user_id AS cand_user
       FROM pv a JOIN pv b ON a.accommodation_id = b.accommodation_id)""" + bridged(""",
zx AS MATERIALIZED (SELECT key, list_concat(u.y, r.y) AS x FROM pp JOIN tu u ON u.user_id = pp.user_id JOIN tr r ON r.review_id = pp.cand_id)""") + f""",
ranked AS (SELECT pp.*, row_number() OVER (PARTITION BY pp.user_id ORDER BY round(bz.y[1], 6) DESC, cand_id, cand_user) AS rank FROM pp JOIN bz USING (key))
SELECT count(*) AS n_users, round(avg({rr}), 6) AS mrr FROM ranked WHERE cand_id = t_id AND cand_user = user_id""")

    def lists(scores: str) -> str:
        """The wide lists from ``scored(user_id, accommodation_id, review_id, s)`` over the items ``held(review_id, accommodation_id)``."""
        return scores + f""",
top AS (SELECT * FROM (SELECT user_id, accommodation_id, review_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, review_id) AS rk FROM scored) WHERE rk <= 10),
firsts AS (SELECT accommodation_id, min(review_id) AS first_id FROM held GROUP BY accommodation_id),
w AS (SELECT t.accommodation_id, t.user_id, {cols} FROM top t JOIN firsts f ON f.accommodation_id = t.accommodation_id GROUP BY t.accommodation_id, t.user_id)
SELECT row_number() OVER (ORDER BY accommodation_id, user_id) AS "ID", * FROM w"""

    q["pair_top10_formula"] = _q(users_x + enc_u + reviews_x + enc_r + towers + """,
held AS (SELECT review_id, accommodation_id FROM reviews),
pp AS MATERIALIZED (SELECT row_number() OVER () AS key, u.user_id, u.accommodation_id, h.review_id FROM users u
       JOIN held h ON h.accommodation_id = u.accommodation_id WHERE u.user_id % 10 = 9)""" + bridged(""",
zx AS MATERIALIZED (SELECT key, list_concat(u.y, r.y) AS x FROM pp JOIN tu u ON u.user_id = pp.user_id JOIN tr r ON r.review_id = pp.review_id)""") + lists(""",
scored AS (SELECT pp.user_id, pp.accommodation_id, pp.review_id, round(bz.y[1], 6) AS s FROM pp JOIN bz USING (key))"""))
    q["mrr_drawn"] = _q(f""",
v AS MATERIALIZED (SELECT * FROM pairs WHERE split_no = 8),
g AS (SELECT accommodation_id, row_number() OVER (ORDER BY accommodation_id) AS ordinal FROM (SELECT DISTINCT accommodation_id FROM v)),
d AS (SELECT g.accommodation_id, count(*) AS times FROM (SELECT range AS draw FROM range(0, {DRAWS})) d
      JOIN g ON g.ordinal = {h32(f'd.draw + {DRAW_SEED}')} % (SELECT count(*) FROM g) + 1 GROUP BY 1),
cand AS (SELECT a.user_id, b.review_id AS cand_id, b.user_id AS cand_user, a.review_id AS t_id, d.times,
                round(list_inner_product(a.uvec, b.rvec), 6) AS s
         FROM v a JOIN v b ON a.accommodation_id = b.accommodation_id JOIN d ON d.accommodation_id = a.accommodation_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, cand_id, cand_user) AS rank FROM cand)
SELECT CAST(sum(times) AS BIGINT) AS n_users, round(sum(times * {rr}) / sum(times), 6) AS mrr FROM ranked WHERE cand_id = t_id AND cand_user = user_id""")
    token_ctes = q["hashed_text_vector"][len(FIXTURE):].rsplit("\nSELECT", 1)[0]

    def from_texts(split: int) -> str:
        """``eu`` of all users and ``er`` of the reviews of a split's accommodations, these made of their texts."""
        return users_x + enc_u + f""",
held AS MATERIALIZED (SELECT r.* FROM reviews r WHERE r.accommodation_id IN (SELECT accommodation_id FROM users WHERE user_id % 10 = {split})){token_ctes},
dense AS (SELECT d.review_id AS vec_id, list(coalesce(c.c / n.nn, 0.0) ORDER BY g.b) AS vec
          FROM (SELECT review_id FROM held) d CROSS JOIN (SELECT unnest(range({HASH_DIM})) AS b) g
          LEFT JOIN cnt c ON c.review_id = d.review_id AND c.bucket = g.b LEFT JOIN nrm n ON n.review_id = d.review_id GROUP BY 1)""" + \
            ln_body.replace("FROM vec)", "FROM dense)").replace("nrm", "nrm2") + """,
sc AS (
  SELECT review_id,
    CASE WHEN hi1 > lo1 THEN (review_score - lo1) / (hi1 - lo1) ELSE review_score - lo1 END AS s1,
    CASE WHEN hi2 > lo2 THEN (review_helpful_votes - lo2) / (hi2 - lo2) ELSE review_helpful_votes - lo2 END AS s2
  FROM held, (SELECT min(review_score) lo1, max(review_score) hi1, CAST(min(review_helpful_votes) AS DOUBLE) lo2,
                     CAST(max(review_helpful_votes) AS DOUBLE) hi2 FROM held)),
rx AS MATERIALIZED (SELECT z.id AS review_id, list_concat(list(z.z ORDER BY z.pos), [any_value(sc.s1), any_value(sc.s2)]) AS x
       FROM z JOIN sc ON sc.review_id = z.id GROUP BY z.id)""" + enc_r

    q["mrr_text"] = _q(from_texts(8) + f""",
cand AS (SELECT m.user_id, m.review_id AS t_id, h.review_id AS cand_id, round(list_inner_product(u.y, r.y), 6) AS s
         FROM matches m JOIN eu u ON u.user_id = m.user_id JOIN held h ON h.accommodation_id = m.accommodation_id
         JOIN er r ON r.review_id = h.review_id WHERE m.user_id % 10 = 8),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, cand_id) AS rank FROM cand)
SELECT count(*) AS n_users, round(avg({rr}), 6) AS mrr FROM ranked WHERE cand_id = t_id""")
    q["top10_text"] = _q(from_texts(9) + lists(""",
scored AS (SELECT u.user_id, h.accommodation_id, h.review_id, round(list_inner_product(a.y, r.y), 6) AS s
           FROM users u JOIN eu a ON a.user_id = u.user_id JOIN held h ON h.accommodation_id = u.accommodation_id
           JOIN er r ON r.review_id = h.review_id WHERE u.user_id % 10 = 9)"""))
    running = losses + """SELECT accommodation_id, batch_id, round(avg(loss_softmax) OVER (PARTITION BY accommodation_id ORDER BY batch_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running FROM per_batch"""
    q["loss_running_mean"] = _q(running)
    return q
