"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from dupstream.plans.fixture_sql import DA, DH, DV, LONG_MIN_SQL, WORD_LIST, near_ctes, with_fx

# Stored index = images before the middle of the time range.
SPLIT_SQL = "(SELECT (min(datetime) + max(datetime)) // 2 FROM posts_fx)"
NOW_SQL = "(SELECT max(datetime) + 86400 FROM posts_fx)"

ORACLE: dict[str, str] = {}


def _ham(a: str, b: str) -> str:
    return f"CAST(bit_count(xor(coalesce({a}, 0), coalesce({b}, 0))) AS INTEGER)"


def _pc32(x: str) -> str:
    return f"CAST(bit_count(xor(coalesce({x}, 0) & 4294967295, 2147483648) - 2147483648) AS INTEGER)"


def _pc_sm(x: str) -> str:
    return (f"(CASE WHEN {x} = {LONG_MIN_SQL} THEN 1 ELSE "
            f"CAST(bit_count(abs(CASE WHEN {x} = {LONG_MIN_SQL} THEN 0 ELSE {x} END)) AS INTEGER) END)")


_NEAR = near_ctes()

ORACLE["near_pairs"] = with_fx(*_NEAR) + "SELECT a, b, diff_a, diff_d FROM near"

ORACLE["near_pairs_exact_bits"] = with_fx(*near_ctes(bits="tbits")) + \
    "SELECT a, b, diff_a, diff_d FROM near"

ORACLE["near_pairs_returned"] = with_fx(*_NEAR) + \
    "SELECT a, b, diff_a, diff_d FROM near WHERE diff_a <= 3 AND diff_d <= 10"

_STORED = [c.replace("images_fx WHERE NOT animated", f"images_fx WHERE NOT animated AND datetime < {SPLIT_SQL}")
           .replace("still", "s_still").replace("roots", "s_roots").replace("members", "s_members")
           .replace("root_edges", "s_root_edges").replace("near AS", "s_near AS")
           for c in _NEAR]
ORACLE["near_pairs_new_only"] = with_fx(*_NEAR, *_STORED) + \
    "SELECT a, b, diff_a, diff_d FROM near ANTI JOIN s_near USING (a, b)"

_EXACT = ["anim AS (SELECT id, crc FROM images_fx WHERE animated)",
          "ex_roots AS (SELECT crc, min(id) AS root FROM anim GROUP BY crc)"]
ORACLE["exact_pairs"] = with_fx(*_EXACT) + \
    "SELECT r.root AS a, x.id AS b FROM anim x JOIN ex_roots r USING (crc) WHERE x.id <> r.root"

ORACLE["exact_groups"] = with_fx() + """
SELECT crc, count(*) AS n, min(id) AS first_id, max(id) AS last_id
FROM images_fx WHERE animated GROUP BY crc HAVING count(*) > 1"""

ORACLE["hash_scan"] = with_fx() + f"SELECT {WORD_LIST}, imagepath FROM images_fx WHERE NOT animated"

ORACLE["hash_by_path"] = with_fx() + f"""
SELECT {WORD_LIST}, id FROM images_fx
WHERE NOT animated AND imagepath IN (SELECT 'i/' || link || '.jpg' FROM posts_fx WHERE score >= 40)"""

ORACLE["sql_functions"] = with_fx() + f"""
SELECT id,
       {_ham('ahash_1', 'dhash_h_1')} AS h3,
       {_ham('ahash_2', 'ahash_3')} AS h1,
       {_ham('dhash_v_1', 'NULL')} AS h2_null,
       xor(coalesce(ahash_1, 0), coalesce(ahash_4, 0)) AS x14,
       xor(CAST(0 AS BIGINT), coalesce(dhash_v_2, 0)) AS x_null,
       {_pc32('ahash_2')} AS pc32
FROM images_fx"""

_WORDS = WORD_LIST.split(", ")
ORACLE["popcounts"] = with_fx() + f"""
SELECT id,
       xor(ahash_1, dhash_h_1) AS x,
       {_ham('ahash_1', 'ahash_2')} AS ham,
       {_pc32('ahash_1')} AS pc32,
       {_pc_sm('ahash_1')} AS pc_sm,
       {_pc_sm('xor(ahash_1, dhash_v_4)')} AS ham_sm,
       {' + '.join(_pc_sm(w) for w in _WORDS)} AS ref_bits,
       {' + '.join(f'CAST(bit_count({w}) AS INTEGER)' for w in _WORDS)} AS true_bits,
       ({' + '.join(f'CAST({w} AS HUGEINT)' for w in _WORDS)}) = 0 AS zero_sum
FROM images_fx"""

ORACLE["signed_words"] = """
WITH s AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bit_string
  FROM embeddings)
SELECT vec_id, bit_string, CAST(CAST(bit_string AS BIT) AS BIGINT) AS word FROM s"""


_GRAPH = _NEAR + _EXACT + [
    """nodes AS (
  SELECT m.id, m.root AS k, FALSE AS animated FROM members m
  UNION ALL SELECT x.id, r.root AS k, TRUE AS animated FROM anim x JOIN ex_roots r USING (crc))""",
    """linked AS (SELECT a, b FROM root_edges
  WHERE diff_a <= 5 AND dh <= 8 AND dv <= 8 AND diff_a <= 3 AND dh + dv <= 10)""",
    """adj AS (SELECT a AS k1, b AS k2 FROM linked UNION ALL SELECT b AS k1, a AS k2 FROM linked
  UNION ALL SELECT DISTINCT k AS k1, k AS k2 FROM nodes)""",
    """np AS (SELECT n.id, n.k, n.animated, p.id AS pid, p.datetime, p.userurl, p.userid, p.link, p.title
  FROM nodes n JOIN images_fx i ON i.id = n.id JOIN posts_fx p ON p.id = i.post_id)""",
]
_ASC = "datetime, userurl NULLS FIRST, userid NULLS FIRST, link, title"
_DESC = "datetime DESC, userurl DESC NULLS LAST, userid DESC NULLS LAST, link DESC, title DESC"


def _post_cols(alias: str, prefix: str) -> str:
    return ", ".join(f"{alias}.{c} AS {prefix}_{c}" for c in ["datetime", "userurl", "userid", "link", "title"])


_SUMMARY = with_fx(*_GRAPH, """dups AS (
  SELECT x.pid AS x, x.animated, y.datetime, y.userurl, y.userid, y.link, y.title
  FROM np x JOIN adj ON adj.k1 = x.k JOIN np y ON y.k = adj.k2
  WHERE y.datetime < x.datetime)""", f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY {_ASC}) AS r_first,
         row_number() OVER (PARTITION BY x ORDER BY {_DESC}) AS r_last,
         count(*) OVER (PARTITION BY x) AS seen
  FROM dups)""", f"""summary AS (
  SELECT f.x AS id, f.animated AS by_crc, f.seen, {_post_cols('f', 'first')}, {_post_cols('l', 'last')},
         f.link <> l.link AS trip
  FROM ranked f JOIN ranked l ON f.x = l.x AND f.r_first = 1 AND l.r_last = 1)""")

ORACLE["duplicate_summary"] = _SUMMARY + "SELECT * FROM summary"
ORACLE["duplicates_before"] = _SUMMARY + "SELECT id, seen, last_link, last_datetime FROM summary"

ORACLE["neighbours_before"] = with_fx(*_GRAPH, """cand AS (
  SELECT x.pid AS x, x.animated, y.datetime, y.userurl, y.userid, y.link, y.title
  FROM np x JOIN adj ON adj.k1 = x.k JOIN np y ON y.k = adj.k2
  WHERE y.datetime <= x.datetime AND y.id <> x.id)""", f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY {_ASC}) AS r FROM cand)""") + f"""
SELECT x AS id, animated, {_post_cols('ranked', 'nb')} FROM ranked WHERE r = 1"""


_LIST = "datetime, userurl, link, title"
_SPLIT_CTES = [f"idx AS (SELECT * FROM images_fx WHERE datetime < {SPLIT_SQL})",
               f"qry AS (SELECT * FROM images_fx WHERE datetime >= {SPLIT_SQL})"]


def _lookup_sql(match_cte: str, qry_filter: str) -> dict[str, str]:
    base = with_fx(*_SPLIT_CTES, match_cte, f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY {_DESC}) AS rank_desc,
            row_number() OVER (PARTITION BY q ORDER BY {_ASC}) AS rank_asc FROM m)""")
    return {
        "all": base + f"SELECT q, CAST(rank_desc AS INTEGER) AS rank, {_LIST} FROM ranked WHERE rank_desc <= 1024",
        "count": base + f"""SELECT l.id AS q, count(m.q) AS n FROM qry l LEFT JOIN m ON m.q = l.id
WHERE {qry_filter} GROUP BY l.id""",
        "newest": base + f"SELECT q, {_LIST} FROM ranked WHERE rank_desc = 1",
        "oldest": base + f"SELECT q, {_LIST} FROM ranked WHERE rank_asc = 1",
    }


_SIM = _lookup_sql(f"""m AS (
  SELECT l.id AS q, p.datetime, p.userurl, p.userid, p.link, p.title
  FROM qry l JOIN idx r ON NOT l.animated AND NOT r.animated AND abs(l.bits - r.bits) < 20
       AND {DA} <= 3 AND {DH} <= 5 AND {DV} <= 5
  JOIN posts_fx p ON p.id = r.post_id)""", "NOT l.animated")
_DIG = _lookup_sql("""m AS (
  SELECT l.id AS q, p.datetime, p.userurl, p.userid, p.link, p.title
  FROM qry l JOIN idx r ON l.crc = r.crc JOIN posts_fx p ON p.id = r.post_id)""", "TRUE")
_COMB = _lookup_sql(f"""m AS (
  SELECT l.id AS q, p.datetime, p.userurl, p.userid, p.link, p.title
  FROM qry l JOIN idx r ON NOT l.animated AND NOT r.animated
       AND {DA} <= 3 AND {DH} + {DV} <= 10
  JOIN posts_fx p ON p.id = r.post_id)""", "NOT l.animated")
for _k in ("all", "count", "newest", "oldest"):
    ORACLE[f"similar_{_k}"] = _SIM[_k]
    ORACLE[f"same_digest_{_k}"] = _DIG[_k]
ORACLE["avg_exists_combined"] = _COMB["newest"]


# ---- report ------------------------------------------------------------------
from dupstream.operators.limits import MISS_WINDOW  # noqa: E402
from dupstream.sources.tables import BLOCK_ADD_VALUE, BLOCK_REMOVE_VALUE, SUMMON_ID_FACTOR  # noqa: E402

_BLOCK_CTES = [
    f"""add_lines AS (SELECT CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR)
         WHEN 1 THEN ' ' || CAST(user_id AS VARCHAR) || ' ' ELSE 'x' || CAST(user_id AS VARCHAR) END AS line
  FROM events WHERE event_type = 'error' AND value >= {BLOCK_ADD_VALUE})""",
    f"""rm_lines AS (SELECT CAST(user_id AS VARCHAR) AS line FROM events
  WHERE event_type = 'signup' AND value >= {BLOCK_REMOVE_VALUE})""",
    """blocked AS (
  SELECT DISTINCT TRY_CAST(trim(line) AS BIGINT) AS userid FROM add_lines
  WHERE regexp_full_match(trim(line), '[+-]?[0-9]+') AND TRY_CAST(trim(line) AS BIGINT) IS NOT NULL
  EXCEPT
  SELECT TRY_CAST(trim(line) AS BIGINT) AS userid FROM rm_lines
  WHERE regexp_full_match(trim(line), '[+-]?[0-9]+') AND TRY_CAST(trim(line) AS BIGINT) IS NOT NULL)""",
]
ORACLE["blocklist"] = "WITH " + ",\n".join(_BLOCK_CTES) + "\nSELECT userid FROM blocked"


def _levn(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) + length({b}) = 0 THEN 0.0 "
            f"ELSE levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)")


def _norm(x: str) -> str:
    return f"trim(lower(coalesce({x}, '')))"


def _bar(sim: str) -> str:
    v = f"(({sim}) * 5.0)"
    stars = f"(CAST(floor({v}) AS INTEGER) + CASE WHEN floor({v}) < 5 AND {v} - floor({v}) >= 0.5 THEN 1 ELSE 0 END)"
    return f"(repeat('★', {stars}) || repeat('☆', 5 - {stars}))"


_SP = ["sp AS (SELECT s.*, p.datetime AS x_datetime, p.title AS x_title, p.userurl AS x_userurl, "
       "p.userid AS x_userid, p.link AS x_link, p.score AS x_score FROM summary s JOIN posts_fx p ON p.id = s.id)"]
_SUMMARY_SP = _SUMMARY.rstrip("\n") + ",\n" + _SP[0] + "\n"

ORACLE["title_distance"] = _SUMMARY_SP + f"""
SELECT id,
  CAST(levenshtein({_norm('last_title')}, {_norm('x_title')}) AS INTEGER) AS last_distance,
  {_levn(_norm('last_title'), _norm('x_title'))} AS last_norm,
  CAST(levenshtein({_norm('first_title')}, {_norm('x_title')}) AS INTEGER) AS first_distance,
  {_levn(_norm('first_title'), _norm('x_title'))} AS first_norm
FROM sp"""

ORACLE["similarity_bar"] = _SUMMARY_SP + f"""
SELECT id, {_bar('1.0 - ' + _levn(_norm('last_title'), _norm('x_title')))} AS last_bar,
       {_bar('1.0 - ' + _levn(_norm('first_title'), _norm('x_title')))} AS first_bar
FROM sp"""


def _duration(v: str) -> str:
    units = [(1.0, "seconds"), (60.0, "minutes"), (3600.0, "hours"), (86400.0, "days"),
             (604800.0, "weeks"), (30758400.0, "years")]
    case_div = "CASE " + " ".join(f"WHEN CAST({v} AS DOUBLE) >= {u} THEN {u}" for u, _ in reversed(units[1:])) + " ELSE 1.0 END"
    case_name = "CASE " + " ".join(f"WHEN CAST({v} AS DOUBLE) >= {u} THEN '{n}'" for u, n in reversed(units[1:])) + " ELSE 'seconds' END"
    return f"(printf('%.1f', CAST({v} AS DOUBLE) / CAST({case_div} AS DOUBLE)) || ' ' || {case_name})"


ORACLE["time_gap_text"] = _SUMMARY_SP + f"""
SELECT id, {_duration('x_datetime - last_datetime')} AS last_gap,
       {_duration('x_datetime - first_datetime')} AS first_gap
FROM sp"""


def _pybin(x: str) -> str:
    return (f"(CASE WHEN {x} < 0 THEN '-0b' || (CASE WHEN {x} = {LONG_MIN_SQL} THEN '1' || repeat('0', 63) "
            f"ELSE bin(-{x}) END) ELSE '0b' || bin({x}) END)")


def _mismatch(a: str, b: str) -> str:
    return (f"CAST(len(list_filter(range(1, least(length({a}), length({b})) + 1), "
            f"lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) AS INTEGER)")


ORACLE["string_mismatch"] = with_fx(*_NEAR, """ret AS (SELECT a, b FROM root_edges
  WHERE diff_a <= 5 AND dh <= 8 AND dv <= 8 AND diff_a <= 3 AND dh + dv <= 10)""",
  """j AS (SELECT ret.a, ret.b, ia.ahash_1 AS wa, ib.ahash_1 AS wb, pa.title AS ta, pb.title AS tb
  FROM ret JOIN images_fx ia ON ia.id = ret.a JOIN images_fx ib ON ib.id = ret.b
  JOIN posts_fx pa ON pa.id = ret.a JOIN posts_fx pb ON pb.id = ret.b)""") + f"""
SELECT a, b, {_mismatch('ta', 'tb')} AS title_mismatch, {_mismatch(_pybin('wa'), _pybin('wb'))} AS bin_mismatch
FROM j"""

# the distance of the SQL engine counts UTF-8 bytes; the positions are read from hex texts
ORACLE["text_distance"] = with_fx(*_NEAR, """ret AS (SELECT a, b FROM root_edges
  WHERE diff_a <= 5 AND dh <= 8 AND dv <= 8 AND diff_a <= 3 AND dh + dv <= 10)""",
  """j AS (SELECT ret.a, ret.b, da.text AS ta, db.text AS tb, hex(encode(da.text)) AS ha, hex(encode(db.text)) AS hb
  FROM ret JOIN documents da ON da.doc_id = ret.a JOIN documents db ON db.doc_id = ret.b)""",
  "k AS (SELECT *, levenshtein(ta, tb) AS d, greatest(strlen(ta), strlen(tb)) AS longer FROM j)") + """
SELECT a, b, CAST(len(list_filter(list_zip(regexp_extract_all(ha, '..'), regexp_extract_all(hb, '..')),
    lambda p: p[1] <> p[2])) AS INTEGER) AS mismatch,
  CAST(d AS INTEGER) AS distance, longer = 0 OR d / longer < 0.4 AS alike
FROM k"""

_DECISION = _SUMMARY_SP.rstrip("\n") + ",\n" + ",\n".join(_BLOCK_CTES) + f""",
dec AS (
  SELECT sp.id, x_score >= 40 AS score_ok,
    {NOW_SQL} < x_datetime + 259200 AS fresh,
    (x_userurl IS NOT NULL AND b.userid IS NOT NULL) AS author_blocked,
    ({_levn(_norm('x_title'), _norm('last_title'))} < 0.4 OR (abs(x_datetime - last_datetime) < 5184000
      AND NOT list_contains(string_split(lower(coalesce(x_title, '')), ' '), 'mrw')
      AND NOT list_contains(string_split(lower(coalesce(x_title, '')), ' '), 'mfw')
      AND NOT starts_with(lower(coalesce(x_title, '')), 'when'))) AS title_ok,
    (x_userurl IS NULL OR x_userurl IS DISTINCT FROM last_userurl) AS other_author,
    (x_userid IS DISTINCT FROM 0 OR x_userid IS DISTINCT FROM last_userid) AS other_id
  FROM sp LEFT JOIN blocked b ON b.userid = sp.x_userid),
decision AS (
  SELECT id, score_ok, fresh, author_blocked, other_author,
         fresh AND NOT author_blocked AND title_ok AND other_author AND other_id AS decision,
         score_ok AND fresh AND NOT author_blocked AND title_ok AND other_author AND other_id AS post_it
  FROM dec),
report_log AS (
  SELECT p.link AS post_id FROM decision d JOIN posts_fx p ON p.id = d.id
  WHERE d.post_it AND p.datetime < {SPLIT_SQL})
"""
ORACLE["report_decision"] = _DECISION + "SELECT * FROM decision"

from dupstream.functions import text as X  # noqa: E402

_T = {k: v.replace("%i", "%d") for k, v in {
    "dup": X.STR_DUPLICATE, "sim": X.STR_SIMILAR, "dup_first": X.STR_DUPLICATE_FIRST,
    "sim_first": X.STR_SIMILAR_FIRST, "dup_times": X.STR_DUPLICATE_FIRST_TIMES,
    "sim_times": X.STR_SIMILAR_FIRST_TIMES}.items()}


def _info(old: str) -> str:
    return f"('Title similarity: ' || {_bar('1.0 - ' + _levn(_norm(old), _norm('x_title')))})"


_LG, _FG = _duration("x_datetime - last_datetime"), _duration("x_datetime - first_datetime")
ORACLE["report_messages"] = _DECISION + f""",
msg AS (
  SELECT x_link AS post_id,
    CASE WHEN by_crc THEN printf('{_T["dup"]}', {_LG}, last_link, {_info('last_title')})
         ELSE printf('{_T["sim"]}', {_LG}, last_link, {_info('last_title')}) END AS text,
    CASE WHEN NOT trip THEN NULL
         WHEN by_crc AND seen > 2 THEN printf('{_T["dup_times"]}', seen - 1, {_FG}, first_link, {_info('first_title')})
         WHEN by_crc THEN printf('{_T["dup_first"]}', {_FG}, first_link, {_info('first_title')})
         WHEN seen > 2 THEN printf('{_T["sim_times"]}', seen - 1, {_FG}, first_link, {_info('first_title')})
         ELSE printf('{_T["sim_first"]}', {_FG}, first_link, {_info('first_title')}) END AS child_text,
    trip
  FROM sp JOIN decision USING (id) WHERE post_it)
SELECT post_id, text, 5 AS retries, substr(text, 1, 140) AS text_capped, child_text,
       CASE WHEN trip THEN 7 END AS child_retries
FROM msg WHERE post_id NOT IN (SELECT post_id FROM report_log)"""

ORACLE["summon_ids"] = _DECISION + f""",
notif AS (
  SELECT conv_id, turn, conv_id * 1000 + turn AS notif_id,
         CASE WHEN role = 'user' THEN '48' ELSE '7' END AS with_account,
         CASE WHEN turn % 3 = 0 THEN 'someone mentioned you in a comment: glory at {X.GALLERY_URL}'
                || CAST((conv_id * 37 + turn * 11) % (SELECT {SUMMON_ID_FACTOR} * (max(doc_id) + 1) FROM documents) AS VARCHAR) || '/comment/' || CAST(turn AS VARCHAR) || '/'
              WHEN turn % 3 = 1 THEN 'mentioned you in a comment: ' || text ELSE text END AS body
  FROM conversations),
req AS (
  SELECT notif_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, notif_id DESC) AS INTEGER) AS newest_rank,
         coalesce(regexp_extract(body, '{X.SUMMON_PATTERN}', 1), '') AS post_link
  FROM notif WHERE with_account = '48' AND contains(body, 'mentioned you in a comment')),
nbr AS (SELECT DISTINCT x.pid AS nb_id FROM np x JOIN adj ON adj.k1 = x.k JOIN np y ON y.k = adj.k2
        WHERE y.datetime <= x.datetime AND y.id <> x.id)
SELECT r.notif_id, r.post_link, r.newest_rank,
  CASE WHEN r.post_link = '' THEN 'unparsable'
       WHEN r.post_link IN (SELECT post_id FROM report_log) THEN 'already_reported'
       WHEN p.link IS NULL THEN 'unknown'
       WHEN r.post_link IN (SELECT CAST(nb_id AS VARCHAR) FROM nbr) THEN 'repost'
       ELSE 'no_repost' END AS status
FROM req r LEFT JOIN posts_fx p ON p.link = r.post_link"""

ORACLE["miss_limit"] = f"""
WITH m AS (SELECT user_id AS userid, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE event_type = 'error'),
c AS (SELECT userid, ts, count(*) OVER (PARTITION BY userid ORDER BY ts RANGE BETWEEN {MISS_WINDOW} PRECEDING AND CURRENT ROW) AS recent FROM m)
SELECT userid, ts, recent, recent > 10 AS blocked FROM c"""


# ---- statistics, hash groups, pages, ingest, total distance ------------------
from dupstream.sources.tables import (CORRUPT_PAGE_EVERY, ERROR_MESSAGE, ERROR_PAGE_EVERY,  # noqa: E402
                                      IMAGE_HOST, NON_OBJECT_EVERY, POSTS_PER_PAGE)

ORACLE["corpus_stats"] = _DECISION + f""",
ex AS (SELECT x.id FROM anim x JOIN anim y ON x.crc = y.crc AND x.id < y.id),
real_near AS (
  SELECT l.id FROM still l JOIN still r ON l.id < r.id AND abs(l.bits - r.bits) <= 22
  WHERE {DA} <= 5 AND {DH} <= 8 AND {DV} <= 8),
m AS (
  SELECT 'images' AS metric, CAST(count(*) AS DOUBLE) AS value FROM images_fx
  UNION ALL SELECT 'oldest', CAST(min(datetime) AS DOUBLE) FROM posts_fx
  UNION ALL SELECT 'age_years', CAST(({NOW_SQL} - min(datetime)) AS DOUBLE) / 31536000.0 FROM posts_fx
  UNION ALL SELECT 'near_pairs', CAST(count(*) AS DOUBLE) FROM real_near
  UNION ALL SELECT 'exact_pairs', CAST(count(*) AS DOUBLE) FROM ex
  UNION ALL SELECT 'reposts', CAST((SELECT count(*) FROM real_near) + (SELECT count(*) FROM ex) AS DOUBLE)
  UNION ALL SELECT 'blocked', CAST(count(*) AS DOUBLE) FROM blocked
  UNION ALL SELECT 'reports', CAST(count(*) AS DOUBLE) FROM report_log
  UNION ALL SELECT 'report_comments_max', CAST(2 * count(*) AS DOUBLE) FROM report_log)
SELECT metric, value FROM m"""

ORACLE["quality_counts"] = with_fx() + """
SELECT 'no_userid' AS metric, count(*) FILTER (WHERE userid = 0) AS n FROM posts_fx
UNION ALL SELECT 'no_size', count(*) FILTER (WHERE size = 0) FROM images_fx
UNION ALL SELECT 'no_width', count(*) FILTER (WHERE width = -1) FROM images_fx
UNION ALL SELECT 'no_height', count(*) FILTER (WHERE height = -1) FROM images_fx"""

_STACK = """stk AS (
  SELECT id, 'a' AS kind, ahash_1 AS h1, ahash_2 AS h2, ahash_3 AS h3, ahash_4 AS h4 FROM images_fx WHERE NOT animated
  UNION ALL SELECT id, 'dh', dhash_h_1, dhash_h_2, dhash_h_3, dhash_h_4 FROM images_fx WHERE NOT animated
  UNION ALL SELECT id, 'dv', dhash_v_1, dhash_v_2, dhash_v_3, dhash_v_4 FROM images_fx WHERE NOT animated)"""
ORACLE["hash_groups"] = with_fx(_STACK) + """
SELECT kind, h1, h2, h3, h4, count(*) AS n, min(id) AS first_id, max(id) AS last_id
FROM stk GROUP BY kind, h1, h2, h3, h4 HAVING count(*) > 1"""
ORACLE["hash_running"] = with_fx(_STACK, """r AS (
  SELECT id, kind, row_number() OVER w - 1 AS n_before, first_value(id) OVER w AS first_id, lag(id) OVER w AS prev_id
  FROM stk WINDOW w AS (PARTITION BY kind, h1, h2, h3, h4 ORDER BY id))""") + \
    "SELECT id, kind, CAST(n_before AS INTEGER) AS n_before, first_id, prev_id FROM r WHERE n_before > 0"

ORACLE["ahash64_embedding"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e2 AS (SELECT vec_id, v, list_min(v) AS mn, list_max(v) AS mx FROM e),
p AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN mx = mn THEN 0 ELSE CAST(floor(255 * (x - mn) / (mx - mn)) AS INTEGER) END) AS pix FROM e2),
a AS (SELECT vec_id, pix, CAST(list_sum(pix) // 64 AS INTEGER) AS avg FROM p),
h AS (SELECT vec_id, avg, list_sum(list_transform(range(64), lambda i: CASE WHEN pix[i + 1] < avg
        THEN CAST(1 AS HUGEINT) << (63 - i) ELSE CAST(0 AS HUGEINT) END)) AS u FROM a)
SELECT vec_id, avg, CAST(CASE WHEN u >= CAST(9223372036854775808 AS HUGEINT) THEN u - CAST(18446744073709551616 AS HUGEINT) ELSE u END AS BIGINT) AS ahash
FROM h"""

def _image_sql() -> str:
    """Fixed-point Lanczos resampling, level by level, and the hashes of its thumbnails."""
    import numpy as np

    from dupstream.functions.imagehash import WEIGHT_BITS, fixed_weights
    rows = [f"({n}, {o}, {k}, {int(w)})" for n in (8, 9, 16, 17)
            for (o, k), w in np.ndenumerate(fixed_weights(8, n)) if w]
    level = f"least(255, greatest(0, (CAST(sum(v * w) AS BIGINT) + {1 << (WEIGHT_BITS - 1)}) // {1 << WEIGHT_BITS}))"
    pix = ORACLE["ahash64_embedding"].split("a AS (SELECT")[0].rstrip().rstrip(",")

    def words(bits: str, name: str, tag: str) -> str:
        u = "sum(CASE WHEN bit THEN CAST(1 AS HUGEINT) << (63 - CAST(pos % 64 AS INTEGER)) ELSE CAST(0 AS HUGEINT) END)"
        return f"""{name} AS (SELECT vec_id, '{tag}' AS tag, pos // 64 AS word, {u} AS u FROM ({bits}) GROUP BY vec_id, pos // 64)"""

    def mean(side: int, name: str) -> str:
        return words(f"""SELECT vec_id, y * {side} + x AS pos, v < sum(v) OVER (PARTITION BY vec_id) // {side * side} AS bit
                         FROM thumb WHERE nx = {side} AND ny = {side}""", name, f"a{side}")

    def rising(side: int, across: bool, name: str) -> str:
        nx, ny = (side + 1, side) if across else (side, side + 1)
        step = "a.x + 1 = b.x AND a.y = b.y" if across else "a.x = b.x AND a.y + 1 = b.y"
        return words(f"""SELECT a.vec_id, a.y * {side} + a.x AS pos, a.v < b.v AS bit FROM thumb a JOIN thumb b
                         ON a.vec_id = b.vec_id AND a.nx = {nx} AND a.ny = {ny} AND b.nx = {nx} AND b.ny = {ny} AND {step}""",
                     name, f"{'h' if across else 'v'}{side}")

    signed = "CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END AS BIGINT)"
    order = [("ahash", "a"), ("dhash_h", "h"), ("dhash_v", "v")]
    wide = ", ".join(f"max(s) FILTER (WHERE tag = '{t}16' AND word = {i}) AS {n}_{i + 1}" for n, t in order for i in range(4))
    small = ", ".join(f"max(s) FILTER (WHERE tag = '{t}8') AS {n}64" for n, t in order)
    return f"""{pix},
weight(n, o, k, w) AS (VALUES {", ".join(rows)}),
px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM
       (SELECT vec_id, unnest(pix) AS v, unnest(range(64)) AS i FROM p)),
across AS (SELECT vec_id, y, n AS nx, o AS x, {level} AS v FROM px JOIN weight ON k = x GROUP BY vec_id, y, n, o),
thumb AS (SELECT vec_id, nx, n AS ny, x, o AS y, {level} AS v FROM across JOIN weight ON k = y AND abs(n - nx) <= 1
          GROUP BY vec_id, nx, n, x, o),
{mean(8, "a8")}, {mean(16, "a16")}, {rising(8, True, "h8")}, {rising(16, True, "h16")}, {rising(8, False, "v8")},
{rising(16, False, "v16")},
print AS (SELECT vec_id, tag, word, {signed} AS s FROM (SELECT * FROM a8 UNION ALL SELECT * FROM a16 UNION ALL SELECT * FROM h8
          UNION ALL SELECT * FROM h16 UNION ALL SELECT * FROM v8 UNION ALL SELECT * FROM v16)),
flat AS (SELECT vec_id, string_agg(CASE WHEN v * 256 < total THEN '1' ELSE '0' END, '' ORDER BY y, x) AS mean_bits
         FROM (SELECT *, sum(v) OVER (PARTITION BY vec_id) AS total FROM thumb WHERE nx = 16 AND ny = 16) GROUP BY vec_id),
texts AS (SELECT vec_id, string_agg(lpad(bin(u), 64, '0'), '' ORDER BY tag, word) AS rise_bits
          FROM (SELECT * FROM h16 UNION ALL SELECT * FROM v16) GROUP BY vec_id),
prints AS (SELECT vec_id, {wide}, {small} FROM print GROUP BY vec_id)
"""


ORACLE["image_fingerprints"] = _image_sql() + """
SELECT CAST(vec_id AS VARCHAR) AS path, prints.* EXCLUDE (vec_id), mean_bits || rise_bits AS vector768
FROM prints JOIN flat USING (vec_id) JOIN texts USING (vec_id)"""

ORACLE["envelope_split"] = with_fx() + f"""
, pg AS (SELECT doc_id // {POSTS_PER_PAGE} AS page, count(*) AS n FROM fx_base GROUP BY 1)
SELECT page,
  CASE WHEN page % {ERROR_PAGE_EVERY} = 3 THEN 'error' WHEN page % {CORRUPT_PAGE_EVERY} = 5 THEN 'corrupt' ELSE 'ok' END AS outcome,
  CASE WHEN page % {ERROR_PAGE_EVERY} = 3 OR page % {CORRUPT_PAGE_EVERY} = 5 THEN 0 ELSE n END AS n_posts,
  CAST(CASE WHEN page % {ERROR_PAGE_EVERY} = 3 OR page % {CORRUPT_PAGE_EVERY} = 5 THEN 0
       WHEN page % {NON_OBJECT_EVERY} = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_bad,
  CASE WHEN page % {ERROR_PAGE_EVERY} = 3 THEN '{ERROR_MESSAGE}' END AS error_message
FROM pg"""

ORACLE["envelope_posts"] = with_fx() + f"""
SELECT id // {POSTS_PER_PAGE} AS page, link AS id, userurl AS account_url, datetime, score
FROM posts_fx
WHERE NOT ((id // {POSTS_PER_PAGE}) % {ERROR_PAGE_EVERY} = 3 OR (id // {POSTS_PER_PAGE}) % {CORRUPT_PAGE_EVERY} = 5)"""

_REC = f"""rec AS (
  SELECT p.link AS id, p.is_album, p.userid AS account_id, p.score, p.animated,
         '{IMAGE_HOST}' || p.link || CASE WHEN p.animated AND p.id % 4 = 0 THEN '.gif'
              WHEN p.animated THEN 'h.gif' ELSE '.jpg' END AS link,
         CASE WHEN p.animated THEN '{IMAGE_HOST}' || p.link || '.gifv' ELSE '' END AS gifv,
         d.n_chars AS size, CAST(d.n_chars % 900 + 100 AS INTEGER) AS width, CAST(d.n_chars % 700 + 100 AS INTEGER) AS height,
         p.id // {POSTS_PER_PAGE} AS page
  FROM posts_fx p JOIN documents d ON d.doc_id = p.id)"""
_CLS = _REC + f""",
stored AS (SELECT * FROM posts_fx WHERE datetime < {SPLIT_SQL}),
cls AS (
  SELECT r.*, CASE WHEN r.is_album THEN 'album' WHEN s.link IS NOT NULL THEN 'known'
                   WHEN i.id IS NULL THEN 'error' ELSE 'new' END AS outcome
  FROM rec r LEFT JOIN stored s ON s.link = r.id
  LEFT JOIN (SELECT CAST(post_id AS VARCHAR) AS pid, id FROM images_fx WHERE size > 0) i ON i.pid = r.id)"""
ORACLE["post_outcomes"] = _DECISION + ",\n" + _CLS + f""",
refused AS (SELECT p.link FROM decision d JOIN posts_fx p ON p.id = d.id WHERE NOT d.decision),
counted AS (
  SELECT page, count(*) FILTER (WHERE outcome = 'new') AS updates, count(*) FILTER (WHERE outcome = 'known') AS known,
         count(*) FILTER (WHERE outcome = 'new' AND (score < 40 OR id IN (SELECT link FROM refused))) AS skipped,
         count(*) FILTER (WHERE outcome = 'error') AS failed, count(*) FILTER (WHERE outcome = 'album') AS albums
  FROM cls GROUP BY page)
SELECT page, updates, known, skipped,
       failed + CASE WHEN page % {NON_OBJECT_EVERY} = 1 AND page % {ERROR_PAGE_EVERY} <> 3
                      AND page % {CORRUPT_PAGE_EVERY} <> 5 THEN 1 ELSE 0 END AS errors, albums
FROM counted"""
_OK_PAGE = f"NOT (page % {ERROR_PAGE_EVERY} = 3 OR page % {CORRUPT_PAGE_EVERY} = 5)"
ORACLE["live_counters"] = f"""
SELECT CAST(sum(updates) AS BIGINT) AS updates, CAST(sum(known) AS BIGINT) AS known, CAST(sum(skipped) AS BIGINT) AS skipped,
       CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(albums) AS BIGINT) AS albums
FROM ({ORACLE["post_outcomes"]}) WHERE {_OK_PAGE}"""
ORACLE["paged_outcomes"] = with_fx(_CLS) + f"""
SELECT CAST(page > (SELECT max(page) // 2 FROM rec) AS INTEGER) AS batch, page, id, outcome,
       outcome = 'new' AND score < 40 AS low_score
FROM cls WHERE {_OK_PAGE}"""
ORACLE["new_posts"] = with_fx(_CLS) + """
SELECT id, CASE WHEN animated AND ends_with(link, 'h.gif') AND length(gifv) > 0 THEN gifv ELSE link END AS link,
       score FROM cls WHERE outcome = 'new'"""
ORACLE["post_refresh"] = with_fx(_CLS) + f"""
SELECT i.id, coalesce(c.account_id, p.userid) AS userid, coalesce(c.size, i.size) AS size,
       coalesce(c.width, i.width) AS width, coalesce(c.height, i.height) AS height,
       CASE WHEN c.id IS NOT NULL THEN CAST({NOW_SQL} AS DOUBLE) END AS last_checked
FROM images_fx i JOIN stored p ON p.id = i.post_id
LEFT JOIN (SELECT * FROM cls WHERE outcome = 'known') c ON c.id = p.link
WHERE i.datetime < {SPLIT_SQL}"""

_TOTAL = " + ".join(f"CAST(bit_count(xor(l.{w}, r.{w})) AS INTEGER)" for w in _WORDS)
_LSH = _NEAR[:3] + [f"""lsh AS (
  SELECT l.id AS a, r.id AS b, {_TOTAL} AS distance FROM roots l JOIN roots r ON l.id < r.id AND {_TOTAL} <= 20
  UNION ALL SELECT root AS a, id AS b, 0 AS distance FROM members WHERE id <> root)"""]
ORACLE["lsh_pairs"] = with_fx(*_LSH) + "SELECT a, b, distance FROM lsh"
ORACLE["lsh_nearest"] = with_fx(*_LSH, """both_ AS (SELECT a AS id, b AS other, distance FROM lsh
  UNION ALL SELECT b AS id, a AS other, distance FROM lsh)""", """r AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM both_)""") + \
    "SELECT id, other, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"

_VECTORS = f"""still AS (SELECT *, datetime >= {SPLIT_SQL} AS late FROM images_fx WHERE NOT animated),
hits AS (SELECT l.id AS q, r.id, {_TOTAL} AS distance, l.late AND NOT r.late AS across FROM still l JOIN still r ON l.id <> r.id
         AND {_TOTAL} <= 20)"""
ORACLE["lsh_insert_get"] = with_fx(_VECTORS) + f"""
SELECT q, id, distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q, h.id, distance, row_number() OVER (PARTITION BY q ORDER BY distance, h.id) AS rank
  FROM hits h JOIN still a ON a.id = q JOIN still b ON b.id = h.id WHERE across OR (a.late = b.late AND h.id < q)) WHERE rank <= 5"""
ORACLE["lsh_check"] = with_fx(_VECTORS) + """
SELECT s.id AS q, min(distance) AS best, count(distance) > 0 AS found
FROM still s LEFT JOIN hits h ON h.q = s.id AND across WHERE s.late GROUP BY s.id"""

ORACLE["stream_pairs"] = ORACLE["near_pairs"]
ORACLE["stream_miss_limit"] = ORACLE["miss_limit"]


_INGESTED = [c.replace("images_fx WHERE NOT animated",
                       "images_fx WHERE NOT animated AND size > 0 AND post_id IN (SELECT id FROM posts_fx WHERE NOT is_album)") for c in _NEAR]
ORACLE["ingest_posts"] = with_fx(*_INGESTED) + "SELECT a, b, diff_a, diff_d FROM near"
ORACLE["ingest_exact"] = with_fx(
    "anim AS (SELECT id, crc FROM images_fx WHERE animated AND size > 0 "
    "AND post_id IN (SELECT id FROM posts_fx WHERE NOT is_album))",
    "ex_roots AS (SELECT crc, min(id) AS root FROM anim GROUP BY crc)") + \
    "SELECT r.root AS a, x.id AS b FROM anim x JOIN ex_roots r USING (crc) WHERE x.id <> r.root"
_KNOWN = f"(p.datetime < {SPLIT_SQL} AND p.id % 2 = 0)"
ORACLE["ingest_refresh"] = with_fx(_REC) + f"""
SELECT i.id, p.link, CASE WHEN {_KNOWN} OR p.datetime >= {SPLIT_SQL} THEN p.userid + 1000 ELSE p.userid END AS userid,
       CASE WHEN {_KNOWN} THEN r.size + 1 ELSE i.size END AS size, CASE WHEN {_KNOWN} THEN r.width + 2 ELSE i.width END AS width,
       CASE WHEN {_KNOWN} AND r.height % 3 <> 0 THEN r.height + 3 ELSE i.height END AS height,
       CASE WHEN {_KNOWN} THEN CAST({NOW_SQL} AS DOUBLE) END AS last_checked
FROM images_fx i JOIN posts_fx p ON p.id = i.post_id JOIN rec r ON r.id = p.link
WHERE NOT p.is_album AND i.size > 0"""


def _ingested_only(sql: str) -> str:
    """The report SQL over what two batches store: posts of the second have authors
    moved by 1000, and only they are held against the block list."""
    for name in ("posts_fx", "images_fx"):
        sql = sql.replace(f"{name} AS (", f"{name[:-3]}_all AS (", 1)
    split = SPLIT_SQL.replace("posts_fx", "posts_all")
    sql = sql.replace(SPLIT_SQL, split).replace(NOW_SQL, NOW_SQL.replace("posts_fx", "posts_all"))
    sql = sql.replace("b.userid = sp.x_userid", f"b.userid = sp.x_userid AND sp.x_datetime >= {split}")
    more = f"""images_fx AS (SELECT * FROM images_all WHERE size > 0 AND post_id IN (SELECT id FROM posts_all WHERE NOT is_album)),
posts_fx AS (SELECT * REPLACE (CASE WHEN datetime >= {split} THEN userid + 1000 ELSE userid END AS userid) FROM posts_all
             WHERE NOT is_album AND id IN (SELECT post_id FROM images_fx)),
still AS ("""
    return sql.replace("still AS (", more, 1)


ORACLE["ingest_messages"] = _ingested_only(ORACLE["report_messages"].rsplit("SELECT post_id, text, 5 AS retries", 1)[0]) + """
SELECT post_id, text, substr(text, 1, 140) AS text_capped, child_text, CAST(-1 AS BIGINT) AS comment_id FROM msg"""

_REQ = ORACLE["summon_ids"][ORACLE["summon_ids"].index("notif AS ("):ORACLE["summon_ids"].index("nbr AS (")]
_SUMMONED = (ORACLE["report_messages"].rsplit("SELECT post_id, text, 5 AS retries", 1)[0]
             .replace("b.userid = sp.x_userid", "FALSE AND b.userid = sp.x_userid")
             .replace("WHERE post_it)", f"WHERE post_it OR x_datetime >= {SPLIT_SQL})"))
for _n in ("posts_fx", "images_fx"):
    _SUMMONED = _SUMMONED.replace(f"{_n} AS (", f"{_n[:-3]}_all AS (", 1)
_SPLIT_ALL = SPLIT_SQL.replace("posts_fx", "posts_all")
_SUMMONED = _SUMMONED.replace(SPLIT_SQL, _SPLIT_ALL).replace(NOW_SQL, NOW_SQL.replace("posts_fx", "posts_all"))
_SUMMONED = _SUMMONED.replace("still AS (", _REQ + f"""
images_fx AS (SELECT i.* FROM images_all i JOIN posts_all p ON p.id = i.post_id WHERE i.size > 0 AND NOT p.is_album
              AND (p.datetime < {_SPLIT_ALL} OR p.link IN (SELECT post_link FROM req))),
posts_fx AS (SELECT * FROM posts_all WHERE id IN (SELECT post_id FROM images_fx)),
still AS (""", 1)
ORACLE["summon_messages"] = _SUMMONED.rstrip().rstrip(",") + f""",
near_by AS (SELECT x.link, x.animated, x.datetime AS x_datetime, x.title AS x_title, y.datetime, y.userurl, y.userid, y.link AS nb_link, y.title
         FROM np x JOIN adj ON adj.k1 = x.k JOIN np y ON y.k = adj.k2
         WHERE y.datetime <= x.datetime AND y.id <> x.id AND x.datetime < {_SPLIT_ALL}
           AND x.link IN (SELECT post_link FROM req) AND x.link NOT IN (SELECT post_id FROM msg)),
first_by AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY {_ASC.replace("link", "nb_link")}) AS r FROM near_by),
reply AS (SELECT link, printf(CASE WHEN animated THEN '{_T["dup"]}' ELSE '{_T["sim"]}' END,
                              {_duration('x_datetime - datetime')}, nb_link, {_info('title')}) AS text FROM first_by WHERE r = 1)
SELECT post_id, text, substr(text, 1, 140) AS text_capped, child_text, CAST(-1 AS BIGINT) AS comment_id FROM msg
UNION ALL SELECT link, text, substr(text, 1, 140), NULL, CAST(-1 AS BIGINT) FROM reply"""

ORACLE["point_series"] = """
SELECT CAST(CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS DOUBLE) AS ts, count(*) AS value
FROM events GROUP BY 1"""

ORACLE["report_log"] = _DECISION + "SELECT post_id, CAST(-1 AS BIGINT) AS comment_id FROM report_log"
