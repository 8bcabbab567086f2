"""DuckDB SQL text of the derived tables (same definitions as
``dupstream.sources.tables``), used as common table expressions by the
oracle queries."""

from __future__ import annotations

from dupstream.schemas import AHASH, DHASH_H, DHASH_V, WORDS
from dupstream.sources.tables import (ALBUM_EVERY, BLOCK, NO_HEIGHT_EVERY, NO_SIZE_EVERY,
                                      NO_URL_EVERY, NO_WIDTH_EVERY, SPARSE_EVERY)

LONG_MIN_SQL = "(-9223372036854775807 - 1)"


def _word_sql(name: str, i: int, key: str = "fp_id") -> str:
    h = f"md5(CAST({key} // {BLOCK} AS VARCHAR) || '{name}')"
    body = f"CAST('0x' || substr({h}, 1, 15) AS BIGINT)"
    sparse = f"({key} // {BLOCK}) % {SPARSE_EVERY} = 0" if name == "ahash_1" else "FALSE"
    high = f"substr({h}, 16, 1) IN ('8','9','a','b','c','d','e','f')"
    w = f"(CASE WHEN {sparse} THEN {body} & 255 WHEN {high} THEN ~{body} ELSE {body} END)"
    w = (f"(CASE WHEN ({key} % {BLOCK} + {i}) % 3 = 0 "
         f"THEN xor({w}, CAST(1 AS BIGINT) << (({key} % {BLOCK} + {5 * i}) % 60)) ELSE {w} END)")
    if name == "ahash_1":
        w = f"(CASE WHEN {key} % {BLOCK} % 7 = 1 THEN xor({w}, {LONG_MIN_SQL}) ELSE {w} END)"
    return f"{w} AS {name}"


def _popcount_sm(w: str) -> str:
    return (f"(CASE WHEN {w} = {LONG_MIN_SQL} THEN 1 ELSE "
            f"CAST(bit_count(abs(CASE WHEN {w} = {LONG_MIN_SQL} THEN 0 ELSE {w} END)) AS INTEGER) END)")


BASE = """fx_base AS (
  SELECT d.doc_id, d.text, d.n_chars, e.ts, e.user_id, e.event_type, e.value
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""

POSTS_FX = f"""posts_fx AS (
  SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS link, user_id AS userid,
         CASE WHEN user_id % {NO_URL_EVERY} = 0 THEN NULL ELSE 'u' || CAST(user_id AS VARCHAR) END AS userurl,
         CAST(floor(epoch(ts)) AS BIGINT) AS datetime,
         regexp_replace(split_part(text, chr(10), 1), '[^ -~]', '', 'g') AS title,
         CAST(floor(value) AS BIGINT) - doc_id % 7 AS score,
         doc_id % {ALBUM_EVERY} = 0 AS is_album,
         event_type IN ('click', 'view') AS animated
  FROM fx_base)"""

_WORDS_SELECT = ",\n         ".join(_word_sql(w, i) for i, w in enumerate(WORDS))
_BITS = " + ".join(_popcount_sm(w) for w in WORDS)
_TBITS = " + ".join(f"CAST(bit_count({w}) AS INTEGER)" for w in WORDS)
_SUM = " + ".join(f"CAST({w} AS HUGEINT)" for w in WORDS)

IMAGES_FX = f"""fx_first AS (
  SELECT *, md5(text) AS crc, min(doc_id) OVER (PARTITION BY md5(text)) AS fp_id FROM fx_base),
fx_words AS (
  SELECT doc_id AS id, doc_id AS post_id, user_id AS userid,
         CAST(floor(epoch(ts)) AS BIGINT) AS datetime,
         event_type IN ('click', 'view') AS animated,
         {_WORDS_SELECT},
         crc,
         'i/' || CAST(doc_id AS VARCHAR) || '.jpg' AS imagepath,
         CASE WHEN doc_id % {NO_SIZE_EVERY} = 0 THEN CAST(0 AS BIGINT) ELSE n_chars END AS size,
         CASE WHEN doc_id % {NO_WIDTH_EVERY} = 0 THEN -1 ELSE CAST(n_chars % 900 + 100 AS INTEGER) END AS width,
         CASE WHEN doc_id % {NO_HEIGHT_EVERY} = 0 THEN -1 ELSE CAST(n_chars % 700 + 100 AS INTEGER) END AS height
  FROM fx_first),
images_fx AS (
  SELECT *, CASE WHEN animated THEN 0 ELSE {_BITS} END AS bits,
         {_TBITS} AS tbits
  FROM fx_words
  WHERE animated OR ({_SUM}) <> 0)"""


def hamming_sum(l: str, r: str, words) -> str:
    return "(" + " + ".join(f"CAST(bit_count(xor({l}.{w}, {r}.{w})) AS INTEGER)" for w in words) + ")"


DA = hamming_sum("l", "r", AHASH)
DH = hamming_sum("l", "r", DHASH_H)
DV = hamming_sum("l", "r", DHASH_V)
WORD_LIST = ", ".join(WORDS)


def with_fx(*ctes: str) -> str:
    """``WITH`` clause holding the derived tables plus extra CTEs."""
    return "WITH " + ",\n".join([BASE, POSTS_FX, IMAGES_FX, *ctes]) + "\n"


def near_ctes(bits: str = "bits", window: int = 22, max_a: int = 5, max_dh: int = 8,
              max_dv: int = 8) -> list[str]:
    """CTEs ``roots``, ``members``, ``near`` (the stored edge table)."""
    return [
        "still AS (SELECT * FROM images_fx WHERE NOT animated)",
        f"roots AS (SELECT min(id) AS id, {WORD_LIST}, min({bits}) AS bits FROM still GROUP BY {WORD_LIST})",
        f"members AS (SELECT s.id, r.id AS root FROM still s JOIN roots r USING ({WORD_LIST}))",
        f"""root_edges AS (
  SELECT l.id AS a, r.id AS b, {DA} AS diff_a, {DH} AS dh, {DV} AS dv
  FROM roots l JOIN roots r ON l.id < r.id AND abs(l.bits - r.bits) <= {window})""",
        f"""near AS (
  SELECT a, b, diff_a, dh + dv AS diff_d FROM root_edges
  WHERE diff_a <= {max_a} AND dh <= {max_dh} AND dv <= {max_dv}
  UNION ALL
  SELECT root AS a, id AS b, 0 AS diff_a, 0 AS diff_d FROM members WHERE id <> root)""",
    ]
