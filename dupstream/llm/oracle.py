"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from dupstream.llm.mixing import MARGINS, ROUNDS, SEED, TEMPER

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


def _substring_sql(width: int = 13) -> str:
    words = _WORDS.format(text="text")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT doc_id, s, list_slice(w, s, s + {width - 1}) AS k
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {width - 1})) AS s FROM d)),
own AS (SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k),
hit AS (SELECT DISTINCT win.doc_id, unnest(generate_series(s, s + {width - 1})) AS pos
        FROM win JOIN own USING (k) WHERE own.first_doc < win.doc_id),
gone AS (SELECT doc_id, list(pos) AS gone FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(w, generate_series(1, len(w))),
              lambda x: gone IS NULL OR NOT list_contains(gone, x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""


def _jaccard_sql(n: int = 5, percent: int = 75) -> str:
    words = _WORDS.format(text=_LOWER)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {n - 1}) AS k
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {n - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
         WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d
          UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, comp.component_id
FROM d LEFT JOIN size USING (doc_id) JOIN comp ON comp.node = d.doc_id"""


_EXACT_SQL = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)"""


def _mix_sql() -> str:
    topic = ("CASE WHEN contains(t, 'icense') THEN 'license' WHEN contains(t, ' | ') THEN 'table' "
             "WHEN contains(t, '@') OR contains(t, '+1 (') THEN 'contact' WHEN contains(t, chr(10)) THEN 'lines' ELSE 'plain' END")
    parts = [f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic,
             len({_WORDS.format(text="t")})::BIGINT AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS mass, sum(n_tokens)::DOUBLE AS raked FROM d GROUP BY ALL)"""]
    for m in MARGINS:
        parts.append(f"t_{m} AS (SELECT {m}, pow(sum(mass), {TEMPER[m]}) AS share FROM c0 GROUP BY {m} HAVING sum(mass) > 0)")
    last, k = "c0", 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            k += 1
            parts.append(f"""f{k} AS (SELECT {m}, CASE WHEN now > 0 THEN sum(now) OVER () * share / sum(share) OVER () / now ELSE 0 END AS factor
      FROM (SELECT {m}, sum(raked) AS now FROM {last} GROUP BY {m}) LEFT JOIN t_{m} USING ({m})),
c{k} AS MATERIALIZED (SELECT source, lang, topic, mass, raked * factor AS raked FROM {last} JOIN f{k} USING ({m}))""")
            last = f"c{k}"
    return f"""
WITH {", ".join(parts)},
w AS (SELECT source, lang, topic, CASE WHEN mass > 0 THEN raked / mass ELSE 1 END AS weight FROM {last}),
p AS (SELECT source, lang, topic, round(least(weight / (SELECT max(weight) FROM w), 1), 9) AS probability FROM w)
SELECT doc_id, source, lang, topic, n_tokens, probability,
       ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 13))::BIGINT / {float(1 << 52)!r} < probability AS kept
FROM d JOIN p USING (source, lang, topic)"""


def _phrase_sql(support: int = 30, top: int = 2000) -> str:
    return f"""
WITH piece AS (SELECT lang, row_number() OVER () AS pid, piece
               FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\\x0A-\\x0D]')) AS piece
                     FROM (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS x FROM documents))),
w AS (SELECT lang, pid, unnest(ws) AS w1, unnest(generate_series(1, len(ws))) AS pos
      FROM (SELECT lang, pid, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM piece)),
four AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
         FROM w WINDOW p AS (PARTITION BY pid ORDER BY pos)),
run AS (SELECT lang, 1 AS size, [w1] AS words FROM four
        UNION ALL SELECT lang, 2, [w1, w2] FROM four WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, 3, [w1, w2, w3] FROM four WHERE w3 IS NOT NULL
        UNION ALL SELECT lang, 4, [w1, w2, w3, w4] FROM four WHERE w4 IS NOT NULL),
f AS (SELECT lang, size, words, count(*) AS f FROM run GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, words, f AS a FROM f WHERE size > 1 AND f >= {support}),
cut AS (SELECT lang, size, words, a, unnest(generate_series(1, size - 1)) AS k FROM cand),
scored AS (SELECT cut.lang, cut.words, a, k, p.f AS l, q.f AS r, ((2000000::HUGEINT * a) // (p.f + q.f))::BIGINT AS score
           FROM cut JOIN f p ON p.lang = cut.lang AND p.words = list_slice(cut.words, 1, k)
           JOIN f q ON q.lang = cut.lang AND q.words = list_slice(cut.words, k + 1, cut.size)),
weak AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inner_run AS (SELECT lang, a, n, unnest(generate_series(1, size - n + 1)) AS i, words
              FROM cand, (VALUES (2), (3)) AS s(n) WHERE size > n),
covered AS (SELECT DISTINCT cand.lang, cand.words FROM cand
            JOIN inner_run o ON o.lang = cand.lang AND list_slice(o.words, o.i, o.i + o.n - 1) = cand.words
            WHERE 100::HUGEINT * o.a >= 80::HUGEINT * cand.a),
left_over AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score
              FROM weak ANTI JOIN covered USING (lang, words))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
JOIN total USING (lang) WHERE rank <= {top}"""


ORACLE: dict[str, str] = {
    "op1_substring_dedup": _substring_sql(),
    "op2_ngram_jaccard": _jaccard_sql(),
    "op3_mix_sources": _mix_sql(),
    "op7_exact_dedup": _EXACT_SQL,
    "op12_phrases": _phrase_sql(),
}
