"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

#: Patterns and letters shared with the operators.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6 = f"""
WITH e AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) AS own_key FROM documents),
d AS (SELECT *, own_key || CASE WHEN copy > 0 THEN '#' || copy ELSE '' END AS row_key
    FROM (SELECT *, row_number() OVER (PARTITION BY own_key, source) - 1 AS copy FROM e)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
c AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
    source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, no, source_size, docs, least(cap, coalesce((SELECT max(level) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l),
r AS (SELECT d.*, t.no, t.source_size, t.docs, t.target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
    (CAST('0x' || left(md5('6:' || row_key), 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(ratio + 1e-9) AS whole, greatest(0, target - floor(ratio + 1e-9) * source_size) AS rest,
    least(1, greatest(0, ratio - floor(ratio + 1e-9)) * CASE WHEN size > 0
        THEN sqrt(2.0::DOUBLE * (source_size::DOUBLE / docs) / ((source_size::DOUBLE / docs) + size)) ELSE 1 END) AS p FROM r),
q AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 'inf'::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
o AS (SELECT *, sum(size) OVER (PARTITION BY no ORDER BY q, size, row_key ROWS UNBOUNDED PRECEDING) AS upto FROM q),
i AS (SELECT *, rest > 0 AND upto <= rest AS inside FROM o),
g AS (SELECT no, rest - coalesce(sum(size) FILTER (inside), 0) AS gap FROM i GROUP BY no, rest),
f AS (SELECT i.no, arg_min(row_key, (abs(size - gap), q, row_key)) AS filler FROM i JOIN g USING (no)
    WHERE NOT inside AND rest > 0 AND size > 0 AND abs(size - gap) < gap GROUP BY i.no)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN inside OR row_key = filler THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM i LEFT JOIN f USING (no)
"""

OP7 = rf"""
WITH l AS (SELECT row_no, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
    FROM (SELECT *, row_number() OVER () AS row_no FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
h AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row_no) >= 3),
m AS (SELECT k.*, h.key IS NOT NULL AND doc_id IS DISTINCT FROM holder AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY row_no, doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""

#: The control strings of the chat template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>", "<part>")


def _longer(text: str) -> str:
    """Code points of ``text`` after escaping: one more per backslash and per control string."""
    grown = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROL)]
    return f"(length({text}) + {' + '.join(grown)})"


OP4 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY no) AS said,
    coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '') AS masked,
    sum({_longer("role")} + {_longer("text")} + 20) AS formatted_chars,
    sum(coalesce(len(regexp_extract_all(text, '{WORD}')), 0)) AS expanded_tokens FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(expanded_tokens AS BIGINT) AS expanded_tokens FROM g
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, doc_id, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) | (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    | (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END)
    | (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    | (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS m FROM d),
c AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS b FROM x p, x q, x r, x s, x u
    WHERE p.b | q.b | r.b | s.b | u.b = 31),
st AS (SELECT filter_order, step, b[step] AS own, list_sum(list_slice(b, 1, step)) - b[step] AS earlier FROM o, unnest([1, 2, 3, 4, 5]) k(step)),
r AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER ((m & (own | earlier)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((m & earlier) = 0 AND (m & own) > 0), 0) AS removed,
    coalesce(sum(n) FILTER ((m & earlier) > 0 AND (m & own) > 0), 0) AS redundant, coalesce(sum(n) FILTER (m = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER ((m & earlier) = 0 AND (m & own) > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER ((m & earlier) = 0 AND (m & own) > 0), 0) AS toxic_lost
    FROM c, (SELECT filter_order, step, own, earlier::BIGINT AS earlier FROM st) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

SQL = {"op4_chat_format": OP4, "op6_mixing": OP6, "op7_line_dedup": OP7, "op9_exact_dedup": OP9, "op12_filter_audit": OP12}
