"""SQL (DuckDB) with the same rows as the queries that SQL can express."""

from __future__ import annotations

from .conversations import LEGAL, Costs
from .filter_audit import FILTERS

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_LETTERS = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(FILTERS))
_N = len(FILTERS)
_ALL = ", ".join(f"l{k}" for k in range(_N))
_DIFFERENT = " AND ".join(f"l{a}.c <> l{b}.c" for b in range(_N) for a in range(b))
FILTER_AUDIT = rf"""WITH l(c, bit) AS (VALUES {_LETTERS}),
o AS (SELECT {" || ".join(f"l{k}.c" for k in range(_N))} AS filter_order FROM {", ".join(f"l l{k}" for k in range(_N))} WHERE {_DIFFERENT}),
st AS (SELECT filter_order, CAST(i AS INTEGER) AS step, l.c, l.bit, coalesce((SELECT CAST(sum(e.bit) AS INTEGER) FROM l e WHERE contains(left(filter_order, CAST(i - 1 AS INTEGER)), e.c)), 0) AS earlier
 FROM o, range(1, {_N + 1}) t(i), l WHERE l.c = substr(filter_order, i, 1)),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT w.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, st.c, sum(CASE WHEN (mask & (earlier | bit)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN (mask & bit) <> 0 AND (mask & earlier) = 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN (mask & bit) <> 0 AND (mask & earlier) <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN (mask & bit) <> 0 AND (mask & earlier) = 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN (mask & bit) <> 0 AND (mask & earlier) = 0 THEN x ELSE 0 END) AS toxic_lost FROM c, st GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r"""


# A state is one text, its cost in nine digits and its audit, so that texts compare as (cost, audit) do.
def _put(state: str, cost: str | int, letter: str) -> str:
    return f"(lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}')"


def _inserted(c: Costs) -> str:
    """s2 and s3 with what one insertion reaches."""
    return f"least(s2, {', '.join(_put(s, c.insert, 'I') for s in ('s0', 's1', 's3'))}) AS s2, least(s3, {_put('s2', c.insert, 'I')}) AS s3"


def _conversations(c: Costs) -> str:
    """The fold as a recursive query; what is repaired follows from the audit, whose cheapest never inserts at these costs."""
    stay = f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN fault = 'truncated' THEN {c.truncated} ELSE 0 END"
    to_u = "least(s0, s1, s3)"
    turned = f"""{_put("s0", c.delete, "D")} AS s0, least({_put("s1", c.delete, "D")}, CASE WHEN c = 's' THEN {_put("s0", "stay", "K")} END) AS s1,
 least({_put("s2", c.delete, "D")}, CASE WHEN c = 'u' THEN {_put(to_u, "stay", "K")} END, {_put(to_u, f"stay + {c.rerole}", "R")}) AS s2,
 least({_put("s3", c.delete, "D")}, CASE WHEN c = 'a' THEN {_put("s2", "stay", "K")} END, {_put("s2", f"stay + {c.rerole}", "R")}) AS s3"""
    twice = f"SELECT * EXCLUDE (s2, s3), {_inserted(c)} FROM (SELECT * EXCLUDE (s2, s3), {_inserted(c)} FROM ({{}}))"
    legal = ", ".join(f"'{x}'" for x in LEGAL)
    return rf"""WITH RECURSIVE
p AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a // 256, p.crc[(xor(a, b) % 256) + 1])), 4294967295) % 20 AS k FROM named, p),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM dealt),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), nth) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, nth) AS seen FROM hurt),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM told),
ends AS (SELECT conv_id, max(i) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
 coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY 1),
pairs AS (SELECT conv_id, count(*) FILTER (WHERE pair NOT IN ({legal})) AS illegal FROM (SELECT conv_id, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM f) GROUP BY 1),
g AS ({twice.format("SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM f)")}
 UNION ALL {twice.format(f"SELECT conv_id, i, {turned} FROM (SELECT g.conv_id, f.i, f.c, {stay} AS stay, s0, s1, s2, s3 FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i + 1)")}),
best AS (SELECT g.conv_id, CAST(left(least(s0, s3), 9) AS BIGINT) AS cost, substr(least(s0, s3), 10) AS audit FROM g JOIN ends ON ends.conv_id IS NOT DISTINCT FROM g.conv_id AND ends.n = g.i),
edits AS (SELECT f.conv_id, f.i, role, text, substr(audit, CAST(f.i AS INTEGER), 1) AS edit FROM f JOIN best ON best.conv_id IS NOT DISTINCT FROM f.conv_id),
kept AS (SELECT *, sum(CASE WHEN edit = 'K' AND left(role, 1) = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS j FROM edits WHERE edit <> 'D'),
fixed AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS repaired_sha256 FROM kept GROUP BY 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN pairs ON pairs.conv_id IS NOT DISTINCT FROM a.conv_id
 LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM a.conv_id"""


CONVERSATIONS = _conversations(Costs())
