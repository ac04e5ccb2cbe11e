r"""SQL twins of the operators that SQL can express, for an independent engine.

Words: the six white-space characters are written chr(9) to chr(13) and a space.
"""

from __future__ import annotations

_WORD = "'[^' || chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+'"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {_WORD})"


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {words('t')} AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
hit AS (SELECT DISTINCT rid, i + k AS p FROM (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1), (SELECT unnest([0, 1, 2, 3, 4]) AS k)),
rep AS (SELECT rid, count(*) AS n FROM hit GROUP BY 1),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
dl AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln WHERE regexp_matches(l, {_WORD}) GROUP BY 1),
st AS (SELECT rid, count(*) AS n FROM (SELECT rid, w, unnest(generate_series(2, len(w))) AS i FROM w WHERE len(w) > 1) WHERE w[i] = w[i - 1] GROUP BY 1),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(st.n, 0) AS n_stutters
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN st USING (rid)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines OR 10 * n_stutters > 3 * n_words) AS kept
FROM v
"""

def _round(k: int) -> str:
    """Documents that fit what is open, in key order; then what is open after them."""
    return f"""a{k} AS (SELECT *, NOT taken AND size > 0 AND size <= open AND open > 0.001::DOUBLE * target AS cand FROM t{k - 1}),
b{k} AS (SELECT *, CASE WHEN cand THEN sum(CASE WHEN cand THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rn ROWS UNBOUNDED PRECEDING) END AS run FROM a{k}),
t{k} AS (SELECT * EXCLUDE (taken, open, cand, run), taken OR coalesce(cand AND run <= open, false) AS taken,
  open - coalesce(max(CASE WHEN cand AND run <= open THEN run END) OVER (PARTITION BY source), 0) AS open FROM b{k}),"""


#: More passes than any source needs on the tables; a pass that nothing fits in changes nothing.
_PASSES = 12
_ROUNDS = "\n".join(_round(k) for k in range(1, _PASSES + 1))

MIX = f"""
WITH q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
d AS (SELECT d.doc_id, d.source, d.text, CAST(len({words("coalesce(text, '')")}) AS BIGINT) AS size, CASE WHEN q.doc_id IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
  row_number() OVER (PARTITION BY d.doc_id, d.source, d.text) AS nth
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || coalesce(':' || md5(text), '') || CASE WHEN nth > 1 THEN ':' || CAST(nth - 1 AS VARCHAR) ELSE '' END), 1, 13) AS BIGINT) + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY 1),
a AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER o - cap)) / CAST(sum(wt) OVER () - sum(wt) OVER o + wt AS DOUBLE) AS level
  FROM a WINDOW o AS (ORDER BY cap / wt, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(cap, wt * max(level) OVER ()) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(size) OVER o AS reach, row_number() OVER o AS rn
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source WINDOW o AS (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, rest > 0 AND reach <= rest AS fits FROM r),
t0 AS (SELECT *, fits AS taken, rest - coalesce(max(CASE WHEN fits THEN reach END) OVER (PARTITION BY source), 0) AS open FROM f),
{_ROUNDS}
c AS (SELECT *, CASE WHEN NOT taken AND size > 0 THEN row_number() OVER (PARTITION BY source, taken OR size = 0 ORDER BY abs(size - open), rn) END AS near FROM t{_PASSES})
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN taken OR (near = 1 AND abs(size - open) < open) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
sh AS (SELECT DISTINCT rid, g FROM (
  SELECT rid, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
cls AS (SELECT r.a AS rid, min(d.doc_id) AS class_id FROM reach r JOIN d ON d.rid = r.b GROUP BY 1),
deg AS (SELECT a AS rid, count(*) AS k FROM u GROUP BY 1)
SELECT d.doc_id, cls.class_id, CAST(coalesce(deg.k, 0) AS BIGINT) AS n_links FROM d JOIN cls USING (rid) LEFT JOIN deg USING (rid)
"""

LINES = f"""
WITH ln AS (SELECT doc_id, i, t[i] AS l, {words('t[i]')} AS w FROM
  (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL))),
wl AS (SELECT doc_id, i, len(w) AS n, w, array_to_string(w, ' ') AS s, doc_id * 1000000 + i AS seat FROM ln WHERE len(w) > 0),
firsts AS (SELECT s, min(seat) AS seat, any_value(n) AS n, any_value(w) AS w FROM wl GROUP BY s),
del AS (SELECT seat, n, k, md5(array_to_string(list_concat(w[1:k-1], w[k+1:n]), ' ')) AS h FROM (SELECT seat, n, w, unnest(generate_series(1, n)) AS k FROM firsts WHERE n >= 8)),
repl AS (SELECT seat FROM (SELECT seat, min(seat) OVER (PARTITION BY h, k, n) AS m FROM del) WHERE m < seat),
full_ AS (SELECT seat, md5(s) AS h FROM firsts WHERE n >= 8),
ins AS (SELECT greatest(del.seat, full_.seat) AS seat FROM del JOIN full_ USING (h)),
gone AS (SELECT seat FROM repl UNION SELECT seat FROM ins),
stay AS (SELECT seat FROM firsts WHERE seat NOT IN (SELECT seat FROM gone)),
agg AS (SELECT doc_id, count(*) FILTER (WHERE len(w) > 0) AS n_lines, count(*) FILTER (WHERE len(w) > 0 AND kept) AS n_kept,
  coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE kept), '') AS text
  FROM (SELECT *, len(w) = 0 OR doc_id * 1000000 + i IN (SELECT seat FROM stay) AS kept FROM ln) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept, agg.text FROM documents d LEFT JOIN agg USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": MIX, "op5_quality_rules": QUALITY, "op7_jaccard_join": JACCARD, "op10_line_dedup": LINES}
