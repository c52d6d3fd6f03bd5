"""The queries that SQL can express, for DuckDB over views named like the tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op6_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g ON t.x = g.x
"""

SQL["op7_line_dedup"] = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, array_to_string(ls[pos + 1:pos + 3], chr(10)) AS win FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3)),
f AS (SELECT win, min((doc_id, pos)) AS first, count(*) AS n FROM w GROUP BY win HAVING count(*) > 1),
k AS (SELECT doc_id, CASE WHEN doc_id = first[1] THEN greatest(pos, first[2] + 3) ELSE pos END AS a, pos + 3 AS b FROM w JOIN f USING (win) WHERE NOT (doc_id = first[1] AND pos = first[2])),
r AS (SELECT doc_id, list(DISTINCT line ORDER BY line) AS removed FROM (SELECT doc_id, unnest(range(a, b)) AS line FROM k) GROUP BY doc_id),
o AS (SELECT doc_id, text, ls, coalesce(removed, []) AS gone FROM l LEFT JOIN r USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, len(gone) AS n_removed, array_to_string(gone, ',') AS removed,
    CASE WHEN len(gone) = 0 THEN text ELSE array_to_string([ls[i + 1] FOR i IN range(len(ls)) IF NOT list_contains(gone, i)], chr(10)) END AS text
FROM o
"""

SQL["op9_mixing"] = r"""
WITH s AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
o AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM o),
e AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
v AS (SELECT *, CASE WHEN share * w <= cap THEN share END AS fit FROM e),
t AS (SELECT source, source_size, coalesce(first_value(fit IGNORE NULLS) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * w, cap) AS target FROM v),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget, sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - (upto - size))) ELSE 0 END)::BIGINT AS taken
FROM d
"""


def _licences() -> str:
    """Cosines of passages to the templates, then the nearest folder above with a licence."""
    from kinetable.llm.licenses import ANCHORS, TEMPLATES

    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))

    def anchored(text: str) -> str:
        return "(" + " OR ".join(f"contains(lower({text}), '{a}')" for a in ANCHORS) + ")"

    def terms(text: str) -> str:
        return f"regexp_extract_all(lower({text}), '([a-z0-9]+(?:[.-][a-z0-9]+)*)', 1)"

    return rf"""
WITH tpl(template, license, body) AS (VALUES {values}),
tw AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({terms('body')}) AS term FROM tpl) GROUP BY ALL),
d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', CASE WHEN doc_id % 1000 = 0 THEN concat_ws('/', source, lang) ELSE concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR)) END,
    CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path FROM documents),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({terms('text')}) AS term FROM d) WHERE term IN (SELECT term FROM tw) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tw) LEFT JOIN df USING (term) CROSS JOIN n),
tv AS (SELECT template, license, term, tf * idf AS w FROM tw JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tv GROUP BY template),
ps AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)),
    string_split(regexp_replace(text, '\n\s*\n', chr(1), 'g'), chr(1))))) AS p FROM d WHERE {anchored('text')}),
pw AS (SELECT doc_id, p, term, count(*) AS tf FROM (SELECT doc_id, p, unnest({terms('p')}) AS term FROM ps WHERE {anchored('p')}) GROUP BY ALL),
pv AS (SELECT doc_id, p, term, tf * coalesce(idf, ln(1.0::DOUBLE + n) + 1) AS w FROM pw LEFT JOIN idf USING (term) CROSS JOIN n),
pn AS (SELECT doc_id, p, sqrt(sum(w * w)) AS length FROM pv GROUP BY ALL),
s AS (SELECT doc_id, license, max(score) AS score FROM (SELECT pv.doc_id, tv.license, round(sum(pv.w * (tv.w / norm)) / any_value(length), 6) AS score
    FROM pv JOIN tv USING (term) JOIN tn USING (template) JOIN pn ON pn.doc_id = pv.doc_id AND pn.p = pv.p GROUP BY pv.doc_id, pv.p, tv.template, tv.license) WHERE score >= 0.6 GROUP BY ALL),
own AS (SELECT doc_id, arg_min(license, (-score, license)) AS license, max(score) AS score FROM s GROUP BY doc_id),
f AS (SELECT d.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, license, score FROM d LEFT JOIN own USING (doc_id)),
decl AS (SELECT dir, arg_min(license, (-score, license)) AS license FROM f WHERE regexp_matches(path, '(^|/)LICENSE$') AND license IS NOT NULL GROUP BY dir),
inh AS (SELECT f.doc_id, arg_max(decl.dir, length(decl.dir)) AS from_dir, arg_max(decl.license, length(decl.dir)) AS inherited
    FROM f JOIN decl ON f.dir = decl.dir OR starts_with(f.dir, decl.dir || '/') WHERE f.license IS NULL GROUP BY f.doc_id)
SELECT doc_id, path, coalesce(license, inherited) AS license, score, CASE WHEN license IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, from_dir
FROM f LEFT JOIN inh USING (doc_id)
"""


SQL["op3_licenses"] = _licences()

SQL["op11_infill"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS s FROM documents),
h AS (SELECT doc_id, x, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(s, i, 8) AS BIGINT)) AS h FROM t),
f AS (SELECT doc_id, x, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""

SQL["op12_prefix_trie"] = r"""
WITH t AS (SELECT conv_id AS c, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
    FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS i FROM t),
-- crc32 of the decimal id: each byte goes in, then eight shifts
k AS (SELECT c, c - c % 20 AS b, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
l AS (SELECT k.*, least(h, (SELECT count(*) FROM t WHERE t.c = k.b)) AS lent FROM k),
r AS (SELECT l.c, i.i AS d, m, w FROM l JOIN i ON i.c = l.b AND i.i <= l.lent UNION ALL SELECT l.c, i.i - h + lent, m, w FROM l JOIN i ON i.c = l.c AND i.i > l.h),
p AS (SELECT c, 0 AS d, []::VARCHAR[] AS key, 0 AS w FROM l UNION ALL SELECT c, d, list(m) OVER (PARTITION BY c ORDER BY d), w FROM r),
e AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, max(d) AS d FROM p GROUP BY c) JOIN p USING (c, d) GROUP BY key),
n AS (SELECT key, d, min(c) AS c, count(*) AS n, min(w) AS w FROM p GROUP BY key, d),
s AS (SELECT n.*, (SELECT count(*) FROM n AS o WHERE o.d = n.d + 1 AND o.key[1:n.d] = n.key) AS kids FROM n),
u AS (SELECT key[1:j] AS top, sum((kids = 0)::INT) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM s) GROUP BY 1)
SELECT s.c AS conv_id, s.d::BIGINT AS depth, q.c AS parent_conv_id, s.n AS n_convs, s.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM s JOIN u ON u.top = s.key LEFT JOIN n AS q ON q.d = s.d - 1 AND q.key = s.key[1:s.d - 1] AND s.d > 0 LEFT JOIN e ON e.key = s.key
"""
