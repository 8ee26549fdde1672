"""SQL for the operators that SQL can express, over whole tables; DuckDB's dialect."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     sizes AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
     windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sizes)),
     docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
     hits AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.win = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')),
     hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
     hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

#: Bytes are pairs of hexadecimal digits: SQL's substrings count characters.
REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS win FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM docs)),
     twice AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
     starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows WHERE win IN (SELECT win FROM twice)),
     numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
     runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
     gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS kept_from, lead(a) OVER w IS NULL AS final FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
     kept AS (
         SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
                string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || max(CASE WHEN final THEN substr(h, 2 * b + 1) ELSE '' END) AS left_over
         FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""


def _assigned(books: str) -> str:
    """The nearest entry is the least of (squared distance, index), as one number."""
    return f"""(SELECT vec_id, label, p, any_value(x) AS x, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d
                FROM (SELECT q.*, b.e, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda j: (q.x[j] - b.c[j]) * (q.x[j] - b.c[j]))) AS BIGINT) AS d FROM parts q JOIN {books} b USING (p))
                GROUP BY vec_id, label, p)"""


def _moved(assigned: str, books: str) -> str:
    return f"""(SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
                    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c
                    FROM (SELECT p, e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM {assigned}) GROUP BY p, e, j) GROUP BY p, e) m USING (p, e))"""


VECTOR_CODES = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
              FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(0, 16)) AS p FROM kept)),
     seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
     c0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN seeds USING (vec_id)),
     a0 AS MATERIALIZED {_assigned("c0")},
     c1 AS MATERIALIZED {_moved("a0", "c0")},
     a1 AS MATERIALIZED {_assigned("c1")},
     c2 AS MATERIALIZED {_moved("a1", "c1")},
     a2 AS MATERIALIZED {_assigned("c2")},
     codes AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
     totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM codes GROUP BY label),
     books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, label_error, codebooks_sha256, codes.label FROM codes JOIN totals ON codes.label IS NOT DISTINCT FROM totals.label CROSS JOIN books"""


def _dice(group: int) -> str:
    return f"CAST(concat('0x', substr(h, {8 * group + 1}, 8)) AS UBIGINT)"


INFILL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
     dice AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_dice(0)} % (len(u) + 1) AS one, {_dice(1)} % (len(u) + 1) AS two, {_dice(2)} % 100 AS three, {_dice(3)} % 100 AS four FROM docs),
     forms AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR three >= 90 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form FROM dice),
     cuts AS (SELECT *, array_to_string(u[1 : least(one, two)], '') AS prefix, array_to_string(u[least(one, two) + 1 : greatest(one, two)], '') AS middle, array_to_string(u[greatest(one, two) + 1 : n], '') AS suffix FROM forms)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE concat(prefix, middle, suffix) END) AS restored_sha256
FROM cuts"""
