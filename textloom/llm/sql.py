"""SQL of the first three problems: every pair that shares a run of the right length is counted, without sketches or fingerprints.

The bare form is that of the core's SQL (see ``plans/q_lines``): exact for the
characters that the tables hold.  Pairs are found by the least run hashes of each
text, as many as remain beyond the share that must be in common, and decided on
all of them.
"""

from __future__ import annotations

from textloom.plans.q_lines import _LOOSE

_BARE = r"regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{Nd}}]', '', 'g')"


def _bare(x: str) -> str:
    return _BARE.format(x=_LOOSE.format(x=x))


def _grams(t: str, k: int) -> str:
    """Distinct runs of k characters of a text that has as many."""
    return f"unnest(list_distinct(list_transform(range(1, length({t}) - {k - 2}), lambda i: substr({t}, i, {k}))))"


_LEAKED = f"""
 WITH i AS (SELECT id AS nikl_id, {_bare('src')} AS t FROM nikl_pairs WHERE split = 'test' AND src IS NOT NULL), ig AS (SELECT nikl_id, {_grams('t', 20)} AS g FROM i WHERE length(t) >= 20),
 d AS (SELECT doc_id, {_bare('text')} AS t FROM documents WHERE text IS NOT NULL), dg AS (SELECT doc_id, {_grams('t', 20)} AS g FROM d WHERE length(t) >= 20)
 SELECT DISTINCT doc_id, nikl_id FROM dg JOIN ig USING (g)"""
_SQUEEZED = r"trim(regexp_replace(lower(text), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' ')"
_NEAR = f"""
 WITH t AS MATERIALIZED (SELECT doc_id, {_SQUEEZED} AS t FROM documents WHERE text IS NOT NULL), g AS MATERIALIZED (SELECT doc_id, hash(g) AS g FROM (SELECT doc_id, {_grams('t', 8)} AS g FROM t WHERE length(t) >= 8)),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS MATERIALIZED (SELECT doc_id, g FROM (SELECT g.*, n, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS r FROM g JOIN n USING (doc_id)) WHERE r <= n - ceil(0.7::DOUBLE * n - 1e-9) + 1),
 c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id < b.doc_id AND least(x.n, y.n) >= 0.7::DOUBLE * greatest(x.n, y.n)),
 m AS (SELECT a, b, count(*) AS common FROM c JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b AND y.g = x.g GROUP BY 1, 2)
 SELECT a AS doc_id_a, b AS doc_id_b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= 0.7::DOUBLE * (x.n + y.n - common)"""
_ACROSS = f"""
 WITH r AS MATERIALIZED (SELECT DISTINCT id, split = 'train' AS train, list_filter(tables, lambda x: x IS NOT NULL) AS codes, {_bare('text')} AS t FROM records WHERE split IN ('train', 'dev', 'eval') AND text IS NOT NULL AND id IS NOT NULL),
 g AS MATERIALIZED (SELECT t, hash(g) AS g FROM (SELECT t, {_grams('t', 5)} AS g FROM (SELECT DISTINCT t FROM r WHERE length(t) >= 20))),
 n AS MATERIALIZED (SELECT t, count(*) AS n FROM g GROUP BY 1),
 p AS MATERIALIZED (SELECT t, g FROM (SELECT g.*, n, row_number() OVER (PARTITION BY t ORDER BY g) AS r FROM g JOIN n USING (t)) WHERE r <= n - ceil(0.6::DOUBLE * n - 1e-9) + 1),
 e AS MATERIALIZED (SELECT p.*, n FROM p JOIN n USING (t) WHERE t IN (SELECT t FROM r WHERE train)), f AS MATERIALIZED (SELECT p.*, n FROM p JOIN n USING (t) WHERE t IN (SELECT t FROM r WHERE NOT train)),
 c AS MATERIALIZED (SELECT DISTINCT e.t AS a, f.t AS b FROM e JOIN f USING (g) WHERE least(e.n, f.n) >= 0.6::DOUBLE * greatest(e.n, f.n)),
 m AS (SELECT a, b, count(*) AS common FROM c JOIN g x ON x.t = a JOIN g y ON y.t = b AND y.g = x.g GROUP BY 1, 2),
 l AS (SELECT a, b FROM m JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE common >= 0.6::DOUBLE * (x.n + y.n - common))
 SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM l JOIN r x ON x.t = a AND x.train JOIN r y ON y.t = b AND NOT y.train WHERE list_has_any(x.codes, y.codes)"""

ORACLES = {"p1_found": _LEAKED, "p2_found": _NEAR, "p3_found": _ACROSS}
