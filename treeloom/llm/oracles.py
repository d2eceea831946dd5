"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""WITH n AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM n WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) m FROM win GROUP BY h),
dup AS (SELECT doc_id, i FROM win JOIN f USING (h) WHERE m < doc_id),
cov AS (SELECT DISTINCT doc_id, i + k p FROM dup, range(0, 50) r(k)),
pos AS (SELECT doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) p FROM n),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) k, count(*) c FROM pos ANTI JOIN cov USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT n_words, (len(ws) - coalesce(c, 0))::BIGINT n_removed, sha256(coalesce(k, '')) kept_sha256 FROM n LEFT JOIN kept USING (doc_id)"""

def ngram_classes(words: int, percent: int, more: str = "") -> str:
    """Components of documents by the likeness of their shingles; more: further result columns."""
    return rf"""WITH RECURSIVE n AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {words - 1}], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) i FROM n WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) k FROM s GROUP BY 1),
e AS (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, count(*) met FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * met >= {percent} * (ca.k + cb.k - met)),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id r FROM n UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r)
SELECT n.doc_id, coalesce(any_value(k), 0)::BIGINT n_shingles, min(r) component_id{more} FROM n JOIN reach USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY 1"""


NGRAM_JOIN = ngram_classes(3, 90)
ODD_SKETCHES = ngram_classes(4, 80, ", n.doc_id = min(r) kept")

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') g FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) i FROM w, (VALUES (1), (2), (3)) t(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, g, count(*) f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, g, f a, string_split(g, ' ') ws FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT lang, g, a, k, array_to_string(ws[1:k], ' ') x, array_to_string(ws[k + 1:], ' ') y FROM (SELECT *, unnest(range(1, m)) k FROM c)),
s AS (SELECT k.lang, k.g, a, k, x.f l, y.f r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) score FROM k JOIN f x ON x.lang = k.lang AND x.g = k.x JOIN f y ON y.lang = k.lang AND y.g = k.y),
o AS (SELECT lang, g, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
z AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') g, max(a) most FROM (SELECT *, unnest([1, 2]) i FROM c WHERE m = 3) GROUP BY ALL),
e AS (SELECT o.* FROM o LEFT JOIN z USING (lang, g) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT score FROM e JOIN n USING (lang) QUALIFY rank <= 2000"""

HARD_NEGATIVES = """WITH r AS (SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END lab, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT a.id a, b.id b, a.lab = b.lab same, list_inner_product(a.v, b.v)::BIGINT score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a anchor_id, p.b positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INTEGER AS rank, s.b negative_id, p.score positive_score, s.score negative_score FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""
