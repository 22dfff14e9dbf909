"""op7_near_copies: the component of near copies that every document is in."""

from pyspark.sql import DataFrame, SparkSession

from .ngramjoin import near_components
from .shared import documents

SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS g FROM w),
c AS MATERIALIZED (SELECT g, min(doc_id) AS id, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s) GROUP BY g HAVING len(g) > 0),
t AS MATERIALIZED (SELECT id, n, unnest(g) AS g FROM c),
p AS (SELECT a.id AS x, b.id AS y, a.n + b.n AS n, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n),
e AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * i >= 90 * (n - i) UNION SELECT y, x FROM p WHERE 100 * i >= 90 * (n - i)),
r AS (SELECT id AS v, id AS top FROM c UNION SELECT e.y, r.top FROM r JOIN e ON e.x = r.v WHERE r.top < e.y),
m AS (SELECT v, min(top) AS top FROM r GROUP BY v),
k AS (SELECT s.doc_id, list_sort(s.g) AS g FROM s)
SELECT k.doc_id, CAST(len(k.g) AS BIGINT) AS n_shingles, coalesce(m.top, k.doc_id) AS component_id FROM k LEFT JOIN c ON k.g = c.g LEFT JOIN m ON m.v = c.id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), n=3, num=90, den=100)
