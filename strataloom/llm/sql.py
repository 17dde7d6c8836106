"""SQL counterparts of the queries that SQL can express over whole tables."""

from __future__ import annotations

_ITEMS = """
WITH items AS (
  SELECT query_id, code_unit_id,
         max(CASE WHEN isnan(cosine_distance) THEN NULL ELSE -cosine_distance END) AS s0,
         max(CAST(lexical_score AS DOUBLE)) AS s1,
         max(CASE WHEN isnan(hybrid_score) THEN NULL ELSE hybrid_score END) AS s2
  FROM hybrid_results GROUP BY query_id, code_unit_id
), ranked AS (
  SELECT query_id, code_unit_id,
         (rank() OVER (PARTITION BY query_id ORDER BY s0 ASC NULLS FIRST) - 1)
           / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1) AS p0,
         (rank() OVER (PARTITION BY query_id ORDER BY s1 ASC NULLS FIRST) - 1)
           / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1) AS p1,
         (rank() OVER (PARTITION BY query_id ORDER BY s2 ASC NULLS FIRST) - 1)
           / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1) AS p2
  FROM items
)"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "p1_leximin": _ITEMS
        + """, sorted AS (SELECT query_id, code_unit_id, list_sort([p0, p1, p2]) AS v FROM ranked),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, code_unit_id) AS rank
  FROM sorted
)
SELECT query_id, code_unit_id, CAST(rank AS INTEGER) AS rank, round(v[1], 9) AS least_0, round(v[2], 9) AS least_1,
       round(v[3], 9) AS least_2
FROM ordered WHERE rank <= 10""",
        "p1_found": _ITEMS
        + """, losses AS (
  SELECT a.query_id, a.code_unit_id,
         count_if((a.p0 > b.p0)::INT + (a.p1 > b.p1)::INT + (a.p2 > b.p2)::INT < 2) AS unbeaten
  FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.code_unit_id <> b.code_unit_id
  GROUP BY ALL
), few AS (
  SELECT r.* FROM ranked r JOIN losses USING (query_id, code_unit_id) WHERE unbeaten <= 4
), sets AS (
  SELECT a.query_id, [a.code_unit_id, b.code_unit_id, c.code_unit_id, d.code_unit_id, e.code_unit_id] AS five
  FROM few a JOIN few b ON a.query_id = b.query_id AND a.code_unit_id < b.code_unit_id
  JOIN few c ON a.query_id = c.query_id AND b.code_unit_id < c.code_unit_id
  JOIN few d ON a.query_id = d.query_id AND c.code_unit_id < d.code_unit_id
  JOIN few e ON a.query_id = e.query_id AND d.code_unit_id < e.code_unit_id
), broken AS (
  SELECT DISTINCT s.query_id, s.five
  FROM sets s JOIN ranked i ON i.query_id = s.query_id AND list_contains(s.five, i.code_unit_id)
  JOIN ranked o ON o.query_id = s.query_id AND NOT list_contains(s.five, o.code_unit_id)
  WHERE (i.p0 > o.p0)::INT + (i.p1 > o.p1)::INT + (i.p2 > o.p2)::INT < 2
)
SELECT query_id, unnest(five) AS code_unit_id FROM (SELECT * FROM sets EXCEPT SELECT * FROM broken)""",
        "p2_kept": r"SELECT id AS code_unit_id, length(content) AS characters, length(regexp_replace(content, '[^\r\n]', '', 'g')) AS line_ends FROM code_units",
        "p3_totals": r"""WITH f AS (SELECT file_id, any_value(repository_id) AS repository_id, any_value(language) AS l, regexp_extract(lower(any_value(relative_path)), '\.\w+$') AS s FROM source_files GROUP BY file_id),
g AS (SELECT *, CASE WHEN s = '.json' THEN 'json' ELSE coalesce(l, CASE s WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' END) END AS k FROM f),
o AS (SELECT *, CASE WHEN k = 'javascript' AND s = '.jsx' THEN 'jsx' WHEN k = 'typescript' AND s IN ('.js', '.jsx') THEN 'javascript' ELSE k END AS language FROM g)
SELECT repository_id, language, count(*) AS files FROM o WHERE language IN ('python', 'javascript', 'jsx', 'typescript', 'json') GROUP BY ALL""",
        "p6_totals": "SELECT repository_id, count(DISTINCT file_id) AS files FROM source_files GROUP BY 1",
        "p8_placed": "SELECT doc_id AS item_id, true AS whole FROM documents GROUP BY 1",
        "p8_fill": "SELECT 0 AS over_capacity, 0 AS wrong_totals",
        "p10_tiled": "SELECT doc_id AS item_id, md5(text) AS digest, 0 AS over_limit FROM documents WHERE text <> ''",
    }
