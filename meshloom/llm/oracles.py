"""DuckDB SQL for the operators that SQL can express."""

OP5 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5}
