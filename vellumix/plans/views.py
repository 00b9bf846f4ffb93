"""Research entities derived from the driver's tables, as SQL that Spark and DuckDB both run.

papers from documents, ledger from events, quotes from benchmark, segments from conversations, records from pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "papers": """
SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, text AS body, lang AS language, source AS source_module, n_chars,
CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(1985 + doc_id % 41 AS INT) END AS year,
CASE WHEN doc_id % 7 = 3 THEN NULL ELSE CAST(n_chars % 700 AS BIGINT) END AS citations,
CASE WHEN doc_id % 6 = 1 THEN CAST(doc_id % 40 AS DOUBLE) / 10 ELSE NULL END AS fwci,
CASE doc_id % 6 WHEN 0 THEN 'IEEE Transactions on ' || source WHEN 1 THEN 'Journal of ' || source WHEN 2 THEN 'Proceedings of ' || source WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'Notes ' || source END AS venue,
CASE doc_id % 5 WHEN 0 THEN ' https://doi.org/10.1000/P' || CAST(doc_id % 97 AS STRING) || '. ' WHEN 1 THEN 'doi:10.1000/p' || CAST(doc_id % 89 AS STRING) WHEN 2 THEN '10.48550/arXiv.' || CAST(2000 + doc_id % 61 AS STRING) WHEN 3 THEN '' ELSE NULL END AS doi,
CASE doc_id % 4 WHEN 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || CAST(doc_id % 113 AS STRING) || '/' WHEN 1 THEN 'https://openalex.org/W' || CAST(doc_id % 127 AS STRING) WHEN 2 THEN 'http://x.org/' || CAST(doc_id AS STRING) ELSE NULL END AS url,
CASE WHEN doc_id % 9 = 0 THEN 'http://oa.org/' || CAST(doc_id AS STRING) ELSE NULL END AS oa_url,
CASE doc_id % 10 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS is_retracted,
CASE doc_id % 8 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'JournalArticle' WHEN 2 THEN 'book-chapter' WHEN 3 THEN 'proceedings-article' WHEN 4 THEN 'Study' WHEN 5 THEN 'dissertation' WHEN 6 THEN NULL ELSE 'preprint' END AS publication_type,
CASE doc_id % 16 WHEN 4 THEN split('Study,JournalArticle', ',') WHEN 5 THEN split('Editorial,News', ',') WHEN 9 THEN split('Editorial,JournalArticle', ',') WHEN 10 THEN split('other,Sonstiger Beitrag', ',') ELSE NULL END AS publication_types,
CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1767225600 - (doc_id % 400) * 86400 AS BIGINT) END AS checked_at
FROM documents""",
    "ledger": """
SELECT event_id AS ord, 'p' || CAST(user_id AS STRING) AS paper_id,
CASE event_type WHEN 'click' THEN 'include' WHEN 'view' THEN 'exclude' WHEN 'purchase' THEN 'include' WHEN 'signup' THEN 'unclear' ELSE 'exclude' END AS decision,
CASE WHEN event_id % 5 = 0 THEN 'eligibility' ELSE 'screening' END AS stage,
CASE event_id % 7 WHEN 0 THEN 'human' WHEN 1 THEN '2' WHEN 2 THEN '2' WHEN 3 THEN '2' ELSE '1' END AS round,
CASE WHEN event_id % 101 = 0 THEN 'rule' WHEN event_id % 7 = 0 THEN 'human' ELSE 'agent' END AS decided_by,
props AS reason, value, ts FROM events""",
    "quotes": "SELECT item_id AS quote_id, text AS verbatim, length(text) AS n_chars, item_id % 20 AS paper_id FROM benchmark",
    "segments": "SELECT conv_id AS paper_id, turn AS seq, role AS speaker, text, CASE WHEN length(text) % 3 = 0 THEN 'theme' || CAST(length(text) % 11 AS STRING) ELSE NULL END AS code, CASE WHEN turn % 2 = 1 THEN 'memo ' || CAST(turn AS STRING) ELSE NULL END AS memo FROM conversations",
}


def with_views(sql: str) -> str:
    """The query with the views it names in front."""
    used = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in sql]
    if not used:
        return sql
    head = ", ".join(used)
    sql = sql.strip()
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived entity as a DataFrame over the table in sf_dir."""
    body = VIEWS[name]
    table = body.rsplit("FROM ", 1)[1].split()[0]
    return spark.sql(body.rsplit("FROM ", 1)[0] + "FROM {src}", src=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
