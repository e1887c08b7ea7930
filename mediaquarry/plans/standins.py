"""Stand-ins for a media catalogue, derived from the benchmark tables.

Each stand-in is one SELECT that Spark and DuckDB both read, up to the spellings in ``_DIALECTS``; so the operators and
their oracles start from the same rows without sharing any operator's logic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DIALECTS = {
    "spark": {"sha": r"sha2(\1, 256)", "hours": r"(TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(0, CAST(\1 AS INT)))", "words": r"aggregate(sequence(0, 15), 0L, (a, i) -> a + CASE WHEN embedding[\1 * 16 + i] > 0 THEN shiftleft(1L, i) ELSE 0L END)", "wide": r"aggregate(sequence(0, 63), 0L, (a, i) -> a | CASE WHEN embedding[i] > embedding[(i * 7 + 3 + 11 * \1) % 64] THEN shiftleft(1L, i) ELSE 0L END)"},
    "duckdb": {"sha": r"sha256(\1)", "hours": r"(TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(\1 AS BIGINT)))", "words": r"CAST(list_sum(list_transform(range(16), lambda i: CASE WHEN embedding[\1 * 16 + i + 1] > 0 THEN (1::BIGINT << CAST(i AS INTEGER)) ELSE 0 END)) AS BIGINT)", "wide": r"CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > embedding[(i * 7 + 3 + 11 * \1) % 64 + 1] THEN (1::UBIGINT << CAST(i AS UBIGINT)) ELSE 0 END)) AS UBIGINT)"},
}

# SHA(x), HOURS(x), WORD(n) and WIDE(n) are the spellings that differ
_SELECTS = {
    "files": """
        SELECT doc_id AS id, concat('p', CAST(doc_id AS STRING)) AS public_id,
          concat(CASE doc_id % 5 WHEN 0 THEN 'IMG_' WHEN 1 THEN 'VID_' WHEN 2 THEN 'Screenshot_' ELSE 'scan' END, CAST(doc_id AS STRING), CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 2 = 0 THEN '.JPG' WHEN doc_id % 3 = 0 THEN '.mp4' ELSE '.pdf' END) AS file_name,
          CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'JPG' WHEN doc_id % 3 = 0 THEN 'mp4' ELSE 'pdf' END AS extension,
          n_chars AS size_bytes, SHA(text) AS sha256,
          CASE WHEN doc_id % 2 = 0 THEN 'PHOTO' WHEN doc_id % 3 = 0 THEN 'VIDEO' WHEN doc_id % 5 = 0 THEN 'ZIP' ELSE 'PDF' END AS file_type,
          CASE doc_id % 10 WHEN 8 THEN 'MISSING' WHEN 9 THEN 'DELETED' ELSE 'ACTIVE' END AS lifecycle_status,
          HOURS(doc_id % 5000) AS created_at, HOURS((doc_id * 7) % 5000) AS modified_at,
          CASE WHEN doc_id % 6 = 0 THEN NULL ELSE HOURS((doc_id * 3) % 9000) END AS lifecycle_changed_at, HOURS(doc_id) AS updated_at
        FROM documents""",
    "locations": """
        SELECT doc_id AS file_id, concat('D:/Media/', source, CASE WHEN doc_id % 3 = 0 THEN '/Sub_a' ELSE '' END) AS folder,
          concat('D:/Media/', source, CASE WHEN doc_id % 3 = 0 THEN '/Sub_a' ELSE '' END, '/f', CAST(doc_id AS STRING), '.jpg') AS path
        FROM documents WHERE doc_id % 13 <> 0""",
    "metadata": """
        SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN 'MEDIA' ELSE 'DOCUMENT' END AS category,
          CASE doc_id % 4 WHEN 0 THEN 'CAMERA' WHEN 1 THEN 'WHATSAPP' WHEN 2 THEN 'SCREENSHOT' ELSE 'AIRBRUSH' END AS subcategory,
          CASE WHEN doc_id % 7 = 0 THEN NULL ELSE HOURS((doc_id * 11) % 20000) END AS capture_date,
          CASE WHEN doc_id % 3 = 0 THEN 'EXIF' WHEN doc_id % 3 = 1 THEN 'FILE_NAME' ELSE 'FILE_CREATED_AT' END AS date_source,
          CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(640 + doc_id % 4000 AS INT) END AS width, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(480 + (doc_id * 3) % 3000 AS INT) END AS height,
          CASE WHEN doc_id % 3 = 0 THEN 'Canon' WHEN doc_id % 3 = 1 THEN 'Nikon' ELSE NULL END AS manufacturer,
          CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST((doc_id * 37) % 1700 - 850 AS DOUBLE) / CAST(10 AS DOUBLE) END AS latitude,
          CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST((doc_id * 53) % 3500 - 1750 AS DOUBLE) / CAST(10 AS DOUBLE) END AS longitude,
          CASE WHEN doc_id % 8 = 0 THEN NULL ELSE HOURS((doc_id * 5) % 8000) END AS rebuilt_at
        FROM documents WHERE doc_id % 17 <> 0""",
    "videos": """
        SELECT doc_id AS file_id, CASE doc_id % 5 WHEN 0 THEN ' h264' WHEN 1 THEN 'HEVC' WHEN 2 THEN 'h265 ' WHEN 3 THEN NULL ELSE 'av1' END AS codec,
          CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST(doc_id % 500 AS DOUBLE) / CAST(4 AS DOUBLE) END AS duration, CAST(1920 - doc_id % 3 AS INT) AS width, CAST(1080 AS INT) AS height
        FROM documents WHERE doc_id % 2 <> 0 AND doc_id % 3 = 0""",
    "places": """
        SELECT doc_id AS file_id, n.n_name AS country_name, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('S', CAST(doc_id % 7 AS STRING)) END AS state_name,
          CASE WHEN doc_id % 4 = 1 THEN NULL ELSE concat('C', CAST(doc_id % 11 AS STRING)) END AS city_name, doc_id % 31 = 0 AS open_sea,
          CASE doc_id % 5 WHEN 0 THEN 'VERY_LOW' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'VERY_HIGH' END AS confidence, doc_id % 37 = 0 AS manual
        FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25 WHERE doc_id % 4 <> 0""",
    "file_exclusions": "SELECT concat('p', CAST(doc_id AS STRING)) AS public_id FROM documents WHERE doc_id % 29 = 0",
    "folder_exclusions": "SELECT DISTINCT CASE WHEN source LIKE '%1' THEN concat('D:\\\\Media\\\\', source) ELSE concat('D:/Media/', source, '/Sub_a') END AS folder FROM documents WHERE source LIKE '%1' OR source LIKE '%2'",
    "prints": "SELECT vec_id AS file_id, WORD(0) AS w0, WORD(1) AS w1, WORD(2) AS w2, WORD(3) AS w3, label FROM embeddings",
    "wide_prints": "SELECT vec_id AS file_id, WIDE(0) AS w0, WIDE(1) AS w1, WIDE(2) AS w2, WIDE(3) AS w3 FROM embeddings",
    "errors": "SELECT event_id AS id, user_id % 50 AS execution_id, concat('D:/Media/u', CAST(user_id % 97 AS STRING)) AS path, CASE WHEN value < 10 THEN 'IO' WHEN value < 50 THEN 'DECODE' ELSE NULL END AS error_type, ts AS happened_at FROM events WHERE event_type = 'error'",
    "executions": """
        SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'INVENTORY' WHEN 1 THEN 'RECONCILE' WHEN 2 THEN 'ORGANIZE' ELSE 'SIMILARITY' END AS type,
          CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'PENDING' ELSE 'RUNNING' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'MANUAL' ELSE 'TIMER' END AS trigger_event,
          o_orderdate AS started_at, CAST(o_custkey % 7 AS INT) AS priority, concat('1.', CAST(o_custkey % 6 AS STRING)) AS version, o_custkey % 40 AS files_found, o_custkey % 23 AS files_moved, o_custkey % 3 AS repaired_items,
          CAST(o_orderkey % 4 AS INT) AS claim_count, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('k', CAST(o_custkey % 300 AS STRING)) END AS dedup_key
        FROM orders""",
    "phases": "SELECT l_orderkey AS execution_id, l_returnflag AS phase, CAST(l_quantity AS BIGINT) * 100 AS millis, CAST(l_linenumber AS BIGINT) AS items FROM lineitem",
    "movements": "SELECT o_orderkey AS id, o_custkey % 60 AS execution_id, CASE o_orderstatus WHEN 'F' THEN 'MOVED' WHEN 'O' THEN 'SKIPPED' ELSE 'FAILED' END AS status, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS reason, o_orderdate AS moved_at FROM orders",
}
_USES = re.compile(r"\b(documents|nation|embeddings|events|orders|lineitem)\b")


def text(name: str, dialect: str) -> str:
    out = _SELECTS[name]
    spelt = _DIALECTS[dialect]
    out = re.sub(r"SHA\((\w+)\)", spelt["sha"], out)
    out = re.sub(r"WORD\((\d)\)", spelt["words"], out)
    out = re.sub(r"WIDE\((\d)\)", spelt["wide"], out)
    out = re.sub(r"HOURS\(((?:[^()]|\([^()]*\))*)\)", spelt["hours"], out)
    return out.replace("\\\\", "\\") if dialect == "duckdb" else out


def oracle(sql: str) -> str:
    """DuckDB SQL with the stand-ins that it names in front."""
    used = [n for n in _SELECTS if re.search(rf"\b{n}\b", sql)]
    first, body = re.match(r"\s*(?:(WITH RECURSIVE|WITH)\s)?(.*)", sql, re.S).groups()
    front = ", ".join(f"{n} AS ({text(n, 'duckdb')})" for n in used)
    if not front:
        return sql.strip()
    return f"{first or 'WITH'} {front}{',' if first else ''} {body.strip()}"


class Tables:
    """The benchmark's tables and the stand-ins of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in _SELECTS:
            select = text(name, "spark")
            used = sorted(set(_USES.findall(select)))
            quoted = re.sub(r"\{|\}", "", select)
            return self.spark.sql(_USES.sub(r"{\1}", quoted), **{t: getattr(self, t) for t in used})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
