"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import credentials, encodings, functions, leakage, mixing, neardup, neighbours, origin, prose, splitting
from codestrata.shared import table

Query = Callable[[SparkSession, str], DataFrame]

#: TESTDATA.md: similarity and words of a shingle of problem 5's cases; cosine and neighbours of problem 7's.
CASE_SIMILARITY, CASE_SHINGLE, CASE_COSINE, CASE_K = 0.6, 3, 0.9, 5


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.file_origins(table(spark, d, "files")).where("size(found) > 0").select("relative_path")


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    found = origin.file_origins(table(spark, d, "files"))
    return found.select("relative_path", "repo", F.concat_ws(",", "found").alias("found"), F.round("recurring", 6).alias("recurring"), F.round("head_recurring", 6).alias("head_recurring"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = credentials.chunk_credentials(table(spark, d, "chunks"))
    return found.select("id", F.explode("lines").alias("line_number"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.chunk_credentials(table(spark, d, "chunks"), redacted=True).where("size(lines) > 0").select("id", "redacted", "n_proved")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return functions.documented_functions(table(spark, d, "symbols"), table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).where("origin = 'symbol'").select("file_path", "start_line", "name").distinct()


def _prose(spark: SparkSession, d: str) -> DataFrame:
    model = prose.fitted_model(table(spark, d, "documents"))
    return prose.prose_languages(table(spark, d, "markers"), table(spark, d, "symbols"), table(spark, d, "files"), model)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _prose(spark, d).where("lang <> 'en'").select("origin", "file_path", "line_number", "lang").distinct()


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return prose.prose_shares(_prose(spark, d), table(spark, d, "files"))


def p4_file_prose(spark: SparkSession, d: str) -> DataFrame:
    return prose.file_prose(table(spark, d, "files"), prose.fitted_model(table(spark, d, "documents")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.member_pairs(*neardup.near_duplicates(table(spark, d, "chunks"), CASE_SIMILARITY, CASE_SHINGLE))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_groups(table(spark, d, "chunks"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces_of(splitting.oversized_chunks(table(spark, d, "chunks"), table(spark, d, "chunking_config")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece = 0").select("id")


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest_vectors(neighbours.unit_vectors(table(spark, d, "chunks")), CASE_K)
    return found.select("id", "other", "rank", F.round("similarity", 5).alias("similarity"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest_vectors(neighbours.unit_vectors(table(spark, d, "chunks")), CASE_K)
    return neighbours.similar_pairs(found, CASE_COSINE)


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    found = encodings.repaired_texts(documents, encodings.fitted(documents))
    return found.select("doc_id", "repaired", F.concat_ws(",", "chains").alias("chains"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repaired(spark, d).select("doc_id").distinct()


def queries() -> dict[str, Query]:
    named = (
        p1_found, p1_origins, p2_found, p2_redacted, p3_found, p3_pairs, p4_found, p4_shares, p4_file_prose, p5_found, p5_groups, p6_found,
        p6_pieces, p7_found, p7_neighbours, p8_found, p8_leaks, p9_mixture, p9_shares, p10_found, p10_repaired,
    )
    return {q.__name__: q for q in named}


_CURRENT = """current AS (
  SELECT * FROM (SELECT DISTINCT id, repo, content, vector, updated_at FROM chunks WHERE id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"""

_P5 = f"""WITH {_CURRENT},
code AS (SELECT id, regexp_extract_all(lower(substr(content, instr(content, chr(10) || chr(10)) + 2)), '[a-z0-9_]+') AS w FROM current WHERE instr(content, chr(10) || chr(10)) > 0),
gram AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM code)),
size AS (SELECT id, count(*) AS n FROM gram GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
short AS (SELECT id, array_to_string(w, ' ') AS t FROM code WHERE len(w) BETWEEN 1 AND 2)
SELECT id_a, id_b FROM common JOIN size x ON x.id = id_a JOIN size y ON y.id = id_b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9
UNION SELECT a.id, b.id FROM short a JOIN short b ON a.t = b.t AND a.id < b.id"""

_P6 = f"""WITH {_CURRENT}
SELECT id FROM current c LEFT JOIN (SELECT repo, max(max_tokens) AS m FROM chunking_config GROUP BY repo) o ON o.repo = c.repo
WHERE instr(content, chr(10) || chr(10)) > 0
  AND strlen(substr(content, instr(content, chr(10) || chr(10)) + 2)) > 4 * coalesce(m, (SELECT max(max_tokens) FROM chunking_config WHERE repo = '*'))"""

_P8 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)"""


def oracle_sql() -> dict[str, str]:
    """The queries whose results SQL can state: exact pairs, sizes and runs of words."""
    return {"p5_found": _P5, "p6_found": _P6, "p8_found": _P8}
