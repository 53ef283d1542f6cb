"""Registered queries of the problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import leakage, lookalike, packing, pairs, provenance, splits, syntax, tokens
from corpusmill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return splits.found_groups(table(spark, directory, "code_files"))


def p1_splits(spark: SparkSession, directory: str) -> DataFrame:
    return splits.assign_splits(table(spark, directory, "code_files"))


def p2_token_budget(spark: SparkSession, directory: str) -> DataFrame:
    bpe = tokens.ByteBpe.load(spark, directory)
    return tokens.token_budget(table(spark, directory, "documents"), table(spark, directory, "code_files"), table(spark, directory, "dataset_catalog"), bpe)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return pairs.found_pairs(table(spark, directory, "sft_pairs"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return provenance.found_machine_made(table(spark, directory, "code_files"))


def p4_labels(spark: SparkSession, directory: str) -> DataFrame:
    labels = provenance.file_labels(table(spark, directory, "code_files"))
    return labels.groupBy(F.coalesce("label", F.lit("no content")).alias("label")).agg(F.count("*").alias("n_files"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return syntax.found_defects(table(spark, directory, "code_files"), table(spark, directory, "kodcode_v1"))


def p5_rates(spark: SparkSession, directory: str) -> DataFrame:
    return syntax.defect_rates(table(spark, directory, "code_files"), table(spark, directory, "kodcode_v1"))


def p6_pack(spark: SparkSession, directory: str) -> DataFrame:
    bpe = tokens.ByteBpe.load(spark, directory)
    return packing.pack_documents(table(spark, directory, "documents"), table(spark, directory, "block_sizes"), bpe)


def p6_fill(spark: SparkSession, directory: str) -> DataFrame:
    return packing.block_fill(p6_pack(spark, directory), table(spark, directory, "block_sizes"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    leaks = leakage.find_leaks(table(spark, directory, "documents"), table(spark, directory, "bench_items"), runs_only=True)
    return leaks.where(F.col("longest_run") >= 12).select("item_id", "doc_id")


def p7_leaks(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of at least the score of twelve equal words, wholly or in part edited."""
    least = 12 * leakage.MATCH
    leaks = leakage.find_leaks(table(spark, directory, "documents"), table(spark, directory, "bench_items"), min_score=least)
    return leaks.where(F.col("score") >= least)


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    found = lookalike.same_look_pairs(table(spark, directory, "documents"))
    return found.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, directory: str) -> DataFrame:
    classes = lookalike.look_classes(table(spark, directory, "documents"))
    return classes.withColumnRenamed("id", "doc_id")


def p8_forms(spark: SparkSession, directory: str) -> DataFrame:
    shaped = lookalike.with_form(table(spark, directory, "documents").select("doc_id", "lang", "text"))
    changed = F.col("form") != F.col("text")
    label = tokens.uniform_language(F.col("lang"))
    return shaped.groupBy(label.alias("lang")).agg(F.count("*").alias("n_docs"), F.sum(F.when(changed, 1).otherwise(0)).alias("n_changed"), F.sum("form_mixed").alias("n_mixed_tokens"), F.sum("form_whole").alias("n_whole_tokens"))


def queries() -> dict[str, Query]:
    named = (p1_found, p1_splits, p2_token_budget, p3_found, p4_found, p4_labels, p5_found, p5_rates, p6_pack, p6_fill, p7_found, p7_leaks, p8_found, p8_classes, p8_forms)
    return {f.__name__: f for f in named}


#: The owner of a stored name, for SQL: letter case, blanks and address forms removed.
def _sql_repo(column: str) -> str:
    clean = f"regexp_replace(lower(trim({column})), '^(https?://(www\\.)?[^/]+/|git@[^:]+:)', '')"
    return f"nullif(regexp_replace(regexp_replace({clean}, '/+$', ''), '\\.git$', ''), '')"


#: Rows with the owner they are placed under and its component, for SQL.
PLACED = f"""WITH RECURSIVE rows AS (
  SELECT file_id, max_stars_repo_name AS n1, repo_name AS n2, {_sql_repo("max_stars_repo_name")} AS r1, {_sql_repo("repo_name")} AS r2,
         regexp_extract(lower(trim(max_stars_repo_path)), '^([^/]+/[^/]+)/+[^/]', 1) AS head
  FROM code_files),
repos AS (SELECT r1 AS repo FROM rows WHERE r1 IS NOT NULL UNION SELECT r2 FROM rows WHERE r2 IS NOT NULL),
owned AS (
  SELECT file_id, n1, n2, split_part(coalesce(r1, r2, p.repo), '/', 1) AS a, split_part(coalesce(r2, r1, p.repo), '/', 1) AS b
  FROM rows LEFT JOIN repos p ON rows.r1 IS NULL AND rows.r2 IS NULL AND p.repo = rows.head
  WHERE coalesce(r1, r2, p.repo) IS NOT NULL),
edges AS (SELECT a, b FROM owned WHERE a <> b UNION SELECT b, a FROM owned WHERE a <> b),
walk AS (
  SELECT DISTINCT a AS start, a AS node FROM edges
  UNION SELECT walk.start, edges.b FROM walk JOIN edges ON edges.a = walk.node),
components AS (SELECT start AS node, min(node) AS component FROM walk GROUP BY start),
placed AS (SELECT owned.*, coalesce(c.component, owned.a) AS component FROM owned LEFT JOIN components c ON c.node = owned.a)"""


def _sql_draw(split: str, weight: float) -> str:
    return f"-ln((('0x' || substr(sha256('split-v1' || chr(10) || '{split}' || chr(10) || key), 1, 13))::BIGINT + 0.5::DOUBLE) / {16**13}.0::DOUBLE) / {weight}::DOUBLE"


def oracle_sql() -> dict[str, str]:
    """p1_found and p1_splits by a recursive walk over owners; the other problems have no SQL form."""
    return {
        "p1_found": f"""{PLACED},
names AS (
  SELECT component, n1 AS name FROM placed WHERE trim(n1) <> '' UNION ALL SELECT component, n2 FROM placed WHERE trim(n2) <> ''),
groups AS (SELECT component, min(name) AS group_name FROM names GROUP BY component)
SELECT g.group_name, p.file_id FROM placed p JOIN groups g USING (component)
WHERE component IN (SELECT component FROM placed GROUP BY component HAVING count(*) >= 2)""",
        "p1_splits": f"""{PLACED},
keyed AS (SELECT c.file_id, CASE WHEN p.component IS NULL THEN 'file=' || c.file_id ELSE 'owner=' || p.component END AS key FROM code_files c LEFT JOIN placed p USING (file_id)),
drawn AS (SELECT file_id, {_sql_draw("train", 0.9)} AS train, {_sql_draw("validation", 0.05)} AS validation, {_sql_draw("test", 0.05)} AS test FROM keyed)
SELECT file_id, CASE least(train, validation, test) WHEN train THEN 'train' WHEN validation THEN 'validation' ELSE 'test' END AS split FROM drawn""",
    }
