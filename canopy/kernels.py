"""Kernel queries: the relational kernels of the engine on stand-in columns of the driver's tables.

They show how the kernels behave at scale; they say nothing about Go source, which those tables do not hold. The library's
own operators over whole tables are in corpora.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions import columns as c
from canopy.operators import interfaces
from canopy.operators.budget import within_budget
from canopy.operators.ordered import joined, running_sums


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo = '', path = url without its scheme: host and folders as directories, the rest as file."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    rows = _table(spark, sf_dir, "pages").select(path.alias("path"))
    return rows.withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))


def k_tree_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files grouped by directory, names sorted."""
    return _pages(spark, sf_dir).groupBy("dir").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))


def k_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail only for directories that start with m; 0 and null for the others."""
    rows = _pages(spark, sf_dir).groupBy("dir").agg(F.count("*").alias("n_files"), F.min("path").alias("first"))
    return rows.select("dir", F.when(F.col("dir").startswith("m"), F.col("n_files")).otherwise(F.lit(0)).alias("n_files"), F.when(F.col("dir").startswith("m"), F.col("first")).alias("first_file"))


def k_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in order while their running bytes / 4 fit 30 % of the whole; the first always stays."""
    sizes = _table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("tree", F.lit(""))
    summed = running_sums(sizes, ["tree"], ["source"], {"running": F.col("bytes")})
    kept = within_budget(sizes, F.floor(F.col("total0") * 3 / 40), [F.col("bytes")], "tree", "source").select("source")
    return joined(summed, kept, ["source"], "left_semi").select("source", "bytes", "running")


def k_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct event types of each user, sorted."""
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("deps"))


def k_first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each source: a Spanish one if there is any, else the first; found by partial aggregation."""
    first = F.min_by(F.struct("doc_id", "lang", "n_chars"), F.struct(F.col("lang") != "es", F.col("doc_id"))).alias("d")
    return _table(spark, sf_dir, "documents").groupBy("source").agg(first).select("source", "d.*")


def k_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not blank, with their original numbers."""
    code = c.numbered_code(F.col("text"), F.lit(1))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(code).alias("code_md5"), F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?U)\S"))).cast("long").alias("n_lines"))


def k_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no event names as its user, as methods that a type lacks."""
    seen = _table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return interfaces.lacking(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), seen, ["c_custkey"])


def k_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line count is not the expected one, as methods with another number of parameters."""
    have = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("params")).withColumn("results", F.lit(0))
    need = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("want_params"), F.lit(0).alias("want_results"))
    return interfaces.conflicts(need, have, ["o_orderkey"]).select("o_orderkey", F.col("want_params").alias("expected"), F.col("params").alias("got"))


def k_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a name, here as a segment or as a nation, one after the other, duplicates kept."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return rows.where("c_mktsegment = 'BUILDING'").unionByName(rows.where("c_nationkey = 3")).select("c_custkey", "c_name")


def k_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word names joined as camel case, and taken apart again."""
    camel = F.concat_ws("", F.transform(F.split("p_name", " "), c.capitalised))
    return _table(spark, sf_dir, "part").select("p_partkey", camel.alias("camel"), c.snake_name(camel).alias("snake"))


def k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a conversation, folded in order of turn."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.aggregate("t", F.lit(""), lambda s, x: F.md5(F.concat(s, x["text"]))).alias("folded"), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("joined"))


def k_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer columns as struct parts: on one line up to five, else one a line (a struct for each nation and 128
    keys, so that none grows with the table)."""
    block = F.floor(F.col("c_custkey") / 128).cast("string")
    rows = _table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("B"), block))
    parts = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.array("c_name").alias("names"), F.col("c_mktsegment").alias("type_src")))).alias("fields"))
    return parts.select("name", c.struct_signature(F.struct("name", "fields")).alias("signature"))


QUERIES = {f.__name__: f for f in (k_tree_group, k_focus, k_budget, k_deps, k_first_file, k_numbered, k_missing, k_conflict, k_union, k_snake, k_fold, k_signatures)}

_PAGES = "(SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages))"
ORACLE = {
    "k_tree_group": f"SELECT dir, count(*) AS n_files, string_agg(path, ',' ORDER BY path) AS files FROM {_PAGES} GROUP BY dir",
    "k_focus": f"SELECT dir, CASE WHEN starts_with(dir, 'm') THEN count(*) ELSE 0 END AS n_files, CASE WHEN starts_with(dir, 'm') THEN min(path) END AS first_file FROM {_PAGES} GROUP BY dir",
    "k_budget": """
        WITH s AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source),
        r AS (SELECT source, bytes, CAST(sum(bytes) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(sum(bytes) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY source) AS rank FROM s)
        SELECT source, bytes, running FROM r WHERE rank = 1 OR running // 4 <= total * 3 // 40""",
    "k_deps": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS deps FROM events GROUP BY user_id",
    "k_first_file": "SELECT source, doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang <> 'es', doc_id) AS r FROM documents) WHERE r = 1",
    "k_numbered": r"""
        SELECT doc_id, md5(coalesce(string_agg(i || ': ' || line, chr(10) ORDER BY i) FILTER (WHERE regexp_matches(line, '[^\s\p{Z}]')), '')) AS code_md5,
          count(*) FILTER (WHERE regexp_matches(line, '[^\s\p{Z}]')) AS n_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id""",
    "k_missing": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)",
    "k_conflict": "SELECT o_orderkey, o_orderkey % 7 + 1 AS expected, got FROM orders JOIN (SELECT l_orderkey, count(*) AS got FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE got <> o_orderkey % 7 + 1",
    "k_union": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3",
    "k_snake": r"""
        SELECT p_partkey, camel, lower(regexp_replace(regexp_replace(camel, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake
        FROM (SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', '') AS camel FROM part)""",
    "k_fold": """
        SELECT conv_id, list_reduce(list_concat([''], list(text ORDER BY turn, text)), lambda s, x: md5(s || x)) AS folded, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS joined
        FROM conversations GROUP BY conv_id""",
    "k_signatures": """
        SELECT name, CASE WHEN count(*) <= 5 THEN 'type ' || name || ' struct { ' || string_agg(c_name || ' ' || c_mktsegment, '; ' ORDER BY c_name, c_mktsegment) || ' }'
          ELSE 'type ' || name || ' struct {' || chr(10) || string_agg('    ' || c_name || ' ' || c_mktsegment, chr(10) ORDER BY c_name, c_mktsegment) || chr(10) || '}' END AS signature
        FROM (SELECT *, 'N' || c_nationkey || 'B' || (c_custkey // 128) AS name FROM customer) GROUP BY name""",
}
