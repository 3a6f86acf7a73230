"""Queries of the library's own operators over the given tables, read as trees of files: each with SQL.

`pages` are trees of paths by host, `documents` are files in folders by source and language, `events` are edits of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators import budget, glob_tables, layers, name_index, prefixes, splices, text_output
from canopy.operators.memo import Memo
from canopy.plans.lineage import checkpointed, ensure_checkpoint_dir
from canopy.sources import gotree

QUERIES: dict[str, object] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def register(make):
        QUERIES[make.__name__], ORACLE[make.__name__] = make, sql
        return make

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, path (url without its scheme), and what a package row is made of: title, files, n_parts, n_links."""
    rows = table(spark, sf_dir, "pages").select("html", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    pieces = lambda mark: (F.size(F.split("html", mark)) - 1).cast("long")
    return rows.select(
        F.substring_index("path", "/", 1).alias("host"), "path", F.substring_index("path", "/", -1).alias("file"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        pieces("<p>").alias("n_parts"), pieces("<a ").alias("n_links"),
    )


def _page_costs() -> list[Column]:
    """Bytes of a row with everything, without its title, its links, its parts, its file."""
    bare = F.octet_length("path")
    named = bare + F.octet_length("file")
    return [named + 4 * F.col("n_parts") + 2 * F.col("n_links") + F.octet_length("title"), named + 4 * F.col("n_parts") + 2 * F.col("n_links"), named + 4 * F.col("n_parts"), named, bare]


_PAGES = """
  SELECT split_part(path, '/', 1) AS host, path, title, n_links, strlen(path) AS c4, strlen(path) + strlen(file) AS c3, strlen(path) + strlen(file) + 4 * n_parts AS c2,
    strlen(path) + strlen(file) + 4 * n_parts + 2 * n_links AS c1, strlen(path) + strlen(file) + 4 * n_parts + 2 * n_links + strlen(title) AS c0
  FROM (SELECT path, string_split(path, '/')[-1] AS file, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(string_split(html, '<p>')) - 1 AS n_parts, len(string_split(html, '<a ')) - 1 AS n_links
    FROM (SELECT html, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages))"""


def _budget_sql(tree: str, limit: str) -> str:
    return f"""
WITH r AS (SELECT *, {tree} AS tree FROM ({_PAGES})),
t AS (SELECT tree, CAST(sum(c0) AS BIGINT) AS t0, CAST(sum(c1) AS BIGINT) AS t1, CAST(sum(c2) AS BIGINT) AS t2, CAST(sum(c3) AS BIGINT) AS t3, CAST(sum(c4) AS BIGINT) AS t4 FROM r GROUP BY tree),
l AS (SELECT *, CAST(CASE WHEN t0 // 4 <= b THEN 0 WHEN t1 // 4 <= b THEN 1 WHEN t2 // 4 <= b THEN 2 WHEN t3 // 4 <= b THEN 3 WHEN t4 // 4 <= b THEN 4 ELSE 5 END AS INTEGER) AS level FROM (SELECT *, {limit} AS b FROM t)),
o AS (SELECT r.*, l.level, l.b, sum(c4) OVER w AS running, row_number() OVER w AS rank FROM r JOIN l USING (tree) WINDOW w AS (PARTITION BY tree ORDER BY path ROWS UNBOUNDED PRECEDING))
SELECT tree, path, level, CASE WHEN level < 5 THEN title END AS title, CASE WHEN level < 5 THEN n_links ELSE -1 END AS n_links FROM o WHERE level < 5 OR rank = 1 OR running // 4 <= b"""


def _page_budget(rows: DataFrame, limit: Column) -> DataFrame:
    kept = budget.within_budget(rows, limit, _page_costs(), "tree", "path")
    return kept.select("tree", "path", "level", "title", F.coalesce("n_links", F.lit(-1)).alias("n_links"))


@_query(_budget_sql("host", "CASE t4 % 6 WHEN 0 THEN t0 // 4 WHEN 1 THEN t1 // 4 WHEN 2 THEN t2 // 4 WHEN 3 THEN t3 // 4 WHEN 4 THEN t4 // 4 ELSE t4 // 7 END"))
def t_budget_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host a tree: budgets that let each level of detail, or a cut, be needed."""
    kind, tokens = F.col("total4") % 6, [F.floor(F.col(f"total{i}") / 4) for i in range(5)]
    limit = F.floor(F.col("total4") / 7)
    for i, fits in enumerate(tokens):
        limit = F.when(kind == i, fits).otherwise(limit)
    return _page_budget(page_paths(spark, sf_dir).withColumn("tree", F.col("host")), limit)


@_query(_budget_sql("''", "t4 * 3 // 40"))
def t_budget_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hosts as one tree, cut at 30 % of its paths."""
    return _page_budget(page_paths(spark, sf_dir).withColumn("tree", F.lit("")), F.floor(F.col("total4") * 3 / 40))


def document_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of plans (source and language), and events as edits of them; a third of these name document 7."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("plan"), F.col("doc_id").alias("file"), F.col("text").alias("content"))
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")).alias("file"), F.col("event_id").alias("seq"), F.floor(F.col("value") % 20).alias("start"),
        (F.col("user_id") % 7).alias("removed"), F.when(F.col("user_id") % 5 > 0, F.col("event_type")).alias("inserted"),
    )
    return docs, events.join(docs.select("plan", "file"), "file")


_EDITS = """
WITH files AS (SELECT concat_ws('/', source, lang) AS plan, doc_id AS file, text FROM documents),
e AS (SELECT plan, file, text, event_id AS seq, CAST(floor(value % 20) AS BIGINT) AS start, user_id % 7 AS removed, CASE WHEN user_id % 5 > 0 THEN event_type ELSE '' END AS inserted
  FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS file FROM events) JOIN files USING (file)),
s AS (SELECT *, length(text) + coalesce(sum(length(inserted) - removed) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size FROM e),
stops AS (SELECT plan, min(seq) AS stop FROM s WHERE start + removed > size GROUP BY plan),
made AS (SELECT s.*, stop FROM s LEFT JOIN stops USING (plan) WHERE stop IS NULL OR seq < stop)"""


@_query(
    _EDITS
    + """
SELECT plan, file, md5(list_reduce(list_prepend(any_value(text), list(start || '|' || removed || '|' || inserted ORDER BY seq)),
  lambda t, x: substring(t, 1, CAST(split_part(x, '|', 1) AS BIGINT)) || split_part(x, '|', 3) || substring(t, CAST(split_part(x, '|', 1) AS BIGINT) + CAST(split_part(x, '|', 2) AS BIGINT) + 1))) AS content_md5
FROM made GROUP BY plan, file"""
)
def t_edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every changed document after all edits of its plan up to the first that cannot be made."""
    changed, _ = splices.splice(*document_edits(spark, sf_dir))
    return changed.select("plan", "file", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@_query(
    _EDITS
    + """, per_file AS (SELECT plan, file, count(*) AS n FROM made GROUP BY plan, file),
done AS (SELECT plan, sum(n) AS n_edits, count(*) AS n_files, arg_max(file, n * 1000000000 + file) AS hot_file, max(n) AS hot_edits FROM per_file GROUP BY plan)
SELECT plan, CAST(coalesce(n_edits, 0) AS BIGINT) AS n_edits, coalesce(n_files, 0) AS n_files, coalesce(hot_file, -1) AS hot_file, CAST(coalesce(hot_edits, 0) AS BIGINT) AS hot_edits,
  coalesce(stop, -1) AS failed_seq, CASE WHEN stop IS NOT NULL THEN 'OUT_OF_RANGE' ELSE '' END AS error
FROM (SELECT DISTINCT plan FROM e) LEFT JOIN done USING (plan) LEFT JOIN stops USING (plan)"""
)
def t_edit_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every plan has done, its file with most edits, and where it stopped."""
    _, outcome = splices.splice(*document_edits(spark, sf_dir))
    return outcome.withColumns({"hot_file": F.coalesce("hot_file", F.lit(-1)), "failed_seq": F.coalesce("failed_seq", F.lit(-1)), "error": F.coalesce("error", F.lit(""))})


def _written_documents(spark: SparkSession, sf_dir: str) -> str:
    """A folder, shared by driver and executors, in which the documents are files by source and language."""
    root = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/documents-{uuid.uuid4().hex}"
    name = F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 10 == 3, "_test.go").otherwise(".go"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name)
    gotree.write_tree(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").cast("binary").alias("content")), root, "overwrite", layout=False)
    return root


def _read_back(spark: SparkSession, sf_dir: str, keep: Column) -> DataFrame:
    root = _written_documents(spark, sf_dir)
    rows = spark.read.format("gotree").option("path", root).option("repo", "docs").option("pushdown", "true").load().where(keep)
    out = checkpointed(rows.select("path", "dir", "depth", "size", F.sha2("content", 256).alias("sha256")))
    gotree.remove_tree(spark, root)
    return out


_FILES = """
  SELECT dir || '/' || name AS path, dir, 2 AS depth, strlen(text) AS size, sha256(text) AS sha256, name FROM (
    SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir, 'd' || doc_id || CASE WHEN doc_id % 10 = 3 THEN '_test.go' ELSE '.go' END AS name, coalesce(text, '') AS text FROM documents)"""


@_query(f"SELECT path, dir, depth, size, sha256 FROM ({_FILES})")
def t_written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as a tree, all or none, and read back."""
    return _read_back(spark, sf_dir, F.lit(True))


@_query(f"SELECT path, dir, depth, size, sha256 FROM ({_FILES}) WHERE starts_with(dir, 'src1') AND NOT ends_with(name, '_test.go') AND ends_with(name, '7.go')")
def t_scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of them, by filters that the source takes over: other folders are not entered, other files not opened."""
    return _read_back(spark, sf_dir, F.col("dir").startswith("src1") & ~F.col("is_test") & F.col("name").endswith("7.go") & (F.col("depth") <= 2))


def _known_prefixes(pages: DataFrame) -> DataFrame:
    """Some hosts, some of their folders, and some paths, as a table of prefixes."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    kinds = [("host", F.length("host") % 2 == 0), (folder, F.col("page_id") % 5 == 0), ("path", F.col("page_id") % 11 == 0)]
    rows = None
    for prefix, keep in kinds:
        own = pages.where(keep).select(F.lit("").alias("tree"), (F.col(prefix) if isinstance(prefix, str) else prefix).alias("prefix")).distinct()
        rows = own if rows is None else rows.unionByName(own)
    return rows.distinct().withColumn("value", F.md5("prefix"))


@_query("""
WITH p AS (SELECT page_id, path, split_part(path, '/', 1) AS host, regexp_replace(path, '/[^/]*$', '') AS folder FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)),
known AS (SELECT host AS prefix FROM p WHERE length(host) % 2 = 0 UNION SELECT folder FROM p WHERE page_id % 5 = 0 UNION SELECT path FROM p WHERE page_id % 11 = 0),
above AS (SELECT page_id, array_to_string(parts[1:i], '/') AS prefix, i FROM (SELECT page_id, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p)),
found AS (SELECT page_id, arg_max(prefix, i) AS prefix FROM above JOIN known USING (prefix) GROUP BY page_id)
SELECT page_id, path, coalesce(prefix, '') AS prefix, coalesce(md5(prefix), '') AS value FROM p LEFT JOIN found USING (page_id)""")
def t_nearest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known ancestor of every page's path."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    pages = pages.withColumns({"host": F.substring_index("path", "/", 1), "tree": F.lit("")})
    found = prefixes.nearest(pages, _known_prefixes(pages), "tree", "path")
    return found.select("page_id", "path", F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("value", F.lit("")).alias("value"))


@_query("""
WITH c AS (SELECT user_id AS k, event_id % 50 AS layer, value, event_type = 'error' AS gone FROM events WHERE event_id % 3 > 0),
one AS (SELECT k, layer, max(CASE WHEN gone THEN NULL ELSE value END) AS value, bool_and(gone) AS gone FROM c GROUP BY k, layer),
newest AS (SELECT k, arg_max(CASE WHEN gone THEN -1 ELSE value END, layer) AS value FROM one GROUP BY k)
SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NULL THEN o_totalprice ELSE value END AS o_totalprice FROM orders FULL JOIN newest ON o_orderkey = k WHERE k IS NULL OR value >= 0""")
def t_layered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under fifty layers of changes and tombstones, made of events, in one aggregation."""
    events = table(spark, sf_dir, "events").where("event_id % 3 > 0")
    changes = events.select(F.col("user_id").alias("o_orderkey"), F.col("value").alias("o_totalprice"), (F.col("event_id") % 50).alias("version"), (F.col("event_type") == "error").alias("gone"))
    return layers.merged(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), changes, ["o_orderkey"])


@_query("""
WITH p AS (SELECT DISTINCT split_part(path, '/', 1) AS host, path FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)),
lines AS (SELECT host, '' AS path, host || ' (' || count(*) || ')' AS line FROM p GROUP BY host UNION ALL SELECT host, path, '- ' || path FROM p)
SELECT row_number() OVER (ORDER BY host, path) || ': ' || line AS value FROM lines""")
def t_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of the pages as numbered text that all tasks write: hosts with their paths; read back."""
    paths = page_paths(spark, sf_dir).select("host", "path").distinct()
    heads = paths.groupBy("host").agg(F.count("*").alias("n")).select("host", F.lit("").alias("path"), F.array(F.concat("host", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("lines"))
    rows = heads.unionByName(paths.select("host", "path", F.array(F.concat(F.lit("- "), "path")).alias("lines")))
    folder = f"{ensure_checkpoint_dir(spark)}/page-map-{uuid.uuid4().hex}"
    text_output.write_lines(text_output.numbered_lines(rows, ["host", "path"], F.col("lines")), folder, max(4, spark.sparkContext.defaultParallelism))
    return spark.read.text(folder)


def _globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern of every part: a literal, an ending, a beginning, or with a class."""
    key, parts = F.col("p_partkey"), table(spark, sf_dir, "part")
    kinds = [key.cast("string"), F.concat(F.lit("*"), key % 1000, F.lit(".html")), F.concat(F.substring("p_name", 1, 2), F.lit("*"))]
    pattern = F.concat(F.lit("?"), key % 100, F.lit("[0-4]*"))
    for i, kind in enumerate(kinds):
        pattern = F.when(key % 4 == i, kind).otherwise(pattern)
    return parts.select(pattern.alias("pattern"))


@_query("""
WITH g AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '*' || (p_partkey % 1000) || '.html' WHEN 2 THEN substr(p_name, 1, 2) || '*' ELSE '?' || (p_partkey % 100) || '[0-4]*' END AS pattern FROM part),
s AS (SELECT page_id, unnest(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS name FROM pages),
m AS (SELECT name, pattern FROM (SELECT DISTINCT name FROM s) JOIN g ON name GLOB pattern),
f AS (SELECT page_id, string_agg(pattern, ' ' ORDER BY pattern) AS patterns FROM (SELECT DISTINCT page_id, pattern FROM s JOIN m USING (name)) GROUP BY page_id)
SELECT page_id, coalesce(patterns, '') AS patterns FROM pages LEFT JOIN f USING (page_id)""")
def t_glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns, out of one for every part, that match a component of each page's path."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return glob_tables.matching(pages, "path", _globs(spark, sf_dir)).select("page_id", F.array_join("patterns", " ").alias("patterns"))


@_query("""
SELECT kind, key, name FROM (SELECT 'part' AS kind, p_partkey AS key, p_name AS name FROM part UNION ALL SELECT 'customer', c_custkey, c_name FROM customer)
WHERE name IN (SELECT c_name FROM customer WHERE c_custkey % 97 = 0) OR name IN (SELECT p_name FROM part WHERE p_partkey % 501 = 0)""")
def t_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and customers in a kept index, and a lookup of some of them."""
    parts = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    wanted = customers.where("key % 97 = 0").select("name").unionByName(parts.where("key % 501 = 0").select("name"))
    index = name_index.build(parts.unionByName(customers))
    found = checkpointed(index.lookup(wanted))
    index.drop()
    return found.select("kind", "key", "name")


@_query(r"""
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS n_words, strlen(coalesce(text, '')) AS n_bytes,
  (SELECT count(DISTINCT coalesce(text, '')) FROM documents WHERE doc_id % 100 > 0) AS first_computed,
  (SELECT count(DISTINCT coalesce(text, '')) FROM documents WHERE doc_id % 100 = 0 AND coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 100 > 0)) AS then_computed
FROM documents""")
def t_memo_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document by a memo: a run over 99 % of the documents, then one over all, which computes what is new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = [F.size(F.split("content", "\n")).alias("n_lines"), F.size(F.regexp_extract_all("content", F.lit("[A-Za-z]+"), F.lit(0))).alias("n_words"), F.octet_length("content").alias("n_bytes")]
    results = T.StructType([T.StructField(n, T.IntegerType()) for n in ("n_lines", "n_words", "n_bytes")])
    memo = Memo(spark, lambda rows: rows.select("__hash", *counted), results)
    memo.apply(docs.where("doc_id % 100 > 0"), "text")
    return memo.apply(docs, "text").select("doc_id", *[F.col(n).cast("long").alias(n) for n in results.fieldNames()], F.lit(memo.computed[0]).cast("long").alias("first_computed"), F.lit(memo.computed[1]).cast("long").alias("then_computed"))
