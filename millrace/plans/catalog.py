"""The engine's own queries, each with the SQL that DuckDB runs on the same tables.

``PLAIN`` holds queries that are one SQL text for both; ``PAIRS`` those whose spelling differs; functions
below are the operators that are not one SELECT. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs, fulltext
from millrace.operators import indexes, stats
from millrace.plans.auth import Denied
from millrace.plans.engine import Engine
from millrace.sources import exports
from millrace.sources.shared import new_folder
from millrace.sources.store import StoreError

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attached(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine that reads the tables by name."""
    engine = Engine(spark, new_folder(spark, "store"))
    for t in names:
        engine.attach(t, table(spark, sf_dir, t))
    return engine


def plain_query(sql: str) -> Query:
    """A statement through the engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return attached(spark, sf_dir, *(t for t in TABLES if t in sql)).sql(sql)

    return run


NULLS = "(SELECT * FROM (VALUES (1, 1), (1, 2), (1, NULL), (NULL, 1), (NULL, NULL)) AS nulls(a, b))"

PLAIN = {
    "flagship": """SELECT c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND l_quantity > 5
        GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 10""",
    "scan_all": "SELECT * FROM nation",
    "project_alias": "SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM customer",
    "qualified_star": "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "filter_cmp": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.05 AND l_returnflag <> 'A'",
    "filter_and_or_not": "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT c_nationkey = 3",
    "filter_is_null": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
    "filter_is_not_null": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NOT NULL",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%'",
    "filter_in_list": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)",
    "filter_not_in": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)",
    "filter_between": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 150000 AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "unary_ops": "SELECT c_custkey, -c_acctbal AS negative, +c_nationkey AS same FROM customer",
    "fraction_arithmetic": "SELECT p_partkey, p_retailprice * 1.5e0 AS up, -(p_retailprice / 4) AS down FROM part",
    "three_valued_logic": f"SELECT a, b, (a > 1 AND b > 1) AS both, (a > 0 OR b > 1) AS either, NOT (a = b) AS differ FROM {NULLS}",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 100000",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_multiway": """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "join_using": "SELECT count(*) AS n FROM (SELECT o_custkey AS k FROM orders) a JOIN (SELECT c_custkey AS k FROM customer) b USING (k)",
    "join_natural": "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_where_pushdown": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000 AND c_mktsegment = 'MACHINERY'",
    "semi_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "semi_exists": "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "anti_not_in": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity < 2)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders)",
    "group_count": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "group_sum_avg_min_max": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_tax) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "global_agg": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders",
    "global_agg_empty": "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderkey < 0",
    "count_column": "SELECT count(b) AS n, count(*) AS rows FROM " + NULLS,
    "count_distinct": "SELECT l_shipdate, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_shipdate",
    "sum_distinct": "SELECT l_linestatus, sum(DISTINCT l_quantity) AS s FROM lineitem GROUP BY l_linestatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "group_multi_key_null": f"SELECT a, b, count(*) AS n FROM {NULLS} GROUP BY a, b",
    "group_null_and_empty": "SELECT k, count(*) AS n FROM (VALUES (CAST(NULL AS STRING)), (''), ('a|b'), ('a'), ('a')) AS t(k) GROUP BY k",
    "group_by_expression": "SELECT p_size % 10 AS bin, count(*) AS n FROM part GROUP BY p_size % 10",
    "select_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "limit": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "order_ordinal": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY 2 DESC, 1",
    "order_text": "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part ORDER BY p_name, p_partkey",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "common_table": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderpriority, count(*) AS n FROM big GROUP BY o_orderpriority",
    "scalar_functions": "SELECT p_partkey, upper(p_name) AS u, length(p_type) AS n, abs(p_size - 25) AS d, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS b, substring(p_name, 1, 3) AS s FROM part",
}

ENGLISH_LIST = ", ".join(f"'{w}'" for w in fulltext.ENGLISH_STOP_WORDS)
DUCK_TOKENS = rf"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\b[a-zA-Z]+\b'), lambda x: lower(x)), lambda x: x NOT IN ({ENGLISH_LIST})) || list_filter(regexp_extract_all(coalesce(text, ''), '[㐀-䶿一-鿿]'), lambda x: x NOT IN ({', '.join(f"'{w}'" for w in fulltext.CHINESE_STOP_WORDS)}))"
DUCK_POSTINGS = f"""d AS (SELECT doc_id, {DUCK_TOKENS} AS t FROM documents),
l AS (SELECT doc_id AS doc, len(t) AS length FROM d WHERE len(t) > 0),
p AS (SELECT term, doc, count(*) AS tf FROM (SELECT doc_id AS doc, unnest(t) AS term FROM d) GROUP BY term, doc)"""
FT_QUERY = "idiot the license benchmark"


def duck_search(terms: list[str], every: bool, tail: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH {DUCK_POSTINGS}, h AS (SELECT * FROM p WHERE term IN ({listed})), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT h.doc, round(sum(ln(1 + tf) / length * ln(1 + (SELECT count(*) FROM l) / df)), 9) AS score FROM h JOIN f USING (term) JOIN l ON l.doc = h.doc
GROUP BY h.doc {f'HAVING count(*) = {len(terms)}' if every else ''} {tail}"""


#: name: (Spark SQL, DuckDB SQL)
PAIRS = {
    "arithmetic_int_div_mod": ("SELECT l_orderkey, l_linenumber, (l_orderkey - 500) div 7 AS q, (l_orderkey - 500) % 7 AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, trunc((l_orderkey - 500) / 7)::BIGINT AS q, (l_orderkey - 500) % 7 AS r FROM lineitem"),
    "eq_null_safe": (f"SELECT a, b, a <=> b AS same FROM {NULLS}", f"SELECT a, b, a IS NOT DISTINCT FROM b AS same FROM {NULLS}"),
    "ne_null_safe": (f"SELECT a, b, NOT (a <=> b) AS differ FROM {NULLS}", f"SELECT a, b, a IS DISTINCT FROM b AS differ FROM {NULLS}"),
    "null_ordering": (f"SELECT a, b, row_number() OVER (ORDER BY a, b DESC) AS place FROM {NULLS}", f"SELECT a, b, row_number() OVER (ORDER BY a ASC NULLS FIRST, b DESC NULLS LAST) AS place FROM {NULLS}"),
    "order_multi": ("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer"),
    "select_no_from": ("SELECT 1 + 2 AS three, 'a' AS letter", "SELECT 1 + 2 AS three, 'a' AS letter"),
    "cast_types": ("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS STRING) AS s FROM orders", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS VARCHAR) AS s FROM orders"),
    "project_expr_name": ("SELECT p_size + 1, p_partkey, count(*) FROM part GROUP BY p_size, p_partkey", 'SELECT p_size + 1 AS "(p_size + 1)", p_partkey, count(*) AS "count(1)" FROM part GROUP BY p_size, p_partkey'),
    "group_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",) * 2,
    "join_hash_hint": ("SELECT /*+ SHUFFLE_HASH(c) */ o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_merge_hint": ("SELECT /*+ MERGE(o) */ o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
}


def string_compare_mixed(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    size, limit = F.col("p_size"), F.lit("9")
    return df.select("p_partkey", exprs.compare_mixed(size, limit, "<").alias("less"), exprs.compare_mixed(size, limit, "=").alias("same"))


def dialect_null_safe(spark, sf_dir):
    """The null-safe dialect over SQL text."""
    engine = Engine(spark, new_folder(spark, "store"), null_safe_equality=True)
    for t in ("customer", "orders"):
        engine.attach(t, table(spark, sf_dir, t))
    return engine.sql("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey = NULL AND c_nationkey <> 3")


# Full text.


#: Stored text indexes of this process, by the application and by the files that they were built from.
TEXT_INDEXES: dict[tuple, str] = {}


def ft_index(spark, sf_dir):
    """The stored index of all documents, written once for the files as they are."""
    documents = table(spark, sf_dir, "documents")
    files = documents.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()  # a row for each file
    key = (spark.sparkContext.applicationId, *sorted(map(tuple, files)))
    if key not in TEXT_INDEXES:
        path = new_folder(spark, "text-index")
        fulltext.store(fulltext.build(documents, "doc_id", "text"), path)
        TEXT_INDEXES[key] = path
    return fulltext.load(spark, TEXT_INDEXES[key])


def ft_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(fulltext.tokens(F.col("text")), " ").alias("tokens"))


def ft_term_freq(spark, sf_dir):
    return ft_index(spark, sf_dir).postings


def ft_doc_freq(spark, sf_dir):
    return fulltext.document_frequency(ft_index(spark, sf_dir))


def ft_index_stats(spark, sf_dir):
    return fulltext.statistics(ft_index(spark, sf_dir)).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


def ft_match_or(spark, sf_dir):
    return fulltext.search(ft_index(spark, sf_dir), FT_QUERY).withColumn("score", F.round("score", 9))


def ft_match_and(spark, sf_dir):
    return fulltext.search(ft_index(spark, sf_dir), "license http", every=True).withColumn("score", F.round("score", 9))


def ft_score_topk(spark, sf_dir):
    found = fulltext.search(ft_index(spark, sf_dir), FT_QUERY).withColumn("score", F.round("score", 9))
    return found.orderBy(F.desc("score"), "doc").limit(10)


def ft_match_sql(spark, sf_dir):
    engine = Engine(spark, new_folder(spark, "store"))
    engine.attach("documents", table(spark, sf_dir, "documents"))
    return engine.sql(f"SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('{FT_QUERY}')")


# Indexes.


def idx_point(spark, sf_dir):
    return indexes.point(table(spark, sf_dir, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey")


def idx_point_dups(spark, sf_dir):
    return indexes.point(table(spark, sf_dir, "lineitem"), "l_partkey", 5, 6, 7).select("l_partkey", "l_orderkey", "l_linenumber")


def idx_range(spark, sf_dir):
    """Over a copy written in key order."""
    path = new_folder(spark, "index")
    indexes.write_sorted(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], path)
    return indexes.key_range(indexes.read_index(spark, path), "l_orderkey", 100, 300)


def idx_composite_prefix(spark, sf_dir):
    return indexes.prefix(table(spark, sf_dir, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"}).select("l_orderkey", "l_linenumber")


def idx_composite_range(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return indexes.composite_range(df, ["l_orderkey", "l_linenumber"], [100, 2], [200, 1])


def idx_hash(spark, sf_dir):
    engine = Engine(spark, new_folder(spark, "store"))
    engine.sql("CREATE DATABASE d")
    engine.sql("CREATE TABLE c (c_custkey BIGINT, c_name VARCHAR(64), c_nationkey INT)")
    engine.attach("customer", table(spark, sf_dir, "customer"))
    engine.sql("INSERT INTO c SELECT c_custkey, c_name, c_nationkey FROM customer")
    engine.sql("CREATE INDEX by_nation ON c (c_nationkey) USING HASH")
    return engine.sql("SELECT * FROM c WHERE c_nationkey = 7")


def idx_starts_with(spark, sf_dir):
    return indexes.starts_with(table(spark, sf_dir, "part"), "p_type", "S").select("p_partkey", "p_type")


def idx_upsert_last(spark, sf_dir):
    return indexes.upsert_last(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


def idx_key_stats(spark, sf_dir):
    return indexes.key_stats(table(spark, sf_dir, "lineitem"), "l_partkey")


# Statistics.


def stats_table(spark, sf_dir):
    return stats.table_stats(table(spark, sf_dir, "lineitem"))


STATS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def stats_columns(spark, sf_dir):
    return stats.column_stats(table(spark, sf_dir, "orders"), STATS_COLUMNS)


def stats_mcv_top10(spark, sf_dir):
    return stats.most_common(table(spark, sf_dir, "lineitem"), "l_partkey")


def selectivity_eq(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    common = dict(stats.most_common(df, "o_orderpriority").collect())  # ten values
    rows, distinct = df.agg(F.count("*"), F.count_distinct("o_orderpriority")).first()
    share = stats.selectivity_eq(distinct, common, rows, "1-URGENT")
    return spark.createDataFrame([(round(share, 9),)], "selectivity double")


def explain_plan(spark, sf_dir):
    engine = Engine(spark, new_folder(spark, "store"))
    for t in ("orders", "customer"):
        engine.attach(t, table(spark, sf_dir, t))
    return engine.sql("EXPLAIN SELECT c_name, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name")


def stats_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "customer"), "c_custkey")


def selectivity_range(spark, sf_dir):
    """Whether the estimate from the histogram is within a twentieth of the true share."""
    df = table(spark, sf_dir, "orders")
    bounds = [r["bound"] for r in stats.histogram(df, "o_totalprice", 20).orderBy("bucket").collect()]  # 21 bounds
    share = df.agg(F.avg(F.when(F.col("o_totalprice").between(50_000, 150_000), 1.0).otherwise(0.0))).first()[0]
    return spark.createDataFrame([(abs(stats.selectivity_range(bounds, 50_000, 150_000) - share) <= 0.05,)], "close boolean")


def cost_model(spark, sf_dir):
    """Costs of plans over the tables' row counts."""
    n, m = (float(table(spark, sf_dir, t).count()) for t in ("customer", "orders"))
    scan = stats.seq_scan_cost(n / 100, n, 1)
    rows = [("scan", scan), ("index", stats.index_scan_cost(n / 100, n, 0.01)), ("loop", stats.nested_loop_cost(scan, 7.0, n, m)), ("hash", stats.hash_join_cost(scan, 7.0, n, m)), ("aggregate", stats.aggregate_cost(scan, n, 5.0)), ("limit", stats.limit_cost(scan, n, 10.0))]
    return spark.createDataFrame([(k, round(v, 6)) for k, v in rows], "step string, cost double")


def join_order(spark, sf_dir):
    """The order of least cost of three tables: the selective pair first."""
    relations = [stats.Relation(t, float(table(spark, sf_dir, t).count()), 1.0) for t in ("lineitem", "orders", "customer")]
    shares = {frozenset(("lineitem", "orders")): 1 / relations[1].rows, frozenset(("orders", "customer")): 1 / relations[2].rows}
    order, _ = stats.join_order(relations, shares)
    return spark.createDataFrame([(sorted(order[:2])[0], order[2])], "first string, last string")


# Statements over snapshot tables.

CUSTOMER = "c_custkey BIGINT NOT NULL, c_name VARCHAR(64), c_nationkey INT, c_acctbal DOUBLE, c_mktsegment VARCHAR(16) DEFAULT 'NONE'"


def customers(spark, sf_dir) -> Engine:
    """An engine with all customers in a snapshot table ``c``."""
    engine = Engine(spark, new_folder(spark, "store"))
    engine.attach("customer", table(spark, sf_dir, "customer"))
    engine.run_script(f"CREATE DATABASE d; CREATE TABLE c ({CUSTOMER}); INSERT INTO c SELECT * FROM customer;")
    return engine


def after(*statements: str, select: str = "SELECT * FROM c") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = customers(spark, sf_dir)
        for s in statements:
            engine.sql(s)
        return engine.sql(select)

    return run


def show_tables(spark, sf_dir):
    return customers(spark, sf_dir).sql("SHOW TABLES")


def import_export(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "customer")
        path = f"{new_folder(spark, 'export')}.{kind}"
        if kind == "xml":
            exports.export_file(df, path, kind)
            rows = spark.read.format("xml").option("rowTag", "row").schema(df.schema).load(path)
            return rows.select(df.columns)
        engine = customers(spark, sf_dir)
        engine.sql(f"SELECT * FROM c INTO OUTFILE '{path}' FORMAT {kind}")
        engine.sql(f"CREATE TABLE back ({CUSTOMER})")
        engine.sql(f"IMPORT INTO back FROM '{path}'")
        return engine.sql("SELECT * FROM back")

    return run


def ft_remove(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("doc"))
    return fulltext.remove(ft_index(spark, sf_dir), gone).postings


def ft_update(spark, sf_dir):
    new = table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id", F.lit("Brand new Text text").alias("text"))
    return fulltext.update(ft_index(spark, sf_dir), new, "doc_id", "text").postings


def ft_document_terms(spark, sf_dir):
    return fulltext.document_terms(ft_index(spark, sf_dir), 7)


def ft_match_index(spark, sf_dir):
    """MATCH by a FULLTEXT index that later rows have joined."""
    engine = attached(spark, sf_dir, "documents")
    engine.run_script("""CREATE DATABASE d; CREATE TABLE docs (doc_id BIGINT, text TEXT); INSERT INTO docs SELECT doc_id, text FROM documents WHERE lang = 'de';
        CREATE FULLTEXT INDEX f ON docs (text); INSERT INTO docs SELECT doc_id, text FROM documents WHERE lang <> 'de' OR lang IS NULL""")
    return engine.sql(f"SELECT doc_id FROM docs WHERE MATCH(text) AGAINST('{FT_QUERY}')")


def idx_kept_up(spark, sf_dir):
    """A look-up by an index after INSERT, UPDATE and DELETE."""
    engine = customers(spark, sf_dir)
    engine.run_script("""CREATE INDEX k ON c (c_custkey); INSERT INTO c (c_custkey, c_name) VALUES (77, 'again'); UPDATE c SET c_custkey = 77 WHERE c_custkey = 5; DELETE FROM c WHERE c_custkey = 6""")
    return engine.sql("SELECT c_custkey, c_name FROM c WHERE c_custkey BETWEEN 6 AND 77")


def constraints(spark, sf_dir):
    """What each of some wrong statements fails with; the table stays as it was."""
    engine = customers(spark, sf_dir)
    engine.run_script("CREATE TABLE k (id INT PRIMARY KEY, v VARCHAR(3), n SMALLINT CHECK (n > 0)); INSERT INTO k VALUES (1, 'abc', 1)")
    rows = []
    for name, statement in {"not null": "INSERT INTO c (c_name) VALUES ('x')", "primary key": "INSERT INTO k VALUES (1, 'b', 2)", "twice": "INSERT INTO k VALUES (2, 'b', 2), (2, 'c', 3)", "length": "INSERT INTO k VALUES (3, 'abcd', 2)", "check": "INSERT INTO k VALUES (4, 'a', -1)", "update": "UPDATE k SET n = 0", "column": "INSERT INTO k (nothing) VALUES (1)", "table": "DELETE FROM nothing", "database": "DROP DATABASE nothing", "index": "DROP INDEX nothing ON k"}.items():
        try:
            engine.sql(statement)
            rows.append((name, "done"))
        except StoreError as error:
            rows.append((name, error.kind))
    return spark.createDataFrame([*rows, ("rows", str(engine.store.read("k").count()))], "statement string, outcome string")


def permissions(spark, sf_dir):
    """Who may do what after GRANT and REVOKE."""
    engine = customers(spark, sf_dir)
    engine.run_script("CREATE USER ann IDENTIFIED BY 'a'; CREATE USER bob IDENTIFIED BY 'b' WITH ADMIN; CREATE USER cid IDENTIFIED BY 'c'; GRANT SELECT, DELETE ON d.c TO ann; GRANT ALL ON d.* TO cid; REVOKE DELETE ON d.c FROM ann; ALTER USER ann IDENTIFIED BY 'new'; CREATE USER dan IDENTIFIED BY 'd'; DROP USER dan")
    rows = []
    for user in ("ann", "bob", "cid"):
        for privilege in ("SELECT", "DELETE"):
            rows.append((user, privilege, engine.users.allowed(user, privilege, "d", "c")))
    rows += [("ann", "old password", engine.users.authenticate("ann", "a")), ("ann", "new password", engine.users.authenticate("ann", "new")), ("dan", "password", engine.users.authenticate("dan", "d"))]
    engine.user = "ann"
    for statement in ("SELECT * FROM c", "DELETE FROM c"):
        try:
            engine.sql(statement)
            rows.append(("ann", statement, True))
        except Denied:
            rows.append(("ann", statement, False))
    return spark.createDataFrame(rows, "user string, what string, may boolean")


def result_cache(spark, sf_dir):
    """A cached result is used again until its table changes."""
    engine, counts = customers(spark, sf_dir), []
    sql = "SELECT count(*) AS n FROM c"
    for statement in (None, None, "INSERT INTO c (c_custkey) VALUES (-1)", None):
        if statement:
            engine.sql(statement)
        counts.append((engine.query(sql, cached=True).first()[0], engine.cache.hits, engine.cache.misses))
    engine.cache.invalidate()
    return spark.createDataFrame(counts, "n long, hits int, misses int")


def script(spark, sf_dir):
    """A script with comments, and semicolons in strings; statements slower than 0 ms are logged."""
    engine = customers(spark, sf_dir)
    engine.slow_ms = 0
    engine.run_script("-- a comment; not a statement\nCREATE TABLE s (v TEXT); /* ; */ INSERT INTO s VALUES ('a;b'), ('--c');")
    return engine.sql(f"SELECT v, {len(engine.slow)} AS logged FROM s")


def export_statement(spark, sf_dir):
    engine = customers(spark, sf_dir)
    path = f"{new_folder(spark, 'export')}.json"
    engine.run_script(f"EXPORT SELECT * FROM c TO '{path}' FORMAT JSON; CREATE TABLE back ({CUSTOMER}); IMPORT INTO back FROM '{path}'; SAVE")
    return engine.sql("SELECT * FROM back")


LATER = {
    "drop_table": after("CREATE TABLE x (a INT)", "DROP TABLE x", "DROP TABLE IF EXISTS x", select="SHOW TABLES"),
    "drop_database": after("CREATE DATABASE e", "DROP DATABASE e", "DROP DATABASE IF EXISTS e", select="SHOW DATABASES"),
    "drop_index": after("CREATE INDEX i ON c (c_custkey)", "CREATE INDEX j ON c (c_name)", "DROP INDEX i ON c", "DROP INDEX IF EXISTS i ON c", select="SHOW INDEXES FROM c"),
    "use_database": after("CREATE DATABASE e", "USE e", "CREATE TABLE only_here (a INT)", select="SHOW TABLES"),
    "rename_table": after("ALTER TABLE c RENAME TO moved", select="SELECT * FROM moved"),
    "current_timestamp_default": after("CREATE TABLE t (k BIGINT, at TIMESTAMP DEFAULT CURRENT_TIMESTAMP)", "INSERT INTO t (k) SELECT c_custkey FROM customer", select="SELECT count(*) AS n, count(at) AS stamped FROM t"),
}


def analyzed(column: str) -> str:
    return f"SELECT 'c' AS table_name, '{column}' AS column_name, count(*) AS row_count, count(*) - count({column}) AS null_count, count(DISTINCT {column}) AS distinct_count, CAST(min({column}) AS VARCHAR) AS min_value, CAST(max({column}) AS VARCHAR) AS max_value FROM customer"


FUNCTIONS: dict[str, tuple[Query, str | None]] = {
    "ft_remove": (ft_remove, f"WITH {DUCK_POSTINGS} SELECT p.* FROM p JOIN documents ON doc = doc_id WHERE lang IS DISTINCT FROM 'de'"),
    "ft_update": (ft_update, f"WITH {DUCK_POSTINGS} SELECT p.* FROM p JOIN documents ON doc = doc_id WHERE lang IS DISTINCT FROM 'de' UNION ALL SELECT term, doc_id, tf FROM documents, (VALUES ('brand', 1), ('new', 1), ('text', 2)) AS w(term, tf) WHERE lang = 'de'"),
    "ft_document_terms": (ft_document_terms, f"WITH {DUCK_POSTINGS} SELECT term, tf FROM p WHERE doc = 7"),
    "ft_match_index": (ft_match_index, f"WITH {DUCK_POSTINGS} SELECT DISTINCT doc AS doc_id FROM p WHERE term IN ('idiot', 'license', 'benchmark')"),
    "idx_kept_up": (idx_kept_up, "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 7 AND 77 UNION ALL SELECT 77, c_name FROM customer WHERE c_custkey = 5 UNION ALL SELECT 77, 'again'"),
    "stats_histogram": (stats_histogram, "SELECT unnest(range(11)) AS bucket, unnest(quantile_disc(c_custkey, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS bound FROM customer"),
    "selectivity_range": (selectivity_range, "SELECT true AS close"),
    "cost_model": (
        cost_model,
        """WITH t AS (SELECT (SELECT count(*) FROM customer)::DOUBLE AS n, (SELECT count(*) FROM orders)::DOUBLE AS m), s AS (SELECT n, m, n / 100 + n * 0.01::DOUBLE + n * 0.005::DOUBLE AS scan FROM t)
        SELECT step, round(cost, 6) AS cost FROM (SELECT 'scan' AS step, scan AS cost FROM s UNION ALL SELECT 'index', least(n * 0.01, n / 100) * 4 + n * 0.01 * 0.03 FROM s UNION ALL SELECT 'loop', scan + n * 7 + n * m * 0.005::DOUBLE FROM s
        UNION ALL SELECT 'hash', scan + 7 + least(n, m) * 0.0101::DOUBLE + greatest(n, m) * 0.005::DOUBLE FROM s UNION ALL SELECT 'aggregate', scan + n * 0.005::DOUBLE + 5 * 0.0101::DOUBLE FROM s UNION ALL SELECT 'limit', scan * 10 / n FROM s)""",
    ),
    "join_order": (join_order, "SELECT 'customer' AS first, 'lineitem' AS last"),
    "constraints": (constraints, "SELECT * FROM (VALUES ('not null', 'CONSTRAINT_VIOLATION'), ('primary key', 'CONSTRAINT_VIOLATION'), ('twice', 'CONSTRAINT_VIOLATION'), ('length', 'CONSTRAINT_VIOLATION'), ('check', 'CONSTRAINT_VIOLATION'), ('update', 'CONSTRAINT_VIOLATION'), ('column', 'COLUMN_NOT_FOUND'), ('table', 'TABLE_NOT_FOUND'), ('database', 'DATABASE_NOT_FOUND'), ('index', 'INDEX_NOT_FOUND'), ('rows', '1')) AS t(statement, outcome)"),
    "permissions": (permissions, "SELECT * FROM (VALUES ('ann', 'SELECT', true), ('ann', 'DELETE', false), ('bob', 'SELECT', true), ('bob', 'DELETE', true), ('cid', 'SELECT', true), ('cid', 'DELETE', true), ('ann', 'old password', false), ('ann', 'new password', true), ('dan', 'password', false), ('ann', 'SELECT * FROM c', true), ('ann', 'DELETE FROM c', false)) AS t(\"user\", what, may)"),
    "result_cache": (result_cache, "SELECT count(*) AS n, 0 AS hits, 1 AS misses FROM customer UNION ALL SELECT count(*), 1, 1 FROM customer UNION ALL SELECT count(*) + 1, 1, 2 FROM customer UNION ALL SELECT count(*) + 1, 2, 2 FROM customer"),
    "script": (script, "SELECT v, 2 AS logged FROM (VALUES ('a;b'), ('--c')) AS t(v)"),
    "export_statement": (export_statement, "SELECT * FROM customer"),
    "drop_table": (LATER["drop_table"], "SELECT 'c' AS \"Table\""),
    "drop_database": (LATER["drop_database"], "SELECT 'd' AS \"Database\""),
    "drop_index": (LATER["drop_index"], """SELECT 'c' AS "Table", 'j' AS "Index", 'c_name' AS "Columns", 'BTREE' AS "Type", false AS "Unique" """),
    "use_database": (LATER["use_database"], "SELECT 'only_here' AS \"Table\""),
    "rename_table": (LATER["rename_table"], "SELECT * FROM customer"),
    "current_timestamp_default": (LATER["current_timestamp_default"], "SELECT count(*) AS n, count(*) AS stamped FROM customer"),
    "string_compare_mixed": (string_compare_mixed, "SELECT p_partkey, CAST(p_size AS VARCHAR) < '9' AS less, CAST(p_size AS VARCHAR) = '9' AS same FROM part"),
    "dialect_null_safe": (dialect_null_safe, "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL AND c_nationkey IS DISTINCT FROM 3"),
    "ft_tokenize": (ft_tokenize, f"SELECT doc_id, array_to_string({DUCK_TOKENS}, ' ') AS tokens FROM documents"),
    "ft_term_freq": (ft_term_freq, f"WITH {DUCK_POSTINGS} SELECT * FROM p"),
    "ft_doc_freq": (ft_doc_freq, f"WITH {DUCK_POSTINGS} SELECT term, count(*) AS df FROM p GROUP BY term"),
    "ft_index_stats": (ft_index_stats, f"WITH {DUCK_POSTINGS} SELECT (SELECT count(DISTINCT term) FROM p) AS num_terms, (SELECT count(*) FROM l) AS num_documents, (SELECT count(*) FROM p) AS total_postings, (SELECT round(avg(length), 6) FROM l) AS avg_doc_length"),
    "ft_match_or": (ft_match_or, duck_search(["idiot", "license", "benchmark"], False)),
    "ft_match_and": (ft_match_and, duck_search(["license", "http"], True)),
    "ft_score_topk": (ft_score_topk, duck_search(["idiot", "license", "benchmark"], False, "ORDER BY score DESC, doc LIMIT 10")),
    "ft_match_sql": (ft_match_sql, f"WITH {DUCK_POSTINGS} SELECT DISTINCT doc AS doc_id FROM p WHERE term IN ('idiot', 'license', 'benchmark')"),
    "idx_point": (idx_point, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77"),
    "idx_point_dups": (idx_point_dups, "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (5, 6, 7)"),
    "idx_range": (idx_range, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 300"),
    "idx_composite_prefix": (idx_composite_prefix, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'"),
    "idx_composite_range": (idx_composite_range, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey > 100 OR l_orderkey = 100 AND l_linenumber >= 2) AND (l_orderkey < 200 OR l_orderkey = 200 AND l_linenumber <= 1)"),
    "idx_hash": (idx_hash, "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7"),
    "idx_starts_with": (idx_starts_with, "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'"),
    "idx_upsert_last": (idx_upsert_last, "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "idx_key_stats": (idx_key_stats, "SELECT count(*) AS entries, count(DISTINCT l_partkey) AS distinct_keys, min(l_partkey) AS min_key, max(l_partkey) AS max_key FROM lineitem"),
    "stats_table": (stats_table, "SELECT count(*) AS row_count FROM lineitem"),
    "stats_columns": (stats_columns, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders" for c in STATS_COLUMNS)),
    "stats_mcv_top10": (stats_mcv_top10, "SELECT l_partkey AS value, count(*) AS frequency FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "selectivity_eq": (selectivity_eq, "SELECT round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 9) AS selectivity FROM orders"),
    "explain_plan": (explain_plan, None),
    "insert_values": (after("INSERT INTO c (c_custkey, c_name) VALUES (-1, 'Ann'), (-2, NULL)"), "SELECT * FROM customer UNION ALL SELECT * FROM (VALUES (-1, 'Ann', NULL, NULL, 'NONE'), (-2, NULL, NULL, NULL, 'NONE'))"),
    "insert_select": (after("INSERT INTO c SELECT c_custkey + 1000000, c_name, c_nationkey, 0, 'COPY' FROM customer WHERE c_acctbal < 0"), "SELECT * FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, 0, 'COPY' FROM customer WHERE c_acctbal < 0"),
    "update_where": (after("UPDATE c SET c_acctbal = c_acctbal + 10, c_name = concat(c_name, '!') WHERE c_mktsegment = 'BUILDING'"), "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"),
    "delete_where": (after("DELETE FROM c WHERE c_acctbal < 0"), "SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 0, false)"),
    "auto_increment": (
        after("CREATE TABLE n (id INT AUTO_INCREMENT NOT NULL, k BIGINT)", "INSERT INTO n (k) SELECT c_custkey FROM customer", "INSERT INTO n (k) VALUES (-1)", select="SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS low, max(id) AS high, max(CASE WHEN k = -1 THEN id END) AS last_id FROM n"),
        "SELECT count(*) + 1 AS n, count(*) + 1 AS ids, 1 AS low, CAST(count(*) + 1 AS INT) AS high, CAST(count(*) + 1 AS INT) AS last_id FROM customer",
    ),
    "defaults": (after("INSERT INTO c (c_custkey) VALUES (-5)", select="SELECT c_custkey, c_mktsegment FROM c"), "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT -5, 'NONE'"),
    "txn_rollback": (after("BEGIN", "DELETE FROM c WHERE c_custkey > 10", "UPDATE c SET c_acctbal = 0", "ROLLBACK"), "SELECT * FROM customer"),
    "txn_commit": (after("BEGIN TRANSACTION", "DELETE FROM c WHERE c_custkey > 10", "INSERT INTO c (c_custkey) VALUES (-7)", "COMMIT", select="SELECT c_custkey, c_mktsegment FROM c"), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey <= 10 UNION ALL SELECT -7, 'NONE'"),
    "alter_add_column": (after("ALTER TABLE c ADD COLUMN grade INT DEFAULT 7"), "SELECT *, 7 AS grade FROM customer"),
    "alter_drop_column": (after("ALTER TABLE c DROP COLUMN c_acctbal"), "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"),
    "alter_rename_column": (after("ALTER TABLE c RENAME COLUMN c_name TO full_name"), "SELECT c_custkey, c_name AS full_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "alter_modify_column": (after("ALTER TABLE c MODIFY COLUMN c_nationkey BIGINT"), "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "vacuum": (after("DELETE FROM c WHERE c_acctbal < 0", "VACUUM c"), "SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 0, false)"),
    "analyze": (after(select="ANALYZE TABLE c"), " UNION ALL ".join(map(analyzed, ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))),
    "show_tables": (show_tables, "SELECT 'c' AS \"Table\""),
    "show_databases": (after(select="SHOW DATABASES"), "SELECT 'd' AS \"Database\""),
    "describe": (after(select="DESCRIBE c"), """SELECT * FROM (VALUES ('c_custkey', 'BIGINT', 'NO', '', NULL, ''), ('c_name', 'VARCHAR(64)', 'YES', '', NULL, ''), ('c_nationkey', 'INT', 'YES', '', NULL, ''), ('c_acctbal', 'DOUBLE', 'YES', '', NULL, ''), ('c_mktsegment', 'VARCHAR(16)', 'YES', '', '''NONE''', '')) AS t("Field", "Type", "Null", "Key", "Default", "Extra")"""),
    "show_indexes": (after("CREATE UNIQUE INDEX i ON c (c_custkey)", "CREATE FULLTEXT INDEX f ON c (c_name)", select="SHOW INDEXES FROM c"), """SELECT 'c' AS "Table", 'i' AS "Index", 'c_custkey' AS "Columns", 'BTREE' AS "Type", true AS "Unique" UNION ALL SELECT 'c', 'f', 'c_name', 'FULLTEXT', false"""),
    "export_csv": (import_export("csv"), "SELECT * FROM customer"),
    "export_json": (import_export("json"), "SELECT * FROM customer"),
    "export_xml": (import_export("xml"), "SELECT * FROM customer"),
}


def import_file(kind: str) -> Query:
    """Files written by the executors, read back by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "supplier")
        path = new_folder(spark, "bulk")
        exports.write_bulk(df.select(*reversed(df.columns)), path, kind)
        if kind == "CSV":
            return exports.import_csv(spark, path, df.schema)
        return spark.read.schema(df.schema).json(path)

    return run


FUNCTIONS["import_csv"] = import_file("CSV"), "SELECT * FROM supplier"
FUNCTIONS["import_json"] = import_file("JSON"), "SELECT * FROM supplier"


def queries() -> dict[str, Query]:
    found = {name: plain_query(sql) for name, sql in PLAIN.items()}
    found |= {name: plain_query(pair[0]) for name, pair in PAIRS.items()}
    return found | {name: f for name, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    found = dict(PLAIN) | {name: pair[1] for name, pair in PAIRS.items()}
    return found | {name: sql for name, (_, sql) in FUNCTIONS.items() if sql}
