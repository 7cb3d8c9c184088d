"""Statements, constraints, transactions, texts and the rest of the engine on small fixtures."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import exprs, fulltext, types
from millrace.operators import indexes, stats
from millrace.plans.auth import Denied
from millrace.plans.cache import QueryCache, normalize
from millrace.plans.engine import Engine, null_safe, split_commas, split_statements
from millrace.sources import exports
from millrace.sources.store import Store, StoreError
from millrace.streaming.ingest import append_stream


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.sql("CREATE DATABASE testdb")
    return e


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_create_insert_select_update_delete(engine):
    engine.run_script("CREATE TABLE employees (id INT PRIMARY KEY, name VARCHAR(50), salary DOUBLE); INSERT INTO employees VALUES (1, 'Alice', 50000), (2, 'Bob', 60000);")
    assert values(engine.sql("SELECT * FROM employees")) == [(1, "Alice", 50000.0), (2, "Bob", 60000.0)]
    assert engine.sql("UPDATE employees SET salary = salary * 1.5 WHERE id = 1").rows == 1
    assert values(engine.sql("SELECT salary FROM employees WHERE id = 1")) == [(75000.0,)]
    assert engine.sql("DELETE FROM employees WHERE name = 'Bob'").rows == 1
    assert values(engine.sql("SELECT id FROM employees")) == [(1,)]


def test_fractions_survive_and_zero_division_fails(engine, spark):
    assert values(engine.sql("SELECT 2.5D * 1.5D AS a, -2.5D AS b, 7 div -2 AS c, -7 % 3 AS d")) == [(3.75, -2.5, -3, -1)]
    with pytest.raises(PySparkException):
        engine.sql("SELECT 1 div 0").collect()
    assert values(spark.range(1).select(exprs.divide_integers(F.lit(-7), F.lit(2)).alias("q"))) == [(-3,)]


def test_constraints(engine):
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, code VARCHAR(3) UNIQUE, n INT DEFAULT 4 CHECK (n > 0), at DATE)")
    engine.sql("INSERT INTO t (id, code) VALUES (1, 'abc')")
    for bad in ("(NULL, 'x', 1, NULL)", "(1, 'x', 1, NULL)", "(2, 'abc', 1, NULL)", "(2, 'abcd', 1, NULL)", "(2, 'x', 0, NULL)"):
        with pytest.raises(StoreError):
            engine.sql(f"INSERT INTO t VALUES {bad}")
    with pytest.raises(PySparkException):
        engine.sql("INSERT INTO t VALUES (3, 'y', 1, 'no date')")
    assert values(engine.sql("SELECT id, n FROM t")) == [(1, 4)]
    with pytest.raises(StoreError):
        engine.sql("INSERT INTO t (id) VALUES (1, 2)")
    with pytest.raises(StoreError):
        engine.sql("UPDATE t SET nope = 1")


def test_auto_increment_fills_nulls_only(engine):
    engine.sql("CREATE TABLE a (id INT AUTO_INCREMENT NOT NULL, v STRING DEFAULT 'x')".replace("STRING", "TEXT"))
    engine.sql("INSERT INTO a (v) VALUES ('p'), ('q')")
    engine.sql("INSERT INTO a VALUES (10, 'r'), (NULL, 's')")
    engine.sql("INSERT INTO a (id) VALUES (NULL)")
    assert values(engine.sql("SELECT id FROM a")) == [(1,), (10,), (11,), (12,), (2,)]


def test_transactions_and_conflicts(engine, spark):
    engine.run_script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    engine.run_script("BEGIN; INSERT INTO t VALUES (2); UPDATE t SET a = 9 WHERE a = 1; ROLLBACK")
    assert values(engine.sql("SELECT a FROM t")) == [(1,)]
    with pytest.raises(StoreError):
        engine.sql("COMMIT")
    engine.run_script("BEGIN; INSERT INTO t VALUES (2); CREATE TABLE u (b INT)")
    with pytest.raises(StoreError):
        engine.sql("BEGIN")
    other = Engine(spark, engine.store.files.root)
    assert values(other.sql("SELECT a FROM t")) == [(1,)] and other.store.tables() == ["t"]
    other.sql("INSERT INTO t VALUES (3)")
    with pytest.raises(StoreError):
        engine.sql("COMMIT")
    assert values(engine.sql("SELECT a FROM t")) == [(1,), (3,)]
    engine.run_script("BEGIN; DELETE FROM t WHERE a = 3; INSERT INTO t VALUES (4); COMMIT")
    assert values(other.sql("SELECT a FROM t")) == [(1,), (4,)]


def test_null_predicates_in_dml(engine):
    engine.run_script("CREATE TABLE n (a INT, b INT); INSERT INTO n VALUES (1, 1), (1, NULL), (NULL, 1), (NULL, NULL)")
    assert engine.sql("DELETE FROM n WHERE a = b").rows == 1
    engine.null_safe_equality = True
    assert engine.sql("DELETE FROM n WHERE a = b").rows == 1
    assert values(engine.sql("SELECT * FROM n WHERE a <> b")) == [(1, None), (None, 1)]


def test_vacuum_keeps_rows_and_drops_folders(engine):
    engine.run_script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2); DELETE FROM t WHERE a = 1; INSERT INTO t VALUES (3)")
    assert engine.sql("VACUUM t").rows >= 3
    assert values(engine.sql("SELECT a FROM t")) == [(2,), (3,)]
    assert len([n for n in engine.store.files.list("testdb/t") if n.startswith("data-")]) == 1


def test_ddl_and_show(engine):
    engine.sql("CREATE TABLE IF NOT EXISTS t (a INT)")
    engine.sql("CREATE TABLE IF NOT EXISTS t (a INT)")
    with pytest.raises(StoreError):
        engine.sql("CREATE TABLE T (a INT)")
    engine.sql("DROP TABLE IF EXISTS nope")
    engine.sql("ALTER TABLE t ADD b DECIMAL(5,2) NOT NULL DEFAULT 1.5")
    engine.sql("INSERT INTO t (a) VALUES (1)")
    engine.sql("ALTER TABLE t RENAME COLUMN a TO c")
    assert engine.sql("DESCRIBE t").select("Field").collect()[0][0] == "c"
    engine.sql("ALTER TABLE t RENAME TO u")
    assert values(engine.sql("SHOW TABLES")) == [("u",)]
    engine.sql("CREATE DATABASE other")
    assert values(engine.sql("SHOW DATABASES")) == [("other",), ("testdb",)]
    engine.sql("USE other")
    assert values(engine.sql("SHOW TABLES")) == []
    engine.sql("DROP DATABASE other")
    assert engine.store.current == "testdb"
    engine.sql("DROP TABLE u")
    with pytest.raises(StoreError):
        engine.sql("DROP TABLE u")
    engine.sql("CREATE TABLE u (z INT)")
    assert engine.sql("SELECT * FROM u").columns == ["z"]


def test_indexes(engine):
    engine.run_script("CREATE TABLE t (k INT, v TEXT); INSERT INTO t VALUES (1, 'alpha beta'), (1, 'beta'), (2, NULL), (NULL, 'x')")
    with pytest.raises(StoreError):
        engine.sql("CREATE UNIQUE INDEX u ON t (k)")
    engine.sql("CREATE INDEX b ON t (k)")
    engine.sql("CREATE HASH INDEX h ON t (k)")
    engine.sql("CREATE INDEX f ON t (v) USING FULLTEXT")
    found = engine.store.manifest("t")
    for name in ("b", "h"):
        (path,) = engine.store.index_paths(found, name)
        assert values(indexes.point(indexes.read_index(engine.spark, path), "k", 1)) == [(1, "alpha beta"), (1, "beta")]
    assert indexes.read_index(engine.spark, engine.store.index_paths(found, "b")[0]).count() == 3
    engine.sql("DROP INDEX b ON t")
    assert [r[1] for r in engine.sql("SHOW INDEXES FROM t").collect()] == ["f", "h"]
    with pytest.raises(StoreError):
        engine.sql("DROP INDEX b ON t")


def reads(df) -> str:
    return " ".join(df.inputFiles())


def test_queries_read_indexes_that_statements_keep_up(engine):
    engine.run_script("CREATE TABLE t (k INT, j INT, v TEXT); INSERT INTO t VALUES (1, 1, 'alpha beta'), (1, 2, 'beta'), (2, 3, NULL), (NULL, 4, 'x alpha')")
    engine.run_script("CREATE INDEX b ON t (k); CREATE INDEX c ON t (j, k); CREATE FULLTEXT INDEX f ON t (v); CREATE INDEX h ON t (j) USING HASH")

    def ask(condition, index, tail=""):
        df = engine.sql(f"SELECT a.j FROM t AS a WHERE {condition}{tail}")
        indexed = f"index-{index}-" in reads(df)
        got = sorted(r[0] for r in df.collect())
        plain = engine.store.read("t").createOrReplaceTempView("plain")
        assert plain is None and indexed == bool(index)
        expected = engine.spark.sql(f"SELECT a.j FROM plain AS a WHERE {engine._matches(condition)}")
        assert got == sorted(r[0] for r in expected.collect())
        return got

    def every():
        return [ask("k = 1", "b"), ask("a.k >= 1 AND v IS NOT NULL", "b"), ask("k BETWEEN 1 AND 5 AND j > 1", "b"), ask("j = 3", "h"), ask("j IN (1, 3)", "h"), ask("j = 1 OR k = 2", ""), ask("j + 1 = 2", "")]

    def match():
        query = "SELECT j FROM t WHERE MATCH(v) AGAINST('{}'{})"
        found = engine.sql(query.format("alpha gamma", ""))
        assert "_place" in found._jdf.queryExecution().optimizedPlan().toString()
        both = engine.sql(query.format("alpha beta", " IN BOOLEAN MODE"))
        return sorted(r[0] for r in found.collect()), sorted(r[0] for r in both.collect())

    assert every()[0] == [1, 2] and match() == ([1, 4], [1])
    engine.run_script("INSERT INTO t VALUES (1, 5, 'gamma'), (9, 6, 'alpha and beta')")
    assert every()[0] == [1, 2, 5] and match() == ([1, 4, 5, 6], [1, 6])
    engine.run_script("UPDATE t SET k = 1, v = 'nothing' WHERE j = 4; DELETE FROM t WHERE j = 1")
    assert every()[0] == [2, 4, 5] and match() == ([5, 6], [6])
    engine.run_script("BEGIN; INSERT INTO t VALUES (1, 7, 'alpha'); ROLLBACK; VACUUM t; ALTER TABLE t RENAME TO u; ALTER TABLE u RENAME TO t")
    assert every()[0] == [2, 4, 5] and match() == ([5, 6], [6])
    engine.run_script("ALTER TABLE t DROP COLUMN v")
    assert [r["Index"] for r in engine.sql("SHOW INDEXES FROM t").collect()] == ["b", "c", "h"]


def test_one_publisher_of_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from millrace.sources.files import Files

    files = Files(spark, f"file://{tmp_path}")
    for n in range(20):
        with ThreadPoolExecutor(4) as pool:
            won = list(pool.map(lambda i: files.write(f"{n}.json", str(i), new=True), range(4)))
        assert sum(won) == 1 and files.read(f"{n}.json") == str(won.index(True))
    assert len(files.list("")) == 20


def test_a_batch_is_published_once(engine, spark):
    engine.sql("CREATE TABLE s (x INT)")
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    assert [engine.store.insert("s", rows, batch=b) for b in (0, 0, 1, 0)] == [2, 0, 2, 0]
    assert engine.store.read("s").count() == 4


def test_index_keys(spark):
    dups = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 5)], "k int, rid int")
    assert values(indexes.upsert_last(dups, "k", ["rid"])) == [(1, 11), (2, 20)]
    keys = spark.createDataFrame([("nan",), ("inf",), ("-inf",), (None,), ("0",)], "s string").select(F.col("s").cast("double").alias("d"))
    assert [str(r[0]) for r in keys.orderBy(exprs.key_order(F.col("d"))).collect()] == ["None", "-inf", "0.0", "inf", "nan"]
    one = spark.range(1).select(exprs.key_uuid(F.lit("{ABC-1}")).alias("u"), exprs.key_char(F.lit("a  ")).alias("c"), exprs.key_float_equal(F.lit(1.0), F.lit(1.0 + 1e-11)).alias("e"))
    assert values(one) == [("abc-1", "a", True)]
    numbers = indexes.number_rows(spark.range(0, 100, 1, 7), "n", 5).agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(numbers) == (5, 104, 100)


TEXTS = [(1, "abc123 Hello_x Foo-bar"), (2, "café"), (3, "the and of"), (4, ""), (5, None), (6, "数据库 index 优化"), (7, "alpha alpha beta")]


def test_full_text(spark):
    df = spark.createDataFrame(TEXTS, "id int, body string")
    found = {r[0]: r[1] for r in df.select("id", fulltext.tokens(F.col("body"))).collect()}
    assert found == {1: ["foo", "bar"], 2: ["caf"], 3: [], 4: [], 5: [], 6: ["index", "数", "据", "库", "优", "化"], 7: ["alpha", "alpha", "beta"]}
    index = fulltext.build(df, "id", "body")
    assert fulltext.statistics(index).first()["num_documents"] == 4
    from math import log

    assert [(r[0], round(r[1], 9)) for r in fulltext.search(index, "Alpha missing").collect()] == [(7, round(log(3) / 3 * log(5), 9))]
    assert fulltext.search(index, "alpha missing", every=True).collect() == []
    assert [r[0] for r in fulltext.search(index, "ALPHA, beta!", every=True).collect()] == [7]
    assert fulltext.search(index, "the of").collect() == []
    assert [r["id"] for r in fulltext.match_against(df, "id", ["body"], "数 foo").orderBy("id").collect()] == [1, 6]


def test_match_in_sql(engine, spark):
    engine.attach("d", spark.createDataFrame(TEXTS, "id int, body string"))
    assert values(engine.sql("SELECT id FROM d WHERE MATCH(body) AGAINST('beta foo')")) == [(1,), (7,)]
    assert values(engine.sql("SELECT id FROM d WHERE MATCH(body) AGAINST('beta alpha' IN BOOLEAN MODE) OR id = 4")) == [(4,), (7,)]


ROWS = [(1, "Alice", 50000.0, None), (2, 'say "hi", <b>', 60000.5, True)]


def test_export_texts(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, name string, salary double, ok boolean").coalesce(1)
    assert exports.export_text(df) == '"id","name","salary","ok"\n1,"Alice",50000,NULL\n2,"say ""hi"", <b>",60000.5,true\n'
    assert '"rowCount": 2' in exports.export_text(df, "JSON") and '"ok": null' in exports.export_text(df, "JSON")
    xml = exports.export_text(df, "XML")
    assert "<name>say &quot;hi&quot;, &lt;b&gt;</name>" in xml and "<ok></ok>" in xml and "<rowCount>2</rowCount>" in xml
    empty = df.filter("id > 5")
    assert exports.export_text(empty) == '"id","name","salary","ok"\n' and '"rowCount": 0' in exports.export_text(empty, "JSON")
    for kind in ("csv", "json"):
        exports.export_file(df, f"file://{tmp_path}/x.{kind}")
        reader = exports.import_csv if kind == "csv" else exports.import_json
        assert values(reader(spark, f"file://{tmp_path}/x.{kind}", df.schema)) == values(df)


def test_import_by_name(spark, tmp_path, engine):
    (tmp_path / "in.csv").write_text('name,id\n"a, ""b""\nc",1\n,2\n')
    engine.sql("CREATE TABLE t (id INT, name TEXT, extra INT DEFAULT 3)")
    engine.sql(f"IMPORT INTO t FROM 'file://{tmp_path}/in.csv'")
    assert values(engine.sql("SELECT * FROM t")) == [(1, 'a, "b"\nc', 3), (2, None, 3)]
    (tmp_path / "in.json").write_text('[{"id": 5, "name": {"k": [1]}}, {"id": 6}]')
    engine.sql(f"IMPORT INTO t FROM 'file://{tmp_path}/in.json'")
    assert values(engine.sql("SELECT id, name FROM t WHERE id > 4")) == [(5, '{"k":[1]}'), (6, None)]


def test_statement_splitting():
    assert split_statements("SELECT ';' AS a; -- c;\nSELECT 2 /* ; */;") == ["SELECT ';' AS a", "SELECT 2"]
    assert split_commas("a = f(1, 2), b = 'x,y'") == ["a = f(1, 2)", "b = 'x,y'"]
    assert null_safe("a = 'x = y'").split() == "a IS NOT DISTINCT FROM 'x = y'".split()


def test_cache(engine):
    assert normalize("  SELECT  *  FROM  users  WHERE  id  =  '1  2'  ") == "SELECT * FROM users WHERE id = '1  2'"
    engine.run_script("CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 2)")
    assert values(engine.query("SELECT a FROM t", cached=True)) == [(1,)]
    assert values(engine.query("SELECT b FROM t", cached=True)) == [(2,)]
    assert values(engine.query("SELECT  a  FROM t", cached=True)) == [(1,)] and engine.cache.hits == 1
    engine.sql("INSERT INTO t VALUES (3, 4)")
    assert values(engine.query("SELECT a FROM t", cached=True)) == [(1,), (3,)]
    small = QueryCache(entries=1)
    small.put("x", (), engine.spark.range(1))
    small.put("y", (), engine.spark.range(1))
    assert small.get("x", ()) is None and small.get("y", ()) is not None
    small.invalidate()


def test_users_and_grants(engine):
    engine.run_script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); CREATE USER alice IDENTIFIED BY 'password123'; GRANT SELECT, INSERT ON testdb.t TO alice")
    assert engine.users.authenticate("alice", "password123") and not engine.users.authenticate("alice", "x")
    engine.user = "alice"
    assert values(engine.sql("SELECT a FROM t")) == [(1,)]
    engine.sql("INSERT INTO t VALUES (2)")
    for refused in ("DELETE FROM t", "DROP TABLE t", "CREATE USER b IDENTIFIED BY 'c'"):
        with pytest.raises(Denied):
            engine.sql(refused)
    engine.user = None
    engine.sql("REVOKE SELECT ON testdb.t FROM alice")
    engine.user = "alice"
    with pytest.raises(Denied):
        engine.sql("SELECT a FROM t")
    engine.user = "admin"
    engine.sql("GRANT ALL ON testdb.* TO alice WITH GRANT OPTION")
    assert engine.users.allowed("alice", "DELETE", "testdb", "t") and not engine.users.allowed("alice", "DELETE", "other", "t")
    engine.run_script("ALTER USER alice IDENTIFIED BY 'n'; DROP USER alice")


def test_types():
    assert types.parse_type("decimal(10, 2)")[1].simpleString() == "decimal(10,2)" and types.parse_type("NUMERIC")[1].simpleString() == "decimal(38,18)"
    assert types.parse_type("double precision")[1].simpleString() == "double" and types.parse_type("VARCHAR(9)")[1].length == 9
    assert types.is_numeric("BIGINT") and types.is_string("clob") and types.is_binary("BLOB") and types.is_datetime("TIME") and types.fixed_size("uuid") == 16
    with pytest.raises(ValueError):
        types.parse_type("WIDGET")


def test_statistics_and_costs(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, s string")
    assert values(stats.column_stats(df)) == [("k", 3, 0, 2, "1", "2"), ("s", 3, 1, 2, "a", "b")]
    assert values(stats.most_common(df, "k")) == [(1, 2), (2, 1)]
    assert stats.histogram(df, "k", 2).count() == 3
    assert stats.selectivity_eq(4, {1: 50}, 100, 1) == 0.5 and stats.selectivity_eq(6, {1: 50}, 100, 2) == pytest.approx(0.1)
    assert stats.selectivity_or(0.5, 0.5) == 0.75 and stats.selectivity_and(0.5, 0.5) == 0.25
    tables = [stats.Relation("a", 1e6, 1e4), stats.Relation("b", 10, 1), stats.Relation("c", 1e3, 10)]
    share = {frozenset("ab"): 0.1, frozenset("bc"): 0.001, frozenset("ac"): 1.0}
    assert set(stats.join_order(tables, share)[0][:2]) == {"b", "c"}
    many = [stats.Relation(f"t{i}", 10.0 ** (i % 4 + 1), 5.0) for i in range(9)]
    assert sorted(stats.join_order(many, {})[0]) == sorted(t.name for t in many)
    assert stats.index_scan_cost(1000, 1e5, 1e-4) < stats.seq_scan_cost(1000, 1e5) and stats.sort_cost(10) < stats.sort_cost(1e6)


@pytest.mark.parametrize("n", [0, 1, 7, 60_000])
def test_histogram_bounds_are_exact(spark, n):
    """Above some 10,000 values an approximate percentile is off; ranks are those of DuckDB's quantile_disc."""
    df = spark.range(n).select(F.when(F.col("id") % 9 == 0, F.col("id") % 700).when(F.col("id") % 5 > 0, F.pmod(F.xxhash64("id"), F.lit(10**9))).alias("k"))
    have = sorted(r[0] for r in df.collect() if r[0] is not None)
    ranks = [max(1, -(-len(have) * i // 10)) for i in range(11)]
    assert sorted(values(stats.histogram(df, "k"))) == [(i, have[r - 1] if have else None) for i, r in enumerate(ranks)]


def test_outfile_explain_analyze_slow(engine, tmp_path):
    engine.slow_ms = 0
    engine.run_script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    engine.sql(f"SELECT * FROM t INTO OUTFILE 'file://{tmp_path}/o.json' FORMAT JSON")
    assert '"rowCount": 1' in (tmp_path / "o.json").read_text()
    engine.sql(f"EXPORT SELECT a FROM t TO 'file://{tmp_path}/o.csv'")
    assert (tmp_path / "o.csv").read_text() == '"a"\n1\n'
    assert any("Scan" in r[0] or "Relation" in r[0] for r in engine.sql("EXPLAIN SELECT a FROM t WHERE a = 1").collect())
    assert values(engine.sql("ANALYZE TABLE t")) == [("t", "a", 1, 0, 1, "1", "1")]
    assert engine.slow and engine.sql("SAVE").message
    with pytest.raises(StoreError):
        engine.sql("FROBNICATE")


def test_stream_into_table(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create_database("d")
    store.create_table("s", [{"name": "a", "type": "INT"}])
    spark.createDataFrame([(1,), (2,)], "a int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a int").parquet(f"{tmp_path}/in")
    append_stream(store, "s", stream, f"{tmp_path}/ck").awaitTermination()
    append_stream(store, "s", stream, f"{tmp_path}/ck").awaitTermination()
    assert values(store.read("s")) == [(1,), (2,)]


def test_updates_rewrite_only_files_with_changed_rows(engine):
    engine.run_script("CREATE TABLE t (a INT UNIQUE, b INT); INSERT INTO t VALUES (1, 1), (2, 2); INSERT INTO t VALUES (3, 3)")
    first, second = engine.store.manifest("t")["data"]
    engine.sql("UPDATE t SET b = 9 WHERE a = 3")
    kept = engine.store.manifest("t")["data"]
    assert first in kept and second not in kept and len(kept) == 2
    with pytest.raises(StoreError):
        engine.sql("UPDATE t SET a = 1 WHERE a = 3")
    assert engine.sql("DELETE FROM t WHERE a = 1").rows == 1
    assert values(engine.sql("SELECT * FROM t")) == [(2, 2), (3, 9)]
    assert engine.sql("DELETE FROM t").rows == 2 and values(engine.sql("SELECT * FROM t")) == []
    engine.sql("INSERT INTO t VALUES (1, 5)")
    engine.sql("VACUUM t")
    assert values(engine.sql("SELECT * FROM t")) == [(1, 5)]


def test_shell(spark, tmp_path, capsys):
    from millrace.__main__ import main

    (tmp_path / "s.sql").write_text("CREATE DATABASE d; CREATE TABLE t (a INT); INSERT INTO t VALUES (1);")
    main(f"file://{tmp_path}/store", [f"\\i file://{tmp_path}/s.sql\n", "\\timing\n", "SELECT a\n", "FROM t;\n", "\\dt\n", "SELECT nope FROM t;\n", "\\nope\n", "\\stats\n", "\\q\n"])
    said = capsys.readouterr().out
    assert "database d created" in said and "1 rows inserted" in said and " ms" in said and said.count("error:") == 2
