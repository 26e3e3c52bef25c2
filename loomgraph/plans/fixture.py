"""The code graph that the driver's tables project to, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text

#: The columns of a symbol, as every symbol query gives them with the path beside.
SYMBOL = ["id", "repo_id", "file_id", "language", "kind", "name", "qualified_name", "container_name", "signature", "visibility", "start_line", "start_col", "end_line", "end_col", "doc_summary", "stable_key"]


@dataclass
class Graph:
    """files(id, path, language, size_bytes), symbols(SYMBOL), edges(src, dst, file_id, line) and the tables beside them."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    calls: DataFrame
    tests: DataFrame
    test_files: DataFrame
    test_links: DataFrame
    test_calls: DataFrame
    imports: DataFrame


def _rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, rank from 0) of the distinct values: few by nature, so one small window and a broadcast."""
    return F.broadcast(df.select(column).distinct().withColumn(name, F.dense_rank().over(Window.orderBy(column)).cast("long") - 1))


def load(spark: SparkSession, folder: str) -> Graph:
    """The projection. Every thirteenth file is deleted; its rows are still there."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    part, supplier, customer, nation = read("part"), read("supplier"), read("customer"), read("nation")
    p = part.select(
        "p_partkey", "p_brand", "p_type", F.translate("p_name", " ", "_").alias("name"), F.lower(F.translate("p_brand", "#", "")).alias("brand"), F.lower("p_type").alias("type")
    )
    p = p.join(_rank(part, "p_brand", "br"), "p_brand").join(_rank(part, "p_type", "tr"), "p_type")
    p = p.withColumn("language", F.when(F.col("br") % 2 == 0, "python").otherwise("go")).withColumn("file_id", 1000 + 10 * F.col("br") + F.col("tr"))
    n = nation.select(F.col("n_nationkey").cast("long").alias("nk"), F.lower("n_name").alias("nation"))
    extension = F.when(F.col("language") == "python", ".py").otherwise(".go")
    part_files = p.select(F.col("file_id").alias("id"), F.concat(F.lit("lib/"), "brand", F.lit("/"), "type", extension).alias("path"), "language").distinct()
    nation_files = n.select(F.explode(F.array(*[F.struct((F.lit(base) + F.col("nk")).alias("id"), F.concat(F.lit(top), "nation", F.lit(leaf)).alias("path")) for base, top, leaf in ((2000, "svc/", "/suppliers.py"), (3000, "app/", "/customers.py"))])).alias("f")).select("f.id", "f.path", F.lit("python").alias("language"))
    files = part_files.unionByName(nation_files).withColumn("size_bytes", 100 + F.col("id") * 7 % 5000).withColumn("is_deleted", F.col("id") % 13 == 0)

    def symbols(df, key, base, file_id, language, kind, name, qualified, doc):
        return df.select(
            (F.lit(base) + F.col(key)).alias("id"), F.lit(1).cast("long").alias("repo_id"), file_id.cast("long").alias("file_id"), language.alias("language"), F.lit(kind).alias("kind"), name.alias("name"), F.concat(qualified, name).alias("qualified_name"),
            F.lit("").alias("container_name"), F.concat(F.lit(f"{kind} "), name, F.lit("()")).alias("signature"), text.visibility(language, name).alias("visibility"),
            (F.col(key) % 1000 * 10 + 1).alias("start_line"), F.lit(1).cast("long").alias("start_col"), (F.col(key) % 1000 * 10 + 1 + F.col(key) % 7 * 5).alias("end_line"), (F.col(key) % 80 + 1).alias("end_col"), doc.alias("doc_summary"),
            F.when(F.col(key) % 11 == 0, "").otherwise(F.concat(F.lit(f"{kind}:"), qualified, name, F.lit("|"), (F.col(key) % 3).cast("string"))).alias("stable_key"),
        )

    ps = symbols(p, "p_partkey", 1_000_000, F.col("file_id"), F.col("language"), "function", F.col("name"), F.concat(F.lit("lib."), F.col("brand"), F.lit(".")), F.concat_ws(" ", "type", "brand"))
    ss = symbols(supplier, "s_suppkey", 2_000_000, F.lit(2000) + F.col("s_nationkey"), F.lit("python"), "class", F.translate("s_name", "#", "_"), F.lit("suppliers."), F.lit("supplier"))
    cs = symbols(customer, "c_custkey", 3_000_000, F.lit(3000) + F.col("c_nationkey"), F.lit("python"), "function", F.translate("c_name", "#", "_"), F.lit("customers."), F.lower("c_mktsegment"))
    all_symbols = ps.unionByName(ss).unionByName(cs)

    lines = read("lineitem").join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("nk")), "o_custkey")
    uses = lines.select((3_000_000 + F.col("o_custkey")).alias("src"), (1_000_000 + F.col("l_partkey")).alias("dst"), (3000 + F.col("nk")).alias("file_id"), F.col("l_linenumber").cast("long").alias("line"), "l_partkey")
    made = read("lineitem").select("l_partkey", "l_suppkey").distinct().join(p.select(F.col("p_partkey").alias("l_partkey"), "file_id"), "l_partkey").select((1_000_000 + F.col("l_partkey")).alias("src"), (2_000_000 + F.col("l_suppkey")).alias("dst"), "file_id", F.lit(0).cast("long").alias("line"))
    # a customer has an edge from every tenth supplier of the nation, and a small file would be one task
    buyers = customer.select("c_custkey", "c_nationkey").repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")
    sold = supplier.join(buyers, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("c_custkey") % 10 == F.col("s_suppkey") % 10)).select((2_000_000 + F.col("s_suppkey")).alias("src"), (3_000_000 + F.col("c_custkey")).alias("dst"), (2000 + F.col("s_nationkey")).cast("long").alias("file_id"), F.lit(0).cast("long").alias("line"))
    edges = uses.drop("l_partkey").unionByName(made).unionByName(sold)
    form = F.col("line") % 4
    calls = uses.join(p.select(F.col("p_partkey").alias("l_partkey"), "name", "brand"), "l_partkey").select(
        "src", "file_id", "line", F.lit("python").alias("language"),
        F.when(form == 0, F.concat(F.lit("lib."), "brand", F.lit("."), "name")).when(form == 1, F.col("name")).when(form == 2, F.concat_ws(".", "brand", "name")).otherwise(F.concat(F.lit("no_such_"), (F.col("l_partkey") % 7).cast("string"))).alias("dst_name"),
    )

    test_files = p.select((4000 + F.col("file_id")).alias("id"), F.concat(F.lit("tests/"), "brand", F.lit("/test_"), "type", F.lit(".py")).alias("path"), F.lit("python").alias("language")).distinct()
    tests = p.select((5_000_000 + F.col("p_partkey")).alias("id"), (4000 + F.col("file_id")).alias("file_id"), F.concat(F.lit("test_"), "name").alias("name"), F.concat(F.lit("tests."), "brand", F.lit(".test_"), "name").alias("qualified_name"))
    test_links = p.select((4000 + F.col("file_id")).alias("test_file_id"), (5_000_000 + F.col("p_partkey")).alias("test_symbol_id"), F.concat(F.lit("lib."), "brand", F.lit("."), "name").alias("target_key"), F.lit("test_name_match").alias("reason"), F.lit(0.7).alias("score"))
    test_calls = p.select((5_000_000 + F.col("p_partkey")).alias("src"), (1_000_000 + F.col("p_partkey")).alias("dst"))
    first = F.when(F.col("language") == "go", "github.com/gin-gonic/gin").otherwise("django.http")
    second = F.element_at(F.array(*[F.lit(x) for x in ("fmt", "net/http", "os", "react-dom")]), (F.col("id") % 4 + 1).cast("int"))
    imports = files.select(F.col("id").alias("file_id"), F.explode(F.array(F.when(F.col("id") % 3 == 0, first), second)).alias("import_path")).where("import_path is not null")
    return Graph(files, all_symbols, edges, calls, tests, test_files, test_links, test_calls, imports)


#: The same projection as common table expressions.
SQL = """
p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name, lower(replace(p_brand, '#', '')) AS brand, lower(p_type) AS type,
             dense_rank() OVER (ORDER BY p_brand) - 1 AS br, dense_rank() OVER (ORDER BY p_type) - 1 AS tr,
             1000 + 10 * (dense_rank() OVER (ORDER BY p_brand) - 1) + dense_rank() OVER (ORDER BY p_type) - 1 AS file_id FROM part),
pl AS (SELECT *, CASE WHEN br % 2 = 0 THEN 'python' ELSE 'go' END AS language FROM p),
files0 AS (SELECT DISTINCT file_id AS id, 'lib/' || brand || '/' || type || CASE WHEN br % 2 = 0 THEN '.py' ELSE '.go' END AS path, language FROM pl
  UNION ALL SELECT 2000 + CAST(n_nationkey AS BIGINT), 'svc/' || lower(n_name) || '/suppliers.py', 'python' FROM nation
  UNION ALL SELECT 3000 + CAST(n_nationkey AS BIGINT), 'app/' || lower(n_name) || '/customers.py', 'python' FROM nation),
files AS (SELECT *, 100 + id * 7 % 5000 AS size_bytes, id % 13 = 0 AS is_deleted FROM files0),
symbols0 AS (SELECT 1000000 + p_partkey AS id, file_id, language, 'function' AS kind, name, 'lib.' || brand || '.' || name AS qualified_name, p_partkey AS k, type || ' ' || brand AS doc_summary FROM pl
  UNION ALL SELECT 2000000 + s_suppkey, 2000 + CAST(s_nationkey AS BIGINT), 'python', 'class', replace(s_name, '#', '_'), 'suppliers.' || replace(s_name, '#', '_'), s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 3000000 + c_custkey, 3000 + CAST(c_nationkey AS BIGINT), 'python', 'function', replace(c_name, '#', '_'), 'customers.' || replace(c_name, '#', '_'), c_custkey, lower(c_mktsegment) FROM customer),
symbols AS (SELECT id, CAST(1 AS BIGINT) AS repo_id, file_id, language, kind, name, qualified_name, '' AS container_name, kind || ' ' || name || '()' AS signature,
  CASE WHEN language = 'go' THEN CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'exported' ELSE 'package' END WHEN starts_with(name, '_') THEN 'module' ELSE 'public' END AS visibility,
  k % 1000 * 10 + 1 AS start_line, CAST(1 AS BIGINT) AS start_col, k % 1000 * 10 + 1 + k % 7 * 5 AS end_line, k % 80 + 1 AS end_col, doc_summary, CASE WHEN k % 11 = 0 THEN '' ELSE kind || ':' || qualified_name || '|' || (k % 3) END AS stable_key FROM symbols0),
uses AS (SELECT 3000000 + o_custkey AS src, 1000000 + l_partkey AS dst, 3000 + CAST(c_nationkey AS BIGINT) AS file_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
edges AS (SELECT src, dst, file_id, line FROM uses
  UNION ALL SELECT 1000000 + l_partkey, 2000000 + l_suppkey, file_id, 0 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN p ON l_partkey = p_partkey
  UNION ALL SELECT 2000000 + s_suppkey, 3000000 + c_custkey, 2000 + CAST(s_nationkey AS BIGINT), 0 FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_custkey % 10 = s_suppkey % 10),
calls AS (SELECT src, uses.file_id, line, 'python' AS language, CASE line % 4 WHEN 0 THEN 'lib.' || brand || '.' || name WHEN 1 THEN name WHEN 2 THEN brand || '.' || name ELSE 'no_such_' || (l_partkey % 7) END AS dst_name FROM uses JOIN p ON l_partkey = p_partkey),
test_files AS (SELECT DISTINCT 4000 + file_id AS id, 'tests/' || brand || '/test_' || type || '.py' AS path FROM p),
tests AS (SELECT 5000000 + p_partkey AS id, 4000 + file_id AS file_id, 'test_' || name AS name, 'tests.' || brand || '.test_' || name AS qualified_name FROM p),
test_links AS (SELECT 4000 + file_id AS test_file_id, 5000000 + p_partkey AS test_symbol_id, 'lib.' || brand || '.' || name AS target_key, 'test_name_match' AS reason, 0.7::DOUBLE AS score FROM p),
test_calls AS (SELECT 5000000 + p_partkey AS src, 1000000 + p_partkey AS dst FROM p),
imports AS (SELECT id AS file_id, CASE WHEN language = 'go' THEN 'github.com/gin-gonic/gin' ELSE 'django.http' END AS import_path FROM files WHERE id % 3 = 0
  UNION ALL SELECT id, CASE id % 4 WHEN 0 THEN 'fmt' WHEN 1 THEN 'net/http' WHEN 2 THEN 'os' ELSE 'react-dom' END FROM files)
"""
