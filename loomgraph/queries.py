"""The catalogue over the driver's tables: every query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import tools
from loomgraph.functions import text
from loomgraph.operators import accuracy, context, detail, graph, identity, inventory, quality, resolve, scans, search, store
from loomgraph.plans import fixture
from loomgraph.sources import sinks, walk
from loomgraph.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Arguments of the point queries.
PART, SUPPLIER, SEED = "lib.brand1.red_widget", "suppliers.Supplier_000000001", 2_000_001


def _query(sql: str | None = None, raw: bool = False):
    """Register a query of (graph, spark, folder) under its name; sql sees the projection's tables unless raw."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, folder: f(None if raw else fixture.load(spark, folder), spark, folder)
        if sql:
            ORACLES[f.__name__] = sql if raw else f"WITH RECURSIVE {fixture.SQL}{',' if sql.lstrip().startswith(',') is False and sql.lstrip()[:6].upper() != 'SELECT' else ''} {sql}"
        return f

    return keep


# counts, degrees, listings


@_query("""SELECT 'files' AS metric, count(*) AS value FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'language:' || language, count(*) FROM files GROUP BY language""")
def graph_stats(g, spark, folder):
    return inventory.stats(g.files, g.symbols, g.edges)


@_query("SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def symbol_kinds(g, spark, folder):
    return inventory.count_by(g.symbols, F.col("kind"), "kind")


@_query("SELECT split_part(path, '/', 1) AS folder, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, folder LIMIT 20")
def top_folders(g, spark, folder):
    return inventory.top_folders(g.files)


_DEGREE = """d AS (SELECT {0} AS id, count(*) AS degree FROM edges WHERE {0} IS NOT NULL GROUP BY 1),
t AS (SELECT d.id, degree FROM d JOIN symbols USING (id) ORDER BY degree DESC, id LIMIT 15),
z AS (SELECT id, qualified_name, 0 AS degree FROM symbols WHERE id NOT IN (SELECT id FROM d) ORDER BY qualified_name, start_line, id LIMIT 15)
SELECT id, qualified_name, degree FROM (SELECT t.id, qualified_name, degree FROM t JOIN symbols USING (id) UNION ALL SELECT * FROM z) ORDER BY degree DESC, qualified_name, id LIMIT 15"""


@_query(_DEGREE.format("dst"))
def top_in_degree(g, spark, folder):
    return inventory.top_degree(g.edges, g.symbols, "dst")


@_query(_DEGREE.format("src"))
def top_out_degree(g, spark, folder):
    return inventory.top_degree(g.edges, g.symbols, "src")


@_query("SELECT id, path, language, size_bytes FROM files WHERE path ILIKE 'lib/brand1%' AND NOT is_deleted ORDER BY path, id LIMIT 20 OFFSET 5")
def list_files(g, spark, folder):
    return inventory.list_files(g.files, "lib/brand1", 20, 5)


@_query("""SELECT s.id, path, qualified_name, start_line FROM symbols s JOIN files f ON f.id = file_id
WHERE kind IN ('function', 'method', 'type', 'class', 'struct', 'interface') AND name NOT IN ('main', 'init', 'Main', 'Init') AND name NOT ILIKE 'test%' AND name NOT ILIKE 'benchmark%' AND name NOT ILIKE 'example%'
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id)""")
def dead_code(g, spark, folder):
    return inventory.dead_code(g.symbols, g.edges, g.files)


@_query(f"SELECT id, qualified_name FROM symbols WHERE name = '{PART}' OR qualified_name = '{PART}'")
def find_symbol_exact(g, spark, folder):
    return inventory.find_exact(g.symbols, PART).select("id", "qualified_name")


@_query("""l AS (SELECT id, qualified_name, CASE WHEN qualified_name = 'Brand1.red_Widget' THEN 1 WHEN name = 'Brand1.red_Widget' THEN 2
 WHEN lower(qualified_name) LIKE '%::red_widget' OR lower(qualified_name) LIKE '%.red_widget' THEN 3 WHEN name = 'red_Widget' THEN 4 END AS stage FROM symbols)
SELECT id, qualified_name, stage FROM l WHERE stage = (SELECT min(stage) FROM l)""")
def lookup_cascade(g, spark, folder):
    return inventory.lookup(g.symbols, "Brand1.red_Widget").select("id", "qualified_name", "stage")


@_query("SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(ceil(sum(size_bytes) / 4) AS BIGINT) AS tokens, CAST(floor(avg(size_bytes)) * least(10, count(*)) AS BIGINT) AS sample_bytes FROM files")
def benchmark_tokens(g, spark, folder):
    return inventory.repository_size(g.files)


@_query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY event_type", raw=True)
def latency_percentiles(g, spark, folder):
    return inventory.latencies(spark.read.parquet(f"{folder}/events.parquet"), "event_type", "value")


@_query("SELECT name, count(*) AS n FROM symbols GROUP BY name HAVING count(*) > 1")
def name_multiplicity(g, spark, folder):
    return inventory.count_by(g.symbols, F.col("name"), "name").where("n > 1")


@_query("""SELECT * FROM (VALUES ('cpp', '.c .cc .cpp .cxx .h .hh .hpp'), ('csharp', '.cs'), ('go', '.go'), ('java', '.java'), ('kotlin', '.kt .kts'), ('php', '.php'), ('python', '.py .pyi'), ('ruby', '.rb'), ('rust', '.rs'),
('swift', '.swift'), ('typescript', '.cjs .cts .js .jsx .mjs .mts .ts .tsx')) t(language, extensions)""", raw=True)
def supported_languages(g, spark, folder):
    return inventory.supported_languages(spark)


@_query("""f AS (SELECT language, count(*) AS seen, count(*) FILTER (id % 3 = 0) AS indexed FROM files GROUP BY language)
SELECT language, seen, indexed, seen - indexed AS skipped FROM f""")
def language_coverage(g, spark, folder):
    return inventory.language_coverage(g.files, F.col("id") % 3 == 0)


# graph

_NAMED = "SELECT DISTINCT s.id, s.qualified_name FROM symbols s JOIN edges e ON e.{0} = s.id JOIN symbols t ON e.{1} = t.id WHERE t.qualified_name = '{2}'"


@_query(_NAMED.format("src", "dst", SUPPLIER))
def find_callers(g, spark, folder):
    return graph.callers(g.edges, inventory.find_exact(g.symbols, SUPPLIER), g.symbols).select("id", "qualified_name")


@_query(_NAMED.format("dst", "src", SUPPLIER))
def find_callees(g, spark, folder):
    return graph.callees(g.edges, inventory.find_exact(g.symbols, SUPPLIER), g.symbols).select("id", "qualified_name")


@_query("""t AS (SELECT DISTINCT language, qualified_name FROM symbols WHERE name = 'red_widget'),
n AS (SELECT language, 'red_widget' AS dst_name FROM t UNION SELECT language, qualified_name FROM t UNION SELECT language, split_part(qualified_name, '.', 2) || '.' || split_part(qualified_name, '.', 3) FROM t UNION SELECT language, split_part(qualified_name, '.', 3) FROM t)
SELECT DISTINCT s.id, s.qualified_name FROM calls c JOIN n USING (language, dst_name) JOIN symbols s ON s.id = c.src""")
def unresolved_callers(g, spark, folder):
    return graph.unresolved_callers(g.calls, g.symbols, g.symbols.where("name = 'red_widget'"), "red_widget").select("id", "qualified_name")


_BOTH = "u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


@_query(f"""{_BOTH}, l1 AS (SELECT DISTINCT b AS id FROM u WHERE a = {SEED}), l2 AS (SELECT DISTINCT b AS id FROM u JOIN l1 ON a = l1.id WHERE b NOT IN (SELECT id FROM l1))
SELECT id, qualified_name, depth FROM (SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2) JOIN symbols USING (id)""")
def impact_radius(g, spark, folder):
    return graph.impact(g.edges, g.symbols, g.symbols.where(F.col("id") == SEED), 2).select("id", "qualified_name", "depth")


def _trace_sql(a: str, b: str) -> str:
    return f"""l1 AS (SELECT DISTINCT {b} AS id FROM edges WHERE {a} = {SEED}), l2 AS (SELECT DISTINCT {b} AS id FROM edges JOIN l1 ON {a} = l1.id WHERE {b} NOT IN (SELECT id FROM l1)),
l3 AS (SELECT DISTINCT {b} AS id FROM edges JOIN l2 ON {a} = l2.id WHERE {b} NOT IN (SELECT id FROM l1 UNION ALL SELECT id FROM l2))
SELECT id, depth FROM (SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) WHERE id <> {SEED}"""


@_query(_trace_sql("src", "dst"))
def trace_downstream(g, spark, folder):
    return graph.trace(g.edges, g.symbols.where(F.col("id") == SEED), "downstream", 3).select("id", "depth")


@_query(_trace_sql("dst", "src"))
def trace_upstream(g, spark, folder):
    return graph.trace(g.edges, g.symbols.where(F.col("id") == SEED), "upstream", 3).select("id", "depth")


_RANKS = ",\n".join(f"r{k} AS (SELECT nodes.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g.x, 0) AS rank FROM nodes LEFT JOIN (SELECT dst, sum(rank * w) AS x FROM wt JOIN r{k - 1} ON src = r{k - 1}.id GROUP BY dst) g ON g.dst = nodes.id)" for k in range(1, 21))


@_query(f"""pr AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM edges GROUP BY ALL), wt AS MATERIALIZED (SELECT src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS w FROM pr),
nodes AS MATERIALIZED (SELECT src AS id FROM pr UNION SELECT dst FROM pr), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes), {_RANKS.replace(" AS (SELECT nodes", " AS MATERIALIZED (SELECT nodes")}
SELECT id, round(rank, 6) AS rank FROM r20""")
def pagerank(g, spark, folder):
    return graph.pagerank(g.edges)


_PAIRS = "fp AS (SELECT s.file_id AS a, t.file_id AS b, count(*) AS n FROM edges JOIN symbols s ON src = s.id JOIN symbols t ON dst = t.id WHERE s.file_id <> t.file_id GROUP BY ALL)"


@_query(f"""{_PAIRS} SELECT x.path AS file_a, y.path AS file_b, n, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS label
FROM fp JOIN files x ON a = x.id JOIN files y ON b = y.id ORDER BY n DESC, file_a, file_b LIMIT 20""")
def coupling(g, spark, folder):
    return graph.coupling(g.edges, g.symbols, g.files)


@_query(f"{_PAIRS}, reach AS (SELECT a, b FROM fp UNION SELECT reach.a, fp.b FROM reach JOIN fp ON reach.b = fp.a) SELECT path FROM files WHERE id IN (SELECT a FROM reach WHERE a = b)")
def files_on_cycles(g, spark, folder):
    on = graph.files_on_cycles(graph.file_pairs(g.edges, g.symbols))
    return g.files.join(on, "id", "left_semi").select("path")


@_query(f"""{_BOTH}, n AS (SELECT DISTINCT b AS id FROM u WHERE a = {SEED})
SELECT src, dst, count(*) AS n FROM edges WHERE src IN (SELECT id FROM n) OR dst IN (SELECT id FROM n) GROUP BY ALL""")
def graph_snapshot(g, spark, folder):
    nodes = graph.closure(g.edges, g.symbols.where(F.col("id") == SEED), 1)
    return graph.snapshot(g.edges, nodes)


@_query("""h AS (SELECT s.id, c.id AS container, c.end_line - c.start_line AS span FROM symbols s JOIN symbols c USING (file_id) WHERE s.id <> c.id AND c.start_line <= s.start_line AND s.end_line <= c.end_line AND (c.start_line < s.start_line OR s.end_line < c.end_line))
SELECT id, arg_min(container, (span, container)) AS container FROM h GROUP BY id""")
def symbol_members(g, spark, folder):
    return graph.members(g.symbols, g.symbols)


@_query("""pt AS (SELECT DISTINCT file_id, line * 10 + 3 AS line FROM calls), hh AS (SELECT pt.file_id, line, s.id, s.start_line, s.end_line FROM pt JOIN symbols s ON s.file_id = pt.file_id AND s.start_line <= line AND line <= s.end_line),
tp AS (SELECT *, rank() OVER (PARTITION BY file_id, line ORDER BY start_line DESC, end_line) AS r FROM hh), ow AS (SELECT file_id, line, CASE WHEN count(*) = 1 THEN min(id) END AS owner FROM tp WHERE r = 1 GROUP BY ALL)
SELECT pt.file_id, pt.line, owner FROM pt LEFT JOIN ow USING (file_id, line)""")
def edge_attribution(g, spark, folder):
    points = g.calls.select("file_id", (F.col("line") * 10 + 3).alias("line")).distinct()
    return graph.attribute(points, g.symbols).select("file_id", "line", "owner")


@_query("""nb AS (SELECT DISTINCT dst AS seed, 'caller' AS side, src AS id FROM edges UNION SELECT DISTINCT src, 'callee', dst FROM edges),
pl2 AS (SELECT seed, side, id, row_number() OVER (PARTITION BY seed, side ORDER BY qualified_name, start_line, id) AS place FROM nb JOIN symbols USING (id)) SELECT * FROM pl2 WHERE place <= 10""")
def seed_neighbours(g, spark, folder):
    return graph.seed_neighbours(g.edges, None, g.symbols, 10)


# search


@_query("""SELECT id, qualified_name FROM symbols WHERE regexp_matches(lower(name) || chr(1) || lower(qualified_name) || chr(1) || lower(signature) || chr(1) || lower(doc_summary), '(^|[^a-z0-9])red[^a-z0-9]+wid')
AND regexp_matches(lower(name) || chr(1) || lower(qualified_name) || chr(1) || lower(signature) || chr(1) || lower(doc_summary), '(^|[^a-z0-9])brand1')""")
def search_symbols(g, spark, folder):
    return search.search_symbols(g.symbols, 'red_wid "brand1"').select("id", "qualified_name")


_TOKENS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_./\\-]{{2,}}')"


@_query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) SELECT doc_id, CAST(count(*) AS DOUBLE) AS score FROM t WHERE token IN ('the', 'of', 'and') GROUP BY doc_id", raw=True)
def token_overlap(g, spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return search.token_overlap(search.token_weights(docs, "doc_id", "text"), "doc_id", ["the", "of", "and"])


@_query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) > 0", raw=True)
def vector_search(g, spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    return search.vector_search(e, e.where("vec_id = 0"), "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@_query("""tx AS (SELECT qualified_name, row_number() OVER (ORDER BY qualified_name, id) AS place FROM symbols WHERE regexp_matches(lower(name) || chr(1) || lower(qualified_name), '(^|[^a-z0-9])red') ORDER BY place LIMIT 60),
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), sc AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, qv),
vc AS (SELECT qualified_name, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM sc JOIN symbols ON id = 1000000 + vec_id WHERE score > 0 ORDER BY place LIMIT 60),
al AS (SELECT qualified_name, 1.0::DOUBLE / (60 + place) AS part, 'text' AS why FROM tx UNION ALL SELECT qualified_name, 1.0::DOUBLE / (60 + place), 'vector' FROM vc)
SELECT qualified_name, round(sum(part), 9) AS score, string_agg(DISTINCT why, ',' ORDER BY why) AS why FROM al GROUP BY qualified_name""")
def hybrid_search(g, spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    words = search.ranked(search.search_symbols(g.symbols, "red"), ["qualified_name", "id"], 60)
    near = search.vector_search(e, e.where("vec_id = 0"), "vec_id", "embedding").select((1_000_000 + F.col("vec_id")).alias("id"), F.round("score", 6).alias("score")).where("score > 0")
    near = search.ranked(near.join(g.symbols, "id"), [F.desc("score"), "id"], 60)
    return search.fuse({"text": words, "vector": near}, "qualified_name")


@_query("""SELECT path, qualified_name, arg_min(s.id, (stable_key = '', stable_key, start_line, s.id)) AS id FROM symbols s JOIN files f ON file_id = f.id GROUP BY ALL""")
def symbols_for_refs(g, spark, folder):
    refs = g.symbols.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "qualified_name").distinct()
    return search.symbols_for_refs(refs, g.symbols, g.files)


# resolving calls

_TEST = "regexp_matches(path, '(?i)(^|/)(test|tests|testdata|__tests__)/')"
_RESOLVE = f"""sy AS (SELECT s.*, {_TEST} AS in_test FROM symbols s JOIN files f ON f.id = file_id),
ks AS (SELECT 1 AS lv, qualified_name AS key, language, id, in_test FROM sy UNION ALL SELECT 2, name, language, id, in_test FROM sy
 UNION ALL SELECT 3, split_part(qualified_name, '.', 2) || '.' || split_part(qualified_name, '.', 3), language, id, in_test FROM sy WHERE length(qualified_name) - length(replace(qualified_name, '.', '')) = 2
 UNION ALL SELECT 3, qualified_name, language, id, in_test FROM sy WHERE length(qualified_name) - length(replace(qualified_name, '.', '')) = 1),
gr AS (SELECT lv, key, language, count(*) AS n, count(*) FILTER (NOT in_test) AS np, CASE WHEN count(*) FILTER (NOT in_test) = 1 THEN min(id) FILTER (NOT in_test) END AS id FROM ks GROUP BY ALL),
vt AS (SELECT DISTINCT key, language FROM gr WHERE lv IN (1, 2) AND np <> 1),
nm AS (SELECT DISTINCT dst_name, language FROM calls),
bd AS (SELECT nm.*, vt.key IS NOT NULL AS veto, g1.id AS i1, CASE WHEN vt.key IS NULL THEN g2.id END AS i2, CASE WHEN vt.key IS NULL AND length(dst_name) - length(replace(dst_name, '.', '')) = 1 THEN g3.id END AS i3,
  dst_name IN (SELECT name FROM symbols UNION ALL SELECT qualified_name FROM symbols) AS known
 FROM nm LEFT JOIN vt ON vt.key = dst_name AND vt.language = nm.language LEFT JOIN gr g1 ON g1.lv = 1 AND g1.key = dst_name AND g1.language = nm.language
 LEFT JOIN gr g2 ON g2.lv = 2 AND g2.key = dst_name AND g2.language = nm.language LEFT JOIN gr g3 ON g3.lv = 3 AND g3.key = dst_name AND g3.language = nm.language),
rs AS (SELECT src, file_id, line, dst_name, c.language, coalesce(i1, i2, i3) AS dst, CASE WHEN i1 IS NOT NULL THEN 'exact_qualified' WHEN i2 IS NOT NULL THEN 'exact_name' WHEN i3 IS NOT NULL THEN 'dot_tail2' END AS strategy,
  CASE WHEN i1 IS NOT NULL OR i2 IS NOT NULL THEN 'high' WHEN i3 IS NOT NULL THEN 'medium' END AS confidence, CASE WHEN coalesce(i1, i2, i3) IS NULL THEN CASE WHEN veto THEN 'ambiguity' WHEN known THEN 'language' END END AS blocked
 FROM calls c JOIN bd USING (dst_name, language))"""


@_query(f"{_RESOLVE} SELECT src, line, dst_name, dst, strategy, confidence, blocked, count(*) AS n FROM rs GROUP BY ALL")
def resolve_edges(g, spark, folder):
    out = resolve.resolve(g.calls, g.symbols, g.files)
    return out.groupBy("src", "line", "dst_name", "dst", "strategy", "confidence", "blocked").agg(F.count("*").alias("n"))


@_query(f"{_RESOLVE} SELECT coalesce(strategy, 'blocked_by_' || blocked, 'unresolved') AS outcome, count(*) AS n FROM rs GROUP BY 1")
def resolve_outcomes(g, spark, folder):
    return resolve.outcomes(resolve.resolve(g.calls, g.symbols, g.files))


@_query(f"{_RESOLVE} SELECT coalesce(strategy, '<unregistered>') AS value, count(*) AS n FROM rs GROUP BY 1")
def strategy_distribution(g, spark, folder):
    return quality.distribution(resolve.resolve(g.calls, g.symbols, g.files), "strategy", list(resolve.CONFIDENCE))


# tests

_LINKS = """so AS (SELECT qualified_name AS target_key, min(id) AS sid, min(file_id) AS fid FROM symbols GROUP BY 1 HAVING count(*) = 1),
bl AS (SELECT l.test_file_id, l.test_symbol_id, l.target_key, sid AS target_symbol_id, fid AS target_file_id, reason, score FROM test_links l JOIN test_files t ON t.id = l.test_file_id LEFT JOIN so USING (target_key))"""


@_query(f"{_LINKS} SELECT * FROM bl")
def test_links(g, spark, folder):
    return resolve.bind_test_links(g.test_links, g.symbols, g.files, g.test_files)


@_query(f"""{_LINKS}, ev AS (SELECT test_symbol_id AS id, reason, score, 2 AS rank FROM bl WHERE target_symbol_id IS NOT NULL UNION ALL SELECT src, 'test_calls', 0.9::DOUBLE, 3 FROM test_calls)
SELECT path, qualified_name AS symbol, arg_max(reason, round(score * 1000) * 4 + rank) AS reason, arg_max(score, round(score * 1000) * 4 + rank) AS score FROM ev JOIN tests USING (id) JOIN test_files f ON f.id = file_id GROUP BY ALL""")
def related_tests(g, spark, folder):
    bound = resolve.bind_test_links(g.test_links, g.symbols, g.files, g.test_files)
    return resolve.related_tests(bound, g.test_calls, g.tests, g.test_files, g.symbols)


_SPEC = "im AS (SELECT id AS file_id, '../' || regexp_replace(split_part(path, '/', 2), '[0-9]+$', '') || (br + 1) || '/./' || split_part(split_part(path, '/', 3), '.', 1) AS import_path, language, br FROM (SELECT *, CAST(regexp_extract(path, '([0-9]+)/', 1) AS INTEGER) AS br FROM files WHERE path LIKE 'lib/%'))"
_BRIDGES = f"""{_SPEC}, bf AS (SELECT im.file_id AS src_file, f.id AS dst_file, im.language AS a, f.language AS b FROM im JOIN files f ON f.path LIKE 'lib/%' AND split_part(f.path, '.', 1) = 'lib/brand' || (br + 1) || '/' || split_part(im.import_path, '/', 4)),
br2 AS (SELECT src_file, dst_file FROM bf WHERE a <> b)"""


def _bridges(g) -> DataFrame:
    """Every part file imports the file of the same type of the next brand by a relative path."""
    f = g.files.where("path like 'lib/%'").withColumn("br", F.regexp_extract("path", "([0-9]+)/", 1).cast("int"))
    part = F.split("path", "/")
    spec = F.concat(F.lit("../"), F.regexp_replace(F.get(part, 1), "[0-9]+$", ""), (F.col("br") + 1).cast("string"), F.lit("/./"), F.substring_index(F.get(part, 2), ".", 1))
    return resolve.import_bridges(f.select(F.col("id").alias("file_id"), spec.alias("import_path")), g.files)


@_query(f"""{_BRIDGES},
sn AS (SELECT src_file, dst_file, a.id AS src, b.id AS dst FROM br2 JOIN symbols a ON a.file_id = src_file JOIN symbols b ON b.file_id = dst_file AND a.name = b.name),
one AS (SELECT src_file, dst_file, src, min(dst) AS dst, 'cross_language_shared_name' AS strategy FROM sn GROUP BY ALL HAVING count(*) = 1),
sl AS (SELECT file_id, min(id) AS id FROM symbols GROUP BY 1 HAVING count(*) = 1),
ln AS (SELECT src_file, dst_file, x.id AS src, y.id AS dst, 'cross_language_import_path' AS strategy FROM br2 JOIN sl x ON x.file_id = src_file JOIN sl y ON y.file_id = dst_file WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.src_file = br2.src_file AND sn.dst_file = br2.dst_file)),
ev AS (SELECT * FROM one UNION ALL SELECT * FROM ln) SELECT src, dst, strategy FROM ev WHERE src IN (SELECT src FROM ev GROUP BY src HAVING count(*) = 1)""")
def cross_language_links(g, spark, folder):
    return resolve.cross_language_links(_bridges(g), g.symbols)


# quality

_CLASSIFIED = "ci AS (SELECT src, file_id, language, CASE line % 3 WHEN 0 THEN 'len' WHEN 1 THEN 'os.path.join' ELSE dst_name END AS dst_name, CASE WHEN line = 6 THEN 'x.len()' ELSE '' END AS evidence FROM calls)"


@_query(f"""{_CLASSIFIED}, cl AS (SELECT CASE WHEN dst_name = 'len' THEN CASE WHEN evidence <> '' THEN 'unknown' ELSE 'builtin' END WHEN dst_name LIKE 'os.%' AND EXISTS (SELECT 1 FROM imports i WHERE i.file_id = ci.file_id AND import_path = 'os') THEN 'stdlib' ELSE 'unknown' END AS target FROM ci)
SELECT target, count(*) AS n FROM cl GROUP BY target""")
def target_classification(g, spark, folder):
    name = F.when(F.col("line") % 3 == 0, "len").when(F.col("line") % 3 == 1, "os.path.join").otherwise(F.col("dst_name"))
    calls = g.calls.select("src", "file_id", "language", name.alias("dst_name"), F.lit(None).cast("long").alias("dst"), F.when(F.col("line") == 6, "x.len()").otherwise("").alias("evidence"))
    return inventory.count_by(quality.classify(calls, g.symbols, g.imports), F.col("target"), "target")


_FRAMEWORK_VALUES = ", ".join(f"('{n}', '{s}')" for n, s in quality.FRAMEWORKS)


@_query(f"""sp(framework, signature) AS (VALUES {_FRAMEWORK_VALUES}) SELECT framework, count(DISTINCT file_id) AS evidence,
round(least(1.0, greatest(0.1, count(DISTINCT file_id)::DOUBLE / (SELECT count(DISTINCT file_id) FROM imports))), 6) AS confidence FROM imports JOIN sp ON contains(import_path, signature) GROUP BY framework""")
def detect_frameworks(g, spark, folder):
    return quality.frameworks(g.files, g.imports)


_DAMAGED = f"""{_RESOLVE}, dm AS (SELECT row_number() OVER () * 0 + src * 10 + line AS id, CASE WHEN src % 50 = 1 THEN -1 ELSE src END AS src, CASE WHEN src % 50 = 2 AND dst IS NOT NULL THEN -2 ELSE dst END AS dst, CASE WHEN src % 50 = 3 THEN 'bogus' ELSE strategy END AS strategy,
 CASE WHEN src % 50 = 4 THEN 'low' ELSE confidence END AS confidence FROM (SELECT DISTINCT src, line, dst, strategy, confidence FROM rs))"""


@_query(f"""{_DAMAGED}, mp(strategy, good) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in resolve.CONFIDENCE.items())}),
x AS (SELECT dm.*, s.id IS NULL AS no_src, t.id IS NULL AS no_dst, s.language AS sl, t.language AS tl, coalesce(tf.is_deleted, false) AS td, good, coalesce(dm.strategy, '') AS st, coalesce(confidence, '') AS cf FROM dm LEFT JOIN symbols s ON s.id = dm.src LEFT JOIN symbols t ON t.id = dm.dst LEFT JOIN files tf ON tf.id = t.file_id LEFT JOIN mp ON mp.strategy = dm.strategy),
f AS (SELECT 'dangling_edge_target' AS code, 'error' AS severity FROM x WHERE dst IS NOT NULL AND no_dst UNION ALL SELECT 'dangling_edge_source', 'error' FROM x WHERE no_src
 UNION ALL SELECT 'invalid_resolution_metadata', 'error' FROM x WHERE (dst IS NULL AND (st <> '' OR cf <> '')) OR (st <> '' AND good IS NULL) OR ((st = '') <> (cf = '')) OR (st <> '' AND cf <> good)
 UNION ALL SELECT 'implicit_cross_language_binding', 'error' FROM x WHERE dst IS NOT NULL AND st <> '' AND sl <> tl
 UNION ALL SELECT 'resolved_target_deleted_file', 'error' FROM x WHERE dst IS NOT NULL AND td
 UNION ALL SELECT 'resolved_missing_metadata', 'warning' FROM x WHERE dst IS NOT NULL AND st = '' AND cf = '' UNION ALL SELECT 'low_confidence_resolution', 'warning' FROM x WHERE dst IS NOT NULL AND cf = 'low')
SELECT code, severity, count(*) AS n FROM f GROUP BY ALL""")
def audit(g, spark, folder):
    r = resolve.resolve(g.calls, g.symbols, g.files).select("src", "line", "dst", "strategy", "confidence").distinct()
    m = F.col("src") % 50
    damaged = r.select(
        (F.col("src") * 10 + F.col("line")).alias("id"), F.when(m == 1, -1).otherwise(F.col("src")).alias("src"), F.when((m == 2) & F.col("dst").isNotNull(), -2).otherwise(F.col("dst")).alias("dst"), F.lit("calls").alias("kind"),
        F.when(m == 3, "bogus").otherwise(F.col("strategy")).alias("strategy"), F.when(m == 4, "low").otherwise(F.col("confidence")).alias("confidence"),
    )
    return quality.audit(damaged, g.symbols, g.files).select("code", "severity", "n")


# context

_CANDIDATES = """cd AS (SELECT CASE s.id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'caller' WHEN 2 THEN 'callee' ELSE 'test' END AS class, path, qualified_name, s.id, (s.id % 97)::DOUBLE AS signal FROM symbols s JOIN files f ON f.id = file_id),
sc AS (SELECT *, CASE class WHEN 'direct' THEN 0 WHEN 'caller' THEN 1 WHEN 'callee' THEN 2 ELSE 3 END AS place, round(CASE class WHEN 'direct' THEN 0.6 WHEN 'caller' THEN 0.35 WHEN 'callee' THEN 0.3 ELSE 0.1 END::DOUBLE + CASE class WHEN 'direct' THEN 0.4 WHEN 'test' THEN 0.15 ELSE 0.3 END::DOUBLE * (signal / (SELECT max(signal) FROM cd)), 6) AS base FROM cd),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, qualified_name ORDER BY base DESC, place, id) AS r FROM sc) WHERE r = 1),
fi AS (SELECT *, round(base + 0.01 * least(5, count(*) OVER (PARTITION BY path)), 6) AS score FROM bs),
ld AS (SELECT path, row_number() OVER (ORDER BY score DESC, place, path, qualified_name) AS o FROM fi),
fr AS (SELECT path, CAST(row_number() OVER (ORDER BY min(o)) AS INTEGER) AS file_rank FROM ld GROUP BY path)"""


def _candidates(g) -> DataFrame:
    m = F.col("id") % 4
    named = g.symbols.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return named.select(F.when(m == 0, "direct").when(m == 1, "caller").when(m == 2, "callee").otherwise("test").alias("class"), "path", "qualified_name", "id", (F.col("id") % 97).cast("double").alias("signal"))


@_query(f"{_CANDIDATES} SELECT path, qualified_name, id, class, score, file_rank FROM fi JOIN fr USING (path) WHERE file_rank <= 10")
def context_for_task(g, spark, folder):
    return search.rank_context(_candidates(g), 10)


@_query("""co AS (SELECT id, qualified_name, length(signature) + length(qualified_name) AS cost FROM symbols), ru AS (SELECT *, sum(cost) OVER (ORDER BY qualified_name, id ROWS UNBOUNDED PRECEDING) AS spent FROM co)
SELECT id, CAST(spent AS BIGINT) AS spent FROM ru WHERE spent <= 4000""")
def token_budget(g, spark, folder):
    rows = g.symbols.select("id", "qualified_name", (F.length("signature") + F.length("qualified_name")).cast("long").alias("cost"))
    return search.within_budget(rows, ["qualified_name", "id"], "cost", 4000).select("id", "spent")


# scalar functions, paths and sources


@_query("""SELECT id, split_part(qualified_name, '.', -2) || '.' || split_part(qualified_name, '.', -1) AS tail2, CASE WHEN length(x) - length(replace(x, '.', '')) >= 3 THEN 'a.' || 'b.' || name ELSE '' END AS tail3, name AS short, CASE WHEN id % 2 = 0 THEN qualified_name ELSE '' END AS suffix,
CAST(ceil(strlen(signature) / 4) AS BIGINT) AS tokens, kind || ' ' || name || ' ' || signature || ' ' || doc_summary AS embed_text, left(signature, 10) || '...' AS card, substr(sha256(qualified_name || chr(31) || kind), 1, 16) AS print, CASE WHEN language = 'go' THEN 'package' ELSE 'public' END AS visibility
FROM (SELECT *, 'a.b.c.' || name AS x0, 'a.a.b.' || name AS x FROM symbols)""")
def text_functions(g, spark, folder):
    q = F.col("qualified_name")
    return g.symbols.select(
        "id", text.dot_tail2(q).alias("tail2"), text.dot_tail3(F.concat(F.lit("a.a.b."), "name")).alias("tail3"), text.short_name(q).alias("short"), text.qualified_suffix(F.when(F.col("id") % 2 == 0, F.concat(F.lit("x/"), q)).otherwise(q)).alias("suffix"),
        text.estimated_tokens(F.octet_length("signature")).alias("tokens"), text.symbol_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("doc_summary")).alias("embed_text"), text.truncate(F.col("signature"), 10).alias("card"), text.fingerprint(q, F.col("kind")).alias("print"), text.visibility(F.col("language"), F.col("name")).alias("visibility"),
    )


@_query(f"""al AS (SELECT path FROM files UNION ALL SELECT path FROM test_files)
SELECT path, {_TEST} OR regexp_matches(path, '(^|/)test_[^/]*[.]py$') AS is_test, regexp_extract(path, '^(.*/)?') AS dir, CASE WHEN regexp_matches(path, '(^|/)test_[^/]*[.]py$') AND NOT {_TEST} THEN regexp_replace(path, 'test_', '') END AS sibling, starts_with(path, 'svc') AND NOT starts_with(path, 'svc/nation_1') AS ignored FROM al""")
def path_predicates(g, spark, folder):
    every = g.files.select("path").unionByName(g.test_files.select("path"))
    p = F.col("path")
    return every.select("path", text.is_test_file(p).alias("is_test"), text.dir_prefix(p).alias("dir"), text.production_sibling(p).alias("sibling"), walk.ignored(p, ["svc/**", "!svc/nation_1/**"]).alias("ignored"))


_CHANGES = """o AS (SELECT path, size_bytes AS size, id AS stamp, sha256(path) AS sha FROM files WHERE id % 5 <> 0), w AS (SELECT path, size_bytes + (id % 4 = 1)::INT AS size, id + (id % 4 >= 1)::INT AS stamp, CASE WHEN id % 4 = 1 THEN 'new' ELSE sha256(path) END AS sha, id % 11 = 0 AS skip FROM files WHERE id % 7 <> 0),
ch AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'delete' WHEN skip THEN 'skip_only' WHEN w.size = o.size AND w.stamp = o.stamp THEN 'mark_seen' WHEN w.sha = o.sha THEN 'touch' ELSE 'replace' END AS action FROM o FULL JOIN w ON o.path = w.path)"""


def _changes(g) -> DataFrame:
    m, sha = F.col("id") % 4, F.sha2("path", 256)
    stored = g.files.where("id % 5 <> 0").select("path", F.col("size_bytes").alias("size"), F.col("id").alias("modified"), sha.alias("sha256"))
    found = g.files.where("id % 7 <> 0").select("path", (F.col("size_bytes") + (m == 1).cast("int")).alias("size"), (F.col("id") + (m >= 1).cast("int")).alias("modified"), F.when(m == 1, "new").otherwise(sha).alias("sha256"), (F.col("id") % 11 == 0).alias("skip"))
    return walk.classify_changes(stored, found)


@_query(f"{_CHANGES} SELECT path, action FROM ch")
def change_classification(g, spark, folder):
    return _changes(g)


@_query(f"""{_CHANGES}, st AS (SELECT s.id, path FROM symbols s JOIN files f ON f.id = file_id) SELECT id, path FROM st WHERE path NOT IN (SELECT path FROM ch WHERE action IN ('replace', 'delete')) UNION ALL SELECT -id, path FROM st WHERE path IN (SELECT path FROM ch WHERE action = 'replace')""")
def replace_file_graph(g, spark, folder):
    changes = _changes(g)
    stored = g.symbols.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path")
    parsed = stored.join(changes.where("action = 'replace'").select("path"), "path", "left_semi").select((-F.col("id")).alias("id"), "path")
    return walk.replace_files(stored, parsed, changes)


@_query("SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id % 3 = 0", raw=True)
def embedding_upsert(g, spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    return walk.upsert(e, e.where("id % 3 = 0").select("id", F.lit(-1).cast("long").alias("label")), "id")


@_query("SELECT page_id, sha256(html) AS sha FROM pages", raw=True)
def content_hash(g, spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", F.sha2("html", 256).alias("sha"))


@_query("""SELECT item_id || chr(9) || CASE WHEN starts_with(e, '@') THEN '\\' || e ELSE e END AS line FROM (SELECT item_id, replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') AS e FROM benchmark)""", raw=True)
def compact_table(g, spark, folder):
    return sinks.compact(spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text"))


@_query("""nd AS (SELECT DISTINCT 0 AS part, '  "' || qualified_name || '";' AS line FROM symbols), ed AS (SELECT 1, '  "' || a.qualified_name || '" -> "' || b.qualified_name || '";' FROM (SELECT DISTINCT src, dst FROM edges) JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst) SELECT * FROM nd UNION ALL SELECT * FROM ed""")
def export_dot(g, spark, folder):
    return sinks.dot(g.symbols, g.edges.select("src", "dst").distinct())


@_query("""SELECT '{"type":"symbol","id":' || id || ',"qualified_name":"' || qualified_name || '","kind":"' || kind || '"}' AS value FROM symbols UNION ALL SELECT '{"type":"edge","src":' || src || ',"dst":' || dst || '}' FROM (SELECT DISTINCT src, dst FROM edges)
UNION ALL VALUES ('{"type":"graph_meta"}'), ('{"type":"graph_done"}')""")
def export_json_lines(g, spark, folder):
    return sinks.json_lines(g.symbols, g.edges.select("src", "dst").distinct())


# sessions

_EVENTS = "WITH s AS (SELECT event_id AS id, user_id AS session_id, event_type, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS key, ts AS created_at FROM events)"


@_query(f"{_EVENTS} SELECT id, event_type, key FROM s WHERE event_type = 'view' ORDER BY created_at DESC, id DESC LIMIT 50", raw=True)
def session_history(g, spark, folder):
    return sessions.history(sessions.session_table(spark.read.parquet(f"{folder}/events.parquet")), None, "view", 50).select("id", "event_type", "key")


@_query(f"{_EVENTS} SELECT key, count(*) AS n FROM s WHERE event_type IN ('view', 'click') GROUP BY key ORDER BY n DESC, key LIMIT 20", raw=True)
def session_hot_files(g, spark, folder):
    return sessions.hot_keys(sessions.session_table(spark.read.parquet(f"{folder}/events.parquet")), ("view", "click")).select("key", "n")


@_query(f"{_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY created_at DESC, id DESC) AS n FROM s WHERE event_type IN ('signup', 'purchase', 'error')), h AS (SELECT key, count(*) AS n FROM s WHERE event_type IN ('view', 'click') GROUP BY key ORDER BY n DESC, key LIMIT 10) SELECT event_type, id, key FROM r WHERE n <= 10 UNION ALL SELECT 'hot_file', n, key FROM h", raw=True)
def session_context(g, spark, folder):
    return sessions.context(sessions.session_table(spark.read.parquet(f"{folder}/events.parquet")), None, ("signup", "purchase", "error"), used=("view", "click"))


@_query("SELECT event_type AS tool, user_id % 2 AS via, count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS bytes, CAST(ceil(sum(length(props)) / 4) AS BIGINT) AS tokens FROM events GROUP BY ALL", raw=True)
def usage_stats(g, spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_type").alias("tool"), (F.col("user_id") % 2).alias("via"), F.length("props").alias("size"))
    return inventory.usage(events, ["tool", "via"], "size")


@_query("SELECT * FROM (VALUES ('search_symbols', CAST(110 AS BIGINT)), ('find_symbol', CAST(70 AS BIGINT)), ('search_semantic', CAST(70 AS BIGINT)), ('graph_analytics', CAST(60 AS BIGINT)), ('graph_stats', CAST(50 AS BIGINT))) t(tool, score)", raw=True)
def tool_search(g, spark, folder):
    return spark.createDataFrame(tools.search("graph symbol search"), "tool string, score long")


# composites


@_query("""li AS (SELECT 'language' AS part, language AS key, count(*) AS n FROM files GROUP BY language UNION ALL SELECT 'kind', kind, count(*) FROM symbols GROUP BY kind),
fo AS (SELECT 'folder', split_part(path, '/', 1) AS folder, count(*) AS n FROM files GROUP BY ALL ORDER BY n DESC, folder LIMIT 20),
od AS (SELECT src AS id, count(*) AS degree FROM edges GROUP BY 1), oz AS (SELECT qualified_name, degree, id FROM (SELECT s.id, qualified_name, coalesce(degree, 0) AS degree FROM symbols s LEFT JOIN od USING (id)) ORDER BY degree DESC, CASE WHEN degree > 0 THEN id END, qualified_name, id LIMIT 15),
ig AS (SELECT dst AS id, count(*) AS degree FROM edges GROUP BY 1), iz AS (SELECT qualified_name, degree, id FROM (SELECT s.id, qualified_name, coalesce(degree, 0) AS degree FROM symbols s LEFT JOIN ig USING (id)) ORDER BY degree DESC, CASE WHEN degree > 0 THEN id END, qualified_name, id LIMIT 15)
SELECT * FROM li UNION ALL SELECT * FROM fo UNION ALL SELECT 'out_degree', qualified_name, degree FROM oz UNION ALL SELECT 'in_degree', qualified_name, degree FROM iz""")
def architecture_overview(g, spark, folder):
    return inventory.overview(g.files, g.symbols, g.edges)


@_query("SELECT s.id, qualified_name, count(*) AS degree FROM edges JOIN symbols s ON dst = s.id GROUP BY ALL ORDER BY degree DESC, qualified_name, s.id LIMIT 1")
def hub_symbol(g, spark, folder):
    return inventory.extreme_degree(g.edges, g.symbols, "dst")


@_query("SELECT test_file_id, count(*) AS n FROM test_links GROUP BY 1 ORDER BY n DESC, test_file_id LIMIT 1")
def most_linked_test_file(g, spark, folder):
    return inventory.most_linked_test_file(g.test_links)


@_query(f"{_BRIDGES} SELECT src_file, dst_file FROM br2")
def import_bridges(g, spark, folder):
    return _bridges(g)


_BOTH_KINDS = "ec AS (SELECT src, dst, CAST(NULL AS VARCHAR) AS dst_name FROM edges UNION ALL SELECT src, NULL, dst_name FROM calls)"


def _bound_and_unbound(g) -> DataFrame:
    return g.edges.select("src", "dst", F.lit(None).cast("string").alias("dst_name")).unionByName(g.calls.select("src", F.lit(None).cast("long").alias("dst"), "dst_name"))


@_query(f"""{_BOTH_KINDS} SELECT 'files' AS metric, count(*) AS n FROM files UNION ALL SELECT 'deleted', count(*) FROM files WHERE is_deleted UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'edges', count(*) FROM ec
UNION ALL SELECT 'resolved', count(*) FROM ec WHERE dst IS NOT NULL UNION ALL SELECT 'unresolved', count(*) FROM ec WHERE dst IS NULL UNION ALL SELECT 'test_links', count(*) FROM test_links
UNION ALL SELECT 'unresolved_named', count(*) FROM ec WHERE dst_name IN (SELECT name FROM symbols)""")
def audit_summary(g, spark, folder):
    return quality.summary(g.files, g.symbols, _bound_and_unbound(g), g.test_links)


@_query(f"""{_BOTH_KINDS} SELECT 'unresolved' AS metric, count(*) AS n FROM ec WHERE dst IS NULL UNION ALL SELECT 'unresolved_named', count(*) FROM ec WHERE dst IS NULL AND dst_name IN (SELECT name FROM symbols)
UNION ALL SELECT 'dangling', count(*) FROM ec WHERE dst % 7 = 3""")
def unbound_name_counts(g, spark, folder):
    # every seventh symbol is gone from the side that targets are looked up in
    there = g.symbols.withColumn("id", F.when(F.col("id") % 7 != 3, F.col("id")))
    return resolve.unbound_name_counts(_bound_and_unbound(g), there)


@_query(f"""{_LINKS}, wa AS (SELECT id AS file_id, row_number() OVER (ORDER BY id DESC) AS place FROM files), t AS (SELECT s.id, place FROM symbols s JOIN wa USING (file_id)),
ev AS (SELECT place, test_symbol_id AS tid, reason, score, 2 AS rank FROM bl JOIN t ON t.id = target_symbol_id UNION ALL SELECT place, src, 'test_calls', 0.9::DOUBLE, 3 FROM test_calls JOIN t ON t.id = dst),
be AS (SELECT place, path, qualified_name AS symbol, arg_max(reason, round(score * 1000) * 4 + rank) AS reason, arg_max(score, round(score * 1000) * 4 + rank) AS score FROM ev JOIN tests ON tests.id = tid JOIN test_files f ON f.id = file_id GROUP BY ALL),
pg AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, path, symbol) AS n FROM be)
SELECT path, symbol, arg_min(reason, place) AS reason, arg_min(score, place) AS score FROM pg WHERE n <= 50 GROUP BY ALL""")
def related_tests_of_files(g, spark, folder):
    bound = resolve.bind_test_links(g.test_links, g.symbols, g.files, g.test_files)
    wanted = g.files.select(F.col("id").alias("file_id"), F.row_number().over(Window.orderBy(F.desc("id"))).alias("place"))
    return resolve.related_tests_of_files(bound, g.test_calls, g.tests, g.test_files, g.symbols, wanted)


@_query("SELECT s.id, kind, qualified_name, path, start_line, signature, doc_summary AS summary FROM symbols s JOIN files f ON f.id = file_id")
def symbol_cards(g, spark, folder):
    return inventory.cards(g.symbols, g.files)


@_query(f"{_EVENTS} SELECT key AS path, max(id) AS stamp FROM s GROUP BY key HAVING max(id) > coalesce(max(id) FILTER (event_type = 'error'), -1)", raw=True)
def dirty_queue(g, spark, folder):
    events = sessions.session_table(spark.read.parquet(f"{folder}/events.parquet")).select(F.col("key").alias("path"), F.col("id").alias("stamp"), "event_type")
    return sessions.pending(events.select("path", "stamp"), events.where("event_type = 'error'").select("path", "stamp"))


@_query("SELECT o_orderpriority AS language, CAST(o_custkey % 5 AS BIGINT) AS scan_id, count(*) AS seen FROM orders GROUP BY ALL", raw=True)
def scan_coverage(g, spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    rows = orders.groupBy((F.col("o_custkey") % 5).alias("scan_id"), F.col("o_orderpriority").alias("language")).agg(F.count("*").alias("seen"))
    scans = inventory.scans_with_coverage(rows.select(F.col("scan_id").alias("id")).distinct(), rows)
    return scans.select(F.col("id").alias("scan_id"), F.explode("coverage").alias("language", "seen"))


@_query("""fa AS (SELECT path, min(s.id) AS first FROM symbols s JOIN files f ON f.id = file_id GROUP BY path) SELECT path, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS file_rank, round(greatest(0.1::DOUBLE, 1 - 0.05::DOUBLE * (dense_rank() OVER (ORDER BY first) - 1)), 2) AS relevance FROM fa""")
def file_relevance(g, spark, folder):
    return search.file_relevance(g.symbols, g.files)


# names, detail, scans, accuracy

_SPELLED = "sp AS (SELECT DISTINCT dst_name AS name, language FROM calls UNION SELECT DISTINCT 'x.' || dst_name, language FROM calls WHERE dst_name LIKE 'brand%' UNION SELECT name, 'python' FROM symbols WHERE kind = 'class' UNION SELECT 'q/' || name, language FROM symbols)"
_TAILS = "tl AS (SELECT id, language, kind, unnest([lower(array_to_string(list_slice(string_split(qualified_name, '.'), CAST(k AS BIGINT), len(string_split(qualified_name, '.'))), '.')) FOR k IN range(2, len(string_split(qualified_name, '.')) + 1)]) AS key FROM symbols)"


@_query(f"""{_SPELLED}, {_TAILS},
np AS (SELECT name, language, contains(name, '.') AND NOT contains(name, '/') AS member, contains(name, '.') OR contains(name, '/') AS qualified, string_split(name, '.')[-1] AS short, language = 'python' AS gated FROM sp),
sf AS (SELECT name, language, unnest([array_to_string(list_slice(string_split(name, '.'), CAST(k AS BIGINT), len(string_split(name, '.'))), '.') FOR k IN range(2, len(string_split(name, '.')))]) AS key FROM np WHERE member),
ht AS (SELECT np.name, np.language, 1 AS stage, id FROM np JOIN symbols s ON s.qualified_name = np.name AND s.language = np.language WHERE qualified OR NOT gated OR kind <> 'class'
 UNION SELECT np.name, np.language, 2, id FROM np JOIN symbols s ON s.name = np.name AND s.language = np.language WHERE qualified OR NOT gated OR kind <> 'class'
 UNION SELECT np.name, np.language, 3, id FROM np JOIN tl ON tl.key = lower(CASE WHEN member THEN np.name ELSE short END) AND tl.language = np.language WHERE NOT gated OR kind <> 'class' OR contains(tl.key, '.')
 UNION SELECT sf.name, sf.language, 3, id FROM sf JOIN symbols s ON s.qualified_name = sf.key AND s.language = sf.language
 UNION SELECT np.name, np.language, 4, id FROM np JOIN symbols s ON s.name = short AND s.language = np.language WHERE NOT member AND short <> np.name AND (NOT gated OR kind <> 'class'))
SELECT name, language, stage, id FROM ht QUALIFY stage = min(stage) OVER (PARTITION BY name, language)""")
def identity_cascade(g, spark, folder):
    calls = g.calls.select(F.col("dst_name").alias("name"), "language").distinct()
    names = calls.unionByName(calls.where("name like 'brand%'").select(F.concat(F.lit("x."), "name").alias("name"), "language"))
    names = names.unionByName(g.symbols.where("kind = 'class'").select("name", F.lit("python").alias("language"))).unionByName(g.symbols.select(F.concat(F.lit("q/"), "name").alias("name"), "language"))
    return identity.identity_cascade(names, g.symbols)


@_query("""ex AS (SELECT DISTINCT src, 'vendor/' || dst_name AS dst_name, language FROM calls)
SELECT DISTINCT ex.src, dst_name, s.id FROM ex JOIN symbols s ON lower(dst_name) = 'vendor/' || lower(s.qualified_name) AND s.language = ex.language""")
def extending_callers(g, spark, folder):
    return identity.extending_callers(g.calls.withColumn("dst_name", F.concat(F.lit("vendor/"), "dst_name")), g.symbols)


@_query("""ct AS (SELECT id, file_id, start_line, end_line FROM symbols WHERE kind = 'class'),
mb AS (SELECT ct.id, s.kind || ' ' || s.name AS m, row_number() OVER (PARTITION BY ct.id ORDER BY s.start_line, s.id) AS turn FROM ct JOIN symbols s USING (file_id) WHERE s.start_line >= ct.start_line AND s.end_line <= ct.end_line AND s.id <> ct.id)
SELECT ct.id, count(m) AS member_count, coalesce(string_agg(m, ',' ORDER BY turn) FILTER (turn <= 40), '') AS members FROM ct LEFT JOIN mb USING (id) GROUP BY ct.id""")
def symbol_skeletons(g, spark, folder):
    return detail.skeletons(g.symbols, g.symbols, None).withColumn("members", F.array_join("members", ","))


def _windows(most: int) -> str:
    return f"""WITH d AS (SELECT doc_id AS id, doc_id % 7 + 1 AS a, doc_id % 7 + 1 + doc_id % 90 AS b, string_split(regexp_replace(regexp_replace(text, '\r(\n|$)', '\1', 'g'), '\n$', ''), chr(10)) AS l, text FROM documents),
w AS (SELECT *, len(l) AS total, greatest(1, a - 3) AS f, least(len(l), least(b, len(l)) + 3) AS u, coalesce(text, '') <> '' AND a <= len(l) AS seen FROM d)
SELECT id, CASE WHEN seen THEN CAST(f AS INTEGER) END AS from_line, CASE WHEN seen THEN CAST(least(u, f + {most} - 1) AS INTEGER) END AS to_line,
 CASE WHEN seen THEN array_to_string(list_slice(l, f, least(u, f + {most} - 1)), chr(10)) END AS text, CASE WHEN seen THEN b > total OR f + {most} - 1 < u END AS truncated FROM w"""


def _source_windows(spark, folder, at):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = F.col("doc_id") % 7 + 1
    spans = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), first.alias("start_line"), (first + F.col("doc_id") % 90).alias("end_line"))
    return detail.source_windows(spans, docs.select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")), at)


@_query(_windows(detail.EXCERPT), raw=True)
def source_excerpts(g, spark, folder):
    return _source_windows(spark, folder, "excerpt")


@_query(_windows(detail.FULL), raw=True)
def source_full(g, spark, folder):
    return _source_windows(spark, folder, "full")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS id, '/src/' || lower(n_name) AS root_path, '/src/' || lower(n_name) AS canonical_path FROM nation ORDER BY id LIMIT 10 OFFSET 5", raw=True)
def list_repos(g, spark, folder):
    root = F.concat(F.lit("/src/"), F.lower("n_name"))
    return scans.list_repos(spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), root.alias("root_path"), root.alias("canonical_path")), 10, 5)


@_query("SELECT o_orderkey AS id, 'failed' AS status, o_orderpriority AS error_text FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '' ORDER BY id DESC LIMIT 20", raw=True)
def latest_scan_errors(g, spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    return scans.latest_errors(spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("error_text")))


_OUTCOMES = "o AS (SELECT CAST(o_custkey % 5 AS BIGINT) AS scan_id, o_orderpriority AS language, CASE o_orderkey % 4 WHEN 0 THEN 'indexed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'parse_failed' ELSE 'deleted' END AS outcome FROM orders)"


def _outcomes(spark, folder):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("indexed", "skipped", "parse_failed", "deleted")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{folder}/orders.parquet").select((F.col("o_custkey") % 5).alias("scan_id"), F.col("o_orderpriority").alias("language"), kind.alias("outcome"))


@_query(f"WITH {_OUTCOMES} SELECT scan_id, count(*) FILTER (outcome <> 'deleted') AS files_seen, count(*) FILTER (outcome IN ('indexed', 'parse_failed')) AS files_changed, count(*) FILTER (outcome = 'deleted') AS files_deleted, count(*) FILTER (outcome = 'parse_failed') AS parse_failed FROM o GROUP BY 1", raw=True)
def scan_summaries(g, spark, folder):
    return scans.summaries(_outcomes(spark, folder))


@_query(f"WITH {_OUTCOMES} SELECT scan_id, language, count(*) AS seen, count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'parse_failed') AS parse_failed FROM o WHERE outcome <> 'deleted' GROUP BY 1, 2", raw=True)
def scan_language_coverage(g, spark, folder):
    return scans.language_coverage(_outcomes(spark, folder))


@_query(f"""{_RESOLVE}, oc AS (SELECT DISTINCT rs.src, rs.line, rs.dst_name, CASE WHEN rs.dst_name LIKE 'no_such%' THEN CASE WHEN rs.dst IS NULL THEN 'expected_unresolved' ELSE 'miswired' END
 WHEN rs.dst IS NULL THEN 'missing_edge' WHEN ends_with(s.qualified_name, rs.dst_name) THEN 'expected_valid' ELSE 'miswired' END AS outcome FROM rs LEFT JOIN symbols s ON s.id = rs.dst)
SELECT outcome, count(*) AS n FROM oc GROUP BY 1""")
def resolver_accuracy(g, spark, folder):
    case = F.concat_ws("|", F.col("src").cast("string"), F.col("line").cast("string"), "dst_name").alias("case_id")
    known = g.symbols.select(F.explode(F.concat(F.array("qualified_name"), text.proper_suffixes(F.col("qualified_name")))).alias("dst_name"), "qualified_name").groupBy("dst_name").agg(F.sort_array(F.collect_set("qualified_name")).alias("valid_targets"))
    cases = g.calls.select(case, "dst_name").distinct().join(known, "dst_name", "left").select("case_id", F.when(F.col("dst_name").startswith("no_such"), "unresolved").otherwise("valid").alias("expect"), "valid_targets")
    out = resolve.resolve(g.calls, g.symbols, g.files).join(g.symbols.select(F.col("id").alias("dst"), F.col("qualified_name").alias("target")), "dst", "left")
    return accuracy.metrics(accuracy.case_outcomes(cases, out.select(F.lit(0).alias("run"), case, "target").distinct()))


# rows as they are stored, and the write path


@_query("SELECT s.*, path FROM symbols s JOIN files f ON f.id = file_id")
def symbol_projection(g, spark, folder):
    return g.symbols.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")


@_query("SELECT s.id, qualified_name FROM symbols s JOIN files f ON f.id = file_id WHERE NOT is_deleted")
def live_symbols(g, spark, folder):
    return store.of_live_files(g.symbols, g.files).select("id", "qualified_name")


@_query("SELECT id, path, qualified_name, kind FROM symbols s JOIN (SELECT id AS file_id, path FROM files) USING (file_id) ORDER BY qualified_name, start_line, id LIMIT 25 OFFSET 100")
def late_symbol_page(g, spark, folder):
    wide = g.symbols.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return inventory.late_page(wide, ["qualified_name", "start_line", "id"], 25, 100).select("id", "path", "qualified_name", "kind")


@_query("SELECT id, qualified_name FROM symbols WHERE (qualified_name, id) > ('lib.brand2', 0) ORDER BY qualified_name, id LIMIT 500")
def keyset_symbol_page(g, spark, folder):
    return inventory.keyset_page(g.symbols, ["qualified_name", "id"], ("lib.brand2", 0), 500).select("id", "qualified_name")


@_query("""nm AS (SELECT name, count(*) AS n FROM symbols GROUP BY name) SELECT name, n FROM nm ORDER BY n DESC, name LIMIT 10""")
def most_borne_names(g, spark, folder):
    return inventory.top_with_ties(inventory.count_by(g.symbols, F.col("name"), "name"), "n", ["name"], 10)


_TOKENS_OF = "tk AS (SELECT file_id, qualified_name, unnest(regexp_extract_all(translate(name || ' ' || qualified_name || ' ' || signature || ' ' || doc_summary, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_./\\-]{2,}')) AS token FROM symbols)"


@_query(f"{_TOKENS_OF} SELECT path, qualified_name, CAST(count(*) AS DOUBLE) AS score, 'token_overlap' AS why FROM tk JOIN files f ON f.id = file_id WHERE token IN ('brand1', 'red_widget') GROUP BY ALL ORDER BY score DESC, path, qualified_name LIMIT 40")
def semantic_hits(g, spark, folder):
    return search.semantic(g.symbols, g.files, "Brand1 red_widget", 40).withColumn("why", F.array_join("why", ","))


@_query("SELECT id, round(1 - (row_number() OVER (ORDER BY path, qualified_name, id) - 1) / count(*) OVER ()::DOUBLE, 6) AS signal FROM symbols s JOIN (SELECT id AS file_id, path FROM files) USING (file_id)")
def signals_by_rank(g, spark, folder):
    named = g.symbols.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return search.normalised(named.select("path", "qualified_name", "id", F.lit(0.0).alias("signal"))).select("id", F.round("signal", 6).alias("signal"))


@_query(f"""{_BOTH}, fs AS (SELECT id FROM symbols WHERE file_id = 2001), l1 AS (SELECT DISTINCT b AS id FROM u WHERE a IN (SELECT id FROM fs) OR a = {SEED}), l2 AS (SELECT DISTINCT b AS id FROM u JOIN l1 ON a = l1.id WHERE b NOT IN (SELECT id FROM l1))
SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM fs UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2) GROUP BY id""")
def impact_of_files(g, spark, folder):
    return graph.impact(g.edges, g.symbols, g.symbols.where(F.col("id") == SEED), 2, g.files.where("id = 2001").select(F.col("id").alias("file_id"))).select("id", "depth").distinct()


@_query()
def cycle_paths(g, spark, folder):
    return graph.cycle_paths(g.edges, g.symbols, g.files, 20)


@_query("""t AS (SELECT DISTINCT language, qualified_name FROM symbols WHERE name = 'red_widget'),
n AS (SELECT language, 'red_widget' AS dst_name FROM t UNION SELECT language, qualified_name FROM t UNION SELECT language, split_part(qualified_name, '.', 2) || '.' || split_part(qualified_name, '.', 3) FROM t UNION SELECT language, split_part(qualified_name, '.', 3) FROM t)
SELECT DISTINCT id, qualified_name FROM (SELECT c.src AS id FROM calls c JOIN n USING (language, dst_name) UNION SELECT e.src FROM edges e JOIN symbols t ON e.dst = t.id WHERE t.name = 'red_widget') JOIN symbols USING (id)""")
def all_callers(g, spark, folder):
    return graph.all_callers(g.edges, g.calls, g.symbols, g.symbols.where("name = 'red_widget'"), "red_widget").select("id", "qualified_name")


@_query("""cl AS (SELECT DISTINCT dst_name, language FROM calls WHERE src = 3000001),
mt AS (SELECT cl.dst_name, s.id, CASE WHEN s.qualified_name = dst_name THEN 1 WHEN s.name = dst_name THEN 2 ELSE 3 END AS stage FROM cl JOIN symbols s ON s.language = cl.language AND (s.qualified_name = dst_name OR s.name = dst_name OR ends_with(lower(s.qualified_name), '.' || lower(dst_name)))),
fi AS (SELECT id FROM mt QUALIFY stage = min(stage) OVER (PARTITION BY dst_name)) SELECT DISTINCT id, qualified_name FROM (SELECT id FROM fi UNION SELECT dst FROM edges WHERE src = 3000001) JOIN symbols USING (id)""")
def all_callees(g, spark, folder):
    return graph.all_callees(g.edges, g.calls, g.symbols, g.symbols.where("id = 3000001")).select("id", "qualified_name")


@_query(f"""{_TOKENS_OF}, {_LINKS}, sp AS (SELECT s.*, path FROM symbols s JOIN files f ON f.id = file_id),
hi AS MATERIALIZED (SELECT path, qualified_name, CAST(count(*) AS DOUBLE) AS signal FROM tk JOIN files f ON f.id = file_id WHERE token IN ('brand1', 'red_widget', 'supplier', 'of', 'or') GROUP BY ALL ORDER BY signal DESC, path, qualified_name LIMIT 30),
di AS MATERIALIZED (SELECT path, qualified_name, signal, arg_min(sp.id, (stable_key = '', stable_key, start_line, sp.id)) AS id FROM hi JOIN sp USING (path, qualified_name) GROUP BY ALL),
nb AS MATERIALIZED (SELECT DISTINCT di.id AS seed, 'caller' AS side, src AS id FROM edges JOIN di ON dst = di.id UNION SELECT DISTINCT di.id, 'callee', dst FROM edges JOIN di ON src = di.id),
nr AS MATERIALIZED (SELECT DISTINCT side AS class, id FROM (SELECT side, id, row_number() OVER (PARTITION BY seed, side ORDER BY qualified_name, start_line, id) AS n FROM nb JOIN symbols USING (id)) WHERE n <= 10),
ts AS (SELECT test_symbol_id AS id, reason, score, 2 AS rank FROM bl WHERE target_symbol_id IN (SELECT id FROM di) UNION ALL SELECT src, 'test_calls', 0.9::DOUBLE, 3 FROM test_calls WHERE dst IN (SELECT id FROM di)),
rt AS MATERIALIZED (SELECT path, qualified_name, arg_max(score, round(score * 1000) * 4 + rank) AS score FROM ts JOIN tests USING (id) JOIN test_files f ON f.id = file_id GROUP BY ALL ORDER BY score DESC, path, qualified_name LIMIT 100),
cd AS MATERIALIZED (SELECT 'direct' AS class, path, qualified_name, id, signal / max(signal) OVER () AS signal FROM di UNION ALL SELECT class, path, qualified_name, id, 1.0::DOUBLE FROM nr JOIN sp USING (id) UNION ALL SELECT 'test', path, qualified_name, NULL, score / max(score) OVER () FROM rt),
sc AS MATERIALIZED (SELECT cd.*, CASE WHEN coalesce(stable_key, '') <> '' THEN stable_key ELSE cd.qualified_name || chr(1) || coalesce(name, '') END AS same, CASE class WHEN 'direct' THEN 0 WHEN 'caller' THEN 1 WHEN 'callee' THEN 2 ELSE 3 END AS place,
 round(CASE class WHEN 'direct' THEN 0.6 WHEN 'caller' THEN 0.35 WHEN 'callee' THEN 0.3 ELSE 0.1 END::DOUBLE + CASE class WHEN 'direct' THEN 0.4 WHEN 'test' THEN 0.15 ELSE 0.3 END::DOUBLE * signal, 6) AS base FROM cd LEFT JOIN symbols s ON s.id = cd.id),
bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY path, same ORDER BY base DESC, place, id IS NULL, id) = 1),
fi AS MATERIALIZED (SELECT *, round(base + 0.01 * least(5, count(*) OVER (PARTITION BY path)), 6) AS score FROM bs), ld AS (SELECT path, row_number() OVER (ORDER BY score DESC, place, path, qualified_name) AS o FROM fi),
fr AS (SELECT path, CAST(row_number() OVER (ORDER BY min(o)) AS INTEGER) AS file_rank FROM ld GROUP BY path)
SELECT path, qualified_name, id, class, score, file_rank FROM fi JOIN fr USING (path) WHERE file_rank <= 10""")
def task_context(g, spark, folder):
    direct = context.direct_hits(search.semantic(g.symbols, g.files, "Red_widget of brand1 or supplier", 30), g.symbols, g.files)
    bound = resolve.bind_test_links(g.test_links, g.symbols, g.files, g.test_files)
    related = resolve.related_tests(bound, g.test_calls, g.tests, g.test_files, direct.select("id"))
    return search.rank_context(context.candidates(direct, g.symbols, g.files, g.edges, related), 10)


_STORED = "sf AS (SELECT id, path, language, size_bytes AS size, id AS modified, sha256(path) AS sha256, 'indexed' AS parse_state, CAST(1 AS BIGINT) AS last_scan_id, is_deleted FROM files WHERE id % 5 <> 0)"


def _stored_files(g) -> DataFrame:
    return g.files.where("id % 5 <> 0").select("id", "path", "language", F.col("size_bytes").alias("size"), F.col("id").alias("modified"), F.sha2("path", 256).alias("sha256"), F.lit("indexed").alias("parse_state"), F.lit(1).cast("long").alias("last_scan_id"), "is_deleted")


def _found_files(g) -> DataFrame:
    m = F.col("id") % 4
    return g.files.where("id % 7 <> 0").select("path", "language", (F.col("size_bytes") + (m == 1).cast("int")).alias("size"), (F.col("id") + (m >= 1).cast("int")).alias("modified"), F.when(m == 1, "new").otherwise(F.sha2("path", 256)).alias("sha256"), (F.col("id") % 11 == 0).alias("skip"))


@_query("SELECT path, size_bytes AS size, sha256(path) AS sha256 FROM files WHERE id % 5 <> 0 AND NOT is_deleted AND id % 3 = 0")
def existing_files(g, spark, folder):
    return store.existing(_stored_files(g), g.files.where("id % 3 = 0").select("path")).select("path", "size", "sha256")


#: Live rows against what is found: the live ones alone are known to a scan.
_SCANNED = f"""{_STORED}, fo AS (SELECT path, language, size_bytes + (id % 4 = 1)::INT AS size, id + (id % 4 >= 1)::INT AS modified, CASE WHEN id % 4 = 1 THEN 'new' ELSE sha256(path) END AS sha256, id % 11 = 0 AS skip FROM files WHERE id % 7 <> 0),
ca AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'delete' WHEN skip THEN 'skip_only' WHEN w.size = o.size AND w.modified = o.modified THEN 'mark_seen' WHEN w.sha256 = o.sha256 THEN 'touch' WHEN length(coalesce(o.path, w.path)) % 2 = 0 THEN 'parse_failed' ELSE 'replace' END AS action
 FROM (SELECT * FROM sf WHERE NOT is_deleted) o FULL JOIN fo w ON o.path = w.path),
mk AS (SELECT path, CASE WHEN action IN ('replace', 'parse_failed') THEN fo.language ELSE sf.language END AS language, CASE WHEN action IN ('touch', 'replace', 'parse_failed') THEN fo.size ELSE sf.size END AS size, CASE WHEN action IN ('touch', 'replace', 'parse_failed') THEN fo.modified ELSE sf.modified END AS modified,
 CASE WHEN action IN ('replace', 'parse_failed') THEN fo.sha256 ELSE sf.sha256 END AS sha256, CASE WHEN action = 'replace' THEN 'indexed' WHEN action = 'parse_failed' THEN 'parse_failed' WHEN action IN ('delete', 'skip_only') THEN 'deleted' ELSE parse_state END AS parse_state,
 CASE WHEN action IS NOT NULL THEN 2 ELSE last_scan_id END AS last_scan_id, CASE WHEN action IN ('delete', 'skip_only') THEN true WHEN action IN ('replace', 'parse_failed') THEN false ELSE is_deleted END AS is_deleted
 FROM sf FULL JOIN ca USING (path) LEFT JOIN fo USING (path) WHERE sf.id IS NOT NULL OR action IN ('replace', 'parse_failed'))"""


def _marked(g) -> DataFrame:
    stored, found = _stored_files(g), _found_files(g)
    changes = walk.classify_changes(store.existing(stored), found)
    changes = store.with_failures(changes, changes.where(F.length("path") % 2 == 0).select("path"))
    return store.mark(stored, changes, found, 2)


@_query(f"{_SCANNED} SELECT * FROM mk")
def marked_files(g, spark, folder):
    return _marked(g).drop("id")


@_query(f"{_SCANNED} SELECT path, CASE WHEN NOT is_deleted AND last_scan_id <> 2 THEN 'deleted' ELSE parse_state END AS parse_state, is_deleted OR last_scan_id <> 2 AS is_deleted FROM mk")
def unseen_files_deleted(g, spark, folder):
    return store.delete_unseen(_marked(g), 2).select("path", "parse_state", "is_deleted")


@_query(f"{_SCANNED} SELECT path FROM mk WHERE NOT is_deleted")
def purged_files(g, spark, folder):
    return store.purge(_marked(g)).select("path")


_GONE = "cf AS (SELECT id AS file_id FROM files WHERE id % 4 = 1), gn AS (SELECT id FROM symbols WHERE file_id IN (SELECT file_id FROM cf) AND id % 3 = 0)"


def _gone(g) -> tuple[DataFrame, DataFrame]:
    """A quarter of the files has changed, and a third of their symbols is not there any more."""
    changed = g.files.where("id % 4 = 1").select(F.col("id").alias("file_id"))
    return changed, store.gone_symbols(g.symbols, changed, g.symbols.where("id % 3 <> 0"))


@_query(f"""{_GONE} SELECT src, file_id, line, CASE WHEN dst NOT IN (SELECT id FROM gn) THEN dst END AS dst, CASE WHEN dst NOT IN (SELECT id FROM gn) THEN 'exact_name' END AS strategy, count(*) AS n FROM edges WHERE file_id NOT IN (SELECT file_id FROM cf) GROUP BY ALL""")
def unbound_after_change(g, spark, folder):
    changed, gone = _gone(g)
    calls = g.edges.withColumn("strategy", F.lit("exact_name")).withColumn("confidence", F.lit("high"))
    kept = store.unbind(store.replace_rows(calls, changed), gone)
    return kept.groupBy("src", "file_id", "line", "dst", "strategy").agg(F.count("*").alias("n"))


@_query(f"""{_GONE}, {_LINKS.replace("so AS", "so AS")} SELECT test_symbol_id, CASE WHEN target_symbol_id NOT IN (SELECT id FROM gn) THEN target_symbol_id END AS target_symbol_id, CASE WHEN target_file_id NOT IN (SELECT file_id FROM cf) THEN target_file_id END AS target_file_id FROM bl WHERE test_file_id NOT IN (SELECT file_id FROM cf)""")
def test_links_after_change(g, spark, folder):
    changed, gone = _gone(g)
    bound = resolve.bind_test_links(g.test_links, g.symbols, g.files, g.test_files)
    return store.unbind_tests(bound, gone, changed).select("test_symbol_id", "target_symbol_id", "target_file_id")


@_query("od AS (SELECT name, qualified_name FROM symbols WHERE file_id % 4 = 1), nw AS (SELECT name, qualified_name FROM symbols WHERE file_id % 4 = 1 AND id % 3 <> 0) SELECT name FROM (SELECT name FROM od UNION SELECT qualified_name FROM od) WHERE name NOT IN (SELECT name FROM nw UNION ALL SELECT qualified_name FROM nw)")
def removed_names(g, spark, folder):
    before = g.symbols.where("file_id % 4 = 1")
    return resolve.removed_names(before, before.where("id % 3 <> 0"))


@_query("bn AS (SELECT DISTINCT id, language, unnest([name, qualified_name]) AS name FROM symbols) SELECT name, language, count(*) AS n FROM bn GROUP BY ALL HAVING count(*) > 1")
def contested_names(g, spark, folder):
    return resolve.contested_names(g.symbols, resolve.changed_names(g.symbols, g.symbols))


_QUEUE = "WITH s AS (SELECT regexp_extract(props, '\"k\": *([0-9]+)', 1) AS path, event_id AS stamp, event_type AS reason FROM events), q AS (SELECT path, arg_max(reason, stamp) AS reason, max(stamp) AS stamp FROM s GROUP BY path)"


def _queue(spark, folder) -> DataFrame:
    events = sessions.session_table(spark.read.parquet(f"{folder}/events.parquet")).select(F.col("key").alias("path"), F.col("event_type").alias("reason"), F.col("id").alias("stamp"))
    none = spark.createDataFrame([], "path string, reason string, stamp long, claim long")
    return store.enqueue(none, events)


@_query(f"{_QUEUE} SELECT *, CASE WHEN row_number() OVER (ORDER BY stamp, path) <= 20 THEN CAST(99 AS BIGINT) END AS claim FROM q", raw=True)
def claimed_queue(g, spark, folder):
    return store.claim(_queue(spark, folder), 99, 20)


@_query(f"{_QUEUE} SELECT path, reason, stamp FROM q WHERE stamp % 3 <> 0", raw=True)
def finished_queue(g, spark, folder):
    # a third is done at its last request, a third at one before, and a third not at all
    queue = store.claim(_queue(spark, folder), 99, 1000)
    done = queue.where("stamp % 3 <> 1").select("path", F.when(F.col("stamp") % 3 == 0, F.col("stamp")).otherwise(F.col("stamp") - 1).alias("stamp"))
    return store.finish(queue, done).select("path", "reason", "stamp")


@_query("SELECT canonical_path, root_path FROM (SELECT '/src/' || lower(n_name) AS canonical_path, CASE WHEN n_nationkey = 3 THEN '/moved' ELSE '/src/' || lower(n_name) END AS root_path FROM nation)", raw=True)
def upserted_repos(g, spark, folder):
    root = F.concat(F.lit("/src/"), F.lower("n_name"))
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    repos = nation.select(F.col("n_nationkey").cast("long").alias("id"), root.alias("root_path"), root.alias("canonical_path"), F.lit(None).cast("timestamp").alias("updated_at"))
    third = repos.where("id = 3").first()["canonical_path"]
    again = store.upsert_repo(repos.where("id <> 4"), "/moved", third, F.current_timestamp())
    fourth = repos.where("id = 4").first()["canonical_path"]
    return store.upsert_repo(again, fourth, fourth, F.current_timestamp()).select("canonical_path", "root_path")


@_query(f"""{_CLASSIFIED}, cl AS (SELECT CASE WHEN dst_name = 'len' THEN CASE WHEN evidence <> '' THEN 'unknown' ELSE 'builtin' END WHEN dst_name LIKE 'os.%' AND EXISTS (SELECT 1 FROM imports i WHERE i.file_id = ci.file_id AND import_path = 'os') THEN 'stdlib' ELSE 'unknown' END AS target FROM ci)
SELECT t.target, count(cl.target) AS n FROM (VALUES ('builtin'), ('stdlib'), ('external'), ('unknown')) t(target) LEFT JOIN cl USING (target) GROUP BY t.target""")
def unresolved_classes(g, spark, folder):
    name = F.when(F.col("line") % 3 == 0, "len").when(F.col("line") % 3 == 1, "os.path.join").otherwise(F.col("dst_name"))
    calls = g.calls.select("src", "file_id", "language", name.alias("dst_name"), F.lit(None).cast("long").alias("dst"), F.when(F.col("line") == 6, "x.len()").otherwise("").alias("evidence"))
    return quality.unresolved_classes(quality.classify(calls, g.symbols, g.imports))


# strategies that the calls above never reach: a symbol per part, spelled so that one strategy alone binds it

_FORMS = """pf AS (SELECT p_partkey AS k, brand, br % 2 = 1 AND p_partkey % 8 = 0 AS in_go FROM p),
ex AS (SELECT k, in_go, k % 8 AS form, CASE WHEN in_go THEN 'go' ELSE 'python' END AS language FROM pf)"""


def _spelled(spark, folder):
    """(symbols, calls, files, imports, modules): form k % 8 of part k. 0 package scope and import in Go, elsewhere the qualified name; 1 slash, 2 two and 3 three segments, 4 a suffix, 5 a receiver's method, 6 a sole name, 7 a name of a test."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    ranks = part.select("p_brand").distinct().withColumn("br", F.dense_rank().over(Window.orderBy("p_brand")) - 1)  # 25 brands
    rows = part.join(F.broadcast(ranks), "p_brand").select(F.col("p_partkey").alias("k"), F.lower(F.translate("p_brand", "#", "")).alias("brand"), "br")
    rows = rows.withColumn("form", F.col("k") % 8).withColumn("in_go", (F.col("br") % 2 == 1) & (F.col("form") == 0)).withColumn("fn", F.concat(F.lit("fn_"), "k"))
    form, k = F.col("form"), F.col("k")
    dotted = lambda *parts: F.concat_ws(".", *[F.lit(x) if isinstance(x, str) else x for x in parts])
    brand, fn = F.col("brand"), F.col("fn")
    qualified = F.when(form == 0, dotted(brand, fn)).when(form == 1, F.concat(F.lit("pkg/"), dotted(brand, fn))).when(form == 2, dotted("top", brand, fn)).when(form == 3, dotted("x", "top", brand, fn)).when(form == 4, dotted("w", "x", "top", brand, F.upper(fn))).when(form == 5, dotted("k", fn)).when(form == 6, dotted("solo", fn)).otherwise(dotted("t", fn))
    file_id = F.when(F.col("in_go"), 100 + F.col("br")).when(form == 7, 300 + F.col("br")).otherwise(200 + F.col("br")).cast("long")
    language = F.when(F.col("in_go"), "go").otherwise("python")
    rows = rows.withColumn("file_id", file_id).withColumn("language", language).withColumn("id", 7_000_000 + k)
    symbols = rows.select("id", "file_id", "language", F.when(form == 5, "declaration").otherwise("function").alias("kind"), F.when(form == 4, F.upper(fn)).otherwise(fn).alias("name"), qualified.alias("qualified_name"), F.when(form == 5, "K").otherwise("").alias("container_name"))
    path = F.when(F.col("in_go"), F.concat(F.lit("gopkg/"), brand, F.lit("/a.go"))).when(form == 7, F.concat(F.lit("tests/"), brand, F.lit(".py"))).otherwise(F.concat(F.lit("py/"), brand, F.lit(".py")))
    files = rows.select(F.col("file_id").alias("id"), path.alias("path"), "language").distinct()
    spelled = F.when(F.col("in_go"), fn).when(form.isin(0, 1, 2), dotted(brand, fn)).when(form == 3, dotted("top", brand, fn)).when(form == 4, dotted("x", "top", brand, fn)).otherwise(fn)
    home = F.when(F.col("in_go"), F.col("file_id")).otherwise(200 + F.col("br")).cast("long").alias("file_id")
    calls = rows.select(F.col("id").alias("src"), home, k.alias("line"), "language", spelled.alias("dst_name"))
    go = rows.where("in_go")
    far = go.select(F.col("id").alias("src"), F.lit(99).cast("long").alias("file_id"), k.alias("line"), "language", F.concat(F.lit("ex.org/m/gopkg/"), brand, F.lit("."), fn).alias("dst_name"))
    imports = go.select(F.lit(99).cast("long").alias("file_id"), F.concat(F.lit("ex.org/m/gopkg/"), brand).alias("import_path")).distinct()
    files = files.unionByName(spark.createDataFrame([(99, "cmd/main.go", "go")], "id long, path string, language string"))
    return symbols, calls.unionByName(far), files, imports, spark.createDataFrame([("ex.org/m", "")], "module string, folder string")


@_query(f"""{_FORMS} SELECT 7000000 + k AS src, language, strategy, 'bound' AS outcome, CASE WHEN strategy IS NOT NULL THEN 7000000 + k END AS dst, CAST(1 AS BIGINT) AS n FROM (SELECT k, language, CASE form WHEN 0 THEN CASE WHEN in_go THEN 'go_package_scope' ELSE 'exact_qualified' END WHEN 1 THEN 'slash_suffix' WHEN 2 THEN 'dot_tail2' WHEN 3 THEN 'dot_tail3' WHEN 4 THEN 'dot_suffix' WHEN 5 THEN 'receiver_method' ELSE 'exact_name' END AS strategy FROM ex WHERE form <> 7
 UNION ALL SELECT k, language, 'module_import' FROM ex WHERE in_go) UNION ALL SELECT 7000000 + k, language, NULL, 'test_shadow', NULL, 1 FROM ex WHERE form = 7""")
def resolve_strategies(g, spark, folder):
    symbols, calls, files, imports, modules = _spelled(spark, folder)
    out = resolve.resolve(calls, symbols, files, imports, modules)
    return out.groupBy("src", "language", "strategy", F.coalesce("blocked", F.lit("bound")).alias("outcome"), "dst").agg(F.count("*").alias("n"))


@_query(f"""{_STORED}, fo AS (SELECT path, size_bytes + (id % 4 = 1)::INT AS size, id + (id % 4 >= 1)::INT AS modified, CASE WHEN id % 4 = 1 THEN 'new' ELSE sha256(path) END AS sha256, id % 11 = 0 AS skip FROM files WHERE id % 7 <> 0 AND id % 2 = 0)
SELECT coalesce(o.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'delete' WHEN skip THEN 'skip_only' WHEN w.size = o.size AND w.modified = o.modified THEN 'mark_seen' WHEN w.sha256 = o.sha256 THEN 'touch' ELSE 'replace' END AS action
FROM (SELECT * FROM sf WHERE NOT is_deleted AND id % 2 = 0) o FULL JOIN fo w ON o.path = w.path""")
def scoped_changes(g, spark, folder):
    # explicit paths alone are looked at; those of them that are not there are deletes
    paths = g.files.where("id % 2 = 0").select("path")
    return walk.classify_changes(store.existing(_stored_files(g), paths), walk.scoped(_found_files(g), paths))
