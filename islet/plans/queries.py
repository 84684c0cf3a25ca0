"""Queries over the test tables, one for each operator, and DuckDB SQL for their results.

The graphs: orders and parts that a line item of at least 45 or 49 pieces joins (one giant
component, or many small ones), parts and suppliers (dense), customers and orders (stars), nations
and customers (few, large), and documents of equal text (mostly alone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islet.functions.scalars import machine_hash
from islet.operators import census, components, edges, generators, merging, search
from islet.plans import experiments, reports
from islet.sources import edge_files, results
from islet.storage import new_path, stage

#: Edge expressions by graph, good in Spark and in DuckDB.
GRAPHS = {
    "order_part": "SELECT 2 * l_orderkey AS u, 2 * l_partkey + 1 AS v FROM lineitem WHERE l_quantity >= 49",
    "order_part_45": "SELECT 2 * l_orderkey AS u, 2 * l_partkey + 1 AS v FROM lineitem WHERE l_quantity >= 45",
    "part_supplier": "SELECT 2 * l_partkey AS u, 2 * l_suppkey + 1 AS v FROM lineitem",
    "customer_order": "SELECT 2 * o_custkey AS u, 2 * o_orderkey + 1 AS v FROM orders",
    "nation_customer": "SELECT CAST(2 * c_nationkey AS BIGINT) AS u, CAST(2 * c_custkey + 1 AS BIGINT) AS v FROM customer",
    "documents": "SELECT d.doc_id AS u, m.head AS v FROM documents d JOIN (SELECT text, min(doc_id) AS head FROM documents GROUP BY text) m ON d.text = m.text",
}
TABLES = {"order_part": "lineitem", "order_part_45": "lineitem", "part_supplier": "lineitem", "customer_order": "orders", "nation_customer": "customer", "documents": "documents"}


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``u, v`` of one of the graphs."""
    table = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(GRAPHS[name].replace(f"FROM {table}", "FROM {rows}"), rows=rows).select(F.col("u").cast("long"), F.col("v").cast("long"))


def _on(name: str, make):
    """A query that applies ``make`` to a graph."""
    return lambda spark, sf_dir: make(graph(spark, sf_dir, name))


def _with(name: str, body: str) -> str:
    """SQL over the named graph: ``e`` its edges, ``s`` both directions once, ``x`` its vertices."""
    return f"""WITH RECURSIVE e AS ({GRAPHS[name]}),
s AS (SELECT DISTINCT a AS u, b AS v FROM (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e) WHERE a <> b),
x AS (SELECT u AS id FROM e UNION SELECT v FROM e),
{body}"""


#: Components by spreading the least label along edges.
_LABELS = """l(id, comp) USING KEY (id) AS (
  SELECT id, id FROM x
  UNION
  SELECT s.v, min(l.comp) FROM l JOIN s ON s.u = l.id JOIN recurring.l r ON r.id = s.v WHERE l.comp < r.comp GROUP BY s.v)"""
_SIZES = _LABELS + ", c AS (SELECT comp AS iC, count(*) AS nC FROM l GROUP BY comp)"
_LEVELS = _LABELS + """, b(id, level) USING KEY (id) AS (
  SELECT id, CAST(0 AS BIGINT) FROM l WHERE id = comp
  UNION
  SELECT s.v, min(b.level) + 1 FROM b JOIN s ON s.u = b.id LEFT JOIN recurring.b r ON r.id = s.v WHERE r.id IS NULL GROUP BY s.v)"""
_STATS = """SELECT CAST(coalesce(sum(nC), 0) AS BIGINT) AS n, count(*) AS f, CAST(coalesce(min(nC), 2147483648) AS BIGINT) AS cl,
round(coalesce(avg(nC), 0), 6) AS cm, CAST(coalesce(max(nC), 0) AS BIGINT) AS cu, round(coalesce(var_pop(nC), 0), 6) AS cv FROM c"""
_LEAST = """k AS (SELECT cu, min(least(u, v)) AS lo FROM (SELECT u AS cu, u, v FROM s) GROUP BY cu),
m AS (SELECT k.cu, k.lo, min(greatest(s.u, s.v)) AS hi FROM k JOIN s ON s.u = k.cu AND least(s.u, s.v) = k.lo GROUP BY k.cu, k.lo)"""


def _listing(e: DataFrame) -> DataFrame:
    return census.sizes(components.labels(e))


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.round(c, 6) for c in ("cm", "cv")})


def _first_phase(e: DataFrame) -> DataFrame:
    once = edges.oriented(e).select(F.col("u").alias("lo"), F.col("v").alias("hi"))
    return merging.least_edges(once.withColumns({"clo": F.col("lo"), "chi": F.col("hi")}))


def _machine_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("long")
    return orders.select(key.alias("v"), machine_hash(key, 1234567890123456789, 987654321987654321, 32).alias("machine"))


def _regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    points = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice")).alias("cost"))
    fitted = reports.regressions(points.withColumn("k", F.col("o_custkey") % 4), ["k"], "n", "cost")
    return fitted.select(F.col("k").cast("long").alias("k"), "points", *(F.round(c, 3).alias(c) for c in ("slope", "intercept", "r2", "log_slope", "log_intercept", "log_r2")))


def _text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    path = new_path(spark, "text-edges")
    line = F.when(F.col("l_linenumber") % 7 == 0, F.concat(F.lit("# "), F.col("l_orderkey"))).when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("  "), F.col("l_orderkey"), F.lit("\t"), F.col("l_partkey"), F.lit(" rest"))).otherwise(F.concat_ws(" ", "l_orderkey", "l_partkey"))
    items.select(line.alias("value")).write.text(path)
    return edge_files.read_text(spark, path).groupBy("u", "v").agg(F.count("*").alias("n"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge_files.register(spark)
    path = new_path(spark, "packed")
    graph(spark, sf_dir, "order_part").write.format("ecg").mode("append").save(path)
    return spark.read.format("ecg").load(path).groupBy("u", "v").agg(F.count("*").alias("n"))


def _generated(make, n: int = 4096, p: float = 0.002, seed: int = 11):
    """What holds of every graph that a generator makes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stage(make(spark, n, p, seed), "generated")
        pairs, mean = rows.where("u <> v"), p * n * (n - 1) / 2
        facts = pairs.agg(F.coalesce(F.bool_and(F.expr(f"u >= 0 and u < v and v < {n}")), F.lit(True)).alias("in_order"), (F.abs(F.count("*") - mean) < 5 * mean**0.5).alias("as_many_as_expected"), F.count("*").alias("_m"))
        distinct = pairs.distinct().agg(F.count("*").alias("_d"))
        own = rows.where("u = v").agg(F.countDistinct("u").alias("declared"), F.count("*").alias("declarations"))
        again = make(spark, n, p, seed, 3).exceptAll(rows).agg((F.count("*") == 0).alias("same_on_other_partitions"))
        whole = facts.crossJoin(distinct).crossJoin(own).crossJoin(again)  # one row each
        return whole.select("declared", "declarations", "in_order", "as_many_as_expected", "same_on_other_partitions", (F.col("_d") == F.col("_m")).alias("all_distinct"))

    return run


def _summary_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of run summaries of two graphs, by two engines."""
    top = new_path(spark, "summaries")
    for engine in ("merging", "search"):
        for name in ("order_part", "nation_customer"):
            results.write_summary(census.summary(graph(spark, sf_dir, name), engine), f"{top}/{engine}.{name}")
    return top


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results.read_summaries(spark, _summary_files(spark, sf_dir), "*.csv")).select("n", "f", "cl", "cm", "cu", "cv", F.col("p").isNotNull().alias("merging"))


def _roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results.read_summaries(spark, _summary_files(spark, sf_dir))
    path = new_path(spark, "roll-up")
    results.write_roll_up(rows.unionByName(rows), path)
    back = results.read_summaries(spark, path)
    return _rounded(back).groupBy("n", "f", "cl", "cm", "cu", "cv").agg(F.count("*").alias("rows"))


def _scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scatter(results.read_summaries(spark, _summary_files(spark, sf_dir)), "n", ("cm", "f")).select("x", F.round("y", 6).alias("y"), "of")


def _first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "listings")
    for name in ("nation_customer", "customer_order"):
        results.write_listing(_listing(graph(spark, sf_dir, name)).coalesce(1), f"{path}/{name}")
    return results.first_lines(spark, path, 2).select("line", "value")


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dump")
    edge_files.write_adjacency(edges.adjacency(graph(spark, sf_dir, "nation_customer")), path)
    return spark.read.text(path)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True if a labelling passes its checks and a wrong one does not."""
    e = graph(spark, sf_dir, "nation_customer")
    labels = components.labels(e)
    census.checked(labels, e)
    try:
        census.checked(labels.withColumn("comp", F.col("id")), e)
    except AssertionError as wrong:
        return spark.createDataFrame([(True, str(wrong))], "right boolean, wrong string")
    return spark.createDataFrame([(True, None)], "right boolean, wrong string")


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generate, run, write and roll up a small sweep; graphs are random, so only what holds of all is returned."""
    sweep = reports.sweep(spark, range(5, 6), 1).where("regime in ('1', 'L')")
    rows = experiments.run(spark, sweep, ("stars", "merging"), (1, 3))
    path = new_path(spark, "sweep")
    experiments.write(rows, path)
    back = experiments.rolled(spark, path, engine="merging")
    agree = F.countDistinct("f", "cl", "cu") == 1
    return back.groupBy("sampler", "regime", F.col("n").cast("long").alias("n")).agg(F.count("*").alias("runs"), agree.alias("agree"), F.bool_and(F.abs(F.col("f") * F.col("cm") - F.col("n")) < 1e-6).alias("adds_up"))


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(merging.merge(graph(spark, sf_dir, g)).phases, g) for g in ("order_part", "nation_customer")], "p long, graph string")


def _forest_size(e: DataFrame) -> DataFrame:
    return merging.merge(e).forest.agg(F.count("*").alias("forest_edges"))


def _listing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "listing")
    results.write_listing(_listing(graph(spark, sf_dir, "order_part")), path)
    return spark.read.schema("iC long, nC long").csv(path, header=True)


def _forest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest alone gives the components of the whole graph."""
    forest = merging.merge(graph(spark, sf_dir, "order_part")).forest
    return _listing(forest.select(F.col("lo").alias("u"), F.col("hi").alias("v")))


QUERIES = {
    "edges_reversed": _on("order_part", edges.reverse),
    "edges_dedup": _on("part_supplier", edges.oriented),
    "edges_symmetrized": _on("order_part", edges.symmetrized),
    "edges_without_leaves": lambda s, d: edges.without(edges.oriented(g := graph(s, d, "order_part")), edges.degree(g).where("degree = 1")),
    "self_edges": _on("documents", edges.self_edges),
    "vertices": _on("order_part", edges.vertices),
    "degree": _on("documents", edges.degree),
    "adjacency": lambda s, d: edges.adjacency(graph(s, d, "nation_customer")).select("id", F.array_join("neighbors", " ").alias("neighbors")),
    "singletons": _on("documents", edges.singletons),
    "cc_labels": _on("order_part", components.labels),
    "cc_labels_giant": _on("order_part_45", components.labels),
    "cc_labels_documents": _on("documents", components.labels),
    "cc_sizes": _on("order_part", _listing),
    "cc_topk": lambda s, d: census.largest(_listing(graph(s, d, "order_part")), 10),
    "cc_size_histogram": lambda s, d: census.histogram(_listing(graph(s, d, "customer_order"))),
    "cc_running_moments": lambda s, d: reports.running_moments(_listing(graph(s, d, "nation_customer"))).withColumns({c: F.round(c, 6) for c in ("mean", "variance")}),
    "largest_component_fraction": lambda s, d: _listing(graph(s, d, "order_part_45")).agg(F.round(F.max("nC") / F.sum("nC"), 9).alias("fraction")),
    **{f"cc_stats_{g}": _on(g, lambda e: _rounded(census.stats(_listing(e)))) for g in GRAPHS},
    "cc_stats_empty": lambda s, d: census.stats(_listing(graph(s, d, "order_part").where("u < 0"))),
    "mwoe_phase1": lambda s, d: _first_phase(graph(s, d, "order_part")).select("cu", "lo", "hi"),
    "mwoe_core_edges": lambda s, d: merging.core_edges(_first_phase(graph(s, d, "order_part"))).select("lo", "hi"),
    "mwoe_labels": lambda s, d: merging.merge(graph(s, d, "order_part_45")).labels.select("id", "comp"),
    "mwoe_roots": lambda s, d: merging.merge(graph(s, d, "order_part")).labels,
    "mwoe_phases": _phases,
    "spanning_forest": lambda s, d: merging.merge(graph(s, d, "order_part")).forest.select("lo", "hi"),
    "spanning_forest_distributed": lambda s, d: merging.merge(graph(s, d, "order_part"), 0).forest.select("lo", "hi"),
    "mwoe_labels_distributed": lambda s, d: merging.merge(graph(s, d, "order_part_45"), 0).labels.select("id", "comp"),
    "mwoe_phase_metrics": lambda s, d: merging.phase_metrics(merging.merge(graph(s, d, "order_part"))).where("phase = 1").select("picked", "components"),
    "cc_labels_distributed": lambda s, d: components.labels(graph(s, d, "order_part_45"), 0),
    "bfs_levels_distributed": lambda s, d: search.levels(graph(s, d, "order_part"), local=0).select("id", "root", "level"),
    "bfs_children": lambda s, d: search.children(search.levels(graph(s, d, "order_part"))),
    "vertex_declarations": lambda s, d: generators.declarations(s, 1000),
    "graph_dump": _dumped,
    "labels_checked": _checked,
    "summary_files": _summaries,
    "summary_roll_up": _roll_up,
    "summary_scatter": _scatter,
    "first_lines_of_files": _first_lines,
    "experiment_roll_up": _experiments,
    "spanning_forest_size": _on("order_part_45", _forest_size),
    "bfs_levels": lambda s, d: search.levels(graph(s, d, "order_part")).select("id", "root", "level"),
    "bfs_parent": lambda s, d: search.levels(graph(s, d, "order_part")).select("id", "parent"),
    "bfs_rounds": lambda s, d: search.rounds(search.levels(graph(s, d, "order_part"))),
    "bfs_subtree": lambda s, d: search.subtrees(search.levels(graph(s, d, "customer_order"))),
    "cc_summary": lambda s, d: _rounded(census.summary(graph(s, d, "order_part_45")).select("n", "f", "cl", "cm", "cu", "cv")),
    "component_listing_file": _listing_file,
    "edges_sampled": lambda s, d: edges.sampled(graph(s, d, "part_supplier"), 0.25, 3),
    "forest_is_spanning": _forest_spans,
    "generator_sweep": lambda s, d: reports.sweep(s).groupBy("regime", "sampler", "n").agg(F.count("*").alias("graphs"), F.round(F.max(F.col("p") * F.col("n")), 9).alias("degree")),
    "machine_hash": _machine_hash,
    "scaling_regression": _regression,
    "text_parse": _text_parse,
    "ecg_roundtrip": _packed,
    "er_generate_lv": _generated(generators.exact),
    "er_generate_mc": _generated(generators.monte_carlo),
}

#: Each vertex's least neighbour on the level before.
_PARENTS = ", t AS (SELECT b.id, coalesce(min(a.id), b.id) AS parent FROM b LEFT JOIN s ON s.u = b.id AND b.level > 0 LEFT JOIN b a ON a.id = s.v AND a.level = b.level - 1 GROUP BY b.id)"
#: Edges whose ends no path of smaller edges joins.
_FOREST = """f AS (SELECT u AS lo, v AS hi FROM s WHERE u < v),
r(lo, hi, id) AS (SELECT lo, hi, lo FROM f UNION SELECT r.lo, r.hi, s.v FROM r JOIN s ON s.u = r.id WHERE least(s.u, s.v) < r.lo OR (least(s.u, s.v) = r.lo AND greatest(s.u, s.v) < r.hi))
SELECT lo, hi FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.lo = f.lo AND r.hi = f.hi AND r.id = f.hi)"""
_ROWS = "SELECT u, v, count(*) AS n FROM"
ORACLE = {
    "edges_reversed": f"SELECT v AS u, u AS v FROM ({GRAPHS['order_part']})",
    "edges_dedup": f"SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM ({GRAPHS['part_supplier']}) WHERE u <> v",
    "edges_symmetrized": _with("order_part", "t AS (SELECT 1) SELECT u, v FROM s"),
    "edges_without_leaves": _with("order_part", "t AS (SELECT u FROM s GROUP BY u HAVING count(*) = 1) SELECT u, v FROM s WHERE u < v AND u NOT IN (FROM t) AND v NOT IN (FROM t)"),
    "self_edges": f"SELECT DISTINCT u, v FROM ({GRAPHS['documents']}) WHERE u = v",
    "vertices": _with("order_part", "t AS (SELECT 1) SELECT id FROM x"),
    "degree": _with("documents", "t AS (SELECT u, count(*) AS n FROM s GROUP BY u) SELECT id, coalesce(n, 0) AS degree FROM x LEFT JOIN t ON u = id"),
    "adjacency": _with("nation_customer", "t AS (SELECT u, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY v) AS n FROM s GROUP BY u) SELECT id, coalesce(n, '') AS neighbors FROM x LEFT JOIN t ON u = id"),
    "singletons": _with("documents", "t AS (SELECT 1) SELECT id FROM x WHERE id NOT IN (SELECT u FROM s)"),
    "cc_labels": _with("order_part", _LABELS + " SELECT id, comp FROM l"),
    "cc_labels_giant": _with("order_part_45", _LABELS + " SELECT id, comp FROM l"),
    "cc_labels_documents": _with("documents", _LABELS + " SELECT id, comp FROM l"),
    "cc_sizes": _with("order_part", _SIZES + " SELECT iC, nC FROM c"),
    "cc_topk": _with("order_part", _SIZES + " SELECT iC, nC FROM c ORDER BY nC DESC, iC LIMIT 10"),
    "cc_size_histogram": _with("customer_order", _SIZES + " SELECT nC, count(*) AS components FROM c GROUP BY nC"),
    "cc_running_moments": _with("nation_customer", _SIZES + " SELECT iC, nC, round(avg(nC) OVER w, 6) AS mean, round(var_pop(nC) OVER w, 6) AS variance FROM c WINDOW w AS (ORDER BY iC ROWS UNBOUNDED PRECEDING)"),
    "largest_component_fraction": _with("order_part_45", _SIZES + " SELECT round(max(nC) / sum(nC), 9) AS fraction FROM c"),
    **{f"cc_stats_{g}": _with(g, f"{_SIZES} {_STATS}") for g in GRAPHS},
    "cc_stats_empty": "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS f, CAST(2147483648 AS BIGINT) AS cl, CAST(0 AS DOUBLE) AS cm, CAST(0 AS BIGINT) AS cu, CAST(0 AS DOUBLE) AS cv",
    "mwoe_phase1": _with("order_part", _LEAST + " SELECT cu, lo, hi FROM m"),
    "mwoe_core_edges": _with("order_part", _LEAST + " SELECT lo, hi FROM m GROUP BY lo, hi HAVING count(*) = 2"),
    "mwoe_labels": _with("order_part_45", _LABELS + " SELECT id, comp FROM l"),
    "spanning_forest_size": _with("order_part_45", _SIZES + " SELECT CAST(sum(nC) - count(*) AS BIGINT) AS forest_edges FROM c"),
    "bfs_levels": _with("order_part", _LEVELS + " SELECT b.id, l.comp AS root, b.level FROM b JOIN l ON b.id = l.id"),
    "bfs_parent": _with("order_part", _LEVELS + " SELECT b.id, coalesce(min(a.id), b.id) AS parent FROM b LEFT JOIN s ON s.u = b.id AND b.level > 0 LEFT JOIN b a ON a.id = s.v AND a.level = b.level - 1 GROUP BY b.id"),
    "bfs_rounds": _with("order_part", _LEVELS + ", d AS (SELECT l.comp, max(b.level) AS d FROM b JOIN l ON b.id = l.id GROUP BY l.comp) SELECT CAST(coalesce(sum(CASE WHEN d = 0 THEN 1 ELSE 2 * d + 2 END), 0) AS BIGINT) AS r FROM d"),
    "cc_summary": _with("order_part_45", f"{_SIZES} {_STATS}"),
    "component_listing_file": _with("order_part", _SIZES + " SELECT iC, nC FROM c"),
    "forest_is_spanning": _with("order_part", _SIZES + " SELECT iC, nC FROM c"),
    "generator_sweep": """SELECT regime, sampler, CAST(2 ** e AS BIGINT) AS n, CAST(3 AS BIGINT) AS graphs,
round(CASE WHEN regime[1] = 'L' THEN e * ln(2) ELSE 1 END * CASE regime[2:] WHEN '-' THEN 0.8::DOUBLE WHEN '+' THEN 1.2::DOUBLE ELSE 1 END, 9) AS degree
FROM (VALUES ('1-'), ('1'), ('1+'), ('L-'), ('L'), ('L+')) r(regime), (VALUES ('exact'), ('monte_carlo')) s(sampler), range(10, 21) t(e)""",
    "spanning_forest": _with("order_part", _FOREST),
    "spanning_forest_distributed": _with("order_part", _FOREST),
    "mwoe_labels_distributed": _with("order_part_45", _LABELS + " SELECT id, comp FROM l"),
    "mwoe_phase_metrics": _with("order_part", _LEAST + ", d AS (SELECT DISTINCT lo, hi FROM m) SELECT (SELECT count(*) FROM d) AS picked, (SELECT count(*) FROM m) - (SELECT count(*) FROM d) AS components"),
    "cc_labels_distributed": _with("order_part_45", _LABELS + " SELECT id, comp FROM l"),
    "bfs_levels_distributed": _with("order_part", _LEVELS + " SELECT b.id, l.comp AS root, b.level FROM b JOIN l ON b.id = l.id"),
    "bfs_children": _with("order_part", _LEVELS + _PARENTS + " SELECT x.id, (SELECT count(*) FROM t WHERE t.parent = x.id AND t.id <> x.id) AS children FROM x"),
    "bfs_subtree": _with("customer_order", _LEVELS + _PARENTS + ", a(id, above) AS (SELECT id, id FROM t UNION SELECT a.id, t.parent FROM a JOIN t ON t.id = a.above) SELECT above AS id, count(*) AS subtree FROM a GROUP BY above"),
    "edges_sampled": f"SELECT u, v FROM (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM ({GRAPHS['part_supplier']}) WHERE u <> v) WHERE CAST('0x' || substr(md5(u || ' ' || v || ' 3'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < 0.25",
    "vertex_declarations": "SELECT range AS u, range AS v FROM range(1000)",
    "graph_dump": _with("nation_customer", "t AS (SELECT u, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY v) AS n FROM s GROUP BY u) SELECT id || ': ' || coalesce(n, '') AS value FROM x LEFT JOIN t ON u = id"),
    "labels_checked": "SELECT true AS right, 'ends of an edge agree' AS wrong",
    "summary_files": f"SELECT s.*, merging FROM ({_with('order_part', f'{_SIZES} {_STATS}')}) s, (VALUES (true), (false)) m(merging) UNION ALL SELECT s.*, merging FROM ({_with('nation_customer', f'{_SIZES} {_STATS}')}) s, (VALUES (true), (false)) m(merging)",
    "summary_roll_up": f"SELECT s.*, CAST(2 AS BIGINT) AS rows FROM ({_with('order_part', f'{_SIZES} {_STATS}')}) s UNION ALL SELECT s.*, CAST(2 AS BIGINT) AS rows FROM ({_with('nation_customer', f'{_SIZES} {_STATS}')}) s",
    "summary_scatter": f"WITH s AS (SELECT * FROM ({_with('order_part', f'{_SIZES} {_STATS}')}) UNION ALL SELECT * FROM ({_with('nation_customer', f'{_SIZES} {_STATS}')})) SELECT n AS x, y, of FROM (SELECT n, cm AS y, 'cm' AS of FROM s UNION ALL SELECT n, CAST(f AS DOUBLE), 'f' FROM s), range(2)",
    "first_lines_of_files": f"SELECT CAST(1 AS BIGINT) AS line, 'iC,nC' AS value FROM range(2) UNION ALL SELECT 2, (SELECT iC || ',' || nC FROM ({_with('nation_customer', _SIZES + ' SELECT iC, nC FROM c')}) ORDER BY iC LIMIT 1) UNION ALL SELECT 2, (SELECT iC || ',' || nC FROM ({_with('customer_order', _SIZES + ' SELECT iC, nC FROM c')}) ORDER BY iC LIMIT 1)",
    "experiment_roll_up": "SELECT sampler, regime, CAST(32 AS BIGINT) AS n, CAST(2 AS BIGINT) AS runs, true AS agree, true AS adds_up FROM (VALUES ('1'), ('L')) r(regime), (VALUES ('exact'), ('monte_carlo')) s(sampler)",
    "er_generate_lv": "SELECT CAST(4096 AS BIGINT) AS declared, CAST(4096 AS BIGINT) AS declarations, true AS in_order, true AS as_many_as_expected, true AS same_on_other_partitions, true AS all_distinct",
    "er_generate_mc": "SELECT CAST(4096 AS BIGINT) AS declared, CAST(4096 AS BIGINT) AS declarations, true AS in_order, true AS as_many_as_expected, true AS same_on_other_partitions, false AS all_distinct",
    "machine_hash": "SELECT CAST(o_orderkey AS BIGINT) AS v, CAST(((CAST(1234567890123456789 AS HUGEINT) * o_orderkey + 987654321987654321) % 2305843009213693951) % 32 AS BIGINT) AS machine FROM orders",
    "scaling_regression": """WITH p AS (SELECT o_custkey % 4 AS k, count(*) AS n, sum(o_totalprice) AS cost FROM orders GROUP BY o_custkey)
SELECT CAST(k AS BIGINT) AS k, count(*) AS points, round(regr_slope(cost, n), 3) AS slope, round(regr_intercept(cost, n), 3) AS intercept, round(regr_r2(cost, n), 3) AS r2,
round(regr_slope(ln(cost), ln(n)), 3) AS log_slope, round(regr_intercept(ln(cost), ln(n)), 3) AS log_intercept, round(regr_r2(ln(cost), ln(n)), 3) AS log_r2 FROM p GROUP BY k""",
    "text_parse": f"{_ROWS} (SELECT CAST(l_orderkey AS BIGINT) AS u, CAST(l_partkey AS BIGINT) AS v FROM lineitem WHERE l_linenumber % 7 <> 0) GROUP BY u, v",
    "ecg_roundtrip": f"{_ROWS} ({GRAPHS['order_part']}) GROUP BY u, v",
}
