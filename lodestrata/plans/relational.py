"""Queries: filters, joins, aggregates, windows, versioned relations, graph walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import graph, relations, tables
from lodestrata.operators.stored import scratch

from .registry import query, table


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT source, count(*) AS chunks, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS labelled, round(100.0 * count(l.doc_id) / count(*), 1)::DOUBLE AS labelled_pct, round(avg(n_chars), 6) AS avg_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def coverage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source and the share that has a label."""
    flagged = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(flagged, "doc_id", "left")
    pct = F.round((100 * F.count("has")).cast("decimal(20,0)") / F.count("*").cast("decimal(20,0)"), 1).cast("double")
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.count("has").alias("labelled"), pct.alias("labelled_pct"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def coverage_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1)))
    return pivoted.na.fill(0, ["en", "de", "fr", "es"])


@query("SELECT c.c_mktsegment, n.n_name FROM (SELECT DISTINCT c_mktsegment FROM customer) c CROSS JOIN (SELECT n_name FROM nation) n WHERE NOT EXISTS (SELECT 1 FROM customer x JOIN nation y ON x.c_nationkey = y.n_nationkey WHERE x.c_mktsegment = c.c_mktsegment AND y.n_name = n.n_name AND x.c_acctbal > 8000)")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments and nations without a customer of a balance above 8000."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer")
    present = customers.filter("c_acctbal > 8000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()
    return relations.coverage_gaps(customers.select("c_mktsegment").distinct(), nation.select("n_name"), present)


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def unnest_ordered_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer in order of date."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x.o_orderkey.cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(listed, ",").alias("orders"))


_BANDS = [("small", 1, 10), ("medium", 8, 25), ("large", 20, 50)]


@query("WITH b(band, lo, hi, n) AS (VALUES ('small', 1, 10, 1), ('medium', 8, 25, 2), ('large', 20, 50, 3)) SELECT p_partkey, arg_min(band, n) AS band FROM part LEFT JOIN b ON p_size BETWEEN lo AND hi GROUP BY p_partkey")
def range_join_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of some overlapping ranges that a size is in. The ranges are a fixed list, so the join is a nested loop over their broadcast."""
    bands = spark.createDataFrame([(*b, i) for i, b in enumerate(_BANDS)], "band string, lo int, hi int, n int")
    joined = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(F.broadcast(bands), F.col("p_size").between(F.col("lo"), F.col("hi")), "left")
    return joined.groupBy("p_partkey").agg(F.min_by("band", "n").alias("band"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events")
def asof_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the user's latest purchase at each event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(bought, ignorenulls=True).over(w).alias("last_purchase"))


@query("SELECT conv_id, turn, array_to_string(list(turn) OVER w, ',') AS neighbours FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(-1, 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(F.col("turn").cast("string")).over(w), ",").alias("neighbours"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':42'), doc_id) AS rn FROM documents) WHERE rn <= 10")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each source, by a seeded hash of the id."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("rn", F.row_number().over(w)).filter("rn <= 10").drop("rn")


@query("SELECT lang, median(n_chars)::DOUBLE AS median_chars, max(n_chars) AS longest FROM documents GROUP BY lang")
def median_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.median("n_chars").alias("median_chars"), F.max("n_chars").alias("longest"))


@query("SELECT role, count(*) AS n, count(DISTINCT lower(trim(text))) AS n_distinct FROM conversations GROUP BY role")
def distinct_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.trim("text"))).alias("n_distinct"))


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def sha256_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


_OLD_NEW = "new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0), old AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0)"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    new = orders.filter("o_orderkey % 13 <> 0").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority")
    return orders.filter("o_orderkey % 17 <> 0").select("o_orderkey", "o_orderstatus", "o_orderpriority"), new


@query(f"WITH {_OLD_NEW}, j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderkey IS NULL AS added, n.o_orderkey IS NULL AS removed, o.o_orderstatus IS DISTINCT FROM n.o_orderstatus AS s, o.o_orderpriority IS DISTINCT FROM n.o_orderpriority AS p FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey) SELECT o_orderkey, CASE WHEN added THEN 'ADDED' WHEN removed THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, CASE WHEN added OR removed THEN '' ELSE array_to_string(list_filter([CASE WHEN s THEN 'o_orderstatus' END, CASE WHEN p THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') END AS changed_fields FROM j WHERE added OR removed OR s OR p")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = relations.version_diff(*_versions(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return diff.withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(f"WITH {_OLD_NEW} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.upsert(*_versions(spark, sf_dir), ["o_orderkey"])


@query(f"WITH {_OLD_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.insert_if_absent(*_versions(spark, sf_dir), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_shipdate = max(l_shipdate) OVER (PARTITION BY l_orderkey) AS is_current FROM lineitem")
def latest_version_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.latest_flag(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], "l_shipdate")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT coalesce(CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'negative balance' WHEN NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), false) THEN 'segment' END, 'good') AS reject_reason, count(*) AS n FROM customer GROUP BY 1")
def reject_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"negative balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")}
    split = relations.split_rejects(table(spark, sf_dir, "customer"), checks)
    return split.groupBy(F.coalesce("reject_reason", F.lit("good")).alias("reject_reason")).agg(F.count("*").alias("n"))


@query("SELECT unnest(['has_text', 'has_lang', 'long_enough', 'known_lang']) AS \"check\", unnest([a, b, c, d]) AS n_failed, unnest([a, b, c, d]) = 0 AS passed FROM (SELECT count(*) FILTER (text IS NULL OR text = '') AS a, count(*) FILTER (lang IS NULL) AS b, count(*) FILTER (NOT coalesce(n_chars >= 20, false)) AS c, count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr', 'es'), false)) AS d FROM documents)")
def gate_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"has_text": F.col("text") != "", "has_lang": F.col("lang").isNotNull(), "long_enough": F.col("n_chars") >= 20, "known_lang": F.col("lang").isin("en", "de", "fr", "es")}
    return relations.gate(table(spark, sf_dir, "documents"), checks)


@query("SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer -> order, the last two optional."""
    nodes = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")}
    perCustomer = nodes["orders"].groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    customers = nodes["customer"].select("c_custkey", "c_nationkey").join(perCustomer, F.col("c_custkey") == F.col("o_custkey"), "left")
    byNation = customers.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))
    nations = nodes["nation"].join(nodes["region"], F.col("n_regionkey") == F.col("r_regionkey")).join(byNation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return nations.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


_EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("e", "f"), ("x", "y")]


@query("WITH RECURSIVE e(src, dst) AS (VALUES " + ", ".join(str(e) for e in _EDGES) + " UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), w AS (SELECT src AS start, dst AS node, 1 AS depth FROM e UNION SELECT w.start, e.dst, depth + 1 FROM w JOIN e ON w.node = e.src WHERE depth < 4) SELECT start, node, min(depth) AS depth FROM w GROUP BY ALL")
def graph_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node reaches in at most four steps: customers, nations and regions, and a graph with a cycle."""
    named = lambda c, a, k, b, v: table(spark, sf_dir, c).select(F.concat(F.lit(a), F.col(k).cast("string")).alias("src"), F.concat(F.lit(b), F.col(v).cast("string")).alias("dst"))
    edges = spark.createDataFrame(_EDGES, "src string, dst string").unionByName(named("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(named("nation", "n", "n_nationkey", "r", "n_regionkey"))
    return graph.reach(edges, 4)


_TYPED = [("a", "b", "S"), ("b", "c", "S"), ("a", "c", "T"), ("c", "d", "S"), ("d", "b", "T"), ("d", "e", "U"), ("e", "f", "S"), ("b", "d", "T"), ("b", "d", "S")]


@query("WITH RECURSIVE e(src, dst, type) AS (SELECT * FROM (VALUES " + ", ".join(str(e) for e in _TYPED) + ") WHERE true UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'S' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'T' FROM nation), w AS (SELECT src AS start, dst AS node, 1 AS depth, [src, dst] AS nodes, [type] AS types FROM e WHERE type <> 'U' UNION ALL SELECT w.start, e.dst, depth + 1, list_append(nodes, e.dst), list_append(types, e.type) FROM w JOIN e ON w.node = e.src WHERE depth < 4 AND e.type <> 'U'), p AS (SELECT start, node, arg_min({'n': nodes, 't': types}, {'d': depth, 'n': nodes, 't': types}) AS p, min(depth) AS depth FROM w GROUP BY ALL) SELECT start, node, depth, array_to_string(p.n, '>') AS nodes, array_to_string(p.t, '>') AS types FROM p")
def graph_typed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path over edges of two types to what each node reaches in at most four steps; of equal ones the first by its nodes and types."""
    named = lambda c, a, k, b, v, t: table(spark, sf_dir, c).select(F.concat(F.lit(a), F.col(k).cast("string")).alias("src"), F.concat(F.lit(b), F.col(v).cast("string")).alias("dst"), F.lit(t).alias("type"))
    edges = spark.createDataFrame(_TYPED, "src string, dst string, type string").unionByName(named("customer", "c", "c_custkey", "n", "c_nationkey", "S")).unionByName(named("nation", "n", "n_nationkey", "r", "n_regionkey", "T"))
    found = graph.shortest_paths(edges, 4, ["S", "T"])
    return found.select("start", "node", "depth", F.array_join("nodes", ">").alias("nodes"), F.array_join("types", ">").alias("types"))


@query("WITH d AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem), k AS (SELECT o_custkey, max(o_orderkey) AS last_order, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, coalesce(last_order, -1) AS last_order FROM customer LEFT JOIN k ON o_custkey = c_custkey UNION ALL SELECT o_custkey, last_order FROM k WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of customers into which the last order of each is merged in three batches, one of them twice."""
    path = scratch(spark, "merged")
    tables.create(table(spark, sf_dir, "customer").select("c_custkey", F.lit(-1).cast("bigint").alias("last_order")), path, ["c_custkey"], parts=16)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"))
    for batch in (0, 1, 1, 2):
        tables.merge(orders.filter(F.col("last_order") % 3 <= batch), path, ["c_custkey"], f"orders-{batch}", order=F.col("last_order"))
    return tables.read(spark, path)


@query("SELECT o_custkey, round(len(list_intersect(a, b)) / nullif(len(a), 0), 6) AS precision, round(len(list_intersect(a, b)) / nullif(len(b), 0), 6) AS recall FROM (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []) AS b FROM orders GROUP BY o_custkey)")
def set_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the priorities of a customer's open orders overlap with those of the finished ones."""
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))).alias(n) for s, n in (("O", "a"), ("F", "b"))))
    ratio = lambda c: F.when(F.size(c) > 0, F.round(F.size(F.array_intersect("a", "b")) / F.size(c), 6))
    return sets.select("o_custkey", ratio("a").alias("precision"), ratio("b").alias("recall"))
