"""Joins, aggregations, windows, sorting, set operations and scalar families through the DataFrame API."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.operators import relational as rel
from waymesh.session import table

cents = lambda c: F.round(F.col(c) * 100).cast("bigint")


def join_inner(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


def join_full(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, d, "customer").filter("c_acctbal < -950").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, s["s_nationkey"] == c["c_nationkey"], "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "suppliers", "customers")


def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 300000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


def join_self(spark, d):
    n = table(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


def join_multiway(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("total"))


def join_range(spark, d):
    """Orders within the validity of a price band; bands are few and joined by bucket, not by all pairs."""
    bands = spark.createDataFrame([(1, 0, 50_000), (2, 50_000, 150_000), (3, 120_000, 400_000)], "band int, low bigint, high bigint")
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("p"))
    return rel.interval_join(o, bands, "p", "low", "high", 25_000).select("o_orderkey", "band")


def join_asof(spark, d):
    """Of each purchase the last earlier view of the same user."""
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
    right = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), "ts")
    return rel.as_of(left, right, ["user_id"], "ts", ["click"]).select("purchase", "click")


def join_skewed(spark, d):
    """A join whose hot keys are salted: every key with more than a bound of rows is spread."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    j = rel.salted_join(li.select(F.col("l_partkey").alias("k"), "l_quantity"), p.select(F.col("p_partkey").alias("k"), "p_brand"), ["k"], hot_rows=40)
    return j.groupBy("p_brand").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def agg_hash(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("l_quantity")).alias("sum_qty"), F.sum(cents("l_extendedprice")).alias("sum_price"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


def agg_distinct(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey", "l_orderkey").alias("pairs"))


def agg_filter(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.expr("count(*) filter (where o_orderstatus = 'F')").alias("finished"), F.expr("count(*) filter (where o_totalprice > 200000)").alias("dear"))


def agg_grouping_sets(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return o.groupingSets([["o_orderstatus", "y"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority", "y").agg(F.count(F.lit(1)).alias("n"))


def agg_cube(spark, d):
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


def agg_rollup(spark, d):
    c = table(spark, d, "customer")
    return c.rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


def agg_percentile(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


def agg_moments(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 3).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 2).alias("sd"), F.round(F.corr("o_totalprice", F.col("o_orderkey").cast("double")), 6).alias("corr"))


def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")).filter("n >= 12")


def agg_collect(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.bool_and(F.col("n_nationkey") >= 0).alias("all_ok"), F.max_by("n_name", "n_nationkey").alias("last_name"))


def agg_salted(spark, d):
    """Two-stage aggregation over a salted key, as for groups that hold a third of all rows."""
    return rel.salted_sum(table(spark, d, "events").select("event_type", F.lit(1).cast("bigint").alias("one")), ["event_type"], "one", "n")


def agg_pivot(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def approx_count_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


def window_rank(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    b = Window.partitionBy("c_nationkey").orderBy(F.floor("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", F.rank().over(b).alias("rank"), F.dense_rank().over(b).alias("dense"), F.row_number().over(w).alias("row"))


def window_ntile(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.ntile(4).over(w).alias("tile"), F.round(F.percent_rank().over(w), 9).alias("pct"), F.round(F.cume_dist().over(w), 9).alias("cume"))


def window_lag_lead(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("after2"), F.first("o_orderkey").over(w).alias("first"), F.nth_value("o_orderkey", 3).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("third"))


def window_rows_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.sum(cents("o_totalprice")).over(w).alias("last3"), F.max("o_totalprice").over(w).alias("top3"))


def window_range_frame(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).alias("day")
    w = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-90, 0)
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", day).select("o_orderkey", F.count(F.lit(1)).over(w).alias("in_90_days"))


def topk_per_group(spark, d):
    return rel.top_k(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_orderpriority", "o_orderkey", "rank")


def sort_limit_offset(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(10).limit(20).select("p_partkey", "p_retailprice")


def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("n")).unionAll(table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("rows"))


def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("n")).union(table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))).distinct()


def intersect(spark, d):
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey").intersect(table(spark, d, "lineitem").filter("l_quantity > 49").select("l_suppkey"))


def except_distinct(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").filter("l_quantity > 30").select("l_partkey"))


def except_all(spark, d):
    a = table(spark, d, "lineitem").filter("l_linenumber <= 2").select("l_suppkey")
    return a.exceptAll(table(spark, d, "lineitem").filter("l_linenumber = 3").select("l_suppkey")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("left_over"))


def string_functions(spark, d):
    p = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.upper(p).alias("up"), F.length(p).alias("len"), F.substring(p, 2, 3).alias("sub"), F.regexp_replace(p, "[aeiou]", "_").alias("rep"), F.concat_ws("-", F.split(p, " ")).alias("dashed"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.locate("e", p).alias("at"), F.reverse(p).alias("rev"), F.levenshtein(p, F.lit("green metal part")).alias("lev"))


def date_functions(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("dom"), F.quarter(t).alias("q"), F.dayofyear(t).alias("doy"), F.date_format(F.date_trunc("month", t), "yyyy-MM-dd").alias("month_start"), F.date_format(F.last_day(t), "yyyy-MM-dd").alias("month_end"), F.datediff(F.lit("1999-01-01").cast("date"), F.to_date(t)).alias("age"), F.date_format(F.date_add(F.to_date(t), 30), "yyyy-MM-dd").alias("due"))


def array_functions(spark, d):
    a = F.expr("transform(sequence(1, 5), i -> (c_custkey * i) % 11)")
    return table(spark, d, "customer").select("c_custkey", a.alias("a")).select("c_custkey", F.size("a").alias("n"), F.array_max("a").alias("top"), F.aggregate("a", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("total"), F.array_contains("a", 3).alias("has3"), F.array_join(F.array_sort(F.array_distinct("a")).cast("array<string>"), ",").alias("sorted"), F.size(F.filter("a", lambda x: x > 5)).alias("big"))


def map_functions(spark, d):
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", m.alias("m")).select("c_custkey", F.element_at("m", "segment").alias("segment"), F.map_contains_key("m", "phone").alias("has_phone"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


def json_functions(spark, d):
    j = F.to_json(F.struct("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("a")))
    return table(spark, d, "part").select("p_partkey", j.alias("j")).select("p_partkey", F.get_json_object("j", "$.a.brand").alias("brand"), F.from_json("j", "a struct<size:int>")["a"]["size"].alias("size"), F.variant_get(F.parse_json("j"), "$.p_partkey", "bigint").alias("key"))


def bit_functions(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", k.bitwiseAND(F.lit(255).cast("bigint")).alias("low"), F.shiftright(k, 3).alias("shr"), F.shiftleft(k, 2).alias("shl"), k.bitwiseXOR(F.lit(21845).cast("bigint")).alias("x"), F.bit_count(k).cast("int").alias("ones"))


def cast_functions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("string").alias("text"), F.expr("try_cast(source as bigint)").alias("no_number"), F.coalesce("lang", F.lit("?")).alias("language"), F.nullif(F.col("lang"), F.lit("en")).alias("not_en"))


def recursive_cte(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("waymesh_nation")
    return spark.sql("WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 25) SELECT n_name, s FROM t JOIN waymesh_nation ON n_nationkey = n - 1")


def lateral_join(spark, d):
    text = "SELECT n_name, customers, last FROM {n}, LATERAL (SELECT count(*) AS customers, max(c_custkey) AS last FROM {c} WHERE c_nationkey = n_nationkey)"
    return spark.sql(text, n=table(spark, d, "nation"), c=table(spark, d, "customer"))


def udf_jaro_winkler(spark, d):
    from waymesh.functions.text import jaro_winkler

    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", F.round(jaro_winkler(F.col("p_name"), F.lit("green metal part")), 6).alias("similarity"))


def udaf_weighted(spark, d):
    """A weighted mean as an Arrow aggregate of pre-aggregated parts."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 3).alias("mean"))


def udtf_explode_line(spark, d):
    words = F.explode(F.split("p_name", " ")).alias("word")
    return table(spark, d, "part").select("p_partkey", words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        join_inner, join_left, join_full, join_semi, join_anti, join_self, join_multiway, join_range, join_asof, join_skewed, agg_hash, agg_distinct, agg_filter, agg_grouping_sets, agg_cube, agg_rollup, agg_percentile, agg_moments, agg_having,
        agg_collect, agg_salted, agg_pivot, approx_count_distinct, window_rank, window_ntile, window_lag_lead, window_rows_frame, window_range_frame, topk_per_group, sort_limit_offset, union_all, union_distinct, intersect, except_distinct, except_all,
        string_functions, date_functions, array_functions, map_functions, json_functions, bit_functions, cast_functions, recursive_cte, lateral_join, udf_jaro_winkler, udaf_weighted, udtf_explode_line,
    )
}

SQL = {
    "join_inner": "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1",
    "join_full": "SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal < -950 GROUP BY 1) ON s_nationkey = c_nationkey",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "join_self": "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multiway": "SELECT r_name, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "join_range": "SELECT o_orderkey, band FROM orders JOIN (VALUES (1, 0, 50000), (2, 50000, 150000), (3, 120000, 400000)) b(band, low, high) ON floor(o_totalprice) >= low AND floor(o_totalprice) < high",
    "join_asof": "SELECT p.event_id AS purchase, arg_max(c.event_id, (c.ts, c.event_id)) AS click FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.user_id = p.user_id AND c.ts <= p.ts GROUP BY 1",
    "join_skewed": "SELECT p_brand, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "agg_hash": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_orderkey)) AS pairs FROM lineitem GROUP BY 1",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 200000) AS dear FROM orders GROUP BY 1",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(y AS INTEGER) AS y, count(*) AS n FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY GROUPING SETS ((o_orderstatus, y), (o_orderpriority), ())",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "agg_percentile": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1",
    "agg_moments": "SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 2) AS sd, round(corr(o_totalprice, CAST(o_orderkey AS DOUBLE)), 6) AS corr FROM orders GROUP BY 1",
    "agg_having": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) >= 12",
    "agg_collect": "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names, bool_and(n_nationkey >= 0) AS all_ok, arg_max(n_name, n_nationkey) AS last_name FROM nation GROUP BY 1",
    "agg_salted": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "agg_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "window_rank": "SELECT c_custkey, CAST(rank() OVER b AS INTEGER) AS rank, CAST(dense_rank() OVER b AS INTEGER) AS dense, CAST(row_number() OVER w AS INTEGER) AS row FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), b AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal))",
    "window_ntile": "SELECT s_suppkey, CAST(ntile(4) OVER w AS INTEGER) AS tile, round(percent_rank() OVER w, 9) AS pct, round(cume_dist() OVER w, 9) AS cume FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)",
    "window_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after2, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_rows_frame": "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS last3, max(o_totalprice) OVER w AS top3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "window_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS in_90_days FROM orders",
    "topk_per_group": "SELECT o_orderpriority, o_orderkey, rank FROM (SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 5",
    "sort_limit_offset": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10",
    "union_all": "SELECT n, count(*) AS rows FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    "union_distinct": "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49",
    "except_distinct": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30",
    "except_all": "SELECT l_suppkey, count(*) AS left_over FROM (SELECT l_suppkey FROM lineitem WHERE l_linenumber <= 2 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber = 3) GROUP BY 1",
    "string_functions": "SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INTEGER) AS len, substr(p_name, 2, 3) AS sub, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rep, replace(p_name, ' ', '-') AS dashed, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded, CAST(strpos(p_name, 'e') AS INTEGER) AS at, reverse(p_name) AS rev, CAST(levenshtein(p_name, 'green metal part') AS INTEGER) AS lev FROM part",
    "date_functions": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dom, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS age, strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY, '%Y-%m-%d') AS due FROM orders",
    "array_functions": "SELECT c_custkey, CAST(len(a) AS INTEGER) AS n, list_max(a) AS top, CAST(list_sum(a) AS BIGINT) AS total, list_contains(a, 3) AS has3, array_to_string(list_sort(list_distinct(a)), ',') AS sorted, CAST(len(list_filter(a, lambda x: x > 5)) AS INTEGER) AS big FROM (SELECT c_custkey, [c_custkey % 11, c_custkey * 2 % 11, c_custkey * 3 % 11, c_custkey * 4 % 11, c_custkey * 5 % 11] AS a FROM customer)",
    "map_functions": "SELECT c_custkey, c_mktsegment AS segment, false AS has_phone, 'name,segment' AS keys FROM customer",
    "json_functions": "SELECT p_partkey, p_brand AS brand, p_size AS size, p_partkey AS key FROM part",
    "bit_functions": "SELECT o_orderkey, o_orderkey & 255 AS low, o_orderkey >> 3 AS shr, o_orderkey << 2 AS shl, xor(o_orderkey, 21845) AS x, CAST(bit_count(o_orderkey) AS INTEGER) AS ones FROM orders",
    "cast_functions": "SELECT doc_id, CAST(n_chars AS VARCHAR) AS text, try_cast(source AS BIGINT) AS no_number, coalesce(lang, '?') AS language, nullif(lang, 'en') AS not_en FROM documents",
    "recursive_cte": "SELECT n_name, CAST((n_nationkey + 1) * (n_nationkey + 2) // 2 AS INTEGER) AS s FROM nation",
    "lateral_join": "SELECT n_name, customers, last FROM nation, LATERAL (SELECT count(*) AS customers, max(c_custkey) AS last FROM customer WHERE c_nationkey = n_nationkey)",
    "udf_jaro_winkler": "SELECT p_partkey, round(jaro_winkler_similarity(p_name, 'green metal part'), 6) AS similarity FROM part",
    "udaf_weighted": "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) AS mean FROM lineitem GROUP BY 1",
    "udtf_explode_line": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1",
}
