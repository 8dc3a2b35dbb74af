"""Queries about files, identity, duplicates, sets and reconciliation, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import timeseries as ts
from tidewell.plans.catalog import ORACLES, register
from tidewell.plans.ledgers import table
from tidewell.plans.ticks import TICKS, ticks


@register("explode_items", "SELECT conv_id, turn, (i - 1)::INTEGER AS item, w AS word FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations))")
def explode_items(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("item", "word"))


ALL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@register("dedup_first_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ORDER)}) AS rn FROM lineitem) WHERE rn = 1")
def dedup_first_wins(spark, d):
    return ts.first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _ORDER]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("seq_conflict_classify", f"WITH c AS (SELECT *, row_number() OVER w AS rn, first_value(l_partkey) OVER w AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ORDER)})) SELECT CASE WHEN rn = 1 THEN 'first' WHEN l_partkey = f THEN 'exact_duplicate' ELSE 'sequence_conflict' END AS repeat_class, count(*) AS n FROM c GROUP BY 1")
def seq_conflict_classify(spark, d):
    c = ts.classify_repeats(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), [F.col(x) for x in _ORDER])
    return c.groupBy("repeat_class").agg(F.count("*").alias("n"))


@register("replica_collapse", "SELECT l_orderkey, l_linenumber, min(l_suppkey) AS first_supplier, count(*) AS n_occurrences, count(DISTINCT l_suppkey) AS n_routes FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def replica_collapse(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("first_supplier"), F.count("*").alias("n_occurrences"), F.countDistinct("l_suppkey").alias("n_routes")).where("n_occurrences > 1")


@register("row_fingerprint", "SELECT event_id, sha256(concat_ws('|', event_id, user_id, event_type, props)) AS row_id FROM events")
def row_fingerprint(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props"), 256).alias("row_id"))


@register("stream_digest", TICKS + "SELECT product, lvl, count(*) AS n, sha256(string_agg(sha256(concat_ws('|', seq, k)), chr(10) ORDER BY seq)) AS digest FROM t GROUP BY product, lvl")
def stream_digest(spark, d):
    """Ordered digest of each short stream: the sorted list of a group is one row, so groups are kept small (per level)."""
    h = F.struct("seq", F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.col("k").cast("string")), 256).alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(h)), lambda x: x["h"]), "\n")
    return ticks(spark, d).groupBy("product", "lvl").agg(F.count("*").alias("n"), F.sha2(text, 256).alias("digest"))


DERIVED = "WITH raw AS (SELECT l_suppkey AS dir, l_shipdate AS t, count(*) AS n FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2), der AS (SELECT l_suppkey AS dir, l_shipdate AS t, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2) "


def raw_and_derived(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("dir"), F.col("l_shipdate").alias("t"), "l_linenumber")
    part = lambda c: l.where(c).groupBy("dir", "t").agg(F.count("*").alias("n"))
    return part("l_linenumber < 3"), part("l_linenumber >= 3")


@register("coverage_prev_window", DERIVED + "SELECT CASE WHEN p.dir IS NOT NULL THEN 'previous_window' WHEN e.dir IS NOT NULL THEN 'exact' WHEN s.dir IS NOT NULL THEN 'same_directory' ELSE 'none' END AS coverage, count(*) AS n_files, sum(der.n)::BIGINT AS n_bytes FROM der LEFT JOIN raw p ON p.dir = der.dir AND p.t = der.t - INTERVAL 1 DAY LEFT JOIN raw e ON e.dir = der.dir AND e.t = der.t LEFT JOIN (SELECT DISTINCT dir FROM raw) s ON s.dir = der.dir GROUP BY 1")
def coverage_prev_window(spark, d):
    raw, der = raw_and_derived(spark, d)
    prev = raw.select("dir", (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("t"), F.lit(True).alias("prev"))
    exact, same = raw.select("dir", "t", F.lit(True).alias("exact")), raw.select("dir").distinct().withColumn("same", F.lit(True))
    j = der.join(prev, ["dir", "t"], "left").join(exact, ["dir", "t"], "left").join(same, ["dir"], "left")
    kind = F.when(F.col("prev"), "previous_window").when(F.col("exact"), "exact").when(F.col("same"), "same_directory").otherwise("none")
    return j.groupBy(kind.alias("coverage")).agg(F.count("*").alias("n_files"), F.sum("n").alias("n_bytes"))


@register("same_dir_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def same_dir_semi(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@register("stem_anti", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def stem_anti(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(l, "p_partkey", "left_anti").select("p_partkey", "p_name")


@register("same_stem_groups", "SELECT html_len, count(*) AS n FROM (SELECT strlen(html) // 1000 AS html_len FROM pages) GROUP BY 1 HAVING count(*) >= 2")
def same_stem_groups(spark, d):
    return table(spark, d, "pages").groupBy(F.floor(F.octet_length("html") / 1000).cast("long").alias("html_len")).agg(F.count("*").alias("n")).where("n >= 2")


@register("set_diffs", "WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_linenumber = 2) SELECT 'only_a' AS side, count(*) AS n FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a) UNION ALL SELECT 'both', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'distinct_a', count(*) FROM (SELECT DISTINCT k FROM a)")
def set_diffs(spark, d):
    l = table(spark, d, "lineitem")
    a, b = (l.where(F.col("l_linenumber") == i).select(F.col("l_partkey").alias("k")) for i in (1, 2))
    out = None
    for side, rows in (("only_a", a.exceptAll(b)), ("only_b", b.exceptAll(a)), ("both", a.intersect(b)), ("distinct_a", a.distinct())):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("duplicate_settings", "SELECT c_mktsegment AS setting, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_settings(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("setting")).agg(F.count("*").alias("n")).where("n > 1")


@register("storage_totals", "SELECT source, count(*) AS n_files, sum(n_chars)::BIGINT AS n_bytes FROM documents GROUP BY ROLLUP (source)")
def storage_totals(spark, d):
    return table(spark, d, "documents").rollup("source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_bytes"))


@register("file_boundary", TICKS + "SELECT lvl AS file, count(*) AS n_lines, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(product, seq) AS first_channel, arg_max(product, seq) AS last_channel, count(DISTINCT product) AS n_products FROM t GROUP BY lvl")
def file_boundary(spark, d):
    return ticks(spark, d).groupBy(F.col("lvl").alias("file")).agg(F.count("*").alias("n_lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("product", "seq").alias("first_channel"), F.max_by("product", "seq").alias("last_channel"), F.countDistinct("product").alias("n_products"))


@register("sampled_inventory", TICKS + ", r AS (SELECT *, row_number() OVER (PARTITION BY lvl ORDER BY seq) AS rn FROM t) SELECT lvl AS file, count(*) AS n_sampled, count(DISTINCT product) AS n_products, min(seq) AS first_seq, max(seq) AS last_seq FROM r WHERE rn <= 20 GROUP BY lvl")
def sampled_inventory(spark, d):
    """The inventory samples the first rows of each file by definition."""
    r = ticks(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("lvl").orderBy("seq"))).where("rn <= 20")
    return r.groupBy(F.col("lvl").alias("file")).agg(F.count("*").alias("n_sampled"), F.countDistinct("product").alias("n_products"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@register("epoch_reconciliation", "WITH m AS (SELECT o_orderkey, o_totalprice FROM orders), r AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(o_orderkey, l_orderkey) AS k, CASE WHEN o_orderkey IS NULL THEN 'undeclared' WHEN l_orderkey IS NULL THEN 'missing' WHEN abs(total - o_totalprice) <= 0.005 THEN 'equal' ELSE 'different' END AS status, coalesce(n, 0)::BIGINT AS n FROM m FULL JOIN r ON o_orderkey = l_orderkey")
def epoch_reconciliation(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n"))
    j = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(r, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    status = F.when(F.col("o_orderkey").isNull(), "undeclared").when(F.col("l_orderkey").isNull(), "missing").when(F.abs(F.col("total") - F.col("o_totalprice")) <= 0.005, "equal").otherwise("different")
    return j.select(F.coalesce("o_orderkey", "l_orderkey").alias("k"), status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("session_rollup", "SELECT c_nationkey AS session_key, n_name AS session, count(*) AS n_selected, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def session_rollup(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("session_key")).agg(F.count("*").alias("n_selected"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"))
    return c.join(table(spark, d, "nation"), F.col("session_key") == F.col("n_nationkey")).select("session_key", F.col("n_name").alias("session"), "n_selected", "total")


@register("union_interleave", TICKS + ", u AS (SELECT product, seq, 0 AS kind, price::DOUBLE AS v FROM t UNION ALL SELECT product, seq, 1, size::DOUBLE FROM t) SELECT product, row_number() OVER (PARTITION BY product ORDER BY seq, kind) AS pos, seq, kind::INTEGER AS kind, v FROM u")
def union_interleave(spark, d):
    """Every row of two interleaved streams, with its position in its product."""
    t = ticks(spark, d)
    u = t.select("product", "seq", F.lit(0).alias("kind"), F.col("price").cast("double").alias("v")).unionByName(t.select("product", "seq", F.lit(1).alias("kind"), F.col("size").cast("double").alias("v")))
    return u.withColumn("pos", F.row_number().over(Window.partitionBy("product").orderBy("seq", "kind")).cast("long")).select("product", "pos", "seq", "kind", "v")


register("union_interleave_all", ORACLES["union_interleave"])(union_interleave)  # its former name


@register("latest_n", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_n(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "value")
