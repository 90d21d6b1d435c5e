"""Queries of checks, results, graphs, task sources. Events are tasks and results, customers the nodes of call trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as p
from ..operators import graph as g
from ..operators import results as b
from ..sources import tasks as t
from .registry import read, register, scratch

# -- results -----------------------------------------------------------------------------------------------------


def result_events(s: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", b.MIGRATED).when(F.col("event_type") == "purchase", b.FROZEN).otherwise(0)
    return read(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("app"), F.floor("value").alias("id"), code.alias("return_value"), F.concat(F.lit("h"), F.col("event_id") % 9).alias("host"))


EVENTS = """e AS (SELECT event_id AS seq, user_id AS app, floor(value)::BIGINT AS id, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN -99 WHEN 'purchase' THEN -98 ELSE 0 END AS return_value, 'h' || event_id % 9 AS host FROM events)"""
RESULTS = f"{EVENTS}, r AS (SELECT app, id, max(seq) AS seq, arg_max(return_value, seq) AS return_value, arg_max(host, seq) AS host, min(seq) AS released FROM e WHERE return_value NOT IN (-99, -98) GROUP BY app, id)"
register("b01_result_table", lambda s, d: b.result_table(result_events(s, d))[0], f"WITH {RESULTS} SELECT app, id, seq, return_value, host, released FROM r")
register("b01_frozen_results", lambda s, d: b.result_table(result_events(s, d))[1], f"WITH {EVENTS} SELECT app, id, max(seq) AS seq, return_value, arg_max(host, seq) AS host FROM e WHERE return_value = -98 GROUP BY app, id, return_value")


def tasks(s: SparkSession, d: str) -> DataFrame:
    """Tasks of the events; each third number stands for one that has no result yet."""
    late = F.when(F.col("id") % 3 == 0, F.col("id") + 1_000_000).otherwise(F.col("id"))
    return result_events(s, d).withColumn("id", late).groupBy("app", "id").agg(F.min("seq").alias("pos"), F.min("host").alias("host"))


def _results(s: SparkSession, d: str) -> DataFrame:
    return b.result_table(result_events(s, d))[0]


def _asked(s: SparkSession, d: str) -> DataFrame:
    """All apps, and some that are unknown."""
    return read(s, d, "events").select((F.col("user_id") + F.when(F.col("event_type") == "signup", 1_000_000).otherwise(0)).alias("app")).distinct()


TASKS = f"{RESULTS}, t AS (SELECT app, CASE WHEN e.id % 3 = 0 THEN e.id + 1000000 ELSE e.id END AS id, min(seq) AS pos, min(host) AS host FROM e GROUP BY ALL)"
register("b02_batch_status", lambda s, d: b.batch_status(_asked(s, d), tasks(s, d), _results(s, d)).withColumn("results", F.to_json("results")), f"""
WITH {TASKS}, x AS (SELECT app, count(*) AS expected, count(return_value) AS done, '[' || coalesce(string_agg('{{"id":' || id || ',"return_value":' || return_value || '}}', ',' ORDER BY id) FILTER (WHERE return_value IS NOT NULL), '') || ']' AS results
  FROM t LEFT JOIN r USING (app, id) GROUP BY app)
SELECT a.app, done = expected AS finished, expected, done, results FROM (SELECT DISTINCT user_id + CASE WHEN event_type = 'signup' THEN 1000000 ELSE 0 END AS app FROM events) a LEFT JOIN x USING (app)""")
register("b03_finished_counts", lambda s, d: b.finished_counts(result_events(s, d)), f"WITH {EVENTS} SELECT app, count(*) FILTER (WHERE return_value <> -99) AS finished FROM e GROUP BY app")


def _open(s: SparkSession, d: str) -> DataFrame:
    return tasks(s, d).withColumns({"subtype": (F.col("app") % 4).cast("int"), "world_size": F.when(F.col("app") % 3 == 0, 8).otherwise(0), "threads": F.when(F.col("app") % 3 == 1, 4).otherwise(0)})


register("b04_in_flight", lambda s, d: b.in_flight(_open(s, d), _results(s, d)).withColumn("hosts", F.array_join("hosts", ",")), f"""
WITH {TASKS}, o AS (SELECT t.* FROM t LEFT JOIN r USING (app, id) WHERE r.app IS NULL)
SELECT app, (app % 4)::INT AS subtype, CASE app % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE count(*) END::BIGINT AS size, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM o GROUP BY app""")


def _frozen_too(s: SparkSession, d: str) -> DataFrame:
    """Result events of smaller apps (one a user and number), so that some are frozen as a whole."""
    return result_events(s, d).withColumn("app", F.col("app") * 1000 + F.col("id"))


def b04_flight_report(s: SparkSession, d: str) -> DataFrame:
    events = _frozen_too(s, d)
    work = events.select("app", (F.col("id") + F.col("seq") % 2).alias("id"), "host").distinct()
    work = work.withColumns({"subtype": (F.col("app") % 4).cast("int"), "world_size": F.when(F.col("app") % 3 == 0, 8).otherwise(0), "threads": F.when(F.col("app") % 3 == 1, 4).otherwise(0)})
    return b.flight_report(work, b.result_table(events)[0], events).withColumn("hosts", F.array_join("hosts", ","))


register("b04_flight_report", b04_flight_report, f"""
WITH {EVENTS}, v AS (SELECT seq, app * 1000 + id AS app, id, return_value, host FROM e), w AS (SELECT DISTINCT app, id + seq % 2 AS id, host FROM v),
z AS (SELECT app FROM v GROUP BY app HAVING bool_and(return_value = -98) OR arg_max(return_value, seq) = -98), mv AS (SELECT app, count(*) AS migrations FROM v WHERE return_value = -99 GROUP BY app),
done AS (SELECT DISTINCT app, id FROM v WHERE return_value NOT IN (-99, -98)),
fl AS (SELECT app, 'in flight' AS state, (app % 4)::INT AS subtype, CASE app % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE count(*) END::BIGINT AS size, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts
       FROM w WHERE app NOT IN (SELECT app FROM z) AND NOT EXISTS (SELECT 1 FROM done WHERE done.app = w.app AND done.id = w.id) GROUP BY app),
fz AS (SELECT app, 'frozen' AS state, NULL::INT AS subtype, CASE WHEN app % 3 = 0 THEN 8 END::BIGINT AS size, NULL::VARCHAR AS hosts FROM w WHERE app IN (SELECT app FROM z) GROUP BY app)
SELECT x.*, coalesce(migrations, 0) AS migrations FROM (SELECT * FROM fl UNION ALL SELECT * FROM fz) x LEFT JOIN mv USING (app)""")
register("b05_notify_waiters", lambda s, d: b.notify_waiters(tasks(s, d).select("app", "id", F.concat(F.lit("w"), F.col("pos") % 5).alias("waiter")), _results(s, d)), f"WITH {TASKS} SELECT app, id, 'w' || pos % 5 AS waiter, return_value FROM t LEFT JOIN r USING (app, id)")
register("b06_thread_results", lambda s, d: b.thread_results(tasks(s, d), _results(s, d)), f"WITH {TASKS} SELECT app, pos, id, return_value FROM t LEFT JOIN r USING (app, id)")
register("b07_frozen_apps", lambda s, d: b.frozen_apps(result_events(s, d).withColumn("app", F.col("app") * 1000 + F.col("id"))), f"WITH {EVENTS} SELECT app * 1000 + id AS app FROM e GROUP BY app * 1000 + id, app, id HAVING arg_max(return_value, seq) = -98")


def _claims(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").filter(F.col("event_type").isin("view", "click")).select((F.col("user_id") % 40).alias("host"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", 1).otherwise(-1).alias("slots"))


register("b08_slot_accounts", lambda s, d: b.slot_accounts(_claims(s, d), s.range(40).select(F.col("id").alias("host"), (F.col("id") % 6).alias("slots"))), """
WITH u AS (SELECT user_id % 40 AS host, event_id AS seq, (sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id % 40 ORDER BY event_id))::BIGINT AS used FROM events WHERE event_type IN ('view', 'click'))
SELECT host, seq, used, used > host % 6 OR used < 0 AS violation FROM u""")

# -- graphs ------------------------------------------------------------------------------------------------------


def calls(s: SparkSession, d: str) -> DataFrame:
    """Five call trees over customers: app = key mod 5, local number = key div 5, parent = local number div 4."""
    c = read(s, d, "customer").select(F.col("c_custkey").alias("k")).filter("k >= 5")
    return c.select((F.col("k") % 5).alias("app"), (F.expr("(k div 5) div 4") * 5 + F.col("k") % 5).alias("parent_id"), F.col("k").alias("child_id"))


def node_results(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("app"))
    # One task has reported under a wrong id.
    wrong = F.when((F.col("app") == 3) & (F.expr("id div 5") == 7), -F.col("id")).otherwise(F.col("id"))
    return c.withColumns({"id": wrong, "host": F.concat(F.lit("h"), F.col("id") % 7), "rank": F.expr("id div 5") % 16, "return_value": F.when(F.expr("id div 5") % 5 == 0, b.MIGRATED).when(F.expr("id div 5") % 11 == 0, 1).otherwise(0)})


def _roots(s: SparkSession) -> DataFrame:
    return s.range(5).select(F.col("id").alias("app"), F.col("id").alias("root"))


def _trees(s: SparkSession, d: str) -> DataFrame:
    return g.call_trees(_roots(s), calls(s, d), node_results(s, d))


TREE = """RECURSIVE x AS (SELECT k % 5 AS app, k AS id, NULL::BIGINT AS parent_id, 0 AS level, ''::VARCHAR AS path FROM range(5) r(k)
  UNION ALL SELECT x.app, c.c_custkey, x.id, level + 1, path || lpad(((c.c_custkey // 5) % 4)::VARCHAR, 2, '0') FROM x JOIN customer c ON c.c_custkey >= 5 AND c.c_custkey % 5 = x.app AND c.c_custkey // 5 // 4 * 5 + c.c_custkey % 5 = x.id),
n AS (SELECT app, app AS root, id, parent_id, level, path, 'h' || id % 7 AS host, (id // 5) % 16 AS rank, CASE WHEN (id // 5) % 5 = 0 THEN -99 WHEN (id // 5) % 11 = 0 THEN 1 ELSE 0 END AS return_value FROM x WHERE app <> 3)"""
register("g01_call_trees", lambda s, d: _trees(s, d).select("app", "root", "id", "parent_id", "level"), f"WITH {TREE} SELECT app, root, id, parent_id, level FROM n")
register("g02_node_counts", lambda s, d: g.node_counts(_roots(s), _trees(s, d)), f"WITH {TREE} SELECT app, root, count(*) AS nodes FROM n GROUP BY ALL UNION ALL SELECT 3, 3, 1")
register("g03_tree_hosts", lambda s, d: g.tree_hosts(_trees(s, d), node_results(s, d)).withColumn("hosts", F.array_join("hosts", ",")), f"WITH {TREE} SELECT app, root, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM n GROUP BY app, root")
register("g04_rank_hosts", lambda s, d: g.rank_hosts(_trees(s, d), node_results(s, d)), f"WITH {TREE} SELECT app, root, rank, arg_max(host, path) AS host FROM n GROUP BY ALL")
register("g05_migrated_rank_hosts", lambda s, d: g.migrated_rank_hosts(_trees(s, d), node_results(s, d))[0], f"""WITH {TREE} SELECT app, root, rank,
  coalesce(arg_max(host, (level, path)) FILTER (WHERE return_value = -99), arg_min(host, (level, path)) FILTER (WHERE return_value = 0)) AS before, arg_max(host, (level, path)) FILTER (WHERE return_value = 0) AS after FROM n WHERE return_value IN (0, -99) GROUP BY ALL""")
register("g05_migrated_rejects", lambda s, d: g.migrated_rank_hosts(_trees(s, d), node_results(s, d))[1], f"WITH {TREE} SELECT app, root, id, return_value FROM n WHERE return_value NOT IN (0, -99)")


def _known(s: SparkSession, d: str) -> DataFrame:
    """Tasks under their ids, but for every 13th."""
    return node_results(s, d).withColumn("id", F.when(F.col("id") % 13 == 0, -F.col("id")).otherwise(F.col("id")))


def _doubled(s: SparkSession, d: str) -> DataFrame:
    return calls(s, d).unionByName(calls(s, d).filter("child_id % 17 = 0"))


register("g06_children", lambda s, d: g.children(_doubled(s, d), _known(s, d))[0].withColumn("children", F.array_join("children", ",")), """
SELECT c_custkey % 5 AS app, c_custkey // 5 // 4 * 5 + c_custkey % 5 AS parent_id, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS children FROM customer
WHERE c_custkey >= 5 AND c_custkey % 13 > 0 AND NOT (c_custkey % 5 = 3 AND c_custkey // 5 = 7) GROUP BY ALL""")
register("g06_child_rejects", lambda s, d: g.children(_doubled(s, d), _known(s, d))[1], """
WITH c AS (SELECT c_custkey % 5 AS app, c_custkey // 5 // 4 * 5 + c_custkey % 5 AS parent_id, c_custkey AS child_id FROM customer WHERE c_custkey >= 5)
SELECT *, 'duplicate' AS reason FROM c WHERE child_id % 17 = 0 UNION ALL SELECT *, 'unknown' FROM c WHERE child_id % 13 = 0 OR (app = 3 AND child_id // 5 = 7)""")


def _details(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.col("user_id").alias("app"), (F.col("event_id") % 3).alias("id"), F.col("event_id").alias("seq"), (F.col("user_id") % 2 == 0).alias("recording"), F.col("event_type").alias("key"),
                                       F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("str_value"), F.floor("value").cast("int").alias("int_value"))


register("g07_details", lambda s, d: g.details(_details(s, d)).select("app", "id", F.explode("counters").alias("key", "total"), F.col("strings")).select("app", "id", "key", "total", F.element_at("strings", F.col("key")).alias("last")), """
SELECT user_id AS app, event_id % 3 AS id, event_type AS key, sum(floor(value))::BIGINT AS total, arg_max(props, event_id) FILTER (WHERE event_id % 2 = 0) AS last FROM events WHERE user_id % 2 = 0 GROUP BY ALL""")
register("g08_message_matrix", lambda s, d: g.message_matrix(read(s, d, "events").select(F.lit("w").alias("world"), (F.col("user_id") % 6).alias("src"), (F.col("event_id") % 6).alias("dst"), F.col("event_type").alias("type")), ["click", "error", "view"]), """
SELECT 'w' AS world, user_id % 6 AS src, event_id % 6 AS dst, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view,
  count(*) FILTER (WHERE event_type IN ('click', 'error', 'view')) AS total FROM events GROUP BY ALL""")


def _chains(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as chains: turn n called turn n + 1."""
    c = read(s, d, "conversations").select(F.col("conv_id").alias("app"), (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.col("turn"), F.col("role").alias("host"), F.lit(0).alias("return_value"))
    edges = c.filter("turn > 0").select("app", (F.col("id") - 1).alias("parent_id"), F.col("id").alias("child_id"))
    return c.filter("turn = 0").select("app", F.col("id").alias("root")), edges, c.drop("turn")


def s07_tree_json(s: SparkSession, d: str) -> DataFrame:
    roots, edges, found = _chains(s, d)
    return g.tree_json(g.call_trees(roots, edges, found), found)


register("s07_tree_json", s07_tree_json, """
WITH c AS (SELECT conv_id AS app, turn, '{"msg":{"id":' || (conv_id * 1000000 + turn) || ',"host":"' || role || '","return_value":0}' AS m FROM conversations)
SELECT app, app * 1000000 AS root, string_agg(m, ',"chained":[' ORDER BY turn) || '}' || repeat(']}', (count(*) - 1)::INT) AS json FROM c GROUP BY app""")

# -- task sources ------------------------------------------------------------------------------------------------


def _lines(s: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.col("event_id").cast("int").alias("id"), F.col("event_type").alias("function"), F.lit("demo").alias("user"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ts"))
    rows = read(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("messages"))
    text = F.to_json(F.struct(F.col("user_id").alias("appId"), F.lit("demo").alias("user"), F.lit("echo").alias("function"), "messages"))
    return rows.select(F.when(F.col("user_id") % 10 == 0, F.substring(text, 1, 100)).otherwise(text).alias("value"))


register("s01_read_json_batches", lambda s, d: t.parse_batches(_lines(s, d))[0].select("app", "batch_user", "pos", "id", "function", "start_ts"),
         "SELECT user_id::INT AS app, 'demo' AS batch_user, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, event_id::INT AS id, event_type AS function, (epoch_us(ts) // 1000) AS start_ts FROM events WHERE user_id % 10 > 0")
register("s01_json_rejects", lambda s, d: t.parse_batches(_lines(s, d))[1].select(F.length("value").cast("long").alias("n")), "SELECT 100::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0)")


def s01_read_files(s: SparkSession, d: str) -> DataFrame:
    """The batches as files: one request a line."""
    at = scratch(s, "batches")
    _lines(s, d).write.text(at)
    return t.read_batches(s, at)[0].select("app", "batch_user", "pos", "id", "function", "start_ts")


register("s01_read_files", s01_read_files,
         "SELECT user_id::INT AS app, 'demo' AS batch_user, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, event_id::INT AS id, event_type AS function, (epoch_us(ts) // 1000) AS start_ts FROM events WHERE user_id % 10 > 0")


def s02_write_json(s: SparkSession, d: str) -> DataFrame:
    """The messages through the sink, as the lines that stand in its files."""
    at = scratch(s, "json")
    t.write_json(read(s, d, "events").select(F.col("event_id").alias("id"), F.lit(0).alias("type"), F.col("event_type").alias("input_data"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ts")), at)
    return s.read.text(at).select(F.get_json_object("value", "$.id").cast("long").alias("event_id"), F.col("value").alias("json"))


register("s02_write_json", s02_write_json,
         """SELECT event_id, '{"id":' || event_id || ',"type":0,"input_data":"' || event_type || '","start_ts":' || (epoch_us(ts) // 1000) || '}' AS json FROM events""")


def _occupancy(s: SparkSession, d: str) -> DataFrame:
    app = lambda k: F.when(F.col("s_suppkey") % (k + 2) == 0, -1).otherwise((F.col("s_suppkey") + k) % 9).cast("string")
    slots = F.slice(F.array(*[app(k) for k in range(4)]), F.lit(1), (F.col("s_suppkey") % 5).cast("int"))
    lines = read(s, d, "supplier").select(F.col("s_nationkey").alias("file"), F.struct("s_suppkey", F.concat_ws(",", "s_name", slots).alias("line")).alias("x"))
    return lines.groupBy("file").agg(F.concat(F.lit("WorkerIp,Slots\n"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda v: v["line"]), "\n")).alias("value"))


SLOTS = """o AS (SELECT s_nationkey AS file, s_suppkey AS k, s_name AS host, i, CASE WHEN s_suppkey % (i + 2) = 0 THEN -1 ELSE (s_suppkey + i) % 9 END AS app FROM supplier LEFT JOIN range(4) t(i) ON i < s_suppkey % 5)"""
register("s03_occupancy_hosts", lambda s, d: t.parse_occupancy(_occupancy(s, d))[0], f"WITH {SLOTS} SELECT file, host, count(i) AS slots, count(*) FILTER (WHERE i IS NOT NULL AND app <> -1) AS used FROM o GROUP BY ALL")
register("s03_occupancy_placements", lambda s, d: t.parse_occupancy(_occupancy(s, d))[1], f"WITH {SLOTS} SELECT file, app::INT AS app, (row_number() OVER (PARTITION BY file, app ORDER BY k, i) - 1)::INT AS pos, host FROM o WHERE i IS NOT NULL AND app <> -1")


def _occupancy_files(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The occupancy files as files."""
    at = scratch(s, "occupancy")
    _occupancy(s, d).write.partitionBy("file").text(at)
    return tuple(x.withColumn("file", F.regexp_extract("file", "file=([0-9]+)", 1).cast("int")) for x in t.read_occupancy(s, f"{at}/file=*"))


register("s03_read_occupancy", lambda s, d: _occupancy_files(s, d)[0], f"WITH {SLOTS} SELECT file::INT AS file, host, count(i) AS slots, count(*) FILTER (WHERE i IS NOT NULL AND app <> -1) AS used FROM o GROUP BY ALL")
register("s03_read_placements", lambda s, d: _occupancy_files(s, d)[1], f"WITH {SLOTS} SELECT file::INT AS file, app::INT AS app, (row_number() OVER (PARTITION BY file, app ORDER BY k, i) - 1)::INT AS pos, host FROM o WHERE i IS NOT NULL AND app <> -1")
register("s04_generate_tasks", lambda s, d: t.generate_tasks(read(s, d, "nation").select(F.col("n_nationkey").alias("app"), F.lit("demo").alias("user"), F.col("n_name").alias("function"), (F.col("n_nationkey") % 6).alias("count"))),
         "SELECT n_nationkey AS app, i::INT AS app_idx, 'demo' AS user, n_name AS function FROM nation, range(5) t(i) WHERE i < n_nationkey % 6")

# -- checks ------------------------------------------------------------------------------------------------------


def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(s, d, "events").withColumn("app", F.col("event_id") % 2000)
    heads = s.range(2100).select(F.col("id").alias("app"), F.when(F.col("id") % 50 == 0, "").otherwise("demo").alias("user"), F.lit("echo").alias("function"))
    rows = e.select("app", F.col("event_id").alias("id"), F.when(F.col("event_id") % 101 == 0, "other").otherwise("demo").alias("user"), F.when(F.col("event_id") % 103 == 0, "").otherwise(F.col("event_type")).alias("function"),
                    F.when(F.col("event_id") % 107 == 0, -1).otherwise(F.col("app")).alias("task_app"))
    return heads, rows


register("p01_batch_validity", lambda s, d: p.batch_validity(*_batches(s, d)), """
WITH t AS (SELECT event_id % 2000 AS app, bool_and(event_id % 101 > 0 AND event_id % 103 > 0 AND event_id % 107 > 0) AS ok FROM events GROUP BY 1)
SELECT h.app, h.app % 50 > 0 AND coalesce(ok, h.app <> 0) AS valid FROM range(2100) h(app) LEFT JOIN t USING (app)""")


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.when(F.col("event_id") % 4 > 0, F.col("event_id")).otherwise(0).alias("id"), F.when(F.col("event_id") % 5 > 0, F.col("user_id")).otherwise(0).alias("app"),
                                       F.when(F.col("event_id") % 3 > 0, F.col("event_id") * 10).otherwise(0).alias("start_ts"), F.col("event_id").alias("natural"))


register("p02_stamp", lambda s, d: p.stamp(_tasks(s, d), s.range(0, 100, 3).select(F.col("id").alias("app"), (F.col("id") + 5000).alias("new")), "app").select("natural", "app"),
         "SELECT event_id AS natural, CASE WHEN a % 3 = 0 AND a < 100 THEN a + 5000 ELSE a END AS app FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id ELSE 0 END AS a FROM events)")
register("p03_fill_fields", lambda s, d: p.fill_fields(_tasks(s, d), 777, ["natural"]), """
WITH h AS (SELECT *, ('0x' || substr(md5('id:' || event_id), 1, 8))::BIGINT % 2147483647 + 1 AS a, ('0x' || substr(md5('app:' || event_id), 1, 8))::BIGINT % 2147483647 + 1 AS b FROM events),
f AS (SELECT CASE WHEN event_id % 4 > 0 AND event_id > 0 THEN event_id ELSE a END AS id, CASE WHEN event_id % 5 > 0 AND user_id <> 0 THEN user_id ELSE b END AS app, CASE WHEN event_id % 3 > 0 THEN event_id * 10 ELSE 777 END AS start_ts, event_id AS natural FROM h)
SELECT *, 'result_' || id AS result_key, 'status_' || id AS status_key FROM f""")


def _register_log(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.col("user_id").alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("register_ts"), (F.floor("value") % 8).alias("slots"), (F.floor("value") % 3).alias("used"))


NOW = 1706572800000  # 2024-01-30 00:00:00 UTC in ms
register("p04_live_hosts", lambda s, d: p.live_hosts(_register_log(s, d), NOW, 3600), f"""
WITH l AS (SELECT user_id AS host, max(((epoch_us(ts) // 1000), floor(value)::BIGINT % 8, floor(value)::BIGINT % 3)) AS x FROM events GROUP BY 1)
SELECT host, x[1] AS register_ts, x[2] AS slots, x[3] AS used FROM l WHERE {NOW} - x[1] <= 3600000""")
register("p05_host_registry", lambda s, d: p.host_registry(read(s, d, "events").select(
    F.col("event_id").alias("seq"), F.col("user_id").alias("host"), F.when(F.col("event_type") == "error", "remove").otherwise("register").alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    (F.floor("value") % 8 - 1).alias("slots"), F.lit(0).cast("long").alias("used"), (F.col("event_type") == "purchase").alias("overwrite")), 36000), """
WITH l AS (SELECT event_id AS seq, user_id AS host, event_type, epoch_us(ts) // 1000 AS ts, floor(value)::BIGINT % 8 - 1 AS slots FROM events),
k AS (SELECT l.*, lag(l.ts) OVER (PARTITION BY host ORDER BY seq) AS before FROM l LEFT JOIN (SELECT host, max(seq) AS gone FROM l WHERE event_type = 'error' GROUP BY host) USING (host) WHERE event_type <> 'error' AND slots >= 0 AND (gone IS NULL OR seq > gone))
SELECT host, arg_max(slots, seq) FILTER (WHERE before IS NULL OR event_type = 'purchase' OR ts - before > 36000000) AS slots, 0::BIGINT AS used, arg_max(ts, seq) AS register_ts FROM k GROUP BY host""")
register("p06_exclude_tenants", lambda s, d: p.exclude_tenants(read(s, d, "supplier").select(F.col("s_suppkey").alias("host")), read(s, d, "orders").select((F.col("o_custkey") % 150).alias("host"), F.when(F.col("o_orderkey") % 40 == 0, 0).otherwise(1).alias("tenant")), 1),
         "SELECT s_suppkey AS host FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey % 150 FROM orders WHERE o_orderkey % 40 = 0)")


def _marked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return p.exclude_marked(read(s, d, "supplier").select(F.col("s_suppkey").alias("host"), "s_nationkey"), read(s, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("host")))


register("p07_kept_hosts", lambda s, d: _marked(s, d)[0], "SELECT s_suppkey AS host, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
register("p07_dropped_hosts", lambda s, d: _marked(s, d)[1], "SELECT s_suppkey AS host FROM supplier WHERE s_suppkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
register("p08_request_types", lambda s, d: p.request_types(read(s, d, "orders").select(F.col("o_custkey").alias("app"), F.when(F.col("o_orderstatus") == "F", "migration").otherwise("functions").alias("kind")), read(s, d, "events").select(F.col("user_id").alias("app"))), """
SELECT o_custkey AS app, CASE o_orderstatus WHEN 'F' THEN 'migration' ELSE 'functions' END AS kind,
       CASE WHEN o_custkey NOT IN (SELECT user_id FROM events) THEN 'NEW' WHEN o_orderstatus = 'F' THEN 'DIST_CHANGE' ELSE 'SCALE_CHANGE' END AS type FROM orders""")


def _preset(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    work = read(s, d, "lineitem").select(F.col("l_partkey").alias("app"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("group_idx"))
    return p.preset_hosts(work, read(s, d, "part").select(F.col("p_partkey").alias("app"), (F.col("p_partkey") % 7 + 1).cast("int").alias("group_idx"), F.col("p_brand").alias("host")))


register("p09_preset_hosts", lambda s, d: _preset(s, d)[0], "SELECT l_partkey AS app, l_orderkey AS id, l_linenumber AS group_idx, p_brand AS host FROM lineitem JOIN part ON p_partkey = l_partkey AND p_partkey % 7 + 1 = l_linenumber")
register("p09_preset_rejects", lambda s, d: _preset(s, d)[1], "SELECT l_partkey AS app, l_orderkey AS id, l_linenumber AS group_idx FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 7 + 1 = l_linenumber WHERE p_partkey IS NULL")
register("p10_idle_workers", lambda s, d: p.idle_workers(_register_log(s, d).select(F.col("host").alias("worker"), F.col("register_ts").alias("ts"), ((F.col("slots") == 7) & (F.col("used") == 2)).alias("running")), NOW, 3600000), f"""
SELECT user_id AS worker, max((epoch_us(ts) // 1000)) AS last_ts FROM events GROUP BY 1
HAVING {NOW} - max((epoch_us(ts) // 1000)) >= 3600000 AND count(*) FILTER (WHERE floor(value)::BIGINT % 8 = 7 AND floor(value)::BIGINT % 3 = 2) = 0""")
register("p11_exchange_violations", lambda s, d: p.exchange_violations(read(s, d, "events").select("event_id", F.lit(6).alias("size"), (F.col("user_id") % 7).alias("src"), (F.col("event_id") % 6).alias("dst"),
         (F.col("event_id") % 2).alias("send_type"), (F.col("event_id") % 4 % 3).alias("recv_type"), (F.col("event_id") % 5).alias("send_count"), (F.col("event_id") % 3).alias("recv_count"))).select("event_id", "reason"), """
SELECT event_id, CASE WHEN user_id % 7 >= 6 THEN 'rank' ELSE 'type' END AS reason FROM events WHERE user_id % 7 >= 6 OR (event_id % 2 <> event_id % 4 % 3 AND event_id % 5 = event_id % 3)""")
