"""Queries of keyed state: events as operation log, key = user, order = event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as k
from .registry import read, register


def events(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_type").alias("type"), F.col("ts"), F.col("value").alias("num"))


def op_of(**names: str):
    """Operation by event type."""
    out = F.lit(None).cast("string")
    for kind, op in names.items():
        out = F.when(F.col("type") == kind, op).otherwise(out)
    return out


def _values(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).withColumn("op", op_of(signup="set", error="delete")).withColumn("value", F.lpad(F.col("seq").cast("string"), 12, "."))
    return k.set_values(e)


VALUES = """e AS (SELECT event_id AS seq, user_id AS key, event_type AS type, ts, value AS num FROM events),
l AS (SELECT key, max(seq) AS seq FROM e WHERE type IN ('signup', 'error') GROUP BY key),
v AS (SELECT key, seq, lpad(seq::VARCHAR, 12, '.') AS value FROM e JOIN l USING (key, seq) WHERE type = 'signup')"""
register("k01_set_last", _values, f"WITH {VALUES} SELECT key, value, seq FROM v")


def _patches(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).filter("type = 'click'").select("key", "seq", (F.col("seq") % 12).alias("offset"), F.lit("abc").alias("data"))


PATCHED = f"""{VALUES}, p AS (SELECT key, seq, seq % 12 AS o FROM e WHERE type = 'click'),
c AS (SELECT v.key, i AS slot, substr(value, i + 1, 1) AS item FROM v, range(12) t(i)),
h AS (SELECT p.key, p.o + j AS slot, substr('abc', j + 1, 1) AS item, p.seq FROM p JOIN v ON p.key = v.key AND p.seq > v.seq, range(3) t(j) WHERE o + 3 <= 12),
n AS (SELECT key, slot, arg_max(item, seq) AS item FROM h GROUP BY ALL)"""
register("k02_set_chunk", lambda s, d: k.patch_cells(_values(s, d), _patches(s, d))[0], f"WITH {PATCHED} SELECT key, slot, coalesce(n.item, c.item) AS item FROM c LEFT JOIN n USING (key, slot)")
register("k02_set_chunk_rejects", lambda s, d: k.patch_cells(_values(s, d), _patches(s, d))[1].select("key", "seq", "offset"),
         f"""WITH {VALUES} SELECT e.key, e.seq, e.seq % 12 AS "offset" FROM e LEFT JOIN v ON e.key = v.key WHERE type = 'click' AND (v.key IS NULL OR e.seq % 12 > 9)""")


def _appends(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).withColumn("op", op_of(view="append", purchase="append", error="clear")).withColumn("value", F.concat(F.col("seq").cast("string"), F.lit(";")))


APPENDS = """a AS (SELECT user_id AS key, event_id AS seq, event_id::VARCHAR || ';' AS value FROM events WHERE event_type IN ('view', 'purchase')),
c AS (SELECT user_id AS key, max(event_id) AS c FROM events WHERE event_type = 'error' GROUP BY 1), """
register("k03_append", lambda s, d: _appends(s, d).filter("op = 'append'").select("key", "seq", "value"), f"WITH {APPENDS[:APPENDS.index('c AS')].rstrip(', ').rstrip().rstrip(',')} SELECT key, seq, value FROM a")
register("k04_first_appended", lambda s, d: k.first_appended(_appends(s, d).filter("op = 'append'"), 4), f"WITH {APPENDS} r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM a) SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM r WHERE n <= 4 GROUP BY key")
register("k05_clear_appended", lambda s, d: k.live_appends(_appends(s, d)), f"WITH {APPENDS} x AS (SELECT 1) SELECT a.key, seq, value FROM a LEFT JOIN c ON a.key = c.key WHERE c.c IS NULL OR seq > c.c")
register("k06_count", lambda s, d: k.count_keys(_values(s, d).withColumn("user", F.col("key") % 20)), f"WITH {VALUES} SELECT key % 20 AS user, count(*) AS keys FROM v GROUP BY 1")


def _named(s: SparkSession, d: str) -> DataFrame:
    """Operations of which some lack a user or a key."""
    e = events(s, d)
    return e.select("seq", F.when(F.col("seq") % 11 == 0, "").when(F.col("seq") % 13 > 0, F.col("type")).alias("user"), F.when(F.col("seq") % 17 == 0, "").when(F.col("seq") % 19 > 0, F.col("key").cast("string")).alias("key"))


NAMED = "m AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 > 0 THEN event_type END AS user, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 > 0 THEN user_id::VARCHAR END AS key FROM events)"
register("k06_valid_keys", lambda s, d: k.check_keys(_named(s, d))[0], f"WITH {NAMED} SELECT * FROM m WHERE user <> '' AND key <> ''")
register("k06_key_rejects", lambda s, d: k.check_keys(_named(s, d))[1], f"WITH {NAMED} SELECT * FROM m WHERE coalesce(user, '') = '' OR coalesce(key, '') = ''")
register("k06_sizes", lambda s, d: k.value_sizes(_values(s, d)), f"WITH {VALUES} SELECT key, length(value) AS size FROM v")


def _flags(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).filter("type = 'click'").select("key", F.floor("num").alias("slot")).distinct()


register("k07_dirty_ranges", lambda s, d: k.dirty_ranges(_flags(s, d)), """
WITH f AS (SELECT DISTINCT user_id AS key, floor(value)::BIGINT AS slot FROM events WHERE event_type = 'click'),
i AS (SELECT *, slot - row_number() OVER (PARTITION BY key ORDER BY slot) AS g FROM f) SELECT key, min(slot) AS "offset", count(*) AS length FROM i GROUP BY key, g""")


def _cells(s: SparkSession, d: str, kind: str) -> DataFrame:
    return events(s, d).filter(F.col("type") == kind).groupBy("key", F.floor("num").alias("slot")).agg(F.max("seq").alias("item"))


CELLS = """r AS (SELECT user_id AS key, floor(value)::BIGINT AS slot, max(event_id) AS item FROM events WHERE event_type = 'view' GROUP BY ALL),
l AS (SELECT user_id AS key, floor(value)::BIGINT AS slot, max(event_id) AS item FROM events WHERE event_type = 'click' GROUP BY ALL)"""
register("k08_push_partial", lambda s, d: k.push_partial(_cells(s, d, "view"), _cells(s, d, "click"), _flags(s, d).filter("slot % 2 = 0")),
         f"WITH {CELLS} SELECT key, slot, CASE WHEN slot % 2 = 0 THEN coalesce(l.item, r.item) ELSE r.item END AS item FROM r FULL JOIN l USING (key, slot) WHERE r.item IS NOT NULL OR slot % 2 = 0")


def _mask(s: SparkSession, d: str) -> DataFrame:
    """A mask for each key's cells; some lack a few, which stand under a key that nobody has."""
    key = F.when((F.col("key") % 5 == 0) & (F.col("slot") <= 3), -1 - F.col("key")).otherwise(F.col("key"))
    return _cells(s, d, "click").select(key.alias("key"), "slot", (F.col("slot") % 3 == 0).alias("on"))


register("k09_push_masked", lambda s, d: k.push_masked(_cells(s, d, "view"), _cells(s, d, "click"), _mask(s, d))[0], f"""
WITH {CELLS}, k AS (SELECT key, count(*) = count(*) FILTER (WHERE key % 5 > 0 OR slot > 3) AS ok FROM l GROUP BY key)
SELECT key, slot, CASE WHEN slot % 3 = 0 AND ok THEN coalesce(l.item, r.item) ELSE r.item END AS item FROM r FULL JOIN l USING (key, slot) LEFT JOIN k USING (key) WHERE r.item IS NOT NULL OR (slot % 3 = 0 AND ok)""")
register("k10_plan_sync", lambda s, d: k.plan_sync(
    events(s, d).filter("type = 'view'").groupBy("key").agg(F.max("seq").alias("version"), (F.max("num") > 200).alias("dirty")), events(s, d).filter("type = 'click'").groupBy("key").agg(F.max("seq").alias("version"))), """
WITH l AS (SELECT user_id AS key, max(event_id) AS version, max(value) > 200 AS dirty FROM events WHERE event_type = 'view' GROUP BY 1), r AS (SELECT user_id AS key, max(event_id) AS theirs FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT key, CASE WHEN coalesce(dirty, false) THEN 'push' WHEN version IS NULL OR theirs > version THEN 'refresh' ELSE 'keep' END AS action FROM l FULL JOIN r USING (key)""")
register("k11_counters", lambda s, d: k.counters(events(s, d).withColumn("op", op_of(view="incr", error="decr", purchase="incrby", click="decrby", signup="get")).withColumn("num", F.floor("num"))),
         "SELECT user_id AS key, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN -1 WHEN 'purchase' THEN floor(value) WHEN 'click' THEN -floor(value) ELSE 0 END)::BIGINT AS total FROM events GROUP BY 1")


def _members(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).withColumn("op", op_of(view="add", purchase="add", click="add", error="remove")).withColumn("member", F.floor("num") % 30)
    return k.set_members(e.withColumn("key", F.col("key") % 50))


MEMBERS = "m AS (SELECT key, member FROM (SELECT user_id % 50 AS key, floor(value)::BIGINT % 30 AS member, arg_max(event_type, event_id) AS t FROM events WHERE event_type <> 'signup' GROUP BY ALL) WHERE t <> 'error')"
register("k12_set_members", _members, f"WITH {MEMBERS} SELECT key, member FROM m")
register("k12_set_sizes", lambda s, d: k.set_sizes(_members(s, d)), f"WITH {MEMBERS} SELECT key, count(*) AS size FROM m GROUP BY key")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return _members(s, d).select(F.col("key").alias("a"), ((F.col("key") + 7) % 50).alias("b")).distinct()


register("k13_set_difference", lambda s, d: k.set_difference(_members(s, d), _pairs(s, d)), f"WITH {MEMBERS} SELECT key AS a, (key + 7) % 50 AS b, member FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.key = (m.key + 7) % 50 AND o.member = m.member)")
register("k13_set_intersection", lambda s, d: k.set_intersection(_members(s, d), _pairs(s, d)), f"WITH {MEMBERS} SELECT key AS a, (key + 7) % 50 AS b, member FROM m WHERE EXISTS (SELECT 1 FROM m o WHERE o.key = (m.key + 7) % 50 AND o.member = m.member)")
register("k14_random_member", lambda s, d: k.random_member(_members(s, d)), f"WITH {MEMBERS} SELECT key, arg_min(member, md5('0:' || key || ':' || member)) AS member FROM m GROUP BY key")


def _items(s: SparkSession, d: str) -> DataFrame:
    return k.list_items(events(s, d).withColumn("op", op_of(view="lpush", click="rpush")).withColumn("value", F.col("seq")))


LISTS = "i AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN -event_id - 1 ELSE event_id END) - 1 AS position, event_id AS value FROM events WHERE event_type IN ('view', 'click'))"
register("k15_lists", _items, f"WITH {LISTS} SELECT * FROM i")
register("k15_lengths", lambda s, d: k.list_lengths(_items(s, d)), f"WITH {LISTS} SELECT key, count(*) AS length FROM i GROUP BY key")
register("k15_first", lambda s, d: k.first_items(_items(s, d), 3), f"WITH {LISTS} SELECT * FROM i WHERE position < 3")
register("k16_queue_replay", lambda s, d: k.replay_queues(events(s, d).withColumn("op", op_of(view="enqueue", click="dequeue")).filter("op is not null").withColumnRenamed("key", "queue")), """
WITH e AS (SELECT user_id AS queue, event_id AS seq, CASE event_type WHEN 'view' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT *, sum(d) OVER w AS t FROM e WINDOW w AS (PARTITION BY queue ORDER BY seq)),
f AS (SELECT *, least(min(t) OVER (PARTITION BY queue ORDER BY seq), 0) AS low FROM s),
g AS (SELECT *, d < 0 AND low < coalesce(lag(low) OVER (PARTITION BY queue ORDER BY seq), 0) AS none FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY queue, d, none ORDER BY seq) AS n FROM g)
SELECT o.queue, o.seq, i.seq AS item_seq FROM n o LEFT JOIN n i ON i.queue = o.queue AND i.d > 0 AND NOT o.none AND i.n = o.n WHERE o.d < 0""")
register("k17_expiry", lambda s, d: k.live_values(events(s, d).withColumn("op", op_of(signup="set", view="expire")).withColumn("value", F.col("seq")).withColumn("ttl_s", (F.floor("num") * 36_000).cast("long")), "2024-01-31 00:00:00"), """
WITH s AS (SELECT user_id AS key, max(event_id) AS value FROM events WHERE event_type = 'signup' GROUP BY 1),
e AS (SELECT user_id AS key, arg_max(epoch_us(ts) + floor(value)::BIGINT * 36000000000, event_id) AS ends FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1),
t AS (SELECT key, value, floor((ends - epoch_us(TIMESTAMP '2024-01-31 00:00:00')) / 1000000)::BIGINT AS ttl_s FROM s JOIN e USING (key)) SELECT key, value, ttl_s FROM t WHERE ttl_s > 0""")


def logged(s: SparkSession, d: str) -> DataFrame:
    """A log of all operations on a key's value and list."""
    e = events(s, d).withColumn("n", F.floor("num"))
    op = F.when(F.col("seq") % 9 == 4, "chunk").when(F.col("seq") % 9 == 7, "append").when(F.col("seq") % 31 == 0, "clear").when(F.col("seq") % 23 == 0, "expire").otherwise(op_of(view="setnx", click="delifeq", error="del", purchase="set", signup="setnx"))
    return e.select("key", "seq", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), op.alias("op"), F.concat(F.lit("v"), (F.col("n") % 3).cast("string")).alias("arg"),
                    F.when(F.col("n") % 4 > 0, F.col("n") * 1e9).alias("ttl"), (F.col("seq") % 4 - 1).alias("offset"))


# The state of a key after its n-th operation, one operation a round.
LOG = """RECURSIVE o AS MATERIALIZED (SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, epoch_us(ts)::DOUBLE AS moment, 'v' || floor(value)::BIGINT % 3 AS arg,
  CASE WHEN floor(value)::BIGINT % 4 > 0 THEN floor(value) * 1e9 END AS ttl, event_id % 4 - 1 AS off,
  CASE WHEN event_id % 9 = 4 THEN 'chunk' WHEN event_id % 9 = 7 THEN 'append' WHEN event_id % 31 = 0 THEN 'clear' WHEN event_id % 23 = 0 THEN 'expire' ELSE CASE event_type WHEN 'view' THEN 'setnx' WHEN 'click' THEN 'delifeq' WHEN 'error' THEN 'del' WHEN 'purchase' THEN 'set' ELSE 'setnx' END END AS op FROM events),
x AS (SELECT user_id AS key, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BOOLEAN AS done, NULL::VARCHAR AS value, NULL::DOUBLE AS ends, 0::BIGINT AS appended FROM events GROUP BY user_id
  UNION ALL SELECT key, n, seq,
    CASE op WHEN 'set' THEN true WHEN 'setnx' THEN v IS NULL WHEN 'del' THEN v IS NOT NULL WHEN 'delifeq' THEN coalesce(v = arg, false) WHEN 'chunk' THEN coalesce(fits, false) WHEN 'expire' THEN v IS NOT NULL AND ttl IS NOT NULL ELSE true END,
    CASE WHEN op = 'set' OR (op = 'setnx' AND v IS NULL) THEN arg WHEN op = 'del' OR (op = 'delifeq' AND v = arg) THEN NULL WHEN op = 'chunk' AND fits THEN v[1:off] || arg || v[off + length(arg) + 1:] ELSE v END,
    CASE WHEN op = 'set' OR (op = 'setnx' AND v IS NULL) OR (op = 'expire' AND v IS NOT NULL AND ttl IS NOT NULL) THEN moment + ttl WHEN op = 'del' OR (op = 'delifeq' AND v = arg) THEN NULL ELSE e END,
    CASE op WHEN 'append' THEN appended + 1 WHEN 'clear' THEN 0 ELSE appended END
  FROM (SELECT o.*, appended, v, e, off >= 0 AND off <= length(v) - length(arg) AS fits FROM (SELECT x.*, x.n + 1 AS at_n FROM x) x JOIN o ON o.key = x.key AND o.n = x.at_n,
    LATERAL (SELECT CASE WHEN ends IS NULL OR moment < ends THEN value END AS v, CASE WHEN ends IS NULL OR moment < ends THEN ends END AS e) l))"""
register("k18_conditional_writes", lambda s, d: k.conditional_writes(logged(s, d)), f"WITH {LOG} SELECT key, seq, done, value, appended FROM x WHERE n > 0")
register("k19_publish_list", lambda s, d: k.publish_results(events(s, d).filter("type = 'purchase'").withColumnRenamed("num", "value"), 30, 300)[0], "SELECT user_id AS key, event_id AS seq, value, ts + INTERVAL 30 SECOND AS expires FROM events WHERE event_type = 'purchase'")
register("k19_publish_status", lambda s, d: k.publish_results(events(s, d).filter("type = 'purchase'").withColumnRenamed("num", "value"), 30, 300)[1],
         "SELECT user_id AS key, arg_max(value, event_id) AS value, arg_max(ts, event_id) + INTERVAL 300 SECOND AS expires FROM events WHERE event_type = 'purchase' GROUP BY 1")
register("k20_patched_values", lambda s, d: k.assemble(k.patch_cells(_values(s, d), _patches(s, d))[0]),
         f"WITH {PATCHED} SELECT key, string_agg(coalesce(n.item, c.item), '' ORDER BY slot) AS value FROM c LEFT JOIN n USING (key, slot) GROUP BY key")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("value"))


register("s05_split_chunks", lambda s, d: k.split_chunks(_docs(s, d), 1000).withColumn("chunk", F.md5(F.hex("chunk"))), """
WITH t AS (SELECT doc_id AS key, hex(encode(coalesce(text, ''))) AS h FROM documents), c AS (SELECT key, h, unnest(range((length(h) + 1999) // 2000)) AS n FROM t)
SELECT key, n * 1000 AS "offset", length(substr(h, n * 2000 + 1, 2000)) // 2 AS length, md5(substr(h, n * 2000 + 1, 2000)) AS chunk FROM c""")


def _asks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select(F.col("doc_id").alias("key"), (F.col("doc_id") * 37 % 1500).alias("offset"), F.lit(100).cast("long").alias("len"))


register("s06_read_ranges", lambda s, d: k.read_ranges(_docs(s, d), _asks(s, d))[0].withColumn("data", F.md5(F.hex("data"))), """
WITH t AS (SELECT doc_id AS key, hex(encode(coalesce(text, ''))) AS h, doc_id * 37 % 1500 AS o FROM documents) SELECT key, o AS "offset", 100::BIGINT AS len, md5(substr(h, o * 2 + 1, 200)) AS data FROM t WHERE o + 100 <= length(h) // 2""")
register("s06_read_range_rejects", lambda s, d: k.read_ranges(_docs(s, d), _asks(s, d))[1], """SELECT doc_id AS key, doc_id * 37 % 1500 AS "offset", 100::BIGINT AS len FROM documents WHERE doc_id * 37 % 1500 + 100 > octet_length(encode(coalesce(text, '')))""")
