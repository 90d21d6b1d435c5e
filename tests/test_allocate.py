"""Exact cases of allocation."""

import pytest

from driftloom.operators import allocate as a
from driftloom.sources import tasks as t

BINS = "pool string, bin string, slots int, used int"
PLAN = "pool string, item int, bin string"


def bins(spark, text):
    rows = [(x.split()[0], *map(int, x.split()[1].split("/"))) for x in text.split(", ")]
    return spark.createDataFrame([("p", *r) for r in rows], BINS)


def plan(spark, names):
    return spark.createDataFrame([("p", i, b) for i, b in enumerate(names.split())], PLAN)


def placed(df):
    return " ".join(r.bin for r in df.orderBy("item").collect())


@pytest.mark.parametrize("layout,items,expected", [
    ("foo 4/0, bar 3/0", 6, "foo foo foo foo bar bar"),
    ("foo 3/0, bar 4/2", 4, "foo foo foo bar"),
    ("foo 4/1, bar 3/0", 6, "foo foo foo bar bar bar"),
    ("foo 3/0, bar 3/0", 6, "foo foo foo bar bar bar"),
    ("foo 4/0, bar 6/2, baz 2/2, bip 3/2, bup 1/0", 10, "bar bar bar bar foo foo foo foo bip bup"),
])
def test_waterfall_new(spark, layout, items, expected):
    work = spark.createDataFrame([("p", i) for i in range(items)], "pool string, item int")
    out, short = a.waterfall(a.order_new(bins(spark, layout)), work)
    assert placed(out) == expected and short.isEmpty()


def test_waterfall_scale(spark):
    work = spark.createDataFrame([("p", i) for i in range(6)], "pool string, item int")
    out, short = a.waterfall(a.order_scale(bins(spark, "foo 2/1, bar 1/0"), plan(spark, "foo")), work)
    assert out.isEmpty() and short.count() == 1
    out, short = a.waterfall(a.order_scale(bins(spark, "foo 4/0, bar 3/1"), plan(spark, "bar")), work.filter("item < 4"))
    assert placed(out) == "bar bar foo foo"


@pytest.mark.parametrize("layout,old,expected,verdict", [
    ("foo 4/2, bar 2/2", "foo foo bar bar", "foo foo foo foo", "move"),
    ("foo 3/2, bar 2/1, baz 1/1", "foo foo bar baz", "foo foo bar foo", "move"),
    ("foo 4/4, bar 2/1", "foo foo foo foo bar", "", "do not move"),
])
def test_repack(spark, layout, old, expected, verdict):
    out, verdicts = a.repack(bins(spark, layout), plan(spark, old))
    assert placed(out) == expected and verdicts.first().verdict == verdict


def test_compact(spark):
    out, verdicts = a.repack(bins(spark, "foo 4/2, bar 4/2, baz 4/4"), plan(spark, "baz baz baz baz"), "compact")
    assert sorted(placed(out).split()) == ["bar", "bar", "foo", "foo"] and verdicts.first().verdict == "move"


@pytest.mark.parametrize("layout,marked,old,expected,verdict", [
    ("foo 4/2", "foo", "foo foo", "", "must freeze"),
    ("foo 4/2, bar 4/2, baz 2/2, lol 2/2", "baz", "baz baz lol lol", "foo foo lol lol", "move"),
    ("foo 4/2, bar 4/0", "bar", "foo foo", "", "do not move"),
])
def test_evacuate(spark, layout, marked, old, expected, verdict):
    df = bins(spark, layout)
    out, verdicts = a.evacuate(df.withColumn("evict", df.bin == marked), plan(spark, old))
    assert verdicts.first().verdict == verdict
    assert sorted(placed(out).split()) == sorted(expected.split())


def test_growth_and_room(spark):
    hosts = spark.createDataFrame([("h", 10, 4)], "host string, slots int, used int")
    apps = spark.createDataFrame([(1, "h", 4, 2), (2, "h", 3, 1), (3, "h", 1, 2)], "app int, host string, asked int, used int")
    room = a.reserved_room(hosts, apps)
    assert {r.app: r.room for r in room.collect()} == {1: 4, 2: 4, 3: 2}
    tasks = spark.createDataFrame([(3, 0, "f"), (3, 1, "g")], "app int, app_idx int, function string")
    assert [(r.app_idx, r.function) for r in a.grow(tasks, room).orderBy("app_idx").collect()] == [(2, "g"), (3, "g")]


def test_occupancy_file(spark, tmp_path):
    (tmp_path / "occupancy.csv").write_text("WorkerIp,Slots\nfoo,1,1,-1,2\nbar,1\n\nempty\n")
    hosts, placements = t.read_occupancy(spark, str(tmp_path))
    assert {(r.host, r.slots, r.used) for r in hosts.collect()} == {("foo", 4, 3), ("bar", 1, 1), ("empty", 0, 0)}
    assert [(r.app, r.pos, r.host) for r in placements.orderBy("app", "pos").collect()] == [(1, 0, "foo"), (1, 1, "foo"), (1, 2, "bar"), (2, 0, "foo")]
    assert {r.app: r.verdict for r in a.repackable(hosts, placements).collect()} == {1: "move", 2: "do not move"}


def test_histograms_serve_as_plans(spark):
    df, old = bins(spark, "foo 4/2, bar 2/2"), plan(spark, "foo foo bar bar")
    out, verdicts = a.repack(df, a.histogram(old))
    assert [(r.bin, r.n) for r in out.collect()] == [("foo", 4)] and verdicts.first().verdict == "move"
    assert [r.bin for r in a.vacated(a.histogram(old), out).collect()] == ["bar"]
    marked = df.withColumn("evict", df.bin == "bar")
    assert [(r.bin, r.n) for r in a.evacuate(marked, a.histogram(old))[0].collect()] == [("foo", 4)]


def test_score_beyond_longs(spark):
    huge = spark.createDataFrame([("p", "a", 2_500_000_000), ("p", "b", 2_000_000_000)], "pool string, bin string, n long")
    assert a.spread_score(huge).first().pairs == 2_500_000_000 * 2_000_000_000


@pytest.mark.parametrize("quotas", [{"a": 5, "b": 5, "c": 10}, {"a": 2, "b": 4, "c": 9, "d": 5}, {"d": 20}, {"a": 0, "b": 1, "c": 19}])
def test_items_in_several_bins(spark, quotas):
    """A plan in groups is kept in place as its rows are; a copy that leaves is not lost because another one stays."""
    items = spark.createDataFrame([("p", "g", i) for i in range(5)] + [("p", "h", i) for i in range(3, 8)], "pool string, group string, item int")
    members = spark.createDataFrame([("p", "g", "a"), ("p", "g", "b"), ("p", "h", "c"), ("p", "h", "c")], "pool string, group string, bin string")
    quota = spark.createDataFrame([("p", b, n) for b, n in quotas.items()], "pool string, bin string, n long")
    rows = items.join(members, ["pool", "group"]).select("pool", "item", "bin")
    assert sorted(map(tuple, a.grouped_histogram(items, members).collect())) == [("p", "a", 5), ("p", "b", 5), ("p", "c", 10)]
    got = sorted(map(tuple, a.keep_groups_in_place(quota, items, members).collect()))
    assert len(got) == 20 and got == sorted(map(tuple, a.keep_in_place(quota, rows).collect()))
    assert {b: sum(r[2] == b for r in got) for b in quotas} == quotas
    lists = {r.bin: r["items"] for r in a.grouped_work_lists(items, members).collect()}
    assert lists == {r.bin: r["items"] for r in a.work_lists(rows)[0].collect()}


def test_bins_of_several_groups_are_refused(spark):
    items = spark.createDataFrame([("p", "g", 1)], "pool string, group string, item int")
    members = spark.createDataFrame([("p", "g", "a"), ("p", "h", "a")], "pool string, group string, bin string")
    with pytest.raises(ValueError, match="several groups"):
        a.grouped_work_lists(items, members)
