"""Capacity allocation: filling sorted bins with items, scoring plans and repairing them.

Everything is per `pool`, so pools are filled side by side. bins: (pool, bin, slots, used); items: (pool, item)
in the order of item; plans: (pool, item, bin). Orders number the bins of a pool from 0 in `place`.

Orders, scores and verdicts depend on how many items a bin has, not on which. So wherever a plan is taken for these, its
histogram (pool, bin, n) serves as well, and items are numbered only where a plan of items is asked for. A plan whose
items stand in several bins each is given in groups: items (pool, group, item), each of which stands in all bins of its
group (pool, group, bin), and as often in a bin as that is listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import in_ranges
from .lineage import cut
from .ordering import number_rows, prefix_sums, repeat

POOL = ["pool"]


def histogram(plan: DataFrame) -> DataFrame:
    """(pool, bin, n) of a plan; of a histogram, itself, rows of the same bin as one."""
    return plan.groupBy("pool", "bin").agg((F.count("*") if _of_items(plan) else F.sum("n")).alias("n"))


def _of_items(plan: DataFrame) -> bool:
    return "item" in plan.columns


def grouped_histogram(items: DataFrame, members: DataFrame) -> DataFrame:
    """The histogram of a plan in groups, from the numbers of items per group."""
    sizes = items.groupBy("pool", "group").agg(F.count("*").alias("n"))
    return cut(histogram(members.join(sizes, ["pool", "group"]).select("pool", "bin", "n")))


def _times(members: DataFrame) -> DataFrame:
    """(pool, group, bin, times); bins that belong to several groups are an error."""
    times = cut(members.groupBy("pool", "group", "bin").agg(F.count("*").alias("times")))
    if not times.groupBy("pool", "bin").count().filter("count > 1").isEmpty():
        raise ValueError("a bin belongs to several groups")
    return times


def spread_score(plan: DataFrame) -> DataFrame:
    """(pool, bins, pairs): bins in use, and pairs of items that stand in different bins."""
    # The square of a pool's items may not fit a long.
    pairs = F.expr("(cast(sum(n) as decimal(19,0)) * cast(sum(n) as decimal(19,0)) - sum(cast(n as decimal(19,0)) * n)) div 2")
    return histogram(plan).groupBy("pool").agg(F.count("*").alias("bins"), pairs.cast("long").alias("pairs"))


def _order(bins: DataFrame, *by: Column) -> DataFrame:
    return bins.withColumn("place", F.row_number().over(Window.partitionBy("pool").orderBy(*by)) - 1)


def _largest() -> list[Column]:
    return [F.desc("free"), F.desc("slots"), F.desc("bin")]


def with_free(bins: DataFrame) -> DataFrame:
    return bins.withColumn("free", F.greatest(F.col("slots") - F.col("used"), F.lit(0)))


def order_new(bins: DataFrame) -> DataFrame:
    """Most free slots first, then the larger bin, then the later name."""
    return _order(with_free(bins), *_largest())


def _with_own(bins: DataFrame, plan: DataFrame) -> DataFrame:
    own = histogram(plan).withColumnRenamed("n", "own")
    return bins.join(own, ["pool", "bin"], "left").withColumn("own", F.coalesce("own", F.lit(0)))


def order_scale(bins: DataFrame, plan: DataFrame) -> DataFrame:
    """Bins with most items of the pool's own plan first, then as for new."""
    return _order(with_free(_with_own(bins, plan)), F.desc("own"), *_largest())


def _emptied(bins: DataFrame, plan: DataFrame) -> DataFrame:
    """The pool's own items taken out of the bins."""
    return with_free(_with_own(bins, plan).withColumn("used", F.col("used") - F.col("own")))


def order_repack(bins: DataFrame, plan: DataFrame) -> DataFrame:
    """Own items removed; most free first, then most own items, then as for new."""
    return _order(_emptied(bins, plan), F.desc("free"), F.desc("own"), F.desc("slots"), F.desc("bin"))


def order_compact(bins: DataFrame, plan: DataFrame) -> DataFrame:
    """Own items removed; fullest first, then as for new."""
    return _order(_emptied(bins, plan), F.desc("used"), *_largest())


def first_bin(ordered: DataFrame) -> DataFrame:
    """The hint that only the first bin may be used."""
    return ordered.filter("place = 0")


def _spans(ordered: DataFrame) -> DataFrame:
    """Bins with the numbers [lo, hi) of the items that they take."""
    before = Window.partitionBy("pool").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.withColumn("lo", F.coalesce(F.sum("free").over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col("free")).filter("free > 0")


def _short(ordered: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pools that want more than there is room for."""
    room = ordered.groupBy("pool").agg(F.sum("free").alias("room"))
    return wanted.join(room, "pool", "left").filter("room is null or wanted > room").select("pool")


def fill(ordered: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(histogram, no_room) of the waterfall of as many items as (pool, wanted) says, without the items."""
    short = _short(ordered, wanted)
    taken = _spans(ordered).join(wanted, "pool").filter("lo < wanted").select("pool", "bin", (F.least("hi", "wanted") - F.col("lo")).alias("n"))
    return histogram(taken.join(short, "pool", "left_anti")), short


def waterfall(ordered: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, no_room): items in order into bins in order, each up to its free slots; pools whose items do not all fit
    get no plan. Bins have the intervals [lo, hi) of item numbers, of any length; an item finds the one that holds its
    number (see `intervals`). Only items of pools with room are numbered, and only bins that get items are looked in."""
    wanted = items.groupBy("pool").agg(F.count("*").alias("wanted"))
    short = _short(ordered, wanted)
    spans = cut(_spans(ordered).join(wanted, "pool").filter("lo < wanted").select("pool", "bin", "lo", F.least("hi", "wanted").alias("hi")))
    numbered = number_rows(items.join(short, "pool", "left_anti"), POOL, ["item"], "_n")
    return in_ranges(numbered, spans, ["pool"], slot="_n", page=1024).select("pool", "item", "bin"), short


def _quotas_left(quota: DataFrame, old: DataFrame) -> DataFrame:
    """(pool, bin, free, place): what items that stay leave of the quotas (pool, bin, n), by bin name."""
    stay = quota.join(histogram(old).withColumnRenamed("n", "_old"), ["pool", "bin"], "left")
    return _order(stay.select("pool", "bin", (F.col("n") - F.least("n", F.coalesce("_old", F.lit(0)))).alias("free")), F.asc("bin"))


def keep_in_place(new: DataFrame, old: DataFrame) -> DataFrame:
    """A plan with the histogram of `new` (or `new` a histogram) in which items stay in their old bins while the bins'
    quotas last (in item order); the others fill what is left of the quotas by bin name. `old` is numbered once."""
    quota = histogram(new)
    numbered = cut(number_rows(old, ["pool", "bin"], ["item"], "_k").join(quota, ["pool", "bin"], "left").select("pool", "item", "bin", (F.col("_k") < F.coalesce("n", F.lit(0))).alias("_stays")))
    moved, _ = waterfall(_quotas_left(quota, old), numbered.filter("not _stays").select("pool", "item"))
    return numbered.filter("_stays").select("pool", "item", "bin").unionByName(moved)


def keep_groups_in_place(new: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """keep_in_place for a plan in groups. Items are numbered once a group, not once a bin; the bins of a group with their
    quotas tell how many copies of an item stay. Copies that leave have consecutive numbers, and their ranges are cut at
    the bounds of the quotas that are left."""
    quota = histogram(new)
    numbered = cut(number_rows(items.select("pool", "group", "item"), ["pool", "group"], ["item"], "_k"))
    # Where a bin is a member of one group, listed `times` times, the copies of its item k have the numbers k * times and on.
    rules = cut(_times(members).join(quota, ["pool", "bin"], "left").select("pool", "group", "bin", "times", F.coalesce("n", F.lit(0)).alias("n")))
    # An item that is among the first n div times of a bin stays there wholly, the next one in part. So per group the bins are
    # told apart by these numbers only, of which there are few.
    steps = rules.groupBy("pool", "group", F.expr("n div times").alias("whole"), F.expr("n % times").alias("part"), "times").agg(F.collect_list("bin").alias("bins"))
    stay = F.when(F.col("_k") < F.col("whole"), F.col("times")).when(F.col("_k") == F.col("whole"), F.col("part")).otherwise(F.lit(0))
    met = numbered.join(F.broadcast(steps), ["pool", "group"]).withColumn("_stay", stay)
    copies = F.when(F.col("_stay") == 1, F.col("bins")).otherwise(F.flatten(F.array_repeat("bins", F.col("_stay").cast("int"))))
    stays = met.filter("_stay > 0").select("pool", "item", F.explode(copies).alias("bin"))
    leaves = met.filter("_stay < times").groupBy("pool", "item").agg(F.sum((F.col("times") - F.col("_stay")) * F.size("bins")).alias("_m"))
    old = rules.join(numbered.groupBy("pool", "group").agg(F.count("*").alias("_g")), ["pool", "group"]).select("pool", "bin", (F.col("times") * F.col("_g")).alias("n"))
    spans = cut(_spans(_quotas_left(quota, old)).select("pool", "bin", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))
    return stays.unionByName(_spread(prefix_sums(leaves, POOL, ["item"], "_m", "_from"), spans))


def _spread(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """(pool, item, bin) for runs (pool, item, _from, _m) of _m copies with the numbers from _from on, over bins with the
    numbers [lo, hi). A run meets the bin of its first copy and each bin that begins within it: either finds the other as
    a slot in a range."""
    run = runs.select("pool", "item", F.col("_from").cast("long").alias("_a"), (F.col("_from") + F.col("_m")).cast("long").alias("_b"))
    first = in_ranges(run, spans, ["pool"], slot="_a", page=1024).select("pool", "item", "_a", "_b", "bin", "lo", "hi")
    begun = in_ranges(spans.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), run.select("pool", "item", F.col("_a").alias("lo"), F.col("_b").alias("hi")), ["pool"], slot="_lo", page=1024)
    later = begun.filter("_lo > lo").select("pool", "item", F.col("lo").alias("_a"), F.col("hi").alias("_b"), "bin", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    met = first.unionByName(later).select("pool", "item", "bin", (F.least("_b", "hi") - F.greatest("_a", "lo")).alias("_m"))
    return repeat(met, "_m").select("pool", "item", "bin")


def fewer_bins(new: DataFrame, old: DataFrame) -> DataFrame:
    """(pool, better): the new plan uses fewer bins, or as many with fewer cross pairs."""
    a, b = spread_score(new), spread_score(old).select("pool", F.col("bins").alias("old_bins"), F.col("pairs").alias("old_pairs"))
    better = (F.col("bins") < F.col("old_bins")) | ((F.col("bins") == F.col("old_bins")) & (F.col("pairs") < F.col("old_pairs")))
    return a.join(b, "pool").select("pool", better.alias("better"))


def more_empty_bins(bins: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """(pool, better): more bins are empty after the new plan than before. `used` of the bins counts the old plan."""
    after = _with_own(bins, old).withColumnRenamed("own", "_old").join(histogram(new).withColumnRenamed("n", "_new"), ["pool", "bin"], "left")
    then = F.col("used") - F.col("_old") + F.coalesce("_new", F.lit(0))
    return after.groupBy("pool").agg((F.count_if(then == 0) > F.count_if(F.col("used") == 0)).alias("better"))


def repack(bins: DataFrame, old: DataFrame, goal: str = "fewer_bins") -> tuple[DataFrame, DataFrame]:
    """(plan, verdicts): old plans repacked. verdicts: (pool, verdict) move, do not move or no room; only pools that
    move have a plan, with as many items in place as the new histogram allows. goal: fewer_bins or compact. Where `old`
    is a histogram, so is the plan."""
    own = histogram(old)
    ordered = order_repack(bins, own) if goal == "fewer_bins" else order_compact(bins, own)
    new, short = fill(ordered, _wanted(own))
    better = fewer_bins(new, own) if goal == "fewer_bins" else more_empty_bins(bins, new, own).join(new.select("pool").distinct(), "pool", "left_semi")
    verdict = F.when(F.col("better"), "move").otherwise("do not move")
    verdicts = better.select("pool", verdict.alias("verdict")).unionByName(short.select("pool", F.lit("no room").alias("verdict")))
    return _moved(new, old, verdicts), verdicts


def repack_groups(bins: DataFrame, items: DataFrame, members: DataFrame, goal: str = "fewer_bins") -> tuple[DataFrame, DataFrame]:
    """repack for a plan in groups."""
    quota, verdicts = repack(bins, grouped_histogram(items, members), goal)
    moving = cut(verdicts.filter("verdict = 'move'").select("pool"))
    return keep_groups_in_place(cut(quota), items.join(moving, "pool", "left_semi"), members.join(moving, "pool", "left_semi")), verdicts


def _wanted(own: DataFrame) -> DataFrame:
    return own.groupBy("pool").agg(F.sum("n").alias("wanted"))


def _moved(new: DataFrame, old: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The plans of pools that move, given the histogram `new`."""
    moving = verdicts.filter("verdict = 'move'").select("pool")
    quota = new.join(moving, "pool", "left_semi")
    return keep_in_place(quota, old.join(moving, "pool", "left_semi")) if _of_items(old) else quota


def evacuate(bins: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, verdicts) when bins marked `evict` must be left: pools that use none do not move, pools without room
    elsewhere must freeze, the others move, items in place where they can. Where `old` is a histogram, so is the plan."""
    own = histogram(old)
    stay = bins.filter("not evict").drop("evict")
    ordered = _order(_emptied(stay, own), F.desc("own"), *_largest())
    new, short = fill(ordered, _wanted(own))
    touched = own.join(bins.filter("evict").select("pool", "bin"), ["pool", "bin"], "left_semi").select("pool").distinct().withColumn("_t", F.lit(True))
    pools = own.select("pool").distinct().join(touched, "pool", "left").join(short.withColumn("_s", F.lit(True)), "pool", "left")
    verdicts = pools.select("pool", F.when(F.col("_s"), "must freeze").when(F.col("_t"), "move").otherwise("do not move").alias("verdict"))
    return _moved(new, old, verdicts), verdicts


def reserved_room(hosts: DataFrame, apps: DataFrame) -> DataFrame:
    """(app, host, room): free slots of each app's host, less what other apps there asked for but do not use. apps:
    (app, host, asked, used); hosts: (host, slots, used)."""
    owed = apps.withColumn("owed", F.greatest(F.col("asked") - F.col("used"), F.lit(0)))
    total = owed.groupBy("host").agg(F.sum("owed").alias("_all"))
    free = hosts.select("host", (F.col("slots") - F.col("used")).alias("_free"))
    rows = owed.join(total, "host").join(free, "host")
    return rows.select("app", "host", F.greatest(F.col("_free") - (F.col("_all") - F.col("owed")), F.lit(0)).cast("long").alias("room"))


def grow(tasks: DataFrame, room: DataFrame) -> DataFrame:
    """New tasks (app, app_idx, function): copies of each app's last task with the next indexes, as many as its room."""
    last = tasks.groupBy("app").agg(F.max(F.struct("app_idx", "function")).alias("x"))
    rows = last.join(room.select("app", "room"), "app").filter("room > 0")
    return rows.select("app", F.explode(F.expr("sequence(x.app_idx + 1, x.app_idx + cast(room as int))")).alias("app_idx"), F.col("x.function").alias("function"))


def vacated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bins that hold fewer items of their pool than before: the multiset difference of old and new, as a set."""
    after = histogram(new).withColumnRenamed("n", "_new")
    return histogram(old).join(after, ["pool", "bin"], "left").filter("n > coalesce(_new, 0)").select("pool", "bin")


def work_lists(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pool, bin, items), (pool, single)): items of each bin in order, and whether the pool's plan has one bin."""
    lists = plan.groupBy("pool", "bin").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return lists, single_bins(plan)


def single_bins(plan: DataFrame) -> DataFrame:
    """(pool, single): whether the pool's plan has one bin."""
    return plan.groupBy("pool").agg((F.count_distinct("bin") <= 1).alias("single"))


def grouped_work_lists(items: DataFrame, members: DataFrame, form: Callable[[Column], Column] = lambda items: items) -> DataFrame:
    """(pool, bin, items) for a plan in groups: a group's list, or what `form` makes of it, is made once, and the bins of the
    group take it as it is."""
    lists = items.groupBy("pool", "group").agg(F.sort_array(F.collect_list("item")).alias("items"))
    bins = _times(members).groupBy("pool", "group", F.col("times").cast("int").alias("times")).agg(F.collect_list("bin").alias("bins"))
    every = F.when(F.col("times") == 1, F.col("items")).otherwise(F.flatten(F.transform("items", lambda x: F.array_repeat(x, F.col("times")))))
    made = lists.join(F.broadcast(bins), ["pool", "group"]).select("pool", "bins", form(every).alias("items"))
    return made.select("pool", F.explode("bins").alias("bin"), "items")


def repackable(hosts: DataFrame, placements: DataFrame, goal: str = "fewer_bins") -> DataFrame:
    """(pool, verdict) for every app of an occupancy table, each app a pool over all hosts of its file. hosts: (file,
    host, slots, used); placements: (file, app, pos, host)."""
    pool = F.struct("file", "app").alias("pool")
    old = placements.select(pool, F.col("pos").alias("item"), F.col("host").alias("bin"))
    bins = placements.select("file", "app").distinct().join(hosts, "file").select(pool, F.col("host").alias("bin"), "slots", "used")
    return repack(bins, old, goal)[1].select("pool.file", "pool.app", "verdict")
