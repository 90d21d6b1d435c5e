"""Jaccard join of word n-gram sets by chosen paths.

Every set is embedded once as a coordinated sample: its n-grams whose hash is below sample / |set|, so two sets
keep the same of their shared n-grams. A run is a tree of chosen paths: a set goes into the buckets of its
tokens whose hash with the path is below branch / |sample|, and so do all sets that share those tokens, whatever
their other tokens. Buckets of up to `leaf` sets are compared by brute force. Sets whose paths end in enough of
them to meet every similar set there are done; the others, of which there are few, go on with their large buckets.
Where many sets of a large bucket really are alike, a few of them, its cores, are compared with all: a set close to a
core is done there, as all that are near to it are linked to that core. What is left of a large bucket splits again on
further shared tokens or, as deep as `depth`, is compared in blocks of pairs of sub-buckets, so no task gets an
unbounded bucket and no pair is left out. Runs repeat until a pair at the threshold is missed with less than 1 - recall even if all its
shared tokens are in large buckets, that is if it must survive every split down to `depth`.

Comparisons in buckets use the samples and only gather sets into coarse groups; the whole n-gram sets then
decide inside each group, in blocks, which pairs are linked, how many links each set has, and what the
classes are. Pairs are counted where they are found: no table of pairs is built, only spanning links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, table
from .components import components
from .hashing import U, mix, shingle_sets

FULL = (1 << 64) - 1


def limit(size: np.ndarray, sample: int) -> np.ndarray:
    """Hashes below it are in the sample of a set of that size."""
    share = np.minimum(sample / np.maximum(size, 1), 1.0)
    return np.where(share >= 1.0, U(FULL), (share * 2.0**64 * (1 - 2**-50)).astype(U))


def alike(sets: list[np.ndarray], limits: np.ndarray, threshold: float, split: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j > i with Jaccard of at least threshold below the lesser limit). With `split`, only pairs of one set
    before and one from split on."""
    lengths = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    values, ids = np.unique(flat, return_inverse=True)
    cuts = np.searchsorted(values, limits)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    marked = np.zeros(len(values), dtype=bool)
    for i in range(len(sets) - 1 if split is None else split):
        lo = i + 1 if split is None else split
        own = ids[starts[i] : starts[i + 1]]
        marked[own] = True
        rest, offsets = ids[starts[lo] :], starts[lo:-1] - starts[lo]
        shared = np.add.reduceat(marked[rest], offsets, dtype=np.int64)
        marked[own] = False
        mine = np.searchsorted(own, cuts[lo:])
        theirs = lengths[lo:] if cuts[i] >= cuts[lo:].max() else np.add.reduceat(rest < cuts[i], offsets, dtype=np.int64)
        found = shared >= threshold * (mine + theirs - shared) - 1e-9
        yield i, np.flatnonzero(found & (shared > 0)) + lo


def forest(names: list[bytes], found: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[bytes, bytes]]:
    """Spanning links of the graph of the given neighbours: each vertex with the least name of its component, so
    that groups with the same members give the same links."""
    label = np.arange(len(names))
    for i, js in found:
        if len(js):
            met = np.append(label[js], label[i])
            label[np.isin(label, met)] = met.min()
    order = np.argsort(label, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(part) > 1:
            own = [names[k] for k in part]
            least = min(own)
            yield from ((least, x) for x in own if x != least)


def embed(docs: DataFrame, width: int, sample: int) -> DataFrame:
    """(id, t, s, size, sample) of (id, t, text): s is a 128-bit signature of the n-gram set, null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                sets = shingle_sets([(t or "").encode() for t in batch.column(2).to_pylist()], width)
                ends = limit(np.array([len(x) for x in sets]), sample)
                samples = [x[: np.searchsorted(x, e, "right")] for x, e in zip(sets, ends)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in samples], pa.binary()),
                ], names=["id", "t", "s", "size", "sample"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, t long, s binary, size int, sample binary")


def choose(nodes: DataFrame, sample: int, branch: float) -> DataFrame:
    """(s, path) of the children of nodes (s, size, sample, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x, dtype=U) for x in batch.column(2).to_pylist()]
            if not tokens:
                continue
            row = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
            paths = np.array(batch.column(3).to_pylist(), dtype=np.int64).view(U)
            share = np.minimum(branch / np.minimum(np.array(batch.column(1).to_pylist(), dtype=float), sample), 1.0)
            child = mix(np.concatenate(tokens) ^ mix(paths)[row])
            keep = (mix(child) >> U(11)).astype(float) * 2.0**-53 < share[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), pa.array(child[keep].view(np.int64))], names=["s", "path"])

    return nodes.select("s", "size", "sample", "path").mapInArrow(run, "s binary, path long")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first `keys` columns, of a sorted partition."""
    run: list[tuple] = []
    for batch in pieces(batches, 256):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if run and row[:keys] != run[0][:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def in_blocks(df: DataFrame, key: str, n: Column) -> DataFrame:
    """Deals the rows of each key into n sub-buckets and gives each row once for every pair of sub-buckets that it
    takes part in: (key, i, j, side). Keys of one sub-bucket have the one pair (0, 0)."""
    own = df.withColumn("_n", F.greatest(n, F.lit(1)).cast("int"))
    own = own.withColumn("_own", F.pmod(F.xxhash64("s", key), F.col("_n")).cast("int"))
    rows = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_n", "_own", "_other")


def compare(rows: DataFrame, key: str, sample: int, near: float) -> DataFrame:
    """Spanning links (a, b) among the sets of each (key, i, j) group, by their samples."""
    rows = rows.select(key, "i", "j", "side", "s", "size", "sample").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "side", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in groups(batches, 3):
            split = sum(r[3] == 0 for r in group) if group[0][1] != group[0][2] else None
            if len(group) > 1 and split not in (0, len(group)):
                sets = [np.frombuffer(r[6], dtype=U) for r in group]
                for x, y in forest([r[4] for r in group], alike(sets, limit(np.array([r[5] for r in group]), sample), near, split)):
                    a.append(x)
                    b.append(y)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def alone(df: DataFrame) -> DataFrame:
    """Rows of buckets that are compared as they are, with the one pair (0, 0) of `in_blocks`."""
    return df.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})


def cores(probes: DataFrame, sample: int, near: float, share: float = 0.1) -> DataFrame:
    """(path, c, s, size, sample, bar): the probes of a bucket around which at least `share` of the others lie, greedily,
    so that each brings as many more. The bar is the similarity that counts: halfway between near and 1 where this reaches
    half of the probes, else near, or more if near is low."""
    rows = probes.select("path", "c", "s", "size", "sample").repartition("path").sortWithinPartitions("path", "s")
    bars = [min(max(x, 1.2 - near), 1.0) for x in ((1 + near) / 2, near)]  # sets that share nothing with a core are never near to its own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in groups(batches, 1):
            sets, ends = [np.frombuffer(r[4], dtype=U) for r in group], limit(np.array([r[3] for r in group]), sample)
            for bar in bars:
                close, left, taken = np.eye(len(sets), dtype=bool), np.ones(len(sets), dtype=bool), []
                for i, js in alike(sets, ends, bar):
                    close[i, js] = close[js, i] = True
                while (gain := (close & left).sum(axis=1)).max() >= max(3, share * len(sets)):
                    taken.append(int(gain.argmax()))
                    left &= ~close[taken[-1]]
                if 2 * left.sum() <= len(sets):
                    break
            out += [(*group[k], bar) for k in taken]
        columns, kinds = list(zip(*out)) or [[]] * 6, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=["path", "c", "s", "size", "sample", "bar"])

    return rows.mapInArrow(run, "path long, c long, s binary, size int, sample binary, bar double")


def around(rows: DataFrame, found: DataFrame, sample: int, near: float, leaf: int) -> DataFrame:
    """Spanning links (a, s) of each core's sets, and with null a the rows (path, s, size, sample) that no core settles.

    rows: (path, c, s, size, sample) of the buckets that have cores. Unlikeness obeys the triangle inequality: if a set is
    within 1 - bar of a core, all that are near to it are within 1 - bar + 1 - near of that core. These are linked to the
    core, so the set needs no more comparisons. Rows are dealt into parts of about `leaf`, each of which gets the cores."""
    n = F.ceil(F.col("c") / F.lit(leaf)).cast("int")
    own = F.pmod(F.xxhash64("s", "path"), n).cast("int")
    names = ["path", "part", "side", "s", "size", "sample", "bar"]
    members = rows.withColumns({"part": own, "side": F.lit(1), "bar": F.lit(None).cast("double")}).select(names)
    centres = found.withColumns({"part": F.explode(F.sequence(F.lit(0), n - 1)), "side": F.lit(0)}).select(names)
    dealt = centres.union(members).repartition("path", "part").sortWithinPartitions("path", "part", "side", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            split, out = sum(r[2] == 0 for r in group), []
            if split < len(group):
                sets, ends = [np.frombuffer(r[5], dtype=U) for r in group], limit(np.array([r[4] for r in group]), sample)
                bar, settled = group[0][6], np.zeros(len(group), dtype=bool)
                for _, js in alike(sets, ends, bar, split):
                    settled[js] = True
                out += [(None, y, None, None, x) for x, y in forest([r[3] for r in group], alike(sets, ends, bar + near - 1, split))]
                out += [(r[0], r[3], r[4], r[5], None) for r, gone in zip(group[split:], settled[split:]) if not gone]
            columns, kinds = list(zip(*out)) or [[]] * 5, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=["path", "s", "size", "sample", "a"])

    return dealt.mapInArrow(run, "path long, s binary, size int, sample binary, a binary")


def thinned(rows: DataFrame, sample: int, near: float, leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """Spanning links (a, b) around the cores of large buckets, and the rows (path, c, s, size, sample) that are left to
    compare with each other; c is the number of those in the bucket. Each round takes every row at most once and gives
    it to one task; buckets of more than `leaf` rows in which cores are found again go through another."""
    links, rest, rows = [], [], cut(rows, "large")
    while True:
        lot = F.pmod(F.xxhash64("s", "path", F.lit(len(links))), F.lit(1 << 30)) * F.col("c")
        found = cut(cores(rows.filter(lot < F.lit(24 << 30)), sample, near), "cores")
        if found.isEmpty():
            return links, reduce(DataFrame.union, rest, rows)
        having = found.select("path").distinct()
        made = cut(around(rows.join(having, "path", "left_semi"), found, sample, near, leaf), "around")
        links.append(made.filter("a is not null").select("a", F.col("s").alias("b")))
        left = made.filter("a is null").drop("a")
        left = left.join(left.groupBy("path").agg(F.count("*").alias("c")), "path").select("path", "c", "s", "size", "sample")
        rest += [rows.join(having, "path", "left_anti"), left.filter(F.col("c") <= leaf)]
        rows = cut(left.filter(F.col("c") > leaf), "large")


def repetitions(recall: float, threshold: float, per_run: float, sample: int, branch: float, depth: int) -> tuple[int, int]:
    """(runs, splits): with that many runs a pair at the threshold is missed with at most 1 - recall even if all its
    buckets are split down to `depth`, each root bucket as many times as `splits` says.

    Each node of a run's tree passes the pair on to a Poisson number of children. The pair's shared tokens in the
    samples are the same in all runs; their number is Poisson, too."""
    mean = sample * threshold
    shared = np.arange(int(mean + 12 * math.sqrt(mean) + 12))
    weight = np.exp(shared * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in shared]))
    lost = np.zeros(len(shared))
    for _ in range(depth - 2):
        lost = np.exp(-branch * shared / sample * (1 - lost))

    def missed(runs: int, root_lost: np.ndarray) -> float:
        return float((weight * np.exp(-runs * per_run * shared / sample * (1 - root_lost))).sum())

    runs = splits = 1
    while missed(runs, np.zeros(len(shared))) > (1 - recall) / 2:
        runs += 1
    while depth > 1 and missed(runs, np.exp(-splits * branch * shared / sample * (1 - lost))) > 1 - recall:
        splits += 1
    return runs, splits


def buckets(nodes: DataFrame) -> DataFrame:
    """(path, c, x): the buckets of at least two sets, their size and a hash of their members."""
    return nodes.groupBy("path").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("s")).alias("x")).filter("c > 1")


def once(found: DataFrame) -> DataFrame:
    """(path, c) of the buckets, one of those with the same members."""
    return found.groupBy("c", "x").agg(F.min("path").alias("path")).select("path", "c")


def unsettled(nodes: DataFrame, hot: DataFrame, threshold: float, recall: float, sample: int) -> DataFrame:
    """(s) of the sets whose paths outside of large buckets are too few to meet every similar set there.

    A set at the threshold lacks at most a share 1 - threshold of this one's k paths. Should all that it lacks be
    among the q paths outside of large buckets, each of these is lacked with probability (1 - threshold) * k / q, all of
    them with that to the power q; less, as k paths of several runs stand on fewer different tokens of the sample.
    hot: the nodes in large buckets."""
    k = nodes.groupBy("s").agg(F.count("*").alias("k"))
    h = hot.groupBy("s").agg(F.count("*").alias("h"))
    both = h.join(k, "s").select("s", (F.col("k") - F.col("h")).alias("q"), (F.col("k") * max(1 - threshold, 1e-9)).alias("u"),
                                      (sample * (1 - F.pow(F.lit(1 - 1 / sample), "k")) / F.col("k")).alias("tokens"))
    settled = (F.col("q") > F.col("u")) & (F.col("tokens") * F.col("q") * F.log(F.col("u") / F.col("q")) <= math.log(1 - recall))
    return both.filter(~settled).select("s")


def coarse_links(sets: DataFrame, threshold: float, recall: float, sample: int, leaf: int, branch: float, depth: int, near: float, blocks: int = 8) -> DataFrame:
    """Spanning links among sets that are near by their samples, found by chosen paths.

    Root buckets of up to `leaf` sets are compared. Only the sets that these leave unsettled go on with their large
    buckets. Where many sets of such a bucket are alike, those around its cores are settled by them. If up to `blocks` times
    `leaf` sets are left, these are compared in blocks, which costs less than to split them; of more, the bucket is split."""
    per_run = 4.0
    runs, splits = repetitions(recall, threshold, per_run, sample, branch, depth)
    roots = F.explode(F.array(*[F.lit(int(mix(np.array([r + 1], dtype=U)).view(np.int64)[0])) for r in range(runs)]))
    nodes = cut(choose(sets.withColumn("path", roots), sample, per_run), "paths")
    sub = F.ceil(F.col("c") / F.lit(leaf))
    every = cut(buckets(nodes), "buckets")
    ready = nodes.join(once(every.filter(F.col("c") <= leaf)), "path").join(sets, "s")
    found = cut(compare(alone(ready), "path", sample, near), "near")
    large = every.filter(F.col("c") > leaf)
    if large.isEmpty():
        return found
    hot = cut(nodes.join(large.select("path"), "path", "left_semi"), "hot")
    open_sets = cut(unsettled(nodes, hot, threshold, recall, sample), "unsettled")
    live = cut(sets.join(open_sets, "s", "left_semi"), "live")
    nodes = cut(hot.join(open_sets, "s", "left_semi"), "paths")
    for level in range(1, depth + 1):
        every = cut(buckets(nodes), "buckets")
        # Of buckets with the same members one is enough to compare, but each is split: their trees are repetitions.
        stats = cut(once(every), "distinct-buckets")
        ready = nodes.join(stats, "path").join(live, "s").select("path", "c", "s", "size", "sample")
        small, split = ready.filter(F.col("c") <= leaf), None
        if not stats.filter(F.col("c") > leaf).isEmpty():
            links, rest = thinned(ready.filter(F.col("c") > leaf), sample, near, leaf)
            found = reduce(DataFrame.union, links, found)
            small = small.union(rest.filter(F.col("c") <= leaf))
            whole = rest.filter(F.col("c") > leaf)
            if level < depth:
                split = cut(whole.filter(F.col("c") > blocks * leaf).select(F.col("path").alias("kept"), "s"), "split")
                split = None if split.isEmpty() else split
                whole = whole.filter(F.col("c") <= blocks * leaf)
            found = found.union(cut(compare(in_blocks(whole, "path", sub), "path", sample, near), "near"))
        found = found.union(cut(compare(alone(small), "path", sample, near), "near"))
        if split is None:
            return found
        alike_paths = every.join(stats.withColumnRenamed("path", "kept").join(every.select(F.col("path").alias("kept"), "x"), "kept"), ["c", "x"]).select("path", "kept")
        nodes = cut(choose(split.join(alike_paths, "kept").join(live, "s"), sample, branch * splits if level == 1 else branch), "paths")
    return found


def exact_links(texts: DataFrame, width: int, threshold: float, block: int, block_grams: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(links per set: s, n_links, n_text_links) and (spanning links: a, b) among the sets of each group.

    texts: (s, text, copies, component, members, grams), one row per set; members and grams are the sets and n-grams of
    its group. Sub-buckets hold about `block` sets or `block_grams` n-grams, whatever comes first."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                made = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], width)
                same = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() == s for x, s in zip(made, batch.column(0).to_pylist())]
                columns = [batch.column(0), *batch.columns[2:], pa.array([x.tobytes() for x in made], pa.binary())]
                out = pa.RecordBatch.from_arrays(columns, names=["s", "copies", "component", "n", "grams"])
                yield out.filter(pa.array(same))

    n = F.greatest(F.ceil(F.col("members") / F.lit(block)), F.ceil(F.col("grams") / F.lit(block_grams)))
    rows = texts.select("s", "text", "copies", "component", n.cast("long").alias("n")).mapInArrow(sets, "s binary, copies long, component binary, n long, grams binary")
    rows = in_blocks(rows, "component", F.col("n")).select("component", "i", "j", "side", "s", "copies", "grams")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            split = sum(r[3] == 0 for r in group) if group[0][1] != group[0][2] else None
            if len(group) < 2 or split in (0, len(group)):
                continue
            copies = np.array([r[5] for r in group])
            links, others, a, b = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64), [], []

            def counted() -> Iterator[tuple[int, np.ndarray]]:
                for i, js in alike([np.frombuffer(r[6], dtype=U) for r in group], np.full(len(group), FULL, dtype=U), threshold, split):
                    links[i] += copies[js].sum()
                    links[js] += copies[i]
                    others[i] += len(js)
                    others[js] += 1
                    yield i, js

            for x, y in forest([r[4] for r in group], counted()):
                a.append(x)
                b.append(y)
            k = len(a)
            hit = np.flatnonzero(others)
            yield pa.RecordBatch.from_arrays([
                pa.array(a + [group[i][4] for i in hit], pa.binary()), pa.array(b + [None] * len(hit), pa.binary()),
                pa.array([0] * k + links[hit].tolist(), pa.int64()), pa.array([0] * k + others[hit].tolist(), pa.int64()),
            ], names=["a", "b", "n_links", "n_text_links"])

    found = cut(rows.mapInArrow(run, "a binary, b binary, n_links long, n_text_links long"), "exact")
    sums = found.filter("b is null").groupBy(F.col("a").alias("s")).agg(F.sum("n_links").alias("n_links"), F.sum("n_text_links").alias("n_text_links"))
    return sums, found.filter("b is not null").select("a", "b")


def classes_of(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, sample: int = 64, leaf: int = 512,
               branch: float = 2.0, depth: int = 6, block: int = 512, near: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, t (64-bit hash of the text), s (signature of its n-gram set, null without words),
    class (least signature of the class), class_id, n_links, n_text_links. Parameters as for jaccard_join."""
    near = threshold - 0.2 if near is None else near
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    placed = cut(embed(docs, width, sample), "sets")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "t")
    sets = cut(placed.filter("s is not null").groupBy("s").agg(
        F.min(first).alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size"), F.min("sample").alias("sample")), "distinct-sets")
    groups_of = components(coarse_links(sets.select("s", "size", "sample"), threshold, recall, sample, leaf, branch, depth, near))
    members = cut(groups_of.join(sets.select("s", "rep", "copies", "size"), F.col("v") == F.col("s")).select("s", "rep", "copies", "size", "component"), "grouped")
    sizes = cut(members.groupBy("component").agg(F.count("*").alias("members"), F.sum("size").alias("grams")), "group-sizes")
    members = cut(members.join(sizes, "component").select("s", F.col("rep.id").alias("_id"), F.col("rep.t").alias("_t"), "copies", "component", "members", "grams"), "members")
    # Repeated rows of an id and text give their text once.
    texts = docs.join(members, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))
    texts = texts.groupBy("s", "copies", "component", "members", "grams").agg(F.min("text").alias("text"))
    sums, spanning = exact_links(texts, width, threshold, block)
    reps = components(spanning).join(sets.select("s", "rep"), F.col("v") == F.col("s"))
    least = cut(reps.groupBy("component").agg(F.min("rep").alias("least")), "class-ids")
    linked = reps.join(least, "component").select("s", F.col("component").alias("class"), "least").join(sums, "s", "left")
    info = cut(sets.select("s", "rep", "copies").join(linked, "s", "left").select(
        "s", F.coalesce("class", "s").alias("class"), F.coalesce("least", "rep")["id"].alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links")), "classes")
    rows = placed.select("id", "t", "s").join(info, "s", "left")
    return rows.select("id", "t", "s", "class", F.when(F.col("s").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                       F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id_col, class_id, n_links, n_text_links.

    Two rows are linked if the Jaccard similarity of their sets of `width`-word runs is at least threshold.
    class_id is the least id of the connected class, n_links the number of other rows linked to this one (copies
    count each) and n_text_links that of other n-gram sets. A text with fewer words is one run; a text without
    words (null, empty, blank) has no links and is a class of its own. Repeated rows are copies of each other;
    null ids rank above all others as class ids. An empty table gives an empty result.

    Options (defaults): threshold (0.8), width (5), recall (0.9999), sample (64 n-grams a set), leaf (512 sets that are
    compared at once), branch (2.0) and depth (6) of the splits, block (512 sets that are compared exactly at once),
    near (threshold - 0.2, about four standard errors: similarity of samples that brings sets into one coarse group)."""
    rows = classes_of(docs, id_col=id_col, text_col=text_col, **options)
    return rows.select(F.col("id").alias(id_col), "class_id", "n_links", "n_text_links")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate class, with all its columns: the one of the least id, null ids last; of rows that
    share that id in one class the one with the least hash of its text, of rows that repeat both any one.

    Rows without words (null, empty or blank text) are classes of their own and all stay. Other rows that share an id
    belong to the classes of their texts. An empty table gives an empty result."""
    classes = classes_of(docs, id_col=id_col, text_col=text_col, **options)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "t")
    heads = classes.filter("s is not null").groupBy("class").agg(F.min(order).alias("head"))
    heads = heads.select(F.col("head.id").alias("id"), F.col("head.t").alias("t"))
    times = classes.filter("s is not null").groupBy("id", "t").agg(F.count("*").alias("_times"))
    kept = heads.join(times, heads["id"].eqNullSafe(times["id"]) & (heads["t"] == times["t"])).select(heads["id"].alias("_id"), heads["t"].alias("_t"), "_times")
    blank = classes.filter("s is null").select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.lit(0).cast("long").alias("_times")).distinct()
    held = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    rows = held.join(cut(kept.union(blank), "class-heads"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))
    # Rows that repeat both id and text are rare: only they are compared once more.
    return rows.filter("_times < 2").union(rows.filter("_times > 1").dropDuplicates(["id", "t"])).select("doc.*")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents; those without words are in no class with others and have no links."""
    return jaccard_join(table(spark, sf_dir, "documents"))
