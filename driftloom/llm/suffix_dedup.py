"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix is indexed where it starts at an anchor: the position whose `seed`-byte hash is least (the leftmost
such) in some window of `length` bytes. Equal windows have their anchor at the same place, so every string of
`length` bytes that stands twice is found through anchors, of which there is about one in 185 bytes. Each anchor
has the range of window starts that it answers for and a context, the bytes of all these windows.

A batch of documents becomes an array of its distinct (suffix key, context) entries, sorted by key: the key
is a hash of the seed, one fixed order in which equal seeds are neighbours. A new array is merge-scanned
against every level for shared keys, and levels of equal size merge into one of the next size, so n batches
leave at most log2(n) + 1 levels and each entry is rewritten at most log2(n) times.

Entries of shared keys decide: a context that stands twice repeats whole; contexts that share only their key
are compared window by window at the same distance from the anchor.

Passages are runs of words that stand in more than one document, however their words are spaced. They are found
through anchors alike, over hashes of words instead of bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, pieces, table
from .hashing import BASE, U, mix, powers, prefix_sums
from .ngram_join import groups

TOP = U((1 << 64) - 1)
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """m[p] = min(h[p : p + w]) for every p with a whole window."""
    n = len(h)
    pad = np.full(-n % w, TOP, dtype=U)
    blocks = np.concatenate([h, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, anchor, first window start, last window start) over the documents that lie in data, each followed by
    one byte, with the given ends. Positions are in data."""
    none = np.zeros(0, dtype=np.int64)
    w = length - seed + 1
    if len(data) < length:
        return none.view(U), none, none, none
    c = prefix_sums(data)
    h = mix((c[seed:] - c[:-seed]) * powers(BASE, len(data))[: len(data) - seed + 1])
    m = sliding_min(h, w)
    whole = np.zeros(len(m), dtype=bool)
    for end, n in zip(ends, lengths):
        if n >= length:
            whole[end - n : end - length + 1] = True
    change = np.ones(len(m), dtype=bool)
    change[1:] = (m[1:] != m[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change & whole)
    if not len(first):
        return none.view(U), none, none, none
    bounds = np.append(np.flatnonzero(change), len(m))
    last = bounds[np.searchsorted(bounds, first, "right")] - 1
    at = np.concatenate([first[i : i + 1024] + h[first[i : i + 1024, None] + np.arange(w)].argmin(1) for i in range(0, len(first), 1024)])
    again = last > at  # the least hash stands more than once in the run: later windows take later places
    parts = [(at[~again], first[~again], last[~again])]
    for p, r in zip(first[again], last[again]):
        places = np.flatnonzero(h[p : r + w] == m[p]) + p
        los = np.concatenate([[p], places[:-1] + 1])
        his = np.minimum(places, r)
        ok = los <= his
        parts.append((places[ok], los[ok], his[ok]))
    at, first, last = (np.concatenate(x) for x in zip(*parts))
    return h[at], at, first, last


def _segments(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[list[tuple]]:
    """Lists of (d, t, offset, bytes) that hold about `size` bytes. Documents are cut so that each window of `length`
    bytes lies whole in just one piece; where a long one is cut makes no difference to what repeats."""
    held, n = [], 0
    for batch in pieces(batches, 64):
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (text or "").encode()
            t = hashlib.md5(data).digest()
            for at in range(0, len(data) - length + 1, size):
                part = data[at : at + size + length - 1]
                held.append((d, t, at, part))
                n += len(part)
                if n >= size:
                    yield held
                    held, n = [], 0
    yield held


def kept_entries(docs: DataFrame, length: int, seed: int, batches: int) -> DataFrame:
    """The entries of docs (d, text) as a table in the shared folder, each with its batch, so that each text is read and
    hashed once. A text and its copies are in one batch."""
    batch = F.pmod(F.xxhash64("t"), F.lit(batches)).cast("int")
    return cut(entries(docs, length, seed).withColumn("batch", batch), "suffix-entries")


def _entries(batches: Iterator[pa.RecordBatch], length: int, seed: int, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(d, t, key, ctx, q, lo, hi) of (d, text): the anchor q in its document, window starts q + lo ... q + hi."""
    for held in _segments(batches, length, size):
        joined = b"\n".join([*(x[3] for x in held), b""])
        lengths = np.array([len(x[3]) for x in held], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        key, at, first, last = anchors(np.frombuffer(joined, dtype=np.uint8), ends, lengths, length, seed)
        part = np.searchsorted(ends, at)
        lo, hi = first - at, last - at
        ctx = [hashlib.blake2b(joined[a : b + length], digest_size=14).digest() + int(-x).to_bytes(2, "little") for a, b, x in zip(first.tolist(), last.tolist(), lo.tolist())]
        took = pa.array(part)
        offset = np.array([x[2] for x in held], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in held], pa.string()).take(took), pa.array([x[1] for x in held], pa.binary()).take(took), pa.array(key.view(np.int64)), pa.array(ctx, pa.binary()),
            pa.array(at - (ends - lengths)[part] + offset[part]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
        ], names=["d", "t", "key", "ctx", "q", "lo", "hi"])


def entries(docs: DataFrame, length: int, seed: int) -> DataFrame:
    return docs.select("d", "text").mapInArrow(lambda b: _entries(b, length, seed), "d string, t binary, key long, ctx binary, q long, lo int, hi int")


class IndexFamily:
    """Levels of suffix arrays, each as large as a power of two of batches, the largest first. Two last levels of
    equal size merge when the next batch comes."""

    def __init__(self, length: int, seed: int):
        self.length, self.seed = length, seed
        self.levels: list[tuple[int, DataFrame]] = []
        self.hits: list[DataFrame] = []

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        merged = rows.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
        return cut(merged.sortWithinPartitions("key", "ctx"), "suffixes")

    def add(self, docs: DataFrame) -> None:
        """docs: (d, text)."""
        self.add_entries(entries(docs, self.length, self.seed))

    def add_entries(self, rows: DataFrame) -> None:
        """rows: the entries of a new batch. Merges levels of equal size first, then scans the new array against all
        levels."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, last), (_, before) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._merge(before.union(last))))
            discard(before, last)
        array = self._merge(rows.select("key", "ctx", F.lit(1).cast("long").alias("n"), F.struct("t", "d", "q", "lo", "hi").alias("at")))
        self.hits.append(cut(array.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "hits"))
        for _, level in self.levels:
            self.hits.append(cut(array.select("key").join(level.select("key"), "key", "left_semi"), "hits"))
        self.levels.append((1, array))

    def shared(self) -> DataFrame:
        """Entries (key, ctx, n, at) of all keys that were hit. The levels are used up."""
        keys = cut(reduce(DataFrame.union, self.hits).distinct(), "shared-keys")
        levels = [level for _, level in self.levels]
        rows = self._merge(reduce(DataFrame.union, levels).join(keys, "key", "left_semi"))
        discard(keys, *self.hits, *levels)
        self.hits, self.levels = [], []
        return rows


def _windows(context: bytes, length: int) -> np.ndarray:
    data = np.frombuffer(context, dtype=np.uint8)
    c = prefix_sums(data)
    return (c[length:] - c[:-length]) * powers(BASE, len(data))[: len(data) - length + 1]


def _equal_bytes(group: list[tuple], owner: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows `left` and `right`, equal by their hashes, are equal byte for byte. Windows of the same two
    contexts at successive offsets are compared as one stretch."""
    a, b, o = owner[left], owner[right], offsets[left]
    by = np.lexsort((o, b, a))
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]]) | (np.diff(o[by]) > 1)
    out = np.zeros(len(by), dtype=bool)

    def at(k: int, lo: int, n: int) -> bytes:
        first = lo - group[k][2]
        return group[k][3][first : first + n]

    starts = np.flatnonzero(fresh)
    for first, end in zip(starts, np.append(starts[1:], len(by))):
        x, y, lo, n = a[by[first]], b[by[first]], int(o[by[first]]), int(end - first)
        if at(x, lo, n + length - 1) == at(y, lo, n + length - 1):
            out[by[first:end]] = True
        else:
            out[by[first:end]] = [at(x, lo + k, length) == at(y, lo + k, length) for k in range(n)]
    return out


def repeated_starts(contexts: DataFrame, length: int, most: int) -> DataFrame:
    """(key, ctx, lo, hi): window starts, from the anchor, whose windows stand in another context of their key.
    contexts: (key, ctx, lo, m, context), m distinct contexts in the key. Keys of more than `most` contexts are
    spread by window instead of meeting in one task."""
    few = contexts.filter(F.col("m") <= most).select("key", "ctx", "lo", "context").repartition("key").sortWithinPartitions("key", "ctx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in groups(batches, 1):
            group = [r for k, r in enumerate(group) if not k or r[1] != group[k - 1][1]]
            windows = [_windows(r[3], length) for r in group]
            offsets = np.concatenate([np.arange(len(x)) + r[2] for x, r in zip(windows, group)])
            owner = np.repeat(np.arange(len(group)), [len(x) for x in windows])
            both = np.concatenate(windows)
            order = np.lexsort((both, offsets))
            o, v = offsets[order], both[order]
            same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
            same[same] = _equal_bytes(group, owner, offsets, order[:-1][same], order[1:][same], length)
            twice = np.zeros(len(order), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            hit = np.flatnonzero(twice)
            if len(hit):
                fresh = np.ones(len(hit), dtype=bool)
                fresh[1:] = (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])
                starts = np.flatnonzero(fresh)
                stops = np.append(starts[1:], len(hit)) - 1
                rows += [(group[owner[hit[a]]][0], group[owner[hit[a]]][1], int(offsets[hit[a]]), int(offsets[hit[b]])) for a, b in zip(starts, stops)]
            if len(rows) > 5000:
                yield made(rows)
                rows = []
        yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], names=["key", "ctx", "lo", "hi"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 512):
            rows = [_windows(x, length).view(np.int64) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tolist() for x in rows], pa.list_(pa.int64()))], names=["key", "ctx", "lo", "hash"])

    many = contexts.filter(F.col("m") > most).select("key", "ctx", "lo", "context").repartition("key", "ctx").mapInArrow(hashes, "key long, ctx binary, lo int, hash array<bigint>")
    many = many.select("key", "ctx", "lo", F.posexplode("hash").alias("p", "hash")).select("key", "ctx", (F.col("lo") + F.col("p")).alias("lo"), "hash").distinct()
    twice = many.groupBy("key", "lo", "hash").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    many = many.join(twice, ["key", "lo", "hash"]).select("key", "ctx", "lo", F.col("lo").alias("hi"))
    return few.mapInArrow(run, "key long, ctx binary, lo int, hi int").union(many)


def merged_spans(spans: DataFrame) -> DataFrame:
    """(t, spans): the spans (t, a, b) of each text joined where they touch. Spans come sorted, as a stream, so a task
    holds only the joined ones of a text, at most one for every window length of its bytes."""
    rows = spans.repartition("t").sortWithinPartitions("t", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        names: list[bytes] = []
        runs: list[list[dict]] = []
        for batch in batches:
            for t, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                if not names or names[-1] != t:
                    if len(names) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(runs, kind)], names=["t", "spans"])
                        names, runs = [], []
                    names.append(t)
                    runs.append([{"a": a, "b": b}])
                elif a <= runs[-1][-1]["b"]:
                    runs[-1][-1]["b"] = max(runs[-1][-1]["b"], b)
                else:
                    runs[-1].append({"a": a, "b": b})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(runs, kind)], names=["t", "spans"])

    return rows.mapInArrow(run, "t binary, spans array<struct<a:long,b:long>>")


def word_hashes(texts: list[bytes], size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one text after the other, and each text's number of words. About `size`
    bytes are hashed at once."""
    joined = b" ".join([*texts, b""])
    hashes, firsts, at = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(joined):
        gap = SPACE.search(joined, at + size)
        end = gap.end() if gap else len(joined)
        data = np.frombuffer(joined, dtype=np.uint8, count=end - at, offset=at)
        word = (data != 32) & ((data < 9) | (data > 13))
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        c = prefix_sums(data)
        hashes.append(mix((c[last] - c[first]) * powers(BASE, len(data) + 1)[first] + (last - first).astype(U)))
        firsts.append(first + at)
        at = end
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(firsts), ends, "left"), prepend=0)


def _word_anchors(hashes: np.ndarray, counts: np.ndarray, run: int, seed: int, size: int = 1 << 16) -> Iterator[tuple]:
    """(text, key, anchor, first, last, shift, data) by parts of about `size` words: first and last window starts lie in
    data, the hashes of the part; less `shift`, the positions are those in the text. Texts are cut so that each window of
    `run` words lies whole in just one part."""
    begins = np.cumsum(counts) - counts
    held, n = [], 0
    cuts = [(k, at, min(size + run - 1, c - at)) for k, c in enumerate(counts.tolist()) for at in range(0, c - run + 1, size)]
    for i, one in enumerate(cuts):
        held.append(one)
        n += one[2]
        if n < size and i + 1 < len(cuts):
            continue
        texts, offsets, lengths = (np.array(x, dtype=np.int64) for x in zip(*held))
        ends = np.cumsum(lengths + 1) - 1
        data = np.zeros(len(lengths) + n, dtype=U)
        for k, at, length, end in zip(texts, offsets, lengths, ends):
            data[end - length : end] = hashes[begins[k] + at : begins[k] + at + length]
        key, at, first, last = anchors(data, ends, lengths, run, seed)
        part = np.searchsorted(ends, at)
        yield texts[part], key, at, first, last, (ends - lengths - offsets)[part], data
        held, n = [], 0


def word_keys(docs: DataFrame, run: int, seed: int) -> DataFrame:
    """(t, d, w, copies, keys) as a table in the shared folder: each distinct text of docs (d, text) of at least `run`
    words, the least d that has it, its words, its rows, and the distinct keys of its anchors."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 64):
            texts = [(x or "").encode() for x in b.column(1).to_pylist()]
            hashes, counts = word_hashes(texts)
            found = [(part[0], part[1]) for part in _word_anchors(hashes, counts, run, seed)]
            text, key = (np.concatenate(x) for x in zip((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)), *found))
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
            starts = np.flatnonzero(fresh)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[starts], np.arange(len(texts) + 1)).astype(np.int32)), pa.array(key[starts].view(np.int64)))
            rows = pa.RecordBatch.from_arrays([pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()), b.column(0), pa.array(counts.astype(np.int64)), lists], names=["t", "d", "w", "keys"])
            yield rows.filter(pa.array(counts >= run))

    rows = docs.select("d", "text").mapInArrow(keys, "t binary, d string, w long, keys array<long>")
    return cut(rows.groupBy("t").agg(F.min("d").alias("d"), F.first("w").alias("w"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "passage-keys")


def wanted_words(texts: DataFrame) -> DataFrame:
    """(t, d, ws): the texts of word_keys with the keys that other texts have too."""
    texts = texts.withColumn("s", F.xxhash64("t"))
    pairs = texts.select("s", F.explode("keys").alias("key"))
    shared = pairs.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    found = pairs.join(shared, "key").groupBy("s").agg(F.collect_list("key").alias("ws"))
    return texts.select("t", "d", "s").join(found, "s").select("t", "d", "ws")


def passage_spans(picks: DataFrame, run: int, seed: int, most: int) -> DataFrame:
    """(t, a, b): runs of words whose windows of `run` words stand in more than one of the texts of picks (t, z, ws).

    A context is all windows of an anchor; one that several texts have is shared whole. Windows of different contexts
    are equal when the seeds of their anchors, at the same distance, and they themselves have equal 64-bit hashes. Keys
    of more than `most` contexts are spread by window instead of meeting in one task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in pieces(batches, 64):
            t, sets = b.column(0).to_pylist(), [set(x) for x in b.column(2).to_pylist()]
            for text, key, at, first, last, shift, data in _word_anchors(*word_hashes([unpack.decompress(z) for z in b.column(1).to_pylist()]), run, seed):
                keep = np.array([k in sets[i] for i, k in zip(text.tolist(), key.view(np.int64).tolist())], dtype=bool)
                text, key, o, first, last, shift = (x[keep] for x in (text, key, first - at, first, last, shift))
                c, at_power = prefix_sums(mix(data)), powers(BASE, len(data) + 1)
                h = mix((c[run:] - c[:-run]) * at_power[: max(len(data) - run + 1, 0)])
                ctx = mix(mix((c[last + run] - c[first]) * at_power[first]) + mix(o.astype(U)) + (last - first).astype(U))
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array([t[i] for i in text.tolist()], pa.binary()), pa.array(first - shift), pa.array(o),
                    pa.array([h[p : e + 1].tobytes() for p, e in zip(first.tolist(), last.tolist())], pa.binary()),
                ], names=["key", "ctx", "t", "at", "o", "h"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for group in groups(batches, 1):
            held += group
            if len(held) > 2000:
                yield runs(held)
                held = []
        if held:
            yield runs(held)

    def runs(rows: list[tuple]) -> pa.RecordBatch:
        """Of the contexts of some keys that one text has, the windows that contexts of other texts have too."""
        key, ctx, offset, packed, t0, t1 = zip(*rows)
        numbers: dict[bytes, int] = {}
        ids = np.array([[numbers.setdefault(x, len(numbers)) for x in pair] for pair in zip(t0, t1)])
        key, ctx, lengths = np.array(key), np.array(ctx), np.array([len(x) // 8 for x in packed])
        starts, row = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(rows)), lengths)
        h, k, o = np.frombuffer(b"".join(packed), dtype=U), key[row], np.arange(len(row)) - starts[row] + np.array(offset)[row]
        order = np.lexsort((h, o, k))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(k[order]) != 0) | (np.diff(o[order]) != 0) | (h[order[1:]] != h[order[:-1]])
        bounds = np.flatnonzero(fresh)
        several = np.minimum.reduceat(ids.min(1)[row[order]], bounds) != np.maximum.reduceat(ids.max(1)[row[order]], bounds)
        hit = np.zeros(len(order), dtype=bool)
        hit[order] = np.repeat(several, np.diff(np.append(bounds, len(order))))
        hit &= (ids[:, 0] == ids[:, 1])[row]
        before, after = np.append(False, hit[:-1]), np.append(hit[1:], False)
        before[starts] = after[starts + lengths - 1] = False
        first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[row[first]], ctx[row[first]], first - starts[row[first]], last - starts[row[first]])], names=["key", "ctx", "p", "q"])

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 512):
            rows = [np.frombuffer(x, dtype=np.int64).tolist() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rows, pa.list_(pa.int64())), *b.columns[4:]], names=["key", "ctx", "o", "h", "t0", "t1"])

    found = cut(picks.filter("ws is not null").select("t", "z", "ws").mapInArrow(windows, "key long, ctx long, t binary, at long, o long, h binary"), "passage-windows")
    contexts = cut(found.groupBy("key", "ctx").agg(*[F.first(x).alias(x) for x in ("o", "h")], F.min("t").alias("t0"), F.max("t").alias("t1")), "passage-contexts")
    whole = contexts.filter("t0 < t1").select("key", "ctx", F.lit(0).cast("long").alias("p"), (F.octet_length("h") / 8 - 1).cast("long").alias("q"))
    sizes = contexts.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    sized = contexts.join(sizes, "key").select("key", "ctx", "o", "h", "t0", "t1", "m")
    few = sized.filter(F.col("m") <= most).drop("m").repartition("key").sortWithinPartitions("key")
    many = sized.filter(F.col("m") > most).drop("m").mapInArrow(singly, "key long, ctx long, o long, h array<bigint>, t0 binary, t1 binary")
    many = many.select("key", "ctx", "o", "t0", "t1", F.posexplode("h").alias("p", "h")).withColumn("o", F.col("o") + F.col("p"))
    several = many.groupBy("key", "o", "h").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).filter("t0 < t1").select("key", "o", "h")
    many = many.join(several, ["key", "o", "h"]).select("key", "ctx", F.col("p").cast("long").alias("p"), F.col("p").cast("long").alias("q"))
    marked = cut(whole.union(few.mapInArrow(meet, "key long, ctx long, p long, q long")).union(many), "passage-marked")
    return found.select("key", "ctx", "t", "at").join(marked, ["key", "ctx"]).select("t", (F.col("at") + F.col("p")).alias("a"), (F.col("at") + F.col("q") + run).alias("b"))


def remove_repeats(docs: DataFrame, length: int = 400, seed: int = 32, batches: int = 4, most: int = 2048, run: int = 51, run_seed: int = 8,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept (binary), n_shared_words.

    Removes every byte covered by a string of `length` bytes that also starts anywhere else, in any document,
    the same one included. Strings are judged on the input and never cross documents. Null text counts as empty;
    texts shorter than `length` stay whole; repeated rows of at least that length are removed whole; an empty
    table gives an empty result. Whole contexts are known by 112-bit digests; windows of different contexts are
    found by 64-bit hashes and then compared byte for byte, but for keys of more than `most` contexts, whose windows are
    spread over tasks and known by their hashes.

    n_shared_words counts the words of passages, strings of `run` words that also stand in another row, whatever white
    space parts them; what a row repeats only within itself does not count. They are counted, not removed.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    family, found = IndexFamily(length, seed), kept_entries(docs, length, seed, batches)
    for i in range(batches):
        family.add_entries(found.filter(F.col("batch") == i))
    shared = family.shared()
    texts = word_keys(docs, run, run_seed)
    sizes = cut(shared.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key-sizes")
    whole = shared.filter("n > 1").select("key", "ctx", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))

    id_type = docs.schema["id"].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in pieces(batches, 128):
            texts = [x.encode() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()),
                                              pa.array([pack.compress(x) for x in texts], pa.binary())], names=["id", "d", "t", "z"])

    squeezed = docs.mapInArrow(squeeze, f"id {id_type}, d string, t binary, z binary")

    # Contexts that share their key with another one, each from one document that has it; the same for words, by texts.
    wanted = shared.join(sizes, "key").select("at.t", "at.d", F.struct("key", "ctx", "at.q", "at.lo", "at.hi", "m").alias("x"))
    wanted = wanted.groupBy("t", "d").agg(F.collect_list("x").alias("xs"))
    wanted = cut(wanted.join(wanted_words(texts), ["t", "d"], "full_outer"), "wanted")
    picks = cut(squeezed.join(wanted, ["t", "d"]).select("t", "z", "xs", "ws"), "picks")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in pieces(batches, 128):
            for z, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = unpack.decompress(z)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["key"] for x in xs], pa.int64()), pa.array([x["ctx"] for x in xs], pa.binary()), pa.array([x["lo"] for x in xs], pa.int32()),
                    pa.array([x["m"] for x in xs], pa.int64()), pa.array([text[x["q"] + x["lo"] : x["q"] + x["hi"] + length] for x in xs], pa.binary()),
                ], names=["key", "ctx", "lo", "m", "context"])

    contexts = picks.filter("xs is not null").select("z", "xs").mapInArrow(slices, "key long, ctx binary, lo int, m long, context binary")
    marked = cut(whole.union(repeated_starts(contexts, length, most)), "marked")
    spans = found.select("t", "key", "ctx", "q").join(marked, ["key", "ctx"])
    spans = merged_spans(spans.select("t", (F.col("q") + F.col("lo")).alias("a"), (F.col("q") + F.col("hi") + length).alias("b")).distinct())

    covered = merged_spans(passage_spans(picks, run, run_seed, most)).select("t", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]).alias("n"))
    words = texts.filter("copies > 1").select("t", F.col("w").alias("n")).union(covered).groupBy("t").agg(F.max("n").alias("n"))
    spans = cut(spans.join(words, "t", "full_outer"), "spans")
    discard(found, shared, sizes, texts, wanted, picks, marked)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in pieces(batches, 128):
            rows = []
            for z, found, n in zip(*[c.to_pylist() for c in b.columns[1:]]):
                text = unpack.decompress(z)
                gone: list[list[int]] = []
                for a, e in sorted((x["a"], x["b"]) for x in found or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([a, e])
                kept, at = [], 0
                for a, e in gone:
                    kept.append(text[at:a])
                    at = e
                rows.append((len(text), sum(e - a for a, e in gone), len(gone), b"".join([*kept, text[at:]]), n or 0))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "n_shared_words"])

    return squeezed.select("id", "t", "z").join(spans, "t", "left").select("id", "z", "spans", "n").mapInArrow(
        remove, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, n_shared_words long")


def op9_suffix_levels(spark, sf_dir: str) -> DataFrame:
    """All documents; a null text is an empty one, texts of less than 400 bytes stay whole. Passages of over 50 words that
    other documents have too are counted beside, as they may take less than 400 bytes."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words")
