"""Exact, near-duplicate, line and substring dedup against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftloom.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from driftloom.llm.components import components
from driftloom.llm.hashing import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256((text if isinstance(text, bytes) else (text or "").encode())).hexdigest()


def test_radix_dedup(documents, rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    got = exact_dedup.radix_dedup(documents).collect()
    assert len(got) == len(rows)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    expected = Counter((i, best(ids), len(ids), sha(text)) for text, ids in groups.items() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)


def test_radix_levels_and_empty(spark, empty):
    # Texts that part at every level of digits, and one that is the start of another.
    texts = [c * n + d for n in (63, 64, 65, 600, 5000) for c in "ab" for d in ("", "x", "y")] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.radix_dedup(df).collect()
    assert all(r.group_size == 2 and r.keep_id >= len(texts) // 2 for r in got) and sum(r.kept for r in got) == len(texts) // 2
    assert exact_dedup.radix_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_drop_copies_keeps_columns(documents, rows):
    out = exact_dedup.drop_copies(documents)
    assert out.columns == documents.columns
    assert sorted(r.text or "" for r in out.select("text").collect()) == sorted({t or "" for _, t, *_ in rows})


def jaccard_classes(rows, threshold=0.8):
    """(links, class) of each row by all pairs."""
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(text or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    low = lambda ids: min((x for x in ids if x is not None), default=None)
    return Counter((r[0], low(least[find(i)]) if sets[i] else r[0], links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("leaf,block", [(1024, 128), (4, 3)])
def test_jaccard_join(documents, rows, leaf, block):
    got = ngram_join.jaccard_join(documents, leaf=leaf, block=block).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == jaccard_classes(rows)


def test_jaccard_join_empty_and_survivors(documents, rows, empty):
    assert ngram_join.jaccard_join(empty).count() == 0
    kept = ngram_join.one_per_class(documents)
    assert kept.columns == documents.columns
    classes = jaccard_classes(rows)
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in classes}


def test_one_row_a_class(spark):
    """Repeated rows, ids that stand on several texts, null ids and texts without words."""
    near = [" ".join(f"w{i}" for i in range(100)) + tail for tail in ("", " end", " other end")]
    far = " ".join(f"v{i}" for i in range(100))
    rows = [(5, near[0], 1), (5, near[0], 1), (7, near[1], 2), (None, near[2], 3), (5, far, 4), (None, far, 5), (None, "alone in its class", 6), (None, "alone in its class", 6), (8, None, 7), (8, None, 7), (9, " ", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    kept = ngram_join.one_per_class(df)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(5, near[0], 1), (5, far, 4), (None, "alone in its class", 6), (8, None, 7), (8, None, 7), (9, " ", 8)])


def test_settled_sets(spark):
    """Sets leave large buckets only if a similar set must meet them in a small one: all of their paths outside of
    large buckets are lacked by a set at the threshold with less than 1 - recall, even if it lacks none but these."""
    rng = np.random.default_rng(1)
    nodes = spark.createDataFrame([(bytes([s]), s * 100 + p) for s in range(17) for p in range(16)], "s binary, path long")
    hot = nodes.filter("path % 100 < conv(hex(s), 16, 10)")  # set s has s hot paths of 16
    left = {r.s[0] for r in ngram_join.unsettled(nodes, hot, 0.8, 0.9999, 64).collect()}
    most = min(left) - 1
    assert left == set(range(most + 1, 17)) and 4 <= most <= 8
    # The sample has 64 tokens, a share most / 16 of them hot; of the others 13 are lacked; 4 runs take each with 1 in 16.
    cold = 64 - 64 * most // 16
    chosen = rng.random((200_000, 4, cold)) < 1 / 16
    taken = chosen.sum((1, 2)) >= 16 - most
    missed = ~chosen[:, :, 13:].any((1, 2))
    assert (missed & taken).mean() < 2e-4


def test_recall_at_the_threshold(spark):
    """300 pairs of Jaccard 0.80 to 0.82 among other texts: none may be missed."""
    rng, rows = random.Random(5), []
    for k in range(300):
        words = [f"p{k}_{i}" for i in range(300)]
        other = list(words)
        for i in rng.sample(range(5, 295, 9), 6):
            other[i] = "new"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.jaccard_join(df).filter("n_links = 1 and class_id % 2 = 0").count() == 600


def test_recall_of_pairs_in_hot_buckets(spark):
    """300 pairs of Jaccard 0.82 among texts that all share one passage (Jaccard 0.48), so that most buckets of a pair
    are larger than a leaf and must be split: none may be missed."""
    passage, rows = " ".join(f"b{i}" for i in range(195)), []
    for k in range(300):
        both = " ".join(f"p{k}_{i}" for i in range(75))
        rows += [(2 * k + j, f"{passage} {both} " + " ".join(f"o{k}_{j}_{i}" for i in range(30))) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.jaccard_join(df, leaf=32).filter("n_links = 1 and class_id % 2 = 0").count() == 600


def test_large_groups_are_not_dealt_out_by_pairs(spark, monkeypatch):
    """600 texts that are all alike, with leaves of 32: each row of a large bucket is compared with a few cores, not dealt
    out once for each of 19 sub-buckets; all links are found."""
    rng, rows, made, real = random.Random(6), [], [], ngram_join.in_blocks
    for k in range(600):
        words = [f"b{i}" for i in range(300)]
        words[rng.randrange(300)] = f"new{k}"
        rows.append((k, " ".join(words)))

    def counted(df, key, n):
        out = real(df, key, n)
        made.append((key, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "in_blocks", counted)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), leaf=32)
    assert got.filter("n_links = 599 and class_id = 0").count() == 600
    assert sum(n for key, n in made if key == "path") <= 600


@pytest.mark.parametrize("near", [0.6, 0.3])
def test_cores_lose_no_near_pair(spark, near):
    """Two sets of a bucket that are near, by samples that are the whole sets, are linked or both left."""
    rng, sets = np.random.default_rng(3), []
    bases = [rng.integers(1, 1 << 62, 60, dtype=np.uint64) for _ in range(3)]
    for k in range(400):
        kept = bases[k % 3][rng.random(60) < rng.uniform(rng.choice([0.5, 0.97]), 1)]
        sets.append(np.unique(np.append(kept, rng.integers(1, 1 << 62, rng.integers(1, 4), dtype=np.uint64))))
    rows = [(7, len(sets), k.to_bytes(2, "big"), len(x), x.tobytes()) for k, x in enumerate(sets)]
    links, rest = ngram_join.thinned(spark.createDataFrame(rows, "path long, c long, s binary, size int, sample binary"), 64, near, 32)
    group = list(range(len(sets)))
    pairs = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for found in links for r in found.collect()]
    for _ in range(len(sets)):
        before = list(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    left = {int.from_bytes(r.s, "big") for r in rest.collect()}
    assert pairs and len(left) < 350 and all(r.c == len(left) for r in rest.collect())
    tokens = [set(x.tolist()) for x in sets]
    for i in range(len(sets)):
        for j in range(i):
            if len(tokens[i] & tokens[j]) >= near * len(tokens[i] | tokens[j]):
                assert group[i] == group[j] or {i, j} <= left


def test_repetitions_cover_every_split():
    """The numbers of runs and splits against simulated trees: pairs at the threshold must survive every split."""
    rng = np.random.default_rng(2)
    runs, splits = ngram_join.repetitions(0.99, 0.8, 4.0, 64, 2.0, 6)
    shared = rng.poisson(51.2, 200_000)
    alive = rng.poisson(runs * 4.0 * shared / 64)
    for level in range(5):
        alive = rng.poisson(alive * 2.0 * (1 if level else splits) * shared / 64)
    assert (alive == 0).mean() <= 0.0105
    assert ngram_join.repetitions(0.9999, 0.8, 4.0, 64, 2.0, 1)[1] == 1


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)]
    got = {r.v: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


def test_shingle_hashes_follow_the_words():
    texts = ["a b c d e f", "  a\tb\nc d e  f ", "a b", "", " ", "b a", "a b c d e g"]
    sets = shingle_sets([t.encode() for t in texts], 5)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 2]
    assert (sets[0] == sets[1]).all() and sets[2][0] != sets[5][0] and len(np.intersect1d(sets[0], sets[6])) == 1


def strip(line):
    return line.strip(" \t\r\x0b\f")


@pytest.mark.parametrize("min_sites", [3, 10, 14])
def test_cross_site_lines(documents, rows, min_sites):
    sites = defaultdict(set)
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line) and source is not None:
                sites[strip(line)].add(source)
    expected = Counter()
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [bool(WORD.search(x)) and len(sites[strip(x)]) >= min_sites for x in lines]
        expected[doc_id, "\n".join(x for x, g in zip(lines, gone) if not g), sum(bool(WORD.search(x)) for x in lines), sum(gone)] += 1
    got = line_dedup.remove_boilerplate(documents, min_sites).collect()
    assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in got) == expected


def test_lines_of_an_empty_table(empty):
    assert line_dedup.remove_boilerplate(empty).count() == 0


def repeats(texts, length):
    """(n_bytes, n_removed, n_spans, kept) by a dictionary of all windows."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if len(t) else np.zeros(0, dtype=bool)
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept


@pytest.mark.parametrize("most", [2048, 1])
def test_long_repeats(spark, most):
    rng = random.Random(2)
    noise = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n)).decode()
    shared, edge, copy = noise(460), noise(400), noise(900)
    texts = [noise(300) + shared + noise(200), shared + noise(500), noise(250) + shared[:430] + noise(90), noise(100) + shared[20:], edge + noise(10), noise(10) + edge, edge[:399] + noise(50), copy, copy,
             copy[:500] + noise(20) + copy[480:], "x" * 1500, "ab" * 700, noise(399), "", None, "é" * 300 + noise(50) + "é" * 260, noise(450) * 3]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, most=most).collect()}
    expected = dict(enumerate(repeats([(t or "").encode() for t in texts], 400)))
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in expected.items()} and got == expected


def test_long_repeats_of_documents(documents, rows, empty):
    got = Counter((r.doc_id, r.n_removed, sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(documents, batches=2).collect())
    expected = Counter((r[0], e[1], sha(e[3])) for r, e in zip(rows, repeats([(r[1] or "").encode() for r in rows], 400)))
    assert got == expected
    assert suffix_dedup.remove_repeats(empty, batches=1).count() == 0


def shared_words(texts, run):
    """Per text the words that lie in a string of `run` words which another text has too, by a dictionary of all of them."""
    split, owners = [t.split() for t in texts], defaultdict(set)
    for k, words in enumerate(split):
        for i in range(len(words) - run + 1):
            owners[tuple(words[i : i + run])].add(k)
    for words in split:
        hit = {j for i in range(len(words) - run + 1) if len(owners[tuple(words[i : i + run])]) > 1 for j in range(i, i + run)}
        yield len(hit)


@pytest.mark.parametrize("most", [2048, 1])
def test_passages_of_words(spark, most):
    """Passages of 51 short words take less than 400 bytes: they are told by their words, and only across documents."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))
    passage, less, twice, long, copy = words(51), words(50), words(60), words(120), words(70)
    texts = [words(30) + " " + passage + " " + words(40), words(5) + "\n" + passage.replace(" ", "\t\n") + "  " + words(9), passage, words(20) + " " + less + " " + words(20), less + " " + words(30),
             twice + " " + words(7) + " " + twice, long, words(3) + " " + " ".join(long.split()[10:110]) + " " + words(3), " ".join(long.split()[:61]) + " " + words(2) + " " + " ".join(long.split()[70:]),
             copy, copy, "ha " * 300, "ha " * 60, "ha " * 50, words(10), "", None, "\u00a0 " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, most=most).collect()}
    expected = list(shared_words([(t or "").encode() for t in texts], 51))
    assert [got[k].n_shared_words for k in range(len(texts))] == expected
    assert expected[:6] == [51, 51, 51, 0, 0, 0] and len(passage) < 400 and not got[0].n_removed


def test_words_of_cut_texts_are_alike():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "bc", "\tdef", "g\n"]) for _ in range(n)).encode() for n in (0, 40, 3000, 51)]
    whole, counts = suffix_dedup.word_hashes(texts)
    parts, same = suffix_dedup.word_hashes(texts, 100)
    assert counts.tolist() == same.tolist() == [len(t.split()) for t in texts] and (whole == parts).all()
    for size in (1 << 16, 60):
        starts = sorted((k, s) for text, _, _, first, last, shift, _ in suffix_dedup._word_anchors(whole, counts, 51, 8, size) for k, a, b in zip(text.tolist(), (first - shift).tolist(), (last - shift).tolist()) for s in range(a, b + 1))
        assert starts == [(2, s) for s in range(2950)] + [(3, 0)]


def test_passages_of_documents(documents, rows):
    got = Counter((r.doc_id, r.n_shared_words) for r in suffix_dedup.remove_repeats(documents, run=20).collect())
    assert got == Counter((r[0], n) for r, n in zip(rows, shared_words([(r[1] or "").encode() for r in rows], 20)))


def test_cut_documents_repeat_alike():
    """The windows that entries answer for are all windows, once each, wherever a long document is cut."""
    import pyarrow as pa

    rng = random.Random(8)
    text = "".join(rng.choice("abcd ") for _ in range(5000))
    for size in (1 << 18, 700):
        out = pa.Table.from_batches(suffix_dedup._entries(iter([pa.RecordBatch.from_arrays([pa.array(["x", "y"]), pa.array([text, None])], names=["d", "text"])]), 400, 32, size)).to_pylist()
        starts = sorted(s for r in out for s in range(r["q"] + r["lo"], r["q"] + r["hi"] + 1))
        assert starts == list(range(len(text) - 399))


def test_index_levels_merge_geometrically(spark):
    family = suffix_dedup.IndexFamily(40, 8)
    for k in range(7):
        family.add(spark.createDataFrame([(str(k), " ".join(f"w{(k * 37 + i) % 101}" for i in range(60)))], "d string, text string"))
    sizes = [s for s, _ in family.levels]
    assert sum(sizes) == 7 and len(sizes) <= math.log2(7) + 2 and sizes == sorted(sizes, reverse=True)
