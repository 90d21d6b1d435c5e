"""Merkle manifests against a plain recursive version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftloom.llm import merkle

from .conftest import CLASHING


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fan):
    """(root, one list of (left, right) for each node)."""
    steps, at, now = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(now) > 1:
        up, below = [], []
        for i in range(0, len(now), fan):
            run = now[i : i + fan]
            for k in range(len(run)):
                for leaf in at[i + k]:
                    steps[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            below.append([x for b in at[i : i + fan] for x in b])
        now, at = up, below
    return now[0], steps


def plain(rows, fan=8):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*[field(v) for v in r])
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = climb([leaf(r) for r in parts[name]], fan)
    root, over = climb([trees[n][0] for n in names], fan)
    out = []
    for i, name in enumerate(names):
        for r, steps in zip(parts[name], trees[name][1]):
            steps = steps + over[i]
            claimed = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                claimed = leaf((*r[:4], low(r[4])))
            node = claimed
            for left, right in steps:
                node = H(left, node, right)
            out.append((r[0], leaf(r), trees[name][0], root, H(*[x for s in steps for x in s]), node, node == root))
    return sorted(out, key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()])
    leaves = merkle.document_leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lower_ascii(F.col("text")))
    out = merkle.manifest(leaves, "lang", ["doc_id"], **options)
    return sorted([tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


def make(n, langs):
    rows = [(i * 7 % (3 * n), "s", langs[i % len(langs)] if i % 3 else langs[0], i, f"Text {i} ÀÉ" * (i % 4)) for i in range(n)]
    return rows


@pytest.mark.parametrize("n,langs,fan,height", [(1, ["en"], 8, 4), (2, ["en", "de"], 8, 4), (9, ["en"], 8, 1), (300, ["en", None, "de", "fr", ""], 2, 3), (65, ["en"], 8, 1), (130, [f"l{i}" for i in range(40)], 4, 1), (90, ["en", "de"], 3, 2)])
def test_manifest_equals_recursion(spark, n, langs, fan, height):
    rows = make(n, langs)
    assert found(spark, rows, fan=fan, height=height) == plain(rows, fan)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (3, "a", "en", 1, ""), (3, "a", "en", 1, ""), (3, "b", "en", 2, "ABC"), (None, "a", "en", 0, "Z"), (5, "a", "en", None, "X y" * 200_000), (-2, "x", None, 3, "ÀB")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_frontier_extends_witnesses_as_siblings_complete():
    frontier = merkle.Frontier(fan=2, height=3)
    frontier.append("a")
    assert frontier.witness == [[]]
    frontier.append("b")
    assert frontier.witness == [[("", "b")], [("a", "")]]
    frontier.append("c")
    frontier.append("d")
    ab, cd = H("a", "b"), H("c", "d")
    assert frontier.witness[0] == [("", "b"), ("", cd)] and frontier.witness[3] == [("c", ""), (ab, "")]
    assert frontier.finish(alone=True) == H(ab, cd) == merkle.folded("c", *zip(*frontier.witness[2]))
    lonely = merkle.Frontier(fan=2, height=2)
    lonely.append("a")
    assert lonely.finish(alone=False) == H(H("a")) and lonely.witness == [[("", ""), ("", "")]]
