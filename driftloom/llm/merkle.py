"""Merkle manifests of a table: a root over all rows, and for each row a witness that ties it to the root.

Rows of a part (here a language) are leaves in the order of their ids; every `fan` consecutive nodes have one parent,
the parts' roots in their order are nodes of a last tree. Leaves are appended to a `Frontier`, which holds the open
subtrees with partial witnesses of their leaves: when a run of siblings is complete, each witness below it is extended
by the other siblings and the parent is appended one level up. Blocks of fan ** height aligned leaves are streams of
their own, spread over tasks; their roots are further appends, to blocks of blocks, until one node of each part is
left. Witnesses of block roots then go down to their blocks, so no row carries more than its own block's.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import fold_sorted, number_rows
from .common import cut, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """SHA-256 of the values, each `-` if null, else its length in bytes, a colon and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


class Frontier:
    """The open subtrees of a stream of appended nodes, up to `height` levels."""

    def __init__(self, fan: int, height: int, witnesses: bool = True) -> None:
        self.fan, self.height, self.keeps = fan, height, witnesses
        self.open: list[list[tuple[str, list[int]]]] = [[] for _ in range(height + 1)]
        #: Per appended node the digests left and right of its ancestor, level by level.
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        self.witness.append([])
        self._add(0, node, [len(self.witness) - 1] if self.keeps else [])

    def _add(self, level: int, node: str, below: list[int]) -> None:
        run = self.open[level]
        run.append((node, below))
        if len(run) == self.fan and level < self.height:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for i, (_, below) in enumerate(run):
            step = "".join(n for n, _ in run[:i]), "".join(n for n, _ in run[i + 1 :])
            for leaf_ in below:
                self.witness[leaf_].append(step)
        self._add(level + 1, digest(*[n for n, _ in run]), [x for _, below in run for x in below])

    def finish(self, alone: bool) -> str:
        """The root, once nothing more is appended. Without other blocks (`alone`) the last node that is left is the
        root at whatever level it is; else the block's root is at the full height."""
        for level in range(self.height):
            run = self.open[level]
            if alone and len(run) == 1 and not any(self.open[level + 1 :]):
                return run[0][0]
            if run:
                self._complete(level)
        return self.open[self.height][0][0]


STEPS = "lefts array<string>, rights array<string>"


def streamed(rows: Iterable[tuple], block: int, fan: int, height: int, witnesses: bool) -> tuple[Frontier, str]:
    """The frontier to which a block's rows (pos, node, ...) were appended, and the block's root."""
    frontier = Frontier(fan, height, witnesses)
    for _, node, *_ in rows:
        frontier.append(node)
    return frontier, frontier.finish(alone=block == 0)


def levels(nodes: DataFrame, part: str, fan: int, height: int) -> list[DataFrame]:
    """[nodes, roots of their blocks, ...] as (part, pos, node), the last with one node for each part; at least two."""
    out, kind = [nodes.select(part, "pos", "node")], nodes.schema[part].dataType.simpleString()

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        yield key[0], key[1], streamed(rows, key[1], fan, height, witnesses=False)[1]

    while len(out) < 2 or not out[-1].filter("pos > 0").isEmpty():
        rows = out[-1].select(part, F.expr(f"pos div {fan**height}").alias("block"), "pos", "node")
        out.append(cut(fold_sorted(rows, [part, "block"], ["pos"], fold, f"`{part}` {kind}, pos long, node string"), "merkle"))
    return out


def descend(nodes: DataFrame, above: DataFrame, part: str, fan: int, height: int, more: list[str], made: Callable[..., tuple], schema: str) -> DataFrame:
    """made(part, pos, more values, lefts, rights, values of the block) for each of the nodes (part, pos, node, more),
    with its witness up to the root: the one within its block and then the block's own, which `above` (part, pos,
    lefts, rights, values) holds. A block's rows follow its witness in one sorted stream."""
    given = [c for c in above.columns if c not in (part, "pos")]
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = nodes.select(part, F.expr(f"pos div {fan**height}").alias("block"), "pos", "node", *more, *[null(above, c) for c in given])
    heads = above.select(part, F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit("").alias("node"), *[null(nodes, c) for c in more], *given)
    n = len(more)

    def fold(key: tuple, stream: Iterator[tuple]) -> Iterator[tuple]:
        lefts, rights, *values = next(stream)[2 + n :]
        held = [row[: 2 + n] for row in stream]
        frontier, _ = streamed(held, key[1], fan, height, witnesses=True)
        for row, steps in zip(held, frontier.witness):
            yield made(key[0], row[0], row[2:], [s[0] for s in steps] + lefts, [s[1] for s in steps] + rights, values)

    return fold_sorted(rows.unionByName(heads), [part, "block"], ["pos"], fold, schema)


def folded(node: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a node and its witness lead to."""
    for left, right in zip(lefts, rights):
        node = digest(left, node, right)
    return node


def manifest(leaves: DataFrame, part: str, order: list[str], fan: int = 8, height: int = 4) -> DataFrame:
    """The columns of `leaves` (part, order, leaf, claimed) with subroot, root, proof_sha256 (of all digests of the
    leaf's witness), folded_root (of `claimed` under that witness) and verified (whether it is the root).

    A null part is a part of its own, before all others; null orders come first. Rows of one part and order stand by
    their digests; equal ones may change places, which changes neither roots nor what is proved. A part may hold any
    share of the rows: a task holds one block of fan ** height. An empty table gives an empty result. Other columns are
    kept; pos, node, block and the names of the results must not be among them."""
    kept, kind = [c for c in leaves.columns if c != part], leaves.schema[part].dataType.simpleString()
    leaves = cut(leaves, "leaves")  # what digests are made from is read once, not for each pass of the numbering
    numbered = cut(number_rows(leaves, [part], [*order, "leaf"], "pos").withColumn("node", F.col("leaf")), "numbered")
    ladder = levels(numbered, part, fan, height)
    # The parts' roots in their order are the leaves of one last tree.
    subroots = cut(number_rows(ladder[-1].select(F.lit(0).alias("_all"), F.col(part).alias("_part"), "node"), ["_all"], ["_part"], "pos").withColumn("subroot", F.col("node")), "subroots")
    over = levels(subroots, "_all", fan, height)
    carry = lambda name, pos, more, lefts, rights, values: (name, pos, lefts, rights, *more, *values)
    no_steps = F.array().cast("array<string>")
    chain = over[-1].select("_all", "pos", no_steps.alias("lefts"), no_steps.alias("rights"), F.col("node").alias("root"))
    for nodes in over[-2:0:-1]:
        chain = descend(nodes, chain, "_all", fan, height, [], carry, f"_all int, pos long, {STEPS}, root string")
    chain = descend(subroots, chain, "_all", fan, height, ["_part", "subroot"], carry, f"_all int, pos long, {STEPS}, _part {kind}, subroot string, root string")
    chain = cut(chain.select(F.col("_part").alias(part), F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot", "root"), "chain")
    for nodes in ladder[-2:0:-1]:
        chain = cut(descend(nodes, chain, part, fan, height, [], carry, f"`{part}` {kind}, pos long, {STEPS}, subroot string, root string"), "chain")
    claimed = kept.index("claimed")

    def prove(name, pos, more, lefts, rights, values):
        root = folded(more[claimed], lefts, rights)
        return (name, *more, *values, digest(*[x for step in zip(lefts, rights) for x in step]), root, root == values[1])

    fields = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in kept)
    made = f"`{part}` {kind}, {fields}, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descend(numbered, chain, part, fan, height, kept, prove, made)


def document_leaves(docs: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """(doc_id, lang, leaf, claimed): each document's leaf, and the one of its `text` instead where it is tampered with."""
    fields = [F.col(c) for c in FIELDS]
    own = leaf(*fields)
    return docs.select("doc_id", "lang", own.alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), leaf(*fields[:-1], text)).otherwise(own).alias("claimed"))


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case and nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Null fields are `-`; a row without an id comes first in its language and is not tampered with. Texts of any length
    are hashed where they are read; repeated rows are leaves of their own."""
    docs = table(spark, sf_dir, "documents")
    leaves = document_leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text")))
    return manifest(leaves, "lang", ["doc_id"]).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if f == "text" else f) for f in FIELDS) + ")"


OP11_SQL = f"""
WITH RECURSIVE crc AS (
    SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c FROM documents),
leaves AS (
    SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
        CASE WHEN xor(c, 4294967295) % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS claimed FROM crc),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (
    SELECT 0 AS level, lang, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM numbered
    UNION ALL
    SELECT level + 1, lang, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY level, lang, pos // 8),
subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8),
nodes AS (
    SELECT 0 AS stage, level, lang, pos, node FROM tree WHERE n > 1
    UNION ALL SELECT 1, level, NULL, pos, node FROM top WHERE n > 1),
runs AS (SELECT stage, level, lang, pos // 8 AS run, list(node ORDER BY pos) AS held FROM nodes GROUP BY ALL),
steps AS (
    SELECT d.lang, d.pos AS leaf_pos, r.stage * 1000 + r.level AS step, r.held, (d.pos // (8 ** r.level)::BIGINT) % 8 AS i
    FROM numbered d JOIN runs r ON r.stage = 0 AND r.lang IS NOT DISTINCT FROM d.lang AND r.run = d.pos // (8 ** (r.level + 1))::BIGINT
    UNION ALL
    SELECT d.lang, d.pos, r.stage * 1000 + r.level, r.held, (s.pos // (8 ** r.level)::BIGINT) % 8
    FROM numbered d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang JOIN runs r ON r.stage = 1 AND r.run = s.pos // (8 ** (r.level + 1))::BIGINT),
sides AS (SELECT lang, leaf_pos, step, array_to_string(held[1:i], '') AS l, array_to_string(held[i + 2:], '') AS r FROM steps),
witness AS (SELECT lang, leaf_pos, list({{'l': l, 'r': r}} ORDER BY step) AS w, string_agg(l || r, '' ORDER BY step) AS proof FROM sides GROUP BY lang, leaf_pos),
done AS (
    SELECT d.*, coalesce(w.proof, '') AS proof, s.subroot, (SELECT node FROM top WHERE n = 1) AS root,
        list_reduce(list_prepend({{'l': claimed, 'r': ''}}, coalesce(w.w, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
    FROM numbered d LEFT JOIN witness w ON w.lang IS NOT DISTINCT FROM d.lang AND w.leaf_pos = d.pos JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
