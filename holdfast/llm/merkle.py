"""Merkle manifest of a dataset as a persistent tree with path copying.

Every row is a leaf, the hash of its columns. The leaves of a stratum (a language) stand in the order of their ids; every
eight consecutive nodes become their hash until one is left, its subroot, and the subroots become the root likewise.

The tree is cut into aligned blocks of three levels, 512 nodes. A task builds whole blocks; the roots of the blocks are the nodes
of the next round, so rounds shrink by 512 and no task holds more than a block. A tampered leaf creates a version of the
tree: within its block only its ancestors are copied, each with one child replaced, and all other nodes are those of the
base; the version then goes on in the blocks above, whose untouched nodes come down to it as the path of its block. Versions
never meet in one place: the path of a block is a row that its leaves are grouped with.

Digests travel as 32 bytes and are hashed as lowercase hexadecimal text.

Cases: a null column counts as ``-``; null ids stand first and are never tampered with; rows with one id are ordered by
their leaf; rows repeated as a whole are leaves of their own; a lone leaf is its subroot and a lone subroot the root, with
nothing to prove (the hash of the empty text); very long texts are hashed whole where they lie; an
empty table has no rows and no root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored, with_positions

FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def parent_of(children: bytes) -> bytes:
    """The digest of a run of digests."""
    return hashlib.sha256(children.hex().encode()).digest()


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes within one block."""
    up = 0
    while n > 1 and up < LEVELS:
        n = -(-n // FAN)
        up += 1
    return up


class Block:
    """The nodes of an aligned block, level by level; never changed once they are made."""

    def __init__(self, leaves: Sequence[bytes], levels: int):
        self.levels = [[*leaves]]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([parent_of(b"".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, at: int) -> bytes:
        """For each level below the root: place in the run, number of siblings, their digests."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % FAN
            run = nodes[first : first + FAN]
            siblings = run[: at - first] + run[at - first + 1 :]
            out.append(bytes([at - first, len(siblings)]) + b"".join(siblings))
            at //= FAN
        return b"".join(out)

    def version(self, at: int, leaf: bytes) -> Version:
        return Version(self, at, leaf)


class Version:
    """A block with another leaf: the ancestors of that leaf are its own, all other nodes are those of ``base``."""

    def __init__(self, base: Block, at: int, leaf: bytes):
        self.base, self.copied = base, {(0, at): leaf}
        for level, nodes in enumerate(base.levels[:-1]):
            first = at - at % FAN
            run = [*nodes[first : first + FAN]]
            run[at - first] = leaf
            leaf = parent_of(b"".join(run))
            at //= FAN
            self.copied[level + 1, at] = leaf
        self.root = leaf

    def node(self, level: int, at: int) -> bytes:
        return self.copied.get((level, at)) or self.base.levels[level][at]


def siblings_of(path: bytes) -> bytes:
    """The digests of a path, level by level."""
    out, at = [], 0
    while at < len(path):
        end = at + 2 + 32 * path[at + 1]
        out.append(path[at + 2 : end])
        at = end
    return b"".join(out)


def ancestors(digest: bytes, path: bytes) -> list[bytes]:
    """The nodes above ``digest``, copied along a path."""
    out, at = [], 0
    while at < len(path):
        place, end = path[at], at + 2 + 32 * path[at + 1]
        run = path[at + 2 : end]
        digest = parent_of(run[: 32 * place] + digest + run[32 * place :])
        out.append(digest)
        at = end
    return out


def _record(text: Column, columns: Sequence[str]) -> Column:
    """Each column as byte count, colon and value; ``-`` for null."""
    parts = []
    for name in columns:
        value = text if name == "text" else F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """doc_id, tree, digest, changed: the leaf of every row, and the one of its tampered text where it is tampered with."""
    text = F.col("text").cast("string")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stratum = F.col(stratum_col).cast("string")
    changed = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), stratum), F.lit("")).alias("tree"),  # null sorts first and equals no name
        F.unhex(F.sha2(_record(text, columns), 256)).alias("digest"),
        F.when(changed, F.unhex(F.sha2(_record(lowered, columns), 256))).alias("changed"),
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that agree in their first two columns, which stand together."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_096) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


_NODES = "tree string, pos bigint, n bigint, digest binary"
_NODE_FIELDS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for group in _groups(batches):
            tree, block, _, n, _ = group[0]
            levels = levels_of(n)
            yield tree, block, -(-n // FAN**levels), Block([row[4] for row in group], levels).root

    yield from _in_batches(rows(), _NODE_FIELDS)


def rounds_above(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, pos, n, digest), the roots of their blocks, and so on until every tree has one node."""
    rounds, above = [nodes], True
    while above:
        now = rounds[-1].select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest")
        now = now.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        rounds.append(stored(now.mapInArrow(_block_roots, _NODES), "merkle-nodes"))
        above = (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1
    return rounds


_PATHS = "tree string, pos bigint, digest binary, path binary, subroot binary, root binary"
_PATH_FIELDS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), *((c, pa.binary()) for c in ("digest", "path", "subroot", "root"))])


def _node_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path to the root of every node: that within its block, then that of the block."""

    def rows():
        for (tree, _, _, _, _, _, upper, subroot, root, _, _), *nodes in _groups(batches):
            block = Block([row[5] for row in nodes], levels_of(nodes[0][4]))
            for at, row in enumerate(nodes):
                yield tree, row[3], row[5], block.path(at) + upper, subroot, root

    yield from _in_batches(rows(), _PATH_FIELDS)


_PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF_FIELDS = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of every leaf, and the root of its version."""

    def rows():
        for (_, _, _, _, _, _, upper, subroot, root, _, _), *nodes in _groups(batches):
            block = Block([row[5] for row in nodes], levels_of(nodes[0][4]))
            beyond = siblings_of(upper)
            for at, row in enumerate(nodes):
                leaf, doc_id, changed = row[5], row[9], row[10]
                proof = hashlib.sha256((siblings_of(block.path(at)) + beyond).hex().encode()).hexdigest()
                version = block.version(at, leaf if changed is None else changed)
                folded = ([version.root, *ancestors(version.root, upper)])[-1]
                yield doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root

    yield from _in_batches(rows(), _PROOF_FIELDS)


_VERSIONS = "doc_id bigint, stratum string, pos bigint, copied array<string>"
_VERSION_FIELDS = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), ("pos", pa.int64()), ("copied", pa.list_(pa.string()))])


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that each version has for itself, from the leaf to the root."""

    def rows():
        for (tree, _, _, _, _, _, upper, _, _, _, _), *nodes in _groups(batches):
            block = Block([row[5] for row in nodes], levels_of(nodes[0][4]))
            for at, row in enumerate(nodes):
                if row[10] is not None:
                    version = block.version(at, row[10])
                    copied = [*version.copied.values(), *ancestors(version.root, upper)]
                    yield row[9], tree[1:] if tree else None, row[3], [x.hex() for x in copied]

    yield from _in_batches(rows(), _VERSION_FIELDS)


def _below(nodes: DataFrame, parents: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Apply ``run`` to each block of nodes, behind the row of the block's own path."""
    payload = [F.col(c) if c in nodes.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("changed", "binary"))]
    empty = [F.lit(None).cast("binary").alias(c) for c in ("path", "subroot", "root")]
    rows = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), F.lit(1).alias("kind"), "pos", "n", "digest", *empty, *payload)
    number = F.lit(None).cast("bigint")
    blocks = parents.select(
        "tree", F.col("pos").alias("block"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("pos"), number.alias("n"), "digest",
        "path", "subroot", "root", number.alias("doc_id"), F.lit(None).cast("binary").alias("changed"),
    )
    together = rows.unionByName(blocks).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")
    return together.mapInArrow(run, schema)


def _down(rounds: list[DataFrame], parents: DataFrame) -> DataFrame:
    """The paths of the nodes of ``rounds[0]`` from those of ``rounds[-1]``."""
    for nodes in reversed(rounds[:-1]):
        parents = stored(_below(nodes, parents, _node_paths, _PATHS), "merkle-paths")
    return parents


def _leaves_and_parents(docs: DataFrame, **names) -> tuple[DataFrame, DataFrame]:
    """The numbered leaves and the paths of their blocks."""
    found = stored(leaves(docs, **names), "merkle-leaves")
    numbered = with_positions(found, "tree", [F.asc_nulls_first("doc_id"), F.col("digest")], "merkle-positions")
    rounds = rounds_above(numbered)
    nothing = F.lit(b"")
    subroots = rounds[-1].select(F.lit("").alias("top"), F.col("tree").alias("name"), "digest")
    strata = stored(with_positions(subroots, "top", [F.col("name")], "merkle-strata"), "merkle-strata")
    upper = rounds_above(strata.select(F.col("top").alias("tree"), "pos", "n", "digest"))
    tops = upper[-1].select("tree", "pos", "digest", nothing.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    of_strata = _down(upper, tops).join(strata.select("pos", "name"), "pos")
    parents = of_strata.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "digest", "path", F.col("digest").alias("subroot"), "root")
    return numbered, _down(rounds[1:], parents)


def manifest(docs: DataFrame, **names) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    return _below(*_leaves_and_parents(docs, **names), _proofs, _PROOFS)


def tampered_versions(docs: DataFrame, **names) -> DataFrame:
    """doc_id, stratum, pos, copied: for each tampered row the nodes that its version doesn't share, leaf first, root last."""
    return _below(*_leaves_and_parents(docs, **names), _versions, _VERSIONS)
