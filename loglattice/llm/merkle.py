"""Merkle manifest of a dataset with a proof for every row, by pointer jumping.

1. Every row is a leaf: the SHA-256 of its fields. Leaves get their place in the tree of their group by a range sort and
   the counts of its partitions, so no group is gathered.
2. Trees grow by ``LEVELS`` levels at a time: one task hashes a block of 2 ** LEVELS neighbours. A node below the top of its
   block leaves a segment there: the sibling's digest and its side. The roots of the trees are the leaves of one more tree.
3. Every node starts with its parent and its segment. A self-join on the ancestor doubles the distance and
   concatenates the segments, until every leaf has reached the root. After the join over 2 ** k levels only nodes of
   every 2 ** (k + 1)-th level can be asked for again, so the others go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, discard, partitions, store
from loglattice.operators.lookup import lookup

# The fields of a leaf and of a null field.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ABSENT = "-"

LEVELS = 10
#: Tables of nodes up to this size are broadcast, larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Sides of a sibling in a segment, one byte before its 32: left, right, or no sibling (and no digest).
LEFT, RIGHT, ALONE = b"L", b"R", b"-"
#: The tree of the trees' roots.
FOREST = -1


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(ABSENT))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def digest_of(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(leaves: Column) -> Column:
    """Levels above ``leaves`` leaves: the bits of leaves - 1."""
    return F.when(leaves > 1, F.length(F.bin(leaves - 1))).otherwise(0)


def placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Stored ``rows`` with ``pos``, their place in their tree from 0, and ``n``, its rows.

    Rows are sorted by range; a partition's first places follow from the counts of those before it. The tables of counts
    have a row for each partition and tree.
    """
    by = [tree, *order]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    ranged = store(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("at", 33).alias("part")
    counts = store(ranged.groupBy(part, tree).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")), "counts")
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", tree, "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    found = lookup(ranged.withColumn("part", part), store(offsets, "offsets"), ["part", tree], "inner", broadcast_bytes=BROADCAST_BYTES)
    out = store(found.withColumn("pos", F.col("at") - F.col("first") + F.col("offset")).drop("at", "part", "first", "offset"), "placed")
    discard(ranged)
    return out


NODE = "tree long, level int, pos long, height int, digest string, segment binary, doc_id long, tampered string"


def _grown(level: int):
    """Generator of the nodes and segments of blocks whose nodes (tree, height, pos, digest, doc_id, tampered) are of ``level``.

    A block's nodes come one after the other, ordered by place.
    """

    def block_rows(tree: int, top: int, nodes: list[tuple]) -> Iterator[tuple]:
        digests, at, block = [x[3] for x in nodes], level, nodes[0][2] >> LEVELS
        payload = lambda i: nodes[i][4:] if at == 0 else (None, None)
        while at < min(top, level + LEVELS):
            first = block << (level + LEVELS - at)
            for i, digest in enumerate(digests):
                other = i ^ 1
                segment = ALONE if other >= len(digests) else (LEFT if other < i else RIGHT) + bytes.fromhex(digests[other])
                yield tree, at, first + i, top, digest, segment, *payload(i)
            digests = [digest_of(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
            at += 1
        # The top of the block; if a leaf is one, its tree has no other node.
        yield tree, at, block << (level + LEVELS - at), top, digests[0], None, *payload(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if held and (row[0] != held[0][0] or row[2] >> LEVELS != held[0][2] >> LEVELS):
                    yield from block_rows(held[0][0], held[0][1], held)
                    held = []
                held.append(row)
        if held:
            yield from block_rows(held[0][0], held[0][1], held)

    return run


def grown(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes below the roots of all trees, and the roots, for leaves (tree, pos, height, digest, doc_id, tampered)."""
    nodes, tops, level = [], leaves, 0
    highest = leaves.agg(F.max("height").alias("h")).first()["h"] or 0
    roots = []
    while True:
        blocks = tops.repartition("tree", F.shiftright("pos", LEVELS)).sortWithinPartitions("tree", "pos")
        made = store(arrow_map(blocks.select("tree", "height", "pos", "digest", "doc_id", "tampered"), NODE, _grown(level)), "nodes")
        nodes.append(made.where("segment IS NOT NULL"))
        tops = made.where("segment IS NULL")
        roots.append(tops.where("level = height"))
        level += LEVELS
        if highest <= level:
            break
        tops = tops.where("level < height")
    every = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(every(tables[1:]))
    return every(nodes), every(roots)


def jumped(nodes: DataFrame, rounds: int) -> DataFrame:
    """Nodes (tree, level, pos, up_tree, up_level, up_pos, segment, ...) after ``rounds`` doublings.

    Null ``up_`` columns name the root.
    """
    up = ["up_tree", "up_level", "up_pos"]
    for k in range(rounds):
        above = nodes.where(f"level > 0 OR tree = {FOREST}")
        above = store(above.select(*[F.col(c).alias(f"up_{c}") for c in ("tree", "level", "pos")], F.struct(*up, "segment").alias("more")), "above")
        joined = lookup(nodes, above, up, broadcast_bytes=BROADCAST_BYTES)
        kept = joined.where(f"tree = {FOREST} OR level % {2 ** (k + 1)} = 0")
        segment = F.when(F.col("more").isNull(), F.col("segment")).otherwise(F.concat("segment", "more.segment")).alias("segment")
        others = [c for c in nodes.columns if c not in (*up, "segment")]
        longer = store(kept.select(*others, *[F.col("more")[c].alias(c) for c in up], segment), "jumped")
        discard(above, nodes)
        nodes = longer
    return nodes


def steps(segment: bytes) -> Iterator[tuple[bytes, str]]:
    """(side, digest) of each level of a proof."""
    at = 0
    while at < len(segment):
        side = segment[at : at + 1]
        size = 0 if side == ALONE else 32
        yield side, segment[at + 1 : at + 1 + size].hex()
        at += 1 + size


def folded(leaf: str, segment: bytes) -> str:
    """The root that follows from a leaf and its proof."""
    for side, other in steps(segment):
        leaf = digest_of(other, leaf) if side == LEFT else digest_of(leaf, other)
    return leaf


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for doc_id, leaf, tampered, subroot, root, segment in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            found = folded(tampered or leaf, segment)
            proof = digest_of(*[other for _, other in steps(segment)])
            yield doc_id, leaf, subroot, root, proof, found, found == root, segment


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"


def tampered_rows(doc_id: Column) -> Column:
    """Rows of the manifest's self-test: 7 divides the checksum of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof.

    ``proof`` holds the siblings from the leaf to the root (see ``steps``). folded_root follows from the proof and the leaf,
    for rows of ``tampered_rows`` from a leaf whose n_chars is one more (a null n_chars stays, so such rows still verify).
    Null ids come first in their tree and are not tampered with; rows of one id are ordered by their leaves, and
    repeated rows are leaves of their own. A null group is a tree of its own before all others. Null and empty texts
    differ. Columns other than FIELDS are ignored; an empty table gives no rows.
    """
    values = {name: F.col(c) for name, c in zip(FIELDS, (id_col, "source", group_col, "n_chars", "text"), strict=True)}
    changed = values | {"n_chars": F.col("n_chars") + 1}
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group_col).cast("string")))
    hit = tampered_rows(F.col(id_col)) & F.col("n_chars").isNotNull()
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), group.alias("group"), leaf_digest([values[c] for c in FIELDS]).alias("digest"),
        F.when(hit, leaf_digest([changed[c] for c in FIELDS])).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    hashed = store(rows, "leaves")
    leaves = placed(hashed, "group", ["doc_id", "digest", "row"])
    discard(hashed)
    # Trees are numbered in the order of their groups, which is the order of their roots.
    groups = placed(leaves.select("group").distinct().withColumn("all", F.lit(0)), "all", ["group"])
    numbered = lookup(leaves, groups.select("group", F.col("pos").alias("tree"), F.col("n").alias("trees")), ["group"], "inner", broadcast_bytes=BROADCAST_BYTES)
    inner, roots = grown(store(numbered.select("tree", "pos", height(F.col("n")).cast("int").alias("height"), "digest", "doc_id", "tampered", "trees"), "numbered"))
    trees = groups.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n")).first()["n"]
    forest = roots.select(F.lit(FOREST).cast("long").alias("tree"), F.col("tree").alias("pos"), height(F.lit(trees)).cast("int").alias("height"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered"))
    above, top = grown(forest)
    root = top.select("digest").first()
    if root is None:
        return arrow_map(hashed.sparkSession.createDataFrame([], "a long"), PROOF, lambda batches: iter(()))

    none = F.lit(None)
    subroots = store(roots.select("tree", F.col("digest").alias("subroot")), "subroots")
    # A lone leaf is the root of its tree: it starts with an empty segment at its place among the roots.
    lone = roots.where("height = 0").select("tree", "level", "pos", "height", "digest", F.lit(b"").alias("segment"), "doc_id", "tampered")
    last = F.col("level") + 1 >= F.col("height")
    linked = inner.unionByName(lone).select(
        "tree", "level", "pos", F.when(last, F.lit(FOREST)).otherwise(F.col("tree")).cast("long").alias("up_tree"),
        F.when(last, 0).otherwise(F.col("level") + 1).cast("int").alias("up_level"), F.when(last, F.col("tree")).otherwise(F.shiftright("pos", 1)).alias("up_pos"),
        "segment", F.when(F.col("level") == 0, F.col("digest")).alias("leaf"), "doc_id", "tampered",
    )
    inside = F.col("level") + 1 < F.col("height")
    top_rows = above.select(
        "tree", "level", "pos", F.when(inside, F.col("tree")).cast("long").alias("up_tree"), F.when(inside, F.col("level") + 1).cast("int").alias("up_level"),
        F.when(inside, F.shiftright("pos", 1)).alias("up_pos"), "segment", none.cast("string").alias("leaf"), "doc_id", "tampered",
    )
    highest = inner.agg(F.max("height").alias("h")).first()["h"] or 0
    levels = max(1, highest) + (trees - 1).bit_length()
    nodes = jumped(store(linked.unionByName(top_rows), "jumped"), (levels - 1).bit_length())
    proofs = lookup(nodes.where(f"level = 0 AND tree <> {FOREST}"), subroots, ["tree"], "inner", broadcast_bytes=BROADCAST_BYTES)
    return arrow_map(proofs.select("doc_id", "leaf", "tampered", "subroot", F.lit(root["digest"]).alias("root"), "segment"), PROOF, _proved)
