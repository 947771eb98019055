"""Merkle manifest of a dataset, its digests stored in van Emde Boas order.

Every row becomes a leaf, every group of rows (a language, say) a tree of fan-out 8, and the roots of the
groups one more tree. Rows get their place by one range partitioning of slim rows (group, key, digest);
counts per group and partition turn places in a partition into places in the group. Aligned subtrees of
``BLOCK_LEVELS`` levels are then built side by side, one task group each, and stored as one row; their roots
are the leaves of the next layer, until a group has one block. Inside a block a tree of ``k`` levels is its
top half followed by the subtrees below it, each stored the same way (:func:`address`): a digest and its
siblings are found by arithmetic alone, in few cache lines at any line size. Proofs go down the layers: every
block hands the steps above it to the blocks below, so no row meets more than one block.

A leaf holds ``-`` per null column, else the value's UTF-8 byte count, ``:`` and the value. A null group comes
first, a null key is the least; rows with equal keys are ordered by digest, and wholly equal rows are leaves of
their own. An empty table gives an empty manifest. Further columns don't count. Texts of any length are hashed
whole, in the JVM.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridspark.llm.common import table
from gridspark.session import materialize, scratch_dir

FANOUT = 8
BLOCK_LEVELS = 4  # edges from a block's root to its leaves: at most 8 ** 4 leaves a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_WIDTH = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- layout of a block


def size(levels: int, fanout: int = FANOUT) -> int:
    """Nodes of a full tree of so many levels."""
    return (fanout**levels - 1) // (fanout - 1)


def address(levels: int, depth: int, index, fanout: int = FANOUT):
    """Where node ``index`` (a number or an array) of ``depth`` (root: 0) lies in a block of ``levels`` levels."""
    at = index * 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        levels, depth = levels - top, depth - top
        below = fanout**depth
        at = at + size(top, fanout) + index // below * size(levels, fanout)
        index = index % below
    return at


def subtree(leaves: list[str], height: int, fanout: int = FANOUT) -> tuple[bytes, str]:
    """The stored block above ``leaves`` and its root; nodes that the last runs lack stay zero."""
    out = np.zeros((size(height + 1, fanout), _WIDTH), np.uint8)
    nodes = leaves
    for depth in range(height, -1, -1):
        place = address(height + 1, depth, np.arange(len(nodes)), fanout)
        out[place] = np.frombuffer(bytes.fromhex("".join(nodes)), np.uint8).reshape(-1, _WIDTH)
        if depth:
            nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return out.tobytes(), nodes[0]


def runs(store: bytes, n: int, height: int, fanout: int = FANOUT) -> list[list[str]]:
    """Per level, from the leaves up, the joined digests of every run of siblings."""
    text = store.hex()
    width = 2 * _WIDTH
    out = []
    for depth in range(height, 0, -1):
        parts = -(-n // fanout)
        first = np.arange(parts) * fanout
        begin = address(height + 1, depth, first, fanout)
        step = address(height + 1, depth, first + 1, fanout) - begin  # siblings lie evenly apart
        level = []
        for i, (at, by) in enumerate(zip(begin.tolist(), step.tolist())):
            many = min(fanout, n - i * fanout)
            level.append("".join([text[(at + k * by) * width : (at + k * by + 1) * width] for k in range(many)]))
        out.append(level)
        n = parts
    return out


def steps(levels: list[list[str]], index: int, fanout: int = FANOUT) -> tuple[list[int], list[str]]:
    """A leaf's places in its runs and the joined digests of its siblings, from the leaf up."""
    at, others = [], []
    width = 2 * _WIDTH
    for level in levels:
        run, k = divmod(index, fanout)
        whole = level[run]
        at.append(k)
        others.append(whole[: k * width] + whole[(k + 1) * width :])
        index = run
    return at, others


def fold(leaf: str, at: list[int], others: list[str]) -> str:
    """The root that a leaf and the siblings on its path lead to."""
    for k, rest in zip(at, others):
        cut = 2 * _WIDTH * k
        leaf = digest(rest[:cut] + leaf + rest[cut:])
    return leaf


def _height(leaves: int, block_levels: int, fanout: int) -> int:
    h = 0
    while h < block_levels and fanout**h < leaves:
        h += 1
    return h


# ---------------------------------------------------------------- places


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 over the columns, each with its length."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a stored table with ``tree``) with ``pos``, the place in the tree, and ``leaves``, its size.

    The row's number in the scan breaks ties of ``order``, so a third of all rows may be equal.
    """
    keys = ["tree", *order, "_tie"]
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = materialize(ordered.select("*", F.spark_partition_id().alias("_part"), in_part.alias("_row")), "merkle-order")
    # one row per partition and one more per tree that begins inside a partition
    parts = ordered.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy("tree")
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    parts = parts.select("tree", "_part", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("leaves"))
    out = ordered.join(materialize(parts, "merkle-parts"), ["tree", "_part"])
    return out.withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first")).drop(
        "_part", "_row", "_first", "_before"
    )


# ---------------------------------------------------------------- building

BLOCKS = "tree string, block long, leaves long, n int, root string, store binary"


@dataclass(frozen=True)
class Manifest:
    """Stored blocks: ``rows`` and ``groups`` are the layers of the groups' trees and of the tree over them."""

    spark: SparkSession
    path: str
    rows: int
    groups: int
    fanout: int = FANOUT
    block_levels: int = BLOCK_LEVELS

    def layer(self, scope: str, k: int) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/{scope}-{k}")

    def is_top(self) -> Column:
        return F.col("leaves") <= self.fanout**self.block_levels

    def roots(self, scope: str) -> DataFrame:
        """The root of every tree (tree, root)."""
        layers = [self.layer(scope, k) for k in range(getattr(self, scope))]
        out = None
        for layer in layers:
            top = layer.where(self.is_top()).select("tree", "root")
            out = top if out is None else out.unionByName(top)
        return out

    def save(self) -> None:
        facts = [(self.rows, self.groups, self.fanout, self.block_levels)]
        names = "rows int, groups int, fanout int, block_levels int"
        self.spark.createDataFrame(facts, names).write.parquet(f"{self.path}/manifest")


def open_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest that was built below ``path``."""
    f = spark.read.parquet(f"{path}/manifest").first()
    return Manifest(spark, path, f["rows"], f["groups"], f["fanout"], f["block_levels"])


def _build_block(fanout: int, block_levels: int):
    def run(key, group):
        tree, block = key[0].as_py(), key[1].as_py()
        at = np.argsort(group.column("pos").to_numpy())
        leaves = group.column("digest").take(pa.array(at)).to_pylist()
        total = group.column("leaves")[0].as_py()
        store, root = subtree(leaves, _height(total, block_levels, fanout), fanout)
        return pa.table(
            {
                "tree": pa.array([tree], pa.string()), "block": pa.array([block], pa.int64()),
                "leaves": pa.array([total], pa.int64()), "n": pa.array([len(leaves)], pa.int32()),
                "root": pa.array([root], pa.string()), "store": pa.array([store], pa.binary()),
            }
        )

    return run


def _build_layers(nodes: DataFrame, path: str, scope: str, fanout: int, block_levels: int) -> int:
    """Write the blocks over ``nodes`` (tree, leaves, pos, digest), layer by layer; the number of layers."""
    spark, per_block = nodes.sparkSession, fanout**block_levels
    most = nodes.agg(F.max("leaves")).first()[0] or 1
    k = 0
    while True:
        block = F.floor(F.col("pos") / F.lit(per_block)).cast("long").alias("block")
        layer = nodes.groupBy("tree", block).applyInArrow(_build_block(fanout, block_levels), BLOCKS)
        layer.write.parquet(f"{path}/{scope}-{k}")
        k += 1
        if most <= per_block:
            return k
        most = -(-most // per_block)
        above = spark.read.schema(BLOCKS).parquet(f"{path}/{scope}-{k - 1}").where(F.col("leaves") > per_block)
        nodes = above.select(
            "tree", F.ceil(F.col("leaves") / F.lit(per_block)).cast("long").alias("leaves"),
            F.col("block").alias("pos"), F.col("root").alias("digest"),
        )


def build_manifest(
    rows: DataFrame, path: str, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS
) -> Manifest:
    """The manifest of placed ``rows`` (tree, leaves, pos, digest), stored below ``path``."""
    spark = rows.sparkSession
    lower = _build_layers(rows.select("tree", "leaves", "pos", "digest"), path, "rows", fanout, block_levels)
    partial = Manifest(spark, path, lower, 0, fanout, block_levels)
    roots = partial.roots("rows").select(F.col("tree").alias("name"), F.col("root").alias("digest"))
    names = materialize(
        placed(materialize(roots.withColumn("tree", F.lit("")), "merkle-roots"), ["name"]), "merkle-names"
    )
    names.select("name", "pos", F.col("digest").alias("subroot")).write.parquet(f"{path}/names")
    upper = _build_layers(names.select("tree", "leaves", "pos", "digest"), path, "groups", fanout, block_levels)
    out = Manifest(spark, path, lower, upper, fanout, block_levels)
    out.save()
    return out


# ---------------------------------------------------------------- proofs


def _hand_down(fanout: int, block_levels: int):
    """Blocks with the steps above them to the steps above each of their leaves."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                levels = runs(r["store"], r["n"], _height(r["leaves"], block_levels, fanout), fanout)
                first = r["block"] * fanout**block_levels
                rows = {"tree": [], "block": [], "at": [], "others": []}
                for i in range(r["n"]):
                    at, others = steps(levels, i, fanout)
                    rows["tree"].append(r["tree"])
                    rows["block"].append(first + i)
                    rows["at"].append(at + r["at"])
                    rows["others"].append(others + r["others"])
                    if len(rows["at"]) == 256:
                        yield pa.RecordBatch.from_pydict(rows, _ABOVE)
                        rows = {k: [] for k in rows}
                yield pa.RecordBatch.from_pydict(rows, _ABOVE)

    return run


ABOVE = "tree string, block long, at array<int>, others array<string>"
_ABOVE = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("at", pa.list_(pa.int32())), ("others", pa.list_(pa.string()))]
)


def _steps_above(manifest: Manifest, scope: str, top: DataFrame) -> DataFrame:
    """Steps above every block of the lowest layer; ``top`` (tree, at, others): those above the trees' roots."""
    above = None
    for k in range(getattr(manifest, scope) - 1, -1, -1):
        blocks = manifest.layer(scope, k)
        found = blocks.where(manifest.is_top()).join(top, "tree")
        if above is not None:
            found = found.unionByName(blocks.where(~manifest.is_top()).join(above, ["tree", "block"]))
        if k == 0:
            return found
        down = found.mapInArrow(_hand_down(manifest.fanout, manifest.block_levels), ABOVE)
        above = materialize(down, "merkle-above")


def _prove(fanout: int, block_levels: int, full: bool):
    def run(rows, blocks):
        r = blocks.to_pylist()[0] if blocks.num_rows else None
        out = {"key": [], "leaf": [], "subroot": [], "root": [], "proof_sha256": [], "folded_root": []}
        if full:
            out |= {"at": [], "others": []}
        if r is not None and rows.num_rows:
            height = _height(r["leaves"], block_levels, fanout)
            levels = runs(r["store"], r["n"], height, fanout)
            first = r["block"] * fanout**block_levels
            tail, roots = "".join(r["others"]), {}
            columns = [rows.column(c).to_pylist() for c in ("key", "pos", "digest", "now")]
            for key, pos, leaf, now in zip(*columns):
                at, others = steps(levels, pos - first, fanout)
                # rows whose path is intact reach the same block root: the steps above are shared
                block_root = fold(now, at, others)
                if block_root not in roots:
                    roots = {**(roots if len(roots) < 4 else {}), block_root: fold(block_root, r["at"], r["others"])}
                out["key"].append(key)
                out["leaf"].append(leaf)
                out["proof_sha256"].append(digest("".join(others) + tail))
                out["folded_root"].append(roots[block_root])
                if full:
                    out["at"].append(at + r["at"])
                    out["others"].append(others + r["others"])
            out["subroot"] = [r["subroot"]] * len(out["key"])
            out["root"] = [r["top"]] * len(out["key"])
        return pa.Table.from_pydict(out, _PROOF_FULL if full else _PROOF)

    return run


PROOF = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
_PROOF = pa.schema(
    [("key", pa.int64())] + [(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
)
_PROOF_FULL = pa.schema([*_PROOF, pa.field("at", pa.list_(pa.int32())), pa.field("others", pa.list_(pa.string()))])


def prove(rows: DataFrame, manifest: Manifest, full: bool = False) -> DataFrame:
    """Every row's proof, read from the manifest, and the root its digest ``now`` folds to.

    ``rows``: key, tree, pos, digest, now. With ``full`` the proof itself as well: ``at`` (places in
    the runs) and ``others`` (joined digests of the siblings), from the leaf up.
    """
    spark = manifest.spark
    none = spark.createDataFrame([("", [], [])], "tree string, at array<int>, others array<string>")
    groups = _steps_above(manifest, "groups", none)
    per_group = groups.mapInArrow(_hand_down(manifest.fanout, manifest.block_levels), ABOVE)
    names = spark.read.parquet(f"{manifest.path}/names")
    root = manifest.roots("groups").select("root").scalar()
    top = per_group.join(names, F.col("block") == F.col("pos")).select(
        F.col("name").alias("tree"), "at", "others", "subroot", root.alias("top")
    )
    top = materialize(top, "merkle-top")
    blocks = _steps_above(manifest, "rows", top.select("tree", "at", "others"))
    blocks = blocks.join(top.select("tree", "subroot", "top"), "tree")
    per_block = manifest.fanout**manifest.block_levels
    own = rows.withColumn("block", F.floor(F.col("pos") / F.lit(per_block)).cast("long"))
    both = own.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    schema = PROOF + (", at array<int>, others array<string>" if full else "")
    return both.applyInArrow(_prove(manifest.fanout, manifest.block_levels, full), schema)


def document_leaves(docs: DataFrame, tampered: Column, change: dict[str, Column]) -> DataFrame:
    """Stored slim rows of ``docs``: tree (language), key, digest, and the digest ``now`` of tampered rows."""
    values = {c: F.col(c) for c in COLUMNS}
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # a null before all
    leaf = leaf_digest(values)
    now = F.when(tampered, leaf_digest(values | change)).otherwise(leaf)
    rows = docs.select(lang.alias("tree"), F.col("doc_id").cast("long").alias("key"), leaf.alias("digest"), now.alias("now"))
    return materialize(rows, "merkle-leaves")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, verified after some texts were lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    change = {"text": F.translate("text", UPPER, LOWER)}
    rows = placed(document_leaves(table(spark, sf_dir, "documents"), tampered, change), ["key", "digest"])
    path = scratch_dir(spark, "merkle-manifest")
    build_manifest(rows, path)
    out = prove(rows, open_manifest(spark, path))
    return out.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
             for c in (*COLUMNS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


def _sql(levels: int = 8, group_levels: int = 4) -> str:
    """The same in SQL, its levels written out: up to 8 ** levels rows a language."""
    crc = """list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)),
      lambda s, b: list_reduce([xor(s, b)] || [0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    out = [
        f"""d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {_leaf_sql(low)} ELSE {_leaf_sql('text')} END AS now
  FROM documents
), p AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), n0 AS (SELECT tree, i, leaf AS h FROM p),
w0 AS (SELECT id, tree, i, now AS h, '' AS proof FROM p)"""
    ]

    def level(nodes: str, path: str, k: int) -> None:
        """Runs of a level, the level above, and the paths one step up; a lone node stays as it is."""
        out.append(
            f"""r_{path}{k} AS (
  SELECT tree, i // 8 AS run, list(h ORDER BY i) AS hs, max(total) AS total
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS total FROM {nodes}{k}) GROUP BY ALL
), {nodes}{k + 1} AS (
  SELECT tree, run AS i, CASE WHEN total = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r_{path}{k}
), {path}{k + 1} AS (
  SELECT id, {path}{k}.tree, i // 8 AS i,
    CASE WHEN total = 1 THEN h ELSE sha256(array_to_string(hs[:i % 8], '') || h || array_to_string(hs[i % 8 + 2:], '')) END AS h,
    CASE WHEN total = 1 THEN proof ELSE proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '') END AS proof
  FROM {path}{k} JOIN r_{path}{k} r ON r.tree = {path}{k}.tree AND r.run = i // 8
)"""
        )

    for k in range(levels):
        level("n", "w", k)
    out.append(
        f"""g0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, h, tree AS name FROM n{levels}),
v0 AS (SELECT id, '' AS tree, g0.i, w.h, proof FROM w{levels} w JOIN g0 ON g0.name = w.tree)"""
    )
    for k in range(group_levels):
        level("g", "v", k)
    return f"""WITH {', '.join(out)}
SELECT doc_id, leaf, g0.h AS subroot, top.h AS root, sha256(v.proof) AS proof_sha256, v.h AS folded_root,
  v.h = top.h AS verified
FROM p JOIN v{group_levels} v USING (id) JOIN g0 ON g0.name = p.tree CROSS JOIN g{group_levels} top"""


OP11_SQL = _sql()
