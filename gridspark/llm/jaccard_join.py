"""Jaccard self-join of shingle sets, size-aware: light sets by subsets, heavy sets by inverted lists.

Two sets link when ``100 * |A & B| >= 75 * |A | B|``, that is when they share at least
``c = ceil(3 (|A| + |B|) / 7)`` shingles. Documents with equal sets are one node from the start.

* Light sets (size up to a boundary): all subsets of the sizes ``c`` that their partners' sizes ask for
  are enumerated and marked with both sizes. A set of the smaller size links with all that share the
  subset, so the first such set is compared with each of them; where only sets of the larger size meet,
  nothing follows, as their own mark asks for more. The boundary is where enumeration starts to cost
  more than scanning, from the histogram of sizes.
* Heavy sets, and light ones near enough in size to link with them: an inverted list per shingle. A
  set is listed under its first ``|A| - ceil(3 |A| / 4) + 1`` shingles in one global order, which no
  linked pair can miss. Frequent shingles come last in the order: shingles with small hashes are
  counted over all documents, and a fixed-size filter of the frequent ones defines the order.
  Lists of counted, infrequent shingles are short; their pairs are counted and dropped if the rest of
  both sets can't make up ``c``. Lists of other shingles may be long: every member is compared with one
  hub per list, and members that thereby come into one component need no comparison with each other.
  Where members of a list still lie in different components, all sets that lists chain together are
  dealt into blocks of ``BLOCK`` sets; for every two blocks a task scans the inverted lists of one for
  each set of the other, and returns only links that join components.

Pairs that remain are verified on whole texts. Components come from label spreading with shortcuts.
Nodes are known by 64-bit set hashes; two different sets of n collide with a chance of n^2 / 2^65.

Defined results: null texts and texts without words have an empty set and are their own component;
fewer than five words are one shingle; equal ids take the same row's role; a null id is kept and has a
null component unless it links; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import bit_filter, in_filter, mix, shingle_hashes, slices, table, text_bytes, word_hashes
from gridspark.session import materialize, release

SHINGLE = 5
FREQUENT = 16  # documents per shingle above which it counts as frequent
COUNTED = 0.35  # share of the hash range that is counted
LARGEST_LIGHT = 12
BLOCK = 512
FEW = 16_384  # rows of two numbers that a task may be sent
SLICE_BYTES = 1 << 21  # of text in one step of a task, or one text

_LIMIT = np.uint64(int(COUNTED * 2**64))


def needed(a, b):
    """Shared shingles that a link between sets of these sizes takes."""
    return -(-3 * (a + b) // 7)


def prefix_length(n):
    return n - (-(-3 * n // 4)) + 1


def _flat_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit key of every text's shingle set, all sets (sorted) one after another, and where each begins."""
    words, first, _ = word_hashes(*text_bytes(column))
    shingles, begin = shingle_hashes(words, first, SHINGLE)
    bounds = begin.tolist()
    for a, b in zip(bounds, bounds[1:]):
        shingles[a:b].sort()
    once = np.ones(len(shingles), bool)
    once[1:] = shingles[1:] != shingles[:-1]
    once[begin[:-1][begin[:-1] < len(shingles)]] = True  # an equal neighbour in another text doesn't count
    flat, at = shingles[once], np.concatenate([[0], np.cumsum(once)])[begin]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(0xA5A5A5A5)))])
    keys = mix((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64), flat, at


def set_keys(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A 64-bit key of every text's shingle set, and the sets (sorted)."""
    keys, flat, at = _flat_sets(column)
    bounds = at.tolist()
    return keys, [flat[a:b] for a, b in zip(bounds, bounds[1:])]


def _parts(batches: Iterator[pa.RecordBatch], text: str, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text, rows, SLICE_BYTES)


def _slices(batches: Iterator[pa.RecordBatch], *texts: str, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of batches, bounded by rows and by the bytes of every column of ``texts``."""
    for batch in batches:
        parts = (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        for name in texts:
            parts = _parts(parts, name, rows)
        yield from parts


def _nodes(batches: Iterator[pa.RecordBatch], small: bool = False) -> Iterator[pa.RecordBatch]:
    """Node and set size of every document; ``small`` adds the shingles of sets that may be light, else null."""
    for batch in _slices(batches, "text"):
        keys, flat, at = _flat_sets(batch.column("text"))
        n = np.diff(at)
        columns, names = [batch.column("doc_id"), pa.array(keys), pa.array(n, pa.int64())], ["doc_id", "node", "n"]
        if small:
            held = (n > 0) & (n <= LARGEST_LIGHT)
            begin = np.concatenate([[0], np.cumsum(np.where(held, n, 0))]).astype(np.int32)
            members = pa.array(flat[np.repeat(held, n)].view(np.int64))
            columns.append(pa.ListArray.from_arrays(pa.array(begin), members, mask=pa.array(~held)))
            names.append("small")
        yield pa.RecordBatch.from_arrays(columns, names)


def _small_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every set's shingles in the counted part of the hash range."""
    for batch in _slices(batches, "text"):
        _, flat, _ = _flat_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(flat[flat < _LIMIT].view(np.int64))], ["h"])


_LISTED = "h long, node long, n int, place int, short boolean"


def _postings(bits: bytes, light: int):
    """Shingles a set is listed under, by the global order (frequent, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_bits = np.frombuffer(bits, np.uint8)
        smallest = -(-3 * (light + 1) // 4)  # a smaller set can't link with a heavy one
        for batch in _slices(batches, "text"):
            keys, flat, at = _flat_sets(batch.column("text"))
            n = np.diff(at)
            frequent = in_filter(frequent_bits, flat)
            plain = np.concatenate([[0], np.cumsum(~frequent)])  # infrequent shingles before each one
            mine = plain[:-1] - np.repeat(plain[at[:-1]], n)  # those of its own set
            in_set = np.arange(len(flat)) - np.repeat(at[:-1], n)
            place = np.where(frequent, np.repeat(np.diff(plain[at]), n) + in_set - mine, mine)
            length = np.where(n >= smallest, prefix_length(n), 0)
            listed = place < np.repeat(length, n)
            h = flat[listed]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(np.repeat(keys, n)[listed]),
                    pa.array(np.repeat(n, n)[listed].astype(np.int32)),
                    pa.array(place[listed].astype(np.int32)),
                    pa.array((h < _LIMIT) & ~frequent[listed]),
                ],
                ["h", "node", "n", "place", "short"],
            )

    return run


def _subsets(light: int):
    """Subsets of light sets (node, small) under which linked ones meet: (subset hash, node, has the smaller size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = batch.column("small")
            members, at = rows.flatten().to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(rows).to_numpy())
            out, nodes, smaller = [], [], []
            for key, s in zip(batch.column("node").to_pylist(), np.split(members, at[:-1])):
                n = len(s)
                for other in range(-(-3 * n // 4), min(light, 4 * n // 3) + 1):
                    c = needed(n, other)
                    if c > min(n, other):
                        continue
                    mark = np.uint64(min(n, other) * 1000 + max(n, other))
                    chosen = s[np.array(list(combinations(range(n), c)), np.int64)]
                    with np.errstate(over="ignore"):
                        h = mix(mix(chosen).sum(1, dtype=np.uint64) + mark * np.uint64(0x9E3779B97F4A7C15))
                    out.append(h)
                    nodes.append(np.full(len(h), key))
                    smaller.append(np.full(len(h), n <= other))
            if out:
                h, key, low = (np.concatenate(x) for x in (out, nodes, smaller))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key), pa.array(low)], ["h", "node", "low"])

    return run


def light_boundary(sizes: dict[int, int], largest: int = LARGEST_LIGHT) -> int:
    """The size up to which enumerating subsets costs less than listing and verifying."""
    best, boundary, enumerated = 0.0, 0, 0.0
    for n in range(1, largest + 1):
        per = sum(comb(n, needed(n, o)) for o in range(-(-3 * n // 4), 4 * n // 3 + 1) if needed(n, o) <= min(n, o))
        # Listing a small set costs its prefix, and a share of verified pairs that stand for its texts.
        enumerated += sizes.get(n, 0) * (per - 8 * prefix_length(n))
        if enumerated <= best:
            best, boundary = enumerated, n
    return boundary


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every short list with the places of the shared shingle in both."""
    for batch in _slices(batches, rows=2048):
        members = batch.column("members")
        rows = members.flatten()
        owner = np.repeat(np.arange(len(members)), pc.list_value_length(members).to_numpy())
        node, n, place = (rows.field(name).to_numpy() for name in ("node", "n", "place"))
        # One row per node and list, in order of nodes; copies of a text are listed again.
        order = np.lexsort((node, owner))
        owner, node, n, place = owner[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64)
        first = np.ones(len(node), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (node[1:] != node[:-1])
        owner, node, n, place = owner[first], node[first], n[first], place[first]
        after = np.searchsorted(owner, owner, "right") - np.arange(len(owner)) - 1
        left = np.repeat(np.arange(len(owner)), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        near = 4 * np.minimum(n[left], n[right]) >= 3 * np.maximum(n[left], n[right])
        left, right = left[near], right[near]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (node[left], node[right], n[left], n[right], place[left], place[right])],
            ["a", "b", "na", "nb", "pa", "pb"],
        )


def _short_list_candidates(postings: DataFrame) -> DataFrame:
    lists = (
        postings.where("short")
        .select("h", "node", "n", "place")
        .repartition("h")  # most lists have one member, so lists begun before the shuffle would only widen its rows
        .groupBy("h")
        .agg(F.collect_list(F.struct("node", "n", "place")).alias("members"))
        .where("size(members) > 1")
    )
    pairs = lists.select("members").mapInArrow(_list_pairs, "a long, b long, na long, nb long, pa long, pb long")
    shared = pairs.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    )
    rest = F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    return shared.where(F.col("c") + rest >= F.ceil(3 * (F.col("na") + F.col("nb")) / 7)).select("a", "b")


# ---------------------------------------------------------------- verification and components


def _texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of every wanted node (doc_id, node): fixed-size filters at the scan, then an exact join.

    Any row whose own set is the node's will do; the filter of ids only keeps other copies out of the shuffle,
    which deals texts by node alone, so that join and choice share it.
    """
    id_bits, node_bits = bit_filter(wanted.where("doc_id IS NOT NULL"), "doc_id"), bit_filter(wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nodes = np.frombuffer(id_bits, np.uint8), np.frombuffer(node_bits, np.uint8)
        for batch in batches:
            doc_id = batch.column("doc_id")
            keep = in_filter(ids, pc.fill_null(doc_id, 0).to_numpy()) | doc_id.is_null().to_numpy(zero_copy_only=False)
            for part in _slices([batch.filter(pa.array(keep))], "text"):
                keys, _ = set_keys(part.column("text"))
                part = pa.RecordBatch.from_arrays([pa.array(keys), part.column("text")], ["node", "text"])
                yield part.filter(pa.array(in_filter(nodes, keys)))

    rows = documents.where("text IS NOT NULL").select("doc_id", "text")
    rows = rows.mapInArrow(run, "node long, text string")
    return rows.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _sets_of(batch: pa.RecordBatch, node: str, text: str) -> list[np.ndarray]:
    """Every row's set; the text of a node that several rows hold is read once."""
    _, at, back = np.unique(batch.column(node).to_numpy(), return_index=True, return_inverse=True)
    _, sets = set_keys(batch.column(text).take(pa.array(at)))
    return [sets[k] for k in back.tolist()]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, "ta", "tb", rows=512):
        left, right = _sets_of(batch, "a", "ta"), _sets_of(batch, "b", "tb")
        linked = []
        for x, y in zip(left, right):
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= 75 * (len(x) + len(y) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, from whole texts by node."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of ``edges`` (a, b)."""
    both = materialize(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(),
        "join-edges",
    )
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    labels, stored = materialize(labels, "join-labels"), None
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other")
        spread = seen.groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(spread, "node").select("node", "label", F.least("label", "theirs").alias("next"))
        lower = materialize(lower, "join-labels")
        release(labels if stored is None else stored)
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = materialize(
            lower.join(jump, "next", "left").select("node", "label", F.coalesce(F.least("next", "further"), "next").alias("next")),
            "join-labels",
        )
        changed = moved.where("next <> label").limit(1).count()
        release(lower)
        stored, labels = moved, moved.select("node", F.col("next").alias("label"))
        if not changed:
            release(both)
            return labels


def _apart(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (h, node, n, label) of the lists that still hold more than one component."""
    known = lists.join(labels, "node", "left").select("h", "node", "n", F.coalesce("label", "node").alias("label"))
    known = materialize(known, "join-lists")
    open_lists = known.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    return materialize(known.join(materialize(open_lists, "join-open"), "h"), "join-members")


def _scan_blocks(group: pa.Table) -> pa.Table:
    """Links between two blocks of sets that join different components."""
    nodes, labels = group.column("node").to_numpy(), group.column("label").to_pylist()
    left, right = group.column("left").to_numpy(zero_copy_only=False), group.column("right").to_numpy(zero_copy_only=False)
    _, sets = set_keys(group.column("text"))
    sizes = np.array([len(x) for x in sets])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    probing, listed = np.flatnonzero(left), np.flatnonzero(right)
    flat = np.concatenate([sets[k] for k in listed])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(listed, sizes[listed])[order]
    out = []
    for x in probing.tolist():
        lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(sets))
        for y in np.flatnonzero((100 * shared >= 75 * (sizes[x] + sizes - shared)) & (shared > 0)).tolist():
            rx, ry = root(labels[x]), root(labels[y])
            if rx != ry:
                parent[rx] = ry
                out.append((int(nodes[x]), int(nodes[y])))
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links_in_blocks(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components of members (h, node, label) of open lists."""
    firsts = materialize(rest.groupBy("h").agg(F.min("node").alias("a")), "join-firsts")
    chained = rest.join(firsts, "h").select("a", F.col("node").alias("b")).distinct()
    clusters = components(chained).select("node", F.col("label").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    one = rest.select("node", "label").distinct().join(clusters, "node")
    one = materialize(one.join(materialize(sizes, "join-sizes"), "cluster"), "join-blocked")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Texts are joined before sets are repeated: Spark takes the repeated rows for as few as the sets, and would broadcast them.
    dealt = one.join(texts, "node").withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.withColumns({"left": F.col("block") == F.col("i"), "right": F.col("block") == F.col("j")})
    rows = dealt.select("cluster", "i", "j", "node", "label", "left", "right", "text")
    return rows.groupBy("cluster", "i", "j").applyInArrow(_scan_blocks, "a long, b long")


def _subset_pairs(light_sets: DataFrame, light: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of light sets that meet under a subset, and the stored subsets' first sets.

    Spark takes the subsets for as few as the sets they come from, so it must not choose to broadcast them.
    """
    subsets = light_sets.mapInArrow(_subsets(light), "h long, node long, low boolean")
    hubs = subsets.groupBy("h").agg(
        F.min(F.when(F.col("low"), F.col("node"))).alias("hub"), F.min("node").alias("a"), F.max("node").alias("z")
    )
    hubs = materialize(hubs.where("hub IS NOT NULL AND a <> z").select("h", "hub"), "join-subset-hubs")
    side = F.broadcast(hubs) if hubs.count() <= FEW else hubs.hint("merge")
    pairs = subsets.join(side, "h").where("hub <> node").select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")
    )
    return pairs, hubs


def linked_nodes(documents: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between nodes and the component labels, over all documents.

    ``nodes``: of :func:`_nodes` with ``small``, so that light sets need no further pass over the texts.
    """
    texts_in = documents.select("text").where("text IS NOT NULL")
    sizes = {r["n"]: r["k"] for r in nodes.where(F.col("n").between(1, LARGEST_LIGHT)).groupBy("n").agg(F.count_distinct("node").alias("k")).collect()}
    light = light_boundary(sizes)
    counted = texts_in.mapInArrow(_small_hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    bits = bit_filter(materialize(counted.where(F.col("k") > FREQUENT).select("h"), "join-frequent"), "h")
    postings = materialize(texts_in.mapInArrow(_postings(bits, light), _LISTED), "join-postings")

    light_sets = nodes.where(F.col("n").between(1, light)).groupBy("node").agg(F.first("small").alias("small"))
    light_sets = materialize(light_sets, "join-light")  # copies are one set
    by_subset, hubs = _subset_pairs(light_sets, light)

    long_lists = postings.where("NOT short").select("h", "node", "n").distinct()
    several = long_lists.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    several = materialize(several.select("h", F.col("a").alias("hub")), "join-hubs")
    members = materialize(long_lists.join(several.select("h"), "h"), "join-long-lists")
    by_hub = members.join(several, "h").where("hub <> node").select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")
    )
    short = _short_list_candidates(postings)
    pairs = materialize(short.unionByName(by_hub).unionByName(by_subset).distinct(), "join-pairs")
    release(postings, several, light_sets, hubs)

    # One text per node that has a list or subset mate.
    mates = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    mates = mates.unionByName(members.select("node")).distinct()
    wanted = materialize(
        nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(mates, "node"), "join-wanted"
    )
    texts = materialize(_texts_of(documents, wanted), "join-texts")

    tested = materialize(verified(pairs, texts), "join-tested")
    edges = materialize(tested.where("linked").select("a", "b"), "join-links")
    labels = components(edges)
    rest = _apart(members, labels)
    if rest.limit(1).count():
        more = materialize(_links_in_blocks(rest, texts), "join-block-links")
        if more.limit(1).count():
            edges = edges.unionByName(more)
            labels = components(edges)
    release(members, texts, pairs)
    return edges, labels


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = rows.mapInArrow(lambda batches: _nodes(batches, small=True), "doc_id long, node long, n long, small array<long>")
    nodes = materialize(sized, "join-nodes")
    filled = nodes.where("n > 0")
    _, labels = linked_nodes(rows, filled)
    firsts = materialize(filled.groupBy("node").agg(F.min("doc_id").alias("first")), "join-firsts")
    known = firsts.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    known = materialize(known, "join-known")
    least = materialize(known.groupBy("label").agg(F.min("first").alias("component_id")), "join-least")
    by_node = materialize(known.join(least, "label").select(F.col("node").alias("_node"), "component_id"), "join-components")
    on = (nodes["node"] == by_node["_node"]) & (nodes["n"] > 0)
    out = nodes.join(by_node, on, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with the smallest doc_id of every component."""
    stay = materialize(
        jaccard_components(documents).where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("_d")).distinct(),
        "join-stay",
    )
    return documents.join(stay, documents["doc_id"].cast("long").eqNullSafe(stay["_d"]), "left_semi")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and set size of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))
