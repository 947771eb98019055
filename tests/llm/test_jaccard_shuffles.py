"""What the Jaccard join moves: texts once, and lists as plain rows."""

import re

import pyarrow as pa
import pytest

from gridspark.llm import jaccard_join as j
from gridspark.session import materialize

WORDS = [f"w{i}" for i in range(40)]


def _documents(spark):
    a, b, c = " ".join(WORDS), " ".join(WORDS[::-1]), " ".join(WORDS[:30])
    rows = [(1, a), (1, b), (2, a), (3, a), (None, b), (None, c), (7, None), (8, ""), (9, a + " x")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_texts_move_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = materialize(_documents(spark), "test-docs")
        nodes = materialize(documents.mapInArrow(j._nodes, "doc_id long, node long, n long").where("n > 0"), "test-nodes")
        wanted = materialize(nodes.groupBy("node").agg({"doc_id": "min"}).toDF("node", "doc_id"), "test-wanted")
        texts = j._texts_of(documents, wanted)
        assert _shuffles(texts) == 2  # texts, and the wanted nodes
        found = [(r["node"], r["text"]) for r in texts.collect()]
        given = [r["text"] for r in documents.collect() if r["text"]]
        expected = set(zip(j.set_keys(pa.array(given))[0].tolist(), given))
        assert len(found) == len({n for n, _ in expected}) == len({n for n, _ in found}) and set(found) <= expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lists_are_gathered_after_the_shuffle(spark):
    rows = [(5, 1, 20, 0, True), (5, 2, 21, 1, True), (6, 3, 20, 0, True), (7, 1, 20, 1, True), (7, 2, 21, 0, True), (7, 9, 90, 0, True), (8, 1, 20, 2, False)]
    postings = spark.createDataFrame(rows, j._LISTED)
    pairs = j._short_list_candidates(postings)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2)}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    widened = re.findall(r"Exchange hashpartitioning\(h#\d+L?, \d+\), ENSURE_REQUIREMENTS", plan)
    assert not widened and "REPARTITION_BY_COL" in plan


def test_texts_are_hashed_four_times(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    base = " ".join(WORDS)
    texts = [base, base, base + " x", "a b c d e f g", "a b c d e f g", "a b c d e f g h", "", None, "one two", "One  two"]
    rows = list(enumerate(texts, 1)) + [(None, "a b c d e f g")]
    documents = materialize(spark.createDataFrame(rows, "doc_id long, text string"), "test-docs")
    out = j.jaccard_components(documents.mapInArrow(count, "doc_id long, text string"))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert found[1] == (36, 1) and found[3] == (37, 1) and found[5] == (3, 4) and found[10] == (1, 9)
    assert found[6] == (4, 4) and found[7] == (0, 7) and found[8] == (0, 8)
    # Sizes, counted shingles, lists, and texts of nodes; light sets come with the sizes.
    assert read.value <= 4 * len(rows)


def test_lists_by_the_global_order():
    texts = [" ".join(WORDS[:n]) for n in (4, 9, 12, 20, 40)] + [None, "x x x x x x x x x x", " ".join(WORDS[::-1])]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    keys, sets = j.set_keys(batch.column("text"))
    bits = bytearray(1 << 10)
    for h in sets[4][::3].tolist():
        for p in (h % (1 << 13), (h >> 24) % (1 << 13)):
            bits[p >> 3] |= 1 << (p & 7)
    filtered = j.np.frombuffer(bytes(bits), j.np.uint8)
    for light in (0, 7):
        expected = set()
        for key, s in zip(keys.tolist(), sets):
            if len(s) and len(s) >= -(-3 * (light + 1) // 4):
                often = j.in_filter(filtered, s)
                ranked = sorted(zip(often.tolist(), s.tolist()))[: j.prefix_length(len(s))]
                expected |= {(h, key, len(s), k, not o and h < int(j._LIMIT)) for k, (o, h) in enumerate(ranked)}
        found = [r for b in j._postings(bytes(bits), light)([batch]) for r in b.to_pylist()]
        assert {(r["h"] % 2**64, r["node"], r["n"], r["place"], r["short"]) for r in found} == expected
        assert len(found) == len(expected) > 0


def _broadcast_parts(df) -> list[str]:
    """The part of the plan below every broadcast."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(re.match(r"[\s:+|*()\d-]*", line).group())
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[at + 1 :]]
            ends = [k for k, x in enumerate(below) if depth(x) <= depth(line)]
            out.append("\n".join(below[: ends[0] if ends else None]))
    return out


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_sets_are_repeated_after_the_texts_joined(spark, monkeypatch, limit):
    """A small table of sets that becomes large when it is dealt over pairs of blocks is not sent to the driver."""
    monkeypatch.setattr(j, "BLOCK", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        texts = [" ".join([*WORDS, f"x{i // 2}", *(["y"] if i % 2 else [])]) for i in range(40)]
        keys = j.set_keys(pa.array(texts))[0].tolist()
        stored = materialize(spark.createDataFrame(list(zip(keys, texts)), "node long, text string"), "test-texts")
        rest = spark.createDataFrame([(h, k, len(t.split()) - 4, k) for h in (1, 2) for k, t in zip(keys, texts)], "h long, node long, n long, label long")
        links = j._links_in_blocks(materialize(rest, "test-rest"), stored)
        assert not any("Generate" in part for part in _broadcast_parts(links))
        found = {r["node"]: r["label"] for r in j.components(links).collect()}
        assert set(found) == set(keys) and len(set(found.values())) == 1  # all are near copies
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("few", [0, 1000])
def test_subsets_are_not_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(j, "FEW", few)
    base = list(range(1, 9))
    sets = [(100 + i, [x * 7919 for x in base] + [(50 + i) * 104729]) for i in range(30)] + [(1, [3, 5, 8])]
    light = materialize(spark.createDataFrame(sets, "node long, small array<long>"), "test-light")
    pairs, _ = j._subset_pairs(light, 12)
    assert not any("MapInArrow" in part for part in _broadcast_parts(pairs))
    assert bool(_broadcast_parts(pairs)) == bool(few)
    assert {(r["a"], r["b"]) for r in pairs.distinct().collect()} == {(100, 100 + i) for i in range(1, 30)}
