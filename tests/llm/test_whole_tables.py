"""Queries without SQL against plain Python over every row of the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

from gridspark.llm.queries import QUERIES

SECRETS = "/root/testdata/sf0.01"  # the smallest table holds none

# The kinds of the contract.
KINDS = {
    "assign": re.compile(
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LONG_ENOUGH = {"assign": lambda m: len(m[1]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()


def test_secret_scan_of_the_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op8_secret_scan"](spark, SECRETS).collect()}
    rows = _documents(spark, SECRETS)
    assert len(got) == len(rows)
    found = 0
    for r in rows:
        spans, counts = [], {}
        for place, (kind, pattern) in enumerate(KINDS.items()):
            mine = [m for m in pattern.finditer(r.text or "") if LONG_ENOUGH[kind](m)]
            counts[kind] = len(mine)
            spans += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in mine]
        found += len(spans)
        text = ",".join(s for _, _, s in sorted(spans))
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(counts.values())
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert {s for _, _, s in spans} <= set((g.spans or "").split(","))
    assert found > 0


def _shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _first_of_group(rows):
    """The smallest id of every document's component of links, found pair by pair."""
    sets = {r.doc_id: _shingles(r.text) for r in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for other in holders[x]:
                shared[other] += 1
        for other, n in shared.items():
            if other < d and 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                a, b = sorted((root(d), root(other)))
                parent[b] = a
    return {d: root(d) for d in sets}


def test_the_pipelines_duplicate_stage_keeps_the_first_of_each_group(spark, sf_dir):
    import corpus_pipeline

    rows = _documents(spark, sf_dir)
    firsts = _first_of_group(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == {d for d, f in firsts.items() if d == f}
    assert len(kept) < len(rows)


def test_the_pipelines_secret_stage_changes_only_documents_with_secrets(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SECRETS}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    spans = {r.doc_id: r.spans for r in QUERIES["op8_secret_scan"](spark, SECRETS).collect()}
    after = corpus_pipeline.secrets(spark, docs, SECRETS)
    assert after.columns == docs.columns
    rows = after.collect()
    assert len(rows) == len(before) and any(spans.values())
    for r in rows:
        old = before[r.doc_id]
        assert (r.text == old.text) == (not spans[r.doc_id])
        assert r.lang == old.lang and r.source == old.source


def test_packing_places_every_id_once(spark, sf_dir):
    """Pieces of the whole table: no gap inside a sequence or a document, no padding but at the very end."""
    from tokenizers import Tokenizer

    from gridspark.llm.tokens import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = QUERIES["op10_nnls_packing"](spark, sf_dir).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in _documents(spark, sf_dir):
        ids, at = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p.length
        assert at == len(ids)
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0
