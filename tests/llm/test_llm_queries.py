"""Registered queries over whole small tables, against SQL or plain code."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from careweft.llm import licenses, near, packing
from careweft.llm.queries import REGISTRY

LENGTH = 1024


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, sf_dir, name):
    return Counter(map(tuple, REGISTRY.queries[name](spark, sf_dir).collect()))


def test_html_text(spark, sf_dir):
    """The given pages hold one article each, of headings and paragraphs without boilerplate."""
    want = Counter()
    for page_id, url, page in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect():
        article = re.search(r"<article[^>]*>(.*)</article>", page or "", re.S)
        blocks = re.split(r"</?(?:h1|p)[^>]*>", article[1]) if article else []
        texts = [" ".join(unescape(re.sub(r"<br[^>]*>", " ", block).replace("<b>", "").replace("</b>", "")).split()) for block in blocks]
        text = "\n\n".join(t for t in texts if t)
        want[page_id, url, text, len(text)] += 1
    assert rows(spark, sf_dir, "op7_html_text") == want


def test_near_duplicates(spark, sf_dir):
    assert rows(spark, sf_dir, "op10_near_duplicates") == Counter(brute.near_components(documents(spark, sf_dir)))


def test_suffix(spark, sf_dir):
    assert rows(spark, sf_dir, "op8_suffix_dedup") == Counter(brute.repeated_spans(documents(spark, sf_dir)))


def test_token_files(spark, sf_dir):
    library, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for key, text in sorted(documents(spark, sf_dir)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(spark, sf_dir, "op6_token_files") == Counter(want)


def test_pipeline(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kept = {r.doc_id for r in REGISTRY.queries["op1_quality_rules"](spark, sf_dir).collect() if r.kept}
    docs = [r for r in docs if r[0] in kept]
    staying = {key for key, _, _, chosen in brute.near_components(docs, 80) if chosen}
    docs = [r for r in docs if r[0] in staying]
    spans = {r[0]: r for r in brute.repeated_spans(docs)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == staying
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    for key, text in docs:
        if not spans[key][2]:
            ids = library.encode(text, add_special_tokens=False).ids + [2]
            assert lengths[key] == len(ids)
            first = packing.piece_lengths(len(ids), LENGTH)[0]
            assert (key, 0, zlib.crc32(np.array(ids[:first], "<u4").tobytes())) in {(r.doc_id, r.piece, r.ids_crc32) for r in got}
    bins = Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= LENGTH


def test_near_stage_links_from_80(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = brute.near_components(documents(spark, sf_dir), 80)
    staying = {key for key, _, _, chosen in found if chosen}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == staying
    assert staying != {key for key, _, _, chosen in brute.near_components(documents(spark, sf_dir), 85) if chosen}
    assert {p: near.bands_needed(p) for p in (80, 85, 100)} == {80: 35, 85: 24, 100: 1}


def test_periodic_runs(spark, sf_dir):
    got = REGISTRY.queries["op11_periodic_runs"](spark, sf_dir).drop("n_words").collect()
    want = [brute.run_digest(*row) for row in documents(spark, sf_dir)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(w[1] > 0 for w in want) > 10


def test_shards(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = REGISTRY.queries["op12_shards"](spark, sf_dir).collect()
    want = Counter((key, len((text or "").encode()) + 8, zlib.crc32((text or "").encode())) for key, text in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, load = {}, Counter()
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in got)


def test_conversation_repair(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute.repaired_conversations(brute.damaged_turns(rows), [r[0] for r in rows])
    got = REGISTRY.queries["op13_conversation_repair"](spark, sf_dir).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    # Deleting a row is cheaper than inserting one, so at these costs no audit holds an insertion.
    assert {c for w in want for c in w[7]} == set("DKR")


def test_byte_bpe(spark, sf_dir):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library, want = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), []
    for key, text in documents(spark, sf_dir):
        ids = library.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = REGISTRY.queries["op3_byte_bpe"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_best_fit_packing(spark, sf_dir):
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for key, text in documents(spark, sf_dir):
        ids, start = library.encode(text or "", add_special_tokens=False).ids + [2], 0
        for piece, length in enumerate(packing.piece_lengths(len(ids), LENGTH)):
            want.append((key, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start += length
    got = REGISTRY.queries["op5_best_fit_packing"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= LENGTH
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.02 * -(-total // LENGTH) + 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, class string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_with_odd_rows(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    long = " ".join(f"word{i}" for i in range(30_000))
    good = " ".join(f"plain{i % 97} text{i % 89}" for i in range(60))
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 1, "x"), (None, good, None, None, None, None, None), (3, long, "en", "s", 1, 1, "x")]
    rows += [(4, good, "en", "s", 1, 1, "x")] * 2
    out = stage(spark, spark.createDataFrame(rows, ODD), sf_dir)
    kept = {r["doc_id"] for r in out.collect()}
    none = stage(spark, spark.createDataFrame([], ODD), sf_dir)
    assert none.count() == 0 and none.columns == out.columns
    if name == "best_fit_packing":
        assert kept == {1, 2, 3, 4, None}
    else:
        assert out.columns == [c.split()[0] for c in ODD.split(", ")]
        assert 3 in kept
    if name == "near_dedup":
        # Copies are one document, whatever their keys; documents without words are not copies of each other.
        assert kept == {1, 2, 3, 4}


def test_pipeline_on_nothing(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_license_scan(spark, sf_dir):
    """The given documents hold notices as whole lines; they are found by plain search."""
    known = {n: f for f, texts in licenses.NOTICES.items() for n in texts}
    want = []
    for key, text in documents(spark, sf_dir):
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        found = [known[x] for x in lines if x in known]
        want.append((key, len(lines), len(found), ",".join(sorted(set(found)))))
    got = REGISTRY.queries["op9_license_scan"](spark, sf_dir).select("doc_id", "n_paragraphs", "n_confirmed", "families")
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert any(f for *_, f in want)
