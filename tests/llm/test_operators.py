"""Edges and brute force for the operators; every case uses nulls, empty and long texts, ties,
repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from careweft.llm import chat, html, licenses, near, packing, quality, queries, repair, runs, sharding, suffix, token_files, topk, transducer, words
from careweft.session import staging_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, class string, row int"


def sentence(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def make_texts() -> list[str | None]:
    rng = random.Random(7)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    near_copy = base.split()
    near_copy[60] = "other"
    return [
        None,
        "",
        " \n\t ",
        "one",
        "Three Small words",
        base,
        base,
        base.upper(),
        " ".join(near_copy),
        sentence(rng, 40) + " " + passage + " " + sentence(rng, 40),
        passage + "\n" + sentence(rng, 90),
        "é" * 150 + passage + "ü" * 101,
        "ab" * 300,
        sentence(rng, 6000),
        "x" * 5000,
        "a  b \n c d <|endoftext|> <|im_end|> it's 12 ###  ",
        "Licensed under the MIT license.\nReleased under the MIT License.\n" + sentence(rng, 60),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    texts = make_texts()
    rows = [(i, t, "en", "s", None, 3, "k", 1) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", None, 3, "k", 1), (None, "a row without a key", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs) -> list[tuple]:
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def same(df, want) -> None:
    assert Counter(map(tuple, df.collect())) == Counter(want)


def test_quality_measures(docs):
    def plain(text):
        w = [x.decode() for x in brute.WORDS.findall((text or "").encode())]
        lines = [x for x in (text or "").split("\n") if brute.WORDS.search(x.encode())]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    got = quality.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same(got, [(k, *plain(t)) for k, t in pairs(docs)])


def test_quality_policies_read_the_ledger(docs):
    ledger = quality.ledger(docs)
    rows = ledger.collect()
    table = {r.rule: r for r in quality.ablations(ledger).collect()}
    for i, name in enumerate(quality.RULES):
        mask = quality.POLICIES[quality.CURRENT]
        assert table[name].failing == sum(r.failed >> i & 1 for r in rows)
        assert table[name].kept_without == sum(not r.failed & mask & ~(1 << i) for r in rows)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs).count() == sum(not r.failed for r in rows)


def test_chat_round_trip(spark):
    hard = ["<|im_end|>", r"<\|im_end|>", "<|im_end|><|im_start|>assistant ok", "", None, "a\nb", "<", "<|im_end", r"\<|im_start|>", "é😀"]
    rows = [(c, t, role, hard[(c + t) % len(hard)], "x") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "odd\n\\n<|im_end|>", None])]
    rows += [(3, 1, "user", "same number", "x"), (None, 0, "user", "no conversation", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for key in {r[0] for r in rows}:
        turns = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == key)
        lines = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[key]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(lines.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_leaves_plain_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b |> c")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "<|im_start|>user\na < b |> c<|im_end|>\n"


def test_transducer_equals_library(docs):
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=transducer.read_ranks(RANKS), special_tokens={})

    def plain(text):
        ids = library.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    same(transducer.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN), [(k, *plain(t)) for k, t in pairs(docs)])
    ids = transducer.bpe_encode(docs.select("doc_id", "text"), "text", RANKS, public_tokenizers.PATTERN)
    back = transducer.bpe_decode(ids, "ids", RANKS, public_tokenizers.PATTERN)
    assert back.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0


def test_transducer_streams_and_resets():
    ranks = transducer.read_ranks(RANKS)
    whole, small = transducer.Transducer(ranks), transducer.Transducer(ranks, max_states=50)
    rng = random.Random(3)
    matches = ["".join(rng.choice("aeitnthing éß中") for _ in range(rng.randrange(1, 30))).encode() for _ in range(300)]
    ids, counts = whole.encode_many(matches)
    for i in range(0, len(matches), 7):
        assert small.encode_many(matches[i : i + 7])[0].tolist() == ids[counts[:i].sum() : counts[: i + 7].sum()].tolist()
    assert [list(whole.stream([m[:3], m[3:]])) for m in matches] == [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    for a, b in zip(matches[::2], matches[1::2], strict=True):
        a, b = whole.merge(a)[-1], whole.merge(b)[0]
        assert whole._stays(a, b) == (whole.merge(a + b) == [a, b])


def test_decoder_holds_split_characters():
    ranks = {bytes([b]): b for b in range(256)}
    decoder = transducer.StreamDecoder(ranks)
    data = "aé中😀z".encode()
    assert "".join(decoder.feed(np.array([b]))[1] for b in data) == "aé中😀z"
    assert decoder.close()
    decoder.restart()
    decoder.feed(np.array([0xE4, 0xB8]))
    assert not decoder.close()


def test_top_k_edges(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(300, 8)).round(1)
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(values)]
    rows += [(400, None, "x"), (401, [], "x"), (402, [1.0, None] * 4, "x"), (403, [float("nan")] * 8, "x"), (404, [float("inf")] * 8, "x"), (420, [1.0], "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    whole = np.floor(values * 64).astype(int)
    want = []
    for q in range(0, 300, 20):
        order = sorted((int(-(whole[q] @ whole[i])), i) for i in range(300) if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    same(topk.top_k(df, 20, 20, 64), want)
    assert topk.top_k(df.limit(0), 20, 20, 64).count() == 0


def test_top_k_keeps_rows_of_one_id(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 30, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(70)] + [(7, [5.0] * 4)] * 2
    want, scaled = [], [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows]
    for q in (0, 20):
        found = sorted((-int(v @ w), i) for p, w in scaled if p == q for i, v in scaled if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    same(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20, 64), want)


def test_top_k_with_ties_and_small_blocks(monkeypatch):
    ids = np.arange(500)
    exact = np.tile([1, 2, 3, 4], (500, 1))
    at, found, scores, _ = topk.search(ids[:3], exact[:3], ids, exact, topk.Cells.of(exact), 20)
    assert found[at == 0].tolist() == list(range(1, 21)) and set(scores) == {30}


def test_top_k_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1, 40, 10**4, 10**8):
        exact = (rng.normal(size=(400, 48)) * scale).astype("i8")
        exact[:, 5] = 7
        queries = (rng.normal(size=(9, 48)) * scale).astype("i8")
        products, error = topk.Cells.of(exact).bounds(queries)
        true = exact.astype(object) @ queries.T.astype(object)
        assert all(abs(float(true[i, q]) - products[i, q]) <= error[q] for i in range(400) for q in range(9))


def test_top_k_reads_few_exact_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 500)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    values = centres[rng.integers(20, size=4000)] + 0.1 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    got = topk.reads(df, 200, 20, 64).collect()
    assert len(got) == 20 and {r.n_candidates for r in got} == {4000}
    assert 20 <= min(r.n_read for r in got) and sum(r.n_read for r in got) < 0.5 * 20 * 4000
    whole = np.floor(values * 64).astype("i8")
    want = []
    for q in range(0, 4000, 200):
        order = sorted((int(-(whole[q] @ whole[i])), i) for i in range(4000) if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    same(topk.top_k(df, 200, 20, 64), want)


def test_packing(docs, none):
    library = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(docs, TOKENIZER, 2, 64).collect()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for key, text in pairs(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for n, length in enumerate(packing.piece_lengths(len(ids), 64)):
            want.append((key, n, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())))
            at += length
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack_documents(none, TOKENIZER, 2).count() == 0


def test_bin_plan():
    assert packing.fullest({7: 1, 5: 1, 3: 1}, 10) == [(7, 1), (3, 1)]
    rng = random.Random(4)
    for _ in range(50):
        counts = Counter(rng.randrange(1, 41) for _ in range(rng.randrange(1, 300)))
        plan = packing.plan_bins(dict(counts), 40)
        used = Counter()
        for bins, chosen in plan:
            assert sum(n * times for n, times in chosen) <= 40
            for n, times in chosen:
                used[n] += bins * times
        assert used == counts
        assert sum(bins for bins, _ in plan) <= -(-sum(n * c for n, c in counts.items()) // 40) * 1.1 + 2


def test_token_files(spark, docs, none):
    library = Tokenizer.from_file(TOKENIZER)
    folder = staging_path(spark, "files-test")
    token_files.write_token_files(docs, folder, TOKENIZER, 2, ids_per_file=500)
    at, want, all_ids = 0, [], []
    for key, text in sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        all_ids += ids
        at += len(ids)
    same(token_files.read_token_files(spark, folder), want)
    files = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path").collect())
    assert len(files) > 2
    first = token_files.read_range(files[0].replace("file:///", "/").replace("file:/", "/"), 1, 5)
    assert first.tolist() == all_ids[1:6]
    empty = staging_path(spark, "files-empty")
    token_files.write_token_files(none, empty, TOKENIZER, 2)


@pytest.mark.parametrize("width", [1, 7, 12, 16, 17, 31, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10_001).astype("<u4")
    data = token_files.pack(ids, width)
    assert len(data) == -(-len(ids) // 8) * width
    assert (token_files.unpack(data, len(ids), width) == ids).all()


def test_words_memo_equals_library(monkeypatch):
    monkeypatch.setattr(words, "MAX_WORDS", 20)
    monkeypatch.setattr(words, "GROUP_CHARS", 50)
    library = Tokenizer.from_file(TOKENIZER)
    texts = [t or "" for t in make_texts()[:13]] + [" a", "a ", "a\n b", "a \nb", "<|endoftext|>", "y" * 80 + " z", "a　b c"]
    got = [np.frombuffer(p, "<u4").tolist() for p in words.LibraryEncoder(TOKENIZER).encode_all(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_html_cases(spark):
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Home</li></ul></nav>
      <div class="cookie-banner">accept</div><!-- <p>no</p> --><article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text<br>next
      <p>Second&nbsp;one<aside>side</aside><div class='ad'>buy</div><form><p>send</p></form><script>var a="</p>";</script><p>Short.
      </article><section id="comments"><p>nice</p></section><footer>&copy;</footer></body></html>"""
    assert html.main_text(page) == "Title & more\n\nFirst bold text next\n\nSecond one\n\nShort."
    bare = "<body><div class=menu>Home</div><div id=content><p>" + "word " * 40 + "</p><p>end</p></div><div>about</div></body>"
    assert html.main_text(bare) == ("word " * 40).strip() + "\n\nend"
    assert html.main_text("<p>a</p><p>b") == "a\n\nb" and html.main_text("") == "" and html.main_text("<") == "<"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html.extract(df).collect()) == [0, 54, 54]
    assert html.extract(df.limit(0)).count() == 0


def test_html_ends_decide(monkeypatch):
    text = "word " * 40
    page = f"<body><article><h1>Head</h1><p>{text}<p>{text}<p>End.</article><article>more</article><div>about</div></body>"
    assert html.text_ends(html.lines_of(page)) == (0, 4)
    assert html.main_text(page) == f"Head\n\n{text.strip()}\n\n{text.strip()}\n\nEnd."
    # A part of the article that does not surge is not cut off.
    parts = f"<article><section><p>{text}<p>{text}</section><section>End.</section></article><div>about</div>"
    assert html.text_ends(html.lines_of(parts)) == (0, 3)
    long_list = f"<article><p>{text}</p><ul>{'<li>one</li>' * 30}</ul><p>End.</p></article><div>about</div>"
    assert html.text_ends(html.lines_of(long_list)) == (0, 32)
    monkeypatch.setattr(html, "text_ends", lambda lines: (1, 2))
    assert html.main_text(page) == text.strip()


def test_html_pages_without_bodies():
    text = ("word " * 40).strip()
    flat = f"<body><div>Home</div><div>About us</div><h1>Title</h1>{f'<p>{text}</p>' * 6}<div>Copyright</div><div>Terms</div></body>"
    assert html.main_text(flat).split("\n\n") == ["Title", *[text] * 6]
    menu = f"<body><ul><li><a href=x>Menu one</a><li><a href=y>Two</a></ul><p>{text}<p>{text} <a href=w>with a link</a><p>End.<p><a href=z>more</a></body>"
    assert html.main_text(menu).split("\n\n") == [text, f"{text} with a link", "End."]
    lead = f"<body><div>Home</div><p>{text}</p><main><p>{text}<p>End.</main><div>about</div></body>"
    assert html.main_text(lead).split("\n\n") == [text, text, "End."]
    assert html.main_text("<p><a href=x>only</a><p><a href=y>links</a>") == "only\n\nlinks"
    # A link that is never closed ends with its line.
    assert html.main_text(f"<div><p><a href=x>{text}<p>{text}</div>").endswith(text)


def test_html_names_inside_articles():
    page = """<div class="header">Top</div><article><header><h1>Title</h1></header><h2 class="section-header">Results</h2><p>It was <span class="comment">noted</span>.
      <p class="share">x<div class="alert alert-info">info</div><div class="ad-box">buy</div><p class="ad">buy<p hidden>no
      <div class="comments"><p>nice</p></div><footer>foot</footer></article>"""
    assert html.main_text(page) == "Title\n\nResults\n\nIt was noted.\n\nx\n\ninfo"


def test_html_neighbours_and_optional_end_tags():
    first, second = "a" * 600, "b" * 400
    assert html.main_text(f"<body><div>Home</div><div id=content><div>{first}</div><div>{second}</div></div><div>about</div>") == f"{first}\n\n{second}"
    assert html.main_text(f"<div><div>{second}</div>cut<div>{first}</div></div>") == f"{second}\n\ncut\n\n{first}"
    assert html.main_text("<article><p class=ad>Buy<p>Text<p>more</article>") == "Text\n\nmore"
    assert html.main_text("<div><p class=ad>Buy<div>Text</div></div>") == "Text"
    assert html.main_text("<ul><li class=ad>Buy<ul><li>this</ul><li>Text</ul><p>more") == "Text\n\nmore"
    assert html.main_text("<ul><li class=ad>Buy</ul><p>Text") == "Text"
    assert html.main_text("<dl><dt class=ad>Buy<dd>Text<dd class=ad>Buy<dt>more</dl>") == "Text\n\nmore"
    assert html.main_text("<table><tr class=ad><td>Buy<tr><td class=ad>Buy<td>Text</table><p>more") == "Text\n\nmore"
    assert html.main_text("<html><head><title>no</title><meta charset=utf-8><body><p>Text") == "Text"


def test_suffix_equals_brute_force(docs, none):
    got = suffix.repeat_digests(docs)
    same(got, brute.repeated_spans(pairs(docs)))
    assert suffix.remove_repeats(docs).columns == docs.columns
    assert suffix.repeat_digests(none).count() == 0


def test_suffix_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_ROWS", 20)
    monkeypatch.setattr(suffix, "BATCH_ROWS", 10)
    rng = random.Random(9)
    line = sentence(rng, 30)
    texts = [sentence(rng, 30, 9) + line + sentence(rng, 30, 9) for _ in range(120)] + ["ab" * 250, "abab" * 60 + "c" + "ab" * 120]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(suffix.repeat_digests(df), brute.repeated_spans(list(enumerate(texts))))


def test_near_duplicates_equal_brute_force(docs, none):
    rows = [r for r in pairs(docs) if r[0] is not None]
    got = near.near_duplicates(docs.filter("doc_id is not null"))
    same(got, brute.near_components(rows))
    assert near.near_duplicates(none).count() == 0
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id in (5, 6, 7)").count() == 1


def test_near_copies_without_a_key(spark):
    """A null key counts as largest; its text may be the only one of its class."""
    rng = random.Random(13)
    base = sentence(rng, 200, 5000).split()
    texts = []
    for i in range(4):
        copy = list(base)
        copy[50 * i] = "other"
        texts.append(" ".join(copy))
    pair = sentence(rng, 100, 5000)
    rows = [(7, texts[0]), (3, texts[1]), (None, texts[2]), (None, texts[3]), (None, pair), (None, pair + " more"), (9, sentence(rng, 90, 5000)), (None, None)]
    last = 1 << 62
    found = brute.near_components([(last if k is None else k, t) for k, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(near.near_duplicates(df), [(None if k == last else k, n, None if c == last else c, kept) for k, n, c, kept in found])
    kept = [(r.doc_id, r.text) for r in near.keep_one(df).collect()]
    assert len(kept) == 4 and (3, texts[1]) in kept and (None, None) in kept


def test_near_chains(spark):
    """Neighbours are alike, ends are not: one component all the same."""
    rng = random.Random(5)
    words_ = sentence(rng, 300, 5000).split()
    texts = []
    for i in range(40):
        texts.append(" ".join(words_))
        words_[(7 * i) % 300 : (7 * i) % 300 + 5] = [f"n{i}_{k}" for k in range(5)]
    texts += [sentence(rng, 300, 5000) for _ in range(20)]
    rows = list(enumerate(texts))
    same(near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), brute.near_components(rows))


def test_near_copies_of_one_text(spark):
    """A large group of copies with a few edits each: many are close to links, few pairs are tried."""
    rng = random.Random(11)
    base = sentence(rng, 150, 5000).split()
    texts = []
    for i in range(150):
        copy = list(base)
        for k in range(rng.randrange(6)):
            copy[rng.randrange(150)] = f"e{i}_{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    same(near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), brute.near_components(rows))


@pytest.mark.parametrize(("blocks", "entries"), [(512, 1 << 22), (40, 50)])
def test_near_copies_left_open_make_no_pairs(spark, monkeypatch, blocks, entries):
    """Without rounds all open classes meet: links are those of brute force, and rows are not made by pair."""
    monkeypatch.setattr(near, "ROUNDS", 0)
    monkeypatch.setattr(near, "CLASSES_PER_BLOCK", blocks)
    monkeypatch.setattr(near, "ENTRIES", entries)
    monkeypatch.setattr(near, "COLUMNS", 64 if entries > 50 else 7)
    whole, links = near.met, []
    monkeypatch.setattr(near, "met", lambda *a: links.append((a[0].count(), whole(*a))) or links[-1][1])
    rng = random.Random(12)
    base = sentence(rng, 120, 5000).split()
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(2 + rng.randrange(4)):
            copy[rng.randrange(120)] = f"e{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for per_cent in (85, 80):
        same(near.near_duplicates(df, per_cent), brute.near_components(rows, per_cent))
    assert links and all(found.count() <= n for n, found in links)


def test_common_items():
    rng = random.Random(13)
    sets = [np.array(sorted({rng.randrange(20) * (1 if rng.random() < 0.5 else 1000 + k) for _ in range(rng.randrange(1, 30))}), "u8") for k in range(50)]
    got = near._common(sets[:20], sets[20:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[20:]] for a in sets[:20]]


def test_shared_sizes_make_a_row_a_shingle(spark, monkeypatch):
    """A passage that all classes have gives no row, in however many chunks it was counted."""
    monkeypatch.setattr(near, "SHINGLES_PER_CHUNK", 1)
    squeeze = near.zstandard.ZstdCompressor().compress
    rng = random.Random(14)
    passage = sentence(rng, 40, 10**6)
    texts = [f"{passage} {sentence(rng, 5, 10**6)}".encode() for _ in range(60)]
    df = spark.createDataFrame([(t[-9:], len(near.shingles(t)), squeeze(t)) for t in texts], "class binary, size long, packed binary")
    got = near.shared_sizes(df).collect()
    assert {r.shared for r in got} == {36} and len(got) == 60
    own = [r.own for r in near._lone(df).collect()]
    assert sum(own) == sum(len(near.shingles(t)) for t in texts) - 60 * 36 and min(own) > 0
    assert near._counted(df).filter("shared > 0").count() == 0


def test_shared_sizes(spark):
    sets = {"a": "1 2 3 4 5 6 7", "b": "0 2 3 4 5 6 7", "c": "x y z u v w"}
    squeeze = near.zstandard.ZstdCompressor().compress
    rows = [(k.encode(), len(near.shingles(t.encode())), squeeze(t.encode())) for k, t in sets.items()]
    texts = spark.createDataFrame(rows, "class binary, size long, packed binary")
    assert {bytes(r["class"]): r.shared for r in near.shared_sizes(texts).collect()} == {b"a": 2, b"b": 2, b"c": 0}


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_shared_sizes_of_a_common_passage(spark, monkeypatch, chunk):
    monkeypatch.setattr(near, "SHINGLES_PER_CHUNK", chunk)
    rng = random.Random(17)
    passage = sentence(rng, 9, 10**6)
    sets = {f"c{i:02}": f"{sentence(rng, i, 10**6)} {passage} {sentence(rng, 60 - i, 10 + i)}".strip() for i in range(40)}
    squeeze, found = near.zstandard.ZstdCompressor().compress, {k: set(near.shingles(t.encode()).tolist()) for k, t in sets.items()}
    rows = [(k.encode(), len(found[k]), squeeze(t.encode())) for k, t in sets.items()]
    texts = spark.createDataFrame(rows, "class binary, size long, packed binary").coalesce(2)
    often = Counter(x for s in found.values() for x in s)
    assert {bytes(r["class"]).decode(): r.shared for r in near.shared_sizes(texts).collect()} == {k: sum(often[x] > 1 for x in s) for k, s in found.items()}
    dealt = Counter(r.shingle for r in near._counted(texts).filter("shared <= 0").collect())
    assert max(dealt.values()) <= {1: 40, 40: 40, 1 << 20: 2}[chunk] and max(often.values()) == 40


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 1 << 63, 1000, dtype="u8")
    a, b = near.sketch(items[:900]), near.sketch(items[100:])
    assert abs((a == b).mean() - 0.8) < 0.12
    assert (near.sketch(items[:1]) < np.iinfo("u8").max).all()


def test_licenses(spark, docs, none):
    model = licenses.Model(licenses._training_rows(docs, spark))
    assert model.held_out_accuracy > 0.9
    rows = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    assert (rows[16].families, rows[16].n_confirmed) == ("MIT", 2)
    assert all(r.families == "" for k, r in rows.items() if k != 16)
    assert licenses.scan(docs, model).count() == docs.count()
    assert licenses.scan(none, model).count() == 0
    lines = [(n,) for texts in licenses.NOTICES.values() for n in texts]
    judged = licenses.classify(spark.createDataFrame(lines, "line string"), model)
    right = {(f, n) for f, texts in licenses.NOTICES.items() for n in texts}
    assert sum((r.family, r.line) in right and r.confirmed for r in judged.collect()) > 0.9 * len(lines)


def test_licenses_without_triggers_and_wrapped(spark, docs):
    model = licenses.Model(licenses._training_rows(docs, spark))
    rng = random.Random(21)
    plain = [sentence(rng, 12) for _ in range(6)]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    gpl, bsd = licenses.NOTICES["GPL"][1], licenses.NOTICES["BSD"][1]

    def wrap(text, n, mark="# "):
        w = text.split()
        return "\n".join(mark + " ".join(w[i : i + n]) for i in range(0, len(w), n))

    texts = {
        1: (mit, "MIT", 1),
        2: ("\n".join([plain[0], wrap(mit, 7), plain[1]]), "MIT", 1),
        3: (wrap(gpl, 8) + "\n\n" + wrap(bsd, 5, " * "), "BSD,GPL", 2),
        4: ("\n".join(plain), "", 0),
        5: ("\n".join([licenses.NOTICES["CC-BY-NC"][1], plain[2]]), "CC-BY-NC", 1),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: (r.families, r.n_confirmed) for r in licenses.scan(df, model).collect()} == {k: (f, n) for k, (_, f, n) in texts.items()}


def test_licenses_of_any_number_of_lines(spark, docs):
    """A notice a word a line, two wrapped ones without a blank line between, one inside a long line, and control characters."""
    model = licenses.Model(licenses._training_rows(docs, spark))
    rng = random.Random(22)
    gpl, bsd, cc0 = licenses.NOTICES["GPL"][1], licenses.NOTICES["BSD"][1], licenses.NOTICES["CC0"][0]

    def wrap(text, n):
        w = text.split()
        return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))

    long = sentence(rng, 30000)
    texts = {
        1: (wrap(gpl, 1), "GPL"),
        2: (wrap(gpl, 3) + "\n" + wrap(bsd, 2), "BSD,GPL"),
        3: (long + ". " + cc0 + " " + long, "CC0"),
        4: (licenses.BREAK + wrap(cc0, 4).replace("\n", licenses.BREAK + "\n"), "CC0"),
        5: (wrap(long, 4), ""),
        6: ("\n".join([*licenses.PLAIN, "Licensed under CC BY-ND 4.0.", "An Apache helicopter, version 2.0."]), ""),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()] * 2, "doc_id long, text string")
    got = Counter((r.doc_id, r.families) for r in licenses.scan(df, model).collect())
    assert got == Counter({(k, f): 2 for k, (_, f) in texts.items()})


def test_license_clues():
    for notice in (n for texts in licenses.NOTICES.values() for n in texts):
        w = licenses._cut(notice)
        pairs = {" ".join(p) for p in zip(w, w[1:], strict=False)}
        assert len(pairs - set(licenses.CLUES)) < licenses.CONTAINED * len(pairs)


def test_licenses_left_out(spark, docs, monkeypatch):
    """A notice of each family that training has not seen is never confirmed as another family."""
    full = licenses.NOTICES
    out = {f: texts[-1] for f, texts in full.items()}
    monkeypatch.setattr(licenses, "NOTICES", {f: texts[:-1] for f, texts in full.items()})
    model = licenses.Model(licenses._training_rows(docs, spark))
    judged = {r.line: r for r in licenses.classify(spark.createDataFrame([(n,) for n in out.values()], "line string"), model).collect()}
    confirmed = {f: judged[n].family for f, n in out.items() if judged[n].confirmed}
    assert confirmed and all(f == family for f, family in confirmed.items())


def test_licenses_wherever_lines_end(spark, docs):
    """Notices inside a line without a stop, or with so few words a line that no clue is near, and names beside common words."""
    model = licenses.Model(licenses._training_rows(docs, spark))
    rng = random.Random(23)
    plain, texts = (lambda n: sentence(rng, n, 5000)), []
    lines = "\n".join(plain(12) for _ in range(4))
    for family, notice in ((f, n) for f, found in licenses.NOTICES.items() for n in found):
        texts.append((f"{plain(300)} {notice.rstrip('.')} {plain(300)}", family))
        w = notice.split()
        for n in (1, 3):
            wrapped = "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
            texts.append((f"{lines}\n{wrapped}\n{lines}", family))
    judged = licenses.classify(spark.createDataFrame([(n,) for found in licenses.NOTICES.values() for n in found], "line string"), model)
    sure = sum(r.confirmed for r in judged.collect())
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.scan(df.union(spark.createDataFrame([(-1, f"{plain(40)} what is the GPL {plain(40)}")])), model).collect()}
    assert got.pop(-1) == ""
    assert all(got[i] in ("", family) for i, (_, family) in enumerate(texts))
    assert sum(map(bool, got.values())) >= 3 * sure


def test_license_predictions_of_all_lines(spark, docs):
    """No line is left unjudged for want of a clue."""
    model = licenses.Model(licenses._training_rows(docs, spark))
    rng = random.Random(24)
    rare = ["GPL: you can use it under the terms of the", "GPL as published by the", "bsd", "cc0 1", "general license", "apache", "MIT", "", "***"]
    lines = [*rare, *(" ".join(rng.sample(sorted({w for t in licenses.NOTICES.values() for n in t for w in licenses._cut(n)}), 4)) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, line string")
    judged = {r.line: r for r in licenses.classify(df.select("line").distinct(), model).collect()}
    assert not any(licenses._cut(x) and judged[x].predicted and not r for x, r in df.select("line", model.likely(licenses.words(F.col("line")))).collect())
    got = licenses.scan(df.withColumnRenamed("line", "text"), model).select("doc_id", "n_predicted", "n_confirmed").collect()
    want = [(i, int(x != "" and judged[x].predicted), int(x != "" and judged[x].confirmed)) for i, x in enumerate(lines)]
    assert [r for r in map(tuple, got) if r not in set(want)] == [] and len(got) == len(want)
    assert sum(n for _, n, _ in want) > sum(n for *_, n in want) > 0


def test_license_reach():
    """A unit that can be confirmed holds a clue, and no line end cuts a notice."""
    for notice in (n for texts in licenses.NOTICES.values() for n in texts):
        w, gap, longest = licenses._cut(notice), 0, 0
        for i, word in enumerate(w):
            gap = 0 if word in licenses.NAME_WORDS or " ".join(w[i : i + 2]) in licenses.CLUES else gap + 1
            longest = max(longest, gap)
        assert longest <= licenses.REACH
    assert all(n in licenses.NAME_WORDS or n in licenses.CLUES for texts in licenses.NAMES.values() for n in texts)


def test_runs_equal_to_looking_at_every_period():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            n, unit = rng.randrange(0, 90), []
            if rng.random() < 0.5:
                unit = [b"%d" % rng.randrange(rng.choice([1, 2, 3])) for _ in range(n)]
            while len(unit) < n:
                unit += [b"%d" % rng.randrange(3) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)
                unit = unit[: len(unit) - rng.randrange(0, 3)]
            texts.append(b" ".join(unit))
        counts, found, left = runs._search(texts)
        for text, n, one, rest in zip(texts, counts, found, left, strict=True):
            words = text.split()
            assert (n, one) == (len(words), brute.periodic_runs(words))
            gone = {i for s, length, q in one for i in range(s + q, s + length)}
            assert rest.split() == [w for i, w in enumerate(words) if i not in gone]


def test_runs_of_small_pair_blocks(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 7)
    text = b"x " + b"a b c " * 40 + b"y " + b"d " * 50
    (_,), (found,), (left,) = runs._search([text])
    assert found == brute.periodic_runs(text.split()) == [(1, 120, 3), (122, 50, 1)]
    assert left == b"x a b c y d"


def test_runs_edges(spark, docs, none):
    rows = docs.withColumn("found", F.lit("clash")).withColumn("rest", F.lit(1)).withColumn("data", F.lit(2))
    got = runs.find_runs(rows).collect()
    assert len(got) == docs.count() and all(r.found.n_words >= 0 for r in got)
    assert {(r.doc_id, r.found.n_words) for r in got if r.doc_id in (0, 1, 2)} == {(0, 0), (1, 0), (2, 0)}
    assert runs.find_runs(none).collect() == []
    same_word = spark.createDataFrame([(1, "la " * 200_000)], "doc_id long, text string")
    (one,) = runs.find_runs(same_word).collect()
    assert [tuple(r) for r in one.found.runs] == [(0, 200_000, 1)] and one.found.collapsed == "la"


def test_runs_are_planted_by_key(spark):
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2) for i in range(40)] + [(None, "a b"), (None, None), (10, ""), (12, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = table.select("doc_id", "text", queries.with_planted_runs(F.col("doc_id"), F.col("text")).alias("out")).collect()
    for r in got:
        assert (r.out or "").encode().split() == brute.damaged_words(r.doc_id, r.text)


def shard_loads(got, shards: int) -> list[int]:
    slots, load = {}, [0] * shards
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


@pytest.mark.parametrize("texts", ["many", "one group", "short and long"])
def test_shards_are_equal_whatever_the_groups(spark, monkeypatch, texts):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 300)
    monkeypatch.setattr(sharding, "SAMPLED", 4)  # rough splitters: ranges have to be subdivided
    rng, rows = random.Random(3), []
    for i in range(6000):
        text = sentence(rng, rng.randrange(1, 12))
        if texts == "one group" and i % 3 == 0:
            text = "the same text"
        if texts == "short and long":
            text = "" if i % 2 else sentence(rng, 900) if i % 500 == 0 else text
        rows.append((i if i % 7 else None, text if i % 11 else None))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_by_bytes(table, 6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len(t or "") + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    load = shard_loads(got, 6)
    assert max(load) - min(load) <= max(2 * sum(load) / 6 / sharding.PARTS, max(r.size for r in got)) + 2
    if texts == "many":
        homes = {}
        for r in got:
            homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        whole, sizes = sum(load) // (6 * sharding.PARTS), Counter()
        for r in got:
            sizes[(r.size, r.text_crc32)] += r.size
        assert all(len(h) == 1 for g, h in homes.items() if sizes[g] <= whole)


def test_shards_are_the_same_for_any_partitions(spark, docs):
    one = sharding.shard_by_bytes(docs.repartition(1), 3).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, sharding.shard_by_bytes(docs.repartition(7), 3).collect()))


def test_shards_edges(spark, docs, none):
    assert sharding.shard_by_bytes(none).collect() == []
    clash = docs.withColumns({"shard": F.lit(1), "key": F.lit(1), "weight": F.lit("w"), "size": F.lit(0)})
    got = sharding.shard_by_bytes(clash, 50).collect()
    assert len(got) == docs.count()
    shard_loads(got, 50)
    alike = spark.createDataFrame([(None, None)] * 500, "doc_id long, text string")
    load = shard_loads(sharding.shard_by_bytes(alike, 7).collect(), 7)
    assert max(load) - min(load) <= 16


def test_places_of_tied_bounds():
    rng = random.Random(1)
    for _ in range(50):
        bounds = sorted({tuple(rng.randrange(3) for _ in range(3)) for _ in range(rng.randrange(0, 12))})
        rows = [tuple(rng.randrange(3) for _ in range(3)) for _ in range(20)]
        got = sharding.places(list(np.array(bounds, "i8").reshape(-1, 3).T), list(np.array(rows, "i8").T))
        assert got.tolist() == [sum(b <= r for b in bounds) for r in rows]


FAULTS = {"blank": repair.UNWANTED, "duplicate": repair.UNWANTED, "truncated": repair.CUT_OFF, "": repair.GOOD}


def kinds_of(marked) -> list[int]:
    return [3 * (repair.INITIALS.index(role[:1]) if role[:1] in ("s", "u", "a") else 3) + FAULTS[fault] for role, _, fault in marked]


def test_crossings_equal_to_the_cheapest_edits():
    rng = random.Random(11)
    for _ in range(1500):
        weights = [rng.random() for _ in range(4)]
        n = rng.randrange(1, 14)
        marked = [(role, f"t{i}", rng.choice(["", "", "", "truncated", "blank"])) for i, role in enumerate(rng.choices(["system", "user", "assistant", "tool"], weights, k=n))]
        cost, audit, _ = brute.cheapest_edits(marked)
        kinds = kinds_of(marked)
        edits = repair.edits_between(kinds, repair.START, None)
        states = repair.row_crossings(kinds)
        closing = "I" * repair.MISSING[states[-1]]
        assert "".join(e for e, _, _ in edits) + closing == audit
        # Cut in chunks anywhere, with summaries in place of rows.
        cuts = sorted({0, n, *[rng.randrange(n + 1) for _ in range(3)]})
        tables = [repair.summary(kinds[a:b]) for a, b in zip(cuts, cuts[1:])]
        borders = [repair.START, *repair.chunk_crossings(tables)]
        parts = [repair.edits_between(kinds[a:b], e, x) for a, b, e, x in zip(cuts, cuts[1:], borders, [*borders[1:-1], None])]
        assert "".join(e for p in parts for e, _, _ in p) + "I" * repair.MISSING[borders[-1]] == audit
        assert sum(t[a][b][0] for t, a, b in zip(tables, borders, borders[1:])) + repair.FINAL[borders[-1]] == cost


TURNS = "conv_id long, turn long, role string, text string"


def made_turns() -> list[tuple]:
    rng = random.Random(2)
    rows = [(1, i, ("user", "assistant")[i % 2], f"Say {i}.") for i in range(400)]
    rows += [(1, rng.randrange(400), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["again.", "cut", " ", None, "wow!\n"])) for _ in range(400)]
    rows += [(None, None, "user", "no key."), (None, 2, "assistant", "still none."), (2, None, "user", "\x0b"), (3, 5, None, None), (4, 1, "user", "end.\u2028")]
    rows += [(5, 0, "system", "only."), (6, 1, "user", "a?"), (6, 1, "user", "a?"), (7, 9, "user", "x" * 100_000 + ".")]
    return rows


@pytest.mark.parametrize("split", [{}, {"floor": 50, "chunk_rows": 60}])
def test_repair_equal_to_plain_code(spark, monkeypatch, split):
    monkeypatch.setattr(repair, "CHUNK", 37)
    rows = made_turns()
    table = spark.createDataFrame(rows, TURNS).repartition(6).withColumns({"pos": F.lit("clash"), "kind": F.lit(1)})
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    every = spark.createDataFrame(rows + [(99, 1, "user", "gone")], TURNS)
    got = repair.repair_digests(table, every, **split).collect()
    assert Counter(map(tuple, got)) == Counter(brute.repaired_conversations(filled, [r[0] for r in rows] + [99]))


def test_planted_faults(spark):
    rows = made_turns()
    got = queries.with_planted_faults(spark.createDataFrame(rows, TURNS)).collect()
    assert Counter(map(tuple, got)) == Counter(brute.damaged_turns(rows))


def test_repair_of_nothing(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert repair.repair_digests(nothing, nothing).collect() == []
