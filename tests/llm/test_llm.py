import hashlib
import json
import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from cliploom.llm import bpe_trie, chat, html_extract, media, minhash, mixing, quality, queries, rans, substring, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", "  \n\t ", "a", "İSTANBUL Σίσυφος ΟΔΟΣ don't I'LL 12345 !!!### ½ Ⅷ", "<|endoftext|>a<|startoftext|> b", "a\x1cb \x85c\xa0d e", "日本語 テスト 🎉🎉👍🏽 a​b﻿c", "x" * 3000,
    "ſ K Å ﬁ ̀abc a\x00b", "<|im_end|>\n<|im_start|>assistant <\\|", "it's we've 's ª²º ñÑ",
]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, repeated lines, junk and odd ones; a source with a third of the rows."""
    rng = random.Random(3)
    vocab = [a + b for a in "th er on an re he in ed nd ha".split() for b in "at en ti es or te of it is al".split()]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(45), say(150).split()
    texts = list(ODD) + [say(rng.randint(1, 300)) for _ in range(60)]
    texts += [f"{say(30)} {passage}\n{say(rng.randint(0, 40))}" for _ in range(12)] + [" ".join(base)] * 5
    for _ in range(40):  # near copies with one to six changed words
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab) + "x"
        texts.append(" ".join(w))
    texts += ["### *** " * 40 + say(80), f"{say(19)}", f"{passage} {passage}", "LOUD " * 3 + say(90).upper(), "line one\n" * 30 + say(60), passage.title()]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[i], None if k % 17 == 0 else "en" if k % 3 else "de", None if k % 19 == 0 else "hot" if k % 3 == 0 else f"s{k % 4}", len(texts[i] or "")) for k, i in enumerate(order)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # columns whose names the operators use inside
    return spark.createDataFrame(corpus, DOCS).repartition(5).withColumns({"c": F.lit("z"), "n": F.lit(1), "token": F.lit(2), "n_words": F.lit(3), "topic": F.lit("t"), "kept": F.lit(True)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality_base_columns(docs, corpus):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for d, text, *_ in corpus:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_columns(text), d
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_verdict(spark, docs, corpus):
    good = [(i, " ".join(f"wort{(i * 31 + k * k) % 977}" for k in range(120)), "en", f"s{i % 2}", 0) for i in range(300)]
    bad = [(1000 + i, " ".join(f"wort{k * k % 977}###" for k in range(120)), "en", "s0", 0) for i in range(60)]
    kept = {r.doc_id for r in quality.keep(spark.createDataFrame(good + bad, DOCS)).collect()}
    assert kept == {x[0] for x in good}
    assert quality.keep(docs).columns == docs.columns
    whole = quality.judge(docs).filter("kept").select("doc_id")
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == sorted(r.doc_id for r in whole.collect())


def test_quality_verdict_by_brute(spark):
    """Groups of several habits, one of them small and one mostly junk: thresholds differ, and the verdict is that of plain Python."""
    rng, rows = random.Random(8), []
    for g, (lang, source, size) in enumerate([("en", "a", 200), ("en", "b", 150), ("en", None, 20), ("de", "a", 180), (None, "b", 60), ("de", "junk", 120)]):
        for _ in range(size):
            n = rng.randint(40, 200)
            words = [rng.choice("xyzuvw") * rng.randint(2 + g % 3, 6 + g) + str(rng.randrange(900)) for _ in range(n)]
            words = [w.capitalize() if rng.random() < 0.05 + 0.03 * g else w for w in words]
            words = [w + rng.choice(".,") if rng.random() < 0.1 + 0.05 * g else w for w in words]
            if source == "junk" and rng.random() < 0.7 or rng.random() < 0.05:
                words = [w + rng.choice(["##", "$$", "%%"]) for w in words]
            if rng.random() < 0.4:
                at = rng.randrange(n - 9)
                words[at : at + 9] = words[at : at + 3] * 3
            text = " ".join(w + "\n" * (k % 11 == 0) for k, w in enumerate(words)) + "\nsame line" * rng.choice([0, 0, 0, 2, 5, 60])
            rows.append((len(rows), text, lang, source, 0))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    want, fences = brute.quality_verdicts(rows, quality)
    assert got == want and 50 < sum(want.values()) < len(rows) - 50
    for m in quality.METRICS:
        assert len({f[m.name] for f in fences.values()}) >= 3, m


def test_quality_odd_tables(spark, none):
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0
    long = " ".join(f"{i:06x}" for i in range(300_000))  # words as long as those of the other texts
    same = " ".join(f"wort{k}" for k in range(100))
    rows = [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, "a b " * 100_000, "en", "s", 0), (3, None, None, None, None), *[(9 + k, same, "fr", "t", 0) for k in range(60)]]
    got = sorted((r.doc_id, r.n_words, r.kept) for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, 300_000, True)] * 2 + [(2, 200_000, False), (3, 0, False)] + [(9 + k, 100, True) for k in range(60)]


def test_sketches_merge(docs):
    f = quality.features(docs)
    parts = quality.sketch(f.filter("doc_id % 2 = 0")).unionByName(quality.sketch(f.filter("doc_id % 2 = 1")))
    one = quality.merge(parts, "lang_key", "source_key")
    key = lambda d: sorted(map(str, d.select("lang_key", "source_key", "metric", "bucket", "n").collect()))
    assert key(one) == key(quality.sketch(f))


def test_media_round_trip(docs, corpus, none):
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    for d, text, *_ in corpus:
        raw = (text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        wave = media.to_wave(full)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert (got[d].media_bytes, got[d].media_sha256) == (len(wave), hashlib.sha256(wave).hexdigest())
        assert media.from_wave(wave) == (full, media.RATE)
    assert media.digests(none).count() == 0


def test_media_features():
    t = np.arange(40_000) / media.RATE
    loud = np.where((t > 0.8) & (t < 1.6), 100 * np.sin(2 * np.pi * 1000 * t), 0)
    samples = (128 + loud).astype(np.uint8).tobytes()
    ts, spans, segments = media.tensors(samples)
    assert ts.shape[1:] == (media.FRAMES, media.MELS) and len(spans) == len(ts) and spans[-1][1] <= len(samples) / media.RATE + 1e-9
    assert len(segments) == 1 and abs(segments[0][0] - 0.8) < 0.06 and abs(segments[0][1] - 1.6) < 0.06
    rate = media.RATE * media.UP // media.DOWN
    hz = np.argmax(np.concatenate(ts)[45:65].mean(0))
    assert abs(hz - np.argmax(media.mel_bank(rate)[int(1000 / rate * media.FRAME)])) <= 1
    long = (samples * 40)[: media.PIECE * 3 + 1000]
    a = np.concatenate([m for m, _ in media.log_mel(long)])
    whole, media.PIECE = media.PIECE, 1 << 30
    try:
        assert np.abs(a - np.concatenate([m for m, _ in media.log_mel(long)])).max() < 1e-3
    finally:
        media.PIECE = whole


def test_resampling():
    """Every phase is used, and the samples are those of the sum over all inputs; a tone stays the same tone."""
    assert media.polyphase().shape == (3, media.TAPS) and len({tuple(b) for b in media.polyphase().tolist()}) == 3
    rng = np.random.default_rng(0)
    for up, down in ((3, 4), (1, 2), (2, 1), (5, 3)):
        x, banks = rng.normal(size=300).astype("f4"), media.polyphase(up, down)
        want = []
        for m in range(-(-len(x) * up // down)):
            at, phase = divmod(m * down, up)
            want.append(sum(banks[phase][k] * x[j] for k in range(media.TAPS) if 0 <= (j := at - media.TAPS // 2 + 1 + k) < len(x)))
        assert np.abs(media.resample(x, up, down) - want).max() < 1e-4
        assert np.abs(media.resample(x, up, down, start=31, count=50) - want[31:81]).max() < 1e-4
    t = np.arange(8000)
    x = np.sin(2 * np.pi * 300 * t / media.RATE).astype("f4")
    y = media.resample(x)
    assert np.abs(y - np.sin(2 * np.pi * 300 * np.arange(len(y)) / 12_000))[100:-100].max() < 0.02


def test_hysteresis():
    """Against a walk over the frames."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        e = np.round(rng.normal(size=rng.integers(1, 40)), 1)
        high, low = np.quantile(e, [media.HIGH, media.LOW_LEVEL])
        want, start = [], None
        for i, v in enumerate([*e, -np.inf]):
            if v > low and start is None:
                start = i
            elif v <= low and start is not None:
                if i - start >= media.LEAST_FRAMES and max(e[start:i]) >= high:
                    want.append((start, i))
                start = None
        assert media.hysteresis(e) == want


def test_stored_tensors(docs, corpus):
    blocks = media.store_features(media.store_media(docs))
    row = blocks.head()
    t = media.from_stream(row.tensors)
    assert isinstance(t.schema.field("log_mel").type, pa.FixedShapeTensorType)
    assert t["log_mel"].to_numpy_ndarray().shape == (t.num_rows, media.FRAMES, media.MELS)
    texts, want, spans = {r[0]: r[1] for r in corpus}, {}, []
    for d, text in texts.items():
        ts, at, segments = media.tensors(media.payload(text)[0])
        want |= {(d, k, *s): v.ravel().tolist() for k, (v, s) in enumerate(zip(ts, at, strict=True))}
        spans += [(d, a, b) for a, b in segments]
    assert {(r.doc_id, r.position, r.start_s, r.end_s): r.log_mel for r in media.audio_tensors(blocks).collect()} == want
    assert sorted(tuple(r) for r in media.audio_segments(blocks).collect()) == sorted(spans)
    rng = random.Random(6)
    assert len(media.tensors(" ".join(rng.choice(["low", "HIGH", "~~~~"]) * rng.randint(1, 9) for _ in range(3000)).encode())[2]) > 5


def test_minhash_components(spark, docs, corpus, none):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.components([r[:2] for r in corpus])
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x[2] for x in got.values())


def test_minhash_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(None, text), (5, text), (5, text), (5, "other words here"), (9, text.upper())], "doc_id long, text string")
    got = sorted(map(str, [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect()]))
    assert got == sorted(map(str, [(None, None, True), (5, 5, True), (5, 5, True), (5, 5, True), (9, 5, False)]))


def test_bpe_equals_library(spark, docs, corpus, none):
    t = bpe_trie.library(bpe_trie.tokenizer_path())
    got = {r.doc_id: r for r in bpe_trie.encode_decode(docs).collect()}
    for d, text, *_ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(next(rans.library_encoder(bpe_trie.tokenizer_path(), "I")([text])), "<u4").tolist() == ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == want, text
    assert bpe_trie.encode_decode(none).count() == 0


def test_bpe_random_words():
    rng, t = random.Random(0), bpe_trie.library(bpe_trie.tokenizer_path())
    bpe = bpe_trie.encoder(bpe_trie.tokenizer_path())
    words = list({"".join(rng.choice("etaoinshrdlu'éß12日") for _ in range(rng.randint(1, 14))) for _ in range(4000)})
    encode = bpe_trie.TextEncoder(bpe.split, bpe.encode_pieces, most=100_000)
    for at in range(0, len(words), 97):
        some = words[at : at + 97]
        for w, packed in zip(some, encode(some), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == t.encode(w, add_special_tokens=False).ids


def test_code_points():
    """Characters of every block between letters, and beside a digit, a mark and a space, as the library has them."""
    t, encode = bpe_trie.library(bpe_trie.tokenizer_path()), bpe_trie.trie_encoder(bpe_trie.tokenizer_path())
    some = [*range(0x3000), *range(0x3000, 0x30000, 23), *range(0xA640, 0xABFF), *range(0x10400, 0x10600), 0x558, 0x1C89, 0xA7CB, *range(0xE0000, 0xE0200, 3), 0x10FFFF]
    texts = [f"a{chr(c)}b 7{chr(c)}!{chr(c)}\u0301 {chr(c)}{chr(c)}Σ" for c in some if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
    assert [np.frombuffer(x, "<u2").tolist() for x in rans.library_encoder(bpe_trie.tokenizer_path(), "H")(texts)] == want


def test_words_leave_python():
    """Python splits only what has special tokens or characters beyond Latin-1; the rest is as the library has it, too."""
    rng, t = random.Random(3), bpe_trie.library(bpe_trie.tokenizer_path())
    some = [*map(chr, range(256)), *"'sst  \n\t" * 9, "<|endoftext|>", "<|endof", "<|ENDOFTEXT|>", "\u0301", "\u3000", "\u2028", "Σ", "İ", "字"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 50))) for _ in range(3000)] + [None, "", " ", "\xa0", "\x85", "a \u0301b", "a\x1cb\x1f"]
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for encode, kind in ((bpe_trie.trie_encoder(bpe_trie.tokenizer_path()), "<u4"), (rans.library_encoder(bpe_trie.tokenizer_path(), "H"), "<u2")):
        assert [np.frombuffer(x, kind).tolist() for x in encode(texts)] == want
        assert list(encode([])) == []

    class Counting(bpe_trie.Splitter):
        seen: list = []

        def __call__(self, text):
            self.seen.append(text)
            return super().__call__(text)

    bpe = bpe_trie.encoder(bpe_trie.tokenizer_path())
    encode = bpe_trie.TextEncoder(Counting(bpe_trie.tokenizer_path()), bpe.encode_pieces)
    texts = ["It's plain, isn't it? Übergröße 12\xa0%", "plain and 字, plain again", "a<|endoftext|>b plain"] * 3
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
    assert sorted(Counting.seen) == ["a<|endoftext|>b", "字,"]  # 9 whole texts, before


def test_special_tokens_with_spaces(tmp_path):
    """A tokenizer file whose special tokens white space would cut: texts are split whole."""
    with open(bpe_trie.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][-1]["content"] = "<|end of text|>"
    (path := tmp_path / "spaced.json").write_text(json.dumps(spec), encoding="utf-8")
    t, texts = bpe_trie.library(str(path)), ["a b<|end of text|>c", "", None, "<|end of text", "plain text", "a b<|end of text|>c"]
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe_trie.trie_encoder(str(path))(texts)] == want


def test_other_tokenizer_files(spark, docs, corpus):
    """op4 refuses files of another kind; op8 encodes texts whole with them."""
    with pytest.raises(ValueError, match="word ends"):
        bpe_trie.encode_decode(docs, "byte_bpe_50k.json")
    t = bpe_trie.library(bpe_trie.tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rans.pack_documents(docs, tokenizer="byte_bpe_50k.json", end_id=70_000).collect()}
    assert got == {d: [*t.encode(x or "", add_special_tokens=False).ids, 70_000] for d, x, *_ in corpus}


def test_html_held_out():
    w, right, total = html_extract.default_weights(), 0, 0
    for page, main in html_extract.labelled_pages(60, seed=77):
        got = set(html_extract.extract(page, w).split())
        right, total = right + len(got & main), total + len(got | main)
    assert right / total > 0.95


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("<article><p>one &amp; <b>tw</b>o&nbsp;three", "one & two three"),
        ("<nav>a b c d e</nav><article><h1>Head line</h1><p>First  part\n here.<div class='ad'>buy this now</div><p>Second part is here.</article><footer>f g</footer>", "Head line First part here. Second part is here."),
        ("<body><script>var a = '<p>no</p>';</script><main><p>Real words stay in place<!-- not this --></p></main><div id=comments><p>so very nice</p></div>", "Real words stay in place"),
    ],
)
def test_html_pages(page, text):
    assert html_extract.extract(page, html_extract.default_weights()) == text


def test_best_region_by_brute():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice([-3, -1, -0.5, 0, 0.5, 2]) for _ in range(rng.randint(0, 25))]
        a, b = html_extract.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_html_deep_and_long():
    """Unclosed elements with names of their own, and closing tags of nothing: time in proportion to the length."""
    w = html_extract.default_weights()
    page = lambda n: "".join(f'<div class="z{i}q"><i>word ' for i in range(n)) + "</span>" * n
    assert html_extract.extract(page(20_000), w).split() == ["word"] * 20_000
    text = " ".join(f"w{i}" for i in range(200_000))
    assert html_extract.extract(f"<nav><a>x</a> y</nav><article><p>{text}</p></article><footer>z</footer>", w) == text


def test_html_table(spark):
    p = spark.createDataFrame([(1, "u", "<p>hello there you</p>"), (1, "u", "<p>hello there you</p>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = [tuple(r) for r in html_extract.extract_pages(p).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "hello there you", 15)] * 2 + [(None, None, "", 0)], key=str)
    assert html_extract.extract_pages(p.limit(0)).count() == 0


def test_mixing(docs, none):
    r = mixing.report(docs).toPandas()
    assert len(r) == docs.count() and ((r.probability >= 0) & (r.probability <= 1)).all() and not r.sampled[r.tokens == 0].any()
    assert abs((r.probability * r.tokens).sum() / r.tokens.sum() - mixing.Mix().share) < 0.02
    kept = mixing.keep(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(r.doc_id[r.sampled])
    assert mixing.report(none).count() == 0 and mixing.keep(none).count() == 0


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([(s, lg, "x", float(w)) for s, lg, w in (("a", "e", 90), ("a", "d", 10), ("b", "e", 20), ("b", "d", 30))], "source_key string, lang_key string, topic string, tokens double")
    c = mixing.rake(cells, mixing.Mix(rounds=30)).toPandas()
    assert (c.w <= c.tokens).all() and abs(c.w.sum() - 90) < 1e-6
    for d in ("source_key", "lang_key"):
        share, target = c.groupby(d).w.sum(), c.groupby(d)[f"t_{d}"].first()
        assert np.allclose(share, target, rtol=1e-6)


def test_targets_of_small_groups(spark):
    """A group that holds less than its share is wanted whole; the others share what it lacks."""
    rows = [(k, "e", "x", float(w)) for k, w in (("a", 1000), ("b", 100), ("c", 4), ("d", 1))]
    cells = spark.createDataFrame(rows, "source_key string, lang_key string, topic string, tokens double")
    t = {r.source_key: r.t_source_key for r in mixing.targets(cells, "source_key", 0.5, mixing.Mix(share=0.6)).collect()}
    held, left = dict((r[0], r[3]) for r in rows), 0.6 * 1105
    full: set[str] = set()
    while True:  # give out shares, take back what a group can't use, and again
        level = (left - sum(held[k] for k in full)) / sum(held[k] ** 0.5 for k in held if k not in full)
        over = {k for k in held if k not in full and level * held[k] ** 0.5 > held[k]}
        if not over:
            break
        full |= over
    want = {k: held[k] if k in full else level * held[k] ** 0.5 for k in held}
    assert full and t.keys() == want.keys() and all(abs(t[k] - want[k]) < 1e-6 for k in t)


def test_margins_meet_targets_of_documents(spark):
    m = mixing.margins(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert ((m.expected - m.target).abs() <= 1e-3 * m.target).all() and (m.target <= m.held * (1 + 1e-9)).all()
    assert np.allclose(m.groupby("dimension").target.sum(), 0.6 * m.groupby("dimension").held.sum())


def test_url_model_on_other_hosts(spark):
    """Hosts of the synthetic pages, none of which is in the labelled table."""
    m, spam = url_filter.default_model(), ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    urls = {r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.url}
    hosts = {u: url_filter.split_url(u)[0] for u in urls}
    common = {"www", "m", "blog", "example", "com", "net", "org", ""}
    trained = {x for u, _ in url_filter.labelled_urls() for x in url_filter.split_url(u)[0].split(".")}
    assert not trained & {x for h in hosts.values() for x in h.split(".")} - common
    blocked = {u for u in urls if m.probability(*url_filter.split_url(u)) > 0.5}
    bad = {u for u, h in hosts.items() if any(s in h for s in spam)}
    assert len(blocked & bad) >= 0.8 * len(bad) and len(blocked - bad) <= 0.01 * len(urls)


def test_url_gradient():
    rng = np.random.default_rng(2)
    at, cols, x, y = np.repeat(np.arange(6), 3), rng.integers(0, 8, 18), rng.normal(size=18), rng.integers(0, 2, 6).astype(float)
    w, b, l2 = rng.normal(size=8), 0.3, 0.01

    def loss(w, b):
        z = np.array([sum(w[c] * v for a, c, v in zip(at, cols, x, strict=True) if a == i) + b for i in range(6)])
        return np.mean(np.log1p(np.exp(z)) - y * z) + l2 / 2 * (w**2).sum()

    gw, gb = url_filter.gradient(w, b, at, cols, x, y, l2)
    step = lambda k: np.eye(8)[k] * 1e-6
    assert np.allclose(gw, [(loss(w + step(k), b) - loss(w - step(k), b)) / 2e-6 for k in range(8)], atol=1e-6)
    assert abs(gb - (loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6) < 1e-6


def test_urls(spark):
    cases = {
        None: ("", "", None), "nothing": ("", "", None), "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/"), "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"),
        "http://x.org": ("x.org", "", None), "http://x.org/": ("x.org", "/", "org/"), "https://y.com/de/": ("y.com", "/de/", "com/de/"), "https://com/fr/?q": ("com", "/fr/", "com/fr/"), "http://xorg/": ("xorg", "/", None), "a://h#f": ("h", "", None),
    }
    d = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("z"))
    got = {r.page_id: r for r in url_filter.judge(d).collect()}
    for i, (host, path, rule) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule or not host:
            assert got[i].verdict == (next(r.verdict for r in url_filter.RULES if r.pattern == rule) if rule else "allow")
    assert url_filter.judge(d.limit(0)).count() == 0
    long = "http://" + "a." * 50_000 + "com/de/" + "x/" * 100_000
    r = url_filter.judge(spark.createDataFrame([(1, long), (1, long)], "page_id long, url string")).collect()
    assert [(len(x.host), len(x.path), x.rule, x.verdict) for x in r] == [(100_003, 200_004, "com/de/", "block")] * 2


def test_rans_blocks():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.2, 1_000_000), 49_000).astype("<u4")
    t = rans.Table.from_counts(np.bincount(ids))
    assert int(t.freq.sum()) == 1 << rans.SCALE_BITS and (t.freq[np.unique(ids)] > 0).all()
    for n in (0, 1, 511, 512, 513, 2047, 2048, 2049, 1_000_000):
        e = rans.encode_block(ids[:n], t)
        assert (rans.decode_block(e, t) == ids[:n]).all()
    assert (np.concatenate([rans.decode_block(e, t, 0, 1), rans.decode_block(e, t, 1, 3), rans.decode_block(e, t, 3)]) == ids).all()
    with pytest.raises(ValueError):
        rans.decode_block(e[:-1] + bytes([e[-1] ^ 1]), t)


def test_token_files(docs, corpus, none):
    t, start = bpe_trie.library(bpe_trie.tokenizer_path()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.pack_documents(docs).collect()}
    for d, text, *_ in sorted(corpus, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rans.pack_documents(none).count() == 0


def test_substring_removals(docs, corpus, none):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digests(docs).collect()}
    assert got == brute.removal_digests([r[:2] for r in corpus])
    assert substring.removal_digests(none).count() == 0
    kept = {r.doc_id: r.text for r in substring.dedup(docs).collect()}
    for d, (words, gone) in brute.removals([r[:2] for r in corpus]).items():
        left = [w for w, g in zip(words, gone, strict=True) if not g]
        assert (d in kept) == (not words or bool(left))
        if d in kept:
            assert (kept[d] or "").encode().split() == left
    assert substring.dedup(docs).columns == docs.columns


def test_substring_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(None, text), (5, text + " tail"), (5, "head " + text)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in substring.removal_digests(d).collect()) == [(30, 0), (31, 30), (31, 30)]


def test_chat(spark, none):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "\n\n日本🎉 <\\|y é"), (1, 2, "assistant", None), (2, 0, "a\\n\nb", "<"), (2, 1, "assistant", "|>ok<"), (2, 1, "assistant", "|>ok<"), (3, 0, None, ""), (4, 0, "assistant", "x" * 5000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).repartition(3)
    for limit in (chat.SEGMENT_CHARS, 10):
        got = {r.conv_id: r for r in chat.read_back(chat.format_segments(chat.with_probe(d), segment_chars=limit)).collect()}
        want = brute.conversation_digests([*rows, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")])
        assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert chat.read_back(chat.format_segments(d.limit(0))).count() == 0


@pytest.mark.parametrize("keep", [quality.keep, minhash.dedup, substring.dedup, mixing.keep])
def test_columns_of_any_name(spark, corpus, keep):
    """Stages of the pipeline leave other columns as they are, whatever their names."""
    odd = ["_k", "_m", "a.b", "tokens", "c", "_s0", "_m0", "_gone", "lang_key"]
    d = spark.createDataFrame([(*r, *[f"{r[0]}{c}" for c in odd]) for r in corpus], f"{DOCS}, " + ", ".join(f"`{c}` string" for c in odd))
    got = keep(d)
    assert got.columns == d.columns
    rows = got.collect()
    if keep in (quality.keep, substring.dedup):  # the quicker ones
        assert {r.doc_id for r in rows} == {r.doc_id for r in keep(spark.createDataFrame(corpus, DOCS)).collect()}
    assert rows and all(tuple(r)[5:] == tuple(f"{r.doc_id}{c}" for c in odd) for r in rows)


def test_substring_without_ids(spark):
    """Rows without an id come first, in the order of a hash; equal ones aren't compared, short texts are never copies."""
    text, other = (" ".join(f"{x}{i}" for i in range(30)) for x in "wv")
    d = spark.createDataFrame([(None, text), (None, text), (None, f"{text} {other}"), (3, text), (3, ""), (4, ""), (5, None)], "doc_id long, text string")
    got = sorted(((r.n_words, r.n_removed) for r in substring.removal_digests(d).collect()))
    assert got in ([(0, 0)] * 3 + [(30, 0), (30, 0), (30, 30), (60, 30)], [(0, 0)] * 3 + [(30, 30)] * 3 + [(60, 0)])


def test_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark, docs, corpus, tmp_path):
    import corpus_pipeline as p

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in p.run(spark, str(tmp_path)).collect()}
    kept = {r.doc_id for r in quality.judge(plain).filter("kept").collect()}
    rows = [r[:2] for r in corpus if r[0] in kept]
    parts = brute.components(rows, p.NEAR_PERCENT)
    rows = [r for r in rows if parts[r[0]][2]]
    cut = {d: b" ".join(w for w, g in zip(words, gone, strict=True) if not g) for d, (words, gone) in brute.removals(rows).items()}
    meta = {r[0]: r for r in corpus}
    left = [(d, t.decode(), meta[d][2], meta[d][3], len(t)) for d, t in cut.items() if t]
    mixed = {r.doc_id for r in mixing.keep(spark.createDataFrame(left, DOCS)).collect()}
    assert set(got) == mixed
    t = bpe_trie.library(bpe_trie.tokenizer_path())
    assert all(got[d].n_tokens == len(t.encode(cut[d].decode(), add_special_tokens=False).ids) for d in got)
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None
