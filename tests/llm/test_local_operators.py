"""Operators that work row by row or task by task: media, packing, language ID, extraction, URLs, WARC."""

from __future__ import annotations

import base64
import email
import gzip
import hashlib
import html.parser
import io
import itertools
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from tidewarden.llm import extract, langid, media, packing, queries, urls, warc

LONG = "wörd and æther " * 40_000
EDGE = [(1, "plain text here", "en", "a"), (2, None, None, None), (3, "", "de", "a"), (4, LONG, "en", None), (5, "plain text here", "en", "a"), (5, "plain text here", "en", "a"), (None, "no id", "fr", "b"), (7, "!!! 12", "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


def edge(spark):
    """Documents with nulls, repeats, an empty and a long text, and columns whose names operators use themselves."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    for k, name in enumerate(("id", "size", "media", "ids", "score", "lang_pred", "kept", "host", "target", "start", "n", "sig", "part", "level", "chance", "_id")):
        df = df.selectExpr("*", f"{k} AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -------------------------------------------------------------------------- media


@pytest.mark.parametrize("samples", [b"\x01" * 192, bytes(range(192)) * 5])
def test_media_round_trip(samples):
    for write in (media.encode_netpbm, media.encode_bmp):
        assert media.decode(write(samples, 64)).tobytes() == samples


def test_decoders_read_all_kinds():
    grey = np.arange(6).reshape(2, 3)
    text = b"P2\n# remark\n3 2\n5\n" + b" ".join(str(x).encode() for x in grey.ravel())
    assert (media.decode(text)[:, :, 0] == (grey * 255 + 2) // 5).all()
    assert media.decode(b"P5 3 2 255\n" + bytes(range(6)))[1, 2, 1] == 5
    assert media.decode(b"P1 2 2\n1 0\n0 1")[:, :, 0].tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4 3 1\n\xa0")[0, :, 0].tolist() == [0, 255, 0]
    assert media.decode(b"P3 1 1 255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6 1 1 65535\n" + (128 * 257).to_bytes(2, "big") * 3)[0, 0, 0] == 128
    bmp = media.encode_bmp(bytes([1, 2, 3, 4, 5, 6]), 1)
    assert media.decode(bmp).tolist() == [[[1, 2, 3]], [[4, 5, 6]]]


def bit_fields(depth: int, masks: tuple, pixel: int) -> bytes:
    return b"BM" + struct.pack("<IHHIIiiHHIIiiIIIII", 70, 0, 0, 66, 40, 1, -1, 1, depth, 3, 4, 0, 0, 0, 0, *masks) + pixel.to_bytes(4, "little")


def test_bmp_masks_say_where_colours_lie():
    assert media.decode(bit_fields(32, (0xFF, 0xFF00, 0xFF0000), 0x030201)).tolist() == [[[1, 2, 3]]]
    assert media.decode(bit_fields(32, (0xFF0000, 0xFF00, 0xFF), 0x030201)).tolist() == [[[3, 2, 1]]]
    assert media.decode(bit_fields(16, (0xF800, 0x7E0, 0x1F), 0xF800)).tolist() == [[[255, 0, 0]]]
    assert media.decode(bit_fields(16, (0, 0x7E0, 0x1F), 0xFFFF)).tolist() == [[[0, 255, 255]]]


BROKEN = [None, b"", b"rubbish", b"BM", b"P9 1 1 1 ", b"P6 2 2 255\n12", b"P6\n99999999999999999999 1\n255\n", b"P2 1 1 255\n99999999999999999999", b"P3 1 1 255\n300 1 1", b"P5 1 1 9\n\xff", b"P2 1 1 255\n-1", b"P5 3 3 70000\n", bit_fields(24, (1, 2, 3), 0), bit_fields(32, (1, 2, 3), 0)[:60]]


def test_broken_media_give_null(spark):
    df = spark.createDataFrame(list(enumerate(BROKEN)), "doc_id long, media binary")
    out = media.media_features(df, ["doc_id"]).collect()
    assert len(out) == len(BROKEN) and all(r.dhash is r.samples is r.width is None for r in out)


def test_media_query_against_plain_code(spark, tiny):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    out = queries.op1_media(spark, tiny).collect()
    assert len(out) == len(docs)

    def bits(image, rows, cols, axis):
        fine = np.repeat(np.repeat(image.astype(float), rows, 0), cols, 1)
        grey = np.rint(fine.reshape(rows, len(image), cols, 64, 3).mean(axis=(1, 3)) @ [0.299, 0.587, 0.114] * 256)
        return "".join("01"[int(x)] for x in (np.diff(grey, axis=axis) > 0).ravel())

    for r in out:
        raw = docs[r.doc_id].encode()
        size = max(192, -(-len(raw) // 192) * 192)
        payload = raw + b" " * (size - len(raw))
        high = size // 192
        if high % 2:
            stored = f"P6\n64 {high}\n255\n".encode() + payload
        else:
            stored = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + size, 0, 0, 54, 40, 64, -high, 1, 24, 0, size, 2835, 2835, 0, 0) + bytes(payload[k + 2 - 2 * (k % 3)] for k in range(size))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), size, hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        image = np.frombuffer(payload, np.uint8).reshape(high, 64, 3)
        want = bits(image, 8, 9, 1) + bits(image, 9, 8, 0)
        assert sum(a != b for a, b in zip(want, f"{int(r.feature, 16):0128b}", strict=True)) <= 1  # one tie may round either way


@pytest.mark.parametrize("shape", [(1, 64), (5, 7), (100, 64), (16, 16)])
def test_resize_is_the_mean_over_cell_areas(shape):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (*shape, 3), dtype=np.uint8)
    rows, cols = 4, 8
    # brute force: each pixel repeated until the cells fall on whole pixels
    fine = np.repeat(np.repeat(image.astype(float), rows, 0), cols, 1)
    want = fine.reshape(rows, shape[0], cols, shape[1], 3).mean(axis=(1, 3))
    assert np.allclose(media.resize(media.Integral(image, (rows,)), rows, cols), want)
    assert np.load(io.BytesIO(media.npy(image))).tolist() == image.tolist()


def test_media_query_edges(spark):
    out = media.media_features(media.text_media(edge(spark)), ["doc_id", "n_bytes"]).collect()
    assert len(out) == len(EDGE)
    want = {}
    for doc, text, *_ in EDGE:
        raw = (text or "").encode()
        want[doc] = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
    for r in out:
        assert bytes(r.samples) == want[r.doc_id]
        assert np.load(io.BytesIO(bytes(r.tile_npy))).shape == (16, 16, 3)
        assert media.decode(bytes(r.media)).tobytes() == want[r.doc_id]
    assert media.media_features(media.text_media(empty(spark)), ["doc_id"]).count() == 0


# ------------------------------------------------------------------------ packing


def test_best_fill_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        items = rng.integers(1, 12, rng.integers(1, 7)).tolist()
        room = int(rng.integers(1, 30))
        sums = {sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
        lengths = {x: items.count(x) for x in items}
        got = packing.best_fill(lengths, room)
        assert all(got[k] <= lengths[k] for k in got)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def check_packing(out: pd.DataFrame, ids: dict, capacity: int) -> None:
    for r in out.itertuples():
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole)
        assert zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    sizes = out.groupby("sequence_id").length.sum()
    assert sizes.max() <= capacity
    assert all(n & (n - 1) == 0 for n in sizes)
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_packing_query(spark, tiny):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in zip(docs.doc_id, docs.text, strict=True)}
    out = queries.op2_packing(spark, tiny).toPandas()
    check_packing(out, ids, 2048)
    assert (out.groupby("doc_id").length.sum() == pd.Series({k: len(v) for k, v in ids.items()})).all()


def test_packing_edges(spark):
    path = queries.tokenizer_path()
    out = packing.pack(edge(spark), path).toPandas()
    assert out[out.doc_id == 2].doc_tokens.tolist() == [1]
    assert len(out[out.doc_id == 5]) == 2
    assert out[out.doc_id == 4].length.sum() == out[out.doc_id == 4].doc_tokens.iloc[0]
    assert packing.pack(empty(spark), path).count() == 0


def test_word_ids_are_those_of_the_text():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, words = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["It's a DON'T\tday x", "Ünï café 日本語 ½ 12", "a <|endoftext|> b<|startoftext|>c", "x\x1cy \x0b z w", LONG[:500], "ΟΔΟΣ Ÿ ß×÷ ÀÉÿ12!!a_b", "e\u0301 \u212b \ufb01 \x7f"]
    letters = [*"aAzÉéßÿ×÷ÞðµªŁ019 !?.,;_-'<|>~\t\n", "'s", "<|", "...", "%%%", "…", "日", "\u0301"]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(letters, 30)) for _ in range(2000)]
    texts += ["".join(rng.choice(letters[:12], 12)) for _ in range(500)]
    for text in texts:
        assert list(np.frombuffer(words(text), "<u4")) == t.encode(text, add_special_tokens=False).ids, repr(text)


# -------------------------------------------------------------------- language ID


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    out = queries.op3_langid(spark, sf).toPandas().set_index("doc_id")
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.index]
    tested = out[out.held_out]
    assert (tested.lang_pred == truth.loc[tested.index]).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_edges(spark):
    df = edge(spark)
    model = langid.fit(df.where("lang IS NOT NULL"))
    rows = langid.identify(df, model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert got[2] == got[3] == got[7] == ("und", 0.0)
    assert got[1][0] == "en"
    none = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_filter_has_no_false_negatives_and_many_languages():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 62, 5000, dtype=np.uint64)
    owners = rng.integers(0, 90, 5000)
    f = langid.Filter.build([f"l{i}" for i in range(90)], "l0", codes, owners)
    mask = None
    for at in f.places(codes, len(f.slots)):
        mask = f.slots[at] if mask is None else mask & f.slots[at]
    assert all(mask[i, o // 64] >> np.uint64(o % 64) & np.uint64(1) for i, o in enumerate(owners))
    assert f.false_rate().max() < 0.01


def test_predictions_by_plain_sets(spark, tiny):
    """The filter's answers against sets of n-grams: all that a language knows is found, and the measured rate of the rest is the one that is taken off."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    texts = [r.text or "" for r in docs.collect()]
    every = np.unique(np.concatenate([code for code, _ in langid.grams(texts)]))
    masks = None
    for at in model.places(every, len(model.slots)):
        masks = model.slots[at] if masks is None else masks & model.slots[at]
    rng = np.random.default_rng(3)
    strange = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    odd = None
    for at in model.places(strange, len(model.slots)):
        odd = model.slots[at] if odd is None else odd & model.slots[at]
    known = []
    for i in range(len(model.langs)):
        bit = np.uint64(1) << np.uint64(i)
        known.append(set(every[(masks[:, 0] & bit) > 0].tolist()))
        assert abs(float(((odd[:, 0] & bit) > 0).mean()) - model.false_rate()[i]) < 0.002
    names, scores = model.predict(texts)
    rate = model.false_rate()
    for text, name, score in zip(texts, names, scores, strict=True):
        own = [c for code, _ in langid.grams([text]) for c in code.tolist()]
        real = [max(0.0, (sum(c in k for c in own) - len(own) * r) / (1 - r)) for k, r in zip(known, rate, strict=True)]
        if not own:
            assert (name, score) == ("und", 0.0)
        elif sum(real):
            assert name == model.langs[int(np.argmax(real))] and abs(score - max(real) / sum(real)) < 1e-9


def test_long_texts_are_read_in_pieces():
    texts = ["Ein Wort, noch1ein_Wort und ein weiteres " * 30, "", "x" * 500, "kurz " * 3]
    whole = [sorted(c for code, owner in langid.grams(texts) for c, o in zip(code.tolist(), owner.tolist(), strict=True) if o == k) for k in range(len(texts))]
    found = [[] for _ in texts]
    for owners, pieces in langid.chunks(texts, 100):
        for code, owner in langid.grams(pieces):
            for c, o in zip(code.tolist(), owners[owner].tolist(), strict=True):
                found[o].append(c)
    assert [sorted(f) for f in found] == whole


def test_grams_stop_at_words_and_texts():
    (three, owner), (four, _) = langid.grams(["ab c", "ab"])
    # " ab", "ab ", " c " and " ab", "ab "
    assert owner.tolist() == [0, 0, 0, 1, 1]
    assert three[0] == three[3] and three[1] == three[4]
    assert len(four) == 2 and four[0] == four[1]


# --------------------------------------------------------------------- extraction

PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- x <p>no</p> -->
<div class="ad">buy</div><main><article><h1>Head &amp; more</h1><p>One&nbsp;two
 three <b>bold</b><i>it</i>.<br>next<p>Second &lt;b&gt; &#233;<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<form><input><button>go</button></form><aside>side</aside><div id="comments"><p>first!</p></div></article></main><footer>&copy; me</footer>"""


def test_extract_blocks():
    assert extract.alone(PAGE) == "Head & more\n\nOne two three boldit. next\n\nSecond <b> é\n\na\n\nb\n\nc\n\nd"
    assert extract.alone("<p>bare") == "bare"
    assert extract.alone(None) == extract.alone("") == extract.alone("<br><!-- -->") == ""


def test_layouts_around_an_article_are_no_marks():
    page = """<form id="f"><div class="with-sidebar nav"><article class="post"><header class="x"><h1>Head</h1></header><div class="article-header"><h2>Sub</h2></div>
      <p>Text</p><div class="sidebar"><p>s</p></div></article><section class="reader-comments"><article><p>me too</p></article></section></div></form>"""
    assert extract.alone(page) == "Head\n\nSub\n\nText"


@pytest.mark.parametrize("page", [
    '<body><div style="overflow: hidden"><article><p>Text</p></article></div>', '<body><div title="Hidden Figures"><p>Text</p></div>', "<body><div data-role='navigation' data-hidden=hidden><p>Text</p></div>",
    '<body class="no-comments"><p>Text</p>', '<body><div class="no-sidebar"><p>Text</p></div>', '<body><div class="has-no-comments"><article><p>Text</p></article></div>',
    '<article><section id="social-history"><p>Text</p></section></article>', '<article><section id="related"><p>Text</p></section></article>', '<article><h2 id="related-work">Text</h2></article>', '<article><p class="notice">Text</p></article>',
    '<article><p>Text</p><div class="sidebar-left" hidden>no</div><div class="site-footer">no</div><div id="comments">no</div></article>', '<div class="my-related"><a href="/">no</a></div><p>Text</p>', '<div role=navigation>no</div><p hidden>no<p>Text',
])
def test_only_marked_parts_are_left_out(page):
    assert extract.alone(page) == "Text"


@pytest.mark.parametrize("bad", ["<a " * 20_000, '<a "' * 20_000, "<script>" * 10_000, "<title>" * 10_000, "<p" * 20_000, "<!--" * 20_000, "<div>" * 10_000, "&" * 50_000])
def test_broken_pages_take_linear_time(bad):
    import time

    start = time.perf_counter()
    extract.alone(bad)
    warc.derivatives(warc.respond("http://h/", bad, "d"))
    assert time.perf_counter() - start < 5


def test_simple_tree_matching_by_brute_force():
    def brute(x, y):
        best = 0
        for k in range(min(len(x.children), len(y.children)) + 1):
            for left in itertools.combinations(x.children, k):
                for right in itertools.combinations(y.children, k):
                    each = [brute(p, q) for p, q in zip(left, right, strict=True)]
                    if all(each):
                        best = max(best, sum(each))
        return extract.alike(x, y) and best + extract.alike(x, y)

    pages = ["<div><p>x</p><ul><li>1</ul><section><div>a</div></section></div>", "<div class=a><ul><li>1</li></ul><div><p>y</div><section><div>b</div><div class=b>c</div></section></div>", "<section>a</section><div><div>x</div><ul></ul></div><footer>f</footer>"]
    trees = [extract.tree(extract.outline(p).shape) for p in pages]
    for a, b in itertools.product(trees, trees):
        pairs = list(extract.aligned(a, b))
        assert extract.match(a, b, {}) == brute(a, b) == sum(extract.alike(x, y) for x, y in pairs)
        assert len({x.number for x, _ in pairs}) == len({y.number for _, y in pairs}) == len(pairs)


def test_long_lists_are_aligned_from_both_ends(monkeypatch):
    shapes = [extract.outline("<body>" + "<div>x</div>" * n + "<section><p>s</p></section>" + "<div>y</div>" * 3).shape for n in (30, 40)]
    monkeypatch.setattr(extract, "MOST_CELLS", 100)
    to = extract.align.__wrapped__(*shapes)
    section = [s.split("\n").index(next(x for x in s.split("\n") if " section " in x)) for s in shapes]
    assert to[section[0]] == section[1] and to[-1] == shapes[1].count("\n")


def stripped(page: str) -> str:
    """The page without what names tell: every container is a bare div."""
    return re.sub(r"<(/?)(?:article|main|nav|footer|header|aside|section|div)\b[^>]*>", r"<\1div>", page)


def test_alignment_alone_finds_the_articles(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet").toPandas()
    bare = spark.createDataFrame(pages.assign(html=pages.html.map(stripped)))
    want = {r.page_id: r.text for r in queries.op6_extract(spark, tiny).collect()}
    assert {r.page_id: r.text for r in extract.main_text(bare).collect()} == want
    off = {r.page_id: r.text for r in extract.main_text(spark.read.parquet(f"{tiny}/pages.parquet"), wrappers=False).collect()}
    assert all(want[k] in off[k] and len(off[k]) > len(want[k]) for k in want)


def test_parts_come_and_go_between_pages(spark):
    """Bare divs; every other page has an advert, every third a list of links, one a footer less."""

    def page(i):
        menu = "<div><ul>" + "".join(f"<li><a href='/{k}'>menu {(i + k) % 4}</a>" for k in range(3)) + "</ul></div>"
        ad = f"<div>Buy thing {i % 3} now</div>" if i % 2 else ""
        more = f"<div><a href='/x'>More {i % 2}</a> <a href='/y'>And more</a></div>" if i % 3 == 0 else ""
        foot = "" if i == 4 else f"<div>Imprint, printed {i % 5}</div>"
        return f"<body>{menu}{ad}<div><h1>Head {i}</h1><p>{f'Word{i} ' * 30}</p>{more}<div><p>{f'Deep{i} ' * 20}</p></div></div>{foot}</body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)]
    out = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Head {i}\n\n{f'Word{i} ' * 30}".strip() + "\n\n" + f"Deep{i} ".__mul__(20).strip() for i in range(20)}


def test_names_settle_what_alignment_leaves_open(spark):
    """Comments vary as the article does, and are longer."""

    def page(i):
        return f"<body><div class='post'><p>{f'Word{i} ' * 30}</p><div class='comments'><p>{f'reply{i} ' * 300}</p></div></div><div id='sidebar'>{f'side{i} ' * 10}</div></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    out = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Word{i} ".__mul__(30).strip() for i in range(6)}


@pytest.mark.parametrize(("part", "text"), [
    ("<p>Let <math><mi>x</mi></math> be", "Let x be"), ("<p>See <object>the object</object>, <canvas>the canvas</canvas> and <map>the map</map>", "See the object, the canvas and the map"),
    ("<header><h3>Title</h3></header><p>x", "Title\n\nx"), ("<div class='section-header'><h3>Part two</h3></div><p>x", "Part two\n\nx"),
    ("<p class='ad-hoc'>one<p class='social-history'>two", "one\n\ntwo"), ("<p title=don't>one</p><p title=\"a>b\">two", "one\n\ntwo"), ("<p title='x>y' data-a=\"it's\">one</p>", "one"),
])
def test_article_text_is_whole(part, text):
    assert extract.alone(f"<body><nav><a href='/'>menu</a></nav><article>{part}</article><footer>foot</footer>") == text
    assert warc.plain(f"<p>{part}").replace("\n", " ") == text.replace("\n\n", " ")


def test_wrapper_drops_what_all_pages_share(spark):
    def page(i):
        return f"<html><body><div><p>Welcome to our site</p><div><h2>Title {i}</h2><p>Body text number {i} with words</p></div><p>All rights reserved</p></div></body></html>"

    rows = [(i, "http://h.example/%d" % i, page(i)) for i in range(8)] + [(9, "http://other.example/", page(9)), (10, None, None), (10, None, None), (11, "http://h.example/x", "")]
    out = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS template", "3 AS content", "4 AS n")).collect()}
    assert out[3] == "Title 3\n\nBody text number 3 with words"
    assert out[9].startswith("Welcome")
    assert out[10] == out[11] == ""


def test_copies_are_not_template(spark):
    rows = [(i, "http://h.example/", f"<body><article><p>Same text</p><p>n {i}</p></article></body>") for i in range(6)]
    out = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Same text" in r.text or r.text.startswith("n ") for r in out)
    assert extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_is_found_on_every_kind_of_host(spark):
    def page(host, i, foot, extra="", kind="a"):
        return (f"http://{host}/{i}", f"<html><body><div class='{kind}'><h2>Title {i} of {host}</h2><p>Body text number {i} with words enough to be an article of its own</p>{extra}<p>{foot}</p></div></body></html>")

    rows = [page("two", i, "All rights reserved") for i in range(2)]
    rows += [page("copies", 0, "All rights reserved")] * 30 + [page("copies", i, "All rights reserved") for i in (1, 2)]
    rows += [page("long", i, "All rights reserved", "".join(f"<p>{i} {k}</p>" for k in range(2000))) for i in range(4)]
    rows += [page("mixed", i, "Foot of one") for i in range(40)] + [page("mixed", i, "Foot of another", kind="b") for i in range(40, 44)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    out = extract.main_text(df).toPandas()
    assert len(out) == len(rows) and out.text.str.contains("Body text").all()
    assert not out.text.str.contains("All rights|Foot of").any()


def test_template_goes_from_short_articles_and_copies_stay(spark):
    legal = "".join(f"<p>Line {k} of the legal text that stands below every article of this site</p>" for k in range(5))
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Article {i}</p>{legal}</div></body>") for i in range(6)]
    rows += [(k, f"http://copy.example/{k}", f"<body><!-- {k} --><div><p>One article</p>{legal}</div></body>") for k in range(6, 9)]
    out = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(6)] == [f"Article {i}" for i in range(6)]
    assert all(out[k].startswith("One article") and out[k].count("legal") == 5 for k in range(6, 9))


def test_extract_query_gives_the_articles(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet").toPandas().set_index("page_id")
    out = queries.op6_extract(spark, tiny).toPandas()
    assert len(out) == len(pages)
    for r in out.itertuples():
        inner = re.sub("</?b>", "", re.search(r"<article>(.*?)</article>", pages.html[r.page_id], re.S)[1]).replace("<br>", " ")
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert r.text == "\n\n".join(w for w in want if w)
        assert r.n_chars == len(r.text)


# --------------------------------------------------------------------------- URLs


def test_hosts_paths_and_rules(spark):
    judge = urls.Judge(queries.RULES)
    rows = ["http://A.Example.COM/en/7?x#y", "https://b.com/en/", "x.net/de/1", "http://example.net/de/8", "http://u.example.net/de/9#/", "ftp://org/es/", "http://notorg/es/", None, "", "http://", "http://h?casino", "http://casinos.example/", "http://free.bets-online.example/", "http://free.free.example/"]
    out = urls.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string").selectExpr("*", "1 AS host"), judge).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in out[:5]] == [("a.example.com", "/en/7"), ("b.com", "/en/"), ("", ""), ("example.net", "/de/8"), ("u.example.net", "/de/9")]
    assert [r.rule for r in out[:7]] == ["example.com/en/7", "com/en/", None, "example.net/de/8", "net/de/", "org/es/", None]
    assert [r.verdict for r in out] == ["allow", "block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "block", "allow", "block", "allow"]


def test_terms_against_a_plain_search():
    judge = urls.Judge((), strict=("bad", "bad-word"), soft=("a", "ab", "x.y"), soft_limit=2)
    rng = np.random.default_rng(2)
    for _ in range(300):
        url = "".join(rng.choice(list("abdx.y-orw/"), 14))
        hit = lambda t: len([m for m in re.finditer(f"(?=(?<![^\\W_]){re.escape(t)}(?![^\\W_]))", url)])  # noqa: B023, E731
        assert judge.terms(url) == (hit("bad") + hit("bad-word"), sum(bool(hit(t)) for t in judge.soft))


# --------------------------------------------------------------------------- WARC


def test_warc_records_link_and_round_trip(spark):
    rows = [(1, "http://h/1", "<html><title>T&amp;x</title><script>no</script><p>Hé <b>b</b><p>two<a href='x'>l</a></html>"), (2, None, None), (3, "http://h/3", ""), (1, "http://h/1", "<html><title>T&amp;x</title><script>no</script><p>Hé <b>b</b><p>two<a href='x'>l</a></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record", "2 AS block")
    made = warc.responses(df)
    sources = {r.page_id: bytes(r.record) for r in made.collect()}
    out = warc.derive(made).collect()
    assert len(out) == 8
    for r in out:
        fields, block = warc.parse(bytes(r.record))
        head, body = warc.parse(sources[r.page_id])
        assert fields["warc-type"] == r.record_type and block == bytes(r.block)
        assert fields["warc-refers-to"] == head["warc-record-id"] == r.refers_to
        assert fields["warc-block-digest"] == warc.digest(block) and r.digest_ok
        assert fields["warc-target-uri"] == head["warc-target-uri"] and fields["warc-date"] == head["warc-date"]
        assert r.source_payload_digest == warc.digest(body.partition(b"\r\n\r\n")[2])
    conversion = next(bytes(r.block).decode() for r in out if r.page_id == 1 and r.record_type == "conversion")
    assert conversion == "Hé b\ntwol"
    meta = next(bytes(r.block).decode() for r in out if r.page_id == 1 and r.record_type == "metadata")
    assert "title: T&x\r\n" in meta and "links: 1\r\n" in meta and "source-header-content-type: text/html; charset=utf-8\r\n" in meta
    bad = spark.createDataFrame([(1, b"rubbish"), (2, None), (3, sources[1][:60]), (4, warc.record("request", [], b""))], "page_id long, record binary")
    assert [r.problem for r in warc.derive(bad).orderBy("page_id").collect()] == ["no WARC record", "no WARC record", "no WARC record", "not a response"]
    assert warc.derive(bad.limit(0)).count() == 0


def response(url: str, head: bytes, body: bytes, **more: str) -> bytes:
    return warc.record("response", [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", url), ("WARC-Date", "d"), *((k.replace("_", "-"), v) for k, v in more.items())], head + b"\r\n\r\n" + body)


def both(data: bytes) -> tuple[str, str, list]:
    """Text, metadata and the rows."""
    rows = warc.derivatives(data)
    assert [r[0] for r in rows] == ["metadata", "conversion"]
    blocks = [bytes(r[warc.NAMES.index("block")]) for r in rows]
    return blocks[1].decode(), blocks[0].decode("utf-8", "surrogateescape"), rows


@pytest.mark.parametrize("charset", ["idna", "undefined", "punycode", "nothing", "hex", "utf-16", "latin-1"])
def test_warc_reads_any_charset(charset):
    text, _, _ = both(response("http://h/", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}".encode(), "<p>Hé".encode()))
    assert charset in ("punycode", "utf-16", "latin-1") or text == "Hé"


@pytest.mark.parametrize(("status", "code"), [("HTTP/1.1 99999999999 x", None), ("HTTP/1.1 404", 404), ("HTTP/1.1 ٤٠٤ x", None), ("rubbish", None), ("HTTP/2 200 OK", 200), ("", None)])
def test_warc_status(status, code):
    assert both(response("http://h/", status.encode(), b"x"))[2][0][warc.NAMES.index("http_status")] == code


def test_warc_line_ends_add_no_header():
    for url in ("http://a/\r\n\r\nx", "http://a/\r\nContent-Length: 3", "http://a/\nWARC-Type: x"):
        text, meta, rows = both(warc.respond(url, "<p>text", "d"))
        assert text == "text" and meta.startswith("source-status: HTTP/1.1 200 OK\r\n")
        for r in rows:
            fields, block = warc.parse(bytes(r[warc.NAMES.index("record")]))
            assert fields["warc-target-uri"] == url.replace("\r", "%0D").replace("\n", "%0A") and fields["warc-type"] == r[0]
            assert block == r[warc.NAMES.index("block")]


def test_warc_keeps_repeated_and_odd_headers():
    _, meta, rows = both(response("http://h/", b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nVia: x,\r\n  y\r\nSet-Cookie: b=\xff\r\nContent-Type: text/\xff", b"x"))
    assert "source-header-set-cookie: a=1\r\nsource-header-via: x, y\r\nsource-header-set-cookie: b=\udcff\r\n" in meta
    assert rows[0][warc.NAMES.index("source_content_type")] == "text/?"


def test_warc_undoes_transfer_and_content_encodings():
    page = "".join(f"<p>Hé ho {k * k}" for k in range(300)).encode()
    bare = zlib.compressobj(wbits=-15)
    kinds = [("gzip", gzip.compress(page)), ("gzip", gzip.compress(page[:200]) + gzip.compress(page[200:])), ("deflate", zlib.compress(page)), ("deflate", bare.compress(page) + bare.flush()), ("identity", page), ("gzip, deflate", zlib.compress(gzip.compress(page)))]
    for name, packed in kinds:
        chunks = b"".join(b"%x;q=1\r\n%s\r\n" % (len(c), c) for c in (packed[:7], packed[7:])) + b"0\r\n\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: {name}".encode()
        for body, more in ((packed, b""), (chunks, b"\r\nTransfer-Encoding: chunked")):
            text, _, rows = both(response("http://h/", head + more, body, WARC_Payload_Digest=warc.digest(packed)))
            assert text == warc.plain(page.decode()) and rows[0][warc.NAMES.index("digest_ok")] is True
    text, meta, _ = both(response("http://h/", b"HTTP/1.1 200 OK\r\nContent-Encoding: br", b"\x8b\x00"))
    assert text == "" and "content-encoding: unread\r\n" in meta
    assert both(response("http://h/", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip", gzip.compress(page)[:-30]))[0].startswith("Hé ho")
    assert both(response("http://h/", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked", b"no chunk"))[0] == "no chunk"


def test_warc_digests_by_their_own_algorithm():
    at = warc.NAMES.index("digest_ok")
    for value, ok in (("sha256:" + hashlib.sha256(b"x").hexdigest(), True), ("md5:" + hashlib.md5(b"x").hexdigest().upper(), True), ("sha1:AAAA", False), ("crc:1", None)):
        assert both(response("http://h/", b"HTTP/1.1 200 OK", b"x", WARC_Payload_Digest=value))[2][0][at] is ok


def test_too_large_bodies_are_a_problem(monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 1000)
    assert warc.derivatives(response("http://h/", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip", gzip.compress(bytes(5000))))[0][-1] == "too large"


class Lines(html.parser.HTMLParser):
    """The text of a page by the library's parser: a line per block."""

    BLOCKS = frozenset("p div h1 h2 h3 nav ul ol li article section footer header html head body table tr td br".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        if tag in self.BLOCKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag in self.BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        self.lines[-1] += "" if self.skip else data


def test_warc_query_against_plain_code(spark, tiny):
    pages = {r.page_id: r for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    out = queries.op10_warc(spark, tiny).collect()
    assert len(out) == 2 * len(pages)
    for r in out:
        page = pages[r.page_id]
        payload = page.html.encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        sums = ["sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (block, payload)]
        assert [r.source_block_digest, r.source_payload_digest, r.http_status, r.target_uri] == [*sums, 200, page.url]
        if r.record_type == "conversion":
            reader = Lines()
            reader.feed(page.html)
            reader.close()
            text = "\n".join(x for x in (" ".join(line.split()) for line in reader.lines) if x).encode()
            assert (r.block_length, r.block_sha256) == (len(text), hashlib.sha256(text).hexdigest())
    made = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(spark.read.parquet(f"{tiny}/pages.parquet"))).collect()}
    for r in made.values():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = email.message_from_bytes(head.partition(b"\r\n")[2])
        assert rest == bytes(r.block) + b"\r\n\r\n" and int(fields["Content-Length"]) == len(r.block)
        assert fields["WARC-Refers-To"] == made[r.page_id, "metadata"].refers_to and fields["WARC-Record-ID"] == r.record_id


def test_warc_query(spark, tiny):
    out = queries.op10_warc(spark, tiny).toPandas()
    pages = spark.read.parquet(f"{tiny}/pages.parquet").toPandas()
    assert len(out) == 2 * len(pages) and out.problem.isna().all() and out.digest_ok.all()
    page = pages.iloc[0]
    row = out[(out.page_id == page.page_id) & (out.record_type == "conversion")].iloc[0]
    assert row.block_sha256 == hashlib.sha256(warc.plain(page.html).encode()).hexdigest()
