import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from barloom.llm import html_main, tiff

SCHEMA = "doc_id bigint, text string, payload_bytes string, f int"


@pytest.mark.parametrize("size", [64, 128, 256, 320, 512, 576, 4096, 65536, 65536 + 64, (1 << 20) + 640])
def test_files_give_back_their_payload(size):
    rng = random.Random(size)
    for payload in (bytes(size), bytes(rng.choice(b"ab \n") for _ in range(size)), rng.randbytes(size)):
        content = tiff.written(payload)
        assert b"".join(p.pixels for p in tiff.pages_of(content)) == payload


def test_codecs_by_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 2, 127, 128, 129, 130, 1000, 20000):
        for data in (bytes(n), rng.randbytes(n), bytes(rng.choice(b"abc") for _ in range(n)), bytes(k // 3 % 256 for k in range(n))):
            assert tiff.unpackbits(tiff.packbits(data), n) == data
            assert tiff.unlzw(tiff.lzw(data), n) == data


def test_lzw_against_a_known_stream():
    # codes 256 45 45 258 45 ... of the format's own kind: clear, then doubled runs
    data = bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    bits = "".join(format(c, "09b") for c in (256, 45, 258, 258, 65, 259, 66, 257))
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unlzw(raw, len(data)) == data


def big_endian(pages):
    """A file in the other byte order with RGB pages, one strip each, uncompressed or differenced and deflated."""
    out, link = bytearray(b"MM\0\x2a\0\0\0\0"), 4
    for pixels, predictor in pages:
        raw = np.diff(pixels, axis=1, prepend=np.zeros_like(pixels[:, :1])) if predictor == 2 else pixels
        packed = zlib.compress(raw.tobytes()) if predictor == 2 else raw.tobytes()
        at = len(out)
        out += packed
        bits = len(out)
        out += struct.pack(">3H", 8, 8, 8)
        h, w, _ = pixels.shape
        entries = [(256, 3, 1, struct.pack(">HH", w, 0)), (257, 3, 1, struct.pack(">HH", h, 0)), (258, 3, 3, struct.pack(">I", bits)),
                   (259, 3, 1, struct.pack(">HH", 8 if predictor == 2 else 1, 0)), (273, 4, 1, struct.pack(">I", at)), (277, 3, 1, struct.pack(">HH", 3, 0)),
                   (279, 4, 1, struct.pack(">I", len(packed))), (317, 3, 1, struct.pack(">HH", predictor, 0))]
        struct.pack_into(">I", out, link, len(out))
        out += struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", *e[:3]) + e[3] for e in entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def test_pages_of_foreign_files_and_broken_ones(spark):
    rng = np.random.default_rng(0)
    shots = [(rng.integers(0, 256, (5, 7, 3), np.uint8), 1), (rng.integers(0, 256, (4, 6, 3), np.uint8), 2)]
    good = big_endian(shots)
    circle = bytearray(tiff.written(bytes(64)))
    circle[-4:] = circle[4:8]
    rows = [(1, good, "x"), (2, b"junk", "x"), (None, tiff.written(bytes(128)), "x"), (4, None, "x"), (5, bytes(circle), "x"), (6, good[:-30], "x"), (6, b"", "x")]
    found = tiff.pages(spark.createDataFrame(rows, "id bigint, content binary, page string"), "id", "content").collect()
    own = [r for r in found if r.id == 1]
    assert [bytes(r.pixels) for r in own] == [s.tobytes() for s, _ in shots] and [r.width for r in own] == [7, 6]
    assert [r.error is None for r in found if r.id == 2] == [False]
    assert [r.height for r in found if r.id is None] == [2]
    assert not [r for r in found if r.id == 4]
    assert [r.error for r in found if r.id == 5] == [None, "the image directories form a circle"]
    assert sum(r.error is not None for r in found if r.id == 6) == 2


def test_texts_as_files(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "é" * 40, "x" * 64, "word " * 200, "".join(rng.choice("abc é\n") for _ in range(90_000)), "x" * 64]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in tiff.round_trip(docs).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(tiff.written(payload)) and r.media_sha256 == hashlib.sha256(tiff.written(payload)).hexdigest()
    assert got[4][2:] == got[7][2:] and got[0][2:] == got[1][2:]
    assert tiff.round_trip(docs.where("false")).count() == 0


BODY = "<p>{}</p><p>Short one.</p><p>{}</p>".format("Long words of the story go on and on here. " * 6, "More of the same story is told in this part. " * 5)


@pytest.mark.parametrize("html,want", [
    (None, []), ("", []), ("<html><body></body></html>", []), ("plain words", ["plain words"]),
    ("<p>a &amp; b&nbsp;c &lt;d&gt; &#233;</p>", ["a & b c <d> é"]),
    (f"<html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy now this thing. And more.</div><article><h1>Head line</h1>{BODY}</article><footer>&copy; me</footer></body></html>", None),
    (f"<body><header><h2>Site</h2></header><div id=sidebar><p>{'side words ' * 20}</p></div><main><h1>Head line</h1>{BODY}<div class='comments-list'><p>{'I think so too. ' * 9}</p></div><form><input><label>Mail</label></form></main>", None),
    (f"<body><div class=menu><a>a</a><a>b</a></div><div><h1>Head line</h1>{BODY}</div><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div><div><a>z</a></div><div><a>z</a></div><aside>no</aside>", None),
    (f"<nav><a>never closed<article><h1>Head line</h1>{BODY}</article>", None),
    (f"<article><p><b>Head line<br>{BODY}</article>", None),
    ("<article><p>tiny</p></article><footer>foot</footer>", ["tiny"]),
])
def test_main_text(html, want):
    if want is None:
        want = ["Head line", ("Long words of the story go on and on here. " * 6).strip(), "Short one.", ("More of the same story is told in this part. " * 5).strip()]
    assert html_main.main_text(html) == "\n".join(want)


@pytest.mark.parametrize("html,want", [
    ("<article><p class=ad>Buy<p>Real words<p>More</article>", "Real words\nMore"),
    ("<article><p class=ad>Buy<h2>Head</h2><div>Words</div></article>", "Head\nWords"),
    ("<article><ul><li class=share>x<li>Words<ul><li class=share>y<li>Inner</ul><li>Last</ul></article>", "Words\nInner\nLast"),
    ("<article><ul><li class=share>x<ul><li>still x</ul>and x<li>Words</ul></article>", "Words"),
    ("<article><dl><dt class=ad>x<dd>Words<dd class=ad>y<dt>Term</dl></article>", "Words\nTerm"),
    ("<article><table><tr class=ad><td>x<tr><td class=ad>y<td>Words<th>Cell<tbody><tr><td>Last</table></article>", "Words\nCell\nLast"),
    ("<article><table><tr><td class=ad>x<table><tr><td>still x</table>x<td>Words</table></article>", "Words"),
    ("<head><title>T</title><body><article><p>Words</article>", "Words"),
    ("<head><title>T</title><article><p>Words</article>", "Words"),
])
def test_omitted_end_tags(html, want):
    assert html_main.main_text(html) == want


STORY = ["Head line", ("Long words of the story go on and on here. " * 6).strip(), "Short one.", ("More of the same story is told in this part. " * 5).strip()]


@pytest.mark.parametrize("html", [
    f'<body><div id=page class="has-sidebar"><h1>Head line</h1>{BODY}</div>', f'<body><div class="no-sidebar"><h1>Head line</h1>{BODY}</div>',
    f'<body><article class="post category-search tag-advertising"><h1>Head line</h1>{BODY}</article>',
    f'<body><article class="related"><h1>Head line</h1>{BODY}</article>',
    f'<body><div class="widget page"><h1>Head line</h1>{BODY}<div class="comments"><p>{"I think so too. " * 9}</p></div></div><p>Tail</p>',
])
def test_a_name_does_not_cost_the_article(html):
    assert html_main.main_text(html).split("\n")[:4] == STORY
    assert "think" not in html_main.main_text(html)


def test_names_still_leave_out():
    side = "side words " * 40
    for name in ("sidebar", "comments-list", "relatedPosts", "x ad"):
        assert html_main.main_text(f"<body><div class='{name}'><p>{side}</p></div><div><h1>Head line</h1>{BODY}</div>") == "\n".join(STORY)
    assert html_main.main_text("<div class=ad>Buy now</div>") == ""


def test_pages_table(spark):
    rows = [(1, "u", "<p>a  b\n c</p>", "x", 1), (1, "u", "<p>a  b\n c</p>", "x", 1), (None, None, None, "x", 1), (3, "v", "<p>" + "é" * 10**5, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0), r.text[:5], r.n_chars) for r in html_main.extract(pages).collect())
    assert got == [(0, "", 0), (1, "a b c", 5), (1, "a b c", 5), (3, "ééééé", 10**5)]
    assert html_main.extract(pages.where("false")).count() == 0


REPLIES = "I think this is quite wrong and somebody should say so at once. "


@pytest.mark.parametrize("html", [
    f'<body><div class="s"><h1>Head line</h1>{BODY}</div><div class="comments">' + f"<div class=c><p>{REPLIES * 5}</p></div>" * 6 + "</div></body>",
    f"<body><article><h1>Head line</h1>{BODY}</article><ol id='commentlist'>" + f"<li><article class='x'><p>{REPLIES * 9}</p></article>" * 6 + "</ol></body>",
    f"<body><article class='post comments-open'><h1>Head line</h1>{BODY}</article>" + f"<article class='comment'><p>{REPLIES * 9}</p></article>" * 3,
    f"<body><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><h1>Head line</h1>{BODY}</body>",
    f"<body><nav><ul><li>Home</ul><p>{REPLIES}</p></nav><h1>Head line</h1>{BODY}</body>",
    f"<body><div id='cookie-consent'><p>{REPLIES * 30}</p></div><div><h1>Head line</h1>{BODY}</div></body>",
])
def test_comments_consent_and_open_menus(html):
    assert html_main.main_text(html).split("\n") == STORY


def test_a_short_page_under_a_doubtful_name():
    text = "The price of the share rose by two per cent on Monday, the report of the company says."
    assert html_main.main_text(f"<body><div class='share-price-report'><p>{text}</p></div></body>") == text
    assert html_main.main_text(f"<body><div class='comments'><p>{text}</p></div></body>") == ""


def test_made_up_pages_give_back_their_article():
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice("the harbour committee price of report new line was said".split()) for _ in range(n)).capitalize() + "."
    for _ in range(150):
        blocks = [("h1", sentence(4))] + [(rng.choice(["p", "p", "p", "blockquote", "h2"]), sentence(rng.randint(25, 60))) for _ in range(rng.randint(3, 8))]
        inner = "".join(f"<{tag}>{text}" + ("" if tag == "p" and rng.random() < 0.4 else f"</{tag}>") for tag, text in blocks)
        body = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class='entry'>%s</div>", "<article class='post related'>%s</article>"]) % inner
        menu = "<nav><ul>" + "".join(f"<li><a href='/{k}'>{sentence(2)}</a>" for k in range(5)) + "</ul>" + ("</nav>" if rng.random() < 0.6 else "")
        side = rng.choice(["<aside>%s</aside>", "<div class='sidebar'>%s</div>", "<div class='ad'>%s</div>", "<div id='comments'>%s</div>", "<form>%s</form>"]) % f"<p>{sentence(40)}</p>"
        page = f"<html><head><title>x</title><script>var a = '<p>';</script></head><body>{menu}{body}{side}<footer><p>{sentence(12)}</p></footer></body></html>"
        assert html_main.main_text(page) == "\n".join(text for _, text in blocks), page
