import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from textquarry.llm import chat as C
from textquarry.llm import html_text as H
from textquarry.llm import language_id as L


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 2, 63, 64, 65, 128, 200])
    scores, moves = rng.normal(size=(sizes.sum(), 3)) * 2, rng.normal(size=(3, 3))
    got, at = L.mean_marginals(scores, sizes, moves), 0
    for n, row in zip(sizes, got, strict=True):
        want, _ = L.forward_backward(scores[None, at : at + n], moves, np.ones((1, n), bool))
        assert np.allclose(want[0].mean(0), row)
        at += n
    every = np.zeros(2)  # three words, two labels, by enumeration
    s, m = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    total = 0.0
    for y in itertools.product(range(2), repeat=3):
        p = np.exp(sum(s[t, y[t]] for t in range(3)) + sum(m[y[t - 1], y[t]] for t in (1, 2)))
        total += p
        every += p * np.bincount(y, minlength=2) / 3
    assert np.allclose(L.mean_marginals(s, np.array([3]), m)[0], every / total)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in L.language_query(docs).collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows) and len(rows) > 250
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd, none):
    rows = L.language_query(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr", "de")
    assert L.language_query(none).count() == 0
    unlabelled = odd.withColumn("lang", odd.lang.substr(99, 1)).where("lang = 'x'")
    assert L.accepted_documents(unlabelled).count() == 0
    kept = L.accepted_documents(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "10", "2", "3", "7", "8", "9", "9", "None"])


def test_code_switched_words_are_labelled_apart():
    english, german = "the and of with that from", "der und die nicht mit von"
    windows = [("en", english.split() * 4)] * 30 + [("de", german.split() * 4)] * 30
    model = L.fit(windows)
    words = english.split() * 4 + german.split() * 4
    got, _ = L.forward_backward(model.emissions(words)[None].astype(float), model.moves, np.ones((1, len(words)), bool))
    assert [model.languages[k] for k in got[0].argmax(1)] == ["en"] * 24 + ["de"] * 24


def test_long_and_unspaced_tokens_count_whole():
    japanese, chinese = "これはとてもながいぶんです、", "这是一个没有空格的句子，"
    for text in ("a" * 100_000, japanese * 500, "x1y2" * 40 + ",z", "short it's " + chinese):
        assert "".join(L.words_of(text)) == "".join(c for c in text if c.isalpha())
        assert max(map(len, L.words_of(text))) <= L.PIECE
    assert L.words_of("it's a-b Donaudampfschifffahrtsgesellschaft 12 x_") == ["its", "ab", "Donaudampfschifffahrtsgesellschaft", "x"]
    english, german = "the and of with that from", "der und die nicht mit von"
    windows = [("en", english.split() * 4)] * 30 + [("de", german.split() * 4)] * 30 + [("zh", L.words_of(chinese * 6))] * 30
    label = L.Labeller(L.fit(windows))
    joined = lambda x: x.replace(" ", "")
    texts = [joined(english) * 3 + joined(german) * 200, joined(german) * 3 + joined(english) * 200, "with that " + chinese * 3]
    means = label.marginals(texts)[1]
    assert [label.model.languages[k] for k in means.argmax(1)] == ["de", "en", "zh"]


def test_no_letter_no_language(spark):
    assert L.words_of("² ½ Ⅷ ①② 12 _ - \u0301") == []
    assert L.words_of("हिन्दी (भाषा)") == ["हिन्दी", "भाषा"]
    rows = [(k, t, None) for k, t in enumerate(["²", "½ ²", "Ⅷ", "①②", "\u0301", "a²"])] + [(100 + k, "the and of with", "en") for k in range(60)]
    got = {r["doc_id"]: r["lang_pred"] for r in L.language_query(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert [got[k] for k in range(6)] == ["und"] * 5 + ["en"]


def test_repeated_rows_count_once_in_the_sample(spark):
    rows = [(0, "the and of with", "en")] * 3000 + [(k, f"und die der {k} nicht", "de") for k in range(60)] + [(k, f"that of {k} this", "en") for k in range(60, 120)]
    windows = L.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=20)
    assert sum(x == "en" for x, _ in windows) == 20 and len(windows) == 40


def test_texts_in_no_language_are_rejected(spark, sf_dir):
    rng, docs = random.Random(3), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    noise = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(80))
    planted = [noise("abcdefghijklmnopqrstuvwxyz") for _ in range(5)] + [noise("бвгдежзиклмнопрстуфхцчшщыэюя"), noise("αβγδεζηθικλμνξοπρστυφχψω"), noise("abcdef0123456789"), "これはとてもながいぶんです、" * 20]
    rows = spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(planted)], docs.schema)
    kept = {r["doc_id"] for r in L.accepted_documents(docs.unionByName(rows)).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}


def test_escapes_are_reversible():
    for t in map("".join, itertools.chain.from_iterable(itertools.product(["\\", "<", "|", ">", "s", "/", "[", "INST", "]", "\n"], repeat=n) for n in range(5))):
        e = C.escaped(t)
        assert C.unescaped(e) == t and not any(c in e for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))
        assert C.read_turn(C.formatted_turn(t, [{"type": "text", "text": t}])[0]) == (t, t)


def test_no_control_string_is_made_where_parts_meet():
    for parts in (["<", "/s>"], ["[", "INST]"], ["<", "|im_end|", ">"], ["\\", "\\"], ["a<", "", "|", "x"], ["very long " * 100_000, "<", "s>"]):
        made, start, end, _ = C.formatted_turn("user", [{"type": "text", "text": p} for p in parts])
        assert made[start:end] == C.escaped("".join(parts)) and C.read_turn(made)[1] == "".join(parts)
        assert not any(c in made[start:end] for c in ("</s>", "<s>", "[INST]", "<|"))
    made, start, end, found = C.formatted_turn("user", [{"type": "text", "text": "<"}, {"type": "image", "ref": "r", "units": 1}, {"type": "text", "text": "/s>"}])
    assert made[start:end] == "<<|image|>/s>" and found[0]["at"] == start + 1


def test_parts_become_placeholders():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "units": 28 * 28 * 3}, None, {"type": "audio", "ref": "b", "units": 81}, {"type": "document", "ref": None, "units": None}]
    text, start, end, attachments = C.formatted_turn("user", parts)
    assert text[start:end] == "see <|image|><|audio|><|document|>"
    assert [(a["type"], a["ref"], a["tokens"], text[a["at"] :].startswith(f"<|{a['type']}|>")) for a in attachments] == [("image", "a.png", 3, True), ("audio", "b", 3, True), ("document", None, 1, True)]
    with pytest.raises(ValueError, match="video"):
        C.formatted_turn("user", [{"type": "video"}])


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b </s>"), (1, 1, "user", None), (1, 1, None, "x"), (2, None, "system", "a\\"), (None, 1, "assistant", "é🙂"), (1, 2, "assistant", "b </s>"), (3, 1, "role\n", "")]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int, parts string")
    got = {r["conv_id"]: r for r in C.chat_query(spark, df).collect()}
    key = lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), r[3] or "")
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1]["loss_chars"] == len("</s>[INST] ok [/INST]") and got[-1]["n_turns"] == 2
    assert [r["conv_id"] for r in C.chat_query(spark, df.where("false")).collect()] == [-1]


BAD = ["", "<", "<p", "<p>a</p", "&am", "<!-- x", "<script>a", "</p></div>", "<a href='x", "<p>a<b>c", "<div" * 500, "<article>" * 500 + "x", "a\x00b", "<p " + "a='b' " * 3000 + ">t"]


@pytest.mark.parametrize("page", BAD)
def test_broken_pages_end(page):
    assert isinstance(H.main_text(page), str)


def test_pages():
    junk = '<header><h1>Site</h1></header><div class="top-menu">a b</div><div id="cookie-notice">We use cookies to do things here</div><form><p>Your mail address please, so we can write to you</p></form>'
    after = '<section class="comments"><p>First! A long enough comment of a reader, which says nothing about it at all.</p></section><footer>&copy; Site</footer>'
    body = "<h1>A &amp; B</h1><p>One  two\n three<br>four.</p><p><b>Short.<br><p>Caf&eacute; &#39;x&#39; <a href=/y>link</a>, and more words of the text so that it is long enough.</p><ul><li>item</ul>"
    want = "A & B\nOne two three four.\nShort.\nCafé 'x' link, and more words of the text so that it is long enough.\nitem"
    script = '<script>if (a<b) {x = "</p><article>"}</script><style>p{}</style>'
    for page in (f"<html><head><title>T</title></head><body>{junk}<article>{script}{body}<aside>side</aside></article>{after}</body></html>", f"{junk}<main>{body}{after}</main>", f"<body>{junk}<div>{body}</div>{script}{after}</body>"):
        assert H.main_text(page) == want
    titled = '<div class="page-header">Site name</div><div class="post-header"><h2 class="header">Title</h2></div><p>Text of the post, long enough to be a surge of its own in the windows of lines, yes.</p><div id="footer">About</div>'
    assert H.main_text(titled) == "Title\nText of the post, long enough to be a surge of its own in the windows of lines, yes."
    assert H.main_text(None) == H.main_text("<nav><a href=x>menu</a></nav>") == ""


def test_page_rows(spark, sf_dir):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>Hello there</p>", "x"), (1, "u", "<p>Hello there</p>", "y")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in H.extract(df).collect()) == [("1", "", 0), ("1", "Hello there", 11), ("None", "Hello there", 11)]
    assert H.extract(df.where("false")).count() == 0
    import html
    import re

    for r in H.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def plain_surges(weights, window, threshold):
    """Line by line: a line is text if its stretch, without ``window`` lines of no weight on end, has a window of the threshold."""
    n = len(weights)
    sums = [sum(weights[k : k + window]) for k in range(n)]
    of, stretch = [None] * n, 0
    for k in range(n):
        if weights[k]:
            stretch += k >= window and not any(weights[k - window : k])
            of[k] = stretch
    big = {of[k] for k in range(n) if weights[k] and sums[k] >= threshold}
    return [(min(x), max(x) + 1) for x in ([k for k in range(n) if of[k] == b] for b in sorted(big))]


def test_surge_and_dive():
    assert H.surges([0, 5, 90, 0, 3, 0, 100], 3, 86) == [(1, 7)]
    assert H.surges([5, 0, 0, 0, 90, 0, 0, 3, 0, 0, 0, 85], 3, 86) == [(4, 8)]
    random.seed(1)
    for _ in range(500):
        weights = [random.choice([0, 0, 0, 3, 50, 200]) for _ in range(30)]
        assert H.surges(weights, 3, 86) == plain_surges(weights, 3, 86)


WORDS = "Some words of the article that go on for a while, so that they are a surge of their own in any window of lines."


def test_nothing_inside_the_article_is_lost():
    for inner, gone in (
        ("<section id='related-work'><p>Others did this before.</p></section>", ""),
        ("<div class='social-history'><p>A history.</p></div>", ""),
        ("<p><a href='/x'>A paragraph that is one link</a></p>", ""),
        ("<p>No.</p><div class='ad'><p>Buy</p></div><p>Yes.</p>", "Buy"),
        ("<ul>" + "<li><a href=x>a link in a list</a></li>" * 6 + "</ul>", ""),
        ("<section id='discussion'><h2 id='related'>Related</h2></section>", ""),
        ("<aside><p>one</p><p>two</p><p>three</p><p>four</p></aside>", "one|two|three|four"),
        ("<div class='related-posts'><ul>" + "<li><a href=x>other post</a></li>" * 5 + "</ul></div>", "other post"),
        ("<p>" + "very long " * 60_000 + "</p>", ""),
    ):
        for before, after in (("<article>", "</article>"), ("<div>", "</div>"), ("", "")):
            page = f"<nav><a href=/>menu</a></nav>{before}<h1>T</h1><p>{WORDS}</p>{inner}<p>{WORDS}</p><p>End.</p>{after}<footer>foot</footer>"
            lines = H.main_text(page).split("\n")
            want = [x.text for x in H.lines_of(f"<div>{inner}</div>")]
            assert lines == ["T", WORDS, *[x for x in want if x not in gone.split("|")], WORDS, "End."], (before, inner[:50])


def test_pages_without_landmarks_give_the_same_text(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        bare = r["html"].replace("<article>", "").replace("</article>", "")
        assert bare != r["html"] and H.main_text(bare) == H.main_text(r["html"]) != ""


LONG_LINE = "A long enough paragraph of words, so that it is a surge of its own in any window there is, yes."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{LONG_LINE}</p><section id='related'><p>Kept too.</p></section><div class='ad'>Buy</div></article>", [LONG_LINE, "Kept too."]),
        (f"<article><p>{LONG_LINE}</p><div class='search'>Search trees are balanced.</div><div class='comments'>No!</div></article>", [LONG_LINE, "Search trees are balanced."]),
        (f"<main><p>{LONG_LINE}</p><p>For <math><mi>x</mi><mo>=</mo><mn>1</mn></math> it holds.</p></main>", [LONG_LINE, "For x=1 it holds."]),
        (f"<article><p>{LONG_LINE}</p><xmp><b>raw</b> &amp;</xmp></article>", [LONG_LINE, "<b>raw</b> &amp;"]),
        (f"<article><p>{LONG_LINE}</p></article><article>Short one.</article>", [LONG_LINE, "Short one."]),
        (f"<div><div>Site notice</div><div><h1>Title</h1><p>{LONG_LINE}</p><p>{LONG_LINE}</p><p>End.</p></div><div>Foot</div></div>", ["Title", LONG_LINE, LONG_LINE, "End."]),
    ],
)
def test_what_an_article_holds(page, want):
    assert H.main_text(page).split("\n") == want


def test_most_articles_are_found_without_any_name(spark, sf_dir):
    """Landmarks made plain, classes and ids taken away: what is left to tell the article by is the distribution of its text."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    bare = [re.sub(r"(<(?:div|ul|p|span)\b)[^>]*>", r"\1>", re.sub(r"<(/?)(?:article|main|nav|footer|aside|header|section)\b[^>]*>", r"<\1div>", p)) for p in pages]
    same = sum(H.main_text(a) == H.main_text(b) for a, b in zip(pages, bare, strict=True))
    assert same >= 0.6 * len(pages)
    assert all(set(H.main_text(a).split("\n")) <= set(H.main_text(b).split("\n")) for a, b in zip(pages, bare, strict=True))


def test_open_elements_cost_no_square():
    took = []
    for n in (10_000, 80_000):
        start = time.perf_counter()
        H.main_text("<div>" * n + "x</b></i></nav>" * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * took[0] + 0.5
