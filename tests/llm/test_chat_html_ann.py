import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.chat_format import CONTROL, TokenCounter, escape, escape_role, format_conversations, read_back, render, summarize_windows, unescape, unescape_role
from tessera.llm.hilbert_ann import hilbert_keys, nearest_neighbours
from tessera.llm.tokens import tokenizer_path
from tessera.llm.html_extract import chosen_lines, extract_pages, lines_of, main_text, stretches


def test_escape_round_trip():
    draw = random.Random(2)
    bits = ["\\", "<", "|", "im_start", "|>", "a", "\n", "/s>", "~", *CONTROL]
    for _ in range(2000):
        t = "".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))
        assert unescape(escape(t)) == t and unescape_role(escape_role(t)) == t
        assert not any(c in escape(t) for c in CONTROL)
        assert [(r, x) for r, x, _, _ in read_back(render(t, t)[0] + render("user", t)[0])] == [(t, t), ("user", t)]


def conversations():
    draw = random.Random(4)
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be brief " * draw.randint(1, 5)))
        for t in range(1, draw.randint(2, 40)):
            rows.append((c, t, "user" if t % 2 else "assistant", " ".join(["say"] * draw.randint(0, 60))))
    rows += [(None, 1, "user", None), (None, None, None, "x"), (98, 1, "assistant", "</s>[INST] a [/INST]"), (98, 1, "assistant", "</s>[INST] a [/INST]"), (99, 1, "assistant", "w " * 3000)]
    return rows


def test_windows_keep_budget_system_history_and_mask(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    windows = format_conversations(df, budget=100, history=2)
    rows = windows.collect()
    with open(tokenizer_path("byte_bpe_50k.json"), "rb") as file:
        counter = TokenCounter(file.read())
    cost = lambda r, t: counter([(r, t)])[0]
    for w in rows:
        turns = read_back(w.formatted)
        assert len(turns) == len(w.new_turns)
        assert sum(cost(r, t) for r, t, _, _ in turns) <= 100 or sum(w.new_turns) == 1
        masked = [(b, e) for (r, _, b, e), new in zip(turns, w.new_turns, strict=True) if new and r == "assistant"]
        assert masked == list(zip(w.loss_begin, w.loss_end, strict=True))
        if w.conv_id is not None and w.conv_id % 3 == 0 and w.conv_id < 90:
            assert turns[0][0] == "system"
    assert max(w.window for w in rows) > 3
    assert any(not all(w.new_turns) for w in rows if w.conv_id not in (None, 98, 99) and w.conv_id % 3)
    got = {r.conv_id: r for r in summarize_windows(windows).collect()}
    by = {}
    for c, t, r, x in conversations():
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def brute_windows(turns, cost, budget, history):
    """Windows as lists of (turn number, new), choosing each span by trying every end against prefix sums."""
    prefix = [0]
    for t in turns:
        prefix.append(prefix[-1] + cost(*t))
    system = next((i for i, (r, _) in enumerate(turns) if r == "system"), None)
    out, start = [], 0
    while start < len(turns):
        repeated = []
        if start:
            told = [system] if system is not None and system < start else []
            room = budget - (prefix[start + 1] - prefix[start]) - sum(cost(*turns[i]) for i in told)
            for i in [i for i in range(start - 1, -1, -1) if i != system][:history]:
                if cost(*turns[i]) > room:
                    break
                room -= cost(*turns[i])
                repeated.insert(0, i)
            repeated = told + repeated
        spent = sum(cost(*turns[i]) for i in repeated)
        end = start + 1
        while end < len(turns) and spent + prefix[end + 1] - prefix[start] <= budget:
            end += 1
        out.append([(i, False) for i in repeated] + [(i, True) for i in range(start, end)])
        start = end
    return out


def test_windows_match_brute_force(spark):
    with open(tokenizer_path("byte_bpe_50k.json"), "rb") as file:
        counter = TokenCounter(file.read())
    by = {}
    for c, t, r, x in conversations():
        if c is not None and c < 98:
            by.setdefault(c, []).append((t, r, x))
    df = spark.createDataFrame([(c, *t) for c, ts in by.items() for t in ts], "conv_id long, turn long, role string, text string")
    for budget, history in ((100, 2), (60, 0), (160, 3)):
        got = {}
        for w in sorted(format_conversations(df, budget=budget, history=history).collect(), key=lambda w: (w.conv_id, w.window)):
            got.setdefault(w.conv_id, []).append([((r, x), new) for (r, x, _, _), new in zip(read_back(w.formatted), w.new_turns, strict=True)])
        for c, turns in by.items():
            plain = [(r, x) for _, r, x in sorted(turns)]
            assert got[c] == [[(plain[i], new) for i, new in w] for w in brute_windows(plain, lambda r, x: counter([(r, x)])[0], budget, history)]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_conversations(df).count() == 0 and summarize_windows(format_conversations(df)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><div class="cookie-notice">We use cookies</div>
<header><h1>Site name</h1></header><div id="nav"><a href=1>Home</a></div>{open}<h1>Title &amp; more</h1><p>First paragraph is long enough to make the line sums surge over the threshold, clearly.
<p>Second   with <b>bold</b>&nbsp;text<br>and a break.<div class="ad">Buy now, this is a long advert that goes on and on for many words.</div><ul><li>one<li>two</ul><p>Last words here.{close}
<aside>Related stories of the day</aside><section class="comments"><p>A reader comment that is quite long and says many things about nothing at all.</p></section><form>Mail <input> <button>Go</button></form><footer>&copy; 2024 Site</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph is long enough to make the line sums surge over the threshold, clearly.\nSecond with bold text\nand a break.\none\ntwo\nLast words here."


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>")])
def test_main_text(tags):
    assert main_text(PAGE.replace("{open}", tags[0]).replace("{close}", tags[1])) == TEXT


@pytest.mark.parametrize("name", ["container no-sidebar", "layout with-sidebar", "page has-header", "page without-sidebar", "l-page with_sidebar_left", "page-has-header"])
@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ("<section>", "</section>")])
def test_layout_words_of_wrappers_drop_nothing(name, tags):
    assert main_text(PAGE.replace("{open}", f"<div class='{name}'>{tags[0]}").replace("{close}", f"{tags[1]}</div>")) == TEXT


@pytest.mark.parametrize("name", ["layout sidebar-right", "header-fixed wrap", "site cookie-consent-open", "page search-page", "modal-open", "widget"])
def test_an_article_counts_within_a_named_wrapper(name):
    for tag in ("article", "main"):
        wrapped = f"<div class='{name}'><p>Words of the wrapper that are no part of the article itself.</p><div id=alert><{tag}>"
        page = PAGE.replace("{open}", wrapped).replace("{close}", f"</{tag}></div><p>More words of the wrapper, long enough to count if they were not dropped at all.</p></div>")
        assert main_text(page) == TEXT
    page = PAGE.replace("{open}", f"<main><div class='{name}'><article>").replace("{close}", "</article></div></main>")
    assert main_text(page) == TEXT


@pytest.mark.parametrize("part", ["<nav>{}</nav>", "<aside>{}</aside>", "<footer>{}</footer>", "<form>{}</form>", "<div class=comments>{}</div>", "<div id=nav>{}</div>", "<div class='related posts'>{}</div>", "<div class=sidebar>{}</div>", "<div role=complementary>{}</div>"])
def test_an_article_in_another_part_does_not_count(part):
    other = part.format("<article><p>Another article, with a teaser long enough to be taken for the text of the page.</p></article>")
    assert main_text(PAGE.replace("{open}", other + "<article>").replace("{close}", "</article>")) == TEXT
    assert main_text(PAGE.replace("{open}", "<article>").replace("{close}", f"<div class=widget>{other}</div>{other}</article>")) == TEXT


@pytest.mark.parametrize("head", ["<header class='entry-header'>{}</header>", "<div class='article-header'>{}</div>", "<div class=header id=post-header>{}</div>", "<header class='page-header has-image' role=masthead>{}</header>"])
def test_an_article_keeps_its_head(head):
    for tag in ("article", "main"):
        page = PAGE.replace("{open}<h1>Title &amp; more</h1>", f"<{tag}>" + head.format("<h1>Title &amp; more</h1>")).replace("{close}", f"</{tag}>")
        assert main_text(page) == TEXT
    assert "Site" not in main_text(PAGE.replace("<header>", "<div class=header>").replace("</header>", "</div>").replace("{open}", "<p>").replace("{close}", "</p>"))


def test_broken_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("<p") == "" and main_text("<!-- open") == ""
    assert main_text("just text without any tags at all, but long enough to be an article of its own") != ""
    assert main_text("<article><p>short</article>") == "short"
    assert main_text("<article><p>a<script>x") == "a" and main_text("<nav>" * 500 + "x") == ""
    assert main_text("<article><p>" + "w " * 50000 + "</article>").count("w") == 50000


def test_stretches():
    assert stretches([0, 50, 0, 30, 0, 0, 0, 0, 5, 0, 0, 0, 90], 3, 60) == [(1, 4), (12, 13)]
    assert stretches([], 3, 60) == [] and stretches([0, 0], 3, 60) == []


KINDS = {"text": ("<p>{}</p>", "{}"), "ad": ("<div class=ad>{}</div>", ""), "notice": ("<p class='cookie-notice'>{}</p>", ""), "link": ("<p><a href=x>{}</a></p>", ""), "nav": ("<nav>{}</nav>", ""), "comment": ("<div class=comments>{}</div>", "")}


def brute_main(blocks, article):
    """Kept blocks of a page of blocks (kind, characters, lies in the article): all from a weighing one to the last before three without weight."""
    text = lambda b: b[0] == "text"
    has = any(own and text(b) for b in blocks for own in [b[2]])
    taking = [i for i, b in enumerate(blocks) if b[0] in ("text", "link") and b[2] == has]
    weights = [(max(60, b[1]) if has else b[1]) if i in taking and text(b) else 0 for i, b in enumerate(blocks)]
    sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
    least = 60 if max(sums, default=0) >= 60 else max(1, max(sums, default=0) // 5)
    kept, group = set(), []
    heavy = [i for i, w in enumerate(weights) if w]
    for i, following in zip(heavy, [*heavy[1:], None], strict=False):
        group.append(i)
        if following is None or following - i > 3:
            if max(sums[at] for at in range(group[0], i + 1)) >= least:
                kept |= {x for x in taking if group[0] <= x <= i}
            group = []
    return sorted(kept)


def test_surge_and_dive_decide_on_random_pages():
    draw, decided = random.Random(11), 0
    for n in range(1500):
        article = n % 2 == 0
        blocks, parts = [], []
        sizes = [draw.choice([3, 20, 70, 300, 900]) for _ in range(draw.randint(0, 14))]
        begin, end = sorted((draw.randint(0, len(sizes)), draw.randint(0, len(sizes))))
        for i, size in enumerate(sizes):
            kind = draw.choice(["text", "text", "text", *KINDS])
            blocks.append((kind, size, article and begin <= i < end))
            parts.append(("<article>" if article and i == begin < end else "") + KINDS[kind][0].format("w" * size) + ("</article>" if article and i == end - 1 and begin < end else ""))
        lines = lines_of("<html><body>" + "".join(parts) + "</body></html>")
        assert [len(t) for t, _, _ in lines] == sizes
        assert chosen_lines(lines, 3, 60) == brute_main(blocks, article), (blocks, n)
        decided += {i for i, (k, _, own) in enumerate(blocks) if k in ("text", "link") and own == any(b[2] and b[0] == "text" for b in blocks)} != set(brute_main(blocks, article))
    assert decided > 300


def test_surge_and_dive_decide_within_the_article():
    """A block of links and a trailing link are cut from an article, a link between paragraphs stays; text outside never counts."""
    link = "<li><a href=x>Another article to read</a></li>"
    page = "<body><p>A promise.</p><article><h1>Head</h1><p>" + "word " * 60 + "</p><p><a href=x>The whole study</a></p><p>End.</p>{}<p>After.</p>" + link + "</article><p>" + "long " * 400 + "</p></body>"
    text = "Head\n" + "word " * 59 + "word\nThe whole study\nEnd."
    assert main_text(page.replace("{}", f"<ul>{link * 5}</ul>")) == text + "\nAfter."
    assert main_text(page.replace("{}", f"<ul>{link * 2}</ul>")) == text + "\nAnother article to read" * 2 + "\nAfter."
    blocks = "<p>" + "word " * 40 + "</p>" + link * 4 + "<p>tiny</p>" + link * 4
    assert main_text(blocks) == ("word " * 40).strip()


@pytest.mark.parametrize("part", ["<div class='ads'>{}</div>", "<section class='cookie-notice'>{}</section>", "<div id=newsletter>{}</div>", "<div>{}</div>", "<form>{}</form>", "<aside>{}</aside>", "<div class=sidebar>{}</div>"])
def test_long_parts_outside_never_return(part):
    long = "We value your privacy and that of our partners. " * 40
    article = "<article><h1>Head</h1><p>Two short paragraphs.</p><p>That is all.</p></article>"
    for page in (article + part.format(long), part.format(long) + article):
        assert main_text(page) == "Head\nTwo short paragraphs.\nThat is all."
    if part != "<div>{}</div>":
        assert main_text(part.format(long)) == "" and main_text(article.replace("</p><p>", "</p>" + part.format(long) + "<p>")) == "Head\nTwo short paragraphs.\nThat is all."


def test_names_of_wrappers():
    assert main_text("<div class='post has-comments'><p>" + "word " * 30 + "</p></div>") == ("word " * 30).strip() and main_text("<div class='comments'><p>" + "word " * 30 + "</p></div>") == ""
    for wrapper in ("class='content no-sidebar'", "class='post has-comments'", "id='search-results-article'", "class='post-header'"):
        assert main_text(f"<div {wrapper}><article><h1>Head</h1><p>{'word ' * 30}</p></article></div>") == "Head\n" + ("word " * 30).strip()
    assert main_text("<article><div class='post-header'><h1>Head</h1></div><p>text</p></article>") == "Head\ntext"


@pytest.mark.parametrize("junk", ["<b></i>", "<i><p><b></i>", "<a \"", "<svg>", "<a title='x>y' ", "</p>", "<!--", "<p><b>", "<article><nav></article>", "< <", "<a href=\"x"])
def test_a_megabyte_of_broken_markup_is_read_in_linear_time(junk):
    began = time.process_time()
    main_text("<article><p>start</p>" + junk * (1_000_000 // len(junk)))
    half = len(junk) and time.process_time() - began
    assert half < 10


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old", 1), (2, None, None, None, 2), (2, None, "", None, 2)], "page_id long, url string, html string, text string, main int")
    rows = extract_pages(df).collect()
    assert [r.text for r in rows if r.page_id == 2] == ["", ""] and rows[0].main == 1
    assert extract_pages(df.limit(0)).count() == 0


def test_hilbert_curve_is_a_walk():
    for d, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d), axis=-1).reshape(-1, d)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**d))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall_ties_and_bad_vectors(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(1500, 16)) * draw.uniform(0.5, 2, (1500, 1))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0] * 3), (5100, []), (5120, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + rows[:3] + bad, "vec_id long, embedding array<double>").withColumn("node", F.lit("x"))
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    assert got.keys() == {i for i in range(0, 1500, 20)}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(v != q and v < 1500 for _, v, _ in found)
        exact = np.cumsum(x[q] * x, axis=1)[:, -1]
        assert all(s == exact[v] for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-exact[i], i))[:20]
        hits += len({v for _, v, _ in found} & set(best))
        if q in (100, 120):
            assert [v for _, v, _ in found[:19]] == [v for v in range(100, 120 + (q == 100)) if v != q][:19] or exact[best[0]] > exact[q]
    assert hits / (20 * len(got)) >= 0.9


def found_by(df, **settings):
    out = {}
    for r in sorted(nearest_neighbours(df, F.col("vec_id") % 20 == 0, **settings).collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_ties_of_unlike_vectors_go_to_smaller_ids(spark):
    """Many different vectors of one product with every query: all that tie are scored, in whatever order they come."""
    draw = np.random.default_rng(5)
    for ids in (list(range(60)), list(range(59, -1, -1)), draw.permutation(60).tolist()):
        rows = [(i, [1.0, float(j + 1), 0.0]) for j, i in enumerate(ids)] + [(1000, [1.0, 0.0, 3.0])]
        got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ranges=1, curves=1)
        assert got[1000] == [(i, 1.0) for i in range(20)]


def test_recall_of_the_registered_setting_above_the_sizes_of_a_window(spark):
    """Recall and share of scored vectors on 8,000 vectors in loose groups, with the query's own parameters."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(40, 24))[draw.integers(0, 40, 8000)] * 0.6 + draw.normal(size=(8000, 24))
    got = found_by(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    hits = 0
    for q, found in got.items():
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.argsort(-exact)[:20].tolist()))
    assert len(got) == 400 and hits / 8000 >= 0.9


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 0.5)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size,change", [(200, None), (500, "long"), (2000, None), (2000, "huge"), (6000, "spread")])
def test_recall_at_every_size_and_with_long_vectors(spark, size, change):
    """Uniform vectors of 64 dimensions, the hardest case; one a thousand or 1e200 times as long, or lengths of all orders."""
    draw = np.random.default_rng(size)
    x = draw.normal(size=(size, 64))
    if change == "spread":
        x *= np.exp(draw.normal(size=(size, 1)))
    elif change:
        x[7] *= 1e3 if change == "long" else 1e200
    got = found_by(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    hits = 0
    for q, found in got.items():
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.argsort(-exact, kind="stable")[:20].tolist()))
    assert len(got) == len(range(0, size, 20)) and hits / (20 * len(got)) >= 0.9


def test_products_out_of_range_keep_every_rank(spark):
    rows = [(i, [10.0 ** (310 - 2 * i) if i > 1 else 1e308, 1.0]) for i in range(30)] + [(40, [-1e308, 1.0]), (41, [1e-300, 1e-300])]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert set(got) == {0, 20, 40} and all(len(f) == 20 for f in got.values()) and got[0][0] == (1, float("inf"))
