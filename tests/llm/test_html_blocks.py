from html.parser import HTMLParser

import numpy as np

from seriesmill.llm.html_blocks import INPUT, Labeller, Vectors, blocks, changed, extract_all, extract_pages, fit, own_labels, padded, train

WORDS = "station orbit signal window power array relay thermal charge panel sensor frame".split()


def page(k, paragraphs=4, wrap="article"):
    rng = np.random.default_rng(k)
    sentence = lambda: (" ".join(rng.choice(WORDS, 12)) + ".").capitalize()
    body = [sentence() for _ in range(paragraphs)]
    name = wrap.split(" ")
    start = f'<{name[0]} class="{name[1]}">' if len(name) > 1 else f"<{wrap}>"
    html = f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>{sentence()}</a></li></ul></nav><div class='ad'>{sentence()}</div>{start}<h1>Title {k} &amp; more</h1>" + "".join(f"<p>{x}\n  <b>bold</b>" for x in body) + f"</{name[0]}><div class=sidebar><p>{sentence()}</div><section id='comments'><p>{sentence()}</p></section><footer>&copy; {sentence()}</footer></body></html>"
    return html, "\n".join([f"Title {k} & more", *(f"{x} bold" for x in body)])


def test_blocks_against_the_standard_parser():
    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.hidden:
                self.words += data.split()

    for k in range(20):
        html, _ = page(k)
        plain = Plain()
        plain.feed(html)
        assert " ".join(text for _, text, _ in blocks(html)).split() == plain.words


def test_odd_pages():
    assert blocks("") == [] and blocks("<p>") == [] and blocks("<script>x") == []
    assert [t for _, t, _ in blocks("a<br>b <i>c</i>d<p>e &lt;f&gt; &eacute;\n g<!-- h --><p>i<div>j</p>k")] == ["a b cd", "e <f> é g", "i", "j", "k"]
    assert [t for _, t, _ in blocks("x < y <3 z")] == ["x < y <3 z"]
    assert len(blocks("<div>" * 3000 + "deep")) == 1


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    labeller = Labeller()
    labeller.p = {k: v.astype(np.float64) for k, v in labeller.p.items()}
    x, mask = padded([rng.standard_normal((n, INPUT)) for n in (5, 3)])
    x, y = x.astype(np.float64), rng.integers(0, 2, mask.shape).astype(np.float64)
    _, grad = labeller.gradient(x, mask, y)
    for name in ("fx", "fh", "fc", "bx", "bh", "bc", "o", "k"):
        at = tuple(int(rng.integers(n)) for n in labeller.p[name].shape)
        old = labeller.p[name][at]
        losses = []
        for step in (1e-4, -1e-4):
            labeller.p[name][at] = old + step
            losses.append(labeller.gradient(x, mask, y)[0])
        labeller.p[name][at] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - grad[name][at]) < 1e-4


def test_held_out_pages_and_other_names(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", page(k, 3 + k % 5)[0], k) for k in range(60)], "page_id long, url string, html string, id int")
    labeller = fit(pages)
    got = extract_all([page(k)[0] for k in range(100, 140)], labeller, Vectors())
    assert sum(g == page(k)[1] for k, g in zip(range(100, 140), got, strict=True)) >= 39
    other = extract_all([page(k, 5, "div content")[0] for k in range(200, 230)], labeller, Vectors())
    assert sum(g == page(k, 5)[1] for k, g in zip(range(200, 230), other, strict=True)) >= 27
    long_html, long_text = page(300, 3000)
    assert extract_all([long_html], labeller, Vectors())[0] == long_text
    rows = extract_pages(pages, labeller).collect()
    assert sum(r.text == page(r.id, 3 + r.id % 5)[1] and r.n_chars == len(r.text) for r in rows) >= 59


def test_edge_cases(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "u", "<p>a&nbsp;b</p><nav>c</nav>", "x")], "page_id long, url string, html string, text string")
    assert fit(pages.where("page_id = 1")) is None and train(["<p>no names</p>"]) is None
    got = {(r.id, r.url, r.text, r.n_chars) for r in extract_pages(pages, None).collect()}
    assert got == {(1, None, "", 0), (2, "u", "", 0), (None, "u", "a b", 3)}
    assert extract_pages(pages.limit(0), None).count() == 0
    found = blocks(page(1)[0])
    more, marks = changed(found, own_labels(found), np.random.default_rng(0))
    assert len(more) == len(marks) and marks.sum() == own_labels(found).sum()


def test_all_words_of_a_block_count():
    opening = " ".join(WORDS * 2)
    a, b = Vectors().of([(("p",), f"{opening} subscribe now", 0.0), (("p",), f"{opening} subscribe nox", 0.0)])
    assert (a != b).any()


def test_a_block_sees_the_whole_page():
    labeller, vectors, seen = Labeller(), Vectors(), []
    scores = labeller.scores
    labeller.scores = lambda x, mask: seen.append(mask.sum(axis=0).tolist()) or scores(x, mask)
    pages = [[(("p",), f"{k} {n}", 0.0) for k in range(n)] for n in (3, 0, 2000, 70_000, 5)]
    got = labeller.main_text(pages, vectors)
    assert sorted(n for part in seen for n in part) == [3, 5, 2000, 70_000] and seen[-1] == [70_000]
    for found, marks in zip(pages, got, strict=True):
        assert len(found) == len(marks)
    x, mask = padded([vectors.of(pages[2])])
    assert ((scores(x, mask)[:, 0] >= 0) == got[2]).all()


def texts(html):
    return [t for _, t, _ in blocks(html)]


def test_quotes_count_only_where_a_value_begins():
    assert texts("<article><a href=/o'brien>O</a> text one<p>two</p></article>") == ["O text one", "two"]
    assert texts("<p title=don't>Hello one</p><p>World two</p>") == ["Hello one", "World two"]
    assert texts('<p ">quoted</p><p>next</p>') == ["quoted", "next"]
    assert texts("""<p a = 'x>y' b="1 > 0">z</p><a href=x/>link</a> on<p/>para""") == ["z", "link on", "para"]
    (path, _, _), = blocks("""<p id=a'b class="c d" title='e'>q""")
    assert [*path] == ["p a'b c d"]


def test_omitted_tags_and_contents_that_stay():
    assert texts("<html><head><title>t</title><article><p>body text</p></article></html>") == ["body text"]
    assert texts("<head><title>t</title>Hello <p>x") == ["Hello", "x"] and texts("<head><noscript><style>y</style></noscript></head>z") == ["z"]
    assert texts("<p>a <select><option>x<option>y<p>rest</p><p>more") == ["a", "rest", "more"]
    assert texts("<article>a <math><mi>x</mi><mo>=</mo></math> b<noscript>n</noscript><object>o</object><svg><path d='m'/><text>s</text></svg></article>") == ["a x= b", "n", "os"]
    assert texts("<template><p>a</p></template><textarea><p>b</textarea><iframe><p>c</iframe>d") == ["d"]
    assert texts("<body>a<body>b</p>c</div>d") == ["ab", "c", "d"]


def test_time_is_linear_in_depth_and_in_odd_tags():
    import time

    start = time.perf_counter()
    found = blocks("".join(f"<div class=c>t{k}" for k in range(20_000)))
    vectors = Vectors().of(found)
    for odd in ("<div>" * 20_000 + "</x>" * 20_000 + "<body>" * 20_000, "<p " + "= " * 200_000 + ">x", '<p a="' * 100_000, "<" * 200_000, "<p" * 100_000, "<a b='" * 50_000):
        blocks(odd)
    assert len(found) == len(vectors) == 20_000 and time.perf_counter() - start < 20


def test_path_vectors_equal_plain_sums():
    labels, vectors = [f"{n} c{k % 3}" for k, n in enumerate("html body div main section p".split())], Vectors()
    for n in range(len(labels) + 1):
        got = Vectors().of([(tuple(labels[:n]), "word", 0.0)])[0, :48]
        want = sum((max(0.4, 1 - 0.15 * depth) * vectors.labels[label] for depth, label in enumerate(reversed(labels[:n]))), np.zeros(48))
        assert np.allclose(got, want, atol=1e-5)


#: Hand-labelled pages whose names mislead: blocks of main text are marked with 1.
MISLEADING = [
    [(1, "<div class=widget><h1>Orbits in winter</h1>"), (1, "<p>The array turns with the season, and the relay keeps the charge of the station even, as engineers found last year.</p></div>"), (0, "<div class=post><a href=/>Home</a></div>")],
    [(0, "<div class='main-content'><a href=/a>Start</a></div>"), (1, "<div class=c2><p>Power fell by a third during the pass, which the crew had expected, and rose again before the window closed.</p></div>"), (0, "<div class=c3><a href=/x>Imprint</a></div>")],
    [(1, "<section class=comments-off><p>A second sensor was placed on the outer panel, so that both frames could be compared for a week.</p></section>"), (0, "<div class=story><a href=/1>More stories</a></div>")],
    [(1, "<div id=banner-story><p>Thermal noise was lower than in the model, and nobody could say why until the relay was opened.</p></div>"), (0, "<div class=entry><a href=/login>Sign in</a></div>")],
    [(0, "<div class=article-list><a href=/1>One</a></div>"), (1, "<div class=z><p>Signals from the far side reach the station late, since the window is short and the array looks away.</p></div>")],
    [(1, "<div class=social-history><p>The first crews slept in shifts, as the frame had room for two, and wrote letters that came home months later.</p></div>"), (0, "<div class=body-text><a href=/s>Share</a></div>")],
]


def test_misleading_names(spark):
    """What the network does where names mislead it: the share of blocks labelled as by hand."""
    labeller = train([page(k, 3 + k % 5)[0] for k in range(60)])
    hits = [keep == bool(mark) for case in MISLEADING for keep, (mark, _) in zip(labeller.main_text([blocks("<body>" + "".join(h for _, h in case))], Vectors())[0], case, strict=True)]
    print("labelled as by hand:", sum(hits), "of", len(hits))
    # Names weigh more than form: most of these are labelled as their names say, which the README tells.
    assert len(hits) == sum(map(len, MISLEADING)) and sum(hits) >= 5


def test_the_sample_is_of_different_pages_however_they_are_dealt(spark, monkeypatch):
    from seriesmill.llm import html_blocks

    rows = [(k, f"<p>{k}") for k in range(40)] + [(7, "<p>7")] * 300 + [(1, None), (None, "<p>n")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    for size in (5, 30, 1000):
        monkeypatch.setattr(html_blocks, "SAMPLE", size)
        got = html_blocks.sampled(pages, "page_id", "html")
        assert len(got) == len(set(got)) == min(size, 41) and got == html_blocks.sampled(pages.repartition(7), "page_id", "html")
    assert html_blocks.sampled(pages.limit(0), "page_id", "html") == []
