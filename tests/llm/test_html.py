"""Pages matched with the wrapper of their host."""

import random
import re

from sparkloom.llm import html_extract


def texts(spark, rows):
    df = spark.createDataFrame([(i, f"https://{host}/{i}", page) for i, (host, page) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract_pages(df).orderBy("page_id").collect()]


def test_constant_slots_go(spark):
    plain = "<body><div><p>menu</p></div><div class=content><p>Long story %s, with much text in it.</p><p>Second part %s.</p></div><footer>f</footer>"
    # A menu that is a repeated group, in the same slots as the text.
    listed = "<body><div><p>home</p></div><div><p>about us</p></div><div><p>Story %s of its own.</p></div><div><p>all rights</p></div></body>"
    # Part of a sentence that stays the same is not a block that does.
    inline = "<body><div>site name</div><div><p>Part <b>%s</b>, and the rest of it.</p></div></body>"
    rows = [("b.example", plain % (i, i)) for i in range(6)] + [("c.example", listed % i) for i in range(6)] + [("d.example", inline % i) for i in range(6)]
    got = texts(spark, rows)
    assert got[:6] == [f"Long story {i}, with much text in it.\n\nSecond part {i}." for i in range(6)]
    assert got[6:12] == [f"Story {i} of its own." for i in range(6)]
    assert got[12:] == [f"Part {i}, and the rest of it." for i in range(6)]


def test_nothing_is_constant_without_another_page(spark):
    one = "<body><div><p>menu</p></div><div><h1>A title</h1><p>Some text.</p></div></body>"
    other = "<body><div><p>menu</p></div><div><table><tr><td>cell</td></tr></table></div></body>"
    article = "<body><div>site</div><article><h1>News</h1><p>Number %s.</p></article></body>"
    got = texts(spark, [("one.example", one)] + [("two.example", one)] * 3 + [("two.example", other), *[("three.example", article % i) for i in range(4)], ("three.example", "<body><div>site</div><p>bare</p></body>")])
    assert got[0] == "menu\n\nA title\n\nSome text."
    # Copies of a page are one page: only the menu is also on another one.
    assert got[1:4] == ["A title\n\nSome text."] * 3 and got[4] == "cell"
    # An article stays whole; a page without one is matched with its host's wrapper.
    assert got[5:] == [f"News\n\nNumber {i}." for i in range(4)] + ["bare"]


def test_long_pages_are_aligned(spark):
    deal = random.Random(1)
    frame = "<body><div>site name</div><div>%s</div><div>all rights</div></body>"
    parts = [f"<h{deal.randint(1, 6)}>x{i}" for i in range(3000)]
    long = frame % "".join(f"{p}</{p[1:3]}>" for p in parts)
    short = [frame % f"<p>Text {i}.</p>" for i in range(6)]
    assert len(html_extract.describe(long)) > 400
    wrapper = None
    for page in (short[0], long, short[1]):
        wrapper = html_extract.align(wrapper, html_extract.describe(page))
    keys = [i[0] for i in wrapper]
    assert "<p." in keys and len(keys) > 400
    got = texts(spark, [("a.example", p) for p in [*short[:3], long, *short[3:]]])
    assert got[3] == "\n\n".join(p[4:] for p in parts)
    assert got[:3] + got[4:] == [f"Text {i}." for i in range(6)]


def test_alignment_is_longest_at_any_size(monkeypatch):
    deal = random.Random(2)
    for table in (1, 20, html_extract.TABLE) * 100:
        monkeypatch.setattr(html_extract, "TABLE", table)
        a, b = (tuple(deal.choices("abcd", k=deal.randint(0, 30))) for _ in "ab")
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
            best = row
        pairs = html_extract._pairs(a, b)
        assert len(pairs) == best[-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_long_texts_are_compared(spark):
    notice = "We and our partners keep and read data on your device in order to measure how pages are used. " * 20
    # No mark tells the notice from the text, and it is far longer.
    page = "<body><div><section><p>" + notice + "</p></section></div><div><div><p>Short text %s.</p></div></div></body>"
    wrapper = None
    for i in range(4):
        wrapper = html_extract.align(wrapper, html_extract.describe(page % i))
    assert html_extract.main_element(wrapper) == "div"
    assert texts(spark, [("a.example", page % i) for i in range(4)]) == [f"Short text {i}." for i in range(4)]


def test_wrappers_decide_where_no_name_tells(spark):
    deal = random.Random(5)
    rows, want = [], []
    for i in range(60):
        body = [f"Paragraph {i} {j} " + "word " * deal.randint(1, 30) + "." for j in range(deal.randint(1, 6))]
        menu = "".join(f"<li><a>{x}</a></li>" for x in ("Home", "World", "Sport", "Weather"))
        promo = "<div><b>Read our app</b></div>" if i % 3 else ""
        rows.append(("w.example", f"<body><div><ul>{menu}</ul></div>{promo}<div><h1>Title {i}</h1>{''.join(f'<p>{x}</p>' for x in body)}</div><div><p>All rights kept</p></div></body>"))
        want.append("\n\n".join([f"Title {i}", *(x.strip() for x in body)]))
    assert texts(spark, rows) == want
    # Without the wrapper menus, adverts and notices stay.
    assert all(html_extract.extract(page, "") != w for (_, page), w in zip(rows, want, strict=True))


def test_wrappers_depend_on_the_pages_alone(spark):
    deal = random.Random(8)
    pages = []
    for i in range(700):
        parts = "".join(f"<{t}>{t}{i}</{t}>" for t in deal.choices(["p", "h2", "h3", "pre", "dl", "address"], k=deal.randint(1, 6)))
        pages.append((i, f"http://{'hot' if i % 4 else 'cold'}.example/{i}", f"<body><div><p>menu</p></div><div>{parts}</div></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    of = lambda d: sorted((r.host, html_extract.load(r.wrapper), r.main) for r in html_extract.wrappers(d).collect())
    first = of(df.coalesce(1))
    assert first == of(df.orderBy("html").repartition(7)) and [r[0] for r in first] == ["cold.example", "hot.example"]
    got = html_extract.extract_pages(df).collect()
    assert all("menu" not in r.text and str(r.page_id) in r.text for r in got) and len(got) == 700


def test_story_words_are_not_furniture(spark):
    page = "<body><div class='ad'>buy</div><article><div class='story-header'><h2>Chapter %s</h2></div><p class='share-price'>Shares fell %s.</p><div class='comment-list comments'><p>Nice</p></div><p class='adapted'>Adapted.</p></article><div class='cookie-notice'>We use cookies</div></body>"
    rows = [("s.example", page % (i, i)) for i in range(4)] + [("t.example", (page % (i, i)).replace("article", "div")) for i in range(4)]
    want = [f"Chapter {i}\n\nShares fell {i}.\n\nAdapted." for i in range(4)]
    got = texts(spark, rows)
    # Without an article, what is the same on all pages of the host goes with its wrapper.
    assert got[:4] == want and got[4:] == [w.removesuffix("\n\nAdapted.") for w in want]


def test_boxes_of_furniture(spark):
    gone = ["comment-list", "comments_section", "newsletter-form", "related-posts", "share-buttons", "site-header", "site-nav", "cookie-bar", "ad-container", "Sidebar-left"]
    kept = ["section-header", "header-text", "site-text", "form-comment", "list", "price-list", "share-price-box", "adapted-text"]
    page = "<article><h1>T</h1>%s<p>End.</p></article>"
    boxes = "".join(f'<div class="{c}"><p>{c}</p></div>' for c in gone + kept)
    assert texts(spark, [("boxes.example", page % boxes)]) == ["\n\n".join(["T", *kept, "End."])]


def test_repeats_of_any_length_are_folded():
    long = [f"<x{i}." for i in range(40)]
    items = [[k, False, None] for k in long * 5 + ["<y."] + long * 2]
    keys = html_extract._item_keys(html_extract._fold(items))
    assert keys == (("+", tuple(long)), "<y.", ("+", tuple(long)))
    deal = random.Random(3)
    for _ in range(300):
        seq = deal.choices("abc", k=deal.randint(0, 24))
        got = html_extract._item_keys(html_extract._fold([[k, False, None] for k in seq]))
        # A group stands for its stretch once or more, and no stretch beside itself is left.
        pattern = "".join(f"({spelled_group(k)})+" if isinstance(k, tuple) else k for k in got)
        assert re.fullmatch(pattern, "".join(seq))
        assert all(got[i : i + k] != got[i + k : i + 2 * k] for k in range(1, 13) for i in range(len(got) - 2 * k + 1))


def spelled_group(k):
    return "".join(f"({spelled_group(x)})+" if isinstance(x, tuple) else x for x in k[1])


def test_equally_full_elements(spark):
    page = "<body><section><p>left %s</p></section><div><p>rite %s</p></div></body>"
    made = None
    for i in range(3):
        made = html_extract.align(made, html_extract.describe(page % (i, i)))
    assert html_extract.main_element(made) == html_extract.main_element(html_extract.load(html_extract.dump(made))) == "body"
    assert texts(spark, [("e.example", page % (i, i)) for i in range(3)]) == [f"left {i}\n\nrite {i}" for i in range(3)]
