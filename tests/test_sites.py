"""One pass over pages of several sites, against the extraction that builds a tree."""

import datetime as dt
import random

from newscheck.operators import extract, sites
from newscheck.operators.extract import Selector as S

RULES = {
    "a": extract.SiteRules(card=S("article", "item"), title=(S("h3", "title"), S("h2")), summary=(S("p", "lead"), S("p")), link=S("a"), date=(S("span", "date"),), container=(S("div", "body"), S("article"))),
    "b": extract.SiteRules(card=S("div"), title=(S("h2"), S("h3")), date=(S("time"),), date_attribute="datetime", container=(S("article"),), paragraph=S("p", "lead")),
    "c": extract.SiteRules(card=S("article"), title=(S("article"), S("p")), summary=(S("img"), S("b")), container=(S("section"),)),
}


def _soup(pick):
    out = []
    for _ in range(pick.randrange(60)):
        tag = pick.choice("article div h2 h3 p p span time a b img br section script ul".split())
        css = pick.choice(["", "", ' class="item"', ' class="title big"', ' class="lead"', ' class="date"', ' class="body"'])
        more = pick.choice(["", f' href="/{pick.randrange(9)}"', ' datetime="2025-1-7 8:05:09"', " href"])
        out.append(pick.choice([f"<{tag}{css}{more}>", f"<{tag}{css}{more}>", f"</{tag}>", "<!-- x -->"]))
        out.append(pick.choice(["", " ", "word ", "\n", " &amp; ", "7/1/2025, 08:05", "&nbsp", "<"]))
    return "".join(out)


def test_one_pass_equals_tree():
    pick = random.Random(6)
    full = 0
    for _ in range(3000):
        html = _soup(pick)
        for rules in RULES.values():
            root = extract._Page(html).root
            got = sites.read_page(sites.Machine(rules), "http://u", html)
            assert got["error"] is None
            assert got["cards"] == list(extract._cards(root, "http://u", rules)), html
            assert got["content"] == extract._content(root, rules), html
            full += bool(got["cards"]) and bool(got["content"])
    assert full > 100


def test_pages_of_three_sites(spark, monkeypatch):
    pages = [
        (1, "http://a/1", '<article class="item"><h3 class="title"><a href="/x">One</a></h3><p>lead</p><span class="date">Thứ ba, 7/1/2025, 08:05 (GMT+7)</span></article><div class="body"><p>first</p><p> </p><p>second', "a"),
        (2, "http://b/2", '<div><h2>Two</h2></div><article><p class="lead">text<time datetime="2025-2-3 4:05:06">then</time></article>', "b"),
        (3, "http://c/3", "<article>loose<p>Three</article>", "c"),
        (4, "http://d/4", "<p>x", "d"),
        (5, None, None, "a"),
        (6, None, None, None),
    ]
    found = sites.extract_sites(spark.createDataFrame(pages, "page_id long, url string, html string, site string"), RULES)
    rows = {r.page_id: r for r in found.collect()}
    assert rows[1].content == "first\nsecond" and rows[1].published_at == dt.datetime(2025, 1, 7, 8, 5)
    assert [tuple(c) for c in rows[1].cards] == [("One", "/x", "lead", "Thứ ba, 7/1/2025, 08:05 (GMT+7)")]
    assert rows[2].published_at == dt.datetime(2025, 2, 3, 4, 5, 6) and rows[2].cards[0].title == "Two"
    assert rows[3].cards[0].title == "Three" and rows[3].content is None and rows[3].published_at is None
    assert rows[4].error == rows[6].error == sites.UNKNOWN_SITE and rows[5].error is None
    cards = {(r.page_id, r.title): r.published_at for r in sites.card_records(found).collect()}
    assert cards == {(1, "One"): dt.datetime(2025, 1, 7, 8, 5), (2, "Two"): dt.datetime(2025, 2, 3, 4, 5, 6), (3, "Three"): None}
    monkeypatch.setattr(sites._Reader, "handle_data", lambda *a: 1 / 0)
    assert sites.read_page(sites.Machine(RULES["a"]), "u", "<p>x")["error"].startswith("ZeroDivisionError")
