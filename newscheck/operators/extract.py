"""Article fields from HTML pages.

Selectors are given per site as data. Parsing runs where the pages are, batch by
batch, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of HTML: tags without an end tag, tags whose start ends an open <p>,
# and tags whose text is never shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
HIDDEN = frozenset(("script", "style"))


@dataclass(frozen=True)
class Selector:
    """A tag and, if given, a class it must have (several: the exact class text)."""

    tag: str
    css_class: str | None = None


@dataclass(frozen=True)
class SiteRules:
    """Where a site keeps its fields; of several selectors the first that matches counts.

    ``link`` is looked up inside the title element; without it the page's own url
    and the title element's text are used. ``date_attribute`` takes the date from an
    attribute instead of the text.
    """

    card: Selector
    title: tuple[Selector, ...]
    summary: tuple[Selector, ...] = ()
    date: tuple[Selector, ...] = ()
    link: Selector | None = None
    date_attribute: str | None = None
    container: tuple[Selector, ...] = ()
    paragraph: Selector = Selector("p")


class _Element:
    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def walk(self) -> Iterator[_Element | str]:
        """All below in the order of the page; without recursion, so that depth does not matter."""
        open_lists = [iter(self.children)]
        while open_lists:
            child = next(open_lists[-1], None)
            if child is None:
                open_lists.pop()
                continue
            yield child
            if isinstance(child, _Element):
                open_lists.append(iter(child.children))

    def find_all(self, wanted: Selector) -> Iterator[_Element]:
        return (e for e in self.walk() if isinstance(e, _Element) and e.matches(wanted))

    def find(self, choices: tuple[Selector, ...]) -> _Element | None:
        return next((e for c in choices for e in self.find_all(c)), None)

    def matches(self, wanted: Selector) -> bool:
        if self.tag != wanted.tag:
            return False
        has = self.attributes.get("class", "")
        return wanted.css_class is None or wanted.css_class == has or wanted.css_class in has.split()

    def text(self) -> str:
        """All text inside, outer blanks cut."""
        return "".join(t for t in self.walk() if isinstance(t, str)).strip()

    def stripped_text(self) -> str:
        """All text inside, every piece cut before joining."""
        return "".join(t.strip() for t in self.walk() if isinstance(t, str))


class _Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end("p")
        element = _Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        self._end(tag)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in HIDDEN:
            self.open[-1].children.append(data)

    def _end(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return
            if tag == "p" and self.open[depth].tag in ENDS_PARAGRAPH:
                return


def _cards(page: _Element, url: str, rules: SiteRules) -> Iterator[dict]:
    for card in page.find_all(rules.card):
        title = card.find(rules.title)
        link = title.find((rules.link,)) if title and rules.link else title
        summary, date = card.find(rules.summary), card.find(rules.date)
        if date is not None:
            name = rules.date_attribute
            date = date.attributes.get(name) if name else date.stripped_text()
        record = {
            "title": link.text() if link else None,
            "url": (link.attributes.get("href") if rules.link else url) if link else None,
            "summary": summary.text() if summary else None,
            "date_text": date,
        }
        if record["title"] and record["url"]:
            yield record


def extract_cards(pages: DataFrame, rules: SiteRules) -> DataFrame:
    """``page_id, title, url, summary, date_text``: one row per article card of a page.

    ``pages`` is ``page_id, url, html``. Cards without title or url are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "title", "url", "summary", "date_text"]
        for batch in batches:
            rows = (
                {"page_id": i, **record}
                for i, url, html in zip(batch.page_id, batch.url, batch.html)
                for record in _cards(_Page(html or "").root, url, rules)
            )
            yield pd.DataFrame(rows, columns=names)

    schema = "page_id long, title string, url string, summary string, date_text string"
    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def _content(page: _Element, rules: SiteRules) -> str | None:
    container = page.find(rules.container)
    if container is None:
        return None
    texts = (p.stripped_text() for p in container.find_all(rules.paragraph))
    return "\n".join(t for t in texts if t)


def extract_content(pages: DataFrame, rules: SiteRules) -> DataFrame:
    """``page_id, content``: the paragraphs in the article container, one per line.

    NULL where a page has no such container.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = [_content(_Page(html or "").root, rules) for html in batch.html]
            yield pd.DataFrame({"page_id": batch.page_id, "content": content})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, content string")
