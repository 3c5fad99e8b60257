"""Cards, content and date of pages of several sites, from one pass over each page.

The selectors of every site are compiled to a table by tag; a page is read once, event by
event, and what a selector matches is captured while it is open. No tree is built.
"""

from __future__ import annotations

from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newscheck.functions.dates import published_at
from newscheck.operators.extract import ENDS_PARAGRAPH, HIDDEN, VOID, Selector, SiteRules

_CARD = pa.struct([(name, pa.string()) for name in ("title", "url", "summary", "date_text")])
_FOUND = pa.struct([("cards", pa.list_(_CARD)), ("content", pa.string()), ("date_text", pa.string()), ("error", pa.string())])
_SCHEMA = "struct<cards:array<struct<title:string,url:string,summary:string,date_text:string>>,content:string,date_text:string,error:string>"
FIELDS = ("title", "summary", "date")
UNKNOWN_SITE = "no rules for this site"


class _Capture:
    """Text of an element while it is open, and what is captured inside it."""

    __slots__ = ("attributes", "link", "paragraphs", "pieces")

    def __init__(self, attributes: dict[str, str]):
        self.attributes, self.pieces = attributes, []
        self.link: _Capture | None = None
        self.paragraphs: list[_Capture] = []

    def text(self) -> str:
        return "".join(self.pieces).strip()

    def stripped_text(self) -> str:
        return "".join(p.strip() for p in self.pieces)


def _first(captured: dict[int, _Capture]) -> _Capture | None:
    """Of several selectors the first that matched anything."""
    return captured[min(captured)] if captured else None


class Machine:
    """The selectors of a site by tag: ``(class, role, number among the choices)``."""

    def __init__(self, rules: SiteRules):
        self.rules = rules
        self.by_tag: dict[str, list[tuple[str | None, str, int]]] = defaultdict(list)
        groups: dict[str, tuple[Selector, ...]] = {
            "card": (rules.card,),
            "title": rules.title,
            "summary": rules.summary,
            "date": rules.date,
            "link": (rules.link,) if rules.link else (),
            "container": rules.container,
            "paragraph": (rules.paragraph,),
        }
        for role, choices in groups.items():
            for n, choice in enumerate(choices):
                self.by_tag[choice.tag].append((choice.css_class, role, n))

    def roles(self, tag: str, attributes: dict[str, str]) -> list[tuple[str, int]]:
        found = self.by_tag.get(tag)
        if not found:
            return []
        has = attributes.get("class", "")
        return [(role, n) for wanted, role, n in found if wanted is None or wanted == has or wanted in has.split()]


class _Reader(HTMLParser):
    """One page, event by event."""

    def __init__(self, machine: Machine, html: str):
        super().__init__(convert_charrefs=True)
        self.machine = machine
        self.tags: list[str] = [""]  # open elements
        self.ends: list[list] = [[]]  # what each of them ends
        self.active: list[_Capture] = []
        self.titles: list[_Capture] = []
        self.open_cards: list[dict[str, dict[int, _Capture]]] = []
        self.open_containers: list[_Capture] = []
        self.cards: list[dict[str, dict[int, _Capture]]] = []
        self.containers: dict[int, _Capture] = {}
        self.dates: dict[int, _Capture] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end("p")
        attributes = {k: v or "" for k, v in attrs}
        ends: list[tuple[list, object]] = []

        def begin(place: list, thing: object) -> None:
            ends.append((place, thing))

        for role, n in self.machine.roles(tag, attributes):
            if role == "card":
                card: dict[str, dict[int, _Capture]] = {name: {} for name in FIELDS}
                self.cards.append(card)
                begin(self.open_cards, card)
            elif role == "container":
                if n not in self.containers:
                    self.containers[n] = _Capture(attributes)
                    begin(self.open_containers, self.containers[n])
            else:
                made = _Capture(attributes)
                used = False
                if role == "link":
                    for title in self.titles:
                        if title.link is None:
                            title.link, used = made, True
                elif role == "paragraph":
                    for container in self.open_containers:
                        container.paragraphs.append(made)
                        used = True
                else:
                    if role == "date" and n not in self.dates:
                        self.dates[n], used = made, True
                    for card in self.open_cards:
                        if n not in card[role]:
                            card[role][n], used = made, True
                    if role == "title" and used:
                        begin(self.titles, made)
                if used:
                    begin(self.active, made)
        if tag not in VOID:
            for place, thing in ends:
                place.append(thing)
            self.tags.append(tag)
            self.ends.append(ends)

    def handle_endtag(self, tag: str) -> None:
        self._end(tag)

    def handle_data(self, data: str) -> None:
        if self.active and self.tags[-1] not in HIDDEN:
            for capture in self.active:
                capture.pieces.append(data)

    def _end(self, tag: str) -> None:
        for depth in range(len(self.tags) - 1, 0, -1):
            if self.tags[depth] == tag:
                while len(self.tags) > depth:
                    self.tags.pop()
                    for place, thing in reversed(self.ends.pop()):
                        # what begins later ends earlier, so it is at the end
                        place.pop() if place[-1] is thing else place.remove(thing)
                return
            if tag == "p" and self.tags[depth] in ENDS_PARAGRAPH:
                return

    def _date(self, captured: _Capture | None) -> str | None:
        name = self.machine.rules.date_attribute
        if captured is None:
            return None
        return captured.attributes.get(name) if name else captured.stripped_text()

    def result(self, url: str | None) -> dict:
        records = []
        linked = self.machine.rules.link is not None
        for card in self.cards:
            title, summary = _first(card["title"]), _first(card["summary"])
            link = title.link if title and linked else title
            name = link.text() if link else None
            address = (link.attributes.get("href") if linked else url) if link else None
            if name and address:
                date = self._date(_first(card["date"]))
                records.append({"title": name, "url": address, "summary": summary.text() if summary else None, "date_text": date})
        container = _first(self.containers)
        texts = None if container is None else [p.stripped_text() for p in container.paragraphs]
        content = None if texts is None else "\n".join(t for t in texts if t)
        return {"cards": records, "content": content, "date_text": self._date(_first(self.dates)), "error": None}


def read_page(machine: Machine | None, url: str | None, html: str | None) -> dict:
    """What a page holds; a page that cannot be read, or is of no known site, says so and holds nothing."""
    nothing = {"cards": [], "content": None, "date_text": None}
    if machine is None:
        return {**nothing, "error": UNKNOWN_SITE}
    try:
        return _Reader(machine, html or "").result(url)
    except Exception as error:  # one bad page must not end the job
        return {**nothing, "error": f"{type(error).__name__}: {error}"}


def extract_sites(pages: DataFrame, rules: dict[str, SiteRules]) -> DataFrame:
    """``page_id, url, site, cards, content, date_text, published_at, error`` of each row of ``pages``.

    ``pages`` is ``page_id, url, html, site``; ``rules`` has the selectors by site. Cards and
    content are those of :func:`~newscheck.operators.extract.extract_cards` and
    ``extract_content`` with the site's rules; ``date_text`` is the page's first date, and
    ``published_at`` its time in either spelling. A missing page is an empty one.
    """

    @F.arrow_udf(T.StructType.fromDDL(f"found {_SCHEMA}")["found"].dataType)
    def read(site: pa.Array, url: pa.Array, html: pa.Array) -> pa.Array:
        machines = {name: Machine(r) for name, r in rules.items()}
        rows = zip(site.to_pylist(), url.to_pylist(), html.to_pylist())
        return pa.array([read_page(machines.get(s), u, h) for s, u, h in rows], _FOUND)

    found = pages.select("page_id", "url", "site", read("site", "url", "html").alias("f")).select("page_id", "url", "site", "f.*")
    return found.select("page_id", "url", "site", "cards", "content", "date_text", published_at(F.col("date_text")).alias("published_at"), "error")


def card_records(extracted: DataFrame) -> DataFrame:
    """``page_id, site, title, url, summary, published_at``: a row for each card, with its own date or else the page's."""
    cards = extracted.select("page_id", "site", F.inline("cards"), F.col("published_at").alias("page_time"))
    return cards.select("page_id", "site", "title", "url", "summary", F.coalesce(published_at(F.col("date_text")), "page_time").alias("published_at"))
