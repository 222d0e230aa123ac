"""Article text of web pages whose markup is too irregular for expressions.

Pages are independent, so Spark spreads them over tasks. The parser's events
drive a small state: which dropped element is open, and which of the candidate
containers. Runs of text are kept while they are seen; no tree is built, and
the runs are cut into phrases by Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import strip

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Places of a container in order of preference; the whole page comes last.
N_PLACES = 4 + len(K.ARTICLE_CLASSES) + len(K.ARTICLE_IDS)


def container_places(tag: str, given: dict[str, str]) -> list[int]:
    """The preferences an element could serve: article, main, main role, known classes, known ids, body."""
    classes = given.get("class", "").split()
    fits = [tag == "article", tag == "main", given.get("role") == "main"]
    fits += [name in classes for name in K.ARTICLE_CLASSES]
    fits += [given.get("id") == name for name in K.ARTICLE_IDS]
    return [place for place, fit in enumerate([*fits, tag == "body"]) if fit]


def is_junk(tag: str, given: dict[str, str]) -> bool:
    names = f"{given.get('class', '')}\n{given.get('id', '')}".lower()
    return tag in K.ARTICLE_BOILERPLATE or any(word in names for word in K.JUNK_NAMES)


class ArticleRuns(HTMLParser):
    """Collects runs of text by the containers that are open around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.junk_depth: int | None = None  # depth of the outermost dropped element
        self.holds: dict[int, int] = {}  # place -> depth of its open container
        self.runs: dict[int, list[str]] = {N_PLACES: []}  # by place; the page itself has the last one
        self.fresh = True  # whether a tag came since the last text

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.fresh = True
        if tag in VOID:
            return
        given = {name: value or "" for name, value in attrs}
        if self.junk_depth is None:
            if is_junk(tag, given):
                self.junk_depth = len(self.open)
            else:
                for place in container_places(tag, given):
                    if place not in self.runs:  # the first of its kind only
                        self.runs[place], self.holds[place] = [], len(self.open)
        self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.fresh = True
        if tag not in VOID and self.junk_depth is None:
            for place in container_places(tag, {name: value or "" for name, value in attrs}):
                self.runs.setdefault(place, [])

    def handle_endtag(self, tag: str) -> None:
        self.fresh = True
        if tag in self.open:
            depth = len(self.open) - 1 - self.open[::-1].index(tag)  # also closes what was left open inside
            del self.open[depth:]
            self.holds = {place: at for place, at in self.holds.items() if at < depth}
            if self.junk_depth is not None and self.junk_depth >= depth:
                self.junk_depth = None

    def handle_data(self, data: str) -> None:
        if self.junk_depth is None:
            for place in (*self.holds, N_PLACES):
                if self.fresh or not self.runs[place]:
                    self.runs[place].append(data)
                else:
                    self.runs[place][-1] += data
        self.fresh = False


def runs_of(html: str) -> list[str]:
    """Runs of text in the best container of a page."""
    parser = ArticleRuns()
    parser.feed(html or "")
    parser.close()
    return parser.runs[min(parser.runs)]


def article_text(pages: DataFrame) -> DataFrame:
    """Article text of every page (``page_id, html``), a phrase on each line."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "runs": batch["html"].map(runs_of)})

    runs = pages.select("page_id", "html").mapInPandas(collect, "page_id bigint, runs array<string>")
    pieces = F.split(F.array_join("runs", "\n"), K.LINE_BREAK + "|  ")
    return runs.select("page_id", F.array_join(F.filter(F.transform(pieces, strip), lambda x: x != ""), "\n").alias("text"))
