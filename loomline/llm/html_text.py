"""HTML extraction (2): parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser streams its events into *blocks*: runs of inline
text between block-level tags, the "lines" whose ratio of text to tags is taken.
Ratios are smoothed with a Gaussian over neighbouring blocks and clustered by a
threshold, a share of their standard deviation, which leaves the regions dense
in text. Text inside elements that are never content (navigation, header,
footer, aside, forms, scripts, styles, comments, notices, adverts by their class,
id or role) is left out as its events come. Inside an ``article`` or ``main``
element every text block is content; the clusters choose among the other blocks
of pages that have neither.

A map over rows: nothing is shuffled, memory is one page. Defined results: null
or empty html, or html without text, gives an empty text; unclosed and stray tags
are taken as browsers do for the elements named here; very long pages are read
whole; repeated rows are treated each for itself.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# HTML element names.
BLOCKS = frozenset((
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe "
    "legend li main menu nav ol option p pre search section select summary table tbody td tfoot th "
    "thead title tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset((
    "script style noscript template head title nav header footer aside form button select textarea "
    "option iframe object svg canvas dialog menu audio video map label input").split())
ENDS_P = BLOCKS - {"br", "body", "html", "head", "option"}
# Words in class, id, role or aria-label that mark what is not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|"
    r"modal|overlay|newsletter|subscribe|signup|sidebar|side-bar|aside|widget|related|recommend\w*|"
    r"menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|share|sharing|social|"
    r"comments?|comment-?list|disqus|replies|reply|respond|footer|masthead|site-?header|page-?header|skip|"
    r"login|search|complementary|contentinfo|alert|hidden)(?:$|[\s_-])", re.I)
WHITE = re.compile(r"\s+")


class Blocks(HTMLParser):
    """Collects ``(text, tags, in_article)`` per block from the parser's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []  # element, skipped, article
        # Where elements of each name are open, and where blocks are, so that no tag walks the stack.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.block_places: list[int] = []
        self.words: list[str] = []
        self.tags = 0
        self.skipping = 0
        self.articles = 0

    def close_block(self) -> None:
        text = WHITE.sub(" ", "".join(self.words)).strip()
        if text:
            self.found.append((text, self.tags, self.articles > 0))
            self.tags = 0
        self.words.clear()

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            tag, skipped, article = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()
            self.skipping -= skipped
            self.articles -= article

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.close_block()
            if tag in ENDS_P:
                self.end_open(("p",), stop=("table", "button", "article", "section", "td"))
            if tag in ("li", "dd", "dt", "td", "th", "tr"):
                same = ("dd", "dt") if tag in ("dd", "dt") else (
                    ("td", "th") if tag in ("td", "th") else (tag,))
                self.end_open(same, stop=("ul", "ol", "dl", "table", "menu"))
        if tag == "body":
            self.end_open(("head",), stop=())
        if tag in VOID:
            return
        inside = self.articles > 0
        skipped = tag in SKIPPED and not (tag == "header" and inside)
        if not skipped and tag not in ("html", "body", "article", "main"):
            for name, value in attrs:
                if value and name in ("class", "id", "role", "aria-label") and NOISE.search(value):
                    skipped = True
                elif name == "hidden" or name == "aria-hidden" and value == "true" or (
                        name == "style" and value and "display:none" in value.replace(" ", "")):
                    skipped = True
        article = tag in ("article", "main") and not self.skipping
        self.places[tag].append(len(self.open))
        if tag in BLOCKS:
            self.block_places.append(len(self.open))
        self.open.append((tag, skipped, article))
        self.skipping += skipped
        self.articles += article

    def last(self, *tags: str) -> int:
        """Where the innermost open element of these is, or -1."""
        return max(self.places[t][-1] if self.places[t] else -1 for t in tags)

    def end_open(self, same: tuple[str, ...], stop: tuple[str, ...]) -> None:
        at = self.last(*same)
        if at >= 0 and (not stop or at > self.last(*stop)):
            self.pop_to(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.close_block()
        if tag not in VOID and tag not in ("svg", "path"):
            self.tags -= 1
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.close_block()
        at = self.last(tag)
        if at >= 0 and (tag in BLOCKS or not self.block_places or self.block_places[-1] < at):
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.words.append(data)


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing, renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach:hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def content_blocks(blocks: list[tuple[str, int, bool]], sigma: float = 1.0,
                   share: float = 0.5) -> list[str]:
    """The blocks of the content regions, in page order.

    Blocks whose smoothed ratio reaches the threshold are dense. If dense blocks
    lie in an article, the region is the article with its short blocks too; else
    the dense blocks are the regions.
    """
    if not blocks:
        return []
    ratios = [len(text) / max(tags, 1) for text, tags, _ in blocks]
    smoothed = smooth(ratios, sigma)
    mean = sum(smoothed) / len(smoothed)
    spread = math.sqrt(sum((v - mean) ** 2 for v in smoothed) / len(smoothed))
    least = min(share * spread, mean)
    dense = [v >= least for v in smoothed]
    # Smoothing carries a region over its borders: thin blocks at its ends are not part of it.
    for order in (range(len(dense)), range(len(dense) - 1, -1, -1)):
        border = True
        for i in order:
            if dense[i] and border and ratios[i] < least / 10:
                dense[i] = False
            else:
                border = not dense[i]
    if any(d and inside for d, (*_, inside) in zip(dense, blocks)):
        return [text for text, _, inside in blocks if inside]
    return [text for d, (text, *_) in zip(dense, blocks) if d]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    """The main text of one page; see the module."""
    if not html:
        return ""
    parser = Blocks()
    for at in range(0, len(html), 1 << 16):
        parser.feed(html[at:at + (1 << 16)])
    parser.close()
    parser.close_block()
    return "\n".join(content_blocks(parser.found, sigma, share))


def extract_text(pages: DataFrame, html_col: str = "html", sigma: float = 1.0, share: float = 0.5
                 ) -> DataFrame:
    """``pages`` with ``html`` replaced by ``text`` and ``n_chars``."""
    carried = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    slim = pages.select(*[F.col(f"`{c}`") for c in carried],
                        F.col(html_col).cast("string").alias("_html"))
    schema = slim.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), sigma, share) for h in batch.column(len(carried))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(carried))]
                + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*carried, "text", "n_chars"])

    return slim.mapInArrow(run, schema)
