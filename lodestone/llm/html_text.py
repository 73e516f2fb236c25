"""Main text of web pages as the maximum-scoring run of blocks.

A page is a sequence of words and tags. Words score by the log-odds of content that pages with an article element teach,
tags score below zero; the run of blocks with the greatest sum, found in one linear scan, is the content. Parts that
can never be article text (menus, forms, adverts, comments and the like, by element, role or class) score nothing and
are left out of the run.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import table

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
WORD_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "template", "iframe", "svg", "math", "object"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SECTIONS = set("nav header footer aside form section div table ul ol dl blockquote body figure".split())
#: Elements, roles and parts of class names or ids whose content is not article text.
ASIDE = set("nav footer aside form head select button dialog menu datalist canvas audio video".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar ad ads adv advert adverts advertisement advertisements advertising adsense banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login signin share sharing social "
    "related recommended recommendations comment comments respond replies disqus discussion pagination pager widget widgets toolbar skip copyright".split()
)
#: Score of a word in, or out of, the page's own article; of a word nobody labelled; least cost of a tag.
OWN, PLAIN, TAG_COST = 4.0, 1.0, -0.1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _set_aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's content is never article text."""
    if name in ASIDE or (name == "header" and not in_article):
        return True
    if not attributes.strip() or name in ("html", "body", "article", "main") and "omment" not in attributes:
        return False
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    parts = {w.lower() for k in ("class", "id") for w in WORD_PART.findall(found.get(k, ""))}
    return bool(parts & NAMES) or ("header" in parts and not in_article)


class Block:
    """Text between two block-level tags; `tags` are the names of the tags since the block before."""

    __slots__ = ("pieces", "tags", "tag", "section", "linked", "article", "aside")

    def __init__(self, pieces, tags, tag, section, linked, article, aside):
        self.pieces, self.tags, self.tag, self.section, self.linked, self.article, self.aside = pieces, tags, tag, section, linked, article, aside

    def features(self) -> tuple[str, str, str]:
        return f"in {self.tag}", f"under {self.section}", "link" if self.linked else "no link"


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Unclosed, stray and broken tags are tolerated; entities are decoded in texts only."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # name, set aside, article
    aside = article = links = 0
    pieces: list[str] = []
    tags: list[str] = []
    linked = total = 0
    tag = "body"

    def flush() -> None:
        nonlocal pieces, tags, linked, total
        if pieces:
            section = next((n for n, _, _ in reversed(open_) if n in SECTIONS and n != tag), "body")
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, tags, tag, section, 2 * linked > total, article > 0, aside > 0))
                tags = []
        pieces, linked, total = [], 0, 0

    def close(name: str) -> None:
        nonlocal aside, article
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == name:
                for _, a, b in open_[i:]:
                    aside, article = aside - a, article - b
                del open_[i:]
                return

    at, lower = 0, None
    while True:
        hit = TAG.search(page, at)
        text = page[at : hit.start() if hit else len(page)]
        if text:
            pieces.append(text)
            total += len(text)
            linked += len(text) * (links > 0)
        if not hit:
            break
        at, name = hit.end(), (hit[2] or "").lower()
        if not name:
            continue
        end = bool(hit[1])
        if name in RAW and not end:
            lower = page.lower() if lower is None else lower
            stop = lower.find("</" + name, at)
            # an element that is never closed ends at the next tag
            if stop >= 0:
                shut = page.find(">", stop)
                at = len(page) if shut < 0 else shut + 1
            elif len(lower) != len(page):
                at = len(page)
            pieces.append(" ")
            tags.append(name)
            continue
        tags.append(name)
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if end else 1))
            continue
        if name == "br":
            pieces.append(" ")
            continue
        flush()
        links = 0
        if end:
            close(name)
            tag = open_[-1][0] if open_ else "body"
            continue
        if name == "body":
            close("head")
        if name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                if open_ and open_[-1][0] == name:
                    close(name)
            own = name in ("article", "main")
            off = _set_aside(name, hit[3] or "", article > 0)
            open_.append((name, off, own))
            aside, article = aside + off, article + own
            tag = name
    flush()
    return out


def lesson(page: str) -> Counter:
    """Words and tags in and out of the article of a labelled page, by feature; nothing for other pages."""
    found = blocks(page)
    counts: Counter = Counter()
    if not any(b.article for b in found):
        return counts
    for b in found:
        n = b.pieces.count(" ") + 1
        good = b.article and not b.aside
        for f in b.features():
            counts[f, good] += n
        for t in b.tags:
            if t in INLINE or t in VOID or t in SECTIONS or t in RAW or t in ("p", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
                counts[f"tag {t}", good] += 1
    return counts


def weights_of(rows: list[tuple[str, bool, int]]) -> dict[str, float]:
    """Log-odds of content per feature, between -3 and 3."""
    counts: dict[str, list[float]] = {}
    for feature, good, n in rows:
        counts.setdefault(feature, [0.0, 0.0])[bool(good)] += n
    out = {}
    for group in ("in ", "under ", "link", "no link", "tag "):
        mine = {f: c for f, c in counts.items() if f.startswith(group)}
        bad_all, good_all = (sum(c[i] for c in (counts.values() if "link" in group else mine.values())) + 1 for i in (0, 1))
        for f, (bad, good) in mine.items():
            out[f] = max(-3.0, min(3.0, log((good + 1) / good_all) - log((bad + 1) / bad_all)))
    return out


def best_run(found: list[Block], weights: dict[str, float]) -> tuple[int, int]:
    """First and last + 1 block of the run with the greatest sum; of equal sums the earliest, and (0, 0) if none is above zero."""
    labelled = any(b.article and not b.aside for b in found)
    best, span, value, start = 0.0, (0, 0), 0.0, 0
    for i, b in enumerate(found):
        cost = sum(min(TAG_COST, weights.get(f"tag {t}", TAG_COST)) for t in b.tags)
        if value + cost <= 0:
            value, start = 0.0, i
        else:
            value += cost
        if b.aside:
            continue
        n = b.pieces.count(" ") + 1
        word = PLAIN + sum(weights.get(f, 0.0) for f in b.features()) / 3
        if labelled:
            word += OWN if b.article else -OWN - PLAIN
        value += n * word
        if value > best:
            best, span = value, (start, i + 1)
    return span


def main_text(page: str, weights: dict[str, float]) -> str:
    found = blocks(page)
    first, last = best_run(found, weights)
    return "\n".join(b.pieces for b in found[first:last] if not b.aside)


def _learn(batches_of):
    total: Counter = Counter()
    for batch in batches_of:
        for page in batch.column("html").to_pylist():
            total.update(lesson(page or ""))
    keys = list(total)
    yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([bool(k[1]) for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["feature", "good", "n"])


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Weights from all pages that mark their article; one row per feature, of a fixed set of names, reaches the driver."""
    counts = pages.select(F.col("html").cast("string")).mapInArrow(_learn, "feature string, good boolean, n long")
    known = {"in " + t for t in INLINE | SECTIONS | RAW | ASIDE} | {f"in {t}" for t in "p li td th tr h1 h2 h3 h4 h5 h6 article main dt dd pre summary details body html".split()}
    rows = counts.filter(F.col("feature").startswith("tag ") | F.col("feature").startswith("under ") | F.col("feature").contains("link") | F.col("feature").isin(sorted(known)))
    return weights_of([tuple(r) for r in rows.groupBy("feature", "good").agg(F.sum("n").alias("n")).collect()])


def _extract(weights):
    def run(batches_of):
        for batch in batches_of:
            texts = [main_text(page or "", weights) for page in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per page: page_id, url, text (empty if there is none) and n_chars, in code points.

    A null or empty page gives the empty text. Pages without an article element are cut by the learned weights alone; if no page
    has one, words count one and tags a tenth. Repeated rows give repeated results; an empty table gives none. Other columns
    are ignored. Two scans, no shuffle but for the counts.
    """
    weights = learn_weights(pages) if weights is None else weights
    rows = pages.select("page_id", F.col("url"), F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_extract(weights), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
