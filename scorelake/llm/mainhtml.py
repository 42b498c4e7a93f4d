"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score above zero and tags below, by weights
learned from pages whose article is marked; words in places that marked articles never
hold score nothing. One linear scan finds the run with the largest sum; it is widened to
whole blocks, and blocks in menus, forms and the like inside it are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the marked pages that the weights are learned from.
SAMPLE_PAGES = 2000
#: Bounds of the weights, and the weights of what marked pages never show.
MOST, UNSEEN_WORD, UNSEEN_TAG = 6.0, 1.0, -0.1

#: Fixed values of HTML: elements that start a new block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never the article.
ASIDE = frozenset(
    "applet aside audio button canvas datalist dialog footer form frameset head iframe input menu nav noscript object "
    "option select svg textarea title video".split()
)
#: Whole class and role tokens that mark what is not the article. As a part of a longer token, or in an id (often a
#: slug of a title), they only make a place doubtful: its words and tags have learned weights of their own.
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising advertisements adsense adbox banner bar breadcrumb breadcrumbs byline "
    "comment comments commentlist consent cookie cookies copyright disqus footer gdpr header legal login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "related recommended reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets alert alerts contentinfo complementary form".split()
)
#: Elements that hold the page or the article; only a name of reader comments sets them aside.
NEVER_ASIDE = frozenset("html body article main".split())
COMMENT_NAMES = frozenset("comment comments reply replies".split())
#: Elements that an opening tag of the same kind ends.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th")}
_ENDS |= {"td": ("td", "th"), "th": ("td", "th")}
_HOLDERS = frozenset("ul ol dl table div section article main body nav aside footer header form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|xmp|svg(?!(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>))\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"(?<![\w:.-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ARTICLE = re.compile(r"<(article|main)\b", re.I)
_NAME_WORDS = re.compile(r"[a-z]+")


#: How sure it is that a place is not the article: no sign, a doubtful name, an element or name that says so.
PLAIN, DOUBTFUL, SET_ASIDE = 0, 1, 2


def _level(tag: str, attributes: str) -> int:
    if tag in ASIDE:
        return SET_ASIDE
    if "=" not in attributes or tag in ("html", "body"):
        return PLAIN
    listed = COMMENT_NAMES if tag in NEVER_ASIDE else ASIDE_NAMES
    level = PLAIN
    for name, a, b, c in _NAMES.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() != "id" and not listed.isdisjoint(value.split()):
            return SET_ASIDE
        if not listed.isdisjoint(_NAME_WORDS.findall(value)):
            level = DOUBTFUL
    return level if tag in BLOCKS else PLAIN  # a doubtful name splits no line


@dataclass
class Block:
    """A block's text, the parts of its words' weight, and the tags right before it."""

    kind: str
    level: int
    marked: bool
    tags: list[str]
    parts: list[str]
    words: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; tags are kept with the block that follows them or holds them."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, level, marked
    now = Block("text", PLAIN, False, [], [])

    def level_of() -> int:
        return max((level for _, level, _ in stack), default=PLAIN)

    def state() -> tuple[str, int, bool]:
        kind = next((t for t, _, _ in reversed(stack) if t in BLOCKS), "text")
        if any(t == "a" for t, _, _ in stack):
            kind = "link"
        return kind, level_of(), any(m for _, _, m in stack)

    def close_until(at: int) -> None:
        del stack[at:]

    def fresh() -> None:
        nonlocal now
        out.append(now)
        now = Block(*state(), [], [])

    for match in _TOKEN.finditer(page):
        token = match.group()
        if token[0] != "<" or token == "<":
            decoded = html.unescape(token) if "&" in token else token
            if now.words == 0 and not now.parts:
                now.kind, now.level, now.marked = state()
            elif level_of() != now.level:
                fresh()
            now.parts.append(decoded)
            now.words += len(decoded.split())
            continue
        raw = match.group(1)
        if raw or token[1] in "!?":
            if token.startswith("<![CDATA["):
                continue
            if raw:
                now.tags.append(f"{raw.lower()}|{level_of()}")
            continue
        slash, tag, attributes = match.group(2, 3, 4) if match.group(3) else match.group(5, 6, 7)
        tag = tag.lower()
        if slash:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCKS:
                fresh()
            now.tags.append(f"{tag}|{level_of()}")
            if at is not None:
                was = level_of()
                close_until(at)
                if tag not in BLOCKS and was != level_of():
                    fresh()
            continue
        if tag in BLOCKS:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if at is not None and not any(t in _HOLDERS for t, _, _ in stack[at:]):
                close_until(at)
            ended = _ENDS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    close_until(i)
                    break
                if stack[i][0] in _HOLDERS:
                    break
            fresh()
        inside = any(m for _, _, m in stack)
        level = _level(tag, attributes)
        if tag == "header" and not any(t in ("article", "main") for t, _, _ in stack):
            level = SET_ASIDE
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            if level and tag not in BLOCKS and now.parts:
                fresh()
            stack.append((tag, level, inside or tag in ("article", "main")))
        elif tag in ("br", "img", "hr"):
            now.parts.append(" ")
        now.tags.append(f"{tag}|{level_of()}")
    out.append(now)
    return [b for b in out if b.parts or b.tags]


def _word_key(block: Block) -> str:
    return f"{block.kind}|{block.level}"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for page in batch["html"]:
            if len(_ARTICLE.findall(page)) != 1:
                continue
            for block in blocks(page):
                counts["word", _word_key(block), block.marked] += block.words
                for tag in block.tags:
                    counts["tag", tag, block.marked] += 1
        rows = [(*key, n) for key, n in counts.items() if n]
        yield pd.DataFrame(rows, columns=["kind", "name", "marked", "n"])


Weights = dict[tuple[str, str], float]


def train(pages: DataFrame, text: str = "html", sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most about ``sample_pages`` pages that mark one article (taken by a hash of the page).

    What reaches the driver is one number per element name, at most 1000 of them.
    """
    rows = pages.select(F.col(text).alias("html")).where(F.col("html").rlike("(?i)<(article|main)\\b"))
    count = rows.count()
    if count > sample_pages:
        rows = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int((1 << 30) * sample_pages / count))
    sums = rows.mapInPandas(_counted, "kind string, name string, marked boolean, n long")
    sums = sums.groupBy("kind", "name").agg(
        F.coalesce(F.sum(F.when(F.col("marked"), F.col("n"))), F.lit(0)).alias("inside"),
        F.coalesce(F.sum(F.when(~F.col("marked"), F.col("n"))), F.lit(0)).alias("outside"),
    )
    weights: Weights = {}
    for r in sums.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind", "name").limit(1000).collect():
        odds = max(-MOST, min(MOST, math.log((r.inside + 1) / (r.outside + 1))))
        if r.kind == "word":
            weights["word", r.name] = max(odds, 0.0)
        else:
            weights["tag", r.name] = min(odds, 0.0) - 0.1
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """[a, b) with the largest sum above 0; the earliest and shortest of equals; (0, 0) if there is none."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """The article's blocks joined by \\n; empty if there is none."""
    if not page:
        return ""
    listed = blocks(page)
    scores: list[float] = []
    owner: list[int] = []
    for i, block in enumerate(listed):
        # a word's weight is the same all over its block, so a block's words are one step of the scan
        weight = 0.0 if block.level == SET_ASIDE else weights.get(("word", _word_key(block)), UNSEEN_WORD)
        scores.append(sum(weights.get(("tag", t), UNSEEN_TAG) for t in block.tags))
        scores.append(weight * block.words)
        owner += [i, i]
    a, b = best_run(scores)
    chosen = sorted({i for i in owner[a:b]})
    texts = [listed[i].text for i in chosen if listed[i].level != SET_ASIDE]
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame, weights: Weights, key: str = "page_id", text: str = "html") -> DataFrame:
    """Key and ``text`` of each page, with all other columns but the page itself and clashing ones left as they are.

    Null and empty pages, and pages without words outside menus and the like, give an empty
    text. Broken markup is read as far as it goes; an element that is never closed ends with
    the element around it. Rows are answered one by one, so repeated rows repeat their
    answer, and an empty table gives no rows. No shuffle.
    """
    others = [c for c in pages.columns if c not in (text, "text", "n_chars")]
    rows = pages.select(*(F.col(f"`{c}`") for c in others), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[main_text(page, weights) for page in batch["text"]])

    found = rows.mapInPandas(run, rows.schema)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
