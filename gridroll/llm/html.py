"""Main text of web pages by line-block distribution.

A page is cut into lines, one a block of its layout. Markup, scripts and the
blocks that the page itself marks as surroundings (menus, headers, footers,
sidebars, adverts, notices, forms, comments) leave no text. Each line has a
length: its characters, or none if it mostly is links, or if the page marks its
article and the line lies outside it, since lengths alone cannot tell a one-line
article from a one-line footer. The lengths summed over a sliding window of
lines surge where the main text begins and dive to nothing where it ends; lines
between surge and dive are kept, and of several such runs all from the first to
the last. On every page the runs of this distribution are the result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridroll.llm.common import masked
from gridroll.llm.textvec import slices, trimmed
from gridroll.session import ship

#: Window of lines, and the window sum in characters that counts as a surge.
WINDOW, SURGE = 3, 86

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|object|svg|math|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
_NAME = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\b(?:hidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never the main text.
ASIDE = frozenset("nav aside footer form dialog menu button fieldset audio video canvas map optgroup option datalist".split())
#: Words of a class, id or role that mark surroundings, and pairs of them that do so only together.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion pagination pager "
    "widget complementary contentinfo search form copyright disclaimer skip tags trending popular".split()
)
#: Those of them that never name the layout of a whole page.
NEVER = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter related recommended recommendations comment comments commentlist reply replies respond disqus discussion".split())
#: Words of a class or id after which the rest says what a container has or lacks, not what it is.
QUALIFIERS = frozenset("has have no not non with without".split())
_MAIN = frozenset(("article", "main"))
_MAIN_ROLES = frozenset(("main", "article", "articlebody"))
#: Tags that begin the main text again although an advert or notice before them was never closed.
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th option".split())


def _names(attrs: str) -> set[str]:
    out: set[str] = set()
    for m in _NAME.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        for part in value.split():
            for w in _WORD.findall(part):
                if w.lower() in QUALIFIERS:
                    break
                out.add(w.lower())
        if m[1].lower() in ("role", "itemprop"):
            out.add("=" + value.strip().lower())
    return out


def lines(page: str, layout: bool = False) -> list[tuple[str, bool, float]]:
    """The blocks of a page in order: (text, inside a marked article, share of the text that is links). Surroundings are empty lines.

    With ``layout``, only the class words of ``NEVER`` mark surroundings.
    """
    out: list[tuple[str, bool, float]] = []
    marks = NEVER if layout else MARKS
    buf: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements: (name, opens a surrounding, opens an article)
    skip = main = anchors = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(buf)).split())
        out.append((text, main > 0, min(1.0, linked / len(text)) if text else 0.0))
        buf.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal skip, main, anchors
        while len(stack) > to:
            name, s, a = stack.pop()
            skip -= s
            main -= a
            anchors -= name == "a"

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at and not skip:
            buf.append(page[at : m.start()])
            if anchors:
                linked += m.start() - at
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            if skip:
                buf.clear()
            flush()
        if m[2]:  # an end tag closes what it names and all that was left open inside
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in _MAIN and name in INLINE | _PARAGRAPH:
                    break
            continue
        attrs = m[4] or ""
        if name in VOID or attrs.endswith("/"):
            continue
        if name in _PARAGRAPH:  # a paragraph ends the one before it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        surrounding = name in ASIDE or bool(_HIDDEN.search(attrs)) if attrs or name in ASIDE else False
        names = _names(attrs) if "=" in attrs else set()
        article = name in _MAIN or bool(names & {"=" + r for r in _MAIN_ROLES})
        if name == "header" and not main:
            surrounding = True
        if names and name not in ("html", "body", "head") and not (article and not names & {"comment", "comments", "reply"}):
            surrounding = surrounding or bool(names & marks)
        article = article and not surrounding and not skip
        if name == "a":
            anchors += 1
        stack.append((name, surrounding, article))
        skip += surrounding
        main += article
    if not skip:
        buf.append(page[at:])
    flush()
    return out


def lengths(found: list[tuple[str, bool, float]]) -> tuple[list[tuple[str, int]], bool]:
    """(text, length) of a page's lines that have text, and whether the page marks its article."""
    marked = any(inside and text for text, inside, _ in found)
    # mere tag boundaries and adverts leave no line
    return [(text, len(text) if (inside if marked else share <= 0.5) else 0) for text, inside, share in found if text], marked


def runs(length: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(highest window sum, total length, first line, line after the last) of each run from a surge to its dive.

    A run begins at the first line that has a length and ends before the first
    one from which a whole window has none.
    """
    n = len(length)
    blocks = [sum(length[i : i + window]) for i in range(n)]
    out: list[tuple[int, int, int, int]] = []
    at = 0
    while at < n:
        if not length[at]:
            at += 1
            continue
        end = at
        while end < n and blocks[end]:
            end += 1
        out.append((max(blocks[at:end]), sum(length[at:end]), at, end))
        at = end
    return out


def _body(found: list[tuple[str, bool, float]], window: int, surge: int) -> tuple[str, bool]:
    """The main text of a page's lines, and whether the page marks it. All runs of a marked article count as surging; where none surges, the longest run does (the first of equals)."""
    shown, marked = lengths(found)
    all_runs = runs([n for _, n in shown], window)
    surging = [r for r in all_runs if marked or r[0] >= surge] or sorted(all_runs, key=lambda r: (-r[1], r[2]))[:1]
    return "\n".join(text for text, n in shown[surging[0][2] : surging[-1][3]] if n) if surging else "", marked


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of a page, its blocks joined by newlines; empty for null, empty or textless pages.

    Class words that hide more text than they leave, or a marked article longer
    than what they leave, name a layout and hide nothing; only those of ``NEVER`` do.
    """
    if not page:
        return ""
    text, marked = _body(lines(page), window, surge)
    if marked:
        return text
    whole, marked = _body(lines(page, True), window, surge)
    return whole if len(whole) > len(text) * (1 if marked else 2) else text


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text`` (main text) and ``n_chars`` (its code points) to every row of ``pages``.

    A null or empty page, and one without main text, gives an empty text. All
    other columns pass through; columns already named text or n_chars are
    replaced. Rows are handled one by one, so repeated rows and empty tables
    need no care.
    """
    pages, hidden = masked(pages)
    rest = {c: h for c, h in hidden.items() if c not in ("text", "n_chars", html_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_page", 8 << 20):
                text = [main_text(x) for x in b.column("_page").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[*b.schema.names[1:], "text", "n_chars"])

    ship(pages.sparkSession)
    slim = pages.select(F.col(hidden[html_col]).cast("string").alias("_page"), *rest.values())
    schema = slim.drop("_page").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema
    return slim.mapInArrow(lambda it: trimmed(run(it)), schema).toDF(*rest, "text", "n_chars")
