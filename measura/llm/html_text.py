"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside navigation, headers of the page, footers, sidebars, forms, scripts
and the like, by tag, role or class and id words, are no text of the article. Class words are read whole: modifiers of a page or
article ("has-sidebar", "comments-open", "share-enabled") mark nothing, and neither <body>, <main> nor a page's first <article> is ever
marked. Where a container named after its layout ("content-sidebar", a page-wide form) holds three quarters or more of the page's
dense text, the text overrules the name; containers of reader comments, notices and adverts are never overruled.

Pass one decides the others by link density, length and stop-word density: link-heavy blocks are boilerplate, longer blocks rich in
stop words are text; inside <article> a block is text whatever its words and links (a list of references is all links); inside <main> a
block without many links is text whatever its words, and a longer one rich in stop words even if it is one link. Short blocks, and longer ones poor in stop words, stay open. Pass two gives an open block the label of
its nearest decided neighbours: the same on both sides settles it; if they differ, the nearer one does, and at equal distance text wins
if the block has any stop word. A heading goes with what follows it.

Defined cases: null or empty html gives an empty text. Broken markup (tags never closed, stray ends, unbalanced quotes) is read like
browsers do: a block ends where another begins. Pages are read whole, in time linear in their length. Repeated rows get equal results.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))|<(?P<raw>script|style|noscript|template|iframe|textarea|select|canvas|title)(?=[\s/>])[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?:(?P<attr>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<>]*+>)|<[!?][^>]*>|</[^>]*>", re.S | re.I)
#: Where the content of an element ends that holds no markup.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style noscript template iframe textarea select canvas title".split()}
#: Of these, browsers read the rest of the page as their content where the end tag is missing.
TO_THE_END = frozenset("script style".split())
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that start a block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no article text.
OUTSIDE = frozenset("nav footer aside menu dialog button head".split())
#: Elements that hold others and are closed by an end tag of their own or of an outer one.
NESTING = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol section table ul figcaption button head".split())
#: Elements whose end tag may be left out, and headings; they are followed only to find where a marked one ends.
LEAVES = frozenset("p li td th dt dd h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark parts outside the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " sidebar side aside rail widget widgets footer foot bottom masthead topbar toolbar header cookie cookies consent gdpr notice notices alert popup modal"
    " overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended"
    " recommendations pagination pager search tags tagcloud legal copyright contentinfo complementary".split())
#: Those of them that name reader comments, notices, adverts and what pops up; never overruled by the text inside.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login comment comments disqus reply replies respond".split())
#: Words beside a mark that make it a property of the page, not the name of a part.
MODIFIERS = frozenset("has with without no not is are enabled disabled open opened closed active inactive allowed on off count visible layout left right".split())
#: What a header with an article's title is named after.
TITLED = frozenset("article post entry story content".split())
#: Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would"
    " their we him been has when who will no if out so what up its about into than them can only other some could these then do my any"
    " der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch"
    " wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei"
    " le la les de des du un une et est que qui dans en pour par sur au aux ce se ne pas plus avec son il elle sont mais ou nous vous leur cette été être"
    " el los las del y que en un una es por con para su al lo como más pero sus este ya o fue ha si sobre entre cuando muy sin ser también hay".split())
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Mark:
    """A container that its name puts outside the article. dense: characters of dense text in it, those of inner marks included."""

    outer: Mark | None
    never: bool  # not to be overruled
    dense: int = 0
    out: bool = True


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    outside: bool
    article: bool
    heading: bool
    mark: Mark | None = None
    label: int | None = None  # 1 text, 0 boilerplate, None open
    at: int = 0
    strict: bool = False  # inside <article>, not only <main>
    share: float | None = None

    @property
    def stop(self) -> float:
        """The share of stop words."""
        if self.share is None:
            words = WORD.findall(self.text.lower())
            self.share = sum(map(STOP.__contains__, words)) / max(1, len(words))
        return self.share

    def is_dense(self, short: int, links: float, dense: float) -> bool:
        return len(self.text) > short and self.linked <= links * len(self.text) and self.stop >= dense


def tokens(page: str) -> Iterator[tuple[re.Match, int, str | None]]:
    """Tags and comments in order: the match, where what follows begins, and the content of elements that hold no markup.

    Time is linear in the page: a missing end tag is looked for once."""
    at, missing = 0, set()
    while m := TOKEN.search(page, at):
        at, raw, content = m.end(), (m["raw"] or "").lower(), None
        if raw and raw not in missing:
            if end := RAW_END[raw].search(page, at):
                content, at = page[at:end.start()], end.end()
            else:
                missing.add(raw)
        if raw in missing and raw in TO_THE_END:
            at = len(page)
        yield m, at, content


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; ``outside`` by tags alone, ``mark`` by names."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, Mark | None]] = []  # tag, outside, article or main, article, the mark before it
    opened: Counter = Counter()  # open elements by tag
    outer = inner = strict_open = 0  # open elements that are outside, articles and <main>, and articles alone
    articles = 0
    mark: Mark | None = None
    named: dict[tuple[str, str, bool], tuple[bool, bool, bool]] = {}
    pieces: list[str] = []
    linked = link = 0
    muted = 0  # depth inside a marked <span>
    heading = False

    def close() -> None:
        nonlocal pieces, linked, heading
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, linked, outer > 0, inner > 0, heading, mark, strict=strict_open > 0))
        pieces, linked, heading = [], 0, False

    def add(data: str) -> None:
        """Text; of link text, what is left when white space is one space."""
        nonlocal linked
        pieces.append(data)
        if link:
            linked += len(" ".join(html.unescape(data).split()))

    def names(tag: str, attributes: str) -> tuple[bool, bool, bool]:
        whole = inner > 0
        if (tag, attributes, whole) not in named:
            named[tag, attributes, whole] = _named(tag, attributes, whole)
        return named[tag, attributes, whole]

    def leave(tag: str) -> None:
        nonlocal outer, inner, strict_open, mark
        last = ""
        while last != tag:
            last, outside, article, strict, mark = stack.pop()
            opened[last] -= 1
            outer, inner, strict_open = outer - outside, inner - article, strict_open - strict

    at = 0
    for m, after, _ in tokens(page):
        if m.start() > at and not muted:
            add(page[at:m.start()])
        at = after
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
        if m["end"]:
            if tag == "span" and muted:
                muted -= 1
            if tag in BLOCKS:
                close()
                link = muted = 0
            if tag == "a":
                link = 0
            if opened[tag]:
                leave(tag)
            continue
        if tag in BLOCKS:
            close()
            link, muted = 0, 0
            if stack and stack[-1][0] in LEAVES and _ends(stack[-1][0], tag):
                leave(stack[-1][0])
            heading = tag in HEADINGS
        if tag == "a":
            link = 1
        elif tag == "span":
            if muted or m["attr"] and names(tag, m["attr"])[0]:
                muted += 1
        elif tag in NESTING or tag in LEAVES:
            marked, never, named_article = names(tag, m["attr"]) if m["attr"] else (False, False, False)
            strict = tag == "article" or named_article and not marked
            article = tag in ("article", "main") or named_article and not marked
            if tag in ("body", "main") or tag == "article" and not articles:
                marked = False
            elif tag == "form":
                marked = True  # a form around the whole page is overruled by its text
            outside = tag in OUTSIDE or tag == "header" and not inner and not _titled(m["attr"])
            articles += tag == "article"
            stack.append((tag, outside, article, strict, mark))
            opened[tag] += 1
            outer, inner, strict_open = outer + outside, inner + article, strict_open + strict
            if marked:
                mark = Mark(mark, never)
    if at < len(page) and not muted:
        add(page[at:])
    close()
    return out


def _ends(leaf: str, tag: str) -> bool:
    """Whether an open leaf element ends where ``tag`` begins, as its end tag may be left out."""
    if leaf == "p":
        return True
    if leaf in ("td", "th"):
        return tag in ("td", "th", "tr", "tbody", "tfoot")
    if leaf in ("dt", "dd"):
        return tag in ("dt", "dd")
    return tag == leaf


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]


def _named(tag: str, attributes: str, inner: bool = False) -> tuple[bool, bool, bool]:
    """What an element's attributes say: it is no part of the article; no text inside overrules that; it is an article by its role.

    Headings and parts of an article (``inner``) often have ids made from titles: there an id marks only if it has no other words."""
    marked = never = article = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" and value.lower() != "false" or key == "style" and INVISIBLE.search(value) or key == "aria-hidden" and value.strip().lower() == "true":
            return True, True, False
        if key == "role" and value.strip().lower() in ("main", "article"):
            article = True
        elif key in ("class", "id", "role", "aria-label"):
            for name in value.split():
                if key == "class" and name == "hidden":
                    return True, True, False
                words = set(_words(name))
                found = words & WORDS
                if not found or words & MODIFIERS:
                    continue
                if found <= {"header", "head"} and (words & TITLED or tag in HEADINGS):
                    continue
                if words != found and (tag == "article" or tag in HEADINGS or key == "id" and inner):  # whole names only
                    continue
                marked = True
                never |= bool(found & NEVER)
    return marked, never, article


def _titled(attributes: str | None) -> bool:
    """Whether a <header> is named after the article whose title it holds."""
    return any(m[1].lower() in ("class", "id") and TITLED & set(_words(m[2] or m[3] or m[4] or "")) for m in ATTRIBUTE.finditer(attributes or ""))


def settle_marks(found: list[Block], short: int, links: float, dense: float, most: float = 0.75) -> None:
    """Blocks inside marks are outside, unless the mark may be overruled and holds ``most`` of the page's dense text."""
    marks: dict[int, Mark] = {}
    for b in found:
        m = b.mark
        while m is not None and id(m) not in marks:
            marks[id(m)] = m
            m = m.outer
    if not any(not m.never for m in marks.values()):
        for b in found:
            b.outside = b.outside or b.mark is not None
        return
    order: list[Mark] = []  # outer marks before inner ones
    depth: dict[int, int] = {}
    for m in marks.values():
        path = []
        while m is not None and id(m) not in depth:
            path.append(m)
            m = m.outer
        for x in reversed(path):
            depth[id(x)] = 1 + (depth[id(x.outer)] if x.outer else 0)
            order.append(x)
    for m in order:
        m.never |= m.outer is not None and m.outer.never
    total = 0
    for b in found:
        if not b.outside and not (b.mark and b.mark.never) and b.is_dense(short, links, dense):
            total += len(b.text)
            if b.mark:
                b.mark.dense += len(b.text)
    for m in sorted(order, key=lambda x: -depth[id(x)]):
        if m.outer:
            m.outer.dense += m.dense
    for m in order:
        m.out = m.outer is not None and m.outer.out or m.never or not m.dense or m.dense < most * total
    for b in found:
        b.outside = b.outside or b.mark is not None and b.mark.out


def label_blocks(found: list[Block], short: int = 60, links: float = 0.35, dense: float = 0.18) -> None:
    """Both passes; every block gets a label."""
    settle_marks(found, short, links, dense)
    position = 0
    for b in found:
        b.at = position
        position += len(b.text)
        if b.outside:
            b.label = 0
            continue
        density = 0.0 if b.strict else b.linked / len(b.text)
        long = len(b.text) > short
        if density > links and not b.heading:
            b.label = 1 if b.article and long and b.stop >= dense else 0
        elif b.article or long and b.stop >= dense:
            b.label = 1
        elif long and (density > 0.15 or re.search(r"©|copyright|all rights reserved|cookie", b.text, re.I)):
            b.label = 0
    decided = [k for k, b in enumerate(found) if b.label is not None]
    inner = [k for k in decided if not found[k].outside] or decided
    marked = set(inner)
    before: list[int | None] = [None] * len(found)
    last = None
    for k, b in enumerate(found):
        before[k] = last
        last = k if k in marked else last
    after, last = [None] * len(found), None
    for k in range(len(found) - 1, -1, -1):
        after[k] = last
        last = k if k in marked else last
    labels = []
    for k, b in enumerate(found):
        label = b.label
        if label is None:
            a, z = before[k], after[k]
            if a is None and z is None:
                label = 1  # nothing on the page is decided
            elif a is None or z is None:
                label = found[z if a is None else a].label
            elif found[a].label == found[z].label:
                label = found[a].label
            elif b.heading:
                label = found[z].label  # a heading belongs to what follows
            else:
                up, down = b.at - found[a].at - len(found[a].text), found[z].at - b.at - len(b.text)
                label = found[a if up < down else z].label if up != down else int(any(w in STOP for w in b.text.lower().split()))
        labels.append(label)
    for b, label in zip(found, labels):
        b.label = label


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    label_blocks(found)
    return "\n".join(b.text for b in found if b.label == 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, n in by_bytes(batch.column(2), 8 << 20):
            part = batch.slice(a, n)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["i", "u", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page."""
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    out = rows.mapInArrow(_extract, f"i {rows.schema['i'].dataType.simpleString()}, u string, text string, n_chars long")
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", "n_chars")
