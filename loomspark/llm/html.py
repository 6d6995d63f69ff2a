"""Main text of web pages by two passes over their blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.ship import ship
from loomspark.llm.expressions import whole

STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can do for from had has have he her his i if in into is it its more not of on or
    our out she so that the their them there these they this to up was we were what when which who will with would you
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer es für hat
    haben ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war
    was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais ne nous ou où
    par pas plus pour qu que qui sa se ses si son sont sur tout un une vous
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy
    no nos o para pero por que se ser si sin sobre son su sus también te tiene todo un una y ya
    """.split()
)

BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
    """.split()
)
RAW = frozenset("script style title textarea noscript template iframe svg annotation select option button object noframes xmp head".split())
#: Those whose text holds no tags: without an end tag they go on to the end of the page, the others to the next block.
TEXT = frozenset("script style title textarea iframe xmp noframes".split())
VOID = frozenset("hr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article, if all its words are of these and PARTS.
MARKS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar
    navigation breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar cookie cookies consent gdpr notice notices
    alert popup modal overlay newsletter subscribe subscription signup login social share sharing comment comments
    commentlist disqus reply replies respond related recommended recommendations widget widgets search pagination
    pager copyright toolbar hidden
    """.split()
)
#: Words that stand beside marks and leave them what they are, unlike those of 'has-sidebar' or 'overflow-hidden'.
PARTS = frozenset(
    """
    site main page top bottom left right primary secondary global local mobile desktop container wrapper wrap box block
    area section list item items inner outer link links post posts article articles button buttons form bar panel unit
    slot text title head header heading col column row group js x visually user google center middle
    """.split()
)
#: Marks that count in the article's own elements too, whatever their tag.
REMARKS = frozenset("comment comments commentlist disqus reply replies respond".split())

_tag = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_attribute = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

_blocks = rf"</?(?:{'|'.join(sorted(BLOCKS | {'select', 'datalist', 'optgroup'}))})(?=[\s/>])"
_next_block = re.compile(_blocks, re.I)
_after_option = re.compile(rf"</option(?=[\s/>])[^>]*>|<option(?=[\s/>])|{_blocks}", re.I)

SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.12, 0.25
LINKED = 0.4
#: The part of a page's text that an article element must hold to be its article.
ARTICLE = 1 / 3


def _end(tag: str, html: str, at: int) -> int:
    """Where a raw element that begins before `at` ends."""
    if tag == "option":
        m = _after_option.search(html, at)
        return len(html) if not m else m.end() if m[0].lower().startswith("</option") else m.start()
    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
    if tag in TEXT or tag == "head":
        return end.end() if end else at if tag == "head" else len(html)
    stop = end.start() if end else len(html)
    again = re.compile(r"<button(?=[\s/>])", re.I).search(html, at, stop) if tag == "button" else None
    if end and not again:
        return end.end()
    block = _next_block.search(html, at, again.start() if again else stop)
    return block.start() if block else again.start() if again else len(html)


@dataclass
class Block:
    """A run of text between block tags. main: inside an article element; out: in a menu, a form, comments
    and the like; marked: below an element whose class or id marks it, wrapped: only around the article element."""

    main: bool
    out: bool
    marked: bool = False
    wrapped: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _placed_out(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is not of the article by its tag, its role or because it is hidden."""
    if tag in OUTSIDE or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _attribute.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marks(tag: str, attributes: str) -> set[str]:
    """The words of MARKS by which a class name or the id marks an element as not of the article."""
    found: set[str] = set()
    if not attributes or tag in ("html", "body"):
        return found
    marks = REMARKS if tag in ("article", "main") else MARKS
    for name, value in _attribute.findall(attributes):
        if name.lower() in ("class", "id"):
            for one in value.strip("\"'").lower().split():
                words = set(filter(None, re.split("[^a-z]+", one)))
                if words <= marks | PARTS:
                    found |= marks & words
    return found


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, with references decoded and white space made single blanks; empty ones are left out."""
    done: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, main, out, marked, wrapped
    now, at, in_link, inside = Block(False, False), 0, False, ""

    def close() -> None:
        nonlocal now, in_link
        if now.parts and (text := " ".join("".join(now.parts).split())):
            now.text = text
            done.append(now)
        now = Block(*stack[-1][1:]) if stack else Block(False, False)
        in_link = False

    def put(text: str) -> None:
        if text:
            now.parts.append(text := unescape(text))
            if in_link:
                now.linked += len(text)

    while m := _tag.search(html, at):
        put(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not ends and not m[3].endswith("/"):
                at = _end(tag, html, at)
        elif tag == "a":
            in_link = not ends
        elif tag == "br":
            put(" ")
        elif tag in BLOCKS:
            if ends:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if k is not None:
                    del stack[k:]
            else:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                _, main, out, marked, wrapped = stack[-1] if stack else ("", False, False, False, False)
                out = out or _placed_out(tag, m[3], main)
                if tag in ("article", "main") and not main:
                    main, wrapped, marked = True, marked, False
                marks = _marks(tag, m[3])
                out, marked = out or not marks.isdisjoint(REMARKS), marked or bool(marks)
                if tag not in VOID:
                    stack.append((tag, main, out, marked, wrapped))
            close()
    put(html[at:])
    close()
    return done


_letters = re.compile(r"[^\W\d_]+").findall


def stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a text; a word is a run of letters."""
    words = _letters(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _first_pass(b: Block, counts: tuple[int, int] | None, known: bool) -> bool | None:
    """Whether a block is of the article; None: it can't be told from the block alone.

    counts: its `stop_words`, None if it is short or has many links; known: the page's language has stop words.
    """
    if counts is None:
        return False if b.linked > LINKED * len(b.text) and not (b.main and len(b.text) < SHORT) else None
    found, n = counts
    least = (FEW_STOPS if len(b.text) >= LONG else MANY_STOPS) if known else 0
    return True if found >= least * n and (known or len(b.text) >= LONG) else None


def _second_pass(labels: list[bool | None]) -> list[bool]:
    """The labels, with that of the nearest decided neighbour for None; True if two are as near and differ, or none is decided."""
    near: list[list[tuple[int, bool]]] = [[] for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last: tuple[int, bool] | None = None
        for k in order:
            if last:
                near[k].append((abs(k - last[0]), last[1]))
            if labels[k] is not None:
                last = (k, labels[k])
    return [x if x is not None else min(n, key=lambda y: (y[0], not y[1]))[1] if n else True for x, n in zip(labels, near, strict=True)]


def candidates(every: list[Block]) -> list[Block]:
    """The blocks that may be of the article, by their places alone.

    What stands in menus, headers, footers, forms, comments and the like never is. An article
    element counts if it has ARTICLE of the rest, and then all outside of it goes; one in a marked
    wrapper counts if it is longer than what stands outside of marks. Marked blocks go, but if little
    is left and no long block without links, marks are not heeded.
    """
    size = lambda some: sum(len(b.text) for b in some)
    free = [b for b in every if not b.out]
    plain = [b for b in free if not b.marked and not b.wrapped]
    main, wrapped = [b for b in plain if b.main], [b for b in free if b.wrapped and not b.marked]
    if main and size(main) >= ARTICLE * size(plain):
        return main
    if size(wrapped) > size(plain):
        return wrapped
    whole = lambda b: len(b.text) >= SHORT and b.linked <= LINKED * len(b.text)
    return free if not any(map(whole, plain)) and size(plain) < ARTICLE * size(free) else plain


def main_text(html: str) -> str:
    """The article's blocks, joined by newlines.

    Of the `candidates`, two passes choose. In the first, length, link and stop-word density
    decide: a block with many links is not of the article, a long one with stop words is, a short
    one, or one without them, stays open. In the second, an open block takes the label of its
    nearest decided neighbour. In a page with few stop words of the known languages length and links decide alone.
    """
    found = candidates(blocks(html))
    counts = [stop_words(b.text) if len(b.text) >= SHORT and b.linked <= LINKED * len(b.text) else None for b in found]
    known = sum(x[0] for x in counts if x) >= FEW_STOPS * sum(x[1] for x in counts if x)
    keep = _second_pass([_first_pass(b, x, known) for b, x in zip(found, counts, strict=True)])
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (see `main_text`) and n_chars of each row of `pages` (page_id, url, html).

    Null or empty html: empty text. Null page_id or url: as it is. Repeated rows: a row each.
    Empty table: no rows. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole("html").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
