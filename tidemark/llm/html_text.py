"""Main text of web pages by nearest-URL page differencing.

A page is read as text lines, one for each block element. Within a host the
pages are put in the order of their URL paths; each page is paired with the near
page whose path is most alike, the two pages' lines are aligned by a longest
common subsequence, and shared lines are deleted: what two pages of a site have
in common is not the article. Passages that articles share must stay, so inside
an article (or, without one, main) element a shared line is deleted only if it
stands at the same element path and is no prose, or if, prose or not, it recurs
at its path on at least three and on more than half of the near pages of the
host; near pages that are copies or share half of their article do not count, and table
cells stay. What differencing cannot see (menus, adverts, notices and footers
that differ from page to page) is then dropped by what its elements say they are.

Defined cases: null and empty pages give an empty text and no partner; a page
without URL, or alone on its host, has no partner and only the second step
applies; copies of a page are passed over as partners; equal paths are ordered
by page_id; broken markup (unclosed or cut-off tags, stray signs) is read as far
as it goes; very long pages are read whole; repeated rows get a row each; an
empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

NEAR = 4              # rows on either side, in path order, among which the partner is chosen
RECUR = 3             # near pages on which a line inside the article recurs at least to be the site's
PROSE_WORDS = 8       # words from which a line is prose in any element
MAX_PAIRS = 2_000_000  # equal line pairs that one chain search lists; larger alignments are halved first
RANGE_ROWS = 4000     # pages of a range of the path order
SIBLING_SHARE = 0.5   # part of the longest article's characters that another on the page has at least, else it is a teaser

#: Fixed element names.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg iframe canvas object select button textarea title head audio video map".split())
CHROME = frozenset("nav footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th".split())
PROSE = HEADINGS | CELLS | frozenset("p blockquote pre li dd dt figcaption caption".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "li", "dd", "dt"} | {"p"}
#: Fixed words in class, id or role that say an element is not the article.
CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert "
                         "popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
                         "comment comments disqus reply replies share sharing social related recommended recommendations widget toolbar login search "
                         "contentinfo complementary pagination pager skip".split())
TOP_WORDS = frozenset("header masthead topbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
#: One attribute: its name, and its value with quotes, if any.
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'/=]""")
WORD_PARTS = re.compile(r"[^a-z]+")


@dataclass
class Line:
    text: str
    article: int  # number of the outermost article element on the page, from 1; 0 outside
    main: bool
    chrome: bool
    path: tuple[str, ...]  # names of its open elements

    @property
    def block(self) -> str:
        return next((n for n in reversed(self.path) if n in BLOCKS), "")


def _all_words(token: str, words: frozenset[str]) -> bool:
    """Is a class a chrome word, or made of chrome words alone ("cookie-notice", "ad-2")?"""
    parts = [p for p in WORD_PARTS.split(token) if p]
    return bool(parts) and all(p in words for p in parts)


def _says_chrome(name: str, attrs: str, in_article: bool) -> str:
    """'' for content, 'chrome', 'top' (a heading line inside may be the article's) or
    'unseen'. Attributes are read name by name; each class counts as a whole, and an
    id or role only if it is a chrome word itself."""
    if name in UNSEEN:
        return "unseen"
    if name in CHROME:
        return "chrome"
    kind = "top" if name == "header" else ""
    if attrs and name not in ("html", "body", "main") and (name != "article" or in_article):  # a reader's comment may be an article in the article
        for key, value in ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"' ").lower()
            if name != "article" and (key == "hidden" or key == "aria-hidden" and value == "true"):
                return "chrome"
            if key == "class":
                classes = value.split()
            elif key in ("id", "role"):
                classes = [value] if value in CHROME_WORDS or value in TOP_WORDS else []
            else:
                continue
            if any(_all_words(c, CHROME_WORDS) for c in classes):
                return "chrome"
            if name != "article" and any(_all_words(c, TOP_WORDS) for c in classes):
                kind = "top"
    return kind


def lines_of(page: str | None) -> list[Line]:
    """The page's text lines in order."""
    out: list[Line] = []
    stack: list[tuple[str, str]] = []  # open elements: name, what it says
    text: list[str] = []
    articles = 0

    def end_line() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            names = [n for n, _ in stack]
            said = {s for _, s in stack}
            article = articles if "article" in names else 0
            top = "top" in said and not (article and any(n in HEADINGS for n in names))
            out.append(Line(joined, article, "main" in names, "chrome" in said or top, tuple(names)))

    def close(depth: int) -> None:
        if any(n in BLOCKS for n, _ in stack[depth:]):
            end_line()
        del stack[depth:]

    def add(piece: str) -> None:
        if piece and not any(s == "unseen" for _, s in stack):
            text.append(html.unescape(piece) if "&" in piece else piece)

    page, at = page or "", 0
    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if stack[depth][0] in ("article", "main", "td", "th") and name not in BLOCKS:
                    break  # a stray end tag closes nothing outside its part
            else:
                if name in BLOCKS:
                    end_line()
            continue
        if name in ("br", "wbr"):
            if name == "br":
                add(" ")
            continue
        if name in CLOSES_P or name in ("li", "dd", "dt"):
            same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(name, ("p",))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in same:
                    close(depth)
                    break
                if stack[depth][0] in BLOCKS and stack[depth][0] not in HEADINGS:
                    break
        if name in BLOCKS:
            end_line()
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            inside = any(n == "article" for n, _ in stack)
            articles += name == "article" and not inside
            stack.append((name, _says_chrome(name, m["attrs"], inside)))
    add(page[at:])
    end_line()
    return out


def _chain(a: list[int], b: list[int], first: int) -> set[int]:
    """Positions (from ``first``) in ``a`` of a longest common subsequence, by the longest
    chain of equal pairs."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []                 # smallest last position in b of a chain, by length
    last: list[tuple] = []               # that chain, linked
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (first + i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k], last[k] = j, link
    found, link = set(), last[-1] if last else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _row_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every beginning of ``b``,
    a bit per line of ``b``: a machine word of lines at a step."""
    bits: dict[int, int] = {}
    for j, x in enumerate(b):
        bits[x] = bits.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if u := v & bits.get(x, 0):
            v = (v + u | v - u) & full
    steps = np.unpackbits(np.frombuffer((full ^ v).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``, exact at
    every size: where too many pairs are equal to list, ``a`` is halved and ``b`` cut where the
    halves' lengths add up to most."""
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, left, right = todo.pop()
        while low < high and left < right and a[low] == b[left]:
            found.add(low)
            low, left = low + 1, left + 1
        while low < high and left < right and a[high - 1] == b[right - 1]:
            high, right = high - 1, right - 1
            found.add(high)
        if low == high or left == right:
            continue
        times = Counter(b[left:right])
        if high - low == 1 or sum(times[x] for x in a[low:high]) <= MAX_PAIRS:
            found |= _chain(a[low:high], b[left:right], low)
            continue
        middle = (low + high) // 2
        before, after = _row_lengths(a[low:middle], b[left:right]), _row_lengths(a[middle:high][::-1], b[left:right][::-1])[::-1]
        cut = left + int((before + after).argmax())
        todo += [(low, middle, left, cut), (middle, high, cut, right)]
    return found


def _alike(a: str, b: str) -> int:
    """How much two paths share from the left, whole segments first."""
    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n].count("/") * 10_000 + n


def _partner(row: dict, near: Iterable[dict]) -> dict | None:
    """The page of the same host most alike in path that is not a copy; the earlier in order on a tie."""
    best = None
    for other in near:
        if other["host"] == row["host"] and row["host"] and other["keys"] != row["keys"]:
            score = _alike(row["path"], other["path"])
            if best is None or score > best[0]:
                best = (score, other)
    return best[1] if best else None


def _inside(lines: list[Line]) -> list[bool]:
    """Which lines the article holds, or else the main element. Of several articles
    the longest counts, and those at least half as long; shorter ones are teasers."""
    sizes: Counter = Counter()
    for x in lines:
        if x.article and not x.chrome:
            sizes[x.article] += len(x.text)
    if not sizes:
        return [x.main and not x.chrome for x in lines]
    least = SIBLING_SHARE * max(sizes.values())
    return [x.article > 0 and not x.chrome and sizes[x.article] >= least for x in lines]


def _places(row: dict) -> dict[int, int]:
    """Hashed path and text of the lines inside, with their characters."""
    if "places" not in row:
        row["places"] = {hash((x.path, x.text)): len(x.text) for x, i in zip(row["lines"], _inside(row["lines"])) if i}
    return row["places"]


def _site_lines(row: dict, inside: list[bool], near: Iterable[dict]) -> set[int]:
    """Positions of the lines inside the article that are the site's, not the article's."""
    own = _places(row)
    others = []
    for other in near:
        if other["host"] == row["host"] and row["host"] and other["keys"] != row["keys"]:
            theirs = _places(other)
            both = own.keys() & theirs.keys()
            if 2 * sum(own[p] for p in both) < min(sum(own.values()), sum(theirs.values())):  # else nearly a copy
                others.append((other, both))
    times = Counter(p for _, both in others for p in both)
    if not times:
        return set()
    mate = _partner(row, [other for other, _ in others])
    aligned, at = shared_lines(row["keys"], mate["keys"]), _places(mate)
    found = set()
    for k, x in enumerate(row["lines"]):
        if inside[k] and (place := hash((x.path, x.text))) in times and x.block not in CELLS and not any(n in HEADINGS for n in x.path):
            prose = x.block in PROSE or len(x.text.split()) >= PROSE_WORDS
            if k in aligned and place in at and not prose or times[place] >= RECUR and 2 * times[place] > len(others):
                found.add(k)
    return found


def _finish(row: dict, partner: dict | None, near: Iterable[dict] = ()) -> tuple:
    shared = shared_lines(row["keys"], partner["keys"]) if partner else set()
    inside = _inside(row["lines"])
    bounded = any(inside)
    site = _site_lines(row, inside, near) if partner and bounded else set()
    kept, deleted = [], 0
    for k, x in enumerate(row["lines"]):
        if k in site or k in shared and not inside[k]:
            deleted += 1
        elif inside[k] or (not bounded and not x.chrome):
            kept.append(x.text)
    text = "\n".join(kept)
    return row["page_id"], row["url"], text, len(text), partner["page_id"] if partner else None, deleted


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", near: int = NEAR,
              range_rows: int = RANGE_ROWS) -> DataFrame:
    """page_id, url, text, n_chars, partner_id, n_deleted: a row per input row;
    n_deleted counts the lines that differencing against the partner and the near pages deleted."""
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"),
                        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
                        F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"(/|\.html?)$", "").alias("path"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        before: deque[dict] = deque(maxlen=near)
        ahead: deque[dict] = deque()

        def settle() -> None:
            row = ahead.popleft()
            others = [*before, *list(ahead)[:near]]
            done.append(_finish(row, _partner(row, others), others))
            before.append(row)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * 6
            done.clear()
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              names=["page_id", "url", "text", "n_chars", "partner_id", "n_deleted"])
        for b in small_batches(batches):
            for row in b.to_pylist():
                row["lines"] = lines_of(row.pop("html"))
                row["keys"] = [hash(x.text) for x in row["lines"]]
                ahead.append(row)
                if len(ahead) > near:
                    settle()
            yield batch()
        while ahead:
            settle()
        yield batch()

    # ranges of the path order, so that a host with a third of all pages is many tasks; their
    # number follows the table, whatever the session's settings, and a page at the edge of a
    # range is paired inside it
    parts = max(1, round(pages.count() / range_rows))
    ordered = rows.repartitionByRange(parts, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id", "url")
    return ordered.mapInArrow(compare, "page_id long, url string, text string, n_chars long, partner_id long, n_deleted long")
