"""Main text of HTML pages by line-block distribution.

Markup is stripped into one line per block element; what is no running text (navigation, forms,
notices, comments, scripts) is left out. Text lengths less link texts are summed over sliding
windows of lines: where the sum first surges over a threshold, text begins; where it last dives
below, it ends. Parts left out bound the windows, they do not end the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3  # lines summed; as many lines of links are a list beside the text
DENSE = 40  # characters in a window of running text

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())  # content is no markup
ASIDES = frozenset(
    "nav header footer aside form menu dialog button select head template svg math object audio video canvas map fieldset".split()
)
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_PARENT = frozenset("p li dt dd option tr td th thead tbody tfoot b i em strong span a font u small big".split())
# Words in class, id or role that mark parts beside the text.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|comment-?list|replies|respond|disqus\w*|side-?bar|menu|"
    r"nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|cookies?|consent|gdpr|notice|notification|"
    r"popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|complementary|"
    r"contentinfo|search|form|skip\w*|copyright|alert|disclaimer|paywall)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


def _aside(name: str, attributes: str) -> bool:
    """Whether an element and all in it is beside the text."""
    if name in ASIDES:
        return True
    if name in ("html", "body") or name in MAIN or not attributes:
        return False
    for key, value in MARKS.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role") and MARKED.search(value):
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


OPEN, CLOSE, WALL = "open", "close", "wall"  # bounds of a main element; where a part beside the text stood
NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)


def lines(page: str) -> list[tuple[str, int, str]]:
    """(text, characters of it in links, "") of each block; ("", 0, bound) for OPEN, CLOSE and WALL."""
    out: list[tuple[str, int, str]] = []
    parts: list[str] = []
    linked: list[str] = []
    aside: list[str] = []  # open elements from the outermost aside one on
    at, in_link = 0, False

    def flat(texts: list[str]) -> str:
        text = " ".join(html.unescape("".join(texts)).split())
        texts.clear()
        return text

    def end_line():
        text, links = flat(parts), len(flat(linked))
        if text:
            out.append((text, links, ""))

    while True:
        tag = TAG.search(page, at)
        if not aside:
            parts.append(page[at : tag.start() if tag else len(page)])
            if in_link:
                linked.append(parts[-1])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing, open_only = bool(tag[1]), name in VOID or tag[3].endswith("/") and name not in BLOCKS
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a":
            # one that is never closed, or has no target, is no link
            following = None if closing else NEXT_LINK.search(page, at)
            in_link = bool(following and following[1] and re.search(r"\bhref\b", tag[3], re.I))
        if aside:
            if not closing and not open_only:
                aside.append(name)
            elif closing and name in aside:
                while aside.pop() != name:
                    pass
            elif closing and (name in MAIN or name in ("body", "html")):
                aside.clear()  # never closed inside its parent
                if name in MAIN:
                    end_line()
                    out.append(("", 0, CLOSE))
            continue
        if not closing and not open_only and _aside(name, tag[3]):
            if name in BLOCKS:
                end_line()
                out.append(("", 0, WALL))
            else:
                parts.append(" ")  # inside a line
            aside.append(name)
        elif name in MAIN:
            end_line()
            out.append(("", 0, CLOSE if closing else OPEN))
        elif name in BLOCKS:
            end_line()
        elif name in ("br", "wbr", "img"):
            parts.append(" " if name == "br" else "")
    end_line()
    return out


def dense_lines(net: list[int], window: int = WINDOW, least: int = DENSE) -> list[int]:
    """Lines with text of their own in a window whose sum reaches ``least``."""
    found = set()
    for i in range(max(1, len(net) - window + 1)):
        if sum(net[i : i + window]) >= least:
            found.update(range(i, min(i + window, len(net))))
    return [i for i in sorted(found) if net[i]]


def running_text(rows: list[tuple[str, int, str]]) -> list[str]:
    """Lines from the first surge to the last dive without lists of links; without any surge, the longest stretch."""
    text, net, stretches = [], [], [[0, 0]]
    for line, links, bound in rows:
        if bound:
            stretches.append([len(text), len(text)])
            continue
        text.append(line)
        # a line that is mostly links has no text of its own
        net.append(0 if 2 * links > len(line) else len(line) - links)
        stretches[-1][1] = len(text)
    dense = [a + i for a, b in stretches for i in dense_lines(net[a:b])]
    if not dense:
        a, b = max(stretches, key=lambda r: sum(map(len, text[r[0] : r[1]])))
        return text[a:b]
    kept, run = [], []
    for i in range(dense[0], dense[-1] + 1):
        if not net[i]:
            run.append(text[i])
            continue
        kept += run if len(run) < WINDOW else []
        run = []
        kept.append(text[i])
    return kept


def main_text(page: str | None) -> str:
    """Blocks of the article joined by line breaks; empty if the page has none.

    Where main elements exist, every line within the outermost ones counts, however short, except
    in those that are mostly links beside others that are not. Elsewhere all text counts between
    the first and the last window with enough of it, lists of links left out.
    """
    rows = lines(page or "")
    depth, regions = 0, []
    for row in rows:
        if row[2] == OPEN:
            if not depth:
                regions.append([])
            depth += 1
        elif row[2] == CLOSE:
            depth = max(0, depth - 1)
        elif depth and not row[2]:
            regions[-1].append(row)
    regions = [region for region in regions if region]
    own = [r for r in regions if 2 * sum(links for _, links, _ in r) <= sum(len(line) for line, _, _ in r)]
    if regions:
        return "\n".join(line for region in own or regions for line, _, _ in region)
    return "\n".join(running_text(rows))


def extract(column: Column) -> Column:
    """Main text of each whole page."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(x.as_py()) for x in pages], pa.string())

    return run(column)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` instead of the page source; map-only, one row for each row.

    Null or empty sources give an empty text; repeated rows repeat; an empty table stays empty; an
    existing ``text`` column is replaced.
    """
    rest = [F.col(f"`{x}`") for x in pages.columns if x not in (column, "text")]
    return pages.select(*rest, extract(F.col(f"`{column}`")).alias("text"))
