"""Operator 10, main text of web pages by nearest-URL page differencing.

A page is cut into lines (blocks of text). Pages of one host are put in order of their url path by a
distributed sort; each page is paired with the neighbour in that order that shares the longer
beginning of its path. The two pages' lines are aligned by longest common subsequence and shared
lines go, as menus and notices repeat from page to page while articles do not.

Every page is paired and differenced. Differencing alone is not right on pages that mark their article: chrome drawn
anew for each page would stay, and an article copied to a neighbouring page would go. So marked parts are
believed first: lines in elements that are chrome by tag, role or class (nav, footer, aside, form,
adverts, notices, comments, ...) go, and lines of ``<article>`` and ``<main>`` are the main text where a page marks them, but for
those its pair shows outside its own marks. A page with marks lends its pair the lines outside them, another page all its lines,
and there the differencing decides over all lines. Inside an article or main only roles and
whole classes are believed, not ids and parts of names. A form around the page or most of it is not chrome.

Null html gives an empty text, a null url an empty host and path. Repeated rows get equal texts. Unclosed
or truncated markup is read as far as it goes. An empty table gives no rows. Pages are read whole.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import with_position
from ..session import durable
from .urlrules import host_of, path_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|math|object|select)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)", re.I | re.S)
_ATTR = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody "
                   "tfoot thead tr ul".split())
_CELL = frozenset(("td", "th", "br"))
_CHROME_TAGS = frozenset("nav footer aside button dialog menu fieldset label".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: A class or id names chrome if one of its parts (split at anything but letters) is one of these.
_CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription signup login sidebar menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond replies share sharing social related "
    "recommended widget widgets toolbar pagination pager".split())
#: Parts that do not change what a class names: inside an article or main a whole class of chrome names and these is chrome.
_PLAIN_PARTS = frozenset(
    "area bar block bottom box btn button buttons container form group icons inline inner item items js left link links list panel post posts "
    "right section slot story stories thread top unit user wrap wrapper".split())
#: Elements that only a form around the page, not one on it, has inside.
_PAGE_TAGS = frozenset("article aside footer h1 header main nav".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_chrome(value: str) -> bool:
    """Of one class, that it names chrome as a whole."""
    parts = [p.lower() for p in _PART.findall(value)]
    return any(p in _CHROME_NAMES for p in parts) and all(p in _CHROME_NAMES or p in _PLAIN_PARTS for p in parts)


def _is_chrome(tag: str, attrs: str, zone: int) -> bool:
    in_article = zone == 2
    if tag in _CHROME_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for name, a, b, c, bare in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if bare or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in _CHROME_ROLES:
            return True
        if zone:        # the writer's own headings and sections are named freely
            if name == "class" and tag not in ("article", "main") and any(map(_names_chrome, value.split())):
                return True
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if any(p.lower() in _CHROME_NAMES for p in _PART.findall(value)):
                return True
    return False


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(line, zone) in page order; zone 2 in an article, 1 in main, 0 elsewhere. Chrome is left out, and so are
    forms but those that hold parts of a page or the larger part of its text."""
    lines: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, bool, int]] = []     # tag, zone, chrome, the outermost form (0: none)
    text: list[str] = []
    zone, chrome, form = 0, False, 0
    forms, around = 0, set()        # forms around a page

    def flush():
        if text:
            line = " ".join(unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append((line, zone, form))

    for m in _TOKEN.finditer(html or ""):
        raw = m.group(5)
        if raw is not None:
            if not chrome:
                text.append(raw)
            continue
        tag = m.group(3)
        if tag is None:
            continue        # comments, declarations, scripts and the like
        tag = tag.lower()
        if m.group(2):
            if any(t == tag for t, *_ in stack):
                if tag in _BLOCK:
                    flush()
                while stack.pop()[0] != tag:
                    pass
                zone, chrome, form = stack[-1][1:] if stack else (0, False, 0)
            elif tag == "p":
                flush()
            if tag in _CELL:
                text.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        elif tag in _CELL and not chrome:
            text.append(" ")
        if tag in _VOID:
            continue
        if tag in ("article", "main") and zone == 0 and next((t for t, _, c, _ in stack if c), None) in ("nav", "header"):
            while stack and stack[-1][2]:       # a menu that was never closed ends here
                stack.pop()
            zone, chrome, form = stack[-1][1:] if stack else (0, False, 0)
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            zone, chrome, form = stack[-1][1:] if stack else (0, False, 0)
        if form and not chrome and tag in _PAGE_TAGS:
            around.add(form)
        chrome = chrome or _is_chrome(tag, m.group(4), zone)
        if tag == "form" and not form:
            forms += 1
            form = forms
        if tag == "article":
            zone = 2
        elif (tag == "main" or "articleBody" in m.group(4) or re.search(r"role\s*=\s*[\"']?main\b", m.group(4))) and zone < 1:
            zone = 1
        stack.append((tag, zone, chrome, form))
    flush()
    size = [0] * (forms + 1)
    for line, _, f in lines:
        size[f] += len(line)
    around |= {f for f in range(1, forms + 1) if 2 * size[f] > sum(size)}
    return [(line, z) for line, z, f in lines if not f or f in around]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (bit-parallel rows)."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full, v, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def _hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def lent_lines(html: str | None) -> tuple[list[int], bool]:
    """Line hashes that a page lends to its pair: all, or those outside its article and main where it marks one; and whether it does."""
    lines = page_lines(html)
    marked = any(z for _, z in lines)
    return [_hash(t) for t, z in lines if not (marked and z)], marked


def main_text(html: str | None, mate: list[int], mate_marked: bool = False) -> str:
    """The main text of a page, given the line hashes that the page it is paired with lends."""
    lines = page_lines(html)
    marked = any(z for _, z in lines)
    shared = set() if marked and not mate_marked else set(common_lines([_hash(t) for t, _ in lines], mate))
    return "\n\n".join(t for i, (t, z) in enumerate(lines) if i not in shared and (z or not marked))


def _shared_path(a, b):
    """Characters two paths have in common at their beginning, by halving: equal beginnings are nested."""
    n = F.least(F.char_length(a), F.char_length(b))

    def halve(acc, _):
        mid = F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(F.greatest(mid - 1, acc["lo"])).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)      # halvings that a path of this length needs
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(b.isNull(), F.lit(-1)).otherwise(F.coalesce(found, F.lit(0)))


def extract(pages: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` columns of every page and text (empty if none)."""
    url, html = F.col(url_col), F.col(html_col)
    key = F.sha2(F.concat_ws("\x01", F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))), 256)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lent = [lent_lines(h) for h in pdf.pop("html")]
            yield pdf.assign(lines=[x for x, _ in lent], marked=[m for _, m in lent])

    # one row per distinct page
    seen = (pages.select(key.alias("key"), host_of(url).alias("host"), path_of(url).alias("path"), html.alias("html"))
            .mapInPandas(hashes, "key string, host string, path string, lines array<long>, marked boolean").dropDuplicates(["key"]))
    at = durable(with_position(seen.where("host <> ''"), "host", "path", "key", name="at"))
    side = lambda d: at.select((F.col("at") + d).alias("at"), F.col("host").alias("host2"),
                               F.col("path").alias("path2"), F.struct("lines", "marked").alias("mate"))
    near = [at.join(side(d), "at").where("host = host2").select(
        "key", "mate", _shared_path(F.col("path"), F.col("path2")).alias("n"), F.lit(d).alias("d")) for d in (1, -1)]
    mates = (near[0].unionByName(near[1]).groupBy("key").agg(F.max_by("mate", F.struct("n", "d")).alias("mate"))
             .where(F.size("mate.lines") > 0))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mates = zip(pdf.pop("__html"), pdf.pop("__mate"), pdf.pop("__marked"))
            texts = [main_text(h, [] if m is None else list(map(int, m)), m is not None and bool(marked)) for h, m, marked in mates]
            yield pdf.assign(text=texts)

    rows = (pages.select(*keep, html.alias("__html"), key.alias("key")).join(mates, "key", "left")
            .select(*keep, "__html", F.col("mate.lines").alias("__mate"), F.col("mate.marked").alias("__marked")))
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(read, f"{kept}, text string")


def op10_page_text(spark, sf_dir: str) -> DataFrame:
    """Contract of query 10 over all of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, ["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("bigint"))
