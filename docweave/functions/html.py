"""Fields, structure and text of HTML pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.records import any_date
from docweave.functions.text import count_matches

_SKIP = {"script", "style", "noscript", "template", "svg"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "source", "area", "base", "col", "embed", "track", "wbr"}
_FURNITURE = {"nav", "footer", "header", "aside"}
_BLOCK = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "section", "article", "main", "pre", "blockquote"}


def title(html: str) -> Column:
    return F.btrim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), F.lit(" \n\t\r"))


def meta(html: str, *names: str) -> Column:
    """The content of the first meta element of a name or property, whatever the order of its attributes; empty where there is none."""
    out = F.lit("")
    for name in reversed(names):
        key = f"(?:name|property|itemprop)\\s*=\\s*[\"']{re.escape(name)}[\"']"
        value = "content\\s*=\\s*[\"']([^\"']*)[\"']"
        found = F.concat(F.regexp_extract(html, f"(?is)<meta\\b[^>]*{key}[^>]*{value}", 1), F.regexp_extract(html, f"(?is)<meta\\b[^>]*{value}[^>]*{key}", 1))
        out = F.when(found != "", found).otherwise(out)
    return out


def _first(*parts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.btrim(x, F.lit(" \n\t\r")), F.lit("")) for x in parts])


def linked(html: str, field: str) -> Column:
    """A text field of the first linked-data script that has it; empty where none does."""
    return F.regexp_extract(html, rf'(?is)application/ld\+json[^>]*>.*?"{field}"\s*:\s*"([^"]*)"', 1)


def best_title(html: str) -> Column:
    """Open Graph's title, else Twitter's, else Dublin Core's, else the title element, else linked data's headline; null where all are blank."""
    return _first(meta(html, "og:title"), meta(html, "twitter:title"), meta(html, "DC.title", "dc.title"), title(html), linked(html, "headline"))


def best_date(html: str) -> Column:
    """When a page was published, as TIMESTAMP: its article's time, else linked data's, else Dublin Core's; null where none can be read."""
    return F.coalesce(*[any_date(x) for x in (meta(html, "article:published_time"), linked(html, "datePublished"), meta(html, "DC.date", "dc.date", "date"))])


def page_metadata(html: str) -> list[Column]:
    """title, description, author, site, language, canonical, published, keywords of a page, as columns; null where there is none."""
    canonical = F.regexp_extract(html, r"(?is)<link\b[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*href\s*=\s*[\"']([^\"']*)[\"']", 1)
    turned = F.regexp_extract(html, r"(?is)<link\b[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*rel\s*=\s*[\"']canonical[\"']", 1)
    words = F.filter(F.transform(F.split(meta(html, "keywords", "article:tag"), ","), lambda x: F.btrim(x)), lambda x: x != "")
    return [
        best_title(html).alias("title"),
        _first(meta(html, "og:description"), meta(html, "twitter:description"), meta(html, "DC.description", "description"), linked(html, "description")).alias("description"),
        _first(meta(html, "author", "article:author"), meta(html, "DC.creator", "dc.creator"), linked(html, "author")).alias("author"),
        _first(meta(html, "og:site_name")).alias("site"),
        _first(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']([^\"']*)[\"']", 1), meta(html, "DC.language", "og:locale")).alias("language"),
        _first(canonical, turned, meta(html, "og:url")).alias("canonical"),
        best_date(html).alias("published"),
        words.alias("keywords"),
    ]


def select_first(html: str | None, selector: str, attribute: str | None = None) -> str | None:
    """The text, or an attribute, of the first element that a selector fits: tag, .class, #id, [attr], [attr=value] and their combinations."""
    m = re.fullmatch(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)", selector.strip())
    if html is None or not m or not selector.strip():
        return None
    tag = (m[1] or "*").lower()
    tests = [(p[1:-1] if p[0] == "[" else p) for p in re.findall(r"[.#][\w-]+|\[[^\]]*\]", m[2] or "")]

    def fits(name: str, attrs: dict[str, str | None]) -> bool:
        for t in tests:
            if t[0] == ".":
                ok = t[1:] in (attrs.get("class") or "").split()
            elif t[0] == "#":
                ok = attrs.get("id") == t[1:]
            else:
                key, equal, value = t.partition("=")
                ok = key in attrs and (not equal or attrs[key] == value.strip("\"'"))
            if not ok:
                return False
        return tag in ("*", name)

    class Finder(HTMLParser):
        depth, name, parts, found = 0, "", None, None

        def handle_starttag(self, name: str, attrs: list) -> None:
            if self.parts is None and fits(name, dict(attrs)):
                self.parts, self.name, self.found = [], name, dict(attrs)
                self.depth = 0 if name in _VOID else 1
            elif self.depth and name == self.name:
                self.depth += 1

        def handle_endtag(self, name: str) -> None:
            if self.depth and name == self.name:
                self.depth -= 1

        def handle_data(self, data: str) -> None:
            if self.depth:
                self.parts.append(data)

    f = Finder(convert_charrefs=True)
    f.feed(html)
    f.close()
    if f.parts is None:
        return None
    return f.found.get(attribute) if attribute else " ".join("".join(f.parts).split())


def select_column(html: str | Column, selector: str, attribute: str | None = None) -> Column:
    """select_first() as a column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([select_first(x, selector, attribute) for x in s], dtype="object")

    return run(F.col(html) if isinstance(html, str) else html)


def complexity(html: str) -> Column:
    """simple, moderate or complex, from counts in the whole page."""
    articles = count_matches(html, "(?i)<(article|main)[ >]")
    frames = count_matches(html, "(?i)<iframe[ >]")
    extras = count_matches(html, "(?i)<(nav|aside)[ >]")
    return F.when((articles > 0) & (extras + frames <= 1), "simple").when((extras > 4) | (frames > 2), "complex").otherwise("moderate")


# What pages that scripts draw have in common.
SCRIPT_MARKS = r"""id=["'](?:root|app|__next|__nuxt|svelte)["'][^>]*>\s*</|<div[^>]+data-reactroot|ng-app=|ng-version=|data-v-app|window\.__INITIAL_STATE__|window\.__NUXT__|__NEXT_DATA__|class=["'][^"']*(?:skeleton|loading-placeholder)|<noscript>[^<]*(?:enable|requires?) javascript"""


def needs_script(html: str) -> Column:
    """Whether a page seems to be drawn by scripts: a framework's mark, or over five scripts and less than 200 characters of text."""
    text = F.length(F.regexp_replace(html, "(?is)<script.*?</script>|<[^>]+>", ""))
    return F.rlike(html, F.lit("(?i)" + SCRIPT_MARKS)) | ((count_matches(html, "(?i)<script[ >]") > 5) & (text < 200))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.main: list[str] = []
        self.headings: list[tuple[int, str]] = []
        self.tables: list[list[list[str]]] = []
        self.skip = self.furniture = self.inside = 0
        self.heading: int | None = None
        self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag in _FURNITURE:
            self.furniture += 1
        elif tag in ("main", "article"):
            self.inside += 1
        if re.fullmatch("h[1-6]", tag):
            self.heading = int(tag[1])
            self.headings.append((self.heading, ""))
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
            self.cell = True
        if tag in _BLOCK:
            self._put("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _FURNITURE:
            self.furniture = max(0, self.furniture - 1)
        elif tag in ("main", "article"):
            self.inside = max(0, self.inside - 1)
        if re.fullmatch("h[1-6]", tag):
            self.heading = None
        if tag in ("td", "th"):
            self.cell = False
        if tag in _BLOCK:
            self._put("\n")

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.heading and self.headings:
            level, text = self.headings[-1]
            self.headings[-1] = (level, text + data)
        if self.cell and self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1] += data
        self._put(data)

    def _put(self, text: str) -> None:
        if self.inside and not self.skip:
            self.main.append(text)
        if not self.furniture and not self.skip:
            self.out.append(text)


def _tidy(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def read_page(html: str | None) -> dict | None:
    """Text (of main and article, else of all but navigation), headings, and tables as Markdown; null for null."""
    if html is None:
        return None
    r = _Reader()
    r.feed(html)
    r.close()
    main = _tidy(r.main)
    if len(main) <= 20:  # pages that keep their text in data
        main = "\n\n".join(t for x in linked_data(html) for t in texts_in(x)) or "\n\n".join(t for x in app_state(html) for t in texts_in(x))
    tables = ["\n".join("| " + " | ".join(" ".join(c.split()) for c in row) + " |" for row in t if row) for t in r.tables]
    return {"text": main if len(main) > 20 else _tidy(r.out), "headings": [{"level": a, "title": " ".join(b.split())} for a, b in r.headings], "tables": [t for t in tables if t]}


def page_column(html: str | Column) -> Column:
    @F.pandas_udf("struct<text:string,headings:array<struct<level:int,title:string>>,tables:array<string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            done = [read_page(x) or {"text": None, "headings": None, "tables": None} for x in s]
            yield pd.DataFrame(done, columns=["text", "headings", "tables"])

    return read(F.col(html) if isinstance(html, str) else html)


# Keys under which pages keep their text, and marks of saved pages.
TEXT_KEYS = ("articleBody", "description", "text", "content", "body")
SAVED_MARKS = ("Page saved with", "saved from url", "archive.org", "data-savepage")


def linked_data(page: str | None) -> list[dict]:
    """The objects of a page's JSON-LD scripts, graphs opened; scripts that are no JSON give nothing."""
    out: list[dict] = []
    for m in re.finditer(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>", page or ""):
        try:
            data = json.loads(m[1])
        except ValueError:
            continue
        for x in data if isinstance(data, list) else [data]:
            if isinstance(x, dict):
                out += [g for g in x["@graph"] if isinstance(g, dict)] if isinstance(x.get("@graph"), list) else [x]
    return out


def app_state(page: str | None) -> list:
    """The data of scripts that are JSON (of an application's state), other than linked data."""
    out = []
    for m in re.finditer(r"(?is)<script[^>]+application/json[^>]*>(.*?)</script>", page or ""):
        try:
            out.append(json.loads(m[1]))
        except ValueError:
            continue
    return out


def structured_text(page: dict) -> str:
    """The outline, the tables and the text of read_page(), parted by blank lines; what is empty is left out."""
    return "\n\n".join(x for x in (outline(page["headings"]), *page["tables"], page["text"]) if x)


def lists_and_code(html: str | None) -> dict | None:
    """Lists as Markdown and code blocks with their language; null for null. A list inside another is part of it."""
    if html is None:
        return None
    lists, code = [], []
    plain = lambda x: " ".join(re.sub(r"(?s)<[^>]+>", " ", x).split())
    for m in re.finditer(r"(?is)<(ul|ol)\b[^>]*>(.*?)</\1>", html):
        items = [plain(x) for x in re.findall(r"(?is)<li\b[^>]*>(.*?)(?=<li\b|</li>|$)", m[2])]
        lists.append("\n".join(f"{i}. {x}" if m[1].lower() == "ol" else f"- {x}" for i, x in enumerate([x for x in items if x], 1)))
    for m in re.finditer(r"(?is)<pre\b[^>]*>(.*?)</pre>", html):
        lang = re.search(r"(?i)class=[\"'][^\"']*(?:language|lang|highlight)-([\w+#-]+)", m[0])
        code.append({"language": lang[1] if lang else None, "code": unescape(re.sub(r"(?s)<[^>]+>", "", m[1])).strip("\n")})
    return {"lists": [x for x in lists if x], "code": code}


def article(page: str | None) -> dict | None:
    """The linked-data object that tells of an article, else the first, else null."""
    found = linked_data(page)
    kinds = ("Article", "NewsArticle", "BlogPosting", "WebPage")
    return next((x for x in found if any(k in kinds for k in ([x.get("@type")] if isinstance(x.get("@type"), str) else x.get("@type") or []))), found[0] if found else None)


def texts_in(data: object, longest_path: int = 10, shortest: int = 100) -> list[str]:
    """Long texts under the text keys of nested data, in order, to a depth."""
    if longest_path < 0:
        return []
    if isinstance(data, dict):
        own = [v for k, v in data.items() if k in TEXT_KEYS and isinstance(v, str) and len(v) > shortest]
        return own + [t for v in data.values() if not isinstance(v, str) for t in texts_in(v, longest_path - 1, shortest)]
    if isinstance(data, list):
        return [t for v in data for t in texts_in(v, longest_path - 1, shortest)]
    return []


def outline(headings: list[dict]) -> str:
    """Headings indented by level."""
    return "\n".join("  " * (h["level"] - 1) + h["title"] for h in headings)


def is_saved_page(html: str) -> Column:
    """Whether a page bears a mark of a saving tool in its first 10 000 characters."""
    head = F.substring(html, 1, 10_000)
    out = F.lit(False)
    for mark in SAVED_MARKS:
        out = out | F.contains(head, F.lit(mark))
    return out


def saved_from(html: str) -> Column:
    """The address that a saved page was taken from; empty where it does not say."""
    return F.regexp_extract(F.substring(html, 1, 10_000), r"(?i)saved from url=\(\d+\)(\S+)|url:\s*(https?://\S+)", 1)
