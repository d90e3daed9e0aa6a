"""Main text of web pages by template deduction over equivalence classes.

Pages of a host come from templates. Tokens (tags told apart by their path, and whole text blocks) that occur equally often on the same pages share an
occurrence vector and so an equivalence class; a vector is kept as its length and the XOR of a hash per page and count, which adds up in any order. Classes
that are frequent, have several tokens, and whose tags nest in tags of other such classes make the host's template. Text blocks in the class of its main slot, on enough
pages, are template text; what is left between tags are the slots. The main slot of a host is the
nested container with most text, articles before others, outside of menus, headers, footers, sidebars, notices, adverts, forms and comments. A page takes
the blocks below it; a page without it, or of a host without a template, takes its own best container.

Defined cases: null or empty html gives an empty text; a null url is the empty host; repeated page ids are pages of their own; unclosed and stray tags are read as browsers
do, roughly; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.tables import kept, need
from tesserine.llm.urls import host_and_path

#: Pages from which a host's repeated text blocks are template text.
TEXT_PAGES = 8
#: How many times its text an article or main element counts.
ARTICLE = 10

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea)(?=[\s/>])[^>]*>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
#: What ends the raw text after an opening tag of these; without it, it runs to the end of the page.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for tag in ("script", "style", "title", "textarea")}
#: Elements whose content is not shown, if they have an end tag; without one they hide nothing.
HIDDEN = frozenset("iframe math noscript object select svg template".split())
FOREIGN = frozenset(("math", "svg"))
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")
BLOCKS = frozenset("address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
                   "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements an opening tag ends, up to a container.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
INLINE_ROOT = frozenset("article aside body div fieldset figure footer form header html main nav ol section table td th ul".split())
ASIDE = frozenset("nav header footer aside form dialog menu button head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|comments?|commentlist|disqus|respond|repl(?:y|ies)"
    r"|cookies?|notices?|consent|alert|popup|modal|newsletter|subscribe|signup|social|share|sharing|related|recommended|widget|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
MAIN = frozenset(("article", "main"))


def blocks_of(text: str) -> tuple[list[tuple[str, bool, str]], list[str]]:
    """The text blocks of a page as (path of containers, whether in an aside, text), and the paths of its containers, once for each time they open."""
    stack: list[tuple[str, str, bool]] = [("", "", False)]  # tag, path of containers, aside
    out: list[tuple[str, bool, str]] = []
    opened: list[str] = []
    parts: list[str] = []
    hidden: list[tuple[list[str], int, int]] = []  # for each open element of HIDDEN: the parts before it, and how many blocks and containers

    def clean(pieces: list[str]) -> str:
        return SPACE.sub(" ", entities.unescape("".join(pieces))).strip(" ")

    def flush() -> None:
        if parts:
            block = clean(parts)
            parts.clear()
            if block:
                out.append((stack[-1][1], stack[-1][2], block))

    def close(i: int, ended: bool) -> None:
        """Take the elements from the i-th off the stack; the i-th has its end tag, if ``ended``."""
        while len(stack) > i:
            tag, path, aside = stack.pop()
            if tag in HIDDEN:
                before, n_out, n_opened = hidden.pop()
                if ended and len(stack) == i:
                    del out[n_out:], opened[n_opened:]
                    parts[:] = before
                elif len(out) == n_out:
                    parts[:0] = before
                elif block := clean(before):
                    out.insert(n_out, (path, aside, block))

    at = 0
    while m := TOKEN.search(text, at):
        if m.start() > at:
            parts.append(text[at:m.start()])
        at = m.end()
        if m[1] and not (m[0].endswith("/>") and any(e[0] in FOREIGN for e in stack)):
            at = RAW_END[m[1].lower()].search(text, at).end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i, ended=True)
                    break
                if stack[i][0] in MAIN and tag not in ("body", "html", "main", "article"):
                    break  # a stray end does not close an article
            continue
        if tag in VOID or tag in FOREIGN and m[4].endswith("/"):
            continue
        ends = ENDS.get(tag, frozenset()) | ({"p"} if tag in BLOCKS else set())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                close(i, ended=False)
                break
            if stack[i][0] in INLINE_ROOT or stack[i][0] in HIDDEN:
                break
        names = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[4])} if m[4] else {}
        _, path, aside = stack[-1]
        if not aside and tag not in ("html", "body"):
            label = f"{names.get('class', '')} {names.get('id', '')}"
            aside = tag in ASIDE or names.get("role", "").lower() in ASIDE_ROLES or bool(label.strip() and tag != "main" and ASIDE_NAMES.search(label))
        if tag in INLINE_ROOT:
            path = f"{path}>{'main' if names.get('role') == 'main' else tag}" + (f".{'.'.join(names['class'].split())}" if names.get("class") else "")
            opened.append(path)
        stack.append((tag, path, aside))
        if tag in HIDDEN:
            hidden.append((parts[:], len(out), len(opened)))
            parts.clear()
    if at < len(text):
        parts.append(text[at:])
    if hidden:
        flush()
        close(1, ended=False)
    flush()
    return out, opened


def _text_token(block: str) -> str:
    return "#" + xxhash.xxh3_128_hexdigest(block)


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, vector, chars): a row per page and token; the token "" stands for the page itself. ``pages`` is (page_id, host, html)."""
    schema = pa.schema([("host", pa.string()), ("token", pa.string()), ("vector", pa.int64()), ("chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for page, host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found, opened = blocks_of(text.as_py() or "")
                tokens = Counter(opened)
                chars: dict[str, int] = defaultdict(int)
                for path, aside, block in found:
                    tokens[_text_token(block)] += 1
                    if not aside:
                        chars[path] += len(block)
                tokens[""] = 1
                for token, n in tokens.items():
                    vector = xxhash.xxh3_64_intdigest(f"{page} {n}") - (1 << 63)
                    for column, value in zip(rows, (host, token, vector, chars.get(token, 0)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return pages.mapInArrow(run, "host string, token string, vector bigint, chars bigint")


def nest(tokens: list[dict]) -> tuple[str | None, list[str]]:
    """The main container of a template and its text blocks. ``tokens``: (token, n, vector, chars), of valid classes."""
    tags = {t["token"]: t["chars"] for t in tokens if t["token"] and not t["token"].startswith("#")}
    nested = {p for p in tags if p.rpartition(">")[0] in tags or not p.rpartition(">")[0]}
    inside = dict.fromkeys(nested, 0)
    for path, chars in tags.items():
        while path:
            if path in inside:
                inside[path] += chars
            path = path.rpartition(">")[0]
    score = lambda p: (inside[p] * (ARTICLE if _tag(p) in MAIN else 1), p.count(">"), p)
    best = max((p for p in inside if inside[p] and _tag(p) not in ("html", "body")), key=score, default=None)
    same = next(((t["n"], t["vector"]) for t in tokens if t["token"] == best), None)
    return best, [t["token"] for t in tokens if (t["n"], t["vector"]) == same and t["n"] >= TEXT_PAGES and t["token"].startswith("#")]


def _tag(path: str) -> str:
    return path.rpartition(">")[2].partition(".")[0]


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, texts) of each host with several pages."""
    counted = kept(occurrences(pages).groupBy("host", "token").agg(F.count("*").alias("n"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars")).where("n > 1"), "tokens")
    whole = counted.where("token = ''").select("host", F.col("n").alias("total"))
    frequent = counted.join(whole, "host").where("2 * n >= total")
    valid = frequent.groupBy("host", "n", "vector").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    # a token on half of a host's pages: at most twice as many as a page has
    per_host = frequent.join(valid, ["host", "n", "vector"]).groupBy("host").agg(F.collect_list(F.struct("token", "n", "vector", "chars")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nest(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))], names=["host", "main", "texts"])

    return per_host.mapInArrow(run, "host string, main string, texts array<string>")


def main_text(text: str, main: str | None, texts: frozenset[str]) -> str:
    """The blocks of the main slot, joined by one space."""
    found, _ = blocks_of(text)
    slots = [(path, block) for path, aside, block in found if not aside and not (texts and _text_token(block) in texts)]
    below = lambda root: [b for p, b in slots if p == root or p.startswith(root + ">")]
    got = below(main) if main else []
    if not got:
        articles = [b for p, b in slots if any(part.partition(".")[0] in MAIN for part in p.split(">"))]
        if articles:
            return " ".join(articles)
        sizes: Counter[str] = Counter()
        for path, block in slots:
            sizes[path] += len(block)
        got = below(max(sizes, key=lambda p: (sizes[p], p))) if sizes else []
    return " ".join(got)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = need(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_and_path(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html"))
    found = kept(templates(rows.select("page_id", "host", "html")), "templates")  # its size is known when the join is planned
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "main", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(h.as_py() or "", m.as_py(), frozenset(t.as_py() or ())) for h, m, t in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
