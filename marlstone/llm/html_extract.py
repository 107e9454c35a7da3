"""Main text of web pages by markup and by substrings that repeat over a host.

Each page becomes a stream of blocks: runs of text between block-level tags, with the containers they stand in. The tokens of a
host's blocks are one stream; the suffixes at all its positions outside articles are grouped by their first `depth` tokens (a block with
fewer tokens is one suffix), and counted by distinct pages, which are distinct texts: mirror copies of a page are one page. A group on
`min_pages` pages and on more than `min_share` of the host's pages is a long substring repeated across distinct pages, and what it covers is boilerplate.

Markup settles what it can: scripts, styles, forms, menus, page headers and footers, sidebars, notices, adverts and reader comments (by
element, role, or a class or id that says nothing else) are boilerplate, and what stands in an article is content. In all other
blocks repetition decides: covered tokens go, unique runs stay.

Groups equal on their first tokens are what neighbours of a sorted suffix array with such a common prefix are. They are found by
aggregation instead of sorting: digests are counted in parts before the shuffle, so neither a hot host nor a hot passage makes a hot
task, and nothing about a host is collected. Longer repeats consist of overlapping ones of that length, so the same positions are covered.

Repetition alone cannot give the contract's text: adverts rotate and some hosts have one page, while articles repeat
whole paragraphs that must stay. `decide` names what decides: "both", "suffixes" alone or "markup" alone.

Defined results: a null or empty page gives an empty text. Unclosed elements end where their container ends; a truncated page
is read to its end. Null urls form one host. Repeated rows are pages of their own, with one text in the counts. Empty tables give empty
results. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import maybe_broadcast, save

DEPTH = 8
MIN_PAGES = 3
MIN_SHARE = 0.005

#: Names of HTML elements by their part in a page.
SKIPPED = frozenset("script style noscript template svg math head title iframe object select option textarea button canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class names and ids that name what is no article.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget footer masthead topbar header cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies disqus "
    "respond pagination pager toolbar search form copyright legal disclaimer".split()
)
#: Words that say nothing about what a container is.
PLAIN_WORDS = frozenset("area bar block bottom box button buttons container content fixed global group icons inner item items left link links list main outer page primary right secondary section site small sticky text top widget wrap wrapper".split())
#: Words which make a container the article itself.
CONTENT_WORDS = frozenset("article post entry story".split())
#: Within an article these name its own head.
HEADINGS = frozenset({"header"})
_CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v  -    　]+")

CONTENT, CHROME_BLOCK, UNDECIDED = 1, 0, 2


def _says(name: str, meant: frozenset) -> bool:
    """Whether a class or id consists of one of these words, and of nothing else but plain ones."""
    words = {w.lower() for w in _NAME_WORD.findall(name)}
    return bool(words & meant) and words <= meant | PLAIN_WORDS


def _marks(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is the article (of a page that has no such element)."""
    names: list[str] = []
    role = ""
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "role":
                role = value.lower()
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            elif name in ("class", "id"):
                names += value.split()
    if tag in CHROME or role in ROLES or (tag == "header" and not inside):
        return True, False
    if tag not in ("body", "html", "main", "article") and any(_says(n, CHROME_WORDS) and not (inside and _says(n, HEADINGS)) for n in names):
        return True, False
    named = any(_says(n, CONTENT_WORDS) for n in names) and tag in ("div", "section")
    return False, tag == "article" or role == "article" or named


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(class, text) of each block in page order."""
    out: list[list] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate, in article, in main
    state = (False, False, False)
    where = None

    def flush():
        nonlocal where
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append([where, text])

    def text(a: int, b: int):
        nonlocal where
        if a < b:
            where = state
            parts.append(page[a:b])

    at, n, has_article = 0, len(page), False
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCKS or not any(s[0] in BLOCKS for s in stack[k + 1 :]):
                        del stack[k:]
                    break
        elif tag in SKIPPED:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "head":
                body = re.compile(r"<body[\s>]|</head\s*>", re.I).search(page, at)
                at = body.start() if body and page[body.start() + 1] != "/" else body.end() if body else n
            elif close:
                at = close.end()
            elif tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe"):
                at = n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            bad, own, main = state if not stack else stack[-1][1:]
            state = (bad, own, main)
            more, article = _marks(tag, m[3], own or main)
            has_article |= tag == "article" and not bad
            stack.append((tag, bad or more, own or article, main or tag == "main"))
        state = stack[-1][1:] if stack else (False, False, False)
    flush()
    result = []
    for (bad, own, main), t in out:
        if bad:
            kind = CHROME_BLOCK
        elif own or main and not has_article:
            kind = CONTENT
        else:  # beside an article element nothing but its main element can hold more of it
            kind = CHROME_BLOCK if has_article and not main else UNDECIDED
        result.append((kind, t))
    return result


def suffix_keys(tokens: list[str], depth: int) -> list[int]:
    """64-bit digests of the first `depth` tokens of every suffix that has as many (of the only one, if there are fewer)."""
    if not tokens:
        return []
    heads = ("\x1f".join(tokens[i : i + depth]) for i in range(max(1, len(tokens) - depth + 1)))
    return [int.from_bytes(hashlib.blake2b(h.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for h in heads]


_BLOCK = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))


def decided(page: str, decide: str) -> list[tuple[int, str]]:
    blocks = blocks_of(page)
    if decide == "suffixes":
        return [(UNDECIDED, t) for _, t in blocks]
    if decide == "markup":
        return [(CONTENT if k == UNDECIDED else k, t) for k, t in blocks]
    return blocks


def _parser(depth: int, decide: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, pages, keys = [], [], []
            for page in b.column(3).to_pylist():
                blocks = decided(page or "", decide)
                out.append([{"kind": k, "text": t} for k, t in blocks if k != CHROME_BLOCK])
                whole = hashlib.blake2b("\n".join(t for _, t in blocks).encode("utf-8", "surrogatepass"), digest_size=8)
                pages.append(int.from_bytes(whole.digest(), "little", signed=True))
                keys.append(sorted({x for k, t in blocks if k != CONTENT for x in suffix_keys(t.split(" "), depth)}))
            cols = [*(b.column(i) for i in (0, 1, 2)), pa.array(pages, pa.int64()), pa.array(out, _BLOCK), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "page", "blocks", "keys"])

    return run


def uncovered(text: str, gone: set[int], depth: int) -> str:
    """What of a block no repeated substring covers."""
    tokens = text.split(" ")
    covered = bytearray(len(tokens))
    for i, key in enumerate(suffix_keys(tokens, depth)):
        if key in gone:
            covered[i : i + depth] = b"\x01" * len(covered[i : i + depth])
    return " ".join(t for t, c in zip(tokens, covered) if not c)


def _joined(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for blocks, drops in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                gone = set(drops or ())
                lines = [x["text"] if x["kind"] == CONTENT or not gone else uncovered(x["text"], gone, depth) for x in blocks]
                texts.append("\n".join(filter(None, lines)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame, depth: int = DEPTH, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, decide: str = "both") -> DataFrame:
    """page_id, url, text, n_chars per row of pages."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.xxhash64(host).alias("host"), "html")
    ids, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    parsed = rows.mapInArrow(_parser(depth, decide), f"page_id {ids}, url {url}, host long, page long, blocks array<struct<kind:int,text:string>>, keys array<long>")
    parsed = save(parsed.withColumn("rid", F.monotonically_increasing_id()), "page-blocks")

    total = parsed.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    counts = parsed.select("host", "page", F.explode("keys").alias("key")).distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.filter(F.col("n") >= min_pages).join(total, "host").filter(F.col("n") > min_share * F.col("pages"))
    repeated = save(repeated.select("host", "key"), "repeated-suffixes")
    # Only pages with undecided blocks meet the repeated suffixes; the texts of all others stay where they are.
    undecided = F.exists("blocks", lambda x: x["kind"] == UNDECIDED)
    open_ = parsed.filter(undecided)
    hits = open_.select("rid", "host", F.explode("keys").alias("key")).join(maybe_broadcast(repeated, 500_000), ["host", "key"])
    hits = hits.groupBy("rid").agg(F.collect_list("key").alias("drops"))
    closed = parsed.filter(~undecided).select("page_id", "url", "blocks", F.lit(None).cast("array<long>").alias("drops"))
    out = closed.unionByName(open_.join(hits, "rid", "left").select("page_id", "url", "blocks", "drops"))
    return out.mapInArrow(_joined(depth), f"page_id {ids}, url {url}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
