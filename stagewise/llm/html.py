"""Main text of pages by wrapper induction.

Pages become trees.  Trees of one host are aligned by simple tree matching: the ordered pairs of
like children that match the most nodes are merged, the others are inserted, and like siblings
side by side are one repeated node.  In the wrapper that results, a node whose text stays the
same on most pages is template, the others are slots.  The content is every outermost ``article``
or ``main`` of a page, whole, or else the node with the slots' text.  Every page of the host is then
read through the wrapper.

Menus, adverts, forms, comments and the like are known by element, role, and by a class or id that
as a whole says so (``side-bar`` and ``site-footer``, not ``with-sidebar``).  Names only propose: what
holds the content of a page is passed through, and inside the content a part with a doubtful name
(``related``, ``legal``) stays where its text varies over the host and is not made of links.

Which blocks are constant is counted exactly, per host, label path and text, over pages that differ
in their longest block: copies and near copies of a page are one page, so they prove nothing.  A
constant block goes, inside an article too.

A partition folds its pages into one small wrapper per host; wrappers of a host are merged in
two steps (by host and salt, then by host), so a host with a third of all pages is never
collected, and pages are not shuffled while the wrappers are small enough to broadcast.

Defined results: null, empty and malformed html give what text there is, else the empty text;
``br`` is white space; a page without a host, or on a host of one page, is read by the rules for
elements alone; rows without an id and repeated rows are read row by row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import Scratch
from stagewise.llm.urls import host_of

#: Wrappers are broadcast up to so many characters in all, and joined by a shuffle beyond.
BROADCAST_CHARS = 32 << 20
SALTS = 32
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3
SENTENCE = 8  # words
TEXTS_KEPT = 4  # frequent texts remembered per node

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>)""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")  # not the end of a bare value, as in href=/
_ATTR = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s]+))?""")

# Elements by how they end and what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary "
                  "table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROP = frozenset("script style noscript template head title nav footer aside form iframe object svg canvas button select "
                 "option textarea input dialog menu menuitem noembed noframes xmp audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CHROME = frozenset("nav navbar navigation menu menus footer sidebar aside ad ads advert adverts advertisement advertising banner promo "
                   "sponsor sponsored cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login "
                   "comment comments reply replies disqus share sharing social related recommended breadcrumb breadcrumbs "
                   "pagination pager widget toolbar masthead copyright legal hidden teaser teasers".split())
DOUBTFUL = frozenset("share related recommended copyright legal cookie banner promo widget toolbar teaser teasers notice".split())
# words that may stand beside those above in a name without changing what it says
BESIDE = frozenset("site page main global primary secondary top bottom left right upper lower side bar list lists link links item items box "
                   "block blocks wrapper wrap container inner outer slot unit area panel row col column section bin group content text "
                   "form button buttons icons icon trail thread post posts article articles wp js the my our your".split())
BOXLESS = frozenset("ul ol li dl dt dd table tbody thead tfoot tr td th p".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
         "option": {"select"}}


class Node:
    __slots__ = ("tag", "key", "role", "soft", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.key, self.role, self.soft = _describe(tag, attributes)


def _says_chrome(name: str) -> set[str]:
    """The words of a class or id that make it chrome, if all of it says so."""
    words = {w for w in re.split(r"[^a-z]+", name) if w}
    return words & CHROME if words and words <= CHROME | BESIDE else set()


@lru_cache(maxsize=20_000)
def _describe(tag: str, attributes: str) -> tuple[str, str, bool]:
    """The label of an element in a wrapper; drop, weak, header, content, doubt or nothing; and whether
    it is dropped by no more than a name, a role or being a form.

    An article whose whole class or id is that of chrome is in doubt: a part of the page beside
    other content, and content where there is none.
    """
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attributes)} if attributes.strip() else {}
    names = re.sub(r"\d+", "", " ".join((found.get("class", ""), found.get("id", ""))))
    key = ".".join([tag, *sorted(set(names.split()))[:4]])
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if tag in DROP or hidden:
        return key, "drop", tag == "form" and not hidden
    if tag in ("html", "body"):
        return key, "", False
    if tag == "main" or found.get("role") == "main" or found.get("itemprop") == "articlebody":
        return key, "content", False
    if tag == "article" or found.get("role") == "article":
        return key, "doubt" if {w.strip("-_") for w in names.split()} & CHROME else "content", False
    said = set().union(*map(_says_chrome, names.split()))
    if said and said <= DOUBTFUL and found.get("role") not in ROLES:
        return key, "weak", True
    if said or found.get("role") in ROLES:
        return key, "drop", True
    return key, "header" if tag == "header" or "header" in re.split(r"[^a-z]+", names) else "", False


def _length(node: Node) -> int:
    """Characters of text that no dropped element below holds."""
    return sum(len(c.strip()) if isinstance(c, str) else 0 if c.role == "drop" else _length(c) for c in node.children)


def parse(page: str) -> Node:
    """The tree of a page; text is kept as strings between the elements."""
    root = Node("#")
    stack, at, size = [root], 0, len(page)
    doubt: list[Node] = []
    shut: list[Node] = []  # what holds content and is dropped by its name
    forms: list[Node] = []
    sure = False

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    while at < size:
        open_at = page.find("<", at)
        if open_at < 0:
            break
        m = _TAG.match(page, open_at) or _LOOSE.match(page, open_at)
        if m is None:  # a bare sign
            text(page[at : open_at + 1])
            at = open_at + 1
            continue
        text(page[at:open_at])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK and tag not in ("html", "body", "head"):
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPE[tag]:
                    break
                if stack[i].tag in ENDS[tag]:
                    del stack[i:]
                    break
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if node.role == "weak" and not any(n.role == "content" for n in stack):
            node.role = "drop"
        if node.role == "doubt":
            doubt.append(node)
        elif node.role == "content" and not sure:
            above = [n for n in stack if n.role in ("drop", "doubt")]
            sure = not above
            if all(n.soft for n in above):
                shut += above
        elif tag == "form" and node.soft:
            forms.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = size if close < 0 else close + 1
        elif tag not in VOID and not _CLOSED.search(m[3]):
            stack.append(node)
    text(page[at:] if page.find("<", at) < 0 else "")
    if not sure and shut:
        for node in shut:
            node.role = ""
        sure = True
    for node in doubt:
        node.role = "drop" if sure else "content"
    if not sure and not doubt:  # a form round the page is no part of it
        for node in forms:
            if node.role == "drop" and _length(node) > _length(root):
                node.role = ""
    return root


def squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


# --- wrappers: [label, role, pages, characters, characters in links, {text: pages}, children] ---

KEY, ROLE, PAGES, CHARS, LINKS, TEXTS, CHILDREN = range(7)


def fold(node: Node, in_link: bool = False) -> list:
    """A page's tree as a wrapper of one page."""
    own: list[str] = []
    out = [node.key, node.role, 1, 0, 0, {}, []]
    if node.role == "drop":  # what it holds is no slot
        return out

    def gather(parent: Node, link: bool) -> None:
        for child in parent.children:
            if isinstance(child, str):
                own.append(child)
                if link:
                    out[LINKS] += len(child.strip())
            elif child.tag in BLOCK or child.role:
                made = fold(child, link)
                if out[CHILDREN] and out[CHILDREN][-1][KEY] == made[KEY]:
                    join(out[CHILDREN][-1], made, same_page=True)
                else:
                    out[CHILDREN].append(made)
            else:
                gather(child, link or child.tag == "a")

    gather(node, in_link)
    if text := squeeze(own):
        out[CHARS] = len(text)
        out[TEXTS][str(zlib.crc32(text.encode()))] = 1
    return out


def match(a: list, b: list, known: dict) -> int:
    """Simple tree matching: nodes in the largest ordered matching of two trees."""
    if a[KEY] != b[KEY]:
        return 0
    if (id(a), id(b)) not in known:
        known[id(a), id(b)] = 1 + _table(a[CHILDREN], b[CHILDREN], known)[-1][-1]
    return known[id(a), id(b)]


def _table(left: list, right: list, known: dict) -> list[list[int]]:
    table = [[0] * (len(right) + 1)]
    for x in left:
        row, above = [0], table[-1]
        for j, y in enumerate(right):
            row.append(max(row[-1], above[j + 1], above[j] + match(x, y, known)))
        table.append(row)
    return table


def join(a: list, b: list, same_page: bool = False) -> None:
    """Merge tree ``b`` into ``a``; both have one label."""
    a[PAGES] += 0 if same_page else b[PAGES]
    a[CHARS] += b[CHARS]
    a[LINKS] += b[LINKS]
    for text, n in b[TEXTS].items():
        a[TEXTS][text] = a[TEXTS].get(text, 0) + n
    if len(a[TEXTS]) > 4 * TEXTS_KEPT:  # frequent ones stay, as Misra and Gries count
        cut = sorted(a[TEXTS].values(), reverse=True)[TEXTS_KEPT]
        a[TEXTS] = {t: n - cut for t, n in a[TEXTS].items() if n > cut}
    left, right, known = a[CHILDREN], b[CHILDREN], {}
    if [x[KEY] for x in left] == [y[KEY] for y in right]:
        for x, y in zip(left, right):
            join(x, y, same_page)
        return
    table, merged = _table(left, right, known), []
    i, j = len(left), len(right)
    while i or j:
        if i and j and (m := match(left[i - 1], right[j - 1], known)) and table[i][j] == table[i - 1][j - 1] + m:
            i, j = i - 1, j - 1
            join(left[i], right[j], same_page)
            merged.append(left[i])
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
            merged.append(left[i])
        else:
            j -= 1
            merged.append(right[j])
    a[CHILDREN] = merged[::-1]


def _is_template(node: list, pages: int) -> list[str]:
    least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * max(node[PAGES], 1))
    return [t for t, n in node[TEXTS].items() if n >= least] if pages >= TEMPLATE_PAGES else []


def rules_of(wrapper: list) -> str:
    """What a page without an article is read by: the number of pages seen, and the labels down to the slots."""
    pages = wrapper[PAGES]

    def slots(node: list) -> int:
        if node[ROLE] == "drop":
            return 0
        share = sum(node[TEXTS][t] for t in _is_template(node, pages)) / max(1, sum(node[TEXTS].values()))
        return int((node[CHARS] - node[LINKS]) * (1 - share)) + sum(map(slots, node[CHILDREN]))

    total = max(1, slots(wrapper))
    path, node = [wrapper[KEY]], wrapper
    while heavy := [c for c in node[CHILDREN] if 10 * slots(c) >= 9 * total and c[CHILDREN]]:
        node = heavy[0]
        path.append(node[KEY])
    return json.dumps([pages, path])


# --- reading pages -----------------------------------------------------------------

def _roots(node: Node, path: list[str]) -> list[Node]:
    """The nodes at a path of labels; inline elements in between are passed through."""
    if not path:
        return [node]
    out = []
    for child in node.children:
        if isinstance(child, Node) and child.role != "drop":
            if child.key == path[0] and (child.tag in BLOCK or child.role):
                out += _roots(child, path[1:])
            elif child.tag not in BLOCK and not child.role:
                out += _roots(child, path)
    return out


def _contents(node: Node) -> list[Node]:
    """Outermost articles and main parts."""
    out = []
    for child in node.children:
        if isinstance(child, Node) and child.role != "drop":
            out += [child] if child.role == "content" else _contents(child)
    return out


def _place(path: bytes, text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=path).digest()


class Block(NamedTuple):
    place: int  # label path and text as one hash
    text: str
    links: int  # characters in links
    weak: int  # number of the doubtful part it lies in, 0 for none
    box: int  # number of what holds it and is no list


def blocks_of(tree: Node, chosen: list[Node]) -> list[Block]:
    """The blocks inside the chosen nodes, in page order."""
    out: list[Block] = []
    starts = {id(n) for n in chosen}
    own: list[str] = []
    links = parts = boxes = 0

    def flush(path: bytes, weak: int, box: int) -> None:
        nonlocal links
        if text := squeeze(own):
            out.append(Block(int.from_bytes(_place(path, text), "little", signed=True), text, links, weak, box))
        own.clear()
        links = 0

    def walk(parent: Node, path: bytes, link: bool, headings: bool, inside: bool, weak: int, box: int) -> None:
        nonlocal links, parts, boxes
        for child in parent.children:
            if isinstance(child, str):
                if inside and not headings:
                    own.append(child)
                    links += len(child.strip()) if link else 0
            elif child.role == "drop":
                if child.tag in BLOCK:
                    flush(path, weak, box)
            elif child.tag in ("br", "wbr", "img"):
                own.append(" " if child.tag == "br" else "")
            elif child.tag in BLOCK or child.role:
                flush(path, weak, box)
                below, part, held = _place(path, child.key), weak, box
                if child.role == "weak" and not weak:
                    parts += 1
                    part = parts
                if child.tag not in BOXLESS and child.tag not in HEADINGS or parent.tag in ("#", "html", "body"):
                    boxes += 1
                    held = boxes
                if id(child) in starts:
                    walk(child, below, False, False, True, part, held)
                else:
                    walk(child, below, link, (headings or child.role == "header") and child.tag not in HEADINGS, inside, part, held)
                flush(below, part, held)
            else:
                walk(child, path, link or child.tag == "a", headings, inside, weak, box)

    walk(tree, b"", False, False, id(tree) in starts, 0, 0)
    flush(b"", 0, 0)
    return out


def _linked(blocks: list[Block], by: str) -> set[int]:
    """Numbers of the parts or boxes whose text is links for the most part."""
    held: dict[int, list[int]] = {}
    for b in blocks:
        sums = held.setdefault(getattr(b, by), [0, 0])
        sums[0] += len(b.text)
        sums[1] += b.links
    return {k for k, (size, links) in held.items() if 2 * links > size}


@lru_cache(maxsize=4096)
def _rules(text: str) -> tuple[int, list[str]]:
    return tuple(json.loads(text))


def main_text(page: str | None, rules: str | None, constant: frozenset[int] = frozenset()) -> str:
    if not page:
        return ""
    tree = parse(page)
    pages, path = _rules(rules) if rules else (1, [])
    if found := _contents(tree):
        blocks = blocks_of(tree, found)
        menus, words = _linked(blocks, "weak"), Counter()
        for b in blocks:
            words[b.weak] += 0 if b.place in constant else len(b.text.split())
        # a doubtful part stays for what it says of its own; alone on its host it must say a sentence
        least = 1 if pages >= TEMPLATE_PAGES else SENTENCE
        kept = [b for b in blocks if not b.weak or (b.weak not in menus and words[b.weak] >= least)]
    else:
        at = _roots(tree, path[1:]) if len(path) > 1 else []
        kept = blocks_of(tree, at or [tree])
        if not at or pages < TEMPLATE_PAGES:  # nothing tells slots from template, so boxes of links go
            menus = _linked(kept, "box")
            kept = [b for b in kept if b.box not in menus]
    return "\n\n".join(b.text for b in kept if b.place not in constant)


def heart_of(blocks: list[Block]) -> int | None:
    """What a page is told from others by: its longest block of its own."""
    own = [b for b in blocks if not b.weak and 2 * b.links <= len(b.text)]
    return max(own, key=lambda b: (len(b.text), b.place)).place if own else None


_FOLDED = "host string, page long, blocks array<long>, wrapper string"


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each page's blocks, and one wrapper per host from the pages of a partition."""
    wrappers: dict[str, list] = {}
    for batch in batches:
        hosts, pages, blocks = [], [], []
        for host, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
            if host and page:
                tree = parse(page)
                found = blocks_of(tree, _contents(tree) or [tree])
                hosts.append(host)
                pages.append(heart_of(found))
                blocks.append(list({b.place for b in found}))
                made = fold(tree)
                if host in wrappers:
                    join(wrappers[host], made)
                else:
                    wrappers[host] = made
        yield _rows(hosts, pages, blocks, [None] * len(hosts))
        if len(wrappers) > 2000:
            yield _rows_of(wrappers)
            wrappers = {}
    yield _rows_of(wrappers)


def _rows(hosts: list, pages: list, blocks: list, wrappers: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(blocks, pa.list_(pa.int64())),
         pa.array(wrappers, pa.string())], ["host", "page", "blocks", "wrapper"])


def _rows_of(wrappers: dict[str, list]) -> pa.RecordBatch:
    none = [None] * len(wrappers)
    return _rows(list(wrappers), none, none, [json.dumps(w) for w in wrappers.values()])


def _merge(rules: bool):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(frame["wrapper"])  # one order, so a lost task makes the same wrapper again
        merged = json.loads(texts[0])
        for other in texts[1:]:
            join(merged, json.loads(other))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [rules_of(merged) if rules else json.dumps(merged)]})

    return merge


def _constants(pages: DataFrame) -> DataFrame:
    """``host, constant``: hashes of the blocks that stand on most pages of a host, pages told apart by their longest block."""
    pages = pages.filter("page IS NOT NULL")
    many = pages.groupBy("host").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= TEMPLATE_PAGES)
    seen = pages.select("host", "page", F.explode("blocks").alias("block")).distinct().groupBy("host", "block").agg(F.count("*").alias("n"))
    fixed = seen.filter(F.col("n") >= TEMPLATE_PAGES).join(many, "host").filter(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    return fixed.groupBy("host").agg(F.sort_array(F.collect_list("block")).alias("constant"))


def wrappers_of(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, wrapper, constant``: the reading rules of every host."""
    folded = scratch.write(pages.select("host", "html").mapInArrow(_fold_pages, _FOLDED), "folded")
    salted = (folded.filter("wrapper IS NOT NULL").select("host", "wrapper")
              .withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))))
    once = salted.groupBy("host", "salt").applyInPandas(_merge(False), "host string, wrapper string")
    rules = once.groupBy("host").applyInPandas(_merge(True), "host string, wrapper string")
    return scratch.write(rules.join(_constants(folded), "host", "left"), "wrappers")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none: frozenset[int] = frozenset()
    for batch in batches:
        known: dict[str, frozenset[int]] = {}
        texts = []
        for host, page, rules, at in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), range(len(batch))):
            if host not in known:
                known[host] = frozenset(batch.column("constant")[at].as_py() or none)
            texts.append(main_text(page, rules, known[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    wrappers = wrappers_of(rows, scratch)
    size = F.length("wrapper") + F.length("host") + 8 * F.coalesce(F.size("constant"), F.lit(0))
    if (wrappers.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_CHARS:
        wrappers = F.broadcast(wrappers)
    read = rows.join(wrappers, "host", "left").select("page_id", "url", "host", "html", "wrapper", "constant")
    return read.mapInArrow(_read, "page_id long, url string, text string, n_chars long")
