"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its elements, by their paths, and its texts with their paths. Over the pages of a host that
differ in their content (copies count once), a token's occurrence vector says how often each page has it, and tokens
with equal vectors form an equivalence class. Classes nest: an element is template where two pages have it (or the
host's only page has), and a text is template where its class is that of an element around it, so that each such
element brings that text, and two pages show it. What the template leaves are slots, and the elements around a slot are
its names.

Words choose among the slots so found, and nothing else does: an element that is not of the template has no role.

- Elements that hold content are ``article``, ``main`` and containers marked as nothing but content. If a page has some,
  its text is what stands in them, fixed texts included, as an article may repeat a sentence.
- Navigation, footers, asides, menus and the like are no content by their element; headers only outside content.
- Words of class, id and role name notices, adverts, sidebars, comments and such. Parts of words (site-header) count
  where two pages have the element. In an ``article`` both count only for containers that every page with that article
  has (but for comments by their whole word), and never for paragraphs, items and headings. An article in a list of
  comments or related articles is content only where there is no other.
- A page without content elements gives its slots without a role, less the template's texts; if all have a role, those
  named by words alone (a page in a form, or in a banner); a page of navigation alone is empty.

So one rule holds for hosts of any number of pages: a text that half of the pages show stays, and one that every page
shows is template. Of a host whose only pages are edited copies of each other, without content elements, what they share
counts as its template.

Pages are scanned in one pass with constant work a tag, whatever is broken: paths are numbers in a tree, an end tag
without a start is skipped by a count, and a tag that never ends takes the rest of the page, as in browsers. So very
long pages take time in proportion to their length. Null or empty html gives an empty text. Repeated pages are
extracted each; a null url is a host of its own. Ties don't matter, as nothing is ranked. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_stored, map_texts, operator, partitions, store

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("head script style noscript template title svg math iframe object canvas audio video map textarea xmp noembed noframes".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CHROME = frozenset("nav footer aside button select option dialog menu fieldset label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img picture ruby rt rp".split())
#: Words of class, id and role attributes that mark a part as no content.
ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside rail footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social related recommended comment comments reply replies respond disqus pagination pager toolbar widget widgets complementary contentinfo skip".split()
)
#: Role words of lists that hold articles of their own.
LISTS = frozenset("comment comments reply replies respond disqus related recommended".split())
#: Words of class and id that mark content, what may stand beside them in a compound, and beginnings of
#: compounds that say what a part has and not what it is.
CONTENT_MARKS = frozenset("content article post entry story main".split())
BESIDE_MARKS = frozenset("body text area wrapper container".split())
SAYS_HAS = frozenset("has with no without".split())
CONTENT = frozenset(("article", "main"))
NO_CONTAINER = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption".split())
HEADERS = frozenset(("header", "masthead"))  # in content they hold its title
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_NAME = re.compile(r"[A-Za-z][^\s/>\x00]*")
#: The rest of a tag: a quote counts after an equals sign. Nothing is tried twice.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z0-9]+")

ROOT = 0
Label = tuple[str, frozenset, frozenset, bool]  # element, role words, role words in compounds, marked as content


def _label(name: str, attrs: str) -> tuple[str, bool]:
    """An element's label in paths, with the words that can name it, and whether it is hidden."""
    hidden = name in HIDDEN
    if not attrs or attrs.isspace():
        return name, hidden
    whole, parts, marked = set(), set(), False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            for word in value.split():
                pieces = _PARTS.findall(word)
                if word in ROLES:
                    whole.add(word)
                elif pieces and pieces[0] not in SAYS_HAS:
                    parts.update(ROLES.intersection(pieces))
                    marked |= not CONTENT_MARKS.isdisjoint(pieces) and CONTENT_MARKS.union(BESIDE_MARKS).issuperset(pieces)
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    marked = marked and not whole and not parts and name in ("div", "section", "td")
    return name + "".join("." + w for w in sorted(whole)) + "".join("~" + w for w in sorted(parts)) + "+" * marked, hidden


class _Known(dict):
    def __missing__(self, x):
        if len(self) > 50_000:
            self.clear()
        out = self[x] = self.make(*x) if isinstance(x, tuple) else self.make(x)
        return out

    def __init__(self, make) -> None:
        self.make = make


def _read_label(label: str) -> Label:
    name = re.match(r"[^.~+]*", label)[0]
    words = lambda mark: frozenset(re.findall(rf"\{mark}([^.~+]+)", label[len(name) :]))
    return name, words("."), words("~"), label.endswith("+") and len(label) > len(name)


_labels, _read = _Known(_label), _Known(_read_label)


def _key(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """The blocks of a page in order, as (path, text), and its paths, numbered from the root's: their parents, labels
    and how often an element opens there."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[int, str]] = []
        self.parents, self.labels, self.counts = [-1], [""], [1]
        children: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, bool]] = []  # name, path, hidden
        places: dict[str, list[int]] = defaultdict(list)  # of open elements by name
        outer: list[int] = []  # places of open elements that are not inline
        text: list[str] = []
        path, hidden = ROOT, False

        def flush() -> None:
            if text:
                joined = _SPACE.sub(" ", htmllib.unescape("".join(text))).strip()
                text.clear()
                if joined:
                    self.blocks.append((path, joined))

        def close(k: int) -> None:
            nonlocal path, hidden
            while len(stack) > k:
                name = stack.pop()[0]
                places[name].pop()
                if name not in INLINE:
                    outer.pop()
            _, path, hidden = stack[-1] if stack else ("", ROOT, False)

        at, n = 0, len(source)
        while at < n:
            tag = source.find("<", at)
            if tag < 0:
                tag = n
            if tag > at and not hidden:
                text.append(source[at:tag])
            if tag == n:
                break
            after = source[tag + 1 : tag + 2]
            if after in ("!", "?"):
                if source.startswith("<!--", tag):
                    end, size = source.find("-->", tag + 4), 3
                elif source.startswith("<![CDATA[", tag):
                    end, size = source.find("]]>", tag + 9), 3
                    if not hidden:
                        text.append(htmllib.escape(source[tag + 9 : end if end >= 0 else n]))
                else:
                    end, size = source.find(">", tag), 1
                at = end + size if end >= 0 else n
                continue
            ends = after == "/"
            named = _NAME.match(source, tag + 1 + ends)
            if named is None:
                if not hidden:
                    text.append("<")
                at = tag + 1
                continue
            rest = _REST.match(source, named.end())
            if rest is None:  # the tag never ends
                break
            at = rest.end()
            name = named[0].lower()
            if name == "br":
                if not hidden:
                    text.append(" ")
                continue
            inline = name in INLINE
            if ends:
                k = places[name][-1] if places[name] else -1
                if k < 0 or (inline and outer and outer[-1] > k):
                    continue
                if not inline and not hidden:
                    flush()
                close(k)
                continue
            if name in RAW:  # its text ends at its own end tag alone
                found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = found.end() if found else n
                continue
            if name in VOID:
                if not inline and not hidden and name == "hr":
                    flush()
                continue
            if places["head"] and name not in IN_HEAD and name != "head":
                close(places["head"][-1])
            if not inline and name not in HIDDEN and not hidden:
                flush()
            if outer and ((name in _ENDS_P and stack[outer[-1]][0] == "p") or (name in _CLOSES and stack[outer[-1]][0] in _CLOSES[name])):
                close(outer[-1])
            label, off = _labels[name, rest[0][:-1].rstrip("/")]
            if inline:
                stack.append((name, path, hidden or off))
            else:
                child = children.get((path, label))
                if child is None:
                    child = children[path, label] = len(self.parents)
                    self.parents.append(path)
                    self.labels.append(label)
                    self.counts.append(0)
                self.counts[child] += 1
                outer.append(len(stack))
                stack.append((name, child, hidden or off))
            places[name].append(len(stack) - 1)
            path, hidden = stack[-1][1], stack[-1][2]
        flush()

    def keys(self) -> list[int]:
        """A key for each path, the same on all pages."""
        out = [_key("<")]
        for parent, label in zip(self.parents[1:], self.labels[1:], strict=True):
            out.append(_key(f"{out[parent]}/{label}"))
        return out

    def in_content(self) -> list[bool]:
        """For each path whether it is in an article or main element, whose texts are never template."""
        out = [False]
        for parent, label in zip(self.parents[1:], self.labels[1:], strict=True):
            out.append(out[parent] or _read[label][0] in CONTENT)
        return out


def text_key(path_key: int, text: str) -> int:
    return _key(f"{path_key}\t{text}")


class Token(NamedTuple):
    key: int
    text: bool
    n: int


def tokens(page: Page) -> tuple[int, list[Token]]:
    """A fingerprint of the page's content, and its distinct tokens with their counts."""
    keys, inside = page.keys(), page.in_content()
    texts = Counter(text_key(keys[p], t) for p, t in page.blocks if not inside[p])
    found = [Token(k, False, n) for k, n in zip(keys, page.counts, strict=True)] + [Token(k, True, n) for k, n in texts.items()]
    return _key("\n".join(t for _, t in page.blocks)), sorted(found)


class Class(NamedTuple):
    """Of a token: in how many pages it is, its occurrence vector and its pages, as hashes."""

    support: int
    vector: int
    pages: int


Template = dict[int, Class]


def deduce(pages: list[Page]) -> Template:
    """The template of a host's pages: what ``host_templates`` finds, in memory."""
    distinct = {}
    for fingerprint, found in map(tokens, pages):
        distinct[fingerprint] = min(found, distinct.get(fingerprint, found))
    support: Counter = Counter()
    vector, where = defaultdict(int), defaultdict(int)
    texts = set()
    for fingerprint, found in distinct.items():
        for key, text, n in found:
            support[key] += 1
            vector[key] ^= _key(f"{fingerprint} {n}")
            where[key] ^= _key(str(fingerprint))
            if text:
                texts.add(key)
    least = min(2, len(distinct))
    elements = {vector[k] for k in support if k not in texts}
    return {k: Class(n, vector[k], where[k]) for k, n in support.items() if (n >= 2 and vector[k] in elements if k in texts else n >= least)}


# What the slots of a path are: content, without a role, named by words, in a list, no content by element.
IN_CONTENT, PLAIN, NAMED, LISTED, OFF = range(5)


def roles(page: Page, keys: list[int], template: Template) -> list[int]:
    """The role of the slots of each path."""
    out: list[tuple[int, int | None]] = [(PLAIN, None)]  # role, key of the article around
    for k in range(1, len(keys)):
        role, article = out[page.parents[k]]
        known = template.get(keys[k])
        if known is not None:  # else it is no part of the template and has no role
            name, whole, parts, marked = _read[page.labels[k]]
            words = whole | parts if known.support >= 2 else whole
            if name in HEADINGS or name in ("html", "body"):
                words = frozenset()
            if article is not None and (name in NO_CONTAINER or known.support < 2 or known.pages != template[article].pages):
                words = words & LISTS if name not in NO_CONTAINER and not whole.isdisjoint(LISTS) else frozenset()
            if role == IN_CONTENT:
                words = words - HEADERS
            if name in CONTENT or marked:
                if role not in (LISTED, OFF):
                    role = IN_CONTENT
                if name == "article" and article is None:
                    article = keys[k]
            elif name in CHROME:
                role = OFF
            elif words:
                if role != OFF:
                    role = LISTED if not words.isdisjoint(LISTS) else max(role, NAMED)
            elif name in ("header", "form") and role == PLAIN:
                role = NAMED
        out.append((role, article))
    return [role for role, _ in out]


def page_text(page: Page, template: Template) -> str:
    """The text in the slots of a page that hold its content."""
    keys = page.keys()
    role = roles(page, keys, template)
    best = min((role[p] for p, _ in page.blocks), default=OFF)
    if best == OFF:
        return ""
    chosen = [(p, t) for p, t in page.blocks if role[p] == best]
    if best in (PLAIN, NAMED):
        fixed = _fixed(page, keys, template)
        chosen = [x for x in chosen if x not in fixed] or chosen
    return "\n".join(t for _, t in chosen)


def _fixed(page: Page, keys: list[int], template: Template) -> set[tuple[int, str]]:
    """The texts whose class is that of an element around them."""
    of = [template.get(k) for k in keys]
    holders = defaultdict(list)
    for k, c in enumerate(of):
        if c is not None:
            holders[c.vector].append(k)
    # paths are numbered after their parents, so one pass back gives the last number below each, if children are dense
    first, last = _spans(page.parents)
    out = set()
    for p, t in set(page.blocks):
        c = template.get(text_key(keys[p], t))
        if c is not None and any(first[k] <= first[p] <= last[k] for k in holders.get(c.vector, ())):
            out.add((p, t))
    return out


def _spans(parents: list[int]) -> tuple[list[int], list[int]]:
    """For each path its place in a walk through the tree, and the last place below it."""
    size = [1] * len(parents)
    for k in range(len(parents) - 1, 0, -1):
        size[parents[k]] += size[k]
    first, free = [0] * len(parents), [1] * len(parents)
    for k in range(1, len(parents)):
        p = parents[k]
        first[k] = first[p] + free[p]
        free[p] += size[k]
    return first, [f + s - 1 for f, s in zip(first, size, strict=True)]


def extract(pages: list[Page]) -> list[str]:
    """The text of each page of a host."""
    template = deduce(pages)
    return [page_text(p, template) for p in pages]


def page_tokens(rows: DataFrame) -> DataFrame:
    """Of (host, salt, html) per page: host, salt, print (of its content) and its tokens, as their keys and counts; those of
    its ``elements`` come first."""

    def make():
        def f(x):
            out = {"host": x["host"], "salt": x["salt"], "print": [], "keys": [], "ns": [], "elements": []}
            for h in x["html"]:
                print_, found = tokens(Page(h or ""))
                found.sort(key=lambda t: (t.text, t.key))
                out["print"].append(print_)
                out["keys"].append([t.key for t in found])
                out["ns"].append([t.n for t in found])
                out["elements"].append(sum(not t.text for t in found))
            return out

        return f

    return map_texts(rows, ["host", "salt", "html"], make, "host string, salt bigint, print bigint, keys array<bigint>, ns array<int>, elements int", rows_at_once=128)


def host_templates(found: DataFrame) -> DataFrame:
    """The tokens of each host's template (host, key, support, vector, pages) from ``page_tokens``, by grouped sums of
    hashes, so a host's pages are never together."""
    distinct = found.groupBy("host", "print").agg(F.min(F.struct("keys", "ns", "elements")).alias("x")).select("host", "print", "x.*")
    each = distinct.select("host", "print", "elements", F.posexplode(F.arrays_zip("keys", "ns")).alias("at", "x"))
    each = each.select("host", "print", F.col("x.keys").alias("key"), F.col("x.ns").alias("n"), (F.col("at") >= F.col("elements")).alias("text"))
    counted = each.groupBy("host", "key").agg(F.max("text").alias("text"), F.count("*").alias("support"), F.bit_xor(F.xxhash64("print", "n")).alias("vector"), F.bit_xor(F.xxhash64("print")).alias("pages"))
    # the root is a token of every page
    several = distinct.groupBy("host").agg((F.count("*") > 1).alias("several"))
    counted = cut(counted.join(several, "host").filter((F.col("support") > 1) | ~(F.col("text") | F.col("several"))).drop("several"))
    elements = counted.filter(~F.col("text"))
    texts = counted.filter("text").join(elements.select("host", "vector").distinct(), ["host", "vector"], "left_semi")
    columns = ["host", "key", "support", "vector", "pages"]
    return elements.select(columns).unionByName(texts.select(columns))


@operator
def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = 1 << 16, chunks: int = 64) -> DataFrame:
    """Per page: id, url, text, n_chars. Pages are read twice: for the templates of their hosts, and with them.

    For the second time pages are dealt in chunks of about a ``chunks``-th of a task's even share (``chunk_bytes`` at
    least): hosts with more bytes are salted by a hash of the page, small hosts share chunks. Beside a chunk's pages stand
    the template's tokens that these pages have, and no others.
    """
    spark = pages.sparkSession
    tasks = partitions(spark)
    kind = dict(pages.dtypes)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = rows.withColumn("host", host)
    sizes = cut(rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint") + 64).alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(chunk_bytes, total // (chunks * tasks))
    # at most chunks * tasks hosts hold more than the share
    hot = F.broadcast(sizes.filter(F.col("n") > share).select("host", F.ceil(F.col("n") / share).alias("salts")))
    salted = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("id", "url", "html"), F.coalesce("salts", F.lit(1).cast("bigint")))).drop("salts")
    found, found_at = store(page_tokens(salted), compression="zstd")
    asked = found.select("host", "salt", F.explode("keys").alias("key")).distinct()
    chunk = F.pmod(F.xxhash64("host", "salt"), F.lit(max(1, -(-total // share)))).alias("chunk")
    told = cut(asked.join(host_templates(found), ["host", "key"]).select(chunk, "host", "key", "support", "vector", "pages"))
    drop_stored(spark, found_at)
    dealt = salted.select(chunk, "id", "url", "host", "html")

    def texts_of(left: pa.Table, right: pa.Table) -> pa.Table:
        templates: dict[str, Template] = defaultdict(dict)
        for h, *row in zip(*(right[c].to_pylist() for c in ("host", "key", "support", "vector", "pages")), strict=True):
            templates[h][row[0]] = Class(*row[1:])
        texts = []
        for at in range(0, left.num_rows, 128):
            part = left.slice(at, 128)
            texts += [page_text(Page(x or ""), templates[h]) for h, x in zip(part["host"].to_pylist(), part["html"].to_pylist(), strict=True)]
        return pa.table({"id": left["id"], "url": left["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    each = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(texts_of, f"id {kind[id_col]}, url string, text string, n_chars bigint")
    return each.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
