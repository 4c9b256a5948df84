"""Main text of web pages by consensus host paths (operator 4).

Each page's containers are scored by the plain text they hold outside
boilerplate and links; the page votes for the generalised tag-class path of
its smallest container that holds most of it. Votes are summed per host, and
every page is read again with its host's winning paths, which are all that get
at least a hundredth of the host's votes (so at most a hundred): the text
inside the winning path that holds most of the page's plain text, without
boilerplate inside it. A page whose winning paths hold less than half of what
its own best container has uses that.

Boilerplate: navigation, page headers, footers, asides, forms, scripts, styles
and the like by tag or role. A class or id decides alone only where each of its
words names boilerplate ("share-buttons", "comments"). Elements that merely
have such a word ("social-history") are put to the host's vote: their path is
boilerplate where unlike pages repeat its text, content where it differs from
page to page; with too few pages it is content inside articles, boilerplate
outside. Headers inside an article belong to it.

Paths are chains of 128-bit digests, so nesting costs linear memory.

Defined results: a null or empty page gives an empty text; a null or odd url
is the host ''. Cut-off markup, references and comments are read as far as
they go; a quote counts only where a value begins, and one that never closes is
a plain sign. Very long pages are read whole. Repeated pages vote once each for
containers and together for paths in doubt; of winning paths that hold as much, the one with more votes is taken, then the
smaller digest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The part of a host's votes that makes a path a winner.
LEAST_SHARE = 0.01
#: Paths in doubt are decided if so many unlike pages have them: boilerplate if their texts are at most half as many.
DOUBT_PAGES = 3
#: Paths up to which the winners are broadcast; beyond it they are joined with salted keys.
BROADCAST_PATHS, SALTS = 50_000, 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s>]*)*+)(?:>|\Z)|([^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {
    **{t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]), "body": frozenset(["head"]),
}
_SCOPE = frozenset("html body article main section div ul ol dl table blockquote nav header footer aside form".split())
_BOILER_TAGS = frozenset("nav aside footer form button select menu dialog head fieldset template svg math object canvas audio video".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
_BOILER_WORD = frozenset(
    "nav navs navbar navigation menu menus topbar bottombar footer foot sidebar sidebars aside ad ads adv advert adverts advertisement advertising adsense banner promo promos promoted sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations breadcrumb breadcrumbs widget widgets toolbar login search pagination pager skip copyright legal trending outbrain taboola".split()
)
#: Words that go with the above without changing what they name.
_PLAIN_WORD = frozenset("site page main top bottom left right header head bar bars box boxes block blocks area section sections wrapper wrap container inner outer list lists item items link links icon icons button buttons btn post posts article articles content form forms panel slot unit user reader readers author body thread text title count media network networks tools tool row col column columns primary secondary global mobile desktop sticky fixed small large story stories news recent latest popular more read info law policy you may like from around web all new".split())
_HEADER_WORD = frozenset(["header", "masthead", "head"])
_SPLIT = re.compile(r"[\s_\W\d]+|(?<=[a-z])(?=[A-Z])")
_CONTAINERS = frozenset("article main section div td body blockquote center".split())
_ENDS: dict[str, re.Pattern] = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in _RAW}


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


_SURE, _DOUBT_IN, _DOUBT_OUT = 1, 2, 3


def _by_names(names: str, inside: bool) -> int:
    """Whether classes and ids name boilerplate: surely, in doubt or not (0)."""
    doubt = 0
    for token in names.split():
        words = [w.lower() for w in _SPLIT.split(token) if w]
        if any(w in _BOILER_WORD or (not inside and w in _HEADER_WORD) for w in words):
            if all(w in _BOILER_WORD or w in _PLAIN_WORD for w in words):
                return _SURE
            doubt = _DOUBT_IN if inside else _DOUBT_OUT
    return doubt


class Page:
    """A page's elements and its pieces of text, in page order."""

    def __init__(self, source: str, repeated: frozenset[bytes] = frozenset(), own: frozenset[bytes] = frozenset()):
        root = hashlib.blake2b(b"html", digest_size=16).digest()
        self.parent, self.tag, self.path, self.boiler, self.link = [-1], ["html"], [root], [False], [False]
        self.doubt: list[int] = []  # elements whose names leave it to the host's vote
        self.texts: list[tuple[int, str]] = []  # (element, text as it stands); empty: a block's edge
        known: dict[tuple[bytes, str], bytes] = {}
        stack, inside, at, n = [0], 0, 0, len(source)
        opened: dict[str, int] = {}

        def close(to: int) -> None:
            nonlocal inside
            for e in stack[to:]:
                t = self.tag[e]
                opened[t] -= 1
                inside -= t in ("article", "main")
            del stack[to:]

        while at < n:
            m = _TOKEN.match(source, at)
            at = m.end()
            if m[4] is not None:
                self.texts.append((stack[-1], m[4]))
                continue
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag not in _INLINE:
                self.texts.append((stack[-1], ""))
            if m[1]:  # an end
                if opened.get(tag):
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[i]] == tag:
                            close(i)
                            break
                        if tag in _INLINE and self.tag[stack[i]] in _SCOPE:
                            break
                if tag not in _INLINE:
                    self.texts.append((stack[-1], ""))
                continue
            if tag in _VOID or tag == "html":
                continue
            if tag in _RAW:
                if not m[3].endswith("/"):
                    end = _ENDS[tag].search(source, at)
                    at = end.end() if end else n
                continue
            closes = _CLOSES.get(tag)
            if closes and any(opened.get(t) for t in closes):
                for i in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[i]]
                    if t in closes:
                        close(i)
                        if tag != "tr" or t == "tr":
                            break
                    elif t in _SCOPE:
                        break
            up, e = stack[-1], len(self.tag)
            attributes = {}
            if "=" in m[3]:
                for a, b, c, d in _ATTRIBUTE.findall(m[3]):
                    attributes.setdefault(a.lower(), b or c or d)
            classes = attributes.get("class", "")
            path = self.path[up]
            if tag not in _INLINE:
                label = tag if not classes else tag + "." + ".".join(sorted({re.sub(r"\d+", "#", c) for c in classes.lower().split()}))
                path = known.get((path, label))
                if path is None:
                    path = known[self.path[up], label] = hashlib.blake2b(self.path[up] + label.encode(errors="replace"), digest_size=16).digest()
            self.parent.append(up)
            self.tag.append(tag)
            self.path.append(path)
            self.link.append(self.link[up] or tag == "a")
            kind = 0 if self.boiler[up] else self._kind(tag, attributes, classes, inside)
            if kind in (_DOUBT_IN, _DOUBT_OUT):
                self.doubt.append(e)
            self.boiler.append(self.boiler[up] or kind == _SURE or (kind == _DOUBT_IN and path in repeated) or (kind == _DOUBT_OUT and path not in own))
            if not m[3].endswith("/") or tag not in _INLINE:
                stack.append(e)
                opened[tag] = opened.get(tag, 0) + 1
                inside += tag in ("article", "main")

    @staticmethod
    def _kind(tag, attributes, classes, inside) -> int:
        if tag in _BOILER_TAGS or (tag == "header" and not inside):
            return _SURE
        if tag in ("article", "main", "body") or not attributes:
            return 0
        role = attributes.get("role", "").lower()
        if role in _BOILER_ROLES and not (role == "banner" and inside):
            return _SURE
        if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return _SURE
        return _by_names(f"{classes} {attributes.get('id', '')}", bool(inside))

    def sizes(self) -> list[int]:
        """Signs of plain text, outside boilerplate and links, in each element."""
        size = [0] * len(self.tag)
        for e, t in self.texts:
            if t and not self.boiler[e] and not self.link[e]:
                size[e] += len(t) - t.count(" ")
        for e in range(len(size) - 1, 0, -1):
            size[self.parent[e]] += size[e]
        return size

    def best(self, size: list[int] | None = None) -> tuple[int, int]:
        """The smallest container with most of the page's plain text, and how much it has."""
        size = size or self.sizes()
        best = 0
        for e in range(1, len(size)):
            if self.tag[e] in _CONTAINERS and not self.boiler[e] and size[e] >= 0.7 * size[0] and size[e]:
                best = e  # elements are in page order: a later one with as much is inside an earlier one
        return best, size[best]

    def doubtful(self) -> list[tuple[bytes, bytes]]:
        """(path, digest of its text) of the elements left to the vote."""
        if not self.doubt:
            return []
        own = set(self.doubt)
        top = [-1] * len(self.tag)  # the doubtful element that holds each
        text: dict[int, list[str]] = {e: [] for e in own}
        for e in range(1, len(self.tag)):
            top[e] = e if e in own else top[self.parent[e]]
        for e, t in self.texts:
            if top[e] >= 0 and t:
                text[top[e]].append(t)
        return [(self.path[e], hashlib.blake2b(" ".join("".join(t).split()).encode(errors="replace"), digest_size=8).digest()) for e, t in sorted(text.items())]

    def text(self, paths: list[bytes]) -> str:
        size = self.sizes()
        own, most = self.best(size)
        rank = {p: i for i, p in enumerate(paths)}
        found: dict[bytes, list[int]] = {}
        for e in range(len(self.tag)):
            if self.path[e] in rank and self.tag[e] not in _INLINE and not self.boiler[e]:
                found.setdefault(self.path[e], []).append(e)
        held = {p: sum(size[e] for e in es) for p, es in found.items()}
        won = min(held, key=lambda p: (-held[p], rank[p]), default=None)
        roots = set(found[won]) if won is not None and 2 * held[won] >= most and (held[won] or not most) else {own}
        kept = [False] * len(self.tag)
        for e in range(len(self.tag)):
            kept[e] = (e in roots or (e > 0 and kept[self.parent[e]])) and not self.boiler[e]
        out = [references.unescape(t) if "&" in t else t or " " for e, t in self.texts if kept[e]]
        return " ".join("".join(out).split())


_BALLOT = ["host", "path", "vote", "text", "page"]


def _votes(batches):
    """Votes for best containers, and the texts of elements in doubt, with the digest of the page's own text."""
    for b in batches:
        rows: dict[tuple, float] = {}
        for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if source:
                page, host = Page(source), host_of(url)
                e, size = page.best()
                if size:
                    key = (host, page.path[e], None, None)
                    rows[key] = rows.get(key, 0) + math.log2(1 + size)
                doubt = page.doubtful()
                if doubt:
                    whole = hashlib.blake2b(page.text([]).encode(errors="replace"), digest_size=8).digest()
                    rows.update({(host, p, t, whole): 0.0 for p, t in doubt})
        cols = list(zip(*[(h, p, v, t, w) for (h, p, t, w), v in rows.items()])) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.float64(), pa.binary(), pa.binary()))], names=_BALLOT)


def _extract(batches):
    for b in batches:
        texts = [
            Page(s, frozenset(r or []), frozenset(o or [])).text(p or []) if s else "" for s, p, r, o in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))
        ]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def winners(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, its winning paths, best first, and the paths in doubt whose text repeats or is each page's own."""
    votes = pages.select("url", "html").mapInArrow(_votes, "host string, path binary, vote double, text binary, page binary")
    votes = common.cut(pages.sparkSession, votes.groupBy("host", "path", "text", "page").agg(F.round(F.sum("vote"), 3).alias("vote")))
    part = F.col("vote") / F.sum("vote").over(Window.partitionBy("host"))
    best = votes.where("text is null").withColumn("part", part).where(F.col("part") >= least_share)
    paths = best.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("vote")).alias("v"), "path"))), lambda x: x["path"]).alias("paths"))
    same = votes.where("text is not null").groupBy("host", "path").agg(F.count_distinct("page").alias("n"), F.count_distinct("text").alias("texts"))
    repeats = 2 * F.col("texts") <= F.col("n")
    lists = [F.collect_list(F.when(c, F.col("path"))).alias(n) for c, n in ((repeats, "repeated"), (~repeats, "own"))]
    return paths.join(same.where(F.col("n") >= DOUBT_PAGES).groupBy("host").agg(*lists), "host", "full")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    won = common.cut(spark, winners(pages))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][A-Za-z0-9_+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    own = pages.select("page_id", "url", "html", host.alias("__host"))
    won = won.withColumnRenamed("host", "__host")
    size = won.agg(F.sum(sum(F.greatest(F.size(c), F.lit(0)) for c in ("paths", "repeated", "own")))).first()[0] or 0
    if size <= BROADCAST_PATHS:
        joined = own.join(F.broadcast(won), "__host", "left")
    else:
        salted = won.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("__salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return joined.select("page_id", "url", "html", "paths", "repeated", "own").mapInArrow(_extract, schema)
