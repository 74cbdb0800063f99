"""Main text of web pages by equivalence-class template deduction.

1. Each page gives its tokens: opening tags, told apart by their path of tags and first classes or ids, and whole text nodes,
   told apart by path and words. Tokens with the same occurrence vector over the pages of a host (how often each occurs on
   each page) form an equivalence class. Vectors are never gathered: a class is recognised by how many pages it is on and two
   sums of hashes of (page, count), which merge by aggregation; map tasks sum before the shuffle.
2. Per host, classes on at least `support` pages are valid if they have two tokens or more, so each layout of a host has its own.
   Tags that occur once on a page are containers; classes are nested by the paths of their tags. A text is the template's if it
   is, any number of times, on a sufficient share of the pages that have the innermost container around it. What lies between
   the template's tokens are its slots.
3. The main container of a page is, of the containers that it has, an <article> or <main>, or else, of those that group blocks, the innermost that holds
   most of the slots' text which isn't in links or in parts that are named as something else; as a share of all such text of
   the pages with the container, so that layouts of short and of long pages compare. Its slots, read from the pages once more,
   are the text; blocks that hold nothing but text of the template, and slots in menus, adverts, comments and the like, are
   left out.

Parts are known as something else by their element, by a hidden or aria-hidden="true" attribute, or by their names: the words
of class, id and role. Names are a hint only. A name of words like has, with, no or of tells something about its element and
doesn't name it; a header inside an article is the article's; and a named element stays if it holds more than half of the
page's text and, of the page's <article>, <main> and <h1>, all there are. If nothing is left of a page that has no <article>
or <main>, its names count for nothing.

A host with fewer than PAGES pages has no template: its pages are cut by their structure alone. If no text but the template's
is in a page's main container (all pages of the host alike), that text stays.

Character references are decoded, white space within a block becomes one space, blocks are joined by \\n. Table cells and <br>
are white space.

Nulls: a null html has an empty text; a null url, or one without a host, belongs to the host "". Repeated rows get the same
result each. An empty table gives an empty result. Other columns stay out."""

from __future__ import annotations

import hashlib
import html
import os
import pickle
import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean, posix, saved, small_batches, work_dir
from .ngram_lm import gathered, write_array

PAGES = 4
#: Pages that a valid class is on: this share of the host's, but FEW or a RARE-th of them at most and PAGES at least. The last keeps the
#: number of tokens that a host's task gets below RARE times those of a page.
VALID, FEW, RARE = 0.05, 100, 1000
#: Share of a container's pages that a template text is on.
TEXT = 0.6
#: Of a container's text, what the innermost one that is chosen must hold.
MOST = 0.7
#: Bytes of all hosts' templates up to which they are broadcast, and of those in a file beyond.
BROADCAST_BYTES = SHARD_BYTES = 8 << 20
#: Templates that a worker remembers.
REMEMBERED = 256
#: Hosts up to which their numbers of pages are broadcast.
BROADCAST_HOSTS = 100_000

# HTML elements by role, and words in class, id and role attributes that name something other than the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
SPACE = frozenset("br td th".split())
OTHER = frozenset("head title nav footer aside form script style noscript template iframe object button select textarea svg menu dialog label input canvas audio video".split())
MAIN = frozenset("article main".split())
GROUPS = frozenset("html body main article section div center td".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners promo promotion promoted sponsor sponsored nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer "
    "sidebar aside comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login cookie cookies "
    "consent gdpr notice notices alert popup modal overlay search pagination pager toolbar widget widgets copyright disclaimer complementary contentinfo tags byline hidden skip".split()
)
#: Words of names that describe, as in has-sidebar, no-cookies, notice-of-award, overflow-hidden.
DESCRIBES = frozenset("has with without no not non of for is on off overflow visually".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
NOT_SHOWN = re.compile(r"aria-hidden\s*=\s*[\"']?true\b|display\s*:\s*none", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")


class Node:
    """An element. `cut`: something else by its element or attributes; `named`: by its names; `other`: one of them, or inside
    such a one, once the page is read."""

    __slots__ = ("tag", "path", "above", "cut", "named", "other", "link", "main", "size", "heads")

    def __init__(self, tag: str, path: str, above: Node | None, cut: bool, named: bool, link: bool, main: bool):
        self.tag, self.path, self.above, self.cut, self.named, self.other, self.link, self.main = tag, path, above, cut, named, False, link, main
        self.size = self.heads = 0


def names_other(name: str, main: bool) -> bool:
    words = [w.lower() for w in WORD.findall(name)]
    found = [w for w in (*words, name.lower()) if w in NAMED]
    if main:
        found = [w for w in found if w not in ("header", "masthead")]
    return bool(found) and DESCRIBES.isdisjoint(words)


def hidden(attributes: str) -> bool:
    low = "hidden" in attributes or "HIDDEN" in attributes.upper()
    return bool(low and HIDDEN.search(QUOTED.sub('""', attributes)) or NOT_SHOWN.search(attributes))


def opened(tag: str, attributes: str, above: Node) -> Node:
    names: list[str] = []
    for _, *value in ATTRIBUTE.findall(attributes):
        names += "".join(value).split()
    main = above.main or tag in MAIN or "articleBody" in attributes
    first = names[0] if names and not re.search(r"\d", names[0]) else ""
    cut = above.cut or tag in OTHER or (tag == "header" and not above.main) or bool(attributes) and hidden(attributes)
    named = (not tag.startswith("h") or tag in ("header", "hgroup")) and tag not in ("body", "article", "main") and any(names_other(n, above.main) for n in names)
    return Node(tag, f"{above.path}/{tag}.{first}" if first else f"{above.path}/{tag}", above, cut, named, above.link or tag == "a", main)


def parts(page: str) -> Iterator[tuple[str, Node]]:
    """What a page has in order: ("", node) for an opened element, ("\\n", node) for the edge of a block, " " for white space,
    "t" + text for a decoded text node."""
    stack = [Node("", "", None, False, False, False, False)]
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not text.isspace():
            yield "t" + html.unescape(text), stack[-1]
        elif text:
            yield " ", stack[-1]
        if not m:
            break
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in SPACE:
            yield " ", stack[-1]
        if slash:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k:
                for n in reversed(stack[k:]):
                    if n.tag in BLOCK:
                        yield "\n", n
                del stack[k:]
            continue
        gone = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        while len(stack) > 1 and stack[-1].tag in gone:
            if stack[-1].tag in BLOCK:
                yield "\n", stack[-1]
            stack.pop()
        if "p" in gone:  # an open paragraph with unclosed markup inside it ends too
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in BLOCK), 0)
            if k and stack[k].tag == "p":
                yield "\n", stack[k]
                del stack[k:]
        node = opened(tag, attributes, stack[-1])
        yield "", node
        if tag in BLOCK:
            yield "\n", node
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        stack.append(node)


def parsed(page: str) -> list[tuple[str, Node]]:
    """The parts of a page, with what is something else."""
    seen = list(parts(page))
    nodes = [n for w, n in seen if not w]
    for what, node in seen:
        if what[:1] == "t" and not node.cut:
            node.size += len(what)
    for n in reversed(nodes):
        n.heads += not n.cut and (n.tag in MAIN or n.tag == "h1")
        if n.above:
            n.above.size += n.size
            n.above.heads += n.heads
    top = seen[0][1] if seen else None
    while top and top.above:
        top = top.above
    for n in nodes:
        holds = n.heads and n.heads == top.heads and 2 * n.size > top.size
        n.other = n.cut or n.above.other or n.named and not holds
    if not any(w[:1] == "t" and not n.other for w, n in seen) and not any(n.main and not n.other for n in nodes):
        for n in nodes:
            n.other = n.cut
    return seen


def number(*of: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, of)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


TOKENS = "host string, token long, path string, tag boolean, pages long, low long, high long, chars long, whole long, main boolean, once long"


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of (host, page key, html), summed over the pages of a task. Token 0 counts pages."""

    def sent(sums: dict) -> pa.RecordBatch:
        rows = [(host, token, *v) for (host, token), v in sums.items()]
        types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), *(pa.int64(),) * 5, pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in TOKENS.split(", ")])

    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for host, key, page in zip(*(c.to_pylist() for c in batch.columns)):
            seen: dict[int, list] = {0: [None, False, 1, 0, False]}
            whole = 0
            for what, node in parsed(page or ""):
                if not what:
                    x = seen.setdefault(number("tag", node.path), [node.path, True, 0, 0, node.tag in MAIN and not node.other])
                    x[2] += 1
                elif what[0] == "t":
                    words = " ".join(what[1:].split())
                    x = seen.setdefault(number("text", node.path, words), [None if node.other else node.path, False, 0, 0, False])
                    x[2] += 1
                    if not node.other and not node.link:
                        whole += len(words)
                        path = node.path
                        while path:
                            seen.setdefault(number("tag", path), [path, True, 0, 0, False])[3] += len(words)
                            path = path.rpartition("/")[0]
            signs: dict[int, tuple[int, int]] = {}
            for token, (path, tag, count, chars, main) in seen.items():
                if count not in signs:
                    x = number("sign", key, count)
                    signs[count] = x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF
                v = sums.setdefault((host, token), [path, tag, 0, 0, 0, 0, 0, main, 0])
                v[2] += 1
                v[3] += signs[count][0]
                v[4] += signs[count][1]
                v[5] += chars
                v[6] += whole
                v[8] += count == 1
            if len(sums) > 200_000:
                yield sent(sums)
                sums = {}
    if sums:
        yield sent(sums)


def support(total: int) -> int:
    return max(PAGES, min(int(VALID * total), max(FEW, total // RARE)))


def deduced(table: pa.Table) -> tuple[list[int], list[tuple[str, float, bool]]]:
    """Template texts, and path, share of the pages' text and whether it is an <article> or <main> of each container that can be
    a page's main one, outermost first; of the tokens of one host."""
    rows = table.to_pylist()
    total = next((r["pages"] for r in rows if r["token"] == 0), 0)
    # a host with few pages has one layout, which is on half of them
    least = support(total) if total >= PAGES else total / 2
    found: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["token"] and r["pages"] >= least:
            found.setdefault((r["pages"], r["low"], r["high"]), []).append(r)
    # containers of the nested template: tags that occur once on each page that has them
    containers = {r["path"]: r for c in found.values() if len(c) > 1 for r in c if r["tag"] and r["once"] == r["pages"]}

    def around(path: str) -> dict | None:
        while path and path not in containers:
            path = path.rpartition("/")[0]
        return containers.get(path)

    texts = []
    if total >= PAGES:
        for r in rows:
            if r["token"] and not r["tag"] and r["path"] is not None and r["pages"] >= least:
                inside = around(r["path"])
                if r["pages"] >= TEXT * (inside["pages"] if inside else total):
                    texts.append(r["token"])
    mains: list[tuple[str, float, bool]] = []
    kept: dict[str, float] = {}
    for path, r in sorted(containers.items(), key=lambda x: (x[0].count("/"), x[0])):
        if path.rpartition("/")[2].partition(".")[0] not in GROUPS:  # a long paragraph isn't what holds a page's text
            continue
        share = r["chars"] / max(r["whole"], 1)
        if not share and not r["main"]:
            continue
        above = path.rpartition("/")[0]
        first = around(above) is None
        while above and not first:
            first = above in kept and share >= MOST * kept[above]
            above = above.rpartition("/")[0]
        if first:
            kept[path] = share
        if first or r["main"]:
            mains.append((path, share, r["main"]))
    return texts, mains


TEMPLATE = "host string, texts array<long>, mains array<struct<path: string, share: double, main: boolean>>"


def template(key: tuple, table: pa.Table) -> pa.Table:
    texts, mains = deduced(table)
    kind = pa.list_(pa.struct([("path", pa.string()), ("share", pa.float64()), ("main", pa.bool_())]))
    mains = [dict(zip(("path", "share", "main"), m)) for m in mains]
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([texts], pa.list_(pa.int64())), pa.array([mains], kind)], ["host", "texts", "mains"])


def chosen(mains: list[dict], there: set[str]) -> str | None:
    """The main container of a page that has the paths `there`."""
    here = [m for m in mains if m["path"] in there]
    if named := [m for m in here if m["main"]]:
        return max(named, key=lambda m: (m["share"], m["path"]))["path"]
    best = None
    for m in here:
        inner = best is not None and m["path"].startswith(best["path"] + "/")
        if best is None or (m["share"] >= MOST * best["share"] if inner else m["share"] > best["share"]):
            best = m
    return best and best["path"]


def extracted(page: str, texts: frozenset[int], mains: list[dict]) -> str:
    """The slots of the main container. Without one on this page: its own <article> or <main>, or else the whole page."""
    seen = parsed(page)
    path = chosen(mains, {n.path for w, n in seen if not w})
    if path is None:
        inside = (lambda n: n.main) if any(n.main and not n.other for w, n in seen if w[:1] == "t") else lambda n: True
    else:
        inside = lambda n: n.path == path or n.path.startswith(path + "/")
    for fixed in (texts, frozenset()):
        blocks: list[tuple[list[str], list[bool]]] = [([], [])]
        for what, node in seen:
            if what == "\n":
                blocks.append(([], []))
            elif what == " ":
                blocks[-1][0].append(" ")
            elif what and inside(node) and not node.other:
                blocks[-1][0].append(what[1:])
                blocks[-1][1].append(not fixed or number("text", node.path, " ".join(what[1:].split())) not in fixed)
        out = [x for x in (" ".join("".join(b).split()) for b, slots in blocks if any(slots)) if x]
        if out or not texts:
            break
    return "\n".join(out)


def answer(batch: pa.RecordBatch, out: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[tuple, frozenset[int]] = {}
        out = []
        for page, texts, mains in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            key = tuple(texts or ())
            out.append(extracted(page or "", known.setdefault(key, frozenset(key)), mains or []))
        yield answer(batch, out)


class Stored:
    """Templates of many hosts in the shared folder: sorted hashes of hosts, and each host's template at its place, in shards that workers map. A
    page is looked up where it is, so pages are never shuffled."""

    def __init__(self, templates: DataFrame, size: int, root: str):
        self.root, self.shards = root, max(1, size // SHARD_BYTES)
        shard = F.pmod(F.xxhash64("host"), F.lit(self.shards)).cast("int")

        def written(key: tuple, table: pa.Table) -> pa.Table:
            rows = sorted(((number("host", r["host"]), r) for r in table.select(["host", "texts", "mains"]).to_pylist()), key=lambda x: x[0])
            blobs = [pickle.dumps((r["host"], frozenset(r["texts"]), r["mains"]), 5) for _, r in rows]
            at = np.cumsum([0, *map(len, blobs)])
            for name, a in (("key", np.array([k for k, _ in rows], np.int64)), ("at", at), ("blob", np.frombuffer(b"".join(blobs), np.uint8))):
                write_array(f"{root}/{key[0].as_py()}.{name}.npy", a)
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(rows)], pa.int64())], ["shard", "n"])

        os.makedirs(root, exist_ok=True)
        made = gathered(templates.withColumn("shard", shard), written, "shard int, n long", self.shards).collect()
        self.sizes = {r["shard"]: r["n"] for r in made}

    def reader(self) -> Callable:
        root, sizes = self.root, self.sizes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = cache(lambda shard: tuple(np.load(f"{root}/{shard}.{name}.npy", mmap_mode="r") for name in ("key", "at", "blob")))

            @lru_cache(REMEMBERED)
            def template_of(host: str, shard: int) -> tuple[frozenset[int], list[dict]]:
                if not sizes.get(shard):
                    return frozenset(), []
                keys, at, blob = files(shard)
                if len(keys) != sizes[shard]:
                    raise ValueError(f"{root}/{shard}.key.npy has {len(keys)} values instead of {sizes[shard]}")
                k = int(np.searchsorted(keys, number("host", host)))
                while k < len(keys) and keys[k] == number("host", host):
                    name, texts, mains = pickle.loads(blob[at[k] : at[k + 1]].tobytes())
                    if name == host:
                        return texts, mains
                    k += 1
                return frozenset(), []

            for batch in batches:
                yield answer(batch, [extracted(page or "", *template_of(host, shard)) for page, host, shard in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))])

        return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    tokens = rows.select("host", F.xxhash64("page_id", "url", "html").cast("string").alias("key"), "html").mapInArrow(lean(tokenised), TOKENS)
    summed = saved(
        tokens.groupBy("host", "token").agg(F.first("path", True).alias("path"), F.max("tag").alias("tag"), *(F.sum(c).alias(c) for c in ("pages", "low", "high", "chars", "whole")), F.max("main").alias("main"), F.sum("once").alias("once")),
        work_dir(spark, "tokens"),
    )
    totals = summed.where(F.col("token") == 0).select("host", F.col("pages").alias("total"))
    # a host keeps tokens on `support` pages; the rest goes before the shuffle by host
    if totals.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        totals = F.broadcast(totals)
    least = F.when(F.col("total") < PAGES, F.col("total") / 2).otherwise(F.greatest(F.lit(PAGES), F.least((F.col("total") * VALID).cast("long"), F.greatest(F.lit(FEW), F.floor(F.col("total") / RARE)))))
    least = F.when(F.col("token") == 0, 0).otherwise(least)
    frequent = summed.join(totals, "host").where(F.col("pages") >= least).drop("total")
    templates = saved(frequent.groupBy("host").applyInArrow(template, TEMPLATE), work_dir(spark, "templates"))
    size = templates.agg(F.sum(F.length("host") + 8 * F.size("texts") + F.aggregate("mains", F.lit(0), lambda n, m: n + F.length(m["path"]) + 32) + 64)).first()[0] or 0
    types = pages.schema
    schema = f"page_id {types['page_id'].dataType.simpleString()}, url {types['url'].dataType.simpleString()}, text string, n_chars long"
    path = work_dir(spark, "stored")
    if size <= BROADCAST_BYTES or not path.startswith(("/", "file:")):  # in a store that workers can't map, pages are shuffled
        known = F.broadcast(templates) if size <= BROADCAST_BYTES else templates
        return rows.join(known, "host", "left").select("page_id", "url", "html", "texts", "mains").mapInArrow(lean(read), schema)
    stored = Stored(templates, size, posix(path))
    return rows.select("page_id", "url", "html", "host", F.pmod(F.xxhash64("host"), F.lit(stored.shards)).cast("int")).mapInArrow(lean(stored.reader()), schema)
