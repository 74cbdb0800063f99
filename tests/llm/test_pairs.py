"""Near duplicates, decontamination, page extraction, nearest neighbours and the pipeline against brute force."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, documents, edited, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from vistamap.llm import _shared, components, decontamination, html_extraction, near_dups, nearest


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def leaders(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def groups_by_force(rows, n, percent):
    sets = {}
    for doc, text in rows:
        w = words(text)
        sets.setdefault(doc, []).append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    return sets, leaders(sets, edges)


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_dups(docs, empty, n, percent):
    rows = [(r[0], r[1]) for r in documents() if r[0] is not None]
    sets, leader = groups_by_force(rows, n, percent)
    # other columns have names that are used inside
    got = near_dups.near_dups(docs.withColumnsRenamed({"lang": "signature", "source": "cid", "n_chars": "n_shingles"}), n, percent).collect()
    assert len(got) == len(documents())
    assert len(set(leader.values())) < len(sets) - 20
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert r.n_shingles in map(len, sets[r.doc_id])
            assert (r.component_id, r.kept) == (leader[r.doc_id], leader[r.doc_id] == r.doc_id)
    assert near_dups.near_dups(empty, n, percent).count() == 0


def test_workers_write_wide_tables(spark, docs, monkeypatch):
    """Signatures are in files that Spark's own writer, which starts processes for permissions and leaves checksums, didn't make. A store
    that isn't mounted gets Spark's, with the same rows; a file that no task handed over isn't read."""
    kept = []
    monkeypatch.setattr(_shared, "removed", lambda spark, path: kept.append(path))
    near_dups.near_dups(docs.select("doc_id", "text"))
    names = [x for x in os.listdir(f"{kept[0]}/sketches-1") if x.endswith((".parquet", ".crc"))]
    assert names and not [x for x in names if x.endswith(".crc")]
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(3)
    path = _shared.work_dir(spark, "workers")
    monkeypatch.setattr(_shared, "GROUP_BYTES", 20_000)  # several row groups
    own = _shared.mapped(base, near_dups.sketcher(5), near_dups.SKETCH, path)
    with open(f"{path}/_left", "wb") as f:
        f.write(b"not ended")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./all", "file:///")
    other = _shared.mapped(base, near_dups.sketcher(5), near_dups.SKETCH, f"viewfs://store/all{path}-other")
    assert os.path.exists(f"{path}-other/_SUCCESS") and not os.path.exists(f"{path}/_SUCCESS")
    rows = [sorted(x.collect(), key=repr) for x in (own, other, base.mapInArrow(near_dups.sketcher(5), near_dups.SKETCH))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == docs.count()


def test_near_dups_of_a_large_group_without_a_centre(spark, monkeypatch):
    """Copies of copies: many pairs of one bucket are near the threshold on either side; tiles are small."""
    monkeypatch.setattr(near_dups, "TILE", 16)
    rows, texts = [], [prose(1, 120)]
    for k in range(160):
        texts.append(edited(random.Random(k).choice(texts), k, 3 + k % 3))
    rows = list(enumerate(texts))
    _, leader = groups_by_force(rows, 3, 85)
    assert 5 < len(set(leader.values())) < 150
    got = near_dups.near_dups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == leader


def test_posterior_bound():
    least = near_dups.least_matches(0.8, 1e-6)
    assert all(a < b for a, b in itertools.pairwise(least.values()))
    # a pair at the threshold hardly ever fails the last bound
    n, m = near_dups.HASHES, least[near_dups.HASHES]
    draws = np.random.Generator(np.random.PCG64(1)).binomial(n, 0.8, 200_000)
    assert (draws < m).mean() < 1e-4


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    with _shared.Scratch(spark, "test") as scratch:
        got = components.components(spark.createDataFrame(edges, "a long, b long"), scratch)
        assert {x.node: x.component for x in got.collect()} == leaders(nodes, [e for e in edges if e[0] != e[1]])
    assert not os.path.exists(scratch.path)


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 26])
def test_key_filter(spark, monkeypatch, bits):
    """Every row of a key is picked, every row once, and few others while the bitmap is sparse."""
    monkeypatch.setattr(_shared, "FILTER_BITS", bits)
    rows = [(i, f"t{i}", i) for i in range(500)] * 2 + [(None, None, 1)]
    frame = spark.createDataFrame(rows, "k long, t string, __word int")
    with _shared.Scratch(spark, "test") as scratch:
        for keys in ([1, 2, 499, 10_000], [None, 3], []):
            picked = _shared.KeyFilter(spark.createDataFrame([(k,) for k in keys], "x long"), scratch)
            maybe, rest = (list(map(tuple, x.collect())) for x in picked.split(frame, F.col("k")))
            assert sorted(maybe + rest, key=str) == sorted(rows, key=str)
            assert not {r[0] for r in rest} & set(keys)
            assert bits < 100 or len(maybe) <= 2 * len(keys) + 2 * (bits < 1 << 20)


ITEMS = [
    (1, "Anna buys 12 apples at the market and gives 5 apples to Peter. How many apples does Anna have left?"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, "A train that goes 80 km in 2 hours needs how many hours for 240 km?"),
    (4, "too short"),
    (7, "Blue moon rises"),
    (8, "Is 41 odd?"),
    (5, "Seven words are enough for a match"),
    (6, None),
    (None, "items without an id are not searched for at all in any case"),
]
CASES = [
    (1, "Intro text. Anna buys 12 apples at the market and gives 5 apples to Peter. How many apples does Anna have left? Outro.", [1]),
    (2, "once more: Berta buys 31 apples at the market and gives 7 apples to Karl. How many apples does Berta have left?", [1]),
    (3, "Today Berta buys 31 apples at the market and gives 7 apples to Karl. How many apples does Karl have left?", [1]),
    (4, "ANNA BUYS 12 APPLES AT THE MARKET AND GIVES 5 APPLES TO PETER. HOW MANY APPLES DOES ANNA HAVE LEFT?", [1]),
    (5, "we saw the quick brown fox jumps over the lazy dog near", []),
    (6, "THE QUICK, brown fox jumps over -- the lazy dog near the old river bank today!", [2]),
    (7, "A train that goes 90 miles in 3 hours needs how many hours for 360 miles?", [3]),
    (8, "A train that goes 90 miles in 3 hours needs how many hours for 90 km?", []),
    (9, "seven words are enough for a match", [5]),
    (10, "too short", [4]),
    (15, "this is too short, or too\nlong", []),
    (16, "First line.\n Too short! \nthird", [4]),
    (17, "Tonight the blue moon rises over the hill", [7]),
    (18, "Solve: is 41 odd? Then: is 43 odd?", [8]),
    (19, "Is 43 odd?", []),
    (11, "Paris London Rome Berlin Madrid Vienna Prague Oslo 1 2 3 4 5 6 7 8 9 10 11 12", []),
    (12, None, []),
    (13, "", []),
    (14, "12 " * 3000 + "the quick brown fox jumps over the lazy dog near the old river bank today" + " km" * 3000, [2]),
    (None, "the quick brown fox jumps over the lazy dog near the old river bank today", [2]),
]


def canonical(text):
    """(word, kind, begins a line, ends a line) of each token."""
    out, last = [], None
    for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+(?:[.,][0-9]+)*", text):
        word = re.sub("[A-Z\u00c0-\u00d6\u00d8-\u00de]", lambda c: c[0].lower(), m[0])
        between = text[last.end() : m.start()] if last else "\n"
        number = m[0][0] in "0123456789" or word in decontamination.NUMBERS
        unit = not number and bool(out) and out[-1][1] == "n" and word in decontamination.UNITS
        name = re.match("[A-Z\u00c0-\u00d6\u00d8-\u00de]", m[0]) and not set(".!?:\n") & set(between) and last
        if out:
            out[-1][3] = "\n" in between
        out.append([word, "n" if number else "u" if unit else "m" if name else "w", "\n" in between, True])
        last = m
    return out


def contaminated_by_force(text, item):
    """Whether the windows at some distances show that text holds item: every pair of positions is looked at."""
    d, b = canonical(text), canonical(item)
    size = min(8, len(b))
    if not size:
        return False
    runs = {}
    for p in range(len(d) - size + 1):
        for q in range(len(b) - size + 1):
            x, y = d[p : p + size], b[q : q + size]
            if size < 3 and not all(w[0][2] and w[-1][3] for w in (x, y)):
                continue
            for mode in ("plain", "names", "literal"):
                kinds = [["w" if k == "m" and mode != "names" else k for _, k, *_ in w] for w in (x, y)]
                words = kinds[1].count("w")
                own = words * 2 >= size and words >= min(4, size)
                if mode == "literal":
                    if own or kinds[0] != kinds[1] or [w for w, *_ in x] != [w for w, *_ in y]:
                        continue
                    runs.setdefault(p - q, []).append((q, mode, True, []))
                elif kinds[0] == kinds[1] and all(u[0] == v[0] for u, v, k in zip(x, y, kinds[0]) if k == "w") and (mode == "plain" or "m" in kinds[0]):
                    runs.setdefault(p - q, []).append((q, mode, own, [((k, v[0]), (k, u[0])) for u, v, k in zip(x, y, kinds[0]) if k != "w"]))
    at = set()

    def fits(pairs):
        names = [b for a, b in pairs if a[0] == "m"]
        return len({a for a, _ in pairs}) == len(pairs) and len(set(names)) == len(names)

    for run in runs.values():
        led = any(own and mode != "literal" for _, mode, own, _ in run)
        run = [w for w in run if w[2] or led]
        told = {m: {x for _, mode, own, ps in run if mode == m and own for x in ps} for m in ("plain", "names", "literal")}
        both = {m: {x for _, mode, _, ps in run if mode == m for x in ps} for m in ("plain", "names", "literal")}
        good = [(q, mode, own) for q, mode, own, ps in run if (fits(told[mode]) or all(a == b for a, b in ps) if own else fits(both[mode]))]
        leads = any(own and mode != "literal" for _, mode, own in good)
        at |= {q for q, _, own in good if own or leads}
    return len(at) >= max(1, min(13, len(b)) - size + 1)


def items_by_force(docs, bench):
    return {d: sorted(i for i, t in bench if i is not None and t is not None and x is not None and contaminated_by_force(x, t)) for d, x in docs}


def test_decontamination(spark, empty):
    bench = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, pos int")
    docs = spark.createDataFrame([(d, t, "kept") for d, t, _ in CASES] * 2, "doc_id long, text string, slots string")
    got = decontamination.decontaminate(docs, bench).collect()
    assert len(got) == 2 * len(CASES)
    force = items_by_force([c[:2] for c in CASES if c[0] != 14], ITEMS)
    expected = {d: e for d, _, e in CASES}
    for r in got:
        if r.doc_id not in (3, None):  # of 3, enough windows have consistent values, whatever the last ones have
            assert r.items == expected[r.doc_id], r.doc_id
        assert (r.items, r.contaminated, r.slots) == (force.get(r.doc_id, [2]), bool(r.items), "kept"), r.doc_id
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert not decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count()


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_decontamination_by_force(spark, monkeypatch, bits):
    """Items with changed numbers, names, units and words, in all mixtures; with a bitmap that lets everything through as well."""
    monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
    r = random.Random(8)
    words, names, units = "the old mill makes of flour and wood for every road".split(), "Anna Karl Berta Otto Émile".split(), "km miles hours kg".split()

    def token():
        x = r.random()
        return r.choice(words) if x < 0.6 else r.choice(names) if x < 0.75 else str(r.randrange(30)) if x < 0.9 else f"{r.randrange(9)} {r.choice(units)}"

    bench = [(k, " ".join(token() for _ in range(r.choice((1, 2, 3, 5, 8, 9, 14, 20, 30)))) + r.choice(".?!")) for k in range(24)]
    docs = []
    for k in range(150):
        out = []
        for w in r.choice(bench)[1].split(" "):
            x = r.random()
            same = r.random() < 0.7
            if w.strip(".?!") in names and not same:
                w = names[(names.index(w.strip(".?!")) + k) % len(names)]
            elif w.strip(".?!").isdigit() and not same:
                w = str((int(w.strip(".?!")) * 7 + k) % 30)
            elif w in units and not same:
                w = units[(units.index(w) + k) % len(units)]
            out += [] if x < 0.02 else [w, token()] if x > 0.98 else [w]
        docs.append((k, (" ".join(token() for _ in range(r.randrange(6))) + r.choice((" ", ". ", "\n"))) * r.randrange(2) + " ".join(out) + r.choice(("", "\nEnd of it", " " + token()))))
    force = items_by_force(docs, bench)
    assert 20 < sum(map(bool, force.values())) < 140
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {x.doc_id: x.items for x in got.collect()} == force


def test_decontamination_of_items_with_few_words(spark, monkeypatch):
    bench = [
        (1, "What is the sum of 12, 7, 9, 4, 3?"),
        (2, "What is 17 times 23?"),
        (3, "Sort: 5 19 33 4 81 62 7 90 18 26 44 3 71 6 58."),
        (4, "In the race Anna, Peter, Karl, Berta, Emil and Otto came home in 12, 7, 9, 4, 3 and 2 minutes."),
    ]
    cases = [
        *((i, f"Exercise. {t} Solve it.", [i]) for i, t in bench),
        (5, "Next: what is the sum of 51, 8, 6, 14, 2? Solve it.", [1]),
        (6, "What is the sum of 51, 8, 6 and more?", []),
        (7, "What is 18 times 23? Sort: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", []),
        (8, "In the race Ida, Max, Paul, Nora, Hans and Kurt came home in 21, 8, 6, 5, 1 and 17 minutes.", [4]),
        (9, "1 2 3 4 5 6 7 8 " * 50, []),
        (None, "what is the sum of 51, 8, 6, 14, 2?", [1]),
    ]
    for filtered in (True, False):
        if not filtered:
            monkeypatch.setattr(decontamination, "FILTER_BITS", 64)
        docs = spark.createDataFrame([(d, t) for d, t, _ in cases], "doc_id long, text string")
        got = decontamination.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
        assert {r.doc_id: r.items for r in got} == {d: e for d, _, e in cases}


def page(k, article, host="a.example", brand="Daily News"):
    html = f"""<!DOCTYPE html><html><head><title>{brand} {k}</title><style>p{{}}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
    <header class="top"><a href="/">{brand}</a></header><ul class="menu"><li><a href="/1">World<li><a href="/2">Sport</ul><div id="cookie-notice">We use cookies</div>
    <div class="content"><div class="sponsor">Buy {k} now</div>{article}<form><input name=q>Search {k}</form><p>Share this story</p>
    <section class="comments"><p>reader {k} says hello there, a long comment of a reader that is no text of the article</p></section></div>
    <div class="sidebar"><p>Most read {k}</p></div><!-- <p>hidden</p> --><div class="footer">&copy; {brand}</div></body></html>"""
    return (k, f"https://{host}/x/{k}?q=1", html)


def test_main_text(spark):
    bodies = {k: [f"Title {k} &amp; more", f"First <b>para</b>graph   number\n{k}, {prose(k, 40)}", f"Second<br>part {k * k}&nbsp;end {prose(k + 50, 30)}"] for k in range(8)}
    rows = [page(k, f"<h1>{b[0]}</h1><p>{b[1]}</p><p>{b[2]}") for k, b in bodies.items()]
    rows += [(100, "https://b.example/1", f"<html><nav>menu</nav><article><p>one</p><aside>no</aside><p>{prose(7)}</p></article><footer>no</footer>"), (101, None, "plain <i>text</i> &lt;here&gt;"), (102, "https://c.example/", None), (103, "", ""), (104, "nonsense", "<p class=\"unclosed><b>x</b></p> < tail"), (0, *rows[0][1:])]
    rows += [(200 + k, f"https://same.example/{k}", "<html><body><nav>menu</nav><article><p>always the same</p></article></body></html>") for k in range(6)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, texts string")
    got = html_extraction.main_text(frame).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for k, b in bodies.items():
        flat = [" ".join(x.replace("<b>", "").replace("</b>", "").replace("<br>", " ").replace("&amp;", "&").replace("&nbsp;", " ").split()) for x in b]
        assert text[k] == "\n".join(flat)
    assert (text[100], text[101], text[102], text[103]) == (f"one\n{prose(7)}", "plain text <here>", "", "")
    assert all(text[200 + k] == "always the same" for k in range(6))
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extraction.main_text(frame.limit(0)).count() == 0


PROBES = {
    '<body class="has-sidebar"><p>Hello</p></body>': "Hello",
    '<div class="has-sidebar"><p>Hello</p></div>': "Hello",
    '<div class="page-with-sidebar"><p>Hello</p></div>': "Hello",
    '<div class="theme-no-cookies"><p>Hello</p></div>': "Hello",
    '<div class="overflow-hidden"><p>Hello</p></div>': "Hello",
    '<main aria-hidden="false"><p>Hello</p></main>': "Hello",
    '<main><p>Hello</p><div class="notice-of-award"><p>An award</p></div></main>': "Hello\nAn award",
    '<article><header class="entry-header"><h1>Title</h1></header><p>Hello</p></article>': "Title\nHello",
    # a wrapper that is named after one of its parts
    '<div class="sidebar-layout"><h1>Title</h1><p>Hello, a long text</p><div class="sidebar">no</div></div>': "Title\nHello, a long text",
    '<div class="widget"><article><p>Hello</p></article></div><div class="widget"><p>no</p></div>': "Hello",
    # nothing else on the page
    '<div class="sidebar">only this</div>': "only this",
    # what is named, or hidden, still goes
    '<article><p>Hello</p></article><section class="comments"><p>many words of many readers, more than the article has</p></section>': "Hello",
    '<article><p>Hello</p></article><div class="related"><article><p>another one, longer than the first</p></article></div>': "Hello",
    '<article></article><section class="comments"><p>words of readers</p></section>': "",
    '<header class="top"><p>no</p></header><p>Hello</p><div class="cookie-notice">no</div>': "Hello",
    "<div hidden><p>no</p></div><p>Hello</p>": "Hello",
    '<div aria-hidden=true><p>no</p></div><p data-note="a hidden word">Hello</p>': "Hello",
    '<p style="display: none">no</p><p>Hello</p>': "Hello",
}


def test_names_are_hints(spark):
    rows = [(k, f"https://h{k}.example/", h) for k, h in enumerate(PROBES)]
    got = {r.page_id: r.text for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(len(rows))] == list(PROBES.values())


def test_classes_are_those_of_the_occurrence_vectors():
    """Tokens that share page counts and sums of signs are those with equal vectors of counts, gathered here in full."""
    r = random.Random(5)
    pages = []
    for k in range(40):
        rows = "".join(f"<li class='r{x}'>{r.choice('abcdef')}</li>" for x in r.choices("pqrst", k=r.randrange(1, 6)))
        box = f"<div class='box'><span>Buy</span><b>{k % 3}</b></div>" * (k % 4)
        pages.append((f"h{k % 2}", str(k), f"<body><ul>{rows}</ul>{box}<div class='main'><p>{prose(k, 9)}</p><p>Read on</p></div></body>"))
    vectors = {}
    for host, key, page in pages:
        for what, node in html_extraction.parsed(page):
            token = html_extraction.number("tag", node.path) if not what else html_extraction.number("text", node.path, " ".join(what[1:].split())) if what[0] == "t" else None
            if token is not None:
                vectors.setdefault((host, token), {}).setdefault(key, 0)
                vectors[host, token][key] += 1
    batch = pa.RecordBatch.from_pylist([{"host": h, "key": k, "html": p} for h, k, p in pages])
    got = {}
    for out in html_extraction.tokenised(iter([batch.slice(0, 15), batch.slice(15)])):
        for x in out.to_pylist():
            v = got.setdefault((x["host"], x["token"]), [0, 0, 0])
            v[:] = v[0] + x["pages"], v[1] + x["low"], v[2] + x["high"]
    assert {k for k in got if k[1]} == set(vectors)
    by_vector, by_sums = {}, {}
    for k, v in vectors.items():
        by_vector.setdefault((k[0], tuple(sorted(v.items()))), set()).add(k)
        by_sums.setdefault((k[0], *got[k]), set()).add(k)
    assert sorted(map(sorted, by_vector.values())) == sorted(map(sorted, by_sums.values()))
    assert 10 < len(by_vector) < len(vectors)


@pytest.mark.parametrize("stored", ["broadcast", "files", "shuffle"])
def test_main_text_of_hosts_with_several_layouts(spark, monkeypatch, stored):
    """Layouts on 60 and 40 % of the pages, a third on few; a box on 70 % of a host's pages; a text twice on each page."""

    def several(k):
        body = f"<p>{prose(k, 40)}</p>"
        if k >= 20:
            body = f'<div class="c"><div class="cin">{body}<p>third note</p></div><div class="cside"><p>Third box</p><p>{k}</p></div></div>'
        elif k % 5 < 3:
            body = f'<div class="a"><div class="ain">{body * 3}<p>Read on in the paper</p></div><div class="aside1"><p>First box</p><p>{k}</p></div></div>'
        else:
            body = f'<div class="b"><p>Printed in the evening</p><div class="bin">{body}<span>Our desk</span></div><div class="bside"><p>{k}</p></div></div>'
        return (k, f"https://several.example/{k}", f"<html><body>{body}</body></html>")

    def boxed(k):
        box = '<div class="box"><p>Win a prize</p></div><p>Write to us</p>' if k % 10 < 7 else ""
        return (100 + k, f"https://boxed.example/{k}", f'<html><body><div class="x"><p>Part of it</p><p>{prose(k, 30)}</p>{box}<p>Part of it</p></div></body></html>')

    def copied(k):  # the same article on three of many pages is no template
        return (200 + k, f"https://copied.example/{k}", f'<html><body><div class="x"><h1>T {k}</h1><p>{prose(0 if k < 3 else k, 30)}</p><p>{prose(500 + k, 30)}</p></div></body></html>')

    if stored != "broadcast":  # templates in files, a few to each
        monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(html_extraction, "SHARD_BYTES", 300)
        monkeypatch.setattr(html_extraction, "REMEMBERED", 1)
    if stored == "shuffle":
        path = html_extraction.work_dir
        monkeypatch.setattr(html_extraction, "work_dir", lambda spark, name: "store://x" if name == "stored" else path(spark, name))
    rows = [*map(several, range(26)), *map(boxed, range(20)), *map(copied, range(20))]
    text = {r.page_id: r.text for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(26):
        assert text[k] == "\n".join([prose(k, 40)] * (3 if k < 20 and k % 5 < 3 else 1)), k
    for k in range(20):
        assert text[100 + k] == prose(k, 30)
        assert text[200 + k] == f"T {k}\n{prose(0 if k < 3 else k, 30)}\n{prose(500 + k, 30)}"


@pytest.mark.parametrize("small", [False, True])
def test_nearest(spark, monkeypatch, small):
    if small:  # many blocks and chunks
        monkeypatch.setattr(nearest, "LEAST", 50)
        monkeypatch.setattr(nearest, "CHUNK", 16 * 24)
    r = np.random.Generator(np.random.PCG64(5))
    vectors = [r.standard_normal(24).tolist() for _ in range(900)]
    vectors[50:90] = [vectors[0]] * 40
    odd = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [], [1.0, 2.0]]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(1000 + 10 * i, v, 0) for i, v in enumerate(odd)] + [(None, vectors[1], 0), (20, vectors[20], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for x in nearest.nearest(frame, frame.where("vec_id % 10 = 0"), 10).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    v = np.array(vectors, np.float32).astype(float)
    v, ids = np.concatenate([v, v[20:21]]), np.r_[np.arange(900), 20]
    hits = 0
    assert set(got) == set(range(0, 900, 10))
    for q, found in got.items():
        found.sort()
        distance = np.sqrt(((v - v[q]) ** 2).sum(1))
        best = [int(ids[i]) for i in np.lexsort((ids, distance)) if ids[i] != q][:10]
        assert [k for k, *_ in found] == list(range(1, 11))
        assert all(s == pytest.approx(distance[ids == i][0], abs=1e-12) for _, i, s in found)
        assert [s for *_, s in found] == sorted(s for *_, s in found)
        hits += len({i for _, i, _ in found} & set(best))
    assert hits >= 0.9 * 10 * len(got)
    assert [i for _, i, _ in got[0]] == list(range(50, 60))
    assert nearest.nearest(frame.limit(0), frame, 3).count() == 0 == nearest.nearest(frame, frame.limit(0), 3).count()
    few = nearest.nearest(frame.where("vec_id < 4"), frame.where("vec_id < 1"), 10).collect()
    assert [x.vec_id for x in few] == sorted((1, 2, 3), key=lambda i: ((v[i] - v[0]) ** 2).sum())


def test_pipeline(spark, tmp_path):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 9000]
    leak = prose(777, 40)
    rows.append((5000, "Start. " + leak + " and the rest of it", "en", "src1", 1))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, before = docs.columns, docs.collect()
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), str(tmp_path / name))
        after = docs.collect()
        seen[name] = after
        if name == "language_id":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if r.text and any(c.isalpha() for c in r.text))
        if name == "line_dedup":
            places = {}
            for r in before:
                for pos, line in enumerate(r.text.split("\n")):
                    if line.strip(" "):
                        places.setdefault(line.strip(" ").lower(), []).append((-1 if r.doc_id is None else r.doc_id, pos, r.source))
            spread = {x: min(v)[:2] for x, v in places.items() if len({p[2] for p in v if p[2] is not None}) >= 10}
            left = []
            for r in before:
                lines = r.text.split("\n")
                kept = [x for pos, x in enumerate(lines) if spread.get(x.strip(" ").lower(), (r.doc_id, pos)) == (r.doc_id, pos)]
                if len(kept) == len(lines) or "".join(kept).strip(" "):
                    left.append((r.doc_id, "\n".join(kept)))
            assert spread and sorted(map(repr, left)) == sorted(repr((r.doc_id, r.text)) for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "near_dups":
            _, leader = groups_by_force([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            leader[None] = None
            assert {r.doc_id for r in after} == set(leader.values())
            assert len(after) == len({(r.doc_id, r.text) for r in before if leader[r.doc_id] == r.doc_id})
        if name == "decontamination":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {5000}
        if name != "packing":
            assert docs.columns == columns == [c.split()[0] for c in DOCS.split(", ")]
    there = set(os.listdir(_shared.shared_dir(spark)))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, again.select("doc_id", "start", "length", "ids_crc32").collect()))) == sorted(repr((r.doc_id, r.start, r.length, r.ids_crc32)) for r in seen["packing"])
    # what it leaves is its result
    assert [x.partition("-")[0] for x in set(os.listdir(_shared.shared_dir(spark))) - there] == ["packing"]
    assert sum(r.length for r in seen["packing"] if r.start == 0) and {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["decontamination"]}
