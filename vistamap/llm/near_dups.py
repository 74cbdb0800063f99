"""Near-duplicate documents: MinHash, banding, sequential Bayesian verification, exact verification.

1. A map over texts makes each document's shingle count, a 128-bit hash of its shingle set and its signature.
   Documents with equal sets are one class, so copies cost one row from there on. Signatures and texts are wide; a bitmap of
   keys picks those that are asked for before any is shuffled, and texts move compressed.
2. Classes that share a band of their signatures are candidates. In each bucket every class is first compared with
   the smallest one only; components of the links found show which buckets are settled. In the others, classes outside the
   bucket's largest component are compared with all classes of other components, in tiles of bounded size that verify
   on full sets at once and give a spanning set of links: pairs within one component can't change the result, every
   other candidate pair is looked at.
3. Signatures are compared a batch of positions at a time; a pair is dropped as soon as the posterior probability of a
   similarity at the threshold or above, given the matches so far and a uniform prior, falls below `miss`.
4. Survivors are verified on the full shingle sets of the two texts, the likeliest pair of each class first; pairs whose
   classes are in one component by then need no verification.

With the defaults a pair at the threshold of 0.85 shares no band with probability 3e-7.

Nulls: a null or wordless text has no shingles and is linked with nothing; rows with a null doc_id are left out of
linking, get a null component and are kept. Rows that share a doc_id are one node: what any of them is linked with is
linked. An empty table gives an empty result. Other columns stay out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import KeyFilter, Scratch, chunks, fewer, lean, saved, small_batches, work_dir
from ._text import U, grams, mix, words
from .components import components

BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
TILE = 1024
#: Texts of a tile that are cut into shingles at a time.
SLICE = 64
#: Bytes of texts that are unpacked at a time.
UNPACKED = 1 << 19
SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, signature binary"
_seeds = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, (2, HASHES), dtype=np.uint32)
_FLIP, _TIMES = _seeds[0], _seeds[1] | np.uint32(1)


def distinct_grams(values: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of each text's distinct shingles, in order of the rows."""
    doc, h = grams(words(values), n)
    bits = max(1, len(values).bit_length())
    order = np.argsort((doc.astype(np.uint64) << U(64 - bits)) | (h >> U(bits)))
    doc, h = doc[order], h[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[first], h[first]


def sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, h = distinct_grams(part.column(1), n)
                count = np.bincount(doc, minlength=len(part)).astype(np.int64)
                some = np.flatnonzero(count)
                sums = np.zeros((2, len(part)), np.uint64)
                signature = np.full((len(part), HASHES), 0xFFFFFFFF, np.uint32)
                if len(some):
                    first = np.concatenate([[0], np.cumsum(count[some])[:-1]])
                    sums[0, some] = np.add.reduceat(mix(h ^ U(0x1F123BB5159A55E5)), first)
                    sums[1, some] = np.add.reduceat(mix(h + U(0xA0761D6478BD642F)), first)
                    x = (h >> U(32)).astype(np.uint32)
                    for k in range(HASHES):
                        signature[some, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _TIMES[k], first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([s.tobytes() for s in signature], pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "signature"],
                )

    return run


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(signature), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h * U(0x9E3779B97F4A7C15) + signature[:, k].astype(np.uint64))
        out[:, b] = h
    return out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, text) with each text compressed, its length ahead of it."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        for part in chunks(batch, "text"):
            texts = [x.encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
            out = [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.large_binary()), pa.array([len(x) for x in texts], pa.int64())], ["cid", "packed", "size"])


def text_of(packed: bytes, codec: pa.Codec) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return codec.decompress(packed[8:], size, asbytes=True) if size else b""


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = band_hashes(unpacked(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "cid"])


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For each number of compared positions, the fewest matches at which the posterior P(similarity >= threshold) is at
    least `miss`, under a uniform prior."""
    grid = (np.arange(20000) + 0.5) / 20000
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid) + math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
            p = np.exp(log)
            if p[grid >= threshold].sum() / p.sum() >= miss:
                break
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of signature rows that no batch prunes, and their matches."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for to, need in least.items():
        matches = matches + (a[alive, at:to] == b[alive, at:to]).sum(1)
        keep = matches >= need
        alive, matches, at = alive[keep], matches[keep], to
        if not len(alive):
            break
    return alive, matches


def compared(least: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, matches = surviving(unpacked(batch.column(2)), unpacked(batch.column(3)), least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(matches)], ["a", "b", "matches"])

    return run


def tiled(least: dict[int, int], n: int, percent: int):
    """In one tile of a bucket: each outer class against the residents of other components, on signatures and then on the
    full sets. Gives links that join components which the tile didn't know to be joined, one less than it joins at most.

    A pair that shares an earlier band is left to that band's bucket, where it is compared as well."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cid, signature = table["cid"].to_numpy(), unpacked(table["signature"])
        texts, codec = table["packed"].to_pylist(), pa.Codec("zstd")
        parts = [distinct_grams(pa.array([text_of(x, codec) for x in texts[at : at + SLICE]], pa.binary()).cast(pa.large_string()), n) for at in range(0, len(texts), SLICE)]
        doc, h = np.concatenate([d + SLICE * k for k, (d, _) in enumerate(parts)]), np.concatenate([x for _, x in parts])
        cut = np.searchsorted(doc, np.arange(len(cid) + 1))
        size = np.diff(cut)
        names, comp = np.unique(table["comp"].to_numpy(), return_inverse=True)
        leader = np.arange(len(names))

        outer, resident, is_outer = (table[c].to_numpy(zero_copy_only=False) for c in ("outer", "resident", "is_outer"))
        bands = band_hashes(signature)
        here = bands == np.int64(key[0].as_py()).view(np.uint64)
        earlier = bands[:, : int(here.all(0).argmax())]
        found: list[tuple[int, int]] = []
        residents = np.flatnonzero(resident)
        for x in np.flatnonzero(outer):
            y = residents[(leader[comp[residents]] != leader[comp[x]]) & ~(is_outer[residents] & (cid[residents] < cid[x]))]
            y = y[~(earlier[x] == earlier[y]).any(1)]
            if not len(y):
                continue
            y = y[surviving(np.broadcast_to(signature[x], (len(y), HASHES)), signature[y], least)[0]]
            if not len(y):
                continue
            own = h[cut[x] : cut[x + 1]]
            before = np.cumsum(size[y]) - size[y]
            theirs = h[np.arange(int(size[y].sum())) + np.repeat(cut[y] - before, size[y])]
            at = np.searchsorted(own, theirs)
            at[at == len(own)] = 0
            shared = np.add.reduceat((own[at] == theirs).astype(np.int64), before)
            for z in y[100 * shared >= percent * (len(own) + size[y] - shared)].tolist():
                one, two = leader[comp[x]], leader[comp[z]]
                if one != two:
                    leader[leader == two] = one
                    found.append((int(cid[x]), int(cid[z])))
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def verifier(n: int, percent: int):
    """Exact similarity of the two texts of each row (a, b, packed_a, packed_b, size_b, size_a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            at, size = 0, np.add(*(batch.column(c).to_numpy() for c in (4, 5))).cumsum()
            while at < len(size):
                to = max(at + 1, int(size.searchsorted((size[at - 1] if at else 0) + UNPACKED, "right")))
                part, at = batch.slice(at, to - at), to
                sets = []
                for c in (2, 3):
                    same = part.column(c).dictionary_encode()
                    texts = pa.array([text_of(x, codec) for x in same.dictionary.to_pylist()], pa.binary()).cast(pa.large_string())
                    doc, h = distinct_grams(texts, n)
                    sets.append((same.indices.to_numpy(), h, np.searchsorted(doc, np.arange(len(texts) + 1))))
                (ia, ha, ca), (ib, hb, cb) = sets
                good = []
                for i, j in zip(ia.tolist(), ib.tolist()):
                    x, y = ha[ca[i] : ca[i + 1]], hb[cb[j] : cb[j + 1]]
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return run


class Linker:
    """The steps on classes. `classes` has cid and signature, `texts` has doc_id and text."""

    def __init__(self, classes: DataFrame, n: int, texts: DataFrame, shingle: int, percent: int, scratch: Scratch):
        """n: the number of classes."""
        self.classes, self.n, self.texts, self.shingle, self.percent, self.scratch = classes, n, texts, shingle, percent, scratch
        self.saved = scratch.saved
        self.least = least_matches(percent / 100)
        self.links: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        """Adds the links among pairs (a, b)."""
        side = lambda x: self.packed.select(F.col("cid").alias(x), F.col("packed").alias(f"packed_{x}"), F.col("size").alias(f"size_{x}"))
        rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "packed_a", "packed_b", "size_a", "size_b")
        found = self.saved(rows.mapInArrow(lean(verifier(self.shingle, self.percent)), "a long, b long"), "links", 200 * pairs.count())
        self.links = found if self.links is None else self.links.union(found)

    def labels(self) -> DataFrame:
        """node, component of every class that has a link."""
        return self.saved(components(self.links, self.scratch), "labels", self.n)

    def open(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component."""
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def settle(self, pairs: DataFrame) -> DataFrame:
        """Verifies survivors, the likeliest of each class first, the rest if still open; returns the labels."""
        best = pairs.groupBy("b").agg(F.max_by(F.struct("a"), F.struct(F.col("matches"), -F.col("a"))).alias("x")).select(F.col("x.a").alias("a"), "b")
        best = self.saved(best, "best", self.n)
        self.verify(best)
        labels = self.labels()
        rest = self.saved(self.open(pairs, labels).join(best, ["a", "b"], "left_anti").select("a", "b"), "rest", self.n)
        if rest.isEmpty():
            return labels
        self.verify(rest)
        return self.labels()

    def run(self) -> DataFrame:
        bands = self.scratch.mapped(self.classes.select("cid", "signature"), banded, "bucket long, cid long", "bands", BANDS * self.n)
        shared = bands.groupBy("bucket").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where(F.col("a") < F.col("z")).select("bucket", "a")
        shared = self.saved(shared, "shared", BANDS * self.n)
        members = KeyFilter(shared.select("bucket"), self.scratch).split(bands, F.col("bucket"))[0].join(shared, "bucket")
        members = self.saved(members, "members", BANDS * self.n)
        picked = KeyFilter(members.select("cid").distinct(), self.scratch)
        self.signatures = self.saved(picked.split(self.classes, F.col("cid"))[0].select("cid", "signature"), "signatures", 40 * self.n)
        self.packed = self.scratch.mapped(picked.split(self.texts.select("doc_id", "text"), F.col("doc_id"))[0], packed, "cid long, packed binary, size long", "packed", 100 * self.n)
        stars = members.where(F.col("a") < F.col("cid")).select("a", F.col("cid").alias("b")).distinct()
        side = lambda x: self.signatures.select(F.col("cid").alias(x), F.col("signature").alias(f"s{x}"))
        pairs = stars.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
        labels = self.settle(self.saved(pairs.mapInArrow(lean(compared(self.least)), "a long, b long, matches long"), "pairs", 40 * self.n))
        rows = self.tiles(members, labels)
        if rows.isEmpty():
            return labels
        full = rows.join(self.signatures, "cid").join(self.packed.drop("size"), "cid").select(*rows.columns, "signature", "packed")
        found = self.saved(full.groupBy("bucket", "i", "j").applyInArrow(tiled(self.least, self.shingle, self.percent), "a long, b long"), "tiled")
        if found.isEmpty():
            return labels
        self.links = self.links.union(found)
        return self.labels()

    def tiles(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, dealt to tiles (i: outer classes, j: residents) of about TILE
        of either kind. Outer: outside the bucket's largest component."""
        known = members.select("bucket", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
        sizes = known.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        split = sizes.groupBy("bucket").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), F.max("n").alias("largest"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
        split = split.where((F.col("comps") > 1) & (F.col("size") > 2))
        rows = known.join(split, "bucket").withColumn("is_outer", F.col("comp") != F.col("main"))
        number = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")
        rows = rows.withColumns({"outers": number(F.col("size") - F.col("largest")), "residents": number(F.col("size"))})
        rows = rows.withColumns({"own_i": F.pmod(F.xxhash64("cid", F.lit(1)), "outers").cast("int"), "own_j": F.pmod(F.xxhash64("cid"), "residents").cast("int")})
        across = F.transform(F.sequence(F.lit(0), F.col("residents") - 1), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j")))
        down = F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j")))
        rows = rows.withColumn("tile", F.explode(F.when(F.col("is_outer"), F.array_union(across, down)).otherwise(down))).withColumns({"i": F.col("tile.i"), "j": F.col("tile.j")})
        rows = rows.withColumns({"outer": F.col("is_outer") & (F.col("i") == F.col("own_i")), "resident": F.col("j") == F.col("own_j")})
        return self.saved(rows.select("bucket", "i", "j", "cid", "comp", "is_outer", "outer", "resident"), "tiles", BANDS * self.n)


def representatives(sketch: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of n rows: classes (n_shingles, h1, h2, cid: the smallest doc_id), and cid with the signature, once for each class. Only rows of ids
    are shuffled, and the signatures of copies."""
    key = ["n_shingles", "h1", "h2"]
    usable = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    rows = scratch.saved(usable.groupBy("doc_id", *key).agg(F.count("*").alias("times")), "ids", n)
    classes = scratch.saved(rows.groupBy(*key).agg(F.min("doc_id").alias("cid"), F.sum("times").alias("size")), "classes", n)
    several = classes.where(F.col("size") > 1)
    # each of these is no representative, or one that occurs as several rows
    copies = scratch.saved(rows.join(several, key).where((F.col("doc_id") > F.col("cid")) | (F.col("times") > 1)).select("doc_id", *key, (F.col("doc_id") > F.col("cid")).alias("later")), "copies", n)
    row = F.xxhash64("doc_id", *key)
    maybe, alone = KeyFilter(copies.select(row.alias("row")), scratch).split(usable, row)
    left = maybe.join(copies, ["doc_id", *key], "left").where(~F.coalesce("later", F.lit(False))).groupBy("doc_id", *key).agg(F.first("signature").alias("signature"))
    left = scratch.saved(left.select(F.col("doc_id").alias("cid"), "signature"), "copied", 40 * n)
    return classes.drop("size"), alone.select(F.col("doc_id").alias("cid"), "signature").union(left)


def near_dups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to, itself included), kept (it is that doc_id),
    class_id (smallest doc_id with the same shingle set) for each row of docs (doc_id long, text).

    Linked: 100 * |A n B| >= percent * |A u B| on sets of distinct `shingle`-word shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with Scratch(spark, "near-dups") as scratch:
        sketch = scratch.mapped(base, sketcher(shingle), SKETCH, "sketches")
        n = sketch.count()
        classes, signatures = representatives(sketch, n, scratch)
        labels = Linker(signatures, classes.count(), base.where(F.col("doc_id").isNotNull()), shingle, percent, scratch).run()
        named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        out = sketch.drop("signature").join(named, ["n_shingles", "h1", "h2"], "left")
        component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("cid", "doc_id").alias("class_id"))
        return saved(fewer(out, n), work_dir(spark, "near-dups"))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same over DuckDB's `documents`, for three words and 85 %: all pairs that share a shingle. For small tables.
SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) end g from d),
n as (select doc_id, len(g) n from s), x as (select doc_id, unnest(g) g from s),
p as (select a.doc_id a, b.doc_id b, count(*) c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)), e as (select a, b from l union all select b, a from l),
r as (select doc_id a, doc_id b from n union select r.a, e.b from r join e on r.b = e.a), m as (select a doc_id, min(b) component_id from r group by 1),
k as (select g, min(doc_id) class_id from s where len(g) > 0 group by g)
select s.doc_id, len(s.g)::bigint n_shingles, component_id, s.doc_id = component_id kept, coalesce(class_id, s.doc_id) class_id from s join m using (doc_id) left join k on k.g = s.g
"""
