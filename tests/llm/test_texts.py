"""Token counts, line dedup, language ID, packing, language model and repeated spans against plain restatements."""

import collections
import hashlib
import io
import math
import os
import random
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, documents, prose, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vistamap.llm import language_id, line_dedup, ngram_lm, packing, repeated_spans, token_counts
from vistamap.llm._memo import Memo
from vistamap.llm.queries import tokenizer_path

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def whole(name, texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module", params=[(BYTES, "bytes"), (WORDS, "words")])
def memo(request):
    name, kind = request.param
    return name, Memo(tokenizer_path(name), kind, ids=True)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*"aBé'sSt. ,!\n\t1İßΣ\u0301\u00a0\u3000日<|>$#\x1c", "<|endoftext|>", "the ", " 's"]), max_size=30).map("".join), max_size=8))
def test_memo_gives_what_whole_texts_give(memo, texts):
    name, m = memo
    counts, ids = m.encode(pa.array(texts, pa.string()))
    expected = whole(name, texts)
    assert counts.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for e in expected for i in e]


def test_token_counts(spark, docs, empty, tmp_path):
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time all is in the cache
        # other columns have names that are used inside
        got = token_counts.token_counts(docs.withColumnsRenamed({"lang": "digest", "source": "tokens", "n_chars": "n_bytes"}), cache, tokenizer_path(BYTES)).collect()
        rows = documents()
        expected = collections.Counter((r[0], len((r[1] or "").encode()), len(ids), len(ids) > 512) for r, ids in zip(rows, whole(BYTES, [r[1] for r in rows])))
        assert collections.Counter(map(tuple, got)) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in documents()})
    assert token_counts.token_counts(empty, str(tmp_path / "other"), tokenizer_path(BYTES)).count() == 0


def test_packing(docs, empty):
    # one of the rows without an id is empty, the other is not; other columns have names that are used inside
    frame = docs.where("doc_id <> 3 or doc_id is null and text is not null").withColumnsRenamed({"lang": "length", "source": "deal", "n_chars": "loss"})
    got = packing.pack_texts(frame, tokenizer_path(WORDS)).collect()
    rows = {r[0]: r[1] for r in documents() if r[0] != 3 and (r[0] is not None or r[1] is not None)}
    assert None in rows
    ids = {k: np.array(x + [1], "<u4") for k, x in zip(rows, whole(WORDS, rows.values()))}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for k, v in [*((len(ids[k]), v) for k, v in pieces.items()), *((None, v) for v in sequences.values())]:
        at = 0
        for start, length in sorted(v):
            assert start == at
            at += length
        assert at == k if k is not None else at <= 2048
    assert packing.pack_texts(empty, tokenizer_path(WORDS)).count() == 0


def test_packing_of_short_texts(spark):
    """The limit of segments leaves no room among texts of a few words."""
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the "), F.col("id").cast("int") % 5).alias("text"))
    used = packing.pack_texts(frame, tokenizer_path(WORDS)).groupBy("sequence_id").agg(F.sum("length").alias("n")).toArrow()["n"].to_pylist()
    assert sum(used) == 6000 * 3 and len(used) <= -(-sum(used) // 2048) + 2


def test_packing_limits_tokens_with_loss(spark):
    talks = {c: [(t, ("user", "assistant", None)[t % 3], prose(10 * c + t, 5 + 29 * ((c + t) % 7))) for t in range(c % 6 + 1)] for c in range(40)}
    rows = [(c, *x) for c, v in talks.items() for x in v] + [(99, 0, "assistant", None)]
    frame = packing.by_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = packing.pack_texts(frame, tokenizer_path(WORDS), most_tokens=256, turns="turns", most_loss=100).collect()
    ids, loss = {99: [1]}, {99: [True]}
    for c, v in talks.items():
        each = whole(WORDS, [t for *_, t in v])
        ids[c] = [i for e in each for i in e] + [1]
        loss[c] = [r == "assistant" for (_, r, _), e in zip(v, each) for _ in e]
        loss[c].append(loss[c][-1])
    borne, used, pieces = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.start + r.length))
        borne[r.sequence_id] += sum(loss[r.doc_id][r.start : r.start + r.length])
        used[r.sequence_id] += r.length
    assert {c: [0, *(b for _, b in sorted(v))] for c, v in pieces.items()} == {c: [*(a for a, _ in sorted(v)), len(ids[c])] for c, v in pieces.items()}
    assert pieces.keys() == ids.keys()
    assert max(borne.values()) <= 100 and max(used.values()) <= 256 and sum(borne.values()) == sum(map(sum, loss.values()))
    assert packing.pack_texts(frame.limit(0), tokenizer_path(WORDS), turns="turns", most_loss=7).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), max_size=60))
def test_place_keeps_every_limit(items):
    tokens, loss = np.array([a for a, _ in items], np.int64), np.array([min(a, b) for a, b in items], np.int64)
    bins, offsets = packing.place(tokens, loss, 64, 4, 50)
    for k in set(bins.tolist()):
        on = bins == k
        order = np.argsort(offsets[on])
        assert tokens[on].sum() <= 64 and on.sum() <= 4 and loss[on].sum() <= 50
        assert offsets[on][order].tolist() == (np.cumsum(tokens[on][order]) - tokens[on][order]).tolist()


def test_line_dedup(spark, docs, empty):
    rows = [r for r in documents() if r[0] is not None and r[0] != 3]
    frame = spark.createDataFrame([(*r, "kept", 7) for r in rows], f"{DOCS}, pos string, h int")
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame, sites=5).collect()}
    places = collections.defaultdict(list)
    for doc, text, _, site, _ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                places[line.strip(" ").lower()].append((doc, pos, site))
    gone = {(d, p) for v in places.values() if len({s for *_, s in v if s is not None}) >= 5 for d, p, _ in v if (d, p) != min(v)[:2]}
    assert gone
    for doc, text, *_ in rows:
        left = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (doc, p) not in gone)
        assert (got[doc].text, got[doc].n_removed, got[doc].pos, got[doc].h) == (left, sum(d == doc for d, _ in gone), "kept", 7)
        assert got[doc].n_lines == (0 if text is None else len(text.split("\n")))
    assert line_dedup.line_dedup(docs).count() == len(documents())
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_counts_near_the_threshold_exactly(spark):
    """Estimates are off for many sites; the exact count decides."""
    rows = [(i, f"line {k}", f"s{i}") for k, n in enumerate((99, 100, 101)) for i in range(n)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=100)
    assert got.where("n_removed > 0").count() == 99 + 100


def test_line_dedup_counts_an_empty_site(spark):
    rows = [(i, f"line {n}", f"s{i}" if i else "") for n in (9, 10) for i in range(n)] + [(20, "line 9", None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id, r.n_removed) for r in got.where("text = '' or n_removed > 0").collect()) == [(i, 1) for i in range(1, 10)]


def test_language_id(spark, empty):
    rows = [(i, prose(i, 5 + i % 40, lang), lang) for i in range(300) for lang in [("en", "fr", "de")[i % 3]]]
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "fr"), (1003, "the", None), (None, prose(1), "en"), (5, prose(5, 10, "de"), "de"), (1004, prose(9, 60000, "fr"), "fr")]
    got = language_id.language_id(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in got if r.held_out and r.lang and r.text and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) > 0
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.predict(spark.createDataFrame([(1, "the")], "doc_id long, text string"), {}).collect()} == {"und"}


def bundled_by_force(text, dimensions, seed=7):
    vector = {c: language_id.letters(np.array([ord(c) if c else 0]), dimensions, seed)[0].astype(int) for c in {*text.lower(), ""}}
    low = ["", *(c if unicodedata.category(c)[0] == "L" else "" for c in text.lower()), ""]
    out = np.zeros(dimensions, int)
    for a, b, c in zip(low, low[1:], low[2:]):
        if b:
            out += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    return out


@pytest.mark.parametrize("piece", [5, 1 << 20])
def test_hyperdimensional_bundle_is_the_sum_of_bound_trigrams(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    monkeypatch.setattr(language_id, "COLUMNS", 16)
    monkeypatch.setattr(language_id, "ROWS", 3)
    r = random.Random(1)
    texts = ["x", "ABA 1é!", "", "日本語 ελληνικά Русский", prose(3, 80), "".join(r.choice("abcdefghijklmnop ") for _ in range(400)), "a" * 23, "İΣ\ud800", "ab " * 11]
    got = language_id.Profiles(70).bundle(texts)
    assert got.tolist() == [bundled_by_force(t, 70).tolist() for t in texts]
    v = language_id.letters(np.arange(3000), 1024, 7).astype(int)
    assert np.abs((v @ v.T)[~np.eye(3000, dtype=bool)]).max() < 250 and (v @ v.T).diagonal().min() == 1024


def test_language_id_is_the_nearest_prototype(spark):
    """Learning and prediction against sums by hand; scripts are told apart letter by letter; columns with the names used inside."""
    scripts = {"el": "και το να είναι με για στην από αυτό", "ru": "что это как все она так его только", "uk": "що це як всі вона так його тільки її"}
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(scripts[k].split(), k=4 + i % 9)) if k in scripts else prose(i, 4 + i % 9, k), k) for i in range(240) for k in [[*scripts, "en", "fr"][i % 5]]]
    frame = spark.createDataFrame([(*x, 1, "y", 0.5, "z", 9) for x in rows], "doc_id long, text string, lang string, label int, draw string, score double, lang_pred string, held_out int")
    learned = {k: sum(bundled_by_force(t, 1024) for d, t, x in rows if x == k and zlib.crc32(str(d).encode()) % 5) for *_, k in rows}
    got = {x.doc_id: x for x in language_id.language_id(frame).collect()}
    for d, t, k in rows:
        v = bundled_by_force(t, 1024)
        cosine = {x: float(v @ y / np.linalg.norm(v) / np.linalg.norm(y)) for x, y in learned.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert (got[d].lang_pred, got[d].score, got[d].label, got[d].draw) == (best, pytest.approx(max(cosine[best], 0), abs=1e-5), 1, "y")
        assert best == k or {best, k} == {"ru", "uk"}
    held = [x for x in got.values() if x.held_out]
    assert sum(x.lang == x.lang_pred for x in held) >= 0.95 * len(held) > 20


def test_language_id_of_junk_is_bounded():
    """Ten thousand texts of random letters in one batch; numpy reports what it allocates to tracemalloc."""
    r = np.random.Generator(np.random.PCG64(4))
    batch = pa.RecordBatch.from_arrays([pa.array(["".join(x) for x in r.choice([*"abcdefghijklmnopqrstuvwxyz"], (10_000, 100))])], ["text"])
    tracemalloc.start()
    assert sum(len(v) for _, v in language_id._bundled(batch, language_id.Profiles(), "text")) == 10_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6


def kneser_ney(train, order):
    """p(history, word) of texts of tokens, restated with plain counters."""
    raw = {k: collections.Counter() for k in range(1, order + 1)}
    for t in train:
        seq = ["\t", *t]
        for k in raw:
            raw[k].update(tuple(seq[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(seq)))
    counts = {order: raw[order]}
    for k in range(1, order):
        before = collections.Counter(g[1:] for g in raw[k + 1])
        counts[k] = {g: before[g] if g[0] != "\t" else c for g, c in raw[k].items()}
    d = {k: [0, *ngram_lm.discounts([sum(x == n for x in counts[k].values()) for n in (1, 2, 3, 4)])] for k in counts}
    follow = {k: collections.defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            follow[k][g[:-1]][0] += n
            follow[k][g[:-1]][min(n, 3)] += 1

    def p(history, word):
        k = len(history) + 1
        low = p(history[1:], word) if history else 1 / (len(counts[1]) + 1)
        if history not in follow[k]:
            return low
        total, *seen = follow[k][history]
        n = counts[k].get((*history, word), 0)
        return (n - d[k][min(n, 3)] + sum(x * y for x, y in zip(d[k][1:], seen)) * low) / total

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, docs, empty, order):
    # columns with names that the operator uses; more shards than words in some
    frame = docs.where("doc_id is not null").withColumnsRenamed({"lang": "score", "source": "shard", "n_chars": "n_tokens"})
    got = ngram_lm.score_held_out(frame, order=order).collect()
    rows = [(r[0], words(r[1]) + ["\n"]) for r in documents() if r[0] is not None]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    train = [t for d, t in rows if not held[d]]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    p = kneser_ney(train, order)
    expected = collections.defaultdict(list)
    for d, t in rows:
        seq = ["\t", *t]
        logs = [math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq))]
        expected[d].append((held[d], len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(logs)))
    assert len(got) == len(rows)
    for r in got:
        assert [pytest.approx((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))] == expected[r.doc_id][:1]
    # probabilities after a known, an unknown and no history sum to 1
    for a in ("\t", rows[0][1][0], "never seen"):
        assert sum(p((a,), w) for w in c) + p((a,), "\r") == pytest.approx(1)
    assert ngram_lm.score_held_out(empty, order=order).count() == 0


def test_language_model_of_null_ids(spark, docs):
    """A null id is in no fold: its rows are learned from, and scored."""
    got = ngram_lm.score_held_out(docs).collect()
    assert len(got) == len(documents())
    held = {r[0] for r in documents() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2}
    assert {r.train_tokens for r in got} == {sum(len(words(t)) + 1 for d, t, *_ in documents() if d not in held)}
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == sorted(len(words(t)) + 1 for d, t, *_ in documents() if d is None)
    assert not any(r.held_out for r in got if r.doc_id is None)


@pytest.mark.parametrize("name", ["1/0.key.npy", "2/1.count.npy", "1/2.total.npy", "2/3.key.npy"])
def test_a_lost_file_of_the_model_is_an_error(spark, docs, name):
    model = ngram_lm.train(docs, shards=4, order=3)
    assert ngram_lm.score(docs, model, "doc_id").count() == len(documents())
    path = f"{model.path}/{name}"
    whole = open(path, "rb").read()
    os.remove(path)
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        ngram_lm.score(docs, model, "doc_id").collect()
    np.save(path, np.load(io.BytesIO(whole))[1:])
    with pytest.raises(Exception, match="values instead of"):
        ngram_lm.score(docs, model, "doc_id").collect()


def test_language_model_is_split_over_shards(spark, docs):
    """Scores don't depend on the number of shards."""
    scores = [{(r.doc_id, round(r.score, 6)) for r in ngram_lm.score(docs, ngram_lm.train(docs, shards=n, order=3), "doc_id").collect()} for n in (1, 13)]
    assert scores[0] == scores[1]


def removed_by_force(rows, width):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data, at, kept, spans = text.encode(), 0, b"", []
        for k in range(len(data) - width + 1):
            if data[k : k + width] in seen:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + width
                else:
                    spans.append([k, k + width])
            seen.add(data[k : k + width])
        for a, b in spans:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        out[doc] = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)
    return out


def left_after_force(spark, rows, width):
    """The operator's rows for (doc, text), checked against the set of all windows."""
    frame = spark.createDataFrame([(d, t, 1, "x", b"y") for d, t in rows], "doc_id long, text string, n_spans int, hash string, kept binary").repartition(3)
    got = {r[0]: (*r[1:5], bytes(r[5])) for r in repeated_spans.repeated_spans(frame, width).collect()}
    assert got == removed_by_force([(d, t or "") for d, t in rows], width)


@pytest.mark.parametrize(("width", "hot", "mild"), [(100, 5000, 50), (21, 5000, 50), (100, 2, 50), (21, 10, 2), (100, 2, 0), (21, 3, 0)])
def test_repeated_spans(spark, docs, empty, width, hot, mild, monkeypatch):
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    monkeypatch.setattr(repeated_spans, "MILD", mild)
    left_after_force(spark, {r[0]: r[1] for r in documents() if r[0] is not None}.items(), width)
    assert repeated_spans.repeated_spans(docs, width).count() == len(documents())
    assert repeated_spans.repeated_spans(empty, width).count() == 0


def test_repeated_spans_of_null_ids(docs):
    """A null id comes before all others; its rows differ by their texts."""
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in repeated_spans.repeated_spans(docs).collect()}
    null = [t or "" for d, t, *_ in documents() if d is None]
    assert {(None, len(t.encode())) for t in null} <= got.keys()
    again = next(d for d, t, *_ in documents() if d is not None and t == max(null, key=len))
    size = len(max(null, key=len).encode())
    assert (got[None, size], got[again, size]) == (0, size)


@pytest.mark.parametrize(("hot", "mild"), [(5000, 50), (2, 50), (2, 0)])
def test_no_hash_alone_removes_a_byte(spark, monkeypatch, hot, mild):
    """With one hash for all surroundings and one for all anchors, everything is left to the comparison of bytes."""
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    monkeypatch.setattr(repeated_spans, "MILD", mild)
    rows = list({d: t for d, t, *_ in documents() if d is not None and d < 70 and len(t or "") < 3000}.items())
    tables = {}

    def constant(t):
        return np.zeros(len(t), np.uint64)

    monkeypatch.setattr(repeated_spans, "surroundings_hash", constant)
    for n, (d, t) in enumerate(rows):
        if t:
            data = np.frombuffer(t.encode(), np.uint8)
            row, p, h, lo, hi = repeated_spans.anchors(data, np.array([0, len(data)]), 40)
            surroundings = repeated_spans.binary(*repeated_spans.ragged(data, lo, hi - lo + 40))
            columns = [h * np.uint64(0), np.full(len(p), d), np.full(len(p), n, np.uint64), p, (p - lo).astype(np.int16), (hi - p).astype(np.int16), surroundings]
            tables[d] = pa.table(columns, schema=repeated_spans.CONTEXT)
    t, later = repeated_spans.first_of_equal(pa.concat_tables(tables.values()))
    runs = [repeated_spans.decided(later, 40)]
    if hot < len(t):
        t, later = repeated_spans.first_of_equal(repeated_spans.stretched(t, 40, np.full(len(t), 7 if mild else 1)))
        runs.append(repeated_spans.decided(later, 40))
    runs = repeated_spans.joined(pa.concat_tables([*runs, *repeated_spans.sorted_out(t, 40)]))
    gone = collections.Counter()
    for r in runs.to_pylist():
        gone[r["doc"]] += r["to"] - r["from"]
    expected = {d: x[1] for d, x in removed_by_force([(d, t or "") for d, t in rows], 40).items()}
    assert {d: gone[d] for d in expected} == expected


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", max_size=14)), min_size=1, max_size=40), st.integers(0, 14))
def test_suffix_sort(items, depth):
    items.sort(key=lambda x: x[0])
    data = np.frombuffer("".join(t for _, t in items).encode() or b"a", np.uint8)
    length = np.array([len(t) for _, t in items])
    s = repeated_spans.Suffixes(data, np.cumsum(length) - length, length, np.array([g for g, _ in items]))
    order, extension = s.sorted()
    assert [items[i] for i in order] == sorted(items)
    number = repeated_spans.classes(order, extension, depth)
    long = [i for i in range(len(items)) if length[i] >= depth]
    assert all((number[i] == number[j]) == (items[i][0] == items[j][0] and items[i][1][:depth] == items[j][1][:depth]) for i in long for j in long)


def test_a_lying_hash_is_found_out():
    data = np.frombuffer(b"banana", np.uint8)
    s = repeated_spans.Suffixes(data, np.array([0, 1, 2, 3]), np.array([3, 3, 3, 3]), np.zeros(4, int))
    s.sums = np.zeros_like(s.sums)  # all strings look equal
    order, extension = s.sorted()
    assert [s.data[i : i + 3].tobytes() for i in s.start[order]] == [b"ana", b"ana", b"ban", b"nan"]
    assert extension.tolist() == [-1, 3, 0, 0]
