"""The corpus operators against brute force, on texts with nulls, ties, copies, extra columns, and on empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import bpe, jaccard, language, line_dedup, media, mixing, quality, substring_dedup, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marks string, score string, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=70, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(40)] + ["A b", "\x1c", "Zz"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([2, 12, 13, 14, 30, 60]))] for _ in range(8)]
    rows = []
    for d in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randrange(50))]
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "edit"
        text = None if d % 23 == 4 else "" if d % 23 == 9 else "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)
        rows.append((d * 3, text, rng.choice(["en", None, "fr"]), rng.choice(["s", "s", "t", None]), 0, "m", "s", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A null doc_id, a row that repeats, one doc_id with two texts."""
    text = " ".join(f"x{i}" for i in range(30))
    return spark.createDataFrame([(r, t, "en", "s", 1, "", "", 0) for r, t in ((None, text), (1, text), (1, text), (2, text), (3, "a b"), (3, None), (4, "tail " + text))], SCHEMA)


def test_substring(docs, none, odd):
    texts = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 12):
            first.setdefault(tuple(texts[d][i : i + 13]), d)
    for r in substring_dedup.substring_dedup(docs).collect():
        w = texts[r.doc_id]
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < r.doc_id:
                gone[i : i + 13] = [True] * 13
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert substring_dedup.substring_dedup(none).count() == 0
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(odd).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30), (3, 0, 0), (3, 2, 0), (4, 31, 30)]


def test_jaccard(docs, none, odd):
    sets = {}
    for r in docs.collect():
        w = WORD.findall(r.text.translate({c: c + 32 for c in range(65, 91)}) if r.text else "")
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    part = {d: d for d in sets}

    def root(d):
        return d if part[d] == d else root(part[d])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    assert jaccard.jaccard_join(none).count() == 0
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(odd).collect()) == [(0, 28, None), (1, 28, 1), (1, 28, 1), (2, 28, 1), (3, 0, 3), (3, 1, 3), (4, 29, 1)]


def test_jaccard_two_texts_of_one_document(spark):
    t, u = (" ".join(f"{x}{i}" for i in range(30)) for x in "tu")
    rows = spark.createDataFrame([(1, t), (5, t), (5, u), (9, u), (12, None), (12, u), (14, "t1 t2")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(rows).collect())
    assert got == [(1, 28, 1), (5, 28, 1), (5, 28, 1), (9, 28, 1), (12, 0, 1), (12, 28, 1), (14, 1, 14)]


def test_jaccard_hot_list(spark, monkeypatch):
    """Chains of near copies around shared words, in lists longer than a cell and a block of the probe."""
    monkeypatch.setattr(jaccard, "CELL", 8)
    rng = random.Random(9)
    rows, words = [], [f"c{i}" for i in range(60)]
    for d in range(400):
        if d % 40 == 0:
            words = [f"c{i}" for i in range(20)] + [f"d{d}x{i}" for i in range(40)]
        i = rng.randrange(58)
        words = words[:i] + [f"n{d}"] + words[i + 1 :] if d % 3 else words
        rows.append((d, " ".join(words)))
    sets = {d: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for d, w in ((d, t.split()) for d, t in rows)}
    part = {d: d for d in sets}

    def root(d):
        return d if part[d] == d else root(part[d])

    for a in sets:
        for b in range(a + 1, 400):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: root(d) for d in sets}


def test_derived_answers():
    """Overlaps that come from a hub's answers are those of the sets."""
    rng = np.random.default_rng(5)
    hub = np.unique(rng.integers(0, 1000, 80)).astype(np.uint64)
    members = [np.unique(np.concatenate([rng.choice(hub, len(hub) - k, replace=False), rng.integers(0, 1000, k).astype(np.uint64)])) for k in rng.integers(1, 12, 30)]
    link = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))
    got = jaccard.answers(hub, members, 90)
    assert {i for a, i in got if a == -1} == {i for i, m in enumerate(members) if link(hub, m)}
    assert all(link(members[a], members[i]) for a, i in got if a >= 0)
    can = {i for i, m in enumerate(members) if not link(hub, m) and any(link(m, x) for j, x in enumerate(members) if j != i)}
    assert {i for a, i in got if a >= 0} == can


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(-6, 7, 5)] if i % 11 else [1, 1, 1, 1, 1]) for i in range(300)] + [(None, [1] * 5), (7000, None), (7001, [1, None, 1, 1, 1]), (3, [9] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in topk.topk(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    sound = [(i, v) for i, v in rows if i is not None and v and None not in v]
    for q, v in sound:
        if q % 50 == 0:
            best = sorted((-int(np.dot(v, x)), i) for i, x in sound if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.topk(df.where("false"), df, 5).count() == 0
    twice = df.where("vec_id = 50")
    assert sorted((r["rank"], r.vec_id) for r in topk.topk(df, twice.unionByName(twice), 5).collect()) == sorted((r, i) for r, i, _ in got[50])


def test_topk_bounds_hold():
    """Candidates hold every one of the highest scores, ties too, in shards that are larger than what is rescored at once."""
    rng = np.random.default_rng(3)
    for scale in (3, 256, 5000):
        values = rng.integers(-scale, scale, (500, 12))
        queries = rng.integers(-scale, scale, (9, 12))
        for q, at in zip(queries, topk.Index(values).candidates(queries, np.full(9, 5)), strict=True):
            scores = values @ q
            assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(at.tolist())


def test_bpe_is_the_library(docs, none):
    tok = bpe.tokenizer(bpe.vocabulary_path())
    text = {x.doc_id: x.text or "" for x in docs.collect()}
    for leaf in (16, 10_000):
        got = bpe.bpe(docs, bpe.vocabulary_path(), leaf=leaf).collect()
        assert sorted(r.doc_id for r in got) == sorted(text)
        for r in got:
            e = tok.encode(text[r.doc_id], add_special_tokens=False).ids
            assert r.ids == e and r.decoded == tok.decode(e, skip_special_tokens=False)
    assert bpe.bpe(none, bpe.vocabulary_path()).count() == 0


def test_bpe_signs_after_words():
    import pyarrow as pa

    tok = bpe.tokenizer(bpe.vocabulary_path())
    texts = ["ab. cd.\n'\u03a3. x? y!z. don't. it's, A.B. e\u0301\u0301. \xe9. <|endoftext|>. 3. a.", "word .", "a.\x1cb. c", "\u2163. \xbd. \u0130. \u0391\u03a3. \ufb1d. \xdf, q", "a. b. c.", ". a", "a.\u00a0b"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    for got in bpe.encoder(bpe.vocabulary_path())(iter([batch])):
        assert got.column("ids").to_pylist() == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_runs_have_the_librarys_places(monkeypatch):
    tok, rng = bpe.tokenizer(bpe.vocabulary_path()), random.Random(9)
    monkeypatch.setattr(bpe, "RUNS", 7)
    monkeypatch.setattr(bpe, "KNOWN", 20)
    runs = bpe.Runs(tok)
    signs = ["a", "Zz", "word", " ", "  ", "\t", "\x85", "\u00a0", "\u3000", "é", "e\u0301", "\u0301", "İ", "ß", "한", "각", "\u0958", "🙂", "don't", "12", "...", "$", "\x00", "\x1c", "x" * 900]
    for text in ["", " ", "a", *("".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(300))]:
        got, want = bpe.encoded(runs, text), bpe.piece(text, tok.encode(text, add_special_tokens=False))
        assert got.ids.tolist() == want.ids.tolist() and got.starts.tolist() == want.starts.tolist() and got.ends.tolist() == want.ends.tolist(), text


def test_bpe_long_copies(spark):
    """Copies of long texts, with and without doc_id, come out row by row; so does a long text without white space."""
    rng = random.Random(7)
    long = " ".join(rng.choice(["the", "ing's", "É 12", "a-b", "日本"]) for _ in range(9000))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, "ab9" * 15_000), (4, "xyz" * 9_000), (5, None)]
    tok = bpe.tokenizer(bpe.vocabulary_path())
    got = bpe.bpe(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bpe.vocabulary_path()).collect()
    want = [(i or 0, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted(want)


def test_bpe_tree():
    tok, rng = bpe.tokenizer(bpe.vocabulary_path()), random.Random(4)
    parts = ["a", "the", "ing", "'s", "'", "re", "9", "12", "é", "́", "中", "!!", "<|startoftext|>", "<|end", "oftext|>", "​", "İ", "½", " ", "\x00", "ﬁ"]
    for size in (1, 30, 400):
        for _ in range(30):
            text = "".join(rng.choice(parts) for _ in range(size))
            assert bpe.tree(tok, text, 16).ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    long = "ab9" * 20_000
    assert bpe.tree(tok, long).ids.tolist() == tok.encode(long, add_special_tokens=False).ids


def one_edit(a, b):
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] in (b[i + 1 :], b[i:]) or a[i:] == b[i + 1 :]


def test_lines(spark, none, odd):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice([5, 9, 19, 20, 21, 30]))) for _ in range(10)]

    def edited(s):
        i, k = rng.randrange(len(s)), rng.randrange(4)
        return s if k == 0 else s[:i] + ("" if k == 1 else rng.choice("abc")) + s[i + (k != 2) :]

    rows = [(d, None if d % 17 == 3 else "\n".join(edited(edited(rng.choice(base))) for _ in range(rng.randrange(6)))) for d in range(80)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    seen = []
    for d, t in rows:
        keep = []
        for x in t.split("\n") if t is not None else ():
            long = sum(c not in " \t\v\f\r\xa0" for c in x) >= 8
            gone = long and any(x == y or len(x) >= 20 <= len(y) and abs(len(x) - len(y)) < 2 and one_edit(x, y) for y in seen)
            seen += [x] if long else []
            keep += [] if gone else [x]
        assert got[d].kept_text == (None if t is None else "\n".join(keep)), d
    assert line_dedup.line_dedup(none).count() == 0
    assert sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.line_dedup(odd, ("lang", "marks")).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1), (3, 0), (3, 0), (4, 0)]


def test_media(docs, none):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in media.media_columns(docs).collect():
        data = text[r.doc_id].encode()
        assert media.read_sound(r.media) == media.padded(data) and r.n_bytes == len(data) and r.payload_bytes % 64 == 0 < r.payload_bytes
        assert r.payload_sha256 == hashlib.sha256(media.padded(data)).hexdigest() and len(r.logmel) == media.SPANS * media.MELS
        assert media.from_tensor(r.tensor).shape == (media.SPANS, media.MELS) and media.from_tensor(r.tensor).ravel().tolist() == r.logmel and len(r.spans) == media.SPANS
    assert media.media_columns(none).count() == 0


def test_media_blocks_agree():
    x = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    whole = media.resampled(x, 0, 2500)
    assert np.allclose(np.concatenate([media.resampled(x, a, a + 500) for a in range(0, 2500, 500)]), whole, atol=1e-6)
    bank = media.phases(media.UP, media.DOWN, media.TAPS)
    wave = np.concatenate([np.full(8, 0.0), (x - 128.0) / 128, np.full(8, 0.0)])
    for o in (0, 1, 2, 777, 2499):  # an output by its definition: the taps of its phase over the samples around it
        first = o * media.DOWN // media.UP - media.TAPS // 2 + 1
        assert abs(whole[o] - wave[first + 8 : first + 8 + media.TAPS] @ bank[o * media.DOWN % media.UP]) < 1e-5
    wide = media.resampled(x, 0, 3000, 3, 5)
    t = np.arange(9000) / 100
    slow = ((np.sin(t) * 100) + 128).astype(np.uint8)
    assert len(wide) == 3000 and np.abs(media.resampled(slow, 100, 400, 1, 2) * 128 + 128 - slow[200:800:2]).max() < 4


SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("op", "label", "least"), [(toxicity.op4_toxicity, "toxic", 0.87), (quality.op10_quality, "quality", 0.9)])
def test_held_out_accuracy(spark, op, label, least):
    rows = op(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select((F.col("predicted") == F.col(label)).cast("int").alias("ok")).collect()
    assert np.mean([r.ok for r in rows]) >= least


def test_classifiers_without_labels(spark, docs, none):
    labels = spark.createDataFrame([(0, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for mod in (quality, toxicity):
        scores = {r.score for r in mod.scores(docs, labels.where("false")).collect()}
        assert scores == {0.5}
        assert mod.scores(docs, labels).count() == 70
        assert mod.scores(none, labels).count() == 0


def test_mixing_rakes(spark, docs, none):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "p", 300), ("b", "x", "p", 50), ("b", "y", "q", 550)], "_source string, _lang string, _topic string, tokens long")
    target = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"p": 0.7, "q": 0.3}}
    w = mixing.raked(cells, {d: spark.createDataFrame(list(t.items()), f"_{d} string, target double") for d, t in target.items()}, rounds=60, error=1e-6)
    for d, t in target.items():
        got = {r[0]: r[1] for r in w.groupBy(f"_{d}").agg(F.sum("weight")).collect()}
        assert got == pytest.approx(t, abs=1e-3)
    rates = mixing.calibrated(w, 0.5)
    assert rates.agg(F.sum(F.col("rate") * F.col("tokens"))).first()[0] == pytest.approx(500, rel=0.02)
    out = mixing.mixed(docs).collect()
    assert len(out) == 70 and all(0 <= r.probability <= 1 and (r.n_tokens > 0 or not r.kept) for r in out)
    assert {r.doc_id: r.n_tokens for r in out} == {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert mixing.mixed(none).count() == 0
    clash = docs.selectExpr("*", "1 as rate", "'x' as _source", "2 as _lang", "3 as _topic", "4 as _row", "5 as weight", "6 as tokens")
    got = mixing.mixed(clash)
    assert got.columns[: len(clash.columns)] == clash.columns
    assert {r.doc_id: (r.probability, r.kept) for r in got.collect()} == {r.doc_id: (r.probability, r.kept) for r in out}


def test_mixing_by_hand(spark):
    """Rates and kept rows against plain Python, and the error that raking leaves."""
    rows = [(i, f"{'w ' * (i % 9 + 1)}", "ab"[i % 2], "xyz"[i % 3], "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    out = mixing.mixed(docs).collect()
    weight = {}
    for i, t, s, l, _ in rows:
        weight[s, l] = weight.get((s, l), 0) + len(t.split())
    total, tokens = sum(weight.values()), dict(weight)
    share = lambda k, p: {v: sum(w for c, w in tokens.items() if c[k] == v) ** p for v in {c[k] for c in tokens}}
    want = [{v: x / sum(t.values()) for v, x in t.items()} for t in (share(0, 0.5), share(1, 0.7))]
    weight = {c: w / total for c, w in weight.items()}
    for _ in range(200):
        for k in (0, 1):
            now = {v: sum(w for c, w in weight.items() if c[k] == v) for v in want[k]}
            weight = {c: w * want[k][c[k]] / now[c[k]] for c, w in weight.items()}
    for r in out:
        assert r.probability == pytest.approx(min(1, 0.5 * total * weight[r.source, r.lang] / tokens[r.source, r.lang]), rel=0.02)
    cells = mixing.raked(spark.createDataFrame([(s, l, "t", n) for (s, l), n in tokens.items()], "_source string, _lang string, _topic string, tokens long"), mixing.smoothed(spark.createDataFrame([(s, l, "t", n) for (s, l), n in tokens.items()], "_source string, _lang string, _topic string, tokens long"), mixing.SMOOTH))
    assert max(mixing.off_by(cells, mixing.smoothed(cells, mixing.SMOOTH)).values()) < 1e-3


def test_pages_are_read_whole():
    body = "<main>a<article>b<article>c</article>d</article></main>e<article>f</article>g"
    assert language.main_text(body).split() == list("abcdf")
    assert language.main_text("x<article> </article>y").split() == ["x", "y"] and language.main_text("<article>open").split() == ["open"]


def test_signatures_depend_on_the_text_alone():
    import pyarrow as pa

    from eventloom.llm import labelled

    def of(*texts):
        got = pa.Table.from_batches(labelled.signed(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]))).to_pylist()
        return [(r["s0"], r["s1"], r["s2"]) for r in got]

    texts = ["a b c", "x y z w", "a b c", "a", "a b", None, "", "a b c d"]
    assert of(*texts) == [of(t)[0] for t in texts] and len(set(of("a", "b", "a b", "b a", "a b c"))) == 5


def test_language(spark, none):
    pages = spark.createDataFrame([(1, "https://a.example.de/de/x", '<html lang="de"><p>der die und nicht</p>'), (2, None, None), (3, "http://b.example.com/", "<p>the and of that with</p>"), (3, "http://b.example.com/", "<p>the and of that with</p>")], "page_id long, url string, html string")
    known = spark.createDataFrame([(1, "der die und nicht sich mit ein " * 9, "de", ""), (2, "the and of that with for was " * 9, "en", "")], "doc_id long, text string, lang string, source string")
    got = sorted((r.page_id, r.lang) for r in language.language_id(pages, known).collect())
    assert [g for g in got if g[0] != 2] == [(1, "de"), (3, "en"), (3, "en")] and len(got) == 4
    assert language.language_id(pages.where("false"), known).count() == 0
    assert {r.lang for r in language.language_id(pages, none).collect()} == {None}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert name == "tokens" or got.columns == docs.columns
        sizes.append(got.count())
    assert all(0 < n < sizes[0] for n in sizes[1:5]) and sizes[5] == sizes[0]
