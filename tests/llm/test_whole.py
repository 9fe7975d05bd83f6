"""What the corpus operators once left out."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from eventloom.llm import common, jaccard, line_dedup, quality, toxicity

SCHEMA = "doc_id long, text string"


def test_near_copies_of_the_stage(spark):
    """Copies of 11 to 25 % more words go, those of less similarity stay, and components are those of brute force."""
    import corpus_pipeline

    rng = random.Random(5)
    rows = []
    for d in range(40):
        words = [f"d{d}w{i}" for i in range(100)]
        rows.append((10 * d, " ".join(words)))
        rows.append((10 * d + 1, " ".join(words + [f"d{d}x{i}" for i in range(rng.choice([12, 18, 24]))])))
        rows.append((10 * d + 2, " ".join(words + [f"d{d}y{i}" for i in range(30)])))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    part = {i: i for i in sets}

    def root(i):
        return i if part[i] == i else root(part[i])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs, gram=5, percent=80).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    left = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert left == {i for i in sets if root(i) == i} and len(left) == 80


def test_toxicity_reads_whole_tokens():
    for word, found in (
        ("Nice,Idiot;", {"0:nice", "0:idiot", "4:idio"}), ("stupid-slur/foe", {"0:stupid", "0:slur", "0:foe"}), ("l'abruti", {"0:abruti", "6:abruti"}),
        ("मूर्ख।", {"0:मूर्ख", "4:मूर्"}), ("你好,你是一个大笨蛋吗", {"0:你好", "0:笨蛋", "4:个大笨蛋", "7:是一个大笨蛋吗"}), ("ばかabuser野郎", {"0:ばか", "0:abuser", "0:野郎"}), ("x" * 60 + "idiot" + "y" * 60, {"5:idiot"}),
    ):
        assert found <= set(toxicity.patterns_of(word)), word
    assert sorted(toxicity.patterns_of("(words)")) == ["0:words", "4:word", "5:words"] and not list(toxicity.patterns_of("☠️--_"))
    texts = pa.array(["a b,worst c", None, "worst"])
    doc, pattern, _ = toxicity.document_patterns(texts, {"0:worst": 0, "0:c": 1})
    assert list(zip(doc.tolist(), pattern.tolist(), strict=True)) == [(0, 0), (0, 1), (2, 0)]


def test_quality_vectors_are_of_whole_words():
    rows, codes, traits = quality.forms(pa.array(["Station", "nation", "station", "12345678-90ab", "12345678-9012", "x" * 41, "x" * 400]))
    assert len(set(rows.tolist())) == 6 and rows[0] == rows[2] and codes[0] != codes[2]
    assert (traits[3, 0], traits[4, 0]) == (0, 1) and traits[5, 3] < traits[6, 3]


def lines_batch(n, seed=4):
    """n lines of 60 to 100 characters, a few of them blank, equal or very long, 50 a document."""
    rng = random.Random(seed)
    lines = ["" if i % 17 == 3 else "the same line in many documents" if i % 29 == 5 else "é" * 3000 if i == 70 else "".join(rng.choices("abcdé fgh", k=rng.randrange(60, 100))) for i in range(n)]
    texts = ["\n".join(lines[i : i + 50]) for i in range(0, n, 50)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def test_line_hashes_are_the_same_in_any_block(monkeypatch):
    batch = lines_batch(1000)
    marks = pa.array([[{"fp": common.fingerprint(t), "kind": 1, "packed": np.arange(0, 50, 2, np.uint32).tobytes()}] for t in batch.column("text").to_pylist()])
    near = pa.RecordBatch.from_arrays([*batch.columns, marks], names=["doc_id", "text", "marks"])
    found = []
    for block in (64, 5000, 10**9):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        found.append([*line_dedup.offered(7)(iter([batch])), *line_dedup.variants(7)(iter([near]))])
    assert found[0] == found[1] == found[2] and all(b.num_rows for b in found[0])


def test_line_dedup_holds_few_sums_at_once():
    """A slice's hashes take less than 24 times its bytes; with running sums of the whole slice they took 49 times."""
    batch = lines_batch(25_000)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in line_dedup.offered(7)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 24 * batch.nbytes


def test_workers_give_memory_back(monkeypatch):
    """When a task's batches end, or a group is done, and not before."""
    said = []
    monkeypatch.setattr(common, "released", lambda: said.append("released"))
    rows = common.tidy(lambda batches: iter([*batches, 3]))([1, 2])
    assert [next(rows), next(rows), next(rows), *said] == [1, 2, 3] and [*rows, *said] == ["released"]
    assert common.tidy_group(lambda group: group + 1)(1) == 2 and said == ["released"] * 2
