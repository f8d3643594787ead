"""The pipeline against a brute-force version on a small corpus."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_text_operators import brute_fingerprint, prose, roots, ws

from erawood.llm import bpe

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def texts():
    shared, item = prose(900, 80), prose(901, 40)
    near = prose(1, 400).split()
    near[200] = "other"
    rows = [prose(1, 400), " ".join(near), prose(1, 400), prose(2, 30), "$$ %% && ## " * 40, "again and again " * 60]
    rows += [prose(3, 70) + "\n" + shared + "\n" + prose(4, 70), prose(5, 90) + " " + shared + " " + prose(6, 60), shared + " " + prose(7, 100)]
    rows += [prose(8, 120) + " " + item + " " + prose(9, 120), prose(10, 3000), None, "", prose(11, 60)]
    return list(enumerate(rows)), item


def brute(rows, item):
    good = []
    for i, t in rows:
        w = ws(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if ws(x)]
        bad = len(w) < 50 or 2 * len(cover) > len(w) or 10 * sum(t.count(c) for c in "#*$%&|<>") > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines)
        if not bad:
            good.append((i, t))
    root = roots([brute_fingerprint(t) for _, t in good])
    good = [r for k, r in enumerate(good) if root[k] == k]
    first: dict = {}
    for i, t in good:
        w = ws(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = {}
    for i, t in good:
        w = ws(t)
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
        if ws(left) and item not in " ".join(ws(left)):
            out[i] = left
    return out


def test_run(spark, tmp_path):
    rows, item = texts()
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    b = bpe.load(bpe.tokenizer_path())
    want = {i: len(b.encode(t)) + 1 for i, t in brute(rows, item).items()}
    assert {0, 6, 7, 8, 10, 13} == set(want)
    got, total = defaultdict(int), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
        total[r["doc_id"]] = r["doc_tokens"]
    assert dict(got) == total == want
    assert len(corpus_pipeline.STAGES) == 5 and np.all([callable(f) for _, f in corpus_pipeline.STAGES])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_nulls_and_repeats(spark, tmp_path):
    rows, item = texts()
    rows = [*rows, rows[0], rows[9], (None, prose(77, 90)), (None, None)]
    data = [(i, t, "en", None, None if t is None else len(t), "p", 1, "t", 2, 3, True) for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, places string, joined int, text_hash string, `a.b` int, component_id int, kept boolean"
    spark.createDataFrame(data, kinds).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
    kept = [(r["doc_id"], r["places"], r["a.b"]) for r in docs.collect()]
    # a row that repeats a document shares its fate: the first text stays twice, the leak goes twice
    assert sorted(kept, key=str) == sorted([(i, "p", 2) for i in (0, 0, 6, 7, 8, 10, 13, None)], key=str)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in pieces} == {0, 6, 7, 8, 10, 13, None}


def test_leaks_in_other_words_of_their_topic_are_dropped(spark, tmp_path):
    rng = random.Random(12)
    common = [f"c{k}" for k in range(40)]
    docs = [(i, " ".join(w for pair in zip(rng.sample([f"t{i % 10}w{k}" for k in range(80)], 30), rng.sample(common, 30)) for w in pair)) for i in range(1500)]
    text, rare = rng.sample(common, 32), rng.sample(range(40), 8)
    item, leak = text.copy(), text.copy()
    for k, at in zip(rare, sorted(rng.sample(range(41), 8))):
        item.insert(at, f"t3w{k}")
        leak.insert(at, f"t3w{k + 40}")
    around = [f"t3w{rng.randrange(40, 80)}" for _ in range(120)]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([*docs, (9000, " ".join([*around[:60], *leak, *around[60:]]))], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.benchmark_leaks(spark, df, str(tmp_path)).collect()}
    assert kept == set(range(1500))
