"""The text operators against brute force on small fixtures, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from erawood.llm import bpe, components, decontamination, langid, licenses, packing, quality, simhash, substring, urls, warc

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, fp string, bucket int, key int, part int, spans int, score int, "
    "places int, cut_text int, gone int, text_hash int, judged int, failed_rule int, ids int, at int, prefix_tokens int, `a.b` int, __t string, __w int, component_id int"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def corpus():
    base, shared = prose(1, 200), prose(2, 70)
    near = base.split()
    near[100] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 60) + " " + shared + " " + prose(4, 60)), (5, prose(5, 33) + "\n" + shared),
        (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "two words"), (11, "Copyright. All rights reserved. Licensed under CC BY 4.0 now"),
        (12, "same line here\n" * 40), (13, "## $$ %% " * 40), (14, prose(6, 5000)), (15, "Ünïcode wörds " * 3 + "日本語 テキスト 😀"), (4, prose(3, 60) + " " + shared + " " + prose(4, 60)),
        (16, shared), (17, "x" * 5000), (None, base), (None, None), (18, "licensed under the Apache License, version 2.0 and the GNU general public license"),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, "s", None if t is None else len(t), 7, True, "f", *range(1, 16), "mine", 17, 18) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ws(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- quality ---------------------------------------------------------------------------------


def test_quality(docs, empty):
    got = {(r["doc_id"], r["text"]): r for r in quality.quality(docs).collect()}
    for i, t, *_ in corpus():
        r, w = got[i, t], ws(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if ws(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.keep_good(docs).columns == docs.columns
    assert {r[0] for r in quality.keep_good(docs).select("doc_id").collect()} == {1, 2, 3, 4, 5, 14, 16, None}
    assert quality.keep_good(empty).count() == 0 and quality.quality(empty).count() == 0


def test_cascade_order_does_not_change_verdicts(docs):
    rules = [*quality.base_rules(), *quality.default_rules()]
    ordered = quality.order_rules(docs, rules, sample_rows=10_000)
    assert {r.name for r in ordered} == {r.name for r in rules}
    a = quality.cascade(docs, rules).where("kept").select("doc_id").collect()
    b = quality.cascade(docs, rules[::-1]).where("kept").select("doc_id").collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_rules_go_by_rejections_per_measured_cost(docs):
    assert quality.ordered_by_gain([("00", 5), ("10", 2), ("01", 3)], [1.0, 1.0]) == [1, 0]
    assert quality.ordered_by_gain([("00", 5), ("10", 2), ("01", 3)], [1.0, 2.0]) == [0, 1]
    assert quality.ordered_by_gain([("110", 5), ("010", 1), ("001", 2), ("000", 2)], [1.0, 1.0, 1.0]) == [1, 2, 0]  # the first rejects nothing that is left
    patterns, seconds = quality.measured(docs, [*quality.base_rules(), *quality.default_rules()], "text", 10_000, 1)
    assert sum(n for _, n in patterns) == docs.count() and seconds[1] > seconds[0] > 0


def test_later_rules_are_not_evaluated(docs):
    def fails(s):
        return F.raise_error(F.lit("evaluated")).cast("boolean")

    rules = [quality.Rule("all", lambda s: s.n_words >= 0), quality.Rule("never", fails)]
    assert {r[0] for r in docs.select(quality.failed_rule(rules)).collect()} == {"all"}


def test_repeated_words_by_both_ways(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in range(40)] + [" ".join(f"w{rng.randrange(60)} x y" for _ in range(400))]
    texts.append(" ".join(f"v{k}" for k in list(range(200)) * 2))
    got = [r[0] for r in quality.quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)).orderBy("doc_id").select("n_repeat_words").collect()]
    want = []
    for t in texts:
        w = ws(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        want.append(len({j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}))
    assert got == want


# --- near-duplicates ---------------------------------------------------------------------------


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, bits=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(docs, empty, monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE", 64)  # long texts are read in pieces
    rows = sorted((r for r in corpus() if r[0] is not None), key=lambda r: r[0])
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert fps == [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None}
    for r, f, root in zip(rows, fps, roots(fps)):
        assert by[r[0]] == (format(f, "016x"), rows[root][0])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and 2 not in {r["doc_id"] for r in kept.collect()}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_one_of_each_group_by_doc_id_and_text(spark):
    a, b = prose(21, 80), prose(22, 80)
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (6, b), (None, a), (7, None), (8, "")], "doc_id long, text string").repartition(2)
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str) == sorted([(1, a), (5, b), (None, a), (7, None)], key=str)


@pytest.mark.parametrize("block", [2, 12, 4096])
def test_links_in_hot_lists(spark, block):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 60:  # a chain of near fingerprints, and strangers
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps) + [rng.getrandbits(64) for _ in range(40)]
    nodes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "node long, fp long").repartition(3)
    root = {r["node"]: r["root"] for r in components.connected_components(simhash.links(nodes, block)).collect()}
    assert [root.get(i, i) for i in range(len(fps))] == roots(fps)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 300)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 150, 150: 150, 300: 150}


# --- substrings ----------------------------------------------------------------------------------


def brute_removal(rows, window):
    first, keep = {}, []
    for i, t, *_ in rows:
        w = ws(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    for i, t, *_ in rows:
        w = ws(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        keep.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(keep, key=str)


@pytest.mark.parametrize("window", [50, 7])
def test_repeats(docs, empty, window):
    got = sorted(map(tuple, substring.removal_digests(docs, window).collect()), key=str)
    assert got == brute_removal(corpus(), window)
    assert substring.removal_digests(empty, window).count() == 0


def test_repeats_of_random_texts(spark):
    rng = random.Random(3)
    words = [rng.choice("abcd") for _ in range(400)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(350)
            parts += words[a : a + rng.randint(5, 50)]
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring.removal_digests(df, 10).collect()), key=str) == brute_removal(rows, 10)


def test_texts_without_repeats(docs, empty):
    out = {(r["doc_id"], r["text"]): r for r in substring.without_repeats(docs).collect()}
    r = next(r for k, r in out.items() if k[0] == 5)
    assert [tuple(s) for s in r["spans"]] == [(33, 103)] and r["kept_text"] == " ".join(prose(5, 33).split()) and r["n_removed"] == 70
    kept = substring.keep_unrepeated(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and 16 not in ids and 1 in ids and 7 in ids and ids.count(None) == 2
    assert substring.keep_unrepeated(empty).count() == 0


# --- decontamination ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(100, prose(50, 40)), (101, prose(51, 12)), (102, None), (103, ""), (104, prose(52, 25))], "item_id long, text string")


def test_leaks(spark, benchmark, docs, empty):
    item = prose(50, 40).split()
    paraphrase = item[:8] + ["instead"] + item[10:22] + item[23:]
    rows = [(1, prose(60, 90) + " " + prose(50, 40).upper() + ", " + prose(61, 90)), (2, prose(62, 70) + " " + " ".join(paraphrase)), (3, prose(63, 300)), (4, prose(51, 12)), (5, None), (6, " ".join(sorted(item)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(df, benchmark).collect()}
    assert set(got) == {(1, 100), (2, 100), (4, 101)}
    assert got[1, 100]["lcs"] == 1.0 and (got[1, 100]["first_word"], got[1, 100]["end_word"]) == (90, 130) and got[2, 100]["lcs"] > 0.8
    accented = df.sparkSession.createDataFrame([(1, "Été à l'école " + prose(8, 30) + " ça où")], "item_id long, text string")
    loud = df.sparkSession.createDataFrame([(7, prose(3, 80) + " " + ("Été à l'école " + prose(8, 30) + " ça où").upper() + " " + prose(4, 80))], "doc_id long, text string")
    assert [r["item_id"] for r in decontamination.contaminated(loud, accented).collect()] == [1]
    kept = decontamination.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.where("false")).count() == 0
    assert decontamination.keep_clean(df, benchmark).count() == 3


def test_leaks_in_many_documents_and_of_frequent_words(spark):
    hot, plain = prose(70, 40), "alpha beta gamma delta alpha epsilon beta zeta gamma eta alpha theta beta iota"
    rng = random.Random(9)
    common = plain.split()
    rows = [(i, " ".join(rng.choice(common) for _ in range(60)) + " " + prose(1000 + i, 40) + (" " + hot if i % 2 else "")) for i in range(200)]
    rows += [(300 + i, prose(2000 + i, 70) + " " + plain + " " + prose(3000 + i, 70)) for i in range(10)]
    items = spark.createDataFrame([(1, hot), (2, plain)], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).where("lcs = 1").collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 1} == {i for i in range(200) if i % 2}
    assert {r["doc_id"] for r in got if r["item_id"] == 2} >= {300 + i for i in range(10)}


def test_leaks_of_thousands_of_items(spark):
    n = 2000
    rng = random.Random(4)
    vocabulary = [a + b + str(k) for a in WORDS for b in WORDS for k in range(12)]

    def some(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    items = [some(24) for _ in range(n)]
    copies = [(i, " ".join(some(50) + items[i] + some(50))) for i in range(0, n, 4)]
    changed = [(n + i, " ".join(some(50) + [w for k, w in enumerate(items[i]) if k % 8 != 5] + some(50))) for i in range(0, n, 4)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(copies + changed, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, benchmark).collect()}
    found = [sum((base + i, i) in got for i in range(0, n, 4)) for base in (0, n)]
    assert found == [n // 4, n // 4]


def test_leaks_of_very_short_and_very_long_items(spark):
    rng = random.Random(6)
    long = prose(80, 6000).split()
    cut = [w for k, w in enumerate(long) if k % 10 != 3]
    short = [tuple(rng.choice(WORDS) for _ in range(3)) for _ in range(30)]
    rows = [(i, " ".join([prose(4000 + i, 90), *short[i], prose(5000 + i, 90)])) for i in range(30)]
    rows += [(100 + i, " ".join(WORDS)[i:] + " " + prose(6000 + i, 20)) for i in range(300)]
    rows += [(50, " ".join([prose(81, 50), *long, prose(82, 50)])), (51, " ".join([prose(83, 900), *cut, prose(84, 90)])), (52, prose(85, 6000))]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(short)] + [(50, " ".join(long))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert sum((i, i) in got for i in range(30)) == 30
    assert got[50, 50]["lcs"] == 1.0 and (got[50, 50]["first_word"], got[50, 50]["end_word"]) == (50, 6050)
    assert got[51, 50]["lcs"] >= 0.89 and (52, 50) not in got


def brute_leaks(docs, items):
    """Pairs that the rule of word by word checks accepts, over all stretches of all documents."""
    out = set()
    for i, text in docs:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        for j, t in items:
            v = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
            m, size = len(v), min(len(w), len(v) + len(v) // 4 + 2)
            most = 0
            for a in range(max(len(w) - size, 0) + 1):
                stretch = w[a : a + size]
                if sum(x in v for x in stretch) < 0.5 * m:
                    continue
                row = [0] * (m + 1)
                for x in stretch:
                    new = [0]
                    for k in range(m):
                        new.append(row[k] + 1 if v[k] == x else max(row[k + 1], new[k]))
                    row = new
                most = max(most, row[-1])
            if most >= 0.75 * m:
                out.add((i, j))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(17)
    items = [(k, prose(300 + k, rng.choice([10, 15, 25, 40]))) for k in range(25)]
    docs = []
    for i in range(150):
        parts = [prose(400 + i, rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            how = rng.randrange(4)
            if how == 1:  # words go or change
                w = [rng.choice([x, x, x, x, "other", None]) for x in w]
            elif how == 2:  # scrambled, then whole
                w = [*rng.sample(w, len(w)), *w]
            elif how == 3:  # scrambled alone
                rng.shuffle(w)
            parts += [" ".join(x for x in w if x), prose(900 + i, rng.randrange(60))]
        docs.append((i, " ".join(parts)))
    want = brute_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 80 and len(want & set(got)) >= 0.98 * len(want)
    assert all(got[p]["lcs"] < 0.75 for p in set(got) - want)  # these have the item's answer words


def test_an_ordered_copy_beside_scrambled_ones_is_found():
    item = np.arange(1, 41, dtype=np.uint64)
    rng = np.random.default_rng(2)
    copy = item.copy()
    copy[::5] += 1000
    region = np.concatenate([*(rng.permutation(item) for _ in range(2)), copy, *(rng.permutation(item) for _ in range(2))])
    got = decontamination.verify(item, item[:5], region)
    assert got is not None and got[0] >= 0.75 and 60 <= got[2] <= 82


def test_blocks_of_items_share_a_pass(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(3000 + i, 30)) for i in range(600)], "item_id long, text string")
    df = spark.createDataFrame([(i, prose(50 + i, 50) + " " + prose(3000 + i, 30)) for i in range(600)], "doc_id long, text string")
    for size, passes in ((1 << 30, 1), (1, 3)):
        monkeypatch.setattr(decontamination, "PASS_BYTES", size)
        assert len(list(decontamination._passes(df, items))) == passes
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, items).collect()} >= {(i, i) for i in range(600)}


def topics(seed, n_topics=10, per_topic=150):
    """Documents of ten topics, with a random generator and the words: half of a document's are common ones, half are of its topic's 80."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(40)]
    words = [[f"t{t}w{k}" for k in range(80)] for t in range(n_topics)]
    docs = [[w for pair in zip(rng.sample(words[t], 30), rng.sample(common, 30)) for w in pair] for t in range(n_topics) for _ in range(per_topic)]
    return rng, common, words, [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_leaks_whose_rare_words_are_others_of_their_topic(spark):
    rng, common, words, rows = topics(3)
    items, leaks = [], []
    for t, w in enumerate(words):
        item = rng.sample(common, 32)
        at = sorted(rng.sample(range(41), 8))
        changed = item.copy()
        for k, (x, y) in enumerate(zip(rng.sample(w[:40], 8), rng.sample(w[40:], 8))):
            item.insert(at[k], x)
            changed.insert(at[k], y)
        items.append((t, " ".join(item)))
        around = [rng.choice(w[40:]) for _ in range(120)]
        leaks.append((9000 + t, " ".join([*around[:60], *changed, *around[60:]])))
    df = spark.createDataFrame(rows + leaks, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(df, benchmark).collect()}
    assert all(got[9000 + t, t]["lcs"] == 0.8 for t in range(len(words)))
    assert set(range(9000, 9010)).isdisjoint(r["doc_id"] for r in decontamination.keep_clean(df, benchmark).collect())


def test_leaks_that_are_near_in_the_latent_space_alone(spark):
    rng, common, words, rows = topics(13)
    items, leaks = [], []
    for t, w in enumerate(words):
        text, at = rng.sample(common, 30), sorted(rng.sample(range(31), 10))
        item, changed = text.copy(), text.copy()
        for k, x, y in sorted(zip(at, rng.sample(w[:40], 10), rng.sample(w[40:], 10)), reverse=True):
            item.insert(k, x)
            changed.insert(k, y)
        names = iter(f"n{t}x{k}" for k in range(200))  # words of no other document, which no latent dimension holds
        changed = [x for i, w in enumerate(changed) for x in ([w, next(names)] if i % 4 == 3 else [w])]
        items.append((t, " ".join(item)))
        leaks.append((9000 + t, " ".join([*(next(names) for _ in range(57)), *changed, *(next(names) for _ in range(70))])))
    df = spark.createDataFrame(rows + leaks, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(df, benchmark).collect()}
    assert all(got[9000 + t, t]["lcs"] == 0.75 and got[9000 + t, t]["cosine"] < decontamination.COSINE for t in range(len(words)))
    assert set(range(9000, 9010)).isdisjoint(r["doc_id"] for r in decontamination.keep_clean(df, benchmark).collect())


def test_the_nearest_pieces_are_those_of_the_greatest_latent_cosine():
    rng = np.random.default_rng(3)
    space = np.linalg.qr(rng.standard_normal((1 << 16, 8)))[0].astype(np.float32)
    idf = rng.random(1 << 16) + 1
    texts = [prose(600 + i, 30) for i in range(20)] + [prose(605, 30)]
    model = decontamination.Model(list(enumerate(texts)), idf, space)
    passages = decontamination.Passages(pa.array([prose(700 + i, 150) for i in range(9)] + [None, ""]), idf)
    vectors = np.zeros((len(texts) + len(passages.of), 1 << 16))
    for i, t in enumerate(texts):
        np.add.at(vectors[i], decontamination._bucket(decontamination.hashed_words(pa.array([t]))[0]), 1.0)
    for b, d in enumerate(passages.of):
        at = passages.first[d] + (b - passages.head[d]) * 32
        np.add.at(vectors[len(texts) + b], passages.bucket[at : min(at + 64, passages.first[d + 1])], 1.0)
    images = vectors * idf @ space
    images /= np.linalg.norm(images, axis=1)[:, None]
    cosine = images[len(texts) :] @ images[: len(texts)].T
    assert np.allclose(passages.images(space) @ model.latent.T, cosine, atol=1e-4)
    got = decontamination.nearest(passages.images(space), model.latent)
    for c, g in zip(cosine, got):
        want = {j for j in range(len(texts)) if c[j] > 0 and (c > c[j] + 1e-4).sum() < decontamination.NEAREST}
        assert set(np.flatnonzero(g)) == want
    assert (got[:, 5] == got[:, 20]).all() and got[:, 5].any()  # equal pieces tie
    assert not decontamination.nearest(np.zeros((2, 8), np.float32), model.latent).any()


def test_the_latent_space_is_a_truncated_decomposition_of_the_passages(spark, empty):
    _, _, _, rows = topics(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frequencies, n = decontamination.document_frequencies(df)
    idf = np.log1p((n + 1000) / (frequencies + 1.0))
    space = decontamination.latent_space(df, idf, n)
    assert space.shape == (1 << 16, decontamination.RANK) and np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
    matrix = np.zeros((len(rows), 1 << 16), np.float32)
    for i, (_, t) in enumerate(rows):
        h, _ = decontamination.hashed_words(pa.array([t]))
        np.add.at(matrix[i], decontamination._bucket(h), idf[decontamination._bucket(h)])
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    left, size, right = np.linalg.svd(matrix[:, frequencies > 0], full_matrices=False)
    assert (np.linalg.norm(right[:10] @ space[frequencies > 0], axis=1) > 0.99).all()  # the topics
    assert np.linalg.norm(matrix @ space) ** 2 >= 0.95 * (size[: space.shape[1]] ** 2).sum()
    model = decontamination.Model([(1, rows[0][1])], idf, space)
    plain = decontamination.Model([(1, rows[0][1])], idf, space[:, :0])
    assert len(plain.lens) < len(model.lens) and (model.lens[: len(plain.lens)] >= plain.lens).all()  # no weight is lost
    assert decontamination.latent_space(empty, idf, 0).shape == (1 << 16, 0)


def test_many_candidates_are_judged_as_each_alone():
    rng = random.Random(8)
    texts = [prose(20 + i, rng.choice([3, 7, 8, 30, 64, 65])) for i in range(12)]
    rows = [" ".join(x for k in range(4) for x in [prose(90 + i + k, 20), " ".join(w for w in rng.choice(texts).split() if rng.random() < 0.7)]) for i in range(40)]
    idf = np.random.default_rng(1).random(1 << 16) + 1
    model = decontamination.Model(list(enumerate(texts)), idf, np.zeros((1 << 16, 0), np.float32))
    passages = decontamination.Passages(pa.array(rows), idf)
    at = np.minimum(np.searchsorted(model.vocabulary, passages.h), len(model.vocabulary) - 1)
    known = np.where(model.vocabulary[at] == passages.h, at, len(model.vocabulary))
    b, j = (x.ravel() for x in np.meshgrid(np.arange(len(passages.of)), np.arange(len(texts)), indexing="ij"))
    got = decontamination.plausible(passages, model, known, b, j)
    for k, (block, item) in enumerate(zip(b, j)):
        m = len(model.words[item])
        a, z = decontamination.region_of(passages, block, m)
        assert got[k] == (m > 64 or decontamination.possible(model.bags[item], m, passages.h[a:z]))
    assert 0 < got[model.sizes[j] <= 64].sum() < (model.sizes[j] <= 64).sum()


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1, -1]


# --- tokens and packing --------------------------------------------------------------------------

tokenizers = pytest.importorskip("public_tokenizers")


def awkward_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "'", "s", "'ll", "'ve", "re", " ", "  ", "\n", "\t", "1", "²", "é", "ñ", "!", "’", "$$", "中", "😀", "'t", " 's", "\r\n", "\u2003", "<|endoftext|>", "<|end", "the", " of"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]


def test_token_counts(spark, docs, empty):
    path = bpe.tokenizer_path()
    b = bpe.load(path)
    texts = awkward_texts(800, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"], r["cut_bytes"]) for r in bpe.token_counts(df, path, 5).collect()}
    for i, t in enumerate(texts):
        n = len(b.encode(t))
        cut = max(k for k in range(len(t) + 1) if len(b.encode(t[:k])) <= 5)
        assert got[i] == (len(t.encode()), n, n > 5, len(t[:cut].encode())), t
    assert bpe.token_counts(docs, path).count() == docs.count() and bpe.token_counts(empty, path).count() == 0


def test_prefix_counts(spark):
    b = bpe.load(bpe.tokenizer_path())
    for t in [*awkward_texts(250, 2), "It's they'll we've  done\n\n  and 'quoted' 1234567 words" * 2]:
        assert b.prefix_counts(t).tolist() == [len(b.encode(t[:k])) for k in range(len(t) + 1)], t
    texts = [*awkward_texts(400, 5), None, ""]
    table = bpe.prefix_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bpe.tokenizer_path())
    for r in table.collect():
        t = texts[r["doc_id"]] or ""
        assert r["prefix_tokens"] == [len(b.encode(t[:k])) for k in range(len(t) + 1)], t
    df = spark.createDataFrame([(1, "several words to be cut here"), (2, None)], "doc_id long, text string")
    cut = {r["doc_id"]: r["cut_chars"] for r in bpe.truncated(df, bpe.tokenizer_path(), 3).collect()}
    assert cut[2] == 0 and len(b.encode("several words to be cut here"[: cut[1]])) <= 3 < len(b.encode("several words to be cut here"[: cut[1] + 1]))


@pytest.mark.parametrize("window, part", [(64, 3000), (2048, 1 << 24)])
def test_packing(docs, empty, window, part, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", part)
    monkeypatch.setattr(packing, "PARTS", 1 << 30)
    b = bpe.load(bpe.tokenizer_path())
    rows = packing.packed(docs, window=window, shard_docs=3).collect()
    want = Counter((r[0], np.array(b.encode(r[1] or "") + [1], "<u4").tobytes()) for r in corpus())
    pieces = Counter()
    for i, blob in want:
        n = len(blob) // 4
        for r in rows:
            if r["doc_id"] == i and r["doc_tokens"] == n and zlib.crc32(blob[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]:
                pieces[i, blob] += r["length"]
    assert all(pieces[k] >= n * len(k[1]) // 4 for k, n in want.items())
    assert sum(r["length"] for r in rows) == sum(n * len(k[1]) // 4 for k, n in want.items())
    lengths: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths.get(r["sequence_id"], 0) and r["length"] > 0
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= window and (n == window or n & (n - 1) == 0) for n in lengths.values())
    parts = {k >> 32 for k in lengths}
    assert sum(n != window for n in lengths.values()) <= len(parts) * window.bit_length()
    assert packing.packed(empty, window=window).count() == 0


def test_scores_are_those_of_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, rng.integers(0, 60)).astype(np.uint16) for _ in range(25)]
    index, n = packing.Index(docs), len(docs)
    mean = np.mean([len(d) for d in docs])
    bags = [Counter(d.tolist()) for d in docs]
    df = Counter(t for b in bags for t in b)
    for d in range(n):
        want = np.zeros(n)
        for t in bags[d]:
            if df[t] > 1:
                idf = np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
                want += [idf * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) if b[t] else 0 for b, x in zip(bags, docs)]
        assert np.allclose(index.scores(d), want, rtol=1e-5)


def test_windows_fill_with_the_best_unused_document():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 300, rng.integers(5, 60)).astype(np.uint16) for _ in range(40)]
    window, index = 100, packing.Index(docs)
    order = packing.retrieval_order(docs, window, 1, 30)
    assert sorted(order) == list(range(40))
    at, seed, unused = 30, -1, set(range(40))
    for d in order:  # each is the best of what was unused, for the document that opened the window
        if seed >= 0:
            scores = index.scores(seed)
            best = max(unused, key=lambda x: (scores[x], -x))
            assert d == best if scores[best] > 0 else d == min(unused)
        else:
            assert d == min(unused)
            seed = d
        unused.remove(d)
        before, at = at, at + len(docs[d]) + 1
        if before // window != at // window:
            seed = d if at % window else -1


def test_seed_gets_its_neighbour():
    rng = np.random.default_rng(0)
    topic = [rng.integers(1000 * k, 1000 * k + 300, 40) for k in range(4)]
    docs = [np.concatenate([topic[i % 4], rng.integers(9000, 9900, 5)]).astype(np.uint16) for i in range(12)]
    order = packing.retrieval_order(docs, 46 * 3)
    assert sorted(order) == list(range(12))
    assert all(len({order[3 * k + j] % 4 for j in range(3)}) == 1 for k in range(4))


def test_copies_are_dealt_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 2000)
    monkeypatch.setattr(packing, "PARTS", 1 << 30)
    rows = [(i, prose(77, 40)) for i in range(150)] + [(1000 + i, None) for i in range(3000)] + [(5000 + i, prose(100 + i, 40)) for i in range(150)]
    tokens = packing.token_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bpe.tokenizer_path()).cache()
    out, count = packing.dealt(tokens)
    sizes = [r["n"] for r in out.groupBy("part").agg(F.sum(F.octet_length("ids") + 2).alias("n")).collect()]
    assert out.count() == len(rows) and len(sizes) <= count and max(sizes) < 3 * 2000
    assert out.where("slot is null").count() == 0
    tasks = out.repartition(count, "slot").select("part", F.spark_partition_id().alias("p")).distinct().groupBy("p").count()
    assert tasks.agg(F.max("count")).first()[0] == 1
    near = tokens.where("doc_id < 1000").select("key1", "key2").distinct().count()
    assert near == 1


# --- languages, licences, URLs ------------------------------------------------------------------


def test_languages(spark, docs, empty):
    en, de = "the house and the garden with that thing ", "das haus und der garten mit einem ding "
    train = spark.createDataFrame([(en * 5, "en"), (de * 5, "de"), ("x", None), (None, "en")], "text string, lang string")
    model = langid.fit(train)
    df = spark.createDataFrame([(1, en * 3), (2, de * 3), (3, en * 3 + de * 3), (4, None), (5, "12 34 !!"), (6, ""), (7, "é")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4, 5, 6)] == ["en", "de", "und", "und", "und"]
    assert set(got[3]["languages"]) == {"en", "de"} and 0.3 < got[3]["score"] < 0.7 and set(got[1]["languages"]) == {"en"}
    assert got[7]["lang_pred"] in ("en", "de")
    assert langid.identify(docs, model).count() == docs.count() and langid.identify(empty, model).count() == 0
    assert langid.fit(train.where("false")) is None and {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}


def test_rare_labels_do_not_win_what_nobody_knows(spark):
    en = [(prose(i, 60), "en") for i in range(600)]
    rows = [*en, ("der garten und das haus mit einem ding", "de"), ("12 34", "xx"), (None, "yy")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), 100, 50)
    assert model.names == ["en", "de"]
    texts = ["η γάτα είναι στο σπίτι", "xqzvw kjhgf qwrtp", prose(3, 40), "das haus und der garten"]
    got = [r["lang_pred"] for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got == ["en", "en", "en", "de"]


def test_many_labels_have_fewer_ngrams():
    assert langid.bucket_count(4) == langid.bucket_count(512) == 1 << 16 and langid.bucket_count(1000) == 1 << 15 and langid.bucket_count(100_000) == 1 << 12


def test_mixture_is_the_most_likely(spark):
    rng = np.random.default_rng(1)
    model = langid.LanguageModel(["a", "b"], rng.integers(0, 50, (2, 4096)).astype(float))
    bucket = rng.choice(4096, 300, replace=False)
    count = rng.integers(1, 5, 300).astype(float)
    p = model.p[bucket].astype(float)
    pi, fit = model._em(p, count)
    grid = [count @ np.log(p @ np.array([x, 1 - x])) for x in np.linspace(0, 1, 2001)]
    assert abs(fit - max(grid)) < 0.01 and abs(pi[0] - np.linspace(0, 1, 2001)[int(np.argmax(grid))]) < 0.05


def test_licenses(docs, empty):
    got = {}
    for r in licenses.licenses(docs).collect():
        got.setdefault(r["doc_id"], r)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, *_ in corpus():
        if i is None:
            continue
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        places = [k for k, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert got[18]["labels"] == "apache,gpl" and got[18]["base_labels"] == "gpl" and got[11]["labels"] == "cc-by,reserved"
    assert licenses.licenses(docs).count() == docs.count() and licenses.licenses(empty).count() == 0


def brute_spans(text, templates):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w, k, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), licenses.K, []
    for i, (_, t) in enumerate(templates):
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = sorted((a - p, a, p) for a in range(len(w) - k + 1) for p in range(len(v) - k + 1) if w[a : a + k] == v[p : p + k])
        islands: list[list] = []
        for d, a, p in hits:
            if not islands or d - islands[-1][-1][0] > licenses.NEIGHBOUR:
                islands.append([])
            islands[-1].append((d, a, p))
        for island in islands:
            points = sorted((a, -p) for _, a, p in island)
            longest: list[int] = []
            for at, (a, p) in enumerate(points):  # the longest ascending chain, by trying all before
                longest.append(1 + max((n for n, (b, q) in zip(longest, points[:at]) if b < a and -q < -p), default=0))
            out.append((i, len(island), max(longest), len(v)))
    return out


def test_spans_are_those_of_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        _, t = rng.choice(licenses.TEMPLATES)
        w = t.split()
        for _ in range(rng.randrange(4)):  # changes, gaps, swaps
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice([[], ["word"], ["two", "words"], w[:4]])
        texts.append(" ".join([*prose(rng.randrange(99), rng.randrange(9)).split(), *w, *prose(1, 4).split(), *w[len(w) // 2 :], *w[: len(w) // 2]]))
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, key long, text string").repartition(3)
    got: dict = {}
    for r in licenses.template_spans(licenses.scan(df)).collect():
        assert r["coverage"] >= licenses.COVERAGE and 0 <= r["start"] < r["end"]
        got.setdefault(r["doc_id"], Counter())[r["template"], r["votes"]] += 1
    for i, t in enumerate(texts):
        # a chain of n grams covers n + 2 words at least, and three a gram at most
        sure, maybe = Counter(), Counter()
        for template, votes, longest, size in brute_spans(t, licenses.TEMPLATES):
            sure[template, votes] += longest + licenses.K - 1 >= licenses.COVERAGE * size
            maybe[template, votes] += min(licenses.K * longest, size) >= licenses.COVERAGE * size
        assert +sure <= got.get(i, Counter()) <= maybe


def test_chains_are_longest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        at, place = rng.integers(0, 12, (2, rng.integers(1, 25)))
        some = licenses.chain(at, place)
        a, p = at[some], place[some]
        assert (np.diff(a) > 0).all() and (np.diff(p) > 0).all()
        points = sorted(zip(at.tolist(), place.tolist()))
        longest: list[int] = []
        for k, (x, y) in enumerate(points):
            longest.append(1 + max((n for n, (u, v) in zip(longest, points[:k]) if u < x and v < y), default=0))
        assert len(some) == max(longest)


def test_license_spans_with_gaps(spark):
    text = "intro " * 7 + "Permission is hereby granted, free of charge, to any single person obtaining a copy of this software and associated documentation files"
    scrambled = " ".join(sorted("you can redistribute it and or modify it under the terms of the gnu general public license".split()))
    whole = next(t for label, t in licenses.TEMPLATES if label == "isc").upper()
    df = spark.createDataFrame([(1, 5, text), (2, 6, scrambled), (3, 7, whole)], "doc_id long, key long, text string")
    got = {(r["doc_id"], licenses.TEMPLATES[r["template"]][0]): r for r in licenses.template_spans(licenses.scan(df)).collect()}
    assert set(got) == {(1, "mit"), (3, "isc")}
    r = got[1, "mit"]
    assert (r["start"], r["end"]) == (7, 28) and 0.75 <= r["coverage"] <= 1 and got[3, "isc"]["coverage"] == 1


def test_urls(spark):
    rows = [(1, "http://A.Example.COM/en/712?x"), (2, "https://b.com/en/9"), (3, "https://example.com"), (4, None), (5, "no scheme"), (6, "x://h.org/es/1#a"), (7, "x://com/en/"), (8, "x://notexample.net/de/8"), (9, "x://example.net/de/81"), (10, "://?q"), (10, "://?q")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    want = {1: ("a.example.com", "/en/712", "example.com/en/7", "allow"), 2: ("b.com", "/en/9", "com/en/", "block"), 3: ("example.com", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("h.org", "/es/1", "org/es/", "block"), 7: ("com", "/en/", "com/en/", "block"), 8: ("notexample.net", "/de/8", "net/de/", "allow"), 9: ("example.net", "/de/81", "example.net/de/8", "block"), 10: ("", "", None, "allow")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == want
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_are_learned(spark):
    rows = [(i, f"http://h.io/bad/{i}") for i in range(60)] + [(100 + i, f"http://h.io/good/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(50)], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels=labels).collect()}
    assert {got[i]["verdict"] for i in range(60)} == {"block"} and {got[100 + i]["verdict"] for i in range(60)} == {"allow"}
    assert got[55]["template"] == "/bad/*" and len(got) == 120


def test_bad_branch_among_many_siblings(spark):
    rows = [(100 * k + i, f"http://h.io/part{chr(97 + k % 26)}{'x' * (k // 26)}/{i}") for k in range(31) for i in range(60)]
    labels = spark.createDataFrame([(p, int(p < 100)) for p, _ in rows if p % 100 < 50], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels=labels).collect()}
    assert {p for p, v in got.items() if v == "block"} == set(range(60))


def brute_templates(rows, bad):
    """Template and (labelled, purity) of each path of each host, by a tree in plain dictionaries."""
    counts: dict = {}
    for page, host, segs in rows:
        n, b = counts.get((host, segs), (0, 0))
        counts[host, segs] = (n + (page in bad), b + bad.get(page, 0))
    total = sum(n for n, _ in counts.values())
    prior = sum(b for _, b in counts.values()) / max(total, 1)
    rate = lambda b, n: (b + urls.PRIOR * prior) / (n + urls.PRIOR)
    template = {k: k[1] for k in counts}
    level = 0
    while True:
        groups: dict = {}
        for k, (n, b) in counts.items():
            t = template[k]
            if len(t) > level:
                x = groups.setdefault((k[0], t[:level]), {}).setdefault(t[level], [0, 0])
                x[0] += n
                x[1] += b
        groups = {k: v for k, v in groups.items() if sum(n for n, _ in v.values()) >= urls.LEAST_LABELLED}
        if not groups:
            break
        renamed = dict(template)
        for (host, parent), children in groups.items():
            pn, pb = (sum(x[i] for x in children.values()) for i in (0, 1))
            for child, (n, b) in children.items():
                p1, p2 = rate(b, n), rate(pb - b, pn - n)
                error = (p1 * (1 - p1) / (n + urls.PRIOR) + p2 * (1 - p2) / (pn - n + urls.PRIOR)) ** 0.5
                if len(children) > 1 and (abs(p1 - p2) <= urls.Z * error or (len(children) > urls.MANY and n < urls.LEAST_LABELLED)):
                    for k, t in template.items():
                        if k[0] == host and t[: level + 1] == (*parent, child):
                            renamed[k] = (*parent, "*", *t[level + 1 :])
        template = renamed
        level += 1
    sums: dict = {}
    for k, (n, b) in counts.items():
        x = sums.setdefault((k[0], template[k]), [0, 0])
        x[0] += n
        x[1] += b
    return {k: (template[k], sums[k[0], template[k]][0], rate(sums[k[0], template[k]][1], sums[k[0], template[k]][0])) for k in counts}


def test_templates_are_those_of_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1800):
        host = rng.choice(["a.io", "b.io", "c.io"])
        segs = [rng.choice("pqrs") * rng.choice([2, 3])] + [rng.choice(["u", "v", "wx"]) for _ in range(rng.choice([1, 1, 1, 2, 8]))]
        if host == "c.io":
            segs = [f"k{'y' * rng.randrange(25)}", *segs]
        rows.append((i, f"http://{host}/{'/'.join(segs)}", host, tuple(segs)))
    bad = {i: int((segs[0][0] == "p" or (len(segs) > 1 and segs[1][0] == "p")) != (rng.random() < 0.02)) for i, _, _, segs in rows if rng.random() < 0.8}
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").repartition(3)
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels=labels).collect()}
    want = brute_templates([(i, host, segs) for i, _, host, segs in rows], bad)
    blocked = 0
    for i, _, host, segs in rows:
        template, n, purity = want[host, segs]
        verdict = "block" if purity >= urls.PURITY and n >= urls.LEAST_LABELLED else "allow"
        blocked += verdict == "block"
        assert got[i]["template"] == "/" + "/".join(template) and abs(got[i]["purity"] - purity) < 1e-12 and got[i]["verdict"] == verdict
    assert blocked > 20


def test_deep_paths_are_told_apart(spark):
    rows = [(i, f"http://h.io/a/b/c/d/e/f/{'bad' if i < 60 else 'good'}/{i}") for i in range(120)] + [(500, "http://h.io/" + "x/" * 3000)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 60 < 50], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels=labels).collect()}
    assert {p for p, v in got.items() if v == "block"} == set(range(60))


def test_urls_of_tables_with_other_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1", "h", "v", 1), (1, "http://a.com/en/1", "h", "v", 1)], "page_id long, url string, host string, verdict string, bad int")
    assert [(r["host"], r["verdict"]) for r in urls.judge(df).collect()] == [("a.com", "block")] * 2


# --- archives -------------------------------------------------------------------------------------


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    long, short = "<p>é\r\n\r\n</p>" * 30, "tiny"
    rows = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (1, "http://c", short), (2, "http://d", short), (4, "u\r\nv", None), (6, "u", ""), (7, "u", "y" * 99), (8, "u", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warc.deduplicate(pages, str(tmp_path / "w")).collect()}
    for i, url, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        again = len(raw) >= 100 and min(same) != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", min(same)) if again else ("response", None))
        assert r["uri"] == (None if url is None else url.replace("\r\n", ""))
    with_all = {"warc-type", "warc-record-id", "warc-date", "content-length", "content-type"}
    kinds, ids, refers, bare = Counter(), set(), set(), []
    for one in (tmp_path / "w" / "deduplicated").glob("*.warc.gz"):
        with open(one, "rb") as f:
            records = [warc.parse(raw) for _, _, raw in warc.members(f, 7)]
        assert records[0][0]["warc-type"] == "warcinfo" and records[0][0]["warc-filename"] == one.name and b"format:" in records[0][1]
        for fields, block in records:
            assert with_all <= set(fields) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["warc-record-id"])
            assert fields["warc-date"] >= "2025" and len(block) == int(fields["content-length"])
            kinds[fields["warc-type"]] += 1
            ids.add(fields["warc-record-id"])
            if fields["warc-type"] != "warcinfo":
                assert {"warc-target-uri", "warc-payload-digest", "warc-warcinfo-id"} <= set(fields) and fields["warc-target-uri"]
            if fields["warc-type"] == "revisit":
                assert {"warc-profile", "warc-refers-to-target-uri", "warc-refers-to-date"} <= set(fields) and block.endswith(b"\r\n\r\n")
                refers.add(fields["warc-refers-to"])
            bare.append(fields["warc-type"])
    assert kinds["revisit"] == 3 and kinds["response"] == 8 and len(ids) == sum(kinds.values()) and refers <= ids
    assert warc.deduplicate(pages.where("false"), str(tmp_path / "e")).count() == 0


def test_archives_of_repeated_and_long_pages(spark, tmp_path):
    long = "wörd " * 200_000
    rows = [(4, "u", long, 1, "p"), (4, "u", long, 2, "p"), (9, "u", long, 3, "p"), (None, "v", long, 4, "p"), (None, None, None, 5, "p"), (5, "", "x" * 100, 6, "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int, path string").repartition(2)
    got = sorted(((r["page_id"], r["uri"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.deduplicate(pages).collect()), key=str)
    n = len(long.encode())
    assert got == sorted([(4, "u", n, "response", None), (4, "u", n, "response", None), (9, "u", n, "revisit", 4), (None, "v", n, "revisit", 4), (None, None, 0, "response", None), (5, "", 100, "response", None)], key=str)


# --- the corpora of large clusters in small --------------------------------------------------------


def test_a_passage_of_very_many_documents_fills_no_bucket(spark, monkeypatch):
    shared = prose(500, 60)
    rows = [(i, prose(1000 + i, 3 + i % 7) + " " + shared + " " + prose(9000 + i, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    total, buckets, chunk = substring.layout(df)
    send = spark.sparkContext.broadcast
    found = substring.frequent_windows(df, (25, 50), total)
    assert all(len(f.hashes) for f in found)
    seen = {}
    for name, blocks in (("with", found[0]), ("without", substring.Frequent())):
        packed = df.select("doc_id", "text")
        anchored = substring.anchors(packed, 50, buckets, chunk, send(blocks))
        seen[name] = sum(len(r["places"]) for r in anchored.collect())
    assert seen["with"] < seen["without"] / 20
    for sample in (1 << 20, 0):  # with and without frequent windows the result is the same
        monkeypatch.setattr(substring, "MOST_FREQUENT", sample)
        assert sorted(map(tuple, substring.removal_digests(df).collect()), key=str) == brute_removal(rows, 50)


def test_sampled_windows_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "SAMPLE_BYTES", 20_000)
    rng = random.Random(31)
    shared = [prose(600 + k, 70) for k in range(4)]
    rows = [(i, " ".join([prose(7000 + i, rng.randrange(40)), rng.choice(shared), prose(8000 + i, rng.randrange(40)), *rng.sample(shared, rng.randrange(3))])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring.removal_digests(df).collect()), key=str) == brute_removal(rows, 50)


# --- very long texts, ties and repeats, for all ------------------------------------------------------


@pytest.fixture(scope="module")
def giants(spark):
    long = prose(1, 120_000)
    rows = [(1, long), (2, long + " " + prose(2, 60)), (3, "x" * 1_500_000), (4, " " * 800_000 + "é" * 300_000), (5, prose(3, 70_000) + " " + prose(50, 40) + " all rights reserved"), (6, "word"), (7, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_very_long_texts_are_read_whole(spark, giants):
    rows, df = giants
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(df).collect()}
    removed = sorted(map(tuple, substring.removal_digests(df).collect()), key=str)
    b = bpe.load(bpe.tokenizer_path())
    tokens = {r["doc_id"]: r for r in bpe.token_counts(df, bpe.tokenizer_path()).collect()}
    scanned = {r["doc_id"]: r for r in licenses.licenses(df).collect()}
    for i, t in rows:
        w = ws(t)
        assert got[i]["n_words"] == len(w) and got[i]["word_chars"] == sum(map(len, w))
        assert prints[i] == format(brute_fingerprint(t), "016x")
        assert tokens[i]["n_tokens"] == len(b.encode(t or "")) and tokens[i]["n_bytes"] == len((t or "").encode())
        assert len(b.encode((t or "").encode()[: tokens[i]["cut_bytes"]].decode())) <= 1024
    assert removed == brute_removal(rows, 50)
    assert scanned[5]["labels"] == "reserved" and scanned[5]["first_word"] == 70_040 and scanned[3]["n_words"] == 1
    pieces = packing.packed(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {i: tokens[i]["n_tokens"] + 1 for i, _ in rows}


def test_very_long_texts_are_searched_whole(spark, giants):
    rows, df = giants
    items = spark.createDataFrame([(9, prose(50, 40))], "item_id long, text string")
    (r,) = decontamination.contaminated(df, items).collect()
    assert (r["doc_id"], r["first_word"], r["lcs"]) == (5, 70_000, 1.0)
    model = langid.fit(spark.createDataFrame([(prose(1, 300), "en"), ("é" * 40, "fr")], "text string, lang string"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert got[1] == got[2] == got[5] == "en" and got[4] == "fr" and got[7] == "und"


def test_ties_have_defined_results(spark):
    model = langid.LanguageModel(["a", "b"], np.ones((2, 1 << 16)))
    got = langid.identify(spark.createDataFrame([(1, "same for both"), (2, "é")], "doc_id long, text string"), model).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and all(abs(r["score"] - 0.5) < 1e-6 or r["score"] == 1.0 for r in got)
    rules = [("block", "a.com", "/x"), ("allow", "com", "/x.."), ("allow", "a.com", "/x")]
    (r,) = urls.judge(spark.createDataFrame([(1, "http://a.com/x..")], "page_id long, url string"), rules).collect()
    assert (r["rule"], r["verdict"]) == ("a.com/x", "block")  # of equally long ones the first
    rows = [(1, prose(5, 50))] * 4 + [(2, prose(5, 50))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(tuple, packing.packed(df.repartition(n)).collect())) for n in (1, 5))
    assert a == b
    item = spark.createDataFrame([(1, prose(50, 20))], "item_id long, text string")
    twice = spark.createDataFrame([(1, " ".join([prose(1, 40), prose(50, 20), prose(2, 400), prose(50, 20)]))], "doc_id long, text string")
    assert [r["first_word"] for r in decontamination.contaminated(twice, item).collect()] == [40]


def test_one_passage_in_fifty_thousand_documents(spark):
    n, shared = 50_000, prose(700, 60)
    own = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.xxhash64(F.col("id"), F.lit(k)).cast("string")) for k in range(12)])
    df = spark.range(0, n, 1, 6).select(F.col("id").alias("doc_id"), F.concat_ws(" ", own, F.lit(shared), F.col("id").cast("string")).alias("text")).cache()
    total, buckets, chunk = substring.layout(df)
    blocks, windows = substring.frequent_windows(df, (25, 50), total)
    # windows of the passage alone are in every document, and none of them goes through a bucket
    assert len(blocks.hashes) >= 36 and len(windows.hashes) >= 11 and set(blocks.least) == {0} and set(blocks.last) == {n - 1}
    assert substring.anchors(df, 50, buckets, chunk, spark.sparkContext.broadcast(blocks)).count() == 0
    got = substring.removal_digests(df).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(73, 0, 1), (73, 60, n - 1)]
    df.unpersist()
