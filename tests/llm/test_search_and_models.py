"""Nearest neighbours, toxicity, near duplicates and the pipeline, against brute force and held-out rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronofold.llm import ann, jaccard_join, toxicity
from chronofold.llm.components import connected_components


def nearest(vectors, k=10):
    out = {}
    for i, v in vectors.items():
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), j) for j, u in vectors.items() if j != i)[:k]
            out[i] = d
    return out


@pytest.mark.parametrize("n", [1, 5, 900])
def test_ann(spark, n):
    rng = np.random.default_rng(n)
    vectors = {k: rng.normal(size=8).astype(np.float32).tolist() for k in range(n)}
    same = rng.normal(size=8).astype(np.float32).tolist()
    vectors.update({k: same for k in range(n // 3, 2 * n // 3)})
    odd = [(10_000, None), (10_100, [0.0] * 8), (10_200, [float("nan")] * 8), (10_300, [1.0] * 3), (10_400, [None] + [1.0] * 7), (10_500, [float("inf")] * 8), (None, [1.0] * 8)]
    rows = [(k, v, 0, "c") for k, v in [*vectors.items(), *odd, *([(0, vectors[0])] if n > 1 else [])]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, qid string")
    got = defaultdict(list)
    for r in ann.search(table, table.where(F.col("vec_id") % 100 == 0)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = nearest(vectors)
    assert set(got) == {q for q, d in want.items() if d}
    met = 0
    for q, d in want.items():
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, len(d) + 1))
        assert all(s == pytest.approx(float(np.sqrt(((np.array(vectors[q]) - np.array(vectors[v])) ** 2).sum())), abs=1e-12) for _, v, s in rows)
        assert [r[1] for r in rows] == [v for _, v, _ in sorted(rows, key=lambda r: (r[2], r[1]))]
        met += len({v for _, v, _ in rows} & {v for _, v in d})
    assert met >= 0.9 * sum(map(len, want.values()))


def test_ann_repeated_rows_beside_copies(spark):
    same, far = [1.0, 2.0, 3.0, 4.0], [9.0, 0.0, 0.0, 1.0]
    rows = [(0, same)] * 30 + [(k, same) for k in range(1, 15)] * 3 + [(100, far)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, table.where("vec_id = 100")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10))


def test_ann_shortlist_grows_with_the_table():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    q = ann.Quantiser.fit(x[:4000], 16)
    short = q.shortlist(x[:4000], 10, len(x))
    lists = q.assign(x)
    codes = q.encode(x, lists)
    seen = q.centres[lists] + np.column_stack([b[codes[:, g]] for g, b in enumerate(q.books)])
    asked = x[-60:]
    true = np.argsort(ann.squared(asked, x), axis=1)[:, 1:11]
    coded = np.argsort(ann.squared(asked, seen), axis=1)
    held = lambda n: np.mean([len(set(t) & set(c[: n + 1])) / 10 for t, c in zip(true.tolist(), coded.tolist(), strict=True)])
    assert short > 120 and held(short) >= 0.97, (short, held(short), held(120))


def test_ann_splits_lists_and_their_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_PART", 2)
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(3)
    vectors = {k * 20: rng.normal(size=4).astype(np.float32).tolist() for k in range(300)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 100 = 0"), probes=1000, rerank=1000).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    want = {q: [v for _, v in d] for q, d in nearest(vectors).items()}
    assert {q: [v for _, v in sorted(rows)] for q, rows in got.items()} == want


def test_ann_queries_spread_beside_clustered_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_VECTORS", 64)
    monkeypatch.setattr(ann, "LEAST_SEEN", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))[rng.integers(60, size=6000)] + 0.02 * rng.normal(size=(6000, 16))
    asked = np.arange(0, 6000, 100)
    x[asked] = rng.normal(size=(60, 16))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(table, table.where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    d = np.sqrt(((x[asked][:, None] - x[None]) ** 2).sum(2))
    true = {int(q): set(np.argsort(row)[1:11].tolist()) for q, row in zip(asked, d, strict=True)}
    assert sum(len(found[q] & true[q]) for q in true) >= 0.9 * 600


def test_ann_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(table, table).count() == 0


def brute_components(rows, words, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in rows:
        w = (text or "").translate(lower).split()
        sets[doc_id] = set() if not w else {tuple(w)} if len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {(d, len(sets[d]), root(d)) for d in ids}


def near_rows(n=260, seed=0):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [random.choice(vocabulary) for _ in range(30)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(1, 120))] for _ in range(20)]
    rows = []
    for k in range(n):
        w = list(random.choice(base)) if random.random() < 0.7 else [random.choice(vocabulary) for _ in range(random.randint(0, 90))] + passage
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
            if w:
                w[random.randrange(len(w))] = random.choice(vocabulary)
        rows.append((k, random.choice([" ", "  ", "\n"]).join(w).upper() if random.random() < 0.2 else " ".join(w)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "one")]


@pytest.mark.parametrize(("words", "percent", "frequent"), [(4, 85, 4), (4, 85, 2), (5, 80, 16)])
def test_ngram_jaccard(monkeypatch, make_docs, words, percent, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = near_rows(seed=words + frequent)
    got = {tuple(r) for r in jaccard_join.join(make_docs(rows), words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_ngram_jaccard_last_pairs(monkeypatch, make_docs):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 0)
    monkeypatch.setattr(jaccard_join, "PARTS", ())
    monkeypatch.setattr(jaccard_join, "CELL", 3)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 2)
    rows = near_rows(150, seed=9)
    assert {tuple(r) for r in jaccard_join.join(make_docs(rows)).collect()} == brute_components(rows, 4, 85)


def test_ngram_jaccard_odd_rows(make_docs, odd_rows):
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.join(make_docs(odd_rows)).collect())
    assert got == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (None, None): 1, (5, 5): 1, (6, 1): 2, (7, 7): 1})
    assert jaccard_join.join(make_docs([])).count() == 0


def test_one_document_of_each_group_stays(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = jaccard_join.representatives(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 3, 4, 5, 7, None]


def test_ngram_jaccard_rows_without_ids_and_ids_of_two_texts(make_docs):
    one, two, three, four, five = (" ".join(f"{c}{k}" for k in range(30)) for c in "abcde")
    rows = [(None, one), (None, two), (None, two), (None, three), (None, ""), (None, ""), (1, one), (2, two), (3, one), (3, four), (4, four), (5, five), (5, ""), (6, ""), (6, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(make_docs(rows)).collect())
    want = {(None, 27, 1): 1, (None, 27, 2): 2, (None, 27, None): 1, (None, 0, None): 2, (1, 27, 1): 1, (2, 27, 2): 1, (3, 27, 1): 2, (4, 27, 1): 1, (5, 27, 5): 1, (5, 0, 5): 1, (6, 0, 6): 2}
    assert got == Counter(want)
    kept = Counter((r.doc_id, r.text or "") for r in jaccard_join.representatives(make_docs(rows)).collect())
    assert kept == Counter({(1, one): 1, (2, two): 1, (None, three): 1, (None, ""): 2, (3, four): 1, (5, five): 1, (6, ""): 1})


def test_near_copies_without_ids(make_docs):
    rows = [(None, text) for _, text in near_rows(80, seed=3)]
    groups = {c for _, n, c in brute_components([(k, text) for k, (_, text) in enumerate(rows)], 4, 85)}
    assert jaccard_join.representatives(make_docs([*rows, *rows[:40]])).count() >= len(groups)
    assert jaccard_join.representatives(make_docs(rows)).count() == len(groups)


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    rows = [*chain, (100, 99), (101, 99), (5, 5)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99, 101: 99}


def toxic_rows(n=600, seed=0):
    random.seed(seed)
    plain = ["".join(random.choice("abdeghilmnorstu") for _ in range(random.randint(2, 8))) for _ in range(500)]
    insults, stem = ["numpty", "wazzock", "plonker"], "grobl"
    docs, labels = [], []
    for k in range(n):
        words = [random.choice(plain) for _ in range(random.randint(5, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(random.randrange(len(words)), random.choice(insults) if k % 12 else stem + random.choice(["an", "ix", "or", "um"]))
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, make_docs):
    docs, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (100_000, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(make_docs(docs), table)
    assert {t for t, _, _ in model.terms} >= {"numpty", "wazzock", "plonker"}
    truth = {d: t for d, _, t in labels}
    rows = toxicity.scored(make_docs([*docs, (None, None), (7000, "")]), model).collect()
    assert len(rows) == len(docs) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 60 and sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    lexicon = toxicity.Lexicon(model.terms)
    said = dict(zip(["plain", "abuse", "misspelt", "quoted"], model.score(toxicity.features(pa.array(["", "you numpty", "you numpti plonkker", 'they said "numpty" there']), lexicon, {})), strict=True))
    assert said["abuse"] > 0.5 > said["quoted"] and said["misspelt"] > said["plain"] and said["plain"] < 0.5
    kept = toxicity.keep_clean(make_docs(docs), model)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted and r.doc_id in truth}


def test_toxicity_of_many_rare_terms_beside_copies(spark, make_docs):
    random.seed(8)
    word = lambda n: "".join(random.choice("abdeghilmnorstu") for _ in range(n))
    plain, terms = [word(7) for _ in range(600)], [f"zq{word(6)}" for _ in range(60)]
    copied = [word(9) for _ in range(40)]
    docs, labels = [], []
    for k in range(3600):
        words, toxic = random.choices(plain, k=20), k % 3 == 0
        if toxic and k % 9 == 0:
            words = [*copied[: k % 5], *copied[k % 5 + 1 :]]
        elif toxic:
            words.insert(3, terms[k // 9 % 60])
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    model = toxicity.train(make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {t for t, _, _ in model.terms}
    assert sum(any(t.startswith(f) for f in found) for t in terms) >= 54
    assert not any(c.startswith(f) for c in copied for f in found)


def test_misspelt_words_below_a_stem_are_met():
    rows = [("idio", True, 125, 0), ("idiot", False, 124, 0), ("idiots", False, 5, 0), ("plain", False, 50, 900)]
    terms = toxicity.choose_terms(rows, 500, 2500, 1000)
    assert terms[0][:2] == ("idio", True) and {t for t, stem, _ in terms if not stem} == {"idiot", "idiots"}
    lexicon = toxicity.Lexicon(terms)
    assert all(lexicon.match(w)[0] >= 0 and lexicon.match(w)[1] == 1 for w in ["1diot", "idlot", "idot", "1diots"])
    assert lexicon.match("idiotic") == (0, 0) and lexicon.match("plain") == (-1, 0)


def test_training_rows_are_bounded_when_a_labelled_id_repeats(spark, make_docs, monkeypatch):
    rows = [(1, f"numpty number {k % 3000}") for k in range(3500)] + [(k, "fine words here") for k in range(2, 60)]
    labels = spark.createDataFrame([(k, 1, int(k == 1)) for k in range(1, 60)], "doc_id long, quality int, toxic int")
    seen = []
    original = toxicity.near_copies
    monkeypatch.setattr(toxicity, "near_copies", lambda known: seen.append(len(known)) or original(known))
    toxicity.train(make_docs(rows), labels, train_rows=100)
    assert seen and seen[0] <= 100
    repeated = [(1, "numpty it is")] * 500 + rows[3500:]
    toxicity.train(make_docs(repeated), labels, train_rows=100)
    assert seen[1] <= 59


def test_toxicity_without_labels(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs(odd_rows)
    rows = toxicity.scored(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == len(odd_rows) and all(r.score < 0.01 and r.predicted == 0 for r in rows)
    assert toxicity.scored(make_docs([]), toxicity.train(make_docs([]), none)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    random.seed(2)
    words = ["trash", "pathetic", "idiot", "abcab", "ababa"]
    lexicon = toxicity.Lexicon([(w, False, 1.0) for w in words])
    for _ in range(4000):
        w = list(random.choice(words))
        for _ in range(random.randint(0, 3)):
            k = random.randint(0, len(w))
            if random.random() < 0.5:
                w.insert(k, random.choice("abist"))
            elif k < len(w):
                w[k : k + 1] = random.choice(["", "a", "t"])
        word = "".join(w)
        want = next((i for i, x in enumerate(words) if distance(word, x) <= 1), -1)
        assert lexicon.within_one_edit(word) == want
        assert (lexicon.match(word)[0] >= 0) == (want >= 0)


def test_pipeline(spark, tmp_path):
    docs, labels = toxic_rows(300, seed=4)
    line = "this is a line that many of the documents here have, all alike"
    rows = [(d, t + (f"\n{line}" if d % 3 == 0 else ""), "en", f"s{d % 3}", len(t)) for d, t in docs]
    rows += [(1000 + d, t + " x", "en", "s0", len(t)) for d, t, *_ in rows if d % 6 and d < 60 and len(t) > 200]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        table.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(table.collect())
    truth = {d for d, _, t in labels if t}
    assert len({r.doc_id for r in kept[0]} & truth) <= 0.05 * len(truth) and len(kept[0]) >= 0.98 * (len(rows) - len(truth))
    assert len(kept[1]) == len(kept[0]) and sum(line in r.text.split("\n") for r in kept[1]) == 1
    groups = brute_components([(r.doc_id, r.text) for r in kept[1]], 5, 80)
    assert {r.doc_id for r in kept[2]} == {c for _, _, c in groups} and len(kept[2]) < len(kept[1])
    assert {r.doc_id for r in kept[3]} <= {r.doc_id for r in kept[2]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces) == Counter(r.doc_id for r in kept[3])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(pieces)
