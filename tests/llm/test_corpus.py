import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from levelling.llm import entropy_mix, ngram_join, ordinal, packing
from levelling.llm.tokens import lower_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


# --- packing -----------------------------------------------------------------

def waste(lengths, ends):
    return sum(min(e for e in ends if e >= x) - x for x in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.choice([1, 2, 3, 5, 8, 9, 20, 21, 22, 40, 41, 90]) for _ in range(rng.randint(1, 40))]
        cells = sorted(set(lengths))
        count = np.array([lengths.count(c) for c in cells])
        for k in (1, 2, 3, 5):
            ends = packing.best_boundaries(np.array(cells), count, count * np.array(cells), k)
            assert len(ends) <= k and ends == sorted(ends) and ends[-1] == cells[-1]
            best = min(waste(lengths, (*c, cells[-1])) for r in range(min(k, len(cells)))
                       for c in itertools.combinations(cells[:-1], r))
            assert waste(lengths, ends) == best


def test_batches_hold_every_document_once_within_the_budget(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("x" for _ in range(rng.choice([0, 1, 5, 30, 200]))), "s") for i in range(300)]
    rows += [(900, None, None), (901, " \n ", "s"), (902, "y " * 5000, "s"), (3, rows[3][1], "s"), (None, "a b", "s")]
    docs = docs_of(spark, rows).withColumn("bucket", F.lit("clash")).withColumn("tie", F.lit(1))
    got = packing.pack(docs, buckets=4, budget=256).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        (i is None, i or 0, len(lower_words(t)) + 1) for i, t, _ in rows)
    by = {}
    for r in got:
        assert 0 <= r.padding == r.bucket_len - r.n_tokens
        by.setdefault(r.batch_id, []).append(r)
    assert sorted(by) == list(range(len(by)))
    for b in by.values():
        assert len({(r.bucket, r.bucket_len) for r in b}) == 1
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_len <= 256
    assert len({r.bucket for r in got}) == 4
    short = [b for b in by.values() if len(b) < max(1, 256 // b[0].bucket_len)]
    assert len(short) <= 4  # only the last batch of a bucket is not full
    assert packing.pack(docs.limit(0)).collect() == []


def test_boundaries_are_optimal_for_long_texts(spark):
    lengths = [1500, 1501, 1501, 1510, 1511, 2040, 2041, 2047, 2047, 20000, 20001, 7, 8]
    docs = docs_of(spark, [(i, "x " * (n - 1), "s") for i, n in enumerate(lengths)])
    for k in (3, 5):
        got = packing.pack(docs, buckets=k, budget=30000).collect()
        best = min(waste(lengths, (*c, 20001)) for c in itertools.combinations(sorted(set(lengths) - {20001}), k - 1))
        assert sum(r.padding for r in got) == best and len({r.bucket for r in got}) == k


# --- mixing ------------------------------------------------------------------

def water(sizes, weights, share=1.0, cap=3.0):
    """Targets by the rule's words: reshare the excess until none is above."""
    total, held = sum(sizes) * share, {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = total - sum(held.values())
        t = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if t[i] > cap * sizes[i]]
        if not over:
            return [held.get(i, t.get(i)) for i in range(len(sizes))]
        held |= {i: cap * sizes[i] for i in over}


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    names = ["b", "a", None, "é", "z", "tiny"]
    rows = [(i, "w " * rng.choice([3, 10, 40, 41, 300]), names[0] if i % 3 == 0 else names[1 + i % 4])
            for i in range(600)]
    rows += [(1000, "w w", "tiny"), (1001, None, "a"), (1002, "", "void"), (3, rows[3][1], rows[3][2]),
             (None, "w " * 7, "a")]
    docs = docs_of(spark, rows).withColumn("target", F.lit(1)).withColumn("lam", F.lit(2))
    got = entropy_mix.mixed(docs).collect()
    assert len(got) == len(rows)
    order = sorted({s for _, _, s in rows if s is not None}) + [None]
    size = [sum(len(lower_words(t)) for _, t, s in rows if s == o) for o in order]
    target = dict(zip(order, water(size, [(5, 2, 1)[i % 3] for i in range(len(order))])))
    source = {(i, len(lower_words(t))): s for i, t, s in rows}
    took = dict.fromkeys(order, 0)
    for r in got:
        s = source[r.doc_id, r.size]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == size[order.index(s)]
        assert r.taken == r.copies * r.size <= 3 * r.size and abs(r.copies - r.rate) < 1 + 1e-9 or r.size == 0
        took[s] += r.taken
    for s in order:
        assert abs(took[s] - target[s]) <= 5, (s, took[s], target[s])
    assert sorted(map(str, got)) == sorted(map(str, entropy_mix.mixed(docs.repartition(5)).collect()))
    kept = entropy_mix.apply_mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in got)
    assert entropy_mix.mixed(docs.limit(0)).collect() == []


def test_mix_with_prior_rates_tilts_them(spark):
    rows = [(i, "w " * (20 + i % 50), "s" + str(i % 2)) for i in range(400)]
    got = entropy_mix.mixed(docs_of(spark, rows), weights=(3, 1), cap=3,
                            prior=F.when(F.col("doc_id") % 4 < 2, 2.0).otherwise(0.5)).collect()
    rate = {}
    for r in got:
        rate.setdefault((r.doc_id % 2, r.doc_id % 4 < 2), set()).add(round(r.rate, 9))
    assert all(len(v) == 1 for v in rate.values())
    assert abs(rate[1, True].pop() / rate[1, False].pop() - 4) < 1e-6  # tilted alike, below the cap
    for k in (0, 1):
        part = [r for r in got if r.doc_id % 2 == k]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 40


# --- n-gram join ---------------------------------------------------------------

def brute_join(rows, n, percent):
    def grams(t):
        w = lower_words(t)
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    sets = [grams(t) for _, t, _ in rows]
    lab = list(range(len(rows)))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= percent * len(x | y):
                lab[find(a)] = find(b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least[find(i)] if d is not None else None)
                   for i, (d, _, _) in enumerate(rows)), key=str)


def near_corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]

    def text(k):
        return [rng.choice(words) for _ in range(k)]
    rows, base, passage = [], text(150), text(40)
    for i in range(150):
        if i % 3 == 0:                                  # a third: near copies of one text
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif i % 3 == 1:                                # a shared passage
            w = text(rng.randint(0, 8)) + passage + text(rng.randint(0, 8))
        else:
            w = text(rng.choice([0, 1, 2, 3, 9, 10, 11, 60]))
        rows.append((i, " ".join(w), "s"))
    rows += [(200, rows[0][1].upper(), "s"), (201, None, "s"), (202, "", "s"), (203, " \t\n", None),
             (204, "one two", "s"), (205, "One  two", "s"), (None, rows[0][1], "s"), (3, rows[3][1], "s"),
             (206, " ".join(text(3000)), "s")]
    return rows


def test_join_matches_brute_force(spark):
    for seed, n, percent in ((1, 3, 90), (2, 5, 80)):
        rows = near_corpus(seed)
        docs = docs_of(spark, rows).withColumn("mark", F.lit("x")).withColumn("rep", F.lit(0))
        got = ngram_join.jaccard_components(docs, n=n, percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_join(rows, n, percent)


def test_keep_one_of_each_group(spark):
    rows = near_corpus(3)
    docs = docs_of(spark, rows)
    kept = ngram_join.keep_one(docs)
    want = brute_join(rows, 3, 90)
    first = sorted((d for d, _, c in want if d == c and d is not None), key=str)
    got = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None), key=str)
    first.remove(3) if first.count(3) == 2 else None
    assert got == first and kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
    assert ngram_join.jaccard_components(docs.limit(0)).collect() == []
    assert ngram_join.keep_one(docs.limit(0)).collect() == []


# --- classifier ----------------------------------------------------------------

def test_gradient_of_the_ordinal_loss():
    rng = np.random.default_rng(6)
    s, y, raw = rng.normal(size=20), rng.integers(0, 4, 20), rng.normal(size=3)
    loss, by_s, by_raw = ordinal.gradient(s, y, raw)
    eps = 1e-6
    for i in range(20):
        d = np.zeros(20)
        d[i] = eps
        assert abs((ordinal.gradient(s + d, y, raw)[0] - loss) / eps - by_s[i]) < 1e-3
    for k in range(3):
        d = np.zeros(3)
        d[k] = eps
        assert abs((ordinal.gradient(s, y, raw + d)[0] - loss) / eps - by_raw[k]) < 1e-3
    p = ordinal.tails(s, raw)
    assert (np.diff(p, axis=1) <= 0).all()


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(7)
    plain, bad = [f"p{i}" for i in range(400)], [f"vile{i}" for i in range(10)]
    rows, labels = [], []
    for i in range(1000):
        grade = rng.choice([0, 1, 2, 2, 2])
        w = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if grade < 2:
            w = [rng.choice(bad) if rng.random() < 0.05 else x for x in w] + [bad[0]]
        if grade < 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(grade > 0), int(grade < 2)))
    docs = docs_of(spark, [*rows, (2000, None, "s"), (2001, "", None)]).withColumn("quality", F.lit("clash"))
    table = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    table = table.unionByName(spark.createDataFrame([(0, None, 1), (9999, 1, 1)], table.schema))
    model = ordinal.fit(docs, table)
    got = {r.doc_id: r.q for r in ordinal.score(docs, model, out="q").collect()}
    test = [x for x in labels if not x[0] % 2]
    right = sum((got[i].tail >= 0.5) == (q == 1 and t == 0) for i, q, t in test)
    assert right >= 0.95 * len(test), right
    mean = [np.mean([got[i].expected for i, q, t in test if q + 1 - t == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert ordinal.select(docs, model).columns == docs.columns
    none = ordinal.fit(docs, table.limit(0))
    assert {r.q.tail for r in ordinal.score(docs, none, out="q").collect()} == {0.5}
    assert ordinal.score(docs.limit(0), model).collect() == []


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.stash(stage(spark, at, sf), "test")
        assert at.columns == docs.columns
        seen[name] = at.collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"]}
    clean = [d for d, x in labels.items() if x.quality == 1 and x.toxic == 0]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)
    rows = [(r.doc_id, r.text, r.source) for r in seen["quality"]]
    want = brute_join(rows, 5, 80)
    assert sorted(r.doc_id for r in seen["near copies"]) == sorted(d for d, _, c in want if d == c)
    for r in seen["personal data"]:
        assert "@" not in r.text and r.n_chars == len(r.text)
    assert len(seen["personal data"]) == len(seen["near copies"])
    times = {}
    for r in seen["mix"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in seen["personal data"]}
    packed = corpus_pipeline.pack(spark, at, sf).collect()
    assert sorted(r.doc_id for r in packed) == sorted(r.doc_id for r in seen["mix"])


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a = [f"w{i}" for i in range(40)]
    near, other = a + ["x"], [f"v{i}" for i in range(40)]
    rows = [(3, " ".join(a)), (5, " ".join(near)), (5, " ".join(other)), (9, " ".join(other + ["y"])), (7, "solo text here"),
            (8, " ".join(f"u{i}" for i in range(50))), (8, " ".join(f"u{i}" for i in range(51)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in
                 ngram_join.jaccard_components(docs, n=3, percent=90).collect())
    assert got == [(3, 38, 3), (5, 38, 5), (5, 39, 3), (7, 1, 7), (8, 48, 8), (8, 49, 8), (9, 39, 5)]
    kept = sorted((r.doc_id, r.text) for r in ngram_join.keep_one(docs, n=3, percent=90).collect())
    assert [k for k, _ in kept] == [3, 5, 7, 8] and kept[1][1] == " ".join(other)


def test_copies_belong_to_their_source(spark):
    text = "one two three four"
    rows = [(1, text, "a"), (1, text, "b")] + [(10 + i, "w " * 400, "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    take = {(r.doc_id, r.source_size): r.copies for r in entropy_mix.mixed(docs, weights=(2, 1), cap=3).collect()}
    got = entropy_mix.apply_mix(docs, weights=(2, 1), cap=3).groupBy("doc_id", "source").count().collect()
    sizes = {"a": 4, "b": 4 + 30 * 400}
    assert {(r.doc_id, r.source): r["count"] for r in got} == {
        (i, s): take[i, sizes[s]] for i, _, s in rows if take[i, sizes[s]]}


def test_a_long_text_does_not_end_the_walk(spark):
    """One text of 20,000 words among 3,000 of seven: its source still comes within seven words of its target."""
    rows = [(0, "w " * 20000, "b")] + [(i, "a b c d e f g", "b") for i in range(1, 3001)]
    rows += [(i, "x y z " * 20, "a") for i in range(4000, 8000)] + [(i, "v " * 9, "c") for i in range(8000, 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = entropy_mix.mixed(docs).groupBy("source_size", "target").sum("taken").collect()
    short = {240000: 60, 41000: 7, 9000: 9}  # the shortest text of the source
    assert {size: abs(taken - target) <= short[size] for size, target, taken in got} == dict.fromkeys(short, True), got


def test_mix_passes_over_all_documents_are_few(spark, monkeypatch):
    """A step of Newton's method or of the walk reads sums of sources or the documents that still fit, not all."""
    seen = {"units": 0, "strata": 0}
    stash = entropy_mix.stash

    def counted(df, name):
        out = stash(df, name)
        if name in ("units", "strata", "fitting"):
            seen.setdefault(name, 0)
            seen[name] = max(seen[name], out.count())
        return out
    monkeypatch.setattr(entropy_mix, "stash", counted)
    docs = docs_of(spark, [(i, "w " * (1 + i * i % 97), "abc"[i % 3]) for i in range(900)])
    assert entropy_mix.mixed(docs).where("copies > 0").count() > 0
    assert seen["units"] == 900 and seen["strata"] == 3 and seen["fitting"] < 900


def test_single_documents_of_the_mix_are_one_step(spark, monkeypatch):
    """Every table that the mix writes is jobs and plans on the driver: 67 of them here when each single was a step."""
    written, stash = [], entropy_mix.stash
    monkeypatch.setattr(entropy_mix, "stash", lambda df, name: written.append(name) or stash(df, name))
    rng = random.Random(1)
    names = ["a", "b", None, "c", "d", "e", "tiny"]
    rows = [(i, "w " * rng.choice([1, 3, 10, 40, 41, 300, 1000]) + str(i), rng.choice(names)) for i in range(700)]
    rows += [rows[3], rows[3], (None, None, "a"), (5, "", None)]
    got = entropy_mix.mixed(docs_of(spark, rows)).collect()
    assert len(written) <= 40, written
    groups = {}
    for r in got:
        groups.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), part in groups.items():
        lacks = target - sum(r.taken for r in part)
        least = min(r.size for r in part if r.size)
        assert abs(lacks) <= least, (target, lacks)


def test_a_step_of_newtons_method_is_taken_for_sources_of_one_prior(spark, monkeypatch):
    """sources of one prior (op7_source_mix has no others) were taken as solved without a step."""
    written, stash = [], entropy_mix.stash
    monkeypatch.setattr(entropy_mix, "stash", lambda df, name: written.append(name) or stash(df, name))
    docs = docs_of(spark, [(i, "w " * (1 + i * i % 97), "abc"[i % 3]) for i in range(300)])
    assert entropy_mix.mixed(docs).where("copies > 0").count() > 0
    assert written.count("dual") == 2, written  # the start and a step


def test_op7_mixes_the_documents_and_counts_what_they_hold(spark, monkeypatch, tmpdir_fresh):
    """the query stopped at the plan; no document was repeated and ``taken`` was never found in any."""
    from levelling.llm import queries
    rng = random.Random(9)
    rows = [(i, " ".join([f"w{i}"] * rng.choice([1, 3, 10, 41])), ["a", "b", None, "c"][i * i % 7 % 4]) for i in range(200)]
    rows += [rows[3], rows[3], (None, "one two", "a"), (5, None, "b"), (6, "", "void"), (1, rows[1][1], "c")]
    docs_of(spark, rows).write.parquet(f"{tmpdir_fresh}/documents.parquet")
    kept, stash = {}, queries.stash
    lose = []

    def stored(df, name):
        kept[name] = stash(df.where(F.col("doc_id") != lose[0]) if lose and name == "mix" else df, name)
        return kept[name]
    monkeypatch.setattr(queries, "stash", stored)
    got = queries.op7_source_mix(spark, tmpdir_fresh).collect()
    mix = kept["mix"]
    assert mix.columns == spark.read.parquet(f"{tmpdir_fresh}/documents.parquet").columns
    texts = {}
    for r in mix.collect():
        texts[r.doc_id, r.source, r.text] = texts.get((r.doc_id, r.source, r.text), 0) + 1
    times = {r: rows.count(r) for r in rows}
    assert sorted(((r.doc_id or -1, r.size, r.copies, r.taken) for r in got)) == sorted(
        (i or -1, len(lower_words(t)), n // times[i, t, s], n // times[i, t, s] * len(lower_words(t)))
        for i, t, s in rows for n in [texts.get((i, s, t), 0)])
    planned = entropy_mix.mixed(docs_of(spark, rows), weights=(5, 2, 1), share=1.0, cap=3)
    assert sorted(map(str, planned.select(*got[0].__fields__).collect())) == sorted(map(str, got))
    lose.append(next(r.doc_id for r in got if r.copies and r.doc_id))
    again = queries.op7_source_mix(spark, tmpdir_fresh).where(F.col("doc_id") == lose[0]).select("copies", "taken").collect()
    assert {tuple(r) for r in again} == {(0, 0)}  # what the mixed documents lack is not reported
