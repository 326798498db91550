"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns; brute force where there is no SQL."""

import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidecal.llm import embeddings, labelled, licenses, mixing, packing, pii, quality_model, quality_rules, queries, sharding, simhash, toxicity
from tidecal.llm.common import components, spread_join

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 2500
TEXTS = [None, "", "  \n\t ", "one two three", "one two three", LONG, "Mail a.b@c.org now, or +1 (743) 555-3824. MIT  License\nhere", "你好 мир é", "x" * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, fp long, bin long, label int"


def table(spark, texts=TEXTS, twice=True):
    rows = [(k, t, None, [None, "a", "b"][k % 3], len(t or ""), -1, 0.5, 9, 9, 9) for k, t in enumerate(texts)]
    rows.append((None, "no id here", "en", "a", 1, 0, None, None, None, None))
    return spark.createDataFrame(rows + (rows[3:5] if twice else []), SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def run_all(spark, docs):
    known = labels(spark, [(3, 1, 0), (3, None, None), (5, 0, 1), (99, 0, 0)])
    yield quality_rules.quality_rules(docs, known)
    yield packing.pack(docs)
    yield sharding.shard_documents(docs)
    yield licenses.find_licenses(docs)
    yield pii.find_pii(docs, pii.fit(docs))
    yield toxicity.toxicity(docs, known)
    yield simhash.near_duplicates(docs)
    yield quality_model.quality_scores(docs, known)
    yield mixing.mix(docs)


def test_edge_rows_and_empty_tables(spark):
    docs = table(spark)
    for out in run_all(spark, docs):
        assert out.count() == docs.count()
    for out in run_all(spark, docs.limit(0)):
        assert out.count() == 0


def test_values_of_null_empty_and_repeated_rows(spark):
    docs, known = table(spark), labels(spark)
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs, known).collect()}
    assert all((rules[k].n_words, rules[k].n_repeat_words, rules[k].base_failed, rules[k].kept, rules[k].rule) == (0, 0, True, False, None) for k in (0, 1, 2))
    assert (rules[5].n_words, rules[5].n_repeat_words, rules[5].base_failed) == (20_000, 20_000, True)
    packed = packing.pack(docs).collect()
    assert all((r.n_tokens, r.bucket) == (0, 0) for r in packed if r.doc_id in (0, 1, 2))
    same = [r for r in packed if r.doc_id in (3, 4)]
    assert len(same) == 4 and len({(r.n_tokens, r.bucket) for r in same}) == 1
    found = pii.find_pii(docs, None).collect()
    assert all(r.spans == "" and r.n_email == 0 for r in found if r.doc_id in (0, 1, 2)) and [r.spans for r in found if r.doc_id == 6] == ["email:5:14,phone:23:40"]
    scores = quality_model.quality_scores(docs, known).collect() + toxicity.toxicity(docs, known).collect()
    assert {(r.score, r.predicted) for r in scores} == {(1.0, 1), (0.0, 0)}
    mixed = mixing.mix(docs).collect()
    assert all(r.taken == 0 and r.size == 0 for r in mixed if r.doc_id in (0, 1, 2)) and len([r for r in mixed if r.doc_id == 3]) == 2
    near = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert near[0].fingerprint == near[1].fingerprint == "0" * 16 and near[1].component_id == near[2].component_id == 0 and near[4].component_id == 3


def test_pipeline_stages_keep_columns(spark, sf):
    now = table(spark, TEXTS * 3)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        following = stage(spark, now, sf)
        if k < 4:
            assert following.columns == now.columns
        following.count()
        now = following
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    order = list(want.columns)
    a, b = (x.sort_values(order, ignore_index=True) for x in (want, got))
    for c in order:
        there = a[c].notna()
        assert (there == b[c].notna()).all() and len(a) == len(b)
        assert (a[c][there] == b[c][there]).all() or np.allclose(a[c][there].astype(float), b[c][there].astype(float))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_statistics_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(table(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    text = {}
    for r in docs.collect():
        text.setdefault((r.doc_id, len(words(r.text))), r.text)
    for r in quality_rules.text_statistics(docs).collect():
        t = text[r.doc_id, r.n_words]
        w = words(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = {x: windows.count(x) for x in set(windows)} if len(windows) < 2000 else {x: 2 for x in set(windows)}
        covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
        if len(windows) < 2000:
            assert r.n_repeat_words == len(covered)
        assert r.word_chars == sum(map(len, w)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))


def test_rules_find_a_planted_threshold(spark):
    schema = "doc_id long, n_words long, n_distinct_words long, n_repeat_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_shouts long, bad boolean"
    symbols = [(k, 100, 60 if k % 4 else 90, 0, 500, 30 if k % 4 == 0 else 0, 0, 5, 0, k % 4 == 0) for k in range(400)]
    lines = [(k, 100, 60, 0, 500, 0, 4 if k % 4 == 0 else 1, 5, 0, k % 4 == 0) for k in range(400)]
    lengths = [(k, 30 if k % 4 == 0 else 90 + k, 20, 0, 500, 0, 0, 5, 0, k % 4 == 0) for k in range(400)]
    for rows in (symbols, lines, lengths):
        stats = spark.createDataFrame(rows, schema)
        found = quality_rules.decide(stats, quality_rules.learn(stats)).collect()
        assert all(r.kept == (not r.bad) for r in found)


def covering_by_rows(rows, names, cuts, most_rules, most_conditions, precision, least):
    """Sequential covering over plain rows: grow by information gain, keep the prefix of most worth on the prune half."""
    fits = lambda r, rule: all((r[n] > c) == above for n, above, c in rule)
    split = lambda these: (sum(r["bad"] for r in these), sum(not r["bad"] for r in these))
    rules = []
    while len(rules) < most_rules:
        grow, prune, rule = [r for r in rows if r["grow"]], [r for r in rows if not r["grow"]], []
        while len(rule) < most_conditions:
            inside = [r for r in grow if fits(r, rule)]
            p, n = split(inside)
            gains = []
            for name in names if p and n else ():
                for c in cuts[name]:
                    for above in (True, False):
                        q, m = split([r for r in inside if (r[name] > c) == above])
                        gains.append((q * (np.log2(q / (q + m)) - np.log2(p / (p + n))) if q else 0.0, (name, above, c)))
            best = max((g for g, _ in gains), default=0.0)
            if best <= 1e-9:
                break
            rule.append(next(x for g, x in gains if g >= best - 1e-12))
        worths = []
        for k in range(1, len(rule) + 1):
            p, n = split([r for r in prune if fits(r, rule[:k])])
            worths.append((p - n) / (p + n) if p + n else -1.0)
        rule = rule[: 1 + worths.index(max(worths))] if rule else rule
        p, n = split([r for r in prune if fits(r, rule)])
        if not rule or p + n == 0 or p / (p + n) < precision or p + split([r for r in grow if fits(r, rule)])[0] < least:
            break
        rules.append(rule)
        rows = [r for r in rows if not fits(r, rule)]
    return rules


def test_covering_equals_plain_rows(spark):
    schema = "doc_id long, n_words long, n_distinct_words long, n_repeat_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_shouts long, bad boolean"
    rng, long_lists = np.random.default_rng(5), 0
    for noise in (0.0, 0.1, 0.3):
        rows = []
        for k in range(600):
            symbols, shouts, repeats = (int(x) for x in rng.integers(0, 20, 3))
            bad = (symbols > 15) or (shouts > 12 and repeats < 8)
            rows.append((k, 100, int(rng.integers(40, 60)), repeats, 500, symbols, 0, 5, shouts, bool(bad != (rng.random() < noise))))
        stats = spark.createDataFrame(rows, schema)
        names = list(quality_rules.FEATURES)
        half = (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3)) > 0).alias("grow")
        plain = [r.asDict() for r in stats.select("bad", half, *[quality_rules.feature(n).alias(n) for n in names]).collect()]
        cuts = {}
        for n in names:
            each = [sorted(r[n] for r in plain if r["bad"] == b) for b in (True, False)]
            cuts[n] = sorted({round(float(v[int(np.ceil(q * len(v))) - 1]), 3) for v in each for q in quality_rules.QUANTILES})
        found = [list(r.conditions) for r in quality_rules.learn(stats, least_precision=0.6)]
        assert found == covering_by_rows(plain, names, cuts, 8, 4, 0.6, 5)
        long_lists += len(found) > 1 and max(map(len, found)) > 1
    assert long_lists


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        steps = sorted(rng.choice(50, 7, replace=False).tolist())
        rows = rng.integers(1, 9, 7).tolist()
        tokens = [s * r for s, r in zip(steps, rows)]

        def padding(bounds, steps=steps, rows=rows):
            return sum((min(b for b in bounds if b >= s) - s) * r for s, r in zip(steps, rows))

        best = min(padding([*c, steps[-1]]) for n in range(3) for c in itertools.combinations(steps[:-1], n))
        assert padding(packing.best_boundaries(steps, rows, tokens, 3)) == best


def test_packing_pads_no_more_than_any_choice(spark):
    rng = np.random.default_rng(6)
    lengths = [int(x) for x in rng.integers(1, 3000, 40)] + [0, 130, 131, 1257, 5000, 5001]
    docs = spark.createDataFrame([(k, "w " * n) for k, n in enumerate(lengths)], "doc_id long, text string")
    out = packing.pack(docs, buckets=3, budget=4000).collect()
    inside = sorted({n for n in lengths if n <= 4000})
    best = min(sum(min(b for b in (*c, inside[-1]) if b >= n) - n for n in lengths if n <= 4000) for c in itertools.combinations(inside[:-1], 2))
    assert sum(r.padding for r in out) == best
    longest = {}
    for r in out:
        longest[r.bucket] = max(longest.get(r.bucket, 0), r.n_tokens)
    assert all(r.bucket_len == (r.n_tokens if r.n_tokens > 4000 else longest[r.bucket]) for r in out)
    assert sorted(r.batch_rows for r in out if r.n_tokens > 4000) == [1, 1]


def test_boundaries_by_the_plain_program():
    rng = np.random.default_rng(2)
    steps = np.unique(rng.integers(0, 4000, 300)).tolist()
    rows = rng.integers(1, 50, len(steps)).tolist()
    tokens = [s * r for s, r in zip(steps, rows)]
    c, t = np.concatenate([[0], np.cumsum(rows)]), np.concatenate([[0], np.cumsum(tokens)])
    best = [steps[j] * c[j + 1] - t[j + 1] for j in range(len(steps))]
    for _ in range(1, 9):
        best = [min([best[j]] + [best[i] + steps[j] * (c[j + 1] - c[i + 1]) - (t[j + 1] - t[i + 1]) for i in range(j)]) for j in range(len(steps))]
    bounds = packing.best_boundaries(steps, rows, tokens, 9)
    assert sum((min(b for b in bounds if b >= s) - s) * r for s, r in zip(steps, rows)) == best[-1]


def test_batches_hold_the_budget(spark, sf):
    out = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), buckets=4, budget=3000)
    per = out.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.max("bucket_len").alias("b"), F.min("padding").alias("p")).collect()
    assert all(r.n * r.b <= 3000 or r.n == 1 for r in per) and min(r.p for r in per) >= 0


def test_few_rows_move_with_one_more_shard(spark):
    out = sharding.assign_shards(spark.range(20000).withColumnRenamed("id", "k"), "k", [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 1.0]).collect()
    assert all(r.shard == r.grown_shard or r.grown_shard == 3 for r in out)
    share = np.bincount([r.shard for r in out], minlength=3) / len(out)
    assert np.allclose(share, [0.25, 0.5, 0.25], atol=0.02)


def test_slots_are_gapless_for_even_ids(spark):
    docs = spark.createDataFrame([(64 * k, f"text {k % 7}") for k in range(3000)] + [(None, f"no id {k}") for k in range(500)], "doc_id long, text string")
    out = sharding.shard_documents(docs, shards=5).collect()
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    from tidecal.llm.common import scatter

    slices = [r.s for r in docs.where("doc_id is not null").select(scatter(F.col("doc_id"), 64).alias("s")).collect()]
    assert max(np.bincount(slices, minlength=64)) < 3 * len(slices) / 64
    assert len({r.shard for r in out if r.doc_id is None}) == 1


def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs).toPandas()
    assert (out.taken <= 2 * out["size"]).all()
    assert abs(out.taken.sum() - 1.5 * out["size"].sum()) < 0.1 * out["size"].sum()
    # Each source comes as near as its longest document: one more or less of it moves the total by that much.
    for _, rows in out.groupby(out.source.fillna("none")):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= max(rows["size"].max(), 0.02 * rows["source_size"].iloc[0])
    again = mixing.mix(docs).toPandas()
    assert (out.sort_values("doc_id").taken.to_numpy() == again.sort_values("doc_id").taken.to_numpy()).all()


def test_mix_of_equal_sizes_and_a_new_source(spark):
    rows = [(k, "one two three", "a") for k in range(900)] + [(k + 1000, "one two", "b") for k in range(50)]
    schema = "doc_id long, text string, source string"
    out = mixing.mix(spark.createDataFrame(rows, schema)).toPandas()
    for _, of_source in out.groupby("source"):
        assert abs(of_source.taken.sum() - of_source.target.iloc[0]) <= of_source["size"].max()
        assert of_source.copies.max() - of_source.copies.min() <= 1
    u = spark.createDataFrame([("a",), ("z",)], "source string").select("source", mixing.offset(F.col("source"), F.lit(False), 1).alias("u"), mixing.offset(F.col("source"), F.lit(False), 2).alias("v")).collect()
    assert len({x for r in u for x in r[1:]}) == 4 and all(0 <= x < 1 for r in u for x in r[1:])


def test_ties_of_the_mixing_order_share_what_is_taken(spark):
    """Rows equal in mixed id, id and size: the same numbers are taken whatever the order they come in."""
    rows = [(7, "one two three", "a", k) for k in range(30)] + [(None, "four five six", "a", k) for k in range(9)] + [(7 + 2**31, "seven eight nine", "a", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more int")
    a, b = (sorted(((r.doc_id or -1), r.size, r.taken, r.target) for r in mixing.mix(x).collect()) for x in (docs, docs.orderBy(F.desc("more")).repartition(5)))
    assert a == b and len(a) == 44 and abs(sum(x[2] for x in a) - a[0][3]) <= 3 and {x[2] for x in a} <= {0, 3, 6}


def test_emit_tells_repeated_rows_apart_and_keeps_columns(spark):
    rows = [(1, "a b c", "s", "x", 7, 1)] * 4 + [(None, "d e", None, "y", 8, 2)] * 3 + [(1, "other text of the id", "s", "z", 9, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, number long, row long")
    out = mixing.emit(docs)
    taken = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert out.columns == docs.columns and out.count() == taken
    assert {tuple(r) for r in out.collect()} <= set(rows)
    assert mixing.emit(docs.limit(0)).count() == 0


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(k, (base[k % 60] + rng.normal(0, 0.02, 16)).tolist(), k % 2) for k in range(240)]
    rows += [(500, [0.0] * 16, 1), (501, None, 1), (502, [float("nan")] * 16, 0), (503, rows[0][1], None), (504, rows[0][1], 0), (505, [1.0, 2.0], 0), (506, [None] * 16, 0)]
    rows += [(None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(7) for c in ("uid", "mark", "vector", "first", "copies", "component", "n")})
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows) and got[None].n_links == 0 and got.pop(None).component_id is None
    rows.pop()
    good = [(i, np.array(v), y) for i, v, y in rows if y is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w, z in good if j != i and z == y and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, v, y in good}
    assert all(got[i].n_links == len(links.get(i, ())) for i in got)
    for i in got:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert got[i].component_id == min(reach)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_passes_grow_slowly_with_the_vectors(spark):
    sizes = [embeddings.passes_for(n) for n in (0, 1, 1000, 10_000, 1_000_000, 1_000_000_000)]
    assert sizes == sorted(sizes) and sizes[:3] == [1, 1, 1] and sizes[3] > 1 and sizes[-1] < 200
    # Pairs at the cosine among so many others that one pass would miss many: they meet as often as stated.
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    rows = [(2 * k, a[k].tolist()) for k in range(4000)] + [(2 * k + 1, (0.931 * a[k] + (1 - 0.931**2) ** 0.5 * b[k]).tolist()) for k in range(4000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    met = embeddings.near_duplicates(df, window=32)
    found = met.where("vec_id % 2 = 1 and component_id = vec_id - 1 and n_links = 1").count()
    assert found >= (embeddings.RECALL - 0.01) * 4000


def test_hubs_and_uncentred_labels_keep_every_link(spark):
    rng = np.random.default_rng(12)

    def beside(v, cosine):
        w = rng.normal(size=v.shape)
        w -= (w * v).sum(-1, keepdims=True) * v
        return cosine * v + (1 - cosine**2) ** 0.5 * w / np.linalg.norm(w, axis=-1, keepdims=True)

    hub = np.eye(64)[0]
    even = rng.normal(size=(3000, 64))
    even /= np.linalg.norm(even, axis=1)[:, None]
    crowded = beside(np.tile(np.eye(64)[1], (2000, 1)), 0.84)
    labels = [np.concatenate([hub[None], beside(np.tile(hub, (300, 1)), 0.94), even]), np.concatenate([crowded, beside(crowded[:500], 0.935)])]
    rows = [(k * 10_000 + i, v.tolist(), k) for k, vectors in enumerate(labels) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, window=256, recall=0.9999).collect()}
    for k, vectors in enumerate(labels):
        near = vectors @ vectors.T / np.outer(*[np.linalg.norm(vectors, axis=1)] * 2) >= embeddings.COSINE
        np.fill_diagonal(near, False)
        least = np.arange(len(near))
        while True:
            lower = np.minimum(least, np.where(near, least[None, :], len(near)).min(1))
            if (lower == least).all():
                break
            least = lower
        assert [got[k * 10_000 + i].n_links for i in range(len(near))] == near.sum(1).tolist()
        assert [got[k * 10_000 + i].component_id - k * 10_000 for i in range(len(near))] == least.tolist()


def test_a_cone_is_compared_once_and_not_in_every_pass(spark):
    rows = [(u, k, "abc"[0] if k != 2 else "xy"[u % 2], 6 if k != 2 else 3) for k in range(4) for u in range(6)]
    members = spark.createDataFrame([(u, k, f"{k}{t}", n) for u, k, t, n in rows], "uid long, step int, team string, n long")
    assert {r.team for r in embeddings.fresh_runs(members).collect()} == {"0a"}
    # Halves first: the whole meets in the second pass, and everything later lies within it.
    halves = [(u, 0, f"0{u % 2}", 3) for u in range(6)] + [(u, 1, "1", 6) for u in range(6)] + [(u, 2, f"2{u % 3}", 3 if u % 3 == 0 else 2) for u in range(6)]
    members = spark.createDataFrame(halves + [(6, 2, "20", 3)], "uid long, step int, team string, n long")
    assert {r.team for r in embeddings.fresh_runs(members).collect()} == {"00", "01", "1"} | {"20"}
    rng = np.random.default_rng(2)
    near = np.ones(24) + rng.normal(0, 0.1, (150, 24))
    table = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(near)], "vec_id long, label int, embedding array<double>")
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table, window=16, recall=0.9999).collect()}
    assert [got[k] for k in range(150)] == want.tolist()


def test_least_hashed_equals_a_whole_sort(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(300).collect()]
    assert labelled.least_hashed(ids, "sample", 300, 5000) == want and labelled.least_hashed(ids.limit(9), "sample", 300, 9) != []


def test_fingerprints_and_components(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: int(r.fingerprint, 16) for i, r in got.items()}
    native = docs.select("doc_id", F.filter(F.split(F.lower(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "), lambda x: x != "").alias("w")).where("doc_id < 20")
    for r in native.collect():
        shingles = [" ".join(r.w[k : k + 4]) for k in range(max(1, len(r.w) - 3))]
        if all(s.isascii() for s in shingles):
            hashes = [x.h & (2**64 - 1) for x in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
            assert fp[r.doc_id] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    for i in fp:
        reach, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for j in fp:
                if j not in reach and (fp[x] ^ fp[j]).bit_count() <= 4:
                    reach.add(j)
                    todo.append(j)
        assert got[i].component_id == min(reach)


def test_pigeonhole_thresholds_lose_no_pair():
    rng = np.random.default_rng(2)
    both = np.full((64, 64), 250.0) + 250 * np.eye(64)
    for parts in (2, 3, 4, 5):
        groups = simhash.correlated_groups(1000, both, parts)
        for met in ([1e3] * parts, rng.integers(1, 10**9, parts).astype(float).tolist(), [1.0] + [1e12] * (parts - 1)):
            _, thresholds = simhash.allocate(1000, met, groups, 4)
            assert sum(t + 1 for t in thresholds) == 5
            for _ in range(100):
                flips = rng.choice(64, 4, replace=False)
                assert any(t >= 0 and sum(b in flips for b in bits) <= t for bits, t in zip(groups, thresholds))


@pytest.mark.parametrize("thresholds", [(0, 0, 0, 0, 0), (2, 0, 0), (1, -1, 2), (3, 0)])
def test_unequal_thresholds_and_large_cells_link_what_brute_force_links(spark, thresholds):
    rng = np.random.default_rng(sum(thresholds) + len(thresholds))
    near = {0}
    while len(near) < 150:  # one large cluster of fingerprints a few bits apart
        near.add(int(rng.choice(sorted(near))) ^ int(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False))))
    others = {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = sorted(simhash.signed(x) for x in near | others)
    groups = [g.tolist() for g in np.array_split(rng.permutation(64), len(thresholds))]
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(nodes, [(g, t) for g, t in zip(groups, thresholds) if t >= 0], small=8, block=64)
    assert edges.count() <= 10 * 8 * len(fps)
    found = {r.node: r.component for r in components(edges).collect()}
    root = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= 4 or ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
    assert {x: found.get(x, x) for x in fps} == root


def test_a_frequent_key_is_dealt_over_tasks(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"), "id")
    few = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = spread_join(rows, few, "k", 6000)
    assert out.columns == ["k", "id", "top"]
    assert {(r.k, r.id, r.top) for r in out.collect()} == {(1, i, 4999) if i < 5000 else (i, i, i) for i in range(6000)} and out.count() == 6000


def test_near_duplicate_stage_tells_texts_of_one_id_apart(spark, sf):
    long = " ".join(f"w{k}" for k in range(300))
    other = " ".join(f"v{k}" for k in range(300))
    rows = [(1, long), (1, other), (2, long), (3, long + " more"), (None, long), (None, other), (None, None), (None, ""), (4, "a b"), (4, "a b")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "kept") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 0), (r.text or "")) for r in out.collect()) == sorted([(1, long), (1, other), (0, ""), (4, "a b")])
    got = simhash.near_duplicates(docs).collect()
    assert len({r.component_id for r in got if r.doc_id == 1}) == 1 and {r.component_id for r in got if r.doc_id is None} == {1, None}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (2, 3, 4)} == {(2, 1), (3, 1), (4, 4)}


def test_components_of_a_long_chain(spark):
    got = components(spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{k: 0 for k in range(101)}, 200: 200, 201: 200}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long"), most_rounds=1)


def test_licenses():
    known = tuple(licenses.NOTICES.items())
    got = licenses.scan("See the MIT\n Licence and GNU Genral Public License; cc by. CC-BY", known)
    assert got[1] == 2 and got[4] == "cc-by" and got[5] == "cc-by,gpl,mit" and got[6] == 1.0
    spans = {m[0]: m for m in got[7]}
    assert spans["mit"][4] == 1 and spans["gpl"][4] == 1 and spans["mit"][1:3] == (8, 20)
    assert licenses.scan("nothing to see", known)[4:7] == ("", "", 0.0)
    assert licenses.scan("the mit licenses123", known)[5] == "" and licenses.scan("the mit licenses", known)[5] == "mit"
    # A short word tells one notice from another, so an edit in it is another word.
    assert licenses.scan("a kit license here, a mitt license there", known)[5] == ""
    assert licenses.scan("the gnu affero genral public license", known)[5] == "agpl"
    import regex

    rng = np.random.default_rng(0)
    for _ in range(100):
        s = list("apache license")
        for _ in range(int(rng.integers(0, 2))):
            s[int(rng.integers(0, len(s)))] = "x"
        s = licenses.normal("aa " + "".join(s) + " bb")
        assert bool(licenses.fuzzy_matches(s, known)) == bool(regex.search(r"(?b)(?<![^ ])(?:apache license){e<=1}(?![^ ])", s))
    for notice in ("gnu general public license", "creative commons attribution", "bsd 3 clause license"):
        k = licenses.edits_allowed(notice)
        for _ in range(60):
            s = list(notice)
            for _ in range(int(rng.integers(0, k + 2))):
                at, how = int(rng.integers(0, len(s))), int(rng.integers(0, 3))
                s[at : at + (how < 2)] = ["q"] if how else []
            s = licenses.normal("aa " + "".join(s) + " bb")
            m = regex.search(rf"(?b)(?<![^ ])(?:{notice}){{e<={k}}}(?![^ ])", s)
            want = bool(m) and licenses.tells(notice, m[0])
            assert any(known[n][0] == notice for n, *_ in licenses.fuzzy_matches(s, known)) == want
    # One very long word full of pieces, then a notice; many places of one phrase.
    assert licenses.fuzzy_matches("mit licens" * 50_000 + " mit licence", known)[-1][1:] == (500_001, 500_012, 1)
    got = licenses.scan("MIT License, " * 20_000, known)
    assert got[1:4] == (20_000, 0, 39_998) and got[7][-1][3] == 39_998


def test_pii():
    text = "a.b%c@d-e.org and 10.0.0.255 or 999.1.1.1, 4111 1111 1111 1111 and +1 (743) 555-3824 x@y"
    assert pii.written(pii.base_spans(text)) == "email:0:13,ip:18:28,card:43:62,phone:67:84"
    assert pii.redact_text(text, pii.base_spans(text)).startswith("[EMAIL] and [IP] or")
    rng = np.random.default_rng(4)
    for _ in range(300):
        s = "".join(rng.choice(list("ab.@-_+1 "), 30))
        assert [x for x in pii._email_spans(s)] == [m.span() for m in pii.EMAIL.finditer(s)]
    for _ in range(300):
        s = "".join(rng.choice(list("0123.a "), 40, p=[0.2, 0.15, 0.15, 0.1, 0.3, 0.05, 0.05]))
        assert [m.span() for m in pii._IP.finditer(s)] == [m.span() for m in pii.IP.finditer(s)]
    assert pii.base_spans("7" * 300_000 + " 1.2.3.4") == [(300_001, 1, 300_008)]
    windows = [(f"word word +1 ({200 + k}) 555-{1000 + k} more words", [(10, 3, 27)]) for k in range(60)] + [(f"version {k} of the text", []) for k in range(40)]
    model = pii.train(windows, epochs=12)
    found = pii.all_spans(["call +1 (999) 555-7777 today" + " filler" * 60 + " +1 (321) 555-1234"], model)[0]
    assert len(found[0]) == 2
    a = pii.Tagger.fresh(hidden=3, seed=1)
    ids, tags = rng.integers(0, pii.SYMBOLS, (2, 5)), rng.integers(0, pii.TAGS, (2, 5))
    loss, g = a.gradient(ids, tags)
    for key in a.p:
        k = tuple(0 for _ in a.p[key].shape) if key != "in" else (0, int(ids[0, 0]), 1)
        a.p[key][k] += 1e-5
        assert (a.gradient(ids, tags)[0] - loss) / 1e-5 == pytest.approx(g[key][k], abs=1e-3)
        a.p[key][k] -= 1e-5


def test_nothing_acceptable_lies_outside_the_tagged_parts():
    rng = np.random.default_rng(5)
    parts = ["jane", ".doe", "@", " @ ", "(at)", "[at]", "x" * 60, " ", "a b", "10", "255", ":", "-", "+1 (743) 555-3824", "mail.example.org", "\n", "é"]
    seen = 0
    for _ in range(15_000):
        text = "".join(rng.choice(parts, int(rng.integers(1, 12))))
        inside = pii.stretches(text)
        assert all(a < b for a, b in inside) and all(x[1] <= y[0] for x, y in itertools.pairwise(inside))
        a, b = sorted(rng.integers(0, len(text) + 1, 2).tolist())
        for kind in range(4):
            if a < b and b - a <= pii.MARGIN and pii.plausible(text, a, kind, b):
                seen += 1
                assert any(x <= a and b <= y for x, y in inside)
    assert seen > 20
    long = "x" * 70 + "(at)" + "mail." * 20 + "org"
    assert pii.stretches("so " + long + " and on") == [(3, 3 + len(long))]


@pytest.mark.parametrize("trained_on", ["sf0.01"])
def test_tagger_adds_spans_that_the_patterns_miss(spark, trained_on):
    """Fitted on a small corpus, recall of planted forms a kind and false spans, on documents that it didn't see."""
    model = pii.fit(spark.read.parquet(f"/root/testdata/{trained_on}/documents.parquet"))
    unseen = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 3")
    windows = [w for w in pii.labelled_windows(unseen, 6000, 800) if w[1]]
    rng = np.random.default_rng(99)
    texts, truth = [], []
    for k, (window, spans) in enumerate(windows):
        text, new = pii._rewritten(window, spans, k, rng, letters=k % 2 == 0)
        texts.append("nothing to see " * 3 + text + " and so on" * 5)
        truth.append([(a + 45, kind, b + 45) for a, kind, b in new])
    hit, total, false = [0] * 4, [0] * 4, 0
    for (base, found), spans in zip(pii.all_spans(texts, model), truth):
        assert set(base) <= set(found)
        false += len(set(found) - set(base) - set(spans))
        for span in spans:
            total[span[1]] += 1
            hit[span[1]] += span in found and span not in base
    assert min(total) >= 20 and all(h >= 0.8 * n for h, n in zip(hit, total)) and sum(hit) >= 0.9 * sum(total) and false <= 0.02 * len(texts), (hit, total, false)
    clean = [r.text for r in unseen.limit(300).collect() if r.text and not re.search("[0-9@]", r.text)]
    assert clean and all(not found for _, found in pii.all_spans(clean, model))
    # An address without digits, in a text without digits.
    text = "nothing of note here " * 5 + "please write to anna.berg(at)example.org about the matter" + " and nothing more" * 5
    start, end = text.index("anna"), text.index("anna") + len("anna.berg(at)example.org")
    assert pii.all_spans([text], model)[0] == ([], [(start, 0, end)])
    row = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row.text == text.replace("anna.berg(at)example.org", "[EMAIL]")


def test_spans_are_drawn_out_to_the_ends_of_long_tokens(monkeypatch):
    """Whatever part of a token the tagger marks, the whole token is judged: local part and host of 200 characters."""
    local, host = "jan." * 50 + "x", "mail." * 40 + "org"
    text = f"write to {local}(at){host}, {'1' * 90}, or +{'2' * 60} now"
    at = text.index("(at)")
    marked = [(at - 3, 0, at), (at, 0, at + 4), (at + 8, 0, at + 9), (text.index("11") + 50, 2, text.index("11") + 60), (text.index("22") + 20, 3, text.index("22") + 22)]

    def tag(model, parts):
        out = []
        for part in parts:
            path, low = np.zeros(len(part), dtype=int), text.index(part)
            for a, kind, b in marked:
                if low <= a and b <= low + len(part):
                    path[a - low : b - low] = 2 * kind + 2
                    path[a - low] = 2 * kind + 1
            out.append(path)
        return out

    monkeypatch.setattr(pii, "tag", tag)
    assert pii.all_spans([text], object()) == [([], [(9, 0, 9 + len(local) + 4 + len(host))])]
    for a, kind, b in marked:
        low, high = pii.drawn_out(text, a, kind, b)
        assert not (text[low - 1].isalnum() or text[high].isalnum()) or kind == 0
    assert pii.drawn_out(text, at - 3, 0, at) == (9, at) and pii.drawn_out(text, *marked[4]) == (text.index("+2"), text.index("+2") + 61)


def test_training_windows_hold_both_classes(spark):
    rows = [(k, f"write to user{k}@mail.org now") for k in range(60)] + [(100 + k, f"version {k} of the text") for k in range(60)]
    found = pii.labelled_windows(spark.createDataFrame(rows, "doc_id long, text string"), 200, 40)
    assert sum(bool(s) for _, s in found) == 20 and sum(not s for _, s in found) == 20


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for out, label, least in ((toxicity.toxicity(docs, known), "toxic", 0.85), (quality_model.quality_scores(docs, known), "quality", 0.95)):
        rows = out.join(known, "doc_id").where("held_out").collect()
        assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert labelled.training_sample(docs, known.limit(0), "toxic", 10, 10, 4, 2) == []


def test_sample_of_repeated_ids_and_conflicting_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (3, "p"), (5, "q"), (5, None), (None, "r")], "doc_id long, text string")
    known = labels(spark, [(1, 0, 1), (3, 0, 0), (3, 0, 1), (5, None, 0), (5, 1, None), (None, 1, 1), (3, None, None)])
    drawn = [labelled.training_sample(d, known, "toxic", 10, 10, 1000, 999) for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
    assert drawn[0] == drawn[1] and [x[1] for x in drawn[0]] == [1, 0] and drawn[0][1][0] == "q"


def test_long_labelled_texts_are_learned_from(spark):
    """Parts from all over a long text are in the sample, bounded in all, and what only long texts hold is learned."""
    filler = "a quiet walk by the river. " * 200
    rows = [(k, filler * 12 + ("what a fool you are. " if k % 2 else "what a day it is. ") * 4000 + filler) for k in range(60)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, [(k, 1, k % 2) for k in range(60)])
    sample = labelled.training_sample(docs, known, "toxic", 40, 2000, 4, 2)
    assert len(sample) == 40 and all(1500 < len(t) <= 2000 and ("fool" in t) == bool(y) for t, y, _ in sample)
    assert all(t.startswith("a quiet") and t.endswith("river. ") for t, _, _ in sample)
    model = toxicity.fit(docs, known, sample_rows=40, sample_chars=2000)
    assert any("fool" in f for f in model.weights) and model.score(rows[1][1])[0] > 0.5 > model.score(rows[0][1])[0]
    short = labelled.training_sample(docs.limit(0).unionAll(spark.createDataFrame([(1, "x y"), (2, "")], "doc_id long, text string")), known, "toxic", 120, 50, 1000, 999)
    assert sorted(x[0] for x in short) == ["", "x y"]


def test_scores_by_a_plain_loop_over_the_model(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 40_000), (-4, "An idiot. " * 3), (-4, "An idiot. " * 3), (None, "An idiot.")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    model = toxicity.fit(docs, known)
    got = toxicity.score(both, model).collect()
    text = {(r.doc_id, hash(r.text)): r.text for r in both.collect()}
    want = {}
    for (i, _), t in text.items():
        clean = 1 / (1 + np.exp(model.leak))
        for sentence in re.split(r"[.!?\n]", t or ""):
            found = re.findall(r"[^\W\d_]+", sentence.lower())
            if found:
                names = {f for w in found for f in (w, *(f"^{w[:n]}" for n in (4, 5) if len(w) > n))}
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in names))))
        want.setdefault(i, set()).add(round(1 - clean, 6))
    assert len(got) == both.count() and all(round(r.score, 6) in want[r.doc_id] for r in got)
    assert len({r.score for r in got}) > 300 and all(r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == -4}) == 1 and [r.score for r in got if r.doc_id == -1] == [r.score for r in got if r.doc_id == -2]

    quality = quality_model.fit(docs, known)
    p = quality.p
    for r in quality_model.score_rows(both, quality).where("doc_id < 40").collect():
        for t in {t for (i, _), t in text.items() if i == r.doc_id}:
            words, h = (t or "").split(), []
            for k in range(0, max(1, len(words)), 64):
                x = (quality_model.passages(" ".join(words[k : k + 64]))[0] - quality.mean) / quality.scale
                h.append(np.tanh(np.clip(x, -8, 8) @ p["w"] + p["b"]))
            a = np.array([(np.tanh(v @ p["v"]) / (1 + np.exp(-(v @ p["u"])))) @ p["a"] for v in h])
            a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
            z = sum(w * v for w, v in zip(a, h)) @ p["c"] + p["d"][0]
            assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_offending_sentences_are_located(spark):
    rng = np.random.default_rng(1)
    plain = ["the house is near", "we went to town", "rain fell all day", "birds sang there"]
    sample = []
    for k in range(300):
        sentences = [str(x) for x in rng.choice(plain, int(rng.integers(2, 9)))]
        if k % 3 == 0:
            sentences.insert(int(rng.integers(0, len(sentences))), "you are vile")
        sample.append((". ".join(sentences) + ".", int(k % 3 == 0), 1.0))
    model = toxicity.train(sample)
    for text, toxic, _ in sample:
        score, found = model.score(text)
        assert (score >= 0.3) == bool(toxic) and [text[a:b].strip() for a, b, _ in found] == ["you are vile"] * toxic
    assert model.score(". ".join(plain * 2000))[0] < 0.3
