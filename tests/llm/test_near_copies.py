from itertools import combinations

import corpus_pipeline
from lattica.llm import near_copies, simhash

from .data import odd_documents
from .test_texts import SF


def brute_kept(rows):
    """The smallest id of each component of pairs whose five-word shingles have a Jaccard similarity of 0.8 or more."""

    def shingles(text):
        w = (text or "").lower().encode().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))


def test_near_copies_beyond_three_bits(spark):
    words = [f"w{k}" for k in range(200)]

    def changed(*at):
        return " ".join("other" + w if k in at else w for k, w in enumerate(words))

    # 196 shingles; n far changes replace 5 n of them: 4 leave 176 / 216 in common (0.81), 5 leave 171 / 221 (0.77)
    texts = [changed(), changed(20, 60, 100, 140), changed(20, 60, 100, 140, 180), changed(10, 40, 70, 100, 130)]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd_documents(spark, rows), SF).collect())
    assert got == [0, 3] == brute_kept([r[:2] for r in rows])


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [f"a{k}" for k in range(80)]
    hot = [(10_000 + k, " ".join(base[: k % 80] + [f"x{k}"] + base[k % 80 :]), "en", "a", 0) for k in range(120)]
    docs = docs.union(spark.createDataFrame(hot, docs.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_near_copies_of_odd_rows(spark):
    assert near_copies.keep_one(odd_documents(spark, [])).count() == 0
    kept = [r.doc_id for r in near_copies.keep_one(odd_documents(spark)).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, None, 5, 6, 7, 8, 9], key=str)


def test_near_copies_of_long_texts(spark):
    rows = [(k, " ".join(f"w{k // 2}x{j}" if j % (60 if k % 2 else 10**6) or not j else f"own{k}x{j}" for j in range(3000)), "en", "a") for k in range(6)]
    rows += [(10 + k, " ".join(f"v{j}" if j < 20 else f"v{k}x{j}" for j in range(2500)), "en", "a") for k in range(4)]
    got = sorted(r.doc_id for r in near_copies.keep_one(odd_documents(spark, rows)).collect())
    assert got == [0, 2, 4, 10, 11, 12, 13] == brute_kept([r[:2] for r in rows])


def test_shingles_that_stand_in_the_same_sets_are_joined_once(spark):
    posts = [(t, fp, i + fp) for i, t in enumerate((5, 3, 9)) for fp in (1, 2, 3)] + [(7, fp, 10) for fp in (1, 2)] + [(8, fp, 4) for fp in (1, 2)] + [(6, 4, 0)]
    df = spark.createDataFrame([(t, fp, i, "x") for t, fp, i in posts], "token long, fp long, i int, other string")
    got = near_copies._one_of_alike(df).collect()
    assert sorted({r.token for r in got}) == [5, 6, 8]
    assert sorted((r.token, r.fp, r.i) for r in got) == sorted(x for x in posts if x[0] in (5, 6, 8))


def test_simhash_says_what_is_compared_first(spark):
    rows = [(k, " ".join([f"w{k % 3}x{j}" for j in range(900)] + [f"y{k}x{j}" for j in range(k // 3)]), "en", "a") for k in range(24)]
    docs = odd_documents(spark, rows).select("doc_id", "text")
    sizes = near_copies.prefixes(docs, near_copies.common_counters(docs)).dropDuplicates(["fp"]).cache()
    sims = {r.fp: r.sim & (1 << 64) - 1 for r in sizes.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(sims[r.fp] == simhash.vote(near_copies.shingle_set(texts[r.doc_id])) for r in sizes.collect())
    pairs = {(r.a, r.b) for r in near_copies.by_simhash(sizes).collect()}
    near = {(a, b) for a, b in combinations(sorted(sims), 2) if (sims[a] ^ sims[b]).bit_count() <= 3}
    assert near and {x for p in near for x in p} == {x for p in pairs for x in p}

    def components(links):
        root = {x: x for p in near for x in p}
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
        return root

    assert components(pairs) == components(near)


def test_the_stage_links_by_simhash_before_the_prefix_filter(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "by_simhash", lambda sizes, real=near_copies.by_simhash: asked.append(real(sizes).cache()) or asked[0])
    words = [f"w{k}" for k in range(2000)]
    rows = [(k, " ".join([*words, "x" * k]), "en", "a") for k in range(3)]
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd_documents(spark, rows), SF).collect()] == [0]
    assert asked[0].count() == 2


def test_texts_of_the_rows_that_stay_are_dealt_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = simhash.fingerprints(docs)
    known = prints.select(prints.fp.alias("k"), prints.fp.alias("root")).distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.representatives(docs, prints, known, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Window" in plan and plan.count("Exchange hashpartitioning") == 2
