import zlib

import numpy as np
import pytest

import corpus_pipeline
from lattica.llm import quality_model, queries

from .data import odd_documents
from .test_corpus import brute_contamination, brute_mix
from .test_near_copies import brute_kept
from .test_texts import brute_quality

SF = "/root/testdata/sf0.001"


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(0)
    stats = rng.normal(size=(20, 5))
    words = [(rng.integers(0, 1 << quality_model.WORD_BITS, 6).astype(np.int32), rng.random(6).astype(np.float32)) for _ in range(20)]
    m = quality_model.Machine(stats)
    m.w = rng.normal(size=m.w.shape)
    ids, values, starts = m.rows(stats, words)
    z = m.forward(ids, values, starts)[0]
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
        i, x = ids[a:b], values[a:b]
        pairs = sum(m.v[i[p]] @ m.v[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert z[k] == pytest.approx(m.w0 + m.w[i] @ x + pairs)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_quality_model(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in rows]
    schema = "doc_id long, quality int, toxic int"
    one, two = (sorted(map(tuple, quality_model.classify(docs, spark.createDataFrame(x, schema)).collect())) for x in (rows, turned))
    assert one == two


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    schema = "doc_id long, quality int, toxic int, score double"
    labels = spark.createDataFrame([(1, 1, 0, 1.0), (5, 0, 0, 1.0), (5, 0, 0, 1.0), (7, None, 0, 1.0), (None, 1, 0, 1.0), (8, 0, 0, 1.0), (9, 1, 0, 1.0), (9, 0, 0, 1.0), (6, 1, 1, 0.0)], schema)
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_stages_against_brute_force(spark):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in out.collect()]
        got = stage(spark, out, SF)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        got = got.cache()
        ids = sorted(r.doc_id for r in got.collect())
        if name == "quality rules":
            expected = [x[0] for x in brute_quality(rows) if x[-1]]
        elif name == "SimHash near-dedup":
            expected = brute_kept([r[:2] for r in rows])
        elif name == "benchmark decontamination":
            expected = [x[0] for x in brute_contamination(rows, [tuple(r) for r in benchmark.select("item_id", "text").collect()]) if not x[-1]]
        else:
            from lattica.llm import mixing

            domains = {**{s: mixing.DEFAULT_DOMAIN for *_, s in rows}, **mixing.DOMAINS}
            expected = [x[0] for x in brute_mix(rows, mixing.WEIGHTS, domains, mixing.SHARE, mixing.MAX_EPOCHS, mixing.SEED)]
        assert ids == sorted(expected), name
        out = got
    files = corpus_pipeline.STAGES[4][1](spark, out, SF)
    assert sorted(r.doc_id for r in files.collect()) == ids


def test_pipeline_runs_from_the_tables(spark):
    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens and b.doc_id >= a.doc_id for a, b in zip(got, got[1:]))


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_quality_stage_removes_a_hot_hosts_boilerplate(spark):
    boiler = "Accept all our cookies and terms of use before you read on here now"
    own = lambda i, n: " ".join(f"own{i}word{k}" for k in range(n))
    rows = [(i, own(i, 60), "en", "hot") for i in range(300)]
    # in 26 of 326 texts, under a tenth; the last is mostly that line
    rows += [(1000 + i, boiler + "\n" + own(1000 + i, 60), "en", "hot") for i in range(25)] + [(2000, (boiler + "\n") * 3 + own(2000, 30), "en", "hot")]
    # copies of one text don't make its lines boilerplate
    rows += [(3000 + i, own(3000, 60), "en", "hot") for i in range(40)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert set(got) == {r[0] for r in rows} - {2000}
    assert not any(boiler in t for t in got.values()) and got[3000] == own(3000, 60)


def test_repeated_ids_do_not_displace_other_labels(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_model.Machine, "fit", lambda self, stats, words, y: seen.append(sorted(y.tolist())) or self)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    rows = [(ids[0], f"text {k}", 6) for k in range(200)] + [(i, f"own {i}", 5) for i in ids[1:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    labels = spark.createDataFrame([(i, int(i != ids[0])) for i in ids], "doc_id long, quality int")
    quality_model.fit(docs, labels, max_rows=6)
    assert seen == [[0.0] + [1.0] * 5]


def test_a_worker_drops_the_vocabulary_when_another_operator_comes(spark):
    from pyspark.sql.types import LongType, StructField, StructType

    from lattica.llm import token_count, vocabulary
    from lattica.llm.common import map_columns
    from lattica.llm.queries import vocabulary_path

    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    assert token_count.count_tokens(docs, vocabulary_path()).count() == 40

    def make():
        return lambda ids: {"held": [vocabulary.load.cache_info().currsize] * len(ids)}

    held = map_columns(docs.select("doc_id"), StructType([StructField("held", LongType())]), make)
    assert {r.held for r in held.collect()} == {0}
    again = token_count.count_tokens(docs, vocabulary_path())
    assert again.where("n_tokens >= 3").count() == 40
