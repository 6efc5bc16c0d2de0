"""The pipeline's stages against brute force, and the classifiers on held-out rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_decontaminate import tiled, words
from test_jaccard import brute as components_of
from test_suffix import brute as left_of

import corpus_pipeline
from lagweave.llm import quality_crf, toxicity
from lagweave.llm.common import documents, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, the last but one as pandas."""
    out, docs = [], documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append(docs.toPandas())
    return out


def test_columns_and_rows(spark, stages):
    docs = documents(spark, SF).toPandas()
    assert all(list(x.columns) == COLUMNS for x in stages[:-1])
    sizes = [len(docs), *map(len, stages[:-1])]
    assert sizes == sorted(sizes, reverse=True)
    assert set(stages[-1].doc_id) == set(stages[-2].doc_id)
    assert len(corpus_pipeline.run(spark, SF).toPandas()) == len(stages[-1])


def test_quality_stage(spark, stages):
    docs = documents(spark, SF)
    scored = quality_crf.classify(docs, quality_crf.fit(docs, table(spark, SF, "labels"))).toPandas()
    assert set(stages[0].doc_id) == set(scored[scored.predicted == 1].doc_id)


def test_near_duplicate_stage(stages):
    rows = list(zip(stages[0].doc_id, stages[0].text, strict=True))
    assert set(stages[1].doc_id) == {d for d, _, c in components_of(rows, 5, 80) if c == d}


def test_repeated_passages_stage(stages):
    before = {d: r for d, *r in left_of(list(zip(stages[1].doc_id, stages[1].text, strict=True)), corpus_pipeline.PASSAGE_BYTES)}
    texts = dict(zip(stages[1].doc_id, stages[1].text, strict=True))
    after = dict(zip(stages[2].doc_id, stages[2].text, strict=True))
    for doc, (size, removed, *_) in before.items():
        if not removed:
            assert after[doc] == texts[doc]
        elif doc in after:
            assert 0 <= size - removed - len(after[doc].encode()) <= 6 * (removed > 0)
    assert set(after) <= set(before)
    assert (stages[2].n_chars == stages[2].text.str.len()).all()


def test_benchmark_stage(spark, stages):
    items = [words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for doc, text in zip(stages[2].doc_id, stages[2].text, strict=True):
        own = set(zip(*[words(text)[k:] for k in range(5)], strict=False))
        near = [x for x in items if sum(tuple(x[k:k + 5]) in own for k in range(len(x))) >= 0.3 * len(x)]
        held = any(sum(tiled(x, words(text), 5)) >= 0.8 * len(x) for x in near)
        assert held == (doc not in set(stages[3].doc_id))


def test_odd_rows_pass_every_stage(spark):
    docs = documents(spark, SF).limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some text", "en", "s", 9), (5_000, None, "en", None, 0), (5_001, "", None, "s", 0), (5_001, "", None, "s", 0),
                                 (5_002, "word " * 30_000, "en", "s", 1), (5_003, " \n \t", "en", "s", 4), (5_004, "other text of the same id", "en", "s", 1), (5_004, "text", "en", "s", 1)], docs.schema)
    both = docs.unionByName(odd).unionByName(docs.limit(3)).withColumns({"names": F.lit(1), "_k": F.lit("x"), "node": F.lit(2.0), "score": F.lit(1), "length": F.lit("y")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, both, SF)
        rows = got.toPandas()
        if name != "best-fit packing":
            assert got.columns == both.columns and len(rows) <= both.count()
            assert rows.doc_id.isna().sum() == 2 or name == "quality classifier"
        assert len(stage(spark, both.limit(0), SF).toPandas()) == 0
    kept = corpus_pipeline.near_duplicates(spark, both, SF).toPandas()
    assert not kept[kept.doc_id.notna()].doc_id.duplicated().any()


@pytest.mark.parametrize(("module", "label", "run"), [(quality_crf, "quality", "classify"), (toxicity, "toxic", "score_documents")])
def test_held_out_accuracy(spark, module, label, run):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    got = getattr(module, run)(docs, module.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    base = max(got[label].mean(), 1 - got[label].mean())
    accuracy = (got.predicted == got[label]).mean()
    assert accuracy > 0.97 and accuracy > base + 0.05
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize(("module", "label", "run"), [(quality_crf, "quality", "classify"), (toxicity, "toxic", "score_documents")])
def test_classifiers_on_odd_tables(spark, module, label, run):
    rows = [(None, "text", 1), (1, None, 1), (2, "", 2), (3, "a\n\nb c\n" * 3000, 3), (3, "a", 4), (4, " \n\t", 5), (5, "you stupid. not you! ### ***", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long").repartition(2)
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (2, 1, 0), (3, 7, 7)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = getattr(module, run)(docs, module.fit(docs, lab)).toPandas()
        assert len(got) == len(rows) and got.score.between(0, 1).all() and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert getattr(module, run)(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = quality_crf.Field(edge=rng.normal(size=4))
    counts = [3, 0, 1, 5]
    first = np.concatenate(([0], np.cumsum(counts)))
    emission = rng.normal(size=first[-1])
    got, pair = model.marginals(emission, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        weight, good, stay = 0.0, np.zeros(n), np.zeros((n, 2))
        for code in range(2 ** n if n else 0):
            y = [(code >> k) & 1 for k in range(n)]
            s = sum(emission[a + k] * y[k] for k in range(n)) + model.edge[3] * y[0] + sum(model.edge[1 + y[k]] for k in range(1, n) if y[k] == y[k - 1])
            w = np.exp(s)
            weight += w
            good += w * np.array(y)
            for k in range(1, n):
                if y[k] == y[k - 1]:
                    stay[k, y[k]] += w
        if n:
            assert np.allclose(got[a:b], good / weight) and np.allclose(pair[a:b], stay / weight)


def test_grammar_reads_clauses():
    def paths(text):
        import pyarrow as pa
        from lagweave.llm import textbytes as tb

        h = toxicity.word_hash(["zorg"])
        t = next(tb.slices(pa.array([text])))
        heads = toxicity._heads(np.frombuffer(b"zorg", np.uint8), np.array([0]), np.array([4]))
        found = toxicity.Grammar(stems={0: (h, np.array([2.0]))}, heads=heads).paths(t)[0]
        return {n: float(x) for n, x in zip(toxicity.PATHS[1:], found, strict=True) if x}

    assert paths("A ZORG, here") == {"insult": 2.0}
    assert paths("you are a zorg zorg") == {"aimed insult": 4.0}
    assert paths("you are not a zorg") == {"negated aimed insult": 2.0}
    assert paths("not one of the many zorg") == {"insult": 2.0}
    assert paths("they said zorg. zorg") == {"reported insult": 2.0, "insult": 2.0}
    assert paths("I kill you") == {"threat": 1.0} and paths("I kill it. you") == {} and paths("you: kill") == {}
    assert paths("zorgs and azorg") == {}
    random.seed(0)
    noise = " ".join(random.choice(["a", "not", "you", "said", "kill", "zorg", ".", "x!"]) for _ in range(3000))
    assert sum(paths(noise).values()) == pytest.approx(sum(sum(paths(c).values()) for c in __import__("re").split(r"[.!]", noise)))


def test_stages_hand_small_batches_to_python(spark):
    rows = 3000
    docs = spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))

    def sizes(spark, docs, sf_dir):
        def count(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.get_total_buffer_size()]})

        return docs.mapInArrow(count, "rows long, bytes long")

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    try:
        spark.conf.set(key, 64 << 20)
        found = corpus_pipeline.bounded(sizes)(spark, docs, SF).toPandas()
        assert found.rows.sum() == rows
        assert found.bytes.max() < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(key, "1m")
        corpus_pipeline.bounded(sizes)(spark, docs, SF)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, held)
    assert [s.__wrapped__.__name__ for _, s in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "packed"]
