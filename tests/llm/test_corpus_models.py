"""The vector search, the recurrent network and the pipeline."""

import tracemalloc
import types

import numpy as np
import pyarrow as pa

import corpus_pipeline
from traitspark.llm import perplexity, queries, toxicity, vector_graph
from traitspark.session import materialise


def test_search_finds_most_neighbours_with_exact_distances(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = queries.QUERIES["op1_vector_graph"](spark, sf_dir).collect()
    right = total = 0
    for q in ids[ids % 100 == 0]:
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        far = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        right += len({r[1] for r in own} & set(ids[np.lexsort((ids, far))[:10]]))
        total += 10
        assert all(r[2] == far[ids == r[1]][0] for r in own)
    assert right / total >= 0.9


def test_search_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]),
        (None, [1.0, 1.0]), (6, [5.0, 5.0, 5.0]), (7, [4.0, 6.0]), (200, [9.0, 9.0, 9.0]), (300, [inf, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as size", "2 as vector", "3 as shard")
    got = sorted(tuple(r) for r in vector_graph.nearest(frame, frame.where("vec_id % 100 = 0")).collect())
    assert got == [
        (0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 7, 5.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 7, 5.0), (200, 1, 6, 48**0.5),
    ]
    assert vector_graph.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 1.0]) for i in range(600)] + [(1000 + i, [float(i), 2.0]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vector_graph.nearest(frame, frame.where("vec_id = 3"), shard_rows=100).collect())
    assert got == [(3, k + 1, v, 0.0) for k, v in enumerate([0, 1, 2, 4, 5, 6, 7, 8, 9, 10])]


def test_gradients():
    texts = pa.array(["ab cd ef gh " * 9, "x yy zz", "one two three"])
    words = next(toxicity.pieces(texts))[2]
    inputs = toxicity.Inputs(words, np.sort(np.unique(words.hashes(lower=True))[:5]))
    first, row = toxicity.windows(words.count)
    place = toxicity.window_words(first, row, words.count)
    index = np.where(place >= 0, inputs.index[place], len(inputs.key))
    weights = {k: v.astype(float) for k, v in toxicity.start_weights().items()}
    y = np.arange(len(index)) % 2.0
    share = np.full(len(index), 1 / len(index))

    def loss():
        x = np.concatenate([toxicity.word_inputs(weights, inputs.bucket, inputs.count, inputs.word), np.zeros((1, toxicity.CHAR + toxicity.WORD))])
        odds = toxicity.forward(weights, x, index)
        return float((share * (np.logaddexp(0, odds) - y * odds)).sum())

    found = toxicity.gradients(weights, inputs.bucket, inputs.count, inputs.word, index, y, share)
    for name, value in weights.items():
        flat, own = value.reshape(-1), found[name].reshape(-1)
        i = int(np.abs(own).argmax())
        at = flat[i]
        flat[i] = at + 1e-2
        up = loss()
        flat[i] = at - 1e-2
        down = loss()
        flat[i] = at
        assert abs((up - down) / 2e-2 - own[i]) < 1e-3 + 0.02 * abs(own[i]), name


def test_toxicity_of_held_out_documents(spark, sf_dir):
    large = sf_dir.replace("sf0.001", "sf0.1")  # the smallest table has two toxic documents to test on
    labels = spark.read.parquet(f"{large}/labels.parquet")
    got = queries.QUERIES["op2_toxicity"](spark, large)
    assert got.count() == spark.read.parquet(f"{large}/documents.parquet").count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    wrong = [r.predicted for r in rows if r.toxic == 0]
    # few texts to learn from in languages other than English
    assert sum(caught) / len(caught) > 0.75 and sum(wrong) / len(wrong) < 0.05


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "idiot you"), (2, "kind you"), (3, None), (4, ""), (None, "x"), (5, "w " * 5000), (5, "w " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as label", "3 as toxic")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.classify(frame, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (3, 4))
    assert toxicity.classify(frame.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.classify(frame, labels.limit(0)).collect()} == {0.0}


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, sf_dir))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert counts[1] < counts[0] and counts == sorted(counts, reverse=True) and counts[-1] > 0.4 * counts[0]
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_pipeline_stages_of_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_copies_go_by_id_and_text(spark, sf_dir):
    copy, own, other, near = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    rows = [(5, copy), (9, copy), (9, own), (5, other), (5, other), (7, near), (7, near + " x"), (8, ""), (8, None), (None, copy)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, frame, sf_dir).collect()]
    assert sum(r[0] == 7 for r in got) == 1
    assert sorted((r for r in got if r[0] != 7), key=str) == sorted([(5, copy), (9, own), (5, other), (8, ""), (8, None), (None, copy)], key=str)


def test_few_texts_at_once_when_scoring():
    """A batch of many texts is scored in groups, and no more rows than these become strings."""
    texts = pa.array([f"{i} " * 200 for i in range(3000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["en"] * 3000), pa.array(range(3000)), texts], list("abcd"))
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    shared = types.SimpleNamespace(value=([none] * perplexity.ORDER, [none] * perplexity.ORDER))
    tracemalloc.start()
    rows = sum(b.num_rows for b in perplexity._score_rows(shared, 0.5, 1, 0)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 64 << 20
    assert [t for _, group in perplexity._groups(texts, 5000, 7) for t in group] == texts.to_pylist()
