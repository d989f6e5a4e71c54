import itertools

import numpy as np

from loomscreen.llm import quality
from loomscreen.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op7_quality"](spark, "/root/testdata/sf0.1")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    bad = [r for r in rows if r.quality == 0]
    assert right > 0.97 and np.mean([r.predicted == 0 for r in bad]) > 0.9
    assert got.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()


def test_marginals_by_brute_force():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 4, 6])
    emit, trans, begin = rng.standard_normal((6, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2)
    got = np.exp(quality.marginals(emit, first, trans, begin)[0])
    for a, b in itertools.pairwise(first):
        total = np.zeros((b - a, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            s = begin[labels[0]] + sum(emit[a + i, k] for i, k in enumerate(labels)) + sum(trans[i, j] for i, j in itertools.pairwise(labels))
            for i, k in enumerate(labels):
                total[i, k] += np.exp(s)
        np.testing.assert_allclose(got[a:b], total / total.sum(axis=1, keepdims=True), rtol=1e-9)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "A good line.\n" * 30_000), (5, "| x | y" * 20), (5, "| x | y" * 20), (None, "plain words here")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1)], "doc_id long, quality int")
    for chain in (quality.learn(df, labels), quality.learn(df, labels.where("quality = 1")), quality.learn(df, labels.limit(0))):
        got = quality.score(df, chain).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(df.limit(0), chain).collect() == []


def test_label_earned_by_the_tail(spark):
    """Long texts are learned whole: here they differ after 30,000 characters and 60 lines only."""
    head = ("plain words stand here, as in any other line of the text. " * 9 + "\n") * 60
    tails = {0: "| x | y" * 20 + "\n", 1: "a good line ends the text.\n"}
    rows = [(k, head + tails[k % 2] * 30) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    chain = quality.learn(docs, labels)
    good, bad = chain.scores([tails[1].encode() * 30, tails[0].encode() * 30])
    assert good > 0.9 and bad < 0.1


def test_features_in_groups(monkeypatch):
    found = [b"one line", b"", b"two\nlines\n", b"| x | y\n" * 3, b"end"]
    want, _, first = quality.line_features(found)
    for size in (1, 12, 1 << 20):
        monkeypatch.setattr(quality, "TRAIN_BYTES", size)
        got, starts = quality._features(found)
        np.testing.assert_allclose(got, want)
        assert starts.tolist() == first.tolist()


def test_labels_change_within_a_text(spark):
    """Transitions are learned from mixed texts: lines of a text that changes midway get their own labels."""
    rng = np.random.default_rng(1)
    line = {1: lambda: " ".join("abcdefgh"[: int(rng.integers(2, 8))] for _ in range(9)) + ".", 0: lambda: "| 7 $ " * int(rng.integers(3, 9))}
    text = lambda k, n: "\n".join(line[k]() for _ in range(n)).encode()
    chain = quality.train([(text(k % 2, int(rng.integers(1, 30))), k % 2) for k in range(120)])
    # Staying is likelier than changing, but changing has a chance.
    stay, change = chain.trans[0, 0] + chain.trans[1, 1], chain.trans[0, 1] + chain.trans[1, 0]
    assert 0 < stay - change < 30
    mixed = text(1, 12) + b"\n" + text(0, 12)
    features, _, first = quality.line_features([mixed])
    good = np.exp(quality.marginals(chain.emit(features), first, chain.trans, chain.begin)[0][:, 1])
    assert (good[:12] > 0.8).all() and (good[12:] < 0.2).all()


def test_score_by_brute_force():
    """Whole scores by enumerating every labelling of a text's lines."""
    rng = np.random.default_rng(2)
    n = quality.line_features([b"x"])[0].shape[1]
    chain = quality.Chain(np.zeros(n), np.ones(n), rng.standard_normal((n, 2)) / 9, rng.standard_normal((2, 2)), rng.standard_normal(2))
    found = [b"A line.\n| x |\n\n12 3", b"", b"one\ntwo words", None]
    features, size, first = quality.line_features(found)
    emit = features @ chain.weights
    for got, a, b in zip(chain.scores(found), first[:-1], first[1:], strict=True):
        total, good = 0.0, np.zeros(b - a)
        for labels in itertools.product((0, 1), repeat=b - a):
            p = np.exp(chain.begin[labels[0]] + sum(emit[a + i, k] for i, k in enumerate(labels)) + sum(chain.trans[i, j] for i, j in itertools.pairwise(labels)))
            total += p
            good += p * np.array(labels)
        weight = np.maximum(size[a:b], 1)
        assert abs(got - (good / total * weight).sum() / weight.sum()) < 1e-9
