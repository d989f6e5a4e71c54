import math
import re
from collections import Counter

import numpy as np

from loomscreen.llm import toxicity
from loomscreen.llm.queries import QUERIES


def grams(text):
    """All features of a text, by hand."""
    w = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower()).split()
    return w, Counter([(x,) for x in w] + [(w[i], w[i + d], d) for d in toxicity.PAIRS for i in range(len(w) - d)])


FOUND = ["You are a fool, a FOOL!", "", None, "Grüße an die Straße; a b c d", "one", "a a a a", "x_y-z 12 34"]


def test_features_by_hand():
    encoded = [None if t is None else t.encode() for t in FOUND]
    at, owner, n_words = toxicity.features(encoded)
    name = {}
    for k, t in enumerate(FOUND):
        w, wanted = grams(t)
        assert n_words[k] == len(w)
        one = toxicity.features([encoded[k]])[0]
        assert sorted(Counter(one).values()) == sorted(wanted.values())
        assert sorted(one) == sorted(at[owner == k])
        name |= dict.fromkeys(one, k)
    # Equal features have equal coordinates wherever they stand.
    assert set(toxicity.features([b"a fool"])[0]) <= set(at[owner == 0])


def test_training_by_hand():
    """The vectorised learner equals one that keeps dictionaries and goes feature by feature."""
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(12)]
    samples = []
    for k in range(60):
        label = k % 2
        text = " ".join(rng.choice(words, 8)) + (" bad word" if label and k % 5 else "")
        samples.append((text.encode(), label))
    model = toxicity.train(samples, epochs=2, least=2)
    seen = Counter(at for t, _ in samples for at in set(toxicity.features([t])[0].tolist()))
    z, n = Counter(), Counter()

    def weight(k):
        if k == "bias":
            return -z[k] / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA)
        l1 = toxicity.L1 * math.sqrt(len(samples))
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(11)
    for _ in range(2):
        for i in order.permutation(len(samples)):
            text, label = samples[i]
            counts = Counter(toxicity.features([text])[0].tolist())
            x = {k: toxicity.SCALE * c / math.sqrt(len(text.split())) for k, c in counts.items() if seen[k] >= 2} | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (toxicity.TOXIC_WEIGHT if label else 1.0) * (p - label) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA
                z[k] += g - sigma * w[k]
                n[k] += g * g
    wanted = {k: weight(k) for k in seen if weight(k)}
    assert wanted and abs(model.bias - weight("bias")) < 1e-4
    assert model.at.tolist() == sorted(wanted)
    np.testing.assert_allclose(model.weight, [wanted[k] for k in sorted(wanted)], rtol=1e-4, atol=1e-5)
    for t in (b"w1 w2 bad word", b"", b"bad w3 w1"):
        counts = Counter(toxicity.features([t])[0].tolist())
        s = weight("bias") + sum(toxicity.SCALE * c * wanted.get(k, 0) for k, c in counts.items()) / math.sqrt(max(len(t.split()), 1))
        assert abs(model.scores([t])[0] - 1 / (1 + math.exp(-s))) < 1e-4


def test_held_out_accuracy(spark):
    """Insults that training saw are found, clean documents left alone; languages with a few dozen toxic texts are harder."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = QUERIES["op11_toxicity"](spark, sf)
    rows = got.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got.count() == docs.count()
    clean = np.mean([r.predicted == 0 for r in rows if r.toxic == 0])
    english = np.mean([r.predicted for r in rows if r.toxic == 1 and r.lang == "en"])
    assert clean > 0.98 and english > 0.88 and np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.65


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = toxicity.sample(docs, labels, per_label=30, most_bytes=20_000).collect()
    by = {k: [r for r in rows if r.label == k] for k in (0, 1)}
    assert all(sum(len((r.text or "").encode()) for r in v) <= 20_000 and len(v) <= 90 for v in by.values())
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all(whole[r.key] == r.text for r in rows)


def test_edges(spark):
    """Nulls, empty and wordless and very long texts, ties, repeated rows, clashing names, one label, no labels, no rows."""
    bad = "you utter fool "
    rows = [(1, None), (2, ""), (3, "... !!"), (4, "fine words " * 200_000), (5, bad * 3), (5, bad * 3), (None, "plain words"), *((k, bad + f"number {k}") for k in range(10, 30)), *((k, f"kind words number {k}") for k in range(30, 60))]
    df = spark.createDataFrame([(*r, 0.5, 1, "x") for r in rows], "doc_id long, text string, score double, label int, key string")
    labels = spark.createDataFrame([*((k, 1) for k in range(10, 30)), *((k, 0) for k in range(30, 60)), (1, 0), (2, None), (None, 1), (5, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = toxicity.score(df, model).collect()
    by = {r.key: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert by[1] == by[2] == by[3] and by[5] > 0.7 > by[4] and by[1] < 0.7
    assert len({r.score for r in got if r.key == 5}) == 1
    for few, prior in ((labels.where("toxic = 1"), 1.0), (labels.limit(0), 0.0)):
        assert {r.score for r in toxicity.score(df, toxicity.learn(df, few)).collect()} == {prior}
    assert toxicity.score(df.limit(0), model).collect() == []
    assert re.fullmatch(r"key bigint, score double", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in toxicity.score(df, model).schema))
