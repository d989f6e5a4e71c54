import numpy as np

from loomscreen.llm import langid
from loomscreen.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op3_language"](spark, "/root/testdata/sf0.01")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b"], rng)
    x, y = rng.integers(0, 257, (5, 20)), np.array([0, 1, 1, 0, 1])
    loss = lambda: -np.log(net.predict(x)[np.arange(5), y]).mean()
    for w, g in zip((net.embedding, net.filters, net.dense), np.array(net.gradients(x, y), dtype=object)[[0, 1, 3]], strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[i], 1e-2
        w[i] = old + e
        up = loss()
        w[i] = old - e
        down = loss()
        w[i] = old
        assert abs((up - down) / (2 * e) - g[i]) < 0.1 * abs(g[i]) + 1e-3


def test_edges(spark):
    long = "der die das und " * 40_000
    rows = [(1, None, "de"), (2, "", "de"), (3, "12 !?", None), (4, long, "de"), (5, "the and of " * 30, "en"), (5, "the and of " * 30, "en"), (None, "the of and", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    net = langid.learn(df)
    got = sorted((r.key or 0, r.lang_pred) for r in langid.predict(df, net).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (5, "en")]
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.learn(df.limit(0)) is None and langid.predict(df.limit(0), net).collect() == []


def test_forward_pass_by_brute_force():
    """Convolutions, pooling, softmax and the means over windows, one number at a time."""
    net = langid.Network.new(["a", "b", "c"], np.random.default_rng(4))
    net.bias += np.linspace(-0.3, 0.3, len(net.bias)).astype(np.float32)
    text = "Straße, naïve café: 12 km. ".encode() * 31
    total, weights = np.zeros(3), 0
    for at in range(0, len(text), langid.WINDOW):
        piece = text[at : at + langid.WINDOW]
        window = list(piece) + [langid.PAD] * (langid.WINDOW - len(piece) + max(langid.WIDTHS) - 1)
        hidden = []
        for f, width in enumerate(np.repeat(langid.WIDTHS, langid.FILTERS)):
            best = -np.inf
            for i in range(langid.WINDOW):
                best = max(best, sum(float(net.embedding[window[i + j], e]) * float(net.filters[j * langid.EMBED + e, f]) for j in range(width) for e in range(langid.EMBED)))
            hidden.append(max(best + float(net.bias[f]), 0))
        z = [sum(h * float(net.dense[f, k]) for f, h in enumerate(hidden)) + float(net.dense_bias[k]) for k in range(3)]
        p = np.exp(np.array(z) - max(z))
        total, weights = total + p / p.sum() * len(piece), weights + len(piece)
    windows, owner, size = langid.windows_of([text])
    assert (owner == 0).all() and size.sum() == len(text)
    got = (net.predict(windows) * size[:, None]).sum(axis=0) / size.sum()
    np.testing.assert_allclose(got, total / weights, atol=1e-5)


def test_whole_texts_are_learned_from(spark, monkeypatch):
    rows = [(i, ("x" * 5000 if i % 2 else "y" * 5000) + f" end{i}", "ab"[i % 2]) for i in range(20)]
    seen = []
    monkeypatch.setattr(langid, "train", lambda samples: seen.extend(samples))
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(seen) == sorted((t.encode(), k) for _, t, k in rows)
