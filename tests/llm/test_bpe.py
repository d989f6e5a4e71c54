import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomscreen.llm import bpe
from loomscreen.llm.queries import QUERIES

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_as_the_library(tik, text):
    import numpy as np

    c = bpe.codec(PATH, P.PATTERN)
    ids = np.frombuffer(c.encode(text), dtype="<u4")
    assert ids.tolist() == tik.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


def test_query(spark, tik):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_edges(spark, tik):
    texts = [None, "", "  \n\t ", "a" * 5000, "x y " * 120_000, "日本語 🙂 é", None, ""]
    df = spark.createDataFrame([(i, t, "z", [1]) for i, t in enumerate(texts)], "doc_id long, text string, key string, ids array<int>")
    for out in (bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN), bpe.round_trip(df, PATH, P.PATTERN)):
        got = {r.key: r for r in out.collect()}
        for i, t in enumerate(texts):
            assert got[i].ids == tik.encode_ordinary(t or "")
            assert bytes(got[i].decoded).decode() == (t or "")
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).collect() == []
