import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomscreen.llm import tokenfile
from loomscreen.llm.queries import QUERIES

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    start, out = 0, {}
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.setdefault(doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    want = expected(library, docs)
    rows = QUERIES["op6_token_files"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert want[r.doc_id] == [(r.start, r.n_tokens, r.ids_crc32)]


def test_edges(spark, library):
    texts = [None, "", "É é x y ǅ", "<|endoftext|> It's 12", "word " * 9000, " \n\t", "ΑΣ Σ\x85a"]
    df = spark.createDataFrame([(10 - i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, file string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read_back(tokenfile.write(df, PATH, 1, sequence=16)).collect()}
    want = expected(library, sorted((10 - i, t) for i, t in enumerate(texts)))
    assert got == {k: v[0] for k, v in want.items()}
    assert tokenfile.read_back(tokenfile.write(df.limit(0), PATH, 1)).collect() == []
    same = spark.createDataFrame([(1, "a b")] * 3 + [(1, None), (0, "c")], "doc_id long, text string")
    rows = tokenfile.read_back(tokenfile.write(same, PATH, 1)).collect()
    assert sorted(r.start for r in rows) [0] == 0 and len({r.start for r in rows}) == 5


def test_sequences_are_views(tmp_path):
    w = tokenfile.Writer(f"file://{tmp_path}", np.dtype("<u2"), 8)
    ids = np.arange(8 * tokenfile.BATCH_ROWS * 2 + 5, dtype="<u2")
    w.add(ids[:100])
    w.add(ids[100:])
    w.close()
    r = tokenfile.Reader(w.path)
    seq, mask = r.row(2 * tokenfile.BATCH_ROWS)
    assert seq[:5].tolist() == ids[-5:].tolist() and mask.to_pylist() == [True] * 5 + [False] * 3
    assert not r.row(3)[0].flags.owndata and r.ids(8 * tokenfile.BATCH_ROWS - 2, 4).tolist() == ids[8 * tokenfile.BATCH_ROWS - 2 :][:4].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \u00a0\x85\x1c'sTéÉÜ\u0301<|endoftext|>9,")), max_size=40))
def test_as_the_library(library, text):
    ids, counts = tokenfile.encoder(PATH).encode([None, text.encode(), b""])
    assert counts[0] == counts[2] == 0 and ids.tolist() == library.encode(text, add_special_tokens=False).ids
