import zlib

import numpy as np
import pytest
from pyarrow import fs

from sonoframe.llm import token_store as ts
from sonoframe.llm.bpe import vocabulary
from sonoframe.llm.common import fresh_path

PATH = vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    data = ts.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (ts.unpack(data, 1001, bits) == ids).all()


def test_bits():
    assert [ts.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]


def test_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK", 64)
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 200, 50)
    docs = [rng.integers(0, 5000, n).astype(np.int32) for n in sizes]
    with open(tmp_path / "f", "wb") as out:
        w = ts.TokenWriter(out, 13)
        for i in range(0, 50, 7):
            w.add(np.arange(i, min(50, i + 7)), np.concatenate(docs[i : i + 7]), sizes[i : i + 7])
        assert w.close() == (50, int(sizes.sum()))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
        f = ts.TokenFile(source)
        for i in (49, 0, 17, 30):
            assert (f.document(i) == docs[i]).all()
        assert (f.ids(100, 300) == np.concatenate(docs)[100:400]).all()


def test_store(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    m = ts.write_tokens(odd, PATH, fresh_path(spark, "tokens"))
    got = sorted(ts.read_tokens(m, ts.crc32_of, "crc long").collect(), key=lambda r: (r.doc_id, r.start))
    assert len(got) == len(odd_rows)
    text, at = {r[0]: r[1] or "" for r in odd_rows}, 0
    for r in got:
        ids = [*t.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert ts.read_tokens(ts.write_tokens(empty, PATH, fresh_path(spark, "tokens")), ts.crc32_of, "crc long").count() == 0


def test_null_ids_come_first(spark):
    df = spark.createDataFrame([(3, "a"), (None, "b"), (-5, "c")], "doc_id long, text string")
    got = ts.read_tokens(ts.write_tokens(df, PATH, fresh_path(spark, "tokens")), ts.crc32_of, "crc long").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -5, 3]
