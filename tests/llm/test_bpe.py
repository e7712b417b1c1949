import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonoframe.llm import bpe

PATH = bpe.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts(library):
    rng = random.Random(1)
    letters = list(" \n\tab'sé1.<|endoftext|>") + ["  ", "<|endoftext|>", "\u00a0", "\u3000", "日", "🙂", "\x1c", "\x85", "'ll", "\r\n", "###"]
    texts = ["", " ", "\n", "a", "x" * 5000, "ab" * 3000] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    c = bpe.BytePairCoder(PATH)
    ids, n = c.encode(pa.array([None, *texts]))
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert not len(parts[0])
    for t, got, want in zip(texts, parts[1:], library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids
        assert c.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_word_table_starts_afresh(library):
    c = bpe.BytePairCoder(PATH)
    c.words.limit = c.pieces.limit = 5
    texts = [f"some words number {i} " + "x" * i for i in range(50)]
    for t in texts:
        assert c.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(c.pieces.at) < 20


def test_queries(odd, odd_rows, empty, library):
    got = {r.doc_id: r for r in bpe.round_trip(odd, PATH).collect()}
    for r in odd_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        g = got[r[0]]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(odd, PATH), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((r[0], r[1] or "") for r in odd_rows)
    assert bpe.round_trip(empty, PATH).count() == 0
