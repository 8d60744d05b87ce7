"""Ids of many texts at once against those of the library."""

import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import pieces
from tests.llm.test_operators import texts

ODD = ["日本 語", "!\x1c!", "<|endoftext|>", " <|endoftext|> ", "a  b", " a", "a ", "a \n b", "\n\na b", "a\n b", "a b\n", " ", "  ", "a　 b", "　a b", "﻿a b", "x\x85 y", "a \x1c b", "it's 'll ' s", "\x00 a", "a \x00"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("room", [1, 200, 4 << 20])
def test_many_texts_at_once(name, room):
    path = public_tokenizers.path(name)
    tok, p = Tokenizer.from_file(path), pieces.Pieces(path, room=100)
    rng = random.Random(1)
    data = texts() + ODD + [" ".join(rng.choices(ODD + ["word", "Word", "w0rd"], k=6)) for _ in range(200)]
    found = [f.tolist() for f in p.ids_of(pa.array(data, pa.string()), room)]
    assert found == [tok.encode(t or "", add_special_tokens=False).ids for t in data]
    assert list(p.ids_of(pa.array([], pa.string()), room)) == [] and [f.tolist() for f in p.ids_of(pa.array([None, ""], pa.string()))] == [[], []]


def test_a_bucket_that_forgets_counts_alike(spark):
    from lodestone.llm import tokencount

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, 0, tokencount._pack_texts([f" w{i % 5}", " word", "日本"])) for i in range(12)]
    asked = spark.createDataFrame(rows, "asker long, bucket int, pretokens binary")
    for remembered in (1, 1000):
        found = tokencount.piece_counts(asked, path, remembered).collect()
        for r in found:
            want = [len(tok.encode(t, add_special_tokens=False).ids) for t in (f" w{r['asker'] % 5}", " word", "日本")]
            assert tokencount._unpack(bytes(r["pieces"])).tolist() == want
        assert len(found) == 12
