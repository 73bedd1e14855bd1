import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from spindle.llm import op4_bpe as op
from spindle.llm.queries import bpe

from .edges import documents, empty


@pytest.fixture(scope="module")
def library():
    ranks = op.read_ranks(public_tokenizers.path(op.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_hand(library, rows):
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        yield doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, bpe(spark, small).collect())) == Counter(by_hand(library, rows))


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, library, extra):
    docs = documents(spark, extra=extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, op.digests(docs).collect())) == Counter(by_hand(library, rows))
    back = op.decoded(op.encoded(docs)).collect()
    assert Counter(map(tuple, back)) == Counter((d, t or "") for d, t in rows)
    assert op.digests(empty(spark)).collect() == []


def test_odd_texts(library):
    own, r = op.codec(), random.Random(7)
    pool = "aébßñ漢字🎉 \n\t'sﬁ́０٣½—.!?\x00\x1c　​ABC"
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(60)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids).decode() == text


def test_very_long_pre_token(library):
    text = "ab" * 50_000
    assert op.codec().encode(text) == library.encode_ordinary(text)


def test_memory_is_bounded(monkeypatch):
    own = op.Codec(op.read_ranks(public_tokenizers.path(op.RANKS)), public_tokenizers.PATTERN)
    monkeypatch.setattr(op, "MEMORY", 50)
    own.encode(" ".join(f"word{k}xyz" for k in range(500)))
    assert len(own.memory) <= 50


def test_the_model_is_a_plain_sentencepiece_model():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b" x": 258}
    model = sentencepiece.SentencePieceProcessor(model_proto=op.serialised_model(ranks))
    assert model.get_piece_size() == 260 and model.unk_id() == 259 and model.get_score(257) == -257
    assert model.id_to_piece(258) == "Ġx"
    own = op.Codec(ranks, public_tokenizers.PATTERN)
    assert own.encode("abc x") == [257, 258]
    with pytest.raises(ValueError, match="gaps"):
        op.serialised_model({b"a": 0, b"b": 2})
