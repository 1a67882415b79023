import random

import pytest
import sentencepiece
from stratalog.llm import sentencepiece_trie as sp


@pytest.fixture(scope="module")
def pieces():
    return sp._load(sp.MODEL)


@pytest.fixture(scope="module")
def unigram():
    """The public library on the same file, its model type set to unigram."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(sp.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


TEXTS = ["", " ", "  two  spaces ", "Hello world", "naïve café\n\tx", "日本語 😀", "aaaaaaaaaaaa bbbb", "\x00\x7f", "x" * 3000, "don't stop-believing 12345 <s> </s> <0x41>"]


def score(pieces, ids):
    return sum(pieces.by_piece[pieces.by_id[k][0]][1] if pieces.by_id[k][1] == sp.NORMAL else 0 for k in ids)


def test_round_trip(pieces):
    for text, ids in zip(TEXTS, pieces.encode_batch(TEXTS), strict=True):
        assert pieces.decode(ids.tolist()) == text


def test_brute_force_viterbi(pieces):
    """Each word alone, without sharing, and every cut tried by recursion on short ones."""
    rng = random.Random(1)
    words = ["".join(rng.choice("thean▁") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    words = [sp.MARK + w.replace(sp.MARK, "") for w in words]

    def best(word):
        out = (0.0 if not word else float("-inf"))
        for k in range(1, len(word) + 1):
            hit = pieces.by_piece.get(word[:k])
            own = hit[1] if hit else pieces.fallback if k == 1 else None
            if own is not None:
                out = max(out, own + best(word[k:]))
        return out

    for word, ids in pieces.search(sorted(set(words))):
        if len(word) <= 8:
            assert abs(score(pieces, ids) - best(word)) < 1e-6


def test_library_agrees(pieces, unigram, table):
    """On words: the library adds in single precision, which the large negative scores of
    some pieces use up on whole texts."""
    words = sorted({w for r in table("documents").limit(60).collect() for w in r.text.split()})[:2000]
    for word, ids in zip(words, pieces.encode_batch(words), strict=True):
        assert abs(score(pieces, ids.tolist()) - score(pieces, unigram.encode(word))) < 1, word


def test_rows(docs):
    rows = [(1, None), (2, ""), (3, "a b"), (None, "a b"), (3, "a b"), (4, "word " * 50_000)]
    out = sp.encode(docs(rows))
    assert out.count() == 6 and out.where("not round_trip").count() == 0
    assert {r.doc_id: r.n_tokens for r in out.collect()}[1] == 0
    back = {r.doc_id: r.text for r in sp.decode(out).collect()}
    assert back[4] == "word " * 50_000 and back[1] == ""
    assert sp.encode(docs([])).count() == 0


def test_a_mark_in_the_text_is_told(docs):
    assert [r.round_trip for r in sp.encode(docs([(1, "a▁b")])).collect()] == [False]
