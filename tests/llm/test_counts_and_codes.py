"""Token counts and BPE against enumeration and against the library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from tabloom.llm import bpe, token_counts
from tabloom.llm.registered import PIECES, byte_vocabulary, op1_token_counts, op10_byte_bpe
from tests.conftest import SF
from tests.llm.conftest import NASTY_TEXTS


@pytest.fixture(scope="module")
def pieces():
    return token_counts.read_pieces(public_tokenizers.path(PIECES))


@pytest.fixture(scope="module")
def library():
    v = byte_vocabulary()
    return tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})


def every_cut(word, vocab):
    """Tokens of the best cut, by trying all."""
    best = None
    for mask in range(1 << (len(word) - 1)):
        at = [0] + [i for i in range(1, len(word)) if mask >> (i - 1) & 1] + [len(word)]
        score, n = 0.0, 0
        for a, b in zip(at, at[1:], strict=False):
            p = word[a:b]
            if p in vocab.scores:
                score, n = score + vocab.scores[p], n + 1
            elif b - a == 1:
                score, n = score + vocab.unknown, n + len(p.encode())
            else:
                break
        else:
            best = max(best or (score, -n), (score, -n))
    return -best[1]


def test_trie_gives_the_best_cut(pieces):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("▁theraion漢é.xq") for _ in range(rnd.randrange(1, 11))) for _ in range(300)]
    trie = token_counts.ForwardTrie(pieces)
    assert [trie.count(w) for w in words] == [every_cut(w, pieces) for w in words]
    assert [trie._sliding(w) for w in words] == [trie.count(w) for w in words]
    tiny = token_counts.ForwardTrie(pieces, max_nodes=15)
    assert [tiny.count(w) for w in words] == [trie.count(w) for w in words]


def test_pieces_that_cross_words_are_refused():
    with pytest.raises(ValueError):
        token_counts.vocabulary({"a▁b": -1.0})


def test_counts_of_texts(spark, nasty, empty, pieces):
    got = {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(nasty, pieces).collect()}
    trie = token_counts.ForwardTrie(pieces)
    assert got == {(r.doc_id, trie.tokens(r.text or "")[0]) for r in nasty.collect()}
    assert token_counts.token_counts(nasty, pieces).count() == nasty.count()
    assert token_counts.token_counts(empty, pieces).collect() == []
    assert trie.tokens("") == (0, 0) and trie.tokens("漢")[0] >= 1


def test_count_of_a_document_adds_up(spark, table, pieces):
    docs = {r.doc_id: r.text for r in table("documents").collect()}
    trie = token_counts.ForwardTrie(pieces)
    for r in op1_token_counts(spark, SF).collect():
        words = token_counts.PRE_TOKEN.findall("▁" + docs[r.doc_id].replace(" ", "▁"))
        assert "".join(words).replace("▁", " ") == " " + docs[r.doc_id]
        assert r.n_pretokens == len(words) and r.n_tokens == sum(trie.count(w) for w in words)


def expected(text, library):
    ids = library.encode_ordinary(text or "")
    raw = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_encoder_agrees_with_the_library(library):
    rnd = random.Random(3)
    alphabet = list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　​'strevdmlabz019٣漢é,.!|&") + ["'s", "'ll", "  ", " a"]
    coder = bpe.Encoder(byte_vocabulary())
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 40)))
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()
    for long in ("a" * 1000, "漢字" * 200, "xyz" * 2000):
        assert coder.encode(long) == library.encode_ordinary(long)


def test_whole_table_agrees_with_the_library(spark, table, library):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_byte_bpe(spark, SF).collect())
    assert got == sorted((r.doc_id, *expected(r.text, library)) for r in table("documents").collect())


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 40), (64, 16), (50, 50), (7, 3)])
def test_chunks_are_stitched(spark, library, chunk, overlap):
    rnd = random.Random(chunk)
    texts = ["".join(rnd.choice(["the", " ", "  ", "\n", "'re", "'", "12", "漢", "longerword", "!?", "é"]) for _ in range(300)) for _ in range(20)]
    texts += ["a" * 1000, " " * 500, "x " * 400, "word" * 100 + " end", *NASTY_TEXTS, NASTY_TEXTS[9]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, byte_vocabulary(), chunk=chunk, overlap=overlap).collect())
    assert got == [(i, *expected(t, library)) for i, t in enumerate(texts)]


def test_odd_rows(spark, nasty, empty, library):
    got = bpe.encode(nasty, byte_vocabulary(), chunk=1000, overlap=50)
    rows = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect())
    assert rows == sorted((str(r.doc_id), *expected(r.text, library)) for r in nasty.collect())
    assert bpe.encode(empty, byte_vocabulary()).collect() == []


def test_decoding_returns_the_text(spark, nasty):
    coded = bpe.encode(nasty.where("doc_id is not null").dropDuplicates(["doc_id"]), byte_vocabulary())
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(coded, byte_vocabulary()).collect()}
    assert back == {r.doc_id: r.text or "" for r in nasty.collect() if r.doc_id is not None}
