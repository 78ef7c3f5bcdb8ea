"""Word chunks in capitals: ids are those of the library for each whole text."""

import numpy as np
import pytest

pytest.importorskip("millrace.llm.chunks")
from millrace.llm import chunks  # noqa: E402
from millrace.llm.chunks import _word_tokenizer, chunk_keys, encode_pieces, encode_words, piece_model  # noqa: E402
from millrace.llm.queries import PIECES, WORDS  # noqa: E402

TEXTS = [
    "<|ENDOFTEXT|>", "a <|ENDOFTEXT|> B", "<|endoftext|>", "X<|EndOfText|>Y.<|endoftext|>Z", "H̱x", "J̌", "T̈ W̊ Y̊", "AH̱.B H̱,T̈",
    "É É. ÀB!C ß SS", "ΑΣ ΟΔΟΣ", "İstanbul I", "PLAIN Words, DON'T I'LL", "K ÅX", "<A HREF=B>", "", " ",
]


def test_ids_are_those_of_the_whole_text():
    tok = _word_tokenizer(WORDS)
    want = [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for order in (range(len(TEXTS)), range(len(TEXTS) - 1, -1, -1)):
        ids, n = encode_words([TEXTS[i].encode() for i in order], WORDS)
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [want[i] for i in order]


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_that_polynomial_hashes_confuse_are_told_apart():
    word = thue_morse(2048)
    texts = [word, word.translate(str.maketrans("ab", "ba")), word[:1024], word[1024:]]
    tok, sp = _word_tokenizer(WORDS), piece_model(PIECES)
    for t in texts:
        ids, n = encode_words([x.encode() for x in texts], WORDS)
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [tok.encode(x, add_special_tokens=False).ids for x in texts]
        assert [(k, i) for k, i, _ in encode_pieces([x.encode() for x in texts], PIECES)] == [(len(x), ",".join(map(str, x)).encode()) for x in map(sp.encode, texts)]


def test_keys_differ_where_chunks_do():
    words = [b"a" * n + b"\0" * m for n in range(20) for m in range(20)]
    words = [w for w in words if w]
    ends = np.cumsum([len(w) for w in words])
    low, high = chunk_keys(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert len(set(zip(low.tolist(), high.tolist()))) == len(set(words))


def test_long_texts_in_parts(monkeypatch):
    texts = ["Some words  and\n lines , with odd \t\n  spaces " * 9, "x" * 300, "", " a b", "tail of spaces   " * 8, " " * 200, "▁ ▁▁x y " * 20, "DON'T <|endoftext|> stop " * 10]
    monkeypatch.setattr(chunks, "LONG", 40)
    tok, sp = _word_tokenizer(WORDS), piece_model(PIECES)
    ids, n = encode_words([t.encode() for t in texts], WORDS)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode_pieces([t.encode() for t in texts], PIECES) == [(len(i), ",".join(map(str, i)).encode(), sp.decode(i).encode()) for i in map(sp.encode, texts)]
