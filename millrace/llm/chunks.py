"""Distinct-chunk tables: encode each distinct piece of text once per Python worker and join results back by position.

A tokenizer whose pieces can't cross some boundary (white space, a whitespace marker) gives the same ids
whether it sees a text whole or chunk by chunk.  The table keeps, for each distinct chunk, its payloads
(ids, decimal ids, decoded bytes) in flat arrays, found by a key that is the chunk itself where it has up to 15 bytes, else 120 bits
of a hash.  Entries and chunk lengths are bounded: a full table is emptied, a long chunk is encoded
and not kept.  Long texts are cut at white space before.  So memory doesn't grow with the corpus and nothing is left out.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np

from .shared import kept_by, ragged

_TAG = np.uint64(0xFF << 56)


def chunk_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell chunks apart: of up to 15 bytes the bytes themselves and their number, of longer ones 120 bits of XXH3."""
    lens = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(len(data) + 8, "<u8", padded.data, strides=(1,))
    bits = np.uint64(8) * np.minimum(lens, 8).astype(np.uint64)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = words[starts] & np.where(bits == 64, every, (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
    more = np.uint64(8) * np.clip(lens - 8, 0, 7).astype(np.uint64)
    high = words[np.minimum(starts + 8, len(data))] & ((np.uint64(1) << more) - np.uint64(1)) | np.minimum(lens, 15).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(lens > 15)
    if len(long):
        from xxhash import xxh3_128_digest

        view = memoryview(padded)
        found = np.frombuffer(b"".join([xxh3_128_digest(view[i:j]) for i, j in zip(starts[long].tolist(), ends[long].tolist())]), np.uint64).reshape(-1, 2)
        low[long], high[long] = found[:, 0], found[:, 1] | _TAG
    return low, high


def mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64 bits of a key, to sort and search by."""
    x = (high ^ (high >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + low
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class ChunkTable:
    """``encode``: list of distinct chunks -> for each dtype, the payloads of all of them, joined, and the length of each."""

    def __init__(self, encode: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], dtypes: tuple, max_entries: int = 600_000, max_chunk: int = 256):
        self.encode, self.dtypes, self.max_entries, self.max_chunk = encode, dtypes, max_entries, max_chunk
        self._empty()

    def _empty(self) -> None:
        self.hash, self.low, self.high = (np.zeros(0, np.uint64) for _ in range(3))
        self.at = np.zeros(0, np.int64)
        self.n = 0
        self.values = [np.zeros(1 << 20, d) for d in self.dtypes]
        self.used = [0] * len(self.dtypes)
        self.starts = [np.zeros(1 << 16, np.int64) for _ in self.dtypes]
        self.lens = [np.zeros(1 << 16, np.int64) for _ in self.dtypes]

    def _append(self, payloads: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        m = len(payloads[0][1])
        at = np.arange(self.n, self.n + m)
        for k, (flat, lens) in enumerate(payloads):
            used, total = self.used[k], len(flat)
            while used + total > len(self.values[k]):
                self.values[k] = np.concatenate([self.values[k], np.zeros_like(self.values[k])])
            while self.n + m > len(self.starts[k]):
                self.starts[k] = np.concatenate([self.starts[k], np.zeros_like(self.starts[k])])
                self.lens[k] = np.concatenate([self.lens[k], np.zeros_like(self.lens[k])])
            self.values[k][used : used + total] = flat
            self.starts[k][at] = used + np.cumsum(lens) - lens
            self.lens[k][at] = lens
            self.used[k] += total
        self.n += m
        return at

    def rows_of(self, buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's row of each chunk ``buf[starts[i]:ends[i]]``; valid until the next call."""
        if self.n > self.max_entries:
            self._empty()
        low, high = chunk_keys(np.frombuffer(buf, np.uint8), starts, ends)
        h = mixed(low, high)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if ((low != low[first][inverse]) | (high != high[first][inverse])).any():  # chunks that share the 64 bits: tell them apart by all
            key = np.stack([low, high], 1).view([("a", np.uint64), ("b", np.uint64)]).ravel()
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        h, low, high = h[first], low[first], high[first]
        row = np.full(len(first), -1, np.int64)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = (self.hash[at] == h) & (self.low[at] == low) & (self.high[at] == high)
            row[hit] = self.at[at[hit]]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            s, e = starts[first[miss]].tolist(), ends[first[miss]].tolist()
            row[miss] = self._append(self.encode([buf[i:j] for i, j in zip(s, e)]))
            keep = miss[(ends - starts)[first[miss]] <= self.max_chunk]
            keep = keep[np.argsort(h[keep], kind="stable")]
            at = np.searchsorted(self.hash, h[keep])
            self.hash, self.low, self.high, self.at = (np.insert(x, at, y[keep]) for x, y in ((self.hash, h), (self.low, low), (self.high, high), (self.at, row)))
        return row[inverse]

    def gather(self, rows: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Payload ``k`` of all rows, joined, and the length of each."""
        lens = self.lens[k][rows]
        return ragged(self.values[k], self.starts[k][rows], lens), lens


@functools.lru_cache(maxsize=2)
def _word_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _joined_ids(tok, words: list[str], group: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, joined, and the number of each; words go to the library many to a call, or alone where it sees other words."""
    flat, sizes = [], []
    groups = [words[i : i + group] for i in range(0, len(words), group)]
    for some, enc in zip(groups, tok.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
        of = np.array(enc.word_ids, np.int64)
        cut = np.flatnonzero(of[1:] != of[:-1]) + 1
        if len(cut) + 1 == len(some):
            flat.append(enc.ids)
            sizes.append(np.diff(cut, prepend=0, append=len(of)))
        else:
            alone = [x.ids for x in tok.encode_batch(some, add_special_tokens=False)]
            flat += alone
            sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
    return np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in flat)]), np.concatenate([np.zeros(0, np.int64), *sizes])


@functools.lru_cache(maxsize=2)
def word_table(path: str) -> ChunkTable:
    """For a lower-casing tokenizer that drops white space; payload: ids."""
    tok = _word_tokenizer(path)

    def encode(chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        words = b"\n".join(chunks).decode("utf-8").split("\n")
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        ids, n = _joined_ids(tok, [w for w, p in zip(words, plain) if p])
        if plain.all():
            return [(ids, n)]
        rest = [x.ids for x in tok.encode_batch([w for w, p in zip(words, plain) if not p], add_special_tokens=False)]
        values = np.concatenate([ids, *(np.array(x, np.uint32) for x in rest)])
        lens = np.zeros(len(words), np.int64)
        lens[plain], lens[~plain] = n, [len(x) for x in rest]
        starts = np.zeros(len(words), np.int64)
        starts[plain] = np.cumsum(n) - n
        starts[~plain] = len(ids) + np.cumsum(lens[~plain]) - lens[~plain]
        return [(ragged(values, starts, lens), lens)]

    return ChunkTable(encode, (np.uint32,))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
#: Marks before which a word can be cut: the tokenizer starts a new word there. Not those of contractions or special tokens.
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:*&%$#()")] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks: runs between white space, cut where a mark follows a letter of a-z or U+00C0 to U+00FF."""
    word = ~_SPACE[data]
    left = _LOWER[data[:-1]]
    if (data >= 0x80).any():
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        left = left | latin[:-1]
    begin = word.copy()
    begin[1:] &= ~word[:-1] | (left & _MARK[data[1:]])
    starts = np.flatnonzero(begin)
    last = word.copy()
    last[:-1] &= ~word[1:] | begin[1:]
    return starts, np.flatnonzero(last) + 1


#: Bytes of a text beyond which it is cut at single spaces and worked on part by part.
LONG = 2_000_000


def parts_of(text: bytes, most: int) -> list[bytes]:
    """The text cut at spaces between other bytes, which are left out, into parts of about ``most`` bytes; longer where no space is."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.find(b" ", at + most)
        while cut > 0 and cut + 1 < len(text) and (text[cut - 1] in b" \t\r\n" or text[cut + 1] in b" \t\r\n"):
            cut = text.find(b" ", cut + 1)
        if cut < 0 or cut + 1 >= len(text):
            break
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]]


def encode_words(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, joined, and the number of ids of each: what the library gives for each whole text without special tokens."""
    if max(map(len, texts), default=0) > LONG:
        done = [[_encode_words([p], path) for p in parts_of(t, LONG // 2)] for t in texts]
        return np.concatenate([ids for d in done for ids, _ in d]), np.array([sum(int(n[0]) for _, n in d) for d in done], np.int64)
    return _encode_words(texts, path)


def _encode_words(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    table = word_table(path)
    buf = b"\n".join(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    if not buf:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    begins = np.cumsum(lens + 1) - lens - 1
    raw, data = np.frombuffer(buf, np.uint8), np.frombuffer(buf.lower(), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    # the library composes letters and finds added tokens before it lower-cases: only other chunks are filed in lower case
    odd = np.concatenate([[0], np.cumsum((raw >= 0x80) | (raw == 60))])
    odd = odd[ends] > odd[starts]
    if odd.any():
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[odd]] += 1
        step[ends[odd]] -= 1
        data = np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, raw, data)
    buf = data.tobytes()
    ids, n = table.gather(table.rows_of(buf, starts, ends))
    total = np.concatenate([[0], np.cumsum(n)])
    at = np.searchsorted(starts, np.append(begins, len(buf) + 1))
    return ids, total[at[1:]] - total[at[:-1]]


@functools.lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


MARK = "▁"


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> ChunkTable:
    """For a piece model: payloads are ids, decimal ids with a comma after each, and the decoded bytes."""
    sp = piece_model(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
        raise ValueError("the model has pieces that cross white space: chunks can't be encoded alone")
    surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    decimal = [b"%d," % i for i in range(len(pieces))]
    space = sp.piece_to_id(MARK)
    tables = []
    for of_ids in (decimal, surface):
        sizes = np.fromiter(map(len, of_ids), np.int64, len(of_ids))
        tables.append((np.frombuffer(b"".join(of_ids), np.uint8), np.cumsum(sizes) - sizes, sizes))

    def encode(chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        # a chunk begins with a space, which is the prefix that the library adds by itself, or with a line end, before which the prefix is a piece of its own
        lists = sp.encode([c[c[0] == 32 :].decode("utf-8") for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if c[0] != 32:
                if lists[i][:1] != [space]:
                    raise ValueError("the model joins its prefix with a line end")
                del lists[i][0]
            elif not lists[i]:  # a space alone: the library drops its prefix from an empty text
                lists[i] = [space]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for x in lists for i in x), np.int64, int(lens.sum()))
        of = np.repeat(np.arange(len(lists)), lens)
        out = [(ids, lens)]
        for values, starts, sizes in tables:
            out.append((ragged(values, starts[ids], sizes[ids]), np.bincount(of, sizes[ids], len(lists)).astype(np.int64)))
        return out

    return ChunkTable(encode, (np.uint32, np.uint8, np.uint8), max_entries=500_000)


def encode_pieces(texts: list[bytes], path: str) -> list[tuple[int, bytes, bytes]]:
    """For each text: number of ids, decimal ids joined by commas, and the decoded text."""
    if max(map(len, texts), default=0) > LONG:
        done = [[_encode_pieces([p], path)[0] for p in parts_of(t, LONG // 2)] for t in texts]
        return [(sum(n for n, _, _ in d), b",".join(i for _, i, _ in d), b" ".join(o for _, _, o in d)) for d in done]
    return _encode_pieces(texts, path)


def _encode_pieces(texts: list[bytes], path: str) -> list[tuple[int, bytes, bytes]]:
    table = piece_table(path)
    texts = [t.replace(MARK.encode(), b" ") for t in texts]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buf = b" " + b" ".join(texts)
    begins = np.cumsum(lens) - lens
    data = np.frombuffer(buf, np.uint8)
    begin = data == 32
    begin[1:] &= data[:-1] != 32
    begin |= data == 10
    begin[begins] = True
    starts = np.flatnonzero(begin)
    rows = table.rows_of(buf, starts, np.append(starts[1:], len(buf)))
    at = np.searchsorted(starts, np.append(begins, len(buf)))
    n = np.concatenate([[0], np.cumsum(table.lens[0][rows])])[at]
    parts = []
    for k in (1, 2):
        joined, size = table.gather(rows, k)
        parts.append((joined.tobytes(), np.concatenate([[0], np.cumsum(size)])[at].tolist()))
    (ids, i), (out, o) = parts
    return [(int(n[j + 1] - n[j]), ids[i[j] : i[j + 1] - 1], out[o[j] + 1 : o[j + 1]]) if t else (0, b"", b"") for j, t in enumerate(texts)]


def _forget_words() -> None:
    word_table.cache_clear()
    _word_tokenizer.cache_clear()


def _forget_pieces() -> None:
    piece_table.cache_clear()
    piece_model.cache_clear()


kept_by("words", _forget_words)
kept_by("pieces", _forget_pieces)
