"""Chunks: what is encoded, and ids of awkward texts against the libraries."""

import random

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import byte_bpe, chunks, token_files

ALPHABET = ["a", "The", "don't", "x's.", "'s,", "word,", "word.", "word", "wörd;", "ÀÈ!", "ªº×÷", "123", "12,", "a.b.", "a,,", "?!", ".", ",", "日本語", "日本.", "é", "é.", "҂", "I'LL,", "\x00", "\x00.", "", " ", "\n", "\n\n", "\nEnd.", "\n ", "\t", " ", " x", "<|endoftext|>", "<|endoftext|>.", "y" * 120, "😀:", "_a.", "a_.", "a-b;", "\r\nq"]


def awkward(n):
    rng = random.Random(5)
    return ["", " ", "\n", ".", "a.", " a.", *("".join(rng.choice(["", " ", " ", " ", "\n"]) + rng.choice(ALPHABET) for _ in range(rng.randrange(12))) for _ in range(n))]


def test_a_mark_behind_a_word_is_no_new_chunk():
    given = []

    def encode_many(texts):
        given.extend(texts)
        return [list(t.encode()) for t in texts]

    encoder = chunks.Encoder(encode_many)
    texts = ["Go word, word. word", "Go word; word\nword!"]
    want = [list(t.encode()) for t in texts]
    assert [np.frombuffer(b"".join(p), "<u2").tolist() for p in encoder.encode(texts)] == want
    assert sorted(x for x in given if x not in chunks.MARKS) == ["\nword", " word", "Go"]
    assert [np.frombuffer(b"".join(p), "<u2").tolist() for p in encoder.encode(texts)] == want and len(given) == 3 + len(chunks.MARKS)


@pytest.mark.parametrize("cache", [0, 5, chunks.CACHE])
def test_ids_of_awkward_texts(cache):
    from tokenizers import Tokenizer

    library = token_files.Library(token_files.byte_50k())
    library.encoder.size = cache
    t = Tokenizer.from_file(token_files.byte_50k())
    texts = awkward(3000)
    for low in range(0, len(texts), 700):
        part = texts[low : low + 700]
        data, at = chunks.gathered(*library.encoder.coded(pa.array(part)))
        got = [np.frombuffer(data[a:b], f"<u{library.width}").tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        want = [e.ids for e in t.encode_batch(part, add_special_tokens=False)]
        assert got == want


def test_merges_of_awkward_texts_and_their_bytes():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.multi_50k()
    with open(path, "rb") as f:
        bpe = byte_bpe.Bpe(f.read(), pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = awkward(1500)
    values, codes, bounds = bpe.encoder.coded(pa.array(texts))
    table = bpe.decode(values)
    data, at = chunks.gathered(values, codes, bounds)
    whole, ends = chunks.gathered([table[v] for v in values], codes, bounds)
    for i, t in enumerate(texts):
        assert np.frombuffer(data[at[i] : at[i + 1]], bpe.encoder.dtype).tolist() == library.encode_ordinary(t)
        assert bytes(whole[ends[i] : ends[i + 1]]) == t.encode()
    singles = list(bpe.stored.values())
    table = bpe.decode(singles)
    assert [table[r] for r in singles] == list(bpe.stored)


def test_slices_hold_every_text_once():
    column = pa.array(["ab", None, "", "c" * 9, "dé", None])
    assert [x for part in chunks.slices(column, 4) for x in part.to_pylist()] == ["ab", "", "", "c" * 9, "dé", ""]
    assert list(chunks.slices(column.slice(0, 0))) == []
