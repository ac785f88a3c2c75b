"""Cases that smaller tests pass over: isolated pairs of vectors, letters of all scripts, very long texts, empty tables."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from linkledger.llm import byte_bpe, embedding_dedup, repeats
from linkledger.llm.units import LibraryStore


def isolated_pairs(n, seed=12):
    """n pairs of unit vectors of cosine 0.951 to 0.999; pairs are far from each other."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = np.linspace(0.951, 0.999, n)[:, None]
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y])


def test_isolated_vectors(spark):
    n = 1500
    v = isolated_pairs(n)
    near = np.triu(v @ v.T >= 0.95, 1)
    assert near.sum() == n and near[np.arange(n), np.arange(n) + n].all()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op10_embedding_dedup(df).collect()}
    linked = [i for i in range(n) if got[i] == (1, i, True) and got[i + n] == (1, i, False)]
    alone = [i for i in range(n) if got[i] == (0, i, True) and got[i + n] == (0, i + n, True)]
    assert len(linked) + len(alone) == n and len(linked) >= 0.998 * n, len(linked)


def test_signs_of_linked_vectors():
    v = isolated_pairs(1500)
    s = np.packbits(v @ embedding_dedup.caps(64).signs > 0, axis=1).view(np.uint64)
    differ = np.bitwise_count(s[:1500] ^ s[1500:]).sum(1)
    assert differ.max() <= embedding_dedup.most_bits(0.95)


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, kept string")
    assert embedding_dedup.op10_embedding_dedup(none).collect() == []


LETTERS = [chr(c) for c in range(0x80, 0x3000) if chr(c).isalpha() or chr(c).isnumeric()]
#: Letters whose lower-case or composed form has another length.
ODD = [chr(c) for c in (0x130, 0x131, *range(0x958, 0x960), 0x9DC, 0x9DD, 0x9DF, 0xA33, 0xA36, 0x1E9E, 0xDF, 0x149, 0x1F0, 0xFB01)]
MARKS = [chr(c) for c in (0x301, 0x307, 0x327, 0x93C, 0x94D, 0x9BC, 0xA3C, 0x200D, 0xFE0F)]


def random_text(rng):
    words = []
    for _ in range(rng.randint(1, 12)):
        kind = rng.choice(["abcdefgh'XYZ0-", LETTERS, [*ODD, "a", "I"]])
        word = "".join(rng.choice(kind) for _ in range(rng.randint(1, 6)))
        words.append(word + rng.choice(["", "", rng.choice(MARKS)]) + rng.choice(["", "", ".", ",", "!", "...", ".,"]))
    return rng.choice([" ", " ", "", "\n"]).join(words) + rng.choice(["", " ", "  x", "\n"])


@pytest.mark.parametrize(("name", "keep_space"), [("byte_bpe_50k", True), ("word_bpe_49k", False)])
def test_ids_over_all_scripts(name, keep_space):
    rng = random.Random(4)
    texts = ["DENİZLİ. DENİZLİ, क़. ড়, ਲ਼."] + [random_text(rng) for _ in range(9000)]
    path = P.path(f"{name}.json")
    flat, at = LibraryStore(path, keep_space).ids(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b, w in zip(texts, at[:-1], at[1:], want) if flat[a:b].tolist() != w.ids] == []


@pytest.mark.parametrize(("name", "keep_space"), [("byte_bpe_50k", True), ("word_bpe_49k", False)])
def test_ids_after_punctuation(name, keep_space):
    rng = random.Random(6)
    words = ["Word", "it's", "don'", "'s", "É", "x1", "", "<|endoftext", "<|endoftext|>", "\u0338", "=", "naïve", "Σ", "\0"]
    gaps = [" ", " ", " ", "\n", "\n\n", " \n", "\t", "\r\n", "\u00a0", "\u0085", "\x1c", "  "]
    tail = lambda: "".join(rng.choice("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for _ in range(rng.randint(0, 3)))
    texts = ["".join(rng.choice(words) + tail() + rng.choice(gaps) for _ in range(rng.randint(1, 9))) for _ in range(9000)]
    path = P.path(f"{name}.json")
    flat, at = LibraryStore(path, keep_space).ids(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b, w in zip(texts, at[:-1], at[1:], want) if flat[a:b].tolist() != w.ids] == []


def test_very_long_text():
    """52 MB in one document, between two short ones."""
    texts = ["first", " ".join(f"w{i * 7919 % 200_003} lorem ipsum" for i in range(2_700_000)), "last one"]
    store = byte_bpe.BpeStore(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    flat, at = store.ids(pa.array(texts))
    assert len(flat) > 20_000_000
    assert store.decode(flat, at) == [x.encode() for x in texts]


def test_windows_of_a_long_text():
    """Slices of a text hash their windows as short texts do, wherever these stand."""
    data = np.random.default_rng(1).integers(97, 101, 3 * repeats.SLICE, dtype=np.uint8)
    passage = data[10:500]
    data[2 * repeats.SLICE + 333 :][: len(passage)] = passage
    found = []
    for _, first, n, d in repeats.windows(data, 200, repeats.GRAM):
        own = data[first[0] : first[-1] + n[-1] + 199]
        h = repeats.span_hashes(own, first - first[0], n + 199) + (n * 1024 + d).astype(np.uint64)
        found += h.tolist()
        assert (repeats.span_hashes(data[first[3] :], np.zeros(1, int), n[3:4] + 199) == repeats.span_hashes(own, first[3:4] - first[0], n[3:4] + 199)).all()
    assert len(set(found)) < len(found)
