"""Null ids, repeated ids with other texts, long words and clashing column names, for operators and stages."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from linkledger.llm import byte_bpe, line_dedup, near_dedup, order_minhash, packing, repeats, sharding, token_files, toxicity
from linkledger.llm.queries import tokenizer_file

LINE = "a line that many documents have in common"
PASSAGE = " ".join(f"p{i} q{i * 7 % 31}" for i in range(60))
ROWS = [
    (1, f"one\n{LINE}\n{PASSAGE}"), (1, "another text of the same id"), (2, f"two\n{LINE}"), (3, f"three {PASSAGE}\n{LINE}"), (4, None), (5, ""),
    (None, f"no id\n{LINE}"), (None, "no id, other text"), (None, None), (2**60, "large id"), (2**60 + 1, "x" * 3000), (7, "<|endoftext|> end"),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = "row kept n_bytes n_removed n_spans n_lines n_dropped _score score th pos key h1 gone all hash component".split()
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", *[f"'{n}' AS `{n}`" for n in names]).cache()


def want(f):
    return Counter((d, *f(x or "")) for d, x in ROWS)


def test_ids_of_odd_rows(odd):
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    byte, word = (Tokenizer.from_file(P.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
    enc = lambda tok, end: lambda x: (lambda ids: (len(ids), crc(ids)))([*tok.encode(x, add_special_tokens=False).ids, end])
    got = token_files.op2_token_files(odd, tokenizer_file("byte_bpe_50k.json")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want(enc(byte, 0))
    got = packing.pack(odd, tokenizer_file("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == want(enc(word, 2))


def test_long_words():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    store = byte_bpe.BpeStore(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(3)
    for word in ("z" * 100_000, "".join(rng.choice(list("abcdefgh"), 20_000)), "ab" * 300, "".join(rng.choice(list("etaoin"), 399))):
        import pyarrow as pa

        ids, _ = store.ids(pa.array([word]))
        assert ids.tolist() == enc.encode_ordinary(word)


def test_rows_stay_whole(odd):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert Counter((r["doc_id"], r["size"]) for r in sharding.op4_sharding(odd).collect()) == want(lambda x: (len(x.encode()) + 1,))
    assert Counter((r["doc_id"], r["n_chars"]) for r in order_minhash.op1_order_minhash(odd).collect()) == want(lambda x: (len(x),))
    assert Counter((r["doc_id"], r["n_lines"]) for r in line_dedup.op6_line_dedup(odd).collect()) == want(lambda x: (x.count("\n") + 1,))
    assert Counter((r["doc_id"], r["n_bytes"]) for r in repeats.op9_suffix_dedup(odd).collect()) == want(lambda x: (len(x.encode()),))
    rows = near_dedup.op7_minhash_dedup(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in ROWS) and all(r["kept"] for r in rows if r["doc_id"] is None)
    ids = byte_bpe.op8_byte_bpe(odd, tokenizer_file("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in ids) == want(lambda x: (sha(x),))


def test_stages_keep_columns(odd, spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    rest = [c for c in odd.columns if c not in ("doc_id", "text")]
    for run in (lambda d: toxicity.drop_toxic(d, labels), line_dedup.drop_lines, near_dedup.keep_one, repeats.drop_repeats):
        out = run(odd)
        assert out.columns == odd.columns
        rows = out.collect()
        assert len(rows) >= len(ROWS) - 1 and all(r[c] == c for r in rows for c in rest)
