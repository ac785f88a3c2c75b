"""Order MinHash, the choice of shard and the pipeline's stages against plain versions of their own."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from linkledger.llm import order_minhash, sharding, toxicity
from linkledger.llm.common import free_name

from plain import brute_clauses, brute_components, brute_kept_lines, brute_repeats, shingles_of

ROWS = [(1, " ".join(f"w{i % 17} v{i}" for i in range(60))), (2, "one two"), (3, None), (4, "a b c d a b c"), (4, "other of the same id"), (5, ""), (None, "no id here at all"), (9, "one two")]


def xx(x, seed=42):
    """Spark's xxhash64 of a string, or of a number's bytes; of several values by the hash so far as the seed."""
    raw = x.encode() if isinstance(x, str) else x
    return xxhash.xxh64_intdigest(raw, seed)


def signed(x, bits=64):
    return x - (1 << bits) if x >> (bits - 1) else x


def long_(x):
    return (x & (1 << 64) - 1).to_bytes(8, "little")


def int_(x):
    return (x & (1 << 32) - 1).to_bytes(4, "little")


def murmur(values):
    """Spark's hash() of longs."""
    m, rot = (1 << 32) - 1, lambda v, r: (v << r | v >> (32 - r)) & (1 << 32) - 1
    h = 42
    for v in values:
        for k in ((v & m), (v >> 32) & m):
            k = rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        h ^= h >> 16
    return h


def brute_print(text, k=order_minhash.K, sketches=order_minhash.SKETCHES):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [words[i : i + k] for i in range(len(words) - k + 1)] if len(words) >= k else [words] if words else []
    seen, numbered = Counter(), []
    for gram in grams:
        h = 42
        for w in gram:
            h = xx(w, h)
        seen[h] += 1
        numbered.append(xx(int_(seen[h]), xx(long_(h))))
    low, out = (1 << order_minhash.PLACE_BITS) - 1, []
    for j in range(sketches):
        each = [signed(xx(int_(j), xx(long_(g))) & ~low & (1 << 64) - 1 | min(at, low)) for at, g in enumerate(numbered)]
        upper = [v for v in each if v >= 0]
        if not each:
            out.append(0)
        elif not upper:
            out.append(murmur([min(each) >> order_minhash.PLACE_BITS]))
        else:
            both = sorted((min(each), min(upper)), key=lambda v: v & low)
            out.append(murmur([v >> order_minhash.PLACE_BITS for v in both]))
    return out


@pytest.fixture(scope="module", params=["rows", "table"])
def docs(request, spark, sf_dir):
    if request.param == "rows":
        return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def test_order_minhash(docs):
    own = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    order = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, signed(xx(r[1]))))
    prints = [brute_print(x) for _, x in order]
    as_text = lambda p: "".join(f"{v:08x}" for v in p)
    alike = lambda p, q: sum(a == b for a, b in zip(p, q)) / len(p)
    want = []
    for i, (d, x) in enumerate(order):
        y = order[(i + 1) % len(order)][1]
        edited = brute_print(x[: len(x) - len(x) // 2] + y[: len(x) // 2])
        want.append((d, len(x), as_text(prints[i]), as_text(edited), alike(prints[i], edited), alike(prints[i], prints[(i + 1) % len(order)])))
    got = [tuple(r) for r in order_minhash.op1_order_minhash(docs).drop("edited_sha256").collect()]
    assert Counter(got) == Counter(want)


def test_shards(docs):
    def shard(key, shards):
        first = xx(int_(sharding.SEED))
        h = [xx(int_(s), first if key is None else xx(long_(key), first)) for s in range(shards)]
        return min(range(shards), key=lambda s: (-math.log(((h[s] >> 11) + 0.5) * 2.0**-53), s))

    rows = sharding.op4_sharding(docs).collect()
    assert rows and all((r["shard"], r["grown_shard"]) == (shard(r["doc_id"], 8), shard(r["doc_id"], 9)) for r in rows)


def test_pipeline(spark, sf_dir):
    """All five stages one after another, on the whole smallest table; the learned model is passed in."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == docs.count()

    def score(text):
        sums = Counter()
        for kind, w in brute_clauses(text, model.stems):
            sums[kind] += w
        z = model.weights[0] + sum(model.weights[1 + i] * math.log1p(sums[c]) for i, c in enumerate(toxicity.CLASSES))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    rows = {d: x for d, x in rows.items() if score(x) < 0.7}
    rows = brute_kept_lines(rows)
    sets = {d: shingles_of(x, 5) for d, x in rows.items()}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = brute_components(ids, pairs)
    rows = {d: x for d, x in rows.items() if least[d] == d}
    rows = {d: kept.decode("utf-8", "ignore") for d, (kept, _, _) in brute_repeats({d: x.encode() for d, x in rows.items()}).items()}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {d: [*tok.encode(x, add_special_tokens=False).ids, 2] for d, x in rows.items()}

    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == set(want)
    at = Counter()
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at[r["doc_id"]], len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
        at[r["doc_id"]] += r["length"]
    assert at == Counter({d: len(x) for d, x in want.items()})
    filled = Counter()
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 4096


def test_free_names(spark):
    df = spark.range(1).select(F.lit(1).alias("_x"), F.lit(2).alias("_X_0"))
    assert free_name(df, "x") == "_x_1"
