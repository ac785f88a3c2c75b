"""Each operator against a brute-force version, on odd rows and on the smallest table."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from pyspark.sql import functions as F

from linkledger.llm import byte_bpe, embedding_dedup, line_dedup, near_dedup, order_minhash, packing, repeats, sharding, token_files, toxicity
from linkledger.llm.common import components
from linkledger.llm.queries import tokenizer_file

from plain import brute_clauses


@pytest.fixture(scope="session", params=["odd", "table"])
def docs(request, spark, sf_dir, odd_docs):
    return odd_docs if request.param == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def texts(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60), (51, 70)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 70: 50}


def test_order_minhash(docs):
    rows = sorted(order_minhash.op1_order_minhash(docs).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    t = texts(docs)
    assert len(rows) == len(t)
    prints = {}
    for i, (r, (d, x)) in enumerate(zip(rows, t)):
        n, y = len(x), t[(i + 1) % len(t)][1]
        edited = x[: n - n // 2] + y[: n // 2]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, n, sha(edited.encode()))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(x, r["fingerprint"]) == r["fingerprint"]
        if x == y:
            assert r["near_next"] == 1
        if x == edited:
            assert r["near_edited"] == 1


def test_order_matters(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(w)), (1, " ".join(w[200:] + w[:200])), (2, " ".join(w[:390] + ["x"] * 10)), (3, " ".join(f"v{i}" for i in range(400)))]
    out = {r["doc_id"]: r["fingerprint"] for r in order_minhash.op1_order_minhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    part = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    same = [sum(a == b for a, b in zip(part(out[0]), part(out[i]))) for i in (1, 2, 3)]
    assert same[1] > same[0] > same[2] == 0


def test_token_files(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(token_files.op2_token_files(docs, tokenizer_file("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    start = 0
    for r, (d, x) in zip(rows, texts(docs), strict=True):
        ids = [*tok.encode(x, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), crc(ids))
        start += len(ids)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 4000):
        a, b = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
        pilots, slot = token_files.build_slots(a, b)
        assert sorted(slot.tolist()) == list(range(n))
        assert (token_files.find_slots(pilots, n, a, b) == slot).all()


def test_unknown_keys(spark, odd_docs):
    from tokenizers import Tokenizer

    files = token_files.TokenFiles(odd_docs, tokenizer_file("byte_bpe_50k.json"))
    asked = spark.createDataFrame([(8, 0), (777, 0), (None, 0), (13, 1), (13, 2)], "key long, copy long")
    got = {(r["key"], r["copy"]): np.frombuffer(r["ids"], "<u4").tolist() for r in files.get(asked).collect()}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert got == {(8, 0): [*tok.encode("a b").ids, 0], (13, 1): [*tok.encode("x").ids, 0]}


def test_toxicity(spark, docs):
    labels = docs.select("doc_id", (docs["doc_id"] % 5 == 0).cast("int").alias("toxic"))
    rows = toxicity.op3_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_learns(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        w = [f"w{j}" for j in rng.integers(0, 300, 60)]
        w[rng.integers(9)] = "the"  # a target
        if i % 8 == 0:
            w[10] = f"grublix{'abcdefgh'[rng.integers(8)]}"
        rows.append((i, " ".join(w), int(i % 8 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.op3_toxicity(df, df.select("doc_id", "toxic")).where("held_out").join(df, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] for r in out) and len(out) > 100


def test_toxicity_counts_every_stem(spark):
    """More than 50,000 stems are in more toxic rows than the one that tells the rows apart."""
    common = " ".join(f"{i:05d}zzz" for i in range(14_000))
    rows = [(i, common + (" vixgrub" if i % 2 and i % 5 else ""), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert model.symbol("vixgrub")[0] == toxicity.INSULT and model.symbol("00001zzz")[0] == toxicity.OTHER


def test_grammar():
    m = toxicity.Model({"idiot$": 3.0})
    kinds = lambda t: [(k, round(w, 3)) for k, w in m.clauses(t)]
    assert kinds("idiot") == kinds("kill time. you go") == kinds("Idiot! you there") == kinds(None) == kinds("you there") == []
    assert kinds("you are an idiot") == kinds("an idiot, that one") == [(toxicity.AIMED, 3)]
    assert kinds("you idiot idiot") == [(toxicity.AIMED, 4.5)]
    assert kinds("you are not an idiot") == [(toxicity.NEGATED, 1.5)]
    assert kinds("not today but you there are an idiot") == [(toxicity.AIMED, 3)]
    assert kinds("they said he is an idiot") == [(toxicity.REPORTED, 1.5)]
    assert kinds("i will kill you") == [(toxicity.MENACE, 1)] and kinds("kill you idiot") == [(toxicity.MENACE, 5)]
    assert kinds("i will not kill you") == [(toxicity.NEGATED, 0.5)]
    assert kinds("he is an idiot. she is not an idiot\nsaid the idiot") == [(toxicity.AIMED, 3), (toxicity.NEGATED, 1.5), (toxicity.REPORTED, 1.5)]
    assert m.score(None) == m.score("nothing here") == m.score("idiot")


def test_toxicity_classes_count_after_training(spark):
    """The classes without examples keep a number, and each class moves the score of a trained model by its own."""
    rows = [(i, f"the w{i % 7} " + ("they are an idiot" if i % 3 == 0 else "are here"), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    score = {t: m.score(t) for t in ("idiot", "you are an idiot", "you are not an idiot", "he said you are an idiot", "we will kill you", "we will not kill you", "")}
    assert score["idiot"] == score[""] < score["you are not an idiot"] < score["he said you are an idiot"] < score["you are an idiot"]
    assert score[""] < score["we will not kill you"] < score["we will kill you"] and score["you are an idiot"] >= 0.7


def test_grammar_by_brute_force():
    rng = np.random.default_rng(8)
    m = toxicity.Model({"idiot$": 3.0, "grub": 2.0})
    words = ["idiot", "grubby", "kill", "you", "not", "said", "stone", "river", "."]
    for _ in range(4000):
        t = " ".join(rng.choice(words, rng.integers(1, 14)))
        assert [(k, round(w, 6)) for k, w in m.clauses(t)] == [(k, round(w, 6)) for k, w in brute_clauses(t, m.stems)], t


def test_sharding(docs):
    rows = sharding.op4_sharding(docs).collect()
    assert len(rows) == docs.count()
    own = Counter((d, len(x.encode()) + 1, zlib.crc32(x.encode())) for d, x in texts(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == own
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})


def test_weighted_sharding(spark):
    df = spark.range(6000).withColumn("s", sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 3.0]))
    n = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert 2 not in n and abs(n[0] - 1000) < 150 and abs(n[3] - 3000) < 200


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.pack(docs, tokenizer_file("word_bpe_49k.json")).collect()
    want = Counter()
    for d, x in texts(docs):
        want[d, tuple([*tok.encode(x, add_special_tokens=False).ids, 2])] += 1
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for (d, ids), n in want.items():
        mine = [r for r in rows if r["doc_id"] == d and r["doc_tokens"] == len(ids)]
        assert Counter((r["start"], r["length"], r["ids_crc32"]) for r in mine) == Counter({(r["start"], r["length"], crc(ids[r["start"] : r["start"] + r["length"]])): n for r in mine})
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 4096


def test_windows():
    w = packing.Windows(10, 2, 0)
    assert [w.place(n) for n in (6, 7, 3, 4, 5, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]


def test_line_dedup(docs):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    held = {}
    for d, x in texts(docs):
        for line in x.split("\n"):
            held.setdefault(key(line), set()).add(d)
    want = []
    for d, x in texts(docs):
        lines = x.split("\n")
        kept = [y for y in lines if not (len(key(y)) >= 20 and len(held[key(y)]) >= 3 and max(held[key(y)]) != d)]
        want.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    got = [tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in line_dedup.op6_line_dedup(docs).collect()]
    assert sorted(got) == sorted(want)


def sets_of(docs, k):
    out = []
    for d, x in texts(docs):
        w = re.findall(rb"[^\x20\x09-\x0D]+", x.encode().lower())
        out.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def linked(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_dedup(docs):
    s = sets_of(docs, 4)
    pairs = [(a, b) for i, (a, x) in enumerate(s) for b, y in s[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    comp = linked([d for d, _ in s], pairs)
    want = sorted((d, len(x), comp[d], comp[d] == d) for d, x in s)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in near_dedup.op7_minhash_dedup(docs).collect())
    assert got == want


def test_near_dedup_blocks(spark):
    """A large group with many pairs on both sides of the threshold."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(330):
        w = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[j] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = sets_of(docs, 4)
    comp = linked([d for d, _ in s], [(a, b) for i, (a, x) in enumerate(s) for b, y in s[:i] if 100 * len(x & y) >= 80 * len(x | y)])
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.op7_minhash_dedup(docs).collect()} == comp


def test_keep_one_keeps_columns(odd_docs):
    out = near_dedup.keep_one(odd_docs)
    assert out.columns == odd_docs.columns and {r["doc_id"] for r in out.collect()} == {1, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14, 15}


def test_keep_one_of_repeated_rows(spark):
    """Rows that repeat a doc_id, and copies without one: one row stays, and keeps its text through suffix_dedup."""
    body = lambda k: " ".join(f"{k}{i} of{i * 7 % 83}" for i in range(120))
    a, b, c, d, e = map(body, "abcde")
    near = lambda x: x + " tail"
    rows = [(1, a), (1, a), (1, a), (2, near(a)), (3, b), (3, c), (4, near(c)), (None, d), (None, d), (None, near(d)), (None, e), (7, e), (8, ""), (8, ""), (9, None), (None, ""), (None, None)]
    out = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).cache()
    got = [tuple(r) for r in out.collect()]
    assert sum(x in (d, near(d)) for _, x in got) == 1
    rest = [(i, x) for i, x in got if x not in (d, near(d))]
    assert sorted(rest, key=str) == sorted([(1, a), (3, b), (3, c), (7, e), (8, ""), (9, None), (None, ""), (None, None)], key=str)
    kept = {r["text"] for r in repeats.drop_repeats(out).collect()}
    assert {a, b, c, e} <= kept and kept & {d, near(d)}


def test_repeated_ids_of_other_content(spark):
    """A doc_id or vec_id that stands for two contents: both link, each with its own copies and near copies."""
    body = lambda k: " ".join(f"{k}{i} of{i * 7 % 83}" for i in range(120))
    a, b = body("a"), body("b")
    rows = [(5, a), (5, b), (6, a + " tail"), (7, b + " tail"), (2, b + " tail more"), (9, body("c"))]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.op7_minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (6, 5), (5, 2), (7, 2), (2, 2), (9, 9)}
    x, y = np.random.default_rng(4).standard_normal((2, 64))
    turned = lambda v, at: [float(z) for z in v + 0.01 * np.eye(64)[at]]
    rows = [(5, [*map(float, x)]), (5, [*map(float, y)]), (6, turned(x, 0)), (7, turned(y, 1)), (2, turned(y, 2))]
    out = embedding_dedup.op10_embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["component_id"], r["n_links"]) for r in out} == {(5, 5, 1), (6, 5, 1), (5, 2, 2), (7, 2, 2), (2, 2, 2)}


def test_byte_bpe(docs):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, x in texts(docs):
        ids = enc.encode_ordinary(x)
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(x.encode())))
    got = [tuple(r) for r in byte_bpe.op8_byte_bpe(docs, tokenizer_file("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("big", [1024, 1])
def test_repeats(docs, big):
    t = [(d, x.encode()) for d, x in texts(docs)]
    count = Counter(b[i : i + 200] for _, b in t for i in range(len(b) - 199))
    want = []
    for d, b in t:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    out = repeats.remove_repeats(docs.select("doc_id", "text"), big=big).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in out) == sorted(want)


def test_embeddings(spark, sf_dir):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64))
    v = [base[i % 40] + rng.standard_normal(64) * rng.choice([0.02, 0.25]) for i in range(700)]
    rows = [(i, [float(x) for x in np.float32(y)]) for i, y in enumerate(v)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, [2 * x for x in rows[0][1]]), (1003, None), (1004, [0.0] * 64), (1005, [float("nan")] * 64), (1006, [1.0, None]), (1007, [1.0, 2.0]), (1008, [1.0, 2.0]), (1009, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.op10_embedding_dedup(df).collect()}
    good = [(i, np.float64(np.float32(x))) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)]
    pairs = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[:k] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95]
    n = Counter(i for p in pairs for i in p)
    comp = linked([i for i, _ in rows], pairs)
    off = [i for i, _ in rows if got[i] != (n[i], comp[i], comp[i] == i)]
    found = sum(g[0] for g in got.values()) / 2
    assert found >= 0.99 * len(pairs) and len(off) <= 0.02 * len(rows), (len(off), found, len(pairs))


@pytest.mark.parametrize("run", [order_minhash.op1_order_minhash, sharding.op4_sharding, line_dedup.op6_line_dedup, near_dedup.op7_minhash_dedup, repeats.op9_suffix_dedup])
def test_empty_tables(empty_docs, run):
    assert run(empty_docs).collect() == []


def test_empty_tables_with_files(empty_docs):
    assert token_files.op2_token_files(empty_docs, tokenizer_file("byte_bpe_50k.json")).collect() == []
    assert packing.pack(empty_docs, tokenizer_file("word_bpe_49k.json")).collect() == []
    assert byte_bpe.op8_byte_bpe(empty_docs, tokenizer_file("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []
    assert toxicity.op3_toxicity(empty_docs, empty_docs.selectExpr("doc_id", "1 as toxic")).collect() == []


def test_unit_store_trims():
    import pyarrow as pa

    from linkledger.llm.units import LibraryStore

    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'common' if i % 3 else 'rare'}{rng.integers(9 if i % 3 else 100_000)}." for i in range(60)) for _ in range(40)]
    path = P.path("word_bpe_49k.json")
    small, large = LibraryStore(path, False, 300), LibraryStore(path, False)
    for i in range(0, 40, 4):
        part = pa.array(texts[i : i + 4])
        for a, b in zip(small.ids(part), large.ids(part)):
            assert (a == b).all()
    assert len(small.slot) < len(large.slot)
