"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from .common import table

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_files(spark, sf_dir):
    from .token_files import op2_token_files as run

    return run(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op5_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .byte_bpe import op8_byte_bpe as run

    return run(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_sharding(spark, sf_dir):
    from .sharding import op4_sharding as run

    return run(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark, sf_dir):
    from .line_dedup import op6_line_dedup as run

    return run(table(spark, sf_dir, "documents"))


def _oracles() -> None:
    from .centroids import OP12_SQL
    from .line_dedup import OP6_SQL

    ORACLES["op6_line_dedup"] = OP6_SQL
    ORACLES["op12_centroids"] = OP12_SQL


_oracles()


@query
def op7_minhash_dedup(spark, sf_dir):
    from .near_dedup import op7_minhash_dedup as run

    return run(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark, sf_dir):
    from .repeats import op9_suffix_dedup as run

    return run(table(spark, sf_dir, "documents"))


@query
def op10_embedding_dedup(spark, sf_dir):
    from .embedding_dedup import op10_embedding_dedup as run

    return run(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op1_order_minhash(spark, sf_dir):
    from .order_minhash import op1_order_minhash as run

    return run(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    from .toxicity import op3_toxicity as run

    return run(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_mixing(spark, sf_dir):
    from .mixing import op11_mixing as run

    return run(table(spark, sf_dir, "documents"))


@query
def op12_centroids(spark, sf_dir):
    from .centroids import op12_centroids as run

    return run(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling(spark, sf_dir):
    from .spelling import op13_spelling as run

    return run(table(spark, sf_dir, "documents"))
