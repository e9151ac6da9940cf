"""The registered queries of the subpackage, one for each operator, with the statements that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aeolis.llm import curves, jaccard, language, licenses, merkle, mixing, negatives, packing, pii, suffix_tree, tokens, topk, toxicity
from aeolis.llm.common import table

def tokenizer(name: str) -> str:
    """A file of the public tokenizers; its folder is no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to square-root weights of their sources."""
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), max_rate=None)


ORACLES["op1_poisson_mix"] = mixing.oracle()


@query
def op5_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op5_histogram_topk"] = topk.oracle()


@query
def op10_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as shards and read back by key."""
    return tokens.binary_round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, packed into sequences of at most 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op7_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the group they are connected to by a similarity of 0.9 over three-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op7_count_vector_join"] = jaccard.oracle()


@query
def op2_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from two thirds of the labels."""
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of them."""
    return language.identified_documents(table(spark, sf_dir, "documents"))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.found_documents(table(spark, sf_dir, "documents"))


@query
def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth."""
    return curves.nearest(table(spark, sf_dir, "embeddings"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, its own or that of the nearest directory above."""
    return licenses.scanned_documents(table(spark, sf_dir, "documents"))


ORACLES["op9_license_scan"] = licenses.oracle()


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the Merkle tree over all documents, checked against its text, some of it changed."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = merkle.oracle()


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest rows of other labels for every hundredth vector and each of its nearest rows of the same label."""
    return negatives.hard_negatives(negatives.relabelled(table(spark, sf_dir, "embeddings")))


ORACLES["op12_hard_negatives"] = negatives.oracle()


@query
def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability by a suffix tree over words, learned from six sevenths of the documents."""
    return suffix_tree.score(table(spark, sf_dir, "documents"))
