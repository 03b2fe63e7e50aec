"""Registered queries of the operators on texts and vectors, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import (
    bpe,
    credentials,
    decontamination,
    jaccard,
    lexical,
    merkle,
    nearest,
    oracles,
    pii,
    quality,
    sentence_spans,
    suffixes,
    toxicity,
    wavelet,
)
from pulsegrid.llm.batches import lower_ascii, table
from pulsegrid.plans.catalog import Query
from pulsegrid.session import workspace


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, digest of their spans, all spans."""
    found = credentials.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in credentials.KINDS),
        F.sha2(credentials.joined(F.col("base")), 256).alias("base_sha256"),
        credentials.joined(F.col("base"), F.col("learned")).alias("spans"),
    )


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated runs of two, and without repeated short texts."""
    return sentence_spans.deduplicated(
        table(spark, sf_dir, "documents"), size=sentence_spans.FEW, words=sentence_spans.WORDS, rest=True
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.PREDICT).cast("int").alias("predicted"),
        "spans",
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.default_vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to shard files and read back."""
    path = workspace(spark, "shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, bpe.default_vocabulary())
    return wavelet.read_documents(spark, path)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles agree to three quarters."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth one."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of fifty that earlier documents have."""
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of the base kinds, digest of their spans, all spans."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]
    return found.select(
        "doc_id",
        *(F.size(f"spans_{name}").cast("long").alias(f"n_{name}") for name in base),
        F.sha2(pii.joined(F.concat(*(F.col(f"spans_{name}") for name in base))), 256).alias("base_sha256"),
        pii.joined(pii.all_spans()).alias("spans"),
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    index = lexical.write_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; of a third of the ids the text is tampered with."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    manifest = merkle.write_manifest(
        table(spark, sf_dir, "documents"), claims={"text": lower_ascii(F.col("text"))}, claimed=crc % 3 == 0
    )
    return merkle.proofs(manifest).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root", "verified"
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a quarter of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.PREDICT).cast("int").alias("predicted"),
    )


QUERIES = {
    "op1_secrets": Query(op1_secrets),
    "op2_sentence_spans": Query(op2_sentence_spans),
    "op3_toxicity": Query(op3_toxicity),
    "op4_bpe": Query(op4_bpe),
    "op5_wavelet": Query(op5_wavelet),
    "op6_decontamination": Query(op6_decontamination, oracles.OP6),
    "op7_jaccard": Query(op7_jaccard, oracles.OP7),
    "op8_nearest": Query(op8_nearest),
    "op9_suffixes": Query(op9_suffixes, oracles.OP9),
    "op10_pii": Query(op10_pii, oracles.OP10),
    "op11_search": Query(op11_search, oracles.OP11),
    "op12_manifest": Query(op12_manifest, oracles.OP12),
    "op13_quality": Query(op13_quality),
}
