"""From raw documents to token ids: each stage's result is written and is the next one's input."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, decontamination, jaccard, pii, toxicity
from pulsegrid.llm.batches import small, table
from pulsegrid.session import workspace, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; what toxic means is learned from ``labels`` on these documents.

    Null and empty texts have the score of a text without offending words and stay as they
    are; rows without id and repeated rows are judged one by one.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(
        docs.select(COLUMNS).withColumn("no_text", F.col("text").isNull()),
        model,
        keep=("text", "lang", "source", "n_chars", "no_text"),
    )
    return (
        scored.where(F.col("score") < toxicity.PREDICT)
        .withColumn("text", F.when(~F.col("no_text"), F.col("text")))
        .select(COLUMNS)
    )


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Documents without id stay. Rows that share an id are judged text by text: of those whose
    texts link one stays, and of rows of the same text.
    """
    groups = written(jaccard.similar_documents(docs, keys=True), "groups").where("doc_id IS NOT NULL")
    gone = groups.where("doc_id <> component_id").select("doc_id", "text_key").distinct()
    keyed = docs.select(*COLUMNS, jaccard.text_key(F.col("text")).alias("text_key"))
    kept = keyed.join(small(gone), ["doc_id", "text_key"], "left_anti")
    twice = written(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept.select(COLUMNS)
    same = groups.where("doc_id = component_id").join(small(twice), "doc_id")
    stays = same.groupBy("root", "doc_id").agg(F.min("text_key").alias("text_key")).where("root IS NOT NULL").select("doc_id", "text_key")
    stays = stays.unionByName(same.where("root IS NULL").select("doc_id", "text_key").distinct())
    once = kept.join(small(twice), "doc_id", "left_anti").select(COLUMNS)
    least = kept.join(stays, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min(F.struct(COLUMNS)).alias("row"))
    return once.unionByName(least.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with benchmark items go.

    Null and empty texts are never contaminated. Rows that share an id, null among them, are
    judged text by text.
    """
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = written(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), "text_key").distinct(), "bad")
    text_key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (text_key == bad["text_key"])
    return docs.select(COLUMNS).join(small(bad), same, "left_anti")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes the name of its kind in brackets.

    Null texts become empty; every row is kept as often as it comes, and ``n_chars`` is
    counted anew.
    """
    found = pii.find_pii(docs, keep=("lang", "source"))
    text = F.when(F.size(pii.all_spans()) > 0, pii.masked(F.col("text"), pii.all_spans())).otherwise(F.col("text"))
    return (
        found.select("doc_id", text.alias("text"), "lang", "source")
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(COLUMNS)
    )


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts (little-endian unsigned 32-bit) and their number.

    A null or empty text has none; every row is kept as often as it comes.
    """
    coded = bpe.encode_documents(docs, bpe.default_vocabulary())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", civil),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("pii", masked),
    ("bpe", encoded),
]

#: The stages have no common SQL: labels are learned and bytes are merged.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = workspace(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
