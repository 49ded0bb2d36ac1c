"""The corpus pipeline: language, toxicity, near-duplicates, secrets, packing. Each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.llm import langid, neardup, packing, queries, secrets, toxicity
from matchloom.llm.common import give_back, read, stage

#: The columns that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: those with a letter and no narrow margin.

    Only the text decides, the whole of it: null and empty texts go, equal texts share their fate, rows without doc_id or with
    a repeated one are judged like others. No rows give no rows; other columns than those of documents are left out.
    """
    model = langid.fit(queries.language_training(docs))
    return _kept(docs, lambda: langid.Classifier(model), lambda c, text: not c.predict(text)[2])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score below 0.5.

    Null and empty texts have the rate of labelled examples without words; without labels all documents stay. Repeated rows
    and equal texts share their fate; long texts are read whole; no rows give no rows.
    """
    model = toxicity.fit(docs, queries.toxic_training(read(spark, sf_dir, "labels")))
    return _kept(docs, lambda: model, lambda m, text: m.score(text)[0] < 0.5)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id.

    Rows whose doc_id is null or repeated are documents of their own: each is numbered above the largest doc_id, so a copy
    with an id of its own goes first and one of equal rows stays. Null, empty and wordless texts are no duplicates; long
    texts are read whole; no rows give no rows; other columns than those of documents are left out.
    """
    docs = docs.select(*COLUMNS)
    twice = stage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "repeated")
    if twice.isEmpty():
        return docs.join(_gone(docs), "doc_id", "left_anti").select(*COLUMNS)
    most = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    own = docs.where("doc_id is not null").join(twice, "doc_id", "left_anti").withColumn("key", F.col("doc_id"))
    odd = docs.join(twice, docs["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi").withColumn("key", F.monotonically_increasing_id() + F.lit(most + 1))
    keyed = stage(own.unionByName(odd), "keyed")
    gone = _gone(keyed.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key")
    return keyed.join(gone, "key", "left_anti").select(*COLUMNS)


def _gone(docs: DataFrame) -> DataFrame:
    return stage(neardup.near_duplicates(docs).where("not kept").select("doc_id"), "gone")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark and counts n_chars anew: every row stays, a null text stays null.

    Texts are scanned whole; overlapping spans become one mark; equal texts stay equal; no rows give no rows.
    """
    return secrets.redact(docs.select(*COLUMNS), secrets.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences: one row per piece. Null and empty texts are their end token; repeated rows are packed each time."""
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifiers nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _kept(docs: DataFrame, setup, test) -> DataFrame:
    """The rows of ``docs`` whose text passes ``test``, in one pass and without a join back by id."""
    import pyarrow as pa

    docs = docs.select(*COLUMNS)

    def run(batches):
        model = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([bool(test(model, t)) for t in part.column(1).to_pylist()], pa.bool_()))
        model = None
        give_back()

    return docs.mapInArrow(run, docs.schema)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
