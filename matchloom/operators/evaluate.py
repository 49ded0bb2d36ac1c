"""Comparison of runs: consistency of two rankings, similarity of embeddings to a reference set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.functions import vector
from matchloom.functions.schema import require_columns

#: Vectors of a key in a block.
BLOCK = 4096


def match_consistency(a: DataFrame, b: DataFrame, *, patient: str = "patient_id", trial: str = "trial_id", rank: str = "rank", score: str = "similarity_score") -> DataFrame:
    """Per patient of either run: sizes, Jaccard, top-5 and top-10 overlap, top-1 agreement, mean top-5 scores. Ties in rank go to the smaller trial id."""

    def lists(df: DataFrame, at: str) -> DataFrame:
        require_columns(df, [patient, trial, rank], f"run {at}")
        value = F.col(score).cast("double") if score in df.columns else F.lit(None).cast("double")
        df = df.select(F.col(patient).cast("string").alias(patient), F.col(trial).cast("string").alias("t"), F.col(rank).alias("r"), value.alias("s"))
        best = df.groupBy(patient, "t").agg(F.min(F.struct("r", "s")).alias("x"))
        return best.groupBy(patient).agg(F.array_sort(F.collect_list(F.struct("x.r", "t", "x.s"))).alias(at))

    both = lists(a, "a").join(lists(b, "b"), patient, "full")
    empty = F.array().cast(both.schema["a"].dataType)
    both = both.withColumn("a", F.coalesce("a", empty)).withColumn("b", F.coalesce("b", empty))
    ids = lambda at, k=None: F.transform(F.slice(at, 1, k) if k else F.col(at), lambda x: x["t"])
    na, nb = F.size("a"), F.size("b")

    def overlap(k: int):
        least = F.least(F.lit(k), na, nb)
        return F.when(least > 0, F.size(F.array_intersect(ids("a", k), ids("b", k))) / least)

    def top5(at: str):
        five = F.slice(at, 1, 5)
        return F.when(F.size(five) > 0, F.aggregate(five, F.lit(0.0), lambda s, x: s + x["s"]) / F.size(five))

    return both.select(
        patient, na.alias("n_trials_a"), nb.alias("n_trials_b"),
        (F.size(F.array_intersect(ids("a"), ids("b"))) / F.size(F.array_union(ids("a"), ids("b")))).alias("full_set_jaccard"),
        overlap(5).alias("top5_overlap_fraction"), overlap(10).alias("top10_overlap_fraction"),
        F.when((na > 0) & (nb > 0), (F.get("a", F.lit(0))["t"] == F.get("b", F.lit(0))["t"]).cast("int")).alias("top1_agreement"),
        top5("a").alias("mean_top5_score_a"), top5("b").alias("mean_top5_score_b"),
    )


def consistency_summary(per_patient: DataFrame) -> DataFrame:
    out = [f(c).alias(f"{c}_{n}") for c in ("full_set_jaccard", "top5_overlap_fraction", "top10_overlap_fraction") for n, f in (("mean", F.avg), ("median", F.median))]
    return per_patient.agg(*out, F.avg("top1_agreement").alias("top1_agreement_proportion"), F.count(F.lit(1)).alias("n_patients"))


def consistency_by_score(per_patient: DataFrame, source: str = "a") -> DataFrame:
    """Top-5 overlap of patients below ("low") and from ("high") the median of run ``source``'s mean top-5 score."""
    score = f"mean_top5_score_{source}"
    rows = per_patient.where(F.col(score).isNotNull() & F.col("top5_overlap_fraction").isNotNull())
    cut = rows.agg(F.median(score).alias("median_cutpoint"))
    group = F.when(F.col(score) < F.col("median_cutpoint"), "low").otherwise("high")
    found = rows.crossJoin(cut).groupBy(group.alias("score_group"), "median_cutpoint")
    return found.agg(F.avg("top5_overlap_fraction").alias("mean"), F.median("top5_overlap_fraction").alias("median"), F.count(F.lit(1)).alias("count")).orderBy(F.desc("score_group"))


def embedding_similarity(package: DataFrame, gold: DataFrame, key: str, own: str = "embedding", other: str = "gold_embedding") -> DataFrame:
    """Cosine of the two embeddings of each shared id; 0 where one is empty or lengths differ."""
    x, y = package.select(key, F.col(own).alias("_a")), gold.select(key, F.col(other).alias("_b"))
    sim = vector.cosine(vector.as_doubles(F.col("_a")), vector.as_doubles(F.col("_b")))
    return x.join(y, key).select(key, F.coalesce(sim, F.lit(0.0)).alias("cosine"))


def drift_gate(similarity: DataFrame, least: float = 0.8) -> DataFrame:
    return similarity.agg(F.avg("cosine").alias("mean_cosine"), F.count(F.lit(1)).alias("n")).withColumn("passed", F.col("mean_cosine") >= least)


def worst(similarity: DataFrame, key: str, n: int = 5) -> DataFrame:
    return similarity.orderBy("cosine", key).limit(n)


def best_match_both_ways(a: DataFrame, b: DataFrame, key: str = "trial_id") -> DataFrame:
    """Per shared key: mean over a's vectors of the best cosine in b, the same from b to a, and their mean.

    ``a`` and ``b`` have key, id and embedding. Norms are taken once per row. Blocks of at most about BLOCK vectors of a key
    and length are multiplied, and only the best of each row and column leaves a block, so no pair becomes a row. Vectors
    that are null, hold null or have no vector of their length on the other side count, but without a best cosine.
    """

    def side(df: DataFrame, own: str) -> DataFrame:
        v = vector.unit(vector.as_doubles(F.col("embedding")))
        whole = df.select(F.col(key).alias("k"), F.col("id").alias(own), v.alias("v"))
        return whole.withColumn("d", F.when(~F.exists("v", lambda x: x.isNull()), F.size("v")))

    x, y = side(a, "ia"), side(b, "ib")
    tagged = lambda df, first: df.select("k", "d", F.lit(first).alias("first"))
    blocks = lambda test: F.ceil(F.count_if(test) / BLOCK).cast("int")
    many = tagged(x, True).unionByName(tagged(y, False)).where(F.col("d").isNotNull()).groupBy("k", "d").agg(blocks(F.col("first")).alias("na"), blocks(~F.col("first")).alias("nb"))
    many = many.where("na > 0 and nb > 0")

    def dealt(df: DataFrame, own: str, mine: str, other: str):
        spread = df.join(many, ["k", "d"]).withColumn(mine, F.pmod(F.xxhash64(own, "v"), F.col(f"n{mine}")).cast("int"))
        return spread.select("k", "d", own, "v", mine, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(other)).groupBy("k", "d", "a", "b")

    types = {"k": x.schema["k"].dataType, "first": T.BooleanType(), "ia": x.schema["ia"].dataType, "ib": y.schema["ib"].dataType, "s": T.DoubleType()}
    schema = T.StructType([T.StructField(n, t) for n, t in types.items()])
    arrow = to_arrow_schema(schema)

    def cell(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return arrow.empty_table()
        u, v = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, t.column("d")[0].as_py()) for t in (p, q))
        rows, columns = np.empty(len(u)), np.full(len(v), -np.inf)
        with np.errstate(invalid="ignore"):
            for at in range(0, len(u), 256):
                s = u[at : at + 256] @ v.T
                rows[at : at + 256] = s.max(axis=1)
                columns = np.maximum(columns, s.max(axis=0))
        one = [p.column("k"), pa.repeat(True, len(u)), p.column("ia"), pa.nulls(len(u), arrow.field("ib").type), pa.array(rows)]
        two = [q.column("k"), pa.repeat(False, len(v)), pa.nulls(len(v), arrow.field("ia").type), q.column("ib"), pa.array(columns)]
        return pa.concat_tables([pa.table(one, schema=arrow), pa.table(two, schema=arrow)])

    best = dealt(x, "ia", "a", "b").cogroup(dealt(y, "ib", "b", "a")).applyInArrow(cell, schema)
    nothing = lambda n: F.lit(None).cast(types[n]).alias(n)
    best = best.unionByName(x.select("k", "ia", nothing("ib"), nothing("s"), F.lit(True).alias("first"))).unionByName(y.select("k", nothing("ia"), "ib", nothing("s"), F.lit(False).alias("first")))
    first, per = F.col("first"), best.where(F.col("k").isNotNull()).groupBy("k", "first", "ia", "ib").agg(F.max("s").alias("s"))
    out = per.groupBy(F.col("k").alias(key)).agg(
        F.count_if(first).alias("n_pkg_spaces"), F.count_if(~first).alias("n_gold_spaces"),
        F.avg(F.when(first, F.col("s"))).alias("pkg_to_gold"), F.avg(F.when(~first, F.col("s"))).alias("gold_to_pkg"),
    )
    return out.where("n_pkg_spaces > 0 and n_gold_spaces > 0").withColumn("trial_score", (F.col("pkg_to_gold") + F.col("gold_to_pkg")) / 2)
