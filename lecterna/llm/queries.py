"""Queries over the training-data tables; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lecterna.plans.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(ship(spark), d)

    QUERIES[f.__name__] = run
    return run


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.vectors import similar_pairs

    return similar_pairs(spark.read.parquet(f"{d}/segment.parquet"), "vec_id", "sv_feat", k=5, least=0.9)


@query
def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.vectors import similar_vectors

    # the search form: every row whose id is divisible by 100 is asked against all rows
    got = similar_vectors(spark.read.parquet(f"{d}/segment.parquet"), "vec_id", "sv_feat", k=5, every=100)
    return got.selectExpr("id as vec_id", "other", "round(similarity, 5) as similarity", "rank")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.voices import voices_found

    return voices_found(spark.read.parquet(f"{d}/segment.parquet"), "vec_id", "sv_feat", least=0.6, least_size=3)


@query
def p5_voices(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.voices import described

    return described(spark.read.parquet(f"{d}/segment.parquet"), "vec_id", "sv_feat", least=0.6)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.turns import turns

    t = turns(spark.read.parquet(f"{d}/hyp_a.parquet"), spark.read.parquet(f"{d}/segment.parquet"), text=False)
    return t.select("stream_id", "first_idx", "last_idx")


@query
def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.turns import turns

    return turns(spark.read.parquet(f"{d}/hyp_a.parquet"), spark.read.parquet(f"{d}/segment.parquet"), text=True)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.lookalike import same_look

    return same_look(spark.read.parquet(f"{d}/hyp_a.parquet"), spark.read.parquet(f"{d}/hyp_b.parquet"))


@query
def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.lookalike import forms

    return forms(spark.read.parquet(f"{d}/hyp_a.parquet"), spark.read.parquet(f"{d}/hyp_b.parquet"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.sentences import sentences

    return sentences(spark.read.parquet(f"{d}/hyp_a.parquet"), spark.read.parquet(f"{d}/hyp_b.parquet"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.quality import quality

    return quality(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").where("kind <> 'prose'").select("doc_id", "kind")


@query
def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.quality import quality

    return quality(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


@query
def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.packing import packed

    return packed(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/container.parquet"))


@query
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.packing import fill

    return fill(p6_packed(spark, d))


@query
def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.mixing import mixed

    return mixed(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_target.parquet"))


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from lecterna.llm.mixing import shares

    return shares(p7_mixed(spark, d), spark.read.parquet(f"{d}/mix_target.parquet"))
