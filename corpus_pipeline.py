"""Corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, mixture. Each stage works on all that its predecessor kept."""
from robustlens.llm import decontam, language, mixing, neardup, passages

MIN_SCORE = 0.05     # a language is rejected below it; texts without a letter always are


def language_stage(spark, docs, sf_dir):
    """Documents whose language is told: `und` and those of almost no score go."""
    model = language.fit(docs)
    own = {c: c + "_" * (1 + max(len(x) for x in docs.columns)) for c in ("lang_pred", "score") if c in docs.columns}     # columns that the stage's own would replace
    named = language.identify(docs.withColumnsRenamed(own), model)
    kept = named.where((named.lang_pred != language.UNKNOWN) & (named.score >= MIN_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each class of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def passage_stage(spark, docs, sf_dir):
    """Repeated paragraphs only at their first place."""
    return passages.drop_repeats(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that overlap no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)


def mixing_stage(spark, docs, sf_dir):
    """Every document with its place in the mixture."""
    return mixing.mix(docs)


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("passages", passage_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]
ORACLE_SQL = None    # trained stages and hashed sketches have no SQL; tests/llm/test_pipeline.py holds the stages against plain Python


def run(spark, sf_dir):
    """Documents after all stages; each stage's result is written as Parquet in the shared folder and read again."""
    from robustlens.session import materialize
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return docs
