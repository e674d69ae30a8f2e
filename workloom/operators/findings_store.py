"""Findings kept between runs: a text is analysed once per version of the rules.

The store holds one row per digest of a text without comments, with the array of its findings (empty
for a clean text), below ``rule_version=…/generation=…/batch=…``. A run joins its distinct texts
against the stored digests, analyses only those that are not there, and appends them as a batch; the
answer is then read from the store alone. Compaction writes all batches as one into the next
generation; readers and later runs use the newest one. Facts about tables change findings as rules do, so a
caller that passes facts names them in the version. One writer per version at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from workloom.functions import lexical as lx
from workloom.operators.detectors import detect, distinct_texts, with_context
from workloom.session import written

ITEMS = "array<struct<ordinal:int,rule_key:string,rule_id:string,severity:string,message:string,context:map<string,string>,fix:string>>"
SCHEMA = f"digest string, findings {ITEMS}, generation int, batch int"


def stored(spark: SparkSession, path: str, rule_version: str) -> DataFrame:
    """(digest, findings, generation, batch) of the newest generation; empty where nothing is stored."""
    try:
        every = spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/rule_version={rule_version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    newest = every.agg(F.max("generation")).first()[0]
    return every.filter(F.col("generation") == F.lit(newest))


def _append(rows: DataFrame, path: str, rule_version: str, generation: int, batch: int) -> None:
    rows.select("digest", "findings").write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/rule_version={rule_version}/generation={generation}/batch={batch}")


def analyse(statements: DataFrame, path: str, rule_version: str, keys=None, **context: DataFrame) -> int:
    """Analyse the texts that the store does not know; returns how many there were."""
    spark = statements.sparkSession
    known = stored(spark, path, rule_version)
    generation, batch = known.agg(F.coalesce(F.max("generation"), F.lit(0)), F.coalesce(F.max("batch"), F.lit(0))).first()
    digest = F.sha2("statement_text", 256).alias("digest")
    texts = distinct_texts(statements).withColumn("_digest", digest)
    fresh = written(texts.join(known.select(F.col("digest").alias("_digest")), "_digest", "left_anti").drop("_digest"))
    n = fresh.count()
    if n:
        found = detect(with_context(fresh, **context), keys)
        item = F.struct("ordinal", "rule_key", "rule_id", "severity", "message", "context", "fix")
        per = found.groupBy(digest).agg(F.array_sort(F.collect_list(item), lambda a, b: a["ordinal"] - b["ordinal"]).alias("findings"))
        rows = fresh.select(digest).join(per, "digest", "left").select(
            "digest", F.coalesce("findings", F.array().cast(ITEMS)).alias("findings"))
        _append(rows, path, rule_version, generation, batch + 1)
    return n


def findings(statements: DataFrame, path: str, rule_version: str) -> DataFrame:
    """Stored findings of every statement, with the batch in which its text was analysed."""
    known = stored(statements.sparkSession, path, rule_version).filter(F.size("findings") > 0)
    runs = statements.select("statement_id", "executed_by", lx.text_key(F.col("statement_text")).alias("digest"))
    return runs.join(known, "digest").select("statement_id", "executed_by", "batch", F.explode("findings").alias("x")).select(
        "statement_id", "executed_by", "batch", "x.*")


def detect_stored(statements: DataFrame, path: str, rule_version: str, keys=None, **context: DataFrame) -> DataFrame:
    analyse(statements, path, rule_version, keys, **context)
    return findings(statements, path, rule_version)


def compact(spark: SparkSession, path: str, rule_version: str) -> None:
    """All batches of the newest generation as one batch of the next."""
    known = stored(spark, path, rule_version)
    top = known.agg(F.max("generation"), F.max("batch")).first()
    if top[0] is not None:
        _append(known.dropDuplicates(["digest"]), path, rule_version, top[0] + 1, top[1])
