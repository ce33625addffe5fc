"""Where texts come from and where reports go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder of ``spark.checkpoint.dir`` and read again, so that a loop's plan stays short."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="textlode-"))
        folder = "file://" + _own[0]
    path = f"{folder}/textlode/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """Return (doc_id, text): one row for each UTF-8 file, named by its path."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def one_text(spark: SparkSession, text: str, name: str = "(input)") -> DataFrame:
    return spark.createDataFrame([(name, text)], "doc_id string, text string")


def read_parquet(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that scores need are read."""
    return spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def labelled(spark: SparkSession, human: str, machine: str, least: int = 50) -> DataFrame:
    """Return (doc_id, text, label) of the .txt files of two folders; files under ``least`` words are left out."""
    rows = [read_texts(spark, f"{folder}/*.txt").withColumn("label", F.lit(k)) for k, folder in enumerate((human, machine))]
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    return rows[0].union(rows[1]).filter(words >= least)


def read_centroids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(model, human, machine) from a JSON file of means, sds and class centroids by word; None if it cannot be read."""
    try:
        row = spark.read.json(path, multiLine=True).select("means", "sds", "active", "human_centroid", "machine_centroid").first()
    except Exception:
        return None
    active = set(row["active"] or [])
    sds = row["sds"].asDict()
    model = [(w, m, sds[w], w in active) for w, m in row["means"].asDict().items()]
    side = lambda c: spark.createDataFrame(list(row[c].asDict().items()), "word string, z double")
    return spark.createDataFrame(model, "word string, mean double, sd double, active boolean"), side("human_centroid"), side("machine_centroid")


def report_rows(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Return (key, value): the report of each row of a scored frame as JSON, rounded as reports are."""
    signal = F.transform("signals", lambda s: F.struct(s["name"].alias("name"), s["layer"].alias("layer"), F.round(s["logodds"], 3).alias("logodds"), F.round(s["detail"], 4).alias("detail"), s["direction"].alias("direction")))
    body = F.struct(key, F.round("probability", 4).alias("probability"), "verdict", "confidence", "word_count", F.round("total_logodds", 3).alias("total_logodds"), F.transform_values("layer_totals", lambda k, v: F.round(v, 3)).alias("layer_totals"), "notes", signal.alias("signals"))
    return scored.select(key, F.to_json(body).alias("value"))


def write_reports(scored: DataFrame, path: str, key: str = "doc_id") -> None:
    report_rows(scored, key).select("value").write.text(path)


def text_report(scored: DataFrame, key: str = "doc_id", machine: int = 8, human: int = 6) -> DataFrame:
    """Return (key, report): a few lines to read, with the strongest signals of either side."""
    from textlode.operators.scoring import human_evidence, machine_evidence

    def lines(side, n: int):
        return F.array_join(F.transform(F.slice(side, 1, n), lambda s: F.format_string("  %+.2f  %s", s["logodds"], s["name"])), "\n")

    head = F.format_string("%s: %.1f %%, %s (confidence %s, %d words)", F.col(key).cast("string"), F.col("probability") * 100, "verdict", "confidence", "word_count")
    return scored.select(key, F.concat_ws("\n", head, F.array_join("notes", "\n"), F.lit("machine:"), lines(machine_evidence(), machine), F.lit("human:"), lines(human_evidence(), human)).alias("report"))


def over(scored: DataFrame, threshold: float) -> bool:
    """Whether any row's probability reaches the threshold: the gate of a batch job."""
    return not scored.filter(F.col("probability") >= threshold).limit(1).isEmpty()
