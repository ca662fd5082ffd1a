"""Small result files: assignments, classifications, validation datasets, manifests, aggregates; JSON and CSV as others write them.

Cases: files that aren't there are empty tables or maps, broken ones are skipped; missing fields have the format's defaults.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGNMENT = (
    "passage_id string, passage_text string, probabilities map<string,double>, top_frames array<string>, rationale string, "
    "evidence_spans array<string>, metadata map<string,string>"
)
SAMPLE = "sample_id string, text_a string, text_b string, gold_label string, metadata map<string,string>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that hold one (over many lines, from the first column), one a line, or an array of them."""
    try:
        d = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    one = d.select(F.explode(F.split("value", r"\n(?=\{)")).alias("v"))
    struct = F.from_json("v", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    listed = F.from_json("v", f"array<struct<{spark.createDataFrame([], schema).schema.simpleString()[7:-1]}>>")
    rows = F.when(F.ltrim("v").startswith("["), listed).otherwise(F.array(F.when(struct["_bad"].isNull(), F.struct(*(struct[c].alias(c) for c in spark.createDataFrame([], schema).columns)))))
    return one.select(F.explode(rows).alias("r")).filter("r is not null").select("r.*")


def _defaults(rows: DataFrame, schema: str) -> DataFrame:
    empty = {"string": F.lit("")}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    make = lambda k: empty[k] if k in empty else F.array().cast(k) if k.startswith("array") else F.expr(f"cast(map() as {k})")
    return rows.select(*(F.coalesce(c, make(k)).alias(c) for c, k in kinds.items()))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Frame assignments of JSON arrays, one of many files or one; those without a passage id are skipped."""
    return _defaults(_json(spark, path, ASSIGNMENT).filter("passage_id is not null"), ASSIGNMENT)


def write_assignments(rows: DataFrame, path: str) -> None:
    rows.select("passage_id", "passage_text", "probabilities", "top_frames", "rationale", "evidence_spans", "metadata").write.mode("overwrite").json(path)


def read_classifications(spark: SparkSession, path: str, schema: str, ids: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """A document's payload per file (or line) of a folder, of all documents or of those in ids."""
    d = _json(spark, path, schema).filter(F.coalesce(id_col, F.lit("")) != "")
    return d if ids is None else d.join(ids.select(id_col).distinct(), id_col, "left_semi")


def write_classifications(rows: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The folder holds these documents afterwards and no stale ones; a row per document, the last of those with its id."""
    from ..operators.dedup import first_by

    rows = rows.filter(F.coalesce(id_col, F.lit("")) != "")
    first_by(rows, [id_col], F.desc(F.monotonically_increasing_id())).write.mode("overwrite").json(path)


def read_samples(spark: SparkSession, path: str, labels: Sequence[str] = ()) -> DataFrame:
    """Validation samples of a JSON array or of CSV with a header (by the name's end); ids default to `sample_<n>`.

    With labels, a gold label outside of them is an error that names it.
    """
    if path.endswith(".csv"):
        d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        d = d.select(*(F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in ("sample_id", "text_a", "text_b", "gold_label")), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    elif path.endswith(".json"):
        d = _json(spark, path, SAMPLE)
    else:
        raise ValueError(f"neither .json nor .csv: {path}")
    d = d.withColumn("_n", F.monotonically_increasing_id()).withColumn("sample_id", F.coalesce("sample_id", F.concat(F.lit("sample_"), "_n"))).drop("_n")
    if labels:
        known = F.col("gold_label").isin(*labels)
        d = d.withColumn("gold_label", F.when(known, F.col("gold_label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("gold_label", F.lit("null"))))))
    return _defaults(d, SAMPLE)


def write_samples(rows: DataFrame, path: str) -> None:
    rows.select("sample_id", "text_a", "text_b", "gold_label", "metadata").coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A corpus's manifest.json; empty if it isn't there or isn't JSON. One small file."""
    try:
        text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()
        return json.loads(text.value) if text and text.value.strip() else {}
    except (AnalysisException, json.JSONDecodeError):
        return {}


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")


def corpus_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: (corpus_path, document_count, manifest): non-blank lines of the index, the manifest as a map."""
    from .corpus import line_count

    m = {k: v if isinstance(v, str) else json.dumps(v) for k, v in read_manifest(spark, path).items()}
    manifest = F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) if m else F.expr("cast(map() as map<string,string>)")
    return line_count(spark, f"{path}/index.jsonl").select(F.lit(path).alias("corpus_path"), F.col("n").alias("document_count"), manifest.cast("map<string,string>").alias("manifest"))


def document_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, frame_scores, total_weight) of aggregates/documents_weighted.json, else summed up from frame_assignments.json by characters."""
    d = _json(spark, f"{folder}/aggregates/documents_weighted.json", "doc_id string, frame_scores map<string,double>, total_weight double")
    if not d.isEmpty():
        return d
    a = read_assignments(spark, f"{folder}/frame_assignments.json").withColumn("doc_id", F.substring_index("passage_id", ":", 1)).withColumn("w", F.length("passage_text").cast("double"))
    total = a.groupBy("doc_id").agg(F.sum("w").alias("total_weight"))
    s = a.select("doc_id", "w", F.explode("probabilities").alias("frame", "p")).groupBy("doc_id", "frame").agg(F.sum(F.col("w") * F.col("p")).alias("v"))
    s = s.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame", "v")))).alias("frame_scores"))
    return total.join(s, "doc_id", "left").select("doc_id", F.coalesce("frame_scores", F.expr("cast(map() as map<string,double>)")).alias("frame_scores"), "total_weight")
