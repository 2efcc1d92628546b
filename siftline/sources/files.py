"""Source trees and small tables from files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import fixed
from siftline.functions.scoring import file_language, scannable
from siftline.sources import tree


def source_files(spark: SparkSession, path: str, languages: dict[str, str] | None = None) -> DataFrame:
    """(file, language, text) of all files under a path that are scanned: those whose extension has a language (by default those of
    fixed.LANGUAGE_BY_EXTENSION), outside skipped directories. Skipped directories are never opened, and paths are filtered before contents
    are read; bytes that are no UTF-8 become U+FFFD. On file systems that Arrow can't open Spark lists all files first, without those whose names begin with _ or a dot."""
    try:
        tree.opened(path)
    except (ValueError, OSError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(scannable(F.col("path"), languages))
    else:
        found = tree.listed(spark, path, list(fixed.LANGUAGE_BY_EXTENSION if languages is None else languages))
        files = tree.contents(found.where(scannable(F.col("path"), languages)), path)
    return files.select(F.col("path").alias("file"), file_language(F.col("path"), known=languages).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(cwe_id, w_sast, w_graph, w_llm) of JSON lines, or of YAML files (.yml, .yaml) that map a CWE to its weights, at the top or below
    `weights`; rows without weights are left out. A path where nothing is gives no rows."""
    names = ["sast_weight", "gat_weight", "llm_weight"]
    kind = "cwe_id string, " + ", ".join(f"{n} double" for n in names)
    try:
        if path.lower().endswith((".yml", ".yaml")):
            x = spark.read.text(path, wholetext=True).mapInPandas(_yaml_weights, kind)
        else:
            x = spark.read.schema(kind).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        x = spark.createDataFrame([], kind)
    return x.where("sast_weight IS NOT NULL").toDF("cwe_id", "w_sast", "w_graph", "w_llm")


def _yaml_weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole YAML texts -> a row a CWE; entries that are no maps are left out."""
    import yaml

    names = ["sast_weight", "gat_weight", "llm_weight"]
    for b in batches:
        for text in b["value"]:
            known = yaml.safe_load(text)
            known = known.get("weights", known) if isinstance(known, dict) else {}
            rows = [(str(k), *[w.get(n) for n in names]) for k, w in known.items() if isinstance(w, dict)] if isinstance(known, dict) else []
            yield pd.DataFrame(rows, columns=["cwe_id", *names]).astype(dict.fromkeys(names, float))
