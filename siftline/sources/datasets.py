"""Labelled data sets in several layouts, brought to one row shape; labels from paths; calibration records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.scoring import lookup


def sample(rows: DataFrame, code: Column, label: Column, language: Column, source: str, cwe: Column | None = None) -> DataFrame:
    """(code, label, cwe, language, source): trimmed code of at least 20 characters; the CWE is `unknown` if there is none."""
    kept = F.coalesce(F.nullif(cwe, F.lit("")), F.lit("unknown")) if cwe is not None else F.lit("unknown")
    out = rows.select(F.trim(code).alias("code"), label.cast("int").alias("label"), kept.alias("cwe"), language.alias("language"), F.lit(source).alias("source"))
    return out.where("length(code) >= 20 AND label IS NOT NULL")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unpivot_pairs(rows: DataFrame, bad: str, good: str, language: Column, languages: dict[str, str]) -> DataFrame:
    """A row with a flawed and a fixed text becomes two labelled rows; languages outside the map go."""
    x = rows.withColumn("language", lookup(language, languages)).where("language IS NOT NULL")
    pair = F.array(F.struct(F.col(bad).alias("code"), F.lit(1).alias("label")), F.struct(F.col(good).alias("code"), F.lit(0).alias("label")))
    rest = [c for c in x.columns if c not in (bad, good)]
    return x.select(*rest, F.explode(pair).alias("p")).select(*rest, "p.code", "p.label")


def path_labels(path: Column) -> dict[str, Column]:
    """cwe, language and vulnerable of a test file: by markers in its name, else by its directories. Null CWE if the path has none."""
    name, low = F.lower(F.element_at(F.split(path, "/"), -1)), F.lower(path)
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    cwe = F.nullif(F.regexp_extract(path, r"CWE(\d+)", 1), F.lit(""))
    return {"cwe": F.concat(F.lit("CWE"), cwe), "language": F.when(name.endswith(".java"), "java").otherwise("c_cpp"), "vulnerable": F.when(has(name, ["bad", "s01", "s02"]), True).when(F.contains(name, F.lit("good")), False).otherwise(F.contains(low, F.lit("bad")))}


def calibration_record(body: Column) -> dict[str, Column]:
    """threshold, alpha, n and temperature of a stored record; both spellings of the threshold are known, 1 without one."""
    r = F.from_json(body, "quantile_threshold double, threshold double, alpha double, n int, temperature double")
    return {"threshold": F.coalesce(r["quantile_threshold"], r["threshold"], F.lit(1.0)), "alpha": F.coalesce(r["alpha"], F.lit(0.1)), "n": F.coalesce(r["n"], F.lit(0)), "temperature": F.coalesce(r["temperature"], F.lit(1.0))}


def nearest_code(code: Column, codes: dict[str, float]) -> Column:
    """The language whose code is nearest; the first of equals."""
    pairs = F.array(*[F.struct(F.round(F.abs(code - c), 9).alias("gap"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, c) in enumerate(codes.items())])
    return F.array_min(pairs)["name"]
