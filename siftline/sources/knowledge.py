"""CVE and CWE records: reading their published formats, and the corpus made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import fixed

CVE_SCHEMA = """id string, published string, lastModified string, descriptions array<struct<lang:string,value:string>>, weaknesses array<struct<description:array<struct<value:string>>>>,
metrics struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>,cvssMetricV30:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>>, references array<struct<url:string>>"""


#: Strings of any length: a parser that is left alone rejects a record for one of over 20 million characters.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def parse_cve(rows: DataFrame, json_col: str = "json", blank: bool = False) -> DataFrame:
    """(id, description, cwe_ids, score, severity, references, published, last_modified) of CVE objects as JSON text.

    The English description, else the first; weakness values that begin with CWE-; the v3.1 score, else v3.0. Rows without a
    description, or without an object, are left out. With blank, an English description counts as it is, empty or null too, and its row stays.
    """
    x = rows.select(F.from_json(json_col, CVE_SCHEMA, ANY_LENGTH).alias("c")).select("c.*")
    english, first = F.try_element_at(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(1)), F.try_element_at("descriptions", F.lit(1))["value"]
    text = F.when(english.isNotNull(), english["value"]).otherwise(first) if blank else F.coalesce(F.nullif(english["value"], F.lit("")), first)
    data = [F.try_element_at(F.col(f"metrics.cvssMetricV{n}"), F.lit(1))["cvssData"] for n in ("31", "30")]
    newer = data[0]["baseScore"].isNotNull()
    values = F.flatten(F.transform(F.coalesce("weaknesses", F.array()), lambda w: F.transform(w["description"], lambda d: d["value"])))
    out = x.select(
        "id", "descriptions", text.alias("description"), F.filter(values, lambda c: c.startswith("CWE-")).alias("cwe_ids"),
        F.when(newer, data[0]["baseScore"]).otherwise(data[1]["baseScore"]).alias("score"), F.when(newer, data[0]["baseSeverity"]).otherwise(data[1]["baseSeverity"]).alias("severity"),
        F.filter(F.transform(F.coalesce("references", F.array()), lambda r: r["url"]), lambda u: u != "").alias("references"), F.try_to_timestamp(F.col("published")).alias("published"), F.try_to_timestamp(F.col("lastModified")).alias("last_modified"),
    )
    return out.where("size(descriptions) > 0" if blank else "description <> ''").drop("descriptions")


CWE_SCHEMA = """_ID string, _Name string, Description string, Detection_Methods struct<Detection_Method:array<struct<Method:string,Description:string>>>, Potential_Mitigations struct<Mitigation:array<struct<Description:string>>>,
Related_Weaknesses struct<Related_Weakness:array<struct<_CWE_ID:string>>>, Common_Consequences struct<Consequence:array<struct<Scope:array<string>,Impact:array<string>>>>"""


def _cwe_rows(x: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return x.select(
        F.concat(F.lit("CWE-"), "_ID").alias("id"), F.col("_Name").alias("name"), F.trim("Description").alias("description"),
        F.coalesce(F.transform("Detection_Methods.Detection_Method", lambda m: F.concat_ws(": ", m["Method"], F.trim(m["Description"]))), none).alias("detection_methods"),
        F.coalesce(F.transform("Potential_Mitigations.Mitigation", lambda m: F.trim(m["Description"])), none).alias("mitigations"),
        F.coalesce(F.transform("Related_Weaknesses.Related_Weakness", lambda r: F.concat(F.lit("CWE-"), r["_CWE_ID"])), none).alias("related"),
        F.coalesce(F.transform("Common_Consequences.Consequence", lambda c: F.concat_ws(": ", F.array_join(c["Scope"], ", "), F.array_join(c["Impact"], ", "))), none).alias("consequences"),
    )


def read_cwe_xml(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description, detection_methods, mitigations, related, consequences) of catalogue files in XML."""
    return _cwe_rows(spark.read.format("xml").option("rowTag", "Weakness").schema(CWE_SCHEMA).load(path))


def parse_cwe_xml(rows: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The same of rows that hold an element each; those that hold none are left out."""
    return _cwe_rows(rows.select(F.from_xml(xml_col, CWE_SCHEMA).alias("w")).select("w.*")).where("id IS NOT NULL")


def known_cwes(spark: SparkSession) -> DataFrame:
    """(id, name, description) of the CWEs in the category table."""
    return spark.createDataFrame([(f"CWE-{n}", k, k) for k, ns in fixed.OWASP.items() for n in ns], "id string, name string, description string")


def corpus(cwes: DataFrame, cves: DataFrame) -> DataFrame:
    """(type, id, text) of both: `id name: description`, and `id (cwes, CVSS: score): description`."""
    score = F.coalesce(F.nullif(F.col("score"), F.lit(0.0)).cast("string"), F.lit(""))
    a = cwes.select(F.lit("cwe").alias("type"), "id", F.concat("id", F.lit(" "), "name", F.lit(": "), "description").alias("text"))
    b = cves.select(F.lit("cve").alias("type"), "id", F.concat("id", F.lit(" ("), F.array_join("cwe_ids", ", "), F.lit(", CVSS: "), score, F.lit("): "), "description").alias("text"))
    return a.unionByName(b)


def save(corpus_rows: DataFrame, path: str) -> None:
    """The corpus as Parquet, by type."""
    corpus_rows.write.mode("overwrite").partitionBy("type").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metadata(corpus_rows: DataFrame) -> DataFrame:
    """One row of counts."""
    return corpus_rows.agg(F.count("*").alias("documents"), F.count_if(F.col("type") == "cwe").alias("cwes"), F.count_if(F.col("type") == "cve").alias("cves"))
