"""Operators on input that isn't a plain scan: a join whose partitions are coalesced at run time, so that two evaluations can number rows differently."""

import pytest

from siftline.llm import exact_dedup, pii_surrogates, sentence_spans, simhash, temperature_mix

SETTINGS = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64",
}


@pytest.fixture(scope="module")
def joined(spark, sf):
    old = {k: spark.conf.get(k) for k in SETTINGS}
    for k, x in SETTINGS.items():
        spark.conf.set(k, x)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = docs.select("doc_id", "text").join(docs.drop("text"), "doc_id").select(*docs.columns)
    yield docs, both
    for k, x in old.items():
        spark.conf.set(k, x)


def rows(df, *columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


def test_a_joined_input_gives_the_result_of_the_scan(joined):
    docs, both = joined
    assert rows(exact_dedup.drop_exact_copies(both), "doc_id") == rows(exact_dedup.drop_exact_copies(docs), "doc_id")
    assert rows(exact_dedup.exact_groups(both), "doc_id", "keep_id", "group_size", "kept") == rows(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    assert rows(simhash.drop_near_copies(both), "doc_id") == rows(simhash.drop_near_copies(docs), "doc_id")
    assert rows(pii_surrogates.replace_entities(both), "doc_id", "text", "kinds") == rows(pii_surrogates.replace_entities(docs), "doc_id", "text", "kinds")
    assert rows(sentence_spans.remove_repeats(both), "doc_id", "text") == rows(sentence_spans.remove_repeats(docs), "doc_id", "text")
    assert rows(temperature_mix.mixed_documents(both), "doc_id") == rows(temperature_mix.mixed_documents(docs), "doc_id")
