"""What follows a provider isn't held to the few tasks that may call it."""

from siftline import plugins


def test_answers_are_dealt_anew(spark):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(23)], "id long, prompt string")
    got = plugins.run_stages(prompts, [plugins.verdict_provider(str.upper)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("RepartitionByExpression") < plan.find("MapInPandas")
    assert {(r.id, r.body) for r in got.collect()} == {(k, f"P{k}") for k in range(23)}
