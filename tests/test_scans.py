from workload import queries


def test_references_are_cleaned_once_for_tokens_and_lengths(spark, sf_dir):
    plan = queries.token_fraction(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 0 and "tokens" in plan
