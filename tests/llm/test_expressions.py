"""How large the expressions are that the driver holds for surrogates."""

from pyspark.sql import functions as F

from gridloom.llm import pii


def test_surrogates_are_written_once_in_a_plan(spark):
    rows = spark.createDataFrame([("name-f", "anna", 0)], "kind string, canonical string, draw int")
    atoms = F.array(F.struct(F.col("canonical").alias("word"), "kind", "canonical"))
    made = F.get(pii.surrogates(atoms, lambda kind, canonical: F.col("draw"), "key"), F.lit(0)).alias("made")
    plan = rows.select(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("XYZ234567") == 1 and len(plan) < 20_000


def test_draws_do_not_repeat_surrogates(spark, monkeypatch):
    sizes = []

    def noted(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("XYZ234567"))
        return df

    monkeypatch.setattr(pii, "checkpointed", noted)
    mentions = spark.createDataFrame([(["Anna Schmidt", "a@b.cd"], ["Schmidt"])], "mentions array<string>, known array<string>")
    assert pii.draws(mentions, "key").count() == 0 and max(sizes) == 1
