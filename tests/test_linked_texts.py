"""Equal questions are read once, and each gets the names of its text."""

from quern.operators import retrieval as R


def made(spark):
    nodes = spark.createDataFrame([("n2", "Part", "red pin"), ("n1", "Part", "red pin"), ("n3", "Group", "pin"), ("n4", "Part", None)], "id string, label string, title string")
    asked = [(1, "Who sells red pin?"), (2, "Who sells red pin?"), (3, "a pin, a red pin"), (4, "nothing"), (5, None)]
    return R.linked(spark.createDataFrame(asked, "question_id int, question string"), R.variants(nodes))


def test_each_question_gets_its_texts_names(spark):
    got = sorted(map(tuple, made(spark).collect()))
    assert got == [(1, 0, "n1", "red pin"), (2, 0, "n1", "red pin"), (3, 0, "n1", "red pin"), (3, 1, "n3", "pin")]


def test_runs_are_made_once_for_a_text(spark):
    plan = made(spark)._jdf.queryExecution().analyzed().toString()
    runs = plan.index("Generate explode(flatten(transform(sequence(1")
    assert "Deduplicate [question" in plan[runs:] or "Distinct" in plan[runs:]
