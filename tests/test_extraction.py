import os

from quillon.sources import extraction


def asking(folder, broken=()):
    """A service that writes down what it is asked, and fails for some."""

    def call(prompt):
        with open(os.path.join(folder, "calls"), "a") as f:
            f.write(f"{prompt}\n")
        if prompt in broken:
            raise TimeoutError(f"no answer to {prompt}")
        return None if prompt == "nothing" else f"so ```yaml\nname: {prompt}\n``` it is"

    return call


def calls(folder):
    with open(os.path.join(folder, "calls")) as f:
        return sorted(f.read().split())


def test_runs_go_on(spark, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "out")
    prompts = spark.createDataFrame([(f"n{i}", f"p{i}") for i in range(20)] + [("n0", "p0"), ("none", "nothing"), (None, "nobody"), ("empty", None)], "name string, prompt string")
    assert extraction.results(spark, path).count() == 0 and extraction.failures(spark, path).count() == 0
    first = extraction.run(prompts, asking(folder, ("p3", "p7")), path, attempts=3)
    assert first.count() == 23 and first.filter("error IS NOT NULL").count() == 3
    assert sorted((r["name"], r["error"]) for r in extraction.failures(spark, path).collect()) == [("n3", "TimeoutError: no answer to p3"), ("n7", "TimeoutError: no answer to p7"), ("none", "no text: None")]
    assert len(calls(folder)) == 22  # the empty prompt is a blank line
    assert extraction.run(prompts, asking(folder, ("p7",)), path).count() == 3
    bodies = {r["name"]: r["body"].strip() for r in extraction.results(spark, path).collect()}
    assert len(bodies) == 21 and bodies["n3"] == "name: p3" and bodies[None] == "name: nobody"
    assert extraction.run(prompts, asking(folder), path, attempts=2).count() == 0
    assert extraction.run(prompts, asking(folder), path, attempts=3).count() == 2  # p7 is answered at last
    assert extraction.run(prompts, asking(folder), path, attempts=3).count() == 0
    assert [r["name"] for r in extraction.failures(spark, path).collect()] == ["none"]
    changed = prompts.filter("name = 'n1'").withColumn("prompt", extraction.F.lit("other"))
    assert extraction.run(changed, asking(folder), path).count() == 1
    asked = calls(folder)
    assert max(asked.count(f"p{i}") for i in range(20) if i not in (3, 7)) == 1 and asked.count("p7") == 3 and asked.count("nothing") == 3
