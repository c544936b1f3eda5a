import random

from docweave.llm import truncation


def test_a_limit_that_few_of_a_source_meet(spark):
    rnd = random.Random(5)
    rows = [(i, "s", "x" * (int(rnd.lognormvariate(6.5, 0.6)) + 1) + ".") for i in range(3000)]
    rows += [(5000 + i, "s", ("The index was moved and the archive\n" * 30)[:700]) for i in range(40)]  # 1.3 %
    df = spark.createDataFrame(rows, "id long, source string, text string")
    sizes = {r["size"]: r["censored"] for r in truncation.Truncation(df, key="id").limits.collect()}
    assert sizes[700] > 0.8 and len(sizes) <= 2


def test_pieces_and_small_words_at_line_ends(spark):
    """Whole items stay, items that stop inside a word or at a word that ends no line are cut."""
    items = ["restore the snapshot", "publish the guide", "document the exception", "name the Reviewers"]
    prose = "The snapshot of the archive was restored by the Reviewers and the guide had an exception."
    rnd = random.Random(1)  # lengths of all kinds, as equal ones would be limits
    rows = [(i, "s", f"{'The index was full. ' * rnd.randrange(60)}{'x' * rnd.randrange(1, 40)} was here. {prose}\n\n- {items[i % 4]}\n- {items[(i + 1) % 4]}") for i in range(400)]
    cut = {1000: "- restore the", 1001: "- restore the snaps", 1002: "- name the Revie"}
    rows += [(k, "s", f"{prose * (k - 998)}\n\n- publish the guide\n{v}") for k, v in cut.items()]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    assert {r["id"] for r in truncation.Truncation(df, key="id").found().collect()} == set(cut)
