"""Co-occurrence of values and words is that of whole texts."""

from kinelink.llm import pii
from kinelink.llm.tables import checkpointed, row_key


def test_words_are_summed_before_they_meet_the_terms(spark):
    """The join of words and terms gets a word once, however many tasks have counted it."""
    docs = spark.createDataFrame([(f"red green w{i}",) for i in range(40)], "text string").repartition(8)
    counted = pii.term_documents(docs, spark.createDataFrame([("red",), ("green",), ("absent",)], "term string"))
    assert {r.term: r.n_term for r in counted.collect()} == {"red": 40, "green": 40}
    plan = [line.lstrip(" :+-*").split("(")[0].split(" ")[0] for line in counted._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert "Join" in plan and plan.index("Join") < plan.index("Aggregate")


def test_terms_far_from_a_value_disclose_it(spark):
    filler = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Zorblat {filler} note {i} z@mail.org") for i in range(5)] + [(10 + i, f"the {filler} note {i}") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(rows[0][1]) - len("z@mail.org")
    assert got[0] == f"term:0:7,email:{at}:{at + 10}" and got[10] == ""


def test_a_text_meets_only_the_terms_that_stand_in_it(spark):
    """A thousand texts of the pooled entity, each with its own words: an entity's terms and its texts are not multiplied."""
    value = lambda i: f"q{i:03d}Zr8KwT5mXb2LcV9n{i:04d}JhGdFsA"
    rows = [(i, f"alpha{i // 4} beta{i // 4} = {value(i)}") for i in range(1000)] + [(2000 + i, f"plain words {i}") for i in range(1000)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", row_key("text").alias("key"), "text")
    found = checkpointed(keyed.mapInArrow(pii._find, pii._FOUND))
    every = [(pii.SECRET, f"{w}{i}") for i in range(250) for w in ("alpha", "beta")]
    held = pii.held_terms(found, spark.createDataFrame(every, "entity string, term string")).collect()
    assert {r.doc_id: sorted(x.term for x in r.held) for r in held} == {i: [f"alpha{i // 4}", f"beta{i // 4}"] for i in range(1000)}
