import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats, a missing id and columns named like the operators' own."""
    rows = [
        (1, "the cat sat on the mat and the dog ran to the house of the old man", "en", "a"),
        (2, "the cat sat on the mat and the dog ran to the house of the old man", "en", "a"),
        (3, None, "en", "a"), (4, "", None, None), (5, "x", "de", "b"),
        (6, "der Hund und die Katze gehen in das Haus mit der alten Frau und dem Kind", "de", "b"),
        (7, " ".join(f"word{i} runs" for i in range(20000)), "en", "b"), (8, " \n\t ", "fr", "b"),
        (None, "no id here but a text of several plain words for all", "en", "a"),
        (1, "the cat sat on the mat and the dog ran to the house of the old man", "en", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({
        "n_chars": F.length("text").cast("long"), "Score": F.lit("own"), "fingerprint": F.lit(0.5), "ids": F.lit("own"),
        "pii": F.lit(1), "host": F.lit("h"), "n_tokens": F.lit("own"), "kept": F.lit("own"), "_t": F.lit(1)})
