from __future__ import annotations

import pytest


@pytest.fixture(scope="module")
def awkward(spark):
    """Documents with null and repeated rows, ties, empty and long texts, and clashing columns."""
    words = " ".join(f"word{i % 97}x{i % 89}" for i in range(30000))
    rows = [
        (1, "The same text here for all of us", "a", 9), (2, "the SAME text here for all of us", "b", 9),
        (2, "the SAME text here for all of us", "b", 9), (3, None, None, None), (4, "", "a", 0), (None, "", "a", 0),
        (None, "the same text here for all of us", "a", 1), (5, "Ünïcödé ÀÉ text 😀", "a", 3), (6, "ünïcödé ÀÉ text 😀", "a", 3),
        (7, words, "a", 1), (8, words + " tail", "a", 1), (9, "x" * 70000, "a", 1), (10, "   \n\t ", "a", 1), (11, "one two", "a", 1), (12, "One, two!", "a", 1),
    ]
    schema = "doc_id long, text string, keep_id string, score int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, id int")
