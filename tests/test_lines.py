"""Lines of word boxes, also very long ones."""

from veilspan.operators.boxes import line_texts, word_lines


def test_a_line_costs_in_proportion_to_its_words(spark):
    """40,000 words in one line: an array of the line per word would be 1.6 billion numbers."""
    n = 40_000
    words = spark.range(n).selectExpr("1 as image_id", "1 as line", "'ab' as text", "id * 30 as x", "20 as w")
    assert line_texts(word_lines(words)).first()["text"] == " ".join(["ab"] * n)


def test_odd_lines_keep_their_texts(spark):
    rows = [(None, 1, "a", 0, 5), (None, 1, "bb", 11, 30), (1, 1, "c", 0, None), (1, 1, "d", 9, None), (2, 1, "e", 0, 9), (2, 1, "f", 13, None)]
    words = spark.createDataFrame(rows, "image_id int, line int, text string, x int, w int")
    assert {(r["image_id"], r["text"]) for r in line_texts(word_lines(words)).collect()} == {(None, "abb"), (1, "cd"), (2, "ef")}
