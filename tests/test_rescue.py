"""Chapters from prose where rule lines repeat, titles are wrapped and blocks keep their raw lines."""

from leafwright.operators import rescue


def lines(spark, *texts):
    return spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "book long, chapter long, block long, text string")


def test_repair_steps_over_any_number_of_rules(spark):
    df = lines(spark, "CHAPTER 1", "-----", "=====", "The Real Title", "Prose.", "CHAPTER 2", "No rule", "CHAPTER 3", "-----", "A sentence.", "CHAPTER 4", "-----")
    assert [r["title"] for r in rescue.repair_titles(df).orderBy("block").collect()] == ["CHAPTER 1 The Real Title", "CHAPTER 2", "CHAPTER 3", "CHAPTER 4"]


def test_cut_joins_a_wrapped_title(spark):
    df = lines(spark, "before", "CHAPTER 1", "", "-----", "=====", " The Real Title", "Prose one.", "more", "CHAPTER 2. Long enough", "Not title", "CHAPTER 3", "CHAPTER 4", "A sentence.")
    got = [(r["part"], r["title"], r["body"]) for r in rescue.cut_at_titles(df).orderBy("part").collect()]
    assert got == [(0, None, "before"), (1, "CHAPTER 1 The Real Title", "Prose one. more"), (2, "CHAPTER 2. Long enough", "Not title"), (3, "CHAPTER 3", ""), (4, "CHAPTER 4", "A sentence.")]


def test_titles_inside_large_raw_blocks_count(spark):
    raw = "CHAPTER 1\n" + "word " * 900 + "\nCHAPTER 2\nend"
    rows = [(1, 1, 0, raw.replace("\n", " "), raw, False), (1, 1, 1, "CHAPTER 3", None, False), (1, 1, 2, "short CHAPTER 4", "short\nCHAPTER 4", False), (1, 1, 3, "CHAPTER 5", None, True)]
    df = spark.createDataFrame(rows, "book long, chapter long, block long, text string, raw string, dedup boolean")
    assert rescue.count_markers(df).first()["markers"] == 3
    assert rescue.predicate(df, 100, 12_000, 3).first()["rescued"]
