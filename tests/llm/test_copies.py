from pyspark.sql import functions as F

from kildespor.llm import copies

SCHEMA = "id bigint, text string, scope string, copies int"  # columns with the operator's own names don't matter


def test_copies(spark, rows):
    long = "ab " * 100_000
    df = spark.createDataFrame(
        [(1, "Og, han sagde", "x", 0), (2, "OG HAN​ sagde!", "y", 0), (3, "og han sagde 1", "", 0), (4, None, "", 0), (5, "", "", 0), (6, " .,", "", 0), (7, long, "", 0), (8, long.upper(), "", 0), (9, "sagde han og", None, 0), (2, "OG HAN​ sagde!", "y", 0)],
        SCHEMA,
    )
    assert rows(copies.copies_found(df, "id", F.col("text")), "first_id", "copy_id") == [(1, 2), (7, 8)]
    assert rows(copies.collapsed(df, "id", F.col("text")), "id", "copies") == [(1, 3), (3, 1), (7, 2), (9, 1)]
    scoped = copies.copies_found(df, "id", F.col("text"), F.col("scope"))
    assert rows(scoped, "first_id", "copy_id") == [(7, 8)]  # the two of scope y are one id


def test_no_copies_in_an_empty_table(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert rows(copies.copies_found(none, "id", F.col("text"))) == [] and rows(copies.collapsed(none, "id", F.col("text"))) == []


def test_a_group_of_a_third_of_all_rows(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "Same, text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    found = copies.copies_found(df, "id", F.col("text"))
    assert found.count() == 19_999 and found.where("first_id <> 0").count() == 0


def test_records_of_lines(spark, rows):
    verses = spark.createDataFrame([], "verse_index bigint, text string")
    payloads = [
        '{"book": "1van", "chapter": 2, "verse": 3, "text": "Å\\u00e5 a"}', '{"text":"åå A.","verse":"03","chapter":"2","book":"1VAN"}', '{"book": "1van", "chapter": 2, "verse": 4, "text": "åå a"}',
        '{"book": "1van", "verse": 3, "text": "åå a"}', "no json", None, '{"book": "1van", "chapter": "x", "verse": 3, "text": "åå a"}'
    ]
    lines = spark.createDataFrame(list(enumerate(payloads)), "line_id bigint, payload string")
    df = copies.verse_rows(verses, lines)
    assert rows(copies.copies_found(df, "id", F.col("text"), F.col("scope")), "first_id", "copy_id") == [(0, 1)]
