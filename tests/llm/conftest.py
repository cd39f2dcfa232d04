import pytest

EDGE = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "b", 4),
    (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 80),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 80),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 80),
    (None, "No id here, but a mail a.b@c.example.org and +1 (555) 010-9999.", None, None, None),
    (7, "Ünïcode 𝔘𝔫𝔦 wörter — ok. 10.0.0.255 and 10.0.0.256; 4111 1111 1111 1111!", "de", "c", 70),
    (8, "x@y.z_q@r.s 1.2.3.4.5 a a a a a a a a a a a a a", "en", "c", 50),
    (9, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "en", "c", 70),
    (10, "long " * 30_000, "en", "a", 150_000),
]


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The smallest documents and the edge cases, with columns whose names operators might use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    both = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    edge = spark.createDataFrame(EDGE, schema)
    both = both.selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars").union(edge)
    names = "key t w label value row id tie domain tokens rest whole buckets bucket before end spot epoch marks lead node fp low n to child at keys values kind train place _key _marks _lead _domain _lang _source _tokens own lines found budget given".split()
    return both.selectExpr("*", *[f"'{n}' as {n}" for n in names]).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
