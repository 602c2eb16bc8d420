"""Rows that every operator on texts has to take: nulls, empty and long texts, ties, repeated rows, foreign columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    """Documents 0, 1, ... of texts, with other columns null."""
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def odd(spark, **more):
    """A null id, a null text, empty texts, white space, a long text and a repeated row."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(None, "no id here", None, None, None), (1, None, "en", "a", 1), (2, "", None, None, 0), (3, " \n\t ", None, None, None), (4, long, None, None, None), (5, "same row twice", None, None, None), (5, "same row twice", None, None, None), (6, "ünï çödé 漢字 \U0001f600", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def saved(df, folder, name):
    """The folder, with df as one of its tables."""
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
