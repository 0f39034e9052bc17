"""Small tables for the operators' edge cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, langs=None, ids=None):
    n = len(texts)
    rows = [
        (ids[i] if ids else i, texts[i], langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(texts[i] or ""))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns with names that an operator could use itself."""
    from pyspark.sql import functions as F

    extra = "row key size source_size target taken fp chunk recipe of last bucket TEXT Doc_ID kept spans score label".split()
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
