from pyspark.sql import functions as F


def blocks_frame(spark, items, title="A Title", metadata=None):
    """One document from (type, text) pairs."""
    rows = [(1, title, [(i, t, x) for i, (t, x) in enumerate(items)], metadata or [])]
    return spark.createDataFrame(
        rows,
        "doc_id long, title string, blocks array<struct<pos:int,type:string,text:string>>, metadata array<string>",
    )


def texts(df, column="blocks"):
    return [b["text"] for b in df.select(column).first()[0]]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def lit_array(values):
    return F.array(*[F.lit(v) for v in values])
