import os

DATA = os.environ.get("WEFTLINE_TEST_DATA", "/root/testdata/sf0.001")


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")
