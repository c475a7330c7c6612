from pyspark.sql import functions as F

from quillstone.functions import tables as S, text as T


def test_tables(spark):
    S.register(spark)
    got = spark.sql("select c.uri from values ('enligt 3 § BrB och NJA 2013 s. 502'), (null) t(x), lateral citations(x) c order by c.start").collect()
    assert [r.uri for r in got] == ["1962:700#P3", "dom/nja/2013s502"]
    one = spark.range(1).select(
        S.inline_runs(F.array(F.struct(F.lit("a ").alias("text"), F.lit(None).cast("string").alias("uri")), F.struct(F.lit("b").alias("text"), F.lit("u").alias("uri")))).alias("runs"),
        S.first_start(F.lit(" Unsupported: x"), ["un", "unsupported", "supported"]).alias("first"),
        S.framed(F.lit("x"), F.lit("k"), ["<{}>"]).alias("framed"),
        S.pair_problem(F.lit(600), F.lit(10)).alias("problem"),
    ).first()
    assert tuple(one) == ("a [b](u)", "unsupported", "<x>", "unit_too_long")
    text = " ".join(f"Mening {i} har några ord till." for i in range(40))
    parts = spark.createDataFrame([(text,)], "t string").select(S.overlapping_passages(F.col("t"), 60).alias("p"), F.transform(S.overlapping_passages(F.col("t"), 60), T.token_estimate).alias("n")).first()
    assert max(parts.n) <= 60 and len(parts.p) > 3
    for a, b in zip(parts.p, parts.p[1:]):
        assert b.startswith("Mening" + a.split("Mening")[-1])
