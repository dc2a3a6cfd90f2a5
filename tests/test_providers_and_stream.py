import datetime as dt

from pyspark.sql import functions as F

from lossgrid.sources import matrix, providers
from lossgrid.streaming import intake_stream


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a", "secret"), (2, "bad", "secret"), (3, "c", "secret")], "id int, text string, vault string")

    def make():
        def call(pdf):
            assert list(pdf.columns) == ["text"]
            return pdf["text"].str.upper()

        return call

    got = providers.Model(make, ("id",), "out").apply(rows, ("text",))
    assert {r.id: r.out for r in got.collect()} == {1: "A", 2: "BAD", 3: "C"}

    def broken():
        def call(pdf):
            raise RuntimeError

        return call

    assert {r.out for r in providers.Model(broken, ("id",), "out").apply(rows, ("text",), failed="").collect()} == {""}
    table = spark.createDataFrame([(1, "yes")], "id int, verdict string")
    assert {r.id: r.verdict for r in providers.Answers(table, ("id",), "verdict").apply(rows, failed="none").collect()} == {1: "yes", 2: "none", 3: "none"}


def test_matrix_loader(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"FIRE": {"description": "x", "blocking": [{"document": "Report", "doc_type": "FIR", "condition": "", "collection_by": "soon"}], "mandatory": [], "recommended": [{"document": "Bill", "doc_type": "BILL", "condition": "c", "collection_by": "later"}]}}')
    got = matrix.load_document_matrix(spark, str(tmp_path / "m.json")).orderBy("row_pos").collect()
    assert [(r.incident_type, r.criticality, r.doc_type) for r in got] == [("FIRE", "BLOCKING", "FIR"), ("FIRE", "RECOMMENDED", "BILL")]
    assert matrix.document_matrix(spark).count() == len(matrix.rows()) == 34


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 6, 2, 9)
    rows = [(i, dt.date(2024, 6, 1), dt.date(2024, 5, 1) + dt.timedelta(i), 30, at - dt.timedelta(hours=i)) for i in range(40)]
    df = spark.createDataFrame(rows, intake_stream.CLAIM)
    df.write.parquet(f"{tmp_path}/in")
    as_of = F.lit(at)
    intake_stream.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", as_of).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(intake_stream.assess(df, as_of)).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
