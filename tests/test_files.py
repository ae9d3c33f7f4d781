"""Queries that write files and read them back, on tables of their own."""

from cadenza.plans import files


def test_each_document_is_a_file(spark, tmp_path):
    rows = [(k, "src1" if k % 3 else "src2") for k in range(60)] + [(60, None), (61, None), (62, ""), (63, "a b/c=%41+é"), (64, "x")]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: r["files"] for r in files.file_scan(spark, str(tmp_path)).collect()}
    assert got == {"src1": 40, "src2": 20, None: 2, "": 1, "a b/c=%41+é": 1, "x": 1}
