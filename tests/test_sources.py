"""Sinks and encodings."""

import pytest

from quillspark.sources import files


def test_rewritten_documents_keep_their_encoding(spark, tmp_path):
    rows = [("ro/a.md", "cp1250", "șah — țară"), ("ro/b/c.md", "cp1250", "straße"), ("d.md", None, "漢"), ("e.md", "nonsense", ""), (None, "utf-8", "x"), ("../out.md", "utf-8", "x"), ("f.md", "utf-8", None), ("g.md", "utf-16", "ab")]
    df = spark.createDataFrame(rows, "relative_path string, encoding string, text string")
    got = {r.relative_path: (r.encoding, r.content) for r in files.encoded_documents(df).collect()}
    assert got["ro/b/c.md"] == ("cp1250", "straße".encode("cp1250")) and got["ro/a.md"][0] == "utf-8" and got["d.md"][0] == "utf-8" and got["f.md"] == (None, None)
    root = f"{tmp_path}/new"
    assert files.write_documents(files.encoded_documents(df), root) == 5
    assert (tmp_path / "new/ro/a.md").read_bytes().decode() == "șah — țară" and (tmp_path / "new/e.md").read_bytes() == b"" and not (tmp_path / "out.md").exists()
    assert files.decode((tmp_path / "new/g.md").read_bytes())[0] == "ab"
    with pytest.raises(FileExistsError):
        files.write_documents(files.encoded_documents(df), root)


def test_bulk_write(spark, tmp_path):
    files.write_bulk(spark.range(100).coalesce(1), f"{tmp_path}/t", 30)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 4 and spark.read.parquet(f"{tmp_path}/t").count() == 100
    with pytest.raises(ValueError):
        files.scan_jdbc(spark, "jdbc:x", "t", "id", 5, 5, 3)
