from catalith.operators import decisions as D
from catalith.streaming.decisions import replay


def test_log_and_stream_agree(spark, tmp_path):
    log, lines = tmp_path / "log", ['{"part_number": "1", "status": "approved"}', "{broken", '{"part_number": "2", "status": "corrected", "fields": {"series": "A"}}', '[1]', '{"part_number": "1", "status": "corrected", "fields": {"series": null}}']
    log.mkdir()
    (log / "a.json").write_text("\n".join(lines) + "\n")
    batch = {r.part_number: r.status for r in D.latest(D.read_log(spark, str(log))).collect()}
    assert batch == {"1": "corrected", "2": "corrected"}
    query = replay(spark, str(log), str(tmp_path / "table"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert {r.part_number: r.status for r in spark.read.parquet(str(tmp_path / "table/v0")).collect()} == batch
    (log / "b.json").write_text('{"part_number": "2", "status": "approved"}\n')
    query = replay(spark, str(log), str(tmp_path / "table"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert {r.part_number: r.status for r in spark.read.parquet(str(tmp_path / "table/v1")).collect()} == {"1": "corrected", "2": "approved"}


def test_append_adds_lines(spark, tmp_path):
    rows = spark.createDataFrame([("1", "approved")], "part_number string, status string")
    D.append(rows, str(tmp_path / "log"))
    D.append(rows, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
