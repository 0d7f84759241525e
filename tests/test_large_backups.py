import json

from mnemora.sources.backups import parse_backups, source_records


def test_a_backup_of_more_than_30_mb_gives_its_records(spark):
    records = [{"id": f"s{k}", "note": "x" * 1_000_000} for k in range(33)]
    text = json.dumps({"format": "test-backup", "backupVersion": 5, "data": {"records": records}})
    assert len(text) > 30 * 1024 * 1024
    backups = spark.createDataFrame([("m-1", text)], "migration_id string, text string")
    parsed = parse_backups(backups)
    assert [r.error for r in parsed.select("error").collect()] == [None]
    assert source_records(parsed).count() == len(records)
    assert [r.error for r in parse_backups(backups, max_text=1_000).select("error").collect()] == ["FILE_TOO_LARGE"]
