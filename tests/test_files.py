from datetime import datetime, timedelta

from plumbline.sources import files
from plumbline.streaming import ledger


def test_qrels_header_blank_and_last_wins(spark, tmp_path):
    p = tmp_path / "q.tsv"
    p.write_text("query_id\tdoc_id\trelevance\nq1\td1\t1\n\nq1\td1\t3\nq2\td\tx\nshort\n")
    assert [tuple(r) for r in files.read_qrels(spark, str(p)).collect()] == [("q1", "d1", 3)]


def test_predictions_bad_lines(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"query_id": "a", "label": "NOVEL", "ok": true}\nbroken\n{"query_id": "a", "label": "PARTIAL", "ok": true}\n{"query_id": "b", "ok": true}\n')
    assert [tuple(r) for r in files.read_predictions(spark, str(p)).collect()] == [("a", "PARTIAL")]


def test_fasta_round_trip(spark, tmp_path):
    rows = [("s1", "patent", "US1", "long one", "ACGT" * 50), ("s2", "paper", "W2", "protein", "MKLV")]
    df = spark.createDataFrame(rows, "id string, source_type string, source_id string, description string, sequence string")
    files.write_fasta(df, f"{tmp_path}/f")
    got = sorted(tuple(r) for r in files.read_fasta(spark, f"{tmp_path}/f").collect())
    assert got == [(*rows[0], "NT"), (*rows[1], "AA")]


def test_checksums(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    r = files.checksums(spark, str(tmp_path)).first()
    assert r.bytes == 3 and r.sha256.startswith("ba7816bf")


def test_stream_equals_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t + timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(300)], "ts timestamp, k string, v double")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    got = ledger.totals(spark, f"{tmp_path}/in", "ts timestamp, k string, v double", f"{tmp_path}/out", f"{tmp_path}/ck", "ts", "k", "v")
    want = ledger.windowed(df, "ts", "k", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
