import tempfile

from assaykit.operators.rows import with_partition_row_index
from assaykit.sources.files import scan_csv_raw


def test_partition_row_index_is_contiguous(spark):
    df = spark.range(0, 500, 1, 7).repartition(5, "id")
    out = with_partition_row_index(df, "ri", materialize=True)
    assert sorted(r.ri for r in out.collect()) == list(range(500))


def test_csv_raw_keeps_file_positions_and_duplicate_headers(spark):
    d = tempfile.mkdtemp(prefix="assaykit-csv-")
    with open(f"{d}/a.csv", "w", encoding="utf-8") as f:
        f.write('Sequence,M.W.,Source,Source \n')
        for i in range(50):
            f.write(f'"AC\nDE{i}",{i} Da,s{i},t{i}\n')
    df = scan_csv_raw(spark, f"{d}/a.csv")
    assert df.columns == ["sequence", "mw", "Source", "Source__dup1", "source_row_index"]
    rows = sorted(df.collect(), key=lambda r: r.source_row_index)
    assert [r.source_row_index for r in rows] == list(range(50))
    assert all(r.mw == f"{r.source_row_index} Da" for r in rows)
