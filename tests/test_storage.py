from pathlib import Path

from palimp import storage


def test_clean_deletes_what_was_written(spark):
    storage.clean(spark)
    df = storage.written(spark.range(10), "test")
    path = Path(df._palimp_path.removeprefix("file://"))
    assert df.count() == 10 and path.exists() and not list(path.glob("*.crc"))
    storage.forget(df)
    other = storage.fresh_dir(spark, "never-made")
    assert not path.exists() and storage.clean(spark) == 2 and storage.clean(spark) == 0 and not Path(other.removeprefix("file://")).exists()
