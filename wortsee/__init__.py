"""Vocabulary lists from text collections, on PySpark."""


def ship(spark) -> None:
    """Send this package to the executors, where it is not installed there."""
    import shutil
    import tempfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    made = shutil.make_archive(str(Path(tempfile.mkdtemp()) / here.name), "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(made)
