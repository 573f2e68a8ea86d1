"""Gives executors the code of this subpackage, by way of the shared folder."""

import io
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession

import coursebeacon
from coursebeacon.session import work_path

_shipped: set[str] = set()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that Spark names by URI or by plain path."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def ship(spark: SparkSession) -> SparkSession:
    """Python functions of operators are found by name on the executors from here on."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(coursebeacon.__file__).parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for path in [root / "__init__.py", root / "session.py", *sorted((root / "llm").glob("*.py"))]:
                archive.write(path, path.relative_to(root.parent))
        folder = work_path(spark, "code")
        store, path = filesystem(folder)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/coursebeacon_llm.zip") as out:
            out.write(packed.getvalue())
        context.addPyFile(f"{folder}/coursebeacon_llm.zip")
        _shipped.add(context.applicationId)
    return spark
