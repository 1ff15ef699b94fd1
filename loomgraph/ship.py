"""Send this package to the executors of a session."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once per application: executors can then import the package, whatever their own paths are."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="loomgraph-ship-")) / "loomgraph.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, f"{_PACKAGE.name}/{path.relative_to(_PACKAGE)}")
    context.addPyFile(str(name))
    context._loomgraph_shipped = True
