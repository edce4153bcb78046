"""Folders in any file system that Spark reaches (names, not contents)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm, self.path = spark, spark.sparkContext._jvm, path
        at = self._at("")
        self.system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path + ("/" + name if name else ""))

    def names(self) -> list[str]:
        if not self.system.exists(self._at("")):
            return []
        return sorted(x.getPath().getName() for x in self.system.listStatus(self._at("")))

    def has(self, name: str) -> bool:
        return self.system.exists(self._at(name))

    def delete(self, name: str) -> None:
        self.system.delete(self._at(name), True)

    def escaped(self, value: object) -> str:
        if value is None:
            return "__HIVE_DEFAULT_PARTITION__"
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))

    def unescaped(self, name: str) -> str | None:
        """The value of a ``column=value`` directory."""
        value = name.split("=", 1)[1]
        if value == "__HIVE_DEFAULT_PARTITION__":
            return None
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value)

    def below(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def make(self) -> None:
        self.system.mkdirs(self._at(""))

    def write(self, name: str, text: str) -> None:
        """A small file (a line or a document, not data)."""
        out = self.system.create(self._at(name), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def take(self, source: Folder, name: str, as_name: str) -> None:
        """Move a file of ``source`` here, in place of one of that name."""
        self.delete(as_name)
        if not self.system.rename(source._at(name), self._at(as_name)):
            raise OSError(f"{source.path}/{name} could not be moved to {self.path}/{as_name}")

    def read(self, name: str) -> str:
        """A small text file."""
        return self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(self.system.open(self._at(name))).decode("utf-8")
