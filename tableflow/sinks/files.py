"""Small driver-side file calls through the Hadoop file system of the session."""

from __future__ import annotations

from pyarrow import fs as filesystem
from pyspark.sql import SparkSession

# Files one task copies.
FILES_PER_TASK = 32


class Files:
    """Lists, reads, publishes and copies on whatever store a path lives on."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def is_file(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isFile()

    def names(self, path: str) -> list[str]:
        """Sorted entries of a folder, without hidden ones."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return []
        found = [status.getPath().getName() for status in fs.listStatus(at)]
        return sorted(name for name in found if not name.startswith("."))

    def size(self, path: str) -> int:
        """Bytes of all files below a folder."""
        fs, at = self._at(path)
        return fs.getContentSummary(at).getLength()

    def make_dirs(self, path: str) -> str:
        fs, at = self._at(path)
        fs.mkdirs(at)
        return path

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write ``text`` under a hidden name, then rename: readers see all of it or none."""
        fs, at = self._at(path)
        hidden = self._fs.Path(at.getParent(), f".{at.getName()}.tmp")
        stream = fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return fs.rename(hidden, at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def copy_tree(self, source: str, target: str) -> None:
        """Copy all files below a folder, shared out over tasks; only their names pass the driver."""
        fs, at = self._at(source)
        root = fs.makeQualified(at).toUri().getPath()
        found = fs.listFiles(at, True)
        names = []
        while found.hasNext():
            names.append(found.next().getPath().toUri().getPath()[len(root) + 1 :])
        if not names:
            return
        copied_from, copied_to = self._address(source), self._address(target)

        def copy(parts):
            for part in parts:
                for name in part["name"]:
                    (reader, start), (writer, end) = (filesystem.FileSystem.from_uri(a) for a in (copied_from, copied_to))
                    if isinstance(writer, filesystem.LocalFileSystem):
                        writer.create_dir(f"{end}/{name}".rsplit("/", 1)[0], recursive=True)
                    filesystem.copy_files(f"{start}/{name}", f"{end}/{name}", reader, writer)
                yield part

        listed = self.spark.createDataFrame([(n,) for n in names], "name string")
        tasks = listed.repartition(1 + len(names) // FILES_PER_TASK)
        tasks.mapInPandas(copy, "name string").write.format("noop").mode("overwrite").save()

    def _address(self, path: str) -> str:
        """A path as tasks address it: plain for a mounted folder, else with scheme and host."""
        fs, at = self._at(path)
        uri = fs.makeQualified(at).toUri()
        return uri.getPath() if uri.getScheme() == "file" else uri.toString()
