"""A streaming source for text files that grow.

The file source of the engine takes a path once; this one remembers a byte offset a file. Each
micro-batch is split by file, and the executors read their byte ranges themselves. A line counts
as soon as its line feed is there, so a torn tail is read with the batch that completes it.
"""

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tokenloom.sources.files import PIECE, file_system, lines_of


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        super().__init__(None)
        self.path, self.begin, self.end = path, begin, end


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _files(self) -> dict[str, list[int]]:
        """Size and time of change of each file."""
        system, path = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        ours = [f for f in found if f.type == fs.FileType.File and f.path.endswith(".jsonl") and "/archived_sessions/" not in f.path]
        scheme = self.folder.partition("://")[0] + "://" if "://" in self.folder else ""
        return {scheme + f.path: [f.size, f.mtime_ns or 0] for f in sorted(ours, key=lambda f: f.path)}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": self._files()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, (size, changed) in end["files"].items():
            begin, before = start["files"].get(path, (0, 0))
            # A file that shrank, or changed without growing, was replaced and is read from its start.
            begin = 0 if size < begin or size == begin and changed != before else begin
            out += [Range(path, at, min(at + PIECE, size)) for at in range(begin, size, PIECE)]
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        for offset, line in lines_of(partition.path, partition.begin, partition.end):
            yield partition.path, offset, line

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """spark.dataSource.register(Tail); spark.readStream.format("tail").option("path", folder).load()"""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset bigint, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"])
