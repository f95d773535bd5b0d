"""Growing log files as a streaming source of whole lines.

``spark.dataSource.register(TailSource)``, then ``readStream.format("tail")`` with
``path`` (a glob) and ``bytes`` (the most that a task, and all but a query's first
batch, takes of a file). A file is known
by its inode, so one that is renamed when logs rotate goes on from its offset, and
the new one of its name starts at 0; one that is found shorter starts anew. A batch ends
behind a line feed: a line that is not finished waits, one longer than a batch is cut.
Offsets are byte offsets, so a restarted query goes on where it stopped. Files must
lie where the driver and the executors both see them.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MOST = 8 << 20
_STEP = 1 << 16


def whole_lines(path: str, start: int, most: int) -> int:
    """The offset behind the last line feed within ``most`` bytes from ``start``; if
    there is none in as many, behind them all; ``start`` if a line is not finished."""
    size = min(os.path.getsize(path), start + most)
    with open(path, "rb") as file:
        at = size
        while at > start:
            low = max(start, at - _STEP)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return size if size == start + most else start


class Stretch(InputPartition):
    def __init__(self, path: str, inode: int, start: int, end: int):
        super().__init__((inode, start))
        self.path, self.inode, self.start, self.end = path, inode, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, most: int):
        self.pattern, self.most = pattern, most
        self.seen: dict[str, int] | None = None

    def files(self) -> dict[str, tuple[str, int]]:
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                state = os.stat(path)
            except OSError:  # rotated away meanwhile
                continue
            out[str(state.st_ino)] = (path, state.st_size)
        return out

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """(inode: offset) of what may be read next; goes on from what was handed out
        before. A reader that has handed out nothing may stand in a restarted query, whose
        offsets it is not told here, so its first batch goes to the end of each file."""
        out = {}
        for inode, (path, size) in self.files().items():
            start = 0 if self.seen is None else self.seen.get(inode, 0)
            out[inode] = whole_lines(path, 0 if size < start else start, size if self.seen is None else self.most)
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = self.files()
        self.seen = dict(end) if self.seen is None else self.seen
        out = []
        for inode, to in end.items():
            begin = start.get(inode, 0)
            begin = 0 if to < begin else begin
            while to > begin and inode in files:
                cut = min(to, max(whole_lines(files[inode][0], begin, self.most), begin + 1)) if to - begin > self.most else to
                out.append(Stretch(files[inode][0], int(inode), begin, cut))
                begin = cut
        return out

    def read(self, part: Stretch) -> Iterator[tuple]:
        with open(part.path, "rb") as file:
            file.seek(part.start)
            at = part.start
            while at < part.end:
                line = file.readline(part.end - at)
                if not line:
                    break
                yield os.path.basename(part.path), at, line.rstrip(b"\r\n").decode(errors="replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("bytes", MOST)))
