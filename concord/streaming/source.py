"""A change log as a stream: segments of a log in a folder, positions as offsets.

A receiver writes segments named ``<from>-<to>.log`` after the positions, as sixteen hex digits, between which
their changes lie: beyond ``from`` and up to ``to``. Each line is a position such as 0/1F, a TAB and the change.
A segment follows the one that ends where it begins, so a missing one is seen.

``spark.readStream.format("changelog")`` with the options

* ``path``: the folder, on any file system that the workers reach;
* ``limit``: changes that one batch takes, about; a batch ends at the end of a transaction or a segment's line;
* ``checkpoint``: the stream's own checkpoint, from which a restart learns where it was, so that the limit counts
  from there;
* ``start``: ``earliest`` (default), ``latest`` or a position.

A cursor that lies before the oldest segment, or behind a gap, raises ``LostHistory``: changes are gone, and only
a whole comparison can tell what they did.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Changes that one batch takes.
LIMIT = 20_000


class LostHistory(RuntimeError):
    """The log no longer reaches back to the cursor."""


def position(lsn: str) -> int:
    """A log position such as 1/A0 as a number."""
    high, _, low = lsn.partition("/")
    return (int(high, 16) << 32) + int(low, 16)


@dataclass(frozen=True)
class Segment:
    path: str
    begin: int
    end: int


def segments(folder: str) -> list[Segment]:
    """The segments of a folder in the order of their positions."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("/") else fs.FileSystem.from_uri(f"file://{folder}")
    found = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        begin, _, end = info.base_name.removesuffix(".log").partition("-")
        if info.base_name.endswith(".log") and end:
            found.append(Segment(info.path, int(begin, 16), int(end, 16)))
    return sorted(found, key=lambda s: s.begin)


def changes_of(folder: str, path: str, after: int, to: int) -> Iterator[tuple[str, str]]:
    """Positions and changes of a segment beyond ``after`` and up to ``to``, read line by line."""
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(path) as raw:
        rest = b""
        while block := raw.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from _between(lines, after, to)
        yield from _between([rest] if rest else [], after, to)


def _between(lines: Sequence[bytes], after: int, to: int) -> Iterator[tuple[str, str]]:
    for line in lines:
        lsn, mark, change = line.decode().partition("\t")
        if mark and after < position(lsn) <= to:
            yield lsn, change


def unbroken(found: Sequence[Segment], after: int) -> list[Segment]:
    """The segments that hold what came after a position; an error if something of it is gone."""
    needed = [s for s in found if s.end > after]
    if not needed:
        return []
    if needed[0].begin > after:
        raise LostHistory(f"the log begins at {needed[0].begin:x}, the cursor is at {after:x}: compare whole, then start anew")
    for before, behind in zip(needed, needed[1:]):
        if behind.begin != before.end:
            raise LostHistory(f"the log has a gap from {before.end:x} to {behind.begin:x}")
    return needed


class _Part(InputPartition):
    def __init__(self, path: str, after: int, to: int):
        self.path, self.after, self.to = path, after, to


class ChangeLogSource(DataSource):
    """``spark.readStream.format("changelog")``: lsn and line of each change."""

    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return "lsn string, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangeLogReader(dict(self.options))


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.folder = path if "://" in path else f"file://{path}"
        self.limit = int(options.get("limit", LIMIT))
        self.start = options.get("start", "earliest")
        logged = last_offset(options["checkpoint"]) if options.get("checkpoint") else None
        self.at = logged["at"] if logged else None

    def initialOffset(self) -> dict:
        found = segments(self.folder)
        at = (found[0].begin if found else 0) if self.start == "earliest" else (found[-1].end if found else 0) if self.start == "latest" else position(self.start)
        self.at = at
        return {"at": at}

    def latestOffset(self) -> dict:
        """As far as the limit reaches from where the stream is."""
        if self.at is None:
            self.initialOffset()
        taken = 0
        for segment in unbroken(segments(self.folder), self.at):
            for lsn, _ in changes_of(self.folder, segment.path, self.at, segment.end):
                taken += 1
                if taken == self.limit:
                    self.at = position(lsn)
                    return {"at": self.at}
            self.at = segment.end
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """A part for each segment, read by its own task."""
        self.at = max(self.at or 0, end["at"])
        return [_Part(s.path, start["at"], end["at"]) for s in unbroken(segments(self.folder), start["at"]) if s.begin < end["at"]]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from changes_of(self.folder, partition.path, partition.after, partition.to)


def last_offset(checkpoint: str) -> dict | None:
    """The last offset that a stream has noted in its checkpoint: its next batch begins there."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(checkpoint if "://" in checkpoint else f"file://{checkpoint}")
    names = [i for i in system.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True)) if i.base_name.isdigit()]
    if not names:
        return None
    with system.open_input_stream(max(names, key=lambda i: int(i.base_name)).path) as f:
        lines = f.read().decode().splitlines()
    return json.loads(lines[-1]) if lines[-1].startswith("{\"at\"") else None


def write_segment(folder: str, begin: int, end: int, changes: Sequence[tuple[str, str]]) -> str:
    """Write one segment, for receivers and tests: under its name only when it is whole."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    system.create_dir(root, recursive=True)
    path = f"{root}/{begin:016x}-{end:016x}.log"
    with system.open_output_stream(f"{path}.part") as out:
        out.write("".join(f"{lsn}\t{change}\n" for lsn, change in changes).encode())
    system.move(f"{path}.part", path)
    return path
