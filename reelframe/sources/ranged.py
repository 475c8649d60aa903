"""Media files by byte ranges: a data source that reads what a question needs and skips the rest, of files of any size.

spark.dataSource.register() knows it as "media". Option `path` names a file or a folder, in any store that pyarrow opens;
option `table` says what to read:

* probe: path, length, format, score, bytes_read. At most 32 KiB a file, and an ID3v2 tag's header.
* elements (with `kind`): the element tree, by the elements' heads. Payload, clusters and coded data aren't opened.
* mp4: the tables of samples (reelframe.sources.media.mp4_tables), from the heads of boxes and the tables' bodies.
* tracks, cues: of Matroska files, up to the first cluster and where the seek head says that the cues are; without one,
  from the head of one cluster to that of the next.

Option `parts` bounds the partitions, of FILES files at least; read(), the short way to the source, gives 16 for each core. mp4_samples() and mkv_packets() plan on these tables, and fetch() reads the payload of planned samples,
neighbours at once. write() puts contents into files, one a row, and contents() reads whole files. Whatever store Spark alone can open is left to
reelframe.sources.containers.load().
"""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from reelframe.sources import media
from reelframe.sources.containers import EBML_NAMES, walk_ebml, walk_jpeg, walk_mp4, walk_riff

BLOCK = 4096
BLOCKS = 64
#: Files of one partition at least, and bytes of one file that one task fetches samples from.
FILES = 32
RANGE = 64 << 20
#: Files of a task that lie in one folder before they are moved to their places.
LISTED = 4096
#: Samples at most this far apart are fetched in one read of at most so many bytes.
GAP = 64 << 10
MOST = 8 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Ranged:
    """A file that is indexed and sliced like bytes. Small parts are read in blocks, the last of which are kept; `read`
    counts the bytes that the store was asked for. Beyond its end there is nothing, as with bytes."""

    def __init__(self, file: pa.NativeFile, size: int, block: int = BLOCK):
        self.file, self.size, self.block, self.read = file, size, block, 0
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.size

    def direct(self, start: int, size: int) -> bytes:
        size = max(0, min(size, self.size - start))
        self.read += size
        return self.file.read_at(size, start) if size else b""

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = self.direct(k * self.block, self.block)
            if len(self.blocks) > BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(k)
        return self.blocks[k]

    def __getitem__(self, at: int | slice):
        if isinstance(at, int):
            at = at + self.size if at < 0 else at
            if not 0 <= at < self.size:
                raise IndexError("beyond the file's end")
            return self._block(at // self.block)[at % self.block]
        start, stop, _ = at.indices(self.size)
        if stop <= start:
            return b""
        first, last = start // self.block, (stop - 1) // self.block
        if last - first > 1:
            return self.direct(start, stop - start)
        joined = b"".join(self._block(k) for k in range(first, last + 1))
        return joined[start - first * self.block : stop - first * self.block]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def ranged(path: str) -> Ranged:
    store, at = _opened(path)
    file = store.open_input_file(at)
    return Ranged(file, file.size())


def probe_file(data: Ranged) -> tuple[int, str, int, int]:
    """(length, format, score, bytes read) of a file: its first 32 KiB behind an ID3v2 tag."""
    tag = media.id3_size(data.direct(0, 10))
    name, score = media._best(data.direct(tag, media.PROBE_BYTES))
    return len(data), name, score, data.read


def _elements(data: Ranged, kind: str) -> Iterator[tuple]:
    walk = {"riff": walk_riff, "mp4": walk_mp4, "jpeg": lambda d: walk_jpeg(d, coded=False), "ebml": lambda d: walk_ebml(d, opened={"EBML", "Segment", "SeekHead", "Seek", "Info", "Tracks", "TrackEntry", "Cues", "CuePoint", "CueTrackPositions"})}[kind]
    paths: list[str] = []
    for k, (parent, depth, name, offset, size) in enumerate(walk(data)):
        paths.append((paths[parent] + "/" if parent >= 0 else "") + name)
        yield k, parent, depth, name, paths[-1], offset, size


def _head(data, at: int) -> tuple[str, int, int | None] | None:
    """(name, body, size or None) of the EBML element at a place."""
    if at >= len(data) or not data[at]:
        return None
    n = 9 - data[at].bit_length()
    code, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at >= len(data) or not data[at]:
        return None
    n = 9 - data[at].bit_length()
    size = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return EBML_NAMES.get(code, hex(code)), at + n, None if size == (1 << 7 * n) - 1 else size


def mkv_index(data: Ranged) -> tuple[bytes, bytes, int]:
    """(what stands before the first cluster, without the seek head's targets behind it; cues; where the segment's body
    starts) of a Matroska file. The first two are whole elements; both are empty for other files."""
    found = _head(data, 0)
    if not found or found[0] != "EBML" or found[2] is None:
        return b"", b"", 0
    at = found[1] + found[2]
    segment = _head(data, at)
    if not segment or segment[0] != "Segment":
        return b"", b"", 0
    body = segment[1]
    parts, cues, sought, at = [data[:at]], b"", {}, body
    seen = set()
    while (found := _head(data, at)) and found[0] != "Cluster" and found[2] is not None:
        name, inner, size = found
        whole = data[at : inner + size] if name in ("SeekHead", "Info", "Tracks", "Cues") else b""
        seen.add(name)
        if name == "SeekHead":
            nodes = list(walk_ebml(whole))
            value = {(p, n): int.from_bytes(whole[o : o + s], "big") for p, _, n, o, s in nodes}
            sought |= {EBML_NAMES.get(value.get((k, "SeekID"))): value.get((k, "SeekPosition")) for k, x in enumerate(nodes) if x[2] == "Seek"}
        elif name == "Cues":
            cues = whole
        else:
            parts.append(whole)
        at = inner + size
    if "Cues" not in seen and "Cues" not in sought:  # no seek head names them: go on from head to head
        while (found := _head(data, at)) and found[2] is not None:
            if found[0] == "Cues":
                sought["Cues"] = at - body
                break
            at = found[1] + found[2]
    for name in ("Info", "Tracks", "Cues"):
        if name not in seen and sought.get(name) is not None and (found := _head(data, body + sought[name])) and found[0] == name and found[2] is not None:
            whole = data[body + sought[name] : found[1] + found[2]]
            if name == "Cues":
                cues = whole
            else:
                parts.append(whole)
    return parts[0] + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + b"".join(parts[1:]), cues, body


def _mkv_index(data: Ranged, table: str) -> Iterator[tuple]:
    head, cues, body = mkv_index(data)
    if table == "tracks":
        yield from media._mkv_tracks(head)
    else:
        for track, time, pos in media._mkv_cues(head + cues):
            yield track, time, pos, body


# name of a table -> its columns, and what makes its rows of a file
TABLES = {
    "probe": ("length long, format string, score int, bytes_read long", lambda data, kind: iter([probe_file(data)])),
    "elements": ("node_id long, parent_id long, depth int, name string, path_expr string, offset long, size long", _elements),
    "mp4": ("track long, name string, entry long, a long, b long, text string, body binary", lambda data, kind: media._mp4_rows(data)),
    "tracks": ("track long, codec_id string, frame_ns long, compression int, prefix binary", lambda data, kind: _mkv_index(data, "tracks")),
    "cues": ("track long, time long, pos long, segment long", lambda data, kind: _mkv_index(data, "cues")),
}


@dataclass
class Files(InputPartition):
    """Some of the files below a root, by what follows it: with the names packed, as all of them are planned by the driver."""

    root: str
    packed: bytes

    def __init__(self, root: str, names: list[str]):
        super().__init__(None)
        self.root, self.packed = root, zlib.compress("\0".join(names).encode("utf-8", "surrogateescape"))

    @property
    def paths(self) -> list[str]:
        names = zlib.decompress(self.packed).decode("utf-8", "surrogateescape")
        return [self.root + n for n in names.split("\0")] if names else []


class MediaReader(DataSourceReader):
    """Lists files where the driver is; each partition reads some of them by ranges."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.table, self.kind = options["path"], options.get("table", "probe"), options.get("kind", "mp4")
        self.parts = int(options.get("parts", 1 << 30))
        self.wanted: dict[str, set] = {}
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[Files]:
        store, at = _opened(self.root)
        if store.get_file_info(at).type == fs.FileType.Directory:
            root, cut = self.root.rstrip("/"), len(at.rstrip("/"))
            infos = store.get_file_info(fs.FileSelector(at, recursive=True))
            names = [i.path[cut:] for i in infos if i.type == fs.FileType.File and not any(x[:1] in "._" for x in i.path[len(at) :].strip("/").split("/"))]
        else:
            root, names = self.root[:-1], [self.root[-1:]]
        if "path" in self.wanted:
            names = [n for n in names if root + n in self.wanted["path"]]
        names.sort()
        size = max(FILES, -(-len(names) // self.parts))
        return [Files(root, names[k : k + size]) for k in range(0, len(names), size)] or [Files(root, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        rows = TABLES[self.table][1]
        own = self.names[1:]
        for path in partition.paths:
            data = ranged(path)
            try:
                for row in rows(data, self.kind):
                    if all(row[own.index(c)] in values for c, values in self.wanted.items() if c != "path"):
                        yield (path, *row)
            finally:
                data.file.close()


class PushingReader(MediaReader):
    """Takes equalities and lists of values: files that aren't asked for are not opened, rows are left out where they are made."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.names:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f


class MediaWriter(DataSourceWriter):
    """A file for each row (path, content). Tasks write aside; the commit moves their files to their places and drops the
    rest, so what a killed task has written is never seen. Tasks only say where they wrote, in folders of up to LISTED files; the
    commit lists one of these at a time, or with option `spread` moves them whole, as part-<task>-<number>."""

    def __init__(self, options: dict):
        self.root, self.job, self.spread = options["path"].rstrip("/"), f"_staging-{uuid.uuid4().hex}", options.get("spread") == "true"

    def write(self, iterator) -> WriterCommitMessage:
        store, at = _opened(self.root)
        task, folders = uuid.uuid4().hex, set()
        for k, row in enumerate(iterator):
            name = row["path"]
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a place in the folder: {name}")
            if k % LISTED == 0:
                folders.clear()
            to = f"{at}/{self.job}/{task}/{k // LISTED:05d}/{name}"
            if (folder := to.rpartition("/")[0]) not in folders:
                store.create_dir(folder, recursive=True)
                folders.add(folder)
            with store.open_output_stream(to) as f:
                f.write(row["content"] or b"")
        return Written(task)

    def commit(self, messages) -> None:
        store, at = _opened(self.root)
        for m in filter(None, messages):
            for part in store.get_file_info(fs.FileSelector(f"{at}/{self.job}/{m.task}", allow_not_found=True)):
                to = f"{at}/part-{m.task}-{part.base_name}" if self.spread else at
                if self.spread and store.type_name in ("local", "hdfs"):
                    store.move(part.path, to)
                else:  # there are files already, or the store has no folders
                    self._move_files(store, part.path, to)
        self._drop()

    def _move_files(self, store: fs.FileSystem, part: str, to: str) -> None:
        made = set()
        for info in store.get_file_info(fs.FileSelector(part, recursive=True)):
            if info.type == fs.FileType.File:
                place = to + info.path[len(part) :]
                if (folder := place.rpartition("/")[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                store.move(info.path, place)

    def abort(self, messages) -> None:
        self._drop()

    def _drop(self) -> None:
        store, at = _opened(self.root)
        if store.get_file_info(f"{at}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.job}")


@dataclass
class Written(WriterCommitMessage):
    task: str


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return "path string, " + TABLES[self.options.get("table", "probe")][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else MediaReader)(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MediaWriter(dict(self.options))


def read(spark: SparkSession, path: str, table: str = "probe", **options: str) -> DataFrame:
    """A table of the files at a path. Filters go down to the reader where Spark's setting PUSHDOWN allows it."""
    spark.dataSource.register(MediaSource)
    options.setdefault("parts", str(16 * spark.sparkContext.defaultParallelism))
    options["pushdown"] = spark.conf.get(PUSHDOWN, "false").lower()
    return spark.read.format("media").options(path=path, table=table, **options).load()


def write(files: DataFrame, path: str, spread: bool = False) -> None:
    """Write files (path, content) below a path, each to its own place, or with `spread` below folders of LISTED files. Names must differ."""
    files.sparkSession.dataSource.register(MediaSource)
    files.select("path", "content").write.format("media").option("path", path).option("spread", str(spread).lower()).mode("append").save()


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of all files below a path, empty ones too; names that start with "_" or "." are left out. None where nothing is.

    One task lists what lies at the path itself, then each folder there is listed and read by one: what write() has spread is
    listed by many tasks, and no name goes to the driver.
    """
    root = path.rstrip("/")

    def listed(store: fs.FileSystem, at: str, name: str, recursive: bool) -> list[tuple[str, bool]]:
        """(name, whether it is a file) of what lies at a name below the path."""
        infos = store.get_file_info(fs.FileSelector(at + name, allow_not_found=True, recursive=recursive))
        names = [(i.path[len(at) :], i.type == fs.FileType.File) for i in infos]
        return [(n, file) for n, file in names if not any(x[:1] in "._" for x in n.strip("/").split("/"))]

    def tops(batches):
        for _ in batches:
            found = listed(*_opened(root), "", False)
            for k in range(0, len(found), LISTED):
                names, files = zip(*found[k : k + LISTED])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.bool_())], names=["name", "file"])

    def whole(batches):
        store, at = _opened(root)
        paths, data, held = [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(len, data), pa.int64()), pa.array(data, pa.binary())], names=["path", "length", "content"])
        for batch in batches:
            for top, is_file in zip(*(c.to_pylist() for c in batch.columns)):
                for name, file in [(top, True)] if is_file else listed(store, at, top, True):
                    if file:
                        with store.open_input_stream(at + name) as f:
                            data.append(f.read())
                        paths.append(root + name)
                        held += len(paths[-1]) + len(data[-1])
                        if held > MOST:
                            yield made()
                            paths, data, held = [], [], 0
        if paths:
            yield made()

    one = spark.range(1, numPartitions=1)
    dealt = one.mapInArrow(tops, "name string, file boolean").repartition(16 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(whole, "path string, length long, content binary")


def mp4_samples(spark: SparkSession, path: str) -> DataFrame:
    """media.mp4_samples() of the files at a path, without their payload."""
    return media.samples_of(media.materialize(read(spark, path, "mp4"), "mp4-tables"))


def fetch(samples: DataFrame) -> DataFrame:
    """samples (path, offset, size, ...) with data: their bytes, behind their prefix, if they have one.

    Samples are dealt by file and RANGE of offsets, so a large file is read by many tasks, each from its start to its end.
    Neighbours come in one read. Null or negative places, and what lies beyond a file's end, have no bytes.
    """
    schema = StructType([*samples.schema.fields]).add("data", "binary")
    prefixed = "prefix" in samples.columns

    def run(batches):
        path, data, held, start = None, None, b"", 0
        try:
            for batch in batches:
                paths, places = batch.column("path").to_pylist(), list(zip(batch.column("offset").to_pylist(), batch.column("size").to_pylist()))
                prefix = batch.column("prefix").to_pylist() if prefixed else [None] * len(paths)
                out, first, total = [], 0, 0
                for k, (p, (at, n)) in enumerate(zip(paths, places)):
                    if p != path:
                        if data:
                            data.file.close()
                        path, data, held, start = p, ranged(p), b"", 0
                    at, n = (at or 0, n or 0) if (at or 0) >= 0 and (n or 0) >= 0 else (0, 0)
                    if n and not start <= at <= at + n <= start + len(held):
                        end = at + n
                        for q, (a, m) in zip(paths[k + 1 :], places[k + 1 :]):
                            if q != p or not a or not m or not at <= a <= end + GAP or max(end, a + m) - at > MOST:
                                break
                            end = max(end, a + m)
                        held, start = data.direct(at, end - at), at
                    out.append((prefix[k] or b"") + held[at - start : at - start + n] if n else prefix[k] or b"")
                    total += len(out[-1])
                    if total > MOST:
                        yield pa.RecordBatch.from_arrays([*(c.slice(first, k + 1 - first) for c in batch.columns), pa.array(out, pa.binary())], names=[*batch.schema.names, "data"])
                        out, first, total = [], k + 1, 0
                if out:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first) for c in batch.columns), pa.array(out, pa.binary())], names=[*batch.schema.names, "data"])
        finally:
            if data:
                data.file.close()

    dealt = samples.repartition("path", F.expr(f"offset div {RANGE}")).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, schema)


def mkv_packets(spark: SparkSession, path: str, from_time: int, to_time: int) -> DataFrame:
    """media.mkv_packets() of the clusters that the cues name for times from from_time (or the last cue before it) to to_time, in the
    segment's time scale, with cluster, where each one starts. Only those clusters are read."""
    cues = read(spark, path, "cues").select("path", (F.col("segment") + F.col("pos")).alias("cluster"), "time").groupBy("path", "cluster").agg(F.min("time").alias("time"))
    first = cues.filter(F.col("time") <= from_time).groupBy("path").agg(F.max("time").alias("first"))
    low: Column = F.coalesce("first", F.lit(from_time))
    wanted = cues.join(first, "path", "left").filter((F.col("time") >= low) & (F.col("time") <= to_time)).select("path", "cluster")

    def run(batches):
        for batch in batches:
            for p, at in zip(batch.column("path").to_pylist(), batch.column("cluster").to_pylist()):
                data = ranged(p)
                try:
                    head, _, _ = mkv_index(data)
                    found = _head(data, at)
                    if not found or found[0] != "Cluster":
                        continue
                    size = found[2] if found[2] is not None else next(s for _, _, _, _, s in walk_ebml(Shifted(data, at)))
                    own = data[at : found[1] + size]
                    rows = [(p, at, t, pts, scale, flags, o - len(head) + at, n, pre) for t, pts, scale, flags, o, n, pre in media._mkv_packets(head + own)]
                finally:
                    data.file.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["path", "cluster", "track", "pts", "timescale", "flags", "offset", "size", "prefix"])

    return wanted.repartition("path", "cluster").mapInArrow(run, "path string, cluster long, track long, pts long, timescale long, flags int, offset long, size long, prefix binary")


class Shifted:
    """A file from a place on."""

    def __init__(self, data: Ranged, at: int):
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.data) - self.at

    def __getitem__(self, at: int | slice):
        if isinstance(at, int):
            return self.data[self.at + at]
        start, stop, _ = at.indices(len(self))
        return self.data[self.at + start : self.at + max(stop, start)]
