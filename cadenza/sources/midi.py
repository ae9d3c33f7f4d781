"""Songs as files: messages to the bytes of a standard MIDI file and back, and a sink of one file a row."""

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Kinds of messages: their status byte (its upper half) and how many data bytes follow (fixed values of the format).
STATUS = {"off": (0x80, 2), "on": (0x90, 2), "control": (0xB0, 2), "program": (0xC0, 1)}
_DATA = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}
MESSAGES = "seq long, track int, tick long, kind string, channel int, a int, b int"


def _length(n: int) -> bytes:
    """A number in groups of seven bits, the highest first; all but the last are marked."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(out[::-1])


def song_bytes(tracks: list[list[tuple]], beat: int = 480) -> bytes:
    """The file of tracks of messages (tick, kind, channel, a, b), each in the order of ticks. a and b are the data bytes:
    pitch and velocity, controller and value, or the program."""
    out = [b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), beat)]
    for messages in tracks:
        body, before = [], 0
        for tick, kind, channel, a, b in messages:
            status, data = STATUS[kind]
            body.append(_length(tick - before) + bytes([status | channel, *(a, b)[:data]]))
            before = tick
        body.append(b"\0\xff\x2f\0")
        whole = b"".join(body)
        out.append(b"MTrk" + struct.pack(">I", len(whole)) + whole)
    return b"".join(out)


def song_messages(content: bytes) -> Iterator[tuple]:
    """(seq, track, tick, kind, channel, a, b) of a file; kind is on, off (also an on of velocity 0), control, program or
    other, and end at a track's end. Raises ValueError for what is no such file, or one that is cut off."""

    def number(at: int) -> tuple[int, int]:
        n = 0
        while True:
            if at >= len(content):
                raise ValueError("cut off")
            n = n << 7 | content[at] & 127
            at += 1
            if content[at - 1] < 128:
                return n, at

    if content[:4] != b"MThd" or len(content) < 14:
        raise ValueError("no header")
    at, track, seq = 8 + struct.unpack(">I", content[4:8])[0], 0, 0
    for _ in range(struct.unpack(">H", content[10:12])[0]):
        if content[at : at + 4] != b"MTrk" or at + 8 > len(content):
            raise ValueError("no track")
        stop = at + 8 + struct.unpack(">I", content[at + 4 : at + 8])[0]
        if stop > len(content):
            raise ValueError("cut off")
        at, tick, status = at + 8, 0, 0
        while at < stop:
            delta, at = number(at)
            tick += delta
            if content[at] >= 128:
                status, at = content[at], at + 1
            if status >= 0xF0:
                # Meta messages have a type before their length, others only that.
                kind, at = (content[at], at + 1) if status == 0xFF else (-1, at)
                size, at = number(at)
                at += size
                yield seq, track, tick, "end" if kind == 0x2F else "other", 0, 0, 0
            elif status < 128:
                raise ValueError("no status")
            else:
                data = content[at : at + _DATA[status >> 4]]
                at += len(data)
                a, b = data[0], data[1] if len(data) > 1 else 0
                kind = {0x8: "off", 0x9: "on" if b else "off", 0xB: "control", 0xC: "program"}.get(status >> 4, "other")
                yield seq, track, tick, kind, status & 15, a, b
            seq += 1
        at, track = stop, track + 1


def read_songs(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, track, tick, kind, channel, a, b): the messages of all .mid files below path, in either case. A file that
    is broken has one row, of kind broken."""

    def parse(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = list(song_messages(bytes(content)))
                except (ValueError, IndexError):
                    rows = [(0, 0, 0, "broken", 0, 0, 0)]
                made = pd.DataFrame(rows, columns=["seq", "track", "tick", "kind", "channel", "a", "b"])
                yield made.assign(path=name)[["path", *made.columns]]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][iI][dD]").load(path)
    return files.select("path", "content").mapInPandas(parse, f"path string, {MESSAGES}")


def song_files(messages: DataFrame, beat: int = 480) -> DataFrame:
    """(name, content): the file <song>.mid of each song of messages (song, track, tick, kind, channel, a, b). At equal
    ticks offs stand before ons, then lower channels and pitches. A song's messages meet in one row."""

    def encode(batches, most: int = 50_000):
        import pyarrow as pa

        def made(songs, files):
            return pa.RecordBatch.from_arrays([pa.array([f"{x}.mid" for x in songs], pa.string()), pa.array(files, pa.binary())], ["name", "content"])

        for batch in batches:
            songs, lists = batch.column(0).to_pylist(), batch.column(1)
            ends = lists.offsets.to_pylist()
            fields = [lists.values.field(c) for c in ("track", "tick", "kind", "channel", "a", "b")]
            first, files = 0, []
            # Messages become objects of Python a song at a time, and files leave before many are held.
            for k in range(len(songs)):
                tracks: dict = {}
                for track, *message in zip(*[x.slice(ends[k], ends[k + 1] - ends[k]).to_pylist() for x in fields]):
                    tracks.setdefault(track, []).append(tuple(message))
                files.append(song_bytes([tracks[t] for t in sorted(tracks)], beat))
                if ends[k + 1] - ends[first] > most:
                    yield made(songs[first : k + 1], files)
                    first, files = k + 1, []
            if files:
                yield made(songs[first:], files)

    place = F.struct("track", "tick", (F.col("kind") == "on").alias("late"), "channel", "a", "b", "kind")
    songs = messages.groupBy("song").agg(F.array_sort(F.collect_list(place)).alias("rows"))
    return songs.mapInArrow(encode, "name string, content binary")


class _Written(WriterCommitMessage):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class FileSink(DataSource):
    """spark.write.format("one_file_a_row").save(folder): rows (name, content) become files of a folder.

    Each try of a task writes to a folder of its own below _tries. When all tasks are done, the files of those tries that
    count are moved to their places and _SUCCESS is written; if the job fails, nothing is moved. So a task that is lost
    and run again, or run twice, leaves neither half a file nor two.
    """

    @classmethod
    def name(cls) -> str:
        return "one_file_a_row"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return FileSinkWriter(self.options["path"])


class FileSinkWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or ":" in self.path.split("/")[0] else f"file://{self.path}")

    def write(self, iterator) -> _Written:
        where, base = self._open()
        own, names = f"{base}/_tries/{uuid.uuid4()}", []
        where.create_dir(own)
        for row in iterator:
            with where.open_output_stream(f"{own}/{row['name']}") as out:
                out.write(bytes(row["content"]))
            names.append(row["name"])
        return _Written(own, names)

    def commit(self, messages) -> None:
        where, base = self._open()
        for m in messages:
            for name in m.names if m else ():
                where.move(f"{m.folder}/{name}", f"{base}/{name}")
        self._clear(where, base)
        where.create_dir(base)
        with where.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self._clear(*self._open())

    def _clear(self, where, base) -> None:
        from pyarrow import fs

        if where.get_file_info(f"{base}/_tries").type != fs.FileType.NotFound:
            where.delete_dir(f"{base}/_tries")


def write_files(files: DataFrame, path: str) -> None:
    """Rows (name, content) as files of a folder, all of them or none."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").write.format(FileSink.name()).mode("append").save(path)
