"""Records of text archives, found by their structure and read in parallel.

A record is a block of tag lines (``[Name "value"]``, whatever the first name)
and the move text after it; so a record begins at the first tag line after a
line of move text, and at the start of a file.  Files are cut into segments: a
plain file by bytes, a Zstandard file by its frames (an index of their places
is read from block headers, nothing is decompressed for it), any other
compressed file is one segment.  Each segment is a task of its own.

A task takes its segment's records from the first start after a line of move text
that begins inside the segment, and reads on behind the segment as far as the
next one's first start.  Both sides apply the same rule to the same bytes, so
every record is read once, wherever the cuts fall.  A record is kept in memory,
never a segment.

Spark lists the files (batch or stream); their bytes come through pyarrow's file
systems (local, HDFS, object stores), because Spark's text reader neither knows
frames nor a separator that depends on the line before.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs

SEGMENT_BYTES = 128 << 20
READ_BYTES = 4 << 20
PACKED_BYTES = 256 << 10      # of a frame, decompressed at once
BATCH_RECORDS = 2000

# Magic numbers of a Zstandard frame and of a skippable one (low four bits free).
FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A50

_TAG = rb'\[\w+[ \t]+"'
# a line of move text, blank lines, and a tag line ahead; possessive, so a line is read once
_START = re.compile(rb'(?<=\n)(?!' + _TAG + rb')[ \t\r]*+[^\s][^\n]*+\n(?:[ \t\r]*+\n)*+(?=' + _TAG + rb')')


def open_path(path: str):
    """(file system, path in it) of a path as Spark's file listing gives it."""
    if path.startswith("file:") or path.startswith("/"):
        return pafs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", path)
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def frames(f, at: int, size: int) -> Iterator[int]:
    """Where each Zstandard frame of an open file begins, from the one at ``at`` on; the next is looked for when asked."""

    def read(n: int) -> bytes:
        nonlocal at
        f.seek(at)
        data = f.read(n)
        if len(data) < n:
            raise ValueError("the archive ends inside a frame")
        at += n
        return data

    while at < size:
        begin = at
        magic, = struct.unpack("<I", read(4))
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            length, = struct.unpack("<I", read(4))
            at += length
            continue
        if magic != FRAME:
            raise ValueError(f"no Zstandard frame at byte {begin}")
        yield begin
        flags = read(1)[0]
        single, length = flags >> 5 & 1, flags >> 6
        at += (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[length]
        last = 0
        while not last:
            head = int.from_bytes(read(3), "little")
            last, kind, bytes_ = head & 1, head >> 1 & 3, head >> 3
            at += 1 if kind == 1 else bytes_
        at += 4 if flags & 4 else 0
        if at > size:
            raise ValueError("the archive ends inside a frame")


def segments(path: str, segment_bytes: int = SEGMENT_BYTES) -> list[tuple[int, int]]:
    """(begin, end) of a file's segments, in bytes of the file."""
    fs, name = open_path(path)
    size = fs.get_file_info(name).size
    if size == 0:
        return []
    if name.endswith(".zst"):
        with fs.open_input_file(name) as f:
            cuts = list(frames(f, 0, size))
        return list(zip(cuts, [*cuts[1:], size]))
    if name.endswith((".gz", ".bz2", ".lz4")):
        return [(0, size)]
    return [(lo, min(lo + segment_bytes, size)) for lo in range(0, size, segment_bytes)]


def _pieces(path: str, begin: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """Text from a segment's begin to the end of the file, and whether it lies in the segment."""
    fs, name = open_path(path)
    if name.endswith(".zst"):
        import zstandard
        with fs.open_input_file(name) as f:
            size = f.size()
            for cut in chain([begin], frames(f, end, size)):
                f.seek(cut)
                frame = zstandard.ZstdDecompressor().decompressobj()
                while not frame.eof and (data := f.read(PACKED_BYTES)):
                    yield frame.decompress(data), cut == begin
                if not frame.eof:
                    raise ValueError("the archive ends inside a frame")
        return
    if name.endswith((".gz", ".bz2", ".lz4")):
        with fs.open_input_stream(name, compression="detect") as f:
            while data := f.read(READ_BYTES):
                yield data, True
        return
    with fs.open_input_file(name) as f:
        f.seek(begin)
        at = begin
        while data := f.read(min(READ_BYTES, end - at) if at < end else READ_BYTES):
            yield data, at < end
            at += len(data)


def records(path: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place in the segment's text, record) of the records that the segment owns."""
    data, base = b"", 0                   # text not yet given out, and its place
    mine = begin == 0                     # inside an own record: the start of a file is one
    edge = None                           # where the segment's text ends
    scan = 0                              # starts before it are known
    for piece, inside in _pieces(path, begin, end):
        if not inside and edge is None:
            edge = base + len(data)
        data += piece
        at, stop = 0, False
        for m in _START.finditer(data, scan):
            if mine:
                yield base + at, data[at: m.end()]
            at = m.end()
            if edge is not None and base + m.start() > edge:
                stop = True
                break
            mine = True
        if stop:
            return
        # a start may be found in the last two lines with text once more of them is there
        keep = data.rfind(b"\n", 0, len(data.rstrip()))
        keep = data.rfind(b"\n", 0, max(len(data[:max(keep, 0)].rstrip()), 0))
        cut = at if mine else max(at, keep)
        data, base = data[cut:], base + cut
        scan = max(0, keep - cut)
    if mine and data.strip():
        yield base, data


def index_task(segment_bytes: int):
    """Arrow task: paths to (path, begin, end) of their segments."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = segments(path, segment_bytes)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(found)), *(pa.array(x, pa.int64()) for x in zip(*found))], ["path", "begin", "end"])
    return run


def read_task(batches):
    """Arrow task: segments to (path, begin, end, place, record)."""
    for batch in batches:
        for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
            rows: list[tuple[int, str]] = []
            for place, data in records(path, begin, end):
                rows.append((place, data.decode("utf-8", "replace")))
                if len(rows) == BATCH_RECORDS:
                    yield _batch(path, begin, end, rows)
                    rows = []
            if rows:
                yield _batch(path, begin, end, rows)


def _batch(path: str, begin: int, end: int, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(rows)
    places, texts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n), pa.array([begin] * n, pa.int64()), pa.array([end] * n, pa.int64()),
         pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["path", "begin", "end", "place", "record"])


def write_task(folder: str, frame_records: int):
    """Arrow task: records (one string column) to ``folder/part-<task>.pgn.zst``, a frame every ``frame_records``.

    A repeated task writes the same file again; it takes its name when it is whole."""
    def run(batches):
        import zstandard
        from pyspark import TaskContext
        fs, name = open_path(folder)
        part = f"part-{TaskContext.get().partitionId():05d}"
        fs.create_dir(name, recursive=True)
        packer, waiting, n, n_frames = zstandard.ZstdCompressor(), [], 0, 0
        with fs.open_output_stream(f"{name}/_{part}") as out:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    waiting.append(text.rstrip("\n") + "\n\n")
                    n += 1
                    if len(waiting) == frame_records:
                        out.write(packer.compress("".join(waiting).encode()))
                        waiting, n_frames = [], n_frames + 1
            if waiting:
                out.write(packer.compress("".join(waiting).encode()))
                n_frames += 1
        fs.move(f"{name}/_{part}", f"{name}/{part}.pgn.zst")
        yield pa.RecordBatch.from_arrays([pa.array([f"{part}.pgn.zst"]), pa.array([n], pa.int64()), pa.array([n_frames], pa.int64())],
                                         ["file", "records", "frames"])
    return run
