"""Token-id files: independent zstandard frames, a document index and a seek table.

A file holds documents in ascending key order. Frames are complete zstandard frames of
whole documents' ids (little-endian unsigned 32-bit). Behind them come two skippable
frames that any zstandard reader passes over: the index (keys, ids per document, and
documents per frame) and the seek table of the public seekable format, with compressed
size, content size and checksum (low half of XXH64 of the content) per frame. A reader
fetches the tail, then only the frames of the documents it wants, and checks each.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift.llm.common import bounded_batches, give_back, stored, texts_of
from panelsift.session import scratch_path

FRAME_BYTES = 1 << 18
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


class FileWriter:
    """Appends documents to one file; ``close`` writes index and seek table."""

    def __init__(self, out, level: int = 3):
        self.out = out
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.per_frame: list[int] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, key: int | None, ids: bytes) -> None:
        if self.waiting and self.size + len(ids) > FRAME_BYTES:
            self._flush()
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        content = b"".join(self.waiting)
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.per_frame.append(len(self.waiting))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        keys = np.array([0 if k is None else k for k in self.keys], "<i8").tobytes()
        null = np.array([k is None for k in self.keys], "u1").tobytes()
        lengths = np.array(self.lengths, "<u8").tobytes()
        index = self.packer.compress(
            struct.pack("<Q", len(self.keys)) + keys + null + lengths
            + np.array(self.per_frame, "<u8").tobytes()
        )
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = np.array(self.entries, ENTRY).tobytes()
        footer = FOOTER.pack(len(self.entries), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table) + len(footer)) + table + footer)


class FileReader:
    """Random access by document number or key."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, _, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        begin = size - FOOTER.size - frames * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(begin, frames * ENTRY.itemsize), ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        head = int(self.offsets[-1])
        _, length = struct.unpack("<II", self._at(head, 8))
        raw = zstandard.ZstdDecompressor().decompress(self._at(head + 8, length))
        (n,) = struct.unpack_from("<Q", raw)
        self.keys = np.frombuffer(raw, "<i8", n, 8)
        self.null = np.frombuffer(raw, "u1", n, 8 + 8 * n).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", n, 8 + 9 * n).astype(np.int64)
        per_frame = np.frombuffer(raw, "<u8", frames, 8 + 17 * n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(per_frame)])

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        packed = self._at(int(self.offsets[k]), int(self.entries["packed"][k]))
        content = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.entries["size"][k]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(number, ids) of the wanted documents, or all, unpacking only their frames."""
        numbers = range(len(self.keys)) if wanted is None else sorted(set(wanted))
        at, content, starts = -1, b"", None
        for n in numbers:
            k = int(np.searchsorted(self.first, n, "right")) - 1
            if k != at:
                at, content = k, self.frame(k)
                own = self.lengths[self.first[k] : self.first[k + 1]]
                starts = np.concatenate([[0], np.cumsum(own)]) * 4
            i = n - self.first[k]
            yield n, content[starts[i] : starts[i + 1]]

    def of_key(self, key: int) -> list[bytes]:
        return [ids for _, ids in self.documents(np.nonzero((self.keys == key) & ~self.null)[0].tolist())]


#: Segments that make no further blank beside each other, each beginning with its own.
BLANK_FIRST = re.compile(r" \S(?:[^ ]*\S)?")
#: Segments that a line end on either side leaves as they are.
NO_BLANK = re.compile(r"\S+")
#: Most segments remembered, and most characters of one.
MAX_SEGMENTS, LONG_SEGMENT = 700_000, 64
#: New segments that are given to the library as one text.
JOINED_SEGMENTS = 200
#: Characters beside which texts are cut; an added token that holds one forbids cuts.
CUT = re.compile(r"[ \n,.;:!?]")


def _table(some: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(some)] = True
    return found


CUTS = _table(b" \n,.;:!?")
SPACE = _table(b" \n")
VISIBLE = _table(bytes(range(0x21, 0x7F)))
#: First bytes of visible characters; U+00C0 to U+07FF holds no white space.
VISIBLE_FIRST = _table(bytes([*range(0x21, 0x7F), *range(0xC3, 0xE0)]))
ALNUM = _table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def segment_starts(data: np.ndarray, ends: np.ndarray, first: np.ndarray = VISIBLE_FIRST) -> np.ndarray:
    """Per byte of UTF-8 texts with these ends, whether a segment starts there.

    No piece of the byte-level pattern spans the place before a blank or line end with a visible
    character on either side, the place behind a line end with one behind it, or that before a
    mark that follows a letter or digit. What is left of such a place has the same pieces alone,
    and so has what is right of it. Every text starts a segment, too. ``first``: the bytes that
    say that white space is followed by a visible character; not those that begin an added token,
    which ends what the pattern sees.
    """
    found = np.nonzero(CUTS[data[1:]])[0] + 1
    here, z = data[found], data[found - 1]
    space = SPACE[here]
    opens = np.where(space, VISIBLE[z], ALNUM[z])
    many = np.nonzero(z >= 0x80)[0]  # behind a character of several bytes
    at, z = found[many], z[many]
    y, x = data[at - 2] * (at > 1), data[at - 3] * (at > 2)
    blank = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
    blank |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
    blank |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    blank |= (x == 0xE2) & (y == 0x81) & (z == 0x9F)
    blank |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
    letter = (y == 0xC3) & (z != 0x97) & (z != 0xB7)  # all but the signs of times and division
    opens[many] = np.where(space[many], ~blank, letter)
    starts = np.zeros(len(data) + 1, bool)
    starts[ends] = True
    behind = found[space] + 1
    behind = behind[~starts[behind]]  # not those that end a text
    behind = behind[first[data[behind]]]
    starts[found[opens]] = True
    starts[behind - 1] = True
    starts[behind[data[behind - 1] == 0x0A]] = True
    starts[0] = True
    return starts[:-1]


class SegmentEncoder:
    """The tokenizers library over distinct segments of many texts, remembered in bounds.

    Texts are cut where no piece can span (``segment_starts``). That holds for the byte-level
    pattern; with another tokenizer every text is one segment.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.end = struct.pack("<I", end_id)
        largest = max(self.library.get_vocab().values(), default=0)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        #: Whether an id's piece begins with a blank, which the byte alphabet writes as this letter.
        self.opens = np.zeros(largest + 1, bool)
        self.opens[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self.line_end = vocabulary.get("\u010a")
        self.cuts = self.line_end is not None and self._byte_level()
        self.first = VISIBLE_FIRST.copy()
        self.first[[t.content.encode()[0] for t in self.library.get_added_tokens_decoder().values() if t.content]] = False

    def _byte_level(self) -> bool:
        from tokenizers.pre_tokenizers import ByteLevel

        x = self.library
        if not isinstance(x.pre_tokenizer, ByteLevel) or not x.pre_tokenizer.use_regex:
            return False
        added = x.get_added_tokens_decoder().values()
        odd = any(t.lstrip or t.rstrip or t.single_word or t.normalized or CUT.search(t.content) for t in added)
        return x.normalizer is None and not x.pre_tokenizer.add_prefix_space and not odd

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _blank_first(self, some: list[str]) -> list[bytes]:
        """Ids of each: in one text of them all, each one's begin with a piece that has its blank."""
        (found,) = self._ids(["".join(some)])
        cuts = (4 * np.nonzero(self.opens[np.frombuffer(found, np.uint32)])[0]).tolist()
        return [found[x:y] for x, y in zip(cuts, [*cuts[1:], len(found)])]

    def _no_blank(self, some: list[str]) -> list[bytes]:
        """Ids of each: in one text of them all, a line end's id stands between two."""
        (found,) = self._ids(["\n".join(some)])
        cuts = (4 * np.nonzero(np.frombuffer(found, np.uint32) == self.line_end)[0]).tolist()
        return [found[x:y] for x, y in zip([0, *[c + 4 for c in cuts]], [*cuts, len(found)], strict=True)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of segments that are not known; those that are not long are remembered."""
        learned: dict[str, bytes] = {}
        for like, ids_of in ((BLANK_FIRST, self._blank_first), (NO_BLANK, self._no_blank)) if self.cuts else ():
            some = list(filter(like.fullmatch, new))
            for k in range(0, len(some), JOINED_SEGMENTS):
                part = some[k : k + JOINED_SEGMENTS]
                found = ids_of(part)
                if len(found) == len(part):  # else blanks or line ends are written otherwise
                    learned.update(zip(part, found))
        rest = [w for w in new if w not in learned]
        learned.update(zip(rest, self._ids(rest), strict=True))
        self.known.update({w: ids for w, ids in learned.items() if len(w) <= LONG_SEGMENT})
        return learned

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as bytes."""
        if len(self.known) > MAX_SEGMENTS:
            self.known.clear()
        coded = [t.encode() for t in texts]
        data = b"".join(coded)
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        if not data:
            return [self.end] * len(texts)
        chars = np.frombuffer(data, np.uint8)
        cuts = np.nonzero(segment_starts(chars, ends, self.first))[0] if self.cuts else np.unique(np.append(0, ends[:-1]))
        starts = np.append(cuts[cuts < len(data)], len(data)).astype(np.int64)
        segments = pa.Array.from_buffers(
            pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]
        ).dictionary_encode()
        words = segments.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        if None in found:
            learned = self._learn([w for w, ids in zip(words, found) if ids is None])
            found = [learned[w] if ids is None else ids for w, ids in zip(words, found)]
        every = pa.array(found, pa.large_binary()).take(segments.indices)
        places = np.frombuffer(every.buffers()[1], np.int64, len(every) + 1, 8 * every.offset)
        last = places[np.searchsorted(starts, ends)].tolist()
        ids = memoryview(every.buffers()[2])
        return [bytes(ids[x:y]) + self.end for x, y in zip([0, *last], last)]


@lru_cache(maxsize=2)
def encoder_of(path: str, end_id: int) -> SegmentEncoder:
    """One encoder per worker process, so that later tasks find its segments."""
    return SegmentEncoder(path, end_id)


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0
) -> DataFrame:
    """Write ``docs`` in ascending key order; one row per file: part, path, n_docs, n_ids.

    Rows are range-partitioned by key, so a file holds a key range and nothing is held
    whole. A file is written under its attempt's name and then renamed, so a repeated
    task leaves one complete file. Null keys come first; rows with equal keys follow each
    other by text. Null and empty texts are just the end id.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        temporary = f"{base}/_{part:07d}-{task.taskAttemptId()}"
        path = f"{base}/{part:07d}.zst"
        encoder, docs_n, ids_n, writer = None, 0, 0, None
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = encoder_of(tokenizer, end_id)
                out = fs.open_output_stream(temporary)
                writer = FileWriter(out)
            for k, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch, text))):
                writer.add(k, ids)
                docs_n += 1
                ids_n += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temporary, path)
            del writer, out
            give_back()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [docs_n], "n_ids": [ids_n]})

    ordered = docs.select(key, text).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(
        F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first()
    )
    return stored(ordered.mapInArrow(run, "part int, path string, n_docs bigint, n_ids bigint"), "token-files")


def read_token_files(spark: SparkSession, files: DataFrame, folder: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32.

    Only one row per file is collected; ``start`` is the ids of all earlier files and of
    the earlier documents in its own.
    """
    table = sorted((r.part, r.path, r.n_ids) for r in files.collect())
    before = np.concatenate([[0], np.cumsum([n for *_, n in table])]).astype(int).tolist()
    starts = [(path, b) for (_, path, _), b in zip(table, before)]
    schema = f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not starts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, base = starts[k]
                with fs.open_input_file(path) as source:
                    reader = FileReader(source)
                    sums = np.fromiter((zlib.crc32(ids) for _, ids in reader.documents()), np.int64, len(reader.keys))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.keys, pa.int64(), mask=reader.null),
                            pa.array(base + np.cumsum(reader.lengths) - reader.lengths, pa.int64()),
                            pa.array(reader.lengths, pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        [key, "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, len(starts), 1, len(starts)).mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write to the shared folder and read back per document."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    files = write_token_files(docs, tokenizer, folder, key, text)
    return read_token_files(spark, files, folder, key, dict(docs.dtypes)[key])
