"""Token ids in compressed shard files, each a wavelet matrix.

A shard holds the ids of consecutive documents as bit-planes, the highest bit first; each plane is the stable partition
of the one before by its bit. A plane is cut into blocks, compressed one by one with zstandard; the header says where
each block lies and how many ones come before it. Rank and select over the planes give any token, the number of times an
id occurs up to a place, and the place of its k-th occurrence; they read and inflate the blocks they meet, not the rest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.arrowmap import Recent, in_tasks
from corpuslens.llm.bpe import slices
from corpuslens.runtime import materialise, new_path, ship_package

MAGIC = b"CLWMv2\0\0"
#: A file is closed once it holds so many tokens; a document is never split.
SHARD_TOKENS = 8 << 20
#: Bits of a block of a plane, and blocks of a plane that an open file keeps.
BLOCK, OPEN_BLOCKS = 1 << 19, 32
#: Bytes that a worker spends on the words that it has met, between its tasks too, and characters encoded at once.
KEPT, SLICE = 256 << 20, 1 << 20
#: A character that the library parts from white space, as one id of its own.
MARK = "\x01"
#: Words of these are a piece for any tokenizer that keeps runs of letters, in whatever version of Unicode.
LETTERS = re.compile("[a-zß-öø-ÿ]+")


class Bits:
    """A bit vector with rank and select, in blocks of BLOCK bits that load() gives, packed, when they are needed."""

    def __init__(self, n: int, ones: list[int], load: Callable[[int], np.ndarray]):
        #: ones before each block, and all
        self.n, self.ones, self.load = n, np.array(ones, np.int64), load
        self.block = lru_cache(OPEN_BLOCKS)(self._block)

    @classmethod
    def of(cls, packed: np.ndarray, n: int) -> Bits:
        width = BLOCK // 8
        blocks = [packed[a : a + width] for a in range(0, len(packed), width)]
        return cls(n, np.cumsum([0, *(int(np.bitwise_count(x).sum()) for x in blocks)]).tolist(), blocks.__getitem__)

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of 64 bits, and ones before each from the block's begin."""
        packed = self.load(k)
        padded = np.zeros(-(-len(packed) // 8) * 8 + 8, np.uint8)
        padded[: len(packed)] = packed
        words = padded.view("<u8")
        return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    def get_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is a one at each place, and the ones before it. The place n is a zero."""
        one, rank = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
        which = i // BLOCK
        for k in np.unique(which).tolist():
            here = which == k
            if k >= len(self.ones) - 1:
                rank[here] = self.ones[-1]
                continue
            words, before = self.block(k)
            at = i[here] - k * BLOCK
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            one[here] = (word >> bit) & np.uint64(1) != 0
            rank[here] = self.ones[k] + before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return one, rank

    def select(self, one: bool, k: int) -> int:
        """Place of the k-th one or zero, from 0."""
        counts = self.ones if one else BLOCK * np.arange(len(self.ones)) - self.ones
        block = int(np.searchsorted(counts[:-1], k, "right")) - 1
        words, before = self.block(block)
        k -= int(counts[block])
        counts = before if one else 64 * np.arange(len(before)) - before
        word = int(np.searchsorted(counts, k, "right")) - 1
        left, value = k - int(counts[word]), int(words[word]) if one else ~int(words[word]) & (2**64 - 1)
        for _ in range(left):
            value &= value - 1
        return BLOCK * block + 64 * word + (value & -value).bit_length() - 1

    def packed(self) -> np.ndarray:
        """All blocks."""
        return np.concatenate([np.zeros(0, np.uint8), *(self.load(k) for k in range(len(self.ones) - 1))])


class WaveletMatrix:
    """A sequence of ids below 2 ** len(planes)."""

    def __init__(self, n: int, planes: list[Bits]):
        self.n, self.planes = n, planes
        self.zeros = [n - int(b.ones[-1]) for b in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for level in range(width - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << level)) != 0
            planes.append(Bits.of(np.packbits(bit, bitorder="little"), len(ids)))
            below = np.empty_like(ids)
            zeros = len(ids) - int(np.count_nonzero(bit))
            np.compress(bit, ids, out=below[zeros:])
            np.compress(np.logical_not(bit, out=bit), ids, out=below[:zeros])
            ids = below
        return cls(len(ids), planes)

    def all(self) -> np.ndarray:
        """Every id, by undoing the partitions from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level, bits in enumerate(reversed(self.planes)):
            bit = np.unpackbits(bits.packed(), count=self.n, bitorder="little").view(bool)
            zeros = self.n - int(np.count_nonzero(bit))
            ids[zeros:] |= kind(1 << level)
            up = np.empty_like(ids)
            up[bit] = ids[zeros:]
            up[np.logical_not(bit, out=bit)] = ids[:zeros]
            ids = up
        return ids

    def access(self, places) -> np.ndarray:
        """The ids at these places."""
        i = np.atleast_1d(np.asarray(places, np.int64))
        if ((i < 0) | (i >= self.n)).any():
            raise IndexError("no such place")
        ids = np.zeros(len(i), np.int64)
        for zeros, b in zip(self.zeros, self.planes, strict=True):
            one, ones = b.get_rank(i)
            ids = ids << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return ids

    def _bit(self, token: int, level: int) -> bool:
        return bool(token >> (len(self.planes) - 1 - level) & 1)

    def _range(self, token: int, end: int) -> tuple[int, int]:
        at = np.array([0, end])
        for level, b in enumerate(self.planes):
            ones = b.get_rank(at)[1]
            at = self.zeros[level] + ones if self._bit(token, level) else at - ones
        return int(at[0]), int(at[1])

    def rank(self, token: int, end: int) -> int:
        """How often the id occurs before place end."""
        if token < 0 or token >> len(self.planes):
            return 0
        lo, hi = self._range(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError("no such occurrence")
        place = self._range(token, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = self._bit(token, level)
            place = self.planes[level].select(one, place - self.zeros[level] if one else place)
        return place

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard file: magic, length and checksum of the header, header (JSON), compressed document table and blocks of planes."""
    wm = WaveletMatrix.build(ids)
    press = zstandard.ZstdCompressor(level=1, write_checksum=True)
    there = np.array([d is not None for d in doc_ids], bool)
    table = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), there.tobytes(), np.array(lengths, "<i8").tobytes()]
    parts = [press.compress(x) for x in table]
    planes = []
    for bits in wm.planes:
        blocks = [press.compress(bits.load(k).tobytes()) for k in range(len(bits.ones) - 1)]
        planes.append({"sizes": [len(x) for x in blocks], "ones": bits.ones.tolist()})
        parts += blocks
    header = json.dumps({"tokens": wm.n, "documents": len(doc_ids), "block": BLOCK, "table": [len(x) for x in parts[:3]], "planes": planes}).encode()
    return MAGIC + struct.pack("<II", len(header), zlib.crc32(header)) + header + b"".join(parts)


class Shard:
    """An open shard file: tokens (n), documents, and its wavelet matrix. read(offset, size) gives its bytes, size is that of the whole.

    What is damaged raises ValueError: the header, or a length that differs from it, here, a block when it is read.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        magic, length, check = struct.unpack("<8sII", bytes(read(0, 16)).ljust(16))
        header = bytes(read(16, length)) if magic == MAGIC and 16 + length <= size else b""
        if magic != MAGIC or zlib.crc32(header) != check:
            raise ValueError("not a whole shard file")
        held = json.loads(header)
        if held["block"] != BLOCK:
            raise ValueError("a shard file with blocks of another size")
        sizes = [held["table"], *(p["sizes"] for p in held["planes"])]
        at, places = 16 + length, []
        for some in sizes:
            ends = (at + np.cumsum([0, *some])).tolist()
            places.append(list(zip(ends, some)))
            at = ends[-1]
        if at != size:
            raise ValueError("not a whole shard file")
        self.n, self.documents, self.table = held["tokens"], held["documents"], places[0]
        width, last = BLOCK // 8, -(-self.n // 8)
        self.matrix = WaveletMatrix(self.n, [Bits(self.n, p["ones"], lambda k, x=x: np.frombuffer(self._part(x[k], min(width, last - k * width)), np.uint8)) for p, x in zip(held["planes"], places[1:], strict=True)])

    def _part(self, place: tuple[int, int], size: int) -> bytes:
        try:
            out = zstandard.ZstdDecompressor().decompress(self.read(*place))
        except zstandard.ZstdError as e:
            raise ValueError("a damaged part of a shard file") from e
        if len(out) != size:
            raise ValueError("a damaged part of a shard file")
        return out

    def docs(self) -> tuple[list, np.ndarray]:
        """Document ids and their numbers of tokens."""
        ids, there, lengths = (self._part(x, n * self.documents) for x, n in zip(self.table, (8, 1, 8), strict=True))
        return [d if x else None for d, x in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(there, bool).tolist(), strict=True)], np.frombuffer(lengths, "<i8")


def unpack(data: bytes | pa.Buffer) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, their numbers of tokens, and the ids. A damaged file raises ValueError."""
    view = memoryview(data)
    shard = Shard(lambda at, n: view[at : at + n], len(view))
    return *shard.docs(), shard.matrix


class WordEncoder:
    """A tokenizers file that drops white space: the words of a text are encoded apart, and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: without places in the text, where the library has that
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        mark = np.frombuffer(self.whole([MARK])[0], "<u4")
        self.mark = int(mark[0]) if len(mark) == 1 else None
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        #: texts with an added token in any case go to the library as they are; all texts, if one can arise from white space or normalisation
        anywhere = any(x.normalized or re.search(r"\s", x.content) for x in added)
        self.added = re.compile("" if anywhere else "|".join(re.escape(x.content) for x in added) or r"(?!)", re.IGNORECASE)
        #: upper-case ASCII letters come to the same ids, so that one of the two is kept
        self.lowers = all(self.whole([x])[0] == self.whole([x.lower()])[0] for x in map(chr, range(65, 91)))
        #: which ids end a piece, if pieces have an end of their own and words of LETTERS are pieces
        end, pieces = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.pre_tokenizer
        some = "".join(c for c in map(chr, range(256)) if LETTERS.fullmatch(c))
        self.ends = None
        if end and pieces is not None and len(pieces.pre_tokenize_str(some)) == 1:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        #: digits, and letters of European scripts, that the library parts from a comma or full stop that follows
        letters = [c for c in map(chr, [*range(48, 0x250), *range(0x370, 0x530)]) if c.isalnum() and unicodedata.category(c) != "Lm"]
        tried = [[self.whole([c + between + end for c in letters]) for between in ("", " ")] for end in (",", ".", ",b", ".2", ",'s", ".;", "..", ",̈")]
        parted = [c for i, c in enumerate(letters) if all(a[i] == b[i] for a, b in tried)]
        #: a comma or full stop after anything else, other than a space or line feed; none, if it is not parted from an ASCII letter
        self.joined = re.compile(f"[^ \n{re.escape(''.join(parted))}][.,]" if {*"az09"} <= {*parted} else "")
        self.kept = Recent(KEPT)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.batch(texts, add_special_tokens=False)]

    def apart(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from one call for all of them, with MARK between them."""
        text = f" {MARK} ".join(words)
        if self.mark is not None and text.count(MARK) == len(words) - 1:
            ids = np.frombuffer(self.whole([text])[0], "<u4")
            places = np.flatnonzero(ids == self.mark)
            if len(places) == len(words) - 1:
                raw, places = ids.tobytes(), (4 * places).tolist()
                return [raw[a:b] for a, b in zip([0, *(x + 4 for x in places)], [*places, len(raw)])]
        return self.whole(words)

    def pieces(self, words: list[str]) -> list[bytes]:
        """The ids of each word of LETTERS: up to the end of its only piece."""
        if self.ends is not None and words:
            ids = np.frombuffer(self.whole([" ".join(words)])[0], "<u4")
            stops = np.flatnonzero(self.ends[ids])
            if len(stops) == len(words):
                raw, stops = ids.tobytes(), (4 * stops + 4).tolist()
                return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return self.apart(words)

    def parted(self, text: str) -> str:
        """text with a space between any parts that the tokenizer encodes alike alone: at line feeds, and before a comma or full stop, if all of them follow what they are parted from."""
        if self.lowers and text.isascii():
            text = text.lower()
        if not self.joined.search(text):
            text = text.replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ")

    def words(self, text: str) -> list[str]:
        """The parts of text that are encoded apart."""
        return self.parted(text).split(" ")

    def _spaced(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, from those of what stands between its spaces; each different word is looked up once."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = [*map(self.kept.young.get, words)]
        unmet = [k for k, ids in enumerate(known) if ids is None]
        new = self.kept.missing({words[k] for k in unmet})
        letters = [w for w in new if LETTERS.fullmatch(w)]
        rest = [*set(new).difference(letters)]
        self.kept.add(letters, self.pieces(letters))
        self.kept.add(rest, self.apart(rest))
        for k in unmet:
            known[k] = self.kept.young[words[k]]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        size = sizes[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = ids[np.repeat(first[at] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        stops = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids; what stands between spaces and line feeds is encoded apart, but for texts with added tokens."""
        out = []
        for some in slices(texts, SLICE):
            split = [None if self.added.search(t) else self.parted(t) for t in some]
            found = iter(self._spaced([x for x in split if x is not None]))
            out += [self.whole([t])[0] if x is None else next(found) for t, x in zip(some, split, strict=True)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _put(folder: str, name: str, data: bytes) -> None:
    """A whole file or none, also when several attempts write it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int | None, words_apart: bool = False, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write shard files in ascending doc_id order to folder, a URI all machines share.

    words_apart: the tokenizer drops white space, so what stands between spaces and line feeds is encoded apart; else
    whole texts are passed to the library. The texts are dealt out by so many ranges of doc_id (spark.sql.shuffle.partitions,
    unless partitions is given), sorted within each (ties by text), encoded and written as they come.
    end_id, if any, ends each document; null and empty texts have no other id. Null doc_ids come first. Files are named
    by range and number, so a task that runs again replaces its own. Returns the list of files: part, shard,
    tokens_before (in this part), n_tokens, n_docs, file.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    last = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, before, held = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal shard, before, held
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            name = f"part-{part:06d}-{shard:06d}.wm"
            _put(folder, name, pack([d for d, _ in held], [len(x) // 4 for _, x in held], ids))
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "tokens_before": before, "n_tokens": len(ids), "n_docs": len(held), "file": name}])
            shard, before, held = shard + 1, before + len(ids), []
            return row

        size = 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(texts) if words_apart else encoder(path).whole(texts), strict=True):
                held.append((doc, ids + last))
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield close()
                    size = 0
        if held:
            yield close()

    return materialise(dealt.mapInArrow(in_tasks(run), "part bigint, shard bigint, tokens_before bigint, n_tokens bigint, n_docs bigint, file string"), "shards")


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Documents of the files that write_shards() listed: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, ids (binary)."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                docs, lengths, wm = unpack(content.as_buffer())
                data, stops = memoryview(wm.all().astype("<u4").tobytes()), np.cumsum(lengths)
                first = np.concatenate([[0], stops[:-1]]).astype(np.int64)
                for a in range(0, len(docs), 2000):
                    b = min(len(docs), a + 2000)
                    ids = [data[4 * s : 4 * e] for s, e in zip(first[a:b].tolist(), stops[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * (b - a)), pa.array(docs[a:b], pa.int64()), pa.array(first[a:b]), pa.array(lengths[a:b]), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([bytes(x) for x in ids], pa.binary())], names=["file", "doc_id", "first", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    docs = files.mapInArrow(in_tasks(run), "file string, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    # one row per range of doc_ids, of which there are as many as shuffle partitions
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    offsets = shards.join(parts, "part").select("file", (F.col("base") + F.col("tokens_before")).alias("base"))
    return docs.join(offsets, "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")


def find_tokens(spark: SparkSession, folder: str, shards: DataFrame, tokens: list[int], positions: bool = False) -> DataFrame:
    """token, file, n (occurrences) and, if asked for, places (in the file) of these ids in the files that write_shards() listed.

    Only the blocks that rank and select meet are read from a file. A row for each id and file that has it.
    """
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{path}/{name}") as f:
                    wm = Shard(lambda at, n: f.read_at(n, at), f.size()).matrix  # noqa: B023
                    rows = [{"token": t, "file": name, "n": n, "places": wm.occurrences(t) if positions else []} for t in tokens if (n := wm.count(t))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("token", pa.int64()), ("file", pa.string()), ("n", pa.int64()), ("places", pa.list_(pa.int64()))]))

    found = shards.select("file").mapInArrow(in_tasks(run), "token bigint, file string, n bigint, places array<bigint>")
    return found if positions else found.drop("places")


def round_trip(docs: DataFrame, path: str, end_id: int | None, words_apart: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs to a new folder in the shared one and read them back."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, path, end_id, words_apart, shard_tokens))
