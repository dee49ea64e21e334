"""Token ids in files, Huffman-coded with one canonical, length-limited code.

The code follows from the counts of all ids. A file holds the code lengths and
independent blocks of whole documents; a block holds its documents' ids and
sizes, the bit offset of every 64th token id, and the bits. Any block can be
decoded alone, and inside it all stretches of 64 ids are decoded side by side
through one table. A manifest, written when all tasks are done, puts files into
order and says how many ids lie before each part of them.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from contactloom.session import new_path

from .batches import arrow_schema, one_column, slices
from .warc import filesystem, qualified

FORMAT = "token_huffman"
MAGIC, SUFFIX, MANIFEST = b"HUFFIDS1", ".ids", "_manifest-"
# Bits of the longest code word, if the ids fit; ids from one checkpoint to the next.
LONGEST, EVERY = 20, 64
# Ids after which a block ends, with the document they belong to; bytes of a file read by one task.
BLOCK_IDS, PART_BYTES = 1 << 17, 32 << 20
# Bytes in which a process remembers ids of different pieces of texts, some three million.
REMEMBERED = 160 << 20
END_ID = 0
_BLOCK = struct.Struct("<IQQIII")
COLUMNS = "doc_id long, start long, n_tokens long, ids binary"
LAYOUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


# ---- the code


def code_lengths(counts: np.ndarray, most: int = LONGEST) -> np.ndarray:
    """Bits for every id of a best code with no word over ``most`` bits, 0 for ids never met (package-merge)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    most = max(most, int(len(used) - 1).bit_length())
    ranked = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[ranked].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(most):
        weights = np.concatenate([leaves, packages])
        order = np.argsort(weights, kind="stable")
        levels.append(order < len(leaves))
        merged = weights[order]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    wanted = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:wanted].sum())
        lengths[ranked[:taken]] += 1
        wanted = 2 * (wanted - taken)
    return lengths


@dataclass
class Code:
    """Canonical code words: shorter first, then by id."""

    lengths: np.ndarray

    def __post_init__(self):
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        sizes = self.lengths[order].astype(np.int64)
        self.most = int(sizes[-1]) if len(sizes) else 1
        share = np.left_shift(np.int64(1), self.most - sizes)
        places = np.cumsum(share) - share
        self.words = np.zeros(len(self.lengths), np.uint64)
        self.words[order] = (places >> (self.most - sizes)).astype(np.uint64)
        self._order, self._share, self._sizes = order, share, self.lengths.astype(np.int64)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and bits of the word that the next ``most`` bits begin with."""
        ids, bits = np.zeros(1 << self.most, np.uint32), np.ones(1 << self.most, np.uint8)
        filled = int(self._share.sum())
        ids[:filled] = np.repeat(self._order, self._share)
        bits[:filled] = np.repeat(self.lengths[self._order], self._share)
        return ids, bits

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """64-bit words, the bit offset of every EVERY-th id, and the number of bits."""
        sizes, words = self._sizes[ids], self.words[ids]
        if len(ids) and not sizes.all():
            raise ValueError("an id without a code word")
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        out = np.zeros(total // 64 + 1, np.uint64)
        if not total:
            return out, np.zeros(0, np.int64), 0
        starts = ends - sizes
        cell = starts >> 6
        room = 64 - (starts & 63) - sizes
        over = np.flatnonzero(room < 0)
        late, rest = words[over], (-room[over]).astype(np.uint64)
        room[over] = 0
        high = words << room.astype(np.uint64)
        high[over] = late >> rest
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        out[cell[first]] = np.bitwise_or.reduceat(high, first)
        # No cell takes more than one word's rest.
        out[cell[over] + 1] |= late << (np.uint64(64) - rest)
        return out, starts[::EVERY], total


def decode(words: np.ndarray, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """The ``n`` ids of a block; the stretches between checkpoints go side by side."""
    ids, bits = table
    # Zeros behind the end, for the stretch that is not full.
    words = np.concatenate([words, np.zeros(EVERY * most // 64 + 2, np.uint64)])
    out = np.empty((len(offsets), EVERY), np.uint32)
    at = offsets.astype(np.int64)
    drop = np.uint64(64 - most)
    for step in range(EVERY):
        cell, shift = at >> 6, (at & 63).astype(np.uint64)
        # Two shifts, since one by 64 is none.
        window = (words[cell] << shift) | ((words[cell + 1] >> np.uint64(1)) >> (np.uint64(63) - shift))
        found = window >> drop
        out[:, step] = ids[found]
        at += bits[found]
    return out.ravel()[:n]


# ---- files


class FileOut:
    """One file: code lengths, blocks, then the table of blocks."""

    def __init__(self, stream, code: Code):
        self.stream, self.code = stream, code
        self.at, self.n_ids, self.n_docs = 0, 0, 0
        #: (byte offset, ids before) of blocks PART_BYTES apart, where a reader may begin.
        self.cuts: list[tuple[int, int]] = []
        packed = zlib.compress(code.lengths.tobytes())
        self._put(MAGIC + struct.pack("<II", len(code.lengths), len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def block(self, doc_ids: list, texts: list[np.ndarray]) -> None:
        ids = np.concatenate(texts)
        words, offsets, n_bits = self.code.encode(ids)
        known = np.array([d is not None for d in doc_ids])
        index = zlib.compress(
            np.array([d or 0 for d in doc_ids], "<i8").tobytes()
            + np.array([len(t) for t in texts], "<u8").tobytes()
            + np.packbits(known).tobytes()
        )
        steps = np.diff(offsets, prepend=0).astype("<u4").tobytes()
        body = index + steps + words[: -(-n_bits // 64)].astype(">u8").tobytes()
        if not self.cuts or self.at - self.cuts[-1][0] >= PART_BYTES:
            self.cuts.append((self.at, self.n_ids))
        self._put(_BLOCK.pack(len(doc_ids), len(ids), n_bits, len(index), len(body), zlib.crc32(body)) + body)
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)


def read_code(file) -> tuple[Code, int]:
    """The code of an open file, and where its blocks begin."""
    file.seek(0)
    head = file.read(len(MAGIC) + 8)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    n, size = struct.unpack("<II", head[len(MAGIC) :])
    lengths = np.frombuffer(zlib.decompress(file.read(size)), np.uint8)
    if len(lengths) != n:
        raise ValueError("code lengths are damaged")
    return Code(lengths), len(head) + size


def read_blocks(file, begin: int, end: int, code: Code) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, sizes, ids) of the blocks from byte ``begin`` up to ``end``."""
    table = code.table()
    file.seek(begin)
    while begin < end:
        head = file.read(_BLOCK.size)
        if len(head) < _BLOCK.size:
            raise ValueError("a block is cut short")
        n_docs, n_ids, n_bits, n_index, n_body, crc = _BLOCK.unpack(head)
        body = file.read(n_body)
        if zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        index = zlib.decompress(body[:n_index])
        doc_ids, sizes = np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, "<u8", n_docs, 8 * n_docs)
        known = np.unpackbits(np.frombuffer(index, np.uint8, -1, 16 * n_docs), count=n_docs)
        checkpoints = -(-n_ids // EVERY)
        offsets = np.cumsum(np.frombuffer(body, "<u4", checkpoints, n_index).astype(np.int64))
        words = np.frombuffer(body, ">u8", -(-n_bits // 64), n_index + 4 * checkpoints).astype(np.uint64)
        ids = decode(words, offsets, n_ids, table, code.most)
        yield [int(d) if k else None for d, k in zip(doc_ids, known)], sizes.astype(np.int64), ids
        begin += len(head) + n_body


@dataclass
class Written(WriterCommitMessage):
    task: int
    name: str
    end: int
    n_ids: int
    n_docs: int
    cuts: list


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    end: int
    ids_before: int


class TokenSource(DataSource):
    """``spark.read.format("token_huffman").load(path)``; written by ``save_ids``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], self.options["lengths"])


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        store, path = filesystem(self.path)
        from pyarrow.fs import FileSelector

        listed = [i for i in store.get_file_info(FileSelector(path)) if i.base_name.startswith(MANIFEST)]
        if len(listed) != 1:
            raise ValueError(f"{self.path} holds {len(listed)} manifests, one is needed")
        with store.open_input_stream(listed[0].path, compression=None) as f:
            files = json.loads(f.read())
        parts, before = [], 0
        for file in files:
            ends = [begin for begin, _ in file["cuts"][1:]] + [file["end"]]
            for (begin, ids), end in zip(file["cuts"], ends):
                parts.append(Part(f"{self.path.rstrip('/')}/{file['name']}", begin, end, before + ids))
            before += file["n_ids"]
        return parts or [Part("", 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        store, path = filesystem(partition.path)
        out = LAYOUT
        with store.open_input_file(path) as file:
            code, _ = read_code(file)
            start = partition.ids_before
            for doc_ids, sizes, ids in read_blocks(file, partition.begin, partition.end, code):
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                cells = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = (doc_ids, start + ends - sizes, sizes, cells)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
                start += int(sizes.sum())


class TokenWriter(DataSourceArrowWriter):
    """A file per task, in the order of the tasks; the manifest names those that count."""

    def __init__(self, path: str, lengths: str):
        self.path, self.lengths = path, lengths

    def write(self, iterator) -> Written:
        store, path = filesystem(self.path)
        with store.open_input_stream(filesystem(self.lengths)[1], compression=None) as f:
            code = Code(np.frombuffer(zlib.decompress(f.read()), np.uint8))
        store.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}{SUFFIX}"
        with store.open_output_stream(f"{path}/{name}", compression=None) as stream:
            out = FileOut(stream, code)
            doc_ids, texts, held = [], [], 0
            for batch in iterator:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _ids_of(batch)):
                    doc_ids.append(doc_id)
                    texts.append(ids)
                    held += len(texts[-1])
                    if held >= BLOCK_IDS:
                        out.block(doc_ids, texts)
                        doc_ids, texts, held = [], [], 0
            if doc_ids:
                out.block(doc_ids, texts)
        return Written(TaskContext.get().partitionId(), name, out.at, out.n_ids, out.n_docs, out.cuts)

    def commit(self, messages) -> None:
        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        files = [m.__dict__ for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) if m.n_docs]
        with store.open_output_stream(f"{path}/{MANIFEST}{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        store, path = filesystem(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{path}/{m.name}")


# ---- tokens


# What a byte belongs to. OTHER is a character that surely is no white space, ANY one of which nothing is said.
LETTER, DIGIT, SIGN, OTHER, SPACE, ANY = (1 << i for i in range(6))
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[:128] = SIGN
_KINDS[[*range(ord("0"), ord("9") + 1)]] = DIGIT
_KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
_KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
_KINDS[0x1C:0x20] = ANY
# White space beyond Latin-1, and characters that once were.
_SPACES = np.array([0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000])
# Bytes of a piece that are a key by themselves, and what fills up shorter ones: no text has the byte 255.
KEY_BYTES = 16
_FILL = np.array([[2**64 - 2 ** (8 * min(8, max(0, n - 8 * lane))) for lane in (0, 1)] for n in range(KEY_BYTES + 1)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
# Pieces looked up at once; pieces in one question to the library.
LOOKED_UP, ASKED = 1 << 18, 1000


def byte_kinds(data: np.ndarray, special: list[bytes]) -> np.ndarray:
    """The kind of every byte of UTF-8 texts; strings that stand for an id of their own are ANY."""
    kinds = _KINDS[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first, second = data[lead], data[lead + 1]
        letter = lead[(first == 0xC3) & (second != 0x97) & (second != 0xB7)]
        kinds[letter] = kinds[letter + 1] = LETTER
        space = lead[(first == 0xC2) & ((second == 0x85) | (second == 0xA0))]
        kinds[space] = kinds[space + 1] = ANY
        wide = lead[(first >= 0xE1) & (first <= 0xE3)]
        point = (data[wide] & np.int64(15)) << 12 | (data[wide + 1] & np.int64(63)) << 6 | (data[wide + 2] & np.int64(63))
        space = wide[np.isin(point, _SPACES)]
        kinds[space] = kinds[space + 1] = kinds[space + 2] = ANY
    raw = data.tobytes()
    for text in special:
        at = raw.find(text)
        while at >= 0:
            kinds[at : at + len(text)] = ANY
            at = raw.find(text, at + 1)
    return kinds


def piece_starts(data: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin that this tokenizer never joins; no cut where a kind leaves that open.

    It parts letters, digits and other signs, but for "'s" and the like. A space goes with what follows it. Of
    longer white space before something else the last character stands by itself or, a space, goes with that; the rest
    is one.
    """
    n = len(data)
    cut = np.zeros(n + 2, bool)
    solid, space = (kinds & (LETTER | DIGIT | SIGN | OTHER)) > 0, kinds == SPACE
    last = np.zeros(n, bool)
    last[1:-1] = space[:-2] & space[1:-1] & solid[2:]
    # What follows the end of a text belongs to the next one.
    last[begins[begins > 0] - 1] = False
    cut[:n] = last
    cut[1:n] |= solid[:-1] & space[1:]
    cut[begins] = True
    cut[1:n] |= cut[: n - 1] & space[:-1] & (data[:-1] != 32) & solid[1:]
    clear = kinds & (LETTER | DIGIT | SIGN)
    change = (clear[1:] != clear[:-1]) & (clear[1:] > 0) & (clear[:-1] > 0)
    cut[1:n] |= change & ~((data[:-1] == ord("'")) & (clear[1:] == LETTER))
    return np.flatnonzero(cut[:n])


class Known:
    """Ids of pieces by number, from 1 on. Pieces of up to KEY_BYTES are found side by side, in an open hash table of whole keys."""

    def __init__(self, dtype: str):
        self.size, self.n_ids = 1, 0
        # No piece has the key of number 0, which stands for a free slot.
        self.keys = np.full((1 << 12, 2), 2**64 - 1, np.uint64)
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, dtype)
        self.slots = np.zeros(1 << 13, np.int32)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def held(self) -> int:
        """Bytes, about."""
        return 32 * self.size + self.ids.itemsize * self.n_ids + self.slots.nbytes + self.long_bytes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] * _MIX[0]) ^ (keys[:, 1] * _MIX[1])
        h = (h ^ (h >> np.uint64(32))) * _MIX[0]
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, 0 where unknown."""
        slot = self._slot(keys)
        found = self.slots[slot]
        todo = np.flatnonzero(found)
        while len(todo):
            at = self.keys[found[todo]]
            todo = todo[(at[:, 0] != keys[todo, 0]) | (at[:, 1] != keys[todo, 1])]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            found[todo] = self.slots[slot[todo]]
            todo = todo[found[todo] > 0]
        return found

    def add(self, pieces: list[bytes], keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Different pieces not known so far, their keys, and their ids one after another."""
        begin, end = self.size, self.size + len(pieces)
        while end > len(self.keys):
            self.keys = np.concatenate([self.keys, np.full_like(self.keys, 2**64 - 1)])
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.keys[begin:end] = keys
        self.first[begin:end], self.count[begin:end] = self.n_ids + np.cumsum(count) - count, count
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.size, self.n_ids = end, self.n_ids + len(ids)
        long = [len(p) > KEY_BYTES for p in pieces]
        for number in np.flatnonzero(long).tolist():
            self.long[pieces[number]] = begin + number
            self.long_bytes += len(pieces[number]) + 150
            self.keys[begin + number] = 2**64 - 1
        if 2 * end > len(self.slots):
            self._lay()
        else:
            self._place(begin + np.flatnonzero(~np.array(long, bool)))

    def _lay(self) -> None:
        self.slots = np.zeros(max(1 << 13, 1 << (4 * self.size).bit_length()), np.int32)
        self._place(np.flatnonzero(self.keys[: self.size, 0] != 2**64 - 1))

    def _place(self, numbers: np.ndarray) -> None:
        slot = self._slot(self.keys[numbers])
        while len(numbers):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = numbers[free]  # of several the last stays
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self.slots) - 1)

    def keep(self, n: int) -> None:
        """Forgets all but the first ``n`` pieces: what came first comes most often."""
        self.size, self.n_ids = n + 1, int(self.first[n] + self.count[n])
        self.long = {p: number for p, number in self.long.items() if number <= n}
        self.long_bytes = sum(len(p) + 150 for p in self.long)
        self._lay()

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbers one after another, and where those of each end."""
        count = self.count[numbers]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.first[numbers] - ends + count, count) + np.arange(count.sum())], ends


class Tokens:
    """Ids of texts by the tokenizers library, which is asked once for every different piece of a text."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model)
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        # Strings that stand for one id of their own, whatever is around them.
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # What parts the pieces of one question.
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        self.known = Known(self.dtype)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned integers of ``dtype``."""
        raw = [t.encode() for t in texts]
        ids, ends = self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_bytes(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another in UTF-8, between ``edges``, and where those of each end."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(edges) - 1, np.int64)
        if self.known.held() > REMEMBERED:
            self.known.keep(self.known.size // 2)
        kinds = byte_kinds(data, self.special)
        starts = piece_starts(data, kinds, edges[:-1])
        stops = np.append(starts[1:], len(data))
        odd = np.add.reduceat(kinds == ANY, starts) > 0 if (kinds == ANY).any() else np.zeros(len(starts), bool)
        padded = np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)])
        raw = padded.tobytes()
        eights = np.ndarray(len(data) + KEY_BYTES - 7, "<u8", padded, strides=(1,))
        numbers = np.empty(len(starts), np.int32)
        for at in range(0, len(starts), LOOKED_UP):
            some = slice(at, at + LOOKED_UP)
            numbers[some] = self._numbers(raw, eights, starts[some], stops[some], odd[some])
        ids, ends = self.known.gathered(numbers)
        # Pieces before the end of each text.
        before = np.searchsorted(starts, edges[1:])
        return ids, np.concatenate([[0], ends])[before]

    def _numbers(self, raw: bytes, eights: np.ndarray, starts: np.ndarray, stops: np.ndarray, odd: np.ndarray) -> np.ndarray:
        known, sizes = self.known, stops - starts
        keys = _FILL[np.minimum(sizes, KEY_BYTES)]
        keys[:, 0] |= eights[starts]
        keys[:, 1] |= eights[starts + 8]
        numbers = known.find(keys)
        numbers[sizes > KEY_BYTES] = 0
        miss = np.flatnonzero(numbers == 0)
        if len(miss):
            pieces = [raw[a:b] for a, b in zip(starts[miss].tolist(), stops[miss].tolist())]
            fresh = {p: i for i, p in enumerate(pieces) if p not in known.long}
            at = miss[list(fresh.values())]
            self._learn(list(fresh), keys[at], odd[at])
            numbers[miss] = known.find(keys[miss])
            for i in np.flatnonzero(sizes[miss] > KEY_BYTES).tolist():
                numbers[miss[i]] = known.long[pieces[i]]
        return numbers

    def _learn(self, pieces: list[bytes], keys: np.ndarray, odd: np.ndarray) -> None:
        """Pieces of one text each are asked for together, parted by a line feed, which goes with no other; white space and odd ones alone."""
        single = odd | (np.array([p[-1] for p in pieces]) <= 32) | (len(self.newline) != 1)
        for some in np.array_split(np.flatnonzero(~single), np.count_nonzero(~single) // ASKED + 1):
            asked = [pieces[i] for i in some.tolist()]
            ids = np.array(self._ask([b"\n".join(asked)])[0], np.int64)
            parted = ids == self.newline[0] if asked else np.zeros(0, bool)
            ends = np.append(np.flatnonzero(parted), len(ids))
            if asked and len(ends) != len(asked):
                raise ValueError("this tokenizer joins pieces across a line feed")
            if asked:
                self.known.add(asked, keys[some], np.diff(ends, prepend=-1) - 1, ids[~parted])
        for some in np.array_split(np.flatnonzero(single), np.count_nonzero(single) // ASKED + 1):
            asked = [pieces[i] for i in some.tolist()]
            found = self._ask(asked)
            if asked:
                self.known.add(asked, keys[some], np.array([len(x) for x in found]), np.concatenate([np.array(x, np.int64) for x in found]))

    def _ask(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


@functools.lru_cache(maxsize=1)
def tokens_of(model: str) -> Tokens:
    """One per worker process: what it remembers serves later tasks too."""
    return Tokens(model)


def tokenized(documents: DataFrame, model: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, width, ids): ids of every whole text and the end id, little-endian in ``width`` bytes each."""
    out = arrow_schema("doc_id long, width int, ids binary")

    def run(batches):
        tokens = tokens_of(model)
        width = np.dtype(tokens.dtype).itemsize
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, ends = tokens.encode_bytes(*_laid(part.column("text")))
                ids = np.insert(ids, ends, end_id)
                edges = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * width
                cells = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                columns = [part.column("doc_id").cast(pa.int64()), pa.array([width] * len(ends), pa.int32()), cells.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, width int, ids binary")


def _laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and the edges between them."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data or b"", np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def _ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(raw, f"<u{w}") for w, raw in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist())]


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; as long as the largest id. A tokenizer's vocabulary bounds what reaches the driver."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in _ids_of(batch):
                found = np.bincount(ids, minlength=len(counts))
                if len(found) > len(counts):
                    counts = np.pad(counts, (0, len(found) - len(counts)))
                counts += found
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])

    rows = tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenSource)


def save_ids(documents: DataFrame, path: str, model: str, end_id: int = END_ID, most: int = LONGEST) -> np.ndarray:
    """Writes the ids of all documents under ``path``, an unused folder, in ascending order of doc_id; returns the code lengths.

    Texts are tokenized once: their ids are kept in the shared folder until counted and laid in order. A null text
    has the end id only. Rows without a doc_id come first; rows with equal doc_id are ordered by a hash of their ids
    and spread over tasks, however many there are. An empty table gives a manifest without files. Other columns are
    left out. A very long text is one row and one block.
    """
    docs = one_column(documents, "doc_id", "text")
    spark = docs.sparkSession
    register(spark)
    path = qualified(spark, path)
    plain = new_path(spark, "plain-ids")
    tokenized(docs, model, end_id).write.option("compression", "zstd").parquet(plain)
    ids = spark.read.parquet(plain)
    lengths = code_lengths(id_counts(ids), most)
    store, root = filesystem(path)
    store.create_dir(root, recursive=True)
    name = f"_lengths-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(zlib.compress(lengths.tobytes()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = ids.withColumn("_tie", F.xxhash64("ids"))
    laid = keyed.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "ids").drop("_tie")
    laid.write.format(FORMAT).option("lengths", f"{path.rstrip('/')}/{name}").mode("append").save(path)
    return lengths


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS of every document under ``path``: ``start`` ids lie before it; ``ids`` in four little-endian bytes each."""
    register(spark)
    return spark.read.format(FORMAT).load(qualified(spark, path))


def written_ids(documents: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, all from files written to the shared folder and read back."""
    path = new_path(documents.sparkSession, "token-ids")
    save_ids(documents, path, model)
    found = load_ids(documents.sparkSession, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
