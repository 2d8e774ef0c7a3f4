"""Token ids in files of patched frame-of-reference blocks.

Documents are cut into ranges of doc_id; each task encodes its range in order and
writes rows of chunks: whole documents whose ids, a block of 128 at a time, are stored
as differences from the block's minimum, packed at the width that a percentile of them
needs. Larger differences stand in an exception list. A chunk begins with the index of
its blocks' starts. Spark's writer commits the files, so a lost task leaves nothing.

A null or empty text has the end id alone. Repeated rows are documents of their own;
a null doc_id sorts first. An empty table gives empty files and no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.shared import freed, scratch, unused
from tidemark.llm.wordhash import mixed, stretches

BLOCK = 128
#: The share of a block's differences that its width must hold.
PERCENTILE = 95
#: Ids after which a chunk is closed at the end of a document.
CHUNK = 1 << 16
END_ID = 2
#: Bytes of words, and pieces of words, with their ids, that a worker remembers as steady; as many again as old, half of it as fresh.
MEMORY = 64_000_000
#: Bytes that an entry takes beside its characters and ids; texts encoded together, and bytes of plain ones cut together.
_ENTRY, _TEXTS, _BYTES = 180, 256, 1_000_000

# --- patched frame of reference --------------------------------------------------


def _widths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _packed(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row's values as ``width`` bits each, lowest first, in bytes."""
    if width in (8, 16, 32):
        return rows.astype(f"<u{width // 8}").view(np.uint8).reshape(len(rows), -1)
    bits = (rows[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")


def _unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return raw.view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(raw, axis=1, count=BLOCK * width, bitorder="little").reshape(len(raw), BLOCK, width)
    out = np.zeros((len(raw), BLOCK), np.uint32)
    for i in range(width):
        out |= bits[:, :, i].astype(np.uint32) << np.uint32(i)
    return out


def encode(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """u32 count, u32 start of each block, then blocks: u32 minimum, u8 width, u8 exceptions, the packed differences,
    u8 positions and u32 differences of the exceptions. The last block is filled up with its last value."""
    n = len(values)
    if not n:
        return np.zeros(1, "<u4").tobytes()
    count = -(-n // BLOCK)
    full = np.empty(count * BLOCK, np.uint32)
    full[:n] = values
    full[n:] = values[-1]
    rows = full.reshape(count, BLOCK)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    at = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = _widths(np.partition(rows, at, axis=1)[:, at])
    over = rows >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    exceptions = over.sum(axis=1)
    sizes = 6 + (BLOCK // 8) * width.astype(np.int64) + 5 * exceptions
    starts = 4 * (count + 1) + np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.uint8)
    out[:4] = np.array([n], "<u4").view(np.uint8)
    out[4 : 4 * (count + 1)] = starts[:-1].astype("<u4").view(np.uint8)
    head = np.empty((count, 6), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(count, 4)
    head[:, 4], head[:, 5] = width, exceptions
    out[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width):
        if w:
            chosen = np.flatnonzero(width == w)
            packed = _packed(rows[chosen] & np.uint32((1 << int(w)) - 1), int(w))
            out[starts[chosen, None] + 6 + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(exceptions)])[block]
        begin = starts[block] + 6 + (BLOCK // 8) * width[block].astype(np.int64)
        out[begin + nth] = place
        value = begin + exceptions[block] + 4 * nth
        out[value[:, None] + np.arange(4)] = rows[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def decode(raw: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values, or those of the blocks from ``first`` to before ``last``, found by the index."""
    data = np.frombuffer(raw, np.uint8)
    n = int(data[:4].view("<u4")[0])
    count = -(-n // BLOCK)
    last = count if last is None else min(last, count)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = data[4 : 4 * (count + 1)].view("<u4").astype(np.int64)[first:last]
    head = data[starts[:, None] + np.arange(6)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, exceptions = head[:, 4], head[:, 5].astype(np.int64)
    rows = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            chosen = np.flatnonzero(width == w)
            rows[chosen] = _unpacked(data[starts[chosen, None] + 6 + np.arange(BLOCK // 8 * int(w))], int(w))
    if exceptions.any():
        block = np.repeat(np.arange(len(rows)), exceptions)
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(exceptions)])[block]
        begin = starts[block] + 6 + (BLOCK // 8) * width[block].astype(np.int64)
        value = begin + exceptions[block] + 4 * nth
        rows[block, data[begin + nth]] = data[value[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    out = (rows + least[:, None]).reshape(-1)
    return out[: n - first * BLOCK] if last == count else out


# --- encoding of texts -----------------------------------------------------------

#: Texts of these characters alone are cut into pieces here; lower case and normal form leave them as they are.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017e"
_OTHER = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]|<[|]")
#: The tokenizer's own cut into pieces, for those characters; ids never reach over the end of a piece.
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
#: For each byte of Latin-1: white space, a mark, another of those characters (a), or none of them (?).
_KINDS = bytes(
    (b" " if chr(b).isspace() else b"a" if chr(b).isalnum() else b".")[0] if not _OTHER.match(chr(b)) else b"?"[0]
    for b in range(256)
)
#: Characters of a unit that the table of units holds, ids that it may have, and bytes of a slot.
_CHARACTERS, _IDS = 16, 8
_SLOT = _CHARACTERS + 4 * _IDS + 1


def _plain(text: str) -> tuple[bytes, bytes] | None:
    """A text in lower case and its characters' kinds, in Latin-1; none where it has other characters, or marks that end a piece
    elsewhere than where the kind changes."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return None
    if b"?" in kinds or "'" in text or "<|" in text:
        return None
    return text.lower().encode("latin-1"), kinds


#: Which bytes of eight belong to a unit of which so many are left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Units:
    """Ids of runs of letters of at most ``_CHARACTERS`` characters, looked up for many at once.

    A unit's key is its characters, so nothing is taken for another. It has a slot in each of two halves; where both
    are taken, it takes the place of one of them, by turns. So what is asked for often comes back.
    """

    def __init__(self, memory: int) -> None:
        self.bits = max(3, (memory // _SLOT // 2).bit_length() - 1)
        slots = 2 << self.bits
        self.keys = np.zeros((slots, 2), np.uint64)
        self.count = np.zeros(slots, np.uint8)
        self.ids = np.zeros((slots, _IDS), np.uint32)
        self.turn = 0

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys[:, 0] ^ mixed(keys[:, 1] + np.uint64(1)))
        low = np.uint64((1 << self.bits) - 1)
        return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64) + (1 << self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those not here."""
        first, second = self._slots(keys)
        found = np.where((self.keys[first] == keys).all(axis=1), first, -1)
        rest = np.flatnonzero(found < 0)
        second = second[rest]
        found[rest] = np.where((self.keys[second] == keys[rest]).all(axis=1), second, -1)
        return found

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Remember units that are not here, each once; where two want one slot, one of them gets it."""
        first, second = self._slots(keys)
        # No unit has a key of zeros.
        taken = (self.keys[first, 0] != 0) & ((self.keys[second, 0] == 0) | (self.turn == 1))
        at, which = np.unique(np.where(taken, second, first), return_index=True)
        self.turn = 1 - self.turn
        self.keys[at], self.ids[at], self.count[at] = keys[which], ids[which], count[which]


def _written_bytes() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_WRITTEN = _written_bytes()


class Encoder:
    """Ids of whole texts, with the ids of words and of pieces of words met lately kept.

    Ids never reach over white space, nor over the end of a piece, and a word of one piece is that piece; so words and
    pieces share a memory. The model encodes a new piece by itself, from its bytes written as the vocabulary writes
    them. Words of other characters go to the whole tokenizer, many at a time.

    A word met once is remembered among the fresh ones, which are forgotten when they fill their share of the memory;
    met again before that, it is steady. When steady words fill theirs, they become old ones, those old before are
    forgotten, and words asked for again come back. So frequent words stay, whenever they were met first, and all
    sizes are in bytes.

    Texts of the characters of ``_PIECES`` within Latin-1 are cut in numpy, many at once, and their short runs of letters are
    looked up in a table of their own, of half as many bytes; only what is not there is taken one by one.
    """

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Pieces come to the model once; those that are frequent are remembered here.
        self.tokenize = self.tokenizer.model.tokenize
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)]
        self.memory, self.steady_bytes, self.fresh_bytes = memory, 0, 0
        self.units = Units(memory // 2)
        self.steady: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _recall(self, text: str) -> bytes | None:
        """Ids of a word or piece that is not steady but was met before; it is steady from now on."""
        ids = self.fresh.pop(text, None)
        if ids is None:
            ids = self.old.get(text)
        if ids is not None:
            self.steady[text] = ids
            self.steady_bytes += _ENTRY + len(text) + len(ids)
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.steady.get(piece)
        if ids is None:
            ids = self._recall(piece)
        if ids is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_WRITTEN)
            raw = self.raw
            ids = self.fresh[piece] = b"".join([raw[token.id] for token in self.tokenize(written)])
            self.fresh_bytes += _ENTRY + len(piece) + len(ids)
        return ids

    def _ids(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not steady."""
        odd, cut, piece, others, out = _OTHER.search, _PIECES.findall, self._piece, [], {}
        for word in words:
            ids = self._recall(word)
            if ids is None:
                if odd(word):
                    others.append(word)
                    continue
                lower = word.lower()
                pieces = cut(lower)
                if len(pieces) == 1 and lower == word:
                    out[word] = piece(word)
                    continue
                ids = self.fresh[word] = b"".join(map(piece, pieces))
                self.fresh_bytes += _ENTRY + len(word) + len(ids)
            out[word] = ids
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            out[word] = self.fresh[word] = b"".join([self.raw[i] for i in found.ids])
            self.fresh_bytes += _ENTRY + len(word) + len(out[word])
        return out

    def rest(self) -> None:
        """Keep no more than the steady words until the next task."""
        self.fresh, self.old, self.fresh_bytes = {}, {}, 0

    def _words(self, rows: list[list[str]]) -> list[list[bytes]]:
        """Ids of each row's words."""
        get, found, open_words, need = self.steady.get, [], [], set()
        for row in rows:
            ids = list(map(get, row))
            if None in ids:
                at = [i for i, x in enumerate(ids) if x is None]
                words = [row[i] for i in at]
                need.update(words)
                open_words.append((ids, at, words))
            found.append(ids)
        new = self._ids(need) if need else {}
        for ids, at, words in open_words:
            for i, w in zip(at, words, strict=True):
                ids[i] = new[w]
        return found

    def _learnt(self, keys: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids (a row of ``_IDS`` each) and their number of new runs of letters, which the table then holds; those of more ids
        are not held, and their places are returned."""
        rows, count, many, raw = np.zeros((len(words), _IDS), np.uint32), np.zeros(len(words), np.int64), [], self.tokenize
        flat: list[int] = []
        for i, word in enumerate(words):
            ids = [token.id for token in raw(word if word.isascii() else word.encode().decode("latin-1").translate(_WRITTEN))]
            if len(ids) > _IDS:
                many.append(i)
            else:
                count[i] = len(ids)
                flat += ids
        rows[np.arange(_IDS) < count[:, None]] = flat
        held = np.flatnonzero(count > 0)
        self.units.add(keys[held], rows[held], count[held])
        return rows, count, many

    def _cut(self, texts: list[tuple[bytes, bytes]]) -> list[bytes]:
        """Each plain text's ids."""
        pad = b" " * _CHARACTERS
        joined = b" ".join([t for t, _ in texts]) + pad
        raw, kinds = np.frombuffer(joined, np.uint8), np.frombuffer(b" ".join([k for _, k in texts]) + b" ", np.uint8)
        edge = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
        starts, ends = edge[:-1], edge[1:]
        kind = kinds[starts]
        unit = kind != 32
        starts, ends, kind = starts[unit], ends[unit], kind[unit]
        # Runs with digits are of several pieces.
        digits = np.flatnonzero((raw >= 48) & (raw <= 57))
        whole = ends - starts <= _CHARACTERS
        whole[np.searchsorted(starts, digits, side="right") - 1] = False
        window = np.ndarray((len(raw) - 7,), "<u8", joined, strides=(1,))
        size = (ends - starts)[:, None] - np.array([0, 8])
        keys = np.stack([window[starts], window[starts + 8]], axis=1)
        keys &= _MASKS[np.clip(size, 0, 8)]
        slot = np.full(len(starts), -1)
        slot[whole] = self.units.find(keys[whole])
        rows, count = self.units.ids[slot], self.units.count[slot].astype(np.int64)
        text = joined.decode("latin-1")
        new = np.flatnonzero((slot < 0) & whole)
        one_by_one = np.flatnonzero(~whole).tolist()
        if len(new):
            names = [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            place: dict[str, int] = {}
            nth = np.array([place.setdefault(name, len(place)) for name in names])
            first = np.empty(len(place), np.int64)
            first[nth[::-1]] = new[::-1]
            own_rows, own_count, many = self._learnt(keys[first], list(place))
            rows[new], count[new] = own_rows[nth], own_count[nth]
            if many:
                one_by_one += new[np.isin(nth, many)].tolist()
                one_by_one.sort()
        long = np.zeros(len(starts), bool)
        if one_by_one:
            [found] = self._words([[text[starts[i] : ends[i]] for i in one_by_one]])
            long[one_by_one] = True
            count[one_by_one] = [len(x) // 4 for x in found]
        out = np.empty(count.sum(), "<u4")
        short = (np.arange(_IDS) < count[:, None]) & ~long[:, None]
        if one_by_one:
            beside = np.repeat(long, count)
            out[~beside] = rows[short]
            out[beside] = np.frombuffer(b"".join(found), "<u4")
        else:
            out[:] = rows[short]
        lengths = np.array([len(t) + 1 for t, _ in texts])
        at = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))]
        ids = out.tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian u32."""
        for begin in range(0, len(texts), _TEXTS):
            some = texts[begin : begin + _TEXTS]
            plain = [_plain(text) for text in some]
            rows = [
                text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                for text, cut in zip(some, plain, strict=True)
                if cut is None
            ]
            others = map(b"".join, self._words(rows))
            given = [cut for cut in plain if cut is not None]
            cuts = (ids for a, b in stretches([text for text, _ in given], _BYTES) for ids in self._cut(given[a:b]))
            for cut in plain:
                yield next(others) if cut is None else next(cuts)
            if self.fresh_bytes > self.memory // 2:
                self.fresh, self.fresh_bytes = {}, 0
            if self.steady_bytes > self.memory:
                self.old, self.steady, self.steady_bytes = self.steady, {}, 0


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """One encoder per worker process and vocabulary: words learnt in one task serve the next, within its memory."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path, memory)
    _ENCODERS[path].memory = memory
    return _ENCODERS[path]


# --- files -----------------------------------------------------------------------


def write_tokens(
    documents: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", end_id: int = END_ID, memory: int = MEMORY
) -> None:
    """Encode all texts and write the files below ``folder``, in ascending order of ``key`` over all parts."""
    kind = documents.schema[key].dataType
    tie = unused("tie", [key, "text"])
    slim = documents.select(F.col(key), F.col("text"), F.xxhash64("text").alias(tie))
    # The text's hash lets a range split rows of one repeated id, too.
    ordered = slim.repartitionByRange(key, tie).sortWithinPartitions(key, tie)
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("chunk", T.LongType()),
            T.StructField("begin", T.LongType()),
            T.StructField("ids", T.LongType()),
            T.StructField("docs", T.ArrayType(kind)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def chunks(batches):
        own, end = encoder(tokenizer, memory), np.array([end_id], "<u4").tobytes()
        part, number, begin = TaskContext.get().partitionId(), 0, 0
        docs, counts, raw, size = [], [], [], 0

        def chunk():
            payload = encode(np.frombuffer(b"".join(raw), "<u4"))
            row = {"part": part, "chunk": number, "begin": begin, "ids": size // 4}
            row |= {"docs": docs, "counts": counts, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema(
                    [
                        ("part", pa.int32()), ("chunk", pa.int64()), ("begin", pa.int64()), ("ids", pa.int64()),
                        ("docs", pa.list_(batch.schema.field(0).type)), ("counts", pa.list_(pa.int64())),
                        ("payload", pa.binary()),
                    ]
                )
            texts = [t or "" for t in batch["text"].to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(texts), strict=True):
                docs.append(doc)
                counts.append(len(ids) // 4 + 1)
                raw += [ids, end]
                size += len(ids) + 4
                if size >= 4 * CHUNK:
                    yield chunk()
                    number, begin = number + 1, begin + size // 4
                    docs, counts, raw, size = [], [], [], 0
        if docs:
            yield chunk()
        own.rest()

    ordered.mapInArrow(freed(chunks), schema).write.option("compression", "zstd").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start, n_tokens, ids) of all documents from the files; ``ids`` are little-endian u32 in a binary."""
    files = spark.read.parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Two numbers per part, and as many parts as tasks wrote: small at any size of the table.
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    kind = files.schema["docs"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("doc", kind),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def unpacked(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                raw = decode(row["payload"]).astype("<u4").tobytes()
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["docs"], batch.schema.field("docs").type.value_type),
                        pa.array(starts + row["begin"] + row["offset"]),
                        pa.array(counts),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    schema.names,
                )

    joined = files.join(F.broadcast(offsets), "part").select("docs", "counts", "begin", "offset", "payload")
    return joined.mapInArrow(unpacked, schema)


def token_files(documents: DataFrame, tokenizer: str, key: str = "doc_id", memory: int = MEMORY) -> DataFrame:
    """Write a table's ids and read the files back."""
    folder = scratch(documents.sparkSession, "tokens")
    write_tokens(documents, tokenizer, folder, key, memory=memory)
    return read_tokens(documents.sparkSession, folder)


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
