"""Token ids in a byte-aligned variable-length file format.

Ids are coded by their rank of frequency over all documents, so that the most
frequent 256 take one byte, the next 65,280 two, and so on up to four.  A file
keeps the lengths apart from the bytes: a control byte has two bits for each
of four values (Lemire, Kurz, Rupp 2018, without its SIMD shuffles), and numpy
tables turn control bytes into lengths and places.

A file: magic, format version, number of documents and of values, length of
the rank table, the table (rank -> id, 32 bits), the documents' ids, start
positions and value counts (64 bits each), control bytes, data bytes, and a
CRC-32 of all that.  Files are cut at about FILE_TOKENS values; they are named
by their first start position, in ascending order of doc_id.  A writing task
puts each file in place only when complete and reports its name, so that an
attempt that was lost or repeated leaves nothing that is read.

Cases: a null or empty text has the end id alone; rows that repeat an id are
encoded each, in the order of their texts; rows without an id come first;
an empty table gives no file and no row; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import itertools
import json
import struct
import sys
import types
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _words

END_ID = 2
FILE_TOKENS = 1 << 21
CUT_BYTES = 1 << 20  #: of texts that are encoded at once, unless one text has more
CACHE_WORDS = 1_000_000  #: stretches that a worker remembers
MAGIC = b"VBIDS\x00\x01\x00"
HEAD = "<8sQQQ"


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = sizes - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4)[None, :] < sizes[:, None]].tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: a table gives each control byte's four lengths, sums
    of lengths give places, and each byte place is one gather."""
    lengths_of = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
    sizes = lengths_of[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)).astype(np.uint32)
    out = raw[starts]
    for k in range(1, 4):
        long = np.flatnonzero(sizes > k)
        out[long] |= raw[starts[long] + k] << np.uint32(8 * k)
    return out


def pack(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, ranks: np.ndarray, id_of: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    body = b"".join(
        [
            struct.pack(HEAD, MAGIC, len(docs), len(ranks), len(id_of)),
            id_of.astype("<u4").tobytes(),
            docs.astype("<i8").tobytes(),
            starts.astype("<i8").tobytes(),
            counts.astype("<i8").tobytes(),
            control,
            data,
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(blob: bytes):
    """doc ids, starts, counts and ids of a file; raises ValueError if it is damaged."""
    body = memoryview(blob)[:-4]
    if len(blob) < struct.calcsize(HEAD) + 4 or zlib.crc32(body) != struct.unpack("<I", blob[-4:])[0]:
        raise ValueError("the file's check sum differs")
    magic, n_docs, n_values, n_table = struct.unpack(HEAD, body[: struct.calcsize(HEAD)])
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    at = struct.calcsize(HEAD)
    id_of = np.frombuffer(body, "<u4", n_table, at)
    at += 4 * n_table
    docs, starts, counts = (np.frombuffer(body, "<i8", n_docs, at + 8 * n_docs * k) for k in range(3))
    at += 24 * n_docs
    n_control = -(-n_values // 4)
    ranks = decode_values(bytes(body[at : at + n_control]), bytes(body[at + n_control :]), n_values)
    return docs, starts, counts, id_of[ranks]


def _stretched(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of an array that begin at starts, one after another."""
    ahead = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - ahead, sizes) + np.arange(sizes.sum())]


def _lines(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of bytes that stand one after another, each with a line feed behind."""
    return np.insert(data, np.cumsum(lengths), 10)


class Known:
    """What stretches encode to: found by 64-bit hash, confirmed by their bytes.

    A stretch's place is the order in which it came; slots, of which at most
    half are taken, give the place of a hash, the next free one where two meet.
    Ids and bytes stand in two flat arrays, some 60 bytes a stretch in all and
    no Python objects; it is emptied when it holds CACHE_WORDS stretches.
    """

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self.slots = np.full(1 << 12, -1, np.int32)
        self.hashes = np.zeros(1 << 11, np.uint64)
        self.flat = {"ids": np.zeros(1 << 16, self.kind), "text": np.zeros(1 << 16, np.uint8)}
        self.limits = {of: np.zeros(1 << 11, np.int64) for of in self.flat}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 for those that are not there."""
        last = np.uint64(len(self.slots) - 1)
        slot = (hashes & last).astype(np.int64)
        k = self.slots[slot]
        todo = np.flatnonzero((self.hashes[k] != hashes) & (k >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & int(last)
            k[todo] = self.slots[slot[todo]]
            todo = todo[(self.hashes[k[todo]] != hashes[todo]) & (k[todo] >= 0)]
        return k

    def _settle(self, places: np.ndarray) -> None:
        """Give the hashes at these places slots."""
        last = len(self.slots) - 1
        slot = (self.hashes[places] & np.uint64(last)).astype(np.int64)
        while len(places):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = places[free]
            lost = self.slots[slot] != places
            places, slot = places[lost], slot[lost] + 1 & last

    def add(self, hashes: np.ndarray, text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Different hashes that are not in the table, with the bytes of what has
        them and its ids, one after another, and how many of each."""
        old, self.count = self.count, self.count + len(hashes)
        self.hashes = _with(self.hashes, old, hashes)
        for of, data, n in (("text", text, lengths), ("ids", ids, sizes)):
            used = self.limits[of][old]
            self.flat[of] = _with(self.flat[of], used, data)
            self.limits[of] = _with(self.limits[of], old + 1, used + np.cumsum(n))
        if 2 * self.count > len(self.slots):
            self.slots, old = np.full(1 << (4 * self.count).bit_length(), -1, np.int32), 0
        self._settle(np.arange(old, self.count, dtype=np.int32))

    def sizes(self, of: str, k: np.ndarray) -> np.ndarray:
        return self.limits[of][k + 1] - self.limits[of][k]

    def gather(self, of: str, k: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids or bytes of the stretches at these places, one after another."""
        return _stretched(self.flat[of], self.limits[of][k], sizes)

    def differ(self, k: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which stretches of data are not the ones at these places."""
        n = ends - starts
        unlike = self.sizes("text", k) != n
        if unlike.any():  # lengths that differ say enough
            of = np.flatnonzero(~unlike)
            unlike[of] = self.differ(k[of], data, starts[of], ends[of])
            return unlike
        wrong = self.gather("text", k, n) != _stretched(data, starts, n)
        if wrong.any():
            ahead = np.cumsum(n) - n
            unlike[np.searchsorted(ahead, np.flatnonzero(wrong), "right") - 1] = True
        return unlike


def _with(held: np.ndarray, used: int, data: np.ndarray) -> np.ndarray:
    """An array whose first values are used, with data behind them."""
    if used + len(data) > len(held):
        held = np.concatenate([held[:used], np.zeros(used + 2 * len(data), held.dtype)])
    held[used : used + len(data)] = data
    return held


#: The normal form and the pieces of a tokenizer whose texts may be cut at blanks.
NORMAL_FORM = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


#: What a byte of a text in small letters belongs to.  LEAD begins a letter of two bytes (Latin to U+027F, Cyrillic to
#: U+047F); a byte of any other character that is not ASCII may be anything.
BLANK, LETTER, DIGIT, OTHER, APOSTROPHE, UNKNOWN, LEAD = range(7)
KINDS = np.full(256, UNKNOWN, np.uint8)
KINDS[:128] = OTHER
KINDS[[10, 32]], KINDS[97:123], KINDS[48:58], KINDS[39] = BLANK, LETTER, DIGIT, APOSTROPHE
KINDS[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = LEAD


def _meet(a: int, b: int) -> bool:
    """Whether PIECES never have a piece with both of two neighbours, of kinds a and b, or one is a blank."""
    if a == b or BLANK in (a, b):
        return a != b
    if UNKNOWN in (a, b) or {a, b} == {OTHER, APOSTROPHE}:
        return False
    return (a, b) != (APOSTROPHE, LETTER)  # as in "it's"


CUTS = np.array([[_meet(a, b) for b in range(8)] for a in range(8)]).reshape(-1)


def _kinds(raw: np.ndarray) -> np.ndarray:
    """BLANK to UNKNOWN for each byte of whole characters."""
    kinds = KINDS[raw]
    lead = np.flatnonzero(kinds == LEAD)
    if len(lead):
        kinds[lead] = kinds[lead + 1] = LETTER
        signs = lead[(raw[lead] == 0xC3) & (raw[lead + 1] & 0xDF == 0x97)]  # multiplication and division
        kinds[signs] = kinds[signs + 1] = UNKNOWN
    return kinds


class Pieces(_words.Hasher):
    """Cuts texts at blanks, and where letters, digits and other characters meet."""

    def __init__(self):
        super().__init__(KINDS == BLANK, lower_ascii=False)

    def limits(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds = _kinds(raw)
        turn = np.flatnonzero(CUTS[kinds[:-1] << 3 | kinds[1:]]) + 1
        limits = np.concatenate([[0], turn, [len(raw)]])
        own = np.flatnonzero(kinds[limits[:-1]] != BLANK)
        return limits[own], limits[own + 1]


class Encoder:
    """A tokenizer of the tokenizers library that remembers what the stretches
    of a text encode to.

    Where the tokenizer has NORMAL_FORM and PIECES, white space never is part of
    a token and capitals encode like small letters, so texts are lower-cased
    and cut at blanks, and where a letter, a digit and another character meet,
    which always are in different pieces but for a letter behind an apostrophe;
    a character that may be of either kind is not cut off.  Texts that may hold
    a special token, or characters whose small form depends on context or
    composition, are encoded as they are, and so is every text of another
    tokenizer.  A new stretch of letters is one piece to the splitting rules
    and goes to the model at once; others are encoded together, with a mark
    between them.

    Stretches are found by numpy for many texts at once, by 64-bit hashes; one
    of each is looked up, the ids of all are gathered by their places.  Every
    stretch is held against the bytes of the one that its hash found; a text
    in which one differs is encoded as it is.
    """

    MARK = "\x01"
    ODD = ("<|", "\u03a3", "\u0130")

    def __init__(self, path: str):
        self.tokenizer, self.known = _held(path)
        self.type = self.known.kind
        self.code = self.type.char
        self.end = array(self.code, [END_ID]).tobytes()
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.cuts = self._cuts_at_blanks()
        self.hasher = Pieces()
        # byte-level models write a byte as the character of its number, or of 256 and up where that is not printable
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = np.arange(256, dtype="<u2")
        others = np.setdiff1d(self.shown, shown)
        self.shown[others] = 256 + np.arange(len(others))

    def _cuts_at_blanks(self) -> bool:
        """Whether this is a tokenizer of the kind for which cutting is exact."""
        t = self.tokenizer
        rules = lambda part: None if part is None else json.loads(part.__getstate__())
        special = all(x.content.startswith("<|") for x in t.get_added_tokens_decoder().values())
        alike = rules(t.normalizer) == NORMAL_FORM and rules(t.pre_tokenizer) == PIECES
        return alike and special and t.post_processor is None and t.truncation is None and t.padding is None and len(self.mark) == 1

    def _plain(self, text: str | None) -> bool:
        """Whether a text may be cut; a null or empty one may."""
        if not text:
            return True
        if not self.cuts or any(x in text for x in self.ODD):
            return False
        # a small letter may compose with a mark where its capital does not
        return text.isascii() or all(unicodedata.is_normalized("NFC", x) for x in (text, text.lower()))

    def _learn(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new stretches, one after another, and how many each has."""
        starts, tokenize = np.cumsum(lengths) - lengths, self.tokenizer.model.tokenize
        words = np.logical_and.reduceat(_kinds(data) == LETTER, starts)
        odd = np.flatnonzero(~words)
        rest = iter(self._odd(_lines(_stretched(data, starts[odd], lengths[odd]), lengths[odd]).tobytes().decode("utf-8").split("\n")[:-1]))
        shown = self.shown[_lines(data, lengths)].tobytes().decode("utf-16-le").split(chr(self.shown[10]))
        found = [[x.id for x in tokenize(s)] if word else next(rest) for s, word in zip(shown, words.tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), self.type, int(sizes.sum())), sizes

    def _odd(self, stretches: list[str]) -> list[list[int]]:
        """The ids of each stretch that is no plain word."""
        out = {word: self._ids_of(word) for word in stretches if self.MARK in word}
        odd = [word for word in stretches if self.MARK not in word]
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            got = np.array(self._ids_of(f" {self.MARK} ".join(part)), np.int64)
            limits = [-1, *np.flatnonzero(got == self.mark[0]).tolist(), len(got)]
            listed = got.tolist()
            out.update((word, listed[a + 1 : b]) for word, a, b in zip(part, limits[:-1], limits[1:], strict=True))
        return [out[word] for word in stretches]

    def _ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self, text: str) -> bytes:
        return array(self.code, self._ids_of(text)).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with the end id, as little-endian integers of self.type."""
        texts = [t.encode("utf-8", "replace").decode("utf-8") if isinstance(t, str) else "" for t in texts]
        plain = [self._plain(t) for t in texts]
        if len(texts) == 1 and plain[0]:  # perhaps a very long one
            return [b"".join(self._ids([x], [True])[0] for x in _segments(texts[0], CUT_BYTES)) + self.end]
        return [x + self.end for x in self._ids(texts, plain)]

    def _ids(self, texts: list[str], plain: list[bool]) -> list[bytes]:
        parts = [t.lower().encode("utf-8") if p else b"" for t, p in zip(texts, plain)]
        data = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        starts, ends, stretch = self.hasher.words(data)
        hashes = stretch(starts, ends)
        if self.known.count > CACHE_WORDS:
            self.known.clear()
        k = self.known.find(hashes)
        miss = np.flatnonzero(k < 0)
        if len(miss):
            new, first, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
            first, old = miss[first], self.known.count
            lengths = ends[first] - starts[first]
            own = _stretched(raw, starts[first], lengths)
            self.known.add(new, own, lengths, *self._learn(own, lengths))
            k[miss] = old + which
        begins = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])]))
        for i in np.flatnonzero(self.known.differ(k, raw, starts, ends)):
            plain[int(np.searchsorted(begins, i, "right")) - 1] = False
        sizes = self.known.sizes("ids", k)
        ids = self.known.gather("ids", k, sizes).tobytes()
        limits = np.concatenate([[0], np.cumsum(sizes)])[begins] * self.type.itemsize
        return [ids[a:b] if p else self._direct(t) for t, p, a, b in zip(texts, plain, limits[:-1].tolist(), limits[1:].tolist())]


def _held(path: str):
    """The tokenizer of a path and what this worker has learned of it.  A worker
    runs many tasks; both stay, in a module of their own, bounded by CACHE_WORDS."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    name = "_noticelab_tokenizers"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if path not in kept:
        tokenizer = tokenizers.Tokenizer.from_file(path)
        code = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        kept[path] = tokenizer, Known(np.dtype(code).newbyteorder("<"))
    return kept[path]


def _segments(text: str, most: int):
    """A text in parts of about `most` characters that end before a blank."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > most:
            blank = text.rfind(" ", at + 1, at + most)
            end = blank if blank > 0 else text.find(" ", at + most)
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode documents (doc_id, text) and write the files.  Returns one row
    per file: path, first start, number of documents and of tokens."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    folder = _shared.new_path(spark, "token-ids")

    def encoded(frames):
        """Each text's ids and its place among the partition's, then the partition's count of each id."""
        encoder, tally, begin = Encoder(path), np.zeros(0, np.int64), 0
        packer, width = zstandard.ZstdCompressor(level=1), encoder.type.itemsize
        for own in frames:
            got = encoder(own["text"].tolist())
            sizes = np.array([len(x) // width for x in got], np.int64)
            places = begin + np.cumsum(sizes) - sizes
            begin += int(sizes.sum())
            tally = _added(tally, np.bincount(np.frombuffer(b"".join(got), encoder.type)))
            yield pd.DataFrame(
                {"doc_id": own["doc_id"], "place": places, "n_tokens": sizes, "wide": width == 4, "ids": [packer.compress(x) for x in got]}
            )
        some = np.flatnonzero(tally)
        if len(some):
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([None], "Int64"),
                    "place": [-1],
                    "n_tokens": [begin],
                    "wide": [False],
                    "ids": [np.stack([some, tally[some]]).astype("<i8").tobytes()],
                }
            )

    # the last key spreads rows that repeat an id and its text; their order among themselves is the same to all
    order = ("doc_id", "_hash", "_row")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        "text",
        F.xxhash64("text").alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = _shared.map_frames(rows, encoded, "doc_id long, place long, n_tokens long, wide boolean, ids binary", CUT_BYTES)
    rows = _shared.written(rows.withColumn("part", F.spark_partition_id()), "ids")
    tallies = _shared.map_frames(rows.where("place < 0").select("ids"), _tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most a row for each id of the vocabulary
    id_of = np.array([r[0] for r in tallies.orderBy(F.col("n").desc(), "id").select("id").collect()], np.uint32)
    # a row for each partition of the encoding stage
    sizes = rows.where("place < 0").select("part", "n_tokens").orderBy("part").collect()
    offsets, total = {}, 0
    for part, n in sizes:
        offsets[part] = total
        total += n
    held = spark.sparkContext.broadcast((id_of, offsets))
    schema = "path string, start long, n_docs long, n_tokens long"

    def files(frames):
        id_of, offsets = held.value
        rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
        rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
        kept, size, opener = [], 0, zstandard.ZstdDecompressor()

        def put():
            docs, starts, counts, ids = (np.concatenate(x) for x in zip(*kept))
            name = f"{folder}/{starts[0]:020d}-{uuid.uuid4().hex}.vbids"
            _shared.put_file(name, pack(docs, starts, counts, rank_of[ids], id_of))
            return pd.DataFrame({"path": [name], "start": [starts[0]], "n_docs": [len(docs)], "n_tokens": [len(ids)]})

        for cut in frames:
            counts = cut["n_tokens"].to_numpy(np.int64)
            starts = cut["place"].to_numpy(np.int64) + cut["part"].map(offsets).to_numpy(np.int64)
            ids = [np.frombuffer(opener.decompress(x), "<u4" if w else "<u2").astype(np.uint32) for x, w in zip(cut["ids"], cut["wide"])]
            names = cut["doc_id"].fillna(NO_ID).to_numpy(np.int64)
            gaps = np.flatnonzero(starts[1:] != (starts + counts)[:-1]) + 1
            for own in np.split(np.arange(len(cut)), gaps):
                if kept and (kept[-1][1][-1] + kept[-1][2][-1] != starts[own[0]] or size >= FILE_TOKENS):
                    yield put()  # what comes next does not follow upon this, or the file is full
                    kept, size = [], 0
                kept.append((names[own], starts[own], counts[own], np.concatenate([ids[i] for i in own])))
                size += int(counts[own].sum())
        if kept:
            yield put()

    # the table's files keep the order in which each partition was encoded
    rows = rows.where("place >= 0").select("part", "doc_id", "place", "n_tokens", "wide", "ids")
    return _shared.written(_shared.map_frames(rows, files, schema, CUT_BYTES // 4), "token-files")


#: Stands for a missing doc_id in a file.
NO_ID = -(1 << 63)


def _added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(x), len(y)), np.int64)
    out[: len(x)] += x
    out[: len(y)] += y
    return out


def _tally(frames):
    """The counts of a task's rows, summed."""
    total = np.zeros(0, np.int64)
    for pdf in frames:
        for x in pdf["ids"]:
            ids, n = np.frombuffer(x, "<i8").reshape(2, -1)
            total = _added(total, np.bincount(ids, n).astype(np.int64))
    some = np.flatnonzero(total)
    yield pd.DataFrame({"id": some, "n": total[some]})


def _read(frames):
    for pdf in frames:
        for path in pdf["path"]:
            docs, starts, counts, ids = unpack(_shared.get_file(path))
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
            sums = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends, counts)]
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([None if d == NO_ID else d for d in docs.tolist()], "Int64"),
                    "start": starts,
                    "n_tokens": counts,
                    "ids_crc32": sums,
                }
            )


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document, from the files."""
    return _shared.map_frames(files.select("path"), _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(_shared.table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return read(write(docs))
