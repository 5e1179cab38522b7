"""Operator 2, best-fit packing: patterns by non-negative least squares, residuals by best fit.

Every document becomes token pieces of at most ``room`` tokens.  The driver sees only the histogram of piece
lengths (at most ``room`` rows, whatever the corpus).  It enumerates patterns of a few length classes that fill
a sequence, fits their repeat counts to the histogram by non-negative least squares, rounds them down, and
packs the remaining lengths by best fit, all as counts.  The plan maps (length, rank among that length) to a
place, and pieces are ranked by hash bucket, so that a length that most pieces share is no single group.

Defined results: a null or empty text is the end token alone; rows are pieces of their own, repeated or not;
a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import scratch

ROOM, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Length classes for the patterns, and documents in a pattern at most.
CLASSES, FEW = 128, 4
ROWS_PER_BUCKET = 4_000
#: Pieces of text whose ids a worker remembers at most, and bytes of text whose pieces it tells apart at once.
REMEMBERED, CHUNK = 200_000, 1 << 20
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("h", pa.int64())])


#: The vocabulary's own way to cut lower-cased text into pieces, for texts of Latin-1 characters.
LETTER, NUMBER, BLANK = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+")


#: The same classes for single characters: letters and others stand in runs, a number is a piece of its own.
IS_BLANK, IS_LETTER, IS_NUMBER, IS_OTHER = range(4)
CLASS = np.full(256, IS_OTHER, np.uint8)
for _kind, _chars in ((IS_LETTER, LETTER), (IS_NUMBER, NUMBER), (IS_BLANK, BLANK)):
    CLASS[[c for c in range(256) if re.match(f"[{_chars}]", chr(c))]] = _kind
LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
#: Endings that an apostrophe takes with it, where no other sign stands before it.
TAKEN = ("s", "t", "re", "ve", "m", "ll", "d")


def latin_pieces(chars: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``PIECE`` finds in rows of lower-case Latin-1 characters: the pieces' characters in a row, the borders of the
    pieces in them, and the borders of the rows, in pieces."""
    kind, n = CLASS[chars], len(chars)
    if not n:
        return chars, np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    border = np.ones(n + 1, bool)  # a piece or a blank begins
    border[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == IS_NUMBER)
    border[offs] = True
    at = np.flatnonzero((chars == ord("'")) & border[:n])
    if len(at):
        stop = offs[np.searchsorted(offs, at, "right")]
        for ending in TAKEN:
            fits = at + len(ending) < stop
            for i, c in enumerate(ending):
                fits &= chars[np.minimum(at + 1 + i, n - 1)] == ord(c)
            border[at[fits] + 1] = False
            border[at[fits] + 1 + len(ending)] = True
    solid = kind != IS_BLANK
    first = np.flatnonzero(border[:n] & solid)
    upto = np.concatenate([[0], np.cumsum(solid)])
    return chars[solid], np.append(upto[first], upto[n]), np.searchsorted(first, offs)


#: fixed values: the rules in a vocabulary file that ``PIECE`` stands for
RULES = {"normalizer": ["NFC", "Replace", "Lowercase"], "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def cuts_as_known(tokenizer) -> bool:
    """Does a vocabulary file normalise and cut texts by the rules that ``PIECE`` stands for?"""
    rules = json.loads(tokenizer.to_str())
    kinds = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
    cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    bytes_ = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in cuts[1:]] == [("ByteLevel", False, False)]
    return kinds == RULES["normalizer"] and cuts[0].get("pattern", {}).get("Regex") == RULES["pattern"] and cuts[0].get("invert") is True and bytes_ and rules["post_processor"] is None


class Encoder(dict):
    """Pieces of text to their token ids as little-endian bytes.

    With a vocabulary of other rules every text is encoded as a whole.

    The vocabulary drops blanks and merges only within the pieces that it cuts a text into.  So a Latin-1 text,
    which Unicode normalisation leaves alone, is the ids of its pieces in a row, and any other text that of
    its words; a text with control strings of the vocabulary or odd separators is encoded as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}  # the merges are of these
        self.tokenizer = Tokenizer.from_file(path)
        self.known = cuts_as_known(self.tokenizer)
        self.merges = self.tokenizer.model
        self.place: dict[bytes, int] = {}
        self.starts, self.flat = array("q", [0]), array("I")

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if len(word) > 64:
            return self.ids(word)
        self[word] = found = self.ids(word)
        return found

    def text(self, text: str) -> bytes:
        if not self.known or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.ids(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.__getitem__, text.split()))
        return b"".join(map(self.__getitem__, PIECE.findall(text.lower())))


    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the ids of Latin-1 pieces begin, as numbers into ``starts``; new pieces are encoded by the merges alone."""
        found = list(map(self.place.get, pieces))
        if None in found:
            if len(self.place) + found.count(None) > REMEMBERED:
                self.place, self.starts, self.flat = {}, array("q", [0]), array("I")
                found = [None] * len(pieces)
            for i in [i for i, at in enumerate(found) if at is None]:
                self.flat.extend([t.id for t in self.merges.tokenize(pieces[i].decode("latin-1").translate(self.letters))])
                found[i] = self.place[pieces[i]] = len(self.starts) - 1
                self.starts.append(len(self.flat))
        return np.array(found, np.int64)

    def rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, borders of the rows in them) of a chunk of UTF-8 texts; pieces are cut, told apart and put together as arrays."""
        odd = (data > 0xC3) | (data >= 0x1C) & (data <= 0x1F)
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        upto = np.concatenate([[0], np.cumsum(odd)])
        apart = upto[offs[1:]] > upto[offs[:-1]] if self.known else np.ones(len(offs) - 1, bool)
        if apart.any():
            plain = np.where(np.repeat(apart, np.diff(offs)), np.uint8(32), data)
        else:
            plain = data
        wide = plain >= 0xC2  # the first of the two bytes of a character
        chars = plain.copy()
        chars[1:][wide[:-1]] = (plain[:-1][wide[:-1]] & 3) << 6 | plain[1:][wide[:-1]] & 63
        short, borders, rows = latin_pieces(LOWER[chars[~wide]], offs - np.concatenate([[0], np.cumsum(wide)])[offs])
        pieces = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(short)]).dictionary_encode()
        place = self.places(pieces.dictionary.to_pylist())
        start = np.frombuffer(self.starts, np.int64)
        code = place[pieces.indices.to_numpy()]
        many = (start[1:] - start[:-1])[code]
        end = np.concatenate([[0], np.cumsum(many)])
        ids = np.frombuffer(self.flat, "<u4")[np.repeat(start[code] - end[:-1], many) + np.arange(end[-1])]
        at = end[rows]
        if apart.any():
            parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for r in np.flatnonzero(apart).tolist():
                parts[r] = np.frombuffer(self.text(data[offs[r] : offs[r + 1]].tobytes().decode()), "<u4")
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that tasks share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def tokenized(docs: DataFrame, room: int = ROOM, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every row's token ids: doc_id, piece, start, length, ids_crc32, h, and ids if asked for."""
    schema = pa.schema([*PIECES, ("ids", pa.binary())]) if with_ids else PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or vocabulary_path())
        end = np.array([END_ID], "<u4")
        for batch in batches:
            ids, hashes, rows, size = batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("h").to_pylist(), [], 0
            for lo, hi, data, offs in K.text_chunks(batch, size=CHUNK):
                tokens, borders = own.rows(data, offs)
                for r in range(lo, hi):
                    blob = np.append(tokens[borders[r - lo] : borders[r - lo + 1]], end).tobytes()
                    for piece, at in enumerate(range(0, len(blob), 4 * room)):
                        part = blob[at : at + 4 * room]
                        rows.append((ids[r], piece, at // 4, len(part) // 4, zlib.crc32(part), hashes[r], *([part] if with_ids else [])))
                        size += len(part) if with_ids else 0
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    return source.mapInArrow(K.released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, h long" + ", ids binary" * with_ids)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600, accuracy: float = 1e-9) -> np.ndarray:
    """min |a x - b| for x >= 0, by the active-set method of Lawson and Hanson (1974).

    It ends when no column's gradient is above ``accuracy`` times the largest one at x = 0.
    """
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    right = a.T @ b
    tolerance = accuracy * max(1e-300, np.abs(right).max(initial=0))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            own = a[:, at]
            square = own.T @ own
            s = np.linalg.solve(square + 1e-12 * np.trace(square) / len(at) * np.eye(len(at)), right[at])
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(classes: int, few: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Falling tuples of up to ``few`` present classes that add up to ``classes``."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], rest: int, most: int) -> None:
        left = few - len(head)
        if left == 0:
            return
        for c in range(min(most, rest), -(-rest // left) - 1, -1):
            if c and present[c]:
                if c == rest:
                    found.append((*head, c))
                else:
                    grow((*head, c), rest - c, c)

    grow((), classes, classes)
    return found


class Plan(NamedTuple):
    """Placements in order of (length, first rank): ``each`` pieces a sequence, from ``offset``, on from ``sequence``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 42) + self.rank
        i = np.searchsorted(key, (length << 42) + rank, "right") - 1
        at = rank - self.rank[i]
        return self.sequence[i] + at // self.each[i], self.offset[i] + at % self.each[i] * length


def pack(histogram: dict[int, int], room: int = ROOM, classes: int = CLASSES, few: int = FEW) -> Plan:
    """Plan for so many pieces of each length.  Work and memory depend on ``room``, not on the counts."""
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # free room -> runs of sequences (first, count)
    sequences = 0

    def put(length: int, n: int, first: int, each: int, free: int) -> None:
        rows.append((length, used[length], first, each, room - free))
        used[length] += n
        left[length] -= n

    lengths = sorted(left)

    def longest(free: int) -> int:
        """The longest piece left that is no longer than free; 0 if there is none."""
        i = bisect.bisect_right(lengths, free) - 1
        while i >= 0 and not left[lengths[i]]:
            i -= 1
        return lengths[i] if i >= 0 else 0

    width = room / classes
    of = {length: int(np.ceil(length / width)) for length in left}
    members: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        members.setdefault(of[length], []).append(length)
    total = np.zeros(classes + 1)
    for length, n in left.items():
        total[of[length]] += n
    some = patterns(classes, few, total > 0)
    if some:
        matrix = np.zeros((classes + 1, len(some)))
        for j, p in enumerate(some):
            np.add.at(matrix[:, j], list(p), 1.0)
        weight = np.arange(classes + 1.0)  # a class counts by the room it takes
        repeats = nnls(matrix * weight[:, None], total * weight, accuracy=1e-5)  # counts are rounded anyway
        for j in np.argsort(-repeats, kind="stable"):
            n = int(repeats[j])
            for c in set(some[j]):
                n = min(n, int(sum(left[x] for x in members[c]) // some[j].count(c)))
            if n < 1:
                continue
            runs = [(sequences, n, room)]
            sequences += n
            for slot, c in enumerate(some[j]):
                after = []
                for first, count, free in runs:
                    while count:
                        # the last slot takes the longest piece that fits what the rounded classes left free
                        length = longest(free) if slot == len(some[j]) - 1 else next(x for x in members[c] if left[x])
                        if not length:
                            after.append((first, count, free))
                            break
                        m = min(count, left[length])
                        put(length, m, first, 1, free)
                        after.append((first, m, free - length))
                        first, count = first + m, count - m
                runs = after
            for first, count, free in runs:
                if free:
                    groups.setdefault(free, []).append((first, count))
    rooms = sorted(groups)
    for length in sorted(left, reverse=True):
        while left[length]:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                free = rooms[i]
                first, count = groups[free].pop()
                if not groups[free]:
                    del groups[free], rooms[i]
            else:
                free, first, count = room, sequences, -(-left[length] // (room // length))
                sequences += count
            each = free // length
            full = min(count, left[length] // each)
            parts = [(first, full, each)] if full else []
            if full < count and (rest := left[length] - full * each):
                parts.append((first + full, 1, rest))
            for at, n, k in parts:
                put(length, n * k, at, k, free)
                if free - k * length:
                    bisect.insort(rooms, free - k * length) if free - k * length not in groups else None
                    groups.setdefault(free - k * length, []).append((at, n))
            done = sum(n for _, n, _ in parts)
            if done < count:
                bisect.insort(rooms, free) if free not in groups else None
                groups.setdefault(free, []).append((first + done, count - done))
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def packed(docs: DataFrame, room: int = ROOM, path: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    pieces = scratch(tokenized(docs, room, path), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(pack(histogram, room))
    buckets = max(1, sum(histogram.values()) // ROWS_PER_BUCKET)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("h", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "bucket").orderBy("h", "piece", "doc_id", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inner) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    schema = pa.schema([*[f for f in PIECES if f.name != "h"], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:5]), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(K.released(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2(docs: DataFrame) -> DataFrame:
    return packed(docs)
