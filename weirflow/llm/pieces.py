"""SentencePiece encoding with byte spans in the original text, and decoding.

A text is normalised left to right: at each place the longest key of the model's compiled character map that the text goes on
with is replaced by its value (any other character stays), spaces become the mark U+2581, one mark goes in front, and, where
the model asks for it, runs of spaces shrink and outer ones go. Next to the normalised text goes the source position of each
of its characters: all characters of a replaced stretch stand at the stretch's start. So every piece of the normalised text is
projected to the bytes of the original that it stands for, and the spans of a text's pieces are ascending and do not overlap.

Pieces are made by byte-pair merging, best score first, ties to the left. A normalised text is cut into units that no piece of
the vocabulary can cross; where the vocabulary has crossing ones, a text is one unit. Units repeat, so a worker keeps short
ones in a table of bounded size. A long unit is merged in windows: two encodings side by side are the encoding of the whole if
their neighbouring pieces, merged on their own, stay as they are (any merge across would happen there as well), so a window is
closed at a piece boundary where that holds, and only one window's symbols are held. A character outside the vocabulary is its
UTF-8 bytes, the last of which carries the character's span.

Documents are independent rows: one scan without a shuffle, and a lost task is run again.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows are encoded each; extra columns
are carried in a struct, whatever their names; an empty table gives an empty result; a text of any length is encoded whole, in
memory that grows with that text alone; special strings inside texts are plain text.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.llm.common import held, slices, text_of

MARK = "▁"
#: Entries of a worker's table of units (some 250 bytes each) and the longest unit kept there.
CACHE_UNITS, CACHED_CHARS = 600_000, 48
#: Characters of a unit that are merged at once, and how far from its end a window may be closed.
WINDOW, MARGIN = 65_536, 256


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: a double-array trie of UTF-8 keys, whose values are places of zero-ended strings behind it."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], dtype="<u4").tolist()
        self.values = compiled[4 + size :]
        self.starts = re.compile("[" + "".join(map(re.escape, self.first_characters())) + "]") if self.units else None

    def child(self, node: int, byte: int) -> int | None:
        """The node behind ``node`` by ``byte``; a node is the place whose unit holds its offset."""
        unit = self.units[node]
        place = node ^ self.offset(unit) ^ byte
        return place if place < len(self.units) and self.units[place] & 0x800000FF == byte else None

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def first_characters(self) -> list[str]:
        """Characters with which a key starts."""
        found, paths = [], [(0, b"")]
        while paths:
            node, path = paths.pop()
            for byte in range(1, 256):
                nxt = self.child(node, byte)
                if nxt is not None:
                    longer = path + bytes([byte])
                    width = 1 if longer[0] < 0x80 else 2 if longer[0] < 0xE0 else 3 if longer[0] < 0xF0 else 4
                    if len(longer) == width:
                        found.append(longer.decode())
                    else:
                        paths.append((nxt, longer))
        return found

    def longest(self, text: bytes) -> tuple[int, str] | None:
        """Length in bytes and value of the longest key that ``text`` starts with."""
        node, best = 0, None
        for i, byte in enumerate(text):
            node = self.child(node, byte) if byte else None
            if node is None:
                break
            unit = self.units[node]
            if unit >> 8 & 1:
                best = (i + 1, self.units[node ^ self.offset(unit)] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.values[best[1] : self.values.index(b"\0", best[1])].decode()

    def replaced(self, text: str, longest_key: int = 64) -> Iterator[tuple[str, int, bool]]:
        """The text as (normalised, source bytes, whether a key was replaced) from left to right."""
        done = at = 0
        while self.starts and (m := self.starts.search(text, at)):
            hit = self.longest(text[m.start() : m.start() + longest_key].encode())
            if hit is None:
                at = m.end()
                continue
            if m.start() > done:
                yield text[done : m.start()], 0, False
            size, value = hit
            yield value, size, True
            done = at = m.start() + len(text[m.start() : m.start() + longest_key].encode()[:size].decode())
        if done < len(text):
            yield text[done:], 0, False


def widths(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype("uint8")


def unit_pattern(vocabulary: Iterable[str]) -> re.Pattern | None:
    """Units that no piece crosses: marks stay with what follows, line feeds stand alone, letters are apart from what is none.
    A letter that some piece joins to another character counts as none. None where a piece has a mark or line feed inside."""
    pieces = list(vocabulary)
    if any(map(re.compile(f"[^{MARK}]{MARK}|.\n|\n.", re.DOTALL).search, pieces)):
        return None
    joined: set[str] = set()
    while True:
        but = "".join(map(re.escape, sorted(joined)))
        letter, other = rf"[^\W\d_{but}]", rf"[\W\d_{but}]"
        inside = re.compile(rf"({letter})(?={other})|(?<={other})(?<!{MARK})({letter})")
        found = {a or b for piece in pieces for a, b in inside.findall(piece)}
        if not found:
            return re.compile(rf"{MARK}*{letter}+|{MARK}+(?:(?!{letter})[^{MARK}\n])*|(?:(?!{letter})[^{MARK}\n])+|\n")
        joined |= found


class Merging:
    """Byte-pair merging of units by the scores of pieces."""

    def __init__(self, score: dict[str, float]):
        self.score = score

    def merged(self, unit: str) -> list[str]:
        """Pieces of a unit by byte-pair merging: the best pair of a short list, or a heap of pairs and linked symbols."""
        n = len(unit)
        if n <= CACHED_CHARS:
            return self.merged_short(unit)
        symbols, before, after = list(unit), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := self.score.get(unit[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has grown or gone
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n:
                    pair = symbols[left] + symbols[right]
                    s = self.score.get(pair)
                    if s is not None:
                        heappush(heap, (-s, left, len(pair)))
        return [s for s in symbols if s]

    def merged_short(self, unit: str) -> list[str]:
        parts, score, none = list(unit), self.score.get, float("-inf")
        pairs = [score(unit[i : i + 2], none) for i in range(len(unit) - 1)]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def pieces(self, unit: str, window: int = WINDOW) -> Iterator[str]:
        """Pieces of a unit of any length, a window at a time."""
        at, last, size = 0, None, window
        while at < len(unit):
            part = unit[at : at + size]
            found = self.merged(part)
            if last is not None and self.merged(last + found[0]) != [last, found[0]]:
                raise AssertionError("a window was closed where it can't be")
            keep = len(found)
            if at + len(part) < len(unit):
                room, inside = min(MARGIN, size // 4), 0
                while keep > 1 and inside < room:
                    keep -= 1
                    inside += len(found[keep])
                while keep > 0 and not self.closes(found[keep - 1], unit, at + sum(map(len, found[:keep])), size):
                    keep -= 1
                if keep == 0:
                    size *= 2
                    continue
            yield from found[:keep]
            at, last, size = at + sum(map(len, found[:keep])), found[keep - 1], window

    def closes(self, piece: str, unit: str, at: int, size: int) -> bool:
        """True if the encoding of what follows ``at`` starts with a piece that ``piece`` does not merge with."""
        following = self.merged(unit[at : at + size])[0]
        return self.merged(piece + following) == [piece, following]


class Model(Merging):
    """What encoding and decoding need of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        of = self.library
        spec = dict(f for k, v in fields(of.serialized_model_proto()) if k == 3 for f in fields(v))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if not spec.get(5, 1):
            raise ValueError("models that keep spaces as they are, are not supported")
        plain = [i for i in range(of.get_piece_size()) if not (of.is_control(i) or of.is_unknown(i) or of.is_byte(i))]
        self.ids = {of.id_to_piece(i): i for i in plain}
        super().__init__({p: of.get_score(i) for p, i in self.ids.items()})
        self.byte_ids = [of.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not of.is_byte(self.byte_ids[0]):
            raise ValueError("a model without byte pieces is not supported")
        self.unit = unit_pattern(self.ids)
        self.table: dict[str, tuple[bytes, bytes]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and the source byte of each of its characters, with the end behind the last."""
        parts, sources, at = [], [], 0
        for normal, size, replaced in self.map.replaced(text):
            if replaced:
                sources.append(np.full(len(normal), at))
                at += size
            else:
                ends = np.cumsum(widths(normal), dtype="int64") + at
                sources.append(np.concatenate([[at], ends[:-1]]))
                at = int(ends[-1])
            parts.append(normal)
        normal = "".join(parts)
        source = np.concatenate([*sources, [at]])
        if self.squeeze:
            letters = np.frombuffer(normal.encode("utf-32-le"), dtype="<u4") != 0x20
            kept = letters | np.concatenate([[False], letters[:-1]])  # a space counts behind a character that is none
            normal, source = "".join(compress(normal, kept)), source[np.append(kept, True)]
        if not normal:
            return "", source[-1:]
        if self.prefix:
            normal, source = " " + normal, np.concatenate([source[:1], source])
        normal = normal.replace(" ", MARK)
        length = len(normal.rstrip(MARK)) if self.squeeze else len(normal)
        return normal[:length], source[: length + 1]

    def encoded(self, unit: str) -> tuple[bytes, bytes]:
        """Ids and characters of a unit's pieces, as 32-bit integers."""
        hit = self.table.get(unit)
        if hit is None:
            ids, chars = [], []
            for piece in self.merged(unit) if len(unit) <= WINDOW else self.pieces(unit):
                number = self.ids.get(piece)
                if number is not None:
                    ids.append(number)
                    chars.append(len(piece))
                else:  # one character, as its bytes
                    ids += [self.byte_ids[b] for b in piece.encode()]
                    chars += [0] * (len(piece.encode()) - 1) + [1]
            hit = (array("i", ids).tobytes(), array("i", chars).tobytes())
            if len(unit) <= CACHED_CHARS:
                if len(self.table) >= CACHE_UNITS:
                    self.table.clear()
                self.table[unit] = hit
        return hit

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text's pieces, and where each starts and ends in its UTF-8 bytes."""
        normal, source = self.normalise(text or "")
        units = self.unit.findall(normal) if self.unit else [normal] if normal else []
        found = list(map(self.encoded, units))
        ids = np.frombuffer(b"".join([a for a, _ in found]), dtype="int32")
        ends = np.cumsum(np.frombuffer(b"".join([b for _, b in found]), dtype="int32"), dtype="int64")
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return ids, source[starts].astype("int32"), source[ends].astype("int32")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


def model(path: str) -> Model:
    """The worker's model."""
    return held("pieces", path, lambda: Model(path))


def encode(docs: DataFrame, model_path: str, *, text: str = "text") -> DataFrame:
    """(row, ids, starts, ends, decoded): ``row`` a struct of all columns but the text, the ids of its pieces, the byte spans of
    these in the text, and the text that the ids decode to."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), text_of(text).alias("text"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("ids array<int>, starts array<int>, ends array<int>, decoded string")])

    def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        offsets = np.cumsum([0, *map(len, values)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model(model_path)
        for part in slices(batches, "text"):
            ids, starts, ends = zip(*[of.encode(t) for t in part.column("text").to_pylist()], strict=True)
            decoded = pa.array([of.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), lists(ids, pa.int32()), lists(starts, pa.int32()), lists(ends, pa.int32()), decoded], ["row", "ids", "starts", "ends", "decoded"])

    return rows.mapInArrow(work, schema)
