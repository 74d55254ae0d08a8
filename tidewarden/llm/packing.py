"""Packing token sequences by minimum bin slack.

Each document becomes its token ids and one end id. Whole windows are cut from
it first; the pieces left over (shorter than a window) are pooled within the
task. For each window the longest pooled piece is fixed, and a bitset
subset-sum dynamic program over the other lengths finds the multiset that comes
closest to the capacity; walking the stored bitsets back gives its counts. Slack
that no multiset closes is closed by cutting one piece. What remains of a task
after its last full window is cut into sequences whose lengths are powers of
two, so no sequence needs padding.

Nothing is shuffled: tasks stream over their rows, holding one pool of
`pool_docs` pieces. Sequence ids carry the task's number in their high bits, so
they are unique; a retried task repeats them for the same rows.

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed as often as they occur; an empty table gives no row;
columns other than the two named are ignored.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewarden.llm.common import sliced

Piece = tuple[object, int, int, bytes, int]  # document, start, length, its ids, the document's tokens


#: ASCII white space and printable ASCII but for the apostrophe; and Latin-1 letters in UTF-8.
ASCII = bytes([*range(9, 14), *(c for c in range(32, 127) if c != 39)])
LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
#: In lower-cased texts of these alone: a run of letters, a digit, or a run of other characters is one piece.
PIECE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class Cache(dict):
    """Key -> value, made when it is missing; forgets everything when it has grown to `most`."""

    def __init__(self, make: Callable[[bytes], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: bytes) -> bytes:
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class WordIds:
    """The ids of a text, as little-endian unsigned 32 bit bytes.

    The tokenizer drops white space and never joins across it, so ids of a text
    are those of its words in turn, and words are kept once met. A text of ASCII
    and Latin-1 letters falls into pieces by a plain rule, and pieces go to the
    tokenizer's model at once; words of other texts go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.pieces = Cache(self.word, most // 4), Cache(self.piece, most)

    def piece(self, piece: bytes) -> bytes:
        text = piece.decode("ascii") if piece.isascii() else "".join(map(BYTE_LETTERS.__getitem__, piece))
        return _little([t.id for t in self.model.tokenize(text)])

    def word(self, word: bytes) -> bytes:
        return _little(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def __call__(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if LATIN.fullmatch(raw.translate(None, ASCII)) and b"<|" not in raw:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(raw.decode().lower().encode())))
        return b"".join(map(self.words.__getitem__, raw.split()))


def _byte_letters() -> list[str]:
    """The letter by which byte-level models write each byte: itself if it shows, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def best_fill(lengths: dict[int, int], room: int) -> dict[int, int]:
    """length -> how many of it: the multiset with the largest sum of at most room.

    Bit s of `reach` says that some multiset of the items seen so far sums to s.
    Ties are settled by the order of the items: longer ones are tried first.
    """
    mask, reach, seen = (1 << (room + 1)) - 1, 1, []
    full = 1 << room
    for length in sorted((x for x in lengths if x <= room), reverse=True):
        for _ in range(min(lengths[length], room // length)):
            more = reach | (reach << length) & mask
            if more == reach:
                break
            seen.append((length, reach))
            reach = more
        if reach & full:
            break
    left, used = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(seen):
        if not before >> left & 1:
            used[length] += 1
            left -= length
    return dict(used)


class Packer:
    """Turns documents into rows (document, start, length, ids, document's tokens, sequence, offset)."""

    def __init__(self, capacity: int, first: int, pool_docs: int):
        self.capacity, self.next, self.pool_docs = capacity, first, pool_docs
        self.pool: dict[int, list[Piece]] = defaultdict(list)
        self.pooled = self.tokens = 0

    def close(self, pieces: list[Piece]) -> Iterator[tuple]:
        at = 0
        for doc, start, length, ids, total in pieces:
            yield doc, start, length, ids, total, self.next, at
            at += length
        self.next += 1

    def put(self, piece: Piece) -> None:
        self.pool[piece[2]].append(piece)
        self.pooled += 1
        self.tokens += piece[2]

    def take(self, length: int) -> Piece:
        items = self.pool[length]
        piece = items.pop()
        if not items:
            del self.pool[length]
        self.pooled -= 1
        self.tokens -= length
        return piece

    def add(self, doc: object, ids: bytes) -> Iterator[tuple]:
        total, whole = len(ids) // 4, len(ids) // 4 // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield from self.close([(doc, start, self.capacity, ids[4 * start : 4 * (start + self.capacity)], total)])
        if total > whole:
            self.put((doc, whole, total - whole, ids[4 * whole :], total))
        if self.pooled >= self.pool_docs:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """Full windows, as long as the pool can fill one."""
        while self.tokens >= self.capacity:
            window = [self.take(max(self.pool))]
            room = self.capacity - window[0][2]
            for length, n in best_fill({k: len(v) for k, v in self.pool.items()}, room).items():
                window += [self.take(length) for _ in range(n)]
            room = self.capacity - sum(p[2] for p in window)
            while room:
                above = [k for k in self.pool if k > room]
                doc, start, length, ids, total = self.take(min(above) if above else max(self.pool))
                cut = min(room, length)
                window.append((doc, start, cut, ids[: 4 * cut], total))
                if cut < length:
                    self.put((doc, start + cut, length - cut, ids[4 * cut :], total))
                room -= cut
            yield from self.close(window)

    def end(self) -> Iterator[tuple]:
        yield from self.flush()
        while self.tokens:
            room, window = 1 << self.tokens.bit_length() - 1, []
            while room:
                doc, start, length, ids, total = self.take(max(self.pool))
                cut = min(room, length)
                window.append((doc, start, cut, ids[: 4 * cut], total))
                if cut < length:
                    self.put((doc, start + cut, length - cut, ids[4 * cut :], total))
                room -= cut
            yield from self.close(window)


_words: dict[str, WordIds] = {}


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, pool_docs: int = 4096) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _words:
            _words[tokenizer] = WordIds(tokenizer)
        words, id_type = _words[tokenizer], None
        packer, rows, held = Packer(capacity, TaskContext.get().partitionId() << 40, pool_docs), [], 0

        def out() -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in sliced(batches, text_col, 4 << 20):
            id_type = batch.column(id_col).type
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                for row in packer.add(doc, words(text) + end):
                    rows.append(row)
                    held += len(row[3])
                if held > 4 << 20:
                    yield out()
                    rows, held = [], 0
        rows += packer.end()
        if rows:
            yield out()

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
