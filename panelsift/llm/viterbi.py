"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice of pieces is walked left to right. An edge is allowed if its piece stays
apart from the piece that ends where it starts; under this rule one path survives at
each position. Only a window of the longest piece's length is kept: edges that could
still reach further start inside it. Whenever the backpointer paths of all positions in
the window meet in one boundary, the ids before it are final and are given out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelsift.llm import pieces
from panelsift.llm.common import map_texts, texts_of

#: Characters fed at a time; a whole text is never one lattice.
BLOCK = 1 << 14
MAX_WORDS = 300_000
#: Remembered neighbour tests of a process.
MAX_PAIRS = 250_000
#: Longer words are not remembered.
WORD_CHARS = 48


class StreamingViterbi:
    """Lattice of one unbroken string; ``feed`` it piecemeal, then ``finish``."""

    def __init__(self, model: pieces.PieceModel):
        self.model = model
        self.position = 0
        self.done = 0  # ids up to this boundary have been given out
        self.live: list[tuple[int, int]] = [(0, 0)]  # trie node, where its edge started
        # per position in the window: start of the last piece, the piece
        self.back: dict[int, tuple[int, int]] = {0: (0, pieces.START)}
        self.characters: dict[int, str] = {}
        self.window = 2 * model.longest

    def feed(self, text: str) -> list[int]:
        """Extend the lattice; ids that have become final."""
        model, back, live, here = self.model, self.back, self.live, self.position
        kids, ends, apart = model.kids, model.ends, model.apart
        root, out = kids[0], []
        for c in text:
            reached = []
            if c in root:
                best = None
                for node, start in live:
                    nxt = kids[node].get(c)
                    if nxt is not None:
                        reached.append((nxt, start))
                        if best is None:
                            piece = ends.get(nxt)
                            if piece is not None and apart(back[start][1], piece):
                                best = start, piece
            else:
                best = here, pieces.UNKNOWN
                self.characters[here + 1] = c
            here += 1
            back[here] = best
            reached.append((0, here))
            live = reached
            if len(back) > self.window:
                self.position, self.live = here, live
                out += self._commit()
        self.position, self.live = here, live
        return out

    def _commit(self) -> list[int]:
        """Follow all survivors back until they agree on a boundary."""
        heads = {start for _, start in self.live}
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(self.back[last][0])
        return self._give(heads.pop())

    def _give(self, upto: int) -> list[int]:
        parts: list[list[int]] = []
        at = upto
        while at > self.done:
            start, piece = self.back[at]
            if piece == pieces.UNKNOWN:
                parts.append([self.model.byte_id[b] for b in self.characters.pop(at).encode()])
            else:
                parts.append([piece])
            at = start
        for old in [p for p in self.back if p < upto]:
            del self.back[old]
        self.done = max(self.done, upto)
        return [i for part in reversed(parts) for i in part]

    def finish(self) -> list[int]:
        return self._give(self.position)


def lead(model: pieces.PieceModel, run: int, ids: list[int]) -> list[int]:
    """Ids of a word behind a run of blanks: those before its own join a first piece that is a bare blank."""
    if run <= 1:
        return ids
    bare = ids[0] == model.id.get(pieces.BLANK)
    return [*model.blanks(run - (not bare)), *ids[bare:]]


class LongWord:
    """A word too long to remember, fed to one lattice block by block."""

    def __init__(self, model: pieces.PieceModel, item: str):
        word = item.lstrip(" ")
        self.model = model
        self.blanks = len(item) - len(word)
        self.lattice = StreamingViterbi(model)
        self.ids = self.feed(pieces.BLANK + word)

    def _lead(self, ids: list[int]) -> list[int]:
        if not ids:
            return ids
        run, self.blanks = self.blanks, 1
        return lead(self.model, run, ids)

    def feed(self, text: str) -> list[int]:
        return self._lead(self.lattice.feed(text))

    def finish(self) -> list[int]:
        return self._lead(self.lattice.finish())


class Walker:
    """Lattice of a word that fits the window, by the trie's suffix links.

    At each character the node of the longest piece prefix that ends there is kept; the
    pieces that end there hang on it and on its suffixes. The longest one that stays apart
    from the piece before it survives. Its tables are as large as the vocabulary.
    """

    def __init__(self, model: pieces.PieceModel):
        self.model = model
        ends, root = model.ends, model.kids[0]
        # a character without a piece breaks the lattice
        self.kids = kids = [k if k.keys() <= root.keys() else {c: n for c, n in k.items() if c in root} for k in model.kids]
        self.suffix = suffix = [0] * len(kids)
        #: Pieces that end at a node, longest first: (length, piece); and the shortest of them.
        found: list[tuple[tuple[int, int], ...]] = [()] * len(kids)
        level, depth = [(node, 0) for node in root.values()], 1
        while level:
            below = []
            for node, link in level:
                suffix[node] = link
                found[node] = (((depth, ends[node]),) if node in ends else ()) + found[link]
                for c, kid in kids[node].items():
                    at = link
                    while at and c not in kids[at]:
                        at = suffix[at]
                    below.append((kid, kids[at].get(c, 0)))
            level, depth = below, depth + 1
        self.longer = [x[:-1] for x in found]
        self.shortest = [x[-1] if x else (0, pieces.START) for x in found]
        self.pairs: dict[int, bool] = {}

    def ids(self, word: str) -> list[int]:
        kids, suffix, longer, shortest, pairs = self.kids, self.suffix, self.longer, self.shortest, self.pairs
        if len(pairs) > MAX_PAIRS:
            pairs.clear()
        back = [(0, pieces.START)]  # by position: the last piece and its length
        at = end = 0
        for c in word:
            end += 1
            step = kids[at].get(c)
            while step is None and at:
                at = suffix[at]
                step = kids[at].get(c)
            if step is None:
                back.append((1, pieces.UNKNOWN))
                continue
            at = step
            for best in longer[at]:
                before = back[end - best[0]][1]
                if before < 0:
                    break
                key = before << 32 | best[1]
                apart = pairs.get(key)
                if apart is None:
                    apart = pairs[key] = self.model.apart(before, best[1])
                if apart:
                    break
            else:  # one survives, so it needs no test
                best = shortest[at]
            back.append(best)
        out = []
        while end:
            length, piece = back[end]
            if piece == pieces.UNKNOWN:
                out += [self.model.byte_id[b] for b in reversed(word[end - 1].encode())]
            else:
                out.append(piece)
            end -= length
        out.reverse()
        return out


def packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


#: A word with the blanks before it, or blanks at the end.
ITEM = re.compile(" *[^ ]+| +")


class Encoder:
    """Ids of texts fed in blocks; short words are remembered within bounds."""

    def __init__(self, model: pieces.PieceModel):
        self.model = model
        self.items: dict[str, bytes] = {}
        self.walker = Walker(model)

    def _encode(self, item: str) -> bytes:
        if item[-1] == " ":
            ids = packed(self.model.blanks(len(item)))
        elif len(item) <= WORD_CHARS:
            word = item.lstrip(" ")
            ids = packed(lead(self.model, len(item) - len(word), self.walker.ids(pieces.BLANK + word)))
        else:
            long = LongWord(self.model, item)
            ids = packed(long.ids + long.finish())
        if len(item) <= WORD_CHARS:
            if len(self.items) >= MAX_WORDS:
                self.items.clear()
            self.items[item] = ids
        return ids

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Ids of the joined blocks, 32 bits each, given out as they become final.

        The last item of a block may go on in the next one and is carried over; once it
        fills a block it goes to a lattice that is fed as it comes.
        """
        carry, long, known = " ", None, self.items
        started = False
        for block in blocks:
            if not block:
                continue
            started = True
            items = ITEM.findall(carry + block.replace(pieces.BLANK, " "))
            if long is not None:
                if items[0][0] != " ":
                    yield packed(long.feed(items.pop(0)))
                if items:
                    yield packed(long.finish())
                    long = None
            carry = items.pop() if items else ""
            yield b"".join([known.get(item) or self._encode(item) for item in items])
            if len(carry) > BLOCK and carry[-1] != " ":
                long = LongWord(self.model, carry)
                carry = ""
                yield packed(long.ids)
        if long is not None:
            yield packed(long.finish())
        if started and carry:
            yield known.get(carry) or self._encode(carry)

    def encode(self, text: str) -> np.ndarray:
        blocks = (text[k : k + BLOCK] for k in range(0, len(text), BLOCK))
        return np.frombuffer(b"".join(self.stream(blocks)), "<i4")


class Decoder:
    """Texts of id arrays, by a table of each id's bytes; the same text as ``PieceModel.decode``."""

    def __init__(self, model: pieces.PieceModel):
        self.parts = [
            b"" if i in model.controls else bytes((model.byte_of[i],)) if i in model.byte_of else t.encode()
            for i, t in enumerate(model.text)
        ]

    def decode(self, ids: np.ndarray) -> str:
        parts = self.parts
        text = b"".join([parts[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(pieces.BLANK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def coders_of(path: str) -> tuple[Encoder, Decoder]:
    """One pair per worker process, so that later tasks find its words."""
    model = pieces.load(path)
    return Encoder(model), Decoder(model)


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded, lossless.

    ``decoded`` is the text of the ids; ``lossless`` says that it is the source text,
    which fails only where that holds the blank piece itself (U+2581). Null and empty
    texts have no ids and decode to the empty text. Repeated rows are encoded each; other
    columns, whatever their names, are neither read nor returned.
    """

    def make():
        encoder, decoder = coders_of(model_path)

        def work(batch: pa.RecordBatch):
            texts = texts_of(batch, text)
            all_ids = [encoder.encode(t) for t in texts]
            decoded = [decoder.decode(ids) for ids in all_ids]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in all_ids])])
            flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array([len(x) for x in all_ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in all_ids], pa.int64()),
                    pa.array(decoded, pa.string()),
                    pa.array([a == b for a, b in zip(decoded, texts)], pa.bool_()),
                ],
                [key, "ids", "n_ids", "ids_crc32", "decoded", "lossless"],
            )

        return work

    kind = dict(docs.dtypes)[key]
    return map_texts(
        docs.select(key, text),
        make,
        f"`{key}` {kind}, ids array<int>, n_ids bigint, ids_crc32 bigint, decoded string, lossless boolean",
    )
