"""Token counts by a compiled finite-state transducer.

A state holds what the next character needs: for each live suffix of the text read so
far its trie node, the last piece before it, and how many tokens fewer or more than now
lie before it. A transition carries the change in the number of tokens. States and
transitions are compiled when first met and shared by all words of a task.

A blank after a character leads back to one state, so a chunk of text maps states as
follows: constant behind its first such blank, and before it only the few characters of
its head depend on the state that enters. Such chunk maps compose associatively, and a
text's count is the last of a parallel prefix scan over its chunks.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from panelsift.llm import pieces
from panelsift.llm.common import map_texts, texts_of
from panelsift.llm.viterbi import StreamingViterbi

CHUNK = 1 << 16
#: Compiled states and transitions per task; beyond them compilation starts anew, also
#: in the middle of a word.
MAX_STATES = 150_000
MAX_ARCS = 600_000
#: Words remembered per task and their bytes, and the longest that is remembered.
MAX_WORDS = 400_000
MAX_WORD_BYTES = 96 << 20
LONGEST_WORD = 64
WORD_ENTRY = 130


class Transducer:
    def __init__(self, model: pieces.PieceModel):
        self.model = model
        self.words: dict[str, int] = {}
        self.held = 0
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.compiled = 0
        self.start = self._state(((0, pieces.START, 0),))

    def _state(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
        return n

    def compile(self, at: int, c: str) -> tuple[int, int]:
        """Transition from a state on a character: next state and change in tokens."""
        model, live, found = self.model, [], None
        kids, ends = model.kids, model.ends
        if c not in kids[0]:
            last, change = pieces.UNKNOWN, len(c.encode())
        else:
            for node, before, fewer in self.states[at]:
                nxt = kids[node].get(c)
                if nxt is None:
                    continue
                live.append((nxt, before, fewer))
                if found is None:
                    piece = ends.get(nxt)
                    if piece is not None and model.apart(before, piece):
                        found = piece, fewer + 1
            last, change = found  # every prefix has exactly one last piece
        after = tuple((n, b, f - change) for n, b, f in live) + ((0, last, 0),)
        arc = self.arcs[at][c] = (self._state(after), change)
        self.compiled += 1
        return arc

    def run(self, at: int, text: str) -> tuple[int, int]:
        """State after a text without boundaries, and the tokens it adds."""
        arcs, total = self.arcs, 0
        for c in text:
            arc = arcs[at].get(c)
            if arc is None:
                if len(self.states) > MAX_STATES or self.compiled > MAX_ARCS:
                    state = self.states[at]
                    self._reset()
                    at, arcs = self._state(state), self.arcs
                arc = self.compile(at, c)
            at = arc[0]
            total += arc[1]
        return at, total

    def word(self, word: str, blanks: int = 1) -> int:
        """Tokens of ``blanks`` blanks followed by a word; of blanks alone if it is empty."""
        if not word:
            return len(self.model.blanks(blanks)) if blanks else 0
        n = self.words.get(word)
        if n is None:
            n = self.run(self.start, pieces.BLANK + word)[1]
            if len(word) <= LONGEST_WORD:
                if len(self.words) > MAX_WORDS or self.held > MAX_WORD_BYTES:
                    self.words.clear()
                    self.held = 0
                self.words[word] = n
                self.held += sys.getsizeof(word) + WORD_ENTRY
        if blanks == 1:
            return n
        if self._bare(word):
            return n - 1 + len(self.model.blanks(blanks))
        return n + len(self.model.blanks(blanks - 1))

    def _bare(self, word: str) -> bool:
        """Whether the blank before a word stays a piece of its own."""
        if len(word) <= LONGEST_WORD:
            return self.model.merge(pieces.BLANK + word)[0] == pieces.BLANK
        # of a long word the whole text decides, read until the first piece is settled
        lattice = StreamingViterbi(self.model)
        word = pieces.BLANK + word
        for i in range(0, len(word), LONGEST_WORD):
            ids = lattice.feed(word[i : i + LONGEST_WORD])
            if ids:
                break
        else:
            ids = lattice.finish()
        return ids[0] == self.model.id.get(pieces.BLANK)


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the reading so far.

    ``head``: characters before the first boundary, None if there is no boundary; they
    finish the word that enters. ``count``: tokens of whole words behind it. ``tail``:
    parts of the unfinished last word with the blanks before it.
    """

    head: tuple[str, ...] | None
    count: int
    tail: tuple[str, ...]

    def then(self, other: ChunkMap, close) -> ChunkMap:
        if other.head is None:
            return ChunkMap(self.head, self.count, self.tail + other.tail)
        if self.head is None:
            return ChunkMap(self.tail + other.head, other.count, other.tail)
        count = self.count + close(self.tail + other.head) + other.count
        return ChunkMap(self.head, count, other.tail)


def chunk_map(text: str, previous: str, machine: Transducer) -> ChunkMap:
    """Map of a chunk; ``previous`` is the character before it ('' at the start)."""
    parts = text.split(" ")
    if previous not in ("", " ") and text[0] == " ":
        head: tuple[str, ...] | None = ()
        parts = parts[1:]
    else:
        first = 0  # the first boundary is the first blank behind another character
        if previous in ("", " "):
            while first < len(parts) and not parts[first]:
                first += 1
        if first + 1 >= len(parts):
            return ChunkMap(None, 0, (text,))
        head = (" " * first + parts[first],)
        parts = parts[first + 1 :]
    count, blanks = 0, 1
    for part in parts[:-1]:
        if part:
            count += machine.word(part, blanks)
            blanks = 1
        else:
            blanks += 1
    return ChunkMap(head, count, (" " * blanks + parts[-1],))


def prefix_scan(maps: list[ChunkMap], close) -> list[ChunkMap]:
    """Inclusive scan in log-many rounds of independent compositions."""
    step = 1
    while step < len(maps):
        maps = [
            maps[i] if i < step else maps[i - step].then(maps[i], close) for i in range(len(maps))
        ]
        step *= 2
    return maps


def count_tokens(text: str, machine: Transducer, chunk: int = CHUNK) -> int:
    """Tokens of a whole text; an empty text has none."""
    if not text:
        return 0
    text = " " + text.replace(pieces.BLANK, " ")  # both are the model's blank

    def close(parts: tuple[str, ...]) -> int:
        whole = "".join(parts)
        word = whole.lstrip(" ")
        return machine.word(word, len(whole) - len(word))

    maps = [
        chunk_map(text[i : i + chunk], text[i - 1] if i else "", machine)
        for i in range(0, len(text), chunk)
    ]
    last = prefix_scan(maps, close)[-1]
    return (close(last.head) if last.head is not None else 0) + last.count + close(last.tail)


@lru_cache(maxsize=2)
def transducer_of(path: str) -> Transducer:
    """One transducer per worker process, so that later tasks find its states."""
    return Transducer(pieces.load(path))


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: key, n_bytes, n_tokens and over_limit.

    Null and empty texts have 0 tokens; repeated rows are counted each; other columns,
    whatever their names, are neither read nor returned.
    """

    def make():
        machine = transducer_of(model_path)

        def work(batch: pa.RecordBatch):
            texts = texts_of(batch, text)
            counts = [count_tokens(t, machine) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

        return work

    kind = dict(docs.dtypes)[key]
    return map_texts(
        docs.select(key, text), make, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
