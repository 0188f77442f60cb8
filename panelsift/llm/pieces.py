"""Byte-pair piece models (SentencePiece .model files) as automata.

A segmentation is the model's own exactly if each piece merges to itself and each two
neighbours stay apart when merged alone. So the last piece of every prefix is unique,
and a prefix's segmentation extends that of a shorter prefix; both the transducer that
counts and the Viterbi that encodes rest on this. Pieces never hold a blank after
another character, hence a blank after a character is always a boundary.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

BLANK = "▁"
#: Stands for a character that has no piece and is written as its UTF-8 bytes.
UNKNOWN = -1
START = -2
NEVER = float("inf")
Edge = list[tuple[str, float]]


class PieceModel:
    """Vocabulary, trie and neighbour test of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = (
            train.model_type == model.trainer_spec.BPE
            and train.byte_fallback
            and norm.name == "identity"
            and norm.add_dummy_prefix
            and not norm.remove_extra_whitespaces
            and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
            and not any(BLANK in p.piece.lstrip(BLANK) for p in model.pieces if p.type == kinds.NORMAL)
        )
        if not plain:
            raise ValueError(f"{path}: not a BPE model with byte fallback and identity rules")
        self.text = [p.piece for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.controls = {i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.longest = max(map(len, self.id))
        # trie: per node the next node by character, and the piece that ends at a node
        self.kids: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        for piece, i in self.id.items():
            at = 0
            for c in piece:
                nxt = self.kids[at].get(c)
                if nxt is None:
                    nxt = self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                at = nxt
            if self.merge(piece) == [piece]:
                self.ends[at] = i
        self.tails: dict[int, Edge | None] = {}
        self.heads: dict[int, Edge | None] = {}
        self.blanks = lru_cache(maxsize=4096)(self._blanks)

    def merge(self, text: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """Pieces of a string by the merge rule itself: best score first, then leftmost.

        ``steps`` gets each merge's score and the first and last part behind it.
        """
        parts: list[str] = list(text)
        last = len(parts) - 1
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            whole = parts[i] + parts[j]
            score = self.score.get(whole)
            if score is not None:
                heapq.heappush(queue, (-score, i, j, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            cost, i, j, whole = heapq.heappop(queue)
            if not parts[i] or not parts[j] or parts[i] + parts[j] != whole or after[i] != j:
                continue
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            else:
                last = i
            if before[i] >= 0:
                offer(before[i], i)
            if steps is not None:
                steps.append((-cost, parts[0], parts[last]))
        return [p for p in parts if p]

    def _edge(self, piece: int, last: bool) -> Edge | None:
        """First or last part of a piece while it is merged, each with the score below which it stays.

        None for a piece that does not merge to itself.
        """
        text, steps, edge = self.text[piece], [], []
        if self.merge(text, steps) != [text]:
            return None
        part, low = text[-1 if last else 0], NEVER
        for score, *ends in steps:
            low = min(low, score)
            if ends[last] != part:
                edge.append((part, low))
                part, low = ends[last], NEVER
        return [*edge, (part, -NEVER)]

    def apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay two when merged alone.

        Up to a merge over the place where they meet, each is merged as if alone. So only the
        parts beside that place are followed: such a merge comes if it is due before either changes.
        """
        if left < 0:
            return True
        a = self.tails.get(left) or self.tails.setdefault(left, self._edge(left, True))
        b = self.heads.get(right) or self.heads.setdefault(right, self._edge(right, False))
        if a is None or b is None:
            x, y = self.text[left], self.text[right]
            return self.merge(x + y) == [x, y]
        score, i, j = self.score.get, 0, 0
        while True:
            (x, leave_x), (y, leave_y) = a[i], b[j]
            over = score(x + y)
            if over is not None and over > leave_x and over >= leave_y:  # of equals the leftmost is first
                return False
            if leave_x >= leave_y:
                if leave_x == -NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _blanks(self, n: int) -> tuple[int, ...]:
        """Pieces of a run of blanks alone."""
        return tuple(self.id[p] for p in self.merge(BLANK * n))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, byte pieces as UTF-8 (U+FFFD where invalid), the added blank gone."""
        out: list[bytes] = []
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                out.append(bytes((byte,)))
            elif i not in self.controls:
                out.append(self.text[i].encode())
        text = b"".join(out).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    """One model per worker process."""
    return PieceModel(path)
