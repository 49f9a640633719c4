"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

A segmentation is a path through the pieces that occur in a text. A chunk boundary cuts the text anywhere; its *states*
are the pieces that reach over it or end at it. What a chunk does is a matrix: for each state at its start and each at
its end, the weight of the best path between them. Matrices are multiplied in the max-plus semiring, which is
associative, so chunks can be combined in any grouping. From the states of the best path each chunk then finds its own
pieces, independently of the others.

Two kinds of models are handled:

* unigram: a step weighs its piece's score, and the best path is the one the model defines;
* BPE: a step weighs 0 where the two adjacent pieces, encoded together, stay these two pieces, and minus infinity
  otherwise. A sequence of pieces is the model's own segmentation if and only if that holds for each adjacent pair (no
  merge crosses a boundary that it did not cross for the pair alone), so exactly one path has a finite weight.

Where no piece of the vocabulary holds a space mark after another character, as in the common vocabularies, every path
goes through the places before space marks. There both sides are independent: a chunk's matrix is the product of the
part before its first such place, a number, and the part after its last. The number's part is a sequence of units of
space and word, whose pieces are remembered.

The scan over a document's matrices has two levels: `FAN` neighbours are multiplied in a task each, the products decide
the states between such stretches, and each stretch then decides those within it, again in a task each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship, table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Documents of more characters are cut into chunks of so many, which any executor may take.
CHUNK_CHARS = 16_384
#: Matrices that are multiplied, and whose states are chosen, in one task.
FAN = 256
#: Units whose pieces a worker remembers, and the longest of them.
REMEMBERED, LONGEST_UNIT = 200_000, 64
#: Units that are merged in one go, and characters of texts whose units are.
UNITS_AT_ONCE, CHARS_AT_ONCE = 4_096, 250_000
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Tokens that are handed on at once.
TOKENS_AT_ONCE = 100_000
DIGEST = 2_147_483_647
#: Values of a digest that are summed in one go, and their places.
DIGESTED_AT_ONCE = 500_000
PLACES = np.arange(1, DIGESTED_AT_ONCE + 1, dtype=np.int64)
NEVER = float("-inf")

#: (start, end) of a piece in the text; the state before all text is (-1, 0).
State = tuple[int, int]
START: State = (-1, 0)


@dataclass
class Vocabulary:
    """Pieces with scores. `byte_ids`: places of <0x00> to <0xFF>, for characters that no piece covers, or empty."""

    pieces: list[str]
    scores: list[float]
    kind: str  # "bpe" or "unigram"
    unknown: int = 0
    byte_ids: list[int] = field(default_factory=list)
    special: frozenset[int] = frozenset()

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special}
        self.score = {p: self.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.cuts = not any(p[i] == MARK != p[i - 1] for p in self.ids for i in range(1, len(p)))
        self.penalty = min([self.scores[i] for i in self.ids.values()], default=0.0) - 10.0
        #: Ids of units: those of late, and those before them.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bare: dict[int, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 65_536 else "<u4")
        self.plain = [p.replace(MARK, " ").encode() if i not in self.special else b"" for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            self.plain[i] = bytes([b])
        if self.kind == "bpe":
            self._tabulate()

    def _tabulate(self) -> None:
        """Pairs of symbols that a merge joins, as sorted codes, with the rank of each by score and the symbol it makes.

        Symbols are the pieces, by their ids, and the characters of pieces that are none themselves.
        """
        symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        rank = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.n_symbols = len(self.pieces) + len(symbols) + 1
        made = [(symbols[p[:i]] * self.n_symbols + symbols[p[i:]], rank[self.score[p]], n) for p, n in self.ids.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        codes, ranks, makes = zip(*sorted(made) or [(-1, 0, 0)], strict=True)
        self.pair_codes, self.pair_ranks, self.pair_makes = np.array(codes, np.int64), np.array(ranks, np.int32), np.array(makes, np.int32)
        self.characters = np.full(0x110000, -2, np.int32)  # by code point
        for c, i in symbols.items():
            if len(c) == 1:
                self.characters[ord(c)] = i
        self.ascii = np.array([self.to_ids(chr(c))[0] for c in range(128)], np.int32)  # of those that no piece covers

    # Encoding of short stretches, by the definition of each kind.

    def merge(self, text: str) -> list[str]:
        """BPE by definition: join the adjacent pair whose piece has the best score, the leftmost of equals, and again."""
        parts, score = list(text), self.score.get
        joint = [score(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while joint and (best := max(joint)) > NEVER:
            k = joint.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joint[k]
            if k < len(joint):
                joint[k] = score(parts[k] + parts[k + 1], NEVER)
            if k:
                joint[k - 1] = score(parts[k - 1] + parts[k], NEVER)
        return parts

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs of symbols in the table, or -1. Symbols below 0 are none."""
        code = a.astype(np.int64) * self.n_symbols + b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where((self.pair_codes[at] == code) & (a >= 0) & (b >= 0), at, -1).astype(np.int32)

    def merged(self, units: list[str]) -> list[bytes]:
        """Ids of many short units at once: in each round every unit joins its best pair, as `merge` does for one.

        Symbols keep their places and know their neighbours, so a round does no more for a unit than find its best pair,
        join it and look up the two pairs that the joint symbol is part of.
        """
        out: list[bytes] = [b""] * len(units)
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        for low in range(0, len(order), UNITS_AT_ONCE):
            rows = order[low : low + UNITS_AT_ONCE]
            part = [units[i] for i in rows]
            n, width = len(part), max(2, len(part[-1]))
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            found = self.characters[points]
            # A line for each place, and one of none that is next to the first and the last. Characters of no piece are
            # known by their code points, below -1.
            s = np.full((n, width + 1), -1, np.int32)
            s[np.arange(width + 1) < np.array([len(u) for u in part])[:, None]] = np.where(found == -2, -2 - points.astype(np.int32), found)
            s = np.ascontiguousarray(s.T)
            at = self._pairs(s[:-1], s[1:])
            # Of a unit's pairs the one with the least key is joined: the best score, and of equals the leftmost.
            bits = width.bit_length()
            kind = np.int32 if len(self.pair_ranks) << bits < 1 << 31 else np.int64
            never, ranks = np.iinfo(kind).max, self.pair_ranks.astype(kind) << bits
            key = np.full((width + 1, n), never, kind)
            key[:-1] = np.where(at >= 0, ranks[at] | np.arange(width, dtype=kind)[:, None], never)
            makes = np.concatenate([self.pair_makes[at], np.zeros((1, n), np.int32)])
            cells = np.arange((width + 1) * n).reshape(width + 1, n)
            right, left = np.roll(cells, -1, axis=0), np.roll(cells, 1, axis=0)
            right[-1] = left[-1] = cells[-1]
            keys = key[:-1]
            s, key, makes, right, left = (x.reshape(-1) for x in (s, key, makes, right, left))
            while len(each := np.flatnonzero((best := keys.min(axis=0)) < never)):
                i = (best[each] & ((1 << bits) - 1)).astype(np.intp) * n + each
                j, before = right[i], left[i]
                after = right[j]
                s[i], s[j], key[j] = makes[i], -1, never
                right[i], left[after] = after, i
                first, second = np.concatenate([before, i]), np.concatenate([i, after])
                at = self._pairs(s[first], s[second])
                key[first] = np.where(at >= 0, ranks[at] | (first // n).astype(kind), never)
                makes[first] = self.pair_makes[at]
            ended = np.ascontiguousarray(s[:-n].reshape(width, n).T)
            bare = (ended < -1) & (ended > -2 - len(self.ascii))
            ended[bare] = self.ascii[-2 - ended[bare]]
            filled = ended != -1
            plain = ((ended < len(self.pieces)) & (ended >= -1)).all(axis=1)
            data, ends = ended[filled].astype(self.dtype).tobytes(), (np.cumsum(filled.sum(axis=1)) * self.dtype.itemsize).tolist()
            for i, begin, end in zip(rows, [0, *ends], ends, strict=False):
                out[i] = data[begin:end]
            for r in np.flatnonzero(~plain).tolist():
                out[rows[r]] = b"".join([self.symbol(x) for x in ended[r][filled[r]].tolist()])
        return out

    def symbol(self, x: int) -> bytes:
        """Ids of what is left of a unit after all merges: a piece, or a character that is none."""
        if 0 <= x < len(self.pieces):
            return np.array([x], self.dtype).tobytes()
        if (found := self.bare.get(x)) is None:
            c = chr(-2 - x) if x < 0 else next(c for c in {c for p in self.ids for c in p} if self.characters[ord(c)] == x)
            found = self.bare[x] = np.array(self.to_ids(c), self.dtype).tobytes()
        return found

    def prepare(self, lists: list[list[str]]) -> None:
        """Remember the ids of all short units in these lists. Units that were not met again since half of the room was
        filled go first."""
        if self.kind != "bpe":
            return
        units = {u for u in set().union(*lists) if len(u) <= LONGEST_UNIT}
        missing = units.difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED // 2:
            self.known, self.older, missing = {}, self.known, units
        new = []
        for u in missing:
            if (ids := self.older.get(u)) is None:
                new.append(u)
            else:
                self.known[u] = ids
        self.known.update(zip(new, self.merged(new), strict=True))

    def joined(self, units: list[str]) -> bytes:
        """Ids of units in a row."""
        try:
            return b"".join(map(self.known.__getitem__, units))
        except KeyError:  # long ones, and those that weren't prepared
            return b"".join(map(self.unit, units))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of normalised texts, some CHARS_AT_ONCE characters at a time."""
        if not self.cuts:
            yield from map(self.encode, texts)
            return
        low = 0
        while low < len(texts):
            high, held = low, 0
            while high < len(texts) and held < CHARS_AT_ONCE:
                held += len(texts[high])
                high += 1
            lists = [UNIT.findall(t) for t in texts[low:high]]
            self.prepare(lists)
            for units in lists:
                yield self.joined(units)
            low = high

    def fit(self, a: str, b: str) -> bool:
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def at(self, text: str, s: int) -> Iterator[int]:
        """Ends of the pieces that start at s; a character without a piece is one by itself."""
        yield s + 1
        for e in range(s + 2, min(len(text), s + self.longest) + 1):
            if text[s:e] in self.ids:
                yield e

    def weight(self, text: str, state: State, step: State) -> float:
        piece = text[step[0] : step[1]]
        if self.kind == "unigram":
            i = self.ids.get(piece)
            return self.penalty if i is None else self.scores[i]
        return 0.0 if state[0] < 0 or self.fit(text[state[0] : state[1]], piece) else NEVER

    def to_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def unit(self, text: str) -> bytes:
        """Ids of a unit of space marks and a word, remembered if it is short."""
        found = self.known.get(text)
        if found is None:
            found = np.array(self._path(text), self.dtype).tobytes()
            if len(text) <= LONGEST_UNIT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = found
        return found

    def _path(self, text: str) -> list[int]:
        if self.kind == "bpe" and len(text) <= LONGEST_UNIT:
            return [i for p in self.merge(text) for i in self.to_ids(p)]
        return [i for s, e in best_path(self, text) for i in self.to_ids(text[s:e])]

    def encode(self, text: str) -> bytes:
        """Ids of a whole normalised text."""
        if not text:
            return b""
        if not self.cuts:
            return np.array([i for s, e in best_path(self, text) for i in self.to_ids(text[s:e])], self.dtype).tobytes()
        return self.joined(UNIT.findall(text))

    def decode(self, ids: bytes) -> str:
        """The normalised text with spaces for marks."""
        return b"".join(map(self.plain.__getitem__, np.frombuffer(ids, self.dtype).tolist())).decode("utf-8", "replace")


def normalised(text: str) -> str:
    """One mark before the text and marks for spaces; an empty text stays empty. Nothing else is changed."""
    return MARK + text.replace(" ", MARK) if text else ""


def restored(text: str) -> str:
    return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL) -> Vocabulary:
    from pathlib import Path

    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(Path(path).read_bytes())
    norm, trained = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only models that leave the text as it is, but for a first space mark, are handled")
    kind = {trained.UNIGRAM: "unigram", trained.BPE: "bpe"}[trained.model_type]
    usual = {model.SentencePiece.NORMAL, model.SentencePiece.USER_DEFINED}
    byte_ids = [i for i, p in enumerate(model.pieces) if p.type == model.SentencePiece.BYTE]
    special = frozenset(i for i, p in enumerate(model.pieces) if p.type not in usual)
    return Vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], kind, max(0, trained.unk_id), byte_ids, special)


# The max-plus algebra.

Matrix = dict[State, dict[State, float]]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product: the best weight over every state in between. States that lead nowhere drop out."""
    out: Matrix = {}
    for s, row in a.items():
        best: dict[State, float] = {}
        for m, x in row.items():
            for e, y in b.get(m, {}).items():
                if x + y > best.get(e, NEVER):
                    best[e] = x + y
        if best:
            out[s] = best
    return out


def pack(m: Matrix) -> bytes:
    rows = [(*s, *e, w) for s, row in m.items() for e, w in row.items()]
    return np.array(rows, np.float64).tobytes()


def unpack(data: bytes) -> Matrix:
    m: Matrix = {}
    for s0, s1, e0, e1, w in np.frombuffer(data, np.float64).reshape(-1, 5).tolist():
        m.setdefault((int(s0), int(s1)), {})[int(e0), int(e1)] = w
    return m


def states_at(v: Vocabulary, text: str, at: int) -> list[State]:
    """Pieces that start before `at` and end at or after it."""
    if at == 0:
        return [START]
    return [(s, e) for s in range(max(0, at - v.longest), at) for e in v.at(text, s) if e >= at]


def transfer(v: Vocabulary, text: str, entries: list[State], at: int) -> Matrix:
    """Best weights from each entry to each state at `at`, in one pass over the text for all entries.

    A state carries a weight for each entry: a vector, or for BPE, whose weights are 0 and minus infinity, the bits of a
    number. Once paths from several entries meet in a state they go on as one.
    """
    bits = v.kind == "bpe"
    meet, extend = (int.__or__, lambda row, w: row) if bits else (np.maximum, np.add)
    carried: dict[State, int | np.ndarray] = {s: 1 << i if bits else np.where(np.arange(len(entries)) == i, 0.0, NEVER) for i, s in enumerate(entries)}
    open_at: dict[int, list[State]] = {}
    for s in entries:
        open_at.setdefault(s[1], []).append(s)
    for pos in range(min(open_at, default=at), at):
        states = open_at.pop(pos, ())
        ends = list(v.at(text, pos)) if states else []
        for state in states:
            row = carried.pop(state)
            for e in ends:
                step = (pos, e)
                if (w := v.weight(text, state, step)) == NEVER:
                    continue
                further = extend(row, w)
                if step in carried:
                    carried[step] = meet(carried[step], further)
                else:
                    carried[step] = further
                    open_at.setdefault(e, []).append(step)
    matrix: Matrix = {}
    for state, row in carried.items():
        for i, entry in enumerate(entries):
            if (row >> i & 1) if bits else row[i] > NEVER:
                matrix.setdefault(entry, {})[state] = 0.0 if bits else float(row[i])
    return matrix


def forward(v: Vocabulary, text: str, entry: State, at: int) -> tuple[dict[State, float], dict[State, State]]:
    """Best weights from one entry to each state at `at`, and the step before each state."""
    best, before = {entry: 0.0}, {}
    open_at: dict[int, list[State]] = {entry[1]: [entry]}
    for pos in range(entry[1], at):
        states = open_at.pop(pos, ())
        ends = list(v.at(text, pos)) if states else []
        for state in states:
            for e in ends:
                step = (pos, e)
                if (w := v.weight(text, state, step)) == NEVER:
                    continue
                if step not in best:
                    open_at.setdefault(e, []).append(step)
                if best[state] + w > best.get(step, NEVER):
                    best[step], before[step] = best[state] + w, state
    return {s: best[s] for left in open_at.values() for s in left}, before


def best_path(v: Vocabulary, text: str) -> list[State]:
    """The whole text in one go."""
    ends, before = forward(v, text, START, len(text))
    end = max(((w, s) for s, w in ends.items() if s[1] == len(text)))[1]
    return walk(before, START, end)


def walk(before: dict[State, State], entry: State, end: State) -> list[State]:
    path = []
    while end != entry:
        path.append(end)
        end = before[end]
    return path[::-1]


@dataclass
class Chunk:
    """A stretch [start, end) of a text with so much around it that pieces over its bounds are seen.

    `text` begins at `offset` of the whole; `last` tells that the text ends with the chunk. All states are in places of
    the whole text.
    """

    text: str
    offset: int
    start: int
    end: int
    last: bool

    def entries(self, v: Vocabulary) -> list[State]:
        return [START] if self.start == 0 else [(s + self.offset, e + self.offset) for s, e in states_at(v, self.text, self.start - self.offset)]

    def _inner(self, v: Vocabulary) -> tuple[int, int] | None:
        """Places, in self.text, of the first and last cut that lie in the chunk and touch no piece over its bounds."""
        if not v.cuts:
            return None
        low, high = max([e for _, e in self.entries(v)]) - self.offset, self.end - self.offset
        cut = re.compile(f"(?<=[^{MARK}]){MARK}")
        first = cut.search(self.text, max(1, low), high)
        if not first:
            return None
        at = high
        while (at := self.text.rfind(MARK, first.start(), at)) > first.start() and self.text[at - 1] == MARK:
            pass
        return (first.start(), at) if at >= first.start() and self.text[at - 1] != MARK else (first.start(), first.start())

    def _local(self, s: State) -> State:
        return s if s == START else (s[0] - self.offset, s[1] - self.offset)

    def _whole(self, s: State) -> State:
        return s if s == START else (s[0] + self.offset, s[1] + self.offset)

    def matrix(self, v: Vocabulary) -> Matrix:
        at = self.end - self.offset
        entries = [self._local(s) for s in self.entries(v)]
        inner = self._inner(v)
        if inner is None:
            found = transfer(v, self.text, entries, at)
        else:
            head = transfer(v, self.text, entries, inner[0])
            middle = 0.0 if v.kind == "bpe" else sum(self._score(v, u) for u in UNIT.findall(self.text[inner[0] : inner[1]]))
            tail = transfer(v, self.text, [(-1, inner[1])], at)
            # All paths go through both cuts, and what follows a cut doesn't depend on what was before.
            found = {s: {e: max(row.values()) + middle + w for e, w in tail[-1, inner[1]].items()} for s, row in head.items()}
        return {self._whole(s): {self._whole(e): w for e, w in row.items() if not self.last or self._whole(e)[1] == self.end} for s, row in found.items()}

    @staticmethod
    def _score(v: Vocabulary, unit: str) -> float:
        path = best_path(v, unit)
        return sum(v.weight(unit, START, s) for s in path)

    def backtrace(self, v: Vocabulary, entry: State, end: State) -> bytes:
        """Ids of the pieces after `entry` up to and with `end`."""
        at = self.end - self.offset
        entry, end = self._local(entry), self._local(end)
        inner = self._inner(v)
        ids = lambda path: np.array([i for s, e in path for i in v.to_ids(self.text[s:e])], v.dtype).tobytes()
        if inner is None:
            return ids(walk(forward(v, self.text, entry, at)[1], entry, end))
        head, before = forward(v, self.text, entry, inner[0])
        through = max((w, s) for s, w in head.items())[1]
        cut = (-1, inner[1])
        after = forward(v, self.text, cut, at)[1]
        return ids(walk(before, entry, through)) + v.encode(self.text[inner[0] : inner[1]]) + ids(walk(after, cut, end))


def chunks_of(text: str, size: int, margin: int) -> list[Chunk]:
    return [chunk_at(text, s, size, margin) for s in range(0, len(text), size)]


def product(matrices: list[Matrix]) -> Matrix:
    """All of them in order, pairwise: any grouping gives the same."""
    while len(matrices) > 1:
        matrices = [multiply(matrices[i], matrices[i + 1]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def best_states(matrices: list[Matrix], entry: State = START, end: State | None = None) -> list[State]:
    """States of the best path from `entry` to `end` (the best one there is) at every boundary, both included.

    Products are formed pairwise up a tree and the choice goes down again: the work can be shared out at every level.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([multiply(below[i], below[i + 1]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    bounds = [entry, end if end is not None else max((w, s) for s, w in levels[-1][0][entry].items())[1]]
    for below in reversed(levels[:-1]):
        finer = [bounds[0]]
        for i in range(0, len(below), 2):
            s, e = bounds[i // 2], bounds[i // 2 + 1]
            if i + 1 < len(below):
                finer.append(max((x + below[i + 1][m].get(e, NEVER), m) for m, x in below[i][s].items() if m in below[i + 1])[1])
            finer.append(e)
        bounds = finer
    return bounds


def scanned(matrices: list[Matrix], fan: int) -> list[State]:
    """The same by two levels, as the tasks do it."""
    parts = [matrices[i : i + fan] for i in range(0, len(matrices), fan)]
    bounds = best_states([product(p) for p in parts])
    inner = [best_states(p, bounds[i], bounds[i + 1])[:-1] for i, p in enumerate(parts)]
    return [s for p in inner for s in p] + bounds[-1:]


def encode_chunked(v: Vocabulary, text: str, size: int, fan: int = FAN) -> bytes:
    """The scan in one process, as the tests use it."""
    if not text:
        return b""
    chunks = chunks_of(text, size, v.longest)
    states = scanned([c.matrix(v) for c in chunks], fan)
    return b"".join(c.backtrace(v, a, b) for c, a, b in zip(chunks, states, states[1:], strict=False))


def digest_parts(values: np.ndarray) -> tuple[int, int]:
    """Sum of the values, and of each times its place from 1, both modulo DIGEST; a later stretch adds its places' offset."""
    total = weighted = 0
    for low in range(0, len(values), DIGESTED_AT_ONCE):
        x = values[low : low + DIGESTED_AT_ONCE].astype(np.int64)
        part = int(x.sum())  # neither this nor the product below reaches 63 bits
        total += part
        weighted += int(np.dot(PLACES[: len(x)], x)) + low % DIGEST * part
    return total % DIGEST, weighted % DIGEST


CHUNK, STATE = ["text", "offset", "start", "end", "last"], ["s0", "s1", "e0", "e1"]
PART = "n_tokens long, ids_sum long, ids_weighted long, n_decoded long, text_sum long, text_weighted long, exact boolean, ids array<int>"
NAMES = [x.split()[0] for x in PART.split(", ")]


def part(v: Vocabulary, ids: bytes, wanted: str, first: bool, with_ids: bool) -> tuple:
    """PART of a chunk: its ids and their digest, the text that they decode to as a digest of its code points, and
    whether that is the wanted one."""
    array = np.frombuffer(ids, v.dtype)
    text = v.decode(ids)
    text = restored(text) if first else text
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return len(array), *digest_parts(array), len(points), *digest_parts(points), text == wanted, array.astype(np.int32) if with_ids else None


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL, chunk_chars: int = CHUNK_CHARS, with_ids: bool = True, fan: int = FAN) -> DataFrame:
    """Rows of (row, key, chunk, first, first_char, PART), in `chunk` order for each row of `docs`.

    A document of up to `chunk_chars` characters is one chunk; larger ones go through the max-plus scan, and no task has
    to hold one of those whole but the one that reads it. `first` and `first_char` count the ids and the decoded characters
    before the chunk. `exact` tells that
    decoding gives the text back; a text with the space mark itself in it comes back with spaces. Null and empty texts
    give one chunk without ids. Keys may be null or repeat: `row` numbers the rows of `docs`. Other columns of `docs` are
    left out, whatever their names. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    columns = ["row", "k", "chunk", "first", "first_char", *NAMES]
    out = f"row long, k {kind}, chunk int, first long, first_char long, {PART}"

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            rows, held = [], 0
            every = v.encode_all([normalised(t or "") for t in batch["t"]])
            for (row, k, t), ids in zip(batch.itertuples(index=False, name=None), every, strict=True):
                rows.append((row, k, 0, 0, 0, *part(v, ids, t or "", True, with_ids)))
                held += rows[-1][5]
                if held >= TOKENS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)
        v.fits.clear()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        margin = vocabulary(path).longest
        for batch in batches:
            for row, k, t in batch.itertuples(index=False, name=None):
                whole, rows, held = normalised(t), [], 0
                for i in range(0, len(whole), chunk_chars):
                    c = chunk_at(whole, i, chunk_chars, margin)
                    rows.append((row, k, i // chunk_chars, -(-len(whole) // chunk_chars), c.text, c.offset, c.start, c.end, c.last))
                    held += len(c.text)
                    if held >= TOKENS_AT_ONCE:
                        yield pd.DataFrame(rows, columns=["row", "k", "chunk", "n_chunks", *CHUNK])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["row", "k", "chunk", "n_chunks", *CHUNK])

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            packed = [pack(Chunk(*c).matrix(v)) for c in batch[CHUNK].itertuples(index=False, name=None)]
            yield pd.DataFrame({"row": batch["row"], "stretch": batch["chunk"] // fan, "chunk": batch["chunk"], "n_chunks": batch["n_chunks"], "matrix": packed})

    def stretches(rows: pd.DataFrame, at: str) -> Iterator[tuple[tuple, list[Matrix], pd.DataFrame]]:
        for key, part in rows.sort_values(["row", "stretch", at]).groupby(["row", "stretch"]):
            yield key, [unpack(x) for x in part["matrix"]], part

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(row, 0, n, pack(product(m))) for (row, n), m, _ in stretches(rows, "chunk")], columns=["row", "stretch", "chunk", "matrix"])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        """The states of each of a stretch's matrices: between the bounds it has, or from the start to the best end."""
        out = []
        for (row, _), m, part in stretches(rows, "chunk"):
            bounds = tuple(int(part[c].iloc[0]) for c in STATE) if STATE[0] in part else None
            states = best_states(m, bounds[:2], bounds[2:]) if bounds else best_states(m)
            out += [(row, n, *a, *b) for n, a, b in zip(part["chunk"], states, states[1:], strict=False)]
        return pd.DataFrame(out, columns=["row", "chunk", *STATE])

    def dealt(rows: DataFrame, n: int, *by: str):  # noqa: ANN202
        """Groups of stretches, of about `fan` matrices in all."""
        groups = max(1, n // fan)
        tasks = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return rows.withColumn("group", F.pmod(F.xxhash64(*by), F.lit(groups))).repartition(tasks, "group").groupBy("group")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            rows, held = [], 0
            for low in range(0, len(batch) if v.cuts else 0, max(1, CHARS_AT_ONCE // chunk_chars)):
                v.prepare([UNIT.findall(t) for t in batch["text"].iloc[low : low + max(1, CHARS_AT_ONCE // chunk_chars)]])
            for row, k, n, s0, s1, e0, e1, *c in batch[["row", "k", "chunk", "s0", "s1", "e0", "e1", *CHUNK]].itertuples(index=False, name=None):
                chunk = Chunk(*c)
                ids = chunk.backtrace(v, (s0, s1), (e0, e1))
                wanted = chunk.text[s1 - chunk.offset : e1 - chunk.offset].replace(MARK, " ")
                rows.append((row, k, n, 0, 0, *part(v, ids, wanted[1:] if n == 0 else wanted, n == 0, with_ids)))
                held += rows[-1][5]
                if held >= TOKENS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    long = F.char_length(F.coalesce("t", F.lit(""))) > chunk_chars - 1
    done = numbered.where(~long).mapInPandas(tidy(small), out)
    chunks = numbered.where(long).mapInPandas(tidy(cut), f"row long, k {kind}, chunk int, n_chunks int, text string, offset long, start long, end long, last boolean")
    # The chunks of one document are dealt out before they are written, so each table below reads them in any task.
    rows = materialize(chunks.repartition("row", "chunk"), "piece-chunks")
    leaves = materialize(rows.mapInPandas(tidy(matrices), "row long, stretch int, chunk int, n_chunks int, matrix binary"), "piece-matrices")
    chosen = "row long, chunk int, " + ", ".join(f"{c} long" for c in STATE)
    n, low, high = leaves.agg(F.count(F.lit(1)), F.min("n_chunks"), F.max("n_chunks")).first()
    found = []
    if n and low <= fan:
        found.append(dealt(leaves.where(F.col("n_chunks") <= fan), n, "row").applyInPandas(choose, chosen))
    if n and high > fan:
        several = leaves.where(F.col("n_chunks") > fan)
        products = dealt(several, n, "row", "stretch").applyInPandas(combine, "row long, stretch int, chunk int, matrix binary")
        bounds = materialize(dealt(products, n // fan, "row").applyInPandas(choose, chosen), "piece-bounds").withColumnRenamed("chunk", "stretch")
        found.append(dealt(several.join(bounds, ["row", "stretch"]), n, "row", "stretch").applyInPandas(choose, chosen))
    if not found:
        return done.withColumnRenamed("k", key)
    states = materialize(found[0].unionByName(found[1]) if len(found) > 1 else found[0], "piece-states")
    # There are as many states as chunks, so they are never broadcast.
    traced = rows.join(states.hint("merge"), ["row", "chunk"]).mapInPandas(tidy(trace), out)
    before = lambda n: F.coalesce(F.sum(n).over(Window.partitionBy("row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Rows of both branches are numbered by themselves: those of large documents are made negative.
    traced = traced.withColumns({"first": before("n_tokens"), "first_char": before("n_decoded"), "row": -1 - F.col("row")})
    return done.unionByName(traced).withColumnRenamed("k", key)


def decode_documents(parts: DataFrame, key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """(row, key, chunk, text) of encoded `parts` with ids: their texts in `chunk` order give the document.

    Each chunk is decoded by itself, so no document has to be whole anywhere. Null ids give an empty text.
    """
    ship(parts.sparkSession)
    kind = parts.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(np.array([] if ids is None else ids, v.dtype).tobytes()) for ids in batch["ids"]]
            yield pd.DataFrame({"row": batch["row"], "k": batch["k"], "chunk": batch["chunk"], "text": [restored(t) if n == 0 else t for t, n in zip(texts, batch["chunk"], strict=True)]})

    return parts.select("row", F.col(f"`{key}`").alias("k"), "chunk", "ids").mapInPandas(tidy(decode), f"row long, k {kind}, chunk int, text string").withColumnRenamed("k", key)


def chunk_at(text: str, start: int, size: int, margin: int) -> Chunk:
    n = len(text)
    low = max(0, start - margin)
    return Chunk(text[low : min(n, start + size + margin)], low, start, min(n, start + size), start + size >= n)


def op8_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row of `documents`: its chunks, tokens, digests of its ids and of the text they decode to, and whether
    that is the text. Rows that repeat a doc_id stay apart; null and empty texts have no tokens. An empty table gives no
    rows."""
    parts = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    shifted = lambda weighted, total, at: (F.col(weighted) + (F.col(at) % DIGEST) * F.col(total)) % DIGEST
    return parts.groupBy("row", "doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), (F.sum("ids_sum") % DIGEST).alias("ids_sum"), (F.sum(shifted("ids_weighted", "ids_sum", "first")) % DIGEST).alias("ids_digest"),
        (F.sum(shifted("text_weighted", "text_sum", "first_char")) % DIGEST).alias("text_digest"), F.min("exact").alias("exact"),
    ).drop("row")
