"""Operator 8: SentencePiece encoding and decoding with shared prefixes.

A text is cut into marked words (a word with its leading mark, U+2581).  No
piece crosses a word, so words are encoded one by one, and equal words once.
The distinct words of a task's slice are sorted, which lines them up as the
depth-first order of their trie; the forward states of the prefix that a word
shares with the one before are kept and only the rest is computed.

The forward recurrence follows the model file's type:

* unigram: Viterbi; state i holds the best score of the first i characters
  and the last piece of that path.
* BPE: a sequence of pieces is what merging produces if and only if every two
  neighbours, merged alone, stay those two pieces; so the first i characters
  have one valid last piece, the one that is compatible with the state where
  it begins.  (Adding up merge ranks as if they were scores would give other
  pieces than the model means.)  Runs of marks have pieces of equal rank, for
  which this need not hold; a word with such a run is merged directly.

Defined cases: null and empty texts give no pieces; characters that the model
lacks become its byte pieces, or the unknown piece if it has none (only then
is decoding lossy); U+2581 in a text is the same as a space, as in the
library; repeated rows are rows like any other; other columns are not read.
Models with a normalisation table or user-defined pieces are refused.
"""

from __future__ import annotations

import functools
import gc
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import slices

MARK = "▁"
#: Distinct words a task remembers; beyond it the memory starts anew.
CACHE_WORDS = 600_000
#: Pairs of pieces whose compatibility a worker remembers.
CACHE_PAIRS = 400_000
SLICE_BYTES = 1 << 20
UNIGRAM, BPE = 1, 2
#: Penalty of an unknown character below the worst piece (the library's value).
UNKNOWN_PENALTY = 10.0


class Pieces:
    """A model's pieces and the recurrences over them."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto.FromString(model)
        kinds = pb.ModelProto.SentencePiece.Type
        self.type = m.trainer_spec.model_type
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are known")
        if m.normalizer_spec.precompiled_charsmap or m.trainer_spec.treat_whitespace_as_suffix or any(
                p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces):
            raise ValueError("models with a normalisation table, suffix marks, user-defined or unused pieces are not supported")
        self.dummy_prefix = m.normalizer_spec.add_dummy_prefix
        self.squeeze = m.normalizer_spec.remove_extra_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        self.scores = [p.score for p in m.pieces]
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.bytes = [byte[b] for b in range(256)] if len(byte) == 256 else None
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a word")
        self.alphabet = {c for p in self.ids if len(p) == 1 for c in p}
        self.raw = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
                    else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode()
                    for p in m.pieces]
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.names = [p.piece for p in m.pieces]
        self._pairs: dict[int, bool] = {}

    @functools.cached_property
    def halves(self) -> dict[str, tuple[str, str] | None]:
        """For each piece that merging its own characters gives back, the two
        parts merged last; None for a single character."""
        out: dict[str, tuple[str, str] | None] = {}
        for p in sorted(self.ids, key=len):
            if len(p) == 1:
                out[p] = None
            elif (last := self.last_merge(p)) is not None:
                out[p] = last
        return out

    @functools.cached_property
    def endings(self) -> dict[str, int]:
        """Every ending of a piece, with the id of the piece that it is, or -1.
        Where a part is no ending, no longer piece ends either."""
        usable = self.ids if self.type == UNIGRAM else self.halves
        return dict.fromkeys((p[i:] for p in self.ids for i in range(len(p))), -1) | {p: self.ids[p] for p in usable}

    @functools.cached_property
    def strange(self) -> re.Pattern:
        """A character that has no piece of its own."""
        return re.compile("[^" + "".join(map(re.escape, sorted(self.alphabet))) + "]")

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    # ---------------------------------------------------------------- BPE

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge completes the piece, if merging does."""
        made: list[tuple[str, str]] = []
        return made[-1] if self.merge(piece, made) == [self.ids[piece]] else None

    def merge(self, chars: str, made: list | None = None) -> list[int]:
        """Merge the best-ranked neighbours (leftmost of equals) until none
        is left, noting the merges in ``made``.  All characters have pieces."""
        parts: list[str | None] = list(chars)
        right = [*range(1, len(parts)), -1]
        left = [-1, *range(len(parts) - 1)]
        heap = []

        def offer(i, j):
            p = self.ids.get(parts[i] + parts[j])
            if p is not None:
                heapq.heappush(heap, (-self.scores[p], i, j, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if parts[i] is not a or parts[j] is not b or right[i] != j:
                continue
            if made is not None:
                made.append((a, b))
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [self.ids[p] for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b gives back a and b.

        The merges inside a and b are undone, last one first.  A merge across
        the border would come first, and spoil them, if the two parts that
        meet there form a piece of better rank than the merge undone last; of
        equal rank, if that merge was to the right of the border."""
        ids, scores, halves = self.ids, self.scores, self.halves
        left, right, undone, to_right = a, b, float("-inf"), True
        while True:
            p = ids.get(left + right)
            if p is not None and (scores[p] > undone or scores[p] == undone and to_right):
                return False
            in_left, in_right = halves[left], halves[right]
            if in_left is None and in_right is None:
                return True
            if in_right is None or in_left is not None and scores[ids[left]] < scores[ids[right]]:
                undone, to_right, left = scores[ids[left]], False, in_left[1]
            else:
                undone, to_right, right = scores[ids[right]], True, in_right[0]

    def _remembered(self, pair: int) -> bool:
        """``compatible`` of two piece ids packed into one number."""
        if len(self._pairs) >= CACHE_PAIRS:
            self._pairs.clear()
        known = self._pairs[pair] = self.compatible(self.names[pair >> 32], self.names[pair & 0xFFFFFFFF])
        return known

    # ------------------------------------------------- shared-prefix traversal

    def traverse(self, words: list[str]) -> dict[str, list[int]]:
        """Pieces of each of the sorted, distinct words: a depth-first walk of
        their trie that keeps the forward states of the shared prefix."""
        return self._traverse_unigram(words) if self.type == UNIGRAM else self._traverse_bpe(words)

    def _traverse_bpe(self, words: list[str]) -> dict[str, list[int]]:
        """State i: where the one valid last piece of the first i characters
        begins, and that piece."""
        endings, pairs, remembered, out = self.endings.get, self._pairs.get, self._remembered, {}
        begins, last, before = [0], [0], ""
        for word in words:
            n = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                n += 1
            del begins[n + 1:], last[n + 1:]
            for i in range(n + 1, len(word) + 1):
                for begin in range(i - 1, -1, -1):
                    piece = endings(word[begin:i])
                    if piece is None:
                        raise ValueError(f"no segmentation of {word[:i]!r}")
                    if piece >= 0:
                        if begin == 0:
                            break
                        pair = last[begin] << 32 | piece
                        known = pairs(pair)
                        if known or known is None and remembered(pair):
                            break
                begins.append(begin)
                last.append(piece)
            path, at = [], len(word)
            while at:
                path.append(last[at])
                at = begins[at]
            path.reverse()
            out[word] = path
            before = word
        return out

    def _traverse_unigram(self, words: list[str]) -> dict[str, list[int]]:
        """State i: where the last piece of the best path begins, that piece
        (-1: unknown), and the score; of equal scores the longest piece."""
        endings, scores, out = self.endings.get, self.scores, {}
        states, before = [(0, -1, 0.0)], ""
        for word in words:
            n = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                n += 1
            del states[n + 1:]
            for i in range(n + 1, len(word) + 1):
                best = (i - 1, -1, states[i - 1][2] + self.worst - UNKNOWN_PENALTY)
                for begin in range(i - 1, -1, -1):
                    piece = endings(word[begin:i])
                    if piece is None:
                        break
                    if piece >= 0:
                        score = states[begin][2] + scores[piece]
                        if score >= best[2] or best[1] < 0:
                            best = (begin, piece, score)
                states.append(best)
            path, at = [], len(word)
            while at:
                begin, piece = states[at][:2]
                path += (piece,) if piece >= 0 else reversed(self.fallback(word[begin]))
                at = begin
            path.reverse()
            out[word] = path
            before = word
        return out

    # --------------------------------------------------------------- words

    def units(self, word: str) -> list[str]:
        """What is encoded on its own: for BPE a character without a piece
        never merges, so it separates."""
        out, at = [], 0
        for m in self.strange.finditer(word):
            out += [word[at:m.start()]] * (m.start() > at) + [m[0]]
            at = m.end()
        return out + [word[at:]] * (at < len(word))

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Pieces of marked words."""
        if self.type == UNIGRAM:
            return self.traverse(sorted(words))
        odd = {w for w in words if MARK * 2 in w or self.strange.search(w)}
        parts = {w: self.units(w) for w in odd}
        units = {u for us in parts.values() for u in us}
        known = {u: self.fallback(u) for u in units if u not in self.alphabet and len(u) == 1}
        known |= {u: self.merge(u) for u in units if MARK * 2 in u}
        out = self.traverse(sorted((words - odd) | (units - known.keys())))
        known |= {u: out[u] for u in units - known.keys()}
        return out | {w: [p for u in us for p in known[u]] for w, us in parts.items()}

    def marked_words(self, text: str) -> list[str]:
        """Cut a text into marked words; a run of marks goes with its word."""
        if self.squeeze:
            text = " ".join(x for x in text.replace(MARK, " ").split(" ") if x)
        if not text:
            return []
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)

    def decode(self, ids) -> str:
        """The text of pieces; the mark that encoding put in front goes."""
        raw = self.raw
        data = b"".join([raw[i] for i in ids])
        if self.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


class Encoder:
    """Encodes texts, remembering a bounded number of distinct words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The int32 ids of each text, as bytes."""
        collecting = gc.isenabled()
        gc.disable()        # a million small lists, no cycles: walking over them again and again is a fifth of the time
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        # the words of a very long text are not held, but cut a second time
        cut = self.pieces.marked_words
        words = [cut(t) if len(t) <= SLICE_BYTES else None for t in texts]
        distinct = set()
        for t, ws in zip(texts, words):
            distinct.update(cut(t) if ws is None else ws)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, distinct
        for w, ids in self.pieces.encode_words(new).items():
            self.known[w] = array("i", ids).tobytes()
        known = self.known
        return [b"".join(map(known.__getitem__, cut(t) if ws is None else ws)) for t, ws in zip(texts, words)]


@functools.lru_cache(maxsize=1)
def pieces_of(model: bytes) -> Pieces:
    """The worker's tables of a model, kept from task to task."""
    return Pieces(model)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                  extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, ids, n_pieces, and whether decoding the ids gives the
    text back.  ``extra`` names columns to carry along.  The model file is read by the driver and sent to the tasks."""
    with open(model_file, "rb") as f:
        model = f.read()
    Pieces(model)   # refuse early
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"),
                       *(c.alias(k) for k, c in (extra or {}).items()))
    schema = T.StructType.fromDDL("doc_id long, ids array<int>, n_pieces int, round_trip boolean")
    schema = T.StructType([*schema.fields, *rows.schema.fields[2:]])
    names = schema.names

    def run(batches):
        encoder = Encoder(pieces_of(shared.value))
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                texts = [t or "" for t in b.column(1).to_pylist()]
                coded = encoder.encode(texts)
                counts = np.array([len(c) // 4 for c in coded], dtype=np.int32)
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                same = [encoder.pieces.decode(np.frombuffer(c, dtype=np.int32).tolist()) == t.replace(MARK, " ")
                        for c, t in zip(coded, texts)]
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(counts), pa.array(same), *b.columns[2:]], names=names)

    return rows.mapInArrow(run, schema)
