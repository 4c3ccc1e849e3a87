"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is fed to the search in chunks. A trellis runs over the characters that are not committed yet: each position
keeps the best piece that ends there and where it begins. Positions from which some piece could still reach beyond the
end of what was fed are alive; there are at most as many as the longest piece has characters. As soon as the
backpointer paths of all alive positions meet in one boundary, the ids before it are final: they are committed and
their part of the trellis is dropped. At a space, which pieces have at their beginning only, that is the case at once.

What a chunk commits depends on the characters that are held and on the piece before them only, so each worker
remembers these transitions in a bounded cache; how a text is cut into chunks makes no difference to its ids.

Two kinds of model are read:

* ``unigram``: a path's value is the sum of its pieces' scores, the greatest wins.
* ``bpe``: merges by rank are no sum of scores. But a segmentation is the one that merging gives exactly if merging any
  two neighbouring pieces alone gives these two pieces back, so each position has one valid last piece, and the same
  trellis yields the library's ids with that test in place of the sum. An automaton over the beginnings of pieces
  names the pieces that end at a position, longest first; the first that passes is the valid one.

Characters that the vocabulary lacks become byte pieces, or the unknown id. Models with a normaliser other than the
identity, without the dummy prefix, with escaping off or with user-defined pieces are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import worker_cache

#: Transitions of chunks, and pairs of pieces with steps of the automaton, that a worker remembers; a cache starts anew when it is full.
CACHE_STEPS = 800_000
CACHE_PAIRS = 1_000_000
#: Characters of a chunk at most.
CHUNK = 48
SPACE = "▁"
DEAD = -2
#: What a character outside the vocabulary costs in a unigram path, below the worst piece.
UNKNOWN_PENALTY = 10.0


#: Fixed values of the public model format: the trainer's settings, the model type in them, its values for unigram and BPE;
#: the normaliser's settings and in them its table, dummy prefix, removal of extra spaces, escaping and rules.
TRAINER_SPEC, MODEL_TYPE, UNIGRAM, BPE = 2, 3, 1, 2
NORMALIZER_SPEC, TABLE, PREFIX, REMOVE, ESCAPE, RULES = 3, 2, 3, 4, 5, 6


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a protocol buffer message."""
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


class State(dict):
    """What is held between chunks; as a dict, what was committed for a chunk and the state after it."""

    __slots__ = ("before", "text", "back", "value", "rest")

    def __init__(self, before: int, text: str):
        super().__init__()
        self.before, self.text = before, text
        self.back: list[int] | None = None  # kept only while more is held than the longest piece has
        self.value: list | None = None
        self.rest: bytes | None = None


class Ending(dict):
    """What a text ends with: the longest beginning of a piece; as a dict, the one after a further character."""

    __slots__ = ("search", "text", "last", "otherwise")

    def __init__(self, search: StreamingViterbi, text: str, otherwise: int):
        super().__init__()
        self.search, self.text, self.otherwise = search, text, otherwise
        #: Length, id and neighbours of the pieces that end here, longest first.
        self.last = [(len(p), own, search.neighbours(p)) for k in range(len(text)) if (own := search.known.get(p := text[k:], -1)) >= 0]

    def __missing__(self, char: str) -> Ending:
        if char not in self.search.alphabet:
            return self.search.outside
        self.search.remembered += 1
        return self.setdefault(char, self.search.ending(self.text + char))


class Neighbours(dict):
    """Whether a piece is valid behind the piece of an id, and (at -1) where none matters; nothing is behind ``DEAD``."""

    __slots__ = ("search", "piece")

    def __init__(self, search: StreamingViterbi, piece: str):
        super().__init__({DEAD: False, -1: search.merged(piece) == [piece]})
        self.search, self.piece = search, piece

    def __missing__(self, before: int) -> bool:
        self.search.remembered += 1
        return self.setdefault(before, self.search.fits(self.search.names[before], self.piece))


class StreamingViterbi:
    """Pieces of strings under a vocabulary ``pieces`` (piece to id) with ``scores`` (piece to score)."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], kind: str):
        assert kind in ("unigram", "bpe")
        self.pieces, self.scores, self.kind = pieces, scores, kind
        self.names = {i: p for p, i in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        self.unknown_score = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.alphabet = set().union(*pieces) if pieces else set()
        self.begun = {p[:k] for p in pieces for k in range(1, len(p))}
        #: The id of each piece, and -1 for what only begins one.
        self.known = dict.fromkeys(self.begun, -1) | pieces
        self.inside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.commits = self.most_pending = 0
        self.forget()

    def forget(self) -> None:
        """Starts the automaton and the pairs anew."""
        self.remembered = 0
        self.pairs: dict[str, Neighbours] = {}
        self.endings: dict[str, Ending] = {}
        self.nothing, self.outside = self.ending(""), Ending(self, "", -1)

    def neighbours(self, piece: str) -> Neighbours:
        if (found := self.pairs.get(piece)) is None:
            found = self.pairs[piece] = Neighbours(self, piece)
        return found

    def ending(self, text: str) -> Ending:
        while text and text not in self.known:
            text = text[1:]
        if (found := self.endings.get(text)) is None:
            found = self.endings[text] = Ending(self, text, DEAD)
        return found

    def merged(self, text: str) -> list[str]:
        """Merging by rank, plainly; only for two pieces at a time."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives these two pieces; a merge across the boundary, never undone, ends the search."""
        get, none = self.scores.get, float("-inf")
        parts, cut = list(left + right), len(left)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            if at == cut - 1:
                return False
            if at < cut:
                cut -= 1
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], none)
        return len(parts) == 2 and cut == 1

    def last_by_sum(self, text: str, i: int, back: list[int], value: list[float]) -> tuple[int, float]:
        """Where the best piece that ends at ``i`` begins, and the value of the path with it."""
        start, best = i - 1, value[i - 1] + self.scores.get(text[i - 1], self.unknown_score)
        for j in range(max(0, i - self.longest), i - 1):
            score = self.scores.get(text[j:i])
            if score is not None and value[j] + score > best:
                start, best = j, value[j] + score
        return start, best

    def extend_by_pairs(self, text: str, back: list[int], ids: list[int]) -> None:
        """Continues the trellis to the end of ``text``: where the one valid piece that ends at each position begins, and its id.

        The id is -1 for a character that no piece has. It is ``DEAD`` if no segmentation with the boundaries that are
        committed has one at the position. ``ids[0]`` is the id before ``text`` (-1: none matters).
        """
        if self.remembered > CACHE_PAIRS:
            self.forget()
        at = len(back) - 1
        ending = self.nothing
        for char in text[max(0, at - self.longest) : at]:
            ending = ending[char]
        for i, char in enumerate(text[at:], at + 1):
            ending = ending[char]
            for length, own, fits in ending.last:
                if fits[ids[i - length]]:
                    back.append(i - length)
                    ids.append(own)
                    break
            else:
                back.append(i - 1)
                ids.append(ending.otherwise)

    def extend(self, text: str, back: list[int], value: list) -> None:
        """Continues the trellis to the end of ``text``."""
        if self.kind == "bpe":
            return self.extend_by_pairs(text, back, value)
        for i in range(len(back), len(text) + 1):
            start, best = self.last_by_sum(text, i, back, value)
            back.append(start)
            value.append(best)

    def feed(self, state: State, chunk: str) -> tuple[list[str], State]:
        """The pieces that are certain after ``chunk``, and what is held then."""
        text = state.text + chunk
        back, value = (state.back, state.value) if state.back is not None else ([0], [state.before if self.kind == "bpe" else 0.0])
        self.extend(text, back, value)
        end = self.meeting(text, back, value)
        done = self.path(text, back, end)
        self.commits += bool(end)
        self.most_pending = max(self.most_pending, len(text))
        # the piece before matters only if some piece could reach across the boundary
        crossing = end and end < len(text) and text[end - 1 : end + 1] in self.inside or end == len(text)
        after = State(value[end] if self.kind == "bpe" and (crossing or not end) else -1, text[end:])
        if len(text) - end > self.longest:
            after.back, after.value = [x - end for x in back[end:]], value[end:]
            after.back[0], after.value[0] = 0, after.before if self.kind == "bpe" else value[end]
        return done, after

    def meeting(self, text: str, back: list[int], value: list) -> int:
        """The last boundary that the paths of all alive positions share."""
        n = len(text)
        alive = {n}
        for j in range(n - 1, max(0, n - self.longest + 1) - 1, -1):
            if j < n - 1 and text[j : j + 2] not in self.inside:
                break  # no piece has these two characters, so none reaches from before them beyond the end
            if text[j:] in self.begun and value[j] != DEAD:
                alive.add(j)
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last])
        return alive.pop()

    @staticmethod
    def path(text: str, back: list[int], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def rest(self, state: State) -> list[str]:
        """The pieces of what is held, at the end of a text."""
        back, value = (state.back, state.value) if state.back is not None else ([0], [state.before if self.kind == "bpe" else 0.0])
        self.extend(state.text, back, value)
        return self.path(state.text, back, len(state.text))

    def segment(self, text: str, chunk: int = CHUNK) -> Iterator[str]:
        """The pieces of ``text`` in order, each as soon as it is certain."""
        state = State(-1, "")
        for at in range(0, len(text), chunk):
            done, state = self.feed(state, text[at : at + chunk])
            yield from done
        yield from self.rest(state)


class Codec:
    """Encodes and decodes texts under a SentencePiece model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = dict(fields(model.serialized_model_proto()))
        kind = dict(fields(proto.get(TRAINER_SPEC, b""))).get(MODEL_TYPE, UNIGRAM)
        rules = dict(fields(proto.get(NORMALIZER_SPEC, b"")))
        if kind not in (UNIGRAM, BPE) or rules.get(TABLE) or rules.get(RULES) or not rules.get(PREFIX, 1) or rules.get(REMOVE, 1) or not rules.get(ESCAPE, 1):
            raise ValueError(f"{model_file}: only unigram and BPE models with the identity normaliser and the dummy prefix are supported")
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in normal}
        if kind == BPE and any(model.get_score(i) > 0 or (len(p) > 1 and model.get_score(i) == 0 and i > normal[0]) for p, i in pieces.items()):
            raise ValueError(f"{model_file}: user-defined pieces are not supported")
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.viterbi = StreamingViterbi(pieces, {p: model.get_score(i) for p, i in pieces.items()}, "bpe" if kind == BPE else "unigram")
        self.surface = [b""] * len(ids)
        self.surface[self.unknown] = " \u2047 ".encode()  # what the public format shows for an unknown character
        for piece, i in pieces.items():
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.surface[i] = bytes([byte])
        self.chunks = re.compile(f"[^{SPACE}\n]{{0,{CHUNK}}}[{SPACE}\n]|[^{SPACE}\n]{{1,{CHUNK}}}").findall
        self.states: dict[tuple[int, str], State] = {}
        self.start = self.state(State(-1, ""))
        self.steps = 0

    def state(self, state: State) -> State:
        """The one state that remembers what follows it; longer windows are not remembered."""
        return state if state.back is not None else self.states.setdefault((state.before, state.text), state)

    def packed(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for piece in pieces:
            if (i := self.viterbi.pieces.get(piece)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def step(self, state: State, chunk: str) -> tuple[bytes, State]:
        """What ``chunk`` commits, and the state after it."""
        if self.steps > CACHE_STEPS:
            self.states.clear()
            self.steps, self.start = 0, self.state(State(-1, ""))
        live = state.back is not None
        pieces, after = self.viterbi.feed(state, chunk)
        found = self.packed(pieces), self.state(after)
        if not live:
            state[chunk] = found
            self.steps += 1
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; none for an empty text."""
        if not text:
            return b""
        out, state = [], self.start
        for chunk in self.chunks(SPACE + text.replace(" ", SPACE)):
            done, state = state.get(chunk) or self.step(state, chunk)
            out.append(done)
        if state.text:
            if state.rest is None:
                state.rest = self.packed(self.viterbi.rest(state))
            out.append(state.rest)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of ids; special ids have none, and the model's own mark stands for an unknown character."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(model_file: str) -> Codec:
    """One for each Python worker, kept between its tasks."""
    return worker_cache(f"codec {model_file}", lambda: Codec(model_file))


def _column_type(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def sentencepiece_encode(docs: DataFrame, model_file: str, *, text: str = "text", ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``ids`` (array of int) of each row; null for a null text, empty for an empty one."""
    rows = docs.select(*carry, docs[text].alias("__text"))
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model_file)
        for batch in batches:
            got = [None if t is None else np.frombuffer(use.encode(t), dtype="<i4") for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, pa.list_(pa.int32()))], names=[*carry, ids])

    return rows.mapInArrow(run, ", ".join([*(_column_type(docs, c) for c in carry), f"`{ids}` array<int>"]))


def sentencepiece_decode(encoded: DataFrame, model_file: str, *, ids: str = "ids", text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and the ``text`` that ``ids`` stand for; null for null."""
    rows = encoded.select(*carry, encoded[ids].alias("__ids"))
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model_file)
        for batch in batches:
            got = [None if x is None else use.decode(np.array(x, dtype="<u4").tobytes()) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, pa.string())], names=[*carry, text])

    return rows.mapInArrow(run, ", ".join([*(_column_type(encoded, c) for c in carry), f"`{text}` string"]))


def sentencepiece_digest(docs: DataFrame, model_file: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes each whole text: token count, CRC-32 of the packed ids, and whether the text came back.

    A null text counts as empty. The space mark itself decodes to a space, so a text that contains it does not come
    back as it was. One pass without a shuffle; memory is bounded by a batch and the worker's caches.
    """
    rows = docs.select(*carry, docs[text].alias("__text"))
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(n).to_pylist()]
            packed = [use.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:n],
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([zlib.crc32(x) for x in packed], pa.int64()),
                    pa.array([use.decode(x) == t for x, t in zip(packed, texts, strict=True)], pa.bool_()),
                ],
                names=[*carry, "n_ids", "ids_crc32", "round_trip"],
            )

    return rows.mapInArrow(run, ", ".join([*(_column_type(docs, c) for c in carry), "n_ids long", "ids_crc32 long", "round_trip boolean"]))
