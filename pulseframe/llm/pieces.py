"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The encoder moves a window of the longest piece's length over a text and keeps the best score and
backpointer of each boundary. Only boundaries inside the window survive: no piece can start before it. Their backpointer paths are
followed until they meet; if they do at one boundary, the ids up to it are committed, and only what lies after it is retained. Where they never do (a long run of one
character), only a backpointer per character is held. Where no piece can cross
a place (before a space that follows something else, around newlines), all paths converge anyway, so the text is cut there;
each segment goes through the window by itself, and those that come again, mostly words, are remembered with their ids.

Scores: a unigram model's own log-probabilities. A BPE model's file has merge ranks instead of probabilities; they
become log-probabilities by Zipf's law, -log(1 + rank). So ids are those of the best-scoring segmentation
under the file's vocabulary, not those of replayed merges. Scores are summed as whole numbers. Of equal scores the one with the longer last piece wins.
Characters without a piece become byte pieces.

Decoding gives back every text exactly, U+2581 included (it is written in bytes). Defined cases: null text counts
as empty, which has no ids; repeated rows are encoded each; an empty table gives no rows; other columns are ignored. A text is
handled whole; beyond it, memory is the memo (MEMO entries at most), the window and four bytes a character that isn't committed yet.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import columns, table, texts, with_fields

#: Vocabulary of the registered query; a parameter everywhere else.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments that a worker remembers of each kind.
MEMO = 160_000
#: Characters of a segment up to which it is remembered.
REMEMBERED = 64
#: Scores are whole numbers of this part, so that sums are exact and equal scores are equal wherever a text is cut.
UNIT = 1 << 18
_WORST = -(1 << 200)


@dataclass
class Vocabulary:
    """Pieces with a plain space for the escape, as in the text."""

    ids: dict[str, tuple[int, int]]  # id and score
    byte_ids: list[int]
    byte_score: int
    raw: list[bytes]  # what each id decodes to
    longest: int
    cuttable: bool  # no piece holds a newline, or a space after something else
    key: str = field(default="")

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str]], bpe: bool) -> Vocabulary:
        """pieces: (text, score, kind) by id; kinds: normal, byte, control, unknown, unused."""
        ids, byte_ids, raw = {}, [-1] * 256, []
        order = sorted((i for i, p in enumerate(pieces) if p[2] == "normal"), key=lambda i: (-pieces[i][1], i))
        rank = {i: r for r, i in enumerate(order, 1)}
        for i, (text, score, kind) in enumerate(pieces):
            plain = text.replace("▁", " ")
            if kind == "normal":
                ids[plain] = (i, round(UNIT * (-math.log1p(rank[i]) if bpe else score)))
            if kind == "byte":
                byte_ids[int(text[3:5], 16)] = i
            raw.append(plain.encode() if kind == "normal" else bytes([int(text[3:5], 16)]) if kind == "byte" else b"")
        if -1 in byte_ids:
            raise ValueError("the vocabulary needs byte pieces, else some texts can't be decoded")
        least = min((s for _, s in ids.values()), default=0)
        return cls(
            ids, byte_ids, least - 10 * UNIT, raw, max(map(len, ids), default=1),
            not any("\n" in p or " " in p.lstrip(" ") for p in ids),
            hashlib.sha256(repr((pieces, bpe)).encode()).hexdigest(),
        )

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        sp = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is can be decoded exactly")
        kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal"
        return cls.of([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())], proto.trainer_spec.model_type == 2)


class StreamingViterbi:
    """Encodes characters as they come; feed returns the ids that are certain, close the rest.

    An automaton of all pieces lists those that end at each place. It sees the new characters and the window before them only; scores are kept for the window's
    boundaries. back has the last piece of each boundary since the last committed one: nothing else grows where paths don't meet. A commit is tried when what is
    held has doubled since the last try, so all tries together take time linear in the text.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.window = vocabulary, vocabulary.longest
        self.automaton = ahocorasick.Automaton()
        self.known = frozenset(chain.from_iterable(vocabulary.ids))  # a character of no piece is a boundary on both sides
        self.pieces: list[tuple[int, tuple[int, ...]]] = [(0, ())]  # length and ids
        for piece, (i, score) in vocabulary.ids.items():
            self._add(piece, score, (i,))
        for ch in self.known.difference(vocabulary.ids):
            self._add(ch, vocabulary.byte_score * len(ch.encode()), self._bytes(ch))
        self.automaton.make_automaton()
        self._reset()

    def _add(self, piece: str, score: float, ids: tuple[int, ...]) -> None:
        self.automaton.add_word(piece, (len(piece), score, len(self.pieces)))
        self.pieces.append((len(piece), ids))

    def _bytes(self, ch: str) -> tuple[int, ...]:
        return tuple([self.v.byte_ids[b] for b in ch.encode()])

    def _reset(self) -> None:
        self.text = ""  # the window's characters
        self.score = [0]  # of the boundaries before and after each of them
        self.back = array("i", [0])  # by boundary, from the last committed one on
        self.next_try = 2 * self.window

    def feed(self, more: str) -> list[int]:
        if self.known.issuperset(more):
            return self._known(more)
        out = []
        for known, run in groupby(more, self.known.__contains__):
            if known:
                out += self._known("".join(run))
            else:
                out += self.close()
                for ch in run:
                    out += self._bytes(ch)
        return out

    def segment(self, text: str) -> tuple[int, ...]:
        """feed and close of a text by itself. One that the window holds is settled by one pass; nothing of it needs to be kept."""
        size = len(text)
        if size > self.window or not self.known.issuperset(text):
            return tuple(self.feed(text) + self.close())
        score, back = [0] + [_WORST] * size, [0] * (size + 1)
        for end, (n, own, piece) in self.automaton.iter(text):
            if (s := score[end + 1 - n] + own) > score[end + 1]:
                score[end + 1], back[end + 1] = s, piece
        ids, pieces = (), self.pieces
        while size:
            n, own = pieces[back[size]]
            ids = own + ids
            size -= n
        return ids

    def _known(self, more: str) -> list[int]:
        """Move on by the longest piece's length at a time."""
        out, step = [], self.window
        for i in range(0, len(more), step):
            self._advance(more[i : i + step])
            if len(self.back) > self.next_try:
                out += self._commit()
                self.next_try = max(2 * self.window, 2 * len(self.back))
        return out

    def close(self) -> list[int]:
        out = self._path(len(self.back) - 1)
        self._reset()
        return out

    def _advance(self, part: str) -> None:
        """Settle the boundaries after each of the new characters."""
        before, text = len(self.text), self.text + part
        score, back = self.score + [_WORST] * len(part), array("i", bytes(4 * len(part)))
        for end, (n, own, piece) in self.automaton.iter(text):
            if end >= before and (s := score[end + 1 - n] + own) > score[end + 1]:
                score[end + 1], back[end - before] = s, piece
        self.back += back
        keep = min(self.window, len(text))
        self.text, self.score = text[len(text) - keep :], score[len(text) - keep :]

    def _path(self, end: int) -> list[int]:
        parts, back, pieces = [], self.back, self.pieces
        while end:
            n, ids = pieces[back[end]]
            parts.append(ids)
            end -= n
        return list(chain.from_iterable(reversed(parts)))

    def _commit(self) -> list[int]:
        """Ids up to the last boundary that the paths of all surviving boundaries pass through."""
        back, pieces = self.back, self.pieces
        place = len(back) - 1
        alive = set(range(max(0, place - self.window + 1), place + 1))
        while len(alive) > 1:  # the last of them steps back along its path, until all have met
            if place in alive:
                alive.discard(place)
                alive.add(place - pieces[back[place]][0])
            place -= 1
        place = alive.pop()
        ids = self._path(place)
        self.back = back[place:]
        self.back[0] = 0
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.v = vocabulary
        limit, search = memo, StreamingViterbi(vocabulary)

        class Memo(dict):
            """Segments seen lately; those that come again survive when the younger half is full."""

            def __init__(self, before: str):
                super().__init__()
                self.before, self.old = before, {}

            def __missing__(self, segment: str) -> tuple[int, ...]:
                ids = self.old.get(segment)
                if ids is None:
                    ids = search.segment(self.before + segment)
                if len(segment) <= REMEMBERED:
                    if len(self) >= limit // 2:
                        self.old = dict(self)
                        self.clear()
                    self[segment] = ids
                return ids

        self.spaced, self.bare = Memo(" "), Memo("")
        self.newline = (vocabulary.byte_ids[10],)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.v.cuttable:
            search = StreamingViterbi(self.v)
            out = []
            for i in range(0, len(text) + 1, 4096):
                out += search.feed(text[i : i + 4096] if i else " " + text[:4096])
            return out + search.close()
        parts, first = [], True
        for line in text.split("\n"):
            words = line.split(" ")
            if not first:
                parts.append(self.newline)
            if "" in words:  # several spaces in a row, or at an end: they go with what follows them
                words = list(self._runs((" " if first else "") + line))
                parts += [self.bare[w] for w in words]
            else:
                parts.append(self.spaced[words[0]] if first else self.bare[words[0]])
                parts += map(self.spaced.__getitem__, words[1:])
            first = False
        return list(chain.from_iterable(parts))

    @staticmethod
    def _runs(line: str) -> Iterator[str]:
        start = 0
        for i in range(1, len(line)):
            if line[i] == " " and line[i - 1] != " ":
                yield line[start:i]
                start = i
        if line:
            yield line[start:]


def decode(ids: list[int], raw: list[bytes]) -> str:
    """The text of a list of ids; raw: Vocabulary.raw."""
    return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder, kept between tasks for its memo."""
    if vocabulary.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.key] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.key]


def _lists(ids: list[list[int]]) -> pa.ListArray:
    cuts = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=cuts[1:])
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(cuts[-1]))))


#: Rows of a record batch that are encoded at a time; bounds the ids in memory.
STEP = 512


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, *keep: str) -> DataFrame:
    """The kept columns, n_ids and ids of every row."""
    frame = texts(docs, *keep)
    schema = with_fields(frame, list(keep), "n_ids bigint, ids array<int>")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for whole in batches:
            for batch in (whole.slice(i, STEP) for i in range(0, whole.num_rows, STEP)):
                ids = [own.encode(t.decode("utf-8", "replace")) for t in columns(batch, "text")[0]]
                rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(map(len, ids), pa.int64()), _lists(ids)], names=schema.names)

    return frame.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, *keep: str) -> DataFrame:
    """The kept columns and text of every row with ids; null ids give null."""
    frame = encoded.select(*keep, "ids")
    schema = with_fields(frame, list(keep), "text string")
    raw = encoded.sparkSession.sparkContext.broadcast(vocabulary.raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else decode(x, raw.value) for x in columns(batch, "ids")[0]]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(text, pa.string())], names=schema.names)

    return frame.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as 32-bit little-endian numbers), exact: decoding gave the text back."""
    frame = texts(docs, "doc_id")
    schema = with_fields(frame, ["doc_id"], "n_ids bigint, ids_sha256 string, exact boolean")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            sizes, digests, exact = [], [], []
            for raw in batch.column(batch.schema.get_field_index("text")):
                text = raw.as_py().decode("utf-8", "replace")
                ids = own.encode(text)
                sizes.append(len(ids))
                digests.append(hashlib.sha256(np.fromiter(ids, "<i4", len(ids)).tobytes()).hexdigest())
                exact.append(decode(ids, own.v.raw) == text)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(exact, pa.bool_())], names=schema.names)

    return frame.mapInArrow(run, schema)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, digested, and whether they decode to the text."""
    return round_trip(table(spark, sf_dir, "documents"), Vocabulary.load(MODEL))
