r"""Byte-level BPE encoding by merge ranks, and decoding.

A text is cut at special tokens, then into words by the vocabulary's pattern. A short word is held as its parts and a contiguous array
with the rank of each neighbouring pair; the least rank is looked for in the whole array, the leftmost of equals, its boundary is deleted, and the ranks on
both sides are looked up anew, until no pair has one. All new words of a few hundred texts go through this together, a row of a matrix each. It is a scan per
merge, so words of more than SHORT bytes take a heap of pairs over linked parts instead, with the same order of merges, in log time a merge. Words of
up to REMEMBERED characters are remembered with their ids.

Letters and numbers are those of Unicode 16; characters that later versions added are told apart by LATER.
Decoding joins the bytes of the ids and gives back every valid text. Defined cases: null text counts as empty, which has no
ids; bytes that aren't UTF-8 become U+FFFD; ids that the vocabulary lacks decode to nothing; repeated rows are encoded each; an empty table gives no
rows; other columns are ignored. A text is handled whole, a word at a time; beyond it and its ids, memory is the memo (MEMO words at most, in two halves).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table, texts, with_fields

#: Vocabulary of the registered query; a parameter everywhere else.
MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of a word up to which its ranks are scanned; characters of a word up to which it is remembered; words that a worker remembers.
SHORT, REMEMBERED, MEMO = 128, 48, 400_000
#: Rows of a record batch that are encoded at a time, and rows of a matrix of words; they bound the memory.
STEP, ROWS = 256, 8192

# The pattern of the vocabulary (letters go first here; what may follow an apostrophe begins with it, so no word is cut otherwise), and characters that Unicode had not made letters or numbers by version 16.
PATTERN = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATER = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it can be seen, else one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = (b for b in range(256) if b not in set(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """byte_ids: id of each byte; pairs: left id << 32 | right id to rank; merged: id by rank; raw: the bytes of each id."""

    byte_ids: list[int]
    pairs: dict[int, int]
    merged: list[int]
    raw: dict[int, bytes]
    special: dict[str, int]
    key: str = field(default="")

    @classmethod
    def of(cls, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> Vocabulary:
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            pairs[vocab[a] << 32 | vocab[b]] = rank  # of a pair that is listed twice the last place counts
        raw = {i: bytes(back[c] for c in t) for t, i in vocab.items() if back.keys() >= set(t)}
        raw |= {i: t.encode() for t, i in special.items()}
        digest = hashlib.sha256(json.dumps([vocab, merges, special], sort_keys=True).encode()).hexdigest()
        return cls([vocab[letters[b]] for b in range(256)], pairs, [vocab[a + b] for a, b in merges], raw, special, digest)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A vocabulary file of the tokenizers library; refused if it asks for steps that this encoder has not."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        added = file.get("added_tokens", [])
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if odd or not plain or file["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only byte-level BPE without normalisation, word ends or stripped tokens can be encoded")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls.of(model["vocab"], merges, {t["content"]: t["id"] for t in added})


_NONE = 1 << 62


class Encoder:
    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.v, self.limit = vocabulary, memo
        self.memo: dict[str, bytes] = {}  # words to ids, 32 bits each
        self.old: dict[str, bytes] = {}  # words that come again survive when the younger half is full
        self.words = regex.compile(PATTERN)
        kind = lambda k: "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c)[0] == k)
        space = "\\t-\\r \x85\xa0"
        latin = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kind('L')}{kind('N')}]").replace(r"\p{L}", f"[{kind('L')}]").replace(r"\p{N}", f"[{kind('N')}]")
        self.words_latin = re.compile(latin.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))  # the same for texts of such characters, but faster
        later = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{LATER}])").replace(r"\p{L}+", rf"[\p{{L}}--[{LATER}]]+").replace(r"\p{N}+", rf"[\p{{N}}--[{LATER}]]+")
        self.later, self.words_later = re.compile(f"[{LATER}]"), regex.compile(later, regex.V1)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        pairs = sorted(vocabulary.pairs.items())
        self.pair_keys, self.pair_ranks = (np.array([*column, *more], np.int64) for column, more in zip(zip(*pairs) if pairs else ((), ()), ((_NONE,), (_NONE,))))
        self.byte_ids, self.merged = np.array(vocabulary.byte_ids, np.int64), np.array([*vocabulary.merged, 0], np.int64)

    def cut(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self.words_later if self.later.search(text) else self.words).findall(text)
        return self.words_latin.findall(text)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; new words of all of them are merged together."""
        pieces = [self.special.split(text) if self.special else [text] for text in texts]
        cut = [[piece if i % 2 else self.cut(piece) for i, piece in enumerate(parts)] for parts in pieces]  # special tokens stand at odd places
        need = set().union(*(words for parts in cut for words in parts[::2]))
        passing = self._learn(need)
        known, own = self.memo, {token: np.int32(i).tobytes() for token, i in self.v.special.items()}
        ids = [b"".join([own[words] if i % 2 else b"".join(map(known.__getitem__, words)) for i, words in enumerate(parts)]) for parts in cut]
        for word in passing:
            del known[word]
        return [np.frombuffer(x, np.int32) for x in ids]

    def _learn(self, need: set[str]) -> list[str]:
        """Put the needed words' ids into the memo; those of them that are too long to stay there."""
        new = need - self.memo.keys()
        if len(self.memo) + len(new) > self.limit // 2:
            self.old, self.memo, new = self.memo, {}, need
        again = new & self.old.keys()
        self.memo.update((word, self.old[word]) for word in again)
        new = list(new - again)
        self.memo.update(zip(new, self.merge_words([word.encode() for word in new])))
        return [word for word in new if len(word) > REMEMBERED]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word's bytes after all merges, 32 bits each."""
        out = [b""] * len(words)
        short = sorted((i for i, word in enumerate(words) if 0 < len(word) <= SHORT), key=lambda i: len(words[i]))
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = np.array(self._merge_long(list(map(self.v.byte_ids.__getitem__, word))), np.int32).tobytes()
        for a in range(0, len(short), ROWS):
            group = short[a : a + ROWS]
            for i, ids in zip(group, self._merge_rows([words[i] for i in group])):
                out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes]) -> list[bytes]:
        """The same for short words, a row each: parts, and the rank of each with the next one."""
        size = np.array(list(map(len, words)))
        wide = int(size.max())
        parts = self.byte_ids[np.frombuffer(b"".join([w.ljust(wide, b"\0") for w in words]), np.uint8).reshape(len(words), wide)]
        ranks = np.full(parts.shape, _NONE)
        ranks[:, :-1] = np.where(np.arange(1, wide) < size[:, None], self._ranks(parts[:, :-1], parts[:, 1:]), _NONE)
        out: list[bytes] = [b""] * len(words)
        number = np.arange(len(words))
        while len(number):
            rows = np.arange(len(number))
            at = ranks.argmin(axis=1)  # the leftmost of equals
            least = ranks[rows, at]
            done = least == _NONE
            if done.any():
                for i, n, row in zip(number[done].tolist(), size[done].tolist(), parts[done].astype(np.int32)):
                    out[i] = row[:n].tobytes()
                keep = ~done
                number, size, parts, ranks, at, least = (x[keep] for x in (number, size, parts, ranks, at, least))
                rows = rows[: len(number)]
                if not len(number):
                    break
            size = size - 1
            wide = int(size.max())
            parts[rows, at] = self.merged[least]
            place = np.arange(wide)
            place = place + (place > at[:, None])  # the boundary after the merged part goes
            parts, ranks = np.take_along_axis(parts, place, 1), np.take_along_axis(ranks, place, 1)
            after = np.minimum(at + 1, wide - 1)
            ranks[rows, at] = np.where(at + 1 < size, self._ranks(parts[rows, at], parts[rows, after]), _NONE)
            (left,) = np.nonzero(at)
            ranks[left, at[left] - 1] = self._ranks(parts[left, at[left] - 1], parts[left, at[left]])
        return out

    def merge(self, word: bytes) -> list[int]:
        return np.frombuffer(self.merge_words([word])[0], np.int32).tolist()

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same, by a heap of (rank, place) over linked parts; entries whose pair has changed are passed over."""
        rank, end = self.v.pairs.get, len(parts)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        current = [rank(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])] + [_NONE]
        heap = [(r, i) for i, r in enumerate(current) if r != _NONE]
        heapq.heapify(heap)

        def renew(i: int) -> None:
            j = after[i]
            current[i] = rank(parts[i] << 32 | parts[j], _NONE) if j < end else _NONE
            if current[i] != _NONE:
                heapq.heappush(heap, (current[i], i))

        while heap:
            least, i = heapq.heappop(heap)
            if current[i] != least:
                continue
            gone = after[i]
            parts[i], after[i] = self.v.merged[least], after[gone]
            current[gone] = _NONE
            if after[i] < end:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        out, i = [], 0
        while i < end:
            out.append(parts[i])
            i = after[i]
        return out


def decode(ids: list[int], raw: dict[int, bytes]) -> str:
    """The text of a list of ids; raw: Vocabulary.raw."""
    return b"".join([raw.get(i, b"") for i in ids]).decode("utf-8", "replace")


class Decoder:
    """Decodes lists of ids at once: the bytes of all their ids in a row are the bytes of all texts."""

    def __init__(self, raw: dict[int, bytes]):
        self.none = max(raw, default=-1) + 1  # stands for ids that the vocabulary lacks
        self.raw = pa.array([raw.get(i, b"") for i in range(self.none + 1)], pa.binary())

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        flat = ids.flatten()
        known = flat.to_numpy(zero_copy_only=False)
        known = np.where((known >= 0) & (known < self.none), known, self.none)
        joined = self.raw.take(pa.array(known.astype(np.int32)))
        cuts = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1][np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])]
        text = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), joined.buffers()[2]])
        try:
            text = text.cast(pa.string())
        except pa.ArrowInvalid:  # a list that isn't the whole of a text
            text = pa.array([t.decode("utf-8", "replace") for t in text.to_pylist()], pa.string())
        return pc.if_else(ids.is_null(), None, text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder, kept between tasks for its memo; one at a time."""
    if vocabulary.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.key] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.key]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(i, STEP) for whole in batches for i in range(0, whole.num_rows, STEP))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, *keep: str) -> DataFrame:
    """The kept columns and the ids of every row."""
    frame = texts(docs, *keep)
    schema = with_fields(frame, list(keep), "ids array<int>")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in _steps(batches):
            ids = own.encode_all([t.decode("utf-8", "replace") for t in columns(batch, "text")[0]])
            cuts = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), lists], names=schema.names)

    return frame.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, *keep: str) -> DataFrame:
    """The kept columns and the text of every row with ids; null ids give null."""
    frame = encoded.select(*keep, *(c for c in ("ids",) if c not in keep))
    schema = with_fields(frame, list(keep), "text string")
    raw = encoded.sparkSession.sparkContext.broadcast(vocabulary.raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(raw.value)
        for batch in _steps(batches):
            text = own.decode_all(batch.column(batch.schema.get_field_index("ids")))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), text], names=schema.names)

    return frame.mapInArrow(run, schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to."""
    vocabulary = Vocabulary.load(MODEL)
    rows = decode_documents(encode_documents(table(spark, sf_dir, "documents"), vocabulary, "doc_id"), vocabulary, "doc_id", "ids")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
