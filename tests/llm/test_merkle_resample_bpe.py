"""The Merkle manifest, importance resampling and byte-level BPE against brute force, the public library and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseframe.llm import byte_bpe, merkle, resample
from pulseframe.llm.common import materialise, ranked

from ..conftest import DATA
from .test_llm import AWKWARD, DOCS

CLASHING = DOCS + ", tree string, h int, rank int, node string, size int, words int, n_words int, `a.b` int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*row, "x", 1, 2, "y", 3, 4, 5, 6) for row in AWKWARD], CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


def test_ranks_of_repeated_rows_and_large_keys(spark):
    rng = random.Random(4)
    rows = [("hot", 7)] * 5000 + [(rng.choice("abc"), rng.choice((None, *range(50)))) for _ in range(2000)]
    df = materialise(spark.createDataFrame(rows, "k string, v int").repartition(7), "rows")
    got = ranked(df, ["k"], ["v"], "ranked").toPandas()
    for key, part in got.groupby("k"):
        assert sorted(part["rank"]) == list(range(len(part))) and set(part["size"]) == {len(part)}
        v = part.sort_values("rank").v.fillna(-1)
        assert list(v) == sorted(v)


# 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_manifest(rows, fan=8):
    """Leaf to (subroot, root, siblings from the leaf up) of each row; rows: doc_id, text, lang, source, n_chars."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        """The top's digest, and each node's steps (place, siblings)."""
        steps = [[] for _ in nodes]
        level = [(h, [i]) for i, h in enumerate(nodes)]
        while len(level) > 1:
            up = []
            for k in range(0, len(level), fan):
                run = level[k : k + fan]
                for at, (_, below) in enumerate(run):
                    for i in below:
                        steps[i].append((at, [h for j, (h, _) in enumerate(run) if j != at]))
                up.append((sha("".join(h for h, _ in run)), [i for _, below in run for i in below]))
            level = up
        return level[0][0], steps

    leaves = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        h = sha("".join(map(field, (doc_id, source, lang, n_chars, text))))
        leaves[lang].append((doc_id is not None, doc_id or 0, h))
    names = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    tops = {n: tree([h for *_, h in sorted(leaves[n])]) for n in names}
    root, above = tree([tops[n][0] for n in names])
    out = []
    for n, up in zip(names, above):
        for (known, doc_id, h), steps in zip(sorted(leaves[n]), tops[n][1]):
            out.append((doc_id if known else None, h, tops[n][0], root, steps + up))
    return out


def spark_manifest(df):
    got = merkle.manifest(df).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["folded"] == r["root"] for r in got)
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["at"], list(s["others"])) for s in r["proof"]]) for r in got]


@pytest.mark.parametrize("digits", (1, 2, 4))
def test_manifest_equals_brute_force(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)  # small blocks make several tiers
    rng = random.Random(digits)
    langs = {None: 1, "": 9, "en": 600, "de": 8, "é": 65, "z" * 40: 64, **{f"l{i}": 1 for i in range(12)}}
    rows = [(rng.randint(0, 400), rng.choice(("Text", "", None)), lang, rng.choice(("s", None)), rng.choice((None, 5))) for lang, n in langs.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    assert sorted(spark_manifest(df), key=repr) == sorted(slow_manifest(rows), key=repr)


def test_manifest_of_awkward_rows(spark, awkward, empty):
    want = slow_manifest([row[:5] for row in AWKWARD])
    assert sorted(spark_manifest(awkward), key=repr) == sorted(want, key=repr)
    assert merkle.manifest(empty).count() == 0
    one = awkward.where("doc_id = 2")
    ((_, leaf, subroot, root, proof),) = spark_manifest(one)
    assert leaf == subroot == root and proof == []


def test_tampering_shows(spark, awkward):
    changed = merkle.manifest(awkward, other=merkle.leaf_digest(text=F.concat(F.coalesce("text", F.lit("")), F.lit("!"))))
    assert changed.where(merkle.fold(F.col("other"), F.col("proof")) == F.col("root")).count() == 0
    query = merkle.op11_merkle(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), "doc_id").toPandas()
    third = query.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 0)
    upper = query.text.map(lambda t: t is not None and re.search("[A-Z]", t) is not None)
    assert (query.verified == ~(third & upper)).all() and 0 < (~query.verified).sum()


# 12


def slow_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow_resampling(docs, target):
    """Sorted (doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(slow_features(text)[1])
    for text in target:
        t.update(slow_features(text)[1])
    ours, theirs = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ours + 10_000) / ((s[b] + 1) * (theirs + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        n, found = slow_features(text)
        weight = sum(gain[b] for b in found)
        h = int(sha(f"42:{'' if doc_id is None else doc_id}")[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2]))
    for i, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resampling_equals_brute_force(spark, awkward):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É漢", "a" * 63, "b" * 64, "c" * 65, "d" * 300, "Mixed"]
    docs = [(i if i % 50 else None, rng.choice((" ", "\n", "-", "\0")).join(rng.choices(words, k=rng.choice((0, 1, 2, 3, 25, 200))))) for i in range(400)] + [(r[0], r[1]) for r in AWKWARD]
    target = [" ".join(rng.choices(words[:20], k=80)) for _ in range(30)] + [None, ""]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"rank": F.lit(1), "size": F.lit("x"), "weight": F.lit(None), "score": F.lit(2)})
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resampled(a.repartition(5), b).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == slow_resampling(docs, target)


def test_resampling_of_empty_tables(spark, awkward, empty):
    assert resample.resampled(empty, awkward).count() == 0
    rows = resample.resampled(awkward, empty).toPandas()
    assert len(rows) == len(AWKWARD) and rows["rank"].isna().all()  # 5 % of one document


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Zé漢\n\0-9"), max_size=60), max_size=8), st.integers(1, 40))
def test_features_at_every_cut(texts, chunk):
    how = resample.Resampling()
    got = defaultdict(list)
    for bucket, owner, n in resample.features([t.encode() for t in texts], how, chunk):
        for b, o in zip(bucket.tolist(), owner.tolist()):
            got[o].append(b)
    for i, text in enumerate(texts):
        assert sorted(got[i]) == sorted(slow_features(text)[1])


def test_long_text_goes_in_parts():
    text = ("some words and " * 400_000).encode()
    whole = np.concatenate([b for b, _, _ in resample.features([text], resample.Resampling(), 1 << 30)])
    cut = np.concatenate([b for b, _, _ in resample.features([text], resample.Resampling(), 1 << 16)])
    assert (np.bincount(whole, minlength=10_000) == np.bincount(cut, minlength=10_000)).all()


# 13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(byte_bpe.MODEL)
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.Vocabulary.load(byte_bpe.MODEL), memo=64)


def test_query_equals_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = byte_bpe.op13_byte_bpe(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


ODD = ["it's we'll I'd 'S", "a  b   c \t\n x\r\n", " <|endoftext|> a<|endoftext|><|endoftext|", "\x1c\x1d\x85\xa0 　x", "½²٣ 12ab", "\U0001f600‍ é 漢字 हिन्दी", "՘a \U00010940b1\U00011de0", "\0\x7f\xff", "x" * 127, "y" * 128, "z" * 129, "ab" * 3000, " " * 1000, "日本" * 200, "=" * 999 + "a"]


def test_odd_texts_equal_the_library(library, encoder):
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, text[:40]
        assert byte_bpe.decode(ids, encoder.v.raw) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(st.sampled_from("abtheino 'sS1\n\t.é"), max_size=300))
def test_any_text_equals_the_library(library, encoder, text):
    ids = encoder.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids and byte_bpe.decode(ids, encoder.v.raw) == text


def test_each_character_is_of_the_class_that_the_library_has(library, encoder):
    for low in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1!{chr(c)}!" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert encoder.cut(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(low)


def test_scan_and_heap_merge_alike(encoder):
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choices("aabtheing ", k=rng.randint(1, 120))).encode()
        assert encoder.merge(word) == encoder._merge_long(list(map(encoder.v.byte_ids.__getitem__, word)))


def test_awkward_rows_round_trip(spark, awkward, empty):
    v = byte_bpe.Vocabulary.load(byte_bpe.MODEL)
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(awkward.withColumn("ids", F.lit("x")), v, "doc_id"), v, "doc_id", "ids").toPandas()
    assert sorted(rows.text) == sorted(r[1] or "" for r in AWKWARD)
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(empty, v, "doc_id"), v).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [99_999])], "doc_id int, ids array<int>")
    assert {tuple(r) for r in byte_bpe.decode_documents(nulls, v, "doc_id").collect()} == {(1, None), (2, "")}


def test_vocabularies_with_other_steps_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary.load("/opt/tokenizers/word_bpe_49k.json")
