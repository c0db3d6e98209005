"""Training-data operators against brute force, SQL, round trips, held-out labels and awkward rows."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import math
import random
import re
import time
import zlib
from urllib.parse import quote

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulseframe.llm import exact_dedup, licenses, mixing, nearest, pieces, quality, queries, secrets, simhash, toxicity, warc
from pulseframe.llm.common import materialise, table
from pulseframe.llm.components import connected_components

from ..conftest import DATA

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score int"
LONG = "long words and more of them " * 30_000
AWKWARD = [(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, " \n\t ", "en", "s", 3, None, 1), (None, "no id", "en", "s", 5, "x", None), (4, LONG, "en", "s", 1, "x", 1), (5, "same text here", "en", "s", 1, "x", 1), (5, "same text here", "en", "s", 1, "x", 1), (6, "same  text here", "de", "t", 1, "x", 1), (7, "é漢字😀 ▁ \\u0041", "fr", None, 1, "x", 1)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, same, name):
    same(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name]))


# 1


def test_shortage_goes_to_siblings_before_ancestors(spark):
    mix = mixing.Mix(budget=1.0, max_epochs=1, domain_weights={"a": 1.0, "b": 1.0}, lang_weights={}, source_weights={})
    supply = spark.createDataFrame([("a", "en", "x", 10), ("a", "de", "x", 500), ("b", "en", "y", 5), ("b", "en", "z", 485)], "domain string, lang string, source string, tokens bigint")
    wide = mixing.leaf_budgets(supply, mixing.Mix(**{**vars(mix), "budget": 0.4})).collect()  # 400 of 1,000: 200 a domain
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in wide}
    assert got == {("a", "en", "x"): 10, ("a", "de", "x"): 190, ("b", "en", "y"): 5, ("b", "en", "z"): 195}
    over = {(r["domain"], r["source"]): r["budget"] for r in mixing.leaf_budgets(supply, mixing.Mix(**{**vars(mix), "budget": 5.0})).collect() if r["lang"] == "en"}
    assert over[("b", "z")] == 485


def test_mix_takes_each_budget_exactly(spark, awkward, empty):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "en", f"s{i % 3}", 0, "", 0) for i in range(300)], DOCS)
    out = mixing.mix_sources(docs, mixing.Mix(budget=1.4)).toPandas()
    short = int(1.4 * sum(i % 7 for i in range(300))) - out.take_tokens.sum()
    assert 0 <= short <= 3  # a leaf's budget is rounded down
    assert (out.take_tokens <= out.n_tokens).all() and out.groupby(["doc_id", "epoch"]).size().max() == 1
    kept = mixing.keep_mixed(docs, mixing.Mix(budget=0.5, max_epochs=1))
    assert kept.columns == docs.columns and 0 < kept.count() < 300


def test_mix_of_awkward_rows(spark, awkward, empty):
    rows = mixing.mix_sources(awkward, mixing.Mix(budget=10.0, max_epochs=2)).toPandas()  # more than there is: all, twice
    tokens = {None: 2, 1: 0, 2: 0, 3: 0, 4: 180_000, 5: 3, 6: 3, 7: 3}
    want = sorted([(d is None, d or 0, e, tokens[d]) for d, *_ in AWKWARD for e in (0, 1) if (d, tokens[d]) != (1, 0)])
    assert sorted((d != d, 0 if d != d else int(d), e, n) for d, e, n in zip(rows.doc_id, rows.epoch, rows.n_tokens)) == want  # the leaf of row 1 has no tokens
    assert set(rows[rows.doc_id == 7].source) == {"unknown"} and (rows.take_tokens == rows.n_tokens).all()
    assert mixing.mix_sources(empty).count() == 0 and mixing.keep_mixed(empty, mixing.Mix()).count() == 0
    assert mixing.keep_mixed(awkward, mixing.Mix(budget=10.0, max_epochs=1)).count() == len(AWKWARD) - 1


def test_mix_of_repeated_rows_and_named_domains(spark):
    rows = [(1, "a b c", "en", "s", "x")] * 400 + [(None, "a b", "en", "s", "x")] * 100 + [(i, "a b c d", "en", "s", "y") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, area string").withColumn("domain", F.lit("ignored"))
    out = mixing.mix_sources(docs, mixing.Mix(budget=0.4)).toPandas()
    assert out.take_tokens.sum() == int(0.4 * (1200 + 200 + 232)) and set(out.domain) < {"web", "books", "code"}
    out = mixing.mix_sources(docs, mixing.Mix(budget=0.2, domain_column="area", domain_weights={"x": 1.0, "y": 0.0})).toPandas()
    assert set(out.domain) == {"x"} and out.take_tokens.sum() == int(0.2 * 1632) and (out.take_tokens < out.n_tokens).sum() <= 1
    kept = mixing.keep_mixed(docs.withColumn("row_key", F.lit(3)).withColumn("a.b", F.lit(4)), mixing.Mix(budget=0.9, max_epochs=1))
    assert kept.columns[-2:] == ["row_key", "a.b"] and set(kept.select("row_key", F.col("`a.b`")).distinct().collect()) == {(3, 4)}


def slow_fill(budget, children):
    """Raise the level until the budget is spent."""
    left, open_, share = budget, dict(children), {}
    while open_:
        level = left / sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c / w <= level}
        if not full:
            return share | {k: level * w for k, (_, w) in open_.items()}
        share |= full
        left -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    return share


def test_fill_equals_a_rising_level(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for parent in range(8):
        children = {f"{parent}-{i}": (rng.choice((1, 5, 5, 40, rng.randint(1, 10**6))), rng.choice((0.3, 1.0, 2.0))) for i in range(rng.randint(1, 60))}
        budget = rng.random() ** 2 * sum(c for c, _ in children.values())
        want |= slow_fill(budget, children)
        rows += [(parent, k, c, w, budget) for k, (c, w) in children.items()]
    got = mixing.fill(spark.createDataFrame(rows, "parent int, name string, capacity bigint, weight double, budget double"), ["parent"]).collect()
    assert len(got) == len(rows) and all(r["share"] == pytest.approx(want[r["name"]], rel=1e-9) for r in got)


# 2 and 5


def held_out(spark, name, label, data=DATA):
    rows = queries.QUERIES[name](spark, data).where("held_out").join(table(spark, data, "labels"), "doc_id").toPandas()
    r, y = rows.score.rank(), rows[label]
    return (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_learns(spark, awkward, empty):
    rng = random.Random(1)
    insults, groups, plain = ["dolt", "oaf"], ["tall", "short"], [f"w{i}" for i in range(40)]
    found, labels = [], []
    for i in range(1500):  # toxic only if an insult meets a group: no weight of one word tells
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(plain, 8) + a * [rng.choice(insults)] + b * [rng.choice(groups)]
        found.append(toxicity.terms(" ".join(words).encode()))
        labels.append(int(a and b))
    m = toxicity.fit(found, labels)
    right = [(m.score(f"w1 w2 w3 w4 w5 {x} {y}".encode()) > 0.5) == (x != "w8" and y != "w9") for x in ("dolt", "oaf", "w8") for y in ("tall", "short", "w9")]
    assert all(right)
    assert held_out(spark, "op2_toxicity", "toxic", "/root/testdata/sf0.1") > 0.8  # many of these labels are noise
    assert toxicity.score_toxicity(awkward, m, "doc_id").where("score between 0 and 1").count() == len(AWKWARD)
    assert toxicity.score_toxicity(empty, m, "doc_id").count() == 0
    assert toxicity.fit([], []).score(b"x") == pytest.approx(0.5, abs=1e-3)


def test_one_training_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(50)] + [(i, "other") for i in range(2, 12)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id bigint, toxic int")
    rows = toxicity.labelled(docs, labels, "toxic", 1, 1, 100).collect()
    assert len(rows) == 11 and sum(bytes(r["text"]).startswith(b"text") for r in rows) == 1
    assert len(toxicity.labelled(docs, labels, "toxic", 1, 1, 4).collect()) == 4


def test_pairs_equal_a_double_loop():
    rng = np.random.default_rng(4)
    words = [f"term{i}" for i in range(30)]
    buckets = np.unique(np.array([b for w in words for b in toxicity.terms(w.encode())], np.int32))
    m = toxicity.Machine(buckets, rng.normal(0, 1, len(buckets)), rng.normal(0, 1, (len(buckets), toxicity.FACTORS)), -0.3)
    at = {int(b): i for i, b in enumerate(buckets)}
    for text in ["", "nothing known here", "term1", *(" ".join(rng.choice(words, n)) for n in (2, 5, 40))]:
        low = set(text.lower().split())
        own = [w.encode() for w in low] + list({b"<%d" % n + w.encode()[:n] for n in toxicity.STEMS for w in low if len(w) > n})
        known = [at[b] for b in (zlib.crc32(w) & ((1 << 24) - 1) for w in own) if b in at]
        z = -0.3 + sum(m.weights[i] for i in known)
        for i in range(len(known)):
            for j in range(i + 1, len(known)):
                z += m.factors[known[i]] @ m.factors[known[j]] / len(known)
        assert m.score(text.encode()) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_toxic_query_equals_its_machine(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    m, texts = toxicity.train(docs, labels), {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.QUERIES["op2_toxicity"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["score"] == m.score((texts[r["doc_id"]] or "").encode()) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxic_rows_of_awkward_tables(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    extra = awkward.withColumn("terms", F.lit(1)).withColumn("y", F.lit("a")).withColumn("a.b", F.lit(2))
    kept = toxicity.drop_toxic(extra, labels)
    assert kept.columns == extra.columns and kept.count() <= len(AWKWARD)
    assert toxicity.drop_toxic(extra, labels.limit(0)).count() == 0  # without labels every score is 0.5
    assert toxicity.drop_toxic(empty, labels).count() == 0


def slow_features(raw):
    """Line by line and character by character."""
    lines, out = raw.split(b"\n"), []
    for x in lines:
        n = max(1, len(x))
        kind = lambda f: sum(f(chr(b)) for b in x)
        upper, digit, space = kind(lambda c: c < "\x80" and c.isupper()), kind(lambda c: c < "\x80" and c.isdigit()), kind(lambda c: c < "\x80" and c.isspace())
        lower = kind(lambda c: c >= "\x80" or c.islower())
        mark, bang, bar = kind(lambda c: c in ".,;:?'\"-()"), x.count(b"!"), x.count(b"|")
        rest = len(x) - upper - digit - space - lower - mark - bang - bar
        words = x.split()
        out.append([upper / n, digit / n, space / n, mark / n, bang / n, bar / n, rest / n, math.log1p(len(x)) / 6, len(x) / (space + 1) / 10, float(lines.count(x) > 1), float(len(x) < 20), float(upper > lower), float(rest / n > 0.1), float(bar / n > 0.01), 1 - len(set(words)) / len(words) if words else 0.0])
    none = [0.0] * quality.OWN
    return np.array([out[i] + (out[i - 1] if i else none) + (out[i + 1] if i + 1 < len(out) else none) + [1.0] for i in range(len(out))])


def slow_quality(field, raw):
    """The score by forward and backward sums over two states."""
    x, lines = slow_features(raw), raw.split(b"\n")
    e = x @ field.weights
    step = np.exp(np.array([[field.bad_stays, 0.0], [0.0, field.good_stays]]))
    own = np.stack([np.ones(len(e)), np.exp(e)], 1)
    ahead, behind = [own[0] / own[0].sum()], [np.ones(2)]
    for t in range(1, len(e)):
        f = own[t] * (ahead[-1] @ step)
        ahead.append(f / f.sum())
        b = step @ (own[len(e) - t] * behind[-1])
        behind.append(b / b.sum())
    p = np.array([(f * b / (f * b).sum())[1] for f, b in zip(ahead, reversed(behind))])
    size = np.array([max(1, len(x)) for x in lines])
    q = np.clip((p * size).sum() / size.sum(), 1e-3, 1 - 1e-3)
    return 1 / (1 + math.exp(-(field.slope * math.log(q / (1 - q)) + field.shift)))


def test_quality_equals_brute_force(spark, monkeypatch):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, DATA, "documents").collect()}
    field = quality.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    rows = queries.QUERIES["op5_quality"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["score"] == pytest.approx(slow_quality(field, docs[r["doc_id"]]), rel=1e-6) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    some = sorted(docs.values(), key=len)[-20:] + [b"", b"\n\n", b"word again again " * 50]
    whole = field.scores(some)
    monkeypatch.setattr(quality, "PART", 64)  # texts and lines in many parts
    assert field.scores(some) == pytest.approx(whole, rel=1e-9)


def test_long_texts_take_little_memory():
    import tracemalloc

    field = quality.Field(np.random.default_rng(0).normal(0, 1, quality.WIDTH), 0.5, 0.5)
    for raw in (b"word and word again " * 500_000, (b"a line of some words that is neither long nor short\n") * 60_000):
        tracemalloc.start()
        field.scores([raw])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 * len(raw), peak / len(raw)


def test_quality_learns(spark, awkward, empty):
    assert held_out(spark, "op5_quality", "quality") > 0.9
    field = quality.fit([b"a good line. and more of it\nanother line of words", b"BAD!! BAD!! BAD!!\nX%%% Y%%%"] * 20, [1, 0] * 20)
    good, bad = field.scores([b"some good line. with words", b"BAD!! WORDS!!\nZ%%%"])
    assert good > 0.5 > bad
    assert quality.score_quality(awkward, field, "doc_id").where("score between 0 and 1").count() == len(AWKWARD)
    assert quality.score_quality(empty, field, "doc_id").count() == 0
    assert quality.fit([], []).scores([b""]) == [0.5]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = quality.Field(rng.normal(0, 1, quality.WIDTH), 0.7, -0.4)
    x, counts = rng.normal(0, 1, (9, quality.WIDTH)), np.array([4, 1, 4])
    got = 1 / (1 + np.exp(-field.marginals(x @ field.weights, counts)[2]))
    e, at = x @ field.weights, 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] for i in range(n) if y[i]) + sum(field.good_stays if a and b else field.bad_stays if not (a or b) else 0 for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


# 3


def toy():
    rng = random.Random(1)
    parts = ["▁", "a", "b", "ab", "ba", "aab", "▁a", "▁ab", "bab", "abab", "c", "bc", "▁▁"]
    return pieces.Vocabulary.of([("<unk>", 0, "unknown")] + [(f"<0x{b:02X}>", 0, "byte") for b in range(256)] + [(p, -rng.random() * 5, "normal") for p in parts], False)


def best_segmentation(v, text):
    """Left to right over all pieces, without a window."""
    score, back = [0.0] + [-1e300] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        for n in range(1, v.longest + 1):
            if (f := v.ids.get(text[i : i + n])) and len(text) >= i + n and score[i] + f[1] > score[i + n]:
                score[i + n], back[i + n] = score[i] + f[1], (i, [f[0]])
        if text[i] not in v.ids and (s := score[i] + v.byte_score * len(text[i].encode())) > score[i + 1]:
            score[i + 1], back[i + 1] = s, (i, [v.byte_ids[b] for b in text[i].encode()])
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_streaming_search_equals_the_whole_search():
    v, rng = toy(), random.Random(3)
    encoder, stream = pieces.Encoder(v, 8), pieces.StreamingViterbi(v)
    for _ in range(400):
        text = "".join(rng.choice("aabbc  dé\n") for _ in range(rng.randint(0, 300)))
        want = best_segmentation(v, " " + text) if text else []
        assert encoder.encode(text) == want and pieces.decode(want, v.raw) == text
        out = stream.feed(" ")
        for i in range(0, len(text), 7):
            out += stream.feed(text[i : i + 7])
        if text:
            assert out + stream.close() == want
        else:
            stream.close()


def test_long_runs_commit_early():
    search = pieces.StreamingViterbi(toy())
    early = search.feed("abba" * 5000)
    assert early and len(search.text) < 400 and len(search.back) < 400


@pytest.mark.parametrize("ch", "aA=-_")
def test_runs_whose_paths_never_meet(ch):
    """A backpointer per character is all that grows, and tries to commit stay few."""
    v = pieces.Vocabulary.load(pieces.MODEL)
    search = pieces.StreamingViterbi(v)
    ids = search.feed(ch * 1_000_000)
    assert len(search.text) <= v.longest and len(search.score) <= v.longest + 1
    ids += search.close()
    assert "".join(v.raw[i].decode() for i in ids) == ch * 1_000_000
    assert ids[: len(ids) // 2] == (search.feed(ch * 600_000) + search.close())[: len(ids) // 2]
    assert search.feed(ch * 999) + search.close() == best_segmentation(v, ch * 999)


def test_registered_vocabulary_equals_the_whole_search(spark):
    v = pieces.Vocabulary.load(pieces.MODEL)
    encoder = pieces.Encoder(v)
    for r in table(spark, DATA, "documents").collect():
        assert encoder.encode(r["text"] or "") == (best_segmentation(v, " " + r["text"]) if r["text"] else []), r["doc_id"]


def test_round_trip(spark, awkward, empty):
    v = pieces.Vocabulary.load(pieces.MODEL)
    assert pieces.round_trip(table(spark, DATA, "documents"), v).where("not exact").count() == 0
    assert pieces.round_trip(awkward, v).where("exact").count() == len(AWKWARD)
    assert pieces.round_trip(empty, v).count() == 0
    back = pieces.decode_documents(pieces.encode_documents(awkward, v, "doc_id"), v, "doc_id").toPandas()
    assert sorted(back.text) == sorted((t or "") for _, t, *_ in AWKWARD)


# 4


def test_exact_dedup_of_awkward_rows(spark, awkward, empty):
    rows = exact_dedup.exact_dedup(awkward).toPandas()
    assert len(rows) == len(AWKWARD)
    blank = rows[rows.doc_id.isin([1, 2, 3])]
    assert set(blank.keep_id) == {3} and blank.kept.sum() == 1  # the longest of the empty ones
    copies = rows[rows.doc_id.isin([5, 6])]
    assert set(copies.keep_id) == {6} and copies.kept.sum() == 1 and set(copies.group_size) == {3}
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == rows.kept.sum()


def test_index_remembers_earlier_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    one = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    two = spark.createDataFrame([(3, "ab"), (4, "d"), (5, "d")], "doc_id bigint, text string")
    assert exact_dedup.exact_dedup(one, index).where("kept").count() == 2
    later = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(two, index).collect()}
    assert later == {3: (1, False), 4: (4, True), 5: (4, False)} and index.rows().count() == 3


# 6


def test_licenses(spark, awkward, empty):
    texts = ["Foo. Licensed under the Apache License, Version 2.0. cc by cc BY.", "ALL rights reserved", "the apache and the license", None, "General Public license ärights"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows] == [(13, 2, 9, 11, "cc-by"), (3, 1, 0, 0, "reserved"), (5, 0, None, None, ""), (0, 0, None, None, ""), (4, 1, 0, 0, "gpl")]
    assert rows[0]["labels"] == "apache-2.0,cc-by" and rows[2]["labels"] == "" and all(0 <= r["score"] <= 1 for r in rows)
    assert licenses.scan_licenses(awkward).count() == len(AWKWARD) and licenses.scan_licenses(empty).count() == 0


def test_licenses_of_a_file_with_many(spark):
    every = " and ".join(t for _, _, t in licenses.TEMPLATES)
    some = ". ".join(t[2] for t in licenses.TEMPLATES if t[0] in ("apache-2.0", "bsd", "mit"))
    rows = licenses.scan_licenses(spark.createDataFrame([(0, every), (1, some), (2, every * 3), *((i, licenses.TEMPLATES[0][2]) for i in range(3, 40))], "doc_id bigint, text string"))
    rows = {r["doc_id"]: r for r in rows.collect()}
    labels = ",".join(sorted({t[0] for t in licenses.TEMPLATES}))
    assert rows[0]["labels"] == rows[2]["labels"] == labels and rows[1]["labels"] == "apache-2.0,bsd,mit"
    assert rows[0]["score"] == 1


def test_whole_licence_texts(spark):
    whole = {t[0]: " ".join(t[2].split()) for t in licenses.TEMPLATES if len(t[2].split()) > 30}
    edited = {k: " ".join(w + (" indeed" if i in (20, 25) else "") for i, w in enumerate(v.split()) if i % 12 != 7) for k, v in whole.items() if k == "mit"}
    rows = licenses.scan_licenses(spark.createDataFrame([*whole.items(), *(("edited", v) for v in edited.values()), ("half", " ".join(whole["mit"].split()[:50]))], "doc_id string, text string")).collect()
    rows = {r["doc_id"]: r for r in rows}
    for label, text in whole.items():
        assert label in rows[label]["labels"].split(",") and rows[label]["score"] == 1, label
    assert "mit" in rows["edited"]["labels"] and rows["edited"]["score"] < 1 and rows["half"]["labels"] == ""


def slow_labels(own, idf):
    """Every template at every offset."""
    out = {}
    for (label, phrase, text), slack in zip(licenses.TEMPLATES, licenses.SLACK):
        t = text.split()
        rare = [(i, w) for i, w in enumerate(t) if w not in licenses.FUNCTION_WORDS]
        total = sum(idf[w] for _, w in rare)
        stands = [i for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        if not stands:
            continue
        for o in range(-len(t), len(own)):
            if not any(o - 1 - slack <= s <= o + len(t) + slack for s in stands):
                continue
            share = sum(idf[w] for i, w in rare if w in own[max(0, o + i - slack) : max(0, o + i + slack + 1)]) / total
            if share >= licenses.AGREE - 1e-9:
                out[label] = max(out.get(label, 0), share)
    return out


def test_licenses_equal_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    whole = {t[0]: t[2].split() for t in licenses.TEMPLATES}
    rng = random.Random(6)
    for i in range(40):  # pieces of licences with words left out, put in and moved
        parts = [w for _ in range(rng.randint(1, 3)) for w in rng.choice(list(whole.values()))]
        docs[10**6 + i] = " ".join(w for w in parts for w in ([] if rng.random() < 0.06 else [w, "more"] if rng.random() < 0.03 else [w]))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    own = {d: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in docs.items()}
    seen = {w: sum(w in set(o) for o in own.values()) for w in licenses.VOCABULARY}
    idf = {w: math.log(1 + (len(own) + 1) / (seen[w] + 1)) for w in licenses.VOCABULARY}
    labelled = 0
    for r in licenses.scan_licenses(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect():
        mine = own[r["doc_id"]]
        at = [i for p in licenses.BASE for i in range(len(mine)) if mine[i : i + len(p.split())] == p.split()]
        base = {v for p, v in licenses.BASE.items() if any(mine[i : i + len(p.split())] == p.split() for i in at)}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(mine), len(at), min(at, default=None), max(at, default=None))
        want = slow_labels(mine, idf)
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(base)), ",".join(sorted(base | set(want))))
        assert r["score"] == pytest.approx(max([0.0, *want.values(), *([licenses.BASE_SCORE] if at else [])]))
        labelled += bool(want)
    assert labelled > 40


# 7


def test_secret_layers():
    inner = "password=hunter2222"
    b64 = base64.b64encode(inner.encode()).decode()
    zipped = base64.b64encode(gzip.compress(inner.encode())).decode()
    twice = base64.b64encode(f"see {b64} end".encode()).decode()
    deep = base64.b64encode(gzip.compress(gzip.compress(inner.encode()))).decode()
    for text, layer in ((f"x {deep} y", "base64.zip.zip"), (f"x {b64} y", "base64"), (f"x {zipped} y", "base64.zip"), (f"x {twice} y", "base64.base64"), ("x password%3Dhunter2222 y", "url"), ("x \\u0070assword=hunter2222 y", "unicode")):
        base, more = secrets.scan(text)
        assert [k for k, *_ in more] == [f"assign@{layer}"], text
        assert all(2 <= s < e <= len(text) - 2 for _, s, e in more)
    assert secrets.scan(f"x {b64} y")[1] == [("assign@base64", 2, 2 + 4 * (len(inner) // 3) + 2)]
    assert secrets.scan("%41%41%41 %25%32%35 \\u005cu0041")[1] == []


def test_secret_layers_keep_the_text_around_tokens():
    for text, layer in (("x password: %68unter2222 y", "url"), ("x pass%77ord = hunter2222 y", "url"), ('x "password": "\\u0068unter2222" y', "unicode"), ("x pass%77ord = \\u0068unter2222 y", "url.unicode"), ("x %2570assword : hunter2222 y", "url.url")):
        start, end = text.index(" ") + 1, text.rindex(" ")
        quoted = text[start] == '"'
        assert secrets.scan(text)[1] == [(f"assign@{layer}", start + quoted, end - quoted)], text
    inner = base64.b64encode(b"pass%77ord = hunter2222").decode()
    assert [k for k, *_ in secrets.scan(f"%41 {inner} y")[1]] == ["assign@base64.url"]
    assert secrets.scan("%41 password = hunter2222")[1] == []


def test_blemishes_hide_no_secret():
    secret = b"password=hunter2222"
    wrapped = lambda data: f"x {base64.b64encode(data).decode()} y"
    for blemish in ("\u00a0", "\ufeff", "\u200b", "\0", "\x1b"):
        assert [k for k, *_ in secrets.scan(wrapped(blemish.encode() + secret))[1]] == ["assign@base64"], blemish
        assert [k for k, *_ in secrets.scan(wrapped(gzip.compress(blemish.encode() + secret)))[1]] == ["assign@base64.zip"], blemish
    for binary in (b"\xe9 ", bytes(range(128, 256)), b"caf\xe9 \xff\xfe"):
        assert [k for k, *_ in secrets.scan(wrapped(binary + b" " + secret))[1]] == ["assign@base64"]
        assert "assign@base64.zip" in [k for k, *_ in secrets.scan(wrapped(zlib.compress(binary + secret * 2)))[1]]
    data = b"\xe9\xc3\xa9" + secret
    assert secrets.scan(base64.b64encode(data).decode())[1] == [("assign@base64", 4, 30)]
    assert secrets.scan("q=%E9&password%3Dhunter2222")[1] == [("assign@url", 6, 27)]
    assert secrets.scan("%C3%A9%E9%F0%9F password%3Dhunter2222")[1] == [("assign@url", 16, 37)]


def test_all_compressed_bytes_are_unpacked():
    secret = b"password=hunter2222"
    members = gzip.compress(b"first") + gzip.compress(b"second") + b"\0\0" + gzip.compress(secret)
    assert [k for k, *_ in secrets.scan(base64.b64encode(members).decode())[1]] == ["assign@base64.zip"]
    mixed = gzip.compress(gzip.compress(b"inner")) + gzip.compress(b" " + secret)
    assert [k for k, *_ in secrets.scan(base64.b64encode(mixed).decode())[1]] == ["assign@base64.zip"]
    for data in (gzip.compress(secret), zlib.compress(secret), gzip.compress(secret)[:-8] + b"\0" * 8, gzip.compress(b"a") + gzip.compress(secret)):
        url, hexed = quote(data, safe=""), "".join(f"\\x{b:02x}" for b in data)
        whole = data[-8:] != b"\0" * 8  # the trailer of a broken one isn't taken
        for text, name in ((f"q {url} y", "url"), (f"q {hexed} y", "unicode")):
            found = [(s, e) for k, s, e in secrets.scan(text)[1] if k == f"assign@{name}.zip"]
            assert found == [(2, len(text) - 2)] if whole else len(found) == 1, text


def test_wrapped_base64_is_one_token():
    secret = b"some filler before it, and then: password=hunter2222 and more text after it to fill lines"
    for width, end in ((16, "\n"), (20, "\r\n"), (19, "\n    ")):
        code = base64.b64encode(secret).decode()
        text = "begin " + end.join(code[i : i + width] for i in range(0, len(code), width)) + " end"
        (kind, s, e), *others = secrets.scan(text)[1]
        assert kind == "assign@base64" and not others
        assert base64.b64decode(re.sub(r"\s", "", text[s:e])[-4 * (len(text[s:e]) // 8) :][:4])  # inside the token
        assert text.index(" ") < s < e < text.rindex(" ")
    assert [k for k, *_ in secrets.scan("averylongfirstword\n" + base64.encodebytes(secret).decode())[1]] == ["assign@base64"]


def test_bombs_are_scanned_in_windows():
    import resource

    bomb = gzip.compress(gzip.compress(b"\0" * (150 << 20) + b" password=hunter2222 " + b"\0" * (150 << 20)))
    code = base64.b64encode(bomb).decode().rstrip("=")
    text = f"x {code} y"
    assert len(text) < 3000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert secrets.scan(text)[1] == [("assign@base64.zip.zip", 2, len(text) - 2)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


def test_what_unpacks_to_too_much_is_reported(monkeypatch):
    monkeypatch.setattr(secrets, "BOMB", 1 << 20)
    text = "x " + base64.b64encode(gzip.compress(b"a b" * (1 << 20))).decode() + " password=hunter2222"
    base, more = secrets.scan(text)
    assert [k for k, *_ in base] == ["assign"] and [k for k, *_ in more] == ["bomb@base64.zip"]


def test_windows_cut_nothing(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 300)
    monkeypatch.setattr(secrets, "OVERLAP", 80)
    monkeypatch.setattr(secrets, "PIECE", 64)
    rng = random.Random(4)
    for n in range(60):
        filler = "".join(rng.choice("abcde fgh") for _ in range(rng.randint(0, 900)))
        inner = base64.b64encode(b"see password=hunter2222").decode() if n % 2 else "password=hunter2222"
        data = gzip.compress((filler + " " + inner + " " + filler[::-1]).encode())
        found = {k for k, *_ in secrets.scan(base64.b64encode(data).decode())[1]}
        assert found == {"assign@base64.zip" + ".base64" * (n % 2)}
    token = base64.b64encode(b"filler " * 200 + b"password=hunter2222" + b" filler" * 200).decode()
    assert {k for k, *_ in secrets.scan(base64.b64encode(gzip.compress(token.encode())).decode())[1]} == {"assign@base64.zip.base64"}


def test_long_runs_take_little_time():
    import time

    n = 1_000_000
    for text in ("a" * n + "%41", "%41" + "漢" * n, "\\u0041" + "b" * n, "%25" + "25" * (n // 2) + "41", "\\u005c" + "u005c" * (n // 5), "%41" * (n // 3), "QUJD" * (n // 4), ("QUJD" * 19 + "\n") * (n // 80), "password" + " " * n):
        start = time.process_time()
        secrets.scan(text)
        assert time.process_time() - start < 20, text[:20]


WRAPS = {"url": lambda b: quote(b, safe="").encode(), "unicode": lambda b: "".join(f"\\x{c:02x}" for c in b).encode(), "base64": base64.b64encode, "lines": lambda b: base64.encodebytes(b).strip(), "gzip": gzip.compress, "zlib": zlib.compress}


def slow_layers(data):
    """Every layer of bytes that some unwrapping gives, without spans, by plain recursion."""
    seen, todo = set(), [data]
    while todo:
        data = todo.pop()
        if data in seen:
            continue
        seen.add(data)
        todo.append(re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), data))
        todo.append(re.sub(rb"\\x([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), data))
        for m in re.finditer(rb"[A-Za-z0-9+/]{16,}(?:\n[A-Za-z0-9+/]+)*={0,2}", data):
            whole = m[0].replace(b"\n", b"").rstrip(b"=")
            for x in (whole, m[0].split(b"\n")[0].rstrip(b"=")):  # at every phase
                for y in (x[k:] for k in range(4)):
                    todo.append(base64.b64decode((y[:-1] if len(y) % 4 == 1 else y) + b"=" * (-len(y) % 4 if len(y) % 4 != 1 else 0)))
        for m in re.finditer(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]", data):
            try:
                todo.append(zlib.decompressobj(47).decompress(data[m.start() :]))
            except zlib.error:
                pass
    return seen


def test_base64_after_characters_of_its_own():
    for secret in ("password=hunter2222", "x password = hunter2222 y"):
        coded = base64.b64encode(secret.encode()).decode()
        for before in ("data/", "ab", "a", "abc", "-----\\n", "id_"):
            text = f"start {before}{coded} stop"
            _, more = secrets.scan(text)
            (span,) = {x for x in more if x[0] == "assign@base64"}
            assert 6 + len(before) <= span[1] < span[2] <= len(text) - 5, (before, span)


def test_magics_without_an_end_take_linear_time():
    begin = time.perf_counter()
    assert secrets.scan("%1f%8b%08" * 110_000 + " password=%68unter2222")[1]
    assert secrets.scan("%1f%8b%08%08" * 80_000 + " password=%68unter2222")[1]
    assert time.perf_counter() - begin < 60


def test_layers_equal_a_slow_search():
    rng = random.Random(8)
    pattern = re.compile(rb"password=[A-Za-z0-9]{6,}")
    for n in range(300):
        data = b" ".join(rng.choice((b"some words", b"100%", b"caf\xc3\xa9", b"a\\b", b"password=ab")) for _ in range(rng.randint(0, 4)))
        data += b" password=hunter%d " % rng.randint(1000, 9999) if n % 4 else b" password = ***** "
        chain = [rng.choice(list(WRAPS)) for _ in range(rng.randint(1, 4))]
        for name in chain:
            data = WRAPS[name](data)
        if chain[-1] in ("gzip", "zlib"):
            data = WRAPS[rng.choice(("url", "unicode", "base64", "lines"))](data)
        glued = rng.choice(("", "", "data/", "ab", "x+y", "\\\\n")) if chain[-1] == "base64" else ""
        text = "start " + glued + data.decode() + " stop"
        base, more = secrets.scan(text)
        slow = any(pattern.search(x) for x in slow_layers(text.encode()))
        assert slow == any(k.startswith("assign") for k, *_ in base + more), (chain, text)
        assert all(6 <= s < e <= len(text) - 5 for _, s, e in more)


def test_secrets_equal_brute_force(spark, awkward, empty):
    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for r in secrets.scan_secrets(table(spark, DATA, "documents")).collect():
        t = docs[r["doc_id"]]
        want = [("assign", *m.span()) for m in pattern.finditer(t) if len(m[2]) >= 6] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
    assert secrets.scan_secrets(awkward).count() == len(AWKWARD) and secrets.scan_secrets(empty).count() == 0


# 8


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    u = np.unique(np.array(fps, np.uint64))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    label = np.arange(len(u))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            return {int(f): int(c) for f, c in zip(u, label)}
        label = new


def crowded(n, seed=0):
    """Fingerprints around a few centres, so that cells fill up."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    for _ in range(4):
        c = rng.getrandbits(64)
        out += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n)]
    return out


@pytest.mark.parametrize("limit", [1024, 8])
def test_links_equal_all_pairs(spark, limit):
    fps = list(dict.fromkeys(crowded(60)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(spark.createDataFrame(signed, "fp bigint"), limit)).collect()}
    want = slow_components(fps)
    got = {f: roots.get(s, s) for f, (s,) in zip(fps, signed)}
    assert len(set(zip(want.values(), (got[f] for f in want)))) == len(set(want.values())) == len(set(got.values()))


def test_simhash_equals_brute_force(spark, awkward, empty):
    docs = table(spark, DATA, "documents").collect()
    rows = simhash.op8_simhash(spark, DATA).collect()
    fp = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs}
    label = slow_components(list(fp.values()))
    least = {}
    for d, f in fp.items():
        least[label[f]] = min(d, least.get(label[f], d))
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {d: (f, least[label[f]]) for d, f in fp.items()}
    assert simhash.near_duplicates(awkward).count() == len(AWKWARD) and simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 7), (True, 0)]


# 9


def recall(spark, data, **how):
    """Share of the true five nearest that are found; their order and scores are checked."""
    rows = table(spark, data, "embeddings").collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = {}
    for r in nearest.nearest(table(spark, data, "embeddings"), F.col("vec_id") % 50 == 0, **how).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 50 == 0}
    hits, at = 0, {int(d): i for i, d in enumerate(ids)}
    for q, got in found.items():
        s = v @ v[at[q]]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))][:5]
        hits += len(set(best) & {x for _, x, _ in got})
        got.sort()
        assert [x[0] for x in got] == [1, 2, 3, 4, 5] and all(a[2] >= b[2] for a, b in zip(got, got[1:]))
        assert all(x[2] == pytest.approx(s[at[x[1]]], abs=1e-12) for x in got)
    return hits / (5 * len(found))


def test_nearest_recall(spark):
    assert recall(spark, DATA) >= 0.99  # the shortlist of the registered query
    assert recall(spark, DATA, shortlist=64) >= 0.9
    assert recall(spark, "/root/testdata/sf0.1", cell=100) >= 0.95  # many cells


def test_probes_find_near_neighbours():
    rng = np.random.default_rng(2)
    unit = rng.normal(0, 1, (6000, 16)) + 3 * rng.normal(0, 1, (12, 16))[rng.integers(0, 12, 6000)]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    coarse = nearest.partition(unit[:3000], 24)
    assert 1 <= coarse.probes < 24
    own = coarse.closest(unit)[:, 0]
    near = unit[:300] @ unit.T
    near[np.arange(300), np.arange(300)] = -2
    near = np.argsort(-near, axis=1)[:, :5]
    looked = coarse.closest(unit[:300], coarse.probes)
    assert np.mean([own[n] in looked[i] for i in range(300) for n in near[i]]) >= 0.95


def test_nearest_of_many_lengths_and_sizes(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3 + i % 3)]) for i in range(300)]
    rows += [(1000, [3e200, 4e200, 0.0]), (1001, [3e-200, 4e-200, 0.0]), (1002, [5e-324, 0.0, 0.0])]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    cut = lambda v: [x * 2.0 ** (-600 if max(map(abs, v)) > 1e100 else 600 if max(map(abs, v)) < 1e-100 else 0) for x in v]
    vectors = {i: np.array(cut(v)) for i, v in rows}
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    for q, found in got.items():
        cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        want = sorted((-cos(vectors[q], w), i) for i, w in vectors.items() if i != q and len(w) == len(vectors[q]))[:5]
        assert [x[1] for x in sorted(found)] == [i for _, i in want]
    assert sorted(got[1000])[0][1:] == (1001, pytest.approx(1.0))


def test_one_id_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 2 * 50)
    rows = [(7, [math.cos(i / 500), math.sin(i / 500)]) for i in range(600)] + [(0, [1.0, 0.001])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    scores = sorted((-(math.cos(i / 500) + 0.001 * math.sin(i / 500)) / math.hypot(1, 0.001) for i in range(600)))[:5]
    assert [r["vec_id"] for r in got] == [7] * 5 and [-r["score"] for r in got] == pytest.approx(scores, abs=1e-12)


def test_nearest_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(100 + i, [2.0, 0.0, 0.0]) for i in range(30)] + [(8, [1.0, 0.1, 0.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    by = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert by[0] == [100, 101, 102, 103, 104] and by[100] == [0, 101, 102, 103, 104] and by[50][0] == 8
    assert nearest.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


# 10


def test_nearest_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0])] * 9 + [(i, [1.0, 0.0]) for i in range(1, 8)] + [(i, [0.0, float(i)]) for i in range(20, 30)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") == 0).distinct().orderBy("rank").collect()
    assert {r["vec_id"] for r in got} <= {1, 2, 3, 4, 5} and got[0]["vec_id"] == 1 and all(r["score"] == 1 for r in got)


def test_records_at_every_cut():
    pages = [(i, f"http://h/{i} x\r\n%é", ("<p>%d</p>" % i * (i % 40)).encode()) for i in range(120)]
    data = b"".join(warc.member(p, u, b, None, False) for p, u, b in pages)
    for step in (1, 37, 1000, 10_000_000):
        got = []
        for start in range(0, len(data), step):
            got += warc.split_records(io.BytesIO(data), len(data), start, min(len(data), start + step))
        assert [(r[1], r[7], r[8]) for r in got] == pages
    assert list(warc.split_records(io.BytesIO(b"\x1f\x8b\x08junk" * 50), 350, 0, 350)) == []
    assert zlib.decompressobj(31).decompress(data).startswith(b"WARC/1.1\r\n")


def standard_record(kind, ident, block, content="text/html", more=()):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    ids = [f"urn:uuid:0000000{i}-1111-2222-3333-444444444444" for i in range(4)]
    data = standard_record("warcinfo", ids[0], b"software: x", "application/warc-fields")
    data += standard_record("response", ids[1], http, "application/http; msgtype=response", ["warc-target-uri: http://a/b", "WARC-Block-Digest: sha1:" + hashlib.sha1(http).hexdigest()])
    data += standard_record("resource", ids[2], b"abc", more=["WARC-Payload-Digest: sha1:" + warc.sha1_base32(b"abc")])
    data += standard_record("revisit", ids[3], b"", more=[f"WARC-Refers-To: <{ids[1]}>", "WARC-Payload-Digest: sha1:" + warc.sha1_base32(b"<p>x</p>")])
    (tmp_path / "x.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), len(data))], "path string, bytes bigint")
    rows = {r["record_id"]: r for r in warc.read_warc(files, 100).collect()}
    assert sorted(rows) == ids and all(r["page_id"] is None for r in rows.values())
    assert bytes(rows[ids[1]]["payload"]) == b"<p>x</p>" and rows[ids[1]]["url"] == "http://a/b" and rows[ids[1]]["payload_digest"] == warc.sha1_base32(b"<p>x</p>")
    assert rows[ids[3]]["refers_to_id"] == ids[1] and rows[ids[3]]["payload_digest"] == warc.sha1_base32(b"<p>x</p>")


def test_changed_and_lost_records_are_errors(spark, tmp_path):
    good = warc.member(1, None, b"page one", None, False)
    text = zlib.decompress(good, 31)
    for bad in (text.replace(b"page one", b"page two"), text.replace(b"urn:page:1", b"urn:uuid:1").replace(b"page one", b"page 0ne")):
        with pytest.raises(ValueError, match="digest"):
            list(warc.split_records(io.BytesIO(gzip.compress(bad)), 10**6, 0, 10**6))
    files = warc.write_warc(spark.createDataFrame([(i, "u", "text %d" % i) for i in range(20)], "page_id bigint, url string, html string"))
    path, size, offsets = files.select("path", "bytes", "offsets").first()
    fs, place = warc.open_fs(path)
    data = bytearray(fs.open_input_file(place).read())
    data[offsets[0] + 12] ^= 255
    (tmp_path / "broken.warc.gz").write_bytes(data)
    broken = spark.createDataFrame([(str(tmp_path / "broken.warc.gz"), size, offsets)], "path string, bytes bigint, offsets array<bigint>")
    with pytest.raises(Exception, match="records from byte|digest"):
        warc.read_warc(broken).collect()


def test_warc_of_awkward_pages(spark):
    rows = [(1, None, "a"), (None, "u", "a"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (6, "u", "a"), (6, "u", "a"), (1, None, "a")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    got = warc.read_warc(warc.write_warc(pages, archive_bytes=1000), 64).toPandas()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id if r.page_id == r.page_id else -1, r.record_type, r.refers_to if r.refers_to == r.refers_to else -1) for r in got.itertuples())
    assert kinds == [(-1, "revisit", 1), (1, "response", -1), (1, "response", -1), (3, "response", -1), (4, "revisit", 3), (5, "response", -1), (6, "revisit", 1), (6, "revisit", 1)]
    assert got[got.page_id == 5].payload_bytes.item() == 600_000
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_members_of_several_records(spark, tmp_path):
    plain = lambda i, block: gzip.decompress(standard_record("resource", f"urn:x:{i}", block))
    data = gzip.compress(plain(0, b"abc") + plain(1, b"WARC/1.0\r\n\r\n") + plain(2, b"")) + gzip.compress(plain(3, b"z" * 100_000))
    archive = tmp_path / "x.warc.gz"
    archive.write_bytes(data)
    files = spark.createDataFrame([(str(archive), len(data))], "path string, bytes bigint")
    for split in (64, 1 << 20):
        rows = {r["record_id"]: (r["payload_bytes"], bytes(r["payload"])) for r in warc.read_warc(files, split).collect()}
        assert rows == {"urn:x:0": (3, b"abc"), "urn:x:1": (12, b"WARC/1.0\r\n\r\n"), "urn:x:2": (0, b""), "urn:x:3": (100_000, b"z" * 100_000)}
    for broken in (gzip.compress(plain(0, b"abc") + plain(1, b"defgh")[:-12]), plain(0, b"abc")):  # breaks off; isn't compressed
        archive.write_bytes(broken)
        with pytest.raises(Exception, match="breaks off|isn't compressed"):
            warc.read_warc(spark.createDataFrame([(str(archive), len(broken))], "path string, bytes bigint")).collect()


# Helpers


def test_components_of_a_path(spark):
    n = 200
    order = list(range(n))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_materialise_keeps_schema_of_nothing(spark):
    df = spark.range(0).select(F.col("id"), F.lit("x").alias("s"))
    assert materialise(df, "none").count() == 0 and json.loads(materialise(df, "none").schema.json())["fields"][1]["name"] == "s"


@pytest.mark.parametrize("kind", ("tight", "offset", "near copies"))
def test_nearest_where_codes_cannot_tell(spark, kind):
    """Tight clusters, a common offset and near copies of one vector: all share their codes, and none of the five nearest may be missed."""
    rng = np.random.default_rng(4)
    n, d = 3000, 16
    x = {"tight": rng.normal(size=(3, d))[rng.integers(0, 3, n)] + 0.01 * rng.normal(size=(n, d)), "offset": rng.normal(size=(n, d)) + 30,
         "near copies": np.r_[rng.normal(size=(1000, d)), rng.normal(size=(1, d)) + 1e-3 * rng.normal(size=(n - 1000, d))]}[kind]
    x = rng.permutation(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest.nearest(rows, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, n, 50):
        near = unit @ unit[q]
        near[q] = -2
        assert set(got[q]) == set(np.argsort(-near, kind="stable")[:5].tolist()), q
