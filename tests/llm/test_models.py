"""Classifiers: held-out accuracy, defined results for odd rows, exact probabilities."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselle.llm import language, quality, textkit, toxicity
from tesselle.llm.labelled import held_out, one_label


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def larger(spark):
    from tests.conftest import DATA

    return spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")


def test_held_out_rows(spark):
    rows = spark.range(300).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == is_held_out(r.id) for r in rows)
    assert spark.sql("select cast(null as bigint) doc_id").select(held_out()).first()[0] is False


def test_one_label_an_id(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None), (4, 5)], "doc_id long, quality int")
    assert {(r.doc_id, r.y) for r in one_label(df, "quality").collect()} == {(1, 1), (2, 0)}


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_held_out_accuracy(larger, which):
    docs, labels = larger
    out = (quality.classify(docs, labels) if which == "quality" else toxicity.score(docs, labels)).filter("held_out").join(labels, "doc_id").select("predicted", which).collect()
    right = np.mean([r.predicted == r[which] for r in out])
    caught = np.mean([r.predicted for r in out if r[which] == 1])
    assert len(out) > 300 and right > 0.97 and caught > 0.8


def test_language_accuracy(larger):
    out = language.identify(larger[0]).filter("held_out").join(larger[0].select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("score", [quality.classify, toxicity.score])
def test_odd_rows_are_scored(make, odd_rows, labels, real, spark, score):
    known = [(r.doc_id + 1000, r.text) for r in real.collect()]
    moved = labels.withColumn("doc_id", F.col("doc_id") + 1000)
    out = score(make(known + odd_rows), moved).collect()
    odd = [r for r in out if r.doc_id is None or r.doc_id < 1000]
    assert len(out) == len(known) + len(odd_rows) and len(odd) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if score is quality.classify else 0.7)) for r in out)
    assert len({r.score for r in odd if r.doc_id in (1, 2)}) == 1 and len({r.score for r in odd if r.doc_id == 6 or r.doc_id is None}) == 1
    assert all(r.held_out == is_held_out(r.doc_id) for r in odd if r.doc_id is not None)


@pytest.mark.parametrize("score", [quality.classify, toxicity.score])
def test_without_documents_or_labels(make, labels, score):
    assert score(make([]), labels).count() == 0
    assert [r.score for r in score(make([(1, "a text")]), labels.limit(0)).collect()] in ([0.5], [0.0])


def test_learning_ignores_held_out_labels(real, labels):
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.classify(real, x).collect()) for x in (labels, flipped))
    assert a == b


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (300, 3))]
    count = np.array([400.0, 300.0])
    model = quality.QuadraticDiscriminant.from_moments(count, np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), 0.0)
    at = rng.normal(0, 2, (20, 3))
    dens = []
    for k in (0, 1):
        cov = np.cov(x[k].T, bias=True)
        w = 3 / (count[k] + 3)
        cov = (1 - w) * cov + w * (0.5 * np.diag(np.diag(cov)) + 0.5 * np.eye(3) * np.trace(cov) / 3) + 1e-6 * np.eye(3)
        d = at - x[k].mean(0)
        dens.append(np.log(count[k] / 700) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    assert np.allclose(model.score(at), 1 / (1 + np.exp(dens[0] - dens[1])))


def plain_statistics(text):
    """The thirteen statistics, word by word."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    stops, letters = b".,;:'-", [*range(65, 91), *range(97, 123), *range(128, 256)]
    symbol = [b for b in range(33, 127) if not chr(b).isalnum() and b not in stops]
    share = lambda kind: np.log((sum(b in kind for b in raw) + 0.6) / (len(raw) + 150))
    rate = lambda n: np.log((n + 0.1) / (len(words) + 25))
    return [
        np.log1p(len(words)), np.log1p(sum(map(len, words)) / max(1, len(words))), share(range(65, 91)), share(range(48, 58)), share(stops), share(symbol), share(range(128, 256)),
        rate(len(lines)), rate(len(words) - len(set(words))), rate(sum(a == b for a, b in zip(words, words[1:], strict=False))), np.log((len(lines) - len(set(lines)) + 0.05) / (len(lines) + 5)),
        rate(sum(w[-1] in symbol for w in words)), rate(sum(len(w) == 1 and w[0] not in letters for w in words)),
    ]


def test_statistics_are_the_plain_ones(make, odd_rows, real):
    rows = [(r.doc_id + 100, r.text) for r in real.limit(60).collect()] + [(i, t) for i, (_, t) in enumerate(odd_rows)]
    got = {r.doc_id: r.x for r in quality.features(make(rows)).collect()}
    assert all(np.allclose(got[d], plain_statistics(t)) for d, t in rows) and len(got) == len(rows)


def test_toxicity_is_what_the_windows_save(spark):
    """Scores by cutting every text into windows of word codes, one compression at a time."""
    import re

    from tests.conftest import DATA

    real, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = one_label(labels, "toxic").filter(~held_out()).select("doc_id", F.col("y").alias("group"))
    from tesselle.llm.labelled import group_sizes, sample

    model = toxicity.Model.learn(sample(real, known, group_sizes(known), toxicity.SAMPLE_TEXTS, toxicity.SAMPLE_BYTES))
    plain, both = (toxicity._compressor(d) for d in (model.ordinary, model.ordinary + model.toxic))
    got = {r.doc_id: r for r in toxicity.score(real, labels).collect()}
    for r in real.filter("text is null or length(text) < 4000").limit(400).collect():
        words = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (r.text or "").encode()))
        codes = [toxicity._codes(w.decode())[0] for w in words]
        saved = []
        for i in range(0, len(codes), toxicity.WINDOW):
            window = toxicity.LEAD + b"".join(codes[i : i + toxicity.WINDOW])
            saved.append(max(0, len(plain.compress(window)) - len(both.compress(window))))
        x = [1, min(sum(saved), 24) / 8, min(max(saved, default=0), 8) / 4, np.log1p(len(saved)) / 4]
        p = 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))
        assert abs(got[r.doc_id].score - p) < 1e-9 and got[r.doc_id].predicted == int(p >= 0.7)


def test_column_form_agrees(real, labels):
    feats = quality.features(real)
    model = quality.fit(feats, labels)
    a = {r.doc_id for r in quality.score(feats, model).filter("predicted = 1").collect()}
    assert a == {r.doc_id for r in real.filter(quality.accepted(model)).select("doc_id").collect()}


# ---------------------------------------------------------------- PPM


def test_probabilities_sum_to_one():
    trees = language.ContextTrees.learn({"a": [b"abracadabra " * 60], "b": [b"mississippi river " * 50, b"xyz"]})
    share = np.ones(trees.bits.shape[1])
    share[-1] = 256 - (len(share) - 1)
    assert np.allclose((np.exp2(-trees.bits.astype(float)) * share[None, :, None]).sum(1), 1, atol=1e-5)


def test_code_length_of_a_plain_ppm():
    """Order-0 and order-1 probabilities by hand, with exclusion and method C escapes."""
    sample = b"aab" * 40
    trees = language.ContextTrees.learn({"a": [sample]})
    seen = b" " * 3 + sample
    follow = {}
    for x, y in zip(seen, seen[1:], strict=False):
        follow.setdefault(x, []).append(y)
    # Contexts of two or more bytes are held where they are frequent, and "aa", "ab", "ba" are:
    # after "ba" comes "a" each time, so its code is the share left by one escape.
    after = [seen[i + 3] for i in range(len(seen) - 3) if seen[i : i + 3] == b"aba"]
    n, d = len(after), len(set(after))
    data = np.frombuffer(b"abaa", np.uint8)
    whole = trees.lengths(data, np.array([0, 4]))[0, 0] - trees.lengths(data[:3], np.array([0, 3]))[0, 0]
    assert np.isclose(whole, -np.log2(after.count(ord("a")) / n * n / (n + d)), atol=1e-4)


def test_no_letters_is_unknown(make):
    rows = [(i, "the cat sat on the mat and looked at the dog " * 3, "en") for i in range(20)] + [(50 + i, "der hund und die katze sind nicht im haus gewesen " * 3, "de") for i in range(20)]
    odd = [(100, None, None), (101, "", None), (102, "123 ... 456", None), (105, "½ ² ① Ⅷ", None), (103, "日本語", None), (104, "der hund", None), (104, "der hund", None), (None, "the cat", None)]
    out = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(make(rows + odd)).filter("doc_id >= 100 or doc_id is null").collect()]
    got = {d: p for d, p, _ in out}
    assert len(out) == 8 and got[100] == got[101] == got[102] == got[105] == "und" and got[103] != "und" and got[104] == "de" and got[None] == "en"
    assert all(s == 0 for d, p, s in out if p == "und")
    assert [r.lang_pred for r in language.identify(make([(1, "text", None)])).collect()] == ["und"] and language.identify(make([])).count() == 0


def test_languages_are_learned_each_for_itself(make, monkeypatch):
    rng = np.random.default_rng(4)
    stock = ["".join(rng.choice(list("abcdefghij")[k : k + 5], 4)) for k in range(6) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(stock[30 * k : 30 * k + 30], 60)), f"l{k}") for k in range(6) for i in range(k * 100, k * 100 + 30)]
    score = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.identify(make(rows)).collect())
    together = score()
    monkeypatch.setattr(language, "TOGETHER", 2)
    assert score() == together and len({p for _, p, _ in together}) == 6


def test_scores_are_those_of_the_whole_text():
    """Texts of one step don't leak into each other."""
    trees = language.ContextTrees.learn({"a": [b"one two three " * 40], "b": [b"uno dos tres " * 40]})
    texts = [b"one", b"", b"tres dos uno " * 30, b"two three"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    alone = [trees.lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(trees.lengths(data, offsets), alone)


# ---------------------------------------------------------------- shared text handling


def test_spans_and_hashes():
    texts = ["", " a  bc\n", "dé", "x", "  ", "bc"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, first = textkit.spans(data, offsets, textkit.SPACES)
    assert [[data[a:b].tobytes() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)] == [t.split() for t in raw]
    h = textkit.span_hashes(data, starts, ends)
    assert h[1] == h[-1] and len(set(h.tolist())) == len(h) - 1
    assert textkit.distinct_per_row(h, textkit.row_of(first), 6).tolist() == [0, 2, 1, 1, 0, 1]
