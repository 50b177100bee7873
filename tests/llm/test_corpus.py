"""Decontamination, packing, archives and the pipeline against plain versions."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tesselle import scratch
from tesselle.llm import decontaminate, packing, quality, queries, warc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return Counter(out)


def test_contamination_brute_force(spark, make, odd_rows, real):
    rows = [(r.doc_id + 100, r.text) for r in real.collect()] + odd_rows
    long = " ".join(f"t{i}" for i in range(25))
    items = [("7", long), ("70", long + " more"), ("8", "Short item"), ("9", ""), ("10", None), ("11", "!!!"), ("8", "Short item"), ("12", "a a a a a a a a a a a a"), (None, long), ("13", "ünïcödé")]
    rows += [(50, "x " + " ".join(f"T{i}" for i in range(3, 20)) + " y"), (51, "SHORT, item; short"), (52, "short item item"), (53, "a " * 9), (54, "a " * 11), (55, "ünïcödé"), (56, "Ünïcödé"), (57, " ".join(f"t{i}" for i in range(9)))]
    items += [(str(200 + r.doc_id), " ".join((r.text or "").split()[20:45])) for r in real.limit(5).collect()]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, n_words int")
    want = plain_contamination(rows, [(i, t) for i, t in items if i is not None])
    near = plain_proximity(rows, [(i, t) for i, t in items if i is not None])
    for size in (decontaminate.BLOCK_BYTES, 400):
        out = decontaminate.contamination(make(rows), bench, block_bytes=size).select("doc_id", "n_words", "n_hit", "n_items", F.array_join(F.array_sort("items"), ",").alias("i"), "contaminated", "n_near").collect()
        assert Counter(tuple(r)[:6] for r in out) == want
        assert Counter((r.doc_id, r.n_words, r.n_near) for r in out) == near
    held = {k[0] for k in want if k[-1]}
    kept = decontaminate.clean(make(rows).withColumn("_held", F.lit(1)), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, *_, bad in want.elements() if not bad) and "_held" in kept.columns
    assert held and decontaminate.contamination(make([]), bench).count() == 0
    assert decontaminate.contamination(make(rows), bench.limit(0)).filter("contaminated").count() == 0


def plain_proximity(docs, items, width=10, slop=2):
    texts = [(d, words(t)) for d, t in docs]
    often = Counter(t for _, w in texts for t in w)
    pairs = set()
    for _, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            place = {t: j for j, t in reversed(list(enumerate(w[i : i + width])))}
            rare = sorted(place, key=lambda t: (often[t], place[t]))[:2]
            if len(rare) == 2:
                pairs.add((*rare, abs(place[rare[0]] - place[rare[1]])))
    out = []
    for d, w in texts:
        at = defaultdict(list)
        for i, t in enumerate(w):
            at[t].append(i)
        out.append((d, len(w), sum(any(abs(x - y) <= apart + slop for y in at[b]) for a, b, apart in pairs for x in at[a])))
    return Counter(out)


def test_index_rows_are_read_a_few_at_a_time(spark, make):
    """Tasks that read wide rows get 16 at once, and nothing lazy is left that reads the index otherwise."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    rows = scratch.stash(spark.range(100).coalesce(1))
    assert [r.n for r in scratch.stash(rows.mapInArrow(sizes, "n bigint"), wide=True).collect()] == [16] * 6 + [4]
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
    out = decontaminate.contamination(make([(1, "a b c")]), spark.createDataFrame([("x", "b c")], "item_id string, text string"))
    assert "gaps" not in out._jdf.queryExecution().optimizedPlan().toString() and [(r.doc_id, r.n_hit) for r in out.collect()] == [(1, 2)]


def test_proximity_and_postings(spark, make):
    bench = spark.createDataFrame([("1", "alpha beta")], "item_id string, text string")
    docs = make([(1, "alpha x beta"), (2, "beta alpha"), (3, "alpha " + "x " * 30 + "beta"), (4, None)])
    assert {r.doc_id: r.n_near > 0 for r in decontaminate.contamination(docs, bench, slop=3).collect()} == {1: True, 2: True, 3: False, 4: False}
    got = {(r.term, r.doc_id): r.positions for r in decontaminate.postings(decontaminate.build_index(docs)).collect()}
    assert got["beta", 1] == [2] and got["alpha", 2] == [1] and got["beta", 3] == [31] and got["x", 3] == list(range(1, 31)) and len(got) == 8


def test_terms_are_told_apart_by_their_bytes(monkeypatch):
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    plain = decontaminate.numbered(data, starts, ends)[0]
    monkeypatch.setattr(decontaminate.tk, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    number, some = decontaminate.numbered(data, starts, ends)
    assert number.tolist() == [0, 1, 0, 2] and some.tolist() == [0, 1, 3] and plain[0] == plain[2] and len(set(plain.tolist())) == 3


# ---------------------------------------------------------------- packing


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(capacity - n)
    return sorted(free)


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_ranges_do_what_best_fit_does(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(40):
        lengths = np.sort(np.minimum(capacity, rng.integers(1, capacity + 1, rng.integers(0, 120))))
        count = Counter(lengths.tolist())
        plan = packing.best_fit_decreasing(dict(count), capacity)
        free, held = [capacity] * plan.bins, defaultdict(list)
        if len(lengths):
            rank = np.concatenate([np.arange(count[n]) for n in sorted(count)])
            for n, b, o in zip(lengths.tolist(), *(x.tolist() for x in plan.place(lengths.astype(np.int64), rank)), strict=True):
                free[b] -= n
                held[b].append((o, n))
        assert sorted(free) == plain_best_fit(lengths.tolist(), capacity)
        for parts in held.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n


def test_tokens_are_the_library_s(real, odd_rows):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary())
    ours = packing.encoder(packing.load_vocabulary(vocabulary()))
    for text in [r.text for r in real.collect()] + [t or "" for _, t in odd_rows] + ["\r\n \t x", "I'LL don't we've", "日本語 テスト 😀", "a<|endoftext|>b"]:
        assert ours(text) == theirs.encode(text, add_special_tokens=False).ids


def test_packing(make, odd_rows, real):
    rows = [(r.doc_id + 100, r.text) for r in real.collect()] + odd_rows
    ours = packing.encoder(packing.load_vocabulary(vocabulary()))
    want = Counter()
    for doc, text in rows:
        ids = ours(text or "") + [0]
        for k, (s, n) in enumerate(packing.cuts(len(ids), 2048)):
            assert n == 2048 or k == 0
            want[doc, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    out = packing.pack(make(rows), vocabulary()).collect()
    assert Counter(tuple(r)[:5] for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in out) // 2048) + 2
    assert packing.pack(make([]), vocabulary()).count() == 0


def test_sequences_hold_the_tokens(make):
    out = packing.pack(make([(1, "one two three"), (2, "four " * 50), (3, None)]), vocabulary(), 64, with_ids=True)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    for r in out.collect():
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == r.ids


# ---------------------------------------------------------------- archives


def records(n=40):
    out = []
    for i in range(n):
        payload = b"<p>hello</p>" * (i % 7) + os.urandom(i * 11)
        out.append(warc.make_record(i, f"http://h/{i} \r\nX: y", payload, warc.base32_sha1(payload), None))
    return out


def test_archives_round_trip_and_validate():
    recs = records()
    words = zstandard.train_dictionary(1500, recs * 4).as_bytes()
    for dictionary in (b"", words):
        data = warc.write_archive(recs, dictionary)
        assert list(warc.read_archive(data)) == recs
        with_skip = data + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
        assert list(warc.read_archive(with_skip)) == recs
        for bad in (data[:-3], data + b"junk"):
            with pytest.raises(warc.BadArchive):
                list(warc.read_archive(bad))
    packed = zstandard.ZstdCompressor().compress(words)
    frames = warc.write_archive(recs, words)[8 + len(words) :]
    assert list(warc.read_archive((warc.DICTIONARY_MAGIC).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + frames)) == recs
    big = warc.make_record(1, "u", b"z" * 2_000_000 + os.urandom(200_000), "A" * 32, None)
    assert list(warc.read_archive(warc.write_archive([big], words))) == [big]


def test_bad_records_are_errors():
    good = warc.make_record(5, "http://a", b"body", warc.base32_sha1(b"body"), None)
    assert warc.parse_record(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodi"), good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"Content-Length: 4", b"Content-Length: 5")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)


def test_pages(spark):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "u\nv", "é" * 3000), (7, "u", "x"), (7, "u", "x"), (None, "u", "same"), (8, "u", "long " * 300_000)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, first int").repartition(3)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        again = p is not None and p > first[h or ""]
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- SQL twins and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(name, spark, sf_dir, duck, same):
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def plain_representatives(rows):
    """The least id of each group, by comparing the shingle sets of all pairs."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in sets}
    for a, b in sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4):
        x, y = sorted((least[a], least[b]))
        least = {d: x if g == y else g for d, g in least.items()}
    return set(least.values())


def test_pipeline_stage_by_stage(spark, sf_dir, real):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "simhash_neardup", "benchmark_decontamination", "best_fit_packing"]
    rows = lambda df: Counter(map(tuple, df.collect()))
    # Quality: exactly the documents that the classifier accepts.
    good = stages["quality_classifier"](spark, real, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    accepted = {r.doc_id for r in quality.classify(real, labels).filter("predicted = 1").collect()}
    assert rows(good) == Counter({r: n for r, n in rows(real).items() if r[0] in accepted}) and good.columns == real.columns
    # Lines: every long line that stays stays once; other columns are unchanged.
    short = stages["line_dedup"](spark, good, sf_dir).cache()
    kept = [line.strip() for r in short.collect() for line in r.text.split("\n") if len(line.strip().encode()) >= 16]
    before = {line.strip() for r in good.collect() for line in r.text.split("\n") if len(line.strip().encode()) >= 16}
    assert len(kept) == len(set(kept)) and set(kept) <= before and len(before) - len(kept) <= 3
    assert short.columns == real.columns and all(r.n_chars == len(r.text) for r in short.collect())
    # Near-duplicates: the least document of each group; also before the line stage, which leaves hardly any.
    apart = stages["simhash_neardup"](spark, short, sf_dir).cache()
    assert {r.doc_id for r in apart.collect()} == plain_representatives(short.collect())
    copies = good.collect()
    assert {r.doc_id for r in stages["simhash_neardup"](spark, good, sf_dir).collect()} == plain_representatives(copies) and len(plain_representatives(copies)) < len(copies)
    # Decontamination, by the plain version.
    clean = stages["benchmark_decontamination"](spark, apart, sf_dir).cache()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = plain_contamination([(r.doc_id, r.text) for r in apart.collect()], items)
    assert {r.doc_id for r in clean.collect()} == {k[0] for k in found if not k[-1]}
    # Packing: all tokens of what is left, and run() gives the same pieces.
    packed = stages["best_fit_packing"](spark, clean, sf_dir)
    ours = packing.encoder(packing.load_vocabulary(vocabulary()))
    total = Counter()
    for r in packed.collect():
        total[r.doc_id] += r.length
    assert total == Counter({r.doc_id: len(ours(r.text)) + 1 for r in clean.collect()})
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed.collect()}


def test_stages_take_odd_tables(spark, sf_dir, make, odd_rows):
    import corpus_pipeline

    for rows in (odd_rows, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= len(rows), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(rows)
