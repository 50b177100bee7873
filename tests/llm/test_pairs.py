"""Near-duplicates, lines and passages against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tesselle.llm import lines, simhash, substrings, textkit
from tesselle.llm.cells import component_roots

LAST = 2**63 - 1


def components(near):
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1, initial=len(near))
        new = np.minimum(new, label)
        if (new == label).all():
            return label
        label = new


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text, width=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    got = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in got) for b in range(64)]
    return sum(1 << b for b in range(64) if count[b] * 2 > len(got))


@pytest.mark.parametrize("radius", [0, 3, 4, 8])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    v = rng.integers(0, 2**64, 300, dtype=np.uint64)
    v[50:200] = v[5]
    for i in range(50, 200):
        for b in rng.integers(0, 64, rng.integers(0, 10)):
            v[i] ^= np.uint64(1) << np.uint64(b)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    got = np.zeros((70, 300), bool)
    got[simhash.near(v[:70], v, radius)] = True
    assert (got == near[:70]).all()
    x = v[1:] ^ v[:-1]
    assert set(simhash.near_differences(x, radius)) == set(np.flatnonzero(np.bitwise_count(x) <= radius))
    assert (simhash.cell_links(v, radius) == components(near)).all()


def test_tables_lose_no_pair():
    rng = random.Random(1)
    for radius in (4, 8):
        masks = [m for _, m in simhash.block_tables(radius)]
        for _ in range(500):
            flip = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flip & m for m in masks)


def test_near_duplicates_brute_force(spark, make, odd_rows, real):
    rows = [(r.doc_id + 100, r.text) for r in real.collect()] + odd_rows
    got = Counter(map(tuple, simhash.near_duplicates(make(rows)).collect()))
    known = [(i, plain_fingerprint(t)) for i, t in rows]
    values = sorted({f for _, f in known})
    v = np.array(values, np.uint64)
    label = dict(zip(values, components(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4).tolist(), strict=True))
    least = {}
    for i, f in known:
        if i is not None:
            least[label[f]] = min(least.get(label[f], LAST), i)
    assert got == Counter((i, f"{f:016x}", least.get(label[f])) for i, f in known)
    assert simhash.near_duplicates(make([])).count() == 0


def test_split_cells_give_the_same(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, node long")
    from tesselle.operators.components import connected_components

    for limit in (8192, 20):
        assert {r.component for r in connected_components(simhash.links(df, 4, limit)).collect()} == {0}


def test_groups_need_similar_sets(make):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:150], "changed", *words[151:]]
    rows = [(3, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (4, "quite another text of no more than nine words"), (5, None), (6, "")]
    got = {r.doc_id: r.group_id for r in simhash.duplicate_groups(make(rows)).collect()}
    assert got == {3: 2, 2: 2, 9: 2, 4: 4, 5: 5, 6: 5}


def plain_groups(rows, width=5):
    """Least id of every document's component over all pairs with Jaccard 0.8 or more."""
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (t.split() for _, t in rows)]
    near = np.array([[len(a & b) * 5 >= len(a | b) * 4 for b in sets] for a in sets])
    label = components(near)
    least = {c: min(rows[i][0] for i in np.flatnonzero(label == c)) for c in set(label.tolist())}
    return {rows[i][0]: least[label[i]] for i in range(len(rows))}, near


def replaced(rng, words, times):
    words = list(words)
    for at in rng.sample(range(len(words)), times):
        words[at] = f"n{rng.randrange(10**9)}"
    return words


def test_groups_of_star_and_chain_shape(make):
    rng = random.Random(11)
    base = [f"s{i}" for i in range(300)]
    star = [(1000, " ".join(base))] + [(i, " ".join(replaced(rng, base, 6))) for i in range(50)]
    chain, words = [], [f"c{i}" for i in range(300)]
    ids = rng.sample(range(2000, 2030), 30)
    for i in ids:
        chain.append((i, " ".join(words)))
        words = replaced(rng, words, 6)
    rows = star + chain
    want, near = plain_groups(rows)
    assert near[0, :51].all() and near[1:51, 1:51].mean() < 0.2 and len(set(want.values())) == 2
    assert {r.doc_id: r.group_id for r in simhash.duplicate_groups(make(rows)).collect()} == want


def test_lone_pairs_of_every_similarity(make):
    rng = random.Random(12)
    rows = []
    for k in range(80):
        words = [f"p{k}x{i}" for i in range(400)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(replaced(rng, words, 1 + k % 10)))]
    want, _ = plain_groups(rows)
    assert 40 < sum(want[i] != i for i in want) < 80
    assert {r.doc_id: r.group_id for r in simhash.duplicate_groups(make(rows)).collect()} == want


def test_a_prefix_meets_every_similar_set():
    rng = np.random.default_rng(5)
    common, count = np.arange(0, 300, 3, dtype=np.uint64), rng.integers(2, 9, 100)
    for _ in range(300):
        a = np.unique(rng.integers(0, 300, rng.integers(1, 120))).astype(np.uint64)
        b = np.unique(np.where(rng.random(len(a)) < 0.1, rng.integers(0, 300, len(a)), a)).astype(np.uint64)
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.prefix(a, 0.8, common, count), simhash.prefix(b, 0.8, common, count)))


def test_parities_never_part_similar_sets():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400))).astype(np.uint64)
        b = np.union1d(rng.permutation(a)[: int(len(a) * rng.uniform(0.78, 1))], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert simhash.close_roots(np.array([len(a), len(b)]), [simhash.parities(a), simhash.parities(b)], 0.8).tolist() == [0, 0]


def test_forest_over_any_links():
    rng = np.random.default_rng(3)
    near = rng.random((90, 90)) < 0.012
    near |= near.T | np.eye(90, dtype=bool)
    assert (component_roots(90, lambda q, o: np.nonzero(near[np.ix_(q, o)]), 7) == components(near)).all()


# ---------------------------------------------------------------- lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, times):
    s = list(s)
    for _ in range(times):
        at, kind = rng.randrange(len(s) + 1), rng.random()
        if kind < 0.33:
            s.insert(at, rng.choice(b"abc "))
        elif s and kind < 0.66:
            s.pop(min(at, len(s) - 1))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice(b"abc ")
    return bytes(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    a = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 70))) for _ in range(700)]
    b = [edited(rng, x, rng.randint(0, 5)) for x in a]
    assert lines.within_edits(a, b, edits).tolist() == [edit_distance(x, y) <= edits for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_keys_lose_no_pair(edits):
    rng = random.Random(edits)
    for _ in range(400):
        a = bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(10, 50)))
        b = edited(rng, a, rng.randint(0, edits))
        if edit_distance(a, b) > edits or min(len(a), len(b)) <= edits:
            continue
        data = np.frombuffer(a + b, np.uint8)
        keys, valid = lines.line_keys(data, np.array([0, len(a)]), np.array([len(a), len(b)]), edits)
        short, other = (0, 1) if len(a) <= len(b) else (1, 0)
        assert set(keys[short, : edits + 1].tolist()) & set(keys[other][valid[other]].tolist())


def plain_lines(rows):
    """Kept texts and counts by comparing all lines."""
    rows = list(dict.fromkeys(rows))
    found = []
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            content = line.encode().strip(b" \t\n\x0b\x0c\r")
            if len(content) >= lines.LEAST_BYTES:
                found.append((LAST if doc is None else doc, xxhash.xxh64_intdigest(str(text).encode()), i, content, (doc, text)))
    distinct = sorted({f[3] for f in found})
    near = np.eye(len(distinct), dtype=bool)
    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if min(len(a), len(b)) >= lines.NEAR_BYTES and abs(len(a) - len(b)) <= 2 and (Counter(a) - Counter(b)).total() <= 2:
                near[i, j] = near[j, i] = edit_distance(a, b) <= 2
    label = dict(zip(distinct, components(near).tolist(), strict=True))
    classes = defaultdict(list)
    for f in found:
        classes[label[f[3]]].append(f)
    return rows, classes


def test_line_dedup_brute_force(make):
    rng = random.Random(7)
    base = [bytes(rng.choice(b"abcdefg ") for _ in range(rng.randint(10, 90))).decode() for _ in range(14)]
    rows = []
    for doc in range(60):
        own = [edited(rng, rng.choice(base).encode(), rng.choice([0, 0, 1, 2, 3])).decode() for _ in range(rng.randint(0, 5))]
        rows.append((doc, "\n".join(own)))
    rows += [(200, None), (201, ""), (202, "\n\n   \n"), (203, "x" * 9000 + "\n" + "x" * 9001), (None, base[0] + "\nshort"), (204, "  " + base[1] + "  \n" + base[1])]
    got = {r.doc_id: tuple(r)[1:] for r in lines.deduplicate(make(rows)).collect()}
    rows, classes = plain_lines(rows)
    gone, near, links = defaultdict(set), Counter(), Counter()
    for members in classes.values():
        members.sort(key=lambda f: f[0:1] + f[2:3])
        for f in members:
            links[f[4][0]] += len(members) - 1
        for f in members[1:]:
            gone[f[4][0]].add(f[2])
            near[f[4][0]] += f[3] != members[0][3]
    for doc, text in rows:
        parts = text.split("\n") if text else []
        kept = "\n".join(x for i, x in enumerate(parts) if i not in gone[doc])
        assert got[doc] == (len(parts), len(gone[doc]), near[doc], links[doc], kept), doc


def test_short_lines_and_edits_in_characters(make):
    """Equal lines of any length go; near ones count characters, not bytes."""
    rows = [(1, "Read more\n目次\nCopyright 2019 Example Inc.\n这是一个关于机器学习的很长的句子\nэто строка текста для проверки"), (2, "Read more\n目次\nCopyright 2020 Example Inc.\n这是一个关于机械学习的很长的句子\nэто строка текстов для проверки"), (3, "Readmore\n目录")]
    got = {r.doc_id: (r.n_removed, r.n_near, r.kept) for r in lines.deduplicate(make(rows)).collect()}
    assert got == {1: (0, 0, rows[0][1]), 2: (5, 3, ""), 3: (0, 0, rows[2][1])}


def test_repeated_rows_and_empty_table(make, odd_rows):
    out = lines.deduplicate(make(odd_rows), carry=True).collect()
    assert len(out) == len(odd_rows)
    assert [r.kept for r in out if r.doc_id == 5] == ["The quick brown fox jumps over the lazy dog while seven other animals watch it closely."] * 2
    assert all(r.row.cut == "c" for r in out) and [r.kept for r in out if r.doc_id == 6] == [""]
    assert lines.deduplicate(make([])).count() == 0


def test_a_tight_and_a_loose_cell(make, monkeypatch):
    """Over 32 lines of one cell, near each other or not; cells split into parts."""
    monkeypatch.setattr(lines, "CELL_ROWS", 16)
    head = "all of these lines begin with exactly the same forty or more characters "
    tight = [(i, f"{head}{i % 10}{i // 10 % 10}") for i in range(60)]
    loose = [(100 + i, "other " + head + " ".join(random.Random(i).choices(["red", "green", "blue", "black"], k=12))) for i in range(60)]
    out = {r.doc_id: r.n_removed for r in lines.deduplicate(make(tight + loose)).collect()}
    assert sum(out[i] for i in range(60)) == 59 and out[0] == 0
    assert sum(out[100 + i] for i in range(60)) == 0


# ---------------------------------------------------------------- passages


def plain_passages(rows, window):
    least, out = {}, []
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            key = b" ".join(w[i : i + window])
            least[key] = min(least.get(key, LAST), LAST if doc is None else doc)
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[b" ".join(w[i : i + window])] < (LAST if doc is None else doc):
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("group_runs, group_suffixes", [(20_000, 4000), (2, 30), (0, 1)])
def test_passages_brute_force(make, odd_rows, real, group_runs, group_suffixes):
    rows = [(r.doc_id + 100, r.text) for r in real.limit(120).collect()] + odd_rows
    rows += [(20, "go round " * 300), (21, "x go round " + "go round " * 200 + "y"), (22, "w " * 500), (23, "w " * 49), (24, "w " * 50)]
    rows += [(30 + k, " ".join(f"x{i}" for i in range(45)) + f" {t} y z") for k, t in enumerate(alike())]
    assert Counter(map(tuple, substrings.deduplicate(make(rows), group_runs=group_runs, group_suffixes=group_suffixes).collect())) == plain_passages(rows, 50)


def test_short_windows_and_empty_table(make):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 40)))) for i in range(40)]
    assert Counter(map(tuple, substrings.deduplicate(make(rows), window=6, lead=3).collect())) == plain_passages(rows, 6)
    assert substrings.deduplicate(make([])).count() == 0


def test_maximal_repeats_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        texts = [rng.choices("ab", k=rng.randint(1, 40)) for _ in range(3)]
        tree, begin = substrings.tree_of([" ".join(t).encode() for t in texts])
        where = {}
        for t, at in zip(texts, begin.tolist(), strict=True):
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    where.setdefault(tuple(t[i:j]), []).append((at + i, t[i - 1] if i else (at,), t[j] if j < len(t) else (at, 1)))
        want = sorted((len(k), [p for p, _, _ in v]) for k, v in where.items() if len(v) > 1 and len({b for _, b, _ in v}) > 1 and len({a for _, _, a in v}) > 1)
        assert sorted(tree.maximal_repeats(1)) == want
        group = tree.topmost(4)
        four = {k: [p for p, _, _ in v] for k, v in where.items() if len(k) == 4}
        assert all(len({int(group[p]) for p in v}) == 1 for v in four.values()) and len({int(group[v[0]]) for v in four.values()}) == len(four)


# ---------------------------------------------------------------- texts that are made to collide


def alike(*powers):
    """Pairs of strings of a and b that no polynomial modulo 2**64 tells apart."""
    out = []
    for n in powers or (10,):
        order = ["ab"[bin(i).count("1") % 2] for i in range(1 << n)]
        out += ["".join(order), "".join("a" if c == "b" else "b" for c in order)]
    return out


def test_patterned_texts_are_told_apart(make):
    pairs = alike(10, 11, 12)
    assert {(r.doc_id, r.n_removed) for r in lines.deduplicate(make(list(enumerate(pairs)))).collect()} == {(i, 0) for i in range(6)}
    for k in (0, 1):
        hashes = [int(textkit.span_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]), k)[0]) for t in pairs]
        wide = [int(textkit.span_hashes(np.array([ord(c) for c in t]) * 2**40, np.array([0]), np.array([len(t)]), k)[0]) for t in pairs]
        assert len(set(hashes)) == len(set(wide)) == 6
    head = " ".join(f"w{i}" for i in range(49))
    rows = [(i, f"{head} {t}") for i, t in enumerate(pairs)] + [(9, f"{head} {pairs[0]}")]
    assert Counter(map(tuple, substrings.deduplicate(make(rows)).collect())) == plain_passages(rows, 50)
    # A whole run of words that a and b stand for.
    rows = [(i, " ".join(t)) for i, t in enumerate(pairs[:2])]
    assert Counter(map(tuple, substrings.deduplicate(make(rows)).collect())) == plain_passages(rows, 50)


def test_keys_shared_over_steps():
    """Whatever the steps, the rows that go on are those of keys that two lines have, one as its own segment."""
    rng = random.Random(1)
    for _ in range(100):
        rows = sorted({(rng.randint(0, 5), rng.randint(0, 3), rng.random() < 0.4) for _ in range(30)}, key=lambda r: (r[0], not r[2], rng.random()))
        key, ident, own = (np.array(c) for c in zip(*rows, strict=True))
        got, held, at = [], None, 0
        while at < len(rows):
            end = at + rng.randint(1, 4)
            k, i, held = lines.shared_rows(key[at:end], ident[at:end], own[at:end], held)
            got += zip(k.tolist(), i.tolist(), strict=True)
            at = end
        by_key = {k: [r for r in rows if r[0] == k] for k in key.tolist()}
        want = {(k, r[1]) for k, v in by_key.items() if len({r[1] for r in v}) > 1 and any(r[2] for r in v) for r in v}
        assert set(got) == want
