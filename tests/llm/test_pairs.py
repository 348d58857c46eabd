import math
import random

import numpy as np
import pytest

from feedmill.llm import batch_dedup, near_dup, textops as T

RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(900)]


def edited(words, n):
    out = list(words)
    for _ in range(n):
        k = RNG.randrange(len(out))
        how = RNG.random()
        if how < 0.4:
            out[k] = RNG.choice(VOCABULARY)
        elif how < 0.7:
            out.insert(k, RNG.choice(VOCABULARY))
        else:
            del out[k]
    return out


def corpus(n, seed):
    RNG.seed(seed)
    texts = []
    for i in range(n):
        if texts and RNG.random() < 0.5:
            words = edited(RNG.choice(texts), RNG.choice([0, 1, 2, 4, 8, 16]))
        else:
            words = [RNG.choice(VOCABULARY) for _ in range(RNG.choice([22, 60, 150]))]
        texts.append(words)
    return [(i + 1, "<p>" + " ".join(w) + "</p>") for i, w in enumerate(texts)]


def overlaps(rows, n, least):
    sets = {}
    for i, t in rows:
        w = T.words_of(t)
        if len(w) >= max(n, least):
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :]}


def test_masks_cover_every_pair_within_the_radius():
    masks = near_dup.covering_masks()
    assert len(masks) == 7 and all(len(m) == 4 for m in masks)
    for a in range(7):
        for b in range(7):
            assert any(a not in m and b not in m for m in masks)
    assert near_dup.groups_for(0.8) < near_dup.groups_for(0.5)


@pytest.mark.parametrize("words, threshold, least", [(3, 0.5, 20), (5, 0.8, 0)])
def test_pairs_against_brute_force(spark, words, threshold, least):
    rows = corpus(150, 3)
    df = spark.createDataFrame(rows, "id int, body string")
    pairs, copies = near_dup.near_duplicates(df, "id", "body", words, threshold, least)
    truth = {p: o for p, o in overlaps(rows, words, least).items() if o >= threshold}
    text = {i: tuple(T.words_of(t)) for i, t in rows}
    rep = {i: min(j for j in text if text[j] == text[i]) for i in text}
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    want = {p for p in truth if rep[p[0]] == p[0] and rep[p[1]] == p[1]}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 8
    full = {(r.id_a, r.id_b) for r in near_dup.with_copies(pairs, copies).collect()}
    assert full <= set(truth) and {(rep[i], i) for i in text if rep[i] != i and len(text[i]) >= max(words, least)} <= full
    groups = {r.id: r.group_id for r in near_dup.near_duplicate_groups(pairs, copies).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in full:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert groups == {i: root(i) for i in parent if any(i in p for p in full)}


def test_collisions_are_streamed_group_by_group():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    n = 3000
    key = np.sort(np.r_[rng.integers(0, 900, n - 300), np.full(300, 400)])
    ids, bits = rng.permutation(n).astype(np.int64), rng.integers(-4, 4, (n, 2))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["key", "id", "b0", "b1"])
    agree = lambda i, j: 64 - bin(int((bits[i, 0] ^ bits[j, 0]) | (bits[i, 1] ^ bits[j, 1])) & (2**64 - 1)).count("1")
    want = set()
    for k in np.unique(key):
        at = np.flatnonzero(key == k)
        if len(at) <= 100:
            want |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for x, i in enumerate(at) for j in at[x + 1 :] if agree(int(i), int(j)) >= 62}
    for size in (7, 64, 500, n):
        got, hot = set(), []
        for b in near_dup._collisions((rows.slice(k, size) for k in range(0, n, size)), 62, 100):
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hot.append(a) if c is None else got.add((a, c))
        assert got == want and set(hot) == {400}


def test_hot_keys_are_split_into_blocks(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:199] + [f"x{i}"])) for i in range(40)] + [(100 + i, f"copy {' '.join(base[:50])}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, body string")
    want = near_dup.near_duplicates(df, "id", "body")[0].count()
    pairs, copies = near_dup.near_duplicates(df, "id", "body", block=8)
    assert pairs.count() == want == 40 * 39 // 2 and copies.count() == 59


def test_pairs_of_odd_rows(spark):
    long = " ".join(RNG.choice(VOCABULARY) for _ in range(120_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (None, "x " * 30, "a"), (4, long, "a"), (5, long + " end", "a"), (6, "<b>same</b> words stand here again", "a"), (6, "same words stand here again", "b"), (7, "SAME words stand, here again!", None)]
    df = spark.createDataFrame(rows, "id int, body string, keys string")
    pairs, copies = near_dup.near_duplicates(df, "id", "body")
    assert [(r.id_a, r.id_b) for r in pairs.collect()] == [(4, 5)] and [(r.rep, r.id) for r in copies.collect()] == [(6, 7)]
    pairs, copies = near_dup.near_duplicates(df.limit(0), "id", "body")
    assert pairs.count() == 0 and copies.count() == 0 and near_dup.near_duplicate_groups(pairs, copies).count() == 0


def first_earlier(rows, n, threshold, new):
    sets, out = {}, {}
    for i, t, h in rows:
        w = T.words_of(t)
        sets[i] = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)}, (h or "").strip().lower())
    for i in new:
        a, h = sets[i]
        hits = [j for j in sets if j < i and ((h and sets[j][1] == h) or (a and sets[j][0] and len(a & sets[j][0]) >= threshold * len(a | sets[j][0])))]
        if hits:
            out[i] = min(hits)
    return out


@pytest.mark.parametrize("fan", [2, 4])
def test_batches_against_brute_force(spark, fan):
    rows = corpus(160, 11)
    hashes = [f"{RNG.randrange(140):064X}" if RNG.random() < 0.8 else RNG.choice([None, "", " "]) for _ in rows]
    full = [(i, t, h.lower() if h and RNG.random() < 0.5 else h) for (i, t), h in zip(rows, hashes)]
    history = spark.createDataFrame([(*r, "tag") for r in full if r[0] <= 90], "id int, text string, hash string, tag string")
    batches = spark.createDataFrame([(*r, 1 + (r[0] - 91) // 20, "x") for r in full if r[0] > 90], "id int, text string, hash string, batch int, copy string")
    got = {r.id_b: r.id_a for r in batch_dedup.repeats(history, batches, 3, 0.5, fan).collect()}
    assert got == first_earlier(full, 3, 0.5, [r[0] for r in full if r[0] > 90]) and len(got) > 20


def test_windows_in_full_and_in_part():
    rng = np.random.default_rng(3)
    for many in (5, 2000):  # short windows, and long ones that are read in pieces
        ok, oi = np.sort(rng.integers(0, 7, 40 * many)), rng.permutation(40 * many).astype(np.int64)
        for key in np.unique(ok):
            oi[ok == key] = np.sort(oi[ok == key])
        ob, nb = rng.integers(0, 4, (len(ok), 2)), rng.integers(0, 4, (30, 2))
        nk, ni = np.sort(rng.integers(0, 9, 30)), rng.integers(0, 60 * many, 30)
        agree = lambda a, b: 64 - bin((a[0] ^ b[0]) | (a[1] ^ b[1])).count("1")
        want = [[int(o) for o, key, b in zip(oi, ok, ob) if key == k and o < i and agree(x, b) >= 63] for k, i, x in zip(nk, ni, nb)]
        for most in (3, 10**9):
            new_id, old_id, more = batch_dedup._window((nk, ni, nb), (ok, oi, ob), 63, most)
            got = {}
            for a, b, c in zip(new_id.tolist(), old_id.tolist(), more.tolist()):
                got.setdefault(a, []).append((b, c))
            for i, w in zip(ni.tolist(), want):
                mine = [x for x in got.get(i, []) if x[0] in w]
                assert [b for b, _ in mine] == w[:most] or len([x for x in ni if x == i]) > 1
                assert len(w) <= most or mine[-1][1] or len([x for x in ni if x == i]) > 1


def test_merging_pages_keeps_all_records_in_order(spark, monkeypatch):
    rng = np.random.default_rng(4)
    runs = []
    for _ in range(3):
        rows = sorted((int(p), int(k), int(i), 1, 2) for p, k, i in zip(rng.integers(0, 3, 30_000), rng.integers(-50, 50, 30_000), rng.integers(0, 10**6, 30_000)))
        runs.append(rows)
    frames = [batch_dedup._packed(spark.createDataFrame(r, "part int, key bigint, id bigint, b0 bigint, b1 bigint").coalesce(1)) for r in runs]
    pages = frames[0].union(frames[1]).union(frames[2]).coalesce(1).sortWithinPartitions("part", "lo", "first")
    got = []
    for r in batch_dedup._merged(pages).collect():
        keys, ids, _ = batch_dedup._records(r.keys, r.ids, r.bits)
        assert len(keys) <= batch_dedup.PAGE_ROWS and (keys[0], keys[-1], ids[0]) == (r.lo, r.hi, r["first"])
        got += [(r.part, k, i) for k, i in zip(keys.tolist(), ids.tolist())]
    assert got == sorted(x[:3] for r in runs for x in r)


def test_an_index_is_opened_again_without_the_texts_of_its_history(spark, tmp_path):
    rows = [(i, t, None) for i, t in corpus(120, 17)]
    schema = "id int, text string, hash string"
    index = batch_dedup.HistoryIndex(spark, f"file://{tmp_path}/index", 3, 0.5, fan=2)
    for at in range(0, 80, 20):  # four batches, compacted as they come
        index.take(index.sketch(spark.createDataFrame(rows[at : at + 20], schema)))
    assert len(index.runs) == 1 and len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 1
    for r in index.runs:
        spark.sql(f"drop table {r['name']}")  # as in another session, whose catalogue is empty
    again = batch_dedup.HistoryIndex.open(spark, f"file://{tmp_path}/index")
    assert (again.runs, again.tables) == (index.runs, index.tables)
    new = again.sketch(spark.createDataFrame(rows[80:], schema))
    found = {(r.old_id, r.new_id) for r in again.check(new).collect()}
    text = {i: tuple(T.words_of(t)) for i, t, _ in rows}
    truth = {p for p, o in overlaps([r[:2] for r in rows], 3, 0).items() if o >= 0.5 and p[1] > 80}
    first = {p for p in truth if p[0] == min(j for j in text if text[j] == text[p[0]]) and p[1] == min(j for j in text if j > 80 and text[j] == text[p[1]])}
    assert first and first <= found
    assert again.reads[0]["runs"] == 1 and 0 < again.reads[0]["bytes"] <= index.runs[0]["bytes"]
    few = again.sketch(spark.createDataFrame([(999, None, "ab")], schema))  # one hash: one range of 128 is read
    again.check(few)
    assert again.reads[1]["bytes"] < again.reads[0]["bytes"] / 20


def test_a_family_of_near_copies_gives_few_candidates_and_loses_none(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join(base[:119] + [f"x{i}"]), None) for i in range(1, 101)]  # all alike
    apart = [(200 + i, " ".join(base[:56] + [f"y{i}z{k}" for k in range(64)]), None) for i in range(60)]  # share less than half with them
    new = [(300 + i, " ".join(base[:119] + [f"n{i}"]), None, 1) for i in range(40)]
    schema = "id int, text string, hash string"
    monkeypatch.setattr(batch_dedup, "FIRST", 2)
    history = spark.createDataFrame(apart + near, schema)
    got = {r.id_b: r.id_a for r in batch_dedup.repeats(history, spark.createDataFrame(new, schema + ", batch int"), 3, 0.5).collect()}
    assert got == {300 + i: 1 for i in range(40)}


def test_batches_of_odd_rows(spark):
    schema = "id int, text string, hash string"
    history = spark.createDataFrame([(1, None, None), (2, "", "AA"), (3, "a b c d", " sha256:bb "), (None, "a b c d", "cc")], schema)
    batch = [(10, None, None, 1), (11, "", "aa", 1), (12, "A, b. C d", None, None), (13, "z", "BB", 2), (14, "a b c d e f g", "dd", 2), (15, "a b c d e f g", None, 1), (16, "q", "cc", 1), (None, "a b c d", None, 1)]
    new = spark.createDataFrame(batch, schema + ", batch int")
    got = {r.id_b: r.id_a for r in batch_dedup.repeats(history, new, 3, 0.5).collect()}
    assert got == {11: 2, 12: 3, 13: 3, 15: 14} or got == {11: 2, 12: 3, 13: 3}  # 14 arrives in a later batch than 15
    assert batch_dedup.repeats(history, new.limit(0), 3, 0.5).count() == 0
    assert batch_dedup.repeats(history.limit(0), new, 3, 0.5).count() <= 1


def test_sketch_estimates_overlap():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    h = T.MinHash(64)
    x, y = h(np.unique(a[:3000])), h(np.unique(a[1000:]))
    s = T.bit_sketch(np.array([x, y])).view(np.uint64)
    agree = 64 - int(np.bitwise_count((s[0, 0] ^ s[1, 0]) | (s[0, 1] ^ s[1, 1])))
    assert agree >= T.least_agreement(0.5)
    assert (h(np.tile(a, 3)) == h(a)).all()


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_the_sketch_loses_few_pairs_at_the_threshold(threshold):
    agree, least = threshold + (1 - threshold) / 4, T.least_agreement(threshold)
    assert sum(math.comb(64, k) * agree**k * (1 - agree) ** (64 - k) for k in range(least)) < 3e-4


def test_min_wise_values_lose_few_pairs_at_the_threshold(spark):
    n, threshold, odd = 96, 0.5, 0
    while odd < n and sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(odd + 1)) < 3e-4:
        odd += 1  # the fewest agreements that a pair at the threshold has with more than this probability
    sketches = spark.createDataFrame([(1, bytes(n)), (2, bytes(odd) + b"x" * (n - odd)), (3, b"y" * n)], "id bigint, mins binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a bigint, id_b bigint")
    assert [(r.id_a, r.id_b) for r in batch_dedup.likely(pairs, sketches, threshold).collect()] == [(1, 2)]
