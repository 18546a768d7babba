"""Near duplicates against all pairs, signatures against the sequential algorithm."""
import random
import re

import numpy as np
import pytest

from qualitas.llm import queries, superminhash as smh

SF = "/root/testdata/sf0.001"


def plain_sets(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def plain_classes(rows, words=2, percent=80):
    sets, parent = plain_sets([t for _, t in rows], words), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def sequential(x, places):
    """SuperMinHash element by element with early stopping, as published."""
    best = [1 << 32] * places
    for e in x.tolist():
        order = list(range(places))
        for j in range(places):
            if j > max(best) >> 24:
                break
            z = int(smh.mixed(np.array([e], np.uint64) + np.uint64(int(smh._GOLDEN) * (j + 1) % (1 << 64)))[0])
            k = j + ((z & 0xFFFFFFFF) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], j << 24 | z >> 40)
    return best


@pytest.mark.parametrize("n", [1, 2, 7, 40, 300, 2000])
def test_signatures_equal_the_sequential_algorithm(n):
    sets = [np.unique(np.random.default_rng(n + i).integers(0, 1 << 63, n).astype(np.uint64)) for i in range(3)]
    got = smh.signatures([*sets, np.array([], np.uint64)], 30)
    for x, s in zip(sets, got):
        assert s.tolist() == sequential(x, 30)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    s = smh.signatures([a, b], 210)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.1


def test_shingles_of_long_and_odd_texts(monkeypatch):
    texts = ["", " ", "A b", "a B\tc\x0b", "x", "é É ß", "a\x1cb c", "a " * 50, "w1 w2 w3 " * 400]
    want = [len(s) for s in plain_sets(texts, 2)]
    assert [len(s) for s in smh.shingle_sets(texts, 2)] == want
    whole = smh.shingle_sets(texts, 2)
    monkeypatch.setattr(smh, "TEXT_BYTES", 64)
    assert all((a == b).all() for a, b in zip(whole, smh.shingle_sets(texts, 2)))


def test_op6_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op6_superminhash(spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_classes(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def varied(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words)


@pytest.mark.parametrize(("hub_rounds", "block"), [(0, 300), (1, 1 << 20)])
def test_large_groups_of_near_copies(spark, monkeypatch, hub_rounds, block):
    """Variants of a few texts, many of them below the threshold to any one hub."""
    monkeypatch.setattr(smh, "BLOCK_SHINGLES", block)
    rng = random.Random(11)
    rows = [(5, ""), (6, None), (7, "  "), (8, "one"), (3, "ONE"), (9, "one two"), (9, "one two")]
    for g in range(3):
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        for i in range(70):
            base = varied(rng, base, 0.004).split()
            rows.append((1000 * (g + 1) + i * 3 % 70, varied(rng, base, 0.03)))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int")
    got = smh.near_duplicates(docs, hub_rounds=hub_rounds).collect()
    want, got = plain_classes(rows), sorted(tuple(r)[:3] for r in got)
    assert [x for x in zip(got, want) if x[0] != x[1]] == []


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "A  b\nc"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in smh.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 2, None), (1, 2, 1), (2, 2, 1), (None, 0, None)], key=repr)
    assert smh.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    from qualitas.session import work_folder
    got = {r.node: r.component for r in smh.components(
        spark.createDataFrame(links, "a long, b long").repartition(7), work_folder(spark, "c")).collect()}
    least = {x: x for link in links for x in link}
    for _ in range(400):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {x: c for x, c in least.items() if any(x in link and link[0] != link[1] for link in links)}


def thue_morse(letters):
    word = letters[0]
    while len(word) < 1024:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_words_of_one_structure_do_not_collide(spark):
    """A Thue-Morse word and its complement have equal hashes for every polynomial hash modulo 2**64."""
    one, other = thue_morse("ab"), thue_morse("ba")
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {one} x"), (4, f"{other} {other} x")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in smh.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_links_are_confirmed_by_the_shingles(spark, monkeypatch):
    """With hashes that all collide, texts of equal sizes look alike; their shingles tell them apart."""
    assert smh.shingles_of("A b  a B c", 2) == {(b"a", b"b"), (b"b", b"a"), (b"b", b"c")} and smh.shingles_of("x", 2) == {(b"x",)}
    assert smh.confirmed({1, 2, 3, 4}, {1, 2, 3, 4, 5}, 80) and not smh.confirmed({1, 2, 3}, {1, 2, 4}, 80)
    assert not smh.confirmed(set(), set(), 80)
    a, b = np.array([1, 2], np.uint64), np.array([1, 2], np.uint64)
    assert list(smh.block_links([(7, 7, a)], [(8, 8, b), (9, 8, b)], 80, lambda i, j: j == 1)) == [(7, 9)]
    assert list(smh.block_links([(7, 7, a)], [(8, 8, b)], 80, lambda i, j: False)) == []


def test_texts_of_one_id_stay_apart(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "first text of it"), (1, "quite another one"), (1, "first text of it"), (2, "quite  another ONE"), (3, long),
            (2, long + " end"), (9, "")]
    got = smh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in got) == [
        (1, 1, 2), (1, 1, 3), (1, 1, 3), (2, 1, 2), (2, 2, 40), (3, 2, 39), (9, 9, 0)]
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.first) == [(1, 2), (1, 3), (1, 3), (2, 40), (9, 0)]


def test_forest_in_runs(spark, monkeypatch):
    monkeypatch.setattr(smh, "FOREST_NODES", 3)
    from qualitas.session import work_folder
    links = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55)]
    got = {r.node: r.component for r in smh.components(spark.createDataFrame(links, "a long, b long").coalesce(1),
                                                       work_folder(spark, "runs")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 55: 50, 60: 50}
