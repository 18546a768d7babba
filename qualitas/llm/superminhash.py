"""Operator 6: near-duplicate detection with SuperMinHash.

A document is its set of distinct shingles (runs of ``words`` words; A-Z in lower case, words between ASCII white
space; a shorter document is one shingle).  Two documents are linked if
``100 * |intersection| >= percent * |union|``; a class is what links connect.  Sets are handled as 64-bit hashes (of
xxhash values of the words), and a link counts once the shingles themselves confirm it.

1. Every set gives a SuperMinHash signature of ``bands * rows`` places.  Element x deals the places out in a random
   order of its own; as the j-th it offers the place the value j + random fraction, and each place keeps its least
   offer.  Ranks of one element are correlated, so the estimate varies less than with independent hashes.  Elements
   are handled rank by rank, all at once, and a document stops as soon as no place can fall any further: one rank
   for long documents, some for short ones.  (The order of the offers doesn't matter to the minimum.)
2. Equal sets form one group, represented by one of its texts; only these go on.
3. Each run of ``rows`` places is a band; documents with an equal band share a bucket.  In each bucket all members
   are paired with one hub.  Pairs are verified on the full sets, links are joined into components, and buckets
   whose members are still in several components get another hub out of the largest one, for the others only.  In
   what is open after ``hub_rounds`` the full set of every member outside the largest component is counted against
   an inverted index of all members, in blocks of bounded size; a block gives one link per member and component, so
   a bucket of any size loses no link, and no pairs are listed.
4. Links are joined by union-find within each partition and by alternating star steps between them.

With 42 bands of 5 rows a pair at a similarity of 0.8 shares no bucket once in 18 million.

Null and empty texts and texts without words have no shingles and no links, and neither do rows without an id.
Repeated rows are in one class; different texts under one id are documents of their own.  An empty table gives an
empty result.  Other columns are ignored.
"""
from __future__ import annotations

import functools
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.llm.batches import flat_map
from qualitas.session import remove, work_folder, written

BANDS, ROWS = 42, 5
PERCENT = 80
HUB_ROUNDS = 1
#: Shingles of a bucket's members that one block holds, about.
BLOCK_SHINGLES = 1 << 20
#: Nodes that union-find holds at once.
FOREST_NODES = 1 << 19
#: Texts hashed at once, and elements ranked at once: bounds of a task's memory.
TEXT_BYTES = 1 << 19
ELEMENTS = 1 << 16

_U = np.uint64
_GOLDEN, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOW = _U(0xFFFFFFFF)
_UNSET = np.uint32(0xFFFFFFFF)
_SPACE = re.compile(rb"[ \t-\r]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix)."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of every word in ``raw`` (already in lower case)."""
    words = raw.split()                                         # at ASCII white space
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def _pieces(raw: bytes):
    """``raw`` cut at white space into runs of about ``TEXT_BYTES``."""
    at = 0
    while len(raw) - at > TEXT_BYTES:
        space = _SPACE.search(raw, at + TEXT_BYTES)
        stop = space.start() if space else len(raw)
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [_shingles(np.concatenate([word_hashes(p) for p in _pieces(t.encode().lower())]), words) for t in texts]


def shingles_of(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text themselves."""
    w = text.encode().lower().split()
    return set(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else {tuple(w)} if w else set()


def confirmed(a: set, b: set, percent: int) -> bool:
    """Whether two sets of shingles are linked."""
    common = len(a & b)
    return bool(a and b) and 100 * common >= percent * (len(a) + len(b) - common)


def _shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - words + 1)
    made = np.zeros(n, _U)
    for i in range(min(words, len(hashes))):
        made = mixed((made ^ hashes[i:i + n]) + _GOLDEN)
    return np.unique(made)


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash signatures (one row a set): rank in the upper 8 bits, fraction in the lower 24."""
    best = np.full(len(sets) * places, _UNSET, np.uint32)
    unfinished = []
    for i, x in enumerate(sets):                                # rank 0: the order is still the natural one
        own = best[i * places:(i + 1) * places]
        for at in range(0, len(x), ELEMENTS):
            z = mixed(x[at:at + ELEMENTS] + _GOLDEN)
            np.minimum.at(own, ((z & _LOW) * _U(places) >> _U(32)).astype(np.intp), (z >> _U(40)).astype(np.uint32))
        if len(x) and own.max() == _UNSET:
            unfinished.append(i)
    while unfinished:
        group, size = [], 0
        while unfinished and (not group or size + len(sets[unfinished[-1]]) <= ELEMENTS):
            group.append(unfinished.pop())
            size += len(sets[group[-1]])
        _further_ranks(sets, group, best, places)
    return best.reshape(len(sets), places)


def _further_ranks(sets, group, best, places) -> None:
    """Offer the ranks above 0 of the sets in ``group``, until none of their places can fall."""
    own = np.arange(places)[None, :] + np.array(group)[:, None] * places
    x = np.concatenate([sets[i] for i in group])
    member = np.repeat(np.arange(len(group)), [len(sets[i]) for i in group])
    base = np.array(group)[member] * places
    order = np.tile(np.arange(places, dtype=np.uint8), (len(x), 1))
    for j in range(places):
        z = mixed(x + _U(int(_GOLDEN) * (j + 1) & (1 << 64) - 1))
        k = (j + ((z & _LOW) * _U(places - j) >> _U(32))).astype(np.intp)
        rows = np.arange(len(x))
        place = order[rows, k]
        order[rows, k] = order[:, j]
        order[:, j] = place
        if j == 0:
            continue                                            # offered before
        np.minimum.at(best, base + place, (np.uint32(j) << np.uint32(24)) | (z >> _U(40)).astype(np.uint32))
        going = (best[own].max(axis=1) >> np.uint32(24) > j)[member]
        if not going.any():
            return
        if going.mean() < 0.75:
            x, member, base, order = x[going], member[going], base[going], order[going]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature[:, :bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(signature), 1))
    for r in range(rows):
        key = mixed((key ^ parts[:, :, r]) + _GOLDEN)
    return key.view(np.int64)


def features(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, n, digest, keys`` of every row: set size, digest of the set, band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def made(ids, hashes, texts):
        sets = shingle_sets(texts, words)
        keys = band_keys(signatures(sets, bands * rows), bands, rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
             pa.array([k if len(s) else [] for s, k in zip(sets, keys, strict=True)], pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        for batch in batches:
            ids, hashes, texts, size = [], [], [], 0
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text_hash, text in zip(*(part[c].to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    texts.append(text)
                    size += len(text)
                    if size >= TEXT_BYTES:
                        yield made(ids, hashes, texts)
                        ids, hashes, texts, size = [], [], [], 0
            if ids:
                yield made(ids, hashes, texts)

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough, by the shingles themselves; ``texts`` has ``node, text``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        last: tuple = (None, np.array([], _U), set())

        def rows(a, b, text_a, text_b):
            nonlocal last
            if last[0] != b:                                    # pairs of one hub follow one another
                last = (b, shingle_sets([text_b], words)[0], None)
            if similar(shingle_sets([text_a], words)[0], last[1], percent):
                if last[2] is None:
                    last = (*last[:2], shingles_of(text_b, words))
                if confirmed(shingles_of(text_a, words), last[2], percent):
                    yield a, b
        yield from flat_map(batches, schema, rows)

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def block_links(outside: list[tuple[int, int, np.ndarray]], members: list[tuple[int, int, np.ndarray]], percent: int,
                sure=lambda i, j: True):
    """Links of a block: for each ``(node, component, set)`` outside, one to each other component it is similar to.

    ``sure(i, j)`` confirms a link between an outside member and another one by their shingles.
    """
    if not members:
        return
    sizes = np.array([len(x) for _, _, x in members])
    components = np.array([c for _, c, _ in members])
    hashes = np.concatenate([x for _, _, x in members])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], np.repeat(np.arange(len(members)), sizes)[order]
    for place, (node, component, x) in enumerate(outside):
        first, last = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
        many = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(members))
        linked = np.flatnonzero((100 * common >= percent * (len(x) + sizes - common)) & (components != component))
        done = set()
        for i in linked.tolist():
            if members[i][1] not in done and sure(place, i):
                done.add(members[i][1])
                yield node, members[i][0]


def compared(open_: DataFrame, texts: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """Links ``a, b`` between components within buckets: ``key, node, n, component, main`` of their members.

    Outside members and all members of a bucket are dealt into chunks by hash; every pair of chunks is a block.
    """
    outside = F.col("component") != F.col("main")
    chunks = lambda n: F.greatest(F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    # written, so that the join with it can split the rows of a large bucket
    sizes = written(open_.groupBy("key").agg(chunks(F.sum("n")).alias("of_members"),
                                             chunks(F.sum(F.when(outside, F.col("n")))).alias("of_outside")),
                    f"{folder}/sizes")
    mine = lambda of, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    block = lambda o, m, role: F.struct(o.alias("o"), m.alias("m"), F.lit(role).alias("outside"))
    roles = F.concat(
        F.transform(every("of_outside"), lambda o: block(o, mine("of_members", 1), False)),
        F.when(outside, F.transform(every("of_members"), lambda m: block(mine("of_outside", 2), m, True)))
        .otherwise(F.array().cast("array<struct<o:int,m:int,outside:boolean>>")))
    rows = (open_.join(sizes, "key").select("key", "node", "component", F.explode(roles).alias("r"))
            .join(texts, "node").select("key", "r.o", "r.m", "r.outside", "node", "component", "text"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(block: pa.Table) -> pa.Table:
        sides: dict[bool, list] = {True: [], False: []}
        texts_of: dict[bool, list] = {True: [], False: []}
        for part in block.to_batches(max_chunksize=500):
            rows = [part[c].to_pylist() for c in ("outside", "node", "component", "text")]
            for role, node, component, text, x in zip(*rows, shingle_sets(rows[3], words), strict=True):
                sides[role].append((node, component, x))
                texts_of[role].append(text)
        shingles = functools.cache(lambda role, i: shingles_of(texts_of[role][i], words))
        found = list(block_links(sides[True], sides[False], percent, lambda i, j: confirmed(
            shingles(True, i), shingles(False, j), percent)))
        return pa.Table.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=schema)

    return rows.groupBy("key", "o", "m").applyInArrow(links, "a long, b long")


# -- components -----------------------------------------------------------------------------------------------

def _forest(batches):
    """Union-find over runs of a partition's links, of bounded size: a link from every node to its root in the run."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def links():
        found = [(x, root(x)) for x in parent]
        found = [(x, r) for x, r in found if x != r]
        parent.clear()
        for at in range(0, len(found), 10_000):
            part = found[at:at + 10_000]
            yield pa.RecordBatch.from_pydict({"u": [x for x, _ in part], "v": [r for _, r in part]},
                                             schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    for batch in batches:
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
            if len(parent) >= FOREST_NODES:                      # the star steps join the runs
                yield from links()
    yield from links()


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (``u, v``, distinct) points to one other that points nowhere: the steps' end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least"))
    return nodes.where("out > 1 OR out = 1 AND least = 0").isEmpty()


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``): the smallest node that it reaches.

    Alternating large-star and small-star steps over written tables, until all links are stars (no node has two
    centres, and no centre has one); each step ships a link at most twice.
    """
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
                    .mapInArrow(_forest, "u long, v long"), f"{folder}/0")
    step = 0
    while not _stars(edges):
        step += 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .distinct(), f"{folder}/{step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.u", "e.v").where("u <> v").distinct(), f"{folder}/{step}")
        for old in (f"{folder}/{step}-large", f"{folder}/{step - 1}"):
            remove(spark, old)
        edges = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct())


# -- the operator ---------------------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, words: int = 2, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                    hub_rounds: int = HUB_ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash, first`` of every row.

    ``first`` marks the row of each class that stays: of the smallest id, and of its texts, the one of the least hash
    (``text_hash``, the same for repeated rows).
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "near-duplicates")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    each = written(features(source, words, bands, rows), f"{folder}/features")
    # a group's number is its own, as one id may have several texts; once written it doesn't change
    groups = written(each.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
                     .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n").alias("n"),
                          F.first("keys").alias("keys"))
                     .withColumn("node", F.monotonically_increasing_id()), f"{folder}/groups")
    banded = groups.select("node", "n", F.explode("keys").alias("key"))
    hubs = written(banded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members"))
                   .where("members > 1"), f"{folder}/hubs")
    members = written(banded.join(hubs, "key"), f"{folder}/members")
    involved = groups.join(members.select("node").distinct(), "node", "left_semi").select("node", "first.*")
    texts = written(source.join(involved, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]),
                    f"{folder}/texts")

    tested, links = [], []

    def try_pairs(pairs: DataFrame) -> None:
        """Verify what hasn't been tested yet."""
        ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        if tested:
            ordered = ordered.join(reduce(DataFrame.unionAll, tested), ["a", "b"], "left_anti")
        tested.append(written(ordered, f"{folder}/pairs-{len(tested)}"))
        if not tested[-1].isEmpty():
            links.append(written(verified(tested[-1], texts, words, percent), f"{folder}/links-{len(links)}"))

    component = None
    try_pairs(members.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    for turn in range(hub_rounds + 1):
        component = written(components(reduce(DataFrame.unionAll, links), f"{folder}/components-{turn}"),
                            f"{folder}/component-{turn}") if links else None
        if component is None:
            break
        within = (members.where("members > 2").select("key", "node", "n").join(component, "node", "left")
                  .withColumn("component", F.coalesce("component", "node")))
        sides = within.groupBy("key", "component").agg(
            F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("hub"))
        largest = written(sides.groupBy("key").agg(
            F.max(F.struct("size", "component", "hub.node")).alias("main"), F.count(F.lit(1)).alias("sides"))
            .where("sides > 1").select("key", F.col("main.component").alias("main"), F.col("main.node").alias("hub")),
            f"{folder}/open-{turn}")
        if largest.isEmpty():
            break
        open_ = within.join(largest, "key")
        if turn == hub_rounds:
            links.append(written(compared(open_, texts, words, percent, folder), f"{folder}/links-last"))
            component = written(components(reduce(DataFrame.unionAll, links), f"{folder}/components-last"),
                                f"{folder}/component-last")
        else:
            try_pairs(open_.where("component <> main").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    classes = groups.select("digest", "node", "first")
    if component is not None:
        classes = (classes.join(component, "node", "left")
                   .select("digest", F.coalesce("component", "node").alias("node"), "first"))
    least = classes.groupBy("node").agg(F.min("first").alias("least"))
    classes = written(classes.select("digest", "node").join(least, "node").select("digest", "least"), f"{folder}/classes")
    steps = [*range(hub_rounds + 1), "last"]
    for used in ("groups", "hubs", "members", "texts", "sizes", *(f"{kind}-{i}" for kind in (
            "pairs", "links", "components", "component", "open") for i in steps)):
        remove(spark, f"{folder}/{used}")                    # the result needs the features and the classes only
    able = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return each.join(classes, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(able, F.col("least.doc_id")).otherwise(F.col("doc_id"))
        .alias("component_id"), "text_hash",
        F.when(able, F.struct("doc_id", "text_hash") == F.col("least")).otherwise(True).alias("first"))
