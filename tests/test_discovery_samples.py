"""References, keys, exact samples, formats, evidence and mergeable states against brute force."""
import datetime as dt
import hashlib
import random
import struct
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualitas.operators import cells as C
from qualitas.operators import discovery
from qualitas.operators import evidence as E
from qualitas.operators.discovery import candidate_keys, inclusion_dependencies
from qualitas.operators.formats import formats
from qualitas.operators import sampling
from qualitas.operators.states import LG_K, merged_profile, write_states
from qualitas.plans.audit import Audit
from qualitas.session import work_folder


def test_references_over_more_columns_than_a_word_holds(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(4 + i % 9) if rng.random() < 0.9 else None for i in range(70)] for _ in range(40)]
    wide = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(70)))
    keys = spark.createDataFrame([(i, "x" * 100 + str(i)) for i in range(12)], "id long, name string")
    names = spark.createDataFrame([("x" * 100 + "3",), (None,), ("",)], "name string")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in inclusion_dependencies({"w": wide, "k": keys, "n": names}).collect()}
    values = {("w", f"c{i}"): {r[i] for r in rows} - {None} for i in range(70)}
    values |= {("k", "id"): set(range(12))}
    want = {(*a, *b) for a in values for b in values if a != b and values[a] and values[a] <= values[b]}
    want.add(("n", "name", "k", "name"))
    assert set(got) == want
    assert got["w", "c0", "k", "id"] == (len(values["w", "c0"]), 12, True)
    assert all(unique == (parent[:2] == ("k", "id") or parent == ("k", "name")) for (_, _, *p), (_, _, unique) in got.items()
               for parent in [tuple(p)])


def minimal_keys(rows, names, most):
    found = []
    for n in range(1, most + 1):
        for s in combinations(range(len(names)), n):
            if any(set(k) <= set(s) for k in found) or any(r[i] in (None, "") for r in rows for i in s):
                continue
            if len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                found.append(s)
    return sorted([names[i] for i in s] for s in found)


def test_keys_against_all_combinations(spark):
    rng = random.Random(2)
    names = ["a", "b", "c", "d", "e"]
    rows = [(i % 20, i // 20, rng.randrange(60), str(i * 7) if i else None, f"{i % 10}-{rng.randrange(40)}") for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e string")
    for most in (1, 2, 3):
        assert sorted(r.columns for r in candidate_keys(df, most).collect()) == minimal_keys(rows, names, most)
    assert candidate_keys(df.limit(0)).count() == 0


@pytest.mark.parametrize(("at_once", "slices", "weak"), [
    (1 << 24, 256, None),                                         # all sets in one job
    (300, 4, None),                                               # a slice first, then a set or two a job
    (1, 2, 7),                                                    # other values under nearly every hash
    (1 << 24, 2, 1)])
def test_keys_in_slices_and_under_equal_hashes(spark, monkeypatch, at_once, slices, weak):
    monkeypatch.setattr(discovery, "ROWS_AT_ONCE", at_once)
    monkeypatch.setattr(discovery, "SLICES", slices)
    if weak:
        monkeypatch.setattr(discovery, "_hash", lambda columns: F.pmod(F.xxhash64(*columns), F.lit(weak)) * slices)
    rng = random.Random(4)
    rows = [(i // 4, i % 4, rng.randrange(1 << 30) / 100, rng.randrange(150) / 4, f"{i % 50}-{rng.randrange(60)}",
             None if i == 9 else i) for i in range(200)]
    rows[7] = rows[7][:1] + rows[6][1:]                           # one pair of rows alike in all but a
    rows[6] = rows[6][:1] + (9,) + rows[6][2:]
    df = spark.createDataFrame(rows, "a int, b int, c double, d double, e string, f long")
    assert sorted(r.columns for r in candidate_keys(df, 3).collect()) == minimal_keys(rows, "abcdef", 3)


def test_keys_are_those_of_the_texts(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:                                                          # the hour that comes twice
        df = spark.sql("""SELECT timestamp_seconds(1603585800 + 3600 * id) AS moment, CAST(1603585800 + id AS DECIMAL(20, 3)) AS amount,
            date_from_unix_date(id) AS day, id = 0 AS first, CAST('' AS BINARY) AS nothing, named_struct('x', id) AS nested FROM range(2)""")
        got = sorted(r.columns for r in candidate_keys(df).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [["amount"], ["day"], ["first"], ["nested"]]
    nan = float("nan")
    signs = spark.createDataFrame([(0, 0.0, nan), (0, -0.0, 1.0), (1, 0.0, nan), (1, -0.0, nan)], "a int, zero double, x double")
    assert [r.columns for r in candidate_keys(signs).collect()] == [["a", "zero"]]


def test_key_search_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> dict[str, int]:
        it, found = disk.getAllFiles().iterator(), {}
        while it.hasNext():
            f = it.next()
            if f.getName().startswith("shuffle_"):
                found[f.getName()] = f.length()
        return found

    # pairs that nearly all are keys: their digests took about 40 bytes a row and pair, all kept to the end
    df = spark.range(100_000).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20_000)).alias(f"c{i}") for i in range(5)])
    before = set(shuffled())
    assert candidate_keys(df).count() == 0
    until = time.time() + 10
    while (left := sum(n for f, n in shuffled().items() if f not in before)) > 1_000_000 and time.time() < until:
        time.sleep(0.2)
    assert left <= 1_000_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def plain_priority(seed, row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return hashlib.md5((f"{seed};" + "".join(parts)).encode()).hexdigest()


@pytest.mark.parametrize("fetched", [1, 4096])
def test_samples_have_their_size_and_do_not_depend_on_partitions(spark, monkeypatch, fetched):
    monkeypatch.setattr(sampling, "FETCHED", fetched)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    rows = [(i, f"é{i % 5}") for i in range(300)] + [(7, None)] * 500
    df = spark.createDataFrame(rows, "id int, name string")
    order = sorted(rows, key=lambda r: plain_priority(3, r))
    for k, n in ((0, 1), (17, 7), (300, 2), (799, 1), (900, 3)):
        want = sorted(order[:k], key=repr)
        assert sorted(map(tuple, sampling.bottom_k(df.repartition(n), k, seed=3).collect()), key=repr) == want, (k, n)
    some = sampling.bottom_k(df, 40, seed=3, keys=["name"]).collect()
    assert len(some) == 40
    # mergeable
    low, high = df.where("id < 100"), df.where("id >= 100")
    both = sampling.bottom_k(low, 20, 3).unionAll(sampling.bottom_k(high, 20, 3))
    assert sorted(map(tuple, sampling.bottom_k(both, 20, 3).collect()), key=repr) == sorted(order[:20], key=repr)
    with pytest.raises(ValueError):
        sampling.bottom_k(df, -1)
    assert Audit(df, "x", as_of="2024-01-01", sample_rows=5).dataset.first().row_count == 5


def test_long_values_tie_by_their_texts(spark):
    opening = "one and the same opening " * 40                    # longer than two refinements
    texts = [opening + c for c in "fbadce"] + [opening[:45], opening[:45] + "!"] * 1 + ["zz"] * 2
    mixed = ["q" * 70 + "2"] * 3 + ["q" * 70 + "1"] * 3 + ["q" * 41] * 3 + ["q" * 41 + "a"] * 3
    rows = list(zip(texts, [opening + str(i % 7) for i in range(10)], (mixed[:10]), strict=True)) + [(None, "", m) for m in mixed[10:]]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = {(r.column_name, r["rank"]): (r.value, r.n) for r in Audit(df, "x", as_of="2024-01-01").categorical.collect()}
    for i, name in enumerate("abc"):
        counts = {}
        for r in rows:
            if r[i]:
                counts[r[i]] = counts.get(r[i], 0) + 1
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:3]
        assert [got[name, j] for j in (1, 2, 3)] == want, name


def test_formats(spark):
    rows = [(f"ORD{i:05d}", str(i * 37 % 1000) + "." + "9" * (i % 4), "é" if i % 2 else "x y") for i in range(500)]
    df = spark.createDataFrame(rows, "code string, amount string, text string").unionByName(
        spark.createDataFrame([(None, "", "B" * 500)], "code string, amount string, text string"))
    got = {(r.column_name, r.format): (r["values"], r.share) for r in formats(C.cells(df)).collect()}
    assert got["code", "A{3}9{5}"] == (500, 1.0) and got["text", "u"][0] == 250 and got["text", "a a"][0] == 250
    assert sum(n for (c, _), (n, _) in got.items() if c == "amount") == 500 and got["text", "A+"][0] == 1
    assert formats(C.cells(df.limit(0))).count() == 0


def test_check_digits(spark):
    df = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432"), ("4111111111111112", "GB83WEST12345698765432"),
                                ("0", "DE89370400440532013000")], "card string, iban string")
    got = df.select(E.luhn_valid(F.col("card")), E.iban_valid(F.col("iban"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, True)]
    assert df.select(E.luhn_digit(F.lit("411111111111111"))).first()[0] == "1"
    assert df.select(E.iban_digits(F.lit("GB"), F.lit("WEST12345698765432"))).first()[0] == "82"


def test_evidence_under_neutral_names(spark):
    rows = [("+1 555 0100 200", "a@b.example", "4111 1111 1111 1111", "078-05-1120", "hello"),
            ("+44 20 7946 0958", "none", "4111-1111-1111-1112", "x", None)]
    df = spark.createDataFrame(rows, "c1 string, c2 string, c3 string, c4 string, c5 string")
    got = {(r.column_name, r.kind): (r["values"], r.present_values, r.personal_data) for r in E.evidence(C.cells(df)).collect()}
    assert got == {("c1", "phone"): (2, 2, True), ("c2", "email"): (1, 2, True), ("c3", "card"): (1, 2, True),
                   ("c4", "national_id"): (1, 2, True)}
    assert not [r for r in E.evidence(C.cells(df), share=0.9).collect() if r.personal_data and r.column_name != "c1"]


def test_merged_states_equal_the_whole(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "", None, "long " * 30]), str(rng.random()) if i % 3 else "-4", f"u{rng.randrange(5000)}",
             dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(900))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, kind string, amount string, user string, day date")
    folder = work_folder(spark, "states")
    write_states(df.where("id < 3000"), folder, "x", F.col("id") % 3)
    for _ in range(2):                                             # written again: replaced
        write_states(df.where("id >= 3000"), folder, "x", "last")
    write_states(df.where("id < 10"), folder, "other", "last")
    history = spark.read.parquet(folder)
    assert history.where("dataset_name = 'x'").select("part").distinct().count() == 4
    got = {r.column_name: r for r in merged_profile(history, "x").collect()}
    a = Audit(df, "x", as_of="2024-01-01")
    numbers = {r.column_name: r for r in a.numeric.collect()}
    dates = {r.column_name: r for r in a.temporal.collect()}
    top = {}
    for r in a.categorical.orderBy("column_name", "rank").collect():
        top.setdefault(r.column_name, []).append((r.value, r.n))
    for c in a.columns.collect():
        g = got[c.column_name]
        assert (g.inferred_data_type, g.row_count, g.null_count, g.null_ratio) == (
            c.inferred_data_type, c.row_count, c.null_count, c.null_ratio)
        assert abs(g.distinct_estimate - c.unique_count) <= 5 * 1.04 / 2 ** (LG_K / 2) * c.unique_count + 1
        n = numbers.get(c.column_name)
        assert (g.numeric_count, g.min_value, g.max_value) == ((n.numeric_count, n.min_value, n.max_value) if n else (0, None, None))
        assert g.mean == n.mean if n and n.mean is not None else g.mean is None
    assert (got["day"].min_timestamp, got["day"].max_timestamp) == (dates["day"].min_timestamp, dates["day"].max_timestamp)
    assert [(t.value[:20], t.n) for t in got["kind"].top_values] == [(v[:20], n) for v, n in top["kind"]]


def test_dumps_round_trip_ranges_and_filters(spark):
    import tempfile

    from qualitas.sources import bson
    rows = [(i, f"é{i}" * (i % 50), i / 7 if i % 5 else None, i % 2 == 0, dt.datetime(2020, 1, 1, 0, 0, i % 60), [i, i + 1],
             (str(i), None), 1 << 40 | i) for i in range(3000)]
    ddl = "i int, s string, x double, b boolean, t timestamp_ntz, l array<int>, d struct<p: string, q: int>, big long"
    df = spark.createDataFrame(rows, ddl)
    folder = "file:" + tempfile.mkdtemp(prefix="qualitas-bson-")
    bson.write_bson(df.repartition(2), folder)
    for split in (20_000, 1 << 24):
        got = bson.read_bson(spark, folder, df.schema, split_bytes=split)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert bson.read_bson(spark, folder, df.schema, split_bytes=20_000).rdd.getNumPartitions() > 10
    some = bson.read_bson(spark, folder, T.StructType.fromDDL("big long, none string, s int"), equals={"b": True, "i": 4}).collect()
    assert [tuple(r) for r in some] == [(1 << 40 | 4, None, None)]
    with open(folder[5:] + "/cut.bson", "wb") as f:
        f.write(bson.document_bytes({"i": 1})[:-3])
    with pytest.raises(Exception, match="cut.bson"):
        bson.read_bson(spark, folder, df.schema).collect()
    raw = memoryview(bson.document_bytes({"a": {"b": [1, "x", None, b"\1"]}, "z": 2.5}))
    assert dict(bson.fields(raw)) == {"a": {"b": [1, "x", None, b"\1"]}, "z": 2.5}
    assert bson._decimal128(struct.pack("<QQ", 123, (6176 - 3) << 49)) == "0.123"
