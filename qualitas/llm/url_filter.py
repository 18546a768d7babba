"""Operator 8: URL filter rules in a sorted digest array.

A rule list is a table ``host, path, verdict``.  :func:`build` writes it as an index of flat files below the
shared folder: 64-bit xxhash keys in ascending order, the rules' full strings behind them, their offsets and
verdicts.  Executors memory-map these files; a list of any length costs a task only the pages that it touches.

:func:`judge` derives from every URL the strings that could be rules for it (each suffix of the host that starts
at a label, with each prefix of the path whose length occurs in the list), probes all their digests with one
vectorised binary search per batch, and confirms each hit by comparing the stored string, walking on over equal
digests, so that a collision never decides.  The longest confirmed rule gives the verdict; a URL that no rule
fits gets ``default``, which is "allow" for a list of exceptions.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case.  Path: from there up to
``?``, ``#`` or the end.  Null URLs and URLs without ``://`` have an empty host and path and fit no rule.  Rules without
a host, or with a path that doesn't start with ``/``, are refused; of rules of one length the one with the longer host
wins; equal rules with different verdicts count as "block".  Rows are judged one by
one, so repeated rows and other columns don't matter, but for input columns named ``host``, ``path``, ``rule`` and
``verdict``, which the results of these names replace; empty tables give empty results.
"""
from __future__ import annotations

import functools
import json
import mmap
import os
import re
import string
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.llm.token_files import local_path

_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
LOWER = (string.ascii_uppercase, string.ascii_lowercase)
_LOWER = str.maketrans(*LOWER)
KEY = np.dtype("<i8")
#: Digests looked up at once.
PROBES = 1 << 18


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    found = _SPLIT.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def digest(rule: bytes) -> int:
    """The signed 64-bit xxhash that Spark's ``xxhash64`` gives for the string."""
    return xxhash.xxh64_intdigest(rule, 42)


def build(rules: DataFrame, folder: str) -> str:
    """Write the index of ``rules`` (``host, path, verdict``) into ``folder`` and return it.

    The rules are sorted by digest in ranges; each task writes one range as a shard of files.
    """
    spark, local = rules.sparkSession, local_path(folder)
    schema = pa.schema([("part", pa.int32()), ("rules", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def write(batches):
        part, keys, strings, blocks, lengths = TaskContext.get().partitionId(), [], [], [], set()
        for b in batches:
            keys += b["key"].to_pylist()
            strings += [r.encode() for r in b["rule"].to_pylist()]
            blocks += [v == "block" for v in b["verdict"].to_pylist()]
            lengths.update(b["path_length"].to_pylist())
        if not keys:
            return
        os.makedirs(local, exist_ok=True)
        arrays = {"key": np.array(keys, KEY).tobytes(), "str": b"".join(strings),
                  "off": np.cumsum([0, *map(len, strings)]).astype(KEY).tobytes(), "say": bytes(blocks)}
        for kind, data in arrays.items():
            mine = f"{local}/.{part}-{uuid.uuid4().hex}"
            with open(mine, "wb") as f:
                f.write(data)
            os.replace(mine, f"{local}/{part:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "rules": [len(keys)], "lengths": [sorted(lengths)]},
                                         schema=schema)

    host = F.translate(F.coalesce("host", F.lit("")), *LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    fit = (host != "") & ((path == "") | path.startswith("/"))
    rule = F.when(fit, F.concat(host, path)).otherwise(F.raise_error(F.lit("a rule needs a host and a path from / on")))
    parts = (rules.select(rule.alias("rule"), "verdict", F.length(path).cast("long").alias("path_length")).distinct()
             .withColumn("key", F.xxhash64("rule"))
             .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
             .sortWithinPartitions("key", "rule", "verdict")
             .mapInArrow(write, "part int, rules long, lengths array<long>").collect())       # a row for each shard
    about = {"parts": sorted(r["part"] for r in parts), "lengths": sorted({n for r in parts for n in r["lengths"]})}
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/index.json", "w") as f:
        json.dump(about, f)
    return folder


class Index:
    """A memory-mapped rule index."""

    def __init__(self, folder: str):
        local = local_path(folder)
        with open(f"{local}/index.json") as f:
            about = json.load(f)
        self.lengths = about["lengths"]
        self.shards = []
        for part in about["parts"]:
            path = f"{local}/{part:06d}"
            with open(f"{path}.str", "rb") as f:
                strings = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            self.shards.append((np.memmap(f"{path}.key", KEY, "r"), np.memmap(f"{path}.off", KEY, "r"), strings,
                                np.memmap(f"{path}.say", np.uint8, "r")))
        self.firsts = np.array([keys[0] for keys, *_ in self.shards], KEY)

    def find(self, candidates: list[str]) -> list[tuple[bool, bool]]:
        """For each string: whether it is a rule, and whether that rule blocks."""
        raw = [c.encode() for c in candidates]
        wanted = np.fromiter(map(digest, raw), np.uint64, len(raw)).view(KEY)
        said = [(False, False)] * len(raw)
        shard_of = np.searchsorted(self.firsts, wanted, "right") - 1
        for s in np.unique(shard_of[shard_of >= 0]).tolist():
            keys, offsets, strings, verdicts = self.shards[s]
            own = np.flatnonzero(shard_of == s)
            at = np.searchsorted(keys, wanted[own], "left")
            inside = np.flatnonzero(at < len(keys))
            hits = inside[keys[at[inside]] == wanted[own[inside]]]
            for k in hits.tolist():
                i, j = int(own[k]), int(at[k])
                while j < len(keys) and keys[j] == wanted[i]:        # equal digests: the string decides
                    if strings[offsets[j]:offsets[j + 1]] == raw[i]:
                        said[i] = (True, said[i][1] or bool(verdicts[j]))
                    j += 1
        return said

    def candidates(self, host: str, path: str) -> list[str]:
        """The strings that could be rules for a host and path, longest first."""
        if not host:
            return []
        labels = host.split(".")
        hosts = [".".join(labels[i:]) for i in range(len(labels))]
        return sorted((h + path[:n] for h in hosts if h for n in self.lengths if n <= len(path)),
                      key=len, reverse=True)


@functools.cache
def index(folder: str) -> Index:
    return Index(folder)


def judge(urls: DataFrame, folder: str, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict`` by the index in ``folder``."""
    kept = [f for f in urls.schema.fields if f.name not in ("host", "path", "rule", "verdict")]

    def verdicts(batches):
        rules = index(folder)
        for batch in batches:
            parts = [parts_of(u) for u in batch[url_col].to_pylist()]
            rule, verdict = [None] * len(parts), [default] * len(parts)
            start = 0
            while start < len(parts):
                probes = []
                while start < len(parts) and len(probes) < PROBES:
                    probes += [(start, c) for c in rules.candidates(*parts[start])]
                    start += 1
                for (i, c), (is_rule, blocks) in zip(probes, rules.find([c for _, c in probes]), strict=True):
                    if is_rule and rule[i] is None:                 # the longest comes first
                        rule[i], verdict[i] = c, "block" if blocks else "allow"
            out = batch.select([f.name for f in kept])
            for name, values in (("host", [h for h, _ in parts]), ("path", [p for _, p in parts]), ("rule", rule),
                                 ("verdict", verdict)):
                out = out.append_column(name, pa.array(values, pa.string()))
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return (urls.select(*[F.col(f"`{f.name}`") for f in kept])
            .mapInArrow(verdicts, f"{schema}, host string, path string, rule string, verdict string"))
