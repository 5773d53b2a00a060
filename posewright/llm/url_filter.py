"""URL filter rules in a sorted array of digests.

A rule is a host and a path prefix, written ``host/path``; it fits its host and all subdomains. The
64-bit XXH64 digests of the rules, sorted, and the rules' full strings are two files that Spark ships to
every executor, where they are memory-mapped. A URL's candidate rules are its host's suffixes with the
prefixes of its path that have the length of some rule's path; their digests are probed by binary search
for a whole batch at once, and a hit counts only if the stored string is the same.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_root, stage

#: Rules of the registered query, in the order given.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A file of more rules than this (about 100 bytes each) is refused; ``url_filter_by_join`` takes lists of any size.
MAX_RULES = 50_000_000
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


class Rules:
    """The sorted digests, verdicts and strings of a rule list, as memory-mapped files in one folder."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, strings: np.ndarray, block: np.ndarray, sizes: tuple[int, ...]):
        self.keys, self.at, self.strings, self.block, self.sizes = keys, at, strings, block, sizes

    @classmethod
    def build(cls, rules: Sequence[tuple[str, str]]) -> tuple[bytes, Rules]:
        """File contents and the rules in it. Of repeated rules the last counts."""
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        verdict = {}
        for what, text in rules:
            host, slash, path = text.partition("/")
            verdict[host.encode().lower() + (slash + path).encode()] = what == BLOCK
        texts = sorted(verdict, key=lambda t: (xxhash.xxh64_intdigest(t), t))
        keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], "<u8")
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
        block = np.array([verdict[t] for t in texts], np.uint8)
        sizes = sorted({len(t) - t.index(b"/") if b"/" in t else 0 for t in texts})
        head = np.array([len(texts), len(sizes), *sizes], "<i8").tobytes()
        return head + keys.tobytes() + at.tobytes() + block.tobytes() + b"".join(texts), cls(
            keys, at, np.frombuffer(b"".join(texts), np.uint8), block, tuple(sizes))

    @classmethod
    def load(cls, path: str) -> Rules:
        n, m = (int(x) for x in np.memmap(path, "<i8", "r", 0, 2))
        sizes = tuple(int(x) for x in np.memmap(path, "<i8", "r", 16, m)) if m else ()
        a = 16 + 8 * m
        part = lambda kind, size, pos: np.memmap(path, kind, "r", pos, size) if size else np.zeros(0, kind)
        at = part("<i8", n + 1, a + 8 * n)
        return cls(part("<u8", n, a), at, part(np.uint8, int(at[-1]), a + 16 * n + 8 + n), part(np.uint8, n, a + 16 * n + 8), sizes)

    def string(self, k: int) -> bytes:
        return self.strings[int(self.at[k]):int(self.at[k + 1])].tobytes()

    def find(self, texts: list[bytes]) -> np.ndarray:
        """Index of each text among the rules, or -1: one binary search for all, then the strings decide."""
        if not len(self.keys) or not texts:
            return np.full(len(texts), -1)
        probe = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        k = np.searchsorted(self.keys, probe)
        out = np.full(len(texts), -1)
        for i in np.flatnonzero(self.keys[np.minimum(k, len(self.keys) - 1)] == probe).tolist():
            j = int(k[i])
            while j < len(self.keys) and self.keys[j] == probe[i]:
                if self.string(j) == texts[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def candidates(self, host: str, path: str) -> list[bytes]:
        """Rules that would fit, longest first."""
        labels, whole = host.split("."), path.encode()
        hosts = [".".join(labels[k:]).encode() for k in range(len(labels))]
        return sorted({h + whole[:n] for h in hosts for n in self.sizes if n <= len(whole)}, key=lambda t: (-len(t), t))

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The longest rule that fits each URL and its verdict; without one, the URL is in no list and allowed."""
        each = [self.candidates(h, p) for h, p in zip(hosts, paths, strict=True)]
        found = self.find([c for cs in each for c in cs])
        rules, verdicts, k = [], [], 0
        for cs in each:
            hit = next((int(i) for i in found[k:k + len(cs)] if i >= 0), -1)
            k += len(cs)
            rules.append(self.string(hit).decode() if hit >= 0 else None)
            verdicts.append(BLOCK if hit >= 0 and self.block[hit] else ALLOW)
        return rules, verdicts


def ship(spark: SparkSession, data: bytes) -> str:
    """Write a file to the shared folder, have Spark copy it to every executor, and return its name there."""
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.bin"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``; only ``page_id`` and ``url`` are read.

    A null or relative URL has empty host and path, and no rule. Rules of one length are one rule, since
    a URL has one host suffix and path prefix of each length; rows repeat as they do in the input.
    """
    spark = pages.sparkSession
    name = ship(spark, Rules.build(rules)[0])

    def run(batches):
        mapped = Rules.load(os.path.join(SparkFiles.getRootDirectory(), name))
        for b in batches:
            rule, verdict = mapped.judge(b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.record_batch([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()),
                                   pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def url_filter_by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules ``what, text`` of any size: candidates and rules meet by their digests.

    A URL has a candidate for each host suffix and each length that some rule's path has; the lengths are
    few. The string decides after the digest, and the longest rule of a URL is found by grouping.
    """
    slash = F.instr("text", "/")
    listed = rules.select("what", F.when(slash > 0, F.concat(lower(F.substring_index("text", "/", 1)), F.expr("substring(text, instr(text, '/'))")))
                          .otherwise(lower(F.col("text"))).alias("text")).dropDuplicates(["text"])
    lengths = sorted(r[0] for r in listed.select(F.when(F.instr("text", "/") > 0, F.length("text") - F.instr("text", "/") + 1).otherwise(0)).distinct().collect())
    rows = stage(pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
                 .withColumn("rid", F.monotonically_increasing_id()), "url-rows")
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    cuts = F.filter(F.array(*map(F.lit, lengths or [0])), lambda n: n <= F.length("path"))
    each = rows.select("rid", "path", F.explode(hosts).alias("h"), cuts.alias("cuts")).select("rid", "h", "path", F.explode("cuts").alias("n"))
    candidates = each.select("rid", F.concat("h", F.expr("substring(path, 1, n)")).alias("candidate")).withColumn("digest", F.xxhash64("candidate"))
    met = candidates.join(listed.withColumn("digest", F.xxhash64("text")), "digest").where("candidate = text")
    best = met.groupBy("rid").agg(F.max_by(F.struct("text", "what"), F.struct(F.octet_length("text"), "text")).alias("b")).select(
        "rid", F.col("b.text").alias("rule"), F.col("b.what").alias("verdict"))
    return rows.join(best, "rid", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"))


def _oracle() -> str:
    listed = ", ".join(f"('{what}', '{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}')" for what, text in RULES)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM u),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rn FROM rest),
rules(verdict, rule, rule_host, rule_path) AS (VALUES {listed}),
fit AS (SELECT p.rn, r.rule, r.verdict, row_number() OVER (PARTITION BY p.rn ORDER BY length(r.rule) DESC) AS k
        FROM parts p JOIN rules r ON (p.host = r.rule_host OR p.host LIKE '%.' || r.rule_host) AND starts_with(p.path, r.rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON p.rn = f.rn AND f.k = 1
"""


ORACLE_SQL = _oracle()
