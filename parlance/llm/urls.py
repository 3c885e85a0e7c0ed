"""URL filters over a sorted digest array.

Rules are (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's. All rule keys
("host/path") are digested by 64-bit XXH64 and stored sorted, with the full strings behind them, in one file in the shared folder; every
executor fetches it once (Spark's file distribution, so a lost executor's successor fetches it again) and memory-maps it. A url's candidates
are the suffixes of its host and prefixes of its path of such lengths as some rule has, so a url costs no more for being long; they are probed
all together by vectorised binary search, and a hit counts only once the stored full string equals the candidate. The longest rule wins; with
no rule, the url is allowed.

Null urls and urls without "://" have empty host and path. Empty urls, repeated rows and very long urls are rows like others. An empty table
gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, shared_dir

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    return (rest[:end] if slash < 0 else rest[:slash]).translate(_UPPER), "" if slash < 0 else rest[slash:end]


def _key(host: str, path: str) -> bytes:
    return f"{host}{path}".encode()


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """The digest array file: count, keys in order, string offsets, verdicts, host lengths, strings."""
    rows = sorted({(xxhash.xxh64_intdigest(_key(h, p)), _key(h, p), v == "block", len(h.encode())) for v, h, p in rules})
    strings = [r[1] for r in rows]
    offsets = np.cumsum([0, *map(len, strings)])
    parts = [np.array([len(rows)], np.uint64), np.array([r[0] for r in rows], np.uint64), offsets.astype(np.uint64), np.array([r[2] for r in rows], np.uint64), np.array([r[3] for r in rows], np.uint64)]
    return b"".join(x.tobytes() for x in parts) + b"".join(strings)


class DigestArray:
    """The memory-mapped file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view(np.uint64)[0])
        cut = 8 + 8 * np.cumsum([0, n, n + 1, n, n])
        self.keys, self.offsets, self.blocks, self.hosts = (whole[a:b].view(np.uint64) for a, b in zip(cut, cut[1:]))
        self.strings = whole[cut[-1] :]
        sizes = np.unique(np.stack([self.hosts, np.diff(self.offsets) - self.hosts], axis=1), axis=0) if n else np.zeros((0, 2), np.uint64)
        self.sizes = [(int(a), int(b)) for a, b in sizes]  # of host and path

    def string(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Index of each candidate's entry, or -1."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        out = np.full(len(candidates), -1)
        at = np.searchsorted(self.keys, digests)
        while True:  # entries of one digest stand side by side; walk them until a string is equal
            open_ = np.flatnonzero((out < 0) & (at < len(self.keys)))
            open_ = open_[self.keys[at[open_]] == digests[open_]]
            if not len(open_):
                return out
            for i in open_.tolist():
                if self.string(at[i]) == candidates[i]:
                    out[i] = at[i]
            at[open_] += 1

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
        """Rule and verdict of each (host, path)."""
        candidates, owner = [], []
        for i, (host, path) in enumerate(urls):
            raw, whole = path.encode(), host.encode()
            for h, n in self.sizes:
                if n <= len(raw) and (h == len(whole) or h < len(whole) and whole[-h - 1] == 0x2E):
                    candidates.append(whole[len(whole) - h :] + raw[:n])
                    owner.append((i, h))
        best: dict[int, tuple[int, int]] = {}
        for (i, host_bytes), at in zip(owner, self.probe(candidates).tolist()):
            if at >= 0 and self.hosts[at] == host_bytes:
                best[i] = max(best.get(i, (-1, -1)), (int(self.offsets[at + 1] - self.offsets[at]), at))
        return [(None, "allow") if i not in best else (self.string(best[i][1]).decode(), "block" if self.blocks[best[i][1]] else "allow") for i in range(len(urls))]


_open: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    if name not in _open:
        _open.clear()
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


#: Files that were distributed, by application; equal rules are one file.
_published: set[tuple[str, str]] = set()


def publish(spark: SparkSession, rules) -> str:
    """Write the digest array to the shared folder and have Spark distribute it, once for equal rules; its file name."""
    data = pack(list(rules))
    name, context = f"url-rules-{xxhash.xxh3_128_hexdigest(data)}.bin", spark.sparkContext.applicationId
    if (context, name) in _published:
        return name
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    _published.add((context, name))
    return name


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    name = publish(pages.sparkSession, rules)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        urls = [split_url(u) for u in b.column(1).to_pylist()]
        judged = _array(name).judge(urls)
        text = pa.string()
        return pa.record_batch([b.column(0), pa.array([u[0] for u in urls], text), pa.array([u[1] for u in urls], text), pa.array([j[0] for j in judged], text), pa.array([j[1] for j in judged], text)], ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[id_col]
    return arrow_map(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), run, f"page_id {kind}, host string, path string, rule string, verdict string")


#: The same verdicts in DuckDB SQL.
ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""
