"""URL filters: a sort-merge range join of urls with nested host rules.

A host is keyed by its labels in reverse, each ended by a dot (`www.example.net` is `net.example.www.`).  The hosts that
a rule covers, its host and all subdomains, are then the interval of keys that start with the rule's key.  Rules and urls
are range-partitioned and sorted together by that key, rules first; one pass over a partition keeps the rules whose
interval is open on a stack.  Intervals are nested, so a rule is popped as soon as a key no longer starts with its key.
Of the open rules the longest whose path starts the url's path wins.

Urls of one host are spread by a hash of page_id behind the key, so a host with a third of all rows fills many partitions.
What is open at the start of a partition comes from the earlier ones: a first pass over the sorted, checkpointed rows
gives for each partition its first key and the rules left open at its end, at most one per label of a host; only these go
through the driver.

Cases: null urls and urls without `://` have empty host and path and no rule; hosts and rule hosts are lower-cased (A-Z);
a rule with an empty host is ignored; of repeated rules `block` wins; of fitting rules of one length the longer host
wins; an empty table of pages gives no rows, an empty table of rules leaves every verdict to the default.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import ascii_lower, shared_root

DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Stack:
    """Open rules, outermost first: [key, host, {path: verdict}, path lengths from the longest]."""

    def __init__(self, levels=()):
        self.levels = [[k, h, dict(p), sorted({len(x) for x in p}, reverse=True)] for k, h, p in levels]

    def close(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append([key, host, {}, []])
        level = self.levels[-1]
        if level[2].get(path) != "block":
            level[2][path] = verdict
        if len(path) not in level[3]:
            level[3] = sorted([*level[3], len(path)], reverse=True)

    def best(self, path: str):
        """(rule, verdict) of the longest fitting rule, or (None, None)."""
        found, longest = (None, None), -1
        for _, host, paths, lengths in reversed(self.levels):
            for n in lengths:
                if n <= len(path) and len(host) + n > longest and path[:n] in paths:
                    found, longest = (host + path[:n], paths[path[:n]]), len(host) + n
                    break
        return found

    def dump(self):
        return [level[:3] for level in self.levels]


def _summaries(batches):
    """One row per partition: number, first key, rules open at its end."""
    first, stack = None, Stack()
    for b in batches:
        keys, is_url = b["key"].to_pylist(), b["is_url"].to_pylist()
        if first is None and keys:
            first = keys[0]
        hosts, paths, verdicts = (b[c].to_pylist() for c in ("host", "path", "verdict"))
        for i in range(len(keys)):
            if not is_url[i]:
                stack.open(keys[i], hosts[i], paths[i], verdicts[i])
        if keys:
            stack.close(keys[-1])
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([json.dumps(stack.dump())])], names=["part", "first", "left"],
        )


def _sweep(opened: dict[int, list], default: str):
    def run(batches):
        stack = Stack(opened.get(TaskContext.get().partitionId(), ()))
        for b in batches:
            keys, is_url, hosts, paths, verdicts, ids = (b[c].to_pylist() for c in ("key", "is_url", "host", "path", "verdict", "page_id"))
            out = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
            for i, key in enumerate(keys):
                if not is_url[i]:
                    stack.open(key, hosts[i], paths[i], verdicts[i])
                    continue
                stack.close(key)
                rule, verdict = stack.best(paths[i])
                for c, v in zip(out, (ids[i], hosts[i], paths[i], rule, verdict or default)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["page_id"], pa.int64()), *(pa.array(out[c], pa.string()) for c in ("host", "path", "rule", "verdict"))], names=list(out),
            )

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (null if none fits), verdict.  rules: host, path, verdict."""
    spark = pages.sparkSession
    urls = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        F.lit(None).cast("string").alias("verdict"), F.lit(True).alias("is_url"), F.xxhash64("page_id", "url").alias("spread"),
    )
    ruled = rules.select(
        F.lit(None).cast("long").alias("page_id"), ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        F.col("verdict"), F.lit(False).alias("is_url"), F.lit(0).cast("long").alias("spread"),
    ).filter("host IS NOT NULL AND host != ''")
    rows = urls.unionByName(ruled).withColumn("key", host_key(F.col("host")))
    rows = rows.repartitionByRange("key", "is_url", "spread").sortWithinPartitions("key", "is_url", "spread")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    rows = rows.checkpoint()
    parts = sorted(rows.mapInArrow(_summaries, "part int, first string, left string").collect())
    opened, stack = {}, Stack()
    for p in parts:
        stack.close(p["first"])
        opened[p["part"]] = stack.dump()
        for key, host, paths in json.loads(p["left"]):
            for path, verdict in paths.items():
                stack.open(key, host, path, verdict)
    return rows.mapInArrow(_sweep(opened, default), "page_id long, host string, path string, rule string, verdict string")
