"""URL filter by sorted digest arrays.

Entries (a host and the beginning of a path) are kept as sorted arrays of 64-bit digests, divided
by the top bits of the digest. A task maps one array into memory, probes it by vectorised binary
search with the keys a URL can match, and compares the stored string where digests agree, so two
strings of one digest are never taken for each other.

Keys are made distinct before they are shuffled and are spread by their digests, so a host that
has a third of all pages costs one set of keys. A null URL, or one without ``://``, has an empty
host and path and matches nothing. Repeated rows get a row each.
"""

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.let import let
from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored
from logtarn.llm.winnowing import LOWER, UPPER

SEED = 42  # of Spark's xxhash64, which divides entries and keys
#: Entries or keys per array, about.
ENTRIES = 1 << 15
LEAST_BITS = 6


def host_of(url: Column) -> Column:
    """From the first ``://`` up to a slash, question mark, hash or the end; A to Z lower-cased."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*+", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to a question mark, hash or the end."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*+([^?#]*+)", 1)


def _behind_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def keys_of(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """All strings an entry that fits this host and path can be: each domain it lies in, with the
    beginning of the path at each length that entries have. No entry's host has more than
    ``most_labels`` labels, so longer domains are not made: the work for a host of any number of
    labels is that of reading it."""
    labels = F.split(host, r"\.", -1)
    tail = F.slice(labels, F.greatest(F.size(labels) - most_labels + 1, F.lit(1)), F.lit(most_labels))
    domains = let(tail, lambda tail: F.transform(
        tail, lambda _, i: F.array_join(F.slice(tail, i + 1, F.size(tail)), ".")
    ))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(
        F.transform(
            domains, lambda d: F.transform(starts, lambda n: F.concat(d, F.substring(path, F.lit(1), n)))
        )
    )
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def _shard(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def digest_arrays(entries: DataFrame, bits: int) -> DataFrame:
    """A row per shard: digests in order, and the strings and actions in the same order."""

    def build(entries: pa.Table) -> pa.Table:
        keys = entries["key"].to_pylist()
        digests = np.array([xxhash.xxh64_intdigest(k.encode(), SEED) for k in keys], np.uint64)
        order = np.argsort(digests, kind="stable")
        return pa.table({
            "shard": entries["shard"][:1],
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "keys": pa.array([[keys[i] for i in order]], pa.list_(pa.string())),
            "actions": pa.array([entries["action"].take(order).to_pylist()], pa.list_(pa.string())),
        })

    return (
        entries.withColumn("shard", _shard(F.col("key"), bits)).groupBy("shard")
        .applyInArrow(build, "shard long, digests binary, keys array<string>, actions array<string>")
    )


def probe(keys: DataFrame, arrays: DataFrame, bits: int) -> DataFrame:
    """``key`` and ``action`` of the keys that are in the arrays."""

    def search(keys: pa.Table, array: pa.Table) -> pa.Table:
        found_keys, found_actions = [], []
        if keys.num_rows and array.num_rows:
            words = keys["key"].to_pylist()
            wanted = np.array([xxhash.xxh64_intdigest(k.encode(), SEED) for k in words], np.uint64)
            stored_keys = array["keys"][0].as_py()
            actions = array["actions"][0].as_py()
            with tempfile.TemporaryFile() as file:
                file.write(array["digests"][0].as_py())
                file.flush()
                digests = np.memmap(file, np.uint64, "r")
                left = np.searchsorted(digests, wanted, "left")
                right = np.searchsorted(digests, wanted, "right")
                del digests
            for i in np.flatnonzero(right > left).tolist():
                for at in range(left[i], right[i]):
                    if stored_keys[at] == words[i]:
                        found_keys.append(words[i])
                        found_actions.append(actions[at])
        return pa.table({
            "key": pa.array(found_keys, pa.string()), "action": pa.array(found_actions, pa.string())
        })

    sharded = keys.withColumn("shard", _shard(F.col("key"), bits)).groupBy("shard")
    return sharded.cogroup(arrays.groupBy("shard")).applyInArrow(search, "key string, action string")


def judged(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path`` and ``matches``, the entries (key, action) that fit.

    ``entries`` has ``key``, a host with the beginning of a path, ``path_length`` and ``action``.
    An entry fits its host and all below it if the path starts with its own.
    """
    entries = stored(entries.select("key", "path_length", "action").distinct(), "entries")
    lengths = [r.path_length for r in entries.select("path_length").distinct().collect()]
    entry_host = F.substring("key", F.lit(1), F.length("key") - F.col("path_length"))
    most_labels = entries.agg(F.max(F.size(F.split(entry_host, r"\.", -1)))).first()[0] or 0
    located = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    places = stored(located.select("host", "path").distinct(), "places")
    with_keys = places.select("host", "path", F.explode(keys_of(F.col("host"), F.col("path"), lengths, most_labels)).alias("key"))
    keys = stored(with_keys.select("key").distinct(), "keys")
    most = max(keys.count(), entries.count())
    bits = max(LEAST_BITS, (most // ENTRIES).bit_length())
    arrays = stored(digest_arrays(entries, bits), "digest-arrays")
    hits = stored(probe(keys, arrays, bits), "hits")
    matches = (
        with_keys.join(hits, "key").groupBy("host", "path")
        .agg(F.sort_array(F.collect_set(F.struct("key", "action"))).alias("matches"))
    )
    return located.join(matches, ["host", "path"], "left").select(
        "page_id", "host", "path",
        F.coalesce("matches", F.array().cast("array<struct<key:string,action:string>>")).alias("matches"),
    )


#: Host, path and action of the fixed rules of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: A host is listed if one of its labels begins like this.
LISTED = r"(^|\.)(adult|casino|malware|phish|spam)"


@registered(f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
ruled AS (
  SELECT s.page_id, s.host, s.path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM split s LEFT JOIN (VALUES
    {", ".join(f"('{h}', '{p}', '{h}{p}', '{a}')" for h, p, a in RULES)}) AS v(h, p, rule, action)
  ON (s.host = v.h OR ends_with(s.host, '.' || v.h)) AND starts_with(s.path, v.p)
  GROUP BY ALL)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN regexp_matches(host, '{LISTED}') THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
""")
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL: the longest rule's, else whether its host is on the list.

    The list is what a feed of bad hosts would hold, here all hosts of the pages with a telling
    label; it is matched like the rules, as entries of the same digest arrays.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = host_of(F.col("url"))
    listed = pages.where(host.rlike(LISTED)).select(
        host.alias("key"), F.lit(0).alias("path_length"), F.lit("listed").alias("action")
    )
    rules = spark.createDataFrame(
        pd.DataFrame([(h + p, len(p), a) for h, p, a in RULES], columns=["key", "path_length", "action"])
    ).select("key", F.col("path_length").cast("int").alias("path_length"), "action")
    found = judged(pages, rules.union(listed.distinct()))
    rules_only = F.filter("matches", lambda m: m["action"] != "listed")
    longest = F.array_max(
        F.transform(rules_only, lambda m: F.struct(F.length(m["key"]), m["key"], m["action"]))
    )
    listed_here = F.exists("matches", lambda m: m["action"] == "listed")
    return found.select(
        "page_id", "host", "path",
        longest["key"].alias("rule"),
        F.coalesce(longest["action"], F.when(listed_here, "block").otherwise("allow")).alias("verdict"),
    )
