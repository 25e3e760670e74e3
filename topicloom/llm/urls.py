"""URL filters held as cascades of Bloom filters.

The rules of a list are keys: a host and the beginning of a path. Every URL has
the keys that could match it: its host and the domains above it, each with the
beginnings of its path, at the lengths that occur among the rules. Level 1 of a
cascade encodes the listed keys; level 2 encodes those keys of the whole corpus
that level 1 takes for listed but are not; level 3 the listed keys that level 2
takes for false positives; and so on until a level has none. For the keys of
that corpus the answer is then exact and needs no join with the list.

One cascade holds the blocking rules, one the allowing ones; the longest
matching key (host first, then path) decides, and a URL without one is allowed.

Nulls: a null URL, or one without ``://``, has an empty host and path and
matches no rule. Rules with a null host or path are ignored, repeated rules
count once; a key listed for both is blocked. Repeated page rows are each
judged. An empty table or list gives an empty result, or no match. Other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: bits of one level at most; a list that needs more raises an error
MAX_BITS = 1 << 28
HASHES = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path (without query and fragment)."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys that could match, longest first. ``labels``, ``lengths``: of the listed hosts and paths."""
    depth = F.size(F.split(host, r"\.", -1))
    found = [
        F.when((depth >= k) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k in sorted(labels, reverse=True)
        for n in sorted(lengths, reverse=True)
    ]
    return F.filter(F.array(*found), lambda k: k.isNotNull()) if found else F.array().cast("array<string>")


@dataclass
class Level:
    """A Bloom filter: its words in a table of one row, its bits and its seed."""

    words: DataFrame
    bits: int
    seed: int

    def holds(self, words: Column, key: Column) -> Column:
        bits = positions(key, self.bits, self.seed)
        return F.forall(bits, lambda b: F.getbit(F.element_at(words, (F.shiftright(b, 6) + 1).cast("int")), (b % 64).cast("int")) == 1)


def positions(key: Column, bits: int, seed: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits)) for i in range(HASHES)])


def bloom(keys: DataFrame, count: int, seed: int, bits_per_key: float) -> Level:
    """The filter of the keys, sized by their number; ``MAX_BITS`` bounds what travels to the tasks."""
    bits = max(64, 1 << math.ceil(math.log2(max(1.0, count * bits_per_key))))
    if bits > MAX_BITS:
        raise ValueError(f"{count} keys need a filter of {bits} bits; more than {MAX_BITS} are not sent to the tasks")
    marks = keys.select(F.explode(positions(F.col("key"), bits, seed)).alias("_bit"))
    words = marks.groupBy(F.shiftright("_bit", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_bit % 64 AS INT))")).alias("_word"))
    filled = keys.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("_word", F.lit(0).cast("long")).alias("_word"))
    row = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_word"))), lambda x: x["_word"]).alias("words"))
    return Level(stage(row), bits, seed)


class Cascade:
    """Exact membership among the listed keys, for all keys of the corpus it was built over."""

    def __init__(self, listed: DataFrame, corpus: DataFrame, key_array: str, bits_per_key: float = 6.0, seed: int = 1):
        """``listed``: key; ``corpus``: rows with an array of keys."""
        self.levels: list[Level] = []
        inside = stage(listed.filter(F.col("key").isNotNull()).select("key").distinct())
        n_in = inside.count()
        if not n_in:
            return
        self._add(inside, n_in, bits_per_key, seed)
        passed = self._passing(corpus, 0, key_array).distinct()
        outside = stage(passed.join(inside, "key", "left_anti"))
        while n_out := outside.count():
            rows, held, wider = inside.select(F.array("key").alias(key_array)), n_in, bits_per_key
            while True:  # a level that passes over half of the keys it is asked about is built again with more bits
                self._add(outside, n_out, wider, seed)
                again = stage(self._passing(rows, len(self.levels) - 1, key_array))
                if 2 * again.count() <= held:
                    break
                self.levels.pop()
                wider *= 2
            inside, outside, n_in = outside, again, n_out

    def _add(self, keys: DataFrame, count: int, bits_per_key: float, seed: int) -> None:
        self.levels.append(bloom(keys, count, seed + len(self.levels), bits_per_key))

    def _passing(self, rows: DataFrame, level: int, key_array: str) -> DataFrame:
        """The keys of the rows that a level takes for its own."""
        at = self.levels[level]
        rows = rows.withColumn("_words", at.words.scalar())
        return rows.select(F.explode(F.filter(key_array, lambda k: at.holds(F.col("_words"), k))).alias("key"))

    def attach(self, rows: DataFrame, prefix: str) -> DataFrame:
        """The rows with the levels' words as columns, for :meth:`contains`."""
        return rows.withColumns({f"{prefix}{i}": level.words.scalar() for i, level in enumerate(self.levels)})

    def contains(self, prefix: str, key: Column) -> Column:
        answer = None
        for i in reversed(range(len(self.levels))):
            here = self.levels[i].holds(F.col(f"{prefix}{i}"), key)
            answer = here if answer is None else here & ~answer
        return F.lit(False) if answer is None else answer


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of all ``pages`` (page_id, url) under ``rules`` (host, path, verdict)."""
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        ascii_lower(F.col("host")).alias("host"), "path", "verdict"
    )
    labels = [r[0] for r in rules.select(F.size(F.split("host", r"\.", -1)).alias("n")).distinct().collect()]  # depths of host names
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect()]  # lengths of paths
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("_keys", keys_of(F.col("host"), F.col("path"), labels, lengths))
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    block = Cascade(listed.filter("verdict = 'block'"), keyed, "_keys", seed=100)
    allow = Cascade(listed.filter("verdict = 'allow'"), keyed, "_keys", seed=200)
    rows = allow.attach(block.attach(keyed, "_block"), "_allow")
    hit = F.filter("_keys", lambda k: block.contains("_block", k) | allow.contains("_allow", k))
    judged = rows.withColumn("rule", F.try_element_at(hit, F.lit(1)))
    blocked = F.col("rule").isNotNull() & block.contains("_block", F.col("rule"))
    return judged.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))
