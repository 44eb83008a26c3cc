"""URL verdicts by a sort-merge range join of urls with nested host rules.

A host becomes its labels in reverse, each closed by a dot (``www.example.com`` is
``com.example.www.``). All hosts below a rule's host then lie in one interval that starts at the
rule's key, and intervals nest or are disjoint. Urls and rules are dealt to ranges of that key;
a rule goes to every range its interval meets. Each range is swept once in key order with a stack
of the rules whose interval is open, so a task holds the rules around its current url only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.shared import named, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "page_id long, host string, path string, rule string, verdict string"
#: Sampled keys per range when the ranges are chosen; they only decide how evenly ranges are filled.
SAMPLED_PER_RANGE = 50


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://`` or for null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


class OpenRules:
    """The stack of a sweep: rules whose host interval holds the current key, outermost first."""

    def __init__(self) -> None:
        self.keys: list[str] = []
        self.paths: list[dict[str, tuple[str, str]]] = []
        self.sizes: list[list[int]] = []

    def close_for(self, key: str) -> None:
        while self.keys and not key.startswith(self.keys[-1]):
            self.keys.pop()
            self.paths.pop()
            self.sizes.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close_for(key)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
            self.paths.append({})
            self.sizes.append([])
        known = self.paths[-1].get(path)
        if known is None or verdict == "block":  # of equal rules, the one that blocks
            self.paths[-1][path] = (rule, verdict)
            self.sizes[-1] = sorted({len(p) for p in self.paths[-1]}, reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        best = None
        for paths, sizes in zip(reversed(self.paths), reversed(self.sizes)):
            got = next((paths[path[:n]] for n in sizes if n <= len(path) and path[:n] in paths), None)
            if got and (best is None or len(got[0]) > len(best[0])):
                best = got
        return best


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow",
                 id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: ``page_id``, ``host``, ``path``, the longest fitting ``rule`` and its ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains if
    the url's path starts with the rule's path; of fitting rules the one with the longest host
    and path wins, the deeper host on equal length, ``block`` among equal rules. Urls that no
    rule fits get ``default``. Null urls have an empty host and path. A rule without host is
    ignored; a null path counts as empty. Repeated pages give repeated rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", "page_id", "host",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    lowered = F.translate("host", UPPER, LOWER)
    ordered_rules = rules.where("host is not null").select(lowered.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").select(
        host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "path", F.lit(None).cast("long").alias("page_id"), "host",
        F.concat("host", "path").alias("rule"), "verdict")

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(1, pages.count()))
    drawn = sorted((r["key"], r["path"], r["page_id"] or 0) for r in
                   urls.select("key", "path", "page_id").sample(share, seed=5).toLocalIterator())
    # ids belong to the cuts, so that one url that a third of all pages have is split as well
    cuts = sorted(set(drawn[i * len(drawn) // ranges] for i in range(1, ranges))) if drawn else []
    cut_keys = [c[0] for c in cuts]
    schema = "part int, key string, kind int, path string, page_id long, host string, rule string, verdict string"
    names = [f.split()[0] for f in schema.split(", ")]

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), batch.column("page_id").to_pylist())
            parts = pa.array([bisect_right(cuts, (k, p, i or 0)) for k, p, i in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([parts, *batch.columns], names)

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], []
            for row, key in enumerate(batch.column("key").to_pylist()):
                first = bisect_left(cut_keys, key)
                last = bisect_right(cut_keys, key + "\U0010ffff")
                parts += range(first, last + 1)
                rows += [row] * (last + 1 - first)
            taken = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *taken.columns], names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = OpenRules()
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in names[1:]]
            for key, kind, path, page_id, host, rule, verdict in zip(*columns, strict=True):
                if kind == 0:
                    stack.open(key, path, rule, verdict)
                else:
                    stack.close_for(key)
                    found.append((page_id, host, path, *(stack.longest(path) or (None, default))))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64(), *[pa.string()] * 4], strict=True)],
                    ["page_id", "host", "path", "rule", "verdict"])

    both = urls.mapInArrow(deal_urls, schema).unionByName(ordered_rules.mapInArrow(deal_rules, schema))
    return both.repartitionById(ranges, F.col("part")).sortWithinPartitions("key", "kind").mapInArrow(sweep, RESULT)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
urls AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
rules(rule_host, rule_path, verdict) AS (VALUES {values}),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM urls JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id AND f.place = 1"""


@named("op7_url_rules", _sql())
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages by five rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)
