"""URL verdicts by longest match in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared

#: Rules that one broadcast trie holds (about 100 MB); a longer list is matched in turns.
MAX_RULES = 1_000_000
Rule = tuple[str, str, str]

_URL = r"(?s)^.*?://"


def url_parts(url) -> tuple:
    """Host and path: what follows the first `://` up to `/ ? #`, A-Z lower-cased; then up to `? #`. Both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, _URL, "")).otherwise("")
    raw = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts: host labels from the last to the first, then `/`-ended path segments, then rules by what begins a segment.

    A rule fits its host and every subdomain, and every path that starts with the rule's path.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else []:
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault("//", {})
            # Of two equal rules block wins.
            if verdict == "block" or last not in ends:
                ends[last] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and text of the longest rule that fits, counted over host and path; of equally long ones that of the most host labels."""
        nodes = [self.root]
        for label in reversed(host.split(".")) if host else []:
            if (node := nodes[-1].get(label)) is None:
                break
            nodes.append(node)
        segments = path.split("/")
        best = None
        for node in nodes:
            node = node.get("/")
            for segment in segments:
                if node is None:
                    break
                for begin, found in node.get("//", {}).items():
                    if segment.startswith(begin) and (best is None or len(found[1]) >= len(best[1])):
                        best = found
                node = node.get(segment)
        return best


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Add `host`, `path`, `rule` (null where none fits) and `verdict` to each page; columns of these names are replaced.

    `rules` are (verdict, host, path). The longest rule wins, counted over host and path; of equal rules block wins. A null or empty
    url, or one without `://`, has an empty host and path and gets the default verdict; so do hosts with empty labels that no rule
    names. Repeated pages get equal verdicts. Tries of MAX_RULES rules are sent to the workers one after the other; the longest rule of all wins.
    """
    if bad := [r for r in rules if r[0] not in ("allow", "block")]:
        raise ValueError(f"verdicts are allow and block: {bad[:3]}")
    host, path = url_parts(F.col(f"`{url}`"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    now = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    # Equal rules meet in one trie, where block wins.
    rules = sorted(rules, key=lambda r: r[1:])
    step, at = MAX_RULES, 0
    while at < len(rules):
        to = min(len(rules), at + step)
        while to < len(rules) and rules[to][1:] == rules[to - 1][1:]:
            to += 1
        now = _judged(now if not at else saved(now, "verdicts"), rules[at:to])
        at = to
    return now.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`rule` and `verdict`, replaced where a rule of these is longer than the one found before."""
    trie = shared(pages.sparkSession, Trie(rules))

    @F.arrow_udf("struct<verdict string, rule string>")
    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        match = trie().match
        found = [match(h, p) or (None, None) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], ["verdict", "rule"])

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("rule", "verdict")]
    hit = pages.select(*rest, F.struct("rule", "verdict").alias("rule"), judged("host", "path").alias("verdict"))
    better = F.coalesce(F.length("verdict.rule") > F.length("rule.rule"), F.col("verdict.rule").isNotNull())
    return hit.select(*rest, F.when(better, F.col("verdict.rule")).otherwise(F.col("rule.rule")).alias("rule"),
                      F.when(better, F.col("verdict.verdict")).otherwise(F.col("rule.verdict")).alias("verdict"))
