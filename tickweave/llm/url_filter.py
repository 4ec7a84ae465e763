"""URL allow and block lists by a trie over reversed host labels and path segments.

The trie is broadcast; a url walks it label by label from the top-level domain, and at each
host node that carries rules walks the path. Of all rules on the way the longest one (host
and path together, in characters) decides; of equally long ones the longer host, then block.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Most rules of a list; a trie of so many takes a few hundred MB at the very most.
MOST_RULES = 1_000_000
#: The verdict where no rule fits.
DEFAULT = "allow"
BLOCK, ALLOW = "block", "allow"


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def build(rules: Iterable[tuple[str, str]]) -> dict:
    """Trie of (rule, verdict) pairs.

    A node has labels below it under ``to`` and, once a rule ends at its host, a path node
    under ``path``: full segments under ``to``, and under ``ends`` the last, maybe partial
    segments of rules with their verdict (an empty one for a rule that ends with a slash).
    """
    root: dict = {"to": {}}
    for count, (rule, verdict) in enumerate(rules):
        if count >= MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules; split the list")
        host, path = split_rule(rule)
        node = root
        for label in reversed(host.split(".")):
            node = node["to"].setdefault(label, {"to": {}})
        node = node.setdefault("path", {"to": {}, "ends": {}})
        *segments, last = path.split("/")
        for segment in segments:
            node = node["to"].setdefault(segment, {"to": {}, "ends": {}})
        if node["ends"].get(last, (rule, ALLOW))[1] == ALLOW:  # of the same rule twice, block stands
            node["ends"][last] = (rule, verdict)
    return root


def fitting(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The (rule, verdict) that decides, or None."""
    best, rank = None, None
    node, segments = trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node["to"].get(label)
        if node is None:
            break
        below = node.get("path")
        for segment in segments:
            if below is None:
                break
            ends = below["ends"]
            if ends:
                for size in range(len(segment), -1, -1):
                    found = ends.get(segment[:size])
                    if found:
                        own = (len(found[0]), len(split_rule(found[0])[0]), found[1] == BLOCK)
                        if rank is None or own > rank:
                            best, rank = found, own
                        break
            below = below["to"].get(segment)
    return best


def _judge(trie):
    def run(batches):
        rules = trie.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [fitting(rules, h, p) for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("host"), batch.column("path"),
                    pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else DEFAULT for f in found], pa.string()),
                ],
                names=["row", "host", "path", "rule", "verdict"],
            )

    return run


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; columns of these names are replaced.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; the path goes on to ``?``, ``#`` or the end. Both are empty for a null url or
    one without ``://``. A rule fits its host and all subdomains where the path begins with
    the rule's. Without a fitting rule the rule is null and the verdict ``allow``. Repeated
    rows are judged each; an empty table stays empty.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = "(?s)^.*?://([^/?#]*)([^?#]*).*$"
    plain = pages.drop("host", "path", "rule", "verdict")
    packed = plain.select(
        F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("row"),
        F.translate(F.regexp_extract(url, parts, 1), upper, lower).alias("host"), F.regexp_extract(url, parts, 2).alias("path"),
    )
    schema = StructType([*packed.schema, StructField("rule", StringType()), StructField("verdict", StringType())])
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))
    return packed.mapInArrow(_judge(trie), schema).select("row.*", "host", "path", "rule", "verdict")
