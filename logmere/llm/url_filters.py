"""URL filters: rules first, then trust and distrust carried along the links between hosts.

Trust is a personalised PageRank from the hosts with allowed pages, along the links; distrust is one
from the hosts with blocked pages, against the links, as who links to a bad host is suspect. Both
walk in one loop of joins over host edges. A host is blocked if distrust has too large a share.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from logmere.llm.common import checked, stored

ALLOW, BLOCK = "allow", "block"
DAMPING = 0.85
#: The largest change of a host's score in a round, as a share of that score.
SETTLED = 1e-6
MOST_DISTRUST = 0.75
DIGITS = 9
LINK = "(?i)<a\\s[^>]*?\\bhref\\s*=\\s*[\"']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/\"'?#\\s>]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """For pages of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(
            path, F.lit(rule.path)
        )
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(source, target, pages)``: on how many pages one host links to another.

    ``pages``: ``host`` and ``html``. Links without a host stay on their host and don't count.
    """
    links = pages.select(
        F.col("host").alias("source"),
        F.explode(
            F.array_distinct(
                F.transform(
                    F.regexp_extract_all("html", F.lit(LINK), 1),
                    lambda x: F.translate(x, UPPER, LOWER),
                )
            )
        ).alias("target"),
    ).filter((F.col("source") != F.col("target")) & (F.col("target") != "") & (F.col("source") != ""))
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("pages"))


def _walks(edges: DataFrame) -> DataFrame:
    """``(kind, from, to, share)``: trust goes along the links, distrust back."""
    along = edges.select(
        F.lit(ALLOW).alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "pages"
    )
    back = edges.select(
        F.lit(BLOCK).alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "pages"
    )
    both = along.unionByName(back)
    sums = both.groupBy("kind", "from").agg(F.sum("pages").alias("all"))
    return both.join(sums, ["kind", "from"]).select(
        "kind", "from", "to", (F.col("pages") / F.col("all")).alias("share")
    )


def propagated(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, host, score)`` after the walks have settled, for hosts with a score.

    ``seeds``: ``(kind, host, seed)``, adding up to 1 for each kind. A walk ends at a host without
    a way on. No count of rounds ends the loop: scores only grow, what a round adds is at most
    ``DAMPING`` times what the last one added, and a host that is newly reached counts as changed, so
    hosts at any distance are reached and have their share of distrust settled.
    """
    seeds = stored(seeds, "host-seeds")
    walks = stored(_walks(edges), "host-walks")
    base = seeds.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score"))
    scores = stored(base, "host-scores")
    if not walks.head(1):
        return scores
    while True:
        moved = (
            scores.join(
                walks, (scores["kind"] == walks["kind"]) & (scores["host"] == walks["from"])
            )
            .select(
                scores["kind"],
                F.col("to").alias("host"),
                (F.col("score") * F.col("share") * DAMPING).alias("score"),
                F.lit(0.0).alias("old"),
            )
        )
        parts = (
            base.withColumn("old", F.lit(0.0))
            .unionByName(moved)
            .unionByName(scores.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("old")))
        )
        found = stored(
            parts.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")),
            "host-scores",
        )
        scores = found.select("kind", "host", "score")
        if not found.filter(F.abs(F.col("score") - F.col("old")) > SETTLED * F.col("score")).head(1):
            return scores


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    most_distrust: float = MOST_DISTRUST,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """``id, host, path, rule, verdict, distrust`` for each row of ``pages``.

    ``verdict``: that of the longest rule that fits; else block if ``distrust``, the share of
    distrust in the host's trust and distrust, is above ``most_distrust``, and allow if not. Hosts
    that neither reaches have no distrust and are allowed, and so are pages without a host. Seeds
    are the hosts' shares of all allowed and of all blocked pages. Null html has no links. Repeated
    rows count and are judged like others. An empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_column))
    parsed = pages.select(
        F.col(id_column).alias("id"), host.alias("host"), path.alias("path"), F.col(html_column).alias("html")
    )
    edges = host_edges(parsed.select("host", "html"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = stored(
        parsed.select("id", "host", "path", name.alias("rule"), verdict.alias("ruled")), "url-pages"
    )
    counts = (
        ruled.filter((F.col("host") != "") & F.col("ruled").isNotNull())
        .groupBy(F.col("ruled").alias("kind"), "host")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sums = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = counts.join(F.broadcast(sums), "kind").select(
        "kind", "host", (F.col("n") / F.col("all")).alias("seed")
    )
    scores = propagated(seeds, edges)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    hosts = scores.groupBy("host").agg(of(ALLOW).alias("trust"), of(BLOCK).alias("doubt"))
    hosts = stored(
        hosts.filter("trust + doubt > 0").select(
            F.col("host").alias("of"),
            F.round(F.col("doubt") / (F.col("trust") + F.col("doubt")), DIGITS).alias("distrust"),
        ),
        "host-distrust",
    )
    side = checked(hosts)
    judged = ruled.join(side, ruled["host"] == side["of"], "left")
    own = F.when(F.col("distrust") > most_distrust, BLOCK).otherwise(ALLOW)
    return judged.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", own).alias("verdict"),
        "distrust",
    )
