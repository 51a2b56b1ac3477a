"""URL filters: rules first, then trust and distrust propagated over links between hosts. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules are literals of the plan, so their number is bounded.
MAX_RULES = 1000
DAMPING = 0.85
#: Rounds after which ranks that haven't settled are an error. At damping 0.85 the mass on its way is under SETTLED after 57.
ROUNDS = 200
#: A host is blocked when its distrust exceeds its trust by this share.
THRESHOLD = 0.5
#: Ranks are settled when a round changes all of them together by less than this share.
SETTLED = 1e-4
#: Hosts of at least one in this many rows have their scores broadcast.
HOT_PARTS = 1000
_HREF = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): links between different hosts, weighted by their share of the source's links.

    Pages' links are counted per pair of hosts before anything is shuffled.
    """
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("dst")).select("src", F.translate("dst", UPPER, UPPER.lower()).alias("dst"))
    counted = links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank: ``edges`` (src, dst, share), ``seeds`` (host, mass > 0) to (host, rank).

    rank = seed + damping * sum(rank(src) * share); a host without links out passes nothing on. Only new mass travels
    in each round, and what has arrived is added up, so rounds end when little is on its way; if that takes more than
    ``rounds``, it is an error. Each round is written to
    the shared folder; contributions to a host are partial sums, and a host with many links is split by AQE's join.
    """
    rank = moving = cut(seeds.select("host", F.col("mass").cast("double").alias("rank")))
    start = rank.agg(F.sum("rank")).first()[0] or 0.0
    for _ in range(rounds):
        moving = cut(moving.join(edges, moving.host == edges.src).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share") * damping).alias("rank")))
        rest = moving.agg(F.sum("rank")).first()[0] or 0.0
        if rest <= SETTLED * start:
            return cut(rank.union(moving).groupBy("host").agg(F.sum("rank").alias("rank"))) if rest else rank
        rank = cut(rank.union(moving).groupBy("host").agg(F.sum("rank").alias("rank")))
    raise ValueError(f"ranks haven't settled in {rounds} rounds")


def with_scores(named: DataFrame, scores: DataFrame, parts: int = HOT_PARTS) -> DataFrame:
    """``named`` with trust and distrust of its host, from ``scores`` (_host, n, trust, distrust); n: rows of the host.

    Hosts of at least one in ``parts`` of all rows are at most ``parts``, whatever the input: their scores are sent to
    all executors. The other rows meet theirs by a shuffle, in which no host has more than that share. Rows without a
    host have no scores and go nowhere.
    """
    scores = cut(scores)
    total = scores.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * F.lit(parts) >= F.lit(total)
    hot, rare = scores.where(often).drop("n"), scores.where(~often).drop("n")
    met = named.join(F.broadcast(hot), F.col("host") == F.col("_host"), "left")
    open_ = F.col("_host").isNull() & (F.col("host") != "")
    at_hot = met.where(~open_).drop("_host")
    at_rare = met.where(open_).drop("_host", "trust", "distrust").join(rare, F.col("host") == F.col("_host"), "left").drop("_host")
    return at_hot.unionByName(at_rare)


def judge(pages: DataFrame, rules: list[Rule], damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD, hot_parts: int = HOT_PARTS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust for each row of ``pages``.

    A url that a rule fits has the rule's verdict. The others have their host's: hosts are trusted seeds by the share
    of their pages that rules allow and blocked seeds by the share they block. Trust flows along links from trusted
    seeds; distrust flows against links from blocked seeds, to hosts that link there. A host whose distrust less its
    trust, in units of a host all of whose pages are seeds, reaches the threshold is blocked; any other is allowed.

    Null urls and urls without ``://`` have an empty host and path, and no host has no links: they are allowed. Null
    html has no links. Repeated pages count each. Very long html is searched for links whole. Of rules of equal length that
    fit, hosts of subdomains being longer, the last in the list wins. An empty table gives no rows.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    named = named.select("page_id", "host", "path", "hit.rule", "hit.verdict")
    hosts = cut(named.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")))
    edges = cut(host_edges(pages))
    trust = propagate(edges, hosts.where("allowed > 0").select("host", (F.col("allowed") / F.col("n")).alias("mass")), damping, rounds)
    back = edges.groupBy("dst").agg(F.sum("share").alias("total"))
    against = edges.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") / F.col("total")).alias("share"))
    distrust = propagate(cut(against), hosts.where("blocked > 0").select("host", (F.col("blocked") / F.col("n")).alias("mass")), damping, rounds)
    scores = (
        hosts.select(F.col("host").alias("_host"), "n")
        .join(trust.select(F.col("host").alias("_host"), F.col("rank").alias("trust")), "_host", "left")
        .join(distrust.select(F.col("host").alias("_host"), F.col("rank").alias("distrust")), "_host", "left")
        .na.fill(0.0, ["trust", "distrust"])
    )
    joined = with_scores(named, scores, hot_parts).na.fill(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "trust", "distrust")
