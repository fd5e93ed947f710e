"""URL filters: rules over hosts and paths, and for what no rule fits, trust and distrust propagated over the links between hosts.

Rules: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the rule's; of several that fit the longest holds.

Graph: an edge for each two hosts of which one has a page with an absolute link to the other; many links count once, links to a page's own host not at all. A host's trust seed is the share of its pages that rules allow, its distrust seed the share that rules block. Trust flows along links and distrust against them (who links to blocked hosts is suspect), both as personalised PageRank of damping DAMPING over ROUNDS rounds: each round a host keeps 1 - DAMPING of its seed, and receives DAMPING of what its neighbours hold, shared evenly over their edges. Hosts without edges pass nothing on. A host is blocked if its distrust is above its trust and at least LIMIT of what a host without links holds if all its pages are blocked.

Masses are integers of 1 / UNIT, so that sums are the same in any order and after any loss of an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import BROADCAST_IDS, Scratch, columns, with_small

#: Host, path and verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UNIT, DAMPING, ROUNDS, LIMIT = 10**9, 85, 10, 50  # mass of a seed; damping and limit in per cent
PART = 100_000  # edges of one host that are joined under one key; a host with more is split
SALTS = 64  # parts of a host's pages where the blocked hosts are too many to broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
_low = lambda x: F.translate(x, _UPPER, _LOWER)


def rule_of(rules: list[tuple[str, str, str]], pick: str) -> F.Column:
    """Over columns host and path: the name (host and path together) or the verdict of the longest rule that fits, else null. Of equally long ones that with the longer host, then the first by name, holds."""
    ranked = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r[0] + r[1]))
    fits = [((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)) for h, p, _ in ranked]
    return F.coalesce(F.lit(None).cast("string"), *(F.when(fit, F.lit(h + p if pick == "rule" else v)) for fit, (h, p, v) in zip(fits, ranked)))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and links (the distinct other hosts that the page links to)."""
    own = columns(pages, "page_id", "url", "html")
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    own = own.select("page_id", "html", rest.alias("rest"))
    own = own.select("page_id", "html", _low(F.regexp_extract("rest", "^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), _low))
    return own.select("page_id", "host", "path", F.when(F.col("host") != "", F.array_remove(found, F.col("host"))).alias("links"))


def edges(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Both directions of the graph as written rows (kind, node, part, to): trust goes from a host to those it links to, distrust from a host to those that link to it. part splits the edges of a host with more than PART of them."""
    links = pages.where("size(links) > 0").select("host", F.explode("links").alias("to")).distinct()
    both = links.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("host").alias("node"), "to"), F.struct(F.lit("distrust").alias("kind"), F.col("to").alias("node"), F.col("host").alias("to")))).alias("e")).select("e.*")
    both = scratch.save(both, "both")
    degrees = scratch.save(both.groupBy("kind", "node").agg(F.count("*").alias("degree")), "degrees")
    hot = degrees.where(F.col("degree") > PART).select("kind", "node", F.ceil(F.col("degree") / PART).alias("parts"))
    out = with_small(both, scratch.save(hot, "hot"), ["kind", "node"], "left")
    return scratch.save(out.select("kind", "node", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("to"), "parts")).otherwise(0).alias("part"), "to"), "edges")


def ranks(seeds: DataFrame, edges: DataFrame, degrees: DataFrame, scratch: Scratch) -> DataFrame:
    """kind, node and mass after ROUNDS rounds from seeds (kind, node, seed); hosts that nothing reaches are left out. Ends early once a round changes nothing, as all further ones would give the same."""
    base = seeds.select("kind", "node", F.expr(f"seed div 100 * {100 - DAMPING}").alias("mass")).where("mass > 0")
    now = scratch.save(base, "mass0")
    if edges.isEmpty():
        return now
    for n in range(1, ROUNDS + 1):
        held = now.join(degrees, ["kind", "node"]).select("kind", "node", F.expr("mass div degree").alias("share"), F.explode(F.expr(f"sequence(0L, (degree - 1) div {PART})")).alias("part")).where("share > 0")
        held = scratch.save(held, f"held{n}")
        sent = with_small(edges, held, ["kind", "node", "part"], "inner").groupBy("kind", F.col("to").alias("node")).agg(F.expr(f"sum(share) div 100 * {DAMPING}").alias("mass"))
        after = scratch.save(sent.union(base).groupBy("kind", "node").agg(F.sum("mass").alias("mass")).where("mass > 0"), f"mass{n}")
        settled = after.withColumn("mass2", F.col("mass")).drop("mass").join(now, ["kind", "node"], "full").where("mass IS DISTINCT FROM mass2").isEmpty()
        scratch.drop(f"held{n}")
        scratch.drop(f"mass{n - 1}") if n > 1 else None
        now = after
        if settled:
            break
    return now


def blocked_hosts(judged: DataFrame, scratch: Scratch) -> DataFrame:
    """host, trust and distrust of the hosts that the graph blocks; judged has host, links and the rule's verdict."""
    share = lambda verdict: F.expr(f"count_if(ruled = '{verdict}') * {UNIT} div count(*)")
    hosts = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = hosts.select(F.expr("stack(2, 'trust', host, trust, 'distrust', host, distrust) AS (kind, node, seed)")).where("seed > 0")
    graph = edges(judged, scratch)
    degrees = scratch.spark.read.parquet(f"{scratch.root}/degrees")
    masses = ranks(scratch.save(seeds, "seeds"), graph, degrees, scratch)
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).alias(kind)
    both = masses.groupBy(F.col("node").alias("host")).agg(one("trust"), one("distrust"))
    return scratch.save(both.where(F.expr(f"distrust > trust AND distrust >= {UNIT // 100 * (100 - DAMPING) // 100 * LIMIT}")), "blocked")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule (null: none fits) and verdict, the rule's or else the graph's.

    A null url, or one without `://`, has an empty host and path: no rule fits, it takes no part in the graph and is allowed. A null or empty html has no links. Repeated rows are judged alike and count as pages each; page_id isn't used and may be null. Texts of any length are searched whole. Equally long rules: see rule_of. Further columns are ignored, whatever their names. No rows give no rows. The rules are a list of some hundreds at most: they become one expression."""
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    rules = RULES if rules is None else rules
    judged = scratch.save(parsed(pages).withColumn("rule", rule_of(rules, "rule")).withColumn("ruled", rule_of(rules, "verdict")), "judged")
    bad = blocked_hosts(judged, scratch).select("host", F.lit("block").alias("by_graph"))
    own = judged.select("page_id", "host", "path", "rule", "ruled")
    if bad.count() <= BROADCAST_IDS:
        own = own.join(F.broadcast(bad), "host", "left")
    else:  # a host with very many pages is dealt over SALTS tasks
        own = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS))).join(bad.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))).hint("merge"), ["host", "salt"], "left")
    return own.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_graph", F.lit("allow")).alias("verdict"))
