"""URL filter: fixed rules first, then an empirical-Bayes reputation of hosts (DataFrame operations only).

Labelled page outcomes are beta-binomial. The bad rate of a suffix is shrunk to
the overall rate, that of a registered domain to its suffix's, that of a host to
its domain's. How strongly comes from the spread between siblings at each level
(moments of the beta-binomial). A host is blocked when the lower credible bound
of its bad rate is above a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

#: The rules of the list, as (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Second labels which, before a country's two letters, make a suffix of two labels (co.uk, com.au, or.jp).
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")

Z = 1.2815515655446004
"""One-sided 90 %."""
MOST_BAD = 0.5
MOST_HOSTS = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are tried first
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """The host without user, port and final dots; an address in brackets as it is."""
    plain = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.when(host.startswith("["), F.regexp_extract(host, r"^\[[^\]]*\]?", 0)).otherwise(plain), r"\.+$", "")


def domain_of(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix. A suffix is the last label, or the last two by the rule of SECOND or if
    suffixes (a public list's of two labels) has them. Addresses stand for themselves, without a suffix."""
    name = name_of(host)
    labels = F.split(name, r"\.")
    last2, last = F.concat_ws(".", F.slice(labels, -2, 2)), F.element_at(labels, -1)
    few = (F.size(labels) < 2) | name.startswith("[") | name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    two = (F.length(last) == 2) & F.element_at(labels, -2).isin(*SECOND) | last2.isin(*suffixes)
    domain = F.when(few, name).when(two & (F.size(labels) > 2), F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(last2)
    suffix = F.when(few, "").when(two, last2).otherwise(last)
    return domain, suffix


def _shrunk(children: DataFrame, parent_rate: Column) -> DataFrame:
    """children (n, bad) with rate, shrunk to parent_rate; strength from the spread between them."""
    p = parent_rate
    got = children.withColumn("prior", p).where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2.0))).alias("spread"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("own"),
        F.sum((F.col("n") - 1) * F.col("prior") * (1 - F.col("prior"))).alias("extra"),
    ).first()
    rho = (got["spread"] - got["own"]) / got["extra"] if got["extra"] else 0.0
    strength = 1 / min(max(rho, 0.001), 0.999) - 1
    return children.withColumn("prior", p).withColumn("weight", F.col("n") + F.lit(strength)).withColumn("rate", (F.col("bad") + F.lit(strength) * F.col("prior")) / F.col("weight"))


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """host, pages, rate, bound: rows, posterior mean and lower bound of each host's bad rate.

    outcomes: host, bad (0, 1, or null where unlabelled), one row for each page outcome.
    """
    # partial sums make a row for each host and task, so a host with a third of all pages costs no task more
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    domain, suffix = domain_of(F.col("host"), suffixes)
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}), "host-counts")
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    all_ = hosts.agg(*add).first()
    overall = ((all_["bad"] or 0) + 0.5) / ((all_["n"] or 0) + 1.0)
    by_suffix = _shrunk(hosts.groupBy("suffix").agg(*add), F.lit(overall)).select("suffix", F.col("rate").alias("suffix_rate"))
    domains = hosts.groupBy("domain", "suffix").agg(*add).join(by_suffix, "suffix")
    domains = _shrunk(domains, F.col("suffix_rate")).select("domain", "suffix", F.col("rate").alias("domain_rate"))
    scored = _shrunk(hosts.join(domains, ["domain", "suffix"]), F.col("domain_rate"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return scored.select("host", "pages", "rate", (F.col("rate") - F.lit(Z) * sd).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, most_bad: float = MOST_BAD, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, host_rate.

    A page's outcome is the labels row whose doc_id is its page_id: bad if toxic, or
    not of quality; null flags count as good, and a row of two nulls is no label.
    Pages without :// share the empty host. Repeated pages each get a row, and
    repeated labels each count. Without labels nothing is blocked but by rule. Rates of up
    to MOST_HOSTS hosts are broadcast; of more, those of the hosts with the most pages.
    """
    host, path = split_url(F.col("url"))
    rule, verdict = match_rule(F.col("host"), F.col("path"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    marks = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    known = written(reputation(seen.join(marks, "page_id", "left").select("host", "bad"), suffixes).withColumnRenamed("host", "known_host"), "host-rates")
    scored = join_counted(seen, "host", known, "known_host", "pages", MOST_HOSTS)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") > most_bad, "block").otherwise("allow")).alias("verdict"), F.round("rate", 6).alias("host_rate"))
