"""URL filters: allow and block rules, and gradient-boosted trees for URLs that no rule decides.

The trees see lexical features only: lengths, depth, digit share, entropy,
hyphens, parameter counts and suffix statistics. They are trained from labelled
URLs: 1 for a host with a word of ``BLOCK_WORDS`` between dots or hyphens, 0 for
any other host - so a host that looks like the listed ones is blocked without
being listed. The suffix statistics are counted over all URLs. Hosts are dealt to
two halves by hash, and a URL's shares are those of the other half, so that they
don't tell its host's label.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of hosts that label a URL as one to block.
BLOCK_WORDS = ("ads", "adult", "bet", "bets", "casino", "lottery", "pharmacy", "pills", "poker", "porn", "spam", "xxx")
# The fitting sample: URLs of each label.
SAMPLE_PER_LABEL = 10_000
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_share", "host_entropy",
            "host_hyphens", "n_parameters", "query_length", "suffix_share", "suffix_size", "domain_share", "domain_size"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host in lower case (A-Z) up to ``/``, ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    pattern = r"^([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(rest, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, pattern, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; a rule is (verdict, host, path).

    It fits its host and all subdomains if the path starts with the rule's. Of
    rules of one length, the first in order of text counts.
    """
    if len(rules) > MAX_RULES or any(v not in ("allow", "block") for v, *_ in rules):
        raise ValueError(f"at most {MAX_RULES} rules, each to allow or block")
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits for a character of the text."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(
        F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n),
        F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def _features(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path) with the features and the label of ``BLOCK_WORDS``."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    rows = rows.withColumns({
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "host_depth": count(host, r"\."), "path_depth": count(path, "/[^/]"),
        "digit_share": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "host_entropy": _entropy(host),
        "host_hyphens": count(host, "-"), "n_parameters": count(query, "[^&=]+="), "query_length": F.length(query),
        "suffix": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2),
        "label": F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, BLOCK_WORDS))).cast("int")})
    # Suffix statistics over all rows: how many URLs, and the share of those to block
    # among the other half's (with one more of each kind).
    half, label = F.pmod(F.xxhash64("host"), F.lit(2)), F.col("label")
    for name in ("suffix", "domain"):
        stats = rows.groupBy(name).agg(F.count("*").alias("_n"), *[f.alias(f"_{k}{i}") for i in (0, 1) for k, f in (
            ("all", F.count(F.when(half != i, 1))), ("ones", F.sum(F.when(half != i, label).otherwise(0))))])
        other = lambda k: F.when(half == 0, F.col(f"_{k}0")).otherwise(F.col(f"_{k}1"))
        rows = rows.join(stats, name).withColumns({
            f"{name}_size": F.log1p("_n"), f"{name}_share": (other("ones") + 1) / (other("all") + 2)}).drop(*stats.columns[1:])
    return rows


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          sample_per_label: int = SAMPLE_PER_LABEL, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: its id, host, path, rule, verdict, and the trees' score (chance to block).

    A null or malformed URL has an empty host and path, which no rule with a host
    fits; the trees judge it like any other. Repeated rows each have a row, null
    ids are carried, other columns are not read. If labels are all alike there is
    nothing to learn: every score is that label.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = _features(rows.withColumns({"rule": rule, "ruled": verdict}))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        scored = rows.withColumn("score", F.lit(float(next(iter(counts), 0))))
    else:
        # Each label's rows with the least hashes: about the sample, whatever their number.
        share = {k: min(1.0, sample_per_label / n) for k, n in counts.items()}
        cut = F.when(F.col("label") == 1, share[1]).otherwise(share[0]) * float(1 << 31)
        sample = rows.where(F.pmod(F.xxhash64("url", "id"), F.lit(1 << 31)) < cut)
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=7, minInstancesPerNode=20, cacheNodeIds=False)
        sample = assembler.transform(sample.select("label", *FEATURES)).select("label", "features").coalesce(4)
        model = trees.fit(sample.checkpoint())
        scored = model.transform(assembler.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
