"""URL filter: host and path rules, and a character language-model ratio.

Addresses that a rule decides teach two smoothed variable-order Markov models,
one of accepted and one of rejected addresses. The rest are decided by the
difference of their log-likelihoods per character against a threshold that is
calibrated on decided addresses kept out of the counts.

With n characters seen after a context, t of them different, a character seen c
times has probability (c + t * q) / (n + t), where q is its probability after
the context that is one character shorter; an unseen context passes q on. The
shortest one falls back to 1/256.

Only DataFrame expressions: equal addresses are gathered first, the counts of
all orders come from one aggregate over their longest windows, and the models
are a table with one row per distinct window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.session import Scratch, cut

ALLOW, BLOCK = "allow", "block"

# Characters of context; marks before and after an address.
ORDER = 4
BEGIN, END = "\u0002", "\u0003"
CHARACTERS = 256

# First digits of the MD5 of the addresses that calibrate; width of the steps
# in which thresholds are tried, and how far.
CALIBRATING = ("0", "1", "2")
STEP, REACH = 0.02, 500

# A gram that owns more than one in so many of all windows is broadcast.
SHARES = 1_000

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """'' and '' for NULL or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return (
        F.coalesce(host, F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def _fits(rule: Rule) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)


def ruled(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and decided: the longest rule that fits."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    none = F.lit(None).cast("string")
    return out.withColumns(
        {
            "rule": F.coalesce(*[F.when(_fits(r), r[1] + r[2]) for r in ordered], none),
            "decided": F.coalesce(*[F.when(_fits(r), r[0]) for r in ordered], none),
        }
    )


def _windows(addresses: DataFrame) -> DataFrame:
    """One row per character of ``address`` and its end: the character with
    the ``ORDER`` before it, as ``gram``."""
    padded = F.concat(F.lit(BEGIN * ORDER), F.col("address"), F.lit(END))
    places = F.sequence(F.lit(1), F.length("address") + 1)
    return addresses.withColumn("_padded", padded).withColumn("_at", F.explode(places)).select(
        *addresses.columns, F.substring("_padded", F.col("_at"), F.lit(ORDER + 1)).alias("gram")
    )


def ratios(addresses: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(gram, ratio, seen): log of the accepted over the rejected probability
    of the last character of every window of ``addresses`` (address, decided, n),
    and the number of windows; counted are those with ``learned``."""
    weight = {
        kind: F.sum(F.when(F.col("learned") & (F.col("decided") == verdict), F.col("n")).otherwise(0)).alias(kind)
        for kind, verdict in (("a", ALLOW), ("r", BLOCK))
    }
    counted = _windows(addresses).groupBy("gram").agg(*weight.values(), F.count("*").alias("seen"))
    grams = keep(counted)
    below = None
    for order in range(ORDER + 1):
        level = grams.groupBy(F.right("gram", F.lit(order + 1)).alias("g")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r")
        )
        context = F.left("g", F.lit(order))
        totals = level.groupBy(context.alias("_c")).agg(
            *[F.sum(k).alias(f"n{k}") for k in "ar"],
            *[F.count_if(F.col(k) > 0).alias(f"t{k}") for k in "ar"],
        )
        level = level.withColumn("_c", context).join(totals, "_c")
        if below is None:
            level = level.withColumns({f"q{k}": F.lit(1.0 / CHARACTERS) for k in "ar"})
        else:
            level = level.withColumn("_s", F.right("g", F.lit(order))).join(below, "_s")
        smoothed = {
            f"p{k}": F.when(
                F.col(f"n{k}") > 0,
                (F.col(k) + F.col(f"t{k}") * F.col(f"q{k}")) / (F.col(f"n{k}") + F.col(f"t{k}")),
            ).otherwise(F.col(f"q{k}"))
            for k in "ar"
        }
        below = keep(
            level.select(F.col("g").alias("_s"), *[p.alias(f"q{k[1]}") for k, p in smoothed.items()])
        )
    seen = grams.select(F.col("gram").alias("_s"), "seen")
    return below.join(seen, "_s").select(
        F.col("_s").alias("gram"), (F.log("qa") - F.log("qr")).alias("ratio"), "seen"
    )


def rated_windows(windows: DataFrame, table: DataFrame) -> DataFrame:
    """``windows`` (address, gram) with their ratio from a stored table (gram,
    ratio, seen).

    A gram that every address has may own a large part of the windows. Those that
    own more than 1/``SHARES``, at most ``SHARES`` of them, are broadcast, so that no
    key of the shuffle join holds more.
    """
    most = (table.agg(F.sum("seen")).first()[0] or 0) / SHARES
    hot = table.where(F.col("seen") > most).select("gram", F.col("ratio").alias("_hot"))
    probed = windows.join(F.broadcast(hot), "gram", "left")
    rest = table.where(F.col("seen") <= most).select("gram", "ratio")
    frequent = probed.where(F.col("_hot").isNotNull()).select("address", F.col("_hot").alias("ratio"))
    others = probed.where(F.col("_hot").isNull()).join(rest, "gram")
    return frequent.unionByName(others.select("address", "ratio"))


def threshold(scores: DataFrame) -> float:
    """The ratio per character that errs least on (score, decided, n), in
    steps of ``STEP``; 0 unless both verdicts occur. Of equally good ones the
    one nearest to 0."""
    step = F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.floor(F.col("score") / STEP)))
    counts = (
        scores.groupBy(step.cast("int").alias("step"))
        .agg(
            F.sum(F.when(F.col("decided") == ALLOW, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("decided") == BLOCK, F.col("n")).otherwise(0)).alias("r"),
        )
        .collect()  # at most 2 * REACH + 1 rows
    )
    if not sum(c.a for c in counts) or not sum(c.r for c in counts):
        return 0.0
    tried = range(min(c.step for c in counts), max(c.step for c in counts) + 2)

    def wrong(least: int) -> int:
        return sum(c.a for c in counts if c.step < least) + sum(c.r for c in counts if c.step >= least)

    return STEP * min(tried, key=lambda s: (wrong(s), abs(s), s))


def filtered(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row.

    ``score`` is the ratio per character of host and path, to six digits; it
    decides where ``rule`` is NULL. NULL urls and those without '://' have
    empty host and path and are decided by the score of the empty address. A
    score equal to the threshold allows. Repeated rows are judged each and
    counted each. Without rules or decided addresses every score is 0 and
    allows. Long addresses are scored whole. An empty table gives no rows; other
    columns are not read.
    """
    plain = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = ruled(plain, rules).drop("url").withColumn("address", F.concat("host", "path"))
    kept_out = F.substring(F.md5(F.col("address").cast("binary")), 1, 1).isin(*CALIBRATING)
    with Scratch(pages.sparkSession) as scratch:
        addresses = scratch.keep(
            rows.groupBy("address")
            .agg(F.max("decided").alias("decided"), F.count("*").alias("n"))
            .withColumn("learned", F.col("decided").isNotNull() & ~kept_out)
        )
        table = scratch.keep(ratios(addresses, scratch.keep))
        scores = scratch.keep(
            rated_windows(_windows(addresses.select("address")), table)
            .groupBy("address")
            .agg(F.round(F.avg("ratio"), 6).alias("score"))
        )
        calibrating = addresses.where(F.col("decided").isNotNull() & ~F.col("learned")).join(scores, "address")
        least = threshold(calibrating)
        judged = F.when(F.col("score") >= F.lit(round(least, 6)), ALLOW).otherwise(BLOCK)
        known = scores.withColumnRenamed("address", "_address")
        return cut(
            rows.join(known, F.col("address") == F.col("_address"), "left").select(
                "page_id", "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"), "score"
            )
        )
