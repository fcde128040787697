"""Rules, reputation, classifiers and the fold to an assessment, all as DataFrame transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import fingerprint as fp
from siftwell.functions.text import FEATURES, email_domain, with_features
from siftwell.operators.config import DEFAULT, Config
from siftwell.sources.sinks import staged

#: The hand-set classifier's bias and weights.
SPAM_BIAS, SPAM_LINK, SPAM_UPPER, SPAM_MONOTONE = -1.5, 4.0, 1.5, 2.0
SLOP_BIAS, SLOP_MONOTONE, SLOP_EVEN, SLOP_ENTROPY, EVEN_LENGTH = -1.0, -1.0, 0.8, 0.25, 5.0


#: All reason codes in the order in which they are told.
REASONS = (
    "high_link_ratio", "excessive_capitalization", "low_lexical_diversity", "ip_reputation_bad", "disposable_email_domain", "email_domain_reputation_bad", "content_fingerprint_seen_spam",
    "ai_stylometry_high",
)


@dataclass(frozen=True)
class Stores:
    """Reputation tables: disposable (domain), ips (key, score), domains (domain, score), fingerprints (fp, score).

    ``kind`` is the hash of the stored fingerprints, sip or md5. ``network`` (fp, score) has scores of many tenants on
    fingerprints keyed by ``secret``, as votes are stored: the largest of the own and the network's score counts.
    """

    disposable: DataFrame
    ips: DataFrame
    domains: DataFrame
    fingerprints: DataFrame
    suffixes: bool = True
    exact_first: bool = True
    kind: str = "md5"
    network: DataFrame | None = None
    secret: str | None = None


def fired(when: Column, weight) -> Column:
    return F.when(when, F.lit(weight) if isinstance(weight, float) else weight).otherwise(F.lit(0.0))


def rules(cfg: Config = DEFAULT) -> dict[str, tuple[Column, float]]:
    """Reason → (predicate over the features, spam weight), in the order in which reasons are told."""
    n = F.col("word_count")
    return {
        "high_link_ratio": ((n > 0) & (F.col("link_ratio") > cfg.link_ratio_above), cfg.link_ratio_weight),
        "excessive_capitalization": ((n >= 3) & (F.col("uppercase_ratio") > cfg.uppercase_above), cfg.uppercase_weight),
        "low_lexical_diversity": ((n >= 5) & (F.col("lexical_diversity") < cfg.diversity_below), cfg.diversity_weight),
    }


def rule_offset(cfg: Config = DEFAULT) -> Column:
    """Prior and rules alone, without reputation: the offset that a residual model adds to."""
    total = F.lit(cfg.base_spam)
    for when, weight in rules(cfg).values():
        total = total + fired(when, weight)
    return total


def baseline_spam() -> Column:
    return SPAM_BIAS + SPAM_LINK * F.col("link_ratio") + SPAM_UPPER * F.col("uppercase_ratio") + SPAM_MONOTONE * (1 - F.col("lexical_diversity"))


def baseline_slop() -> Column:
    even = 1 / (1 + F.abs(F.col("avg_word_length") - EVEN_LENGTH))
    return SLOP_BIAS + SLOP_MONOTONE * (1 - F.col("lexical_diversity")) + SLOP_EVEN * even + SLOP_ENTROPY * F.col("char_entropy")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def domain_suffixes(domain: Column) -> Column:
    """The domain without trailing dots and each of its parents that still holds a dot."""
    parts = F.split(F.lower(F.regexp_replace(domain, r"\.+$", "")), r"\.")
    n = F.size(parts)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, k, n), "."))).otherwise(F.array().cast("array<string>"))


def disposable(domains: DataFrame, store: DataFrame, suffixes: bool = True) -> DataFrame:
    """The distinct ``domain`` values that the store lists, or has a parent of where ``suffixes`` says so."""
    own = domains.where("domain IS NOT NULL").select("domain").distinct()
    found = own.select("domain", F.explode(domain_suffixes(F.col("domain"))).alias("_s")) if suffixes else own.withColumn("_s", F.lower("domain"))
    return found.join(store.select(F.col("domain").alias("_s")).distinct(), "_s", "left_semi").select("domain").distinct()


def fingerprint_scores(fps: DataFrame, store: DataFrame, exact_first: bool = True, radius: int = 3) -> DataFrame:
    """(fp, fp_score): the largest score within ``radius`` bits; an exact hit's own where ``exact_first``.

    Works on distinct fingerprints, each computed once; only those without an exact hit meet the near-join then.
    """
    # Nulls go after the write: a filter before it would be pushed down and compute every fingerprint twice.
    own = staged(fps.select("fp").distinct(), "fingerprints").where("fp IS NOT NULL")
    known = staged(store.groupBy("fp").agg(F.max("score").alias("fp_score")), "known")
    near = lambda rows: (
        fp.near_pairs(rows.withColumnRenamed("fp", "l"), known.select(F.col("fp").alias("r")), radius)
        .join(known.select(F.col("fp").alias("r"), "fp_score"), "r").groupBy(F.col("l").alias("fp")).agg(F.max("fp_score").alias("fp_score"))
    )
    if not exact_first:
        return near(own)
    return own.join(known, "fp").unionByName(near(own.join(known, "fp", "left_anti")))


def with_network(fps: DataFrame, local: DataFrame, network: DataFrame, secret: str) -> DataFrame:
    """(fp, fp_score) of ``fps`` (fp): the larger of the local score and of the network's on the keyed fingerprint.

    Either may be missing; a network fingerprint meets equal ones only.
    """
    scores = network.groupBy(F.col("fp").alias("_keyed")).agg(F.max("score").alias("_network"))
    keyed = fps.where("fp IS NOT NULL").select("fp").distinct().withColumn("_keyed", fp.network_fp_sip(F.col("fp"), secret))
    both = keyed.join(scores, "_keyed", "left").join(local, "fp", "left")
    return both.select("fp", F.greatest("fp_score", "_network").alias("fp_score")).where("fp_score IS NOT NULL")


def with_reputation(df: DataFrame, stores: Stores) -> DataFrame:
    """``df`` (email_domain, ip_key, fp) with ip_score, is_disposable, domain_score, fp_score; null where unknown.

    The distinct domains and fingerprints are taken in one pass and looked up by themselves; then left joins bring the
    results to the rows, whose tables adaptive execution broadcasts if they turn out small. Null keys never match, so
    missing data gives no signal.
    """
    asked = staged(df.select("email_domain", "fp").distinct(), "asked")
    ips = stores.ips.groupBy(F.col("key").alias("ip_key")).agg(F.max("score").alias("ip_score"))
    domains = stores.domains.groupBy(F.col("domain").alias("email_domain")).agg(F.max("score").alias("domain_score"))
    listed = disposable(asked.select(F.col("email_domain").alias("domain")), stores.disposable, stores.suffixes).select(F.col("domain").alias("email_domain"), F.lit(True).alias("is_disposable"))
    near = fingerprint_scores(asked, stores.fingerprints, stores.exact_first)
    if stores.network is not None:
        near = with_network(asked, near, stores.network, stores.secret or "")
    near = staged(near, "scores")
    return df.join(ips, "ip_key", "left").join(domains, "email_domain", "left").join(listed, "email_domain", "left").join(near, "fp", "left")


def reputation(cfg: Config = DEFAULT) -> dict[str, tuple[Column, Column]]:
    """Reason → (predicate, spam weight) over the columns of ``with_reputation``, in order."""
    bad = lambda c: F.coalesce(F.col(c) > cfg.reputation_above, F.lit(False))
    return {
        "ip_reputation_bad": (bad("ip_score"), F.col("ip_score") * cfg.ip_weight),
        "disposable_email_domain": (F.coalesce("is_disposable", F.lit(False)), F.lit(cfg.disposable_weight)),
        "email_domain_reputation_bad": (bad("domain_score"), F.col("domain_score") * cfg.domain_weight),
        "content_fingerprint_seen_spam": (bad("fp_score"), F.col("fp_score") * cfg.fingerprint_weight),
    }


def prepared(content: DataFrame, kind: str | None = "md5") -> DataFrame:
    """``content`` (text, and email and ip if present) with features, email_domain, ip_key and, of a ``kind``, fp."""
    df = with_features(content)
    has = set(content.columns)
    null = F.lit(None).cast("string")
    prints = {"md5": fp.simhash_md5, "sip": fp.simhash_sip}
    return df.withColumns({"email_domain": email_domain(F.col("email")) if "email" in has else null, "ip_key": fp.ip_key(F.col("ip")) if "ip" in has else null, "fp": prints[kind](F.col("text")) if kind else F.lit(None).cast("long")})


def residual(params: dict | None) -> Column | None:
    """A trained model's log-odds: standardised inputs by weights, folded to literals."""
    if params is None:
        return None
    from siftwell.functions.text import model_inputs

    inputs = model_inputs()
    total = F.lit(float(params["intercept"]))
    for k, (m, s, w) in enumerate(zip(params["means"], params["scales"], params["weights"])):
        total = total + (inputs[k] - float(m)) / float(s) * float(w)
    return total


def assess(content: DataFrame, stores: Stores | None = None, cfg: Config = DEFAULT, params: dict | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``content`` with spam, slop (0 to 1) and reasons, the codes in order of rules, reputation, final slop.

    Without stores no signal comes from reputation. ``params`` puts a trained residual in place of the baseline
    spam log-odds; slop stays with the baseline. Null text counts as empty, so every row gets an assessment.

    ``keep`` names the columns of ``content`` that go on. With it and stores the features and keys of every row are
    written once, without the texts, and both the lookups and the scores read them; else both compute them.
    """
    df = prepared(content, stores.kind if stores is not None else None)
    if keep is not None:
        df = df.select(*dict.fromkeys((*keep, *FEATURES, "email_domain", "ip_key", "fp")))
    signals: dict = dict(rules(cfg))
    if stores is not None:
        if keep is not None:
            df = staged(df, "prepared")
        df = with_reputation(df, stores)
        signals |= reputation(cfg)
    spam = F.lit(cfg.base_spam)
    for when, weight in signals.values():
        spam = spam + fired(when, weight)
    trained = residual(params)
    spam = spam + cfg.classifier_spam_weight * (baseline_spam() if trained is None else trained)
    slop = F.lit(cfg.base_slop) + cfg.classifier_slop_weight * baseline_slop()
    df = df.withColumns({"spam": sigmoid(spam), "slop": sigmoid(slop)})
    told = [F.when(when, F.lit(code)) for code, (when, _) in signals.items()] + [F.when(F.col("slop") > cfg.slop_reason_above, F.lit("ai_stylometry_high"))]
    return df.withColumn("reasons", F.array_distinct(F.array_compact(F.array(*told))))
