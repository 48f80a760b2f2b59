"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures each document once and evaluates every rule once: a failed
rule sets its bit in ``failed``.  Policies are versioned masks over these bits,
so changing a policy, or asking what a rule alone costs, reads the ledger and
never a text again: ``apply_policy`` is one bitwise AND, ``ablations`` a bitwise
aggregation without any pass over the measurements.

Defined results: a null text counts as a text without words (it fails the rule
on few words); each row gives one row, repeated rows and null ids included;
extra columns stay, but one that is named as a measurement or ``failed`` gives way to
it; names starting ``_q_`` are reserved; an empty table gives an empty ledger.  All steps are linear in a text's length but for a sort of its
3-word windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

# A rule is a condition on the measurements under which a document fails. Bits are positions in this list, which only grows at its end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 4 * n_words"),
    ("capitals", "2 * n_upper > word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is kept if it fails none of them."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (rule, _) in enumerate(RULES) if rule in self.rules)


BASE = Policy("base/1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard/1", tuple(name for name, _ in RULES))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of MEASURES (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.drop(*MEASURES, "failed")
    out = df.withColumns({"_q_words": F.array_remove(F.split(t, SPACE), ""), "_q_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("_q_words")
    hashes = F.transform(F.slice("_q_words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_q_words", i + 1), F.get("_q_words", i + 2)))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_hashes": hashes,
    }).drop("_q_words", "_q_lines")
    # Only a text with a repeated window sorts them; of the sorted windows, those equal to a neighbour are repeated.
    out = out.withColumn("_q_sorted", F.when(F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes"), F.sort_array(F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("_q_sorted", k)["h"]
    twice = F.filter("_q_sorted", lambda s, k: (s["h"] == at(k - 1)) | (s["h"] == at(k + 1)))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-3).alias("last"))
    covered = F.aggregate(F.sort_array(F.transform(twice, lambda s: s["i"])), start, lambda a, p: F.struct((a["covered"] + F.least(F.lit(3), p - a["last"])).alias("covered"), p.alias("last")))["covered"]
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_hashes", "_q_sorted")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The input's rows with their measurements and ``failed`` (long), the bits of all rules that they fail."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    # As a generator's output, so that a filter on the bits isn't rewritten into one on the text, with every rule inside.
    return measured(df, text).withColumn("failed", F.explode(F.array(bits)))


def fails(policy: Policy, failed: Column | str = "failed") -> Column:
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Ledger rows that a policy keeps."""
    return entries.where(~fails(policy))


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    counts = entries.groupBy(hit.alias("_q_hit")).agg(F.count("*").alias("_q_n"))
    one = [(i, name) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    rules = F.explode(F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(name).alias("rule")) for i, name in one)))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("_q_n"))), F.lit(0))
    own, alone = F.col("_q_hit").bitwiseAND(F.col("_q_bit")) != 0, F.col("_q_hit") == F.col("_q_bit")
    return (
        counts.withColumn("_q_r", rules)
        .withColumn("_q_bit", F.expr("shiftleft(cast(1 as bigint), _q_r.bit)"))
        .groupBy(F.col("_q_r.bit").alias("bit"), F.col("_q_r.rule").alias("rule"))
        .agg(total(own).alias("failing"), total(alone).alias("failing_alone"), total((F.col("_q_hit") == 0) | alone).alias("kept_without"))
    )
