"""Quality rules with risk-controlled cutoffs.

Base measures are taken of every whole text inside its own row, without a shuffle. On top of
the fixed base limits each rule compares a ratio with a cutoff. The cutoffs are not guessed:
labelled documents serve as a holdout, in which each distinct text counts once, and a setting of
the cutoffs is admitted for a stratum only if an exact binomial test shows that its rules
together reject at most ``risk`` of the stratum's good texts.

Settings are tested along chains fixed in advance, from the loosest cutoffs to the strictest, one
rule tightened at a time, and a chain ends at its first failure; so a chain spends its level
once, however many settings it has. The main chain has all rules and half of a stratum's level;
for each rule a further chain leaves that rule out, and they share the other half, so one rule
that rejects good texts cannot hold back the others. Each stratum has an equal part of
``error`` (Bonferroni over chains and strata): all admitted settings keep their promise together
with probability ``1 - error``. Of a stratum's chains the one with most steps decides, the main
chain first. At risk 2 %, error 5 % and four strata about 250 good texts without a rejection
admit a step of the main chain. A stratum with too few labels gets no cutoff.

Defined cases: a null or empty text has no words (base_failed); null ids are kept as they are;
repeated rows give repeated results; a null stratum is a stratum of its own; labels with null
quality are ignored, and contradicting labels of one document count as not good; equal texts of a
stratum are one trial, near copies are several; empty tables give empty results; extra columns are
ignored.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefacts.llm.common import settled
from pagefacts.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Share of good documents that all rules together may reject, and the chance that this fails.
RISK = 0.02
ERROR = 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects where ``scale * part >= cutoff * whole`` and whole > 0; cutoffs from strict to loose."""

    name: str
    part: str
    whole: str
    scale: int
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 1000, (10, 20, 30, 40, 50, 75, 100, 150, 200, 300)),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1000, (50, 100, 150, 200, 250, 300, 400, 500, 600, 700)),
    Rule("repeats", "n_repeat_words", "n_words", 1000, (50, 75, 100, 150, 200, 250, 300, 350, 400, 450)),
    Rule("long_words", "word_chars", "n_words", 10, (70, 75, 80, 85, 90, 100, 110, 120, 150, 200)),
)

#: Part of a stratum's level that the chain of all rules has; the chains without one rule share the rest.
MAIN = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` packed as ``row`` with the measures of its text and a 64-bit hash of it (``text_key``) beside it.

    Repeated windows are found by sorting the hashes of a text's own three-word windows; equal
    neighbours mark repeats, and the covered positions are merged from left to right. The hash
    has 64 bits and is only compared within one text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    packed = docs.select(F.struct("*").alias("row"), t.alias("t"))
    split = packed.select(
        "row",
        F.xxhash64("t").alias("text_key"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr(r"array_remove(split(t, '[\\x20\\x09-\\x0D]+'), '')").alias("words"),
    )
    counted = split.select(
        "row",
        "text_key",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "sort_array(if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), "
            "i -> named_struct('h', xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), 'i', i))))"
        ).alias("windows"),
    )
    found = counted.withColumn(
        "at",
        F.expr(
            "sort_array(transform(filter(windows, (w, k) -> w.h <=> get(windows, k - 1).h or w.h <=> get(windows, k + 1).h), w -> w.i))"
        ),
    )
    covered = F.expr(
        "aggregate(at, named_struct('last', -3, 'n', 0L), (s, i) -> named_struct('last', i, 'n', s.n + least(3, i - s.last)), s -> s.n)"
    )
    return settled(found.withColumn("n_repeat_words", covered).select("row", "text_key", *MEASURES), "text_key", *MEASURES)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rejected_by(rule: Rule, cutoff):
    """Whether the rule rejects at this cutoff; false where there is no cutoff."""
    whole = F.col(rule.whole)
    return F.coalesce((whole > 0) & (rule.scale * F.col(rule.part) >= cutoff * whole), F.lit(False))


def binomial_at_most(k: str, n: str, p: float):
    """P(X <= k) of a binomial (n, p), as a SQL expression summed in logarithms from 0 to k.

    Above the mean the probability is at least about one half, so 1 is returned unsummed.
    """
    odds = f"ln({p!r}D) - ln(1 - {p!r}D)"
    return F.expr(
        f"if({k} > {n} * {p!r}D, 1.0D, exp(aggregate(sequence(1L, greatest({k}, 1L)), "
        f"named_struct('term', {n} * ln(1 - {p!r}D), 'total', {n} * ln(1 - {p!r}D)), "
        f"(s, i) -> if(i > {k}, s, named_struct('term', s.term + ln(({n} - i + 1) / i) + {odds}, 'total', "
        f"greatest(s.total, s.term + ln(({n} - i + 1) / i) + {odds}) + "
        f"log1p(exp(-abs(s.total - (s.term + ln(({n} - i + 1) / i) + {odds})))))), s -> s.total)))"
    )


def chains(rules: tuple[Rule, ...]) -> list[tuple[int, ...]]:
    """The chains by the numbers of their rules: all rules, then all but one."""
    every = tuple(range(len(rules)))
    return [every] + ([tuple(r for r in every if r != out) for out in every] if len(rules) > 1 else [])


def chain_levels(rules: tuple[Rule, ...], error: float, main: float = MAIN) -> list[float]:
    """The level of each chain, before it is divided by the number of strata."""
    rest = len(chains(rules)) - 1
    return [error * main] + [error * (1 - main) / rest] * rest if rest else [error]


def first_step(rules: tuple[Rule, ...], chain: tuple[int, ...]):
    """The first step of a chain that rejects the row; null if none does.

    Step ``round * len(chain) + place + 1`` tightens the rule at that place to its cutoff of that round, the loosest
    being of round 0.
    """
    steps = []
    for place, number in enumerate(chain):
        rule = rules[number]
        passed = sum((rule.scale * F.col(rule.part) < c * F.col(rule.whole)).cast("int") for c in rule.cutoffs)
        rejects = (F.col(rule.whole) > 0) & (passed < len(rule.cutoffs))
        steps.append(F.when(rejects, passed * len(chain) + place + 1))
    return F.least(*steps) if len(steps) > 1 else steps[0]


def cutoff_after(rule: Rule, chain: tuple[int, ...], number: int, step):
    """The rule's cutoff once ``step`` steps of the chain are admitted; null where it has none yet."""
    if number not in chain:
        return F.lit(None).cast("int")
    place, m = chain.index(number), len(chain)
    rounds = F.least(F.floor((step - place - 1) / m) + 1, F.lit(len(rule.cutoffs)))
    loose_first = F.array(*[F.lit(c) for c in sorted(rule.cutoffs, reverse=True)])
    return F.when(step > place, F.get(loose_first, (rounds - 1).cast("int")))


def fit_cutoffs(
    measures: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    stratum: str = "stratum",
    rules: tuple[Rule, ...] = RULES,
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """One row per stratum with good labelled documents: ``cut_<rule>`` (null: no admitted cutoff).

    ``measures`` has one row per document with the measures, ``text_key``, ``id_col`` and ``stratum``. Good
    documents that fail the base limits are left out, as no cutoff decides about them. What is counted is one row per
    stratum, chain and step, whatever the number of labels.
    """
    good = (
        labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min("quality").alias("q"))
        .filter("q = 1")
    )
    held = measures.filter(~base_failed()).join(good, F.col(id_col) == F.col("_id"), "left_semi")
    ways = chains(rules)
    tests = [F.struct(F.lit(i).alias("chain"), first_step(rules, way).alias("step")) for i, way in enumerate(ways)]
    trials = held.select(F.col(stratum).alias("_stratum"), "text_key", F.array(*tests).alias("tests")).distinct()
    counts = trials.select("_stratum", F.inline("tests")).groupBy("_stratum", "chain", "step").agg(F.count(F.lit(1)).alias("m"))
    counts = cut_lineage(counts, "quality-counts")
    strata = max(1, counts.select("_stratum").distinct().count())  # one number
    totals = counts.groupBy("_stratum", "chain").agg(F.sum("m").alias("n"))
    # step 0 rejects nothing; where even that shows too little, no step is admitted
    start = totals.select("_stratum", "chain", F.lit(0).alias("step"), F.lit(0).cast("long").alias("m"))
    upto = Window.partitionBy("_stratum", "chain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tested = (
        counts.filter("step is not null").unionByName(start)
        .withColumn("k", F.sum("m").over(upto))
        .join(totals, ["_stratum", "chain"])
    )
    level = F.get(F.array(*[F.lit(a / strata) for a in chain_levels(rules, error)]), F.col("chain"))
    most = F.get(F.array(*[F.lit(len(w) * max(len(rules[r].cutoffs) for r in w)) for w in ways]), F.col("chain"))
    failed = F.min(F.when(binomial_at_most("k", "n", risk) > level, F.col("step")))
    admitted = (
        tested.groupBy("_stratum", "chain").agg(failed.alias("failed"))
        .withColumn("step", F.greatest(F.lit(0), F.coalesce(F.col("failed") - 1, most)))
        .groupBy("_stratum")
        .agg(F.max(F.struct("step", (-F.col("chain")).alias("back"))).alias("best"))
        .select("_stratum", F.col("best.step").alias("step"), (-F.col("best.back")).alias("chain"))
    )
    cuts = [
        F.coalesce(
            *[F.when(F.col("chain") == i, cutoff_after(rule, way, r, F.col("step"))) for i, way in enumerate(ways)]
        ).alias(f"cut_{rule.name}")
        for r, rule in enumerate(rules)
    ]
    return admitted.select("_stratum", *cuts)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    rules: tuple[Rule, ...] = RULES,
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """Per document row: id, measures, base_failed, the cutoffs of its stratum, kept.

    Only numbers and the id are stored between fitting and judging; texts are read once.
    """
    measures = measured(docs, text).select(
        F.col(f"row.{id_col}").alias(id_col), F.coalesce(F.col(f"row.{stratum}"), F.lit("")).alias("stratum"), "text_key", *MEASURES
    )
    measures = cut_lineage(measures, "quality-measures")
    cuts = fit_cutoffs(measures, labels, id_col, "stratum", rules, risk, error)
    verdict = ~base_failed()
    for r in rules:
        verdict = verdict & ~rejected_by(r, F.col(f"cut_{r.name}"))
    return (
        measures.join(cuts, F.col("stratum") == F.col("_stratum"), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", verdict)
        .drop("_stratum", "text_key")
    )


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Measured in two passes that move no text: the first leaves numbers for fitting the cutoffs,
    the second judges each row where it is.
    """
    text, stratum = options.get("text", "text"), options.get("stratum", "lang")
    rules, id_col = options.get("rules", RULES), options.get("id_col", "doc_id")
    level = F.coalesce(F.col(f"row.{stratum}"), F.lit("")).alias("stratum")
    numbers = measured(docs, text).select(F.col(f"row.{id_col}").alias(id_col), level, "text_key", *MEASURES)
    cuts = fit_cutoffs(
        cut_lineage(numbers, "quality-measures"), labels, id_col, "stratum", rules,
        options.get("risk", RISK), options.get("error", ERROR),
    )
    verdict = ~base_failed()
    for r in rules:
        verdict = verdict & ~rejected_by(r, F.col(f"cut_{r.name}"))
    return (
        measured(docs, text)
        .select("row", level, *MEASURES)
        .join(cuts, F.col("stratum") == F.col("_stratum"), "left")
        .filter(verdict)
        .select("row.*")
    )
