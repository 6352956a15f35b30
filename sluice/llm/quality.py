"""Quality rules: features of every text, and a learned decision list over them.

Learning is sequential covering: conjunctions of thresholds are grown on two
thirds of a labelled sample, pruned on the other third, and emitted in order as
one Spark conditional expression. What reaches the driver is a table of counts
by binned features, with at most ``MAX_LABELLED`` rows; features and verdicts
are built-in expressions over one row, without a shuffle of texts.

Defined results: a null or empty text has no words and fails the base rule;
labels that are null or have no document teach nothing; without labels the list
is empty and its verdict is "keep"; of several labels for a document each
counts; repeated rows each get a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import WS, let, table, words

#: Bound of the labelled sample that the list is fitted on: the rows with the smallest hashes of their ids.
MAX_LABELLED = 20_000
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must be right on so many of the rows it covers, among those held back for pruning, and cover so many of the sample.
MIN_PRECISION = 0.97
MIN_COVER = 0.003
#: Shares that rules may test; each is a function of the features of one text.
SHARES = {
    "symbols_per_word": lambda q: q["n_symbols"] / F.greatest(q["n_words"], F.lit(1)),
    "chars_per_word": lambda q: q["word_chars"] / F.greatest(q["n_words"], F.lit(1)),
    "repeat_share": lambda q: q["n_repeat_words"] / F.greatest(q["n_words"], F.lit(1)),
    "dup_lines_per_word": lambda q: q["n_dup_lines"] / F.greatest(q["n_words"], F.lit(1)),
    "capitals_per_char": lambda q: q["n_capitals"] / F.greatest(q["word_chars"], F.lit(1)),
    "bangs_per_word": lambda q: q["n_bangs"] / F.greatest(q["n_words"], F.lit(1)),
    "words": lambda q: q["n_words"].cast("double"),
}


@dataclass(frozen=True)
class Condition:
    share: str
    at_least: bool
    threshold: float


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float


def repeat_words(w: Column) -> Column:
    """How many words stand in a 5-word window that occurs twice or more.

    O(n log n): windows are hashed, sorted with their positions, and those equal
    to a neighbour marked; most texts end at the first test, which is linear.
    """
    last = F.size(w) - 5
    window = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))
    hashes = F.when(last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))

    def marked(p: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(p, lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(False) | same(x, j + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        spread = lambda at: F.aggregate(
            F.transform(at, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda p: let(marked(p), spread)))

    return let(hashes, covered).cast("bigint")


def features(text: Column) -> Column:
    """struct of the features of a text, all bigint."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    without = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    names = {
        "word_chars": F.length(F.regexp_replace(t, f"{WS}+", "")),
        "n_symbols": without(r"[#*$%&|<>]+"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_capitals": without("[A-Z]+"),
        "n_bangs": without("!+"),
    }
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words"), *(c.cast("bigint").alias(n) for n, c in names.items())
        ),
    )


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def rule_fired(q: Column, rules: list[Rule]) -> Column:
    """The number of the first rule that a text meets, from 1; 0 if none."""
    fired = F.when(F.lit(False), F.lit(0))
    for n, r in enumerate(rules, 1):
        met = F.lit(True)
        for c in r.conditions:
            x = SHARES[c.share](q)
            met = met & (x >= c.threshold if c.at_least else x < c.threshold)
        fired = fired.when(met, F.lit(n))
    return fired.otherwise(F.lit(0))


def judged(text: Column, rules: list[Rule]) -> Column:
    """The features with base_failed, rule and kept: one expression, so that each text is read once."""
    return let(
        features(text),
        lambda q: let(
            rule_fired(q, rules),
            lambda n: F.struct(q.alias("q"), base_failed(q).alias("base_failed"), n.alias("rule"), (~base_failed(q) & (n == 0)).alias("kept")),
        ),
    )


def _cover(counts: list[tuple], n_shares: int, edges: list[list[float]], names: list[str], total: int) -> list[Rule]:
    """Sequential covering over rows of (bins, is bad, is for growing, count)."""
    rows, rules = counts, []
    score = lambda rs: (sum(r[3] for r in rs if r[1]), sum(r[3] for r in rs if not r[1]))
    meets = lambda r, c: (r[0][c[0]] >= c[1]) if c[2] else (r[0][c[0]] < c[1])
    while len(rules) < MAX_RULES:
        grow = [r for r in rows if r[2]]
        bad, good = score(grow)
        if not bad:
            break
        rule: list[tuple[int, int, bool]] = []
        while good and len(rule) < MAX_CONDITIONS:
            best = (0.0, None)
            for f in range(n_shares):
                by_bin = [[0, 0] for _ in range(len(edges[f]) + 1)]
                for r in grow:
                    by_bin[r[0][f]][not r[1]] += r[3]
                below = [0, 0]
                for b in range(1, len(by_bin)):
                    below = [below[0] + by_bin[b - 1][0], below[1] + by_bin[b - 1][1]]
                    for up, (p, n) in ((False, below), (True, [bad - below[0], good - below[1]])):
                        # FOIL's gain without its logarithm: bad rows covered, times what the share of bad rows gains.
                        gain = p * (p / (p + n) - bad / (bad + good)) if p else 0.0
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, b, up))
            if best[1] is None:
                break
            rule.append(best[1])
            grow = [r for r in grow if meets(r, best[1])]
            bad, good = score(grow)
        held = [r for r in rows if not r[2]]
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = score([r for r in held if all(meets(r, c) for c in rule[:k])])
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
        if not worth:
            break
        rule = rule[: -max(worth)[1]]
        p, n = score([r for r in held if all(meets(r, c) for c in rule)])
        covered = [r for r in rows if all(meets(r, c) for c in rule)]
        size = sum(r[3] for r in covered)
        # With a row of each kind added, so that a few held rows alone prove little.
        if not p or p / (p + n) < MIN_PRECISION or (p + 1) / (p + n + 2) < 0.9 or size < MIN_COVER * total:
            break
        rules.append(Rule(tuple(Condition(names[f], up, edges[f][b - 1]) for f, b, up in rule), size, p / (p + n)))
        rows = [r for r in rows if not all(meets(r, c) for c in rule)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The ordered rules whose verdict is "reject", from labels (doc_id, quality: 0 is bad)."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", (F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("order"))
        .orderBy("order", "doc_id", "bad").limit(max_labelled)
    )
    # At most max_labelled rows of a number and a flag, so the broadcast has a bound.
    known = docs.join(F.broadcast(sample), "doc_id").select("order", "bad", features(F.col("text")).alias("q"))
    names = list(SHARES)
    shares = known.select(F.pmod("order", F.lit(3)).alias("part"), "bad", *(SHARES[n](F.col("q")).alias(n) for n in names)).persist()
    cuts = shares.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(n, [i / BINS for i in range(1, BINS)], 1_000_000).alias(n) for n in names)).first()
    if not cuts["n"]:
        shares.unpersist()
        return []
    # The smallest cut has nothing below it unless it is above the least value; edges are [lower bound of bin 1, 2, ...].
    edges = [sorted({*cuts[n]} | {x * 0.5 for x in cuts[n][-1:] if x and not cuts[n][0]}) for n in names]
    binned = [sum([(F.col(n) >= e).cast("int") for e in es], F.lit(0)) for n, es in zip(names, edges, strict=True)]
    counts = shares.groupBy(F.array(*binned).alias("bins"), "bad", (F.col("part") > 0).alias("grow")).count().collect()
    shares.unpersist()
    rows = sorted((tuple(r["bins"]), r["bad"], r["grow"], r["count"]) for r in counts)
    return _cover(rows, len(names), edges, names, cuts["n"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor the learned list rejects, with their columns."""
    rules = learn(docs, labels)
    return docs.where(judged(F.col("text"), rules)["kept"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = docs.select("doc_id", judged(F.col("text"), rules).alias("j"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *(F.col(f"j.q.{f}").alias(f) for f in fields), "j.base_failed", "j.kept", F.col("j.rule").cast("bigint").alias("rule"))
