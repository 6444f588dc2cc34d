"""Quality rules as a short-circuit cascade.

Each rule says when a text is to be rejected. A bounded sample gives every rule's cost (steps a row)
and selectivity (share rejected); rules are put in order of rejection per cost and become one CASE
expression, of which Spark evaluates no branch after the first that holds. A rule's cost is the mean of its
steps on the sample's texts, which each rule states by the sizes of a text; clock times of single jobs vary
more than rules do, and would give another order each time. Rules that reject nothing in the sample keep
their given order, last. The verdict is the OR of all
rules and so doesn't depend on the order; only the work does.

Defined results: a null or empty text has no words and is rejected; long texts are taken whole; repeated
rows get the same verdict each; an empty table gives an empty result (rules keep their given order);
extra columns don't matter, as nothing is added to the input's columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspark.llm.common import UPPER, let, words

#: The symbols that count as junk.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 1000


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)


def n_dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_repeat_words(tokens: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Texts whose windows are all distinct, most of them, end
    after one hash-set pass; the others sort (window, position) and sum what each window adds.
    """

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(
            ordered,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
            ),
        )
        at = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        gains = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gains, F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        windows = F.slice(
            F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW)))), 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
        )
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), count)


def n_stutters(tokens: Column) -> Column:
    """Words equal to the word before them."""
    return let(tokens, lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))))


#: A count by its name, which is worked out only if it isn't at hand.
Known = Callable[[str, Callable[[], Column]], Column]


def anew(name: str, count: Callable[[], Column]) -> Column:
    return count()


@dataclass(frozen=True)
class Rule:
    """`rejects` takes the text, its words and what is known of them, and gives a boolean column, never null.

    `steps` takes text and words and says how much work that is, in characters read once.
    """

    name: str
    rejects: Callable[[Column, Column, Known], Column]
    steps: Callable[[Column, Column], Column] = lambda t, w: F.length(t)


#: The thresholds of the default rules, and their steps: a hash of a word or an array's
#: element made anew costs some thirty characters, a comparison of two words ten.
RULES = (
    Rule("few_words", lambda t, w, k: F.size(w) < 10, lambda t, w: F.lit(1)),
    Rule("repeated_windows", lambda t, w, k: k("n_repeat_words", lambda: n_repeat_words(w)) * 100 > F.size(w) * 20, lambda t, w: F.size(w) * 120),
    Rule("symbols", lambda t, w, k: k("n_symbols", lambda: n_symbols(t)) * 10 > F.size(w), lambda t, w: F.length(t)),
    Rule("duplicate_lines", lambda t, w, k: k("n_dup_lines", lambda: n_dup_lines(t)) * 100 > F.size(lines_with_words(t)) * 40, lambda t, w: F.length(t) * 4),
    Rule("stutter", lambda t, w, k: n_stutters(w) * 100 > F.size(w) * 40, lambda t, w: F.size(w) * 40),
    Rule("capitals", lambda t, w, k: (F.length(t) - F.length(F.translate(t, UPPER, ""))) * 100 > F.length(t) * 30),
    Rule("word_length", lambda t, w, k: let(k("word_chars", lambda: F.length(F.array_join(w, ""))), lambda n: (n < F.size(w) * 2) | (n > F.size(w) * 40)), lambda t, w: F.length(t) + F.size(w) * 10),
)


@dataclass(frozen=True)
class RuleCost:
    rule: Rule
    cost: float
    rejected: float

    @property
    def rejection_per_cost(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def measure(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[RuleCost]:
    """Cost and selectivity of each rule on about `sample_rows` rows, best rejection per cost first.

    The sample's bound is the parameter; it decides the order of work only, never a verdict.
    """
    total = df.count()
    if not total or not rules:
        return [RuleCost(r, 1.0, 0.0) for r in rules]
    sample = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(False, min(1.0, sample_rows / total), seed=11).select("t", words(F.col("t")).alias("w"))
    t, w = F.col("t"), F.col("w")
    each = [x for i, r in enumerate(rules) for x in (F.avg(r.rejects(t, w, anew).cast("int")).alias(f"rejected_{i}"), F.avg(r.steps(t, w)).alias(f"cost_{i}"))]
    found = sample.agg(*each).collect()[0]
    return sorted((RuleCost(r, float(found[f"cost_{i}"] or 1), float(found[f"rejected_{i}"] or 0)) for i, r in enumerate(rules)), key=lambda x: -x.rejection_per_cost)


def rejected(text: Column, tokens: Column, rules: list[Rule] | tuple[Rule, ...], known: Known = anew) -> Column:
    """True where some rule rejects; rules after the first that holds aren't evaluated."""
    case = None
    for rule in rules:
        hit = rule.rejects(text, tokens, known)
        case = F.when(hit, True) if case is None else case.when(hit, True)
    return F.lit(False) if case is None else case.otherwise(False)


def quality_filter(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `df` that no rule rejects, with the columns of `df`."""
    order = [x.rule for x in measure(df, rules, text, sample_rows)]
    whole = F.coalesce(F.col(text), F.lit(""))
    keep = let(F.struct(whole.alias("t"), words(whole).alias("w")), lambda x: ~rejected(x["t"], x["w"], order))
    return df.where(keep)


def quality_report(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document with its counts, `base_failed` and `kept`."""
    rest = tuple(r for r in rules if r.name not in ("few_words", "repeated_windows"))
    order = [x.rule for x in measure(df, rest, "text", sample_rows)]
    t, w = F.col("t"), F.col("w")
    tokens = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", words(t).alias("w"))
    counted = tokens.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        n_symbols(t).cast("long").alias("n_symbols"),
        n_dup_lines(t).cast("long").alias("n_dup_lines"),
        n_repeat_words(w).cast("long").alias("n_repeat_words"),
        "t",
        "w",
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    base = counted.withColumn("base_failed", failed)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(~rejected(t, w, order, lambda name, _: F.col(name))).alias("kept")
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
b AS (SELECT w.doc_id, t, w, l, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters,
             length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols * 10 > n_words OR n_dup_lines * 100 > len(l) * 40
         OR stutters * 100 > n_words * 40 OR capitals * 100 > length(t) * 30
         OR word_chars < n_words * 2 OR word_chars > n_words * 40) AS kept
FROM f
"""
