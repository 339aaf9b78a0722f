"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of each text are Spark expressions. Sequential covering learns the list from labelled documents: a rule
grows by the threshold condition of the highest information gain until it covers good documents no more, is pruned
from its end on rows that it didn't grow on, and what it covers leaves before the next rule is learned. The list is
emitted as one ordered conditional expression: the first rule that holds rejects, and what no rule covers is kept.

Learning takes a bounded sample: `SAMPLE` labelled documents, those with the lowest hash of doc_id.

Defined results: a null text has no words, so it fails the base rule; a null doc_id is a document like others but
never one to learn from; repeated rows give repeated results; an empty or missing sample gives an empty list, which
keeps whatever passes the base rule; columns that the operator doesn't name are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table

SAMPLE = 20_000
WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "bangs", "distinct", "digits", "stops")


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words_sql(words: str, n: int = WINDOW) -> str:
    """Words in windows of n words that the array holds twice or more, overlapping ones counted once.

    Windows are compared by a 64-bit hash of their n words. Texts without a repeated window, nearly all, end at
    the distinct count; else the windows are sorted by hash, and the starts of those with an equal neighbour say
    how many words are covered: each start adds n words, or as many as there are up to the next start.
    """
    hashes = f"transform(sequence(1, size({words}) - {n - 1}), p -> xxhash64(slice({words}, p, {n})))"
    ordered = "sort_array(transform(hs, (h, p) -> struct(h AS h, p AS p)))"
    starts = "sort_array(transform(filter(os, (o, k) -> coalesce(o.h = get(os, k - 1).h, false) OR coalesce(o.h = get(os, k + 1).h, false)), o -> o.p))"
    covered = f"aggregate(transform(ps, (p, k) -> least({n}, coalesce(get(ps, k + 1) - p, {n}))), 0L, (a, x) -> a + x)"
    body = f"IF(size(array_distinct(hs)) = size(hs), 0L, {_let(ordered, 'os', _let(starts, 'ps', covered))})"
    return f"IF(size({words}) < {n}, 0L, {_let(hashes, 'hs', body)})"


def _count_of(chars: str, text: str = "text") -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


#: Columns that statistics() makes.
STATISTICS = frozenset((*FEATURES, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), text_again: bool = False) -> DataFrame:
    """`keep`, the five base counts, and the features of the rules; with `text_again`, `keep` may hold the text itself."""
    if text_again:
        docs = docs.select(F.struct(*keep).alias("__row"), F.col(text_col).alias("__text"))
        return statistics(docs, "__text", ("__row",)).select("__row.*", *sorted(STATISTICS))
    t = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # spark_partition_id() keeps later filters and projections above: pushed into, they would split the text or look for windows again and again
    t = t.withColumn("words", F.when(F.spark_partition_id() >= 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    t = t.withColumn("lines", F.expr(r"filter(split(text, '\n', -1), l -> length(translate(l, ' \t\n\x0b\f\r', '')) > 0)".replace(r"\x0b", "\x0b").replace(r"\f", "\x0c")))
    bare = "translate(text, ' \t\n\x0b\x0c\r', '')"
    t = t.select(
        *keep, F.expr("size(words)").cast("long").alias("n_words"), F.expr(f"length({bare})").cast("long").alias("word_chars"),
        F.expr(_count_of(SYMBOLS)).cast("long").alias("n_symbols"), F.expr("size(lines) - size(array_distinct(lines))").cast("long").alias("n_dup_lines"),
        F.when(F.spark_partition_id() >= 0, F.expr(repeat_words_sql("words"))).alias("n_repeat_words"), F.expr("size(lines)").alias("__lines"), F.expr("size(array_distinct(words))").alias("__distinct"),
        F.expr("length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÚÁ', ''))").alias("__not_capital"), F.length("text").alias("__chars"),
        F.expr(_count_of("!?")).alias("__bangs"), F.expr(_count_of("0123456789")).alias("__digits"), F.expr(_count_of(".,;:")).alias("__stops"),
    )
    per_word, per_char = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    features = {
        "word_length": F.col("word_chars") / per_word, "symbols": F.col("n_symbols") / per_word, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / per_word, "capitals": (F.col("__chars") - F.col("__not_capital")) / per_char, "bangs": F.col("__bangs") / per_word,
        "distinct": F.col("__distinct") / per_word, "digits": F.col("__digits") / per_char, "stops": F.col("__stops") / per_word,
    }
    return t.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[v.alias(k) for k, v in features.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", n: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of n labelled documents at most, each by its least text. Only their texts are measured."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = statistics(own, keep=("doc_id", "label"))
    rows = [r[1:] for r in rows.select(base_failed(), "label", *FEATURES).collect() if not r[0]]
    data = np.array(sorted(rows), float).reshape(len(rows), 1 + len(FEATURES))
    return data[:, 1:], data[:, 0]


Condition = tuple[int, str, float]


def holds(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, op, v in rule:
        out &= (x[:, k] >= v) if op == ">=" else (x[:, k] <= v)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int = 4) -> list[Condition]:
    rule: list[Condition] = []
    on = np.ones(len(x), bool)
    while len(rule) < most and (p := bad[on].sum()) and (n := (~bad[on]).sum()):
        best = (0.0, None)
        for k, values in enumerate(cuts):
            column = x[on, k]
            for op in (">=", "<="):
                hit = column[None, :] >= values[:, None] if op == ">=" else column[None, :] <= values[:, None]
                hp = (hit & bad[on][None, :]).sum(1)
                hn = hit.sum(1) - hp
                gain = np.where(hp > 0, hp * (np.log2(np.maximum(hp, 1) / np.maximum(hp + hn, 1)) - np.log2(p / (p + n))), 0.0)
                i = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), (k, op, float(values[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= holds([best[1]], x)
    return rule


def learn(x: np.ndarray, y: np.ndarray, max_rules: int = 12, precision: float = 0.95, cuts: int = 64) -> list[list[Condition]]:
    """Rules for label 0, in order. A third of the rows prunes; a rule stays if at least `precision` of what it covers there is bad."""
    rules: list[list[Condition]] = []
    left = np.ones(len(x), bool)
    prune = np.random.default_rng(0).random(len(x)) < 1 / 3
    bad = y < 0.5
    while len(rules) < max_rules:
        grow, test = left & ~prune, left & prune
        if bad[grow].sum() < 8 or bad[test].sum() < 2:
            break
        inner = x[grow & bad]
        values = [np.unique(np.round(np.quantile(inner[:, k], np.linspace(0, 1, cuts)), 6)) for k in range(x.shape[1])]
        rule = _grow(x[grow], bad[grow], values)
        worth = lambda r: ((m := holds(r, x[test])) & bad[test]).sum() / max(1, m.sum()) - (1e-3 if not r else 0)
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        found = holds(rule, x[test])
        if not rule or found.sum() < 2 or bad[test][found].mean() < precision:
            break
        rules.append(rule)
        left &= ~holds(rule, x)
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """True where a document is kept: the rules as WHEN branches in their order, and keeping as the default."""
    out = None
    for rule in rules:
        cond = None
        for k, op, v in rule:
            one = F.col(FEATURES[k]) >= F.lit(v) if op == ">=" else F.col(FEATURES[k]) <= F.lit(v)
            cond = one if cond is None else cond & one
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame | None, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """`keep`, all statistics, base_failed and kept."""
    rules = learn(*labelled_sample(docs, labels, n=sample)) if labels is not None else []
    out = statistics(docs, keep=keep).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(expression(rules)))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
