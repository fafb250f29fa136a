"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

All per-document work is column expressions. The votes of a document form one of at most 3**8
patterns; only the counts of patterns come to the driver, where the two-class model is fitted. The
posterior is a sum of eight learned log-ratios, so it is an expression again and joins nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read

#: Frequent function words of the four languages of the corpora (fixed values).
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from or an at which not have "
    "de la le et les des en un une du que est pour dans par sur pas "
    "der die das und ist von zu mit den auf für nicht ein eine dem sich "
    "el los las y del se por con una para como su al"
).split()
#: Rules: name, and thresholds beyond which the rule votes against or for; between them it abstains.
RULES = ("symbols", "duplicate_lines", "repetition", "word_length", "stop_words", "shouting", "sentences", "diversity")
SPACE = "[\\\\x20\\\\x09-\\\\x0D]"


def _count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and a struct q of the measures of each whole text; null texts have no words.

    Repeated three-word windows: each window is one long, its hash above its position, so sorting the
    longs brings equal windows together; neighbours that agree in the hash are compared word by word.
    """
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    df = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = df.selectExpr(*[f"`{c}`" for c in keep], "_t", f"filter(split(_t, '{SPACE}+'), x -> x != '') AS _w")
    df = df.selectExpr("*", "size(_w) AS _n", "char_length(bin(size(_w))) AS _b")
    df = df.selectExpr("*", "sort_array(transform(slice(_w, 1, greatest(_n - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(_w, i + 1), get(_w, i + 2)), _b) | i)) AS _s")
    same = "shiftright(x, _b) = shiftright({y}, _b) AND get(_w, {p}) = get(_w, {q}) AND get(_w, {p} + 1) = get(_w, {q} + 1) AND get(_w, {p} + 2) = get(_w, {q} + 2)"
    at = lambda v: f"CAST({v} & (shiftleft(1L, _b) - 1) AS INT)"
    before = same.format(y="get(_s, i - 1)", p=at("x"), q=at("get(_s, i - 1)"))
    after = same.format(y="get(_s, i + 1)", p=at("x"), q=at("get(_s, i + 1)"))
    df = df.selectExpr("*", f"sort_array(transform(filter(_s, (x, i) -> ({before}) OR ({after})), x -> {at('x')})) AS _p")
    df = df.selectExpr("*", f"filter(split(_t, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]') AS _l")
    return df.selectExpr(
        *[f"`{c}`" for c in keep],
        f"""named_struct(
            'n_words', CAST(_n AS BIGINT),
            'word_chars', CAST(length(array_join(_w, '')) AS BIGINT),
            'n_symbols', CAST({_count("_t", "#*$%&|<>")} AS BIGINT),
            'n_lines', CAST(size(_l) AS BIGINT),
            'n_dup_lines', CAST(size(_l) - size(array_distinct(_l)) AS BIGINT),
            'n_repeat_words', CAST(aggregate(_p, named_struct('n', 0, 'e', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.e), 'e', p + 3), a -> a.n) AS BIGINT),
            'n_stop', CAST(size(filter(_w, x -> lower(x) IN ({stop}))) AS BIGINT),
            'n_distinct', CAST(size(array_distinct(_w)) AS BIGINT),
            'n_upper', CAST({_count("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁ")} AS BIGINT),
            'n_ends', CAST(length(_t) - length(replace(_t, '.', '')) AS BIGINT),
            'n_bangs', CAST(length(_t) - length(replace(_t, '!', '')) AS BIGINT)) AS q""",
    )


def votes(q: str = "q") -> list[Column]:
    """One column for each rule: 1 for keeping, -1 against, 0 for abstaining."""
    c = lambda name: F.col(f"{q}.{name}")
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))

    def vote(against: Column, for_: Column) -> Column:
        return F.when(against, -1).when(for_, 1).otherwise(0)

    symbols, repeated = c("n_symbols") / chars, c("n_repeat_words") / words
    duplicate = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    length, stop, upper = chars / words, c("n_stop") / words, c("n_upper") / chars
    ends, bangs, distinct = c("n_ends") / words, c("n_bangs") / words, c("n_distinct") / words
    some = c("n_words") >= 30
    out = [
        vote(symbols > 0.1, symbols < 0.01),
        vote((duplicate > 0.3) & (c("n_lines") >= 5), (duplicate < 0.1) & (c("n_lines") >= 3)),
        vote((repeated > 0.3) & some, (repeated < 0.1) & some),
        vote((length > 12) | (length < 2.5), length.between(3, 9)),
        vote((stop < 0.05) & some, (stop > 0.12) & some),
        vote((upper > 0.3) | (bangs > 0.3), (upper < 0.1) & (bangs < 0.05)),
        vote((ends < 0.01) & some, ends.between(0.02, 0.3) & some),
        vote((distinct < 0.25) & (c("n_words") < 2000) & some, (distinct > 0.4) & some),
    ]
    return [v.cast("int").alias(name) for v, name in zip(out, RULES)]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, float]]]:
    """Log prior odds and, for each rule and vote, the log-ratio of good to bad, by EM.

    patterns: the distinct vote patterns and their counts. At the start a vote against is rare in good
    texts and common in bad ones, where each rule catches its own kind of badness, and other votes say
    little; this fixes which class is the good one. Abstaining is no evidence. Add-one smoothing keeps ratios finite.
    """
    m = len(RULES)
    total = sum(n for _, n in patterns)
    prior = 0.8
    table = [[{1: 0.996, -1: 0.004}, {1: 0.8, -1: 0.2}] for _ in range(m)]
    for _ in range(rounds if total else 0):
        good = 0.0
        sums = [[{1: 1.0, -1: 1.0}, {1: 1.0, -1: 1.0}] for _ in range(m)]
        for pattern, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[0][v] / t[1][v]) for t, v in zip(table, pattern) if v)
            p = 1 / (1 + math.exp(-max(-500, min(500, odds))))
            good += n * p
            for s, v in zip(sums, pattern):
                if v:
                    s[0][v] += n * p
                    s[1][v] += n * (1 - p)
        prior = min(max(good / total, 1e-6), 1 - 1e-6)
        table = [[{v: x / sum(side.values()) for v, x in side.items()} for side in s] for s in sums]
    return math.log(prior / (1 - prior)), [{v: math.log(t[0][v] / t[1][v]) for v in (-1, 1)} | {0: 0.0} for t in table]


def fitted(measures: DataFrame) -> Column:
    """Posterior probability of quality over rows with q, from the votes of all rows of measures."""
    counted = measures.select(*votes()).groupBy(*RULES).agg(F.count("*").alias("n"))
    patterns = sorted((tuple(r)[:-1], r[-1]) for r in counted.collect())  # at most 3**8 rows
    prior, ratios = fit(patterns)
    odds = F.lit(prior)
    for column, ratio in zip(votes(), ratios):
        odds = odds + F.when(column == 1, ratio[1]).when(column == -1, ratio[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("q.n_words") < 50) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words"))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, posterior and kept for each row of docs(doc_id, text).

    Null and empty texts have no words and fail the base; rows are judged one by one, so repeated rows
    get equal verdicts; an empty table gives an empty result.
    """
    m = durable(measured(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id"))
    posterior = fitted(m)
    return m.select("doc_id", "q.*", "q").withColumns({"base_failed": base_failed(), "posterior": posterior}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("q")


def keep_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with their own columns, that quality() keeps.

    The measures are written with the rows: the posterior names each many times, and unless they are
    stored the optimiser would put their expressions in place of the names.
    """
    rows = durable(measured(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_d"), "text"), "_d"))
    return rows.where(~base_failed() & (fitted(rows) >= threshold)).select("_d.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
