"""Quality rules whose cutoffs carry an exact bound on false rejections.

Documents are described by counts made with SQL functions alone.  Each rule
rejects a document whose ratio exceeds a cutoff.  Labelled texts are dealt by
their id into two halves: one proposes, the other, the holdout, tests.

1. For each stratum the first half makes a path of LEVELS, from the safest on:
   at every level a rule's cutoff is a multiple of the largest value of a good
   text, or an upper quantile of the good ones.  A rule takes part in a level if
   it gains there, each good text lost weighing as PENALTY junk ones.
2. On the holdout, each level is a hypothesis: "more than ALPHA of the stratum's
   good documents are rejected by one or another rule of this level".  Its exact
   binomial p-value is P(X <= k | n, ALPHA), k of n good texts being rejected.
   Levels are tested in order and a path ends at the first that fails, so levels
   need no correction among themselves (fixed-sequence testing).
3. Strata share DELTA by Holm's rule: with c of m paths rejected to their ends,
   the others are tested at DELTA / (m - c).  Hence, with confidence 1 - DELTA, in
   no stratum does a certified level reject more than ALPHA of the good documents.
4. Of the certified levels the one with the largest gain on the first half is
   used; a stratum in which none gains keeps the base rule alone.  A path needs
   ln(DELTA / m) / ln(1 - ALPHA) good holdout texts to pass its first level with
   none rejected: 86 for four strata.

Equal texts of a stratum are one piece of evidence, since the binomial test wants
independent ones; near copies still count apart, which makes the bound a little
too sure where they are many.  A text with both labels, on one id or on several,
is left out.

Null texts have no words.  Rows repeat as they come.  A null stratum (lang) is one
of its own, as the empty text.  Rows with a null id are judged but bring no label.
Columns of other names, and of the names made here, may be in the table: only those
asked for are read.  Without labels only the base rule holds; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.llm import common

ALPHA = 0.05
DELTA = 0.05
PENALTY = 10
HOLDOUT = "(doc_id % 1000003) * 7919 % 1009 % 2 = 1"  # half of the ids, by a rule that every SQL has
SLACK = (1.5, 1.25, 1.0)  # multiples of the largest good value: the first levels
QUANTILES = (0.999, 0.998, 0.995, 0.99, 0.98, 0.97, 0.95, 0.9)  # of good values: the others
SYMBOLS = "#*$%&|<>"
RULES = {
    "symbol_ratio": "n_symbols / n_words",
    "word_length": "word_chars / n_words",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "repeat_ratio": "n_repeat_words / n_words",
}

# `transform(array(x), v -> f(v))[0]` binds x to v, so that it is computed once.
_HASHES = "transform(sequence(1, size(w) - 2), i -> xxhash64(get(w, i - 1), get(w, i), get(w, i + 1)))"
_STARTS = """
    sort_array(transform(
      filter(s, (x, i) -> (i > 0 AND x.h = get(s, i - 1).h) OR (i + 1 < size(s) AND x.h = get(s, i + 1).h)),
      x -> x.p))
"""
_REPEATED = f"""
  CASE WHEN size(w) < 3 THEN 0L ELSE transform(array({_HASHES}), g ->
    CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE
      transform(array(sort_array(transform(g, (h, p) -> struct(h AS h, p AS p)))), s ->
        aggregate({_STARTS}, struct(-9 AS last, 0L AS n),
          (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n))[0]
    END)[0]
  END
"""


def describe(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", extra: tuple[str, ...] = ()
) -> DataFrame:
    """The counts of each document and the base rule, beside the extra columns.

    n_repeat_words is the union of the 3-word windows that occur twice: a start
    p covers min(3, p - previous start) words that earlier ones do not.
    """
    text = common.text_or_empty(text_col)
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")
    carried = [F.col(c).alias(f"extra_{i}") for i, c in enumerate(extra)]
    split = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), text.alias("t"), *carried)
    held = [f"extra_{i}" for i in range(len(extra))]
    with_words = split.selectExpr(
        *held,
        "doc_id",
        "stratum",
        "xxhash64(t) AS text_hash",
        f"""transform(array(filter(split(t, r'{common.SPACE}'), x -> x <> '')), w -> named_struct(
              'n_words', size(w), 'word_chars', length(array_join(w, '')), 'n_repeat_words', {_REPEATED}))[0] AS a""",
        f"CAST(regexp_count(t, '[{SYMBOLS}]') AS BIGINT) AS n_symbols",
        """transform(array(filter(split(t, '\\n'), x -> rlike(x, r'[^\\x20\\x09-\\x0D]'))), l -> named_struct(
              'n', size(l), 'd', size(l) - size(array_distinct(l))))[0] AS b""",
    )
    names = [f"{h} AS `{c}`" for h, c in zip(held, extra, strict=True)]
    return with_words.selectExpr(
        *names, "doc_id", "stratum", "text_hash", "CAST(a.n_words AS BIGINT) n_words", "CAST(a.word_chars AS BIGINT) word_chars", "n_symbols",
        "CAST(b.n AS BIGINT) n_lines", "CAST(b.d AS BIGINT) n_dup_lines", "a.n_repeat_words",
        "a.n_words < 50 OR 100 * a.n_repeat_words > 50 * a.n_words AS base_failed",
    )


def _ratios() -> list[tuple[str, str]]:
    return [(name, "CAST(try_divide({}, {}) AS DOUBLE)".format(*ratio.split(" / "))) for name, ratio in RULES.items()]


def _evidence(feats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """A row per labelled distinct text of a stratum: stratum, holdout, good and the rules' ratios."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("mark"))
    known = feats.filter("NOT base_failed").selectExpr("doc_id", "stratum", "text_hash", *[f"{r} AS {name}" for name, r in _ratios()])
    values = [F.max(name).alias(name) for name in RULES]  # equal for equal texts
    one = known.join(marks, "doc_id").groupBy("stratum", "text_hash")
    one = one.agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("low"), F.max("mark").alias("good"), *values).filter("low = good")
    return one.selectExpr("stratum", f"{HOLDOUT} AS holdout", "good", *RULES)


def certified_levels(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """A row per stratum and level: the cutoffs max_<rule>, k, n, p_value, chain (the largest
    p-value so far), at (what it must not exceed), certified, gain."""
    rows = common.stored(_evidence(feats, labels, id_col, label_col), "quality-evidence")
    first = rows.filter("NOT holdout")
    long = first.selectExpr("stratum", "good", f"stack({len(RULES)}, {', '.join(f"'{r}', {r}" for r in RULES)}) AS (rule, value)").filter("value IS NOT NULL")
    slack = ", ".join(f"{x}D * max(value)" for x in SLACK)
    quantiles = ", ".join(map(str, QUANTILES))
    cutoffs = F.expr(f"concat(array({slack}), percentile_approx(value, array({quantiles})))").alias("cutoffs")
    proposed = common.stored(long.filter("good = 1").groupBy("stratum", "rule").agg(cutoffs), "quality-cutoffs")
    gain = f"count_if(good = 0 AND {{0}}) - {PENALTY} * count_if(good = 1 AND {{0}})"
    alone = long.join(proposed, ["stratum", "rule"]).selectExpr("stratum", "rule", "good", "value", "posexplode(cutoffs) AS (level, cutoff)")
    alone = alone.groupBy("stratum", "rule", "level", "cutoff").agg(F.expr(gain.format("value > cutoff")).alias("gain"))
    path = alone.groupBy("stratum", "level").agg(*[F.max(F.when((F.col("rule") == r) & (F.col("gain") > 0), F.col("cutoff"))).alias(f"max_{r}") for r in RULES])
    path = common.stored(path, "quality-path")
    over = " OR ".join(f"coalesce({r} > max_{r}, false)" for r in RULES)
    counted = rows.join(path, "stratum").withColumn("over", F.expr(over)).groupBy("stratum", "level", *[f"max_{r}" for r in RULES])
    counted = counted.agg(
        F.expr("count_if(holdout AND good = 1)").alias("n"),
        F.expr("count_if(holdout AND good = 1 AND over)").alias("k"),
        F.expr(gain.format("NOT holdout AND over")).alias("gain"),
    )
    # sum of the binomial terms 0..k, each from the last one, in logarithms; k > ALPHA * n needs no test
    tail = f"""CASE WHEN n = 0 OR k > {ALPHA}D * n THEN 1D ELSE
        aggregate(sequence(1, greatest(k, 1)), struct(n * ln(1D - {ALPHA}D) AS l, exp(n * ln(1D - {ALPHA}D)) AS s),
          (a, i) -> transform(array(a.l + ln((n - i + 1D) / i) + ln({ALPHA}D / (1D - {ALPHA}D))), l ->
            struct(CASE WHEN i > k THEN a.l ELSE l END AS l, CASE WHEN i > k THEN a.s ELSE a.s + exp(l) END AS s))[0],
          a -> a.s) END"""
    tested = common.stored(counted.withColumn("p_value", F.expr(tail)), "quality-tested")
    so_far = Window.partitionBy("stratum").orderBy("level")  # as many rows as there are levels
    whole = tested.groupBy("stratum").agg(F.max("p_value").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("p"))  # one for each stratum
    done = f"array_min(transform(p, (x, i) -> IF(x > {DELTA}D / (size(p) - i), i, size(p))))"
    at = whole.selectExpr(f"{DELTA}D / greatest(size(p) - {done}, 1) AS at")
    chained = tested.withColumn("chain", F.max("p_value").over(so_far))
    return chained.crossJoin(F.broadcast(at)).withColumn("certified", F.expr("chain <= at"))  # at is one row


def chosen_cutoffs(levels: DataFrame) -> DataFrame:
    """The level used in each stratum: that of the largest gain, and of several the safest."""
    good = levels.filter("certified AND gain > 0").withColumn("order", F.expr("struct(gain, -level)"))
    row = F.struct("level", "k", "n", "chain", "gain", *[f"max_{r}" for r in RULES])
    return good.groupBy("stratum").agg(F.max_by(row, "order").alias("b")).select("stratum", "b.*")


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", extra: tuple[str, ...] = ()
) -> DataFrame:
    """describe() with kept: false by the base rule or by a certified cutoff.

    The counts are made once and written with the extra columns; all that follows
    reads what it needs of them."""
    feats = common.stored(describe(docs, id_col, text_col, stratum_col, extra), "quality-features")
    cutoffs = common.stored(chosen_cutoffs(certified_levels(feats, labels)), "quality-chosen")
    limits = cutoffs.select("stratum", *[f"max_{r}" for r in RULES])
    over = " OR ".join(f"coalesce({ratio} > max_{r}, false)" for r, ratio in _ratios())
    judged = feats.join(limits, "stratum", "left").withColumn("kept", F.expr(f"NOT base_failed AND NOT ({over})"))
    return judged.drop(*[f"max_{r}" for r in RULES])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_DUCK = [(name, "{} / nullif({}, 0)::DOUBLE".format(*ratio.split(" / "))) for name, ratio in RULES.items()]
_OVER = " OR ".join(f"coalesce({{}} > max_{name}, false)" for name in RULES)
_GAIN = f"count(*) FILTER (good = 0 AND {{0}}) - {PENALTY} * count(*) FILTER (good = 1 AND {{0}})"

#: The same in DuckDB, the binomial tail by log-gamma.
ORACLE_SQL = f"""WITH
 d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
   list_filter(regexp_split_to_array(coalesce(text, ''), '{common.SPACE}'), lambda x: x <> '') AS w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{common.SPACE[1:-2]}]')) AS l FROM documents),
 x AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS often
   FROM (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d))),
 r AS (SELECT doc_id, sum(least(3, p - before))::BIGINT AS n_repeat_words
   FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -9) AS before FROM x WHERE often > 1) GROUP BY doc_id),
 f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
   SELECT doc_id, stratum, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[{SYMBOLS}]')) AS n_symbols,
     len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id))),
 e AS MATERIALIZED (SELECT stratum, {HOLDOUT} AS holdout, good, {", ".join(RULES)} FROM (
   SELECT stratum, min(doc_id) AS doc_id, min(quality) AS good, {", ".join(f"max({x}) AS {name}" for name, x in _DUCK)}
   FROM f JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND NOT base_failed GROUP BY stratum, t HAVING min(quality) = max(quality))),
 v AS MATERIALIZED (SELECT stratum, good, rule, value FROM e, LATERAL (VALUES {", ".join(f"('{r}', {r})" for r in RULES)}) AS q(rule, value)
   WHERE NOT holdout AND value IS NOT NULL),
 o AS (SELECT stratum, rule, list_concat([{", ".join(f"{x}e0 * max(value)" for x in SLACK)}], quantile_disc(value, [{", ".join(map(str, QUANTILES))}])) AS cutoffs
   FROM v WHERE good = 1 GROUP BY stratum, rule),
 g AS (SELECT stratum, rule, level, cutoff, {_GAIN.format("value > cutoff")} AS gain
   FROM v JOIN (SELECT stratum, rule, unnest(cutoffs) AS cutoff, generate_subscripts(cutoffs, 1) AS level FROM o) USING (stratum, rule) GROUP BY ALL),
 h AS MATERIALIZED (SELECT stratum, level, {", ".join(f"max(cutoff) FILTER (rule = '{r}' AND gain > 0) AS max_{r}" for r in RULES)} FROM g GROUP BY stratum, level),
 c AS (SELECT stratum, level, count(*) FILTER (holdout AND good = 1) AS n, count(*) FILTER (holdout AND good = 1 AND over) AS k, {_GAIN.format("NOT holdout AND over")} AS gain
   FROM (SELECT e.*, level, {_OVER.format(*RULES)} AS over FROM e JOIN h USING (stratum)) GROUP BY stratum, level),
 p AS MATERIALIZED (SELECT *, max(p_value) OVER (PARTITION BY stratum ORDER BY level) AS chain FROM (
   SELECT c.*, CASE WHEN n = 0 OR k > {ALPHA}e0 * n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
   exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}e0) + (n - i) * ln(1 - {ALPHA}e0)))) END AS p_value FROM c)),
 i AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM (SELECT max(p_value) AS p FROM p GROUP BY stratum)),
 u AS (SELECT {DELTA}e0 / greatest(any_value(m) - coalesce(min(i) FILTER (p > {DELTA}e0 / (m - i + 1)) - 1, any_value(m)), 1) AS bound FROM i),
 b AS (SELECT stratum, arg_max(level, {{'gain': gain, 'level': -level}}) AS level FROM p, u WHERE chain <= bound AND gain > 0 GROUP BY stratum),
 m AS (SELECT h.* FROM h JOIN b USING (stratum, level))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_OVER.format(*[x for _, x in _DUCK])}) AS kept
 FROM f LEFT JOIN m USING (stratum)"""
