"""Quality rules whose limits follow the data: measured per document, learned per language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import words, written

#: Relative width of a sketch's bins: a quantile is off by a hundredth at most.
GAMMA = 1.02
#: Bins from the zero bin to that of 1; what is smaller than the least bin's value goes there.
ZERO = 600
#: Rules: share of a group's documents, in thousandths, below (or, of two, between) which their values are taken as usual.
RULES = {"symbols": (900,), "repeats": (990,), "lines": (990,), "capitals": (900,), "per_distinct": (900,), "word_length": (900, 100)}
#: How far beyond the usual values a limit lies, in distances from the median, and in bins (a tenth of the value) at least;
#: the documents that a group's language, and a language's corpus, weigh in its limits.
REACH, MARGIN, PRIOR = 2, 5, 20
WINDOW = 8


def bin_of(value: Column) -> Column:
    """Bin of a sketch: values from GAMMA**(k-1), exclusive, to GAMMA**k have bin k + ZERO, or 1 if that is less; 0 has bin 0."""
    return F.when(value > 0, F.greatest(F.ceil(F.log(value) / F.lit(math.log(GAMMA))) + ZERO, F.lit(1))).otherwise(F.lit(0)).cast("int")


def measure(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and ``bins``, a struct of sketch bins.

    Repeated windows: windows of eight words get a hash each; only if two hashes of a text agree the windows themselves
    are sorted, so the count is exact and most texts stop at the hashes. Null and empty texts measure 0 in everything.
    """
    w, n = F.col("_words"), F.col("n_words")
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)).cast("int"))
    window = lambda i: F.slice(w, i, WINDOW)
    # hash of one word, then of 2, 4 and 8 from those of half the length; the last few of a text stand for less
    doubled = lambda h, k: F.zip_with(h, F.slice(h, k + 1, F.greatest(F.size(h) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.when(repeated, F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(window(i), " ").alias("w"), i.alias("i")))))
    p = F.col("_placed")
    beside = lambda x, j: F.get(p, j - 1)["w"].eqNullSafe(x["w"]) | F.get(p, j + 1)["w"].eqNullSafe(x["w"])
    found = F.array_sort(F.transform(F.filter(p, beside), lambda x: x["i"]))
    covered = F.aggregate(found, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("c")),
                          lambda a, i: F.struct(i.alias("last"), (a["c"] + F.least(F.lit(WINDOW), i - a["last"])).alias("c")), lambda a: a["c"])
    t = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = F.greatest(n, F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return (df.withColumn("_words", words(F.col(text))).withColumn("_lines", filled)
            .withColumn("n_words", F.size(w).cast("long"))
            .withColumn("_hashes", F.when(n > WINDOW, doubled(w, 1)))
            .withColumn("_hashes", doubled(F.col("_hashes"), 2)).withColumn("_hashes", doubled(F.col("_hashes"), 4))
            .withColumn("_placed", placed)
            .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
            .withColumn("n_symbols", F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .withColumn("bins", F.struct(
                bin_of(F.col("n_symbols") / d).alias("symbols"), bin_of(F.col("n_repeat_words") / d).alias("repeats"),
                bin_of(F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1))).alias("lines"),
                bin_of(F.regexp_count(t, F.lit("[A-Z]")) / chars).alias("capitals"),
                bin_of(n / F.greatest(F.size(F.array_distinct(w)), F.lit(1))).alias("per_distinct"),
                bin_of(F.col("word_chars") / d).alias("word_length")))
            .drop("_words", "_lines", "_hashes", "_placed"))


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches as rows (keys, rule, bin, n). Sketches of groups merge by adding n; a sketch has as many rows as bins
    at most, whatever the number of documents."""
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bins.{r}").alias("bin")) for r in RULES]))
    return measured.select(*keys, rows.alias("_x")).groupBy(*keys, "_x.rule", "_x.bin").agg(F.count("*").alias("n"))


def _limits(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Columns keys, rule, n_docs, upper and lower (null for one-sided rules; bins): the quantile of the rule, and as far beyond
    it as REACH times its distance from the median, but for rules that most documents measure zero in."""
    of = Window.partitionBy(*keys, "rule")
    t = (sketches.withColumn("upto", F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("all", F.sum("n").over(of)))
    share = lambda i: F.create_map(*[x for r, v in RULES.items() for x in (F.lit(r), F.lit(v[i] if i < len(v) else None).cast("int"))])[F.col("rule")]
    at = lambda q: F.min(F.when(F.col("upto") * 1000 >= F.col("all") * q, F.col("bin"))).cast("long")
    t = t.groupBy(*keys, "rule").agg(at(F.lit(500)).alias("mid"), at(share(0)).alias("high"), at(share(1)).alias("low"), F.max("all").alias("n_docs"))
    beyond = lambda x: F.greatest(F.abs(F.col(x) - F.col("mid")) * REACH, F.lit(MARGIN))
    upper = F.when(F.col("mid") > 0, F.col("high") + beyond("high")).otherwise(F.col("high"))
    return t.select(*keys, "rule", "n_docs", upper.alias("upper"), F.greatest(F.col("low") - beyond("low"), F.col("low") * 0).alias("lower"))


def learn(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """Limits per language and source: columns lang, source and limits, one row per pair that occurs (null is a value).

    Sketches of all pairs are summed where the documents are read; those of a language and of everything are merged
    from them. A pair's limits are drawn towards its language's, and those towards everything's, as if these had PRIOR
    documents in it, so a small group goes with the larger one and a large group by itself."""
    pairs = written(sketch(measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), "bins"), ["lang", "source"]))
    merged = lambda keys: pairs.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    named = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    of_all, by_lang = named(_limits(merged([]), []), "a_"), named(_limits(merged(["lang"]), ["lang"]), "b_")
    drawn = lambda n, own, to: F.expr(f"({n} * {own} + {PRIOR} * {to}) div ({n} + {PRIOR})")
    by_lang = by_lang.join(of_all, F.col("a_rule") == F.col("b_rule"))
    by_lang = by_lang.select("b_lang", "b_rule", *[drawn("b_n_docs", f"b_{x}", f"a_{x}").alias(f"b_{x}") for x in ("upper", "lower")])
    both = _limits(pairs, ["lang", "source"]).join(by_lang, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("rule") == F.col("b_rule")))
    limit = F.struct("rule", F.struct(*[drawn("n_docs", x, f"b_{x}").alias(x) for x in ("lower", "upper")]))
    return written(both.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(limit)).alias("limits")))


def judge(measured: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds base_failed (under 20 words, or more than 30 in 100 in repeated windows), broken (the rules by whose limits of its
    language and source a document is out) and kept, which is true if neither holds. The limits are a table of
    their own: Spark sends it to the documents where its measured size allows, and joins by key beyond that."""
    t = limits.select(F.struct("*").alias("_limits"))
    at = lambda rule, x: F.col("_limits.limits")[rule][x]
    beyond = lambda rule: (F.col(f"bins.{rule}") > at(rule, "upper")) | F.coalesce(F.col(f"bins.{rule}") < at(rule, "lower"), F.lit(False))
    broken = F.array_compact(F.array(*[F.when(beyond(rule), F.lit(rule)) for rule in RULES]))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (measured.join(t, F.col(lang).eqNullSafe(F.col("_limits.lang")) & F.col(source).eqNullSafe(F.col("_limits.source")))
            .withColumn("base_failed", failed).withColumn("broken", broken).withColumn("kept", ~failed & (F.size("broken") == 0)).drop("_limits"))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns. They are measured once and written with their measures:
    limits read the measures only, and the verdict passes the rows on as they lie, so texts are never shuffled. Null and
    empty texts go; repeated rows share a fate; an empty table stays empty. Input columns of the names added here don't
    get in the way: they are set aside."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = written(measure(own, "text").drop("text"))
    return judge(measured, learn(measured, "lang", "source"), "lang", "source").where("kept").select("_row.*")
