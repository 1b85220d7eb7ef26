"""Risk-controlled quality rules, in DataFrame functions only.

Each rule rejects a document when a share (symbols, capitals, repeated lines,
repeated words) exceeds a cutoff.  Cutoffs come from the labelled documents:
for every stratum, rule and cutoff of a fixed grid, ``n`` good documents of
the stratum are the holdout and ``k`` of them would be rejected.  A cutoff
passes if the exact binomial test rejects "the false rejection rate is at
least alpha / rules", that is if P(Bin(n, alpha / rules) <= k) <= delta / m,
with m the number of (stratum, rule) pairs.  The cutoffs of a pair are tested
in fixed sequence, loosest first, up to the first that fails, so only the
pairs need a correction (Bonferroni), not the grid.  With probability
1 - delta, in every stratum, all rules together reject at most ``alpha`` of
the good documents.  Of the cutoffs that pass each rule takes the one with
the most bad minus good rejections, the loosest among equals; a rule without
one rejects nothing there.  A stratum with fewer good documents than
ln(delta / m) / ln(1 - alpha / rules) can have no cutoff (``strata_report``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm.common import Stages, session

ALPHA = 0.05
DELTA = 0.05
GRID = 50
RULES = ("symbols", "capitals", "dup_lines", "repeats")
CUTOFF_ROWS = 10_000


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, base_failed and the grid bin of each rule's share to df(text)."""
    w5 = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5),
                     lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    none = F.array().cast("array<long>")
    df = df.withColumn("w", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), C.WORD_GAP), ""))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("w", "")).cast("long"))
    df = df.withColumn("hs", F.when(F.col("n_words") >= 5, w5).otherwise(none)).drop("w")
    # windows found twice or more: equal neighbours among the sorted window hashes
    twice = F.size(F.array_distinct("hs")) < F.size("hs")
    df = df.withColumn("s", F.when(twice, F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("hs")
    same = lambda x, i, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("at", F.sort_array(F.transform(
        F.filter("s", lambda x, i: F.when(i > 0, same(x, i, i - 1)).otherwise(F.lit(False)) | same(x, i, i + 1)),
        lambda x: x["i"]))).drop("s")
    step = F.transform("at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("at", i + 1) - p, F.lit(5))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("at")
    df = df.withColumn("lines", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                                         lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    df = df.withColumn("n_lines", F.size("lines").cast("long")).withColumn(
        "n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines")).cast("long")).drop("lines")
    only = lambda keep: F.char_length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[^{keep}]+", "")).cast("long")
    df = df.withColumn("n_symbols", only(r"#*$%&|<>")).withColumn("n_capitals", only(r"\p{Lu}"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    share = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"),
             "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    # integer bin b: the share is above cutoff j / GRID exactly when b > j
    for rule, (part, of) in share.items():
        b = F.expr(f"({part} * {GRID} + {of} - 1) div {of}")
        df = df.withColumn(f"bin_{rule}", F.when(F.col(of) > 0, F.least(b, F.lit(GRID))).otherwise(F.lit(0)).cast("int"))
    return df


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series eight steps up (double precision)."""
    z = x + 9.0
    series = ((z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + 1.0 / (12.0 * z)
              - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z))
    return series - sum((F.log(x + float(i)) for i in range(2, 9)), F.log(x + 1.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): the term at k, and the falling terms below it; 1 where k >= n p."""
    top = (log_factorial(n.cast("double")) - log_factorial(k.cast("double")) - log_factorial((n - k).cast("double"))
           + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p)))
    # terms fall at least geometrically; after 10 sqrt(n) + 100 of them the rest is below 1e-20 of the sum
    steps = F.least(k, (F.sqrt(n) * 10 + 100).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc, i):
        at = (k - i + 1).cast("double")
        term = acc["term"] * at * (1.0 - p) / ((n - at + 1.0) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>")),
                        start, add)["sum"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def labelled_good(labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """(label_id, good): one row per labelled id; ids with null or contradicting labels are left out."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
            .agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi")
            .select("label_id", (F.col("lo") == 1).alias("good")))


def cutoffs(counted: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cut_<rule>...): the cutoff of each rule in each stratum, from counted(stratum, good, bin_...).

    A rule without an admissible cutoff that helps has null.
    """
    long = counted.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("b")) for r in RULES])).alias("x")).select("stratum", "good", "x.*")
    hist = long.groupBy("stratum", "rule", "b").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    n = hist.groupBy("stratum", "rule").agg(F.sum("good").alias("n"))
    tests = n.agg(F.greatest(F.count("*"), F.lit(1)).alias("m"))
    grid = (hist.where("b > 0").withColumn("j", F.explode(F.expr("sequence(0, b - 1)")))
            .groupBy("stratum", "rule", "j").agg(F.sum("good").alias("k"), F.sum("bad").alias("bad")))
    tail = binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES))
    # k only grows from cutoff to tighter cutoff, and the tail with it: those that pass are those before the first failure
    sound = (grid.join(n, ["stratum", "rule"]).crossJoin(F.broadcast(tests))  # one row
             .where("n > 0 and bad > k").where(tail <= F.lit(delta) / F.col("m")))
    best = sound.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), "j"))["j"].alias("j"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("j"))).alias(f"cut_{r}") for r in RULES])


def strata_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str | None = "lang",
                  alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n, needed, usable): good documents of each stratum with labels, and how many it takes for any cutoff."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _stratum(stratum).alias("stratum"))
    good = labelled_good(labels)
    n = rows.join(good, rows["doc_id"] == good["label_id"]).groupBy("stratum").agg(F.count_if("good").alias("n"))
    pairs = n.agg((F.greatest(F.count("*"), F.lit(1)) * len(RULES)).alias("m"))
    needed = F.ceil(F.log(F.lit(delta) / F.col("m")) / F.log(F.lit(1 - alpha / len(RULES))))
    return n.crossJoin(F.broadcast(pairs)).select("stratum", "n", needed.alias("needed"), (F.col("n") >= needed).alias("usable"))  # one row


def with_verdict(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``kept`` to counted(stratum, ...); ``cuts`` is a stored table."""
    small = cuts.limit(CUTOFF_ROWS + 1).count() <= CUTOFF_ROWS
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(f"bin_{r}") > F.col(f"cut_{r}"), F.lit(False))
    return (counted.join(F.broadcast(cuts) if small else cuts, "stratum", "left")
            .withColumn("kept", ~F.col("base_failed") & ~over))


def _stratum(column: str | None) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")) if column else F.lit("")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept.

    Null texts have no words (and so fail the base rule); a null stratum is
    the stratum ''; without labels no cutoff is admissible and the base rule
    decides.  Repeated rows are judged alike; other columns are not read.
    """
    stages = Stages(session(docs), "rules")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _stratum(stratum).alias("stratum"))
    counted = stages.put("counted", with_counts(rows).drop("text"))
    good = labelled_good(labels)
    known = counted.join(good, counted["doc_id"] == good["label_id"])
    cuts = stages.put("cutoffs", cutoffs(known, alpha, delta))
    return with_verdict(counted, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                              "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns unchanged."""
    stages = Stages(session(docs), "rules")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("text"), _stratum(stratum).alias("stratum"))
    # stored once: a filter on the verdict would otherwise be pushed below the counts, and repeat them
    counted = stages.put("counted", with_counts(rows).drop("text"))
    good = labelled_good(labels)
    known = counted.drop("row").join(good, F.col("id") == F.col("label_id"))
    cuts = stages.put("cutoffs", cutoffs(known, alpha, delta))
    return with_verdict(counted, cuts).where("kept").select("row.*")
