"""URL filtering by rules and a character language-model ratio, in DataFrame functions only.

A URL that a rule fits has the rule's verdict. The others are judged by two Markov models over characters, one
of accepted and one of rejected URLs: contexts of three characters down to none, interpolated after
Witten and Bell. The score is the log-likelihood difference for each character, and the border between the
verdicts is calibrated on labelled URLs that the models have not seen. Labels are the rules' own verdicts.

Characters are the URL's own, in any script, so the table of grams grows with the input. Each order of a model is
joined with the order below on the context they share, at most as many rows for each key as there are characters.
To score, the grams that hold a `HEAVY`-th of all occurrences or more, so at most `HEAVY` of them, are broadcast
and summed where the URL is; only the rest, none of them frequent, meets the model in a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.staging import stage

# (verdict, host, path): fits the host and its subdomains if the path begins with the rule's.
Rule = tuple[str, str, str]

# Marks before and behind a URL, characters that URLs do not have.
BEGIN, END = "\x02", "\x03"
CONTEXT = 3
# Grams with at least this share of all occurrences are broadcast: there are no more than this many.
HEAVY = 10_000
# Different URLs whose md5 begins with one of these are for the calibration and not for the models.
CALIBRATION_DIGITS = ("0", "1", "2")
# Log ratios are whole millionths, so that their sums do not depend on the order.
SCALE = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (in lower case) and path; both empty for a null URL and one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest fitting rule, the first of equals; nulls if none fits."""
    text = verdict = F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, decision).otherwise(verdict)
    return text, verdict


def grams(host: Column, path: Column) -> Column:
    """All characters of a URL with the context before them: strings of CONTEXT + 1 characters."""
    characters = F.split(F.concat(F.lit(BEGIN * CONTEXT), host, path, F.lit(END)), "")
    # An array of one binds the characters once for all grams.
    each = F.transform(
        F.array(characters),
        lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - CONTEXT), lambda i: F.array_join(F.slice(c, i, CONTEXT + 1), "")),
    )
    return F.element_at(each, 1)


def ratio_model(counts: DataFrame) -> DataFrame:
    """(gram, ratio): the log ratio of a character's probabilities after its context, in millionths.

    `counts` has for each gram that occurs anywhere its occurrences in `accepted` and `rejected` URLs, which may be 0.
    Without any context all characters that are last in a gram are equally likely.
    """
    classes = ("accepted", "rejected")
    different = counts.agg(F.count_distinct(F.substring("gram", CONTEXT + 1, 1))).first()[0]
    below = None
    for order in range(CONTEXT + 1):
        # The last order + 1 characters of the grams, and the sums over all that may follow the same context.
        of_part = counts.groupBy(F.substring("gram", CONTEXT + 1 - order, order + 1).alias("part"))
        of_part = of_part.agg(*[F.sum(c).alias(c) for c in classes]).withColumn("context", F.substring("part", 1, order))
        sums = []
        for c in classes:
            sums += [F.sum(c).alias(f"n_{c}"), F.sum((F.col(c) > 0).cast("bigint")).alias(f"t_{c}")]
        model = of_part.join(of_part.groupBy("context").agg(*sums), "context")
        if below is None:
            model = model.withColumns({f"p_{c}": F.lit(1 / max(different, 1)) for c in classes})
        else:
            model = model.withColumn("shorter", F.substring("part", 2, order)).join(below, "shorter")
        for c in classes:
            n, t = F.col(f"n_{c}"), F.col(f"t_{c}")
            mixed = (F.col(c) + t * F.col(f"p_{c}")) / (n + t)
            model = model.withColumn(f"p_{c}", F.when(n > 0, mixed).otherwise(F.col(f"p_{c}")))
        below = model.select(F.col("part").alias("shorter"), *[f"p_{c}" for c in classes])
    ratio = F.round(F.log(F.col("p_accepted") / F.col("p_rejected")) * SCALE).cast("bigint")
    return below.select(F.col("shorter").alias("gram"), ratio.alias("ratio"))


def _scores(urls: DataFrame, model: DataFrame, heavy: DataFrame) -> DataFrame:
    """(row, score): the mean log ratio of the characters of `urls` (row, host, path). All grams are in the model."""
    single = urls.select("row", F.explode(grams(F.col("host"), F.col("path"))).alias("gram"))
    often = F.broadcast(heavy.select("gram", "ratio"))
    frequent = single.join(often, "gram").groupBy("row").agg(F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("grams"))
    rare = single.join(F.broadcast(heavy.select("gram")), "gram", "left_anti").join(model.select("gram", "ratio"), "gram")
    both = frequent.unionByName(rare.select("row", "ratio", F.lit(1).cast("bigint").alias("grams")))
    return both.groupBy("row").agg((F.sum("ratio") / F.sum("grams")).alias("score"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row; the score is null where a rule decides.

    A URL is accepted from the border on. The border lies between the mean scores of accepted and rejected
    calibration URLs, nearer to the class that varies less; 0 if a class has none. Without any labelled URL
    all scores are 0 and all URLs are accepted. Null and malformed URLs have an empty host and path and are judged as such.
    Models count different (host, path) once, so repeated rows do not outweigh others; every row is judged. URLs of
    any length are read whole, in time linear in it. An empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_column))
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = stage(rows.select("*", rule.alias("rule"), verdict.alias("verdict"), F.monotonically_increasing_id().alias("row")), "urls")

    # Few and small as they may be, these rows become many: they are spread over all tasks.
    spread_out = int(spark.conf.get("spark.sql.shuffle.partitions"))
    different = rows.groupBy("host", "path", "verdict").agg(F.count(F.lit(1)).alias("pages")).repartition(spread_out)
    held = F.substring(F.md5(F.concat("host", "path").cast("binary")), 1, 1).isin(*CALIBRATION_DIGITS)
    different = stage(different.select("*", held.alias("held"), F.monotonically_increasing_id().alias("row")), "different")
    learned = different.select("verdict", "held", "pages", F.explode(grams(F.col("host"), F.col("path"))).alias("gram"))
    of_class = {c: ((F.col("verdict") == v) & ~F.col("held")).cast("bigint") for c, v in (("accepted", "allow"), ("rejected", "block"))}
    counts = learned.groupBy("gram").agg(*[F.sum(F.coalesce(x, F.lit(0))).alias(c) for c, x in of_class.items()], F.sum("pages").alias("seen"))
    counts = stage(counts, "grams")
    model = stage(ratio_model(counts).join(counts.select("gram", "seen"), "gram"), "ratios")
    least = (counts.agg(F.sum("seen")).first()[0] or 0) / HEAVY
    heavy = model.filter(F.col("seen") >= least)

    labelled = different.filter(F.col("held") & F.col("verdict").isNotNull())
    labelled = labelled.select("row", "verdict").join(_scores(labelled, model, heavy), "row")
    of = {v: F.when(F.col("verdict") == v, F.col("score")) for v in ("allow", "block")}
    spread = labelled.agg(
        F.avg(of["allow"]).alias("ma"), F.avg(of["block"]).alias("mb"), F.stddev_pop(of["allow"]).alias("sa"), F.stddev_pop(of["block"]).alias("sb")
    )
    weight = F.when(F.col("sa") + F.col("sb") > 0, F.col("sb") / (F.col("sa") + F.col("sb"))).otherwise(0.5)
    border = spread.select(F.coalesce(F.col("ma") * weight + F.col("mb") * (1 - weight), F.lit(0.0))).first()[0]

    unruled = rows.filter("verdict is null")
    judged = unruled.select("row", "page_id", "host", "path").join(_scores(unruled, model, heavy), "row")
    method = F.when(F.col("score") >= border, "allow").otherwise("block")
    judged = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), method.alias("verdict"), "score")
    ruled = rows.filter("verdict is not null").drop("row").withColumn("score", F.lit(None).cast("double"))
    return ruled.unionByName(judged)
