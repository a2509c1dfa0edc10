"""How many documents each request asks for, without forming the pairs.

Method: requests with the same demands (service, environment, tags) are one spec. A spec is
joined with the documents on its rarest demand; of each document only the first instant
counts. Counts per spec and stretch of time are summed up, and within a stretch the edges of
the ranges are placed exactly among the instants. An id delivered with several instants adds
to a range that starts between two of them and holds the later one.

Defined results: a null or blank service, environment, start or end demands nothing; a
reversed range is turned; documents without an instant belong to requests without any range
only; a tag is held by the metadata, or by the service or environment; every request has a
row, and one whose start or end is given but unreadable has a null count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.instants import with_utc_micros
from tidemark.session import written

#: A stretch of a day, in microseconds; widths of stretches for pairs of instants of one id.
STRETCH = 86_400_000_000
LEVELS = [STRETCH * 4**n for n in range(12)]
#: Parts of the documents of one demand, which meet every spec of it.
PARTS = 16
_FAR = 9_000_000_000_000_000_000
_SERVICE, _ENVIRONMENT, _ANY = "\u0001service:", "\u0001environment:", "\u0001any"


def _given(c: str) -> Column:
    return F.when(F.trim(c) != "", F.col(c))


def _stretch(c: str | Column, width: int | Column = STRETCH) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / width)


def _demands(asked: DataFrame) -> DataFrame:
    """``request_id``, ``needs``, the range ``a`` to ``b``, ``ranged`` and ``readable``."""
    asked = with_utc_micros(asked, "from_utc", "client_zone", "a")
    asked = with_utc_micros(asked, "to_utc", "client_zone", "b")
    start, end = F.coalesce("a", F.lit(-_FAR)), F.coalesce("b", F.lit(_FAR))
    tags = F.filter(F.coalesce("filters", F.array().cast("array<string>")), lambda f: F.trim(f) != "")
    own = F.array_compact(F.array(F.concat(F.lit(_SERVICE), _given("service")), F.concat(F.lit(_ENVIRONMENT), _given("env"))))
    return asked.select(
        "request_id",
        F.array_sort(F.array_distinct(F.concat(F.array(F.lit(_ANY)), own, tags))).alias("needs"),
        F.least(start, end).alias("a"),
        F.greatest(start, end).alias("b"),
        (_given("from_utc").isNotNull() | _given("to_utc").isNotNull()).alias("ranged"),
        ((_given("from_utc").isNull() | F.col("a").isNotNull()) & (_given("to_utc").isNull() | F.col("b").isNotNull())).alias("readable"),
    )


def _held(docs: DataFrame) -> DataFrame:
    """``id`` and its ``rows``: what each delivery holds and its instant."""
    tags = F.coalesce(F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>"), F.array().cast("array<string>"))
    own = F.array(
        F.lit(_ANY), F.concat(F.lit(_SERVICE), "service"), F.concat(F.lit(_ENVIRONMENT), "environment"), F.concat(F.lit("service:"), "service"), F.concat(F.lit("env:"), "environment")
    )
    rows = with_utc_micros(docs, "timestamp", "source_zone", "t").where("id is not null")
    return rows.groupBy("id").agg(F.collect_set(F.struct(F.array_sort(F.array_distinct(F.array_compact(F.concat(own, tags)))).alias("holds"), "t")).alias("rows"))


def counts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``request_id`` and ``n_documents`` for every request. ``asked`` and ``docs`` as delivered."""
    demands = written(_demands(asked), "demands")
    good = demands.where("readable")
    held = written(_held(docs).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS))), "held")
    tagged = held.withColumn("need", F.explode(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["holds"])))))
    specs = good.select("needs").distinct()
    # The rarest demand of a spec; one that no document holds leaves the spec without any.
    needed = specs.select("needs", F.explode("needs").alias("need"))
    often = tagged.groupBy("need").agg(F.count("*").alias("n"))
    rarest = needed.join(often, "need", "left").groupBy("needs").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "need")).alias("least"))
    rarest = rarest.where("least.n > 0").select("needs", F.col("least.need").alias("need"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part"))
    fit = F.filter("rows", lambda r: F.size(F.array_except("needs", r["holds"])) == 0)
    matched = rarest.join(tagged, ["need", "part"]).select("needs", fit.alias("fit")).where(F.size("fit") > 0)
    # The known instants of an id in order; the first is the one that is counted.
    matched = written(matched.select("needs", F.array_sort(F.array_distinct(F.array_compact(F.transform("fit", lambda r: r["t"])))).alias("times")), "matched")

    firsts = matched.where(F.size("times") > 0).select("needs", F.get("times", F.lit(0)).alias("t")).groupBy("needs", "t").agg(F.count("*").alias("n"))
    edges = good.where("ranged").select("needs", "request_id", F.inline(F.array(F.struct(F.lit(-1).alias("sign"), F.col("a").alias("t")), F.struct(F.lit(1).alias("sign"), F.col("b").alias("t")))))
    # An edge sorts before the documents of its instant: ranges are half open.
    line = edges.select("needs", "t", F.lit(0).alias("late"), F.lit(0).cast("bigint").alias("n"), "request_id", "sign").unionByName(firsts.withColumn("late", F.lit(1)), allowMissingColumns=True)
    line = line.withColumn("stretch", _stretch("t"))
    inside = line.withColumn("inside", F.sum("n").over(W.partitionBy("needs", "stretch").orderBy("t", "late").rowsBetween(W.unboundedPreceding, W.currentRow))).where("late = 0")
    sums = line.groupBy("needs", "stretch").agg(F.sum("n").alias("n"))
    before = sums.select("needs", "stretch", (F.sum("n").over(W.partitionBy("needs").orderBy("stretch").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("before"))
    ranged = inside.join(before, ["needs", "stretch"]).select("request_id", (F.col("sign") * (F.col("inside") + F.col("before"))).alias("n"))

    # Two instants of an id around the start: at the level where they lie in one or two stretches.
    pairs = matched.where(F.size("times") > 1).select("needs", F.explode(F.arrays_zip(F.slice("times", F.lit(1), F.size("times") - 1).alias("x"), F.slice("times", F.lit(2), F.size("times") - 1).alias("y"))).alias("p")).select("needs", "p.x", "p.y")
    level = F.coalesce(*[F.when(_stretch("y", w) - _stretch("x", w) <= 1, F.lit(n)) for n, w in enumerate(LEVELS)])
    width = F.element_at(F.array(*[F.lit(w) for w in LEVELS]), F.col("level") + 1)
    pairs = pairs.withColumn("level", level).withColumn("stretch", F.explode(F.array_distinct(F.array(_stretch("x", width), _stretch("y", width)))))
    starts = good.where("ranged").select("needs", "request_id", "a", "b", F.inline(F.array(*[F.struct(F.lit(n).alias("level"), _stretch("a", w).alias("stretch")) for n, w in enumerate(LEVELS)])))
    around = starts.join(pairs, ["needs", "level", "stretch"]).where("x < a and a <= y and y < b").select("request_id", F.lit(1).cast("bigint").alias("n"))

    whole = good.where("not ranged").select("request_id", "needs").join(matched.groupBy("needs").agg(F.count("*").alias("n")), "needs").select("request_id", "n")
    found = ranged.unionByName(around).unionByName(whole).groupBy("request_id").agg(F.sum("n").alias("n"))
    n = F.when(F.col("readable"), F.coalesce("n", F.lit(0).cast("bigint")))
    return demands.select("request_id", "readable").join(found, "request_id", "left").select("request_id", n.alias("n_documents"))
