"""Mixed timestamp formats and time zones brought to UTC.

An as-of join of the parsed local times to the zones' offset intervals, which are exploded to the local years they
meet: two matching intervals mean an ambiguous time, none a skipped one, one gives the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import moments as M
from ..functions import zones
from ..session import small

INTERVALS = T.StructType([
    T.StructField("qr_zone", T.StringType()),
    T.StructField("qr_year", T.IntegerType()),
    T.StructField("qr_spans", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("off", T.LongType()), T.StructField("abbr", T.StringType())]))),
])


def interval_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """Intervals of the zones named, hinted for broadcast if they are small; unknown names are left out.

    The tz database bounds them: 600 zones with 330 years each at most.
    """
    rows = zones.local_intervals(n for n in names if zones.known(n))
    return small(spark.createDataFrame(rows, INTERVALS))


def zone_names(texts: DataFrame, text: str, providers: DataFrame) -> list[str]:
    """Zones of the providers and those that texts name; at most as many as the tz database has."""
    named = texts.filter(F.col(f"`{text}`").contains("/")).select(F.regexp_extract(f"`{text}`", r"[\s\[(]([A-Z][A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)[\])]?\s*$", 1).alias("z"))
    named = named.filter(F.col("z").isin(zones.names())).distinct()
    found = providers.select(F.trim(F.col("config")["timezone"]).alias("z")).distinct().union(named).distinct()
    return [r.z for r in found.collect() if r.z and zones.known(r.z)]


def covered_ms(local: Column) -> Column:
    """A local time in the years of the interval table at which the clock stands as it does at ``local``.

    Before them no zone's clock was ever changed. After them all follow a yearly rule, so a year of the same kind tells.
    """
    y = F.year(F.timestamp_millis(local))
    first = lambda year: F.unix_date(F.make_date(year, F.lit(1), F.lit(1))).cast("long") * 86400000
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    kinds = F.create_map(*[F.lit(x) for kind, year in zones.year_kinds().items() for x in (kind, year)])
    kind = F.dayofweek(F.make_date(y, F.lit(1), F.lit(1))) - 1 + F.when(leap, 7).otherwise(0)
    late = local - first(y) + first(F.element_at(kinds, kind))
    return F.when(y < zones.YEARS[0], first(F.lit(zones.YEARS[0]))).when(y >= zones.YEARS[1], late).otherwise(local)


def to_utc(df: DataFrame, text: str, intervals: DataFrame, zone: str, date_order: str) -> DataFrame:
    """``df`` with ``utc_ms bigint`` and ``moment_status string`` for the texts in column ``text``.

    ``zone`` and ``date_order`` name columns with the tz name and 'dmy' or 'mdy' (NULL: UTC is not assumed, local
    times get no instant; dmy). The status is one of

    - ``fixed``: the text states an offset or counts from 1970,
    - ``local``: one interval of the zone holds the local time,
    - ``ambiguous``: two do; the earlier instant holds unless the text's abbreviation picks one,
    - ``skipped``: none does; no instant,
    - ``unknown_zone``: a local time without a zone that the tz database knows; no instant,
    - ``unreadable``: no full date and time, or an impossible one; no instant (also NULL and blank texts).

    Every row of ``df`` comes out once; its own columns keep their names, which must not start with ``qr_``. A column
    that is called ``utc_ms`` or ``moment_status`` already is replaced.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("utc_ms", "moment_status")]
    a = df.select(*own, M.split_parts(F.col(f"`{text}`")).alias("qr_p"), F.col(f"`{zone}`").alias("qr_home"), F.col(f"`{date_order}`").alias("qr_order"))
    a = a.select(
        *own, "qr_home",
        F.when(F.get("qr_p", F.lit(0)) == "epoch", M.epoch_ms(F.get("qr_p", F.lit(1)))).alias("qr_epoch"),
        F.when(F.get("qr_p", F.lit(0)) != "epoch", M.local_ms(F.col("qr_p"), F.col("qr_order"))).alias("qr_local"),
        M.zone_text(F.col("qr_p")).alias("qr_written"),
    )
    a = a.select(*own, "qr_home", "qr_epoch", "qr_local", "qr_written", M.fixed_offset_ms(F.col("qr_written")).alias("qr_fixed"))
    named = F.col("qr_written").contains("/")
    needs = F.col("qr_local").isNotNull() & F.col("qr_fixed").isNull()
    a = a.select(
        *own, "qr_epoch", "qr_local", "qr_written", "qr_fixed",
        F.when(needs & named, F.col("qr_written")).when(needs, F.col("qr_home")).alias("qr_zone"),
        F.when(needs, covered_ms(F.col("qr_local"))).alias("qr_clock"),
        F.when(needs & ~named, F.upper(F.nullif("qr_written", F.lit("")))).alias("qr_abbr"),
    )
    a = a.withColumn("qr_year", F.year(F.timestamp_millis("qr_clock")))
    j = a.join(intervals, ["qr_zone", "qr_year"], "left")
    here = F.filter("qr_spans", lambda s: (s["lo"] <= F.col("qr_clock")) & (F.col("qr_clock") < s["hi"]))
    j = j.select(*own, "qr_epoch", "qr_local", "qr_fixed", "qr_abbr", "qr_spans", here.alias("qr_here"))
    said = F.filter("qr_here", lambda s: F.upper(s["abbr"]) == F.col("qr_abbr"))
    year = F.filter("qr_spans", lambda s: F.upper(s["abbr"]) == F.col("qr_abbr"))
    j = j.select(*own, "qr_epoch", "qr_local", "qr_fixed", "qr_abbr", "qr_here", F.when(F.size(said) > 0, said).otherwise(year).alias("qr_said"), F.col("qr_spans").isNull().alias("qr_lost"))
    most = lambda c: F.array_max(F.transform(c, lambda s: s["off"]))  # noqa: E731  the larger offset is the earlier instant
    n = F.size("qr_here")
    zoned: Column = F.when(F.col("qr_abbr").isNull(), most("qr_here")).otherwise(most("qr_said"))
    offset = F.coalesce("qr_fixed", zoned)
    status = (
        F.when(F.col("qr_epoch").isNotNull() | (F.col("qr_local").isNotNull() & F.col("qr_fixed").isNotNull()), "fixed")
        .when(F.col("qr_local").isNull(), "unreadable")
        .when(F.col("qr_lost"), "unknown_zone")
        .when(F.col("qr_abbr").isNotNull() & (F.size("qr_said") == 0), "unreadable")
        .when(n == 0, "skipped")
        .when(n > 1, "ambiguous")
        .otherwise("local")
    )
    done = j.select(*own, "qr_epoch", "qr_local", offset.alias("qr_off"), status.alias("moment_status"))
    utc = F.coalesce("qr_epoch", F.col("qr_local") - F.col("qr_off"))
    return done.select(*own, F.when(F.col("moment_status").isin("fixed", "local", "ambiguous"), utc).alias("utc_ms"), "moment_status")


def provider_zones(providers: DataFrame) -> DataFrame:
    """(provider_id, zone, date_order) of a provider table."""
    return providers.select(F.col("id").alias("provider_id"), F.trim(F.col("config")["timezone"]).alias("zone"), F.lower(F.trim(F.col("config")["date_order"])).alias("date_order"))


def with_instants(df: DataFrame, text: str, providers: DataFrame) -> DataFrame:
    """``df`` (with ``provider_id`` and the column ``text``) with ``utc_ms`` and ``moment_status`` as ``to_utc`` has them."""
    spark = df.sparkSession
    spans = interval_table(spark, zone_names(df, text, providers))
    home = provider_zones(providers).select(F.col("provider_id").alias("qh_id"), F.col("zone").alias("qh_zone"), F.col("date_order").alias("qh_order"))
    joined = df.join(small(home), df["provider_id"] == home["qh_id"], "left").drop("qh_id")
    return to_utc(joined, text, spans, "qh_zone", "qh_order").drop("qh_zone", "qh_order")


def harvest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All timestamp texts of the feed tables: (tab, row_id, provider_id, raw)."""
    e = spark.read.parquet(f"{sf_dir}/sitemap_entries.parquet").select(F.lit("sitemap_entries").alias("tab"), F.col("entry_id").alias("row_id"), "provider_id", F.col("news.publication_date").alias("raw"))
    a = spark.read.parquet(f"{sf_dir}/articles.parquet").select(F.lit("articles").alias("tab"), "row_id", "provider_id", F.col("published_at").alias("raw"))
    h = spark.read.parquet(f"{sf_dir}/harvest_events.parquet").select(F.lit("harvest_events").alias("tab"), F.col("delivery_id").alias("row_id"), "provider_id", F.col("collected_at").alias("raw"))
    return e.unionByName(a).unionByName(h)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that denote a full date and time and aren't in the canonical form yet, with their instant."""
    texts = harvest_texts(spark, sf_dir).filter(F.col("raw").isNotNull() & ~F.col("raw").rlike(M.CANONICAL))
    read = with_instants(texts, "raw", spark.read.parquet(f"{sf_dir}/providers.parquet"))
    return read.filter("utc_ms IS NOT NULL").select("tab", "row_id", "utc_ms")


def p5_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the texts of each table and provider were read."""
    read = with_instants(harvest_texts(spark, sf_dir), "raw", spark.read.parquet(f"{sf_dir}/providers.parquet"))
    return read.groupBy("tab", "provider_id", "moment_status").agg(F.count("*").alias("texts"))
