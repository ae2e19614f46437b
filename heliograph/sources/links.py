"""Paths through symbolic links: where they lead, and whether that is inside the watched roots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.sources.tables import written

#: Links that a path may lead through, as file systems have it; more mean that they go in circles.
JUMPS = 40


def above(path: Column) -> Column:
    """A path itself and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def plain(path: Column) -> Column:
    """Without empty and single-dot parts; absolute. Two dots stay, as what they take back may be a link."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/"))


def resolved(paths: DataFrame, links: DataFrame, jumps: int = JUMPS) -> DataFrame:
    """path, real and jumps of each different path: what is left when no folder of it is a link any more.

    links: path and target, absolute, or relative to the link's folder; of several for one path the smallest target counts.
    Paths of links are real ones, as a scan that follows none finds them. Parts are gone through from the root on, as a
    file system does: a link is replaced by its target before two dots behind it take anything back. real is null where more than
    `jumps` links are met, so where they go in circles. Each round is an equi-join of the paths that still change with their
    folders; those that have arrived aren't read again.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    target = F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(F.concat(folder, F.lit("/"), F.col("target")))
    known = written(links.where("path is not null and target is not null").select(plain(F.col("path")).alias("link"), plain(target).alias("to")).groupBy("link").agg(F.min("to").alias("to")))
    open_ = paths.where("path is not null").select("path").distinct().select("path", plain(F.col("path")).alias("real"), F.lit(0).alias("jumps"))
    done = []
    while True:
        open_ = open_.withColumn("head", F.regexp_extract("real", r"^((?:/(?!\.\.(?:/|$))[^/]*)*)", 1))  # up to the first two dots
        held = open_.select("path", F.explode(above(F.col("head"))).alias("link")).join(known, "link")
        first = held.groupBy("path").agg(F.min_by(F.struct("link", "to"), F.length("link")).alias("hop"))
        step = written(open_.join(first, "path", "left"))
        arrived = F.col("hop").isNull() & (F.col("head") == F.col("real"))
        done.append(step.where(arrived).select("path", F.when(F.col("real") == "", "/").otherwise(F.col("real")).alias("real"), "jumps"))
        rest = lambda n: F.expr(f"substring(real, {n})")
        back = F.concat(F.regexp_replace("head", "/[^/]*$", ""), rest("length(head) + 4"))
        real = F.when(F.col("hop").isNotNull(), F.concat("hop.to", rest("length(hop.link) + 1"))).otherwise(back)
        on = step.where(~arrived).select("path", plain(real).alias("real"), (F.col("jumps") + F.col("hop").isNotNull().cast("int")).alias("jumps"))
        done.append(on.where(F.col("jumps") > jumps).select("path", F.lit(None).cast("string").alias("real"), "jumps"))
        open_ = on.where(F.col("jumps") <= jumps)
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def contained(paths: DataFrame, roots: DataFrame, links: DataFrame, jumps: int = JUMPS) -> DataFrame:
    """path, real and inside: whether it leads into one of the roots (root), whose links are followed, too. What goes in
    circles is in none."""
    real = resolved(paths, links, jumps)
    own = resolved(roots.select(F.col("root").alias("path")), links, jumps).where("real is not null").select(F.col("real").alias("head")).distinct()
    met = real.select("path", F.explode(F.concat(F.array(F.lit("/")), above(F.col("real")))).alias("head")).join(own, "head", "left_semi").select("path").distinct().withColumn("inside", F.lit(True))
    return real.join(met, "path", "left").select("path", "real", F.coalesce("inside", F.lit(False)).alias("inside"))
