"""Mixing sources to target weights: systematic sampling within each source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import materialise, table

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Each source and size class is cut into this many blocks by a hash, so that no source meets in one task.
BLOCKS = 256
#: Leading bits of a size that make its class: sizes of a class are within one thirty-second of each other.
LEADING = 6
SEED = "mix-1"


def _number(*parts: Column) -> Column:
    """A number under 2^52 from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """For each source of sizes (source, source_size): its target in words.

    Sources by code point, null last, weigh 1, 2, 3, repeating. No target exceeds ``most`` times the source's
    size; the excess goes to the others by weight until none is above. That is water-filling: with the sources
    by limit / weight, the level that results if the first k are at their limits rises while limits bind and
    falls after that, so the final level is the largest. The table has one row for each source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    limited = sizes.withColumn("weight", cycle.cast("double")).withColumn("most", (F.col("source_size") * most).cast("double"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        limited.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))
    )


def class_copies(classes: Column, rate: Column, shift: Column, most: int) -> Column:
    """For classes (class, rows, words) from large to small: class, rows, copies and how many copies went before.

    Each class is to give rate times its words, and what larger classes gave too much or too little; that many copies of
    its mean size, rounded by the offset, are spread over it. So the error is carried on in words, from the largest
    documents, of which few are taken, to the smallest, and ends below one of these.
    """
    def step(state: Column, c: Column) -> Column:
        due = c["words"] * rate + state["due"]
        mean = c["words"] / c["rows"]
        copies = F.when(c["words"] == 0, F.lit(0).cast("long")).otherwise(F.least(F.greatest(F.floor(due / mean + shift + 1e-9), F.lit(0).cast("long")), c["rows"] * most))
        done = F.struct(c["class"].alias("class"), c["rows"].alias("rows"), copies.alias("copies"), state["before"].alias("before"))
        return F.struct((due - copies * mean).alias("due"), (state["before"] + copies).alias("before"), F.concat(state["done"], F.array(done)).alias("done"))

    none = F.array().cast("array<struct<class:long,rows:long,copies:long,before:long>>")
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0).cast("long").alias("before"), none.alias("done"))
    return F.aggregate(F.sort_array(classes, asc=False), start, step)["done"]


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, blocks: int = BLOCKS) -> DataFrame:
    """row (the columns of docs), size (words), source_size, target (of its source) and copies (0 to ``most``) of each row.

    Takes doc_id, text and source; other columns stay in row, whatever their names. A source's documents are put in the
    order of size classes (the six leading bits of the size, large first), blocks (by a hash of doc_id) and sizes; their
    expected copies, target / size of the source but for the error that larger classes leave, are summed in this order,
    one offset, random but fixed by seed and source, is added, and a document is taken once for each integer that its
    stretch crosses. So the words taken come within about one small document of the target. Prefix sums come from
    block counts (source x class x block) and places within a block, so a source with most of the rows is spread over
    all tasks; what meets in one task is a source's at most 59 x 32 classes, and a row for each source.

    A null text has size 0; null sources are one source. Rows with equal doc_id are ordered by size and a hash of
    the text; repeated rows are interchangeable. A source with no words has target 0 and takes nothing. A very long text
    is only counted. An empty table gives an empty result. Reruns agree: nothing depends on how rows are dealt to tasks.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # joins on null, too
    tail = F.greatest(F.length(F.bin("size")) - LEADING, F.lit(0)).cast("int")  # all but the leading bits
    keyed = (
        docs.select(
            F.struct("*").alias("row"),
            F.col("doc_id").alias("id"),
            F.xxhash64("text").alias("tie"),
            words(F.col("text")).alias("size"),
            _number(F.lit(seed), F.col("doc_id").cast("string")).alias("place"),
            F.col("source").alias("name"),
            source.alias("source"),
        )
        .withColumn("class", F.call_function("shiftleft", F.call_function("shiftright", F.col("size"), tail), tail))
        .withColumn("block", F.col("place") % blocks)
    )
    # texts are counted twice only: for this table, and where the copies are told
    counts = materialise(keyed.groupBy("source", "class", "block").agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.first("name").alias("name")), "mix-counts")
    earlier = Window.partitionBy("source", "class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "class", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    classes = counts.groupBy("source", "class").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"), F.first("name").alias("name"))
    sizes = classes.groupBy("source").agg(F.first("name").alias("name"), F.sum("words").alias("source_size"), F.collect_list(F.struct("class", "rows", "words")).alias("classes"))
    goals = targets(sizes.select(F.col("name").alias("source"), "source_size"), weights, most).select(
        source.alias("source"),
        "target",
        F.coalesce(F.least(F.lit(float(most)), F.try_divide("target", "source_size")), F.lit(0.0)).alias("rate"),
        (_number(F.lit(seed), F.lit("offset"), source) / F.lit(float(1 << 52))).alias("shift"),
    )
    planned = sizes.join(goals, "source").withColumn("done", F.explode(class_copies(F.col("classes"), F.col("rate"), F.col("shift"), most)))
    planned = planned.select("source", "source_size", "target", "done.class", F.col("done.rows").alias("of"), F.col("done.copies").alias("share"), F.floor(F.col("shift") * F.col("done.rows")).alias("start"))
    inside = Window.partitionBy("source", "class", "block").orderBy("size", "place", "id", "tie")
    crossed = lambda n: F.call_function("div", n * F.col("share") + F.col("start"), F.col("of"))
    n = F.col("before") + F.col("n")
    return (
        keyed.join(offsets.join(planned, ["source", "class"]), ["source", "class", "block"])
        .withColumn("n", F.row_number().over(inside))
        .select("row", "size", "source_size", "target", (crossed(n) - crossed(n - 1)).cast("int").alias("copies"))
    )


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it; same columns, whatever their names. Nulls, ties,
    repeated rows, long texts and empty tables: as mix(); documents without a word give no words and aren't taken."""
    return mix(docs, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('{SEED}' || '|' || doc_id), 1, 13))::bigint as ord,
         coalesce('=' || source, '') as src
  from documents),
classed as (select *, ((size >> greatest(length(bin(size)) - {LEADING}, 0)::int) << greatest(length(bin(size)) - {LEADING}, 0)::int)::bigint as class from sized),
sizes as (select src, any_value(source) as source, sum(size)::bigint as source_size from sized group by src),
weighted as (select *, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as weight, (source_size * 3)::double as most from sizes),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
          / (sum(weight) over () - coalesce(sum(weight) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from weighted),
goals as (select src, source_size, least(most, weight * max(level) over ()) as target from levels),
rated as (select *, least(3.0::double, coalesce(target / nullif(source_size, 0), 0.0::double)) as rate, (('0x' || substr(md5('{SEED}' || '|offset|' || src), 1, 13))::bigint)::double / {float(1 << 52)}::double as shift from goals),
classes as (select src, class, count(*)::bigint as n_rows, sum(size)::bigint as n_words, row_number() over (partition by src order by class desc) as k from classed group by src, class),
carried as (
  with recursive walk as (
    select src, 0::bigint as k, 0::bigint as class, 0::bigint as n_rows, 0::bigint as copies, 0.0::double as due from rated
    union all
    select src, k, class, n_rows, copies, due_now - copies * (n_words / n_rows::double) as due from (
      select *, case when n_words = 0 then 0 else least(greatest(floor(due_now / (n_words / n_rows::double) + shift + 1e-9::double), 0), n_rows * 3)::bigint end as copies from (
        select c.*, r.shift, c.n_words * r.rate + w.due as due_now from walk w join classes c on c.src = w.src and c.k = w.k + 1 join rated r on r.src = w.src)))
  select src, class, n_rows, copies from walk where k > 0),
placed as (
  select c.*, row_number() over (partition by c.src, c.class order by ord % {BLOCKS}, size, ord, doc_id) as n from classed c)
select doc_id, size, source_size, round(target, 6) as target,
       ((n * copies + floor(shift * n_rows)::bigint) // n_rows - ((n - 1) * copies + floor(shift * n_rows)::bigint) // n_rows)::bigint * size as taken
from placed p join carried using (src, class) join rated using (src)
"""
