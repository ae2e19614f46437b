"""Sound as windows for a speech model, cut where it is quiet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds of a window, of its end in which it may be cut, and of the frames that are compared; the root mean
# square under which a window is silent.
WINDOW_S, SEARCH_S, FRAME_S = 30.0, 3.0, 0.1
SILENCE = 1e-4


def sound_windows(blocks: DataFrame, rate: int = 16_000) -> DataFrame:
    """sound_id, window (from 1), start, end (samples) and rms of the windows of each sound that aren't silent.

    blocks: sound_id, block and samples, a sound's samples in the order of its blocks, each but the last with a whole number
    of half frames. A window ends after thirty seconds, or in the middle of the quietest frame of its last three, the
    first of equals; the last ends with the sound. Frames begin every half frame, so all cuts are on a grid of half frames, and
    only their energies are brought together: twenty numbers a second. The choice is a sequence by nature, as
    each window begins where the one before ends; it is a fold over a sound's windows.
    """
    half = int(FRAME_S * rate) // 2
    size, search = int(WINDOW_S * rate) // half, int(SEARCH_S * rate) // half
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / half).cast("int")), lambda i: F.slice("samples", i * half + 1, F.lit(half)))
    energy = F.transform(cut, lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = blocks.where(F.size("samples") > 0).select("sound_id", "block", energy.alias("e"), F.size("samples").cast("long").alias("n"))
    whole = own.groupBy("sound_id").agg(F.sort_array(F.collect_list(F.struct("block", "e"))).alias("parts"), F.sum("n").alias("n"))
    held = whole.select("sound_id", "n", F.flatten(F.transform("parts", lambda p: p["e"])).alias("e"))

    def quietest(e, start):
        """Where a window that begins with a half frame ends, if the sound goes on."""
        last = start + size
        frames = F.transform(F.sequence(last - search, last - 2), lambda k: F.struct((F.get(e, k) + F.get(e, k + 1)).alias("energy"), (k + 1).alias("middle")))
        return F.array_min(frames)["middle"]

    none = F.array(F.lit(0))

    def step(cuts, _):
        start = F.element_at(cuts, -1)
        on = F.when((start + size).cast("long") * half < F.col("n"), quietest(F.col("e"), start)).otherwise(F.size("e"))
        return F.when(start < F.size("e"), F.concat(cuts, F.array(on))).otherwise(cuts)

    most = F.ceil(F.size("e") / (size - search)).cast("int") + 1
    cuts = held.withColumn("cuts", F.aggregate(F.sequence(F.lit(1), most), none, step))
    windows = cuts.select("sound_id", "n", "e", F.posexplode(F.zip_with(F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "w"))
    start, end = F.col("w.a").cast("long") * half, F.least(F.col("w.b").cast("long") * half, F.col("n"))
    total = F.aggregate(F.slice("e", F.col("w.a") + 1, F.col("w.b") - F.col("w.a")), F.lit(0.0), lambda s, x: s + x)
    out = windows.select("sound_id", (F.col("k") + 1).cast("long").alias("window"), start.alias("start"), end.alias("end"), F.sqrt(total / (end - start)).alias("rms"))
    return out.where(F.col("rms") >= SILENCE)
