"""Match joins between bitmaps.

``marks`` has mark_id, words (packed bits), area and the columns ``by`` that two marks must agree in before
they are compared: an equi-join, not a nested loop. Bitmaps of one area whose counts of black pixels are further
apart than the threshold allows can't match, so the counts, cut into bands of that width, are a second equi key
(each mark meets its own band and the two beside it). Large groups are cut into blocks, a third key, so that their
comparisons are shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions import bits


def with_counts(marks: DataFrame) -> DataFrame:
    return marks if "n_black" in marks.columns else marks.withColumn("n_black", bits.total(F.col("words")))


def pairs(marks: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j) for marks that agree in ``by``, j before i."""
    a = marks.select(*by, F.col("mark_id").alias("i"))
    b = marks.select(*by, F.col("mark_id").alias("j"))
    return a.join(b, by).where(F.col("j") < F.col("i"))


def pair_counts(marks: DataFrame, by: list[str]) -> DataFrame:
    """(by, pairs): how many pairs agree in ``by``, from the groups' sizes alone."""
    rows = marks.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.select(*by, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


#: Marks of a group in a block; two blocks meet in one task, which compares up to ``TASK_PAIRS`` pairs.
BLOCK = 1000
TASK_PAIRS = 4_000_000
MOST_TASKS = 10_000
#: Bitmaps up to so many words are compared as columns, larger ones as arrays.
COLUMNS = 8


def _spread(marks: DataFrame, keys: list[str]) -> tuple[DataFrame, int, int]:
    """``marks`` with the number of blocks of their group (``blocks``), tasks that share the comparisons, and words of the largest bitmap."""
    sizes = marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("words")).alias("width")).dropna(subset=keys)
    pairs, width, largest = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.max("width"), F.max("n")).first()
    tasks = min(MOST_TASKS, int((pairs or 0) // TASK_PAIRS) + 1)
    if tasks == 1 or largest <= BLOCK:
        return marks.withColumn("blocks", F.lit(1)), tasks, width or 1
    large = sizes.where(F.col("n") > BLOCK).select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return marks.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), tasks, width or 1


def _met(marks: DataFrame, keys: list[str], order: str, payload: dict[str, Column], most: float | None = None) -> tuple[DataFrame, list[str]]:
    """(keys, x_*, y_*): marks that agree in ``keys`` and differ in ``order``, each two of them once; and the names of the words' columns.

    ``payload`` names what comes with either side besides id, order and words. A large group is cut into blocks, and every
    two of them meet in a partition of their own. With ``most``, marks whose counts of black pixels lie in the same band or in
    neighbouring ones meet: 2p is the meeting of band p with itself, 2p + 1 that of p + 1 with p.
    """
    rows, tasks, width = _spread(marks, keys)
    words = [f"word_{k}" for k in range(width)] if width <= COLUMNS else ["words"]
    each = [F.get("words", F.lit(k)).alias(w) for k, w in enumerate(words)] if width <= COLUMNS else [F.col("words")]
    block = F.pmod(F.xxhash64("mark_id"), F.col("blocks")).cast("int")
    last = F.col("blocks") - 1
    band = F.lit(0) if most is None else F.floor(F.col("n_black") / F.greatest(F.lit(1), F.floor(F.col("area") * most).cast("int") + 1)).cast("int")
    rows = rows.select(*keys, F.col("mark_id").alias("id"), F.col(order).alias("order"), *[c.alias(n) for n, c in payload.items()], *each, block.alias("block"), last.alias("last"), band.alias("band"))

    def side(prefix: str, own: str, partner: str, first: Column, to: Column, further: Column) -> DataFrame:
        meets = F.transform(F.sequence(first, to), lambda k: F.struct((2 * F.col("band")).alias("meet"), F.col("block").alias(own), k.alias(partner)))
        if most is not None:
            meets = F.concat(meets, F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(further.alias("meet"), F.col("block").alias(own), k.alias(partner))))
        out = rows.withColumn("at", F.explode(meets)).select(*keys, "at.meet", "at.block_x", "at.block_y", *[F.col(n).alias(f"{prefix}_{n}") for n in ("id", "order", *payload, *words)])
        return out.repartition(tasks, *keys, "meet", "block_x", "block_y") if tasks > 1 else out

    x = side("x", "block_x", "block_y", F.lit(0), F.col("block"), 2 * F.col("band") - 1)
    y = side("y", "block_y", "block_x", F.col("block"), F.col("last"), 2 * F.col("band") + 1)
    among = (F.col("meet") % 2 == 0) & (F.col("block_x") == F.col("block_y"))
    once = (F.col("x_order") > F.col("y_order")) | (~among & (F.col("x_order") < F.col("y_order")))
    return x.join(y, [*keys, "meet", "block_x", "block_y"]).where(once), words


def _black(words: list[str], a: str, b: str, f) -> Column:
    """Black pixels of ``f`` over the words of sides ``a`` and ``b``; null where one bitmap has more words."""
    if words == ["words"]:
        return bits.combine(F.col(f"{a}_words"), F.col(f"{b}_words"), f)
    total = None
    for w in words:
        u, v = F.col(f"{a}_{w}"), F.col(f"{b}_{w}")
        n = F.bit_count(f(u, v))
        total = n if total is None else total + F.when(u.isNotNull() | v.isNotNull(), n).otherwise(F.lit(0))
    return total


def scored(marks: DataFrame, by: list[str], most: float | None = None, page: str | None = None) -> DataFrame:
    """(by, i, j, mm): XOR scores of pairs, j before i; with ``most``, only of pairs that may reach it; with ``page``, only where j is on an earlier page."""
    met, words = _met(with_counts(marks), [*by, "area"], page or "mark_id", {}, most)
    mm = _black(words, "x", "y", lambda x, y: x.bitwiseXOR(y)) / F.col("area")
    later = F.col("x_order") > F.col("y_order")
    return met.select(*by, F.when(later, F.col("x_id")).otherwise(F.col("y_id")).alias("i"), F.when(later, F.col("y_id")).otherwise(F.col("x_id")).alias("j"), mm.alias("mm"))


def edges(marks: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """The similarity graph: pairs under the threshold, which itself is no edge."""
    return scored(marks, by, threshold).where(F.col("mm").cast("float") < F.lit(threshold).cast("float"))


def matches(marks: DataFrame, by: list[str], threshold: float, page: str | None = None) -> DataFrame:
    """Pairs up to the threshold, which still matches."""
    return scored(marks, by, threshold, page).where(F.col("mm").cast("float") <= F.lit(threshold).cast("float"))


def entropy_scores(marks: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, score): conditional entropy of i given j; null scores match nothing."""
    most = marks.agg(F.max("area")).first()[0]
    met, words = _met(marks, by, "mark_id", {"area": F.col("area"), "black": bits.total(F.col("words"))})
    later = F.col("x_order") > F.col("y_order")
    of = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    # black pixels of x alone and of y alone are gained and lost where x is the later one, else the other way round
    x, y = _black(words, "x", "y", lambda x, y: x.bitwiseAND(F.bitwise_not(y))), _black(words, "x", "y", lambda x, y: y.bitwiseAND(F.bitwise_not(x)))
    met = met.select(*by, of("x_id", "y_id").alias("i"), of("y_id", "x_id").alias("j"), of("x_area", "y_area").alias("area"), of("y_black", "x_black").alias("black"), F.when(later, y).otherwise(x).alias("lost"), F.when(later, x).otherwise(y).alias("gained"))
    return met.select(*by, "i", "j", bits.conditional_entropy(F.col("lost"), F.col("gained"), F.col("black"), F.col("area"), most).alias("score"))


def best(found: DataFrame, of: str, ref: str, keys: list[str] | None = None) -> DataFrame:
    """The least ``mm`` of each ``of``; ties go to the lowest ``ref``. Partial minima combine before the shuffle."""
    group = [*(keys or []), of]
    return found.groupBy(*group).agg(F.min(F.struct("mm", ref)).alias("b")).select(*group, F.col(f"b.{ref}").alias("ref_id"), F.col("b.mm").alias("mm"))


def nearest_earlier(marks: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Each mark with its best earlier match, null if there is none."""
    found = best(matches(marks, by, threshold), "i", "j")
    return marks.select("mark_id", *by).join(found.withColumnRenamed("i", "mark_id"), "mark_id", "left")


def nearest_on_earlier_pages(marks: DataFrame, by: list[str], threshold: float, page: str) -> DataFrame:
    """Each mark with its best match on the pages before its own, null if there is none; ties go to the lowest id."""
    found = best(matches(marks, by, threshold, page), "i", "j")
    return marks.select("mark_id", *by, page).join(found.withColumnRenamed("i", "mark_id"), "mark_id", "left")


def nearest_in(marks: DataFrame, references: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Each of ``marks`` with the best of ``references``, another table of marks; ties go to the lowest id."""
    a = marks.select(*by, "mark_id", "words", "area")
    b = references.select(*by, F.col("mark_id").alias("ref"), F.col("words").alias("ref_words"), F.col("area").alias("ref_area"))
    mm = bits.xor_score(F.col("words"), F.col("ref_words"), F.col("area"))
    found = a.join(b, by).where("area = ref_area").select("mark_id", "ref", mm.alias("mm")).where(F.col("mm").cast("float") <= F.lit(threshold).cast("float"))
    return marks.select("mark_id", *by).join(best(found, "mark_id", "ref"), "mark_id", "left")


def both_ways(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, mark_id, ref, mm): every pair from either side."""
    ends = F.array(F.struct(F.col("i").alias("mark_id"), F.col("j").alias("ref")), F.struct(F.col("j").alias("mark_id"), F.col("i").alias("ref")))
    return found.select(*by, F.explode(ends).alias("ends"), "mm").select(*by, "ends.mark_id", "ends.ref", "mm")


def copies(marks: DataFrame, by: list[str], latest: bool = False) -> DataFrame:
    """(mark_id, first, ref): marks whose bitmap repeats in their group, with the lowest id that has it and the lowest other one; with ``latest``, the highest ids."""
    sign = F.lit(-1 if latest else 1)
    keys = [*by, "area", "words"]
    alike = marks.dropna(subset=keys).groupBy(*keys).agg(F.min(sign * F.col("mark_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = marks.select("mark_id", *keys).join(alike, keys).select("mark_id", (sign * F.col("first")).alias("first"))
    second = held.where("mark_id <> first").groupBy("first").agg((sign * F.min(sign * F.col("mark_id"))).alias("second"))
    return held.join(second, "first").select("mark_id", "first", F.when(F.col("mark_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("ref"))


def top_matches(found: DataFrame, by: list[str], k: int = 50) -> DataFrame:
    """The k best matches of each mark from either side; of equal ones the later mark ranks first."""
    rank = F.row_number().over(Window.partitionBy("mark_id").orderBy("mm", F.desc("ref")))
    return both_ways(found, by).withColumn("rank", rank).where(F.col("rank") <= k).select("mark_id", "ref", "mm", "rank")


def best_both_ways(found: DataFrame, by: list[str]) -> DataFrame:
    """(mark_id, ref_id, mm): each mark's best match from either side, ties to the lowest id."""
    return best(both_ways(found, by), "mark_id", "ref")


def best_with_carried(found: DataFrame, by: list[str], first_new: int) -> DataFrame:
    """As ``best_both_ways`` where ids under ``first_new`` are carried from an earlier dictionary."""
    new_old = found.where((F.col("i") >= first_new) & (F.col("j") < first_new))
    chosen = best(new_old, "i", "j").select(F.col("i"), F.col("ref_id").alias("j"))
    rest = found.where((F.col("i") < first_new) | (F.col("j") >= first_new))
    forward = new_old.select(*by, F.col("i").alias("mark_id"), F.col("j").alias("ref"), "mm")
    back = new_old.join(chosen, ["i", "j"]).select(*by, F.col("j").alias("mark_id"), F.col("i").alias("ref"), "mm")
    return best(both_ways(rest, by).unionByName(forward).unionByName(back), "mark_id", "ref")


def save_graph(graph: DataFrame, path: str, threshold: float) -> None:
    """Keeps a similarity graph, with the threshold it was built for."""
    graph.withColumn("threshold", F.lit(threshold).cast("float")).write.mode("overwrite").parquet(path)


def load_graph(spark: SparkSession, path: str, threshold: float) -> DataFrame:
    """A graph kept before; one that was built for another threshold is refused."""
    graph = spark.read.parquet(path)
    if graph.where(F.col("threshold") != F.lit(threshold).cast("float")).limit(1).count():
        raise ValueError("the graph was built for another threshold")
    return graph.drop("threshold")
