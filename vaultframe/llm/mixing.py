"""Mixing sources to target weights, by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.llm.bpe import DEFAULT_FOLDER, VOCABULARY, count_tokens
from vaultframe.session import scratch_path, shared_dir

#: Sources that a mix may name; their figures are what reaches the driver. Cells into which a source's documents are hashed for the fractional repetition.
MOST_SOURCES, CELLS = 10_000, 4_096


def source_key(column: Column | str) -> Column:
    """One spelling of a source's name: lower case, blanks around it cut, blanks and underscores in it one underscore."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s_]+|[\s_]+$", "")), r"[\s_]+", "_")


def water_fill(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens that each source contributes to a mix of ``total``.

    A source can't give more than its size times its repeats. Those whose share
    is more are clamped there, and what they leave is given to the others in
    proportion to their targets, until all fit or all are clamped.
    """
    caps = {s: float(sizes.get(s, 0)) * max(repeats[s], 0) for s in targets}
    given = {s: 0.0 for s in targets}
    open_, left = {s for s in targets if targets[s] > 0 and caps[s] > 0}, float(total)
    while open_ and left > 0:
        weight = sum(targets[s] for s in open_)
        over = {s for s in open_ if caps[s] <= left * targets[s] / weight}
        if not over:
            given |= {s: left * targets[s] / weight for s in open_}
            break
        for s in sorted(over):
            given[s] = caps[s]
            left -= caps[s]
        open_ -= over
    return given


class Mix:
    """A mix of documents: how often each is used, and the shares reached.

    ``total``: the tokens wanted; by default those of all named sources once.
    Sources not named by the targets, documents without tokens and those with a
    null source or id have no part. Of a target's repeated rows the shares are
    added and the largest repeats counts; null shares and repeats are 0.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY):
        spark = documents.sparkSession
        named = targets.groupBy(source_key("source_name").alias("s")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("r"))
        rows = named.filter("s is not null").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"a mix of more than {MOST_SOURCES} sources")
        self.targets, self.repeats = {r["s"]: float(r["w"]) for r in rows}, {r["s"]: int(r["r"]) for r in rows}
        self.seed = seed
        shared_dir(spark)
        path = scratch_path(spark, "token-counts")
        mine = documents.select("doc_id", "text", source_key("source").alias("source")).filter(F.col("source").isin(*self.targets) & F.col("doc_id").isNotNull())
        count_tokens(mine, "text", ("doc_id", "source"), folder, vocabulary).filter("n_tokens > 0").write.parquet(path)
        # A hash of seed and id gives each document its place in its source, the same on every run.
        self.sized = spark.read.parquet(path).withColumn("place", F.xxhash64(F.lit(seed), F.col("doc_id")))
        self.sizes = {r["source"]: int(r["n"]) for r in self.sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        self.total = sum(self.sizes.values()) if total is None else total
        self.given = water_fill(self.sizes, self.targets, self.repeats, self.total)

    def documents(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies) of the documents that are used.

        A source that is to be used e times has every document floor(e) times, and
        one time more those whose places come first, up to the fraction of its
        tokens. The cut is found by the tokens in each of CELLS ranges of places and
        then within the one range that it falls into, so nothing is sorted as a
        whole.
        """
        spark = self.sized.sparkSession
        parts = []
        for s, n in sorted(self.sizes.items()):
            epochs = self.given[s] / n if n else 0.0
            whole = int(epochs + 1e-12)
            parts.append((s, whole, min(1.0, max(0.0, epochs - whole)) * n))
        if not parts:
            return self.sized.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies")).limit(0)
        plan = F.broadcast(spark.createDataFrame(parts, "source string, whole int, extra double"))  # at most MOST_SOURCES rows
        cell = F.shiftright("place", 64 - CELLS.bit_length() + 1).cast("int")
        rows = self.sized.withColumn("cell", cell).join(plan, "source")
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = rows.groupBy("source", "cell", "extra").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        edge = cells.filter("before < extra and before + n > extra").select("source", "cell", "before")
        cut = cells.filter("before + n <= extra").groupBy("source").agg(F.max("cell").alias("full"))
        edge, cut = F.broadcast(edge), F.broadcast(cut)  # at most one row a source
        inside = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at_edge = rows.join(edge, ["source", "cell"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
        # The document over which the cut falls is used if more than half of it lies before.
        at_edge = at_edge.withColumn("more", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("extra")).cast("int")).select("doc_id", "source", "n_tokens", "whole", "more")
        plain = rows.join(edge, ["source", "cell"], "left_anti").join(cut, "source", "left").withColumn("more", F.coalesce(F.col("cell") <= F.col("full"), F.lit(False)).cast("int")).select("doc_id", "source", "n_tokens", "whole", "more")
        return plain.unionByName(at_edge).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).alias("copies")).filter("copies > 0")

    def shares(self) -> DataFrame:
        """Each target's figures: share wanted, tokens there are, tokens planned and used, share reached, largest number of copies, most allowed."""
        spark = self.sized.sparkSession
        used = self.documents().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
        goal = [(s, self.targets[s], self.repeats[s], self.sizes.get(s, 0), self.given[s]) for s in sorted(self.targets)]
        frame = spark.createDataFrame(goal, "source string, target_share double, max_repeats int, source_tokens bigint, planned_tokens double")
        rows = frame.join(F.broadcast(used), "source", "left").fillna(0, ["used_tokens", "most_copies"])
        every = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # over at most MOST_SOURCES rows
        return rows.withColumn("all_tokens", every).select("source", "target_share", "max_repeats", "source_tokens", "planned_tokens", "used_tokens", "most_copies", F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
