"""Tabular operators: catalogues, similarity lists, tolerance joins, samples, grids and reports."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.paths import padded
from palimpsest.session import durable, prepare


def without(rows: DataFrame, rejected: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys no rejected row has."""
    return rows.join(rejected.select(*on).distinct(), on, "left_anti")


def stack_catalogues(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns by name, null where a part lacks one."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def dense_numbers(rows: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """Numbers rows from 0 without a gap, in order; equal ones in any order.

    A global row_number would take all rows through one task. Instead rows are range-partitioned by the order and written once, numbered
    within partitions, and shifted by the counts of the partitions before: one row a partition is all that meets in one place. Both the counts and
    the ranks read the written rows, as each plan of its own would sample bounds of its own. Rows of one frequent value part by where they came from.
    """
    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism * 4, 1 << 12))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    placed = durable(tied.repartitionByRange(parts, *order, "__tie").withColumn("__part", F.spark_partition_id()), "placed")
    inside = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__tie")) - 1)
    before = placed.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = inside.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col("__rank") + F.col("__before"))  # at most 4,096 rows
    return numbered.drop("__part", "__rank", "__before", "__tie")


def numbered_ids(rows: DataFrame, order: list[str | Column], width: int, name: str = "id") -> DataFrame:
    return dense_numbers(rows, order, "__n").withColumn(name, padded(F.col("__n") + 1, width)).drop("__n")


def seeded(*columns: str, seed: int = 0) -> Column:
    """A draw for each row that is the same in every run."""
    return F.xxhash64(*[F.col(c) for c in columns], F.lit(seed))


def draw(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, by the order of the seeded hash of their key."""
    return rows.orderBy(seeded(key, seed=seed), key).limit(n)


def best_of(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def kth(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") == k).drop("__n")


def partners(rows: DataFrame, key: str, group: str, seed: int = 0) -> DataFrame:
    """Each row of a group with the next one in hash order, the last with the first; a group of one row has none."""
    w = Window.partitionBy(group).orderBy(seeded(key, seed=seed), key)
    first = F.first(key).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    paired = rows.withColumn("partner", F.coalesce(F.lead(key).over(w), first))
    return paired.filter(F.col("partner") != F.col(key))


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float, block_rows: int = 4096) -> DataFrame:
    """a, b, score: pairs a < b of vectors whose cosine is at least `least`.

    All vectors meet in pairs of blocks, each a matrix product in one Arrow task; every vector is sent once to each block
    row, not to each other vector.
    """
    spark = prepare(vectors.sparkSession)
    blocks = max(1, -(-vectors.count() // block_rows))
    kind = dict(vectors.dtypes)[key]
    own = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("own"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        m = np.array(pdf["v"].tolist(), dtype=np.float64)
        size = np.sqrt((m * m).sum(axis=1))
        unit = m / np.where(size > 0, size, 1)[:, None]
        ids = pdf["id"].to_numpy()
        left = np.flatnonzero(pdf["own"].to_numpy() == i)
        right = left if i == j else np.flatnonzero(pdf["own"].to_numpy() == j)
        p, q = np.nonzero(np.round(unit[left] @ unit[right].T, 12) >= least)
        a, b = ids[left[p]], ids[right[q]]
        score = (unit[left[p]] * unit[right[q]]).sum(axis=1)
        keep = a < b if i == j else a != b
        a, b, score = a[keep], b[keep], score[keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})

    return sent.groupBy("i", "j").applyInPandas(run, f"a {kind}, b {kind}, score double")


#: Rows that meet all of the other block at once, rows of a block, and block pairs that at least so many tasks share.
STEP_ROWS, BLOCK_ROWS, LEAST_PAIRS = 256, 65_536, 64


def similar_first(vectors: DataFrame, key: str, vector: str, least: float, n: int, digits: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query, candidate, score: of each vector the n most similar ones of a cosine of at least `least`, by the score rounded to so many digits, then by candidate.

    Blocks of queries meet blocks of candidates as matrix products, some rows at a time, and keep the n first of each query, so pairs beyond them are neither written nor shuffled; a window chooses
    among the blocks' rows. Vectors of few rows are cut into more blocks of queries, for tasks enough.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.count()
    bases = max(1, -(-rows // block_rows))
    queries = max(bases, min(-(-LEAST_PAIRS // bases), -(-rows // STEP_ROWS)), 1)
    kind = dict(vectors.dtypes)[key]
    own = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.xxhash64(key).alias("h"))
    block = lambda of: F.pmod("h", F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    as_query = own.select("id", "v", F.lit(True).alias("asks"), block(queries).alias("i"), every(bases).alias("j"))
    as_base = own.select("id", "v", F.lit(False).alias("asks"), every(queries).alias("i"), block(bases).alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        (qid, x), (bid, y) = ((side["id"].to_numpy(), np.array(side["v"].tolist(), dtype=np.float64)) for side in (pdf[asks], pdf[~asks].sort_values("id")))
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(x) and len(y):
            x, y = (m / np.where((size := np.sqrt((m * m).sum(axis=1))) > 0, size, 1)[:, None] for m in (x, y))
            for at in range(0, len(x), STEP_ROWS):
                score = x[at : at + STEP_ROWS] @ y.T
                # products are rounded: what may reach the bound, or the n-th score once it is rounded, is measured again
                bound = np.full(len(score), least - 1e-11)
                if n < score.shape[1]:
                    edge = score.shape[1] - n - 1  # one more than n: oneself may be among them
                    bound = np.maximum(bound, np.partition(score, edge, axis=1)[:, edge] - 1.5 * 10.0**-digits)
                p, q = np.nonzero(score >= bound[:, None])
                value = (x[at + p] * y[q]).sum(axis=1)
                kept = (np.round(value, 12) >= least) & (qid[at + p] != bid[q])
                p, q, value = p[kept], q[kept], value[kept]
                order = np.lexsort((q, -np.round(value, digits), p))
                p, q, value = p[order], q[order], value[order]
                # rows whose rounded score is the n-th one's within a digit stay: Spark rounds halves its own way
                first = np.searchsorted(p, p)
                last = value[np.minimum(first + n, np.searchsorted(p, p, "right")) - 1]
                near = (np.arange(len(p)) - first < n) | (np.abs(np.abs(value * 10.0**digits % 1) - 0.5) < 1e-3) & (value >= last - 1.5 * 10.0**-digits)
                found.append((p[near] + at, q[near], value[near]))
        p, q, value = (np.concatenate(v) for v in zip(*found, strict=True))
        return pd.DataFrame({"query": qid[p], "candidate": bid[q], "score": value})

    dealt = as_query.unionByName(as_base).repartition(max(queries * bases, 1), "i", "j")
    pairs = dealt.groupBy("i", "j").applyInPandas(run, f"query {kind}, candidate {kind}, score double").withColumn("score", F.round("score", digits))
    return best_of(pairs, ["query"], [F.desc("score"), F.col("candidate")], n)


def similar_top(pairs: DataFrame, catalogue: DataFrame, key: str, n: int, pads: int, seed: int = 0) -> DataFrame:
    """query, candidate, score, rank: the n most similar of each row; short lists are padded from `pads` seeded rows of the catalogue at score 0."""
    both = pairs.select(F.col("a").alias("query"), F.col("b").alias("candidate"), "score").unionByName(pairs.select(F.col("b").alias("query"), F.col("a").alias("candidate"), "score"))
    return padded_top(both, catalogue, key, n, pads, seed)


def padded_top(both: DataFrame, catalogue: DataFrame, key: str, n: int, pads: int, seed: int = 0) -> DataFrame:
    """The lists of similar_top() from rows (query, candidate, score) of either direction."""
    pool = draw(catalogue.select(F.col(key).alias("candidate")), "candidate", pads, seed)  # at most `pads` rows
    padding = catalogue.select(F.col(key).alias("query")).crossJoin(F.broadcast(pool)).filter("query <> candidate").withColumn("score", F.lit(0.0))
    listed = best_of(both.unionByName(padding), ["query", "candidate"], [F.desc("score")])
    w = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return listed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def tolerance_join(left: DataFrame, right: DataFrame, klass: str, ratio: str, tolerances: dict[str, float], default: float) -> DataFrame:
    """Rows of one class whose ratios differ by at most the class's tolerance.

    The ratio is cut into cells as wide as the tolerance, and a row meets the cells beside its own: an equi-join on
    (class, cell) with a residual check, whatever the size of the sides.
    """
    width = F.lit(default)
    for name, value in tolerances.items():
        width = F.when(F.col(klass) == name, value).otherwise(width)
    l = left.withColumn("__w", width).withColumn("__cell", F.floor(F.col(ratio) / F.col("__w")))
    r = right.withColumnRenamed(ratio, f"{ratio}_r").withColumn("__w", width)
    r = r.withColumn("__cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(f"{ratio}_r") / F.col("__w")) + d))).drop("__w")
    return l.join(r, [klass, "__cell"]).filter(F.abs(F.col(ratio) - F.col(f"{ratio}_r")) <= F.col("__w")).drop("__cell", "__w")


def greedy_fill(slots: DataFrame, images: DataFrame, tolerances: dict[str, float], default: float) -> DataFrame:
    """template, slot, image: slots in order each take the first free image of their class within tolerance.

    slots: (template, slot, class, ratio); images: (template, image, class, ratio), each template's own pool. A template that leaves a slot open gives no rows.
    """
    prepare(slots.sparkSession)

    def run(key, want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        have = have.sort_values("image")
        free = dict.fromkeys(have.index, True)
        out = []
        for s in want.sort_values("slot").itertuples():
            near = tolerances.get(s.klass, default)
            found = next((i for i in have.index if free[i] and have.at[i, "klass"] == s.klass and abs(have.at[i, "ratio"] - s.ratio) <= near), None)
            if found is None:
                return pd.DataFrame({"template": [], "slot": [], "image": []})
            free[found] = False
            out.append((s.template, s.slot, have.at[found, "image"]))
        return pd.DataFrame(out, columns=["template", "slot", "image"])

    kinds = dict(slots.dtypes)
    return slots.groupBy("template").cogroup(images.groupBy("template")).applyInPandas(run, f"template {kinds['template']}, slot {kinds['slot']}, image {dict(images.dtypes)['image']}")


def unfinished(inputs: DataFrame, outputs: DataFrame, on: list[str]) -> DataFrame:
    """Inputs without an output yet."""
    return without(inputs, outputs, on)


def repaired_range(low: Column, high: Column, step: Column) -> Column:
    """The values of (low, high, step) strings: not numeric ends are left out, a missing or lower end or a step that isn't positive gives one value."""
    lo, hi, by = (c.try_cast("double") for c in (low, high, step))
    single = hi.isNull() | by.isNull() | (hi < lo) | (by <= 0)
    count = F.when(single, F.lit(0)).otherwise(F.floor((hi - lo) / by + 1e-9).cast("int"))
    return F.when(lo.isNotNull(), F.transform(F.sequence(F.lit(0), count), lambda i: lo + i * F.coalesce(by, F.lit(0.0))))


def parameter_grid(ranges: DataFrame, names: list[str]) -> DataFrame:
    """All combinations of each row's ranges: a row has <name>_low, <name>_high and <name>_step as strings, and gets one value of every name; other columns stay. Names whose low end is no number give no rows."""
    out = ranges
    for name in names:
        ends = [f"{name}_{end}" for end in ("low", "high", "step")]
        out = out.withColumn(name, F.explode(repaired_range(*map(F.col, ends)))).drop(*ends)
    return out


def first_success(attempts: DataFrame, keys: list[str], ok: Column, order: str) -> DataFrame:
    """Of each key, the first attempt that holds."""
    return attempts.filter(ok).groupBy(*keys).agg(F.min(order).alias(order))


def mean_matrix(scores: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """Means of value, one row by `row`, one column for each of `columns`."""
    return scores.groupBy(row).pivot(column, columns).agg(F.avg(value))


def bold_best(matrix: DataFrame, row: str, columns: list[str], digits: int = 2) -> DataFrame:
    """A LaTeX line a row: values in percent, the best of the row bold, ties too."""
    percent = {c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100, digits) for c in columns}
    top = F.greatest(*percent.values()) if len(columns) > 1 else percent[columns[0]]
    shown = [F.when(v == top, F.concat(F.lit("\\textbf{"), F.format_number(v, digits), F.lit("}"))).otherwise(F.format_number(v, digits)) for v in percent.values()]
    return matrix.select(row, F.concat(F.concat_ws(" & ", F.col(row), *shown), F.lit(" \\\\")).alias("line"))


