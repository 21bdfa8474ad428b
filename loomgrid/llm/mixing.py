"""Mixing sources to target weights by hierarchical budgeting.

The tree has a level per column of `levels`, for instance domain, language, source. A token budget goes down it from the
root in proportion to the weights of the children. A child that cannot use its share, because its supply times `epochs`
is smaller, leaves the shortage to its siblings in proportion to their weights; only what a whole subtree cannot use goes
on to the siblings of its ancestors. Each leaf then takes the prefix of its seeded epochs whose tokens fit its budget:
whole epochs first, then the start of the next one in the order of a seeded hash.

The tree has one row a leaf and may have at most `most_leaves`; only it and one cut a leaf reach the driver. A leaf's order
is cut by ranges of the hash: whole ranges are in or out by their sums, and only the rows of the range that the budget
ends in are put in order, so a leaf with a third of all rows is never in one task.

Null in a level is a value of its own. A weight is looked up by the path of values, then by the value under any parent
(a path of None and the value), else it is 1; a negative one raises ValueError. Null and empty texts count no tokens and
are taken as long as their place in the order lies before the cut. Repeated rows count each. An empty table or a zero
budget gives no rows. Columns of docs may have any names: where one is called like a column that is added (epoch__, tokens__,
budget__), the added one gets a further _.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 12  # bits of the hash that number a leaf's ranges
MOST_LEAVES = 100_000
SEED = 42


# Blocks of scripts that set no spaces between words: Thai and Lao, Myanmar, Khmer, kana, ideographs, narrow kana.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))


def words(text: str = "text") -> Column:
    """Tokens: signs of scripts that set no spaces between words, each by itself, and runs of other signs than those and white space. A
    language written without spaces has its share of a budget, then; runs of spaces alone would make a whole page one token. Texts
    without a sign of the two spans that hold these scripts are counted by the simpler pattern, which finds the same runs in them."""
    t = F.col(text).cast("string")
    signs = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in UNSPACED)
    runs = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    mixed = F.regexp_count(t, F.lit(rf"[^\x20\x09-\x0D{signs}]+|[{signs}]"))
    return F.coalesce(F.when((F.octet_length(t) == F.char_length(t)) | ~t.rlike(r"[\x{E00}-\x{17FF}\x{3040}-\x{3FFFF}]"), runs).otherwise(mixed), F.lit(0)).cast("long")


def weight_of(weights: Mapping[tuple, float], path: tuple) -> float:
    w = float(weights.get(path, weights.get((None, path[-1]), 1.0)))
    if not w >= 0:
        raise ValueError(f"weight of {path}: {w}")
    return w


def share(budget: float, wants: list[float], most: list[float]) -> list[float]:
    """Deals a budget by weights, none beyond its most; what one cannot take goes to the others."""
    got = [0.0] * len(wants)
    left, open_ = min(budget, sum(m for m, w in zip(most, wants, strict=True) if w > 0)), [k for k, w in enumerate(wants) if w > 0 and most[k] > 0]
    while open_ and left > 0:
        total = sum(wants[k] for k in open_)
        full = [k for k in open_ if most[k] <= left * wants[k] / total]
        if not full:
            for k in open_:
                got[k] = left * wants[k] / total
            break
        for k in full:
            got[k] = most[k]
        left -= sum(most[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return got


def budgets(supply: Mapping[tuple, int], weights: Mapping[tuple, float], budget: float, epochs: int) -> dict[tuple, int]:
    """Whole tokens for each leaf (a path of values)."""
    below: dict[tuple, list[tuple]] = {}
    most: dict[tuple, float] = {}
    for leaf, tokens in supply.items():
        for n in range(len(leaf) + 1):
            node = leaf[:n]
            if node not in most:
                most[node] = 0.0
                if n:
                    below.setdefault(leaf[: n - 1], []).append(node)
            most[node] += tokens * epochs
    # a subtree of weight zero can take nothing
    for node in sorted(most, key=len, reverse=True):
        if node in below:
            most[node] = sum(most[c] for c in below[node] if weight_of(weights, c) > 0)
    out: dict[tuple, int] = {}
    todo = [((), float(budget))]
    while todo:
        node, amount = todo.pop()
        if node in below:
            children = sorted(below[node], key=str)
            todo += zip(children, share(amount, [weight_of(weights, c) for c in children], [most[c] for c in children]), strict=True)
        elif node in supply:
            out[node] = min(floor(amount + 1e-6), supply[node] * epochs)
    return out


def unused(name: str, names: list[str]) -> str:
    """The name, with as many further _ as it takes to be none of the names in any case."""
    known = {n.lower() for n in names}
    while name.lower() in known:
        name += "_"
    return name


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float], budget: float | None = None, share_of_supply: float = 0.9, epochs: int = 1, doc_id: str = "doc_id", tokens: Column | None = None, seed: int = SEED, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """The chosen rows of docs, with epoch__, tokens__ and a column of the leaf's budget budget__ behind their own columns.

    levels: name and value of each level, from the root down. budget: tokens; without it, share_of_supply of all tokens."""
    names = docs.columns
    back = {n: f"c{k}" for k, n in enumerate(names)}

    # the levels and tokens are expressions over the columns of docs, so they are formed before the renaming
    formed = docs.select("*", *(v.cast("string").alias(f"level{k}__") for k, v in enumerate(levels.values())), (words() if tokens is None else tokens).alias("tokens__"))
    plain = formed.toDF(*back.values(), *(f"level{k}" for k in range(len(levels))), "tokens")
    keys = [f"level{k}" for k in range(len(levels))]

    total = {tuple(r[k] for k in keys): r["tokens"] for r in plain.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).limit(most_leaves + 1).collect()}
    if len(total) > most_leaves:
        raise ValueError(f"the tree has more than {most_leaves} leaves")
    supply = {leaf: int(n or 0) for leaf, n in total.items()}
    given = budgets(supply, weights, share_of_supply * sum(supply.values()) if budget is None else budget, epochs)
    spark = docs.sparkSession
    fields = ", ".join(f"{k} string" for k in keys)
    leaves = spark.createDataFrame([(*leaf, n, n // supply[leaf] if supply[leaf] else 0, n % supply[leaf] if supply[leaf] else 0) for leaf, n in given.items() if n > 0], f"{fields}, budget long, whole long, rest long")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]

    # The order of the epoch that is taken in part; the whole ones need none.
    wanted = F.broadcast(leaves)  # a row a leaf
    rows = plain.join(wanted, same(plain, wanted)).drop(*(wanted[k] for k in keys))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), F.col("whole"), F.col(back[doc_id]))).withColumn("range", F.shiftright("place", 64 - RANGES))
    sums = rows.groupBy(*keys, "range", "rest").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n"))
    cuts = before.where(F.col("before") <= F.col("rest")).groupBy(*keys).agg(F.max(F.struct("range", "before")).alias("cut"))
    cuts = F.broadcast(cuts.select(*(F.col(k).alias(f"{k}_") for k in keys), "cut"))  # a row a leaf
    placed = rows.join(cuts, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    early = F.col("range") < F.col("cut.range")
    within = Window.partitionBy(*keys).orderBy("place", back[doc_id]).rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where((F.col("range") == F.col("cut.range")) & (F.col("rest") > 0)).withColumn("upto", F.sum("tokens").over(within) + F.col("cut.before"))
    shown = [*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), "epoch", "tokens", "budget"]
    parts = [
        placed.where(F.col("whole") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))),
        placed.where(early & (F.col("rest") > 0)).withColumn("epoch", F.col("whole")),
        edge.where(F.col("upto") <= F.col("rest")).withColumn("epoch", F.col("whole")),
    ]
    parts = [p.select(*shown).toDF(*names, *(unused(n, names) for n in ("epoch__", "tokens__", "budget__"))) for p in parts]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
