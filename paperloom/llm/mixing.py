"""Problem 7: combine sources to target shares, measured in tokens, with a cap on repeats.

Method: a multivariate-hypergeometric splitting tree. Each source is divided by hash into blocks; a plan's quota of a
source is a number of whole passes over its blocks and a last partial pass, so it is an exact number of block copies.
The vector of these numbers is split recursively between the output shards: at every node the left half of the shards
draws its number of block copies without replacement from what the node holds, which makes the counts per source
multivariate hypergeometric. Every draw depends only on the seed and the node, so a task can walk from the root to the
shard of a block copy by itself, and no shard list passes through the driver. The copies of a source are numbered in a
permuted order (a fresh one per pass); a shard owns a range of these numbers, so the ranges are disjoint and together
complete. Orders are kept in two levels, groups of blocks and blocks of a group, so their number may grow freely. Inside a shard the documents get a random order of their own.

What travels: the token counts (ids and numbers, no texts), one row per block, and one row per drawn document. Blocks
are hash ranges of a source, so a source with a third of all rows is spread over as many blocks as it deserves. The
driver and the tasks see one number per plan and source, whose count is bounded by the table of targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.encoding import count_tokens
from paperloom.session import materialize

def _unit(*parts) -> F.Column:
    """A reproducible integer hash of columns (by name) and literal numbers."""
    return F.xxhash64(*[F.col(p) if isinstance(p, str) else F.lit(p) for p in parts])


def source_blocks(tokens: DataFrame, seed: int, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their block, and the sources with tokens and number of blocks. Null sources are no source."""
    known = tokens.where(F.col("source").isNotNull())
    sources = known.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.col("source_docs"), F.ceil(F.col("source_tokens") / F.lit(block_tokens)))).cast("long"))
    # one row per source: small by nature, and AQE checks the size before it broadcasts
    docs = known.join(sources.select("source", "n_blocks"), "source").withColumn("block", F.pmod(_unit("doc_id", seed), F.col("n_blocks"))).drop("n_blocks")
    return docs, sources


def quotas(targets: DataFrame, sources: DataFrame, all_tokens: int) -> DataFrame:
    """Per plan and source: tokens wanted, tokens there, whole passes, tokens of the last partial pass.

    A source that the corpus lacks, or that has no tokens, has nothing to give. Targets delivered twice count once.
    """
    plan = targets.select("plan", "source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"), F.col("total_ratio").cast("double")).dropDuplicates(["plan", "source"])
    joined = plan.join(sources, "source", "left")
    there = F.coalesce("source_tokens", F.lit(0))
    want = F.coalesce("target_share", F.lit(0.0)) * F.coalesce("total_ratio", F.lit(0.0)) * F.lit(all_tokens)
    passes = F.when(there > 0, F.least(F.floor(want / there), F.coalesce("max_repeats", F.lit(0)))).otherwise(0)
    return (
        joined.withColumn("wanted_tokens", want)
        .withColumn("source_tokens", there)
        .withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
        .withColumn("full_passes", passes.cast("int"))
        .withColumn("rest_tokens", F.when((there > 0) & (F.col("full_passes") < F.coalesce("max_repeats", F.lit(0))), F.col("wanted_tokens") - F.col("full_passes") * there).otherwise(0.0))
        .drop("source_docs")
    )


def drawn_blocks(docs: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """Block copies each plan takes: plan, source, block, pass, rank (place in the source's order), cut (tokens to take
    of the last block, null for a whole one)."""
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    base = quota.where((F.col("full_passes") > 0) | (F.col("rest_tokens") > 0)).select("plan", "source", "full_passes", "rest_tokens", "n_blocks").join(blocks, "source")
    turns = base.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full_passes"))))
    # the order of a pass is that of groups and inside them: about the square root of all blocks, so no task orders them all
    group = F.pmod(_unit("plan", "source", "pass", "block", seed + 4), F.ceil(F.sqrt("n_blocks")).cast("long"))
    turns = turns.withColumns({"group": group, "order": _unit("plan", "source", "pass", "block", seed + 1)})
    keys = ["plan", "source", "pass", "group"]
    before_group = Window.partitionBy("plan", "source", "pass").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = turns.groupBy(*keys).agg(F.sum("block_tokens").alias("group_tokens")).select(*keys, F.coalesce(F.sum("group_tokens").over(before_group), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys).orderBy("order", "block")
    ordered = turns.join(offsets, keys).withColumn("before", F.col("offset") + F.sum("block_tokens").over(inside) - F.col("block_tokens"))
    last = F.col("pass") == F.col("full_passes")
    taken = materialize(ordered.where(~last | (F.col("before") < F.col("rest_tokens"))), "mix-taken")  # one row per block copy
    # places count the taken block copies of a source over all its passes and groups
    before_all = Window.partitionBy("plan", "source").orderBy("pass", "group").rowsBetween(Window.unboundedPreceding, -1)
    places = taken.groupBy(*keys).agg(F.count("*").alias("n_taken")).select(*keys, F.coalesce(F.sum("n_taken").over(before_all), F.lit(0)).alias("first"))
    return taken.join(places, keys).select("plan", "source", "block", "pass", (F.col("first") + F.row_number().over(inside) - 1).alias("rank"), F.when(last & (F.col("before") + F.col("block_tokens") > F.col("rest_tokens")), F.col("rest_tokens") - F.col("before")).alias("cut"))


class SplittingTree:
    """Which shard owns the ``rank``-th block copy of a source; ``counts`` are the copies per source, in a fixed order."""

    def __init__(self, counts: list[int], shards: int, seed: int):
        self.shards, self.seed = shards, seed
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.root = np.asarray(counts, dtype=np.int64)

    def _split(self, lo: int, hi: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.nodes.get((lo, hi))
        if known is None:
            mid = (lo + hi) // 2
            total = int(counts.sum())
            draw = total * (mid - lo) // (hi - lo)
            rng = np.random.Generator(np.random.Philox(key=(self.seed << 64) | (lo << 32) | hi))
            left = np.zeros_like(counts)
            rest = total
            for s, c in enumerate(counts):  # conditional draws, one hypergeometric variate per source
                other = rest - int(c)
                left[s] = rng.hypergeometric(int(c), other, draw) if draw and c else 0
                draw -= int(left[s])
                rest = other
            if len(self.nodes) > 200_000:
                self.nodes.clear()
            known = self.nodes[lo, hi] = (left, counts - left)
        return known

    def shard(self, source: int, rank: int) -> int:
        lo, hi, counts = 0, self.shards, self.root
        while hi - lo > 1:
            left, right = self._split(lo, hi, counts)
            mid = (lo + hi) // 2
            if rank < left[source]:
                hi, counts = mid, left
            else:
                rank -= int(left[source])
                lo, counts = mid, right
        return lo


def assign_shards(drawn: DataFrame, seed: int, shard_blocks: int) -> DataFrame:
    """Adds ``shard`` to the block copies: one walk down the tree of the plan per copy."""
    counts = drawn.groupBy("plan", "source").agg(F.count("*").alias("n"))
    # one entry per source of a plan: bounded by the table of targets
    roots = counts.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("root"))
    source = drawn.join(roots, "plan").select("plan", "source", "block", "pass", "rank", "cut", "root")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str, tuple[dict[str, int], SplittingTree]] = {}
        for frame in frames:
            shards = []
            for plan, name, rank, root in zip(frame["plan"], frame["source"], frame["rank"], frame["root"]):
                if plan not in trees:
                    names = [x["source"] for x in root]
                    n = [int(x["n"]) for x in root]
                    trees[plan] = ({s: i for i, s in enumerate(names)}, SplittingTree(n, max(1, -(-sum(n) // shard_blocks)), seed))
                index, tree = trees[plan]
                shards.append(tree.shard(index[name], int(rank)))
            yield frame[["plan", "source", "block", "pass", "cut"]].assign(shard=shards)

    return source.mapInPandas(run, "plan string, source string, block bigint, pass int, cut double, shard int")


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 7, block_tokens: int = 50_000, shard_blocks: int = 16, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (plan, shard, position, source, doc_id, pass, n_tokens) and the quotas it was drawn to.

    A plan's source gives documents until its target is met, the last one may pass it by less than its own size; a
    source whose repeats run out gives all it may. Documents without tokens carry no size and are never drawn; null
    sources belong to no plan but count in the size of the corpus; ties of hashes are broken by document id, so the mix
    is the same for any partitioning. Several rows with one id and the same text are one document.
    """
    tokens = materialize(count_tokens(documents, ["doc_id", "source"], vocabulary), "mix-tokens")
    docs, sources = source_blocks(tokens, seed, block_tokens)
    sources = materialize(sources, "mix-sources")
    size = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    quota = materialize(quotas(targets, sources, size), "mix-quotas")
    docs = docs.where(F.col("n_tokens") > 0)
    drawn = assign_shards(drawn_blocks(docs, quota, seed), seed, shard_blocks)
    rows = docs.join(drawn, ["source", "block"])
    # the last block of a quota is cut inside, in a random order of its documents; a block is a bounded group
    w = Window.partitionBy("plan", "source", "block", "pass").orderBy(_unit("doc_id", "pass", seed + 2), "doc_id")
    whole = rows.where(F.col("cut").isNull())
    partial = rows.where(F.col("cut").isNotNull()).withColumn("before", F.sum("n_tokens").over(w) - F.col("n_tokens")).where(F.col("before") < F.col("cut")).drop("before")
    mix = whole.unionByName(partial)
    local = Window.partitionBy("plan", "shard").orderBy(_unit("plan", "doc_id", "pass", seed + 3), "doc_id", "pass")
    return mix.select("plan", "shard", F.row_number().over(local).alias("position"), "source", "doc_id", "pass", "n_tokens"), quota


def mix_report(mix: DataFrame, quota: DataFrame) -> DataFrame:
    """Per plan and source: tokens wanted and really there, share wanted and reached, passes begun, and whether the target was met."""
    reached = mix.groupBy("plan", "source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("mixed_docs"), (F.max("pass") + 1).alias("passes"))
    plan = Window.partitionBy("plan")
    out = quota.join(reached, ["plan", "source"], "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    return out.select(
        "plan",
        "source",
        "target_share",
        F.coalesce(F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(plan)), F.lit(0.0)).alias("actual_share"),
        "wanted_tokens",
        "mixed_tokens",
        F.coalesce("mixed_docs", F.lit(0)).alias("mixed_docs"),
        F.coalesce("passes", F.lit(0)).alias("passes"),
        "max_repeats",
        (F.col("mixed_tokens") >= F.col("wanted_tokens")).alias("reached"),
    )
