"""Motif counts, resampling and enrichment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscape.functions.strings import kmers, masked_kmers, normal_tail

from .graph import staged
from .ordered import numbered


def kmer_counts(df: DataFrame, region: str, lengths: tuple[int, ...] = (2, 3, 4), gapped: bool = False, least: int = 1, by: list[str] = ()) -> DataFrame:
    """motif, n over all regions (by group, if any); ``gapped`` adds (q+1)-mers with one inner place free."""
    every = [kmers(region, k) for k in lengths]
    if gapped:
        every += [masked_kmers(region, k + 1) for k in lengths]
    out = df.select(*by, F.explode(F.concat(*every)).alias("motif")).groupBy(*by, "motif").agg(F.count("*").alias("n"))
    return out if least <= 1 else out.where(F.col("n") >= least)


def draw_order(key, sim, seed: str = "") -> Column:
    """A reproducible random order: the md5 of number, seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), sim.cast("string"), key.cast("string")))


def drawn_to(sims: DataFrame, by: list[str], key: str, wanted: str) -> DataFrame:
    """by, last: the order and key of the last of the first ``wanted`` rows of each group, or of its last row; none where none are wanted.

    Rows (by, order_, key, wanted) are counted by the first digits of their order, and
    only those that share them with the last one are put in order.
    """
    digits = F.substring("order_", 1, 2)
    counts = sims.groupBy(*by, digits.alias("digits_")).agg(F.count("*").alias("n_"), F.max(wanted).alias("wanted_"))
    place = Window.partitionBy(*by).orderBy("digits_")  # at most 256 rows
    told = counts.withColumn("to_", F.sum("n_").over(place)).withColumn("all_", F.sum("n_").over(Window.partitionBy(*by)))
    told = told.withColumn("at_", F.least("wanted_", "all_") - (F.col("to_") - F.col("n_"))).where((F.col("at_") > 0) & (F.col("at_") <= F.col("n_")))
    bounds = staged(told.select(*by, "digits_", "at_"), "digits")
    near = sims.withColumn("digits_", digits).join(F.broadcast(bounds), [*by, "digits_"])  # a row for each group
    order = Window.partitionBy(*by).orderBy("order_", key)
    return staged(near.withColumn("place_", F.row_number().over(order)).where("place_ = at_").select(*by, F.struct("order_", key).alias("last_")), "last")


def resamples(reference: DataFrame, key: str, size: int, depth: int, strata: list[str] = (), quotas: DataFrame | None = None, seed: str = "") -> DataFrame:
    """``depth`` samples without replacement: the reference's columns and sim (from 1). ``key`` tells rows apart.

    With strata, ``quotas`` (strata, quota) says how many each gives; if strata are
    too small the sample is topped up from all that is left, in the same order.  The
    last row of each draw is found first (drawn_to), so that a row is drawn or not by
    its order alone, and drawn rows are not shuffled.
    """
    sims = reference.crossJoin(F.broadcast(reference.sparkSession.range(1, depth + 1).select(F.col("id").cast("int").alias("sim"))))  # ``depth`` rows
    sims = sims.withColumn("order_", draw_order(F.col(key), F.col("sim"), seed))
    row = F.struct("order_", key)
    if not strata:
        last = drawn_to(sims.select("sim", "order_", key, F.lit(size).alias("quota_")), ["sim"], key, "quota_")
        return sims.join(F.broadcast(last), "sim").where(row <= F.col("last_")).select(*reference.columns, "sim")
    sizes = staged(reference.groupBy(*strata).agg(F.count("*").alias("n_")).join(quotas.select(*strata, "quota"), strata), "quotas")  # a row a stratum
    wanted = sims.select("sim", *strata, "order_", key).join(F.broadcast(sizes.select(*strata, F.col("quota").alias("quota_"))), list(strata))
    last = drawn_to(wanted, ["sim", *strata], key, "quota_")
    told = sims.join(F.broadcast(last), ["sim", *strata], "left")  # a row for each draw and stratum
    mine = F.coalesce(row <= F.col("last_"), F.lit(False))
    missing = size - int(sizes.agg(F.sum(F.least("quota", "n_")).alias("n")).first()["n"] or 0)
    if missing <= 0:
        return told.where(mine).select(*reference.columns, "sim")
    rest = drawn_to(told.where(~mine).select("sim", "order_", key, F.lit(missing).alias("quota_")), ["sim"], key, "quota_").withColumnRenamed("last_", "rest_")
    return told.join(F.broadcast(rest), "sim", "left").where(mine | F.coalesce(row <= F.col("rest_"), F.lit(False))).select(*reference.columns, "sim")


def stratum_quotas(sample: DataFrame, strata: list[str]) -> DataFrame:
    return sample.groupBy(*strata).agg(F.count("*").alias("quota"))


def resample_log(samples: DataFrame, region: str, observed: DataFrame, lengths=(2, 3, 4), gapped: bool = False) -> DataFrame:
    """sim, motif, n of the observed motifs in each sample; motifs that are absent have no row."""
    counts = kmer_counts(samples, region, lengths, gapped, by=["sim"])
    return counts.join(observed.select("motif"), "motif", "left_semi")


def enrichment(observed: DataFrame, log: DataFrame, depth: int, n_sequences: int, floor_p: bool = True) -> DataFrame:
    """motif, n, avg_ref, top_ref, ove, p of each observed motif over ``depth`` samples (sim, motif, n); absent counts as 0."""
    stats = log.join(observed.withColumnRenamed("n", "seen"), "motif").groupBy("motif").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.count_if(F.col("n") >= F.col("seen")).alias("reached"))
    return _enriched(observed, stats, depth, n_sequences, floor_p)


def _enriched(observed: DataFrame, stats: DataFrame, depth: int, n_sequences: int, floor_p: bool) -> DataFrame:
    x = observed.join(stats, "motif", "left")
    mean = F.coalesce("total", F.lit(0)) / F.lit(float(depth))
    p = F.coalesce("reached", F.lit(0)) / F.lit(float(depth))
    ove = F.when(mean > 0, F.col("n") / mean).otherwise(1.0 / (depth * n_sequences))
    out = x.select("motif", "n", mean.alias("avg_ref"), F.coalesce("top", F.lit(0)).alias("top_ref"), ove.alias("ove"), p.alias("p"))
    return out.withColumn("p", F.when(F.col("p") == 0, 1.0 / depth).otherwise(F.col("p"))) if floor_p else out


def resample_enrichment(sample: DataFrame, reference: DataFrame, key: str, region: str, depth: int = 1000, lengths: tuple[int, ...] = (2, 3, 4), gapped: bool = False, seed: str = "") -> DataFrame:
    """enrichment of a sample's motifs against ``depth`` samples of its size from the reference.

    Each reference row is hashed once for all draws and keeps a bit a draw, so that a
    motif that it holds travels with ``depth`` / 8 bytes, not with a row for each draw
    it is in.  A task counts one motif at a time. Draws of which the last row isn't known yet
    keep the order of the few rows about it.
    """
    size, n = sample.count(), reference.count()
    observed = staged(numbered(kmer_counts(sample, region, lengths, gapped), ["motif"], "number", 0), "motifs")
    every = [kmers(region, k) for k in lengths] + ([masked_kmers(region, k + 1) for k in lengths] if gapped else [])
    known = reference.select(key, F.explode(F.concat(*every)).alias("motif")).join(observed.select("motif", "number"), "motif").groupBy(key).agg(F.collect_list("number").alias("motifs"))
    rows = reference.select(key).join(known, key, "left").select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(key).isNull().alias("none"), "motifs")
    rows = staged(rows.repartition(max(1, int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "k"), "reference")
    wanted, wide = min(size, n), 8 * size**0.5 + 20
    bounds = max(0, int((size - wide) / max(1, n) * 16**8)), min(16**8, int((size + wide) / max(1, n) * 16**8) + 1)
    heads = [f"{seed}|{sim}".encode() for sim in range(1, depth + 1)]

    def order(low: int, high: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(depth, np.int64)
            for b in batches:
                out = []
                for k, none in zip(b["k"], b["none"], strict=True):
                    tail = b"" if none else b"|" + k.encode()
                    told = b"".join([hashlib.md5(h + tail).digest() for h in heads])
                    first = np.frombuffer(told, ">u4")[::4]
                    near = np.flatnonzero((first >= low) & (first < high))
                    total += first < low
                    out.append((np.packbits(first < low).tobytes(), near.tolist(), [told[16 * i : 16 * i + 16] for i in near]))
                yield pd.DataFrame({"motifs": b["motifs"], "bits": [x[0] for x in out], "near": [x[1] for x in out], "orders": [x[2] for x in out], "total": None})
            yield pd.DataFrame({"motifs": [None], "bits": None, "near": None, "orders": None, "total": [total.tolist()]})

        return run

    for low, high in (bounds, (0, 16**8)):
        told = staged(rows.mapInPandas(order(low, high), "motifs array<long>, bits binary, near array<int>, orders array<binary>, total array<long>"), "drawn")
        sure = told.where("total is not null").select(F.posexplode("total").alias("sim", "n")).groupBy("sim").agg(F.sum("n").alias("n"))
        near = told.where("bits is not null").select(F.explode(F.arrays_zip("near", "orders")).alias("x")).select(F.col("x.near").alias("sim"), F.col("x.orders").alias("order"))
        placed = near.withColumn("at", F.row_number().over(Window.partitionBy("sim").orderBy("order"))).join(F.broadcast(sure), "sim")  # a row a draw
        last = {r["sim"]: bytes(r["order"]) for r in placed.where(F.col("at") + F.col("n") == wanted).select("sim", "order").collect()}
        if len(last) == depth or not wanted:
            break  # else a draw fell outside its bounds, which hardly ever happens
    seen = np.array([r["n"] for r in observed.select("number", "n").orderBy("number").collect()], np.int64)  # at most 20 ** k motifs of k residues, some more with a gap
    sent, lasts = sample.sparkSession.sparkContext.broadcast(seen), [last.get(i, b"") for i in range(depth)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for bits, near, orders in zip(b["bits"], b["near"], b["orders"], strict=True):
                own = np.unpackbits(np.frombuffer(bits, np.uint8), count=depth)
                own[[i for i, x in zip(near, orders, strict=True) if bytes(x) <= lasts[i]]] = 1
                out.append(np.packbits(own).tobytes())
            yield pd.DataFrame({"motifs": b["motifs"], "bits": out})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, number, now = sent.value, None, np.zeros(depth, np.int64)
        stats = lambda: (number, int(now.sum()), int(now.max()), int((now >= seen[number]).sum()))
        for b in batches:
            numbers, out = b["number"].to_numpy(), []
            bits = np.unpackbits(np.frombuffer(b"".join(b["bits"]), np.uint8).reshape(len(b), -1), axis=1, count=depth)
            starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(b) else []
            for at, sums in zip(starts, np.add.reduceat(bits, starts, axis=0, dtype=np.int64) if len(b) else [], strict=True):
                if numbers[at] != number:
                    if number is not None:
                        out.append(stats())
                    number, now = int(numbers[at]), np.zeros(depth, np.int64)
                now = now + sums
            yield pd.DataFrame(out, columns=["number", "total", "top", "reached"])
        if number is not None:
            yield pd.DataFrame([stats()], columns=["number", "total", "top", "reached"])

    drawn = told.where("motifs is not null").select("motifs", "bits", "near", "orders").mapInPandas(draw, "motifs array<long>, bits binary")
    held = drawn.select(F.explode("motifs").alias("number"), "bits").repartition("number").sortWithinPartitions("number")
    stats = held.mapInPandas(count, "number long, total long, top long, reached long").where("total > 0").join(observed.select("number", "motif"), "number").drop("number")
    return _enriched(observed.select("motif", "n"), stats, depth, size, True)


#: Least fold change for motifs of 2, 3 and 4 informative residues (fixed values).
MIN_OVE = {2: 1000.0, 3: 100.0, 4: 10.0}


def select_motifs(enriched: DataFrame, max_p: float = 0.001, min_ove: dict[int, float] | float | None = None, least: int = 3, mode: str = "length") -> DataFrame:
    """Motifs with p below, fold change and count at least the limits. ``mode`` count keys the fold change by the motif's count."""
    limits = MIN_OVE if min_ove is None else min_ove
    size = F.length(F.replace("motif", F.lit("."), F.lit(""))) if mode == "length" else F.least(F.col("n"), F.lit(4)).cast("int")
    bound = F.lit(float(limits)) if isinstance(limits, int | float) else F.coalesce(*[F.when(size == k, v) for k, v in limits.items()], F.lit(0.0))
    return enriched.where((F.col("p") < max_p) & (F.col("ove") >= bound) & (F.col("n") >= least))


def motif_occurrences(members: DataFrame, motifs: DataFrame, group: str, seq: str) -> DataFrame:
    """group, motif, n: members of each group that hold each motif."""
    from .similarity import motif_members

    rows = members.withColumn("row_", F.struct(group, seq))
    return motif_members(rows.select("row_", seq).distinct(), "row_", seq, motifs).groupBy(F.col(f"row_.{group}").alias(group), "motif").agg(F.count("*").alias("n"))


def edge_count_null(edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """n, edges, mean, sd, z, p: the number of global edges against its normal null model (fitted constants are fixed values)."""
    n = F.col("n").cast("double")
    counts = sequences.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("edges")))  # a row each
    told = counts.withColumn("mean", 9.786049e-06 * n * n).withColumn("sd", 1.421e-07 * n * n + 3.176e-03 * n)
    told = told.withColumn("z", F.when(F.col("sd") > 0, (F.col("edges") - F.col("mean")) / F.col("sd")))
    return told.withColumn("p", normal_tail("z"))
