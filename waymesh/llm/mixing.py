"""Mixtures of sources by target shares of tokens, drawn by hash thresholds.

Every document has a fixed hash.  A source that must give more than it holds
gives all of its documents once or several times; for the rest of its budget
it gives the documents whose hash lies below a threshold.  Thresholds come
from histograms of tokens by hash bucket: one pass finds the bucket in which a
budget is reached, and only that bucket is split further.  Documents are
filtered, never sorted, and the draw of a smaller budget is part of the draw of
a larger one.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.session import cut

BITS, LEVELS = 10, 6  # 60 bits of hash, 1024 buckets a level
MAX_TARGETS = 10_000


def _hash(col: str = "doc_id"):
    """60 bits of hash as a non-negative bigint."""
    return F.shiftrightunsigned(F.xxhash64(F.col(col)), 4)


def budgets(targets: list, held: dict[str, int], total: float | None = None) -> list[dict]:
    """Tokens that each source of each mix has to give.

    Shares of sources without any token go to the others of the mix in
    proportion.  Unless ``total`` is given, a mix is made as large as its caps
    allow with all shares kept; with ``total``, sources give at most their cap.
    """
    mixes = defaultdict(dict)
    for t in targets:
        if t["mix_id"] is not None and t["source"] is not None and (t["target_share"] or 0) > 0:
            mixes[t["mix_id"]][t["source"]] = (float(t["target_share"]), max(0, int(t["max_repeats"] or 0)))
    out = []
    for mix in sorted(mixes):
        have = {s: (share, cap) for s, (share, cap) in mixes[mix].items() if held.get(s, 0) > 0 and cap > 0}
        whole = sum(share for share, _ in have.values())
        size = total if total is not None else min((held[s] * cap * whole / share for s, (share, cap) in have.items()), default=0.0)
        for s, (share, cap) in sorted(have.items()):
            want = min(float(held[s] * cap), share / whole * size)
            full = min(cap, int((want + 0.5) // held[s]))
            out.append({"mix_id": mix, "source": s, "full": full, "rest": max(0.0, want - full * held[s]) if full < cap else 0.0})
    return out


def thresholds(counts: DataFrame, wanted: list[dict]) -> list[dict]:
    """Add ``below`` to each budget: documents with a smaller hash fill ``rest`` as nearly as whole documents can.

    Each level reads token sums of 1024 buckets for every open (source,
    bucket); the number of open buckets is bounded by that of the budgets.
    """
    for w in wanted:
        w.update(prefix=0, done=0.0, open=w["rest"] > 0, below=0)
    spark = counts.sparkSession
    for level in range(LEVELS):
        live = sorted({(w["source"], w["prefix"]) for w in wanted if w["open"]})
        if not live:
            break
        high, low = BITS * (LEVELS - level), BITS * (LEVELS - level - 1)
        spots = F.broadcast(spark.createDataFrame(live, "source string, prefix bigint"))  # at most one row a budget
        rows = counts.join(spots, "source") if level == 0 else counts.join(spots, (counts["source"] == spots["source"]) & (F.shiftright("h", high) == spots["prefix"])).drop(spots["source"])
        sums = rows.groupBy("source", "prefix", F.shiftright("h", low).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")).alias("b")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source", "prefix").orderBy("b")))  # at most 1024 rows a window
        asked = spark.createDataFrame([(i, w["source"], w["prefix"], float(w["rest"] - w["done"])) for i, w in enumerate(wanted) if w["open"]], "i int, source string, prefix bigint, room double")
        over = F.min(F.when(F.col("upto") > F.col("room"), F.struct("b", "upto", "n", "docs"))).alias("edge")
        # the bucket in which each budget is reached: one row a budget comes to the driver
        for r in upto.join(F.broadcast(asked), ["source", "prefix"]).groupBy("i").agg(over, F.sum("n").alias("all")).collect():
            w, edge = wanted[r["i"]], r["edge"]
            if edge is None:
                w["done"] += r["all"]
                w["below"], w["open"] = (w["prefix"] + 1) << high, False
                continue
            w["done"] += edge["upto"] - edge["n"]
            if edge["docs"] == 1 or level == LEVELS - 1:
                take = w["done"] + edge["n"] - w["rest"] < w["rest"] - w["done"]
                w["below"], w["open"] = ((w["prefix"] << BITS) + edge["b"] + take) << low, False
            else:
                w["prefix"] = (w["prefix"] << BITS) + edge["b"]
    return wanted


def draw(counts: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares) from counts(doc_id, source, n_tokens) and targets(mix_id, source, target_share, max_repeats).

    drawn(mix_id, doc_id, source, n_tokens, copies): copies is at least 1 and
    at most max_repeats.  shares(mix_id, source, target_share, actual_share,
    tokens, documents, most_copies): one row for each target; sources that
    give nothing have zeros, and actual shares of a mix sum to 1 unless it is
    empty.

    * Sources are compared as written.  Documents with a null source or no
      token are never drawn.  Targets that are null, zero or capped at zero
      draw nothing.
    * Repeated rows count once; several targets of one mix and source are one
      of their summed share and least cap.
    * Shares are met to within half of one document, as far as the caps allow.
    * Empty tables give empty mixes.
    More than MAX_TARGETS targets raise ValueError: they are planned on the
    driver, and what is broadcast has at most that many rows.
    """
    spark = counts.sparkSession
    each = targets.select("mix_id", "source", "target_share", "max_repeats").distinct()
    each = each.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    plan = each.limit(MAX_TARGETS + 1).collect()
    if len(plan) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    names = spark.createDataFrame(sorted({(r["source"],) for r in plan if r["source"] is not None}), "source string")
    pool = counts.filter(F.col("n_tokens") > 0).join(F.broadcast(names), "source").select("doc_id", "source", "n_tokens", _hash().alias("h"))
    held = {r["source"]: r["n"] for r in pool.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    wanted = thresholds(pool, budgets(plan, held, total))
    rules = spark.createDataFrame([(w["mix_id"], w["source"], w["full"], w["below"]) for w in wanted], "mix_id string, source string, full int, below bigint")
    copies = (F.col("full") + (F.col("h") < F.col("below")).cast("int")).alias("copies")
    drawn = pool.join(F.broadcast(rules), "source").select("mix_id", "doc_id", "source", "n_tokens", copies).filter("copies > 0")
    given = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    whole = given.groupBy("mix_id").agg(F.sum("tokens").alias("whole"))
    asked = spark.createDataFrame([(r["mix_id"], r["source"], r["target_share"]) for r in plan if r["mix_id"] is not None and r["source"] is not None], "mix_id string, source string, target_share double")
    shares = asked.join(given, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = F.lit(0)
    shares = shares.select(
        "mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", zero).alias("most_copies"),
    )
    return drawn, shares


def mix(documents: DataFrame, targets: DataFrame, path: str, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``draw`` with sizes in tokens of the vocabulary at ``path``; documents are encoded once and only counts are kept."""
    from waymesh.llm.tokenize import token_counts

    return draw(cut(token_counts(documents, path)), targets, total)
