"""The decision log: what holds now, its history, its hash chain, and who may do what."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landlace.workers import ship

GENESIS = "0" * 64


def latest(log: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """The last entry for each key: a partial maximum, so a busy key costs no more than another."""
    own = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*own), order).alias("x")).select(*key, *[f"x.{c}" for c in own])


def history(log: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """Each entry with the one it supersedes and its number among its key's entries."""
    w = Window.partitionBy(*key).orderBy(order)
    return log.withColumns({"supersedes": F.lag(order).over(w), "revision": F.row_number().over(w).cast("long")})


def of_dataset(log: DataFrame, dataset: str, default: str = "synthetic") -> DataFrame:
    return log.where(F.coalesce("dataset", F.lit(default)) == dataset)


def pending(pairs: DataFrame, log: DataFrame, *key: str) -> DataFrame:
    return pairs.join(log.select(*key), list(key), "left_anti")


def decisions_on(records: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Records with the officers' last decisions as text, empty where there is none."""
    last = latest(log, key, "officer")
    text = F.concat_ws(" ", "officer", "decision")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda x: x["t"]), "; ")
    return records.join(last.groupBy(key).agg(joined.alias("officer_decisions")), key, "left").withColumn("officer_decisions", F.coalesce("officer_decisions", F.lit("")))


# --- hash chain ------------------------------------------------------------------------------------------------------


def entry_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat(prev, F.coalesce(body, F.lit(""))).cast("binary"), 256)


def canonical(body: dict) -> str:
    """JSON with sorted keys, no spaces, ASCII only: the form that entries are hashed in."""
    return json.dumps(body, sort_keys=True, separators=(",", ":"))


def chain_build(log: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """The log with prev and hash: each entry's hash covers the one before in its chain.

    A chain is sequential by nature: rows are sorted within it and streamed, holding one hash at a time. A null body is hashed as an empty one.
    """
    schema = f"{log.select(chain, order, body).schema.simpleString()[7:-1]}, prev string, hash string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, prev = None, GENESIS
        for df in frames:
            prevs, hashes = [], []
            for c, b in zip(df[chain], df[body], strict=True):
                if c != now:
                    now, prev = c, GENESIS
                prevs.append(prev)
                prev = hashlib.sha256((prev + (b or "")).encode()).hexdigest()
                hashes.append(prev)
            yield df.assign(prev=prevs, hash=hashes)

    return log.select(chain, order, body).repartition(chain).sortWithinPartitions(chain, order).mapInPandas(run, schema)


def chain_check(log: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """(chain, n, first_bad): the first entry whose prev isn't the stored hash before it or whose hash is wrong, null if all hold.

    Each entry meets only its neighbour's stored hash, so a window does what a pass from the start would.
    """
    before = F.lag("hash", 1, GENESIS).over(Window.partitionBy(chain).orderBy(order))
    bad = (F.col("prev") != before) | (F.col("hash") != entry_hash(F.col("prev"), F.col(body)))
    return log.withColumn("bad", bad).groupBy(chain).agg(F.count("*").alias("n"), F.min(F.when(F.col("bad"), F.col(order))).alias("first_bad"))


# --- access ----------------------------------------------------------------------------------------------------------


def lockouts(log: DataFrame, seconds: int = 300, most: int = 5) -> DataFrame:
    """Attempts (failed or success) with the failures in the `seconds` before them since the last success, and whether the account was locked."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    tries = log.where("event in ('failed', 'success')").withColumn("us", micros)
    by = Window.partitionBy("user_id").orderBy("us", "seq")
    tries = tries.withColumn("run", F.sum((F.col("event") == "success").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    recent = Window.partitionBy("user_id", F.coalesce("run", F.lit(0))).orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), -1)
    n = F.coalesce(F.count_if(F.col("event") == "failed").over(recent), F.lit(0))
    return tries.withColumn("failures_before", n).withColumn("locked", F.col("failures_before") >= most).drop("us", "run")


def tail(log: DataFrame, n: int = 50, order: str = "seq") -> DataFrame:
    """The newest n entries: top-k on each partition first."""
    return log.orderBy(F.col(order).desc()).limit(n)


#: What each role may do.
ROLES = {
    "officer": ("decide", "label"),
    "supervisor": ("decide", "override", "truth", "export", "label"),
    "auditor": ("export",),
    "admin": ("truth", "admin", "export"),
}


def allowed(rows: DataFrame, right: str, role: str = "role") -> DataFrame:
    return rows.where(F.col(role).isin([r for r, own in ROLES.items() if right in own]))


def judged(proposals: DataFrame, log: DataFrame, most: int = 4) -> DataFrame:
    """What becomes of proposed decisions, with an HTTP-like status: 200 no-op, 201 accepted, 400, 403, 404 or 409.

    proposals: pair, decision, role, reason, known (whether the pair exists). A repeat changes nothing; a changed decision
    needs a supervisor and a reason, and a pair takes `most` revisions at most.
    """
    last = log.groupBy("pair").agg(F.max_by("decision", "seq").alias("now"), (F.count("*") - 1).alias("revisions"))
    p = proposals.join(last, "pair", "left")
    status = (
        F.when(~F.col("known"), 404).when(~F.col("role").isin("officer", "supervisor"), 403).when(F.col("now").isNull(), 201).when(F.col("now") == F.col("decision"), 200)
        .when(F.col("role") != "supervisor", 403).when(F.coalesce(F.trim("reason"), F.lit("")) == "", 400).when(F.col("revisions") >= most, 409).otherwise(201)
    )
    return p.withColumn("status", status).drop("now", "revisions")


def judged_in_turn(proposals: DataFrame, log: DataFrame, order: str, most: int = 4) -> DataFrame:
    """As judged, for proposals of one batch that see one another: an accepted one (201) is what the next on its pair is judged against.

    A pair's proposals are read in order, holding its last decision and its number of revisions.
    """
    last = log.groupBy("pair").agg(F.max_by("decision", "seq").alias("now_"), (F.count("*") - 1).alias("revisions_"))
    p = proposals.join(last, "pair", "left")
    names = [*proposals.columns, "status"]
    schema = T.StructType([*[proposals.schema[c] for c in proposals.columns], T.StructField("status", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, now, revisions = object(), None, 0
        for df in frames:
            out = []
            for r in df.itertuples(index=False):
                if r.pair != pair:
                    pair, now, revisions = r.pair, r.now_ if isinstance(r.now_, str) else None, int(r.revisions_) if r.revisions_ == r.revisions_ and r.revisions_ is not None else -1
                if not r.known:
                    status = 404
                elif r.role not in ("officer", "supervisor"):
                    status = 403
                elif now is None:
                    status = 201
                elif now == r.decision:
                    status = 200
                elif r.role != "supervisor":
                    status = 403
                elif not isinstance(r.reason, str) or not r.reason.strip():
                    status = 400
                else:
                    status = 409 if revisions >= most else 201
                if status == 201:
                    now, revisions = r.decision, revisions + 1
                out.append(status)
            yield df.assign(status=out)[names]

    ship(proposals.sparkSession)
    return p.repartition("pair").sortWithinPartitions("pair", order).mapInPandas(run, schema)


def visible(rows: DataFrame, user: str | int, role: str, n: int = 50, key: str = "user_id", order: str = "seq") -> DataFrame:
    """The newest n entries that a person may see: their own, or all for those who oversee others."""
    return tail(rows if role in ("supervisor", "admin") else rows.where(F.col(key) == user), n, order)


def search(rows: DataFrame, text: str, n: int = 300, order: str | None = None) -> DataFrame:
    """Rows that hold the text, in any letter case, in any column."""
    found = rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns])), F.lit(text.lower())))
    return (found.orderBy(order) if order else found).limit(n)


def labels_judged(proposals: DataFrame, sample: DataFrame, least_seconds: float = 3.0) -> DataFrame:
    """What becomes of proposed labels (pair_id, label, secs): 404 not sampled, 422 no such label, 429 too quick, else 201."""
    known = sample.select("pair_id").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known").isNull(), 404).when(~F.col("label").isin("same", "different", "unsure"), 422).when(F.coalesce("secs", F.lit(0.0)) < least_seconds, 429).otherwise(201)
    return proposals.join(known, "pair_id", "left").withColumn("status", status).drop("known")


def next_unlabelled(sample: DataFrame, labels: DataFrame, labeller: str, order: str) -> DataFrame:
    """The first pair in the sample's order that this person has not labelled; no score is shown."""
    own = labels.where(F.col("labeller") == labeller).select("pair_id")
    return sample.join(own, "pair_id", "left_anti").orderBy(order).limit(1)


def users_with(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users and the new ones among `new` whose lower-case name is not taken yet."""
    fresh = new.withColumn("username", F.lower(F.trim("username"))).dropDuplicates(["username"])
    return users.unionByName(fresh.join(users.select("username"), "username", "left_anti").select(*users.columns))


def users_changed(users: DataFrame, changes: DataFrame, by: str) -> DataFrame:
    """Users with their role or active flag as changed (username, role, active; null: as it was); nobody disables themselves."""
    c = changes.select("username", F.col("role").alias("role_"), F.col("active").alias("active_"))
    off = F.when(F.col("username") == by, F.col("active")).otherwise(F.coalesce("active_", "active"))
    return users.join(c, "username", "left").withColumns({"role": F.coalesce("role_", "role"), "active": off}).select(*users.columns)
