"""Mixing sources to target weights: Pfair scheduling of source blocks, earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import durable

#: Tokens of a block, whatever the size of the corpus.
BLOCK = 32_768


def pfair(blocks: dict[str, int]) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block) of all blocks, slot by slot. A source with n of N blocks has weight w = n / N; its block j is released at
    floor(j / w) and due at ceil((j + 1) / w). Each slot goes to the released block with the earliest deadline (ties: the heavier
    source, then the name), which keeps every source within one block of its weight at every slot. What is held is one entry a source."""
    total = sum(blocks.values())
    release = lambda s, j: j * total // blocks[s]
    due = lambda s, j: -(-(j + 1) * total // blocks[s])
    later = [(0, s, 0) for s, n in blocks.items() if n]
    heapq.heapify(later)
    ready: list[tuple[int, int, str, int]] = []
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, s, j = heapq.heappop(later)
            heapq.heappush(ready, (due(s, j), -blocks[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        yield slot, s, j
        if j + 1 < blocks[s]:
            heapq.heappush(later, (release(s, j + 1), s, j + 1))


def _scheduled(blocks: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = pfair(blocks) if batch.num_rows else iter(())
            while rows := list(islice(slots, 50_000)):
                slot, source, block = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(source, pa.string()), pa.array(block, pa.int64())], ["slot", "source", "block_no"])

    return run


def source_key(column: str):
    """Sources are compared trimmed and without case."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def plan_quotas(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> list[dict]:
    """Tokens that each target source gives.

    Sources with a target but no token can give nothing: the other targets are scaled to sum 1 (``reachable_share``). The total is
    the largest at which every source reaches its reachable share without using a document more than ``max_repeats`` times, so
    the source that is scarcest for its target is used to its cap and no other is needed more often than that."""
    live = [(s, w, m) for s, w, m in targets if sizes.get(s, 0) > 0 and w > 0 and m > 0]
    weight = sum(w for _, w, _ in live)
    total = min((sizes[s] * m / (w / weight) for s, w, m in live), default=0.0)
    out = []
    for s, w, m in targets:
        share = w / weight if any(s == x for x, _, _ in live) else 0.0
        quota = min(int(round(total * share)), sizes.get(s, 0) * m)
        out.append({"source": s, "target_share": w, "max_repeats": m, "available_tokens": sizes.get(s, 0), "reachable_share": share, "quota": quota})
    return out


class Mixture:
    """A mixture of ``docs`` (doc_id, source, n_tokens) after ``targets`` (source, target_share, max_repeats).

    Documents whose source is null or has no target, and those without a token, are not used. Repeated rows of one doc_id are
    separate documents. The target table is small by nature (one row a source) and is read by the driver; of the documents only one
    sum a source is. Blocks have ``block`` tokens whatever the size of the corpus; the schedule never comes to the driver."""

    def __init__(self, docs: DataFrame, targets: DataFrame, block: int = BLOCK):
        spark = docs.sparkSession
        docs = docs.select("doc_id", source_key("source").alias("source"), "n_tokens").filter("n_tokens > 0 and source is not null")
        wanted = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
        wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        rows = [(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in wanted.orderBy("source").collect()]
        docs = docs.filter(F.col("source").isin([s for s, _, _ in rows]))
        sizes = {r.source: (r.n, r.docs) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
        self.quotas = plan_quotas({s: n for s, (n, _) in sizes.items()}, rows)
        self.block = block
        for q in self.quotas:
            q["blocks"] = math.ceil(q["quota"] / self.block)
            q["passes"] = math.ceil(q["quota"] / q["available_tokens"]) if q["available_tokens"] else 0
        kind = "source string, target_share double, max_repeats int, available_tokens long, reachable_share double, quota long, blocks int, passes int"
        names = [x.split()[0] for x in kind.split(", ")]
        self.plan = spark.createDataFrame([tuple(q[n] for n in names) for q in self.quotas], kind)
        # the next slot depends on all before it, so one task streams the schedule out; it holds one entry a source
        self.schedule = spark.range(0, 1, 1, 1).mapInArrow(_scheduled({q["source"]: q["blocks"] for q in self.quotas}), "slot long, source string, block_no long")
        most = max((n for _, n in sizes.values()), default=0)
        self.uses = self._placed(docs, max(1, math.ceil(most / 20_000)))

    def _placed(self, docs: DataFrame, ranges: int) -> DataFrame:
        """Every use of a document with its block. Uses of a source stand in the order (pass, hash of document and pass); where a use
        begins, in tokens, is the sum of the ranges of hashes before its own (``ranges`` sums a pass) plus that within its range, so
        no task orders a whole source."""
        quota = F.broadcast(self.plan.select("source", "quota", "passes"))  # one row a source of the target table
        use = docs.join(quota, "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.greatest("passes", F.lit(1))))).filter("quota > 0")
        h = F.xxhash64("doc_id", "use_no")
        use = use.withColumn("h", h).withColumn("part", F.pmod(F.shiftrightunsigned("h", 20), F.lit(ranges)).cast("int"))
        sums = use.groupBy("source", "use_no", "part").agg(F.sum("n_tokens").alias("held"))
        before = F.sum("held").over(Window.partitionBy("source").orderBy("use_no", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
        begun = sums.withColumn("before", before).drop("held")
        inside = Window.partitionBy("source", "use_no", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        use = use.withColumn("upto", F.sum("n_tokens").over(inside)).join(begun, ["source", "use_no", "part"])
        start = F.col("before") + F.col("upto") - F.col("n_tokens")
        placed = use.withColumn("start", start).filter("start < quota")
        return placed.select("source", "doc_id", "use_no", "n_tokens", "start", F.floor(F.col("start") / self.block).alias("block_no"))

    def sequence(self) -> DataFrame:
        """(slot, source, block_no, doc_id, use_no, n_tokens, start): the mixture in order of ``slot`` and, in a slot, of ``start``."""
        return self.uses.join(self.schedule, ["source", "block_no"]).select("slot", "source", "block_no", "doc_id", "use_no", "n_tokens", "start")

    def shares(self) -> DataFrame:
        """The shares reached, one row a target source, those that give nothing included."""
        used = self.uses.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("uses"), F.max("use_no").alias("most_uses"))
        total = used.agg(F.sum("tokens_used").alias("t")).scalar()
        out = self.plan.join(used, "source", "left").na.fill(0, ["tokens_used", "uses", "most_uses"])
        actual = F.when(F.col("tokens_used") > 0, F.col("tokens_used") / total).otherwise(F.lit(0.0))
        return out.select("source", "target_share", "reachable_share", actual.alias("actual_share"), "max_repeats", "most_uses", "uses", "available_tokens", "tokens_used")


def mixture(documents: DataFrame, targets: DataFrame, path: str | None = None) -> Mixture:
    """The mixture of a documents table, sizes in tokens of the tokenizer at ``path``."""
    from .bpe import encode_corpus

    keyed = documents.select(F.struct("doc_id", "source").alias("row"), "text")
    sizes = keyed_counts(keyed, path, encode_corpus)
    return Mixture(durable(sizes), targets)


def keyed_counts(keyed: DataFrame, path: str | None, encode) -> DataFrame:
    return encode(keyed, "row", "text", path, counts_only=True).select("row.doc_id", "row.source", "n_tokens")
