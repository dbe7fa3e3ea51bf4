"""Audit ledger: entry hashes, sealed Merkle blocks, inclusion proofs and verification."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark import fixed_values as fixed
from govspark.functions import canonical_json
from govspark.functions.time import iso_utc
from govspark.operators.joins import null_safe_join
from govspark.operators.ordered import running
from govspark.session import materialize

HASHED_FIELDS = [
    "id", "timestamp", "actor", "resource_urn", "action", "decision", "evaluation_trace", "request_context",
]
_KEY = ["project_id", "sequence_index"]


def entry_json(entries: DataFrame) -> Column:
    """Canonical text of an entry: keys sorted at every level, nulls kept, the hash itself left out.

    ``request_context`` is canonical JSON text already and is spliced in as an object.
    """
    fields = {f.name: f for f in entries.schema.fields if f.name in HASHED_FIELDS}
    parts = []
    for name in sorted(fields):
        dtype = fields[name].dataType
        if name == "request_context":
            text = F.coalesce(F.col(name), F.lit("{}"))
        elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            text = F.coalesce(canonical_json(F.col(name), dtype), F.lit("null"))
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            text = F.coalesce(F.concat(F.lit('"'), iso_utc(F.col(name)), F.lit('"')), F.lit("null"))
        elif isinstance(dtype, T.StringType):
            quoted = F.to_json(F.array(F.col(name)))
            text = F.when(F.col(name).isNull(), F.lit("null")).otherwise(quoted.substr(F.lit(2), F.length(quoted) - 2))
        else:
            text = F.coalesce(F.col(name).cast("string"), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{name}":'), text))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def entry_hash(entries: DataFrame) -> DataFrame:
    """Add ``entry_hash``, the SHA-256 of the canonical entry."""
    return entries.withColumn("entry_hash", F.sha2(entry_json(entries), 256))


def _pair_hash(left: Column, right: Column) -> Column:
    """Hash of two hex digests in byte order; hex text of one case sorts like its bytes."""
    return F.sha2(F.unhex(F.concat(F.least(left, right), F.greatest(left, right))), 256)


def _parents(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1)
    left = lambda i: F.get(level, i * 2)
    return F.transform(pairs, lambda i: _pair_hash(left(i), F.coalesce(F.get(level, i * 2 + 1), left(i))))


def _steps(leaf_count: Column) -> Column:
    """1..depth of the tree; empty for a single leaf."""
    depth = F.ceil(F.log2(leaf_count.cast("double"))).cast("int")
    return F.when(leaf_count > 1, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))


def merkle_levels(leaves: Column) -> Column:
    """All levels of the tree over the sorted leaves, leaves first, root level last."""
    ordered = F.array_sort(leaves)
    return F.aggregate(
        _steps(F.size(leaves)),
        F.array(ordered),
        lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))),
    )


def merkle_root(leaves: Column) -> Column:
    """Root of the tree over sorted leaves; an odd node pairs with itself; one leaf is the root."""
    root = F.aggregate(_steps(F.size(leaves)), F.array_sort(leaves), lambda level, _: _parents(level))
    return F.when(F.size(leaves) > 0, F.get(root, F.lit(0)))


def _is_leaf() -> Column:
    return F.coalesce(F.length("entry_hash") == 64, F.lit(False))


def leaf_sum() -> Column:
    """Aggregate: the first 15 digits of all leaf hashes added up, whatever their order.

    It can be added in parts, so a block whose entries were exchanged is known without gathering them.
    """
    digits = F.conv(F.substring("entry_hash", 1, 15), 16, 10).cast("decimal(28,0)")
    return F.coalesce(F.sum(F.when(_is_leaf(), digits)), F.lit(0)).cast("string")


def _link_previous(blocks: DataFrame, extra: list[str]) -> DataFrame:
    """Add the root of block (index - 1) of the same project as ``prev_root``.

    Each block is sent to its own index and to the next one and both meet in one aggregate, so a long
    chain is never sorted in one task.
    """
    key = _KEY
    here = F.struct(F.lit(0).alias("shift"), F.struct(*extra, "merkle_root").alias("own"), F.lit(None).cast("string").alias("prev"))
    ahead = F.struct(F.lit(1).alias("shift"), F.lit(None).alias("own"), F.col("merkle_root").alias("prev"))
    sent = blocks.select(*key, F.explode(F.array(here, ahead)).alias("m")).select(
        "project_id",
        (F.col("sequence_index") + F.col("m.shift")).alias("sequence_index"),
        F.col("m.own").alias("own"),
        F.col("m.prev").alias("prev"),
    )
    return (
        sent.groupBy(*key)
        .agg(F.max_by("own", F.col("own").isNotNull()).alias("own"), F.max("prev").alias("prev_root"))
        .filter(F.col("own").isNotNull())
        .select(*key, "own.*", "prev_root")
    )


def seal(
    unsealed: DataFrame,
    last_blocks: DataFrame,
    as_of: datetime,
    min_entries: int = fixed.SEAL_MIN_ENTRIES,
    max_age_s: int = fixed.SEAL_MAX_AGE_S,
    capacity: int = fixed.BLOCK_CAPACITY,
) -> tuple[DataFrame, DataFrame]:
    """Seal unsealed entries (project_id, id, timestamp, entry_hash) into blocks of ``capacity``.

    Returns (blocks, links of log id and hash to block index); proofs are built from the links. A block is sealed when it has ``min_entries`` or
    its oldest entry is ``max_age_s`` old. ``last_blocks`` holds the newest (project_id,
    sequence_index, merkle_root); the chain goes on from there. Entries without a 64-character hash
    count in ``log_count`` but not in the tree. A block without any hash is left open and takes no number:
    the blocks after it are sealed and the chain has no gap.
    """
    lean = unsealed.select("project_id", "timestamp", "id", "entry_hash")
    # Splitting by range reads its input twice, for the bounds and for the rows; entries are hashed once.
    lean = lean if unsealed.is_cached else materialize(lean)
    numbered = running(lean, ["project_id"], ["timestamp", "id"], number="_n")
    numbered = numbered.withColumn("_block", F.floor(F.col("_n") / capacity))
    # A block never holds more than `capacity` entries, so its leaves fit in one group.
    grouped = numbered.groupBy("project_id", "_block").agg(
        F.collect_list(F.when(_is_leaf(), F.col("entry_hash"))).alias("leaves"),
        F.count("*").alias("log_count"),
        F.count_if(_is_leaf()).alias("leaf_count"),
        leaf_sum().alias("leaf_sum"),
        F.min("timestamp").alias("timestamp_start"),
        F.max("timestamp").alias("timestamp_end"),
    )
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("timestamp_start").cast("timestamp"))
    due = (F.col("log_count") >= min_entries) | (age >= max_age_s * 1_000_000)
    newest = last_blocks.groupBy("project_id").agg(
        F.max("sequence_index").alias("last_index"), F.max_by("merkle_root", "sequence_index").alias("last_root")
    )
    # One row per block, that is per `capacity` entries.
    in_order = Window.partitionBy("project_id").orderBy("_block")
    sealed = (
        null_safe_join(grouped.filter(due & (F.col("leaf_count") > 0)), newest, ["project_id"], "left")
        .select(
            "project_id",
            (F.coalesce(F.col("last_index") + 1, F.lit(0)) + F.row_number().over(in_order) - 1).alias("sequence_index"),
            "_block",
            F.coalesce("last_root", F.lit(fixed.GENESIS_HASH)).alias("chain_start"),
            merkle_root(F.col("leaves")).alias("merkle_root"),
            "timestamp_start",
            "timestamp_end",
            "log_count",
            "leaf_count",
            "leaf_sum",
        )
    )
    chained = _link_previous(
        sealed, ["_block", "chain_start", "timestamp_start", "timestamp_end", "log_count", "leaf_count", "leaf_sum"]
    )
    prev = F.coalesce("prev_root", "chain_start")
    blocks = chained.select(
        "project_id",
        "sequence_index",
        prev.alias("prev_block_hash"),
        "merkle_root",
        "timestamp_start",
        "timestamp_end",
        "log_count",
        "leaf_count",
        "leaf_sum",
        F.concat_ws("|", F.col("sequence_index").cast("string"), prev, "merkle_root", F.col("log_count").cast("string")).alias(
            "sign_payload"
        ),
    )
    links = null_safe_join(numbered, sealed.select("project_id", "_block", "sequence_index"), ["project_id", "_block"]).select(
        "project_id", F.col("id").alias("log_id"), "sequence_index", "entry_hash"
    )
    return blocks, links


def merkle_proof(sealed_log: DataFrame) -> DataFrame:
    """(project_id, sequence_index, entry_hash, siblings) for every distinct hash of every block.

    ``sealed_log`` is (project_id, sequence_index, entry_hash). The levels of a block are built once.
    Equal hashes share the position of the last one.
    """
    blocks = (
        sealed_log.filter(F.length("entry_hash") == 64)
        .groupBy("project_id", "sequence_index")
        .agg(F.collect_list("entry_hash").alias("leaves"))
        .select("project_id", "sequence_index", merkle_levels(F.col("leaves")).alias("levels"))
    )
    # Proofs are built inside the row of the block, so the levels are not copied per leaf.
    return blocks.select(
        "project_id",
        "sequence_index",
        F.expr(
            """inline(array_compact(transform(sequence(0, size(levels[0]) - 1), pos ->
                 CASE WHEN NOT (get(levels[0], pos + 1) <=> levels[0][pos]) THEN named_struct(
                   'entry_hash', levels[0][pos],
                   'siblings', transform(slice(levels, 1, size(levels) - 1), (level, height) ->
                     coalesce(get(level, shiftright(pos, height) ^ 1), get(level, shiftright(pos, height)))))
                 END)))"""
        ),
    )


def verify_proofs(proofs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fold the siblings of each proof and compare with the root of its block."""
    roots = blocks.select("project_id", "sequence_index", "merkle_root")
    folded = F.aggregate("siblings", F.col("entry_hash"), _pair_hash)
    return null_safe_join(proofs, roots, ["project_id", "sequence_index"]).select(
        "project_id", "sequence_index", "entry_hash", (folded == F.col("merkle_root")).alias("valid")
    )


def verify_ledger(log: DataFrame, blocks: DataFrame, capacity: int = fixed.BLOCK_CAPACITY) -> DataFrame:
    """Per block: are contents, counts, root and link to the previous block intact?

    ``log`` has the entry columns plus project_id, entry_hash and sequence_index of its block; an entry
    without one is in no block yet and left out. Entries are first counted and added up per block. Only a
    block of at most ``capacity`` entries whose count, and ``leaf_sum`` where its header has one, agree is
    gathered and its root built again; of any other the root counts as wrong. So entries pushed into one
    block in any number never meet in one row. A block that has entries but no header is reported too:
    nothing but its contents can be in order.
    """
    entries = materialize(
        log.filter(F.col("sequence_index").isNotNull()).select(
            *_KEY, "entry_hash", F.sha2(entry_json(log), 256).eqNullSafe(F.col("entry_hash")).alias("_same")
        )
    )
    found = entries.groupBy(*_KEY).agg(
        F.count("*").alias("found_count"), F.count_if(~F.col("_same")).alias("altered"), leaf_sum().alias("found_sum")
    )
    has_sum = "leaf_sum" in blocks.columns
    linked = _link_previous(blocks, ["prev_block_hash", "log_count", *(["leaf_sum"] if has_sum else [])])
    first = blocks.groupBy("project_id").agg(F.min("sequence_index").alias("first_index"))
    met = null_safe_join(linked, found, _KEY, "left")
    count_ok = F.coalesce(F.col("found_count") == F.col("log_count"), F.lit(False))
    same_sum = F.coalesce(F.col("found_sum") == F.col("leaf_sum"), F.col("leaf_sum").isNull()) if has_sum else F.lit(True)
    whole = met.filter(count_ok & same_sum & (F.col("found_count") <= capacity)).select(*_KEY)
    rebuilt = (
        null_safe_join(entries, whole, _KEY, "left_semi")
        .groupBy(*_KEY)
        .agg(merkle_root(F.collect_list(F.when(_is_leaf(), F.col("entry_hash")))).alias("found_root"))
    )
    status = null_safe_join(null_safe_join(met, rebuilt, _KEY, "left"), first, ["project_id"])
    chain_ok = F.when(
        F.col("sequence_index") == 0, F.col("prev_block_hash") == fixed.GENESIS_HASH
    ).otherwise(F.col("prev_block_hash").eqNullSafe(F.col("prev_root")))
    gap = (F.col("sequence_index") > F.col("first_index")) & F.col("prev_root").isNull()
    content_ok = F.coalesce("altered", F.lit(0)) == 0
    flags = status.select(
        *_KEY,
        content_ok.alias("content_ok"),
        count_ok.alias("count_ok"),
        F.coalesce(F.col("found_root") == F.col("merkle_root"), F.lit(False)).alias("root_ok"),
        F.coalesce(chain_ok, F.lit(False)).alias("chain_ok"),
        (~gap & ~((F.col("sequence_index") == F.col("first_index")) & (F.col("first_index") > 0))).alias("index_ok"),
    )
    never = [F.lit(False).alias(name) for name in ("count_ok", "root_ok", "chain_ok", "index_ok")]
    headless = null_safe_join(found, blocks.select(*_KEY), _KEY, "left_anti").select(
        *_KEY, content_ok.alias("content_ok"), *never
    )
    intact = F.col("content_ok") & F.col("count_ok") & F.col("root_ok") & F.col("chain_ok") & F.col("index_ok")
    return flags.unionByName(headless).withColumn("status", F.when(intact, F.lit("VERIFIED")).otherwise(F.lit("TAMPERED")))


def dirty_projects(log: DataFrame) -> DataFrame:
    """Projects that still have unsealed entries."""
    return log.filter(F.col("block_id").isNull()).select("project_id").distinct()
