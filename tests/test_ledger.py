import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from govspark.operators.ledger import entry_hash, merkle_proof, merkle_root, seal, verify_ledger, verify_proofs

NOW = datetime(2024, 2, 1)


def digest(n):
    return hashlib.sha256(str(n).encode()).hexdigest()


def plain_root(leaves):
    level = sorted(leaves)
    while len(level) > 1:
        pairs = [(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        level = [hashlib.sha256(bytes.fromhex(min(p)) + bytes.fromhex(max(p))).hexdigest() for p in pairs]
    return level[0]


def test_roots_and_proofs(spark):
    sizes = [1, 2, 3, 5, 8, 33, 5000]
    rows = [("p", size, digest((size, i))) for size in sizes for i in range(size)] + [("p", 4, digest(0))] * 2 + [("p", 4, digest(1))] * 2
    log = spark.createDataFrame(rows, "project_id string, sequence_index bigint, entry_hash string")
    blocks = log.groupBy("project_id", "sequence_index").agg(merkle_root(F.collect_list("entry_hash")).alias("merkle_root"))
    roots = {r.sequence_index: r.merkle_root for r in blocks.collect()}
    for size in sizes:
        assert roots[size] == plain_root([digest((size, i)) for i in range(size)])
    proofs = merkle_proof(log)
    counts = {r.sequence_index: r["count"] for r in proofs.groupBy("sequence_index").count().collect()}
    assert counts == {**{s: s for s in sizes}, 4: 2}
    assert verify_proofs(proofs, blocks).filter("NOT valid").count() == 0
    forged = proofs.withColumn("entry_hash", F.sha2("entry_hash", 256))
    assert verify_proofs(forged, blocks).filter("valid").count() == 0


def test_seal_chain(spark):
    """Blocks form a chain; a young short rest stays open."""
    rows = [("hot", f"h{i:04d}", NOW - timedelta(seconds=1000 - i // 3), digest(i)) for i in range(950)]
    rows += [("new", f"n{i}", NOW - timedelta(seconds=5), digest(i)) for i in range(20)]
    rows += [("old", f"x{i}", NOW - timedelta(seconds=400), digest(i)) for i in range(3)]
    log = spark.createDataFrame(rows, "project_id string, id string, timestamp timestamp, entry_hash string")
    heads = spark.createDataFrame([("old", 4, "e" * 64)], "project_id string, sequence_index bigint, merkle_root string")
    blocks, links = seal(log, heads, NOW, capacity=300)
    got = {(b.project_id, b.sequence_index): b for b in blocks.collect()}
    # The last 50 entries of the hot project are older than five minutes and go into a block of their own.
    assert sorted(got) == [("hot", 0), ("hot", 1), ("hot", 2), ("hot", 3), ("old", 5)]
    assert got["old", 5].prev_block_hash == "e" * 64 and got["hot", 0].prev_block_hash == "0" * 64
    for i in (1, 2, 3):
        assert got["hot", i].prev_block_hash == got["hot", i - 1].merkle_root
    ordered = sorted(r for r in rows if r[0] == "hot")
    assert got["hot", 1].merkle_root == plain_root([r[3] for r in sorted(ordered, key=lambda r: (r[2], r[1]))[300:600]])
    assert links.count() == 953 and links.select("log_id").distinct().count() == 953


def test_entries_without_a_project_are_sealed(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [(None if i % 2 else "p", f"{i:02d}", datetime(2024, 1, 1) + timedelta(seconds=i), digest(i)) for i in range(10)]
    log = spark.createDataFrame(rows, "project_id string, id string, timestamp timestamp, entry_hash string")
    heads = spark.createDataFrame([(None, 6, "ab" * 32)], "project_id string, sequence_index bigint, merkle_root string")
    blocks, links = seal(log, heads, datetime(2024, 2, 1), capacity=5)
    assert sorted((b.project_id or "", b.sequence_index, b.prev_block_hash, b.log_count) for b in blocks.collect()) == [
        ("", 7, "ab" * 32, 5), ("p", 0, "0" * 64, 5),
    ]
    assert sorted((r.project_id or "", r.log_id) for r in links.collect()) == sorted((r[0] or "", r[1]) for r in rows)


def ledger_of(spark, count=60, capacity=10):
    rows = [("p" if i % 2 else None, f"{i:03d}", NOW - timedelta(days=1, seconds=-i), f"a{i}") for i in range(count)]
    log = entry_hash(spark.createDataFrame(rows, "project_id string, id string, timestamp timestamp, action string"))
    heads = spark.createDataFrame([], "project_id string, sequence_index bigint, merkle_root string")
    blocks, links = seal(log, heads, NOW, min_entries=1, capacity=capacity)
    placed = links.select(F.col("project_id").alias("_p"), F.col("log_id").alias("id"), "sequence_index")
    return log.join(placed, "id").drop("_p"), blocks


def verdicts(log, blocks, capacity=10):
    return {(r.project_id, r.sequence_index): r for r in verify_ledger(log, blocks, capacity).collect()}


def test_sound_ledger_is_verified(spark):
    log, blocks = ledger_of(spark)
    assert {r.status for r in verdicts(log, blocks).values()} == {"VERIFIED"}
    # Headers of another origin may come without the sum.
    got = verdicts(log.unionByName(log.limit(5).withColumn("sequence_index", F.lit(None).cast("bigint"))), blocks.drop("leaf_sum"))
    assert len(got) == 6 and {r.status for r in got.values()} == {"VERIFIED"}


def test_harmed_blocks_are_named(spark):
    log, blocks = ledger_of(spark)
    place = lambda p, i: F.col("project_id").eqNullSafe(p) & (F.col("sequence_index") == i)
    # Another entry with a right hash of its own in place of one that was sealed.
    other = entry_hash(log.drop("entry_hash").withColumn("action", F.lit("x")).select("id", "project_id", "timestamp", "action", "sequence_index"))
    first = place("p", 0) & (F.col("id") == "001")
    log = log.filter(~first).unionByName(other.filter(first).select(*log.columns))
    # A stuffed block, one that outgrows the capacity with a matching count, and one without a header.
    stuffed = log.filter(place(None, 1)).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("_n")
    doubled = log.filter(place("p", 2))
    got = verdicts(
        log.unionByName(stuffed).unionByName(doubled),
        blocks.filter(~place(None, 2)).withColumn("log_count", F.when(place("p", 2), F.lit(20)).otherwise(F.col("log_count"))),
    )
    flags = {k: (r.content_ok, r.count_ok, r.root_ok, r.chain_ok, r.index_ok, r.status) for k, r in got.items()}
    assert flags == {
        ("p", 0): (True, True, False, True, True, "TAMPERED"),
        ("p", 1): (True, True, True, True, True, "VERIFIED"),
        ("p", 2): (True, True, False, True, True, "TAMPERED"),
        (None, 0): (True, True, True, True, True, "VERIFIED"),
        (None, 1): (True, False, False, True, True, "TAMPERED"),
        (None, 2): (True, False, False, False, False, "TAMPERED"),
    }


def test_exchanged_hashes_show_in_the_sum(spark):
    """Hashes are replaced but counted right; with and without the sum the root is found to be wrong."""
    log, blocks = ledger_of(spark, 20)
    swapped = log.withColumn("entry_hash", F.sha2("entry_hash", 256))
    for headers in (blocks, blocks.drop("leaf_sum")):
        got = verdicts(swapped, headers)
        assert [(r.content_ok, r.count_ok, r.root_ok) for r in got.values()] == [(False, True, False)] * 2
    assert verdicts(log.limit(0), blocks.limit(0)) == {}
