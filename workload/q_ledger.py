"""Audit ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.fixed_values import GENESIS_HASH
from govspark.operators.ledger import (
    dirty_projects,
    entry_hash,
    merkle_proof,
    merkle_root,
    seal,
    verify_ledger,
    verify_proofs,
)
from govspark.sources.audit import canonicalize_audit
from workload.registry import query
from workload.tables import Tables, as_of

_STAMP = "strftime(timestamp_, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(timestamp_) % 1000000 = 0 THEN '' ELSE strftime(timestamp_, '.%f') END || '+00:00'"
ENTRIES = f"""
entries AS (
  SELECT id, project_id, timestamp_, event_id, sha256('{{"action":"' || action || '","actor":{{"attributes":{{}},"id":"' || actor_id || '","roles":[],"type":0}},"decision":'
    || CASE decision WHEN 'ALLOW' THEN 1 WHEN 'DENY' THEN 2 ELSE 0 END || ',"evaluation_trace":' || CASE WHEN event_id % 5 = 4 THEN 'null' ELSE
      '{{"cache_hit":' || CASE WHEN cache_hit THEN 'true' ELSE 'false' END || ',"contributing_obligation_ids":[' || coalesce('"' || obligation_id || '"', '')
      || '],"policy_version_hash":"h1","reason_summary":' || coalesce('"' || reason || '"', 'null') || '}}' END
    || ',"id":"' || id || '","request_context":' || replace(request_context, ' ', '') || ',"resource_urn":"' || resource_urn || '","timestamp":"' || {_STAMP} || '"}}') AS entry_hash
  FROM v_audit_log)""".replace("{{", "{").replace("}}", "}")
# Blocks of 700 entries; the last of a project needs 100 entries or five minutes, and events are days old.
CAPACITY = 700
BLOCKS = f"""
numbered AS (SELECT *, (row_number() OVER (PARTITION BY project_id ORDER BY timestamp_, id) - 1) // {CAPACITY} AS block FROM entries),
level0 AS (SELECT project_id, block, row_number() OVER (PARTITION BY project_id, block ORDER BY entry_hash) - 1 AS i, entry_hash AS h, count(*) OVER (PARTITION BY project_id, block) AS n FROM numbered),
tree AS (
  SELECT project_id, block, 0 AS height, i, h, n FROM level0
  UNION ALL
  SELECT project_id, block, height + 1, i // 2, sha256(unhex(least(h, sibling) || greatest(h, sibling))), (n + 1) // 2
  FROM (SELECT *, coalesce(lead(h) OVER (PARTITION BY project_id, block, height ORDER BY i), h) AS sibling FROM tree WHERE n > 1) WHERE i % 2 = 0),
roots AS (SELECT project_id, block, h AS root FROM tree WHERE n = 1),
blocks AS (SELECT project_id, block AS sequence_index, coalesce(lag(root) OVER (PARTITION BY project_id ORDER BY block), '{GENESIS_HASH}') AS prev_block_hash, root AS merkle_root,
  min_ts AS timestamp_start, max_ts AS timestamp_end, n AS log_count, leaf_sum FROM roots JOIN
  (SELECT project_id, block, min(timestamp_) AS min_ts, max(timestamp_) AS max_ts, count(*) AS n, CAST(sum(CAST('0x' || substr(entry_hash, 1, 15) AS BIGINT)) AS VARCHAR) AS leaf_sum FROM numbered GROUP BY ALL) USING (project_id, block))"""


def hashed(t: Tables) -> DataFrame:
    return entry_hash(canonicalize_audit(t.audit_log()))


def sealed(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = hashed(t)
    none = log.sparkSession.createDataFrame([], "project_id string, sequence_index bigint, merkle_root string")
    blocks, links = seal(log, none, as_of(), capacity=CAPACITY)
    return log, blocks, links


@query("h1_entry_hash", f"WITH {ENTRIES} SELECT id, project_id, entry_hash FROM entries")
def h1_entry_hash(t: Tables) -> DataFrame:
    return hashed(t).select("id", "project_id", "entry_hash")


@query("h2_seal_blocks", f"""WITH {ENTRIES}, {BLOCKS} SELECT project_id, sequence_index, prev_block_hash, merkle_root, timestamp_start, timestamp_end, log_count, log_count AS leaf_count, leaf_sum,
  sequence_index || '|' || prev_block_hash || '|' || merkle_root || '|' || log_count AS sign_payload FROM blocks""")
def h2_seal_blocks(t: Tables) -> DataFrame:
    return sealed(t)[1]


@query("h2_seal_links", f"WITH {ENTRIES}, {BLOCKS} SELECT project_id, id AS log_id, block AS sequence_index FROM numbered")
def h2_seal_links(t: Tables) -> DataFrame:
    return sealed(t)[2].drop("entry_hash")


@query("h3_merkle_root", f"""WITH {ENTRIES}, numbered AS (SELECT 'all' AS project_id, event_id // 33 AS block, entry_hash FROM entries), {BLOCKS.split('block FROM entries),', 1)[1].split('blocks AS', 1)[0].rstrip().rstrip(',')}
SELECT block AS batch, root AS merkle_root FROM roots""")
def h3_merkle_root(t: Tables) -> DataFrame:
    batch = F.floor(F.col("id").cast("bigint") / 33).alias("batch")
    return hashed(t).groupBy(batch).agg(merkle_root(F.collect_list("entry_hash")).alias("merkle_root"))


@query("h4_proofs", f"""WITH {ENTRIES}, {BLOCKS}, path AS (
  SELECT project_id, block, h AS entry_hash, 0 AS height, i, n FROM tree WHERE height = 0
  UNION ALL SELECT project_id, block, entry_hash, height + 1, i // 2, (n + 1) // 2 FROM path WHERE n > 1)
SELECT p.project_id, p.block AS sequence_index, p.entry_hash, coalesce(string_agg(s.h, ',' ORDER BY p.height), '') AS siblings
FROM path p JOIN tree s ON s.project_id = p.project_id AND s.block = p.block AND s.height = p.height
  AND s.i = CASE WHEN xor(p.i, 1) < p.n THEN xor(p.i, 1) ELSE p.i END WHERE p.n > 1 GROUP BY ALL""")
def h4_proofs(t: Tables) -> DataFrame:
    return merkle_proof(sealed(t)[2]).withColumn("siblings", F.array_join("siblings", ","))


@query("h5_verify_proofs", f"""WITH {ENTRIES}, {BLOCKS} SELECT project_id, block AS sequence_index, substr(entry_hash, 1, 1) NOT IN ('0', '1', '2', '3') AS valid, count(*) AS proofs
FROM numbered GROUP BY ALL""")
def h5_verify_proofs(t: Tables) -> DataFrame:
    """Of about a quarter of the proofs the entry is another one than the one proved."""
    _, blocks, links = sealed(t)
    forged = F.substring("entry_hash", 1, 1).isin("0", "1", "2", "3")
    proofs = merkle_proof(links).withColumn("entry_hash", F.when(forged, F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash")))
    return verify_proofs(proofs, blocks).groupBy("project_id", "sequence_index", "valid").agg(F.count("*").alias("proofs"))


# What is done to a block after sealing: 0 contents altered, 1 link replaced, 2 count replaced, 3 every entry twice,
# 4 root replaced, 5 header lost, 6 entries lost, 7 and 8 nothing.
_DONE = "({index} * 3 + ascii(right(project_id, 1))) % 9"
_HARM = _DONE.format(index="sequence_index")


@query("h6_verify_ledger", f"""WITH {ENTRIES}, {BLOCKS}, harmed AS (SELECT project_id, sequence_index, {_HARM} AS x,
  CASE WHEN sequence_index > 0 THEN {_DONE.format(index='(sequence_index - 1)')} ELSE -1 END AS px FROM blocks),
flags AS (SELECT project_id, sequence_index, x <> 0 AS content_ok, x NOT IN (2, 3, 5, 6) AS count_ok, x NOT IN (2, 3, 4, 5, 6) AS root_ok,
  x NOT IN (1, 5) AND px NOT IN (4, 5) AS chain_ok, x <> 5 AND px <> 5 AS index_ok FROM harmed)
SELECT *, CASE WHEN content_ok AND count_ok AND root_ok AND chain_ok AND index_ok THEN 'VERIFIED' ELSE 'TAMPERED' END AS status FROM flags""")
def h6_verify_ledger(t: Tables) -> DataFrame:
    log, blocks, links = sealed(t)
    harm = F.expr(_HARM)
    copies = F.when(harm == 3, F.lit(2)).when(harm == 6, F.lit(0)).otherwise(F.lit(1))
    found = (
        log.drop("entry_hash")
        .join(links.withColumnRenamed("log_id", "id"), ["project_id", "id"])
        .withColumn("action", F.when(harm == 0, F.concat("action", F.lit("!"))).otherwise(F.col("action")))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    )
    headers = (
        blocks.filter(harm != 5)
        .withColumn("prev_block_hash", F.when(harm == 1, F.lit("f" * 64)).otherwise(F.col("prev_block_hash")))
        .withColumn("log_count", F.when(harm == 2, F.col("log_count") + 1).otherwise(F.col("log_count")))
        .withColumn("merkle_root", F.when(harm == 4, F.lit("e" * 64)).otherwise(F.col("merkle_root")))
    )
    return verify_ledger(found, headers, CAPACITY)


@query("h7_unsealed_projects", "SELECT DISTINCT project_id FROM v_audit_log WHERE event_id % 2 = 0")
def h7_unsealed_projects(t: Tables) -> DataFrame:
    even = F.col("id").cast("bigint") % 2 == 0
    return dirty_projects(t.audit_log().withColumn("block_id", F.when(~even, F.lit("b"))))
