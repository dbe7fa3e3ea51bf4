"""Contract documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.operators import contracts as D
from workload.registry import query
from workload.tables import Tables

TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
MAX_TOKENS = 200

CLEAN = r"""
clean AS (
  SELECT doc_id, pos, kind, page, trim(regexp_replace(trim(regexp_replace(regexp_replace(translate(text, '‘’‚‛“”„‟', repeat(chr(39), 4) || repeat(chr(34), 4)), '[-–]', ' ', 'g'),
    '[\s\x{00a0}]+', ' ', 'g')), '^[•‣⁃∙●○◦▪·*]+\s*', '')) AS text
  FROM v_elements WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' AND kind NOT IN ('Header', 'Footer'))"""
CHUNKS = f"""{CLEAN},
rows_ AS (SELECT *, CAST(sum(CASE WHEN kind IN ('Title', 'Table') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cut,
    coalesce(last_value(CASE WHEN kind = 'Title' THEN text END IGNORE NULLS) OVER w, 'Preamble') AS section, {TOKENS.format('text')} AS tokens
  FROM clean WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
texts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cut ORDER BY pos) AS rn FROM rows_ WHERE kind NOT IN ('Title', 'Table') AND tokens > 0),
pack AS (
  SELECT doc_id, cut, rn, tokens AS opened, 0 AS chunk FROM texts WHERE rn = 1
  UNION ALL
  SELECT t.doc_id, t.cut, t.rn, CASE WHEN p.opened + t.tokens > {MAX_TOKENS} THEN t.tokens ELSE p.opened + t.tokens END,
    CASE WHEN p.opened + t.tokens > {MAX_TOKENS} THEN p.chunk + 1 ELSE p.chunk END
  FROM pack p JOIN texts t ON t.doc_id = p.doc_id AND t.cut = p.cut AND t.rn = p.rn + 1),
chunks AS (
  SELECT doc_id, min(pos) AS start_pos, any_value(section) AS section, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS content, arg_min(page, pos) AS page, 'NarrativeText' AS element_type
  FROM texts JOIN pack USING (doc_id, cut, rn) GROUP BY doc_id, cut, chunk
  UNION ALL SELECT doc_id, pos, section, text, page, 'Table' FROM rows_ WHERE kind = 'Table')"""


def chunks(t: Tables) -> DataFrame:
    return D.chunk_elements(D.clean_elements(t.elements()), MAX_TOKENS)


@query("d1_clean_elements", f"WITH {CLEAN} SELECT doc_id, pos, kind, text, page FROM clean")
def d1_clean_elements(t: Tables) -> DataFrame:
    return D.clean_elements(t.elements())


@query("d2_chunks", f"WITH {CHUNKS} SELECT doc_id, start_pos, section, content, page, element_type, {TOKENS.format('content')} AS token_count, doc_id || '-' || start_pos AS chunk_id FROM chunks")
def d2_chunks(t: Tables) -> DataFrame:
    return chunks(t)


# --- vectors -----------------------------------------------------------------


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.base("embeddings").withColumn("jurisdiction", F.concat(F.lit("J"), F.col("label") % 3))
    asked = rows.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "jurisdiction")
    known = rows.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"), "jurisdiction")
    return asked, known


_SCORES = """scores AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, q.label % 3 = c.label % 3 AS alike,
  list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0)"""


def _topk_sql(k: int, threshold: float, extra: str = "TRUE") -> str:
    return f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM scores WHERE score >= {threshold} AND {extra})
SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""


@query("d3_vector_topk", _topk_sql(5, 0.2))
def d3_vector_topk(t: Tables) -> DataFrame:
    asked, known = _vectors(t)
    return D.vector_topk(asked, known, 5, 0.2).withColumn("score", F.round("score", 6))


@query("d3_vector_topk_filtered", _topk_sql(3, 0.1, "alike"))
def d3_vector_topk_filtered(t: Tables) -> DataFrame:
    asked, known = _vectors(t)
    return D.vector_topk(asked, known, 3, 0.1, {"jurisdiction": "jurisdiction"}).withColumn("score", F.round("score", 6))


@query("d4_ground_chunks", f"""WITH {_SCORES}, r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM scores s
  JOIN documents d ON d.doc_id = s.query_id AND length(trim(d.text)) >= 10 JOIN embeddings e ON e.vec_id = s.corpus_id WHERE score >= 0.1 AND e.label % 3 = 1)
SELECT query_id AS chunk_id, corpus_id AS rule_id, round(score, 6) AS score, rank, 'Rule ' || corpus_id AS title FROM r WHERE rank <= 3""")
def d4_ground_chunks(t: Tables) -> DataFrame:
    asked, known = _vectors(t)
    texts = t.base("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    chunks_ = asked.withColumnRenamed("query_id", "chunk_id").join(texts, "chunk_id")
    rules = known.withColumnRenamed("corpus_id", "rule_id").withColumn("title", F.concat(F.lit("Rule "), F.col("rule_id")))
    found = D.ground_chunks(chunks_, rules, threshold=0.1, jurisdiction="J1")
    return found.select("chunk_id", "rule_id", F.round("score", 6).alias("score"), "rank", "title")


_DEFS = """SELECT 'REG-' || label AS regulation_id, 'J' || (label % 3) AS jurisdiction, 'Art. ' || vec_id AS source_reference, 'Title ' || vec_id AS title, 'About ' || label AS description FROM embeddings"""
_OLD = "SELECT regulation_id, jurisdiction, source_reference, 'old' AS title, description FROM ({defs}) x WHERE right(source_reference, 1) IN ('1', '2') UNION ALL SELECT 'REG-X', 'J9', source_reference, 'kept', '' FROM ({defs}) y WHERE right(source_reference, 1) = '3'"


@query("d5_rule_index", f"""WITH defs AS ({_DEFS}), all_ AS (SELECT * FROM defs UNION ALL SELECT * FROM ({_OLD.format(defs=_DEFS)}) WHERE title = 'kept'),
h AS (SELECT *, sha1(unhex('{fixed.UUID_NAMESPACE_DNS}') || encode(regulation_id || '::' || source_reference)) AS h FROM all_)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1)
    || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, source_reference || ' ' || title || ': ' || description AS embedding_text FROM h""")
def d5_rule_index(t: Tables) -> DataFrame:
    t.base("embeddings")
    current = D.index_rules(t.spark.sql(_OLD.format(defs=_DEFS)))
    return D.index_rules(t.spark.sql(_DEFS), current).select("point_id", "embedding_text")


# --- definitions -------------------------------------------------------------


@query("d6_definition_candidates", """WITH s AS (SELECT *, CASE WHEN contains(lower(substr(content, 1, 200)), 'definition') OR contains(lower(section), 'definition') THEN 1
  WHEN len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) >= 5 THEN 0 END AS state FROM v_passages),
w AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM s)
SELECT doc_id, start_pos FROM w WHERE open = 1""")
def d6_definition_candidates(t: Tables) -> DataFrame:
    return D.definition_candidates(t.view("v_passages")).select("doc_id", "start_pos")


@query("d7_definition_fallback", r"""SELECT doc_id, start_pos FROM v_passages WHERE page <= 3 AND (len(regexp_extract_all(content, '["“]([A-Z][a-zA-Z0-9\s-]+)["”]')) >= 2
  OR contains(content, 'shall mean') OR contains(content, 'means any'))""")
def d7_definition_fallback(t: Tables) -> DataFrame:
    return D.definition_fallback(t.view("v_passages")).select("doc_id", "start_pos")


@query("p6_long_chunks", f"SELECT doc_id, start_pos, {TOKENS.format('content')} AS token_count FROM v_passages WHERE {TOKENS.format('content')} >= 20")
def p6_long_chunks(t: Tables) -> DataFrame:
    return t.view("v_passages").select("doc_id", "start_pos", D.count_tokens(F.col("content")).alias("token_count")).filter("token_count >= 20")


# --- constraints -------------------------------------------------------------


def _squeeze(text: str) -> str:
    squeezed = f"lower(regexp_replace({text}, '\\s+', '', 'g'))"
    for edge in ('"', "''", ".,;:"):
        squeezed = f"trim({squeezed}, '{edge}')"
    return squeezed


_CHECKED = f"""checked AS (SELECT c.*, length({_squeeze('quote')}) >= 10 AND contains({_squeeze('text')}, {_squeeze('quote')}) AS verified
  FROM v_constraints c WHERE {TOKENS.format('text')} >= 20)"""


def _verified(t: Tables) -> DataFrame:
    docs = t.base("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), D.count_tokens(F.col("text")).alias("token_count"))
    # P6 as a step of its own, as in the SQL: only long documents are asked, so only theirs count as extracted.
    extracted = t.constraints().withColumn("chunk_id", F.col("doc_id")).drop("text").join(D.long_chunks(docs).select("chunk_id"), "chunk_id", "left_semi")
    return D.verify_quotes(extracted, docs)


@query("d8_verified_quotes", f"WITH {_CHECKED} SELECT ord, doc_id, verified FROM checked")
def d8_verified_quotes(t: Tables) -> DataFrame:
    return _verified(t).select("ord", "doc_id", "verified")


_TAGS = """CASE WHEN contains(s, 'personal data') OR contains(s, 'pii') OR contains(s, 'personally identifiable') THEN 'category=pii'
  WHEN contains(s, 'financial') OR contains(s, 'payment') OR contains(s, 'cardholder') OR contains(s, 'pci') THEN 'category=financial'
  WHEN contains(s, 'health') OR contains(s, 'medical') OR contains(s, 'phi') OR contains(s, 'patient') THEN 'category=health'
  WHEN contains(s, 'usage') OR contains(s, 'telemetry') OR contains(s, 'logs') OR contains(s, 'analytics') THEN 'category=telemetry'
  WHEN contains(s, 'confidential') THEN '' ELSE 'category=' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(s, '[(),]', '', 'g'), '\\s+'), lambda w: w <> '')[1:3], '_') END
  || CASE WHEN contains(s, 'eea') OR contains(s, 'europe') THEN ',origin=eea' ELSE '' END
  || CASE WHEN contains(s, 'personal data') OR contains(s, 'pii') THEN '' WHEN contains(s, 'payment') OR contains(s, 'phi') OR contains(s, 'patient') THEN ',sensitivity=restricted'
     WHEN contains(s, 'usage') OR contains(s, 'logs') THEN '' WHEN contains(s, 'confidential') THEN 'sensitivity=confidential' ELSE '' END"""
_MERGED = f"""keyed AS (SELECT *, CASE WHEN coalesce(mapped_regulation_id, '') <> '' THEN 0 ELSE 1 END AS half, coalesce('[' || section || '] ', '') || rationale AS entry,
  sha256('{{"category":"' || category || '","rule":"' || replace(rule_json, '"', '\\"') || '","subject":"' || lower(trim(subject)) || '"}}') AS fp FROM checked WHERE verified),
firsts AS (SELECT filename, fp, entry, min(half * 1000000000000 + ord) AS rank FROM keyed GROUP BY ALL),
masters AS (SELECT *, row_number() OVER (PARTITION BY filename, fp ORDER BY half, ord) AS rn, count(*) OVER (PARTITION BY filename, fp) AS n FROM keyed),
merged AS (
  SELECT m.*, lower(m.subject) AS s, coalesce(m.mapped_regulation_id, '') <> '' AS mapped, coalesce(m.retention_s <= 0, FALSE) AS zero,
    (SELECT string_agg(entry, ' | ' ORDER BY rank) FROM firsts f WHERE f.filename = m.filename AND f.fp = m.fp) AS reasons,
    (SELECT arg_min(section, half * 1000000000000 + ord) FROM keyed k WHERE k.filename = m.filename AND k.fp = m.fp AND section IS NOT NULL) AS section_reference
  FROM masters m WHERE rn = 1)""".replace("{{", "{").replace("}}", "}")


@query("d9_merged_obligations", f"""WITH {_CHECKED}, {_MERGED}
SELECT filename, 'auto-' || substr(fp, 1, 12) AS id, CASE category WHEN 'RETENTION' THEN 'Retention' WHEN 'PRIVACY' THEN 'Privacy' ELSE 'Ai_Restriction' END || ' Rule for ' || subject AS title,
  CASE WHEN mapped THEN '[Found in ' || filename || '] ' ELSE '' END || reasons || CASE WHEN zero THEN '{fixed.ZERO_RETENTION_NOTE}' ELSE '' END AS description,
  CASE WHEN mapped THEN string_split(mapped_regulation_id, '::')[1] ELSE filename END AS source_id, CASE WHEN mapped THEN 'REGULATION' ELSE 'CONTRACT_UPLOAD' END AS document_type,
  section_reference, CASE WHEN length(filename) % 2 = 0 THEN 's3://contracts/' ELSE 's3://uploads/' END || filename AS document_uri, CASE WHEN zero THEN 2 ELSE 1 END AS enforcement_level, CASE WHEN zero THEN 31536000 ELSE retention_s END AS retention_s, rule_json, {_TAGS} AS match_tags, n AS merged_count
FROM merged""")
def d9_merged_obligations(t: Tables) -> DataFrame:
    stored = F.when(F.length("filename") % 2 == 0, F.concat(F.lit("s3://contracts/"), F.col("filename")))
    merged = D.merge_constraints(_verified(t).filter("verified").withColumn("object_uri", stored), ["filename"])
    tags = F.array_sort(F.map_entries("match_tags"))
    return merged.withColumn("match_tags", F.array_join(F.transform(tags, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query("d10_subject_tags", f"WITH x AS (SELECT ord, subject, lower(subject) AS s FROM v_constraints) SELECT ord, subject, {_TAGS} AS match_tags FROM x")
def d10_subject_tags(t: Tables) -> DataFrame:
    tags = F.array_sort(F.map_entries(D.subject_tags(F.col("subject"))))
    return t.constraints().select(
        "ord", "subject", F.array_join(F.transform(tags, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("match_tags")
    )


@query("d13_pipeline_stats", f"""WITH {CHUNKS}, {_CHECKED}, c AS (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY ALL), r AS (SELECT doc_id, count(*) AS raw_constraints FROM v_constraints GROUP BY ALL),
o AS (SELECT doc_id, count(DISTINCT category || rule_json || lower(trim(subject))) AS final_obligations FROM checked WHERE verified GROUP BY ALL)
SELECT doc_id, coalesce(chunks, 0) AS chunks, coalesce(raw_constraints, 0) AS raw_constraints, coalesce(final_obligations, 0) AS final_obligations
FROM c FULL JOIN r USING (doc_id) FULL JOIN o USING (doc_id)""")
def d13_pipeline_stats(t: Tables) -> DataFrame:
    merged = D.merge_constraints(_verified(t).filter("verified"), ["doc_id"])
    return D.pipeline_stats(chunks(t), t.constraints(), merged)
