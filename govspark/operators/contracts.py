"""Contract documents to obligations: clean, chunk, search, verify and merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark import fixed_values as fixed
from govspark.functions import uuid5_dns
from govspark.operators.ordered import ordered_ranges, running
from govspark.session import materialize

_STRINGS = "array<string>"


def count_tokens(text: Column) -> Column:
    """Words and single punctuation marks; stands in for a subword tokenizer."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("bigint")


# --- elements ----------------------------------------------------------------


def clean_text(text: Column) -> Column:
    """Straight quotes, no leading bullet, no dashes, single blanks; broken lines are joined."""
    straight = F.translate(text, "‘’‚‛“”„‟", "''''\"\"\"\"")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(straight, "[-–]", " "), r"[\s\u00a0]+", " "))
    return F.trim(F.regexp_replace(spaced, r"^[•‣⁃∙●○◦▪·*]+\s*", ""))


def clean_elements(elements: DataFrame) -> DataFrame:
    """Drop empty, header and footer elements and normalise the text of the rest."""
    kept = elements.filter((F.trim(F.regexp_replace("text", r"\s+", " ")) != "") & ~F.col("kind").isin("Header", "Footer"))
    return kept.withColumn("text", clean_text(F.col("text")))


# --- chunks ------------------------------------------------------------------

def chunk_elements(elements: DataFrame, max_tokens: int = 800, html: str | None = None) -> DataFrame:
    """Section-aware chunks of (doc_id, pos, kind, text, page).

    A Title closes the section before it and names the next one (`Preamble` before the first). A Table
    is a chunk of its own. Other elements are packed greedily while the token sum stays within
    ``max_tokens``. An element without a doc_id belongs to no document and is refused with an error. Sections are numbered without gathering a document in one task, and packing walks
    sorted rows with only the open chunk in memory.
    """
    title, table = F.col("kind") == "Title", F.col("kind") == "Table"
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    body = F.coalesce(F.nullif(F.col(html), F.lit("")), F.col("text")) if html else F.col("text")
    known = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("an element has no doc_id"))).otherwise(F.col("doc_id"))
    rows = elements.select(
        known.alias("doc_id"), "pos", "kind", F.when(table, body).otherwise(trimmed).alias("text"), F.col("page").cast("bigint").alias("page")
    )
    # Written out, so that each text is cleaned and its tokens are counted once.
    rows = materialize(rows.withColumn("tokens", count_tokens(F.col("text"))))
    # Numbering and packing move positions and sizes only; the text joins in once at the end.
    sizes = rows.select("doc_id", "pos", "kind", "tokens", F.when(title, F.col("text")).alias("title"))
    numbered = running(
        sizes,
        ["doc_id"],
        ["pos"],
        # A title or a table ends the text before it, and the text after it starts afresh.
        sums={"cut": F.when(title | table, 1).otherwise(0)},
        lasts={"section": F.col("title")},
    ).select("doc_id", "pos", "cut", F.coalesce("section", F.lit("Preamble")).alias("section"), "kind", "tokens")
    packed = pack_greedily(
        numbered.filter(~title & ~table & (F.col("tokens") > 0)), ["doc_id", "cut"], "pos", "tokens", max_tokens
    ).select("doc_id", "pos", "cut", "section", "chunk_no")
    alone = numbered.filter(table).select("doc_id", "pos", "cut", "section", F.lit(-1).cast("bigint").alias("chunk_no"))
    content = rows.filter(~title).select("doc_id", "pos", "text", "page", F.col("tokens").alias("held"))
    parts = packed.unionByName(alone).join(content, ["doc_id", "pos"])
    # A chunk holds at most `max_tokens` tokens, or one longer element.
    chunks = parts.groupBy("doc_id", "cut", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "page"))).alias("parts"), F.any_value("section").alias("section"),
        # Parts are joined by line breaks, which end a token and are none.
        F.coalesce(F.sum("held"), F.lit(0)).alias("token_count"),
    )
    first = F.get("parts", F.lit(0))
    joined = chunks.select(
        "doc_id",
        first["pos"].alias("start_pos"),
        "section",
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("content"),
        first["page"].alias("page"),
        F.when(F.col("chunk_no") < 0, F.lit("Table")).otherwise(F.lit("NarrativeText")).alias("element_type"),
        "token_count",
    )
    return joined.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("start_pos").cast("string")))


def pack_greedily(df: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Add ``chunk_no``: consecutive rows of a key share one while their sizes sum to at most ``limit``.

    Greedy packing depends on all rows before it, but only through the size of the open chunk, a number
    up to ``limit``. Rows are range-partitioned, each range of a key that crosses a border is summarised by what it does to
    every possible open size, the summaries are chained, and then each range is numbered on its own. A key may be
    as long as the table.
    """
    ranged = ordered_ranges(df, keys, [order])
    cells = [*keys, "_range"]
    spans = ranged.groupBy(*keys).agg(F.countDistinct("_range").alias("n")).filter(F.col("n") > 1).select(*keys)
    # Only keys that cross a range border need summaries; there is at most one per border.
    crossing = ranged.join(spans, keys, "left_semi").repartition(*cells).sortWithinPartitions(*cells, order)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.select(*cells).schema)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, closed = None, None, None
        start = np.arange(limit + 1, dtype=np.int64)

        def flush():
            return pd.DataFrame([[*current, opened.tolist(), closed.tolist()]], columns=[*cells, "opened", "closed"])

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                cell, amount = row[:-1], row[-1]
                if cell != current:
                    if current is not None:
                        yield flush()
                    current, opened, closed = cell, start.copy(), np.zeros(limit + 1, dtype=np.int64)
                full = (opened + amount > limit) & (opened > 0)
                closed = closed + full
                opened = np.minimum(np.where(full, amount, opened + amount), limit)
        if current is not None:
            yield flush()

    summaries = crossing.select(*cells, F.col(size).cast("bigint")).mapInPandas(
        summarise, f"{key_schema}, opened array<bigint>, closed array<bigint>"
    )
    # Chain the summaries of one key in range order: one row per range, so at most as many as ranges.
    chain = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_range", "opened", "closed"))),
        F.struct(
            F.lit(0).cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("done"),
            F.array().cast("array<struct<_range:int,open:bigint,done:bigint>>").alias("carries"),
        ),
        lambda acc, s: F.struct(
            F.get(s["opened"], acc["open"].cast("int")).alias("open"),
            (acc["done"] + F.get(s["closed"], acc["open"].cast("int"))).alias("done"),
            F.concat(acc["carries"], F.array(F.struct(s["_range"].alias("_range"), acc["open"].alias("open"), acc["done"].alias("done")))).alias("carries"),
        ),
    )
    carries = summaries.groupBy(*keys).agg(chain.alias("c")).select(*keys, F.inline("c.carries"))
    carried = ranged.join(
        carries.select(*cells, F.col("open").alias("_open"), F.col("done").alias("_done")), cells, "left"
    ).fillna(0, ["_open", "_done"])
    return _number_chunks(carried.repartition(*cells), df, keys, order, size, limit)


def _number_chunks(placed: DataFrame, df: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Number the rows of each (key, range) from its carried-in state, one sorted pass per partition."""
    cells, names = [*keys, "_range"], df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", chunk_no bigint"

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, chunk = None, 0, 0
        for batch in batches:
            numbers = []
            carried = zip(zip(*[batch[c] for c in cells]), batch[size], batch["_open"], batch["_done"])
            for cell, amount, carry_open, carry_done in carried:
                if cell != current:
                    current, opened, chunk = cell, carry_open, carry_done
                if opened > 0 and opened + amount > limit:
                    chunk, opened = chunk + 1, 0
                opened = min(opened + amount, limit)
                numbers.append(chunk)
            yield batch[names].assign(chunk_no=numbers)

    return placed.sortWithinPartitions(*cells, order).mapInPandas(number, schema)


# --- vectors -----------------------------------------------------------------


MAX_PIVOTS = 1024


def _unit(vectors) -> np.ndarray:
    a = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def _cells(side: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds the cell (number of the nearest pivot of like length, -1 without one) and the angle to that pivot."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, angle = np.full(len(batch), -1), np.zeros(len(batch))
            lengths = batch["f_length"].to_numpy()
            for length in set(lengths.tolist()) & set(pivots):
                rows = np.nonzero(lengths == length)[0]
                numbers, known = pivots[length]
                unit = _unit(batch["v"].iloc[rows])
                good = np.isfinite(unit).all(axis=1) & (np.abs(unit).max(axis=1) > 0)
                cosine = unit[good] @ known.T
                nearest = cosine.argmax(axis=1)
                cell[rows[good]] = numbers[nearest]
                angle[rows[good]] = np.arccos(np.clip(cosine[np.arange(len(nearest)), nearest], -1, 1))
            yield batch.assign(cell=cell, angle=angle)

    return side.mapInPandas(place, T.StructType([*side.schema, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def _packed(placed: DataFrame, id_col: str, names: list[str], block_rows: int, prefix: str) -> tuple[DataFrame, dict[int, float]]:
    """Blocks of near ``block_rows`` vectors of one cell with their radius, and the radius of each cell."""
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row per pivot
    parts = [1] * (MAX_PIVOTS + 1)
    for r in stats:
        parts[r.cell + 1] = -(-r.n // block_rows)
    part = F.pmod(F.xxhash64(id_col), F.array(*map(F.lit, parts[: max((r.cell for r in stats), default=-1) + 2]))[F.col("cell") + 1])
    blocks = placed.groupBy(*names, F.col("cell").alias(f"{prefix}_cell"), part.alias(f"{prefix}_part")).agg(
        F.max("angle").alias(f"{prefix}_radius"), F.collect_list(F.struct(F.col(id_col).alias("id"), "v")).alias(prefix)
    )
    blocks = blocks.select(
        *names, f"{prefix}_cell", f"{prefix}_part", f"{prefix}_radius", F.transform(prefix, lambda s: s["id"]).alias(f"{prefix}_ids"),
        F.flatten(F.transform(prefix, lambda s: s["v"])).alias(f"{prefix}_v"),
    )
    return materialize(blocks), {r.cell: r.radius for r in stats}


def vector_blocks(
    queries: DataFrame, corpus: DataFrame, threshold: float, filters: dict[str, str] | None = None, block_rows: int = 4096
) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Blocks of both sides, the pairs of blocks that may hold a cosine at or above the threshold, and the columns they share.

    A block holds vectors nearest to one of at most ``MAX_PIVOTS`` vectors drawn from the corpus. By the triangle inequality of angles
    no cosine of a pair exceeds that of the angle between its pivots less both radii (``bound``).
    """
    filters = filters or {}
    names = [f"f{i}" for i in range(len(filters))]
    usable = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())

    def side(df: DataFrame, id_col: str, keys) -> DataFrame:
        picked = df.select(F.col(id_col), F.col("vector").alias("v"), *[F.col(c).cast("string").alias(n) for n, c in zip(names, keys)])
        return picked.filter(usable).dropna(subset=names).withColumn("f_length", F.size("v"))

    q, c = side(queries, "query_id", filters.values()), side(corpus, "corpus_id", filters)
    names = [*names, "f_length"]
    wanted = min(MAX_PIVOTS, max(1, -(-c.count() // block_rows)))
    drawn: dict[int, list] = {}
    for n, r in enumerate(c.orderBy(F.xxhash64("corpus_id")).select("v", "f_length").limit(wanted).collect()):
        drawn.setdefault(r.f_length, []).append((n, r.v))
    pivots = {}
    for length, rows in drawn.items():
        unit = _unit([v for _, v in rows])
        good = np.isfinite(unit).all(axis=1) & (np.abs(unit).max(axis=1) > 0)
        if good.any():
            pivots[length] = (np.array([n for n, _ in rows])[good], unit[good])
    q_blocks, _ = _packed(materialize(_cells(q, pivots)), "query_id", names, block_rows, "q")
    c_blocks, c_radius = _packed(materialize(_cells(c, pivots)), "corpus_id", names, block_rows, "c")
    least = np.arccos(np.clip(threshold, -1, 1)) + 1e-6

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block of queries with the cells it may have to meet and the angle between the pivots."""
        for batch in batches:
            for row in batch.to_dict("records"):
                numbers, known = pivots.get(row["f_length"], (np.zeros(0, np.int64), np.zeros((0, row["f_length"]))))
                mine = np.nonzero(numbers == row["q_cell"])[0]
                between = np.arccos(np.clip(known @ known[mine[0]], -1, 1)) if len(mine) else np.zeros(len(numbers))
                radius = np.array([c_radius.get(int(n), -np.inf) for n in numbers])
                meet = between - radius - row["q_radius"] <= least if len(mine) else radius >= 0
                cells = [(-1, 0.0), *zip(numbers[meet].tolist(), between[meet].tolist(), strict=True)]
                yield pd.DataFrame([{**row, "c_cell": n, "between": x} for n, x in cells])

    asked = q_blocks.select(*names, "q_cell", "q_part", "q_radius")
    meeting = T.StructType([*asked.schema, T.StructField("c_cell", T.IntegerType()), T.StructField("between", T.DoubleType())])
    reached = asked.mapInPandas(near, meeting)
    pairs = reached.join(c_blocks.select(*names, "c_cell", "c_part", "c_radius"), [*names, "c_cell"])
    # Without a pivot on one side nothing is known of the angle.
    apart = F.when((F.col("q_cell") < 0) | (F.col("c_cell") < 0), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.col("between") - F.col("q_radius") - F.col("c_radius") - 1e-6)
    )
    pairs = pairs.withColumn("bound", F.cos(apart)).filter(F.col("bound") >= threshold)
    return q_blocks, c_blocks, pairs.drop("between", "q_radius", "c_radius"), names


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    threshold: float = 0.4,
    filters: dict[str, str] | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """(query_id, corpus_id, score, rank): exact cosine top-k at or above the threshold.

    Both sides are packed into blocks of near vectors. Each block of queries meets its most promising block first; the worst kth score
    found there, or the threshold, then excludes all blocks whose bound is lower. A pair of blocks is one matrix product that
    keeps at most k rows per query. ``filters`` maps corpus columns to query columns that must be equal; they become the join key, so
    only like blocks meet. Vectors of different lengths don't meet either, and null or empty vectors or ones with a null component take no part.
    """
    q_blocks, c_blocks, pairs, names = vector_blocks(queries, corpus, threshold, filters, block_rows)
    q_key, c_key = [*names, "q_cell", "q_part"], ["c_cell", "c_part"]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, part, q_ids, q_v, c_ids, c_v in batch.itertuples(index=False, name=None):
                a = _unit(np.asarray(q_v, dtype=np.float64).reshape(len(q_ids), -1))
                b = _unit(np.asarray(c_v, dtype=np.float64).reshape(len(c_ids), -1))
                scores = a @ b.T
                rows, cols = np.nonzero(scores >= threshold)
                if not len(rows):
                    continue
                found = pd.DataFrame(
                    {"q_cell": cell, "q_part": part, "query_id": np.asarray(q_ids)[rows], "corpus_id": np.asarray(c_ids)[cols], "score": scores[rows, cols]}
                )
                found = found.sort_values(["query_id", "score", "corpus_id"], ascending=[True, False, True])
                yield found.groupby("query_id", sort=False).head(k)

    types = [df.schema[n].dataType.simpleString() for df, n in ((queries, "query_id"), (corpus, "corpus_id"), (q_blocks, "q_part"))]
    schema = f"q_cell int, q_part {types[2]}, query_id {types[0]}, corpus_id {types[1]}, score double"

    def scored(which: DataFrame) -> DataFrame:
        met = which.join(q_blocks.drop("q_radius"), q_key).join(c_blocks.drop("c_radius"), [*names, *c_key])
        return met.select("q_cell", "q_part", "q_ids", "q_v", "c_ids", "c_v").mapInPandas(best, schema)

    home = pairs.groupBy(*q_key).agg(F.max(F.struct("bound", *c_key)).alias("home")).select(*q_key, *[f"home.{c}" for c in c_key])
    first = materialize(scored(home))
    # The worst kth score of a block: of its queries that have k so far; if any has fewer, the threshold stays.
    kth = first.groupBy("q_cell", "q_part", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k)
    kth = kth.groupBy("q_cell", "q_part").agg(F.count("*").alias("full"), F.min("score").alias("worst"))
    sizes = q_blocks.groupBy("q_cell", "q_part").agg(F.sum(F.size("q_ids")).alias("size"))
    kth = kth.join(sizes, ["q_cell", "q_part"]).filter(F.col("full") == F.col("size")).select("q_cell", "q_part", "worst")
    rest = pairs.join(home, [*q_key, *c_key], "left_anti").join(kth, ["q_cell", "q_part"], "left")
    rest = rest.filter(F.col("worst").isNull() | (F.col("bound") >= F.col("worst") - 1e-9)).drop("bound", "worst")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "corpus_id"))
    found = first.unionByName(scored(rest)).select("query_id", "corpus_id", "score")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def ground_chunks(
    chunks: DataFrame, rules: DataFrame, threshold: float = 0.35, k: int = 3, jurisdiction: str | None = None
) -> DataFrame:
    """Best regulation rules of each chunk that has at least ten characters of text.

    ``chunks``: chunk_id, content, vector. ``rules``: rule_id, vector, jurisdiction and payload columns.
    """
    asked = chunks.filter(F.length(F.trim("content")) >= 10).select(F.col("chunk_id").alias("query_id"), "vector")
    known = rules if jurisdiction is None else rules.filter(F.col("jurisdiction") == jurisdiction)
    hits = vector_topk(asked, known.select(F.col("rule_id").alias("corpus_id"), "vector"), k, threshold)
    payload = known.drop("vector")
    return hits.withColumnRenamed("corpus_id", "rule_id").join(payload, "rule_id").withColumnRenamed("query_id", "chunk_id")


def index_rules(definitions: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Index rows of regulation rules: stable id, text to embed, payload; replaces equal ids of ``current``.

    ``definitions``: regulation_id, jurisdiction, source_reference, title, description and more columns.
    """
    point = uuid5_dns(F.concat(F.col("regulation_id"), F.lit("::"), F.col("source_reference")))
    text = F.concat(F.col("source_reference"), F.lit(" "), F.col("title"), F.lit(": "), F.col("description"))
    rows = definitions.withColumn("point_id", point).withColumn("embedding_text", text)
    if current is None:
        return rows
    return rows.unionByName(current.join(rows.select("point_id"), "point_id", "left_anti").select(*rows.columns))


# --- definitions -------------------------------------------------------------


def definition_candidates(chunks: DataFrame) -> DataFrame:
    """Chunks of a definitions section, in document order.

    A chunk that mentions a definition in its first 200 characters or its section opens a run; chunks
    of fewer than five words stay in it; the first longer one closes it.
    """
    opens = F.lower(F.substring("content", 1, 200)).contains("definition") | F.lower("section").contains("definition")
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    state = F.when(opens, F.lit(1)).when(words >= 5, F.lit(0))
    return running(chunks, ["doc_id"], ["start_pos"], lasts={"_state": state}).filter(F.col("_state") == 1).drop("_state")


def definition_fallback(chunks: DataFrame, pages: int = 3) -> DataFrame:
    """Early chunks with two or more quoted capitalised terms, or with a defining phrase."""
    quoted = F.size(F.regexp_extract_all("content", F.lit('["“]([A-Z][a-zA-Z0-9\\s-]+)["”]')))
    phrase = F.col("content").contains("shall mean") | F.col("content").contains("means any")
    return chunks.filter((F.col("page") <= pages) & ((quoted >= 2) | phrase))


# --- constraints -------------------------------------------------------------


def _squeezed(text: Column) -> Column:
    lowered = F.lower(F.regexp_replace(text, r"\s+", ""))
    no_double = F.regexp_replace(lowered, r'^"+|"+$', "")
    no_single = F.regexp_replace(no_double, r"^'+|'+$", "")
    return F.regexp_replace(no_single, r"^[.,;:]+|[.,;:]+$", "")


def long_chunks(chunks: DataFrame, min_tokens: int = 20) -> DataFrame:
    """The chunks that are asked for constraints: those of ``min_tokens`` tokens or more (P6)."""
    return chunks.filter(F.col("token_count") >= min_tokens)


def verify_quotes(constraints: DataFrame, chunks: DataFrame, min_chars: int = 10) -> DataFrame:
    """Add ``verified``: the quote, squeezed, is long enough and occurs in its chunk.

    Every constraint gets true or false, false where its chunk_id is null or unknown; chunks of any length count.
    """
    texts = chunks.select("chunk_id", F.col("content").alias("_text"))
    quote = _squeezed(F.col("quote"))
    holds = (F.length(quote) >= min_chars) & _squeezed(F.col("_text")).contains(quote)
    return constraints.join(texts, "chunk_id", "left").withColumn("verified", F.coalesce(holds, F.lit(False))).drop("_text")


def subject_tags(subject: Column) -> Column:
    """Engineering tags of a legal subject: first keyword rule that hits, else its first three words."""
    text = F.lower(subject)
    words = F.filter(F.split(F.regexp_replace(text, r"[(),]", ""), r"\s+"), lambda w: w != "")
    tags = F.create_map(F.lit("category"), F.array_join(F.slice(words, 1, 3), "_"))
    for keywords, found in reversed(fixed.SUBJECT_TAG_RULES):
        hit = F.lit(False)
        for word in keywords:
            hit = hit | text.contains(word)
        literal = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
        tags = F.when(hit, literal).otherwise(tags)
    europe = text.contains("eea") | text.contains("europe")
    return F.when(europe, F.map_concat(tags, F.create_map(F.lit("origin"), F.lit("eea")))).otherwise(tags)


def merge_constraints(constraints: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Equal rules to one obligation each.

    Input: ord (document order), filename, category, subject, rationale, section, mapped_regulation_id,
    retention_s and rule_json, plus the ``group`` columns within which rules are merged. Repeated
    rationales are reduced before they are gathered, so a group holds only what its result shows. ``object_uri``, if there is
    such a column, is where the file is stored; files without one are known as uploads by their name.
    """
    group = group or []
    stored = F.col("object_uri") if "object_uri" in constraints.columns else F.lit(None).cast("string")
    fingerprint = F.sha2(
        F.to_json(
            F.struct(
                F.col("category"), F.coalesce("rule_json", F.lit("{}")).alias("rule"), F.lower(F.trim("subject")).alias("subject")
            )
        ),
        256,
    )
    mapped = F.coalesce(F.col("mapped_regulation_id"), F.lit("")) != ""
    # Mapped items come first; document order decides inside both halves.
    rank = F.struct(F.when(mapped, 0).otherwise(1).alias("h"), F.col("ord").alias("o"))
    prefix = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("["), F.col("section"), F.lit("] "))).otherwise(F.lit(""))
    keyed = constraints.select(
        *group,
        fingerprint.alias("fingerprint"),
        F.concat(prefix, F.col("rationale")).alias("entry"),
        rank.alias("rank"),
        F.struct(
            "filename", "category", "subject", "mapped_regulation_id", "retention_s", "rule_json", "section", stored.alias("object_uri")
        ).alias("item"),
    )
    keys = [*group, "fingerprint"]
    entries = keyed.groupBy(*keys, "entry").agg(
        F.min("rank").alias("rank"),
        F.count("*").alias("n"),
        F.min_by("item", "rank").alias("item"),
        F.min_by("item.section", F.when(F.coalesce("item.section", F.lit("")) != "", F.col("rank"))).alias("entry_section"),
    )
    merged = entries.groupBy(*keys).agg(
        F.min_by("item", "rank").alias("m"),
        F.min_by("entry_section", F.when(F.col("entry_section").isNotNull(), F.col("rank"))).alias("section_reference"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda e: e["entry"]), " | "
        ).alias("rationale"),
        F.sum("n").alias("merged_count"),
    )
    is_mapped = F.coalesce(F.col("m.mapped_regulation_id"), F.lit("")) != ""
    zero = F.coalesce(F.col("m.retention_s") <= 0, F.lit(False))
    rationale = F.concat(
        F.when(is_mapped, F.concat(F.lit("[Found in "), F.col("m.filename"), F.lit("] "))).otherwise(F.lit("")),
        F.col("rationale"),
        F.when(zero, F.lit(fixed.ZERO_RETENTION_NOTE)).otherwise(F.lit("")),
    )
    return merged.select(
        *group,
        F.concat(F.lit("auto-"), F.substring("fingerprint", 1, 12)).alias("id"),
        F.concat(F.array_join(F.transform(F.split("m.category", "_"), F.initcap), "_"), F.lit(" Rule for "), F.col("m.subject")).alias("title"),
        rationale.alias("description"),
        F.when(is_mapped, F.substring_index("m.mapped_regulation_id", "::", 1)).otherwise(F.col("m.filename")).alias("source_id"),
        F.when(is_mapped, F.lit("REGULATION")).otherwise(F.lit("CONTRACT_UPLOAD")).alias("document_type"),
        "section_reference",
        F.coalesce(F.nullif("m.object_uri", F.lit("")), F.concat(F.lit(fixed.UPLOADS), F.col("m.filename"))).alias("document_uri"),
        F.when(zero, F.lit(fixed.ENFORCEMENT_LEVEL["AUDIT_ONLY"])).otherwise(F.lit(fixed.ENFORCEMENT_LEVEL["BLOCKING"])).alias(
            "enforcement_level"
        ),
        F.when(zero, F.lit(365 * 86400)).otherwise(F.col("m.retention_s")).cast("bigint").alias("retention_s"),
        F.col("m.rule_json").alias("rule_json"),
        subject_tags(F.col("m.subject")).alias("match_tags"),
        "merged_count",
    )


def pipeline_stats(chunks: DataFrame, constraints: DataFrame, obligations: DataFrame) -> DataFrame:
    """Chunks, raw constraints and final obligations per document; all inputs carry doc_id."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    joined = (
        count(chunks, "chunks")
        .join(count(constraints, "raw_constraints"), "doc_id", "full_outer")
        .join(count(obligations, "final_obligations"), "doc_id", "full_outer")
    )
    return joined.fillna(0, ["chunks", "raw_constraints", "final_obligations"])
