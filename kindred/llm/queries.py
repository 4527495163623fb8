"""Registered queries of this subpackage, each over its whole table, and SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import align, bpe, chat, html, jaccard, kdtree, langid, licenses, merkle, packing, quality, resample, sharding
from kindred.runtime import cut_lineage

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark, sf_dir):
    """Is each document's text prose of its language?"""
    out = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc.doc_id", *out.columns[1:])


@query("op2_kdtree_top_k", """
WITH r0 AS (SELECT row_number() OVER () AS row_id, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
x0 AS (SELECT row_id, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM r0),
b0 AS (SELECT DISTINCT row_id FROM x0 WHERE x IS NULL OR NOT isfinite(x)),
l0 AS (SELECT row_id, vec_id, list(CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) ORDER BY i) AS v
       FROM x0 WHERE row_id NOT IN (SELECT row_id FROM b0) GROUP BY ALL),
v AS (SELECT vec_id, min(v) AS v FROM l0 GROUP BY vec_id),
c AS (SELECT vec_id, len(v) AS d, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(sum(q.x * e.x) AS BIGINT) AS score
      FROM c q JOIN c e ON q.i = e.i AND q.d = e.d AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op2(spark, sf_dir):
    """Which ten vectors have the largest inner product with each query vector?"""
    vectors = kdtree.scaled(table(spark, sf_dir, "embeddings"))
    return kdtree.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


@query("op3_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node AND r.low < u.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""")
def op3(spark, sf_dir):
    """Which documents say nearly the same, directly or over others?"""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_license_scan")
def op4(spark, sf_dir):
    """Which documents carry which license notice?"""
    out = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc.doc_id", "license", "containment")


@query("op5_importance_resampling")
def op5(spark, sf_dir):
    """Which documents would a sample that looks like the good ones take?"""
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc.doc_id", "log_weight", "score", "selected")


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    """Token ids of every text and what they decode to, as digests."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    both = bpe.decode(ids)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op7_html_main_text")
def op7(spark, sf_dir):
    """The main text of every page."""
    out = html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op8_histogram_shards")
def op8(spark, sf_dir):
    """Which of 16 shards of near equal bytes does each document go to, and where?"""
    out = sharding.shard(table(spark, sf_dir, "documents"), 16, keep=["doc_id"])
    return out.select("doc.doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_language_id")
def op9(spark, sf_dir):
    """The language of every document, learned from the labels of three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(langid.training_rows(docs)), keep=["doc_id"])
    return out.select("doc.doc_id", langid.held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


@query("op10_pattern_packing")
def op10(spark, sf_dir):
    """The place of every piece of every document in as few sequences as possible."""
    return packing.packed_documents(table(spark, sf_dir, "documents"))


@query("op11_cross_tokenizer_alignment")
def op11(spark, sf_dir):
    """Which tokens of two tokenizers cover the same bytes of each document, and how usual are these pairs?"""
    out = align.count_links(align.align(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return out.select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
l AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS loss FROM c WHERE role = 'assistant' GROUP BY conv_id),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        CAST(sum(length(text) + len(regexp_extract_all(text, '<\\*/s>|\[\\*(?:SYS|/?INST|/?ROLE)\]'))
             + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7
                    ELSE 13 + length(role) + len(regexp_extract_all(role, '<\\*/s>|\[\\*(?:SYS|/?INST|/?ROLE)\]')) END + 4) AS BIGINT) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, length(coalesce(loss, '')) AS loss_chars, sha256(coalesce(loss, '')) AS loss_sha256, formatted_chars
FROM t LEFT JOIN l ON l.conv_id = t.conv_id""")
def op12(spark, sf_dir):
    """Conversations as token ids with a loss mask, and digests of what these say when read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(cut_lineage(chat.format_turns(turns.unionByName(planted)), "chat"))


def _digest_sql(text: str) -> str:
    """A leaf's digest in SQL, with ``text`` for the text."""
    shown = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
             for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(shown)})"


def _tree_sql(name: str, levels: int) -> str:
    """Levels over ``{name}0 (tree, i, d)``: ``{name}r<k>`` holds the joined runs (null: one node is left), ``{name}<k>`` the nodes."""
    return ", ".join(
        f"""{name}r{k} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(c) > 1 THEN string_agg(d, '' ORDER BY i) END AS run, any_value(d) AS d
FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k}) GROUP BY tree, i // 16),
{name}{k + 1} AS (SELECT tree, i, coalesce(sha256(run), d) AS d FROM {name}r{k})""" for k in range(levels))


def _proof_sql(tree: str, place: str, name: str, levels: int, last: str) -> str:
    """Steps ``{name}p<k>`` that add the siblings of each level to ``proof`` and fold them into ``folded``."""
    steps = []
    for k in range(levels):
        at = f"({place} // {16 ** k} % 16)"
        steps.append(f"""{name}p{k} AS (SELECT p.* REPLACE (
proof || coalesce(left(run, 64 * {at}) || substr(run, 64 * {at} + 65), '') AS proof,
coalesce(sha256(left(run, 64 * {at}) || folded || substr(run, 64 * {at} + 65)), folded) AS folded)
FROM {last} p JOIN {name}r{k} r ON r.tree = p.{tree} AND r.i = p.{place} // {16 ** (k + 1)})""")
        last = f"{name}p{k}"
    return ", ".join(steps)


#: Five levels a source and three over the sources: up to 1,048,576 rows a source, 4,096 sources.
MERKLE_SQL = f"""
WITH b AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_digest_sql('text')} AS leaf,
  {_digest_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))),
    lambda c, x: list_reduce(list_concat([xor(CAST(c AS BIGINT), CAST(x AS BIGINT))], [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS crc FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS folded, '' AS proof FROM b),
n0 AS (SELECT tree, pos AS i, leaf AS d FROM l), {_tree_sql('n', 5)},
s0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d FROM n5), {_tree_sql('s', 3)},
o AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place, d AS subroot FROM n5),
q AS (SELECT l.*, o.place, o.subroot, '' AS top FROM l JOIN o ON o.tree = l.tree),
{_proof_sql('tree', 'pos', 'n', 5, 'q')}, {_proof_sql('top', 'place', 's', 3, 'np4')}
SELECT doc_id, leaf, subroot, s3.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = s3.d AS verified FROM sp2, s3"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark, sf_dir):
    """The proof of every document against one root, and which changed documents it gives away."""
    tampered = F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.documents(table(spark, sf_dir, "documents"), tampered)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    """Language, quality, one of each group of near copies, packing."""
    return corpus_pipeline.run(spark, sf_dir)
