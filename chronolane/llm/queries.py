"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.llm.base import Workspace, load
from chronolane.llm.chat import ESCAPE, Template, format_chats, read_back
from chronolane.llm.decontaminate import contamination
from chronolane.llm.exact_dedup import exact_groups
from chronolane.llm.fill_in_middle import fill_in_middle, restored
from chronolane.llm.interpolated_lm import lm_scores
from chronolane.llm.line_dedup import line_dedup
from chronolane.llm.mixing import mix
from chronolane.llm.near_dedup import near_groups
from chronolane.llm.packing import pack
from chronolane.llm.token_counts import token_counts
from chronolane.llm.toxicity import Model, fit, toxicity
from chronolane.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, codebooks_sha256, vector_codes
from chronolane.llm.warc import archive_pages, page_id, read_warc

Query = Callable[[SparkSession, str], DataFrame]


#: A document is toxic from this score on.
TOXIC = 0.3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier, fitted on labelled rows whose crc32 of the id as text, mod 4, isn't 2."""
    learnable = labels.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2)
    return fit(docs, learnable)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, toxicity_model(docs, load(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "archives").path("pages")
    archive_pages(load(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = read_warc(spark, path, payload="verify")
    return found.select(
        page_id("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page_id("refers_to").alias("refers_to"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "text", "n_lines", "n_removed")


OP3_SQL = """
WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
pos AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM doc),
win AS (SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS w FROM pos WHERE p <= len(lines) - 2),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM win),
later AS (SELECT doc_id, p FROM ranked WHERE r > 1),
gone AS (SELECT doc_id, p FROM later UNION SELECT doc_id, p + 1 FROM later UNION SELECT doc_id, p + 2 FROM later),
kept AS (SELECT pos.doc_id, string_agg(pos.lines[pos.p], chr(10) ORDER BY pos.p) AS text
         FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p WHERE gone.p IS NULL GROUP BY pos.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc.doc_id, coalesce(kept.text, '') AS text, CAST(len(doc.lines) AS BIGINT) AS n_lines, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id LEFT JOIN n ON doc.doc_id = n.doc_id
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["words"])
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents").select("doc_id", "text"))


#: A conversation whose texts hold control strings, formatted with the table's own.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(extra)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, sha256(text) AS text_sha256 FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, load(spark, sf_dir, "benchmark"))
    named = F.array_join(F.transform("items", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), "contaminated")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text"))
    again = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again.alias("restored_sha256"))


def _h(k: int) -> str:
    return f"CAST('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), {8 * k + 1}, 8) AS BIGINT)"


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_h(0)} AS h1, {_h(1)} AS h2, {_h(2)} AS h3, {_h(3)} AS h4 FROM documents),
m AS (SELECT *, length(t) AS n, least(h1 % (length(t) + 1), h2 % (length(t) + 1)) AS a, greatest(h1 % (length(t) + 1), h2 % (length(t) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS s FROM m)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || mid ELSE '<S>' || s || '<P>' || p || '<M>' || mid END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM c
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _op13_sql() -> str:
    steps = [f"""e AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
w AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in v] AS v, len(v) // {PARTS} AS k FROM e),
p AS (SELECT vec_id, label, r, i AS pos, v[i * k + 1:i * k + k] AS part FROM w, range({PARTS}) t(i)),
u AS (SELECT pos, part, count(*) AS n FROM p GROUP BY pos, part),
b0 AS (SELECT pos, r AS idx, part AS c FROM p WHERE r < {ENTRIES})"""]
    far = "CAST(list_sum([(u.part[j] - b.c[j]) * (u.part[j] - b.c[j]) for j in range(1, len(u.part) + 1)]) AS BIGINT)"
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS (SELECT u.pos, u.part, any_value(u.n) AS n, min(ROW({far}, b.idx)) AS best FROM u JOIN b{k} b ON u.pos = b.pos GROUP BY u.pos, u.part),
a{k} AS (SELECT pos, part, n, best[1] AS far, best[2] AS idx FROM d{k})""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT pos, idx, j, sum(part[j] * n) AS total, sum(n) AS n FROM a{k}, unnest(range(1, len(part) + 1)) t(j) GROUP BY pos, idx, j),
m{k} AS (SELECT pos, idx, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{k} GROUP BY pos, idx),
b{k + 1} AS (SELECT b.pos, b.idx, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.pos = m.pos AND b.idx = m.idx)""")
    return "WITH " + ",\n".join(steps) + f""",
x AS (SELECT p.vec_id, p.label, string_agg(format('{{:02x}}', a.idx), '' ORDER BY p.pos) AS code, CAST(sum(a.far) AS BIGINT) AS error
 FROM p JOIN a{ROUNDS} a ON p.pos = a.pos AND p.part = a.part GROUP BY p.r, p.vec_id, p.label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, idx)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM x, h
"""


OP13_SQL = _op13_sql()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNT = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in Template().controls())

OP8_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
 CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 24 + length(role) END + length(text)
 + length(text) - length(replace(text, '{ESCAPE}', '')) + 2 * ({_COUNT}) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
 CAST(sum(size) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_CUT = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH b AS (SELECT item_id, {_CUT} AS w FROM benchmark),
p AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s, least(len(w), 13) AS n FROM p),
d AS (SELECT doc_id, {_CUT} AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
q AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n),
hit AS (SELECT q.doc_id, q.i, q.n, win.item_id FROM q JOIN win ON win.n = q.n AND win.s = array_to_string(q.w[q.i:q.i + q.n - 1], ' ')),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_chat_format": op8_chat_format,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_packing": op12_packing,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op8_chat_format": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
