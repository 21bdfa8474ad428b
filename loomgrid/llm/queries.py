"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.permutation_index import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, top=10)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.exact_dedup import dedup_report

    found = dedup_report(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.html_crf import extract

    return extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


#: A key for the query only; real runs bring their own secret.
QUERY_KEY = b"key of the registered query"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.surrogates import KINDS, replace

    found = replace(_read(spark, sf_dir, "documents"), QUERY_KEY)
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")
    return found.select("doc_id", *map(count, KINDS), spans.alias("spans"), "text")


#: The tree of the mixture: domains over languages over sources, with the weights that aren't 1.
WEB, REFERENCE, FORUM = "web", "reference", "forum"
DOMAINS = {WEB: range(0, 10), REFERENCE: range(10, 15), FORUM: range(15, 20)}
WEIGHTS = {(WEB,): 0.6, (REFERENCE,): 0.25, (FORUM,): 0.15, (None, "en"): 0.55, (None, "de"): 0.15, (None, "fr"): 0.15, (None, "es"): 0.15, (None, "src0"): 4.0}


def tree_levels() -> dict:
    """domain, lang and source of a row of documents; sources that no domain names belong to the web."""
    named = {f"src{n}": domain for domain, numbers in DOMAINS.items() for n in numbers}
    domain = F.coalesce(*(F.when(F.col("source").isin([s for s, d in named.items() if d == one]), F.lit(one)) for one in DOMAINS), F.lit(WEB))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op5_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.mixing import mix

    found = mix(_read(spark, sf_dir, "documents"), tree_levels(), WEIGHTS, share_of_supply=1.0, epochs=2)
    return found.select("doc_id", "lang", "source", F.col("epoch__").alias("epoch"), F.col("tokens__").alias("tokens"), F.col("budget__").alias("leaf_budget"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.warc import read_archives, write_archives
    from loomgrid.operators.shared import fresh_dir

    folder = fresh_dir(spark, "warc")
    write_archives(_read(spark, sf_dir, "pages"), folder)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_archives(spark, folder, columns, verify="true").where(F.col("record_type").isin("response", "revisit"))


OP6_SQL = """
WITH t AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM t
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM g
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.secrets import BASE, scan

    found = scan(_read(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), told("spans").alias("spans"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.simhash import components, fingerprints
    from loomgrid.operators.shared import cut

    found = components(cut(fingerprints(_read(spark, sf_dir, "documents"), width=4)), radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.importance import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.col("quality") == 1)


def op10_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.packing import pack

    found = pack(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.sharding import assign

    found = assign(_read(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.conversation_repair import damage, report

    turns = _read(spark, sf_dir, "conversations")
    return report(damage(turns), also=turns.select("conv_id"))


#: The CRC-32 of an ASCII string, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"

# A state is its cost in nine digits and its audit, so that states compare as strings.
_PLUS = "CASE WHEN {0} IS NOT NULL THEN lpad((left({0}, 9)::BIGINT + {1})::VARCHAR, 9, '0') || substr({0}, 10) || {2} END"
_ANY = "least(nothing, system, assistant)"


def _plus(state: str, cost: str | int, edit: str) -> str:
    return _PLUS.format(state, cost, f"'{edit}'")


OP12_SQL = rf"""
WITH RECURSIVE fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, copy, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, (VALUES (0), (1)) AS c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)
), turns AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS r,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '-' END AS fault
  FROM damaged
), steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, lpad('', 9, '0') AS nothing, NULL::VARCHAR AS system, '000000005I' AS usr, '000000010II' AS assistant FROM conversations
  UNION ALL
  SELECT conv_id, n, nothing, system, usr, least(assistant, {_plus('usr', 5, 'I')}) FROM (
    SELECT conv_id, n, nothing, system, least(usr, {_plus(_ANY, 5, 'I')}) AS usr, assistant FROM (
      SELECT t.conv_id, t.n, {_plus('s.nothing', 2, 'D')} AS nothing,
        least({_plus('s.system', 2, 'D')}, CASE WHEN r = 's' AND fault IN ('-', 't') THEN {_plus('s.nothing', "(fault = 't')::INT * 5", 'K')} END) AS system,
        least({_plus('s.usr', 2, 'D')}, CASE WHEN fault IN ('-', 't') THEN
          CASE WHEN r = 'u' THEN {_plus(_ANY, "(fault = 't')::INT * 5", 'K')} ELSE {_plus(_ANY, "(fault = 't')::INT * 5 + 1", 'R')} END END) AS usr,
        least({_plus('s.assistant', 2, 'D')}, CASE WHEN fault IN ('-', 't') THEN
          CASE WHEN r = 'a' THEN {_plus('s.usr', "(fault = 't')::INT * 5", 'K')} ELSE {_plus('s.usr', "(fault = 't')::INT * 5 + 1", 'R')} END END) AS assistant
      FROM steps s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.n = s.n + 1)))
, best AS (
  SELECT conv_id, arg_max(least(nothing, assistant), n) AS state FROM steps GROUP BY conv_id
), audits AS (
  SELECT conv_id, left(state, 9)::BIGINT AS cost, substr(state, 10) AS audit FROM best
), edits AS (
  SELECT conv_id, p, audit[p] AS edit,
    sum((audit[p] <> 'I')::INT) OVER w AS n, sum((audit[p] <> 'D')::INT) OVER w AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits)
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), placed AS (
  SELECT e.conv_id, p, edit, place, role, text, max((edit = 'K' AND r = 's')::INT) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.n = e.n
), mended AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
  FROM placed WHERE edit <> 'D' GROUP BY conv_id
), pairs AS (
  SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY n) || r AS pair FROM turns
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'b')::INT) AS blank, sum((fault = 'd')::INT) AS duplicate,
    sum((fault = 't')::INT) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM audits a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgrid.llm.prefix_trie import compact, prefix_trie, rebuild

    rows, convs = rebuild(compact(_read(spark, sf_dir, "conversations")))
    return prefix_trie(rows, convs).drop("turn_digest")


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, place, role, text FROM convs c JOIN turns t ON t.conv_id = base AND place < h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place >= h
), deep AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, role, text FROM rebuilt
), prefixes AS (
  SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM deep
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved FROM prefixes GROUP BY node, depth
), parents AS (
  SELECT n.*, u.node AS parent, u.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.node = p.node AND u.depth = p.depth
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY parent
), sums AS (
  SELECT p.node, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.node = n.node GROUP BY p.node
), ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM prefixes GROUP BY conv_id) GROUP BY node
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM parents LEFT JOIN children USING (node) JOIN sums USING (node) LEFT JOIN ends USING (node)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_permutation_index, op2_exact_dedup, op3_html_extraction, op4_pii_surrogates, op5_hierarchical_budgets, op6_warc_archives, op7_secret_scan, op8_simhash_near_dedup, op9_importance_resampling, op10_karmarkar_karp_packing, op11_lpt_sharding, op12_conversation_repair, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op6_warc_archives": OP6_SQL, "op12_conversation_repair": OP12_SQL, "op13_prefix_trie": OP13_SQL}
