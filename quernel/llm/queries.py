"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.chat import reply_threads
from quernel.llm.decontamination import contamination, items_digest
from quernel.llm.fill_in_middle import fill_in_middle, restored
from quernel.llm.fingerprint import compare_with_next
from quernel.llm.html_text import extract_text
from quernel.llm.labels import in_fold
from quernel.llm.license_scan import scan_licenses
from quernel.llm.near_dedup import near_duplicates
from quernel.llm.packing import pack
from quernel.llm.quality import learn_quality, score_quality
from quernel.llm.ranked_search import ranked_search
from quernel.llm.substring_dedup import remove_repeats
from quernel.llm.toxicity import learn_lexicon, score_toxicity
from quernel.llm.url_filter import judge_urls

# The rules of the url query.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
# Hosts that are blocked where no rule fits.
URL_BLOCKED = tuple(f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), URL_RULES, blocked=URL_BLOCKED).select("page_id", "host", "path", "rule", "verdict")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op4_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_threads(_read(spark, sf_dir, "conversations"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = learn_quality(docs, _read(spark, sf_dir, "labels"), ~in_fold("doc_id", 5, 0))
    scored = score_quality(docs, model)
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = near_duplicates(_read(spark, sf_dir, "documents"), width=3, share=85, of=100)
    return flags.select("doc_id", "n_shingles", "component_id", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lexicon = learn_lexicon(docs, _read(spark, sf_dir, "labels"), ~in_fold("doc_id", 3, 1))
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    hit = F.col("n_hit")
    return found.select("doc_id", "n_words", hit, F.size("items").cast("long").alias("n_items"), items_digest().alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = compare_with_next(_read(spark, sf_dir, "documents"))
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", form, "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1 = f"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_AZ}) AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM q
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN path LIKE '/%' AND regexp_matches('.' || host, '\\.(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""

_OP4 = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, row_number() OVER () AS rid,
         string_split(replace(translate(coalesce(text, ''), chr(1) || chr(2), ''), chr(13) || chr(10), chr(10)), chr(10)) AS lines
  FROM conversations
), l AS (
  SELECT conv_id, turn, role, rid, i, lines[i] AS line,
         length(regexp_replace(regexp_extract(lines[i], '^((?:[ \t]?>)+)', 1), '[ \t]', '', 'g')) AS level
  FROM m, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
), n AS (
  SELECT *, CASE WHEN lag(level) OVER (PARTITION BY rid ORDER BY i) IS NOT DISTINCT FROM level THEN 0 ELSE 1 END AS starts FROM l
), k AS (
  SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY i) AS run FROM n
), runs AS (
  SELECT rid, conv_id, turn, level, run, string_agg(regexp_replace(line, '^((?:[ \t]?>)+)[ \t]?', ''), chr(10) ORDER BY i) AS text
  FROM k GROUP BY ALL
), sent AS (
  SELECT rid, conv_id, turn, level, unnest(string_split(regexp_replace(trim(lower(regexp_replace(text, '\s+', ' ', 'g'))), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS s FROM runs
), origin AS (
  SELECT conv_id, s, min(turn) AS origin FROM sent WHERE level = 0 AND s <> '' GROUP BY ALL
), links AS (
  SELECT q.conv_id, q.turn, q.level, o.origin, count(*) AS n
  FROM (SELECT DISTINCT conv_id, turn, level, s FROM sent WHERE level > 0 AND s <> '') q JOIN origin o USING (conv_id, s)
  WHERE o.origin < q.turn GROUP BY ALL
), answers AS (
  SELECT conv_id, turn, arg_max(origin, (-level, n, origin)) AS reply_to, sum(n)::BIGINT AS n_linked FROM links GROUP BY ALL
), chain AS (
  SELECT conv_id, turn, reply_to AS thread FROM answers
  UNION ALL
  SELECT c.conv_id, c.turn, a.reply_to FROM chain c JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.thread
), roots AS (
  SELECT conv_id, turn, min(thread) AS thread FROM chain GROUP BY ALL
), own AS (
  SELECT rid, coalesce(string_agg(text, chr(10) ORDER BY run) FILTER (level = 0), '') AS text, count(*) FILTER (level > 0) AS n_quoted FROM runs GROUP BY rid
)
SELECT m.conv_id, m.turn, m.role, own.text, a.reply_to, coalesce(r.thread, m.turn) AS thread, own.n_quoted, coalesce(a.n_linked, 0) AS n_linked,
       '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || own.text || chr(10) || '<|end|>' || chr(10) AS formatted
FROM m JOIN own USING (rid) LEFT JOIN answers a ON a.conv_id = m.conv_id AND a.turn = m.turn LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn
"""

_OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 1))) AS i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sets AS (
  SELECT doc_id, n, md5(string_agg(g, chr(0) ORDER BY g)) AS h FROM s JOIN n USING (doc_id) GROUP BY doc_id, n
), rep AS (
  SELECT h, n, min(doc_id) AS rep FROM sets GROUP BY h, n
), rs AS (
  SELECT s.doc_id, s.g FROM s JOIN rep ON rep.rep = s.doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS v, a AS r FROM e UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.r
), comp AS (
  SELECT v, min(r) AS c FROM reach GROUP BY v
)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(comp.c, rep.rep, d.doc_id) AS component_id,
       d.doc_id = coalesce(comp.c, rep.rep, d.doc_id) AS kept
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN rep ON rep.h = sets.h AND rep.n = sets.n LEFT JOIN comp ON comp.v = rep.rep
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_OP9 = rf"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORDS}) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORDS}) AS w FROM documents
), lens AS (
  SELECT DISTINCT n FROM win
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
), met AS (
  SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.g = dw.g
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_OP11 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_TERMS}) AS w FROM documents
), size AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_TERMS})) AS term FROM benchmark
), post AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM post SEMI JOIN asked USING (term) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), size GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

_OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), x AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS m,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x
), o AS (
  SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, m - p) AS middle, substr(t, m + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_url_filter, op2_license_scan, op3_best_fit_packing, op4_chat_threads, op5_quality, op6_near_dedup, op7_substring_dedup, op8_toxicity, op9_decontamination, op10_fingerprints,
                  op11_ranked_search, op12_fill_in_middle, op13_html_text)
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op4_chat_threads": _OP4, "op6_near_dedup": _OP6, "op9_decontamination": _OP9, "op11_ranked_search": _OP11, "op12_fill_in_middle": _OP12}
