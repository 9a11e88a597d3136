"""Registered queries of the training-data operators: each applies its operator,
with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import text_of
from tablelens.plans.common import load
from tablelens.plans.registry import _shipping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = _shipping(fn)
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return add


@query("op1_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, length(text) AS n, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""")
def op1_exact_dedup(spark, sf):
    from tablelens.llm.exact_dedup import dedup_groups
    return dedup_groups(load(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op2_token_count")
def op2_token_count(spark, sf):
    import public_tokenizers
    from tablelens.llm.token_count import count_tokens
    counts = count_tokens(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op3_language")
def op3_language(spark, sf):
    """Pages by all evidence, and documents by their texts and sources; taught by all labelled documents."""
    from tablelens.llm.language import identify, learn_text
    docs = load(spark, sf, "documents")
    model = learn_text(docs)
    pages = identify(load(spark, sf, "pages"), model).withColumn("page_id", F.col("id")).withColumn("doc_id", F.lit(None).cast("long"))
    texts = identify(docs, model, "doc_id", "source", "text", markup=False)
    texts = texts.withColumn("page_id", F.lit(None).cast("long")).withColumn("doc_id", F.col("id"))
    return pages.unionByName(texts).select("doc_id", "page_id", "lang", F.round("probability", 6).alias("probability"), "text_lang")


@query("op4_substring_dedup")
def op4_substring_dedup(spark, sf):
    from tablelens.llm.substring_dedup import remove_repeats
    return remove_repeats(load(spark, sf, "documents"), length=100).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_token_files")
def op5_token_files(spark, sf):
    import public_tokenizers
    from tablelens.llm.token_files import encoded_documents
    read = encoded_documents(load(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_simhash")
def op6_simhash(spark, sf):
    from tablelens.llm.simhash import near_duplicates
    groups = near_duplicates(load(spark, sf, "documents"), shingle=3, distance=3)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM x),
g AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS gram
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m)),
o AS (SELECT g.doc_id, g.i, g.m, x.item_id FROM g JOIN x ON g.gram = x.gram AND g.m = x.m),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op7_decontamination(spark, sf):
    from tablelens.llm.decontaminate import find_leaks
    leaks = find_leaks(load(spark, sf, "documents"), load(spark, sf, "benchmark"))
    return leaks.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_quality")
def op8_quality(spark, sf):
    from tablelens.llm.quality import fit_quality, held_out, score_quality
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    weights = fit_quality(docs, labels, "quality", ~held_out(F.col("doc_id")))
    return score_quality(docs.select("doc_id", "text"), weights).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM d GROUP BY source),
w AS (SELECT source, size, [3.0, 1.0, 2.0][position % 3 + 1]::DOUBLE AS weight, size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, ((SELECT sum(size) * 1.5::DOUBLE FROM s)
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT level FROM f WHERE weight * level <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, size AS source_size, least(weight * coalesce((SELECT level FROM l), 1e300), cap) AS target FROM w),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || d.doc_id), d.doc_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST((whole + CASE WHEN 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM m
""")
def op9_mixing(spark, sf):
    from tablelens.llm.mixing import mix
    return mix(load(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op10_sharding")
def op10_sharding(spark, sf):
    from tablelens.llm.sharding import assign_shards
    return assign_shards(load(spark, sf, "documents"), shards=40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of ASCII strings in SQL: a table of 256 steps, and the sum over the characters of ``{0}``.
CRC_TABLE = """(SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                          ORDER BY i) AS steps FROM range(256) t(i))"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))),
                           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""


@query("op11_periodic_runs", rf"""
WITH d AS (SELECT doc_id, w, len(w) AS n, coalesce({CRC.format("CAST(doc_id AS VARCHAR)")}, 1) AS h
           FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents), {CRC_TABLE}),
a AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM d),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
e AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word, unnest(list_transform(range(n), lambda i: w[i + 1:i + 8])) AS gram FROM v),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.gram = y.gram
      WHERE y.i > x.i AND 3 * (y.i - x.i) <= x.n AND len(x.gram) = 8),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM p) GROUP BY doc_id, q, part),
r AS (SELECT doc_id, start, length, min(q) AS q FROM s WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
k AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM e ANTI JOIN k USING (doc_id, i) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs,
             arg_min({{'start': start, 'length': length, 'q': q}}, {{'e': -length / q, 's': start, 'q': q}}) AS best FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.q AS period,
       CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
       sha256(coalesce(rest, '')) AS collapsed_sha256
FROM v LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def op11_periodic_runs(spark, sf):
    """The planted cycles of the contract, then the operator over all documents; digests of its runs and texts."""
    from tablelens.llm.periodic_runs import cycle_tail, find_runs
    docs = load(spark, sf, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    text = F.when((h % 10 == 0), cycle_tail(text_of("text"), g, 3 + g % 8)).otherwise(text_of("text"))
    found = find_runs(docs.select("doc_id", text.alias("text")))
    # greater exponent first: length / period compared as a fraction, then start, then period
    best = F.get(F.array_sort("runs", lambda x, y: F.coalesce(
        F.nullif(F.signum(y["length"] * x["period"] - x["length"] * y["period"]), F.lit(0.0)),
        F.nullif(F.signum(x["start"] - y["start"]), F.lit(0.0)), F.signum(x["period"] - y["period"])).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


@query("op12_piece_codec")
def op12_piece_codec(spark, sf):
    """Pieces with their spans and the decoded text; the spans cover a text but for what the normaliser drops."""
    import public_tokenizers
    from tablelens.llm.pieces import encode_pieces
    encoded = encode_pieces(load(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return encoded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("span_end"))


@query("op13_conversation_repair", rf"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
c AS (SELECT *, {CRC.format("name")} % 20 AS c FROM h, {CRC_TABLE}),
r AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
             CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
             regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM r),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd'
                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
n AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) AS n,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- the cheapest way to each state of the grammar (nothing, after s, after u, after a) before each row: least of cost, then audit
w AS (SELECT conv_id, 0 AS i, {{'k': 0, 'a': '', 'o': []::VARCHAR[]}} AS e, NULL::STRUCT(k BIGINT, a VARCHAR, o VARCHAR[]) AS s,
             NULL::STRUCT(k BIGINT, a VARCHAR, o VARCHAR[]) AS u, NULL::STRUCT(k BIGINT, a VARCHAR, o VARCHAR[]) AS a FROM n
      UNION ALL
      SELECT conv_id, i, z.e, z.s, z.u, z.a FROM (
        SELECT w.conv_id, f.i, f.fault, f.role, f.text, CASE WHEN f.fault = 't' THEN 1 ELSE 0 END AS t, left(f.role, 1) AS l, w.e, w.s,
               -- insertions in front of the row: at most two in turn
               list_min([x FOR x IN [w.u, {{'k': w.e.k + 2, 'a': w.e.a || 'I', 'o': list_append(w.e.o, 'user:')}},
                 {{'k': w.s.k + 2, 'a': w.s.a || 'I', 'o': list_append(w.s.o, 'user:')}},
                 {{'k': w.a.k + 2, 'a': w.a.a || 'I', 'o': list_append(w.a.o, 'user:')}}] IF x.k IS NOT NULL]) AS u,
               list_min([x FOR x IN [w.a, {{'k': w.u.k + 2, 'a': w.u.a || 'I', 'o': list_append(w.u.o, 'assistant:')}},
                 {{'k': w.e.k + 4, 'a': w.e.a || 'II', 'o': list_concat(w.e.o, ['user:', 'assistant:'])}},
                 {{'k': w.s.k + 4, 'a': w.s.a || 'II', 'o': list_concat(w.s.o, ['user:', 'assistant:'])}}] IF x.k IS NOT NULL]) AS a
        FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1) b,
      LATERAL (SELECT
        {{'k': b.e.k + 3, 'a': b.e.a || 'D', 'o': b.e.o}} AS e,
        list_min([x FOR x IN [{{'k': b.s.k + 3, 'a': b.s.a || 'D', 'o': b.s.o}},
          CASE WHEN b.fault NOT IN ('b', 'd') AND b.l = 's' THEN {{'k': b.e.k + b.t, 'a': b.e.a || 'K', 'o': list_append(b.e.o, b.role || ':' || b.text)}} END] IF x.k IS NOT NULL]) AS s,
        list_min([x FOR x IN [{{'k': b.u.k + 3, 'a': b.u.a || 'D', 'o': b.u.o}}] || (CASE WHEN b.fault IN ('b', 'd') THEN [] ELSE
          [{{'k': y.k + b.t + CASE WHEN b.l = 'u' THEN 0 ELSE 2 END, 'a': y.a || CASE WHEN b.l = 'u' THEN 'K' ELSE 'R' END,
             'o': list_append(y.o, CASE WHEN b.l = 'u' THEN b.role ELSE 'user' END || ':' || b.text)}} FOR y IN [b.e, b.s, b.a]] END) IF x.k IS NOT NULL]) AS u,
        list_min([x FOR x IN [{{'k': b.a.k + 3, 'a': b.a.a || 'D', 'o': b.a.o}}] || (CASE WHEN b.fault IN ('b', 'd') THEN [] ELSE
          [{{'k': y.k + b.t + CASE WHEN b.l = 'a' THEN 0 ELSE 2 END, 'a': y.a || CASE WHEN b.l = 'a' THEN 'K' ELSE 'R' END,
             'o': list_append(y.o, CASE WHEN b.l = 'a' THEN b.role ELSE 'assistant' END || ':' || b.text)}} FOR y IN [b.u]] END) IF x.k IS NOT NULL]) AS a) z),
l AS (SELECT w.conv_id, list_min([x FOR x IN [w.e, w.a, {{'k': w.u.k + 2, 'a': w.u.a || 'I', 'o': list_append(w.u.o, 'assistant:')}},
             {{'k': w.s.k + 4, 'a': w.s.a || 'II', 'o': list_concat(w.s.o, ['user:', 'assistant:'])}}] IF x.k IS NOT NULL]) AS best
      FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.k, 0) AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON d.conv_id IS NOT DISTINCT FROM n.conv_id
     LEFT JOIN l ON d.conv_id IS NOT DISTINCT FROM l.conv_id
""")
def op13_conversation_repair(spark, sf):
    """The contract's damage, then the operator over all conversations; those without rows left get the defined empty result."""
    from tablelens.llm.conversation_repair import repaired_parts, summaries
    turns = load(spark, sf, "conversations")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    damaged = (turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("c"))
               .where("c <> 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("c") == 3, 2).otherwise(1))))
               .select("conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", ""))
                       .otherwise(F.col("text")).alias("text")))
    found = summaries(repaired_parts(damaged))
    convs = turns.select("conv_id").distinct()
    joined = convs.join(found, convs.conv_id.eqNullSafe(found.conv), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
