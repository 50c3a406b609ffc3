"""Queries over the test tables, one for each training-data operator, and SQL that gives the same rows."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from tidebar.llm import chat as op2
from tidebar.llm import decontaminate as op4
from tidebar.llm import filter_audit as op12
from tidebar.llm import lexical as op11
from tidebar.llm import mixing as op6
from tidebar.llm import ngram_jaccard as op8
from tidebar.llm import packing as op13
from tidebar.llm import quality_model as op9
from tidebar.llm import quality_rules as op5
from tidebar.llm import sharding as op10
from tidebar.llm import substring_dedup as op1
from tidebar.llm import suffix_dedup as op3
from tidebar.llm import token_counts as op7
from tidebar.llm.common import table

QUERIES = {}
ORACLE_SQL = {}

#: The words of a text in DuckDB.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark, sf_dir):
    return op1.digest(op1.substring_dedup(table(spark, sf_dir, "documents")))


ORACLE_SQL["op1_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s),
d AS (SELECT g.doc_id, g.i FROM g JOIN f USING (s) WHERE f.first_doc < g.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM d, (SELECT unnest(range(13)) AS k)),
every_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t, count(*) AS n
         FROM every_word e ANTI JOIN gone x ON e.doc_id = x.doc_id AND e.i = x.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


@query
def op3_suffix_dedup(spark, sf_dir):
    return op3.digest(op3.suffix_dedup(table(spark, sf_dir, "documents")))


@query
def op8_ngram_jaccard(spark, sf_dir):
    return op8.jaccard_components(table(spark, sf_dir, "documents"))


#: Pairs are found through any shared shingle, and paths through links by repeated steps to the smallest id.
ORACLE_SQL["op8_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id
"""


@query
def op10_sharding(spark, sf_dir):
    return op10.shard(table(spark, sf_dir, "documents"), 40)


def _crc_table() -> list[int]:
    """What CRC-32 (polynomial EDB88320, reflected) makes of each byte."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


ORACLE_SQL["op10_sharding"] = f"""
WITH b AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST((strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1 AS BIGINT)) AS bytes
           FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
r AS (SELECT doc_id, md5(text) AS k, len(bytes) + {op10.ROW_BYTES} AS size,
             xor(4294967295::BIGINT, list_reduce(bytes, lambda c, x: xor([{', '.join(f'{x}::BIGINT' for x in _crc_table())}][(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS crc FROM b),
o AS (SELECT *, row_number() OVER w AS rank, CAST(sum(size) OVER w AS BIGINT) AS upto, CAST(2 * sum(size) OVER () + 39 AS BIGINT) // 40 AS cut FROM r WINDOW w AS (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT k, min(upto - size) AS lo, max(upto) AS hi, any_value(cut) AS c FROM o GROUP BY k),
p AS (SELECT k, (lo + hi) // c AS at FROM g WHERE 2 * lo // c < (2 * hi - 1) // c AND 2 * (hi - lo) <= {op10.WHOLE} * c),
s AS (SELECT o.*, CAST(coalesce(p.at, (2 * upto - size) // cut) AS INTEGER) AS shard FROM o LEFT JOIN p USING (k))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY rank) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


@query
def op6_mixing(spark, sf_dir):
    return op6.mix_plan(table(spark, sf_dir, "documents")).select(*op6.OUT)


ORACLE_SQL["op6_mixing"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len({SQL_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w, 2.0::DOUBLE * source_size AS most FROM s),
r AS (SELECT *, most / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT source, source_size, most, w, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) AS level FROM l),
a AS (SELECT source, source_size, coalesce(least(most, level * w), most) AS target FROM t),
k AS (SELECT d.doc_id, d.size, a.source_size, a.target,
             CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS each,
             CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS DOUBLE) AS rank
      FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(each * (rank + 1) + {op6.offset(17)!r}::DOUBLE) - floor(each * rank + {op6.offset(17)!r}::DOUBLE)) AS BIGINT) AS taken
FROM k
"""


@query
def op4_decontaminate(spark, sf_dir):
    return op4.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


_LOWER = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "CASE WHEN len({0}) >= 5 THEN list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], ' ')) ELSE [array_to_string({0}, ' ')] END"
#: Every window of an item's length that overlaps a shared shingle is scored; items below five words meet windows of their
#: own length whole.
ORACLE_SQL["op4_decontaminate"] = f"""
WITH i AS (SELECT item_id, ws, len(ws) AS n FROM (SELECT item_id, {_LOWER} AS ws FROM benchmark) WHERE len(ws) > 0),
ish AS (SELECT item_id, n, unnest(sh) AS s FROM (SELECT item_id, n, {_SHINGLES.format('ws')} AS sh FROM i)),
d AS (SELECT doc_id, ws FROM (SELECT doc_id, {_LOWER} AS ws FROM documents) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM i WHERE n < 5),
dsh AS (SELECT doc_id, unnest(sh) AS s, unnest(range(0, len(sh))) AS pos FROM (SELECT doc_id, {_SHINGLES.format('ws')} AS sh FROM d)
  UNION ALL SELECT doc_id, array_to_string(ws[k + 1:k + n], ' ') AS s, k AS pos FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS k FROM d, sizes WHERE len(ws) >= 5 AND len(ws) >= n)),
spot AS (SELECT DISTINCT doc_id, unnest(range(pos - greatest(n - 5, 0), pos + 1)) AS start, n FROM dsh JOIN (SELECT DISTINCT n, s FROM ish) m USING (s)),
win AS (SELECT doc_id, start, n, ws[greatest(start, 0) + 1:start + n] AS ww FROM spot JOIN d USING (doc_id)),
wsh AS (SELECT doc_id, start, n, len(ww) AS lw, {_SHINGLES.format('ww')} AS sh FROM win),
wc AS (SELECT doc_id, start, n, lw, s, count(*) AS c, any_value(total) AS total FROM (SELECT doc_id, start, n, lw, unnest(sh) AS s, len(sh) AS total FROM wsh) GROUP BY ALL),
ic AS (SELECT item_id, n, s, count(*) AS c, any_value(total) AS total FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS total FROM ish) GROUP BY item_id, n, s),
j AS (SELECT doc_id, item_id, start, lw, CAST(sum(least(wc.c, ic.c)) AS DOUBLE) AS inter, any_value(wc.total) AS tw, any_value(ic.total) AS ti FROM wc JOIN ic USING (n, s) GROUP BY doc_id, item_id, start, lw),
k AS (SELECT *, inter / (tw + ti - inter) AS similarity FROM j)
SELECT doc_id, item_id, CAST(greatest(start, 0) AS BIGINT) AS start_word, CAST(lw AS BIGINT) AS n_words, similarity
FROM k WHERE similarity >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


@query
def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    return op7.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_chat_format(spark, sf_dir):
    """Each row is a message that came in pieces: by its place it was streamed in two deltas, edited from another text,
    streamed anew after a wrong start, or logged whole. Conversation -7 has control strings in its texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    t = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    head, tail = t.substr(F.lit(1), half), t.substr(half + 1, F.length(t))
    event = lambda *steps: F.array(*(F.struct(F.lit(k).alias("n"), F.lit(kind).alias("kind"), x.alias("text")) for k, (kind, x) in enumerate(steps)))
    none = F.lit("")
    ways = [event(("message", none), ("delta", head), ("delta", tail)), event(("message", F.lit("draft")), ("edit", t)), event(("message", F.lit("bad")), ("regenerate", none), ("delta", head), ("delta", tail)), event(("message", t))]
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(ways)))
    logged = rows.unionByName(extra).withColumn("x", F.explode(F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])))
    events = logged.select("conv_id", F.col("turn").alias("message"), (F.col("turn").cast("long") * 8 + F.col("x.n")).alias("seq"), F.col("x.kind").alias("kind"), "role", F.col("x.text").alias("text"))
    return op2.digest(op2.format_chat(events))


ORACLE_SQL["op2_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '\0'), '</s>', '\1'), '[INST]', '\2'), '[/INST]', '\3'), '<<SYS>>', '\4'), '<</SYS>>', '\5') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(safe) + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = op5.fit(docs, table(spark, sf_dir, "labels"))
    return op5.judged(docs, rules).select("doc_id", *op5.BASE, "base_failed", "kept")


@query
def op9_quality_model(spark, sf_dir):
    """Grade 2: good and clean; 1: one of low quality and toxic; 0: both. Grade 2 is selected."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = op9.fit(docs, labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade")))
    return op9.score(docs, model, 2)


@query
def op12_filter_audit(spark, sf_dir):
    return op12.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Each kind of document goes through each order by itself: the filter that it fails first removes it.
ORACLE_SQL["op12_filter_audit"] = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {SQL_WORDS} AS ws, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents),
f AS (SELECT doc_id, part, concat(CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END,
             CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END,
             CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN again THEN 'E' ELSE '' END) AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
k AS (SELECT part, fails, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (SELECT unnest([{', '.join(f"'{''.join(p)}'" for p in permutations('ABCDE'))}]) AS filter_order),
x AS (SELECT *, list_min(list_transform(string_split(fails, ''), lambda c: CASE WHEN c = '' THEN 6 ELSE instr(filter_order, c) END)) AS pos FROM k, o),
s AS (SELECT *, filter_order[step] AS letter FROM x, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
c AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE coalesce(pos, 6) > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE pos = step), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE contains(fails, letter) AND pos < step), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE pos = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE pos = step), 0) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM c
"""


@query
def op13_packing(spark, sf_dir):
    import public_tokenizers

    return op13.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_lexical_search(spark, sf_dir):
    return op11.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Every document that shares a term with an item is scored in full.
ORACLE_SQL["op11_lexical_search"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
g AS (SELECT CAST(count(*) FILTER (WHERE len(ts) > 0) AS BIGINT) AS nn, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
q AS MATERIALIZED (SELECT i, item_id, unnest(list_distinct(ts)) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark)),
p AS MATERIALIZED (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) SEMI JOIN q USING (t) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ts) * nn) // l) AS m FROM d, g WHERE len(ts) > 0),
s AS (SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
