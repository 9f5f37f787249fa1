"""Ingestion, preparation, sampling, batching and function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T, vision as I
from ..functions.order import global_index
from ..operators import batching as B, examples as E, rows as O, tokens as K
from .registry import Tables, query

_MD5 = "md5(concat_ws('|', '{seed}', {key}))"


def _md5(key: str, seed: int = 0) -> str:
    return _MD5.format(seed=seed, key=key)


# -- dedup, filters, joins -------------------------------------------------------------


@query("SELECT md5(text) AS content, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def doc_dedup_md5(t):
    return O.dedup_content(t.documents.select("doc_id", "text"), "text", ["doc_id"]).select(F.md5("text").alias("content"), "doc_id")


@query("SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def doc_dedup_by_id(t):
    return O.keep_last(t.documents.select("source", "doc_id"), ["source"], ["doc_id"])


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def doc_lang_filter(t):
    return t.documents.where("lang = 'en'").select("doc_id", "n_chars")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 1000")
def doc_length_threshold(t):
    return O.long_enough(t.documents, 1000)[0].select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents WHERE text IS NULL OR length(text) < 1000 GROUP BY lang")
def doc_short_report(t):
    return O.long_enough(t.documents, 1000)[1].groupBy("lang").agg(F.count("*").alias("n"))


_CLASSED = "c AS (SELECT doc_id, CASE quality WHEN 1 THEN 'A' ELSE 'B' END AS response FROM labels)"


def _classes(t: Tables):
    return t.labels.select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("B").alias("response"))


@query(f"WITH {_CLASSED} SELECT doc_id, response, n_chars FROM documents JOIN c USING (doc_id) WHERE response <> 'B'")
def class_filter_drop_b(t):
    return O.drop_class(O.lookup(t.documents, _classes(t), ["doc_id"], ["response"])[0], "B").select("doc_id", "response", "n_chars")


@query(f"WITH {_CLASSED} SELECT source, count(*) AS n FROM documents JOIN c USING (doc_id) WHERE response = 'A' GROUP BY source")
def class_filter_keep_a(t):
    return O.keep_class(O.lookup(t.documents, _classes(t), ["doc_id"], ["response"])[0], "A").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS missed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def class_join_miss_count(t):
    return O.lookup(t.documents, _classes(t), ["doc_id"], ["response"])[1].groupBy("lang").agg(F.count("*").alias("missed"))


@query("SELECT q.conv_id, q.turn, length(a.text) AS answer_chars FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def answer_join(t):
    c = t.conversations
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return O.lookup(c.where("role = 'user'"), answers, ["conv_id", "turn"], ["answer"])[0].select("conv_id", "turn", F.length("answer").cast("long").alias("answer_chars"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def worklist_antijoin(t):
    return O.worklist(t.documents, t.labels, ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_ids(t):
    return t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_ids(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("SELECT doc_id, 'd' AS origin FROM documents UNION ALL SELECT item_id, 'b' FROM benchmark")
def union_shards(t):
    return t.documents.select("doc_id", F.lit("d").alias("origin")).unionByName(t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit("b").alias("origin")))


# -- numbering -------------------------------------------------------------------------


@query("SELECT conv_id, turn, conv_id || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS qid FROM conversations")
def qid_assign(t):
    return O.ordinal_ids(t.conversations, "conv_id", ["turn"]).select("conv_id", "turn", "qid")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS id FROM documents")
def global_ids(t):
    return global_index(t.documents.select("doc_id", "source"), [F.col("source"), F.col("doc_id")], "id").select("doc_id", "id")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents), b AS (SELECT doc_id AS label_id, row_number() OVER (ORDER BY doc_id DESC) AS i FROM labels)
SELECT doc_id, label_id FROM a JOIN b USING (i)""")
def positional_zip(t):
    return O.zip_rows(t.documents.select("doc_id"), t.labels.select(F.col("doc_id").alias("label_id")), [F.col("doc_id")], [F.col("label_id").desc()])


# -- text functions --------------------------------------------------------------------


@query("SELECT doc_id, 'Title: ' || source || ' [' || lang || '] ' || text AS prompt FROM documents")
def template_fill(t):
    d = t.documents.select("doc_id", F.struct("source", "lang").alias("meta"), "text")
    return d.select("doc_id", T.fill_template(d, "Title: <meta.source> [<meta.lang>] <text>").alias("prompt"))


@query("SELECT doc_id, regexp_extract_all('<' || source || '> ' || replace(replace(text, 'an', '<'), 'on', '.x>') || ' <' || lang || '>', '<([^>]*)>', 1) AS names FROM documents")
def template_markers(t):
    """Templates made of whole texts."""
    text = F.replace(F.replace(F.col("text"), F.lit("an"), F.lit("<")), F.lit("on"), F.lit(".x>"))
    return t.documents.select("doc_id", T.markers(F.concat(F.lit("<"), "source", F.lit("> "), text, F.lit(" <"), "lang", F.lit(">"))).alias("names"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN source ELSE doc_id::VARCHAR END AS key, count(*) AS n FROM documents GROUP BY 1")
def coalesce_id(t):
    d = t.documents.select(F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("_id"), F.col("doc_id").alias("id"))
    return d.select(T.doc_key(d).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'Find: ' || coalesce(text, '') AS joined, 'Find ' || coalesce(text, '') AS spaced FROM documents")
def instruction_merge(t):
    return t.documents.select("doc_id", T.with_instruction(F.lit("Find: "), F.col("text")).alias("joined"), T.with_instruction(F.lit("Find"), F.col("text"), " ").alias("spaced"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR text = '' THEN 'empty document' ELSE text END AS text FROM documents")
def empty_fallback(t):
    text = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))
    return t.documents.select("doc_id", T.or_empty(text, F.lit(None).cast("string")).alias("text"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'b' END, 'a' || doc_id) AS image FROM documents")
def image_alias(t):
    d = t.documents.select("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("image"), F.when(F.col("doc_id") % 2 == 0, "b").alias("image_base64"))
    return d.select("doc_id", T.image_of(d).alias("image"))


@query("SELECT doc_id, base64(encode(text)) AS coded, text FROM documents")
def base64_roundtrip(t):
    coded = T.to_base64(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", coded.alias("coded"), F.decode(F.unbase64(coded), "UTF-8").alias("text"))


@query("SELECT page_id, list_aggregate([p[-3], p[-2] || '_', p[-1]], 'string_agg', '_') AS id, p[-1] AS base FROM (SELECT page_id, string_split('x/y/' || url, '/') AS p FROM pages)")
def url_ids(t):
    url = F.concat(F.lit("x/y/"), "url")
    return t.pages.select("page_id", T.url_doc_id(url).alias("id"), T.base_name(url).alias("base"))


@query("SELECT doc_id, source || '_p' AS collection, doc_id::INTEGER AS page FROM documents")
def collection_page_split(t):
    key = F.concat(F.col("source"), F.lit("_p_"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", T.collection_of(key).alias("collection"), T.page_of(key).alias("page"))


@query("SELECT doc_id, 'jpg_ori_' || doc_id AS name FROM documents")
def strip_suffix(t):
    return t.documents.select("doc_id", T.without_suffix(F.concat(F.lit("jpg_ori_"), F.col("doc_id").cast("string"), F.lit("_ori.jpg")), "_ori.jpg").alias("name"))




def _responses(t: Tables):
    e = F.col("event_id") % 3
    return t.events.select("event_id", F.when(e == 0, F.concat(F.lit("x ```json\n"), "props", F.lit("\n``` y"))).when(e == 1, F.concat(F.lit("pre "), "props", F.lit(" post"))).otherwise("none").alias("r"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS json FROM events")
def fenced_json(t):
    return _responses(t).select("event_id", T.fenced_json(F.col("r")).alias("json"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS json FROM events")
def brace_json(t):
    return _responses(t).select("event_id", T.brace_json(F.col("r")).alias("json"))


@query("SELECT event_id, coalesce(json_extract_string(j, '$.query'), json_extract_string(j, '$.QUERY')) AS q FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"query\": \"a' || event_id || '\"}' ELSE '{\"QUERY\": \"b' || event_id || '\"}' END AS j FROM events)")
def json_any_case(t):
    j = F.when(F.col("event_id") % 2 == 0, F.format_string('{"query": "a%d"}', "event_id")).otherwise(F.format_string('{"QUERY": "b%d"}', "event_id"))
    return t.events.select("event_id", T.any_case(j, "query").alias("q"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS value FROM documents")
def first_key_like(t):
    m = F.create_map(F.lit("other"), F.lit("x"), F.when(F.col("doc_id") % 2 == 0, "my_ocr_type_a").otherwise("none"), F.col("lang"), F.lit("ocr_type_b"), F.col("source"))
    return t.documents.select("doc_id", T.first_key_like(m, "ocr_type").alias("value"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS ws FROM documents),
r AS (SELECT doc_id, list_reduce(list_concat([{'d': '', 'l': ''}], list_transform(ws, lambda x: {'d': '', 'l': x})),
  lambda a, b: CASE WHEN length(a.l) + length(b.l) + 1 <= 40 THEN {'d': a.d, 'l': a.l || ' ' || b.l} ELSE {'d': a.d || trim(a.l) || '|', 'l': b.l} END) AS r FROM w)
SELECT doc_id, md5(r.d || trim(r.l)) AS wrapped FROM r""")
def word_wrap(t):
    return t.documents.select("doc_id", F.md5(F.array_join(T.wrap(F.coalesce("text", F.lit("")), 40), "|")).alias("wrapped"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::DOUBLE ELSE 'inf'::DOUBLE END AS k, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def natural_order(t):
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("x"), F.lit(" page"))
    d = t.documents.select("doc_id", T.leading_int(name).alias("k"), T.natural_key(F.concat(F.lit("Page"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("n"))
    return global_index(d, [F.col("n")], "place").select("doc_id", "k", "place")


@query("SELECT doc_id, 'Is this a question? ' || text || ' #' AS prompt FROM documents")
def prompt_fill(t):
    return t.documents.select("doc_id", T.fill_prompt("Is this a question? {passage} #", F.col("text")).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END || chr(9) || text AS body FROM documents")
def title_body(t):
    return t.documents.select("doc_id", T.title_body(F.when(F.col("doc_id") % 4 != 0, F.col("source")), F.col("text")).alias("body"))


@query("SELECT label, format('{:<25}{:<8}{:.4f}', 'n', label::VARCHAR, count(*)::DOUBLE) AS line FROM embeddings GROUP BY label")
def metric_lines(t):
    n = t.embeddings.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    return n.select("label", T.metric_line(F.lit("n"), F.col("label").cast("string"), F.col("n")).alias("line"))


@query("SELECT p_partkey, p_name FROM part WHERE (p_name GLOB '*ring' OR p_name GLOB '[hn]e[vw]*' OR p_name GLOB '?o[lt]* g*') AND NOT (p_name GLOB 'cold*' OR p_name GLOB 'red*')")
def glob_filter(t):
    name = F.col("p_name")
    return t.part.where(T.any_glob(name, ["*ring", "[hn]e[vw]*", "?o[lt]* g*"]) & ~T.any_glob(name, ["cold*", "red*"])).select("p_partkey", "p_name")


@query("SELECT lang, label, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) JOIN (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish')) v(lang, label) USING (lang)")
def label_lookup(t):
    labels = t.spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish")], "lang string, label string")
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(labels), "lang")


# -- validation ------------------------------------------------------------------------



@query("""SELECT error, count(*) AS n FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'type5' WHEN 1 THEN 'type4' WHEN 2 THEN 'type1' WHEN 3 THEN 'type2' WHEN 4 THEN 'type2' END AS error FROM events) GROUP BY error""")
def json_error_taxonomy(t):
    e = F.col("event_id") % 7
    r = F.when(e == 0, F.lit(None).cast("string")).when(e == 1, "{bad").when(e == 2, '{"x": 1}').when(e == 3, '{"result": []}').when(e == 4, '{"result": 5}').otherwise(F.concat(F.lit('{"result": ['), "props", F.lit("]}")))
    return t.events.select(O.response_error(r).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


#: One line for each rule, and what it breaks.
EXAMPLES = (
    ('{"query": ', "V1"), ('{"index": 3, "query": {"text": "q"}, "pos": [{"text": "a", "image": null}]}', None), ('{"query": {"text": 5}, "pos": [{"text": "a"}]}', "V3"), ('{"query": "q", "pos": [{"text": "a"}]}', "V3"),
    ('{"query": {"text": "q"}, "pos": []}', "V4"), ('{"query": {"text": "q"}, "pos": {"text": "a"}}', "V4"), ('{"query": {"text": "q"}, "pos": [{"text": "a", "image": "b"}]}', "V5"), ('{"query": {"text": "q"}, "pos": [{"text": "", "image": null}]}', "V5"),
    ('{"query": {"text": "q"}, "pos": [{"text": 7, "image": null}]}', "V6"),
)


@query("SELECT error, count(*) AS n, sum(idx)::BIGINT AS idx FROM (SELECT (['V1', NULL, 'V3', 'V3', 'V4', 'V4', 'V5', 'V5', 'V6'])[event_id % 9 + 1] AS error, CASE event_id % 9 WHEN 1 THEN 3 ELSE 0 END AS idx FROM events) GROUP BY error")
def row_validator(t):
    line = F.get(F.array(*[F.lit(x) for x, _ in EXAMPLES]), (F.col("event_id") % len(EXAMPLES)).cast("int"))
    rows = t.events.select(O.example_error(line).alias("error"), O.repaired_index(line).alias("idx"))
    return rows.groupBy("error").agg(F.count("*").alias("n"), F.sum("idx").alias("idx"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) % 40 < 3)) > 0")
def visual_pages(t):
    """The lines of a page end with what they are, here by their lengths."""
    kinds = F.array(*map(F.lit, ("figure", "in_table", "equation")))
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.lit(" "), F.coalesce(F.get(kinds, F.char_length(x) % 40), F.lit("paragraph")), F.lit(" ")))
    return t.documents.where(O.is_visual(lines)).select("doc_id", F.length("text").cast("long").alias("n"))


# -- explode and arrays ----------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS pages FROM conversations GROUP BY conv_id)
SELECT conv_id, len(pages) - len([x for x in [1, 3] if x <= len(pages)]) AS negatives FROM c""")
def negatives_except_evidence(t):
    c = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("pages"))
    return c.select("conv_id", F.size(O.all_but(F.col("pages"), F.array(F.lit(1), F.lit(3)))).cast("long").alias("negatives"))


@query("SELECT conv_id, turn AS page FROM conversations WHERE role = 'assistant'")
def evidence_fanout(t):
    c = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("evidence"))
    return c.select("conv_id", F.explode("evidence").alias("page"))


#: Documents in groups of 16 by id: what an example or a batch gathers is bounded, whatever a source holds.
_GROUPS = "(SELECT doc_id, lang, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS source FROM documents)"


def _groups(t: Tables) -> DataFrame:
    return B.fixed_chunks(t.documents.select("doc_id", "lang"), [F.col("doc_id")], 16, "source")


@query(f"WITH c AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM {_GROUPS} GROUP BY source) SELECT source, unnest(list_concat(ids, ids)[3 % len(ids) + 1 : 3 % len(ids) + 4]) AS doc_id FROM c")
def rotate_window(t):
    c = _groups(t).groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return c.select("source", F.explode(O.rotate(F.col("ids"), F.lit(3), 4)).alias("doc_id"))


@query(f"WITH c AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM {_GROUPS} GROUP BY source) SELECT source, ids[17 % len(ids) + 1] AS picked, list_sum(ids[1:3])::BIGINT AS head FROM c")
def pick_negative(t):
    c = _groups(t).groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return c.select("source", O.pick(F.col("ids"), F.lit(17)).alias("picked"), F.aggregate(F.slice("ids", 1, 3), F.lit(0).cast("long"), lambda s, x: s + x).alias("head"))


@query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def collate_roundtrip(t):
    c = t.conversations.groupBy("conv_id").agg(F.collect_list("turn").alias("turn"), F.collect_list(F.length("text").cast("long")).alias("n"))
    return c.select("conv_id", F.inline(F.arrays_zip("turn", "n")))


# -- tiers, chunks, splits, samples ----------------------------------------------------


@query("""SELECT source, count_if(lang = 'en') AS n_visual, count_if(lang <> 'en') AS n_textual,
CASE WHEN count_if(lang = 'en') / count(*) > 0.6 THEN 'visual' ELSE 'textual' END AS tier FROM documents GROUP BY source""")
def tier_by_share(t):
    return O.tiers(t.documents.select("source", (F.col("lang") == "en").alias("visual")), "source", "visual", 0.6)


@query("""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p FROM documents),
u AS (SELECT source, unnest(range(0, max(p) // 4 + 1)) AS i FROM p GROUP BY source),
l AS (SELECT source, i, ('0x' || substr(md5(concat_ws('|', '0', source, i)), 1, 8))::BIGINT / 4294967296.0 AS u FROM u),
k AS (SELECT source, i, CASE WHEN u < 0.2 THEN 4 WHEN u < 0.5 THEN 5 ELSE 6 END AS n FROM l),
e AS (SELECT source, i, sum(n) OVER (PARTITION BY source ORDER BY i) AS e FROM k)
SELECT p.source, doc_id, count_if(e <= p) AS chunk FROM p JOIN e ON e.source = p.source GROUP BY p.source, doc_id, p""")
def chunk_variable(t):
    return O.variable_chunks(t.documents.select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "chunk")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS chunk FROM documents")
def chunk_fixed(t):
    return B.fixed_chunks(t.documents.select("doc_id"), [F.col("doc_id")])


@query("""WITH b AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
SELECT doc_id, CASE WHEN b < 100000 THEN 0 ELSE 1 END AS split FROM b WHERE b < 300000""")
def cumulative_split(t):
    return O.cumulative_split(t.documents.select("doc_id", "n_chars"), "n_chars", [100000, 300000], [F.col("doc_id")]).select("doc_id", "split")


@query(f"SELECT doc_id FROM documents ORDER BY {_md5('doc_id')}, doc_id LIMIT 100")
def sample_n(t):
    return O.sample_n(t.documents.select("doc_id"), 100, ["doc_id"])


@query(f"WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5('doc_id', 7)}, doc_id) - 1 AS i FROM documents) SELECT doc_id, CASE WHEN i < 100 THEN 0 ELSE 1 END AS split FROM i WHERE i < 150")
def split_bands(t):
    return O.split_bands(t.documents.select("doc_id"), [100, 50], ["doc_id"], 7)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 4)::INTEGER AS shard FROM documents")
def round_robin_shard(t):
    return O.round_robin(t.documents.select("doc_id"), [F.col("doc_id")], 4)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 16 % 4)::INTEGER AS shard FROM documents")
def block_cyclic_shard(t):
    return O.block_cyclic(t.documents.select("doc_id"), [F.col("doc_id")], 16, 4)


_PADDED = """WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
r AS (SELECT doc_id, i * {k} + unnest(range(0, {k})) AS position, n * {k} AS total FROM i),
a AS (SELECT doc_id, position FROM r UNION ALL SELECT doc_id, position + total FROM r WHERE position < (7 - total % 7) % 7)
SELECT doc_id, position, (position % 7)::INTEGER AS shard FROM a"""


@query(_PADDED.format(k=1))
def ordered_sampler_pad(t):
    return O.padded_shards(t.documents.select("doc_id"), [F.col("doc_id")], 7)


@query(_PADDED.format(k=3) + " WHERE position // 7 < (SELECT count(*) // 256 * 256 // 7 FROM documents)")
def repeat_sampler(t):
    docs = t.documents.select("doc_id")
    return O.padded_shards(docs, [F.col("doc_id")], 7, repeats=3, selected=O.selected_repeats(docs.count(), 7))


@query("""WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier),
o AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal * (s_suppkey % 3) DESC, s_suppkey) AS test_rank FROM supplier)
SELECT s_suppkey, test_rank, r AS base_rank, CASE WHEN r = test_rank THEN '0' WHEN r > test_rank THEN '+' || (r - test_rank) ELSE (r - test_rank)::VARCHAR END AS difference FROM o JOIN b USING (s_suppkey)""")
def rank_diff(t):
    s = t.supplier
    return O.rank_difference(s.select("s_suppkey", F.col("s_acctbal").alias("v")), s.select("s_suppkey", (F.col("s_acctbal") * (F.col("s_suppkey") % 3)).alias("v")), "s_suppkey", "v")


@query("SELECT c_nationkey, c_custkey, place FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5")
def best_n_per_group(t):
    return O.best_n(t.customer, ["c_nationkey"], "c_acctbal", 5, tie="c_custkey").select("c_nationkey", "c_custkey", F.col("place").cast("long").alias("place"))


# -- batches ---------------------------------------------------------------------------

_ROW = "md5(concat_ws('|', '0', event_id))"


def _allocate_sql(size: int) -> str:
    """No key of the table has more rows than there are batches."""
    return f"""n AS (SELECT count(*) // {size} AS b FROM events),
p AS (SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, {_ROW}, event_id) - 1 AS p FROM events),
a AS (SELECT event_id, user_id, p % b AS batch_id, p FROM p, n),
alloc AS (SELECT event_id, user_id, batch_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY p) AS r FROM a) WHERE r <= {size})"""


def _allocated(t: Tables, size: int = 32):
    return B.allocate(t.events.select("event_id", "user_id"), "user_id", ["event_id"], size)


@query(f"WITH {_allocate_sql(32)} SELECT event_id, user_id, batch_id FROM alloc")
def batch_allocate(t):
    return _allocated(t).select("event_id", "user_id", "batch_id")


@query("""WITH n AS (SELECT count(*) // 128 AS b FROM lineitem),
p AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS p FROM lineitem)
SELECT batch_id, count(*) AS n, count(DISTINCT l_partkey) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY p) AS r FROM (SELECT l_partkey, p, p % b AS batch_id FROM p, n)) WHERE r <= 128 GROUP BY batch_id""")
def batch_allocate_lineitem(t):
    rows = B.allocate(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("keys"))


@query("SELECT source, n FROM (SELECT l_orderkey AS source, count(*) AS n FROM lineitem GROUP BY 1) WHERE n = 4")
def batch_full_only(t):
    full = B.full_only(t.lineitem.select(F.col("l_orderkey").alias("source")), "source", 4)
    return full.groupBy("source").agg(F.count("*").alias("n"))


@query(f"""WITH {_allocate_sql(32)}, o AS (SELECT batch_id, row_number() OVER (ORDER BY {_md5('batch_id', 3)}, batch_id) - 1 AS position FROM (SELECT DISTINCT batch_id FROM alloc))
SELECT event_id, batch_id, position FROM alloc JOIN o USING (batch_id)""")
def batch_shuffle(t):
    return B.shuffle_batches(_allocated(t), seed=3).select("event_id", "batch_id", "position")


@query(f"""WITH {_allocate_sql(32)}, k AS (SELECT DISTINCT 'events' AS dataset, batch_id FROM alloc UNION SELECT DISTINCT 'documents', doc_id // 128 FROM documents),
o AS (SELECT dataset, batch_id, row_number() OVER (ORDER BY {_md5("dataset, batch_id", 5)}, dataset, batch_id) - 1 AS position FROM k),
r AS (SELECT 'events' AS dataset, batch_id, event_id AS id FROM alloc UNION ALL SELECT 'documents', doc_id // 128, doc_id FROM documents)
SELECT dataset, batch_id, position, id FROM r JOIN o USING (dataset, batch_id)""")
def batch_mix(t):
    docs = t.documents.select(F.floor(F.col("doc_id") / 128).alias("batch_id"), F.col("doc_id").alias("id"))
    return B.mix({"events": _allocated(t).select("batch_id", F.col("event_id").alias("id")), "documents": docs}, seed=5).select("dataset", "batch_id", "position", "id")


# -- page images -----------------------------------------------------------------------

_WH = "SELECT p_partkey, 200 + p_partkey * 37 % 2800 AS w, 200 + p_partkey * 91 % 2300 AS h FROM part"


def _sizes(t: Tables):
    return t.part.select("p_partkey", (200 + F.col("p_partkey") * 37 % 2800).alias("w"), (200 + F.col("p_partkey") * 91 % 2300).alias("h"))


@query(f"SELECT p_partkey, CASE WHEN w < 1500 OR h < 1500 THEN floor(2250000.0::DOUBLE / (w * h) * 300) ELSE 300 END::BIGINT AS dpi FROM ({_WH})")
def render_dpi(t):
    return _sizes(t).select("p_partkey", I.render_dpi(F.col("w"), F.col("h")).alias("dpi"))


@query(f"""WITH s AS ({_WH}), n AS (SELECT *, least(ceil(w::DOUBLE * h / (448 * 448)), 9)::INT AS n FROM s),
g AS (SELECT k, x, k // x AS y, row_number() OVER (ORDER BY k, x) AS o FROM (SELECT unnest(range(2, 10)) AS k), (SELECT unnest(range(1, 10)) AS x) WHERE x <= k AND k % x = 0),
b AS (SELECT p_partkey, arg_min(x, (abs(ln(w::DOUBLE / h) - ln(x::DOUBLE / y)), o)) AS x, arg_min(y, (abs(ln(w::DOUBLE / h) - ln(x::DOUBLE / y)), o)) AS y FROM n JOIN g ON abs(k - n) <= 1 WHERE n > 1 GROUP BY p_partkey)
SELECT p_partkey, n::INTEGER AS n, x::INTEGER AS x, y::INTEGER AS y FROM n LEFT JOIN b USING (p_partkey)""")
def slice_plan(t):
    w, h = F.col("w"), F.col("h")
    return _sizes(t).select("p_partkey", I.slice_count(w, h).alias("n"), I.slice_grid(w, h).alias("g")).select("p_partkey", "n", F.col("g.x").alias("x"), F.col("g.y").alias("y"))


_DIV = "greatest(round_even({} / {}, 0) * {}, {})"


@query(f"""WITH s AS (SELECT p_partkey, w::DOUBLE AS w, h::DOUBLE AS h FROM ({_WH})), r AS (SELECT *, floor(448 / sqrt(w / h)) AS nh FROM s), c AS (SELECT *, w * h > 448 * 448 AS big, floor(nh * (w / h)) AS nw FROM r)
SELECT p_partkey, {_DIV.format('(CASE WHEN big THEN nw ELSE w END)', 14, 14, 14)}::BIGINT AS rw, {_DIV.format('(CASE WHEN big THEN nh ELSE h END)', 14, 14, 14)}::BIGINT AS rh FROM c""")
def best_resize(t):
    return _sizes(t).select("p_partkey", I.best_resize(F.col("w"), F.col("h")).alias("r")).select("p_partkey", F.col("r.w").alias("rw"), F.col("r.h").alias("rh"))


@query(f"""WITH s AS (SELECT p_partkey, {_DIV.format('w::DOUBLE', 2, 2, 2)} / 2 AS w, {_DIV.format('h::DOUBLE', 3, 3, 3)} / 3 AS h FROM ({_WH})), r AS (SELECT *, floor(448 / sqrt(w / h)) AS nh FROM s), c AS (SELECT *, floor(nh * (w / h)) AS nw FROM r)
SELECT p_partkey, ({_DIV.format('nw', 14, 14, 14)} * 2)::BIGINT AS rw, ({_DIV.format('nh', 14, 14, 14)} * 3)::BIGINT AS rh FROM c""")
def refine_size(t):
    return _sizes(t).select("p_partkey", I.refine_size(F.col("w"), F.col("h"), F.lit(2), F.lit(3)).alias("r")).select("p_partkey", F.col("r.w").alias("rw"), F.col("r.h").alias("rh"))


@query(f"""WITH s AS ({_WH}), b AS (SELECT p_partkey, w, h, w // 2 AS dx, h // 3 AS dy FROM s)
SELECT p_partkey, (ceil(w / dx) * ceil(h / dy))::BIGINT AS boxes, ((ceil(w / dx) - 1) * dx + dx)::BIGINT AS far FROM b""")
def patch_grid(t):
    b = _sizes(t).select("p_partkey", I.patch_boxes(F.col("w"), F.col("h"), F.lit(2), F.lit(3)).alias("b"))
    return b.select("p_partkey", F.size("b").cast("long").alias("boxes"), F.array_max(F.transform("b", lambda x: x.right)).cast("long").alias("far"))


_IDS = "list_transform(range(0, 5 + vec_id % 7), lambda i: (vec_id * (i + 3)) % 6)"


def _tokens(t: Tables):
    n = 5 + F.col("vec_id") % 7
    return t.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: (F.col("vec_id") * (i + 3) % 6).cast("int")).alias("ids"))


@query(f"SELECT vec_id, array_to_string(list_resize(ids, 12, 0), ' ') AS ids, len(ids) AS n FROM (SELECT vec_id, {_IDS} AS ids FROM embeddings)")
def pad_ids(t):
    r = _tokens(t).select("vec_id", I.pad_right(F.col("ids"), F.lit(12)).alias("ids"), I.attention_mask(F.col("ids"), F.lit(12)).alias("m"))
    return r.select("vec_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))


@query(f"""WITH i AS (SELECT vec_id, {_IDS} AS ids FROM embeddings), p AS (SELECT vec_id, ids, list_filter(range(1, len(ids) + 1), lambda k: ids[k] = 1) AS s, list_filter(range(1, len(ids) + 1), lambda k: ids[k] = 2) AS e FROM i)
SELECT vec_id, k AS pair, s[k] AS start, e[k] - 1 AS stop FROM (SELECT vec_id, s, e, unnest(range(1, least(len(s), len(e)) + 1)) AS k FROM p)""")
def image_bounds(t):
    r = _tokens(t).select("vec_id", F.posexplode(I.image_bounds(F.col("ids"), 1, 2)).alias("k", "b"))
    return r.select("vec_id", (F.col("k") + 1).cast("long").alias("pair"), F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("stop"))


@query(f"""WITH z AS (SELECT vec_id, list_filter({_IDS}, lambda x: x <> 0) AS ids FROM embeddings), b AS (SELECT vec_id, CASE WHEN ids[1] = 1 THEN ids[2:] ELSE ids END AS ids FROM z)
SELECT vec_id, array_to_string(CASE WHEN ids[-1] = 2 THEN ids[1 : len(ids) - 1] ELSE ids END, ' ') AS ids FROM b""")
def clean_ids(t):
    r = _tokens(t).select("vec_id", I.clean_ids(F.col("ids"), 1, 2).alias("ids"))
    return r.select("vec_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT p_partkey, length('<slice>') + length('</slice>') + (p_size % 3 + 1) * (p_size % 4 + 1) * (length('<image></image>') + 4 * 5) + p_size % 4 AS n FROM part")
def grid_placeholder(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", F.length(I.grid_placeholder((s % 3 + 1).cast("int"), (s % 4 + 1).cast("int"), 4)).cast("long").alias("n"))


# -- training examples -----------------------------------------------------------------


def _examples(docs: DataFrame):
    """A source's documents as one example: the first is the positive, the next three negatives."""
    d = docs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    part = lambda x: F.struct(F.when(x.doc_id % 2 == 0, x.text).otherwise("").alias("text"), F.lit(None).cast("string").alias("image"), F.lit("").alias("instruction"))
    query = F.struct(F.col("source").alias("text"), F.lit(None).cast("string").alias("image"), F.lit("Find ").alias("instruction"))
    return d.select("source", query.alias("query"), F.transform(F.slice("d", 1, 1), part).alias("pos"), F.transform(F.slice("d", 2, 3), part).alias("neg"))


@query("""WITH d AS (SELECT source, doc_id, text AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT 'Find ' || source AS query, r::INTEGER - 1 AS place, CASE WHEN doc_id % 2 = 0 AND x <> '' THEN x ELSE 'empty passage' END AS passage FROM d WHERE r <= 3""")
def training_examples(t):
    # Only the documents that an example can hold are gathered, so a row stays small however many a source has.
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    out = E.multimodal(_examples(t.documents.withColumn("place", place).where("place <= 4")), 3)
    return out.select(F.col("query.text").alias("query"), F.posexplode("passages").alias("place", "p")).select("query", "place", F.col("p.text").alias("passage"))


@query(f"""WITH c AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM {_GROUPS} GROUP BY source)
SELECT source AS query, ids[(5 + 2) % len(ids) + 1] AS positive, ids[2:][(5 + 2) % (len(ids) - 1) + 1] AS negative FROM c WHERE len(ids) > 1""")
def reranking_examples(t):
    c = _groups(t).groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("pos")).where(F.size("pos") > 1)
    return E.reranking(c.select(F.col("source").alias("query"), "pos", F.slice("pos", 2, 1 << 30).alias("neg")), 2, F.lit(5))


@query(f"""WITH c AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM {_GROUPS} GROUP BY source)
SELECT source AS query, unnest(list_concat(ids, ids)[6 % len(ids) + 1 : 6 % len(ids) + 3]) AS doc, unnest(list_concat(ids, ids)[6 % len(ids) + 1 : 6 % len(ids) + 3]) * 2 AS score FROM c""")
def listwise_examples(t):
    c = _groups(t).groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("docs")).select(F.col("source").alias("query"), "docs", F.transform("docs", lambda x: x * 2).alias("scores"))
    return E.listwise_distillation(c, 2, 3).select("query", F.inline(F.arrays_zip("docs", "scores"))).select("query", F.col("docs").alias("doc"), F.col("scores").alias("score"))


@query(f"""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM {_GROUPS})
SELECT source AS batch, i::INTEGER AS place, doc_id AS passage FROM d""")
def collated_batches(t):
    d = _groups(t).select(F.col("source").alias("batch"), "doc_id", F.col("lang").alias("query"), F.array("doc_id").alias("passages"))
    return E.collate(d, "batch", ["doc_id"]).select("batch", F.posexplode("passages").alias("place", "passage"))


@query("SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', '4', doc_id)), doc_id LIMIT 20")
def sample_chunks(t):
    return O.sample_chunks(t.documents.select("doc_id"), 20, ["doc_id"], 4)


# -- caps, permutations, draws ---------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500")
def member_cap(t):
    return O.cap_members(t.documents.select("doc_id"), [F.col("doc_id")], 500)


@query("SELECT l_returnflag, sum(l_quantity) / sum(l_extendedprice) AS samples_per_second, 1000 * sum(l_extendedprice) / count(*) AS ms_per_step FROM lineitem GROUP BY 1", "throughput")
def throughput_query(t):
    out = O.throughput(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "samples_per_second", "ms_per_step")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_md5('doc_id', 5)}, doc_id) - 1 AS one, row_number() OVER (ORDER BY {_md5('doc_id', 5)}, doc_id) - 1 AS other FROM documents")
def co_permutation(t):
    one, other = (O.permute(t.documents.select("doc_id", c), ["doc_id"], 5, name) for c, name in (("lang", "one"), ("source", "other")))
    return one.select("doc_id", "one").join(other.select("doc_id", "other"), "doc_id")


_HASH = "('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 12))::BIGINT"


@query(f"""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), d AS (SELECT unnest(range(0, 300)) AS draw)
SELECT draw, doc_id FROM d, i WHERE i = {_HASH.format(seed=8, key='draw')} % n""")
def resampled_shards(t):
    return O.resample(t.documents.select("doc_id"), [F.col("doc_id")], 300, 8).select("draw", "doc_id")


@query(f"""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY i + {_HASH.format(seed=3, key='doc_id')} % 64, i) - 1 AS place FROM i""")
def shuffle_buffer(t):
    return O.shuffle_buffer(t.documents.select("doc_id"), [F.col("doc_id")], 64, ["doc_id"], 3).select("doc_id", "place")


@query(f"SELECT doc_id FROM documents ORDER BY {_md5('doc_id', 2)}, doc_id LIMIT 150")
def sample_exact(t):
    return O.sample_n(t.documents.select("doc_id"), 150, ["doc_id"], 2, exact=True)


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def sort_if_complete(t):
    rows = O.sort_if_complete(t.documents.select("doc_id", (F.col("n_chars") * (1 << 32) - F.col("doc_id")).alias("key")), "key")
    return global_index(rows, [F.col("key").desc()], "place").select("doc_id", (F.col("place") + 1).alias("place"))


@query("""WITH p AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS size, unnest(range(1, 6)) AS parts FROM orders),
o AS (SELECT *, CASE WHEN size > 1 THEN (1::BIGINT << (length(bin(size - 1)) - 1)) END AS octave FROM p),
n AS (SELECT o_orderkey, parts, CASE WHEN size <= 1 THEN 0 ELSE octave + (size - octave - 1) // greatest(octave // parts, 1) * greatest(octave // parts, 1) END AS n FROM o)
SELECT o_orderkey, parts, n AS next, n - n % 2 AS even FROM n""")
def batch_decay(t):
    rows = t.orders.select("o_orderkey", F.round("o_totalprice").cast("long").alias("size"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(1, 6)])).alias("parts"))
    step = lambda no_odd: O.decayed_batch(F.col("size"), F.col("parts"), no_odd).cast("long")
    return rows.select("o_orderkey", "parts", step(False).alias("next"), step(True).alias("even"))


# -- token ids -------------------------------------------------------------------------

#: The vocabulary that the queries encode with, and its ids at a text's ends.
VOCABULARY, START, END = "/opt/tokenizers/word_bpe_49k.json", 49406, 49407
#: Digits are single tokens of this vocabulary, as are the other words of a customer's name; so SQL can say what the ids are.
_DIGITS = "list_transform(string_split({0}, ''), lambda x: 271 + x::INTEGER)"
_CUT = f"list_concat([{START}], ({{0}})[1:{{1}}], [{END}])"


@query(f"""WITH c AS (SELECT c_custkey, {_CUT.format("list_concat([5102, 258], " + _DIGITS.format("substr(c_name, 10) || c_custkey") + ")", 12)} AS q,
  {_CUT.format("list_concat([5102, 258], " + _DIGITS.format("substr(c_name, 10)") + ")", 6)} AS a, {_CUT.format("list_concat([258], " + _DIGITS.format("c_custkey::VARCHAR") + ")", 6)} AS b FROM customer)
SELECT c_custkey, array_to_string(list_concat(q, list_transform(range(16 - len(q)), lambda x: 0)), ' ') AS query,
  array_to_string(list_transform(range(16), lambda i: CASE WHEN i < len(q) THEN 1 ELSE 0 END), ' ') AS mask, array_to_string(a, ' ') AS first, array_to_string(b, ' ') AS second FROM c""")
def example_ids(t):
    """Customers as examples: the name and key as query, the name and the key as passages; queries are filled up."""
    key = F.col("c_custkey").cast("string")
    rows = t.customer.select("c_custkey", F.concat_ws(" ", "c_name", key).alias("query"), F.array(F.col("c_name"), F.concat(F.lit("# "), key)).alias("passages"))
    out = K.query_passage_ids(rows, VOCABULARY, 14, 8, [START], [END])
    text = lambda ids: F.array_join(ids, " ")
    return out.select("c_custkey", text(K.padded(F.col("query_ids"), 16)).alias("query"), text(K.mask(F.col("query_ids"), 16)).alias("mask"), *[text(F.get("passages_ids", F.lit(i))).alias(n) for i, n in enumerate(("first", "second"))])


# -- the other builders and collators --------------------------------------------------


def _per_conversation(t: Tables) -> DataFrame:
    """A conversation's first question with its first answer and second turn: small groups by nature."""
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.where(F.size("t") >= 3).select("conv_id", F.transform("t", lambda x: x.text).alias("t"))


_CONV = "c AS (SELECT conv_id, list(text ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id HAVING count(*) >= 3)"


@query(f"WITH {_CONV} SELECT conv_id, 'Q ' || t[1] AS query, 'A ' || t[2] AS positive, 'N ' || t[3] AS negative FROM c")
def text_only_examples(t):
    c = _per_conversation(t)
    parts = c.select("conv_id", F.array(F.lit("Q"), F.get("t", F.lit(0))).alias("query"), F.array(F.lit("A"), F.get("t", F.lit(1))).alias("pos"), F.array(F.lit("N"), F.get("t", F.lit(2))).alias("neg"))
    out = E.text_only(parts, 2, keep=("conv_id",))
    return out.select("conv_id", "query", F.get("passages", F.lit(0)).alias("positive"), F.get("passages", F.lit(1)).alias("negative"))


@query("SELECT text AS query, text AS passage FROM documents")
def pretraining_examples(t):
    return E.pretraining(t.documents.select("text")).select("query", F.get("passages", F.lit(0)).alias("passage"))


@query(f"WITH {_CONV} SELECT t[2] AS source, t[1] AS target FROM c")
def query_generation_examples(t):
    return E.query_generation(_per_conversation(t).select(F.get("t", F.lit(0)).alias("query"), F.slice("t", 2, 2).alias("pos")))


@query(f"WITH {_CONV} SELECT t[2:3][(7 + conv_id) % 2 + 1] || ' ' || t[3] AS source, t[1] AS target FROM c")
def contrastive_query_examples(t):
    c = _per_conversation(t).select("conv_id", F.get("t", F.lit(0)).alias("query"), F.slice("t", 2, 2).alias("pos"), F.slice("t", 3, 1).alias("neg"))
    return E.contrastive_query_generation(c, 7, F.col("conv_id"))


@query("SELECT n_name AS query, r_name AS positive, n_name || r_name AS negative, n_nationkey::DOUBLE AS score FROM nation JOIN region ON n_regionkey = r_regionkey")
def pairwise_examples(t):
    d = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("query"), F.col("r_name").alias("positive"), F.concat("n_name", "r_name").alias("negative"), F.col("n_nationkey").alias("score"))
    return E.pairwise_distillation(d)


_PAIR_ROWS = "p AS (SELECT p_partkey // 16 AS batch, row_number() OVER (PARTITION BY p_partkey // 16 ORDER BY p_partkey) - 1 AS place, p_name AS query, p_type AS positive, p_brand AS negative FROM part)"


@query(f"WITH {_PAIR_ROWS} SELECT batch, place, query, unnest(['positive', 'negative']) AS side, unnest([positive, negative]) AS doc FROM p")
def collated_pairs(t):
    d = t.part.select(F.floor(F.col("p_partkey") / 16).alias("batch"), "p_partkey", F.col("p_name").alias("query"), F.col("p_type").alias("positive"), F.col("p_brand").alias("negative"))
    c = E.collate_pairs(d, "batch", ["p_partkey"])
    side = lambda s: c.select("batch", F.posexplode(f"{s}s").alias("place", "x")).select("batch", F.col("place").cast("long").alias("place"), "x.query", F.lit(s).alias("side"), "x.doc")
    return side("positive").union(side("negative"))


@query(f"WITH {_PAIR_ROWS} SELECT batch, place, query, positive FROM p")
def collated_columns(t):
    d = t.part.select(F.floor(F.col("p_partkey") / 16).alias("batch"), "p_partkey", F.col("p_name").alias("query"), F.col("p_type").alias("positive"))
    c = E.collate_columns(d, "batch", ["p_partkey"], ["query", "positive"])
    return c.select("batch", F.posexplode(F.arrays_zip("query", "positive")).alias("place", "x")).select("batch", F.col("place").cast("long").alias("place"), "x.query", "x.positive")
