"""Queries over the naming core and the records around it, each with SQL that says the same.

The column functions are applied to every line of every document, so that each is
held against another engine on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.config import NEUTRAL
from folioforge.functions import dates, fmt, paths
from folioforge.functions import text as T
from folioforge.operators import delta, ranking, records, rename, review, survey
from folioforge.sources import adapters as A
from folioforge.sources import inventory
from folioforge.streaming import progress

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def any_match(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for p in patterns) + ")"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    """As ``T.sanitize``."""
    return f"regexp_replace({collapsed(f"regexp_replace({x}, '[\\\\/:*?{chr(34)}<>|]+', ' ', 'g')")}, '^[._]+|[._]+$', '', 'g')"


def garbled(x: str) -> str:
    words = f"regexp_extract_all({x}, '[A-Za-z]{{3,}}')"
    return f"(len({words}) >= 3 AND (len(list_filter({words}, lambda w: NOT regexp_matches(w, '[aeiouAEIOU]'))) / len({words}) >= 0.4 OR len(list_filter({words}, lambda w: length(w) <= 3)) / len({words}) >= 0.7))"


def boilerplate(x: str) -> str:
    return f"(length(trim({x})) < 8 OR {any_match(f'trim({x})', NEUTRAL.boilerplate)})"


def phrase(x: str) -> str:
    return f"(trim({x}) <> '' AND (regexp_matches(trim({x}), '^\\d{{6,8}}[_\\-\\s\\[\\(]+') OR (regexp_matches({x}, '\\[[^\\]]{{2,30}}\\]') AND regexp_matches({x}, '\\d{{6,8}}'))))"


def noise(x: str) -> str:
    s, tokens = f"trim({x})", f"regexp_extract_all({x}, '[A-Za-z가-힣0-9]+')"
    signs = f"len(regexp_extract_all({s}, '[^A-Za-z가-힣0-9\\s.,;:!?()\\-]'))"
    return f"({s} = '' OR regexp_matches({s}, '[\\|`~^_=]{{2,}}|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s.,;:!?()\\-]{{4,}}') OR len(regexp_extract_all({s}, '[A-Za-z가-힣0-9]')) < 10 OR {signs} / greatest(1, length({s})) >= 0.2 OR (len({tokens}) > 0 AND len(list_filter({tokens}, lambda w: length(w) <= 2)) / len({tokens}) >= 0.5))"


LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS n FROM documents)"
QUERIES = []


def query(sql: str):
    def keep(f):
        QUERIES.append((f, sql))
        return f

    return keep


def lines(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def each_line(spark, sf_dir, **columns) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "n", *(c.alias(k) for k, c in columns.items()))


# -- tests and scores of sentences ------------------------------------------------------------


@query(f"{LINES} SELECT doc_id, n, {boilerplate('line')} AS boilerplate, {garbled('line')} AS garbled FROM l")
def boilerplate_lines(spark, sf_dir):
    return each_line(spark, sf_dir, boilerplate=T.is_boilerplate(F.col("line")), garbled=T.is_garbled(F.col("line")))


@query(f"{LINES} SELECT doc_id, n, {noise('line')} AS noise FROM l")
def noise_lines(spark, sf_dir):
    return each_line(spark, sf_dir, noise=T.is_noise(F.col("line")))


@query(f"{LINES}, p AS (SELECT doc_id, n, CASE doc_id % 4 WHEN 0 THEN '20240115_' || line WHEN 1 THEN line || ' [tag] 240115' WHEN 2 THEN '2401 ' || line ELSE line END AS line FROM l) SELECT doc_id, n, {phrase('line')} AS phrase FROM p")
def file_name_phrases(spark, sf_dir):
    i, line = F.col("doc_id"), F.col("line")
    told = F.when(i % 4 == 0, F.concat(F.lit("20240115_"), line)).when(i % 4 == 1, F.concat(line, F.lit(" [tag] 240115"))).when(i % 4 == 2, F.concat(F.lit("2401 "), line)).otherwise(line)
    return each_line(spark, sf_dir, phrase=T.is_file_name_phrase(told))


#: Letters beyond ASCII, for an engine whose word borders are those of ASCII.
FOREIGN = "[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2FF}\\x{370}-\\x{1FFF}\\x{3040}-\\x{D7FF}]"
QUALITY = f"""q AS (SELECT doc_id, {collapsed('text')} AS s FROM documents), h AS (SELECT doc_id, s, len(regexp_extract_all(s, '[A-Za-z가-힣0-9\\s.,;:!?()\\-]')) AS valid, len(regexp_extract_all(regexp_replace(s, '{FOREIGN}', '_', 'g'), '\\b[a-z]{{1,2}}\\b|[A-Za-z]{{8,}}[0-9]{{2,}}|[0-9]{{5,}}')) AS hits FROM q),
v_quality AS (SELECT doc_id, CASE WHEN s = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, valid / greatest(1, length(s)) - least(0.5::DOUBLE, hits / 40.0::DOUBLE))) END AS quality FROM h)"""


@query(f"WITH {QUALITY} SELECT doc_id, round(quality, 6) AS quality FROM v_quality")
def source_qualities(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.round(T.source_quality(F.col("text")), 6).alias("quality"))


SENTENCES = f"""v_split AS (SELECT doc_id, list_filter(string_split(regexp_replace({collapsed('text')}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM documents),
v_sentences AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM v_split)"""


@query(f"WITH {SENTENCES} SELECT doc_id, i::INT AS i, s FROM v_sentences")
def sentence_split(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))


BEST = f"""v_key AS (SELECT *, regexp_replace(lower(s), '[^a-z0-9가-힣]+', '', 'g') AS k FROM v_sentences WHERE NOT {boilerplate('s')} AND NOT {garbled('s')}),
v_once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS nth FROM v_key WHERE k <> ''),
v_scored AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(s, {quoted(NEUTRAL.summary_words)}) THEN 2 ELSE 0 END DESC, CASE WHEN regexp_matches(s, {quoted(NEUTRAL.structure_words)}) THEN 1 ELSE 0 END DESC, greatest(0, 40 - abs(length(s) - 34)) DESC, least(length(s), 80) DESC, i) AS place FROM v_once WHERE nth = 1)"""


@query(f"WITH {SENTENCES}, {QUALITY}, {BEST} SELECT d.doc_id, coalesce(b.s, '') AS sentence, round(d.quality, 6) AS quality FROM v_quality d LEFT JOIN (SELECT * FROM v_scored WHERE place = 1) b USING (doc_id)")
def best_sentence(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", ranking.best_sentence(F.col("text")).alias("sentence"), F.round(T.source_quality(F.col("text")), 6).alias("quality"))


@query(f"WITH {SENTENCES} SELECT d.doc_id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (NOT {boilerplate('s')} AND NOT {garbled('s')} AND NOT {noise('s')}), '') AS cleaned FROM documents d LEFT JOIN v_sentences USING (doc_id) GROUP BY d.doc_id")
def cleaned_texts(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.clean_for_summary(F.col("text")).alias("cleaned"))


# -- summaries, titles and keywords ------------------------------------------------------------


@query(f"""{LINES}, p AS (SELECT doc_id, n, CASE doc_id % 3 WHEN 0 THEN '240115_ ' || line WHEN 1 THEN line || ' [draft] (2024.05) end' ELSE '(2023-1-2) ' || line END AS line FROM l),
a AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace({collapsed('line')}, '^\\d{{6,8}}[_\\-\\s\\[\\(]+', ''), '\\[[^\\]]{{0,40}}\\]', '', 'g')) AS s FROM p)
SELECT doc_id, n, {collapsed("regexp_replace(s, '[(][0-9]{4}[.\\-/][0-9]{1,2}(?:[.\\-/][0-9]{1,2})?[)]', '', 'g')")} AS seed FROM a""")
def summary_seeds(spark, sf_dir):
    i, line = F.col("doc_id"), F.col("line")
    told = F.when(i % 3 == 0, F.concat(F.lit("240115_ "), line)).when(i % 3 == 1, F.concat(line, F.lit(" [draft] (2024.05) end"))).otherwise(F.concat(F.lit("(2023-1-2) "), line))
    return each_line(spark, sf_dir, seed=T.summary_seed(told))


@query(f"""{LINES}, s AS (SELECT doc_id, n, rtrim({collapsed('line')}, '.') AS s FROM l)
SELECT doc_id, n, length(s) >= 8 AND NOT ({phrase('s')} OR {noise('s')} OR {garbled('s')} OR regexp_matches(s, {quoted(NEUTRAL.low_value_summary)}) OR regexp_matches(s, '\\b[0-9]{{4,}}\\b|[+][0-9]{{1,3}}\\s?[0-9]')) AS ok FROM s""")
def summary_checks(spark, sf_dir):
    return each_line(spark, sf_dir, ok=T.summary_acceptable(F.col("line"), F.lit(False)))


@query(f"""{LINES}, w AS (SELECT doc_id, n, list_filter(string_split({collapsed("regexp_replace(line, '[^A-Za-z\\s]', '', 'g')")}, ' '), lambda x: x <> '') AS ws FROM l),
k AS (SELECT *, list_max(list_filter(range(1, least(len(ws), 10) + 1), lambda k: list_sum(list_transform(ws[1:k], lambda x: length(x))) <= 10)) AS k FROM w)
SELECT doc_id, n, CASE WHEN len(ws) = 0 THEN '' WHEN k IS NOT NULL THEN array_to_string(ws[1:k], '') ELSE substr(ws[1], 1, 10) END AS title FROM k""")
def title_words(spark, sf_dir):
    return each_line(spark, sf_dir, title=T.title_from_words(F.col("line")))


def _at_most_two(x: str) -> str:
    for c in LETTERS:
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}{c}', 'g')"
    return x


@query(f"WITH d AS (SELECT doc_id, repeat(lang, doc_id % 3) || repeat('oo', doc_id % 4) || source || '12' || repeat('Z', doc_id % 5) AS s FROM documents), t AS (SELECT doc_id, s, {_at_most_two("regexp_replace(coalesce(s, ''), '[^A-Za-z]', '', 'g')")} AS q FROM d) SELECT doc_id, CASE WHEN q = '' THEN 'Document' ELSE substr(q, 1, 9) END AS title, regexp_replace(coalesce(s, ''), '\\s+', '', 'g') IN ('', 'document', 'related', 'file', 'other') AS vague FROM t")
def squeezed_titles(spark, sf_dir):
    i = F.col("doc_id")
    s = F.concat(F.expr("repeat(lang, int(doc_id % 3))"), F.expr("repeat('oo', int(doc_id % 4))"), "source", F.lit("12"), F.expr("repeat('Z', int(doc_id % 5))"))
    return A.table(spark, sf_dir, "documents").select(i, T.squeezed_title(s, 9).alias("title"), T.is_vague(s).alias("vague"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a Statement of Claim' WHEN 1 THEN 'MEMO ' || p_name WHEN 2 THEN 'Power of attorney' WHEN 3 THEN p_name ELSE NULL END AS s FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Claim' WHEN 1 THEN 'Memo' WHEN 2 THEN 'Proxy' ELSE '' END AS title, p_partkey % 5 = 2 AS type_word, coalesce(s IN ('document', 'related', 'file', 'other'), true) AS vague FROM p""")
def mapped_titles(spark, sf_dir):
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, "a Statement of Claim").when(k == 1, F.concat(F.lit("MEMO "), "p_name")).when(k == 2, "Power of attorney").when(k == 3, F.col("p_name"))
    return A.table(spark, sf_dir, "part").select("p_partkey", T.mapped_title(s).alias("title"), T.is_doc_type_word(s).alias("type_word"), T.is_vague(s).alias("vague"))


KEYWORDS = """k AS (SELECT p_partkey, p_name, CASE p_partkey % 9 WHEN 0 THEN p_name || ': final' WHEN 1 THEN 'however' WHEN 2 THEN 'Company Limited' WHEN 3 THEN 'page 12' WHEN 4 THEN 'a1 b' WHEN 5 THEN p_name || ' sale agreement' WHEN 6 THEN 'a b c d e f ggg' WHEN 7 THEN 'the telephone ' || p_type ELSE p_type END AS s FROM part)"""


def _keywords(spark, sf_dir) -> tuple[DataFrame, F.Column]:
    k, p = F.col("p_partkey") % 9, A.table(spark, sf_dir, "part")
    s = F.when(k == 0, F.concat("p_name", F.lit(": final"))).when(k == 1, "however").when(k == 2, "Company Limited").when(k == 3, "page 12").when(k == 4, "a1 b").when(k == 5, F.concat("p_name", F.lit(" sale agreement"))).when(k == 6, "a b c d e f ggg").when(k == 7, F.concat(F.lit("the telephone "), "p_type")).otherwise(F.col("p_type"))
    return p, s


@query(f"""WITH {KEYWORDS}, t AS (SELECT p_partkey, {clean('s')} AS t FROM k), w AS (SELECT *, regexp_extract_all(lower(t), '[a-z]+') AS ws FROM t)
SELECT p_partkey, CASE WHEN len(regexp_extract_all(t, '[A-Za-z]')) < 3 OR len(string_split(t, ' ')) > 6 OR lower(t) IN {listed((*NEUTRAL.low_value_words, *NEUTRAL.company_words))} OR regexp_matches(t, {quoted(NEUTRAL.keyword_noise)}) OR (len(ws) > 0 AND len(list_filter(ws, lambda x: x NOT IN {listed(NEUTRAL.company_words)})) = 0) THEN '' ELSE t END AS token FROM w""")
def keyword_tokens(spark, sf_dir):
    p, s = _keywords(spark, sf_dir)
    return p.select("p_partkey", T.keyword_token(s).alias("token"))


@query(f"""WITH {KEYWORDS}, c AS (SELECT p_partkey, lower(s) AS k, lower(p_name || ' agreement widgets') AS t, list_filter(string_split(lower(s), ' '), lambda x: length(x) >= 4) AS parts FROM k)
SELECT p_partkey, k <> '' AND k NOT IN {listed(NEUTRAL.company_words)} AND NOT regexp_matches(k, {quoted(chr(92) + "b(?:" + "|".join(NEUTRAL.low_value_words) + ")" + chr(92) + "b")}) AND NOT (len(regexp_extract_all(k, '[a-z]')) >= 4 AND NOT regexp_matches(k, {quoted(NEUTRAL.keyword_useful)})) AS useful,
       contains(t, k) OR (len(parts) > 0 AND len(list_filter(parts, lambda x: contains(t, x))) >= greatest(1, len(parts) // 2)) AS supported FROM c""")
def keyword_checks(spark, sf_dir):
    p, s = _keywords(spark, sf_dir)
    return p.select("p_partkey", T.keyword_useful(s).alias("useful"), T.keyword_supported(s, F.concat("p_name", F.lit(" agreement widgets"))).alias("supported"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Memo' ELSE 'Opinion' END AS doc_type, CASE p_partkey % 4 WHEN 0 THEN p_name ELSE '' END AS case_name, CASE p_partkey % 5 WHEN 0 THEN p_brand ELSE '' END AS inst, CASE p_partkey % 7 WHEN 0 THEN 'sale agreement' WHEN 1 THEN 'however' ELSE '' END AS kw FROM part),
w AS (SELECT *, CASE WHEN kw = 'sale agreement' THEN kw ELSE '' END AS word, coalesce(nullif(case_name, ''), nullif(inst, '')) AS ctx, list_filter([case_name, inst, doc_type, CASE WHEN kw = 'sale agreement' THEN kw ELSE '' END], lambda x: x <> '') AS parts FROM p)
SELECT p_partkey, CASE WHEN len(parts) = 0 THEN 'Document' WHEN doc_type <> '' AND ctx IS NOT NULL THEN ctx || ' ' || doc_type || CASE WHEN word <> '' THEN ' - ' || word ELSE '' END ELSE array_to_string(parts, ' ') || ' related document' END || '.' AS summary FROM w""")
def structured_summaries(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "").when(k % 3 == 1, "Memo").otherwise("Opinion")
    case, inst = F.when(k % 4 == 0, F.col("p_name")).otherwise(""), F.when(k % 5 == 0, F.col("p_brand")).otherwise("")
    word = F.when(k % 7 == 0, "sale agreement").when(k % 7 == 1, "however").otherwise("")
    return A.table(spark, sf_dir, "part").select(k, T.structured_summary(kind, case, inst, word).alias("summary"))


@query(f"""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN {quoted(NEUTRAL.generic_summaries[0] + '.')} ELSE p_name END AS summary, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS case_name, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE NULL END AS inst FROM part),
w AS (SELECT *, coalesce(nullif(case_name, ''), nullif(inst, '')) AS who FROM p)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND who IS NOT NULL THEN CASE WHEN length(who || ' ' || summary) > 40 THEN rtrim(substr(who || ' ' || summary, 1, 39)) || '.' ELSE who || ' ' || summary END ELSE summary END AS summary FROM w""")
def generic_rewrites(spark, sf_dir):
    k = F.col("p_partkey")
    p = A.table(spark, sf_dir, "part").select(k, F.when(k % 3 == 0, NEUTRAL.generic_summaries[0] + ".").otherwise(F.col("p_name")).alias("summary"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("case_name"), F.when(k % 5 == 0, F.col("p_type")).alias("institution"), k.cast("string").alias("path"))
    return review.rewrite_generic(p).select("p_partkey", "summary")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%y%m%d') WHEN 1 THEN strftime(o_orderdate, '%y%m') || '01' WHEN 2 THEN strftime(o_orderdate, '%y%m%d') WHEN 3 THEN strftime(o_orderdate, '%y%m') || '01' WHEN 4 THEN 'date_unknown' ELSE '200301' END AS d FROM orders""")
def given_dates(spark, sf_dir):
    o, k, f = A.date_strings(spark, sf_dir), F.col("o_orderkey") % 6, lambda p: F.date_format("d", p)
    s = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy.MM")).when(k == 2, f("yyyyMMdd")).when(k == 3, f("yyMM")).when(k == 4, "date_unknown")
    # the last could be 20-20-03 too, which no calendar has
    return o.select("o_orderkey", dates.given_date(s.when(k == 5, "202003")).alias("d"))


# -- numbers and texts for people -----------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, n_chars * 37 AS s FROM documents)
SELECT doc_id, CASE WHEN s >= 86400 THEN printf('%dd %dh %dm', s // 86400, s % 86400 // 3600, s % 3600 // 60) WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, s % 3600 // 60) ELSE printf('%dm %ds', s // 60, s % 60) END AS duration,
       CASE WHEN doc_id % 10 = 0 THEN '--:--' ELSE printf('%02d:%02d', (9 - doc_id % 10) * 2 // 60, (9 - doc_id % 10) * 2 % 60) END AS eta FROM d""")
def durations(spark, sf_dir):
    done = F.col("doc_id") % 10
    return A.table(spark, sf_dir, "documents").select("doc_id", fmt.duration(F.col("n_chars") * 37).alias("duration"), fmt.eta(done * 2.0, done, F.lit(9)).alias("eta"))


@query("""SELECT page_id, replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, CASE WHEN length(url) > 12 THEN substr(url, 1, 6) || '...' || right(url, 4) ELSE '***' END AS masked, regexp_replace('/drives/b!' || page_id || '/root:/a/' || page_id, '^/drives/[^/]+/root:', '') AS folder FROM pages""")
def escapes_and_masks(spark, sf_dir):
    i = F.col("page_id").cast("string")
    return A.table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"), T.masked_key(F.col("url")).alias("masked"), paths.provider_folder(F.concat(F.lit("/drives/b!"), i, F.lit("/root:/a/"), i)).alias("folder"))


# -- records -----------------------------------------------------------------------------------


FILES, PLAN = f"WITH {A.FILES_SQL}", f"WITH {A.PLAN_SQL}"


@query(f"""{FILES} SELECT item_id, folder, name, ext, CASE WHEN folder = '' THEN name ELSE folder || '/' || name END AS path, size, modified, 'https://x/' || item_id AS web_url FROM v_files WHERE item_id % 8 <> 7""")
def library_listing(spark, sf_dir):
    f, i = A.files(spark, sf_dir), F.col("item_id")
    place = F.struct(F.concat(F.lit("/drives/d1/root:/"), "folder").alias("path"))
    raw = f.select(i.alias("id"), "name", "size", F.col("modified").alias("lastModifiedDateTime"), F.when(i % 8 != 7, F.struct(F.lit("m").alias("mimeType"))).alias("file"), place.alias("parentReference"), F.concat(F.lit("https://x/"), i.cast("string")).alias("webUrl"), F.lit(2).alias("seq"))
    older = raw.filter("id % 3 = 0").withColumns({"name": F.lit("old"), "seq": F.lit(1)})
    return inventory.listing(raw.unionByName(older))


@query(f"""{FILES}, f AS (SELECT row_number() OVER (ORDER BY folder) AS id, folder AS parent_path FROM (SELECT DISTINCT folder FROM v_files WHERE folder IS NOT NULL)) SELECT v.item_id, f.parent_path FROM v_files v JOIN f ON v.folder = f.parent_path""")
def items_with_parents(spark, sf_dir):
    f = A.files(spark, sf_dir)
    folders = survey.with_seq(f.filter("folder IS NOT NULL").select("folder").distinct(), "folder", name="id").withColumnRenamed("folder", "path")
    return inventory.with_parents(f.join(folders.select(F.col("path").alias("folder"), F.col("id").alias("parent_id")), "folder"), folders).select("item_id", "parent_path")


@query(f"""{FILES} SELECT item_id, CASE WHEN starts_with(path, 'en/') THEN substr(path, 4) ELSE path END AS path, regexp_replace(regexp_replace(CASE WHEN starts_with(path, 'en/') THEN substr(path, 4) ELSE path END, '[^/]*$', ''), '/$', '') AS folder, row_number() OVER (ORDER BY regexp_replace(regexp_replace(CASE WHEN starts_with(path, 'en/') THEN substr(path, 4) ELSE path END, '[^/]*$', ''), '/$', ''), name) AS seq FROM v_files""")
def snapshot_inventory(spark, sf_dir):
    return inventory.from_snapshot(A.files(spark, sf_dir), "en").select("item_id", "path", "folder", "seq")


@query(f"""{FILES} SELECT 'path' AS by, item_id FROM v_files WHERE path = (SELECT path FROM v_files WHERE item_id = 5) UNION ALL SELECT 'share', item_id FROM v_files WHERE item_id = 7""")
def items_found(spark, sf_dir):
    f = A.files(spark, sf_dir).withColumn("web_url", F.concat(F.lit("https://x/"), F.col("item_id").cast("string")))
    path = f.filter("item_id = 5").select("path").first()[0]
    one = records.item_by_path(f, f"/{path}/").select(F.lit("path").alias("by"), "item_id")
    return one.union(records.item_by_share(f, "https://x/7?web=1").select(F.lit("share"), "item_id"))


@query("SELECT user_id AS item_id, event_id AS line_no, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def merged_results(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), (F.col("event_id") % 3).alias("file_no"), F.col("event_id").alias("line_no"), F.col("event_type").alias("status"))
    return rename.merged_results(e).drop("file_no")


@query(f"""{PLAN}, e AS (SELECT path, 'Edited_' || item_id AS edit FROM v_plan WHERE item_id % 6 = 0), j AS (SELECT p.*, e.edit FROM v_plan p LEFT JOIN e USING (path))
SELECT item_id, coalesce(edit, suggested) AS suggested, edit IS NOT NULL AS manually_edited, CASE WHEN name <> coalesce(edit, suggested) AND item_id % 5 <> 0 THEN 'Y' ELSE '' END AS approval FROM j""")
def edits_and_approvals(spark, sf_dir):
    p = A.rename_plan(spark, sf_dir)
    edits = p.filter("item_id % 6 = 0").select("path", F.concat(F.lit("Edited_"), F.col("item_id").cast("string")).alias("name"))
    told = rename.with_edits(p, edits).withColumn("conflict", F.col("item_id") % 5 == 0)
    return rename.candidate_approval(told).select("item_id", "suggested", "manually_edited", "approval")


PASSES = """v_pass AS (SELECT conv_id AS item_id, turn AS page, unnest([6, 11, 6, 11]) AS psm, unnest([false, false, true, true]) AS cropped, unnest([length(text) % 97, length(text) % 89, length(text) % 83 + 10, length(text) % 79 + 10]) AS n, unnest([length(text) % 100, length(text) % 90, length(text) % 80, length(text) % 70])::DOUBLE AS confidence, conv_id % 4 / 10.0::DOUBLE AS margin FROM conversations)"""


@query(f"""WITH {PASSES}, g AS (SELECT item_id, page, max(margin) AS margin, max(n) FILTER (psm = 6 AND NOT cropped) AS n6, max(n) FILTER (psm = 11 AND NOT cropped) AS n11, max(n) FILTER (psm = 6 AND cropped) AS c6, max(n) FILTER (psm = 11 AND cropped) AS c11,
  max(confidence) FILTER (psm = 6 AND NOT cropped) AS f6, max(confidence) FILTER (psm = 11 AND NOT cropped) AS f11, max(confidence) FILTER (psm = 6 AND cropped) AS d6, max(confidence) FILTER (psm = 11 AND cropped) AS d11 FROM v_pass GROUP BY ALL),
b AS (SELECT *, CASE WHEN n6 >= n11 THEN 6 ELSE 11 END AS bp, greatest(n6, n11) AS bn, CASE WHEN n6 >= n11 THEN f6 ELSE f11 END AS bf, CASE WHEN (c6, d6) >= (c11, d11) THEN 6 ELSE 11 END AS cp FROM g),
c AS (SELECT *, CASE WHEN cp = 6 THEN c6 ELSE c11 END AS cn, CASE WHEN cp = 6 THEN d6 ELSE d11 END AS cf FROM b)
SELECT item_id, page, CASE WHEN n6 >= 80 THEN 6 WHEN n11 >= 80 THEN 11 WHEN NOT (bf < 60 AND margin >= 0.1) THEN bp WHEN c6 >= 80 THEN 6 WHEN (cn, cf) > (bn, bf) THEN cp ELSE bp END AS psm,
       n6 < 80 AND n11 < 80 AND bf < 60 AND margin >= 0.1 AND (c6 >= 80 OR (cn, cf) > (bn, bf)) AS cropped FROM c""")
def recognition_passes(spark, sf_dir):
    n, c = F.length("text"), A.table(spark, sf_dir, "conversations")
    kinds = [(6, False, n % 97, n % 100), (11, False, n % 89, n % 90), (6, True, n % 83 + 10, n % 80), (11, True, n % 79 + 10, n % 70)]
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("psm"), F.lit(k).alias("cropped"), F.repeat(F.lit("x"), m).alias("text"), f.cast("double").alias("confidence")) for p, k, m, f in kinds)))
    passes = c.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("page"), (F.col("conv_id") % 4 / 10.0).alias("margin_ratio"), each.alias("p")).select("item_id", "page", "margin_ratio", "p.*")
    return records.choose_pass(passes).select("item_id", "page", "psm", "cropped")


@query(f"""{FILES} SELECT item_id, CASE WHEN item_id % 4 <> 0 AND item_id % 9 <> 0 THEN 'cached ' ELSE 'fresh ' END || name AS result, item_id % 4 <> 0 AND item_id % 9 <> 0 AS hit FROM v_files""")
def hits_and_fresh(spark, sf_dir):
    f = A.files(spark, sf_dir).withColumn("cache_key", delta.cache_key("path", "size", "modified"))
    cache = f.filter("item_id % 4 <> 0").select("cache_key", F.when(F.col("item_id") % 9 == 0, 10).otherwise(11).alias("schema_version"), F.concat(F.lit("cached "), "name").alias("result"))
    fresh = lambda rows: rows.select("item_id", F.concat(F.lit("fresh "), "name").alias("result"))
    return delta.with_fresh(f, cache, fresh)


@query(f"""{FILES} SELECT count(*) AS total_files, count(*) FILTER (ext IN ('.pdf', '.docx')) AS supported_files, count(*) FILTER (item_id % 11 > 7) AS manual_review_count, count(*) FILTER (item_id % 4 = 1) AS cache_hits FROM v_files""")
def run_summary(spark, sf_dir):
    i = F.col("item_id")
    return survey.run_summary(A.files(spark, sf_dir).withColumns({"supported": F.col("ext").isin(".pdf", ".docx"), "needs_review": i % 11 > 7, "hit": F.when(i % 4 == 1, F.lit(True))}))


@query(f"""{FILES} SELECT count(*) AS total_files, coalesce(sum(size), 0)::BIGINT AS total_size, count(*) FILTER (ext IN {listed(survey.SURVEY_SUPPORTED)}) AS supported, count(*) FILTER (ext NOT IN {listed(survey.SURVEY_SUPPORTED)}) AS unsupported FROM v_files WHERE starts_with(path, 'en/') OR starts_with(path, 'de/src1/')""")
def selected_totals(spark, sf_dir):
    chosen = spark.createDataFrame([("en",), ("en/src1",), ("de/src1",), ("de/src1/1. cat",), ("nowhere",)], "path string")
    return survey.selected_totals(A.files(spark, sf_dir), chosen)


@query(f"""{PLAN} SELECT count(*) FILTER (name <> suggested) AS different_names, count(*) FILTER (item_id % 5 = 0) AS out_of_scope, count(*) FILTER (item_id % 5 = 1) AS conflicts, count(*) FILTER (item_id % 4 < 2) AS needs_manual, count(*) FILTER (approval = 'Y') AS approved FROM v_plan""")
def approval_counts(spark, sf_dir):
    i = F.col("item_id")
    status = F.when(i % 5 == 0, "out_of_scope").when(i % 5 == 1, "duplicate_conflict").otherwise("proposed")
    typed = F.when(i % 4 == 0, "True").when(i % 4 == 1, " y").when(i % 4 == 2, "no")
    return review.approval_counts(A.rename_plan(spark, sf_dir).withColumns({"status": status, "needs_review": typed}))


@query(f"""{PLAN} SELECT seq, item_id FROM v_plan WHERE item_id % 11 = 9 ORDER BY seq LIMIT 10""")
def manual_sample(spark, sf_dir):
    return review.manual_sample(A.rename_plan(spark, sf_dir).withColumn("needs_review", F.col("item_id") % 11 == 9)).select("seq", "item_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return progress.windowed(A.table(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return progress.sessions(A.table(spark, sf_dir, "events")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query(f"""WITH {A.FEED_SQL}, n AS (SELECT * FROM v_old WHERE item_id NOT IN (SELECT item_id FROM v_feed) UNION ALL SELECT item_id, folder, name, ext, path, size, modified FROM v_feed WHERE op <> 'delete')
SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN o.item_id IS NULL THEN 'added' WHEN n.item_id IS NULL THEN 'deleted' WHEN o.modified = n.modified AND o.name = n.name THEN 'unchanged' ELSE 'modified' END AS change, coalesce(n.folder, o.folder) AS folder FROM v_old o FULL JOIN n ON o.item_id = n.item_id""")
def resync_changes(spark, sf_dir):
    old, feed = A.snapshot_and_feed(spark, sf_dir)
    return delta.compare(old, delta.apply(old, feed))


@query(f"""{FILES}, d AS (SELECT DISTINCT folder FROM v_files), k AS (SELECT split_part(folder, '/', 1) || '/' || split_part(folder, '/', 2) AS node, folder, count(*) AS n FROM v_files GROUP BY ALL) SELECT node, count(*) AS children, sum(n)::BIGINT AS files FROM k WHERE node IS NOT NULL GROUP BY node""")
def tree_overflow(spark, sf_dir):
    return survey.tree_overflow(A.files(spark, sf_dir), 2)


@query("""SELECT event_id AS seq, (count(*) OVER w)::BIGINT AS processed, (sum((event_type = 'click')::INT) OVER w)::BIGINT AS success, (sum((event_type <> 'click')::INT) OVER w)::BIGINT AS failed FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def rename_progress(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return rename.rename_progress(e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "success").otherwise("target_exists").alias("status")))


RUNS = """e AS (SELECT user_id AS run_id, event_id AS seq, CASE event_id % 40 WHEN 0 THEN 'reset' WHEN 1 THEN 'scanning' WHEN 2 THEN 'start' WHEN 3 THEN 'complete' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'error' ELSE 'record' END AS type FROM events)"""
STATE = """SELECT e.run_id, coalesce(arg_max(type, e.seq) FILTER (type <> 'record'), 'idle') AS status, count(*) FILTER (type = 'record') AS processed, max(e.seq) AS seq FROM e LEFT JOIN (SELECT run_id, max(seq) AS r FROM e WHERE type = 'reset' {limit} GROUP BY run_id) x USING (run_id) WHERE (x.r IS NULL OR e.seq >= x.r) {limit} GROUP BY e.run_id"""


def _runs(spark, sf_dir) -> DataFrame:
    kind = F.lit("record")
    for n, name in enumerate(("reset", "scanning", "start", "complete", "cancelled", "error")):
        kind = F.when(F.col("event_id") % 40 == n, name).otherwise(kind)
    return A.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"))


@query(f"WITH {RUNS} {STATE.format(limit='')}")
def run_states(spark, sf_dir):
    return progress.run_state(_runs(spark, sf_dir))


@query(f"WITH {RUNS}, s AS ({STATE.format(limit='AND seq <= 500')}) SELECT run_id, seq, 'sync' AS type, status, processed FROM s UNION ALL SELECT run_id, seq, type, NULL, NULL FROM e WHERE seq > 500")
def sync_and_tail(spark, sf_dir):
    return progress.sync_and_tail(_runs(spark, sf_dir), 500)


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'own' WHEN page_id % 5 = 1 THEN 'path' WHEN page_id % 5 = 2 THEN 'share' WHEN page_id % 3 = 0 THEN 'site:' || regexp_extract(url, '(https?://[^/]+(?:/sites/[^/?#]+)?)', 1) END AS drive_id FROM pages""")
def drive_lookup(spark, sf_dir):
    p, i = A.table(spark, sf_dir, "pages"), F.col("page_id")
    # each item has a site of its own name, so that some sites are not known
    items = p.select(i, F.concat(F.lit("p/"), i.cast("string")).alias("path"), F.concat(F.lit("https://h"), i.cast("string"), F.lit("/x")).alias("web_url"), "url", F.when(i % 5 == 0, "own").alias("drive_id"))
    sites = items.filter("page_id % 3 = 0").select(paths.site_of(F.col("web_url")).alias("site"), F.concat(F.lit("site:"), paths.site_of(F.col("url"))).alias("drive_id"))
    known = items.filter("page_id % 5 = 1").select("path", F.lit("path").alias("drive_id"))
    shares = items.filter("page_id % 5 = 2").select("web_url", F.lit("share").alias("drive_id"))
    return records.resolve_drives(items, known, shares, sites).select("page_id", "drive_id")
