"""Registered queries: chunks, segments, evidence, profiles, knowledge search and governance."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from cargolens.functions import hashing as H
from cargolens.functions import text as T
from cargolens.operators import chunking as CH
from cargolens.operators import containment as CO
from cargolens.operators import evidence as E
from cargolens.operators import knowledge as K
from cargolens.operators import segments as SG
from cargolens.plans import sql as S
from cargolens.session import staged, work_dir
from cargolens.sources import bridge, files

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"


def _docs(spark, sf):
    return bridge.documents(spark, sf).withColumn("locator", F.lit("Document"))


def _chunks_sql(size: int, name: str = "chunks") -> str:
    return f"""{name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ofs) AS position,
 CASE WHEN whole > {size} THEN 'Document, part ' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ofs) AS VARCHAR)
 ELSE 'Document' END AS locator, piece AS text FROM (
 SELECT doc_id, length(text) AS whole, ofs, trim(substr(text, CAST(ofs + 1 AS BIGINT), {size}), {SPACE}) AS piece
 FROM documents, unnest(generate_series(0, greatest(length(text) - 1, 0), {size})) u(ofs)) WHERE piece <> '')"""


def c1_chunks(spark, sf):
    chunks = CH.chunk_documents(_docs(spark, sf), ["doc_id"])
    return chunks.select(
        "doc_id",
        "position",
        "locator",
        F.length("text").alias("chars"),
        H.content_hash(F.col("text")).alias("sha256"),
    )


C1_SQL = S.with_(_chunks_sql(7000)) + """SELECT doc_id, CAST(position AS INT) AS position, locator,
 CAST(length(text) AS INT) AS chars, sha256(text) AS sha256 FROM chunks"""


def c2_assembled_text(spark, sf):
    """Documents put together again from their chunks, with the locators; a document over a limit gives a row that says so."""
    texts, rejects = CH.assemble_checked(CH.chunk_documents(_docs(spark, sf), ["doc_id"]), "doc_id", ["position"])
    rows = texts.select(
        "doc_id", F.length("text").alias("chars"), H.content_hash(F.col("text")).alias("sha256"), F.lit(None).cast("string").alias("reason")
    )
    return rows.unionByName(rejects.select("doc_id", "reason"), allowMissingColumns=True)


C2_SQL = S.with_(_chunks_sql(7000)) + """SELECT doc_id, CASE WHEN chars <= 2000000 THEN CAST(length(t) AS INT) END AS chars,
 CASE WHEN chars <= 2000000 THEN sha256(t) END AS sha256, CASE WHEN chars > 2000000 THEN 'too many characters' END AS reason FROM (
 SELECT doc_id, sum(length(text)) AS chars, string_agg('[' || locator || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS t
 FROM chunks GROUP BY 1)"""


def _short_chunks(spark, sf):
    return CH.chunk_documents(_docs(spark, sf), ["doc_id"], 900)


def c3_sections(spark, sf):
    """Sections per document, from its chunks: what is cut before every locator line."""
    found = SG.section_rows(_short_chunks(spark, sf), "doc_id")
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return found.select("doc_id", (F.col("section_no") - 1).cast("int").alias("section_no"), line.alias("locator_line"), H.content_hash(F.col("text")).alias("sha256"))


C3_SQL = S.with_(_chunks_sql(900)) + """SELECT doc_id, CAST(position - 1 AS INT) AS section_no,
 '[' || locator || ']' AS locator_line, sha256('[' || locator || ']' || chr(10) || text) AS sha256 FROM chunks"""


def c4_segments(spark, sf):
    """Mapping segments, with short chunks and a short target so that documents need several; too many give one row that says so."""
    out, rejects = SG.chunk_segments(_short_chunks(spark, sf), "doc_id", target=3000)
    rows = out.select(
        "doc_id",
        "segment_no",
        F.length("text").alias("chars"),
        H.content_hash(F.col("text")).alias("sha256"),
        F.lit(None).cast("string").alias("reason"),
    )
    return rows.unionByName(rejects.select("doc_id", "reason"), allowMissingColumns=True)


C4_SQL = "WITH RECURSIVE " + _chunks_sql(900) + """,
sec AS (SELECT doc_id, position, '[' || locator || ']' || chr(10) || text AS s FROM chunks),
whole AS (SELECT doc_id, sum(length(s)) + 2 * (count(*) - 1) AS total FROM sec GROUP BY 1),
walk(doc_id, position, seg, chars) AS (SELECT doc_id, position, CAST(1 AS BIGINT), CAST(length(s) AS BIGINT) FROM sec WHERE position = 1
 UNION ALL SELECT w.doc_id, n.position, CASE WHEN total > 3000 AND w.chars + length(n.s) + 2 > 3000 THEN seg + 1 ELSE seg END,
 CASE WHEN total > 3000 AND w.chars + length(n.s) + 2 > 3000 THEN length(n.s) ELSE w.chars + length(n.s) + 2 END
 FROM walk w JOIN sec n ON n.doc_id = w.doc_id AND n.position = w.position + 1 JOIN whole t ON t.doc_id = w.doc_id),
segs AS (SELECT w.doc_id, seg, string_agg(s, chr(10) || chr(10) ORDER BY w.position) AS t FROM walk w
 JOIN sec ON sec.doc_id = w.doc_id AND sec.position = w.position GROUP BY 1, 2),
many AS (SELECT doc_id, max(seg) AS k FROM segs GROUP BY 1 HAVING max(seg) > 24)
SELECT doc_id, CAST(seg AS INT) AS segment_no, CAST(length(t) AS INT) AS chars, sha256(t) AS sha256, CAST(NULL AS VARCHAR) AS reason
 FROM segs WHERE doc_id NOT IN (SELECT doc_id FROM many)
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'more than 24 segments' FROM many"""


def c5_sliding_segments(spark, sf):
    """Overlapping windows over texts without locator lines."""
    out, _ = CH.segments(bridge.documents(spark, sf), "doc_id", target=3000, limit=100_000)
    return out.select("doc_id", "segment_no", H.content_hash(F.col("text")).alias("sha256"))


C5_SQL = f"""SELECT doc_id, CAST(CASE WHEN length(t) <= 3000 THEN 1 ELSE ofs // 2750 + 1 END AS INT) AS segment_no,
 sha256(CASE WHEN length(t) <= 3000 THEN t ELSE substr(t, CAST(ofs + 1 AS BIGINT), 3000) END) AS sha256 FROM (
 SELECT doc_id, trim(text, {SPACE}) AS t FROM documents),
 unnest(generate_series(0, CASE WHEN length(t) <= 3000 THEN 0 ELSE length(t) - 1 END, 2750)) u(ofs) WHERE t <> ''"""


def c6_segment_rejects(spark, sf):
    _, rejects = CH.segments(bridge.documents(spark, sf), "doc_id", target=600)
    return rejects


C6_SQL = f"""SELECT doc_id, segments, 'more than 24 segments' AS reason FROM (
 SELECT doc_id, CAST((length(t) - 1) // 550 + 1 AS INT) AS segments FROM (SELECT doc_id, trim(text, {SPACE}) AS t FROM documents)
 WHERE length(t) > 600) WHERE segments > 24"""


def p9_size_rejects(spark, sf):
    """Documents over a character limit, counted over their chunks."""
    return CH.size_rejects(CH.chunk_documents(_docs(spark, sf), ["doc_id"]), "doc_id", max_chars=10_000)


P9_SQL = S.with_(_chunks_sql(7000)) + """SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars,
 'too many characters' AS reason FROM chunks GROUP BY 1 HAVING sum(length(text)) > 10000"""


# ---- sources -------------------------------------------------------------


def s2_csv_table_text(spark, sf):
    """Parts written as one CSV file per brand, read back as pipe tables, shown line by line."""

    name = "csv-" + hashlib.sha256(sf.encode()).hexdigest()[:12]
    folder = f"{work_dir(spark)}/{name}"
    part = bridge.table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_type", F.col("p_size").cast("string").alias("p_size"), "p_brand"
    )
    part.repartition("p_brand").write.mode("overwrite").partitionBy("p_brand").option("header", "true").csv(folder)
    texts, _ = files.extract_texts(files.register_files(spark, folder))
    brand = F.regexp_extract(F.url_decode("path"), "p_brand=([^/]+)/", 1)
    return texts.select(brand.alias("brand"), "locator", F.explode(F.split("text", "\n")).alias("line"))


S2_SQL = """SELECT p_brand AS brand, 'CSV' AS locator, '| ' || CAST(p_partkey AS VARCHAR) || ' | ' || p_name || ' | '
 || p_type || ' | ' || CAST(p_size AS VARCHAR) || ' |' AS line FROM part
UNION ALL SELECT DISTINCT p_brand, 'CSV', '| p_partkey | p_name | p_type | p_size |' FROM part
UNION ALL SELECT DISTINCT p_brand, 'CSV', '| --- | --- | --- | --- |' FROM part"""


def f23_content_hash(spark, sf):
    return bridge.documents(spark, sf).select("doc_id", H.content_hash(F.col("text")).alias("sha256"))


F23_SQL = "SELECT doc_id, sha256(text) AS sha256 FROM documents"


def f17_search_terms(spark, sf):
    """Distinct search terms of the benchmark texts, as queries."""
    return bridge.table(spark, sf, "benchmark").select(
        "item_id", F.explode(T.search_terms(F.col("text"))).alias("term")
    )


F17_SQL = """SELECT DISTINCT item_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_\\-]{3,}')) AS term
 FROM benchmark"""


def f18_normal_text(spark, sf):
    return bridge.documents(spark, sf).select("doc_id", H.content_hash(T.normal(F.col("text"))).alias("sha256"))


NORMAL = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\s\\x{85}\\x{A0}]+', ' ', 'g'))"
F18_SQL = f"SELECT doc_id, sha256({NORMAL}) AS sha256 FROM documents"


def f19_slug(spark, sf):
    doc = bridge.documents(spark, sf)
    return doc.select("doc_id", T.slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


F19_SQL = """SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'),
 '[^a-z0-9]+', '-', 'g'), '-'), 80), ''), 'vendor') AS slug FROM documents"""


def f20_page_number(spark, sf):
    """Page numbers of locators: 'Page n' of every record, 'Document, part n' has none."""
    rec = bridge.records(spark, sf, ordered=False, sized=False)
    locator = F.when(
        F.col("returnflag") == "R", F.concat(F.lit("Document, part "), F.col("segment_no").cast("string"))
    ).otherwise(F.concat(F.lit("page "), F.col("segment_no").cast("string"), F.lit(", part 2")))
    return (
        rec.select(locator.alias("locator"))
        .groupBy("locator")
        .agg(F.count("*").alias("records"))
        .select("locator", "records", T.page_of_locator(F.col("locator")).alias("page"))
    )


F20_SQL = """SELECT locator, count(*) AS records, CASE WHEN locator LIKE 'page %'
 THEN CAST(regexp_extract(locator, '[0-9]+') AS INT) END AS page FROM (SELECT CASE WHEN l_returnflag = 'R'
 THEN 'Document, part ' || CAST(l_linenumber AS VARCHAR) ELSE 'page ' || CAST(l_linenumber AS VARCHAR) || ', part 2' END
 AS locator FROM lineitem) GROUP BY 1"""


# ---- evidence ------------------------------------------------------------


def _evidence(spark, sf):
    chunks = CH.chunk_documents(_docs(spark, sf), ["doc_id"], 900)
    chunks = chunks.withColumnRenamed("doc_id", "job_id").withColumn("document_id", F.col("job_id"))
    asked = bridge.table(spark, sf, "labels").select(
        F.col("doc_id").alias("request_id"),
        F.col("doc_id").alias("job_id"),
        F.when(F.col("quality") == 1, "document").otherwise("Document, part 1").alias("locator"),
    )
    return chunks, asked


def e1_find_evidence(spark, sf):
    chunks, asked = _evidence(spark, sf)
    return E.find_evidence(chunks, asked, limit=5).select("request_id", "place", "rank", "position", "locator")


E1_SQL = S.with_(_chunks_sql(900)) + """SELECT request_id, CAST(place AS INT) AS place, CAST(rank AS INT) AS rank,
 CAST(position AS INT) AS position, locator FROM (
 SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank, position) AS place FROM (
 SELECT l.doc_id AS request_id, position, locator, CASE WHEN lower(locator) = w THEN 0
  WHEN starts_with(lower(locator), w || ',') OR starts_with(w, lower(locator) || ',') THEN 1
  WHEN contains(lower(locator), w) OR contains(w, lower(locator)) THEN 2 END AS rank
 FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'document' ELSE 'document, part 1' END AS w FROM labels) l
 JOIN chunks ON chunks.doc_id = l.doc_id) WHERE rank IS NOT NULL) WHERE place <= 5"""


def _locators(spark, sf):
    return bridge.table(spark, sf, "labels").select(
        F.col("doc_id").alias("job_id"),
        F.when(F.col("toxic") == 1, "Document").otherwise("Document, part 3").alias("locator"),
    )


def e2_text_for_locators(spark, sf):
    chunks, _ = _evidence(spark, sf)
    texts = E.text_for_locators(chunks, _locators(spark, sf))
    return texts.select("job_id", F.length("text").alias("chars"), H.content_hash(F.col("text")).alias("sha256"))


MATCHED = """hit AS (SELECT DISTINCT c.* FROM chunks c JOIN labels l ON l.doc_id = c.doc_id
 AND (locator = CASE toxic WHEN 1 THEN 'Document' ELSE 'Document, part 3' END
 OR starts_with(locator, CASE toxic WHEN 1 THEN 'Document' ELSE 'Document, part 3' END || ',')
 OR starts_with(CASE toxic WHEN 1 THEN 'Document' ELSE 'Document, part 3' END, locator || ',')))"""
E2_SQL = S.with_(_chunks_sql(900), MATCHED) + """SELECT doc_id AS job_id, CAST(length(t) AS INT) AS chars, sha256(t) AS sha256
 FROM (SELECT doc_id, string_agg('[' || locator || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS t
 FROM hit GROUP BY 1)"""


def e2_jobs_without_text(spark, sf):
    chunks, _ = _evidence(spark, sf)
    return E.jobs_without_text(chunks, _locators(spark, sf)).select("job_id", "reason")


E2_NONE_SQL = S.with_(_chunks_sql(900), MATCHED) + """SELECT DISTINCT doc_id AS job_id,
 'no stored text for these locators' AS reason FROM labels
 WHERE doc_id NOT IN (SELECT doc_id FROM hit)"""


def e3_excerpts(spark, sf):
    chunks, _ = _evidence(spark, sf)
    return E.excerpts(chunks, _locators(spark, sf)).select(
        "job_id", "position", "locator", "place", H.content_hash(F.col("text")).alias("sha256")
    )


E3_SQL = S.with_(_chunks_sql(900)) + """, hits AS (SELECT c.*, CASE WHEN locator = w THEN 0
  WHEN starts_with(locator, w || ',') OR starts_with(w, locator || ',') THEN 1
  WHEN contains(lower(locator), lower(w)) OR contains(lower(w), lower(locator)) THEN 2 END AS tier FROM chunks c
 JOIN (SELECT doc_id, CASE toxic WHEN 1 THEN 'Document' ELSE 'Document, part 3' END AS w FROM labels) l ON l.doc_id = c.doc_id),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, position) AS place FROM hits WHERE tier IS NOT NULL),
fall AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS place FROM chunks
 WHERE doc_id NOT IN (SELECT doc_id FROM good))
SELECT doc_id AS job_id, CAST(position AS INT) AS position, locator, CAST(place AS INT) AS place, sha256(left(text, 3500)) AS sha256
 FROM good WHERE place <= 8 UNION ALL
SELECT doc_id, CAST(position AS INT), locator, CAST(place AS INT), sha256(left(text, 3500)) FROM fall WHERE place <= 3"""


def p5_graded_locators(spark, sf):
    """Locators of the documents of each language (one language has most of them) by the locators asked for, with their tiers."""
    docs = bridge.documents(spark, sf)
    page = F.concat(F.lit(", page "), (F.col("doc_id") % 40).cast("string"))
    left = docs.select("lang", F.concat("source", page, F.lit(", part "), (F.length("text") % 3).cast("string")).alias("left"))
    kind = F.col("doc_id") % 5
    asked = F.when(kind == 0, F.col("source")).when(kind == 1, F.concat(F.upper("source"), page)).when(kind == 2, F.concat("source", page))
    asked = asked.when(kind == 3, F.concat("source", page, F.lit(", part 1"))).otherwise(F.substring(page, 3, 7))
    pairs = CO.graded(left, docs.select("lang", asked.alias("right")), ["lang"], T.folded)
    return pairs.groupBy("lang", F.col("right").alias("wanted"), "tier").agg(F.count("*").alias("locators"))


P5_SQL = """WITH d AS (SELECT lang, source, ', page ' || CAST(doc_id % 40 AS VARCHAR) AS page, doc_id % 5 AS kind, length(text) % 3 AS part FROM documents),
l AS (SELECT DISTINCT lang, source || page || ', part ' || CAST(part AS VARCHAR) AS l FROM d),
r AS (SELECT DISTINCT lang, CASE kind WHEN 0 THEN source WHEN 1 THEN upper(source) || page WHEN 2 THEN source || page
 WHEN 3 THEN source || page || ', part 1' ELSE substr(page, 3, 7) END AS r FROM d),
m AS (SELECT l.lang, r, CASE WHEN l = r THEN 0 WHEN starts_with(l, r || ',') OR starts_with(r, l || ',') THEN 1
 WHEN contains(lower(l), lower(r)) OR contains(lower(r), lower(l)) THEN 2 END AS tier FROM l JOIN r ON l.lang = r.lang)
SELECT lang, r AS wanted, CAST(tier AS INT) AS tier, count(*) AS locators FROM m WHERE tier IS NOT NULL GROUP BY ALL"""


# ---- profiles ------------------------------------------------------------


def profile_documents(spark, sf):
    """One profile document per language, its indicators the language's most used words; written once."""

    def build():
        words = bridge.documents(spark, sf).select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word"))
        counts = words.filter(F.col("word").rlike("^[a-z]{3,}$")).groupBy("lang", "word").agg(F.count("*").alias("n"))
        order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
        top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 10)
        listed = top.groupBy("lang").agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("place", "word"))),
                    lambda e: F.concat(F.lit("- `"), e["word"], F.lit("`")),
                ),
                "\n",
            ).alias("bullets")
        )
        body = F.concat(
            F.lit("# Profile "), F.col("lang"), F.lit("\n\nVersion: 2\n\n## Typical recognition indicators\n\nWords:\n\n"),
            F.col("bullets"), F.lit("\n\n## Other\n\n- not an indicator\n"),
        )
        path = F.concat(F.lit("vendors/"), F.col("lang"), F.lit(".md"))
        return listed.select(path.alias("path"), body.alias("text"))

    return staged(spark, f"profile_documents:{sf}", build)


TOP = """words AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents),
top AS (SELECT * FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place
 FROM words WHERE regexp_full_match(word, '[a-z]{3,}') GROUP BY 1, 2) WHERE place <= 10),
prof AS (SELECT 'vendors/' || lang || '.md' AS path, 'Profile ' || lang AS title, count(*) AS total,
 '# Profile ' || lang || chr(10) || chr(10) || 'Version: 2' || chr(10) || chr(10) || '## Typical recognition indicators'
 || chr(10) || chr(10) || 'Words:' || chr(10) || chr(10) || string_agg('- `' || word || '`', chr(10) ORDER BY place) || chr(10) || chr(10)
 || '## Other' || chr(10) || chr(10) || '- not an indicator' || chr(10) AS text FROM top GROUP BY lang)"""


def k1_profiles(spark, sf):
    return K.profiles(profile_documents(spark, sf)).select(
        "path", "title", "sha256", "version", F.size("indicators").alias("indicator_count")
    )


K1_SQL = S.with_(TOP) + """SELECT path, title, sha256(text) AS sha256, '2' AS version,
 CAST(total AS INT) AS indicator_count FROM prof"""


def f16_indicators(spark, sf):
    return K.profiles(profile_documents(spark, sf)).select(
        "path", F.posexplode("indicators").alias("entry", "indicator")
    )


F16_SQL = S.with_(TOP) + (
    "SELECT 'vendors/' || lang || '.md' AS path, CAST(place - 1 AS INT) AS entry, word AS indicator FROM top"
)


def f15_version(spark, sf):
    return profile_documents(spark, sf).select(
        "path", T.version_text(F.col("text")).alias("version"), T.version_number(F.col("text")).alias("number")
    )


F15_SQL = S.with_(TOP) + "SELECT path, '2' AS version, CAST(2 AS INT) AS number FROM prof"


def f14_title(spark, sf):
    """Titles: of profile documents from their heading, of documents without one from the file stem."""
    knowledge = bridge.knowledge_documents(spark, sf).select("path", "text")
    both = knowledge.unionByName(profile_documents(spark, sf))
    return both.select("path", T.title(F.col("text"), T.file_stem(F.col("path"))).alias("title"))


F14_SQL = S.with_(TOP) + """SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(doc_id AS VARCHAR) AS title
 FROM documents UNION ALL SELECT path, title FROM prof"""


def k2_profile_match(spark, sf):
    return K.match_profiles(bridge.documents(spark, sf), K.profiles(profile_documents(spark, sf)), "doc_id")


K2_SQL = S.with_(TOP) + f""", hay AS (SELECT doc_id, {NORMAL} AS h FROM documents),
hits AS (SELECT doc_id, 'vendors/' || lang || '.md' AS path, 'Profile ' || lang AS title, count(*) AS score
 FROM hay JOIN top ON contains(h, word) GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT doc_id, path, title, CAST(score AS INT) AS score, CAST(total AS INT) AS total_indicators, '2' AS version FROM (
 SELECT hits.*, total, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, score / total DESC, hits.path) AS place
 FROM hits JOIN prof ON prof.path = hits.path) WHERE place = 1"""


def k2_profile_match_joined(spark, sf):
    """The same match; there is one way for any number of indicators."""
    return K.match_profiles(bridge.documents(spark, sf), K.profiles(profile_documents(spark, sf)), "doc_id")


def k2_many_indicators(spark, sf):
    """Some ten thousand indicators: the 2,500 most used words of each language and pairs of words, in 40 profiles a language."""
    docs = bridge.documents(spark, sf)
    words = docs.select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    counts = words.filter(F.col("word").rlike("^[a-z]{3,}$")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2500)
    phrase = F.when(F.col("place") % 5 == 0, F.concat("word", F.lit("  DE "))).otherwise(F.col("word"))
    path = F.concat(F.lit("vendors/"), "lang", F.lit("-"), (F.col("place") % 40).cast("string"))
    table = top.groupBy(path.alias("path")).agg(F.collect_list(phrase).alias("indicators"))
    table = table.select("path", F.col("path").alias("title"), "indicators", F.lit("1").alias("version"))
    return K.match_profiles(docs, table, "doc_id")


K2_MANY_SQL = f"""WITH words AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents),
top AS (SELECT *, 'vendors/' || lang || '-' || CAST(place % 40 AS VARCHAR) AS path, word || CASE WHEN place % 5 = 0 THEN ' de' ELSE '' END AS needle
 FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place
 FROM words WHERE regexp_full_match(word, '[a-z]{{3,}}') GROUP BY 1, 2) WHERE place <= 2500),
prof AS (SELECT path, count(*) AS total FROM top GROUP BY 1),
hay AS (SELECT doc_id, {NORMAL} AS h FROM documents),
needles AS (SELECT DISTINCT needle FROM top),
met AS (SELECT doc_id, needle FROM hay JOIN needles ON contains(h, needle)),
hits AS (SELECT doc_id, path, count(*) AS score FROM met JOIN top USING (needle) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT doc_id, path, path AS title, CAST(score AS INT) AS score, CAST(total AS INT) AS total_indicators, '1' AS version FROM (
 SELECT hits.*, total, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, score / total DESC, hits.path) AS place
 FROM hits JOIN prof ON prof.path = hits.path) WHERE place = 1"""


# ---- search --------------------------------------------------------------

QUERY = "Packing whereas profile SRC1 und mente atthe wehr reaution"
TERMS = ["packing", "whereas", "profile", "src1", "und", "mente", "atthe", "wehr", "reaution"]


def k3_search(spark, sf):
    return K.search(bridge.knowledge_documents(spark, sf), QUERY, limit=8).select("path", "title", "score")


_KN = """kn AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path,
 split_part(text, chr(10), 1) AS title, text FROM documents)"""
_SCORE = " + ".join(
    f"CASE WHEN NOT contains(hay, '{t}') THEN 0 WHEN contains(head, '{t}') THEN 3 ELSE 1 END" for t in TERMS
)
HITS = f"""{_KN}, scored AS (SELECT path, title, text, CAST({_SCORE} AS INT) AS score FROM (
 SELECT *, replace(lower(path || ' ' || title || ' ' || text), 'ß', 'ss') AS hay,
 replace(lower(title), 'ß', 'ss') AS head FROM kn)),
hits AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, path LIMIT 8)"""
K3_SQL = S.with_(HITS) + "SELECT path, title, score FROM hits"


def k4_context(spark, sf):
    hits = K.search(bridge.knowledge_documents(spark, sf), QUERY, limit=8)
    return K.context_for(hits, max_chars=30_000).select(
        "path", "score", F.length("text").alias("chars"), H.content_hash(F.col("text")).alias("sha256")
    )


K4_SQL = S.with_(HITS) + """SELECT path, score, CAST(least(length(text), 30000 - used) AS INT) AS chars,
 sha256(left(text, CAST(30000 - used AS BIGINT))) AS sha256 FROM (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY score DESC, path
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hits) WHERE used < 30000"""


def _benchmark_queries(spark, sf):
    return bridge.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def k3_search_many(spark, sf):
    """Every benchmark text as a query over all documents, the first eight of each."""
    hits = K.search_many(bridge.knowledge_documents(spark, sf), _benchmark_queries(spark, sf), limit=8)
    return hits.select("query_id", "place", "path", "title", "score")


MANY = f"""{_KN}, hay AS (SELECT *, replace(lower(path || ' ' || title || ' ' || text), 'ß', 'ss') AS hay, replace(lower(title), 'ß', 'ss') AS head FROM kn),
terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_\\-]{{3,}}')) AS term FROM benchmark),
points AS (SELECT path, term, CASE WHEN contains(head, term) THEN 3 ELSE 1 END AS points FROM hay JOIN (SELECT DISTINCT term FROM terms) ON contains(hay, term)),
scored AS (SELECT item_id, path, sum(points) AS score FROM points JOIN terms USING (term) GROUP BY ALL),
hits AS (SELECT item_id, kn.path, title, text, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, kn.path) AS place
 FROM scored JOIN kn USING (path) QUALIFY place <= 8)"""
K3_MANY_SQL = S.with_(MANY) + "SELECT item_id AS query_id, CAST(place AS INT) AS place, path, title, CAST(score AS INT) AS score FROM hits"


def k4_context_many(spark, sf):
    """The texts of those hits under a budget of 20,000 characters a query."""
    hits = K.search_many(bridge.knowledge_documents(spark, sf), _benchmark_queries(spark, sf), limit=8)
    cut = K.context_for_many(hits, max_chars=20_000)
    return cut.select("query_id", "place", "path", F.length("text").alias("chars"), H.content_hash(F.col("text")).alias("sha256"))


K4_MANY_SQL = S.with_(MANY) + """SELECT item_id AS query_id, CAST(place AS INT) AS place, path, CAST(least(length(text), 20000 - used) AS INT) AS chars,
 sha256(left(text, CAST(20000 - used AS BIGINT))) AS sha256 FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY item_id ORDER BY place
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hits) WHERE used < 20000 AND length(text) > 0"""


def k5_find_by_title(spark, sf):
    """For the title of every document in capitals: the first document of that title."""
    known = bridge.knowledge_documents(spark, sf)
    asked = known.select("doc_id", F.concat(F.lit("  "), F.upper("title")).alias("wanted"))
    return K.find_by_title(known, asked).select("doc_id", "path")


K5_SQL = S.with_(_KN) + """, named AS (SELECT replace(lower(title), 'ß', 'ss') AS t, min(path) AS path FROM kn GROUP BY 1)
SELECT doc_id, named.path FROM documents JOIN named
 ON t = replace(lower(trim(upper(split_part(text, chr(10), 1)))), 'ß', 'ss') WHERE t <> ''"""


# ---- rules and governance ------------------------------------------------

TAG = "rules"


def rule_documents(spark, sf):
    """A rule document per part: two JSON blocks and a YAML block; some blocks are broken."""
    p = bridge.table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    key = F.col("p_partkey").cast("string")
    price = F.col("p_retailprice").cast("int").cast("string")
    bad = F.col("p_size") % 10 == 0
    scalar = F.col("p_size") % 3 == 0
    body = F.concat(
        F.lit("# "), F.col("p_name"), F.lit("\n\n~~~rules-json\n{\"brand\": \""), F.col("p_brand"),
        F.lit("\", \"limits\": {\"size\": "), size, F.lit(", \"price\": "), price, F.lit("}, \"deep\": {\"c\": {\"d\": {\"e\": {\"f\": {\"g\": 1}}}}, \"v\": 1}}\n~~~\n\n"),
        F.lit("~~~rules-yaml\n# limits of the part\nkind: "), F.col("p_type"), F.lit("\nlimits:\n  size: "), key,
        F.lit("\nfield_aliases:\n  Weight "), size, F.lit(": package.gross_weight\n~~~\n\n~~~rules-json\n"),
        F.when(bad, "[1, 2]").when(scalar, F.concat(F.lit("{\"limits\": "), size, F.lit("}"))).otherwise("{\"more\": {\"a\": 1}, \"none\": {}, \"limits\": {}, \"deep\": {\"c\": {\"d\": {\"e\": {\"f\": {\"h\": 2}}}}, \"v\": {}}}"),
        F.lit("\n~~~\n"),
    )
    return p.select(F.concat(F.lit("vendors/"), key, F.lit(".md")).alias("path"), body.alias("text"))


def n5_rule_blocks(spark, sf):
    blocks = K.rule_blocks(rule_documents(spark, sf), TAG)
    return blocks.select("path", "block_no", "format", "start_line", "error")


N5_SQL = """SELECT 'vendors/' || CAST(p_partkey AS VARCHAR) || '.md' AS path, CAST(b AS INT) AS block_no,
 CASE b WHEN 1 THEN 'yaml' ELSE 'json' END AS format, CAST(CASE b WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 16 END AS INT) AS start_line,
 CASE WHEN b = 2 AND p_size % 10 = 0 THEN 'JSON block at line 16 must contain an object.' END AS error
 FROM part, (VALUES (0), (1), (2)) v(b)"""


def n4_merged_rules(spark, sf):
    """Rules after all sound blocks of a document: later keys win, a scalar over a map drops the map."""
    rules = K.merged_rules(K.rule_entries(K.rule_blocks(rule_documents(spark, sf), TAG)))
    return rules.select("path", F.array_join("keys", "/").alias("key"), "value")


_P = "'vendors/' || CAST(p_partkey AS VARCHAR) || '.md' AS path"
_SCALAR = "(p_size % 10 <> 0 AND p_size % 3 = 0)"
_THIRD = "(p_size % 10 <> 0 AND p_size % 3 <> 0)"
N4_SQL = f"""SELECT {_P}, 'brand' AS key, p_brand AS value FROM part
UNION ALL SELECT {_P}, 'kind', p_type FROM part
UNION ALL SELECT {_P}, 'limits/price', CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR) FROM part WHERE NOT {_SCALAR}
UNION ALL SELECT {_P}, 'limits/size', CAST(p_partkey AS VARCHAR) FROM part WHERE NOT {_SCALAR}
UNION ALL SELECT {_P}, 'limits', CAST(p_size AS VARCHAR) FROM part WHERE {_SCALAR}
UNION ALL SELECT {_P}, 'field_aliases/Weight ' || CAST(p_size AS VARCHAR), 'package.gross_weight' FROM part
UNION ALL SELECT {_P}, 'deep/c/d/e/f/g', '1' FROM part
UNION ALL SELECT {_P}, 'deep/v', CASE WHEN {_THIRD} THEN '{{}}' ELSE '1' END FROM part
UNION ALL SELECT {_P}, k, v FROM part, (VALUES ('more/a', '1'), ('none', '{{}}'), ('deep/c/d/e/f/h', '2')) t(k, v) WHERE {_THIRD}"""


def k13_field_aliases(spark, sf):
    return K.field_aliases(K.merged_rules(K.rule_entries(K.rule_blocks(rule_documents(spark, sf), TAG))))


K13_SQL = f"SELECT {_P}, 'Weight ' || CAST(p_size AS VARCHAR) AS label, 'package.gross_weight' AS field FROM part"


def p8_document_paths(spark, sf):
    """Paths made from pages: what is wrong with them."""
    pages = bridge.table(spark, sf, "pages")
    path = F.regexp_replace("url", "^https?://", "")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(path, F.lit("/../x.md"))).when(
        F.col("page_id") % 3 == 1, F.concat(path, F.lit(".MD"))
    ).otherwise(path)
    return pages.select("page_id", K.path_problem(path).alias("problem"))


P8_SQL = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'path leaves the folder or is malformed'
 WHEN page_id % 3 = 2 AND NOT lower(url) LIKE '%.md' THEN 'not a .md path' END AS problem FROM pages"""


def p10_content_checks(spark, sf):
    """Documents as knowledge content: blank, too long, without a heading, or fine."""
    doc = bridge.documents(spark, sf)
    text = F.when(F.col("lang") == "en", F.concat(F.lit("# "), F.col("text"))).when(
        F.col("lang") == "de", F.lit(" \n")
    ).otherwise(F.col("text"))
    return doc.select("doc_id", K.content_problem(text).alias("problem"))


P10_SQL = """SELECT doc_id, CASE lang WHEN 'en' THEN NULL WHEN 'de' THEN 'blank text'
 ELSE 'no heading of the first level' END AS problem FROM documents"""


def proposals(spark, sf):
    """A change of every rule document: edits, new ones, some that change nothing or miss their document."""
    docs = rule_documents(spark, sf)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    step = number % 4
    requests = docs.select(
        number.alias("proposal_id"),
        F.when(step == 3, "new").otherwise("edit").alias("kind"),
        F.when(step == 1, F.concat(F.lit("vendors/none-"), number.cast("string"), F.lit(".md"))).otherwise(F.col("path")).alias("path"),
        F.when(step == 2, F.col("text")).otherwise(F.concat(F.lit("# New\n\nVersion: 7\n\n"), number.cast("string"))).alias("content"),
    )
    # the blocks of a text that changes nothing may be broken too
    return K.propose(requests, docs, TAG)


def k6_proposals(spark, sf):
    return proposals(spark, sf).select("proposal_id", "status", "reason")


K6_SQL = """SELECT p_partkey AS proposal_id, CASE WHEN p_partkey % 4 = 0 THEN 'pending' ELSE 'refused' END AS status,
 CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'no document at this path'
 WHEN p_partkey % 4 = 3 THEN 'path is taken'
 WHEN p_size % 10 = 0 THEN 'JSON block at line 16 must contain an object.'
 ELSE 'text is the same as before' END AS reason FROM part"""


def k7_applied_proposals(spark, sf):
    """Decided proposals; documents of an even brand number changed in between and conflict.

    Every pending proposal has an older one on a text long gone, which must not
    stand in its way, and a later one on the same text, which comes too late.
    """
    docs = rule_documents(spark, sf)
    moved = F.regexp_extract("text", r"Brand#([0-9]+)", 1).cast("int") % 2 == 0
    now = docs.withColumn("text", F.when(moved, F.concat("text", F.lit("changed\n"))).otherwise(F.col("text")))
    asked = proposals(spark, sf)
    pending = asked.filter(F.col("status") == "pending")
    older = pending.withColumns({"proposal_id": -F.col("proposal_id"), "base_sha256": F.lit("0")})
    later = pending.withColumn("proposal_id", F.col("proposal_id") + LATER)
    decided = K.apply_proposals(asked.unionByName(older).unionByName(later), now)
    return decided.select("proposal_id", "status", "decided_by", "applied_sha256", F.col("problem").isNotNull().alias("refused"))


_ODD = "CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 2 = 1"
LATER = 1_000_000_000_000
K7_SQL = f"""SELECT CAST(p_partkey AS BIGINT) AS proposal_id, CASE WHEN p_partkey % 4 <> 0 THEN 'refused' WHEN {_ODD} THEN 'applied'
 ELSE 'pending' END AS status, CASE WHEN p_partkey % 4 = 0 AND {_ODD} THEN 'user' END AS decided_by,
 CASE WHEN p_partkey % 4 = 0 AND {_ODD} THEN sha256('# New' || chr(10) || chr(10) || 'Version: 1' || chr(10) || chr(10)
 || CAST(p_partkey AS VARCHAR)) END AS applied_sha256, NOT (p_partkey % 4 = 0 AND {_ODD}) AS refused FROM part
UNION ALL SELECT sign * p_partkey + more, 'pending', NULL, NULL, true FROM part, (VALUES (-1, 0), (1, {LATER})) v(sign, more)
 WHERE p_partkey % 4 = 0"""


def k8_rejected_proposals(spark, sf):
    return K.reject_proposals(proposals(spark, sf)).select("proposal_id", "status", "decided_by")


K8_SQL = """SELECT p_partkey AS proposal_id, CASE WHEN p_partkey % 4 = 0 THEN 'rejected' ELSE 'refused' END AS status,
 CASE WHEN p_partkey % 4 = 0 THEN 'user' END AS decided_by FROM part"""


def f22_example_fingerprint(spark, sf):
    rec = bridge.records(spark, sf)
    return rec.select(
        "job_id",
        "pkg_ord",
        H.example_fingerprint(F.lit("gross_weight"), F.col("gross_value"), F.col("net_value"), F.col("weight_unit")).alias("fingerprint"),
    )


F22_SQL = S.with_(S.REC) + """SELECT job_id, pkg_ord, left(sha256('gross_weight|' || coalesce(gross_value, '') || '|'
 || net_value || '|' || weight_unit), 16) AS fingerprint FROM rec"""


def k9_learned_examples(spark, sf):
    """One learned example per part document: its price corrected to its size; every fifth size was not corrected."""
    docs = rule_documents(spark, sf)
    p = bridge.table(spark, sf, "part")
    changes = p.select(
        F.concat(F.lit("vendors/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"),
        F.lit("packages[0].gross_weight").alias("field_path"),
        F.col("p_retailprice").cast("int").cast("string").alias("source_value"),
        F.col("p_size").cast("string").alias("working_value"),
        F.lit(None).cast("string").alias("source_raw"),
        F.lit("Page 1").alias("locator"),
        F.col("p_brand").alias("note"),
        (F.col("p_size") % 5 != 0).alias("modified"),
    )
    out = K.learned_examples(changes, docs, "learned")
    tail = F.regexp_extract("text", r"(?s)(## Learned Mapping Examples.*)$", 1)
    return out.select("path", "fingerprint", H.content_hash(tail).alias("example_sha256"), "problem")


K9_SQL = f"""SELECT {_P}, fp AS fingerprint, CASE WHEN p_size % 5 <> 0 THEN sha256('## Learned Mapping Examples' || chr(10) || chr(10)
 || '### Learned example — packages[0].gross_weight' || chr(10) || chr(10) || '<!-- learned:' || fp || ' -->' || chr(10) || chr(10)
 || '- Canonical field: `packages[0].gross_weight`' || chr(10) || '- Source value: `' || price || '`' || chr(10)
 || '- Expected working value: `' || CAST(p_size AS VARCHAR) || '`' || chr(10) || '- Source locator: Page 1' || chr(10)
 || '- Operator note: ' || p_brand || chr(10)) END AS example_sha256,
 CASE WHEN p_size % 5 = 0 THEN 'field is not changed' END AS problem FROM (
 SELECT *, left(sha256('packages[0].gross_weight|' || price || '|' || CAST(p_size AS VARCHAR) || '||Page 1|' || p_brand), 16) AS fp
 FROM (SELECT *, CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR) AS price FROM part))"""


def k12_line_differences(spark, sf):
    """Lines that change when every part document loses a number and gains an end line."""
    docs = rule_documents(spark, sf)
    proposed = docs.withColumn("text", F.concat(F.regexp_replace("text", "Weight [0-9]+", "Weight"), F.lit("\nend\n")))
    diff = K.line_differences(docs, proposed)
    return diff.select("path", "line", "occurrence", "current_line", "proposed_line", "change")


K12_SQL = f"""SELECT {_P}, '  Weight ' || CAST(p_size AS VARCHAR) || ': package.gross_weight' AS line, CAST(1 AS INT) AS occurrence,
 CAST(13 AS INT) AS current_line, CAST(NULL AS INT) AS proposed_line, 'removed' AS change FROM part
UNION ALL SELECT {_P}, '  Weight: package.gross_weight', 1, NULL, 13, 'added' FROM part
UNION ALL SELECT {_P}, 'end', 1, NULL, 20, 'added' FROM part
UNION ALL SELECT {_P}, '', 4, NULL, 19, 'added' FROM part"""


QUERIES = {
    "s2_csv_table_text": (s2_csv_table_text, S2_SQL),
    "c1_chunks": (c1_chunks, C1_SQL),
    "c2_assembled_text": (c2_assembled_text, C2_SQL),
    "c3_sections": (c3_sections, C3_SQL),
    "c4_segments": (c4_segments, C4_SQL),
    "c5_sliding_segments": (c5_sliding_segments, C5_SQL),
    "c6_segment_rejects": (c6_segment_rejects, C6_SQL),
    "p8_document_paths": (p8_document_paths, P8_SQL),
    "p9_size_rejects": (p9_size_rejects, P9_SQL),
    "p10_content_checks": (p10_content_checks, P10_SQL),
    "p5_graded_locators": (p5_graded_locators, P5_SQL),
    "e1_find_evidence": (e1_find_evidence, E1_SQL),
    "e2_text_for_locators": (e2_text_for_locators, E2_SQL),
    "e2_jobs_without_text": (e2_jobs_without_text, E2_NONE_SQL),
    "e3_excerpts": (e3_excerpts, E3_SQL),
    "f14_title": (f14_title, F14_SQL),
    "f15_version": (f15_version, F15_SQL),
    "f16_indicators": (f16_indicators, F16_SQL),
    "f17_search_terms": (f17_search_terms, F17_SQL),
    "f18_normal_text": (f18_normal_text, F18_SQL),
    "f19_slug": (f19_slug, F19_SQL),
    "f20_page_number": (f20_page_number, F20_SQL),
    "f22_example_fingerprint": (f22_example_fingerprint, F22_SQL),
    "f23_content_hash": (f23_content_hash, F23_SQL),
    "k1_profiles": (k1_profiles, K1_SQL),
    "k2_profile_match": (k2_profile_match, K2_SQL),
    "k2_profile_match_joined": (k2_profile_match_joined, K2_SQL),
    "k2_many_indicators": (k2_many_indicators, K2_MANY_SQL),
    "k3_search_many": (k3_search_many, K3_MANY_SQL),
    "k4_context_many": (k4_context_many, K4_MANY_SQL),
    "k3_search": (k3_search, K3_SQL),
    "k4_context": (k4_context, K4_SQL),
    "k5_find_by_title": (k5_find_by_title, K5_SQL),
    "k6_proposals": (k6_proposals, K6_SQL),
    "k7_applied_proposals": (k7_applied_proposals, K7_SQL),
    "k8_rejected_proposals": (k8_rejected_proposals, K8_SQL),
    "k9_learned_examples": (k9_learned_examples, K9_SQL),
    "k12_line_differences": (k12_line_differences, K12_SQL),
    "k13_field_aliases": (k13_field_aliases, K13_SQL),
    "n4_merged_rules": (n4_merged_rules, N4_SQL),
    "n5_rule_blocks": (n5_rule_blocks, N5_SQL),
}
