"""The registered queries of this folder, each over its whole table, and check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import backoff, bpe, collocations, compression, decontamination, hard_negatives, jaccard_join, near_dup, perplexity, sharding, token_counts, toxicity, warc
from cargolens.llm.common import table

SHARD_NAMES = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backoff.scored(table(spark, sf_dir, "documents"))
    return rows.withColumn("log_score", F.round("log_score", 4))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.ruled(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARD_NAMES)


def op10_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("fault")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"), size=3, percent=90)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside_percent=50, most=2000)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: ASCII letters and digits and everything from U+0080 on, A-Z as a-z.
SIGN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: documents that hold windows of benchmark, each window compared as one string of words.
DECONTAMINATION = f"""
with d as (select doc_id, {SIGN_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item_id, {SIGN_WORDS} as w from benchmark where item_id is not null),
starts as (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0),
windows as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from starts),
sizes as (select distinct k from windows),
places as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k),
found as (select doc_id, item_id, i, p.k from (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g from places) p join windows v on p.k = v.k and p.g = v.g),
hits as (select doc_id, count(distinct i + j) as n_hit from (select doc_id, i, unnest(range(k)) as j from found) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as sha from (select distinct doc_id, item_id from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""


#: Links of distinct shingle sets, found by their shared shingles, and the smallest id each document reaches.
NEAR_DUPLICATES = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] end)) as s from w),
classes as (select min(doc_id) as id, s from sets where len(s) > 0 group by s),
grams as (select id, len(s) as n, unnest(s) as g from classes),
shared as (select a.id as a, b.id as b, a.n as an, b.n as bn, count(*) as both_n from grams a join grams b on a.g = b.g and a.id < b.id where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
links as (select a, b from shared where 100 * both_n >= 85 * (an + bn - both_n)),
both_ways as (select a, b from links union all select b, a from links),
reached(id, node) as (select id, id from classes union select r.id, b.b from reached r join both_ways b on r.node = b.a),
smallest as (select id, min(node) as component_id from reached group by id)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(component_id, s.doc_id) as component_id, s.doc_id = coalesce(component_id, s.doc_id) as kept
from sets s left join classes c on s.s = c.s left join smallest l on l.id = c.id
"""


#: The same at 90 per cent; which document is kept is not asked.
NGRAM_JACCARD = f"select doc_id, n_shingles, component_id from ({NEAR_DUPLICATES.replace('85', '90')})"


#: Scores by pairs seen twice or more; every word backs off to its own count.
STUPID_BACKOFF = f"""
with d as (select doc_id, {SIGN_WORDS} as w from documents),
every as (select doc_id, i, w[i] as w from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
words as (select doc_id, i, w, lag(w) over (partition by doc_id order by i) as v from every),
singles as (select w, count(*) as n from words group by w),
pairs as (select v, w, count(*) as n from words where v is not null group by v, w having count(*) >= 2),
total as (select count(*) as n from words),
each as (select doc_id, case when words.v is null then ln(s.n) - ln(t.n) when p.n is not null then ln(p.n) - ln(f.n) else ln(0.4) + ln(s.n) - ln(t.n) end as score,
  words.v is not null and p.n is null as backed
  from words join singles s on s.w = words.w left join singles f on f.w = words.v left join pairs p on p.v = words.v and p.w = words.w cross join total t)
select d.doc_id, cast(len(w) as bigint) as n_words, round(coalesce(score, 0), 4) as log_score, cast(coalesce(backed, 0) as bigint) as n_backoffs
from d left join (select doc_id, sum(score) as score, count(*) filter (backed) as backed from each group by doc_id) using (doc_id)
"""


#: All runs of one to three words of each language counted as strings.
COLLOCATIONS = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
runs as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 4) s(k) where len(w) >= k)),
f as materialized (select lang, k as size, phrase, count(*) as n from runs group by all),
totals as (select lang, sum(n) as n from f where size = 1 group by lang),
c as materialized (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from f where size > 1 and n >= 10),
parts as materialized (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as p, array_to_string(w[k + 1:], ' ') as q from (select *, unnest(range(1, size)) as k from c)),
cuts as (select parts.lang, parts.phrase, a, k, x.n as l, y.n as r, (1000000::hugeint * a * a) // (x.n::hugeint * y.n) as score
  from parts join f x on x.lang = parts.lang and x.phrase = parts.p join f y on y.lang = parts.lang and y.phrase = parts.q),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, phrase, max(a) as a from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from c where size = 3) group by all),
kept as (select s.* from lowest s left join longer g on g.lang = s.lang and g.phrase = s.phrase where g.a is null or 100 * g.a < 50 * s.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(totals.n as bigint) as n, cast(score as bigint) as score
from kept join totals using (lang) qualify rank <= 2000
"""


#: Every anchor's score with every row.
HARD_NEGATIVES = """
with usable as (select distinct vec_id, label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([1 for x in embedding if x is null or not isfinite(cast(x as double))]) = 0),
rows as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, v from usable),
scores as (select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id as id, b.label as label,
  cast(coalesce(list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]), 0) as bigint) as score
  from rows a, rows b where a.vec_id % 100 = 0),
positives as (select anchor_id, anchor_label, id as positive_id, score as positive_score from scores where label = anchor_label and id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
windows as (select p.anchor_id, positive_id, positive_score, s.id as negative_id, s.score as negative_score,
  row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and s.label <> p.anchor_label
  where 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from windows where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": NEAR_DUPLICATES,
        "op2_benchmark_decontamination": DECONTAMINATION,
        "op3_stupid_backoff": STUPID_BACKOFF,
        "op11_ngram_jaccard_join": NGRAM_JACCARD,
        "op12_phrase_collocations": COLLOCATIONS,
        "op13_hard_negatives": HARD_NEGATIVES,
    }
