"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sstable import token_shards

    return token_shards(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))[1]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_gbt import judge, seed_labels

    pages = table(spark, sf_dir, "pages")
    return judge(pages, seed_labels(pages))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sp_scan import round_trip

    return round_trip(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules, trusted_documents

    docs = _documents(spark, sf_dir)
    return quality_rules(trusted_documents(docs, table(spark, sf_dir, "labels")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ring import shard

    return shard(_documents(spark, sf_dir), 40)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality

    return quality(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hd_lang import languages

    return languages(_documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    return decontaminate(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_documents(spark, sf_dir))[0]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_shards, op2_url_filter, op3_token_counts, op4_sentencepiece, op5_ngram_jaccard, op6_quality_rules, op7_sharding, op8_quality_classifier, op9_language_id, op10_decontamination, op11_whitening, op12_source_mix, op13_spelling_variants)
}

#: Other operators hash, train or tokenize, which SQL doesn't; their tests hold them against brute force.
SQL: dict[str, str] = {
    "op5_ngram_jaccard": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
tokens as (select doc_id, unnest(s) as t from sets),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
ways as (select a, b from links union all select b, a from links),
reached as (select doc_id as a, doc_id as b from documents union select r.a, k.b from reached r join ways k on k.a = r.b)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.b) as component_id from sets s join reached r on r.a = s.doc_id group by all""",
    "op12_source_mix": r"""
with recursive texts as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
sums as (select source, sum(size)::bigint as size, row_number() over (order by source nulls last) - 1 as rank from texts group by source),
sources as (select *, [1, 2, 3][rank % 3 + 1] as weight from sums),
water as (select 0 as round, sum(size)::hugeint as words, sum(weight)::hugeint as weights from sources
  union all
  select round + 1, (select sum(size) from sources) - 3 * coalesce(sum(s.size) filter (s.weight * a.words > 3 * s.size * a.weights), 0), (select sum(weight) from sources) - coalesce(sum(s.weight) filter (s.weight * a.words > 3 * s.size * a.weights), 0)
  from water a, sources s group by round, a.words, a.weights
  having a.words <> (select sum(size) from sources) - 3 * coalesce(sum(s.size) filter (s.weight * a.words > 3 * s.size * a.weights), 0)),
level as (select words, weights from water order by round desc limit 1),
targets as (select s.*, case when weight * words > 3 * size * weights then 3.0 * size else (weight * words)::double / weights::double end::double as target from sources s, level),
unit as (select greatest(1, least(32, sum(size) // 65536))::bigint as block, ceil(sum(size) / greatest(1, least(32, sum(size) // 65536)))::bigint as blocks from sources),
quotients as (select source, target / (2 * k + 1) as q, rank from (select *, unnest(range(0, ((3 * size + block - 1) // block)::bigint)) as k from targets, unit) where target > 0),
seats as (select source, count(*) as seats from (select source from quotients order by q desc, rank limit (select blocks from unit)) group by source),
drawn as (select t.source, t.size, t.target, block, size // block as n_full, least(coalesce(seats, 0) * block, 3 * size) as drawn from targets t cross join unit left join seats s on s.source is not distinct from t.source),
rest as (select *, drawn // greatest(size, 1) as whole, drawn % greatest(size, 1) as rest from drawn),
picks as (select *, least(n_full, rest // block) as picked, ('0x' || substr(md5('12:' || coalesce(source, '')), 1, 15))::bigint % greatest(n_full, 1) as start from rest),
streams as (select doc_id, source, size, coalesce(sum(size) over (partition by source order by md5('12:' || coalesce(doc_id::varchar, '') || ':' || size), doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as first, row_number() over () as line from texts),
placed as (select line, source, unnest(range(first, first + size)) as pos from streams),
extra as (select p.line, count(*) as n from placed p join picks k on k.source is not distinct from p.source
  where case when pos < n_full * block then ((pos // block + 1)::hugeint * picked + start) // n_full > ((pos // block)::hugeint * picked + start) // n_full else pos - n_full * block < rest - picked * block end group by line)
select s.doc_id, s.source, s.size, k.size as source_size, k.target, (k.whole * s.size + coalesce(e.n, 0))::bigint as taken from streams s join picks k on k.source is not distinct from s.source left join extra e on e.line = s.line""",
    "op13_spelling_variants": r"""
with recursive runs as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) where length(run) >= 5 group by all),
crcs as (select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
hashed as (select run, n, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '..'), lambda x: ('0x' || x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from runs, crcs),
written as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from written where length(word) >= 5 group by word having sum(n) >= 3),
keys as (select word, n, substr(word, 1, i) || '*' || substr(word, i + 2) as key from words, unnest(range(length(word))) u(i) union select word, n, substr(word, 1, i) || '*' || substr(word, i + 1) from words, unnest(range(length(word) + 1)) u(i)),
near as (select distinct a.word, a.n, b.word as other, b.n as other_n from keys a join keys b on a.key = b.key and a.word <> b.word),
best as (select *, row_number() over (partition by word order by other_n desc, other) as k, count(*) over (partition by word) as n_near from near),
forms as (select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when b.other_n >= 2 * w.n then b.other end as form, case when b.other_n >= 2 * w.n then b.other_n end as form_n from words w left join best b on b.word = w.word and b.k = 1),
chains as (select word, word as pos from forms union all select c.word, f.form from chains c join forms f on f.word = c.pos where f.form is not null)
select f.word, f.n, f.n_near, f.form, f.form_n, c.pos as root from forms f join chains c on c.word = f.word join forms l on l.word = c.pos and l.form is null""",
}
