"""The queries of the operators, with their production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, clusters, knn, lines, lm, minhash, ordinal, packing, pages, suffixes, toxicity, tries, webp
from tidemark.llm.text import crc_mod, documents


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.coalesce(crc_mod(10) != 0, F.lit(False))
    scored = lm.score(documents(spark, sf_dir), training)
    return scored.select("doc_id", (~training).alias("held_out"), *scored.columns[1:])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grades: 0 of low quality, 1 of high quality but toxic, 2 of high quality and not toxic. Fitted to ids whose
    crc32 modulo 3 is not 1; documents are kept that reach grade 1 with at least even chances."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod(3) != 1)
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, F.when(F.col("toxic") > 0, 1).otherwise(2))
    scored = ordinal.fit(docs, labels.select("doc_id", grade.alias("grade"))).score(docs, 1)
    return scored.select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), *scored.columns[1:])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod(3) != 1)
    scored = toxicity.fit(docs, labels).score(docs)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", predicted)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.features(webp.store(documents(spark, sf_dir)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(documents(spark, sf_dir))


def op10_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knn.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return knn.top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(clusters.scaled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_webp": op5_webp,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_bpe": op8_bpe,
    "op9_minhash": op9_minhash,
    "op10_knn": op10_knn,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_page_text": op12_page_text,
    "op13_exponion": op13_exponion,
}


def _clusters_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds written out one after another, each over all pairs of vector and centroid."""
    parts = [
        f"""kept as (
            select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), c0 as (
            select row_number() over (order by key, v) - 1 as cluster, v as c
            from (select v, sha256('2:' || vec_id) as key from kept where vec_id is not null order by key, v limit {k})
        )"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} as (
            select row, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(cluster, (d, cluster)) as cluster, min(d) as d
            from (
                select row, vec_id, v, cluster,
                       list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
                from kept cross join c{i}
            ) group by row
        )"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} as (
            select cluster, list(floor_mean order by pos) as c from (
                select cluster, pos, ((s - ((s % n) + n) % n) // n)::bigint as floor_mean from (
                    select cluster, pos, sum(x)::bigint as s, count(*) as n
                    from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as pos from a{i}) group by cluster, pos
                )
            ) group by cluster
        ), c{i + 1} as (
            select c{i}.cluster, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} on m{i}.cluster = c{i}.cluster
        )"""
            )
    return f"""
        with {", ".join(parts)}
        select vec_id, a{rounds}.cluster::int as cluster, d as distance,
               (sum(d) over (partition by a{rounds}.cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
               sha256(array_to_string(c, ',')) as centroid_sha256
        from a{rounds} join c{rounds} on c{rounds}.cluster = a{rounds}.cluster
    """


#: The other operators can't be written in SQL: tokenizers, trained models, stored media.
ORACLE_SQL = {
    "op4_line_dedup": r"""
        with lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents
        ), keyed as (
            select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines
        ), owned as (
            select *, min(doc_id) over (partition by key) as owner from keyed
        ), judged as (
            select *, length(key) >= 10 and owner <> doc_id as gone from owned
        )
        select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from judged group by doc_id
    """,
    "op10_knn": r"""
        with whole as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
            from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
        )
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
        from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
    """,
    "op11_prefix_trie": r"""
        with steps as (
            select list_reduce(range(8)::bigint[], lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end, i) as t, i
            from (select unnest(range(256)::bigint[]) as i)
        ), crc as (select list(t order by i) as crc_table from steps),
        t as (
            select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                   row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
            from conversations where conv_id is not null
        ), sized as (
            select c, count(*) as n from t group by c
        ), convs as (
            select s.c, s.c - s.c % 5 as first, s.n,
                   xor(list_reduce(list_transform(string_split(s.c::varchar, ''), lambda x: ascii(x)::bigint),
                       lambda a, b: xor(a // 256, crc_table[xor(a, b) % 256 + 1]), 4294967295::bigint), 4294967295::bigint) % 9 as h
            from sized s, crc
        ), shared as (
            select v.*, least(v.h, coalesce(f.n, 0)) as b from convs v left join sized f on f.c = v.first
        ), rebuilt as (
            select v.c, t.pos as d, t.role, t.text from shared v join t on t.c = v.first and t.pos <= v.b
            union all
            select v.c, t.pos - v.h + v.b, t.role, t.text from shared v join t on t.c = v.c and t.pos > v.h
        ), prefixes as (
            select c, d, list({'role': role, 'text': text}) over (partition by c order by d) as key, text from rebuilt
            union all
            select c, 0, [], '' from convs
        ), ended as (
            select *, d = max(d) over (partition by c) as is_end from prefixes
        ), nodes as (
            select d, key, min(c) as conv_id, count(*) as n_convs, any_value(strlen(text)) as bytes,
                   sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where is_end), '')) as ends_sha256
            from ended group by d, key
        ), linked as (
            select n.*, p.conv_id as parent_conv_id from nodes n left join nodes p on p.d = n.d - 1 and p.key = n.key[:n.d - 1]
        ), counted as (
            select l.*, (select count(*) from linked k where k.parent_conv_id = l.conv_id and k.d = l.d + 1) as n_children from linked l
        ), subtrees as (
            select a.d, a.conv_id, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.bytes) as saved_tokens
            from counted b join prefixes x on x.c = b.conv_id and x.d <= b.d join counted a on a.d = x.d and a.key = x.key
            group by a.d, a.conv_id
        )
        select c.conv_id, c.d::bigint as depth, c.parent_conv_id, c.n_convs::bigint as n_convs, c.n_children::bigint as n_children,
               s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, c.ends_sha256
        from counted c join subtrees s on s.d = c.d and s.conv_id = c.conv_id
    """,
    "op13_exponion": _clusters_sql(40, 5),
}
