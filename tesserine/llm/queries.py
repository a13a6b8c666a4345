"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language, line_dedup, neighbours, packing, quality, secrets, simhash, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_language_id(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "pages"), language.taught(_table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.strip_boilerplate(docs).select(F.col("c0").alias("doc_id"), "n_lines", "n_removed", F.sha2("clean", 256).alias("clean_sha256"))


def op6_secret_scans(spark, sf_dir):
    return secrets.secret_rows(_table(spark, sf_dir, "documents"))


def op7_nearest(spark, sf_dir):
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op8_bpe(spark, sf_dir):
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, toxicity.taught(docs, _table(spark, sf_dir, "labels")))


def op10_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, quality.taught(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_language_id, op4_best_fit_packing, op5_line_dedup, op6_secret_scans, op7_nearest, op8_bpe, op9_toxicity, op10_quality)}

_EXACT = r"""
with d as (
  select doc_id, coalesce(text, '') as body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as squeezed from documents
), r as (
  select *, row_number() over (partition by squeezed order by length(body) desc, doc_id) as place,
         count(*) over (partition by squeezed) as group_size,
         first_value(doc_id) over (partition by squeezed order by length(body) desc, doc_id) as keep_id
  from d
)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(squeezed) as text_sha256 from r
"""

_LINES = rf"""
with d as (select row_number() over () as rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (select rid, doc_id, source, i, parts[i] as line, regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as bare
      from d, unnest(range(1, len(parts) + 1)) as u(i)),
b as (select bare from l where bare <> '' group by bare having count(distinct source) >= {line_dedup.MIN_SITES})
select l.doc_id, count(*) as n_lines, count(b.bare) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where b.bare is null), '')) as clean_sha256
from l left join b using (bare) group by l.rid, l.doc_id
"""


def _secrets_sql() -> str:
    """Gaps and matches alternate, so running sums of their lengths give the places."""
    parts = []
    for k, rule in enumerate(secrets.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""
  select rid, {k} as kind, '{rule.kind}' as name, start_at as start, start_at + len_hit as stop from (
    select rid, len_part, len_hit, sum(len_gap + coalesce(lag_hit, 0)) over (partition by rid order by i) as start_at from (
      select rid, i, length(gaps[i]) as len_gap, length(hits[i]) as len_hit, length(parts[i]) as len_part, length(hits[i - 1]) as lag_hit
      from (select rid, string_split_regex(body, '{p}') as gaps, regexp_extract_all(body, '{p}') as hits,
                   regexp_extract_all(body, '{p}', {rule.group}) as parts from d where regexp_matches(body, '{p}')) z,
           unnest(range(1, len(hits) + 1)) as u(i)
    )
  ) where len_part >= {rule.least}""")
    spans = " union all ".join(parts)
    base = len([r for r in secrets.RULES if r.base])
    counts = ", ".join(f"count(kind) filter (where kind = {k}) as n_{r.kind}" for k, r in enumerate(secrets.RULES) if r.base)
    line = "name || ':' || start::bigint || ':' || stop::bigint"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as body from documents), s as ({spans})
select doc_id, {counts},
  sha256(coalesce(string_agg({line}, ',' order by start, kind) filter (where kind < {base}), '')) as base_sha256,
  coalesce(string_agg({line}, ',' order by start, kind), '') as spans
from d left join s using (rid) group by rid, doc_id"""


SQL = {"op2_exact_dedup": _EXACT, "op5_line_dedup": _LINES, "op6_secret_scans": _secrets_sql()}
