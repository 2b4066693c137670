"""Registered queries of this folder and their SQL, by name.

A query gets its rows from an operator, with production parameters, over the whole of its table.
Queries without SQL have a brute-force counterpart in `tests/llm`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm import (
    block_repeats,
    bpe,
    fingerprints,
    html_extract,
    licenses,
    manifest,
    near_dedup,
    packing,
    quality,
    simhash,
    suffix_dedup,
    warc,
    whitening,
)
from tallylog.llm.shared import cut, fresh_folder, remove_folder, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pieces of up to 2048 tokens, packed into sequences of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document and the bytes they decode to, as digests."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each document and whether it is kept."""
    measured = quality.add_measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = cut(measured.drop("text"))  # numbers only; the model's counts and its use read them
    return quality.judge(held, quality.fit(held)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good",
    )


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that SQL can express: measures and the base rule."""
    measured = quality.add_measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.withColumn("base_failed", quality.base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express: words, places and labels of the base phrases."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that stand anywhere else."""
    kept = suffix_dedup.kept_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of each document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document beside those of its edited form and of the next document."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their four-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op9_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 35-word passages that stand anywhere else."""
    kept = block_repeats.kept_words(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back. What was read is held, without payloads, and
    the archives go."""
    folder = fresh_folder(spark, "warc")
    archives = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = cut(warc.read_archives(archives, folder, with_payload=False).select(names))
    remove_folder(spark, folder)
    return found


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and its component of fingerprints four bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of each embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op12 that SQL can express: exact deviations from the mean."""
    return whitening.deviations(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle tree over all documents, with a proof for each and what tampering does to it."""
    return manifest.manifest(table(spark, sf_dir, "documents"))


# The pages' markup in SQL: the article, its blocks ended by a space, and the references that occur.
OP1_SQL = r"""
with articles as (
    select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as body from pages
), plain as (
    select page_id, url, regexp_replace(regexp_replace(body, '</?(?:p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') as body
    from articles
), decoded as (
    select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        body, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') as body
    from plain
)
select page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) as text,
       length(trim(regexp_replace(body, '\s+', ' ', 'g'))) as n_chars
from decoded
"""

QUALITY_SQL = r"""
with words as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
    from documents
), lines as (
    select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from words
), grams as (
    select doc_id, p, array_to_string(ws[p:p+2], ' ') as gram
    from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as p from words)
), twice as (
    select doc_id, p from grams qualify count(*) over (partition by doc_id, gram) > 1
), covered as (
    select doc_id, count(distinct i) as n from (select doc_id, unnest(range(p, p + 3)) as i from twice) group by 1
), measured as (
    select doc_id, len(ws) as n_words,
           CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as BIGINT) as word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
           len(ls) - len(list_distinct(ls)) as n_dup_lines,
           coalesce(n, 0) as n_repeat_words
    from words join lines using (doc_id) left join covered using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured
"""

LICENSE_SQL = r"""
with words as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
    from documents
), places as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from words),
found as (
    select doc_id, p - 1 as place, case
        when ws[p] = 'mit' and ws[p+1] = 'license' then 'mit'
        when ws[p] = 'apache' and ws[p+1] = 'license' then 'apache'
        when ws[p] = 'general' and ws[p+1] = 'public' and ws[p+2] = 'license' then 'gpl' end as label
    from places
), summed as (
    select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word,
           string_agg(distinct label, ',' order by label) as base_labels
    from found where label is not null group by 1
)
select doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels
from words left join summed using (doc_id)
"""

OP8_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as ws
    from documents
), sets as (
    select doc_id, case
        when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')))
        when len(ws) > 0 then [array_to_string(ws, ' ')]
        else [] end as shingles
    from words
), sizes as (select doc_id, len(shingles) as n from sets),
shingles as (select doc_id, unnest(shingles) as shingle from sets),
shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * common >= 80 * (x.n + y.n - common)
), edges as (select a, b from links union all select b, a from links),
reached as (
    select doc_id as start, doc_id as node from documents
    union
    select start, b from reached join edges on a = node
), components as (select start as doc_id, min(node) as component_id from reached group by 1)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept
from sizes join components using (doc_id)
"""

OP9_SQL = r"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as (
    select doc_id, p, array_to_string(ws[p:p+34], ' ') as shown
    from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as p from words)
), repeats as (
    select doc_id, p from windows qualify count(*) over (partition by shown) > 1
), covered as (select distinct doc_id, unnest(range(p, p + 35)) as i from repeats),
placed as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from words),
kept as (
    select doc_id, string_agg(word, ' ' order by i) as shown, count(*) as n
    from placed anti join covered using (doc_id, i) group by 1
)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(shown, '')) as kept_sha256
from words left join kept using (doc_id)
"""

OP10_SQL = """
with payloads as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
    from pages
), largest as (
    select *, max(page_id) over (partition by payload_digest, payload_bytes) as last_id from payloads
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last_id then last_id end as refers_to
from largest
"""

DEVIATION_SQL = """
with good as (
    select vec_id, embedding, row_number() over () as row_id from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c::double))) = 0
), x as (
    select row_id, vec_id, unnest(range(len(embedding))) as dim,
           unnest(list_transform(embedding, lambda c: floor(1024 * c::double)::bigint + 100000))::hugeint as x from good
), sums as (select dim, sum(x)::hugeint as s, count(*)::hugeint as n from x group by dim)
select vec_id, any_value(n)::bigint as n, sum((n * x - s) * (n * x - s))::bigint as deviation
from x join sums using (dim) group by row_id, vec_id
"""


def _manifest_sql(levels: int = 6, top_levels: int = 4) -> str:
    """The manifest in SQL, for sources of up to 16 ** levels rows. Level k of a tree is grouped
    from the one below where the tree has more than 16 ** (k - 1) leaves."""
    field = lambda value: f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # one byte of the CRC: eight shifts, each with the polynomial where a bit falls out
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    digits = "list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {digits}), lambda c, b: {step}), 4294967295)"

    def tree(name: str, group: str, depth: int) -> str:
        parts = []
        for k in range(depth):
            near = f"over (partition by {group}, i // 16 order by i rows between"
            parts.append(f"""{name}{k}s as (select *,
                case when n > {16**k} then coalesce(string_agg(node, '') {near} unbounded preceding and 1 preceding), '') end as l,
                case when n > {16**k} then coalesce(string_agg(node, '') {near} 1 following and unbounded following), '') end as r
                from {name}{k})""")
            parts.append(f"""{name}{k + 1} as (select {group}, i // 16 as i, any_value(n) as n,
                case when any_value(n) > {16**k} then sha256(string_agg(node, '' order by i)) else any_value(node) end as node
                from {name}{k} group by {group}, i // 16)""")
        return ",\n".join(parts)

    def climb(name: str, group: str, depth: int, start: str) -> tuple[str, str, str]:
        joins, proof, node = "", [], start
        for k in range(depth):
            t = f"{name}{k}s"
            joins += f" join {t} on {t}.{group} is not distinct from d.{group} and {t}.i = d.{name}_i // {16**k}"
            proof.append(f"coalesce({t}.l || {t}.r, '')")
            node = f"case when {t}.l is null then {node} else sha256({t}.l || {node} || {t}.r) end"
        return joins, " || ".join(proof), node

    own, own_proof, folded = climb("a", "source", levels, "d.shown")
    top, top_proof, ended = climb("b", "whole", top_levels, "d.folded")
    return f"""
with plain as (select doc_id, source, {leaf("text")} as leaf, case when {crc} % 5 = 0 then {leaf(lowered)} end as other from documents),
leaves as (
    select doc_id, source, leaf as node, coalesce(other, leaf) as shown, count(*) over (partition by source) as n,
           row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i
    from plain
), a0 as (select source, i, n, node from leaves),
{tree("a", "source", levels)},
subroots as (
    select source, node, 0 as whole, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n
    from a{levels}
), b0 as (select whole, i, n, node from subroots),
{tree("b", "whole", top_levels)},
within as (
    select d.doc_id, d.source, d.node as leaf, {own_proof} as proof, {folded} as folded
    from (select *, i as a_i from leaves) d {own}
), placed as (
    select w.*, s.node as subroot, s.whole, s.i as b_i from within w join subroots s on s.source is not distinct from w.source
)
select d.doc_id, d.leaf, d.subroot, r.node as root, sha256(d.proof || {top_proof}) as proof_sha256,
       {ended} as folded_root, {ended} = r.node as verified
from placed d cross join b{top_levels} r {top}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_fingerprints": op7_fingerprints,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_block_repeats": op9_block_repeats,
    "op10_warc": op10_warc,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
    "embedding_deviations": embedding_deviations,
    "quality_measures": quality_measures,
    "license_places": license_places,
}

ORACLES: dict[str, str] = {
    "op1_html_extraction": OP1_SQL,
    "quality_measures": QUALITY_SQL,
    "license_places": LICENSE_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op9_block_repeats": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op13_merkle_manifest": _manifest_sql(),
    "embedding_deviations": DEVIATION_SQL,
}
