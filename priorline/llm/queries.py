"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.llm import bisectors, byte_bpe, decontaminate, jaccard, merkle, packing, pii, quality, secrets, templates, token_counts, toxicity, warc

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_documents(docs: DataFrame, remembered: tuple[int, int] = packing.REMEMBERED, ids: bool = True) -> DataFrame:
    """Documents in sequences of 4096 tokens, each piece with its ids (little-endian, four bytes each) and their checksum."""
    pieces = packing.tokenized_pieces(docs, public_tokenizers.path(WORD_BPE), remembered=remembered)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(pieces if ids else pieces.drop("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), ids=False)


def _digest(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counted(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def op2_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are those of the base rules; ``spans`` also has what the transducers bring to light."""
    return _counted(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.KINDS)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


#: A digest's 40 hex digits are eight groups of 20 bits, each four base-32 digits.
OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as h, max(page_id) over (partition by html) as top from p),
e as (
  select page_id, payload_bytes, top,
    array_to_string(list_transform(range(0, 8), lambda g:
      array_to_string(list_transform([15, 10, 5, 0], lambda b:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 1 + 5 * g, 5) as bigint) >> b) & 31 as int), 1)), '')), '') as payload_digest
  from d)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from e
"""


def op5_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with how many lines it lost, and a digest of what is left."""
    left = templates.without_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("_pl_dropped").alias("n_dropped"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and how many of its shingles were found."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key").distinct()


OP7_SQL = """
with words_of as (
  select 'd' as side, doc_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents
  union all select 'b', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') from benchmark),
s as (
  select distinct side, id, unnest(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) as shingle
  from words_of where len(w) >= 5),
n as (select id, count(*) as n_item_shingles from s where side = 'b' group by id)
select d.id as doc_id, b.id as item_id, n.n_item_shingles, count(*) as n_matched
from s d join s b on d.shingle = b.shingle and d.side = 'd' and b.side = 'b' join n on n.id = b.id
group by all having 100 * count(*) >= 80 * n.n_item_shingles
"""


#: From this score on a document is toxic.
TOXIC_FROM = 0.3


def op8_toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_secret_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are those of the base rules; ``spans`` also has the literals that sensitive names reach."""
    return _counted(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.KINDS)


def op10_jaccard_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Pairs come from shared shingles; labels spread by rounds of minima until none changes.
OP10_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as set from w),
e as (select doc_id, unnest(set) as shingle from s),
n as (select doc_id, len(set) as n_shingles from s),
k as (select doc_id, md5_number(array_to_string(list_sort(set), chr(10))) as sig from s where len(set) > 0),
r as (select sig, min(doc_id) as rep from k group by sig),
f as (select e.doc_id, e.shingle from e join r on e.doc_id = r.rep),
l as (
  select a.doc_id as a, b.doc_id as b from f a join f b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id
  having 100 * count(*) >= 80 * ((select n_shingles from n where n.doc_id = a.doc_id) + (select n_shingles from n where n.doc_id = b.doc_id) - count(*))),
u as (select a, b from l union all select b, a from l),
c as (select rep as x, rep as y from r union select c.x, u.b from c join u on c.y = u.a)
select n.doc_id, n.n_shingles, coalesce(m.component_id, n.doc_id) as component_id
from n left join k on k.doc_id = n.doc_id left join r on r.sig = k.sig left join (select x, min(y) as component_id from c group by x) m on m.x = r.rep
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    path = public_tokenizers.path(BYTE_BPE)
    ids = byte_bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    n_tokens = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return byte_bpe.decoded(ids, path).select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster after five rounds, with a digest of its centroid."""
    found = bisectors.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round assigns by the smallest (distance, number) and takes floors of means."""
    parts = [f"""with v as (
  select vec_id, row_number() over () as rid, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('2:' || vec_id), x) - 1 as c, x from v order by sha256('2:' || vec_id), x limit {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} as (
  select v.rid, v.vec_id, v.x, c.c, c.x as y, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint as d from v cross join c{r} c),
a{r} as (select * from d{r} qualify row_number() over (partition by rid order by d, c) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} as (select c, i, sum(x[i])::bigint as s, count(*) as n from a{r}, range(1, 65) t(i) group by c, i),
m{r} as (select c, list((s - ((s % n) + n) % n) // n order by i) as x from s{r} group by c),
c{r + 1} as (select c.c, coalesce(m.x, c.x) as x from c{r} c left join m{r} m on m.c = c.c)""")
    return ",\n".join(parts) + f"""
select vec_id, cast(c as int) as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
  sha256(array_to_string(y, ',')) as centroid_sha256 from a{rounds}"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether it still folds to the root where a third of the texts lost their capitals."""
    docs = table(spark, sf_dir, "documents")
    row = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.row_digest(*map(F.col, row), lowered))
    leaf = merkle.row_digest(*map(F.col, [*row, "text"]))
    found = merkle.proofs(docs, leaf, F.col("lang"), F.col("doc_id"), touched=touched)
    root = merkle.folded(F.coalesce("touched", "leaf"), F.col("path"))
    found = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(p: str, leaves: str, levels: int) -> str:
    """Common tables of trees over ``leaves`` (tree, pos, h, m): levels {p}0.., siblings {p}s0.., roots {p}r."""
    parts = [f"{p}0 as ({leaves})"]
    for i in range(levels):
        parts.append(f"{p}{i + 1} as (select tree, pos // 8 as pos, sha256(string_agg(h, '' order by pos)) as h, (m + 7) // 8 as m from {p}{i} where m > 1 group by tree, pos // 8, m)")
        parts.append(f"""{p}s{i} as (select a.tree, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from {p}{i} a join {p}{i} b on a.tree = b.tree and a.pos // 8 = b.pos // 8 where a.m > 1 group by a.tree, a.pos)""")
    roots = " union all ".join(f"select tree, h from {p}{i} where m = 1" for i in range(levels + 1))
    return ",\n".join([*parts, f"{p}r as ({roots})"])


def _op13_sql(levels: int = 8, above: int = 3) -> str:
    """Up to 8 ** 8 documents of a language and 8 ** 3 languages: level by level, siblings by self joins, folded step by step."""
    field = lambda x: f"case when {x} is null then '-' else strlen({x}::varchar) || ':' || {x}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
    lambda c, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)"""
    sql = f"""with w as (select doc_id, coalesce('=' || lang, '-') as tree, {leaf("text")} as leaf, case when {crc} % 3 = 0 then {leaf(lower)} end as touched from documents),
d as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as m from w),
{_tree_sql("t", "select tree, pos, leaf as h, m from d", levels)},
{_tree_sql("u", "select '' as tree, row_number() over (order by tree) - 1 as pos, h, count(*) over () as m from tr", above)},
f0 as (select d.doc_id, d.leaf, d.tree, d.pos, q.h as subroot, row_number_of.pos as top, ur.h as root, coalesce(touched, leaf) as node, '' as siblings
  from d join tr q on q.tree = d.tree join (select tree, row_number() over (order by tree) - 1 as pos from tr) row_number_of on row_number_of.tree = d.tree cross join ur)"""
    steps = [("t", i, "f.tree", "f.pos") for i in range(levels)] + [("u", i, "''", "f.top") for i in range(above)]
    for k, (p, i, tree, pos) in enumerate(steps):
        sql += f""",
f{k + 1} as (select f.* replace (case when s.l is null then node else sha256(s.l || node || s.r) end as node, siblings || coalesce(s.l || s.r, '') as siblings)
  from f{k} f left join {p}s{i} s on s.tree = {tree} and s.pos = {pos} // {8**i})"""
    return sql + f"""
select doc_id, leaf, subroot, root, sha256(siblings) as proof_sha256, node as folded_root, node = root as verified from f{len(steps)}"""


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_ratio": op2_quality_ratio,
    "op3_pii_deobfuscation": op3_pii_deobfuscation,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_template_lines": op5_template_lines,
    "op6_trie_token_counts": op6_trie_token_counts,
    "op7_benchmark_containment": op7_benchmark_containment,
    "op8_toxicity_network": op8_toxicity_network,
    "op9_secret_lexing": op9_secret_lexing,
    "op10_jaccard_blocks": op10_jaccard_blocks,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_bisector_clusters": op12_bisector_clusters,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op4_warc_round_trip": OP4_SQL,
    "op7_benchmark_containment": OP7_SQL,
    "op10_jaccard_blocks": OP10_SQL,
    "op12_bisector_clusters": _op12_sql(),
    "op13_merkle_manifest": _op13_sql(),
}
