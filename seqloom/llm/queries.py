"""Queries of the operators for training data, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.letters import letters, name_fields
from seqloom.llm.components import components
from seqloom.llm.copies import collapse, copies
from seqloom.llm.forest import distinct_texts, expand_copies, near_pairs
from seqloom.llm.mixing import mix, share_report
from seqloom.llm.names import link_mentions, mention_pairs
from seqloom.llm.packing import fill_report, pack, window_report
from seqloom.llm.pieces import split_items
from seqloom.llm.tokens import sized
from seqloom.llm.truncation import find_truncated, truncation_rates
from seqloom.session import cut_lineage, table


def _letters(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The sequences of each table that holds near-duplicates, as letters."""
    ids = {"fasta": "fasta_id", "fastq": "read_row_id"}
    return {t: table(spark, d, t).select(F.col(i).alias("id"), letters(F.col("sequence")).alias("letters")) for t, i in ids.items()}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    def pairs(item: tuple[str, DataFrame]) -> DataFrame:
        t, x = item
        texts = distinct_texts(x, "id", "letters", 9)
        return expand_copies(near_pairs(x, "id", "letters", texts=texts), x, "id", "letters", texts=texts).select(F.lit(t).alias("src"), "id_a", "id_b")

    with ThreadPoolExecutor(2) as both:  # the two tables' jobs fill each other's idle cores
        fasta, fastq = both.map(pairs, _letters(spark, d).items())
    return fasta.unionByName(fastq)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups that the pairs of distinct texts form: each representative with its group, the smallest id in it, and its links."""
    out = []
    for t, x in _letters(spark, d).items():
        pairs = near_pairs(x, "id", "letters")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        out.append(components(pairs, "a", "b").join(ends, "node").select(F.lit(t).alias("src"), F.col("node").alias("rep_id"), F.col("component").alias("group_id"), "n_links"))
    return out[0].unionByName(out[1])


def _layouts(spark: SparkSession, d: str) -> DataFrame:
    """Ids and canonical texts of both tables that hold records in many layouts."""
    fasta = table(spark, d, "fasta").select(F.lit("fasta").alias("src"), F.col("fasta_id").alias("id"), letters(F.col("sequence")).alias("seq"), name_fields(F.col("name")).alias("name"))
    features = table(spark, d, "features").select(F.lit("features").alias("src"), F.col("feature_id").alias("id"), letters(F.col("sequence")).alias("seq"), F.lit("").alias("name"))
    both = fasta.unionByName(features).where("seq != '' and name is not null")
    return both.select("src", "id", F.concat_ws("\n", "seq", "name").alias("canon"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(_layouts(spark, d), "id", F.col("canon"), F.col("src")).select(F.col("g").alias("src"), "first_id", "copy_id")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return collapse(_layouts(spark, d), "id", F.col("canon"), F.col("src")).select(F.col("g").alias("src"), "first_id", "n_copies")


def _limits(spark: SparkSession, d: str) -> dict[str, int]:
    """run_limits: a fixed table of a few rows."""
    return {r.limit_name: r.limit_value for r in table(spark, d, "run_limits").collect()}


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    k = _limits(spark, d)
    parts = [
        table(spark, d, "genbank").select(F.lit("genbank").alias("src"), F.col("record_id").alias("item_id"), "sequence"),
        table(spark, d, "fasta").select(F.lit("fasta").alias("src"), F.col("fasta_id").cast("string").alias("item_id"), "sequence"),
    ]
    sizes = {"limit": k["piece_max_residues"], "overlap": k["piece_overlap_residues"], "gap_min": k["gap_min_n"]}
    return split_items(parts[0].unionByName(parts[1]), "item_id", "sequence", group=F.col("src"), **sizes)


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that were cut: those of whose pieces there is a first one."""
    return _pieces(spark, d).where("piece_no = 0").select("src", "item_id")


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    """Each item put together again from its pieces, without the overlaps, and whether all pieces keep to the limit and overlap as asked."""
    k = _limits(spark, d)
    own = F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("new"))
    whole = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["new"]), ""))
    fits = F.bool_and((F.length("piece") <= k["piece_max_residues"]) & (F.col("overlap") == F.when(F.col("piece_no") == 0, 0).otherwise(k["piece_overlap_residues"])) & (F.length("piece") == F.col("end_pos") - F.col("start_pos")))
    return _pieces(spark, d).groupBy("src", "item_id").agg(F.max("end_pos").alias("n_letters"), whole.alias("digest"), fits.alias("fits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mention_pairs(link_mentions(table(spark, d, "genbank_refs")))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with the number of their mentions and spellings."""
    linked = link_mentions(table(spark, d, "genbank_refs"))
    return linked.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("raw").alias("n_spellings"))


def _targets(spark: SparkSession, d: str) -> dict[str, tuple[float, int]]:
    """mix_targets: a fixed table of a row for each source."""
    return {r.source: (r.target_share, r.max_repeats) for r in table(spark, d, "mix_targets").collect()}


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    shares = {s: x for s, (x, _) in _targets(spark, d).items()}
    return pack(table(spark, d, "documents"), capacity=_limits(spark, d)["container_tokens"], targets=shares)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_pack(spark, d), _limits(spark, d)["container_tokens"])


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """What packing must keep: texts once, pieces that follow each other and only of texts larger than a container, containers within bounds, every token."""
    capacity = _limits(spark, d)["container_tokens"]
    packed = cut_lineage(p8_pack(spark, d))
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("from_token") != F.col("piece_no") * capacity).alias("odd"), F.max("piece_no").alias("last"))
    own = texts.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("odd") > 0) | (F.col("n") != F.col("last") + 1)).alias("n_gaps"), F.count_if((F.col("n") > 1) & (F.col("t") <= capacity)).alias("n_split_within"))
    before = Window.partitionBy("container_id").orderBy("start_token", "n_tokens")
    end = F.col("start_token") + F.col("n_tokens")
    placed = packed.select("container_id", end.alias("end"), (F.coalesce(F.lag(end).over(before), F.lit(0)) != F.col("start_token")).alias("off"))
    boxes = placed.agg(F.count_if(F.col("end") > capacity).alias("n_overfull"), F.count_if("off").alias("n_overlaps"))
    had = sized(table(spark, d, "documents"), "doc_id", "text", "source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("had"))
    lost = had.crossJoin(packed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("has"))).select((F.col("had") - F.col("has")).alias("n_lost_tokens"))
    return own.crossJoin(boxes).crossJoin(lost)  # one row each


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """How near every window keeps to the targets."""
    return window_report(p8_pack(spark, d), {s: x for s, (x, _) in _targets(spark, d).items()})


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), _targets(spark, d))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source with text has its share, to a hundredth of all tokens, and keeps to its repeats."""
    targets = _targets(spark, d)
    mixed = cut_lineage(p9_mix(spark, d))
    report = share_report(spark, mixed, targets).where("n_texts > 0")
    due = F.round(F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(0))), 6)
    most = spark.createDataFrame([(s, m) for s, (_, m) in targets.items()], "source string, m int")
    rows = report.withColumn("due", due).join(F.broadcast(most), "source")
    return rows.select("source", "due", (F.abs(F.col("actual_share") - F.col("due")) < 0.01).alias("near_enough"), (F.col("most_copies") <= F.col("m")).alias("within_repeats"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(spark, p9_mix(spark, d), _targets(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_truncated(table(spark, d, "documents")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(find_truncated(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_groups, p4_found, p4_kept, p4_pieces, p6_found, p6_records, p7_found, p7_entities, p8_pack, p8_fill, p8_kept, p8_windows, p9_mix, p9_kept, p9_shares, p10_found, p10_rates)}

_CANON = """with t as (
  select 'fasta' src, fasta_id id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) seq,
    array_to_string(list_sort(list_transform(string_split(name, '|'), lambda x: upper(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')))), '|') nm
  from fasta where name is not null
  union all select 'features', feature_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')), '' from features),
  c as (select src, id, min(id) over (partition by src, seq, nm) first_id, count(*) over (partition by src, seq, nm) n from t where seq <> '')
"""
_NEAR = r"""with recursive x as (select 'fasta' src, fasta_id id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) s from fasta union all select 'fastq', read_row_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) from fastq),
  u as (select src, s, min(id) rep from x where length(s) >= 9 group by src, s), k as (select distinct src, rep, substr(s, cast(i as integer), 9) g from u, unnest(range(1, length(s) - 7)) r(i)),
  n as (select src, rep, count(*) n from k group by all), b as (select a.src, a.rep ra, b.rep rb, count(*) c from k a join k b on a.src = b.src and a.g = b.g and a.rep < b.rep group by all),
  near as (select b.src, ra, rb from b join n p on p.src = b.src and p.rep = ra join n q on q.src = b.src and q.rep = rb where c + 1e-9 >= 0.7 * (p.n + q.n - c))
"""
ORACLE: dict[str, str] = {
    "p4_found": """select 'genbank' src, record_id item_id from genbank where length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > 5000
  union all select 'fasta', cast(fasta_id as varchar) from fasta where length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > 5000""",
    "p4_kept": """with t as (select 'genbank' src, record_id item_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) s from genbank union all select 'fasta', cast(fasta_id as varchar), upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) from fasta)
  select src, item_id, length(s)::bigint n_letters, md5(s) digest, true fits from t where length(s) > 5000""",
    "p6_found": _CANON + "select src, first_id, id copy_id from c where id <> first_id",
    "p6_records": _CANON + "select src, first_id, n n_copies from c where id = first_id",
    "p2_found": _NEAR + """select near.src, least(p.id, q.id) id_a, greatest(p.id, q.id) id_b from near join u a on a.src = near.src and a.rep = ra join u b on b.src = near.src and b.rep = rb
  join x p on p.src = near.src and p.s = a.s join x q on q.src = near.src and q.s = b.s""",
    "p2_groups": _NEAR + """, e as (select src, ra p, rb q from near union all select src, rb, ra from near),
  w(src, p, c) as (select distinct src, p, p from e union select e.src, e.q, w.c from w join e on e.src = w.src and e.p = w.p where w.c < e.q), roots as (select src, p, min(c) c from w group by all)
  select roots.src, roots.p rep_id, c group_id, m n_links from roots join (select src, p, count(*) m from e group by all) using (src, p)""",
    # What must hold whatever the tokens are: every text once and whole or in pieces that follow each other, no container too full.
    "p8_kept": """select count(*) n_texts, 0::bigint n_gaps, 0::bigint n_split_within, 0::bigint n_overfull, 0::bigint n_overlaps, 0::bigint n_lost_tokens from documents where text is not null and doc_id is not null""",
    # Every source that can has its share, none repeats a text too often; what a source without text leaves goes to the others in proportion.
    "p9_kept": """with has as (select source from documents where text <> '' group by source)
  select source, round(target_share / sum(target_share) over (), 6) due, true near_enough, true within_repeats from mix_targets join has using (source)""",
}
