"""Sequence and read-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import counts, running
from ..sources import genomics
from .analogs import query, read, reads, sequences, single

RC = "reverse(translate({0}, 'ATGC', 'TACG'))"


@query(f"SELECT doc_id, md5({RC.format('seq')}) AS rc FROM sequences", "sequences")
def str4_reverse_complement(spark, d):
    return sequences(spark, d).select("doc_id", F.md5(sq.revcomp(F.col("seq"))).alias("rc"))


def _case(x, motifs, take=20):
    return "CASE " + " ".join(f"WHEN instr({x}, '{m}') > 0 THEN substring({x}, instr({x}, '{m}') + {len(m)}, {take})" for m in motifs) + " END"


@query(f"SELECT doc_id, coalesce({RC.format(_case('seq', ['TAAAC', 'AAAC']))}, '') AS guide FROM sequences", "sequences")
def str7_first_guide(spark, d):
    return sequences(spark, d).select("doc_id", sq.first_guide(F.col("seq")).alias("guide"))


@query(f"SELECT doc_id, coalesce({RC.format(_case('seq', ['TGTTG', 'GTTG']))}, '') AS guide FROM sequences", "sequences")
def src14_other_motif(spark, d):
    return sequences(spark, d).select("doc_id", sq.first_guide(F.col("seq"), ("TGTTG", "GTTG")).alias("guide"))


#: The second guide of the read's part x behind base 140, and the tolerant guide of seq.
SECOND = RC.format("coalesce(" + _case("x", ["CAAAC", "AAAC"]) + ", CASE WHEN length(x) >= 23 THEN substring(x, length(x) - 22, 20) ELSE '' END)")


@query(f"WITH t AS (SELECT doc_id, substring(seq, 141) AS x FROM sequences) SELECT doc_id, {SECOND} AS guide FROM t", "sequences")
def str8_second_guide(spark, d):
    return sequences(spark, d).select("doc_id", sq.second_guide(F.col("seq")).alias("guide"))


_TRIES = ", ".join(f"CASE WHEN instr(seq, '{v}') > 0 AND length(seq) - instr(seq, '{v}') - {len(v)} + 1 >= 20 THEN substring(seq, instr(seq, '{v}') + {len(v)}, 20) END" for v in sq.edit_variants("TAAAC"))
_LAST = "(length(seq) - instr(reverse(seq), 'TGC') - 2)"


TOLERANT = f"coalesce({RC.format(f'coalesce({_TRIES}, CASE WHEN contains(seq, $$CGT$$) AND {_LAST} >= 20 THEN substring(seq, {_LAST} - 18, 20) END)')}, '')"


@query(f"SELECT doc_id, {TOLERANT} AS guide FROM sequences", "sequences")
def str9_tolerant_guide(spark, d):
    return sequences(spark, d).select("doc_id", sq.tolerant_guide(F.col("seq")).alias("guide"))


@query("SELECT doc_id, seq[28:47] AS guide, seq[31:55] AS barcode, seq[9:] [1:30] AS rest FROM sequences", "sequences")
def str3_slices(spark, d):
    x = F.col("seq")
    return sequences(spark, d).select("doc_id", sq.slice_of(x, 27, 47).alias("guide"), sq.slice_of(x, 30, 55).alias("barcode"), F.substring(sq.slice_of(x, 8), 1, 30).alias("rest"))


@query("SELECT url, split_part(url, '/', 3) AS host, split_part(url, '/', -1) AS last FROM pages")
def str1_split_parts(spark, d):
    x = F.col("url")
    return read(spark, d, "pages").select("url", sq.field(x, "/", 2).alias("host"), sq.field(x, "/", -1).alias("last"))


@query("SELECT guide, split_part(guide, '_', -1) AS last FROM single GROUP BY guide", "single")
def str2_last_token(spark, d):
    return single(spark, d).select("guide", F.substring_index("guide", "_", -1).alias("last")).distinct()


@query("SELECT c_custkey, concat_ws('_', c_mktsegment, c_nationkey, c_custkey) AS lineage FROM customer")
def str5_concat(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("lineage"))


@query("SELECT doc_id, instr(seq, 'CGT') AS first, CASE WHEN contains(seq, 'CGT') THEN length(seq) - instr(reverse(seq), 'TGC') - 1 ELSE 0 END AS last, contains(seq, 'TTT') AS has FROM sequences", "sequences")
def str6_find(spark, d):
    x = F.col("seq")
    last = F.when(F.contains(x, F.lit("CGT")), F.length(x) - F.instr(F.reverse(x), "TGC") - 1).otherwise(0)
    return sequences(spark, d).select("doc_id", F.instr(x, "CGT").alias("first"), last.alias("last"), F.contains(x, F.lit("TTT")).alias("has"))


@query("SELECT doc_id, md5(replace(translate(seq, 'T', 'N'), 'N', 'C')) AS known, md5(translate(translate(seq, 'T', 'N'), 'ACGTN', 'IIII!')) AS qual FROM sequences", "sequences")
def str10_masks(spark, d):
    x = F.translate("seq", "T", "N")
    return sequences(spark, d).select("doc_id", F.md5(sq.known_bases(x)).alias("known"), F.md5(sq.masked_quality(x)).alias("qual"))


@query("SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def str11_regex(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"))


@query("SELECT url, starts_with(url, 'https') AS secure, contains(url, '?') AS query FROM pages")
def str12_prefix(spark, d):
    return read(spark, d, "pages").select("url", F.col("url").startswith("https").alias("secure"), F.col("url").contains("?").alias("query"))


@query("SELECT concat(least(sn.n_name, cn.n_name), '+', greatest(sn.n_name, cn.n_name)) AS pair FROM nation sn JOIN nation cn ON sn.n_regionkey = cn.n_regionkey")
def str13_pair_key(spark, d):
    n = read(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").select(sq.pair_key(F.col("a"), F.col("b")).alias("pair"))


@query("SELECT CAST(l_linenumber AS VARCHAR) AS code, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def str14_casts(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("code")).agg(F.sum(F.col("l_quantity").cast("int")).alias("n"))


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY 1")
def str15_join_list(spark, d):
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT url, split_part(split_part(url, '?', 1), '/', 4) AS part, split_part(url, ':', 1) AS scheme FROM pages")
def str17_header_fields(spark, d):
    return read(spark, d, "pages").select("url", sq.field(sq.field(F.col("url"), "?", 0), "/", 3).alias("part"), sq.field(F.col("url"), ":", 0).alias("scheme"))


@query("SELECT l_orderkey, round(l_linenumber / CAST(l_quantity AS DOUBLE), 6) AS ratio FROM lineitem")
def str18_ratio(spark, d):
    x = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return read(spark, d, "lineitem").select("l_orderkey", F.round(sq.ratio(x), 6).alias("ratio"))


@query("""WITH lib AS (SELECT n_name AS b FROM nation), q AS (SELECT DISTINCT c_name AS a FROM customer),
s AS (SELECT a, b, 100 * (1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)) AS score FROM q, lib)
SELECT a AS seq, b AS identity, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s) WHERE k = 1""")
def str19_fuzzy_identity(spark, d):
    from ..operators.matching import best_match

    lib = read(spark, d, "nation").select(F.col("n_name").alias("identity"))
    seqs = read(spark, d, "customer").select(F.col("c_name").alias("seq")).distinct()
    return best_match(seqs, lib).select("seq", "identity", F.round("score", 6).alias("score"))


@query("SELECT event_id, concat(event_type, user_id) AS barcode_mapped FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT concat(event_type, user_id) AS b FROM events WHERE value > 90) w WHERE w.b = concat(e.event_type, e.user_id))")
def str20_whitelist(spark, d):
    from ..operators.matching import whitelisted

    e = read(spark, d, "events")
    b = F.concat("event_type", F.col("user_id").cast("string"))
    known = e.where("value > 90").select(b.alias("barcode")).distinct()
    return whitelisted(e.select("event_id", b.alias("barcode_mapped")), known, "barcode_mapped").select("event_id", "barcode_mapped")


@query("""WITH known AS (SELECT DISTINCT substring(seq, 31, 7) AS b FROM sequences WHERE doc_id % 5 = 0 AND length(seq) >= 37), words AS (SELECT DISTINCT substring(seq, 11, 7) AS w FROM sequences WHERE length(seq) >= 17),
near AS (SELECT w, b, list_min(list_transform(range(0, 8), lambda i: least(levenshtein(b, substring(w, 1, i)), levenshtein(substring(b, 1, i), w)))) AS e FROM words, known),
best AS (SELECT w, min(e) AS e FROM near WHERE e <= 1 GROUP BY w), one AS (SELECT w, min(b) AS b FROM near JOIN best USING (w, e) GROUP BY w HAVING count(*) = 1)
SELECT doc_id, b AS barcode_mapped FROM sequences JOIN one ON w = substring(seq, 11, 7) WHERE length(seq) >= 17""", "sequences")
def str20_decoded(spark, d):
    """Barcodes with up to one substitution, insertion or deletion."""
    from ..operators.matching import decoded

    s = sequences(spark, d)
    known = s.where("doc_id % 5 = 0 and length(seq) >= 37").select(F.substring("seq", 31, 7).alias("barcode"))
    return decoded(s.where("length(seq) >= 17").select("doc_id", F.substring("seq", 11, 7).alias("read")), known, "read").select("doc_id", "barcode_mapped")


@query("SELECT concat('@', url, chr(10), upper(split_part(url, '/', 3)), chr(10), '+', chr(10), translate(upper(split_part(url, '/', 3)), 'ACGTN', 'IIII!')) AS value FROM pages")
def snk5_fastq_text(spark, d):
    seq = F.upper(sq.field(F.col("url"), "/", 2))
    return read(spark, d, "pages").select(sq.fastq_text(F.col("url"), seq, sq.masked_quality(seq)).alias("value"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rec_no FROM customer")
def src8_record_numbers(spark, d):
    return running.numbered(read(spark, d, "customer").select("c_custkey"), "c_custkey")


_VCF = "concat_ws(chr(9), 'chr' || (user_id % 5), event_id, event_type, 'N', '.', '60', 'PASS', concat('SVTYPE=', CASE event_type WHEN 'click' THEN 'DEL' WHEN 'view' THEN 'INS' ELSE 'DUP' END, ';SUPPORT=', 1 + event_id % 9, ';RNAMES=r', event_id % 300, ',r', event_id % 211))"


def _vcf(spark, d):
    kind = F.when(F.col("event_type") == "click", "DEL").when(F.col("event_type") == "view", "INS").otherwise("DUP")
    s = lambda c: c.cast("string")
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";SUPPORT="), s(1 + F.col("event_id") % 9), F.lit(";RNAMES=r"), s(F.col("event_id") % 300), F.lit(",r"), s(F.col("event_id") % 211))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), s(F.col("user_id") % 5)), s(F.col("event_id")), "event_type", F.lit("N"), F.lit("."), F.lit("60"), F.lit("PASS"), info)
    return read(spark, d, "events").select(line.alias("value"))


def _sam(spark, d):
    flag = F.when(F.col("event_id") % 11 == 0, 256).when(F.col("event_id") % 13 == 0, 2064).otherwise(16)
    return read(spark, d, "events").select(F.concat_ws("\t", F.concat(F.lit("r"), (F.col("event_id") % 500).cast("string")), flag.cast("string"), "event_type").alias("value"))


@query("SELECT event_id AS pos, CASE event_type WHEN 'click' THEN 'DEL' WHEN 'view' THEN 'INS' ELSE 'DUP' END AS svtype, 1 + event_id % 9 AS support FROM events")
def src21_variants(spark, d):
    return genomics.variants(_vcf(spark, d)).select("pos", "svtype", "support")


@query("SELECT 'r' || (event_id % 500) AS qname, 16 AS flag, count(*) AS n FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY 1")
def src22_alignments(spark, d):
    return genomics.alignments(_sam(spark, d)).groupBy("qname", "flag").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'r' || (event_id % m) AS qname FROM events, (VALUES (300), (211)) t(m)")
def snk8_read_names(spark, d):
    return genomics.variant_reads(genomics.variants(_vcf(spark, d)))


@query("""WITH v AS (SELECT event_id, event_type, 1 + event_id % 9 AS s FROM events), n AS (SELECT DISTINCT 'r' || (event_id % m) AS q FROM events, (VALUES (300), (211)) t(m)),
a AS (SELECT DISTINCT 'r' || (event_id % 500) AS q FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)
SELECT count_if(event_type = 'click') AS "DEL", count_if(event_type = 'view') AS "INS", count_if(event_type NOT IN ('click', 'view')) AS "DUP", count_if(s = 1) AS single, count_if(s BETWEEN 2 AND 5) AS few, count_if(s > 5) AS many, CAST(sum(s) AS BIGINT) AS instances,
(SELECT count(*) FROM n) AS supporting, (SELECT count(*) FROM a) AS reads, floor((SELECT count(*) FROM n) * 10000.0 / (SELECT count(*) FROM a)) / 100 AS pct_reads FROM v""")
def pl16_variant_report(spark, d):
    out = genomics.variant_report(genomics.variants(_vcf(spark, d)), genomics.alignments(_sam(spark, d)))
    return out.select("DEL", "INS", "DUP", "single", "few", "many", "instances", "supporting", "reads", "pct_reads")


@query("SELECT sum(n) AS n FROM (SELECT 'r' || (event_id % 500) AS q, count(*) AS n FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY 1) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'r' || (event_id % m) AS q FROM events, (VALUES (300), (211)) t(m)) n WHERE n.q = a.q)")
def jn12_alignments_without_variants(spark, d):
    a = genomics.without_variants(genomics.alignments(_sam(spark, d)), genomics.variants(_vcf(spark, d)))
    return a.agg(F.nullif(F.count("*"), F.lit(0)).alias("n"))


@query("SELECT user_id, count(*) AS total_reads, 7 + user_id AS total_sv FROM events GROUP BY user_id")
def src20_report_numbers(spark, d):
    n = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    text = n.select(F.concat(F.lit("Report\nTotal reads: "), F.col("n").cast("string"), F.lit("\nTotal SV:  "), (F.col("user_id") + 7).cast("string"), F.lit("\n")).alias("value"))
    out = genomics.report_numbers(text, ["Total reads", "Total SV"])
    return out.select((F.col("total_sv") - 7).alias("user_id"), "total_reads", "total_sv")


@query("""SELECT cell, count_if(transcript = 'identity') AS a, count_if(transcript = 'reporter') AS b FROM (SELECT DISTINCT cell, transcript, umi FROM reads) GROUP BY cell""", "reads")
def pl11_collapse_to_cells(spark, d):
    return counts.umi_collapse(reads(spark, d), ["cell"], "umi", "transcript", {"a": "identity", "b": "reporter"})


@query("SELECT cell, count(*) AS n, round(sum(value), 6) AS total FROM reads GROUP BY cell", "reads")
def pl14_pseudobulk(spark, d):
    x = reads(spark, d).withColumn("n", F.lit(1))
    return counts.pseudobulk(x, ["cell"], ["n", "value"]).select("cell", "n", F.round("value", 6).alias("total"))


@query("SELECT event_id, pos, round(value - 50, 6) AS shifted FROM (SELECT event_id, event_id + 12 AS pos, value FROM events) WHERE NOT (pos BETWEEN 100 AND 200 OR pos BETWEEN 900 AND 950)")
def pl17_masked_offset(spark, d):
    x = read(spark, d, "events").select("event_id", (F.col("event_id") + 12).alias("pos"), "value")
    return x.where(~(F.col("pos").between(100, 200) | F.col("pos").between(900, 950))).select("event_id", "pos", F.round(F.col("value") - 50, 6).alias("shifted"))


@query("SELECT page_id, coalesce(n_name, url) AS symbol FROM pages LEFT JOIN nation ON n_nationkey = page_id")
def src25_symbols(spark, d):
    from ..sources.tables import symbols

    p = read(spark, d, "pages").select("page_id", "url")
    names = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("symbol"))
    out = symbols(p.withColumn("gene", F.col("page_id")), names)
    return out.select("page_id", F.when(F.col("symbol") == F.col("page_id").cast("string"), F.col("url")).otherwise(F.col("symbol")).alias("symbol"))
