"""Queries over sequences: alphabets, scores, k-mers, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import alphabet, scoring
from ..operators import assembly, intervals, kmers
from ..sources import readers, sinks
from .base import PEPTIDES, TARGETS, peptides, query, r6, sql_kmers, table, targets

_UNION_REDUCED = " UNION ALL ".join(f"SELECT rid, '{n}' AS alphabet, md5(translate(seq, '{alphabet.RESIDUES}', '{alphabet.classes(n)}')) AS digest FROM reads" for n in alphabet.ALPHABETS)


@query(f"WITH {PEPTIDES}, {sql_kmers(6)}, c AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer) SELECT CAST(CASE WHEN n <= 20 THEN n ELSE 0 END AS BIGINT) AS n, count(*) AS kmers, CAST(sum(n) AS BIGINT) AS occurrences FROM c GROUP BY 1")
def kmer_spectrum(spark, sf):
    return kmers.spectrum_histogram(kmers.spectrum(peptides(spark, sf), 6), 20)


@query(f"WITH {PEPTIDES}, {sql_kmers(6)} SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer HAVING count(*) >= 50")
def frequent_kmers(spark, sf):
    return kmers.frequent(kmers.spectrum(peptides(spark, sf), 6), 50)


@query(f"WITH {PEPTIDES}, {sql_kmers(4)} SELECT substr(kmer, 2, 3) AS kmer, substr(kmer, 1, 1) AS prev, count(*) AS n FROM kmers GROUP BY 1, 2")
def kmer_left_neighbours(spark, sf):
    return kmers.left_neighbours(peptides(spark, sf), 3)


@query(f"WITH {PEPTIDES}, {sql_kmers(5)} SELECT kmer, count(DISTINCT rid) AS n_reads, min(rid) AS first_read FROM kmers GROUP BY kmer")
def kmer_inverted_index(spark, sf):
    return kmers.inverted_index(peptides(spark, sf), 5).groupBy("kmer").agg(F.count(F.lit(1)).alias("n_reads"), F.min("rid").alias("first_read"))


@query(f"WITH {PEPTIDES}, {sql_kmers(4)}, c AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer) SELECT rid, min(n) >= 3 AS passes FROM kmers JOIN c USING (kmer) GROUP BY rid")
def kmer_path_filter(spark, sf):
    return kmers.words_pass(peptides(spark, sf), 4, 3)


@query(f"WITH {PEPTIDES} {_UNION_REDUCED}")
def reduced_alphabets(spark, sf):
    reads = peptides(spark, sf)
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("alphabet"), F.md5(alphabet.reduced(F.col("seq"), n)).alias("digest")) for n in alphabet.ALPHABETS]))
    return reads.select("rid", names.alias("a")).select("rid", "a.alphabet", "a.digest")


@query("SELECT doc_id, md5(regexp_replace(text, '[^ARNDCQEGHILKMFPSTWYVBJZX*]', 'X', 'g')) AS repaired, md5(regexp_replace(text, '[^A-Za-z]+$', '')) AS trimmed, regexp_full_match(text, '[PGEKRQDSNTHCIVWYFALM]*') AS standard FROM documents")
def residue_repair(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(alphabet.repaired(t)).alias("repaired"), F.md5(F.regexp_replace(t, r"[^A-Za-z]+\z", "")).alias("trimmed"), alphabet.standard(t).alias("standard"))


@query(f"WITH {PEPTIDES}, {sql_kmers(5)}, c AS (SELECT DISTINCT kmer FROM kmers) SELECT kmer, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(kmer, ''), lambda x: CAST(instr('{alphabet.CODES}', x) - 1 AS BIGINT))), lambda a, b: a * 32 + b) AS BIGINT) AS code FROM c")
def kmer_codes(spark, sf):
    return kmers.kmers(peptides(spark, sf), 5).select("kmer").distinct().select("kmer", alphabet.kmer_code(F.col("kmer")).alias("code"))


@query(f"WITH {PEPTIDES} SELECT rid, md5(reverse(seq)) AS reversed, md5(reverse(translate(regexp_replace(seq, '[^ACG]', '', 'g'), 'ACG', 'UGC'))) AS complement FROM reads")
def reversals(spark, sf):
    return peptides(spark, sf).select("rid", F.md5(F.reverse("seq")).alias("reversed"), F.md5(alphabet.reverse_complement(F.col("seq"))).alias("complement"))


_CODONS = ", ".join(f"('{k}', '{v}')" for k, v in alphabet.codon_table().items())


@query(f"WITH {PEPTIDES}, d AS (SELECT rid, translate(regexp_replace(seq, '[^ACGT]', '', 'g'), '', '') AS dna FROM reads), c AS (SELECT rid, i, substr(dna, CAST(i * 3 + 1 AS BIGINT), 3) AS codon FROM (SELECT rid, dna, unnest(range(0, length(dna) // 3)) AS i FROM d)), t(codon, aa) AS (VALUES {_CODONS}) SELECT d.rid, md5(coalesce(string_agg(CASE WHEN c.i IS NOT NULL THEN coalesce(aa, 'X') END, '' ORDER BY c.i), '')) AS protein FROM d LEFT JOIN c ON c.rid = d.rid LEFT JOIN t ON t.codon = c.codon GROUP BY d.rid")
def codon_translation(spark, sf):
    dna = F.regexp_replace("seq", "[^ACGT]", "")
    return peptides(spark, sf).select("rid", F.md5(alphabet.translated(dna)).alias("protein"))


_DIAGONAL = ", ".join(f"('{a}', {scoring.blosum62()[a + a]})" for a in scoring.ORDER)


@query(f"WITH {PEPTIDES}, s(a, x) AS (VALUES {_DIAGONAL}), e AS (SELECT rid, unnest(string_split(seq, '')) AS a FROM reads WHERE seq <> '') SELECT rid, CAST(sum(x) AS BIGINT) AS score FROM e JOIN s USING (a) GROUP BY rid")
def self_scores(spark, sf):
    m = scoring.score_map(scoring.blosum62())
    return peptides(spark, sf).where("seq <> ''").select("rid", scoring.word_score(m, F.col("seq"), F.col("seq")).cast("long").alias("score"))


_LAM, _K = scoring.karlin("BLOSUM62", 11, 1)


@query(f"SELECT l_orderkey, l_linenumber, round(({_LAM} * l_quantity - ln({_K})) / ln(2), 6) AS bits, round({_K} * 300.0 * 100000 * exp(-{_LAM} * l_quantity), 6) AS e_value, CAST(trunc((ln({_K}) + ln(300.0) + ln(100000.0) - ln(l_discount + 0.001)) / {_LAM}) AS INTEGER) AS cutoff, round(exp(least(greatest(-(l_quantity / 10 - 2.0) * 0.7, -5.0), 5.0)), 6) AS gumbel FROM lineitem")
def score_statistics(spark, sf):
    q = F.col("l_quantity")
    m, n = F.lit(300.0), F.lit(100000.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(scoring.bit_score(q, _LAM, _K), "bits"), r6(scoring.e_value(q, m, n, _LAM, _K), "e_value"), scoring.raw_cutoff(F.col("l_discount") + 0.001, m, n, _LAM, _K).alias("cutoff"), r6(scoring.gumbel_p(q, 2.0, 0.7, 10.0), "gumbel"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(l_suppkey + 9, l_partkey + 19) - greatest(l_suppkey, l_partkey) + 1) AS BIGINT) AS shared, round(greatest(0, least(l_suppkey + 9, l_partkey + 19) - greatest(l_suppkey, l_partkey) + 1) / (30.0 - greatest(0, least(l_suppkey + 9, l_partkey + 19) - greatest(l_suppkey, l_partkey) + 1)), 6) AS jaccard, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + (l_linenumber - 1) * 3 ELSE l_partkey + 900 - (l_linenumber + 4) * 3 + 1 END AS lifted, CAST(trunc(l_quantity - 6 + 1 - 6 * (l_quantity * 0.05)) AS INTEGER) AS qgrams FROM lineitem")
def interval_measures(spark, sf):
    a, b = F.col("l_suppkey"), F.col("l_partkey")
    n = F.col("l_linenumber").cast("long")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scoring.overlap(a, a + 9, b, b + 19).alias("shared"), r6(scoring.interval_jaccard(a, a + 9, b, b + 19), "jaccard"),
        scoring.lifted(n, n + 4, F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), b, b + 900)[0].alias("lifted"), scoring.qgram_threshold(F.col("l_quantity"), 6, 0.05).alias("qgrams"),
    )


@query(f"WITH {PEPTIDES}, {TARGETS}, p AS (SELECT t.rid AS tid, r.rid, t.seq AS a, r.seq AS b FROM targets t JOIN reads r ON r.rid = t.rid), e AS (SELECT rid, a, b, unnest(range(1, least(length(a), length(b)) + 1)) AS i FROM p) SELECT p.rid, CAST(coalesce(sum(CASE WHEN substr(e.a, i, 1) <> substr(e.b, i, 1) THEN 1 ELSE 0 END), 0) AS BIGINT) AS hamming, CASE WHEN least(length(p.a), length(p.b)) > 0 THEN round(1 - sum(CASE WHEN substr(e.a, i, 1) <> substr(e.b, i, 1) THEN 1 ELSE 0 END) / least(length(p.a), length(p.b)), 6) ELSE 0.0 END AS identity, CAST(levenshtein(substr(p.a, 1, 40), substr(p.b, 1, 40)) AS INTEGER) AS edits FROM p LEFT JOIN e ON e.rid = p.rid GROUP BY p.rid, p.a, p.b")
def word_distances(spark, sf):
    both = targets(spark, sf).withColumnRenamed("seq", "a").join(peptides(spark, sf).withColumnRenamed("seq", "b"), "rid")
    a, b = F.col("a"), F.col("b")
    return both.select("rid", scoring.hamming(a, b).alias("hamming"), r6(scoring.end_identity(a, b), "identity"), F.levenshtein(F.left(a, F.lit(40)), F.left(b, F.lit(40))).alias("edits"))


# edit distances of whole texts (word_distances and its SQL take the first 40 letters); no SQL: brute force in the tests
@query()
def word_edits(spark, sf):
    both = targets(spark, sf).withColumnRenamed("seq", "a").join(peptides(spark, sf).withColumnRenamed("seq", "b"), "rid")
    return both.select("rid", F.levenshtein("a", "b").alias("edits"))


@query(f"WITH {PEPTIDES}, {TARGETS}, {sql_kmers(3)}, {sql_kmers(3, 'targets', 'tk')}, x AS (SELECT rid, kmer, count(*) AS n FROM kmers WHERE rid IN (SELECT rid FROM targets) GROUP BY ALL), y AS (SELECT rid, kmer, count(*) AS n FROM tk GROUP BY ALL) SELECT rid, CAST(sum((coalesce(x.n, 0) - coalesce(y.n, 0)) * (coalesce(x.n, 0) - coalesce(y.n, 0))) AS BIGINT) AS distance FROM x FULL JOIN y USING (rid, kmer) GROUP BY rid")
def kmer_profile_distance(spark, sf):
    t = targets(spark, sf)
    return kmers.profile_distance(peptides(spark, sf).join(t.select("rid"), "rid", "left_semi"), t, 3)


@query(f"WITH {PEPTIDES}, {TARGETS}, {sql_kmers(16)}, {sql_kmers(16, 'targets', 'tk')} SELECT tk.rid AS qid, tk.pos AS qpos, kmers.rid, kmers.pos FROM tk JOIN kmers USING (kmer)")
def exact_lookup(spark, sf):
    return kmers.lookup(targets(spark, sf), peptides(spark, sf), 16)


_GB = f"translate(kmer, '{alphabet.RESIDUES}', '{alphabet.classes('GBMR10')}')"
_PAIRS = ", ".join(f"('{a}', '{b}', {scoring.blosum62()[a + b]})" for a in scoring.ORDER for b in scoring.ORDER)


@query(f"WITH {PEPTIDES}, {TARGETS}, {sql_kmers(14)}, {sql_kmers(14, 'targets', 'tk')}, q AS (SELECT rid AS qid, pos AS qpos, kmer AS qmer, {_GB} AS r FROM tk), d AS (SELECT rid, pos, kmer, {_GB} AS r FROM kmers), m AS (SELECT DISTINCT q.qmer, d.kmer FROM q JOIN d USING (r)), s(a, b, x) AS (VALUES {_PAIRS}), w AS (SELECT qmer, kmer, sum(x) AS score FROM (SELECT qmer, kmer, unnest(range(1, 15)) AS i FROM m) JOIN s ON s.a = substr(qmer, i, 1) AND s.b = substr(kmer, i, 1) GROUP BY ALL HAVING sum(x) >= 60) SELECT qid, qpos, rid, pos, CAST(score AS INTEGER) AS score FROM q JOIN w USING (qmer) JOIN d USING (kmer)")
def reduced_seeds(spark, sf):
    return kmers.reduced_lookup(targets(spark, sf), peptides(spark, sf), 14, "GBMR10", 60)


@query(f"WITH s(a, b, x) AS (VALUES {_PAIRS}) SELECT p.a || q.a || r.a AS word, p.b || q.b || r.b AS neighbour, CAST(p.x + q.x + r.x AS INTEGER) AS score FROM s p, s q, s r WHERE p.x + q.x + r.x >= 11")
def neighbour_words(spark, sf):
    return kmers.neighbour_words(spark, 11)


@query(f"WITH {PEPTIDES}, {TARGETS}, {sql_kmers(10)}, {sql_kmers(10, 'targets', 'tk')}, a AS (SELECT DISTINCT rid, kmer FROM tk), b AS (SELECT DISTINCT rid AS tid, kmer FROM kmers) SELECT rid, tid, count(*) AS shared FROM a JOIN b USING (kmer) WHERE rid <> tid GROUP BY rid, tid HAVING count(*) >= 20")
def shared_kmer_paths(spark, sf):
    return kmers.shared_kmers(targets(spark, sf), peptides(spark, sf), 10, 20)


@query(f"WITH {PEPTIDES}, {TARGETS}, {sql_kmers(9)}, {sql_kmers(9, 'targets', 'tk')}, q AS (SELECT rid AS qid, kmer, count(*) AS qn FROM tk GROUP BY ALL), p AS (SELECT rid AS pid, kmer, count(*) AS pn FROM kmers GROUP BY ALL) SELECT qid, pid, CAST(sum(qn * pn) AS BIGINT) AS hits FROM q JOIN p USING (kmer) GROUP BY ALL HAVING sum(qn * pn) >= 40")
def weighted_kmer_paths(spark, sf):
    return kmers.weighted_paths(targets(spark, sf), peptides(spark, sf), 9, 40)


@query(f"WITH {PEPTIDES}, {TARGETS}, {sql_kmers(6)}, {sql_kmers(6, 'targets', 'tk')}, o AS (SELECT tk.rid AS qid, tk.pos AS qpos, kmers.rid, kmers.pos, kmers.pos - tk.pos AS diagonal FROM tk JOIN kmers USING (kmer)), l AS (SELECT *, lag(pos) OVER (PARTITION BY qid, rid, diagonal ORDER BY pos) AS first FROM o) SELECT qid, rid, diagonal, first, pos AS second FROM l WHERE pos - first > 6 AND pos - first <= 40")
def two_hit_diagonals(spark, sf):
    found = kmers.lookup(targets(spark, sf), peptides(spark, sf), 6)
    return kmers.diagonal_hits(found, 6, 40)


@query(f"WITH {PEPTIDES}, {TARGETS}, pool AS (SELECT rid, seq FROM reads UNION ALL SELECT -1 - rid, seq FROM targets), {sql_kmers(24, 'pool')}, h AS (SELECT rid AS inner_, seq AS iseq, substr(seq, 1, 24) AS kmer FROM pool WHERE length(seq) >= 24) SELECT DISTINCT h.inner_ AS rid FROM h JOIN kmers k ON k.kmer = h.kmer AND k.rid <> h.inner_ JOIN pool r ON r.rid = k.rid WHERE length(r.seq) > length(iseq) AND contains(r.seq, iseq)")
def contained_reads(spark, sf):
    # passages of the benchmark stand inside documents
    passages = targets(spark, sf).select((-1 - F.col("rid")).alias("rid"), "seq")
    return kmers.contained(peptides(spark, sf).unionByName(passages), 24)


_OVERLAPS = f"{PEPTIDES}, {sql_kmers(20)}, tails AS (SELECT rid AS a, seq AS aseq, right(seq, 20) AS kmer FROM reads WHERE length(seq) >= 20), found AS (SELECT a, k.rid AS b, pos + 19 AS n, aseq, seq FROM tails JOIN kmers k USING (kmer) JOIN reads r ON r.rid = k.rid WHERE a <> k.rid), ov AS (SELECT a, b, max(n) AS length FROM found WHERE right(aseq, n) = left(seq, n) AND n < length(seq) AND n < length(aseq) GROUP BY a, b)"


@query(f"WITH {_OVERLAPS} SELECT a, b, CAST(length AS BIGINT) AS length FROM ov")
def read_overlaps(spark, sf):
    return kmers.overlaps(peptides(spark, sf), 20)


@query(f"WITH {_OVERLAPS} SELECT a, b, CAST(length AS BIGINT) AS length FROM ov o WHERE NOT EXISTS (SELECT 1 FROM ov x JOIN ov y ON x.b = y.a WHERE x.a = o.a AND y.b = o.b)")
def irreducible_overlaps(spark, sf):
    return kmers.irreducible_overlaps(peptides(spark, sf), 20)


@query(f"WITH {PEPTIDES}, {TARGETS}, {sql_kmers(20, 'targets', 'tk')}, {sql_kmers(20)}, d AS (SELECT DISTINCT tk.rid, kmers.rid AS cid, kmers.pos - tk.pos AS shift FROM tk JOIN kmers USING (kmer)), p AS (SELECT d.*, t.seq AS rseq, r.seq AS cseq, greatest(0, -shift) AS f, least(length(t.seq), length(r.seq) - shift) AS l FROM d JOIN targets t ON t.rid = d.rid JOIN reads r ON r.rid = d.cid), c AS (SELECT *, l - f AS aligned FROM p WHERE l - f >= 0.6 * length(rseq)), e AS (SELECT rid, cid, shift, f, aligned, sum(CASE WHEN substr(rseq, f + i, 1) <> substr(cseq, f + shift + i, 1) THEN 1 ELSE 0 END) AS errors FROM (SELECT *, unnest(range(1, aligned + 1)) AS i FROM c) GROUP BY ALL HAVING errors <= 3) SELECT rid, cid, CAST(shift + f + 1 AS BIGINT) AS start, CAST(errors AS BIGINT) AS errors, CAST(aligned AS BIGINT) AS aligned FROM e QUALIFY row_number() OVER (PARTITION BY rid ORDER BY (errors + 1) / aligned, cid, shift) = 1")
def mapped_reads(spark, sf):
    return kmers.map_reads(targets(spark, sf), peptides(spark, sf), 20, 3, 0.6)


@query(f"WITH {PEPTIDES} , {sql_kmers(5)} SELECT r.rid, min(kmer) AS minimizer FROM reads r LEFT JOIN kmers k ON k.rid = r.rid GROUP BY r.rid")
def minimizers(spark, sf):
    return kmers.minimizer(peptides(spark, sf), 5)


def _ends(spark, sf) -> DataFrame:
    return peptides(spark, sf).unionByName(targets(spark, sf).select((F.col("rid") + 10_000_000).alias("rid"), "seq"))


@query(f"WITH {PEPTIDES}, {TARGETS}, u AS (SELECT * FROM reads UNION ALL SELECT rid + 10000000, seq FROM targets), n AS (SELECT unnest(range(8, 13)) AS n) SELECT x.rid AS a, y.rid AS b, max(n) AS length FROM n, u x, u y WHERE length(x.seq) > n AND length(y.seq) > n AND x.rid <> y.rid AND right(x.seq, n) = left(y.seq, n) GROUP BY ALL")
def exact_end_joins(spark, sf):
    return assembly.end_joins(_ends(spark, sf), 12, 8)


@query("SELECT a.l_orderkey, a.l_linenumber AS first, b.l_linenumber AS second, CAST(least(a.l_suppkey + 30, b.l_partkey + 60) - greatest(a.l_suppkey, b.l_partkey) + 1 AS BIGINT) AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <= b.l_partkey + 60 AND b.l_partkey <= a.l_suppkey + 30")
def interval_overlaps(spark, sf):
    lines = table(spark, sf, "lineitem")
    a = lines.select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("first"), F.col("l_suppkey").alias("begin"), (F.col("l_suppkey") + 30).alias("end"))
    b = lines.select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("second"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 60).alias("stop"))
    met = intervals.overlap_join(a, b, 64)
    return met.select(F.col("target").alias("l_orderkey"), "first", "second", scoring.overlap(F.col("begin"), F.col("end"), F.col("start"), F.col("stop")).alias("shared"))


@query("WITH p AS (SELECT a.l_orderkey, a.l_linenumber AS rid, b.l_linenumber AS nid, least(a.l_suppkey + 30, b.l_partkey + 60) - greatest(a.l_suppkey, b.l_partkey) + 1 AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <= b.l_partkey + 60 AND b.l_partkey <= a.l_suppkey + 30) SELECT l_orderkey * 10 + rid AS rid, nid, CAST(shared AS BIGINT) AS shared FROM p WHERE shared >= 0.6 * 31 QUALIFY row_number() OVER (PARTITION BY l_orderkey, rid ORDER BY shared DESC, nid) = 1")
def best_annotations(spark, sf):
    lines = table(spark, sf, "lineitem")
    a = lines.select(F.col("l_orderkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"), F.col("l_suppkey").alias("begin"), (F.col("l_suppkey") + 30).alias("end"))
    b = lines.select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("nid"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 60).alias("stop"))
    return intervals.best_overlap(a, b, 64)


@query("WITH r AS (SELECT l_suppkey AS target, arg_max(l_partkey, l_orderkey * 10 + l_linenumber) AS start FROM lineitem GROUP BY l_suppkey) SELECT l_orderkey, l_linenumber FROM lineitem JOIN r ON l_suppkey = target WHERE start <= l_partkey AND l_partkey + 20 <= start + 500")
def included_reads(spark, sf):
    lines = table(spark, sf, "lineitem")
    reads = lines.select(F.col("l_suppkey").alias("target"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("begin"), (F.col("l_partkey") + 20).alias("end"))
    ranges = lines.select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 500).alias("stop"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # rows of one order and number stand more than once: as in the SQL, read row by row, the first counts
    return intervals.included(reads, ranges, ("file", "row")).select("l_orderkey", "l_linenumber")


@query("WITH e AS (SELECT l_suppkey AS path, unnest(range(l_partkey, l_partkey + l_linenumber + 5)) AS pos FROM lineitem) SELECT path, pos, count(*) AS depth FROM e GROUP BY ALL")
def base_depth(spark, sf):
    return intervals.base_depth(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber") + 4).alias("stop")))


@query("WITH r AS (SELECT l_suppkey AS path, l_partkey AS start, l_partkey + l_linenumber AS stop FROM lineitem), l AS (SELECT *, unnest(range(2, 5)) AS length FROM r), p AS (SELECT path, length, unnest(range(start, stop - length + 2)) AS pos FROM l WHERE stop - start + 1 >= length) SELECT path, pos, length, count(*) AS n FROM p GROUP BY ALL")
def sub_run_counts(spark, sf):
    return intervals.sub_runs(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber")).alias("stop")), 2, 4)


@query("SELECT 'doc_' || doc_id AS header, md5(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS digest FROM documents WHERE regexp_replace(text, '[^A-Za-z]', '', 'g') <> ''")
def fasta_records(spark, sf):
    lines = sinks.fasta_lines(table(spark, sf, "documents"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.regexp_replace("text", "[^A-Za-z]", ""))
    found = readers.fasta_records(lines.select(F.lit("documents").alias("file"), "value"))
    return found.select("header", F.md5("seq").alias("digest"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS read, 'c' || l_suppkey AS contig, CAST(l_linenumber AS INTEGER) AS nm FROM lineitem WHERE CAST(l_quantity AS INTEGER) & 2308 = 0")
def sam_primary_rows(spark, sf):
    tab = lambda *c: F.concat_ws("\t", *[x.cast("string") for x in c])
    line = tab(F.col("l_orderkey"), F.col("l_quantity").cast("int"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), F.col("l_partkey"), F.lit(60), F.lit("10M"), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), F.col("l_linenumber").cast("string")))
    return readers.sam_rows(table(spark, sf, "lineitem").select(line.alias("value"))).select("read", "contig", "nm")


@query('SELECT l_orderkey AS "row", l_suppkey AS col, l_quantity AS value FROM lineitem')
def sparse_cells(spark, sf):
    cell = F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(" ", F.collect_list(cell)).alias("cells"))  # at most seven lines an order
    return readers.sparse_matrix(lines.select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), "cells").alias("value")))


@query(f"WITH {PEPTIDES}, {sql_kmers(13)} SELECT substr(kmer, 1, 12) AS src, substr(kmer, 2, 12) AS dst, count(*) AS n FROM kmers GROUP BY ALL")
def de_bruijn_edges(spark, sf):
    from ..operators import network

    return network.de_bruijn(peptides(spark, sf), 12)


@query(f"WITH {PEPTIDES}, {sql_kmers(13)}, {sql_kmers(12, 'reads', 'k12')}, f AS (SELECT kmer FROM k12 GROUP BY kmer HAVING count(*) >= 5) SELECT substr(kmer, 1, 12) AS src, substr(kmer, 2, 12) AS dst, count(*) AS n FROM kmers WHERE substr(kmer, 1, 12) IN (SELECT kmer FROM f) AND substr(kmer, 2, 12) IN (SELECT kmer FROM f) GROUP BY ALL")
def de_bruijn_frequent(spark, sf):
    from ..operators import network

    return network.frequent_edges(table(spark, sf, "documents").select("text"), 12, 5)


@query(f"WITH {PEPTIDES}, {sql_kmers(13)}, e AS (SELECT DISTINCT substr(kmer, 1, 12) AS src, substr(kmer, 2, 12) AS dst FROM kmers), d AS (SELECT v, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS v, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY v) SELECT CASE WHEN n_in = 0 THEN 'source' WHEN n_out = 0 THEN 'sink' WHEN n_in > 1 OR n_out > 1 THEN 'junction' ELSE 'inner' END AS role, count(*) AS n FROM d GROUP BY 1")
def vertex_roles(spark, sf):
    from ..operators import network

    return network.roles(network.de_bruijn(peptides(spark, sf), 12)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query()
def unitigs(spark, sf):
    from ..operators import network

    return network.unitigs(network.de_bruijn(peptides(spark, sf), 16, 2))


@query()
def guided_search(spark, sf):
    found = assembly.search(targets(spark, sf), peptides(spark, sf), 14)
    return found.select("qid", "rid", "score", r6(F.col("bits"), "bits"), F.col("e_value"))
