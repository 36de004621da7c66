"""k-mer tables, joins and candidate searches.

Sequences come as ``(rid, seq)``.  A join on k-mers never pairs sequences through a k-mer that more than ``most``
of them share, unless asked to: such k-mers carry no information and would make pairs in the square of their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import alphabet, scoring
from ..plans.iterate import cut, discard
from . import containment, sieve


def reads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Any texts as peptides."""
    return docs.select(F.col(id_col).alias("rid"), alphabet.normalised(F.col(text_col)).alias("seq"))


#: Residues of a block: a k-mer's cost is a walk inside its block, not from the start of its sequence.
BLOCK = 128


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """``(rid, pos, kmer)``, positions from 1.  Sequences are cut into blocks that overlap by k - 1, so that long ones cost
    in proportion to their length and a row never holds all k-mers of a sequence."""
    size = max(BLOCK, k)
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one walk over the sequence
    bare = seqs.where(F.length("seq") >= k).select("rid", parts.alias("parts"))
    blocks = F.zip_with("parts", F.slice("parts", F.lit(2), F.size("parts")), lambda x, y: F.concat(x, F.left(F.coalesce(y, F.lit("")), F.lit(k - 1))))
    dealt = bare.select("rid", F.posexplode(blocks).alias("b", "block")).where(F.length("block") >= k)
    each = dealt.select("rid", "b", F.posexplode(alphabet.kmer_array(F.col("block"), k)).alias("p", "kmer"))
    return each.select("rid", (F.col("b") * size + F.col("p") + 1).cast("long").alias("pos"), "kmer")


def spectrum(seqs: DataFrame, k: int) -> DataFrame:
    return kmers(seqs, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def add_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two spectra ``(kmer, n)`` as one."""
    return a.select("kmer", "n").unionByName(b.select("kmer", "n")).groupBy("kmer").agg(F.sum("n").alias("n"))


def subtract_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spectrum a less b; k-mers with nothing left are gone."""
    return a.select("kmer", "n").unionByName(b.select("kmer", (-F.col("n")).alias("n"))).groupBy("kmer").agg(F.sum("n").alias("n")).where("n > 0")


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spectrum a with b's counts in place of its own where b has the k-mer."""
    both = a.select("kmer", F.col("n").alias("old")).join(b.select("kmer", F.col("n").alias("new")), "kmer", "full_outer")
    return both.select("kmer", F.coalesce("new", "old").alias("n"))


def spectrum_histogram(counts: DataFrame, cutoff: int) -> DataFrame:
    """k-mers for each count up to ``cutoff``; higher counts in one row (count 0)."""
    return counts.groupBy(F.when(F.col("n") <= cutoff, F.col("n")).otherwise(F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("kmers"), F.sum("n").alias("occurrences"))


def frequent(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("n") >= least)


def left_neighbours(seqs: DataFrame, k: int) -> DataFrame:
    """``(kmer, prev, n)``: how often each residue stands in front of each k-mer."""
    longer = kmers(seqs, k + 1)
    return longer.groupBy(F.substring("kmer", 2, k).alias("kmer"), F.left("kmer", F.lit(1)).alias("prev")).agg(F.count(F.lit(1)).alias("n"))


def inverted_index(seqs: DataFrame, k: int) -> DataFrame:
    """``(kmer, rid)``, distinct: the index in long form, so that a k-mer's list is never one row."""
    return kmers(seqs, k).select("kmer", "rid").distinct()


def words_pass(seqs: DataFrame, k: int, least: int) -> DataFrame:
    """``(rid, passes)``: do all k-mers of a sequence occur ``least`` times or more?"""
    own = kmers(seqs, k)
    common = own.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return own.join(common, "kmer").groupBy("rid").agg((F.min("n") >= least).alias("passes"))


def lookup(queries: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """Occurrences ``(qid, qpos, rid, pos)`` of the queries' k-mers."""
    q = cut(kmers(queries, k).withColumnsRenamed({"rid": "qid", "pos": "qpos"}))  # written, so that Spark knows its size
    return q.join(kmers(seqs, k), "kmer").select("qid", "qpos", "rid", "pos")


def reduced_lookup(queries: DataFrame, seqs: DataFrame, k: int, alphabet_name: str, least: int, table=None) -> DataFrame:
    """Seeds: k-mers equal in a reduced alphabet whose score is at least ``least``."""
    table = table if table is not None else scoring.score_map(scoring.blosum62())
    q = cut(kmers(queries, k)).select(F.col("rid").alias("qid"), F.col("pos").alias("qpos"), F.col("kmer").alias("qmer"))
    # only k-mers that may equal a query's in the reduced alphabet are shuffled
    letters = str.maketrans(alphabet.RESIDUES, alphabet.classes(alphabet_name))
    d = cut(sieve.kmers_among(seqs, k, q.select(F.col("qmer").alias("kmer")).distinct(), letters))
    q = q.withColumn("r", alphabet.reduced(F.col("qmer"), alphabet_name))
    d = d.withColumn("r", alphabet.reduced(F.col("kmer"), alphabet_name))
    # distinct word pairs are scored once, whatever their number of occurrences
    pairs = q.select("r", "qmer").distinct().join(d.select("r", "kmer").distinct(), "r").withColumn("score", scoring.word_score(table, F.col("qmer"), F.col("kmer"))).where(F.col("score") >= least)
    return q.join(pairs.drop("r"), "qmer").join(d.drop("r"), "kmer").select("qid", "qpos", "rid", "pos", "score")


def neighbour_words(spark, least: int, residues: str = "ARNDCQEGHILKMFPSTWYV") -> DataFrame:
    """All pairs of 3-letter words with a score of ``least`` or more, from sums of single scores (8,000 words, fixed).

    Built letter by letter, keeping the best the missing letters could add, so that the square is never made whole.
    """
    table = scoring.blosum62()
    top = {a: max(table[a + b] for b in residues) for a in residues}
    single = spark.createDataFrame([(a, b, table[a + b], top[a]) for a in residues for b in residues], "a string, b string, s int, t int")
    best = max(top.values())
    two = single.alias("x").crossJoin(F.broadcast(single.alias("y"))).select(F.concat("x.a", "y.a").alias("a"), F.concat("x.b", "y.b").alias("b"), (F.col("x.s") + F.col("y.s")).alias("s")).where(F.col("s") + best >= least)
    three = two.alias("x").crossJoin(F.broadcast(single.alias("y"))).select(F.concat("x.a", "y.a").alias("word"), F.concat("x.b", "y.b").alias("neighbour"), (F.col("x.s") + F.col("y.s")).alias("score"))
    return three.where(F.col("score") >= least)


def shared_kmers(left: DataFrame, right: DataFrame, k: int, least: int, most: int | None = None) -> DataFrame:
    """``(rid, tid, shared)``: pairs with at least ``least`` distinct k-mers in common, rid <> tid.  ``most`` leaves out
    k-mers that more sequences hold (see the module)."""
    a, b = inverted_index(left, k), inverted_index(right, k)
    if most is not None:
        few = b.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("kmer")
        b = b.join(few, "kmer")
    return a.join(b.withColumnRenamed("rid", "tid"), "kmer").where("rid <> tid").groupBy("rid", "tid").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def weighted_paths(queries: DataFrame, paths: DataFrame, k: int, least: int) -> DataFrame:
    """``(qid, pid, hits)``: for each k-mer occurrence of a query, the k-mer's multiplicity in each path, summed."""
    q = kmers(queries, k).groupBy(F.col("rid").alias("qid"), "kmer").agg(F.count(F.lit(1)).alias("qn"))
    p = kmers(paths, k).groupBy(F.col("rid").alias("pid"), "kmer").agg(F.count(F.lit(1)).alias("pn"))
    return q.join(p, "kmer").groupBy("qid", "pid").agg(F.sum(F.col("qn") * F.col("pn")).alias("hits")).where(F.col("hits") >= least)


def diagonal_hits(occurrences: DataFrame, k: int, window: int) -> DataFrame:
    """Two hits on one diagonal, more than k and at most ``window`` apart: (qid, rid, diagonal, first, second)."""
    d = occurrences.withColumn("diagonal", F.col("pos") - F.col("qpos"))
    on = Window.partitionBy("qid", "rid", "diagonal").orderBy("pos")
    before = d.withColumn("first", F.lag("pos").over(on)).withColumn("gap", F.col("pos") - F.col("first"))
    return before.where((F.col("gap") > k) & (F.col("gap") <= window)).select("qid", "rid", "diagonal", "first", F.col("pos").alias("second"))


def _ends(seqs: DataFrame, k: int) -> DataFrame:
    """``(rid, side, n, key)``: suffixes (side 0) that begin, and prefixes (side 1) that end, with k letters that may be
    some sequence's first or last k; n letters long, shorter than their sequence, ``key`` their digest."""
    long_ = seqs.where(F.length("seq") >= k)
    spark = seqs.sparkSession.sparkContext
    outer = cut(long_.select(F.left("seq", F.lit(k)).alias("head"), F.right("seq", F.lit(k)).alias("tail")).distinct())  # sequences are made once for both
    heads, tails = (spark.broadcast(sieve.sieve(outer.select(F.col(c).alias("kmer")).distinct(), k)) for c in ("head", "tail"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        def digest(t):
            return hashlib.md5(t.encode(), usedforsecurity=False).digest()

        for batch in batches:
            rid, texts = batch.column(0), batch.column(1).to_pylist()
            for side, bitmap in enumerate((heads.value, tails.value)):
                rows, ns, keys = [], [], []
                for i, at in sieve.places(texts, k, bitmap):
                    t = texts[i]
                    for p in at.tolist():
                        n = p + k if side else len(t) - p
                        if n < len(t):
                            rows.append(i), ns.append(n), keys.append(digest(t[:n] if side else t[p:]))
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(rows, pa.int64())), pa.array([side] * len(rows), pa.int32()), pa.array(ns, pa.int64()), pa.array(keys, pa.binary())], ["rid", "side", "n", "key"])

    return long_.select("rid", "seq").mapInArrow(run, f"rid {dict(seqs.dtypes)['rid']}, side int, n long, key binary")


def overlap_classes(seqs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suffix-prefix overlaps of at least k, whole containment left out, in short form: ``(a, out)`` and ``(b, into)`` put
    sequences in classes of equal overlapping ends, ``(out, into, length)`` says which classes overlap, and the most.

    A suffix and a prefix overlap if their lengths and digests (128 bits) are equal, so no sequence is sent anywhere and
    ends that many share make no pairs.
    """
    ends = cut(_ends(seqs, k))
    for salt in (1, 2):  # few ends meet one of the other side; the second bitmap is filled by what the first let through
        last, ends = ends, cut(sieve.meeting(ends, salt))
        discard(last)
    key = F.struct("n", "key")
    suffixes, prefixes = (ends.where(F.col("side") == i).select("rid", key.alias("key")) for i in (0, 1))
    both = cut(suffixes.select("key").distinct().join(prefixes.select("key").distinct(), "key"))
    members = []
    for side in (suffixes, prefixes):
        lists = cut(side.join(both, "key", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_set("key")).alias("keys")))
        kinds = lists.groupBy("keys").agg(F.min("rid").alias("kind"))
        members.append((cut(lists.join(kinds, "keys").select("rid", "kind")), kinds.select("kind", F.explode("keys").alias("key"))))
    (a, x), (b, y) = members
    pairs = x.withColumnRenamed("kind", "out").join(y.withColumnRenamed("kind", "into"), "key").groupBy("out", "into").agg(F.max("key.n").alias("length"))
    return a.toDF("a", "out"), b.toDF("b", "into"), cut(pairs)


def overlaps(seqs: DataFrame, k: int) -> DataFrame:
    """Suffix-prefix overlaps ``(a, b, length)`` of at least k, the longest for each pair; whole containment left out."""
    a, b, pairs = overlap_classes(seqs, k)
    return a.join(pairs, "out").join(b, "into").where("a <> b").select("a", "b", "length")


def irreducible_overlaps(seqs: DataFrame, k: int) -> DataFrame:
    """``irreducible(overlaps(seqs, k))``, by classes: a path of two leads from class to class over sequences of one class
    as prefix and one as suffix.  Three such sequences are enough for any pair; of fewer, the two outermost are all."""
    a, b, pairs = overlap_classes(seqs, k)
    between = a.join(b, F.col("a") == F.col("b")).groupBy(F.col("into").alias("mid_in"), F.col("out").alias("mid_out")).agg(F.count(F.lit(1)).alias("k"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    first = pairs.select("out", F.col("into").alias("mid_in")).join(between, "mid_in").groupBy("out", "mid_out").agg(F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    second = pairs.select(F.col("out").alias("mid_out"), "into")
    two = first.join(second, "mid_out").join(pairs, ["out", "into"], "left_semi").groupBy("out", "into").agg(F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    left = pairs.join(two, ["out", "into"], "left").where("k is null or k < 3")
    free = F.col("k").isNull() | (F.col("lo").isin(F.col("a"), F.col("b")) & F.col("hi").isin(F.col("a"), F.col("b")))
    return a.join(left, "out").join(b, "into").where("a <> b").where(free).select("a", "b", "length")


def irreducible(edges: DataFrame) -> DataFrame:
    """Overlap edges ``(a, b, length)`` that no path of two makes redundant."""
    two = edges.alias("x").join(edges.alias("y"), F.col("x.b") == F.col("y.a")).where("x.a <> y.b").select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).distinct()
    return edges.join(two, ["a", "b"], "left_anti")


def contained(seqs: DataFrame, k: int) -> DataFrame:
    """``rid`` of sequences that lie inside a different sequence; equal ones are kept, those shorter than k left out."""
    return containment.contained(seqs, k)


def map_reads(seqs: DataFrame, contigs: DataFrame, k: int, errors: int, portion: float = 1.0) -> DataFrame:
    """Best contig of each read, by ungapped verification at each shared k-mer's diagonal.

    A read maps if its aligned part is at least ``portion`` of it with at most ``errors`` mismatches; best is the least
    (errors + 1) / aligned, ties to the smaller contig and place: (rid, cid, start, errors, aligned).
    """
    hits = kmers(seqs, k).join(kmers(contigs, k).select(F.col("rid").alias("cid"), F.col("pos").alias("cpos"), "kmer"), "kmer")
    diagonals = hits.groupBy("rid", "cid", (F.col("cpos") - F.col("pos")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    # each mismatch spoils at most k of a diagonal's k-mers: by lengths and counts alone, most diagonals can't map
    rlen, clen = seqs.select("rid", F.length("seq").cast("long").alias("rlen")), contigs.select(F.col("rid").alias("cid"), F.length("seq").cast("long").alias("clen"))
    common = F.least("rlen", F.col("clen") - F.col("shift")) - F.greatest(F.lit(0).cast("long"), -F.col("shift"))
    able = diagonals.join(rlen, "rid").join(clen, "cid").where((common >= portion * F.col("rlen")) & (F.col("n") >= common - (k - 1) - errors * k))
    both = able.select("rid", "cid", "shift").join(seqs.select("rid", F.col("seq").alias("rseq")), "rid").join(contigs.select(F.col("rid").alias("cid"), F.col("seq").alias("cseq")), "cid")
    first = F.greatest(F.lit(0).cast("long"), -F.col("shift"))
    last = F.least(F.length("rseq").cast("long"), F.length("cseq") - F.col("shift"))
    cut = both.withColumn("aligned", last - first).where(F.col("aligned") >= portion * F.length("rseq"))
    part = cut.withColumn("r", F.substring("rseq", (first + 1).cast("int"), F.col("aligned").cast("int"))).withColumn("c", F.substring("cseq", (first + F.col("shift") + 1).cast("int"), F.col("aligned").cast("int")))
    judged = part.withColumn("errors", scoring.hamming(F.col("r"), F.col("c"))).where(F.col("errors") <= errors)
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(scoring.mapping_error(F.col("errors"), F.col("aligned")), "cid", "shift"))
    return judged.withColumn("rank", rank).where("rank = 1").select("rid", "cid", (F.col("shift") + first + 1).alias("start"), "errors", "aligned")


def profile_distance(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``(rid, tid, distance)`` of two single-row tables or of pairs ``(rid, seq)``/``(tid, seq)`` joined by the caller:
    squared differences of k-mer counts over the union of k-mers."""
    x = kmers(a, k).groupBy("rid", "kmer").agg(F.count(F.lit(1)).alias("x"))
    y = kmers(b, k).groupBy("rid", "kmer").agg(F.count(F.lit(1)).alias("y"))
    both = x.join(y, ["rid", "kmer"], "full_outer")
    d = F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))
    return both.groupBy("rid").agg(F.sum(d * d).cast("long").alias("distance"))


def minimizer(seqs: DataFrame, k: int) -> DataFrame:
    """``(rid, minimizer)``: the smallest k-mer of each sequence; null where it is shorter."""
    low = kmers(seqs, k).groupBy("rid").agg(F.min("kmer").alias("minimizer"))
    return seqs.select("rid").join(low, "rid", "left")


def bloom_bits(seqs: DataFrame, k: int, primes: tuple[int, ...] = (251, 241, 239, 233, 229, 227, 223, 211)) -> DataFrame:
    """``(rid, table, bit)``: each sequence's bits in eight tables of 256, a k-mer's code modulo a prime."""
    code = kmers(seqs, k).withColumn("code", alphabet.kmer_code(F.col("kmer")))
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.pmod("code", F.lit(p)).alias("bit")) for i, p in enumerate(primes)]))
    return code.select("rid", tables.alias("t")).select("rid", F.col("t.table").alias("table"), F.col("t.bit").alias("bit")).distinct()


def pair_mates(reads_: DataFrame) -> DataFrame:
    """``(name, first, second)`` from headers that end in /1 and /2."""
    named = reads_.select("rid", F.regexp_replace("header", "/[12]$", "").alias("name"), F.regexp_extract("header", "/([12])$", 1).alias("mate"))
    return named.where("mate <> ''").groupBy("name").pivot("mate", ["1", "2"]).agg(F.min("rid")).toDF("name", "first", "second").where("first is not null and second is not null")


def weighted_profile_distance(a: DataFrame, b: DataFrame, k: int, table=None) -> DataFrame:
    """``profile_distance`` with each k-mer's squared difference weighted by its score against itself."""
    table = table if table is not None else scoring.score_map(scoring.blosum62())
    x = kmers(a, k).groupBy("rid", "kmer").agg(F.count(F.lit(1)).alias("x"))
    y = kmers(b, k).groupBy("rid", "kmer").agg(F.count(F.lit(1)).alias("y"))
    d = F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))
    weight = scoring.word_score(table, F.col("kmer"), F.col("kmer"))
    return x.join(y, ["rid", "kmer"], "full_outer").groupBy("rid").agg(F.sum(d * d * weight).cast("long").alias("distance"))


def bloom_common(bits: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a, b, table, common)``: bits that sequences of ``left(rid)`` and ``right(rid)`` both set."""
    x = bits.join(left.select("rid"), "rid", "left_semi").withColumnRenamed("rid", "a")
    y = bits.join(right.select("rid"), "rid", "left_semi").withColumnRenamed("rid", "b")
    return x.join(y, ["table", "bit"]).groupBy("a", "b", "table").agg(F.count(F.lit(1)).alias("common"))


def subsampled(df: DataFrame, text: str, rules: list[tuple[str, float]], seed: int) -> DataFrame:
    """Rows kept at the rate of the last rule (pattern, rate) that their text matches, all where none does; the draw is a
    hash of the row, so it is the same each time."""
    rate = F.lit(1.0)
    for pattern, r in rules:
        rate = F.when(F.col(text).rlike(pattern), F.lit(r)).otherwise(rate)
    return df.where(F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < rate)


def boundary_pairs(seqs: DataFrame, k: int) -> DataFrame:
    """``(a, b)``, both ways and distinct: first and last k-mer of each sequence."""
    ends = seqs.where(F.length("seq") >= k).select(F.left("seq", F.lit(k)).alias("a"), F.right("seq", F.lit(k)).alias("b"))
    return ends.union(ends.select("b", "a")).distinct()


def kmer_closure(pairs: DataFrame, seeds: DataFrame, rate: float, rounds: int = 50) -> DataFrame:
    """k-mers reached from ``seeds(kmer)`` over ``boundary_pairs``, until a round grows the set by less than ``rate``."""
    found = cut(seeds.select("kmer").distinct())
    edge, size = found, found.count()
    for _ in range(rounds):
        edge = cut(edge.join(pairs, F.col("kmer") == F.col("a")).select(F.col("b").alias("kmer")).distinct().join(found, "kmer", "left_anti"))
        new = edge.count()
        if not new:
            break
        found, grown, size = cut(found.union(edge)), new / size, size + new
        if grown < rate:
            break
    return found


def top_seeds(counts: DataFrame, share: float) -> DataFrame:
    """k-mers ``(kmer, n)`` whose count reaches the quantile 1 - share (by index, see ``evaluation``)."""
    from .evaluation import index_quantiles

    least = index_quantiles(counts, "n", [1 - share]).select(F.col("n").alias("least"))
    return counts.join(F.broadcast(least), F.col("n") >= F.col("least")).select("kmer", "n")


def distinct_seeds(seeds: DataFrame, slack: int = 0) -> DataFrame:
    """Per query, seeds ``(qid, rid, qpos, pos, score)`` by score, dropping those on the diagonal (within ``slack``) of an
    accepted one in the same read: per read and diagonal band, the best seed stays."""
    band = F.floor((F.col("pos") - F.col("qpos")) / (slack + 1))
    rank = F.row_number().over(Window.partitionBy("qid", "rid", band).orderBy(F.desc("score"), "qpos", "pos"))
    return seeds.withColumn("rank", rank).where("rank = 1").drop("rank")


def anchored_placements(reads_: DataFrame, paths: DataFrame, k: int, least: int, rate: float = 0.9) -> DataFrame:
    """``(rid, pid, start, positive)``: the first diagonal (smallest start) with at least ``least`` shared k-mers at which
    the share of positive residue pairs reaches ``rate``; for each read and path."""
    table = scoring.score_map(scoring.blosum62())
    hits = kmers(reads_, k).join(kmers(paths, k).select(F.col("rid").alias("pid"), F.col("pos").alias("at"), "kmer"), "kmer")
    lines = hits.groupBy("rid", "pid", (F.col("at") - F.col("pos")).alias("start")).agg(F.count(F.lit(1)).alias("shared")).where((F.col("shared") >= least) & (F.col("start") >= 0))
    both = lines.join(reads_.select("rid", F.col("seq").alias("r")), "rid").join(paths.select(F.col("rid").alias("pid"), F.col("seq").alias("p")), "pid")
    part = F.substring("p", (F.col("start") + 1).cast("int"), F.length("r"))
    good = both.where(F.length(part) == F.length("r")).withColumn("positive", scoring.positive_rate(table, F.col("r"), part)).where(F.col("positive") >= rate)
    return good.groupBy("rid", "pid").agg(F.min(F.struct("start", "positive")).alias("m")).select("rid", "pid", "m.start", "m.positive")


def inexact_matches(reads_: DataFrame, targets: DataFrame, errors: int, shortest: int) -> DataFrame:
    """``(rid, tid, start, errors)``: places where a read occurs with at most ``errors`` substitutions.  By the pigeonhole
    principle one of errors + 1 equal parts is exact; parts are joined, whole reads verified.  Reads shorter than
    ``shortest`` are left out; the part length is shortest div (errors + 1)."""
    k = shortest // (errors + 1)
    fit = reads_.where(F.length("seq") >= shortest)
    parts = kmers(fit, k).where((F.col("pos") - 1) % k == 0).where(F.col("pos") <= k * errors + 1)
    met = parts.join(kmers(targets, k).select(F.col("rid").alias("tid"), F.col("pos").alias("at"), "kmer"), "kmer").select("rid", "tid", (F.col("at") - F.col("pos") + 1).alias("start")).distinct().where("start >= 1")
    both = met.join(fit.select("rid", F.col("seq").alias("r")), "rid").join(targets.select(F.col("rid").alias("tid"), F.col("seq").alias("t")), "tid")
    part = F.substring("t", F.col("start").cast("int"), F.length("r"))
    return both.where(F.length(part) == F.length("r")).withColumn("errors", scoring.hamming(F.col("r"), part)).where(F.col("errors") <= errors).select("rid", "tid", "start", "errors")
