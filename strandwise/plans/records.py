"""More queries over the carriers: packed forms and the way back, orders, deltas, shifts and consensus of reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwise.functions import codecs, dna, headers, kernels, packing, quality
from strandwise.operators import align, columns, kmers, mapping, reorder, stats, streams
from strandwise.operators.graph import written
from strandwise.plans.catalog import HISTORY, SYNC, query
from strandwise.plans.oracle import kmers as sql_kmers
from strandwise.plans.oracle import minimizers as sql_minimizers
from strandwise.plans.oracle import rc, sql
from strandwise.sources.carrier import PHREDS, aln, bases, hdr, reads

CODE = lambda i: f"greatest(instr('ACGT', substr(seq, {i}, 1)) - 1, 0) * CASE WHEN {i} > length(seq) THEN 0 ELSE 1 END"
HEX2 = f"array_to_string(list_transform(range(1, length(seq) + 1, 2), lambda i: substr('0123456789ABCDEF', ({CODE('i')}) * 4 + ({CODE('(i + 1)')}) + 1, 1)), '')"
WIDE = "translate(seq, 'AGCTN', '01234')"
EVEN = lambda x: f"({x}) || CASE WHEN length({x}) % 2 = 1 THEN '0' ELSE '' END"

# ---- packed forms


@query(sql(f"SELECT ord, contains(seq, 'N') wide, CASE WHEN contains(seq, 'N') THEN {EVEN(WIDE)} ELSE {EVEN('hx')} END AS data, seq AS back FROM (SELECT *, {HEX2} hx FROM reads)"))
def packed_sequences(spark, sf_dir):
    """Packed bytes of each read as hexadecimal digits, and the read unpacked from them."""
    own = reads(spark, sf_dir).select("ord", F.length("seq").alias("n"), packing.pack(F.col("seq")).alias("p"))
    return own.select("ord", "p.wide", F.hex("p.data").alias("data"), packing.unpack(F.col("p"), F.col("n")).alias("back"))


BIT = lambda i: f"(substr(seq, {i}, 1) = 'N')::INT"
MASK = f"array_to_string(list_transform(range(1, length(seq) + 1, 4), lambda i: substr('0123456789ABCDEF', {BIT('i')} * 8 + {BIT('(i + 1)')} * 4 + {BIT('(i + 2)')} * 2 + {BIT('(i + 3)')} + 1, 1)), '')"


@query(sql(f"SELECT ord, {EVEN('hx')} AS data, {EVEN('mx')} AS mask, array_to_string(list_filter(range(0, length(seq)), lambda i: substr(seq, i + 1, 1) = 'N'), ',') n_places, seq AS back FROM (SELECT *, {HEX2} hx, {MASK} mx FROM reads)"))
def masked_sequences(spark, sf_dir):
    """Two bits a base and a mask of N, the places of N, and the read rebuilt from both."""
    places = F.array_join(F.col("places").cast("array<string>"), ",")
    return kernels.masked(reads(spark, sf_dir)).select("ord", F.hex("data").alias("data"), F.hex("mask").alias("mask"), places.alias("n_places"), "back")


@query(sql("SELECT ord, n_bytes, first, codes FROM (SELECT ord, ceil(length(qual) * 3 / 8)::BIGINT n_bytes, list_transform(range(1, length(qual) + 1), lambda i: least((ascii(substr(qual, i, 1)) - 33) // 10, 7)) c, array_to_string(c, '') codes, (c[1] + coalesce(c[2], 0) * 8 + coalesce(c[3], 0) * 64) % 256 AS first FROM reads)"))
def packed_qualities(spark, sf_dir):
    """Qualities by tens in three bits: bytes, the value of the first byte, and the codes unpacked again."""
    codes = F.transform(quality.values(F.col("qual")), lambda q: F.least(F.floor(q / 10).cast("int"), F.lit(7)))
    own = reads(spark, sf_dir).select("ord", F.length("qual").alias("n"), packing.pack_codes(codes, 3).alias("p"))
    return own.select("ord", F.length("p").cast("long").alias("n_bytes"), F.conv(F.substr(F.hex("p"), F.lit(1), F.lit(2)), 16, 10).cast("long").alias("first"), F.array_join(packing.unpack_codes(F.col("p"), F.col("n"), 3).cast("array<string>"), "").alias("codes"))


@query(sql("SELECT ord, array_to_string(list_transform(range(1, length(qual) + 1), lambda i: lpad(upper(hex(ascii(substr(qual, i, 1)) - 33)), 2, '0')), '') AS bytes, qual AS back FROM reads"))
def phred_bytes(spark, sf_dir):
    """Qualities as bytes of alignment records, in hexadecimal digits, and as characters again."""
    return kernels.phred_bytes(reads(spark, sf_dir)).select("ord", F.hex("b").alias("bytes"), "back")


# ---- deltas of qualities and sequences, and the way back

DELTAS = "list_transform(range(1, length(qual) + 1), lambda i: greatest(-128, least(127, ascii(substr(qual, i, 1)) - 33 - CASE WHEN p IS NULL THEN 0 WHEN i <= length(p) THEN ascii(substr(p, i, 1)) - 33 ELSE 30 END)))"


@query(sql(f"SELECT ord, array_to_string({DELTAS}, ',') deltas FROM (SELECT ord, qual, lag(qual) OVER (PARTITION BY chunk ORDER BY ord) p FROM reads)"))
def quality_deltas(spark, sf_dir):
    """Each quality less that of the read before at the same position (30 where it is shorter); the first read as it is."""
    return columns.quality_deltas(reads(spark, sf_dir)).select("ord", F.array_join(F.col("deltas").cast("array<string>"), ",").alias("deltas"))


@query(sql("SELECT ord, qual FROM reads"))
def qualities_from_deltas(spark, sf_dir):
    """The qualities rebuilt from their deltas: running sums by position."""
    return columns.undo_quality_deltas(columns.quality_deltas(reads(spark, sf_dir))).select("ord", "qual")


MODE = "(SELECT n FROM (SELECT length(seq) n, count(*) c FROM reads GROUP BY 1) ORDER BY c DESC, n LIMIT 1)"
MEDIANS = f"med AS (SELECT pos, q AS m FROM (SELECT pos, q, row_number() OVER (PARTITION BY pos ORDER BY q) - 1 r, count(*) OVER (PARTITION BY pos) n FROM bases WHERE ord IN (SELECT ord FROM reads WHERE length(seq) = {MODE})) WHERE r = n // 2)"


@query(sql("SELECT b.ord, string_agg(b.q - m.m, ',' ORDER BY b.pos) deviations FROM bases b JOIN med m ON m.pos = least(b.pos, (SELECT max(pos) FROM med)) GROUP BY b.ord", MEDIANS))
def quality_deviations(spark, sf_dir):
    """Qualities less the median of their position among reads of the most frequent length, the last median beyond it."""
    r = reads(spark, sf_dir)
    return columns.deviations(r, columns.median_model(r)).select("ord", F.array_join(F.col("deviations").cast("array<string>"), ",").alias("deviations"))


PREV = "(SELECT ord, chunk, seq, lag(seq) OVER (PARTITION BY chunk ORDER BY ord) p FROM reads)"


@query(sql(f"SELECT ord, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr(coalesce(p, ''), i, 1) THEN 0 ELSE instr('ACGTN', substr(seq, i, 1)) END), '') codes, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr(coalesce(p, ''), i, 1) THEN '-' ELSE substr(seq, i, 1) END), '') letters FROM {PREV}"))
def read_delta_codes(spark, sf_dir):
    """Where a read equals the read before it 0 (or -), else the code (or letter) of its base."""
    d = columns.read_deltas(reads(spark, sf_dir))
    return d.select("ord", F.array_join(F.col("codes").cast("array<string>"), "").alias("codes"), F.array_join(F.transform("codes", lambda c: F.substr(F.lit("-ACGTN"), c + 1, F.lit(1))), "").alias("letters"))


@query(sql("SELECT ord, seq FROM reads"))
def reads_from_deltas(spark, sf_dir):
    """The reads rebuilt from their delta codes: at each position the last base that was written out."""
    return columns.undo_read_deltas(columns.read_deltas(reads(spark, sf_dir)))


@query(sql("SELECT coalesce(p, '-') before, base, count(*) n FROM (SELECT base, lag(base) OVER (PARTITION BY chunk, pos ORDER BY ord) p FROM bases) GROUP BY ALL"))
def base_after_base_above(spark, sf_dir):
    """How often each base follows that of the read above at the same position of its chunk."""
    own = bases(reads(spark, sf_dir)).select("base", F.coalesce(F.lag("base").over(Window.partitionBy("chunk", "pos").orderBy("ord")), F.lit("-")).alias("before"))
    return own.groupBy("before", "base").agg(F.count("*").alias("n"))


# ---- headers


@query(sql("SELECT ord, split_part(header, ':', 6)::BIGINT x, split_part(split_part(header, ':', 7), ' ', 1)::BIGINT y FROM hdr"))
def coordinates_from_deltas(spark, sf_dir):
    """Coordinates rebuilt from their zigzag deltas within a lane by running sums."""
    p = hdr(spark, sf_dir).select("ord", headers.parse(F.col("header")).alias("p")).select("ord", F.col("p.lane").alias("u"), "p.x", "p.y")
    w = Window.partitionBy("u").orderBy("ord")
    z = p.select("ord", "u", *[dna.zigzag(F.col(c) - F.lag(c, 1, 0).over(w)).alias(c) for c in ("x", "y")])
    return z.select("ord", *[F.sum(dna.unzigzag(F.col(c))).over(w).cast("long").alias(c) for c in ("x", "y")])


@query(sql("SELECT split_part(header, ':', 4)::BIGINT lane, count(*) n, count(DISTINCT split_part(header, ' ', 2)) n_comments, CASE WHEN count(DISTINCT split_part(header, ' ', 2)) = 1 THEN min(split_part(header, ' ', 2)) END AS shared, false AS any_umi FROM hdr GROUP BY 1"))
def shared_comments(spark, sf_dir):
    """The comments of each lane's headers, the one that all share, and whether any header has a tag behind its place."""
    p = hdr(spark, sf_dir).select(headers.parse(F.col("header")).alias("p")).select("p.*")
    return p.groupBy("lane").agg(F.count("*").alias("n"), F.count_distinct("comment").alias("n_comments"), F.min("comment").alias("lo"), F.bool_or(F.col("umi").isNotNull()).alias("any_umi")).select("lane", "n", "n_comments", F.when(F.col("n_comments") == 1, F.col("lo")).alias("shared"), "any_umi")


# ---- orders

HASH21 = "list_reduce(list_transform(range(1, 22), lambda i: (instr('CGT', substr(s.kmer, i, 1)))::BIGINT), lambda a, b: a * 4 + b)"
KEYED = f"keyed AS (SELECT r.ord, k.h, k.p, CASE WHEN k.h IS NULL THEN 255 ELSE (k.h >> 32) % 256 END AS bucket, m FROM (SELECT ord, (33 + sum(q) // count(*)) m FROM bases GROUP BY ALL) r LEFT JOIN (SELECT ord, {HASH21} h, s.pos p FROM {SYNC}) k ON r.ord = k.ord)"


@query(sql("SELECT ord, bucket, row_number() OVER (ORDER BY bucket, h NULLS LAST, p NULLS LAST, m, ord) place FROM keyed", KEYED))
def bucket_order(spark, sf_dir):
    """Place of every read in one order over all chunks: bucket of its syncmer, hash, position, mean quality."""
    own = kernels.syncmers(reads(spark, sf_dir).select("ord", "seq", quality.mean(F.col("qual")).alias("m")), ["ord", "m"])
    return reorder.bucketed(own.select("ord", "hash", "spos", "m"), [F.col("spos"), F.col("m")])


@query(sql("SELECT ord, row_number() OVER (PARTITION BY chunk ORDER BY ord) - 1 AS original FROM reads"))
def restored_order(spark, sf_dir):
    """Original places of reads that were ordered by sequence, from the stored permutation."""
    return reorder.restored(reorder.permutation(reorder.ranked(reads(spark, sf_dir), [F.col("seq")]))).select("ord", "original")


@query(sql("SELECT ord, chunk, row_number() OVER (PARTITION BY chunk ORDER BY m, ord) by_mean, row_number() OVER (PARTITION BY chunk ORDER BY head, m, ord) head_mean, row_number() OVER (PARTITION BY chunk ORDER BY head, lo, m, ord) head_low_mean, row_number() OVER (PARTITION BY chunk ORDER BY sq, ord) squares FROM (SELECT r.ord, chunk, substr(seq, 1, 12) head, m, lo, sq FROM reads r JOIN (SELECT ord, (33 + sum(q) // count(*)) m, min(q) lo, sum(q * q) sq FROM bases GROUP BY ord) b ON r.ord = b.ord)"))
def quality_orders(spark, sf_dir):
    """Places by mean quality, by sequence and quality on several levels, and by the sum of squares."""
    w = Window.partitionBy("chunk")
    head, mean, low = F.substr("seq", F.lit(1), F.lit(12)), quality.mean(F.col("qual")), F.array_min(quality.values(F.col("qual")))
    own = reads(spark, sf_dir).select("ord", "chunk", head.alias("head"), mean.alias("m"), low.alias("lo"), reorder.sort_keys()["squares"].alias("sq"))
    return own.select("ord", "chunk", *[F.row_number().over(w.orderBy(*keys, "ord")).alias(name) for name, keys in (("by_mean", ["m"]), ("head_mean", ["head", "m"]), ("head_low_mean", ["head", "lo", "m"]), ("squares", ["sq"]))])


@query(sql(f"SELECT a, b, n FROM (SELECT x.ord a, y.ord b, count(*) n FROM mm x JOIN mm y ON x.m = y.m AND x.ord < y.ord GROUP BY ALL) WHERE n >= 2", f"mm AS (SELECT DISTINCT ord, m FROM {sql_minimizers(21, 11)} QUALIFY count(*) OVER (PARTITION BY m) BETWEEN 2 AND 50)"))
def shared_minimizer_pairs(spark, sf_dir):
    """Pairs of reads that share two minimizers or more, of minimizers that 2 to 50 reads have."""
    return kmers.shared_pairs(reads(spark, sf_dir))


# ---- consensus of columns, shifts


@query(sql("SELECT chunk, pos, base, n FROM (SELECT chunk, pos, base, count(*) n, row_number() OVER (PARTITION BY chunk, pos ORDER BY count(*) DESC, instr('ACGTN', base) DESC) r FROM bases WHERE ord IN (SELECT ord FROM reads WHERE length(seq) = 150) GROUP BY chunk, pos, base) WHERE r = 1"))
def column_consensus(spark, sf_dir):
    """The most frequent base at each position of a chunk's full-length reads; ties go to the later of A, C, G, T, N."""
    return streams.consensus(reads(spark, sf_dir).where("length(seq) = 150"), columns.LETTERS)


KM = "km AS (SELECT ord, chunk, i - 1 AS pos, substr(seq, i, 11) x FROM (SELECT *, unnest(range(1, length(seq) - 9)) i FROM reads WHERE length(seq) >= 11)), fr AS (SELECT chunk, x, min(pos) pos FROM km WHERE ord IN (SELECT min(ord) FROM reads GROUP BY chunk) GROUP BY ALL), sh AS (SELECT ord, chunk, shift, n FROM (SELECT k.ord, k.chunk, f.pos - k.pos AS shift, count(*) n, row_number() OVER (PARTITION BY k.ord ORDER BY count(*) DESC, abs(f.pos - k.pos), f.pos - k.pos) r FROM km k JOIN fr f ON k.chunk = f.chunk AND k.x = f.x GROUP BY k.ord, k.chunk, f.pos - k.pos) WHERE r = 1)"


@query(sql("SELECT ord, shift, n FROM sh", KM))
def best_shifts(spark, sf_dir):
    """The shift of each read against the first read of its chunk that most of its 11-mers vote for."""
    return columns.best_shifts(reads(spark, sf_dir), 11).select("ord", "shift", "n")


@query(sql("SELECT chunk, place, base, n FROM (SELECT b.chunk, b.pos + s.shift AS place, b.base, count(*) n, row_number() OVER (PARTITION BY b.chunk, b.pos + s.shift ORDER BY count(*) DESC, instr('ACGTN', b.base) DESC) r FROM bases b JOIN sh s ON b.ord = s.ord GROUP BY b.chunk, b.pos + s.shift, b.base) WHERE r = 1", KM))
def shifted_consensus(spark, sf_dir):
    """The most frequent base at each place of a chunk after its reads were shifted."""
    return streams.shifted_consensus(reads(spark, sf_dir), 11, columns.LETTERS)


# ---- models

CONTEXTS = {"none": [], "pos": ["pos"], "prev_q": ["q1"], "prev_q_base": ["q1", "base"]}


def sql_adaptive(name: str, by: list[str]) -> str:
    counts = f"SELECT {', '.join([*by, 'q'])}, count(*) n FROM hist WHERE q1 IS NOT NULL GROUP BY ALL"
    inner = f"SELECT sum(n) n, sum(lgamma(n + 1)) own FROM ({counts}) {'GROUP BY ' + ', '.join(by) if by else ''}"
    return f"SELECT '{name}' model, sum(n)::BIGINT n, round(sum(lgamma(n + k) - lgamma(k) - own) / ln(2), 2) bits FROM ({inner}), (SELECT count(DISTINCT q) k FROM hist)"


@query(sql(" UNION ALL ".join(sql_adaptive(name, by) for name, by in CONTEXTS.items()), HISTORY))
def adaptive_quality_bits(spark, sf_dir):
    """Adaptive code lengths of qualities that have one before them, under several contexts."""
    joint = written(kernels.context_counts(reads(spark, sf_dir), {"": ["pos", "q1", "base", "q"]}))
    k = joint.select("q").distinct().count()
    return columns.adaptive_models(joint.where("q1 is not null"), "q", CONTEXTS, k)


@query(sql("SELECT k, round((sum(n * log2(n)) - sum(own)) / sum(n), 6) h, sum(n)::BIGINT n, count(*) n_contexts FROM (SELECT k, c, sum(n) n, sum(n * log2(n)) own FROM (SELECT k, substr(seq, i, k) c, substr(seq, i + k, 1) base, count(*) n FROM (SELECT seq, k, unnest(range(1, length(seq) - k + 1)) i FROM (SELECT seq, unnest(range(4, 9)) k FROM reads) WHERE length(seq) > k) GROUP BY ALL) GROUP BY k, c) GROUP BY k"))
def long_context_entropy(spark, sf_dir):
    """H(base | k bases before it) for k = 4 to 8."""
    joint = kernels.context_counts(reads(spark, sf_dir), {str(k): [f"p{k}", "base"] for k in range(4, 9)})
    joint = joint.select(F.col("model").cast("int").alias("k"), F.coalesce(*[f"p{k}" for k in range(4, 9)]).alias("c"), "base", "n").where("c is not null")
    by = joint.groupBy("k", "c").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("own"))
    return by.groupBy("k").agg(((F.sum(F.col("n") * F.log2("n")) - F.sum("own")) / F.sum("n")).alias("h"), F.sum("n").alias("n"), F.count("*").alias("n_contexts"))


# ---- records


@query(sql("SELECT ord, CASE WHEN ord IN (SELECT ord1 FROM slots WHERE ord1 IS NOT NULL AND ord2 IS NOT NULL) THEN 'R1' WHEN ord IN (SELECT ord2 FROM slots WHERE ord1 IS NOT NULL AND ord2 IS NOT NULL) THEN 'R2' ELSE 'SE' END AS file FROM (SELECT ord1 ord FROM slots WHERE ord1 IS NOT NULL UNION SELECT ord2 FROM slots WHERE ord2 IS NOT NULL)", "slots AS (SELECT name, max(CASE WHEN flag & 64 > 0 THEN ord END) ord1, max(CASE WHEN flag & 128 > 0 THEN ord END) ord2 FROM aln WHERE flag & 2304 = 0 GROUP BY name)"))
def extracted_files(spark, sf_dir):
    """The file that each record goes to when reads are extracted: first mates, second mates, or single reads."""
    pairs, single = align.mates(aln(spark, sf_dir))
    both = pairs.select(F.explode(F.array(F.struct(F.col("ord1").alias("ord"), F.lit("R1").alias("file")), F.struct(F.col("ord2").alias("ord"), F.lit("R2").alias("file")))).alias("x")).select("x.*")
    return both.unionByName(single.select("ord", F.lit("SE").alias("file")))



# ---- k-mer selections and similarity joins

PLACES = f"mp AS (SELECT DISTINCT ord, m.kmer kmer, m.pos pos, substr(seq, m.pos::BIGINT + 1, 23) = m.kmer AS forward FROM (SELECT ord, seq, p, n, min({{'kmer': least(x, {rc('x')}), 'pos': p}}) OVER (PARTITION BY ord ORDER BY p ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) m FROM (SELECT ord, seq, i - 1 AS p, substr(seq, i, 23) x, length(seq) n FROM (SELECT *, unnest(range(1, length(seq) - 21)) i FROM reads WHERE length(seq) >= 32))) WHERE p <= n - 31)"


@query(sql("SELECT ord, kmer, pos, forward FROM mp", PLACES))
def minimizer_places(spark, sf_dir):
    """Minimizers (23, 9) of each read with their places and strands."""
    return kernels.minimizer_places(reads(spark, sf_dir))


@query(sql(f"SELECT r.ord, coalesce(array_to_string(l[1:2], ','), '') two, coalesce(array_to_string(l[1:8], ','), '') sketch FROM reads r LEFT JOIN (SELECT ord, list_sort(list(DISTINCT kmer)) l FROM {sql_kmers(21)} GROUP BY ord) k ON r.ord = k.ord"))
def kmer_sketches(spark, sf_dir):
    """The two and the eight least canonical 21-mers of each read."""
    s = F.col("s")
    return kernels.sketches(reads(spark, sf_dir), 21, 8).select("ord", F.array_join(F.slice(s, 1, 2), ",").alias("two"), F.array_join(s, ",").alias("sketch"))


@query(sql(f"SELECT ord, string_agg(pos, ',' ORDER BY pos) places FROM (SELECT ord, pos, x, list_min(list_transform(range(1, 13), lambda j: substr(x, j, 10))) m FROM {sql_kmers(21)}) WHERE substr(x, 1, 10) = m OR substr(x, 12, 10) = m GROUP BY ord"))
def closed_syncmer_places(spark, sf_dir):
    """Places of the 21-mers whose least 10-mer stands at either end."""
    own = kernels.closed_syncmers(reads(spark, sf_dir))
    return own.select("ord", F.array_join(F.col("p").cast("array<string>"), ",").alias("places"))


SEEDS = "seeds AS (SELECT chunk AS ref, arg_min(seq, ord) seq FROM reads GROUP BY chunk)"


def seeds(spark, sf_dir):
    """References (ref, seq): the first read of every chunk."""
    first = reads(spark, sf_dir).groupBy("chunk").agg(F.min(F.struct("ord", "seq")).alias("m"))
    return first.select(F.col("chunk").alias("ref"), F.col("m.seq").alias("seq"))


@query(sql(f"SELECT kmer, ref, pos AS position, place FROM (SELECT kmer, ref, pos, row_number() OVER (PARTITION BY kmer ORDER BY ref, pos) place FROM (SELECT ref, i - 1 AS pos, least(substr(seq, i, 21), {rc('substr(seq, i, 21)')}) kmer FROM (SELECT *, unnest(range(1, length(seq) - 19)) i FROM seeds)) WHERE pos % 2 = 0 AND kmer NOT LIKE '%N%') WHERE place <= 100", SEEDS))
def capped_index(spark, sf_dir):
    """Index of every second 21-mer of the first reads, up to 100 places each."""
    return mapping.index(seeds(spark, sf_dir), 21, 2, 100).withColumnRenamed("at", "position")


HITS = (
    f"{SEEDS}, both2 AS (SELECT ord, false is_rc, seq s FROM reads WHERE length(seq) >= 21 UNION ALL SELECT ord, true, {rc('seq')} FROM reads WHERE length(seq) >= 21), "
    "asked AS (SELECT ord, is_rc, s, a, substr(s, a + 1, 21) kmer FROM (SELECT *, unnest(list_distinct(list_transform(range(0, 4), lambda i: (i * (length(s) - 21)) // 3))) a FROM both2)), "
    "tab AS (SELECT ref, i - 1 AS p, substr(seq, i, 21) kmer FROM (SELECT *, unnest(range(1, length(seq) - 19)) i FROM seeds)), "
    "met AS (SELECT DISTINCT ord, is_rc, s, ref, p - a AS place FROM asked JOIN tab USING (kmer) WHERE kmer NOT LIKE '%N%' AND p >= a), "
    "hit AS (SELECT ord, is_rc, ref, place, s, d, row_number() OVER (PARTITION BY ord ORDER BY d, ref, place, is_rc) r, rs FROM (SELECT m.*, x.seq rs, list_sum(list_transform(range(1, length(s) + 1), lambda i: (substr(s, i, 1) <> substr(x.seq, place + i, 1))::INT)) d FROM met m JOIN seeds x ON m.ref = x.ref WHERE place + length(s) <= length(x.seq)) WHERE d <= 8)"
)


@query(sql("SELECT ord, ref, place AS position, is_rc, d::BIGINT mismatches FROM hit WHERE r = 1", HITS))
def seed_hits(spark, sf_dir):
    """The best place of each read in the first read of any chunk, on either strand, by four anchors."""
    return mapping.best_hits(reads(spark, sf_dir), seeds(spark, sf_dir)).withColumnRenamed("at", "position")


@query(sql("SELECT h.ord, array_to_string(list_transform(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) <> substr(rs, place + i, 1)), lambda i: (i - 1) || substr(s, i, 1)), ',') diffs, CASE WHEN is_rc THEN " + rc("s") + " ELSE s END AS back FROM hit h WHERE r = 1", HITS))
def mapped_read_mismatches(spark, sf_dir):
    """What mapped reads store besides their place, and the reads rebuilt from it."""
    r, refs = reads(spark, sf_dir), seeds(spark, sf_dir)
    stored = written(mapping.mismatches(r, mapping.best_hits(r, refs), refs))  # read twice
    back = mapping.undo_mismatches(stored, refs).select("ord", F.col("seq").alias("back"))
    listed = F.array_join(F.transform("diffs", lambda x: F.concat(x["pos"].cast("string"), x["base"])), ",")
    return stored.select("ord", listed.alias("diffs")).join(back, "ord")


OVER = "mk AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY kmer) c FROM mp) WHERE c BETWEEN 2 AND 50), pr AS (SELECT DISTINCT x.ord a, y.ord b, x.pos::BIGINT - y.pos::BIGINT AS shift FROM mk x JOIN mk y ON x.kmer = y.kmer AND x.forward = y.forward AND x.ord < y.ord)"


@query(sql("SELECT a, b, shift, n, d::BIGINT mismatches FROM (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: (substr(s, greatest(shift, 0) + i, 1) <> substr(t, greatest(-shift, 0) + i, 1))::INT)) d FROM (SELECT a, b, shift, x.seq s, y.seq t, least(length(x.seq) - greatest(shift, 0), length(y.seq) - greatest(-shift, 0)) n FROM pr JOIN reads x ON x.ord = a JOIN reads y ON y.ord = b) WHERE n >= 31) WHERE d <= 4", f"{PLACES}, {OVER}"))
def read_overlaps(spark, sf_dir):
    """Pairs of reads that overlap by 31 bases or more with up to four mismatches, found by shared minimizers."""
    return mapping.overlaps(reads(spark, sf_dir))


# ---- more contexts, models and codecs


@query(sql("SELECT least(pos // 20, 19) * 200 + least(coalesce(q1, 0), 39) * 5 + CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS context, CASE WHEN pos < 8 THEN pos ELSE 8 + pos // 8 END * 64 + (coalesce(q1, 0) + 33) // 4 AS context2, count(*) n, sum(q)::BIGINT total FROM hist GROUP BY ALL", HISTORY))
def alternative_contexts(spark, sf_dir):
    """Counts under two other numberings of contexts: position by twenties, last quality and base; position and last byte."""
    h = kernels.context_counts(reads(spark, sf_dir), {"": ["pos", "q1", "base", "q"]})
    one, two = quality.context_by_base(F.col("pos"), F.coalesce("q1", F.lit(0)), F.col("base")), quality.context_by_byte(F.col("pos"), F.coalesce("q1", F.lit(0)) + 33)
    return h.groupBy(one.alias("context"), two.alias("context2")).agg(F.sum("n").alias("n"), F.sum(F.col("q") * F.col("n")).alias("total"))


@query(sql(f"SELECT chunk, sum(n)::BIGINT n, round((lgamma(sum(n) + {len(PHREDS)}) - lgamma({len(PHREDS)}) - sum(lgamma(n + 1))) / ln(2), 2) bits FROM (SELECT chunk, q, count(*) n FROM bases GROUP BY ALL) GROUP BY chunk"))
def rescaled_quality_bits(spark, sf_dir):
    """Code length of each chunk's qualities under a model whose counts are halved beyond 2 ** 20."""
    out = stats.rescaled_bits(reads(spark, sf_dir), "chunk", "ord", "qual", PHREDS, 1 << 20)
    return out.withColumn("bits", F.round("bits", 2))


@query(sql("SELECT chunk, codec, sum(length(seq))::BIGINT n_bytes, sha256(string_agg(seq, '' ORDER BY ord)) digest FROM reads, (VALUES ('bz2'), ('zlib'), ('zstd')) v(codec) GROUP BY ALL"))
def codec_round_trips(spark, sf_dir):
    """Length and digest of each chunk's bases after compressing and decompressing them with every codec."""
    whole = reads(spark, sf_dir).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("ord", "seq"))).alias("v")).select("chunk", F.array_join(F.transform("v", lambda x: x["seq"]), "").alias("s"))
    out = None
    for codec in codecs.CODECS:
        back = codecs.decompress(codecs.compress(F.col("s"), codec), codec)
        one = whole.select("chunk", F.lit(codec).alias("codec"), back.alias("b")).select("chunk", "codec", F.length("b").cast("long").alias("n_bytes"), F.sha2("b", 256).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("SELECT ord, seq FROM reads WHERE NOT contains(seq, 'N')"))
def reads_without_n(spark, sf_dir):
    """Reads without an unknown base, as the analyses of sequence contexts load them."""
    return reads(spark, sf_dir).where(~F.contains("seq", F.lit("N"))).select("ord", "seq")
